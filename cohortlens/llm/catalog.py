"""The queries of this subpackage with their SQL twins."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("archives", "invertible", "langid", "lexical", "linededup", "minhash", "mixing", "multiindex", "ngram_lm", "pii", "reputation", "semantic", "whitening")


def _all(name: str) -> dict:
    return {k: v for m in _MODULES for k, v in getattr(import_module(f"cohortlens.llm.{m}"), name).items()}


def queries() -> dict:
    import corpus_pipeline

    return _all("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    return _all("ORACLES") | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
