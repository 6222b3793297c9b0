import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, row string, host string, `__n` int, key string, copy string, pii string, rep string, `a.b` int"
WORDS = "the of and to in that was his with which this from they would there were been have when more will other some upon into shall only over such then like".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    out = [r.choice(WORDS) + r.choice(["", "", "ly", "ing", "er"]) for _ in range(words)]
    for k in range(7, words, 9):
        out[k] += "."
    return " ".join(out)


def rows_of(texts):
    """(doc_id, text, lang, source) as rows with extra columns whose names operators use."""
    return [(i, t, lang, source, len(t or ""), 1, "x", "y", 2, "k", "c", "p", "r", 5) for i, t, lang, source in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long one, repeated rows, ties."""
    base = prose(1, 120)
    texts = [(1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "a"), (5, " \t\n ", "en", None), (None, prose(2, 50), "fr", "b"), (None, None, None, None)]
    texts += [(6, prose(3, 30_000), "en", "a"), (7, "1234 !!", "en", "b"), (8, "one", None, "b"), (-5, base + " tail of words", "en", "b"), (9, "line\nline\nother line\n", "de", "a")]
    return spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
