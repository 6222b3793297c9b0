"""Language identification: one bit-sliced Bloom filter answers, for every n-gram of a
text, with the set of languages that have it; bits are counted a language and corrected
for the filter's own false positives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm.names import col
from cohortlens.llm.vectext import U64, buffers, mix, small_arrow, small_batches

_SLICE = 1 << 18


@dataclass(frozen=True)
class LanguageFilters:
    """An n-gram is four bytes of the lower-cased text with everything but letters turned
    into single spaces. It belongs to a language if it makes up ``least_share`` of that
    language's n-grams or more, so a language has at most 1/``least_share`` of them and the
    filter has a fixed size. Counts come from about ``fit_rows`` documents a language at
    most, chosen by a hash of their ids."""

    fit_rows: int = 20_000
    least_share: float = 5e-5
    slots: int = 1 << 18
    hashes: int = 3


def letters(column: pa.Array) -> pa.Array:
    """Lower-cased letters with one space around each word; null is empty."""
    low = pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))
    return pc.replace_substring_regex(pc.binary_join_element_wise(" ", low, " ", ""), r"[^\p{L}\p{M}]+", " ")


def grams(buf: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All 4-byte n-grams as integers, and the row that each is from, a slice at a time."""
    rows = np.arange(len(offs) - 1)
    for s in range(0, max(0, len(buf) - 3), _SLICE):
        e = min(len(buf) - 3, s + _SLICE)
        part = buf[s : e + 3].astype(np.uint32)
        g = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) | part[3:] << np.uint32(24)
        row = np.repeat(rows, np.diff(np.clip(offs, s, e)))
        inside = np.arange(s + 4, e + 4) <= offs[row + 1]
        yield g[inside], row[inside]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches ``lang, text`` to ``lang, gram, n``: what one task has seen, in blocks."""
    kept: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in kept[lang]]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in kept[lang]]), len(keys)).astype(np.int64)

    def out(lang: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    for batch in small_batches(batches, 1):
        names = np.array(batch.column(0).to_pylist(), dtype=object)
        for lang in dict.fromkeys(names):
            buf, offs = buffers(letters(batch.column(1).filter(pa.array(names == lang))))
            for g, _ in grams(buf, offs):
                kept.setdefault(lang, []).append(np.unique(g, return_counts=True))
                if len(kept[lang]) > 16:
                    kept[lang] = [merged(lang)]
                    if len(kept[lang][0][0]) > 1 << 20:
                        yield out(lang, *kept.pop(lang)[0])
    for lang in kept:
        yield out(lang, *merged(lang))


@dataclass(frozen=True)
class BitSlicedFilter:
    """``table``: for each slot the languages that have set it, in as many words of 64 bits
    as they need (bit i of word k: ``langs[64 k + i]``)."""

    langs: tuple[str, ...]
    table: np.ndarray
    hashes: int

    def slots(self, g: np.ndarray) -> list[np.ndarray]:
        h = mix(g.astype(U64) + U64(0x9E3779B97F4A7C15))
        return [((h >> U64(20 * k)) & U64(len(self.table) - 1)).astype(np.int64) for k in range(self.hashes)]

    def which(self, g: np.ndarray) -> np.ndarray:
        """A row of words for each n-gram: the bits of all languages that contain it."""
        first, *rest = self.slots(g)
        found = self.table[first]
        for at in rest:
            found &= self.table[at]
        return found

    def false_rates(self) -> np.ndarray:
        return np.array([np.mean(has(self.table, i)) ** self.hashes for i in range(len(self.langs))])


def has(words: np.ndarray, i: int) -> np.ndarray:
    """Whether bit ``i`` is set in each row of words."""
    return (words[:, i // 64] >> U64(i % 64) & U64(1)).astype(bool)


def learn(train: DataFrame, p: LanguageFilters = LanguageFilters()) -> BitSlicedFilter:
    """The filter of all languages in ``doc_id, text, lang``; rows without a language or
    without text teach nothing. Every language has a bit, however many there are."""
    small_arrow(train.sparkSession)
    train = train.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text")
    shares = train.groupBy("lang").agg(F.least(F.lit(1.0), p.fit_rows / F.count("*")).alias("share"))
    rows = sorted(r.lang for r in shares.collect())
    table = np.zeros((p.slots, -(-len(rows) // 64)), U64)
    if not rows:
        return BitSlicedFilter((), table, p.hashes)
    chosen = train.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    found = counts.join(F.broadcast(total), "lang").where(F.col("n") >= p.least_share * F.col("total")).select("lang", "gram").toArrow()
    langs = tuple(rows)
    out = BitSlicedFilter(langs, table, p.hashes)
    names, keys = np.array(found.column("lang").to_pylist(), dtype=object), found.column("gram").to_numpy().astype(np.uint32)
    for i, lang in enumerate(langs):
        for at in out.slots(keys[names == lang]):
            table[at, i // 64] |= U64(1) << U64(i % 64)
    return out


def _predict(batches: Iterator[pa.RecordBatch], shared, text: int, keep: int, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """Column ``text`` is the text; the first ``keep`` go through."""
    f: BitSlicedFilter = shared.value
    false = f.false_rates()
    for batch in small_batches(batches, text):
        buf, offs = buffers(letters(batch.column(text)))
        n = np.zeros(batch.num_rows, np.int64)
        hits = np.zeros((len(f.langs), batch.num_rows))
        for g, row in grams(buf, offs):
            n += np.bincount(row, minlength=len(n))
            found = f.which(g)
            for i in range(len(f.langs)):
                hits[i] += np.bincount(row[has(found, i)], minlength=len(n))
        # marks are parts of n-grams, but no letters
        has_letter = pc.match_substring_regex(pc.fill_null(batch.column(text).cast(pa.string()), ""), r"\p{L}").to_numpy(zero_copy_only=False)
        if len(f.langs):
            true = np.clip((hits - np.outer(false, n)) / (1 - false[:, None] + 1e-12), 0, None)
            best = true.argmax(axis=0)
            score = np.clip(true.max(axis=0) / np.maximum(n, 1), 0, 1)
            pred = [f.langs[b] if ok else "und" for b, ok in zip(best, has_letter, strict=True)]
        else:
            score, pred = np.zeros(len(n)), ["und"] * len(n)
        score = np.where(has_letter, score, 0.0)
        kept = [batch.column(k) for k in range(keep)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names[:keep], *names])


def identify(docs: DataFrame, f: BitSlicedFilter, keep: tuple[str, ...] = ("doc_id",), text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns and, under ``names``, language and score of each row. A text among
    the kept columns goes to Python once.

    ``und`` with score 0 where the text is null or has no letter, or where no language was
    learned; otherwise the language with most n-grams of the text (ties: the first by
    name) and the share of n-grams it has, both after the correction. Repeated rows are
    answered alike; an empty table gives an empty one; further columns are ignored. A kept
    column with one of the ``names`` is replaced.
    """
    spark = docs.sparkSession
    small_arrow(spark)
    keep = tuple(c for c in keep if c not in names)
    # Python gets columns by place, as it could not tell a dot in a name from a field's
    places = [f"c{k}" for k in range(len(keep))]
    sent = docs.select(*[col(c).alias(k) for c, k in zip(keep, places, strict=True)])
    schema = "".join(f"{k} {kind}, " for k, kind in sent.dtypes) + "told string, score double"
    shared = spark.sparkContext.broadcast(f)
    at = keep.index(text) if text in keep and dict(docs.dtypes)[text] == "string" else len(keep)
    if at == len(keep):
        sent = docs.select(*[col(c).alias(k) for c, k in zip(keep, places, strict=True)], col(text).cast("string").alias("text"))
    out = sent.mapInArrow(partial(_predict, shared=shared, text=at, keep=len(keep), names=("told", "score")), schema)
    return out.toDF(*keep, *names)


def fold(doc_id: str, of: int):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(of))


def op2_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the four folds that are not held out. Nulls,
    empty and long texts, ties, repeated rows, empty tables and further columns: as in
    ``learn`` and ``identify``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    f = learn(docs.where(fold("doc_id", 5) != 0))
    out = identify(docs, f)
    return out.select("doc_id", fold("doc_id", 5).eqNullSafe(0).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_filters": op2_language_filters}
ORACLES: dict = {}
