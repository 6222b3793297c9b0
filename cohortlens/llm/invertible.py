"""Document fingerprints that can be subtracted: invertible Bloom lookup tables of
paragraph digests, in Spark functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.workspace import Workspace


@dataclass(frozen=True)
class Table:
    """Three ranges of ``width`` cells each; a digest is in one cell of each. ``rounds``:
    peeling stops after so many at the latest. A failed comparison is repeated with a table
    for each of several groups of digests, about ``load`` digests each, then with four
    times as many groups; if that fails too, the digests themselves are compared."""

    width: int = 10
    rounds: int = 16
    load: int = 8


#: A line, cut after the first sentence that ends past 160 characters (and within 320).
PARAGRAPH = r"[^\n]{160,320}?[.!?](?= )|[^\n]+"
_CELL = "struct<n:int,key:bigint,mark:bigint>"


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs; blank ones do not count."""
    found = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(found, lambda x: F.xxhash64(x)))


def _mark(key: Column) -> Column:
    return F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(0xFFFFFFFF))


def _place(key: Column, part: int, t: Table, turn: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key, F.lit(100 + turn)), 20 * part).bitwiseAND(F.lit(0xFFFFF)), F.lit(t.width)).cast("int")


def keyed(digests: Column, t: Table = Table(), turn: int = 0) -> Column:
    """Digests with their marks and their cell in each range."""
    return F.transform(digests, lambda d: F.struct(d.alias("key"), F.lit(1).alias("sign"), _mark(d).alias("mark"), *[_place(d, j, t, turn).alias(f"p{j}") for j in range(3)]))


def _less(a: Column, x: Column) -> Column:
    """A cell without a digest that counted ``sign``."""
    return F.struct((a["n"] - x["sign"]).alias("n"), a["key"].bitwiseXOR(x["key"]).alias("key"), a["mark"].bitwiseXOR(x["mark"]).alias("mark"))


def sketch(keys: Column, t: Table = Table()) -> Column:
    """The cells of ``keyed`` digests: how many fell in each, and the exclusive or of them
    and of their marks."""
    zero = F.expr(f"cast(named_struct('n', 0, 'key', 0L, 'mark', 0L) as {_CELL})")

    def add(a: Column, x: Column) -> Column:
        return F.struct((a["n"] + 1).alias("n"), a["key"].bitwiseXOR(x["key"]).alias("key"), a["mark"].bitwiseXOR(x["mark"]).alias("mark"))

    def part(j: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(t.width - 1)), lambda i: F.aggregate(F.filter(keys, lambda x: x[f"p{j}"] == i), zero, add))

    return F.concat(*[part(j) for j in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["key"].bitwiseXOR(y["key"]).alias("key"), x["mark"].bitwiseXOR(y["mark"]).alias("mark")))


def peel(cells: Column, t: Table = Table(), turn: int = 0) -> Column:
    """``only_a, only_b``: how many digests only the first and only the second side has;
    ``whole``: whether nothing is left. In turns, every cell with a single digest gives it
    away, and the digests given are taken out of all their cells."""
    none = F.array().cast("array<struct<key:bigint,sign:int,mark:bigint,p0:int,p1:int,p2:int>>")
    state = F.struct(cells.alias("cells"), none.alias("got"), F.lit(0).alias("only_a"), F.lit(0).alias("only_b"))

    def single(c: Column) -> Column:
        return ((c["n"] == 1) | (c["n"] == -1)) & (c["mark"] == _mark(c["key"]))

    def digest(c: Column) -> Column:
        return F.struct(c["key"].alias("key"), c["n"].alias("sign"), c["mark"].alias("mark"), *[_place(c["key"], j, t, turn).alias(f"p{j}") for j in range(3)])

    def step(s: Column, k: Column) -> Column:
        give = F.struct(s["cells"].alias("cells"), F.array_distinct(F.transform(F.filter(s["cells"], single), digest)).alias("got"), s["only_a"].alias("only_a"), s["only_b"].alias("only_b"))

        def left(c: Column, i: Column) -> Column:
            here = F.filter(s["got"], lambda x: F.when(i < t.width, x["p0"] == i).when(i < 2 * t.width, x["p1"] == i - t.width).otherwise(x["p2"] == i - 2 * t.width))
            return F.aggregate(here, c, _less)

        take = F.struct(
            F.transform(s["cells"], left).alias("cells"), none.alias("got"),
            (s["only_a"] + F.size(F.filter(s["got"], lambda x: x["sign"] == 1))).alias("only_a"), (s["only_b"] + F.size(F.filter(s["got"], lambda x: x["sign"] == -1))).alias("only_b"),
        )
        return F.when(k % 2 == 1, give).when(F.size(s["got"]) > 0, take).otherwise(s)

    def end(s: Column) -> Column:
        empty = F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["mark"] == 0))
        return F.struct(s["only_a"].alias("only_a"), s["only_b"].alias("only_b"), empty.alias("whole"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(2 * t.rounds)), state, step, end)


def differences(df: DataFrame, pairs: dict[str, tuple[str, str]], t: Table = Table()) -> DataFrame:
    """For each ``name: (a, b)`` a column ``name`` with ``only_a, only_b``: how many digests
    only one of the columns ``d_a``, ``d_b`` has, from their tables ``cells_a``, ``cells_b``;
    where peeling fails, from larger ones, made of a table a group of digests."""
    base = df.columns
    df = df.withColumns({name: peel(subtract(F.col(f"cells_{a}"), F.col(f"cells_{b}")), t) for name, (a, b) in pairs.items()})
    for turn, times in ((1, 1), (2, 4)):
        groups = {n: F.greatest(F.lit(2), F.ceil((F.size(f"d_{a}") + F.size(f"d_{b}")) / t.load) * times).cast("int") for n, (a, b) in pairs.items()}
        sides = [(n, side, d) for n, (a, b) in pairs.items() for side, d in (("a", a), ("b", b))]
        failed = {n: ~F.col(n)["whole"] for n in pairs}
        df = df.withColumns({f"__g_{n}": F.when(failed[n], groups[n]) for n in pairs})
        df = df.withColumns({f"__k_{n}_{s}": F.when(failed[n], keyed(F.col(f"d_{d}"), t, turn)) for n, s, d in sides})
        df = df.withColumns({f"__k_{n}_{s}": F.when(failed[n], _split(F.col(f"__k_{n}_{s}"), F.col(f"__g_{n}"), turn)) for n, s, _ in sides})
        df = df.withColumns({f"__k_{n}_{s}": F.when(failed[n], F.transform(f"__k_{n}_{s}", lambda k: sketch(k, t))) for n, s, _ in sides})
        df = df.withColumns({f"__k_{n}_a": F.when(failed[n], F.zip_with(f"__k_{n}_a", f"__k_{n}_b", subtract)) for n in pairs})
        df = df.withColumns({f"__k_{n}_a": F.when(failed[n], F.transform(f"__k_{n}_a", lambda c: peel(c, t, turn))) for n in pairs})
        df = df.withColumns({n: F.when(failed[n], _total(F.col(f"__k_{n}_a"))).otherwise(F.col(n)) for n in pairs}).select(*base, *pairs)
    exact = lambda a, b: F.struct(F.size(F.array_except(f"d_{a}", f"d_{b}")).alias("only_a"), F.size(F.array_except(f"d_{b}", f"d_{a}")).alias("only_b"), F.lit(True).alias("whole"))
    return df.withColumns({n: F.when(F.col(n)["whole"], F.col(n)).otherwise(exact(a, b)) for n, (a, b) in pairs.items()})


def _split(keys: Column, groups: Column, turn: int) -> Column:
    return F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.filter(keys, lambda x: F.pmod(F.xxhash64(x["key"], F.lit(200 + turn)), groups) == g))


def _total(peeled: Column) -> Column:
    none = F.struct(F.lit(0).alias("only_a"), F.lit(0).alias("only_b"), F.lit(True).alias("whole"))
    return F.aggregate(peeled, none, lambda s, x: F.struct((s["only_a"] + x["only_a"]).alias("only_a"), (s["only_b"] + x["only_b"]).alias("only_b"), (s["whole"] & x["whole"]).alias("whole")))


def likeness(d: Column, a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of digests, given what only one has; 1 if both are empty."""
    union = F.size(a) + d["only_b"]
    return F.when(union == 0, F.lit(1.0)).otherwise((F.size(a) - d["only_a"]) / union)


def written(cells: Column) -> Column:
    """The table as hexadecimal text: 4 digits of the count, 16 of the key, 8 of the mark."""
    return F.array_join(F.transform(cells, lambda c: F.concat(F.lpad(F.hex(c["n"].bitwiseAND(F.lit(0xFFFF))), 4, "0"), F.lpad(F.hex(c["key"]), 16, "0"), F.lpad(F.hex(c["mark"]), 8, "0"))), "")


def successors(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``id, before, need``: for each id the next larger one (for the largest: the smallest),
    whose edited text ends with this one's beginning, and how many code points it takes.

    Ids alone are sorted, in ranges; a table with a row a range links their ends.
    """
    from pyspark.sql import Window as W

    ids = docs.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    ranges = ws.table(ids.repartitionByRange(F.col("id")).withColumn("range", F.spark_partition_id()), "ranges")
    ends = ranges.groupBy("range").agg(F.min(F.struct("id", "n")).alias("low"))
    over = W.orderBy("range")  # as many rows as there are ranges
    first = ranges.agg(F.min(F.struct("id", "n")).alias("first"))
    ends = ends.select("range", F.lead("low").over(over).alias("next")).join(F.broadcast(first)).select("range", F.coalesce("next", "first").alias("up"))
    inside = F.lead(F.struct("id", "n")).over(W.partitionBy("range").orderBy("id"))
    linked = ranges.select("range", "id", inside.alias("inside")).join(F.broadcast(ends), "range")
    top = F.coalesce("inside", "up")
    return ws.table(linked.select("id", top["id"].alias("before"), F.floor(top["n"] / 3).cast("int").alias("need")), "successors")


def fingerprint_edits(docs: DataFrame, t: Table = Table()) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` of every row of ``doc_id, text``.

    The edited text is the text with its last third replaced by the start of the text with
    the next smaller doc_id (after the smallest: the largest). A null text is an empty one;
    two texts without paragraphs are alike (1). A null doc_id comes after the smallest. Of
    rows that repeat a doc_id each is a row of the result; as a neighbour the largest text
    counts. A single document is its own neighbour. Extra columns are ignored; an empty
    table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "sketch")
    # both joins take the same columns by the same key, so the texts are shuffled once
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    after = rows.join(successors(rows, ws), "id").groupBy("id", "before", "need").agg(F.max("text").alias("text"))
    after = after.select(F.col("before").alias("id"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("start"), paragraph_digests(F.col("text")).alias("d_next"))
    both = rows.join(after, "id")
    third = F.floor(F.length("text") / 3).cast("int")
    both = both.withColumn("n", F.length("text")).withColumn("third", third)
    both = both.select(F.when(F.col("id") > -(1 << 63), F.col("id")).alias("doc_id"), "n", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - F.col("third")), F.substring(F.col("start"), F.lit(1), F.col("third"))).alias("edited"), paragraph_digests(F.col("text")).alias("d_own"), "d_next")
    both = both.select("doc_id", "n", F.sha2("edited", 256).alias("edited_sha256"), "d_own", "d_next", paragraph_digests(F.col("edited")).alias("d_edited"))
    kinds = ("own", "next", "edited")
    both = both.withColumns({f"keyed_{x}": keyed(F.col(f"d_{x}"), t) for x in kinds})
    both = both.withColumns({f"cells_{x}": sketch(F.col(f"keyed_{x}"), t) for x in kinds}).drop(*[f"keyed_{x}" for x in kinds])
    both = differences(both, {"diff_edited": ("own", "edited"), "diff_next": ("own", "next")}, t)
    return both.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", written(F.col("cells_own")).alias("fingerprint"), written(F.col("cells_edited")).alias("edited_fingerprint"),
        likeness(F.col("diff_edited"), F.col("d_own"), F.col("d_edited")).alias("near_edited"), likeness(F.col("diff_next"), F.col("d_own"), F.col("d_next")).alias("near_next"),
    )


def op6_lookup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edits. Nulls, empty and long texts, ties,
    repeated rows, an empty table and further columns: as in ``fingerprint_edits``."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_lookup_tables": op6_lookup_tables}
ORACLES: dict = {}
