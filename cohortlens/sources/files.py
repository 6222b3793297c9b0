"""Readers of sequence, interval, tree and detector files as DataFrames."""

from __future__ import annotations

import re
from functools import partial
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions import scalars as S
from cohortlens.workspace import Workspace


def read_tsv(spark: SparkSession, path: str, columns: list[str] | None = None, comment: str | None = None) -> DataFrame:
    """All columns as trimmed text; ``columns`` prunes the scan."""
    reader = spark.read.option("sep", "\t").option("header", True)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in columns or df.columns])


def read_metadata(spark: SparkSession, path: str, names: tuple[str, ...] = ("accession", "Accession", "seqName")) -> DataFrame:
    """A metadata table with its key column, however spelled, as ``accession`` (first token)."""
    df = read_tsv(spark, path)
    key = S.resolve_column(df, names)
    return df.withColumnRenamed(key, "accession").withColumn("accession", S.first_token(F.col("accession")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``accession, header, seq, ord``: records in file order; ``ord`` (a struct) grows along a
    file, and from file to file of a folder by their paths. Spark reads the parts of files by
    size, not in order: their places come first in ``ord``, row numbers tell within a part."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", at.alias("ord"))
    body = F.regexp_replace(F.col("value"), "^>", "")
    header = F.trim(F.regexp_extract(body, r"^([^\r\n]*)", 1))
    seq = F.regexp_replace(F.regexp_replace(body, r"^[^\r\n]*", ""), r"\s", "")
    return raw.where(F.trim("value") != "").select(S.first_token(header).alias("accession"), header.alias("header"), seq.alias("seq"), "ord")


def last_records(fasta: DataFrame) -> DataFrame:
    """One row an accession: the last in file order."""
    return fasta.groupBy("accession").agg(F.max_by("header", "ord").alias("header"), F.max_by("seq", "ord").alias("seq"), F.max("ord").alias("ord"))


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """Records of one length; another length is an error when rows are read."""
    df = read_fasta(spark, path)
    width = df.agg(F.max(F.length("seq")).alias("width"))
    same = F.assert_true(F.length("seq") == F.col("width"), F.lit("sequences of different lengths"))
    return df.join(F.broadcast(width)).where(same.isNull()).drop("width")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``start, end, label``, 0-based and half-open; anything but intervals is skipped."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.trim("value").rlike("^(#|track|$)") & (F.size(f) >= 3))
    rows = rows.select(f[1].try_cast("int").alias("start"), f[2].try_cast("int").alias("end"), F.get(f, F.lit(3)).alias("label"))
    return rows.where("start IS NOT NULL AND end > start")


def read_node_state(spark: SparkSession, path: str, node: str) -> DataFrame:
    """``site, base`` of one node of an ancestral-state table; sites that are missing or not
    A, C, G or T are N. No row at all is an error."""
    df = read_tsv(spark, path, comment="#").where(F.col("Node") == node).select(F.col("Site").cast("int").alias("site"), F.upper("State").alias("state"))
    last = df.agg(F.max("site")).first()[0]
    if last is None:
        raise ValueError(f"no state of node {node}")
    base = F.when(F.col("state").isin("A", "C", "G", "T"), F.col("state")).otherwise("N")
    return spark.range(1, last + 1).select(F.col("id").cast("int").alias("site")).join(df, "site", "left").select("site", base.alias("base"))


def read_newick(text: str) -> list[tuple[int, int | None, str, float, bool]]:
    """``(id, parent, label, distance, is_leaf)`` of a tree, in preorder; a small parser, as a
    tree is a single line of text."""
    rows: list[list] = [[0, None, "", 0.0, True]]
    at, k, buf = 0, 0, ""

    def close() -> None:
        nonlocal buf
        label, _, dist = buf.partition(":")
        if label.strip():
            rows[at][2] = label.strip().strip("'")
        if dist.strip():
            rows[at][3] = float(dist)
        buf = ""

    for k, c in enumerate(text.strip()):
        if c == "(":
            rows[at][4] = False
            rows.append([len(rows), at, "", 0.0, True])
            at = len(rows) - 1
        elif c == ",":
            close()
            rows.append([len(rows), rows[at][1], "", 0.0, True])
            at = len(rows) - 1
        elif c == ")":
            close()
            at = rows[at][1]
        elif c == ";":
            break
        else:
            buf += c
    close()
    return [tuple(r) for r in rows]


def tree_edges(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(read_newick(text), "id long, parent long, label string, dist double, is_leaf boolean")


#: Nodes of a tree, in preorder, that one task looks through at a time.
TREE_BLOCK = 1 << 16


def newick_tree(spark: SparkSession, path: str) -> DataFrame:
    """``tree_edges`` of a Newick file of any size: ``id, parent, label, dist, is_leaf``, ids in
    preorder. The text is read in pieces between its commas and never whole: running sums
    of opened and closed brackets give each piece its depth and its first id; a node's
    parent, and the node that a closing bracket names, is the last node opened at the
    depth above. Running sums and last nodes are taken within blocks and carried from block
    to block. What follows the first ``;`` is passed over; an empty file gives no rows."""
    ws = Workspace(spark, "newick")
    raw = spark.read.option("lineSep", ",").text(path)
    # Spark may read the parts of a file in any order; their places tell the right one
    part = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = ws.table(raw.select("value", part.alias("part"), F.monotonically_increasing_id().alias("ord")), "pieces")
    end = F.broadcast(raw.where(F.col("value").contains(";")).agg(F.min(F.struct("part", "ord")).alias("end")))  # one row
    raw = raw.join(end).where(F.col("end").isNull() | (F.struct("part", "ord") <= F.col("end"))).withColumn("value", F.substring_index("value", ";", 1))
    parts = F.split(F.regexp_replace("value", r"\(", ""), r"\)")
    piece = raw.select("ord", "part", (F.length("value") - F.length(F.translate("value", "(", ""))).alias("opens"), parts.alias("texts"))
    piece = piece.withColumn("deeper", F.col("opens") - F.size("texts") + 1)
    sums = piece.groupBy("part").agg(F.sum("deeper").alias("deeper"), F.sum(F.col("opens") + 1).alias("nodes"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row a part of the file
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"all_{c}") for c in ("deeper", "nodes")])
    within = W.partitionBy("part").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    before = lambda x, c: F.coalesce(F.sum(x).over(within), F.lit(0)) + F.col(f"all_{c}")
    piece = piece.join(F.broadcast(sums), "part").withColumns({"depth": before(F.col("deeper"), "deeper"), "first": before(F.col("opens") + 1, "nodes")})
    piece = ws.table(piece.select("opens", "texts", "depth", "first"), "placed")
    last = F.col("first") + F.col("opens")
    nodes = piece.select("*", F.explode(F.sequence(F.lit(0), "opens")).alias("k")).select((F.col("first") + F.col("k")).alias("id"), (F.col("depth") + F.col("k")).alias("depth"), (F.col("k") < F.col("opens")).alias("inner"), (F.col("k") == 0).alias("starts"), F.when(F.col("k") == F.col("opens"), F.col("texts")[0]).alias("text"))
    nodes = ws.table(nodes, "nodes")
    none = F.lit(None).cast("long")
    opened = nodes.where("inner").select("depth", F.col("id").alias("at"), F.col("id").alias("open"), none.alias("child"), F.lit(None).cast("string").alias("text"))
    begun = nodes.where("starts AND id > 0").select(F.col("depth") - 1, F.col("id").alias("at"), none.alias("open"), F.col("id").alias("child"), F.lit(None).cast("string").alias("text"))
    shut = piece.select("depth", "opens", last.alias("at"), F.posexplode(F.slice("texts", 2, F.greatest(F.lit(0), F.size("texts") - 1))).alias("j", "text"))
    shut = shut.select((F.col("depth") + F.col("opens") - 1 - F.col("j")).alias("depth"), "at", none.alias("open"), none.alias("child"), "text")
    events = opened.unionAll(begun).unionAll(shut).withColumn("block", F.floor(F.col("at") / TREE_BLOCK))
    carried = events.groupBy("depth", "block").agg(F.max("open").alias("open"))
    carried = carried.select("depth", "block", F.max("open").over(W.partitionBy("depth").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    upto = F.max("open").over(W.partitionBy("depth", "block").orderBy("at").rangeBetween(W.unboundedPreceding, 0))
    seen = events.withColumn("upto", upto).where("open IS NULL").join(carried, ["depth", "block"]).withColumn("above", F.coalesce("upto", "carried"))
    seen = ws.table(seen.select("child", "text", "above"), "found")
    parents = seen.where("child IS NOT NULL").select(F.col("child").alias("id"), F.col("above").alias("parent"))
    names = seen.where("child IS NULL AND above IS NOT NULL").groupBy(F.col("above").alias("id")).agg(F.max("text").alias("name"))
    out = nodes.join(parents, "id", "left").join(names, "id", "left")
    # a node that does not start a piece hangs on the one before it
    parent = F.when(F.col("starts"), F.col("parent")).otherwise(F.col("id") - 1)
    text = F.coalesce("text", "name", F.lit(""))
    label, dist = F.split(text, ":", 2)[0], F.trim(F.get(F.split(text, ":", 2), F.lit(1)))
    label = F.btrim(F.regexp_replace(label, r"^\s+|\s+$", ""), F.lit("'"))
    return out.select("id", parent.alias("parent"), label.alias("label"), F.when(dist != "", F.regexp_replace(dist, r"\s", "").cast("double")).otherwise(0.0).alias("dist"), (~F.col("inner")).alias("is_leaf"))


def _p_value(text: Column) -> Column:
    p = F.trim(text).try_cast("double")
    return F.when((p > 0) & (p <= 1), p)


def triplet_records(lines: DataFrame, drop_ragged: bool = False) -> DataFrame:
    """``p_name, q_name, child, p1, p2, p, breakpoints, ord`` of a triplet detector's lines
    (``value``), by position: the last field may hold commas. ``p`` is the smaller of the
    two corrected values within (0, 1]. ``drop_ragged`` skips lines of over 13 fields."""
    f = F.split("value", ",", 13)
    rows = lines.withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("P_name") & (F.size(f) >= 11))
    if drop_ragged:
        rows = rows.where(F.size(F.split("value", ",")) <= 13)
    p1, p2 = _p_value(f[9]), _p_value(f[10])
    return rows.select(F.trim(f[0]).alias("p_name"), F.trim(f[1]).alias("q_name"), F.trim(f[2]).alias("child"), p1.alias("p1"), p2.alias("p2"), F.least(p1, p2).alias("p"), F.get(f, F.lit(12)).alias("breakpoints"), "ord")


def read_triplets(spark: SparkSession, path: str, drop_ragged: bool = False) -> DataFrame:
    return triplet_records(spark.read.text(path), drop_ragged)


def read_p_histogram(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) >= 4).select(f[0].try_cast("int").alias("bin"), f[1].try_cast("long").alias("count"), f[2].try_cast("double").alias("fraction"), f[3].try_cast("double").alias("log10"))


def read_tokens(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """First token of each non-blank line: lists of accessions."""
    df = spark.read.text(path).where(F.trim("value") != "").select(S.first_token(F.col("value")).alias("accession"))
    return df.limit(limit) if limit else df


#: What a permutation detector prints: column, label.
PERMUTATION_FIELDS = (("phi_perm_p", "PHI (Permutation)"), ("phi_normal_p", "PHI (Normal)"), ("nss_p", "NSS"), ("maxchi_p", "Max Chi^2"))


def permutation_values(text: Column, missing: str = "--") -> list[Column]:
    out = []
    for name, label in PERMUTATION_FIELDS:
        quoted = "".join("\\" + c if c in "()^." else c for c in label)
        out.append(S.number_or_null(F.nullif(F.regexp_extract(text, quoted + r":\s*(\S+)", 1), F.lit("")), missing).alias(name))
    return out


#: A candidate's record, a file of its own; fields that a file lacks are null.
CANDIDATE = "accession string, clade string, phi_perm_p double, phi_normal_p double, nss_p double, maxchi_p double, parents array<string>, n_sites long"


def read_candidate_json(spark: SparkSession, path: str, schema: str = CANDIDATE) -> DataFrame:
    """The records of a folder with a JSON file a candidate, in the order of the files'
    names. A declared schema: no pass to find one, and no surprise from one odd file."""
    rows = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("file", F.col("_metadata.file_name"))
    # a sort looks at its rows twice: files are opened once
    return Workspace(spark, "candidates").table(rows, "rows").orderBy("file").drop("file")


_SEGMENTS = "candidate_accession string, breakpointData map<string, struct<delta_cAIC: double, cAIC: double>>, baselineParameters struct<`c-AIC`: double>"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """``accession, breakpoint, delta, baseline`` of a segment detector's JSON files, one a
    candidate (without its name, the file's): a row a breakpoint with the gain of the
    criterion that it brings (that of the whole model where no gain is given, else 0)."""
    rows = spark.read.option("multiLine", True).schema(_SEGMENTS).json(path)
    name = F.coalesce("candidate_accession", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    rows = rows.select(name.alias("accession"), F.col("baselineParameters.`c-AIC`").alias("baseline"), F.explode("breakpointData").alias("breakpoint", "x"))
    return rows.select("accession", "breakpoint", F.coalesce("x.delta_cAIC", "x.cAIC", F.lit(0.0)).alias("delta"), "baseline")


def union_accessions(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("accession")
    for t in tables[1:]:
        out = out.unionByName(t.select("accession"))
    return out.dropna().distinct()


def _hashed(batches, limit: int):
    """Size and SHA-256 of each path, read 1 MiB at a time."""
    import hashlib

    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        out = []
        for path in batch.column(0).to_pylist():
            local = re.fullmatch(r"file:/*(/.*)", path)
            store, at = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
            digest = hashlib.sha256()
            with store.open_input_stream(at) as f:
                while piece := f.read(limit):
                    digest.update(piece)
            out.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["path", "size", "sha256"])


def manifest(spark: SparkSession, path: str, small: int = 1 << 28) -> DataFrame:
    """``path, size, sha256`` of every file below a folder. Files over ``small`` bytes (Spark
    reads none over 2 GiB whole) are streamed by their tasks, from any store of Arrow's.
    Spark passes over empty files: they have no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    whole = files.where(F.col("length") <= small).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > small).select("path", F.col("length").alias("size"))
    return whole.unionByName(large.mapInArrow(partial(_hashed, limit=1 << 20), "path string, size long, sha256 string"))


def folder_record(files: DataFrame) -> DataFrame:
    """One row of a manifest: ``files, size, sha256`` of the sorted list of its digests and paths."""
    lines = F.sort_array(F.collect_list(F.concat_ws("  ", "sha256", "path")))
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))


def read_parameters(spark: SparkSession, path: str) -> dict:
    """A JSON object of parameters or results in a file of its own."""
    rows = spark.read.option("multiLine", True).json(path).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else {}


def read_bundle(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Records of a JSONL bundle as flat text columns: ``name: a.path.in.the.record``."""
    raw = spark.read.text(path).where("trim(value) != ''")
    return raw.select(*[F.get_json_object("value", "$." + at).alias(name) for name, at in fields.items()])


def clock_roots(dates: DataFrame, most: int = 5) -> DataFrame:
    """The first rows (by name) of a table of dated nodes that are inner nodes or roots."""
    return dates.where(F.col("node").startswith("NODE_") | F.col("node").rlike("(?i)root")).orderBy("node").limit(most)


def clock_lines(spark: SparkSession, path: str) -> DataFrame:
    """``name, value`` of the ``rate:`` and ``intercept:`` lines of a clock report."""
    found = spark.read.text(path).select(F.regexp_extract("value", r"(rate|intercept):\s*(\S+)", 1).alias("name"), F.regexp_extract("value", r"(rate|intercept):\s*(\S+)", 2).alias("v"))
    return found.where("name != ''").select("name", F.expr("try_cast(v AS double)").alias("value"))


def scan_p(spark: SparkSession, path: str, child: str) -> DataFrame:
    """``flagged, min_p, n_triples`` of a detector's lines that name a child: the smallest
    number above 0 and up to 1 in any of their fields, set apart by commas or tabs."""
    lines = spark.read.text(path).where(F.col("value").contains(child))
    numbers = F.transform(F.split("value", "[,\t]"), lambda x: F.trim(x).try_cast("double"))
    least = F.array_min(F.filter(numbers, lambda v: (v > 0) & (v <= 1)))
    return lines.agg((F.count("*") > 0).alias("flagged"), F.min(least).alias("min_p"), F.count("*").alias("n_triples"))


def mask_source(*paths: tuple[str, str | None]) -> tuple[str, str] | None:
    """Of ``(kind, path)`` in order of priority, the first that is given."""
    return next(((kind, path) for kind, path in paths if path), None)


def verify_manifest(now: DataFrame, then: DataFrame) -> DataFrame:
    """``path, state``: ``same``, ``changed``, ``missing`` or ``new``."""
    both = now.select("path", F.col("sha256").alias("a")).join(then.select("path", F.col("sha256").alias("b")), "path", "full")
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "missing").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select("path", state.alias("state"))
