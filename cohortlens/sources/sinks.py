"""Writers: tables, sequences, intervals, summaries, checksums; resumable runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import cohort, sequence


def write_tsv(df: DataFrame, path: str) -> None:
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def wrapped(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")


def write_fasta(records: DataFrame, path: str, keep: DataFrame | None = None, wrap: int | None = None, order: list[str | Column] | None = None) -> None:
    """``accession, seq`` in ``order`` (of ``ord``, if none is given and there is such a
    column), equal ones by id, so that few values of ``ord`` are dealt to many tasks too;
    ``keep`` restricts ids."""
    if keep is not None:
        records = records.join(keep.select("accession").distinct(), "accession", "left_semi")
    seq = wrapped(F.col("seq"), wrap) if wrap else F.col("seq")
    order = order or (["ord"] if "ord" in records.columns else [])
    if order:
        records = records.orderBy(*order, "accession")
    records.select(F.concat(F.lit(">"), "accession", F.lit("\n"), seq).alias("value")).write.mode("overwrite").text(path)


def write_condition_fasta(records: DataFrame, children: DataFrame, path: str, columns: DataFrame | None = None) -> None:
    """The records of an alignment (``accession, seq, ord``) for a detector: children first,
    each in file order, with the ``columns`` (0-based, ``column``) of a table as N."""
    marked = cohort.marked_children(records, children)
    if columns is not None:
        marked = sequence.mask_column_table(marked, columns)
    write_fasta(marked, path, order=[F.desc("is_child"), "ord"])


#: Rows of ``write_each`` that one task writes, about.
FILES_A_TASK = 2_000


def write_each(lines: DataFrame, path: str, key: str) -> None:
    """A text file a row (``value``), dealt to tasks by ``key``, whose values are all different
    and stay with their rows. Each task puts its files in place, not the driver one by one
    at the end; a second attempt of a task sorts the same rows into the same names."""
    tasks = max(1, -(-lines.count() // FILES_A_TASK))
    dealt = lines.repartition(tasks, key).sortWithinPartitions(key).select("value")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("maxRecordsPerFile", 1).text(path)


def write_bed(sites: DataFrame, path: str, header: str | None = None) -> None:
    """Sites (``pos`` from 1, ``context, occupancy``) sorted by position and context; a
    ``header`` is the first line, after ``# ``."""
    lines = sites.select(F.lit(1).alias("k"), "pos", "context", F.concat_ws("\t", F.lit("ref"), (F.col("pos") - 1).cast("string"), F.col("pos").cast("string"), "context", F.col("occupancy").cast("string")).alias("value"))
    if header is not None:
        first = sites.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(None).cast("int").alias("pos"), F.lit("").alias("context"), F.lit(f"# {header}").alias("value"))
        lines = first.union(lines)
    lines.orderBy("k", "pos", "context").select("value").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_summary(path: str, values: DataFrame, **tables: DataFrame) -> None:
    """One JSON object, indented: the columns of the one row of ``values``, and under each
    further name the rows of a small summary table, in the order of its columns. Nulls are
    left out, as the reader of such a file takes what is missing for null."""
    out = values
    for name, rows in tables.items():
        listed = rows.select(F.struct("*").alias("x")).agg(F.sort_array(F.collect_list("x")).alias(name))
        out = out.join(F.broadcast(listed))  # one row each
    out.coalesce(1).select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def write_checksums(files: DataFrame, path: str) -> None:
    files.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value")).write.mode("overwrite").text(path)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def append_run(df: DataFrame, path: str, by: str) -> None:
    """Results of finished units of work, a partition each."""
    df.write.mode("append").partitionBy(by).parquet(path)
