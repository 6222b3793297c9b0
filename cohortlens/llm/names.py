"""Column names of an operator's own, whatever the input's columns are called, and joins
with small tables by a key that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts that the rows of each key are dealt to where the other side is too large to broadcast.
SALTS = 32


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added to those that ``df`` has (in upper or lower case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, small: bool, how: str) -> DataFrame:
    """``rows`` with the columns of the row of ``table`` that has their key (null is a key):
    broadcast if ``small``, else joined by a shuffle in which every key has SALTS parts."""
    if small:
        return rows.join(F.broadcast(table), col(key).eqNullSafe(F.col(table_key)), how)
    (mine,) = free(rows, "salt")
    (theirs,) = free(table.select("*", F.lit(0).alias(mine)), "salt_of_table")
    many = table.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(theirs))
    dealt = rows.withColumn(mine, F.pmod(F.xxhash64(*[col(c) for c in rows.columns if dict(rows.dtypes)[c] in ("string", "bigint")]), F.lit(SALTS)).cast("int"))
    return dealt.join(many, col(key).eqNullSafe(F.col(table_key)) & (F.col(mine) == F.col(theirs)), how).drop(mine, theirs)
