"""Joins whose hot keys are dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task of a join takes; a key with more is split.
HOT = 4096
#: Rows of a side that may be broadcast.
BROADCAST_ROWS = 10_000


def beside(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table that is broadcast if it has at most BROADCAST_ROWS rows, else by shuffle."""
    small = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(few) if small else few, on, how)


def split_keys(a: DataFrame, b: DataFrame, on: list[str], spread: Column, hot: int | None = None) -> tuple[DataFrame, DataFrame]:
    """a and b with one more column, _salt, to join by: rows of b of a key with over `hot` of them are dealt (by `spread`, a hash of what
    tells them apart) over as many salts as it takes, and rows of a of that key are copied to each. Keys are counted beforehand; where none is
    hot the salt is 0."""
    hot = hot or HOT
    heavy = b.groupBy(*on).count().where(F.col("count") > hot).select(*on, F.ceil(F.col("count") / hot).cast("int").alias("_salts"))
    if heavy.isEmpty():
        return a.withColumn("_salt", F.lit(0)), b.withColumn("_salt", F.lit(0))
    salts = F.coalesce("_salts", F.lit(1))
    left = beside(a, heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    right = beside(b, heavy, on, "left").withColumn("_salt", F.pmod(spread, salts).cast("int")).drop("_salts")
    return left, right
