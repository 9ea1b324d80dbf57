"""Tables kept in buckets of their key, of which a change rewrites the buckets that it touches and no other.

A bucket is a folder of Parquet files (`_bucket=N`), chosen by a hash of the key. A change names the keys that it touches; their buckets alone are
read, changed, written beside the table, and put in place of what was there. A change that was cut off can be made again: until the new
files are in place the old ones are."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from darkslide.plans.session import child_names, drop_path, materialize
from darkslide.sources.catalog_sink import replace_children, upsert

BUCKET = "_bucket"
#: What is known of a table; readers pass over names with an underscore.
ABOUT = "_about"


def _with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _dealt(df: DataFrame) -> DataFrame:
    """Rows together by bucket; Spark splits those that are much larger than others."""
    return df.hint("rebalance", BUCKET)


def create(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write df as a new table. Take so many buckets that one is a few files of a good size, since a change rewrites whole ones."""
    spark = df.sparkSession
    _dealt(_with_bucket(df, key, buckets)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    spark.createDataFrame([(key, buckets, df.schema.json())], "key string, buckets int, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/{ABOUT}")


def _about(spark: SparkSession, path: str) -> tuple[str, int, str]:
    r = spark.read.parquet(f"{path}/{ABOUT}").first()  # one row
    return r["key"], r["buckets"], r["schema"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is, without its buckets."""
    return _rows(spark, path).drop(BUCKET)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(_about(spark, path)[2]))
    return spark.read.schema(schema.add(BUCKET, IntegerType())).parquet(path)


def change(spark: SparkSession, path: str, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Put make(rows) in place of the rows of the buckets of the keys in touched (a column of the key's name), and return these
    buckets. make must leave rows of other keys as they are; keys of rows that it adds must be among the touched."""
    key, buckets, _ = _about(spark, path)
    hit = sorted(r[0] for r in _with_bucket(touched.select(key), key, buckets).select(BUCKET).distinct().collect())  # at most the number of buckets
    if not hit:
        return hit
    made = make(_rows(spark, path).where(F.col(BUCKET).isin(hit)).drop(BUCKET))
    side = materialize(_with_bucket(made, key, buckets), "bucket-change")
    filled = {r[0] for r in side.select(BUCKET).distinct().collect()}
    if not filled <= set(hit):
        raise ValueError("the change made rows of keys that are not among those it touches")
    _dealt(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for b in set(hit) - filled:  # nothing is left of these, and so nothing was written over them
        if f"{BUCKET}={b}" in child_names(spark, path):
            drop_path(spark, f"{path}/{BUCKET}={b}")
    drop_path(spark, side.table_path)
    return hit


def upsert_into(spark: SparkSession, path: str, updates: DataFrame) -> list[int]:
    """Put rows in place of those of their keys; keys that are new are added."""
    key = _about(spark, path)[0]
    return change(spark, path, updates, lambda rows: upsert(rows, updates.select(*rows.columns), key))


def replace_children_in(spark: SparkSession, path: str, new: DataFrame, parents: DataFrame) -> list[int]:
    """Replace all rows of the given parents (the table's key) by new ones; a parent may get none."""
    parent = _about(spark, path)[0]
    return change(spark, path, parents, lambda rows: replace_children(rows, new.select(*rows.columns), parents, parent))


def delete_from(spark: SparkSession, path: str, gone: DataFrame) -> list[int]:
    """Delete the rows of the keys in gone: the cascade of removed parents."""
    key = _about(spark, path)[0]
    return change(spark, path, gone, lambda rows: rows.join(gone.select(key), key, "left_anti").select(*rows.columns))
