"""Chapters, gaps, missing times and new names along a timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from darkslide.operators.ranking import deal_by_group, lag_in_large_groups, rank_all, running_total
from darkslide.plans.session import materialize


def seconds(t: Column | str) -> Column:
    return F.unix_micros(F.col(t).cast("timestamp") if isinstance(t, str) else t.cast("timestamp")) / 1e6


def chapters(df: DataFrame, ts: str, key: str, gap: float = 900.0, by: str | None = None) -> DataFrame:
    """df with `chapter`: a new one begins where the time since the row before is over `gap` seconds.

    Rows are dealt by range of time (with `by`, of that and time), each part counts its own cuts, and a table of one row per part (last
    time, number of cuts) joins the parts up; so neither the whole table nor a large group is one task."""
    order = [F.col(ts), F.col(key)]
    cut = lambda prev: F.when(seconds(ts) - prev > gap, 1).otherwise(0)
    if by:
        dealt = deal_by_group(df, [by], order)
        before = lag_in_large_groups(dealt, [by], [ts, key], seconds(ts), "_before")
        counted = running_total(before.withColumn("_cut", cut(F.col("_before"))), [by], order, F.col("_cut"), "chapter")
        return counted.withColumn("chapter", F.col("chapter") + 1).drop("_cut", "_before", "_part")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "timeline")
    w = Window.partitionBy("_part").orderBy(*order)
    inner = dealt.withColumn("_cut", cut(F.lag(seconds(ts)).over(w)))
    ends = inner.groupBy("_part").agg(F.min(seconds(ts)).alias("first"), F.max(seconds(ts)).alias("last"), F.sum("_cut").alias("cuts"))
    over = Window.orderBy("_part")
    starts = ends.withColumn("_new", F.when(F.col("first") - F.lag("last").over(over) > gap, 1).otherwise(0))
    starts = starts.select("_part", (F.sum("_new").over(over) + F.sum("cuts").over(over) - F.col("cuts")).alias("_base"))
    joined = inner.withColumn("_in", F.sum("_cut").over(w)).join(F.broadcast(starts), "_part")
    return joined.withColumn("chapter", (F.col("_in") + F.col("_base") + 1).cast("long")).drop("_part", "_cut", "_in", "_base")


def long_gaps(df: DataFrame, by: str, ts: str, key: str, least: float = 3600.0) -> DataFrame:
    """by, gap_start, gap_end, seconds of every gap over `least` seconds."""
    dealt = deal_by_group(df.select(by, ts, key), [by], [F.col(ts), F.col(key)])
    g = lag_in_large_groups(dealt, [by], [ts, key], F.col(ts), "gap_start").select(by, "gap_start", F.col(ts).alias("gap_end"))
    return g.withColumn("seconds", F.round(seconds("gap_end") - seconds("gap_start"), 3)).where(F.col("seconds") > least)


def fill_times(df: DataFrame, ts: str, key: str, fallback: Column | None = None, step: int = 2) -> DataFrame:
    """Rows without a time get the earliest known one (else `fallback`) plus `step` seconds each, in
    order of key; column synthetic tells them."""
    base = df.agg(F.coalesce(F.min(ts), *([fallback] if fallback is not None else [])).alias("_base"))
    unknown = rank_all(df.where(F.col(ts).isNull()).select(key), [F.col(key)], "_i")
    known = df.join(F.broadcast(base)).join(unknown, key, "left")  # one row of base
    made = (F.col("_base").cast("timestamp") + F.make_interval(secs=(F.col("_i") - 1) * step)).cast(df.schema[ts].dataType)
    return known.withColumn("synthetic", F.col(ts).isNull()).withColumn(ts, F.coalesce(ts, made)).drop("_base", "_i")


def auto_names(df: DataFrame, key: str, name: str, prefix: str = "Person ") -> DataFrame:
    """Rows without a name get prefix and the next numbers after the highest in use, in order of key."""
    used = df.agg(F.coalesce(F.max(F.nullif(F.regexp_extract(name, f"^{prefix}([0-9]+)$", 1), F.lit("")).cast("long")), F.lit(0)).alias("_top"))
    new = rank_all(df.where(F.col(name).isNull()).select(key), [F.col(key)], "_i")
    out = df.join(F.broadcast(used)).join(new, key, "left")  # one row of used
    return out.withColumn(name, F.coalesce(name, F.concat(F.lit(prefix), F.col("_top") + F.col("_i")))).drop("_top", "_i")


def next_ids(df: DataFrame, which: Column, key: str, out: str) -> DataFrame:
    """df with `out`: the key, or for rows that `which` selects the next free numbers in order of key."""
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    new = rank_all(df.where(which).select(key), [F.col(key)], "_i")
    return df.join(F.broadcast(top)).join(new, key, "left").withColumn(out, F.coalesce(F.col("_top") + F.col("_i"), F.col(key))).drop("_top", "_i")
