"""Ranks within groups and over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from darkslide.plans.session import materialize


def rank_in_group(df: DataFrame, group: str | list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def keep_count(n: Column, percent: float) -> Column:
    """Rows to keep of n: the percentage rounded up, one at least."""
    return F.greatest(F.lit(1), F.ceil(n * percent / 100.0)).cast("long")


def top_percent(df: DataFrame, group: str | list[str], order: list[Column], percent: float) -> DataFrame:
    w = Window.partitionBy(group)
    ranked = rank_in_group(df, group, order).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("rank") <= keep_count(F.col("_n"), percent)).drop("_n")


def rank_all(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """Rank of every row in one order over the whole table, without bringing it to one task.

    Rows are dealt by range of the order, numbered within their part, and the parts' sizes (one
    row per part) are summed up to give each part its first number."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_in", inner).join(F.broadcast(before), "_part").withColumn(out, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def deal_by_group(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """df with _part, dealt by range of group and order and written; null groups are groups as well. A group may hold any share of the rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *(F.col(g) for g in groups), *order).withColumn("_part", F.spark_partition_id()), "ranked")


def running_total(dealt: DataFrame, groups: list[str], order: list[Column], add: Column, out: str) -> DataFrame:
    """dealt with the sum of `add` over the rows of the group up to each row, in order (dealt by `deal_by_group`).

    Sums are taken by group within each part. Only a part's first group can have begun in parts before it, so one row for each part
    tells what its first group starts from."""
    inner = dealt.withColumn("_in", F.sum(add).over(Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    runs = dealt.groupBy("_part", *groups).agg(F.sum(add).alias("_n")).select("_part", F.struct(*groups).alias("_g"), "_n")
    ends = runs.groupBy("_part").agg(F.min(F.struct("_g", "_n")).alias("first"), F.max(F.struct("_g", "_n")).alias("last"))
    base, before, starts = 0, None, []
    for r in ends.orderBy("_part").collect():  # one row for each part: their number is a setting, not the size of the data
        base = base if before is not None and r["first"]["_g"] == before else 0
        starts.append((r["_part"], base))
        single = r["first"]["_g"] == r["last"]["_g"]
        base, before = (base if single else 0) + r["last"]["_n"], r["last"]["_g"]
    offsets = dealt.sparkSession.createDataFrame(starts, "_part int, _base long")
    begun = ends.select("_part", F.col("first._g").alias("_first")).join(offsets, "_part")
    joined = inner.join(F.broadcast(begun), "_part")  # one row for each part
    more = F.when(F.struct(*groups).eqNullSafe(F.col("_first")), F.col("_base")).otherwise(F.lit(0))
    return joined.withColumn(out, (F.col("_in") + more).cast("long")).drop("_in", "_base", "_first")


def lag_in_large_groups(dealt: DataFrame, groups: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """dealt with `value` of the row before in the group, null for its first row (dealt by `deal_by_group`). The first row of a part's first
    group takes it from the part before, of which one row is kept."""
    w = Window.partitionBy("_part", *groups).orderBy(*order)
    inner = dealt.withColumns({out: F.lag(value).over(w), "_in": F.row_number().over(w)})
    ends = dealt.groupBy("_part").agg(F.max_by(F.struct(F.struct(*groups).alias("g"), value.alias("v")), F.struct(*groups, *order)).alias("last"))
    before = ends.select("_part", F.lag("last").over(Window.orderBy("_part")).alias("_last"))  # one row for each part
    goes_on = (F.col("_in") == 1) & F.struct(*groups).eqNullSafe(F.col("_last.g"))
    return inner.join(F.broadcast(before), "_part").withColumn(out, F.when(goes_on, F.col("_last.v")).otherwise(F.col(out))).drop("_in", "_last")


def rank_in_large_groups(df: DataFrame, groups: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """Rank of every row in its group, where a group may hold any share of the rows; rows that tie are numbered as they come."""
    return running_total(deal_by_group(df, groups, order), groups, order, F.lit(1), out).drop("_part")


def percentiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """group and a column for each share: the value at that share of the group's known values in order, with linear interpolation. Values
    are ranked over all tasks, so a large group is no single one; ties don't matter."""
    ranked = rank_in_large_groups(df.where(F.col(value).isNotNull()).select(group, value), [group], [F.col(value)], "_r")
    sizes = ranked.groupBy(group).agg(F.max("_r").alias("_n"))
    rows = ranked.join(sizes, group)
    at = {name: (F.col("_n") - 1) * share for name, share in shares.items()}
    picked = [F.max(F.when(F.col("_r") - 1 == f(at[n]), F.col(value))).alias(f"_{k}_{n}") for n in shares for k, f in (("lo", F.floor), ("hi", F.ceil))]
    found = rows.groupBy(group, "_n").agg(*picked)
    low = lambda n: F.col(f"_lo_{n}")
    return found.select(group, *((low(n) + (F.col(f"_hi_{n}") - low(n)) * (at[n] - F.floor(at[n]))).alias(n) for n in shares))


def neighbours(df: DataFrame, key: list[str], order: list[str], value: str, size: int, out: str = "neighbours") -> DataFrame:
    """Values of up to `size` rows before and after each row of its group (key), without its own, in order.

    Rows are dealt by range of group and order, and the last and first `size` rows of each part are copied to the parts beside it, so a
    group that holds most rows is no single task. What the driver sees is these few rows of each part."""
    spark, names = df.sparkSession, [*key, *order]
    dealt = deal_by_group(df, key, [F.col(c) for c in order])
    edge = ["_part", *dict.fromkeys([*names, value])]
    ends = []
    for turn in (lambda c: F.col(c).asc(), lambda c: F.col(c).desc()):
        placed = dealt.select(*edge, F.row_number().over(Window.partitionBy("_part").orderBy(*map(turn, names))).alias("_n"))
        by: dict[int, list] = {}
        for r in placed.where(F.col("_n") <= size).orderBy("_part", "_n").collect():
            by.setdefault(r["_part"], []).append(tuple(r)[1:-1])
        ends.append(by)
    first, last = ends
    parts, copies = sorted(first), []
    for ahead, there in ((False, parts), (True, parts[::-1])):
        near: list = []  # rows next to a part, the nearest first; a part of few rows lets those beyond it through
        for p in there:
            copies += [(p, *row) for row in near]
            near = [*(first if ahead else last)[p], *near][:size]
    schema = T.StructType([T.StructField("_part", T.IntegerType()), *(dealt.schema[c] for c in edge[1:])])
    halo = spark.createDataFrame(copies, T.StructType([T.StructField(f.name, f.dataType) for f in schema])).withColumn("_copy", F.lit(True))
    every = dealt.withColumn("_copy", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    w = Window.partitionBy("_part", *key).orderBy(*order)
    around = F.concat(F.collect_list(value).over(w.rowsBetween(-size, -1)), F.collect_list(value).over(w.rowsBetween(1, size)))
    return every.withColumn(out, around).where("not _copy").drop("_part", "_copy")
