"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.operators.skew import beside
from darkslide.plans.session import discard, materialize

#: The number of rounds grows with the logarithm of the longest path; more than these means a defect.
MAX_ROUNDS = 200


#: Edges that may be left to one task.
ONE_TASK = 10_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """Stars (u, v: the least node) of edges of which there are few."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def root(x: object) -> object:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for u, v in zip(b["u"].tolist(), b["v"].tolist(), strict=True):
                a, z = root(u), root(v)
                up[max(a, z)] = min(a, z)
        rows = [(x, root(x)) for x in list(up)]
        yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"])

    return edges.coalesce(1).mapInPandas(join, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", in_one_task: int = 0) -> DataFrame:
    """node, component (the least node of it) for every node that has an edge to another one.

    Large-star and small-star steps in turn: each node hands its larger, then its smaller neighbours
    to the least node it knows, until the edges are stars. Minima are taken by partial aggregation and joined back, so a
    node with very many neighbours is no single group; these joins are by shuffle, since edges take many times
    their file's size in memory. Each round is written to the shared folder in place of the one before.
    Where at most in_one_task edges are left, one task joins them instead of more rounds. Edges that aren't stars after MAX_ROUNDS rounds are an error, never an unfinished answer."""
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = materialize(e, "components")
    before = None
    for _ in range(MAX_ROUNDS):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        if now[0] <= in_one_task:
            last, e = e, materialize(_in_one_task(e), "components")
            discard(last)
            break
        before = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
        last, e = e, materialize(small.where("u <> v").distinct(), "components")
        discard(last)
    else:
        raise RuntimeError(f"edges are not stars after {MAX_ROUNDS} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def grown_components(known: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst", in_one_task: int = 0) -> DataFrame:
    """node, component of the nodes that are new or whose component changes when edges come to known components (node, component).

    The ends of new edges are replaced by their components, so what is joined is as large as the new edges, however large the graph is; the
    least node of a component names it, before and after. All other nodes stay as they are: put the result in their place (`upsert`)."""
    named = lambda t, end: t.join(known.select(F.col("node").alias(end), F.col("component").alias(f"_{end}")).hint("merge"), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct()
    contracted = named(named(ends, "a"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    parts = materialize(connected_components(contracted, "a", "b", in_one_task).withColumnRenamed("component", "_to"), "grown")
    moved = beside(known, parts.where("node <> _to").select(F.col("node").alias("component"), "_to"), ["component"]).select("node", F.col("_to").alias("component"))
    new = parts.join(known.select("node").hint("merge"), "node", "left_anti").select("node", F.col("_to").alias("component"))
    return moved.unionByName(new)
