"""Exact duplicates, near-duplicate edges and groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from darkslide.functions.measures import centred, correlation, correlation_of_centred
from darkslide.operators.fingerprints import hamming, near_fingerprints
from darkslide.operators.graph import ONE_TASK, connected_components
from darkslide.operators.skew import beside, split_keys
from darkslide.operators.timeline import seconds
from darkslide.plans.session import materialize


def digest_key(digest: Column, key: Column) -> Column:
    """Groups rows by digest; a null digest is a group of its own."""
    return F.coalesce(digest, F.concat(F.lit("null:"), key.cast("string")))


def exact_groups(df: DataFrame, digest: str, key: str) -> DataFrame:
    """group_key, representative (least key), n."""
    return df.groupBy(digest_key(F.col(digest), F.col(key)).alias("group_key")).agg(F.min(key).alias("representative"), F.count("*").alias("n"))


def group_flags(df: DataFrame, group: str, ts: str, session: float = 30.0) -> DataFrame:
    """group, n, is_duplicate_group (two or more), is_session_group (two known times or more, all within `session` seconds)."""
    t = seconds(ts)
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.count(ts).alias("known"), (F.max(t) - F.min(t)).alias("span"))
    return g.select(group, "n", (F.col("n") > 1).alias("is_duplicate_group"), F.coalesce((F.col("known") >= 2) & (F.col("span") <= session), F.lit(False)).alias("is_session_group"))


def duplicate_report(groups: DataFrame, n: str = "n") -> DataFrame:
    """One row: totals, share of rows in groups of two or more, share of rows saved by one per group."""
    g = groups.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total"), F.count("*").alias("groups"), F.coalesce(F.sum(F.when(F.col(n) > 1, F.col(n))), F.lit(0)).alias("in_groups"), F.count_if(F.col(n) > 1).alias("duplicate_groups"))
    rate = lambda x: F.coalesce(F.round(F.try_divide(x, F.col("total")), 4), F.lit(0.0))
    return g.select("total", "groups", "duplicate_groups", rate(F.col("in_groups")).alias("recovery_rate"), rate(F.col("total") - F.col("groups")).alias("burst_collapse"))


def histogram(df: DataFrame, key: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """key, bins (array of shares that add up to 1, in order), mean, std (population) of the values in [low, high)."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) < high))
    # moments come out of the per-bin partial sums, so the values are aggregated once
    cells = inside.groupBy(key, F.floor((F.col(value) - low) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    per = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0)) / F.col("n"))
    mean = F.col("s") / F.col("n")
    return per.select(key, dense.alias("bins"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)).alias("std"))


def simhash(words: Column, bits: int = 64) -> Column:
    """64-bit fingerprint of a list of words: each bit is the majority of that bit over the words' hashes. No words: 0."""
    at = F.lit(-1 if bits >= 64 else (1 << bits) - 1).cast("long")
    hashes = F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<long>"))
    return _majority(hashes).bitwiseAND(at)


@F.arrow_udf(LongType())
def _majority(hashes: pa.Array) -> pa.Array:
    """The bits that are set in more than half of the numbers of each list, all lists of a batch bit by bit."""
    ends = np.append(0, np.cumsum(pc.list_value_length(hashes).to_numpy(zero_copy_only=False)))
    flat = hashes.flatten().to_numpy(zero_copy_only=False)
    value, running = np.zeros(len(hashes), np.int64), np.zeros(len(flat) + 1, np.int64)
    for b in range(64):
        np.cumsum((flat >> b) & 1, out=running[1:])
        more = 2 * (running[ends[1:]] - running[ends[:-1]]) > np.diff(ends)
        value |= more.astype(np.int64) << b
    return pa.array(value)


def band_edges(df: DataFrame, key: str, fp: str, most: int = 7, copies: bool = False) -> DataFrame:
    """src < dst, distance of all rows whose fingerprints differ in at most `most` (up to 7) bits.

    Fingerprints are looked up by parts of them (`fingerprints`); equal ones are looked up once, as one row: the least key. With copies
    that row also has an edge (distance 0) to each other row of its fingerprint, so that components hold them all."""
    reps = df.where(F.col(fp).isNotNull()).groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("rep"))
    reps = materialize(reps, "fingerprints")
    found = near_fingerprints(reps, reps, "fp", most, F.col("a_rep") < F.col("b_rep")).select(F.col("a_rep").alias("src"), F.col("b_rep").alias("dst"), "distance")
    if not copies:
        return found
    equal = df.select(F.col(key).alias("dst"), F.col(fp).alias("fp")).join(reps.hint("merge"), "fp").where("rep <> dst")
    return found.unionByName(equal.select(F.col("rep").alias("src"), "dst", F.lit(0).alias("distance")))


def burst_edges(df: DataFrame, key: str, ts: str, gap: int = 60) -> DataFrame:
    """src, dst of all rows at most `gap` seconds apart (src first, ties by key): a range join as an equi-join on time buckets, each row
    meeting its own bucket and the next. The rows of a crowded bucket are dealt over many tasks. Other columns come along as a_... and b_..."""
    a, b = _burst_sides(df, key, ts, gap)
    a, b = split_keys(a, b, ["bucket"], F.xxhash64(f"b_{key}"))
    return a.join(b.hint("merge"), ["bucket", "_salt"]).where(_in_turn(key, gap)).withColumnsRenamed({f"a_{key}": "src", f"b_{key}": "dst"}).drop("bucket", "_salt", "a__s", "b__s")


def _burst_sides(df: DataFrame, key: str, ts: str, gap: int) -> tuple[DataFrame, DataFrame]:
    """Rows as a_... with their own time bucket and the next, and as b_... with their own."""
    t = df.where(F.col(ts).isNotNull()).withColumn("_s", seconds(ts)).drop(ts)
    own = F.floor(F.col("_s") / gap)
    side = lambda to, bucket: t.select(bucket.alias("bucket"), *(F.col(c).alias(f"{to}_{c}") for c in t.columns))
    return side("a", F.explode(F.array(own, own + 1))), side("b", own)


def _in_turn(key: str, gap: int) -> Column:
    a, b = F.col("a__s"), F.col("b__s")
    return ((b > a) | ((b == a) & (F.col(f"b_{key}") > F.col(f"a_{key}")))) & (b - a <= gap)


#: What the cheap tests of a pair need, and the histograms that are joined to pairs which pass them.
LOOKS, HISTOGRAMS = ["ratio", "saturation", "fp"], ["hue", "sat", "value"]


def alike(threshold: int = 12) -> Column:
    """The cheap tests of a pair (a_..., b_...): aspect within .25, both grey or neither, fingerprints within min(7, threshold - 5) bits."""
    c = F.col
    aspect = F.abs(c("a_ratio") - c("b_ratio")) / F.greatest("a_ratio", "b_ratio") <= 0.25
    grey = (c("a_saturation") < 15) == (c("b_saturation") < 15)
    return aspect & grey & (hamming(c("a_fp"), c("b_fp")) <= min(7, threshold - 5))


def agreeing(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """src, dst of the pairs whose histograms correlate at .90 / .80 / .80; a missing histogram drops the pair. The histograms are joined to
    these pairs alone, by shuffle: tables of few different values are small files and large rows, which Spark would broadcast by the size of the file."""
    side = lambda end, to: rows.select(F.col(key).alias(end), *(F.col(h).alias(f"{to}_{h}") for h in HISTOGRAMS))
    both = pairs.select("src", "dst").join(side("src", "a").hint("merge"), "src").join(side("dst", "b").hint("merge"), "dst")
    return both.where(_agree(correlation)).select("src", "dst")


def _agree(corr: Callable[[Column, Column], Column]) -> Column:
    c = F.col
    agree = (corr(c("a_hue"), c("b_hue")) >= 0.90) & (corr(c("a_sat"), c("b_sat")) >= 0.80) & (corr(c("a_value"), c("b_value")) >= 0.80)
    return F.coalesce(agree, F.lit(False))


#: Rows of a time bucket above which its pairs are looked up by their fingerprints.
CROWD = 2048


def near_duplicate_edges(df: DataFrame, key: str, ts: str, gap: int = 60, threshold: int = 12) -> DataFrame:
    """src, dst of rows (ratio, saturation, fp, hue, sat, value) at most `gap` seconds apart that look alike. Rows without a time or
    a fingerprint have no edges here, see `unknown_time_edges`.

    The rows of most time buckets all meet, with their histograms, so that rows are shuffled and pairs are not. In a crowded one (a burst that holds a large
    share of the table) only those meet that share parts of their fingerprints, which misses no pair that is near enough."""
    known = df.where(F.col("fp").isNotNull())
    slim = known.select(key, ts, *LOOKS)
    whole = known.select(key, ts, *LOOKS, *(centred(F.col(h)).alias(h) for h in HISTOGRAMS))
    near = alike(threshold) & _agree(correlation_of_centred)
    a, b = _burst_sides(slim, key, ts, gap)
    crowded = b.groupBy("bucket").count().where(F.col("count") > CROWD).select("bucket")
    if crowded.isEmpty():
        return burst_edges(whole, key, ts, gap).where(near).select("src", "dst")
    crowded = materialize(crowded, "crowded")
    of = lambda t, how: beside(t, crowded, ["bucket"], how)
    all_a, all_b = _burst_sides(whole, key, ts, gap)
    few = of(all_a, "left_anti").join(of(all_b, "left_anti").hint("merge"), "bucket").where(_in_turn(key, gap)).where(near)
    plain = lambda t: t.select("bucket", *(F.col(c).alias(c[2:]) for c in t.columns if c != "bucket"))
    many = near_fingerprints(plain(of(a, "left_semi")), plain(of(b, "left_semi")), "fp", min(7, threshold - 5), _in_turn(key, gap), ["bucket"])
    ends = lambda t: t.select(F.col(f"a_{key}").alias("src"), F.col(f"b_{key}").alias("dst"))
    return ends(few).unionByName(agreeing(ends(many.where(alike(threshold))), df, key))


def unknown_time_edges(df: DataFrame, key: str, ts: str, threshold: int = 12) -> DataFrame:
    """src, dst that tie every row without a time to all rows that look like it, whatever their time, in as few edges as their
    components need.

    Rows of an equal look are one row here: those without a time are tied to the least of them, and those with a time that look like some row
    without one to the least of theirs. So pairs are of different looks, found by parts of their fingerprints as in `band_edges`."""
    look = F.xxhash64("fp", *[F.col(c) for c in (*LOOKS[:2], *HISTOGRAMS)])
    rows = df.where(F.col("fp").isNotNull()).withColumns({"_look": look, "_known": F.col(ts).isNotNull()})
    cols = ["fp", "ratio", "saturation", *HISTOGRAMS]
    reps = rows.groupBy("_look", "_known").agg(F.min(key).alias("rep"), *(F.first(c).alias(c) for c in cols))
    reps = materialize(reps, "looks")
    looks = reps.select("rep", F.col("_known").alias("known"), *LOOKS)
    near = near_fingerprints(looks.where("not known"), looks, "fp", min(7, threshold - 5), F.col("a_rep") != F.col("b_rep")).where(alike(threshold))
    pairs = near.where("b_known or a_rep < b_rep").select(F.col("a_rep").alias("src"), F.col("b_rep").alias("dst"))
    found = materialize(agreeing(pairs, reps, "rep"), "look-edges")
    met = found.select(F.col("dst").alias("rep")).distinct()
    tied = reps.where("not _known").select("_look", "_known", "rep").union(reps.where("_known").join(met.hint("merge"), "rep", "left_semi").select("_look", "_known", "rep"))
    stars = rows.select(F.col(key).alias("dst"), "_look", "_known").join(tied.withColumnRenamed("rep", "src").hint("merge"), ["_look", "_known"]).where("src <> dst").select("src", "dst")
    return found.unionByName(stars)


def groups(df: DataFrame, key: str, digest: str, edges: DataFrame) -> DataFrame:
    """key, group_id of every row: exact copies and everything that edges (of representatives) tie together; the least key names it."""
    reps = df.select(key, digest_key(F.col(digest), F.col(key)).alias("_g"))
    least = reps.groupBy("_g").agg(F.min(key).alias("rep"))
    parts = connected_components(edges, in_one_task=ONE_TASK).select(F.col("node").alias("rep"), "component")
    named = least.join(parts.hint("merge"), "rep", "left").select("_g", F.coalesce("component", "rep").alias("group_id"))
    return reps.join(named.hint("merge"), "_g").select(key, "group_id")
