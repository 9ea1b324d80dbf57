"""From scored photos to verdicts: best of each group, quotas, heroes, manual overrides.

Scores are compared to six decimals; the photo's id breaks ties, so results don't depend on order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.operators.ranking import rank_all, rank_in_group
from darkslide.plans.session import materialize

# Shares of a category that coverage mode keeps.
QUOTAS = {"Audience": 25, "Group Photos": 25, "Keynote": 25, "Panel Discussion": 25, "Awards": 30, "Branding": 60, "Networking": 60, "Exhibition": 70}
DEFAULT_QUOTA = 25
HERO_PERCENT, HERO_MOST = 2, 25


def by_score() -> list[Column]:
    return [F.round("overall", 6).desc(), F.col("photo_id")]


def with_best(scored: DataFrame) -> DataFrame:
    """rank in the group and is_best."""
    return rank_in_group(scored, "group_id", by_score()).withColumn("is_best", F.col("rank") == 1)


def candidates(best: DataFrame) -> DataFrame:
    """Best picks that the rules don't reject."""
    return best.where(F.col("is_best") & (F.col("decision") != "REJECT"))


def smart_keep(best: DataFrame, percent: float | None) -> DataFrame:
    """photo_id of the best picks kept by rank over all: the percentage of all photos, one at least; all without a percentage."""
    found = candidates(best)
    if percent is None:
        return found.select("photo_id")
    total = best.select("photo_id").distinct().count()
    most = max(1, -(-int(total * percent * 1000) // 100_000))
    return rank_all(found.select("photo_id", "overall"), by_score()).where(F.col("rank") <= most).select("photo_id")


def quota(category: Column) -> Column:
    m = F.create_map(*(F.lit(x) for kv in QUOTAS.items() for x in kv))
    return F.coalesce(F.element_at(m, category), F.lit(DEFAULT_QUOTA))


def coverage_keep(best: DataFrame) -> DataFrame:
    """photo_id of the best picks within the quota of their category, a share of all photos of it.

    There are few categories, so rows are ranked over all of them by category and score, dealt by range, and a category's first rank is
    taken off: a large category is no single task."""
    totals = best.groupBy("category").agg(F.count("*").alias("all_in_category"))
    ranked = rank_all(candidates(best).select("photo_id", "category", "overall"), [F.col("category"), *by_score()], "place")
    first = ranked.groupBy("category").agg(F.min("place").alias("first"))
    most = F.greatest(F.lit(1), F.ceil(F.col("all_in_category") * quota(F.col("category")) / 100.0))
    limits = first.join(totals, "category").select("category", (F.col("first") + most).alias("end"))
    return ranked.join(limits, "category").where(F.col("place") < F.col("end")).select("photo_id")


def hero_limit(total: int) -> int:
    return min(HERO_MOST, max(1, -(-total * HERO_PERCENT // 100)))


def heroes(kept: DataFrame, total: int) -> DataFrame:
    """photo_id of the best kept photos (at most HERO_MOST); plain branding doesn't qualify."""
    able = kept.where((F.col("category") != "Branding") | (F.col("branding_presence") >= 75))
    return able.orderBy(*by_score()).limit(hero_limit(total)).select("photo_id")


def verdicts(scored: DataFrame, percent: float | None = None, coverage: bool = False) -> DataFrame:
    """photo_id, group_id, rank, is_best, category, overall, publish (one decimal), decision, auto_discard."""
    read = ["photo_id", "group_id", "category", "overall", "publish", "decision", "branding_presence"]
    best = materialize(with_best(scored.select(*read)), "best")  # read four times below
    keep = coverage_keep(best) if coverage else smart_keep(best, percent)
    kept = best.join(keep.withColumn("_kept", F.lit(True)), "photo_id", "left").withColumn("_kept", F.coalesce("_kept", F.lit(False)))
    top = heroes(kept.where("_kept"), best.count()).withColumn("_hero", F.lit(True))
    out = kept.join(F.broadcast(top), "photo_id", "left")
    decision = F.when(F.col("_hero"), "HERO").when(F.col("_kept"), "KEEP").otherwise("REJECT")
    one = lambda c: F.floor(F.round(c, 6) * 10 + 0.5) / 10
    return out.select("photo_id", "group_id", "rank", "is_best", "category", one("overall").alias("overall"), one("publish").alias("publish"), decision.alias("decision"), (~F.col("_kept")).alias("auto_discard"))


def overridden(verdict: DataFrame, actions: DataFrame) -> DataFrame:
    """Verdicts with manual actions (photo_id, seq, action) applied; the last action on a photo wins.

    Actions: swap (becomes the kept pick of its group), keep_only (the group's other photos are discarded),
    toggle (discarded or not is turned over), discard."""
    last = actions.groupBy("photo_id").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))
    with_last = verdict.join(last, "photo_id", "left")
    # the last swap or keep_only of a group names its pick
    picks = with_last.where(F.col("action").isin("swap", "keep_only")).groupBy("group_id").agg(F.max_by(F.struct("photo_id", "action"), "seq").alias("p"))
    out = with_last.join(picks, "group_id", "left")
    is_pick = F.col("photo_id") == F.col("p.photo_id")
    discarded = (
        F.when(F.col("p").isNotNull() & is_pick, False)
        .when(F.col("action") == "toggle", ~F.col("auto_discard"))
        .when(F.col("action") == "discard", True)
        .when(F.col("p.action") == "keep_only", True)
        .when(F.col("p").isNotNull() & F.col("is_best"), True)
        .otherwise(F.col("auto_discard"))
    )
    best = F.when(F.col("p").isNotNull(), is_pick).otherwise(F.col("is_best"))
    return out.select("photo_id", "group_id", best.alias("is_best"), discarded.alias("discarded"))


