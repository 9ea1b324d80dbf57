"""Upserts, sidecars, deliveries, reports: what is written and the columns it is derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.operators.ranking import deal_by_group, rank_in_large_groups, running_total
from darkslide.plans.session import drop_path, materialize, new_path
from darkslide.sources.catalog_source import COLOR_CLASS


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """base with the rows of updates in place of those with their keys; of several updates of a key the
    last to be written must be chosen before (see latest_per_key)."""
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


def replace_table(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Overwrite a Parquet table that df may be read from: the new rows are written in full beside it first."""
    side = new_path(spark, "replace")
    df.write.parquet(side)
    spark.read.parquet(side).write.mode("overwrite").parquet(path)
    drop_path(spark, side)


def replace_children(children: DataFrame, new: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """children with all rows of the given parents replaced by new ones (a parent may get none)."""
    return children.join(parents.select(parent).distinct(), parent, "left_anti").unionByName(new)


def cascade(children: DataFrame, alive: DataFrame, parent: str) -> DataFrame:
    """children whose parent is alive."""
    return children.join(alive.select(parent), parent, "left_semi")


def set_null(children: DataFrame, alive: DataFrame, parent: str) -> DataFrame:
    """children with a parent that is gone set to null."""
    a = alive.select(parent, F.lit(True).alias("_alive"))
    return children.join(a, parent, "left").withColumn(parent, F.when(F.col("_alive"), F.col(parent))).drop("_alive").select(*children.columns)


def evolve(old: DataFrame, new: DataFrame, defaults: dict[str, Column], version: str, current: int, recompute: dict[str, Column]) -> DataFrame:
    """Rows of two schemas as one: missing columns get defaults, and rows of an older version are computed anew."""
    both = old.unionByName(new, allowMissingColumns=True)
    both = both.withColumns({k: F.coalesce(F.col(k), v) for k, v in defaults.items()})
    stale = F.coalesce(F.col(version), F.lit(0)) < current
    both = both.withColumns({k: F.when(stale, v).otherwise(F.col(k)) for k, v in recompute.items()})
    return both.withColumn(version, F.when(stale, F.lit(current)).otherwise(F.col(version)))


def subfolder(by: str) -> Column:
    """Folder of a photo (columns scene, chapter, is_highlight, person_names) by scenes, chapters, highlights or persons."""
    if by == "scenes":
        return F.coalesce("scene", F.lit("General"))
    if by == "chapters":
        return F.coalesce("chapter", F.lit("Chapter 1"))
    if by == "highlights":
        return F.when(F.coalesce("is_highlight", F.lit(False)), "Highlights").otherwise("Regular")
    if by == "persons":
        names = F.coalesce("person_names", F.array().cast("array<string>"))
        return F.when(F.size(names) == 0, "No Faces").otherwise(F.coalesce(F.get(names, 0), F.lit("Unresolved")))
    return F.lit("General")


def deliver(df: DataFrame, by: str, path: str) -> None:
    """Write rows in one folder per subfolder."""
    df.withColumn("subfolder", subfolder(by)).write.partitionBy("subfolder").mode("overwrite").parquet(path)


def sidecar_fields(rating: Column, label: Column, rejected: Column) -> dict[str, Column]:
    """Elements of a written sidecar."""
    classes = F.create_map(*(F.lit(x) for kv in COLOR_CLASS.items() for x in kv))
    return {
        "rating": rating,
        "label": label,
        "colorclass": F.coalesce(F.element_at(classes, F.lower(label)), F.lit("0")),
        "pick": F.when(rejected, -1).when(rating >= 3, 1).otherwise(0),
        "good": F.when(rejected, "false").otherwise("true"),
        "tagged": F.when(rejected, "False").when(rating >= 3, "True").otherwise("False"),
    }


def sidecar_text(rating: Column, label: Column, rejected: Column) -> Column:
    f = sidecar_fields(rating, label, rejected)
    tags = (("xmp:Rating", "rating"), ("xmp:Label", "label"), ("photomechanic:colorclass", "colorclass"), ("xmpDM:pick", "pick"), ("xmpDM:good", "good"), ("photomechanic:tagged", "tagged"))
    body = F.concat(*(x for tag, k in tags for x in (F.lit(f"<{tag}>"), f[k].cast("string"), F.lit(f"</{tag}>"))))
    return F.concat(F.lit("<rdf:Description>"), body, F.lit("</rdf:Description>"))


def with_tag(xml: Column, tag: str, value: Column) -> Column:
    """Sidecar text with one element set: its text is replaced if there, else it is added; other tags stay as they are."""
    there = F.contains(xml, F.lit(f"<{tag}>"))
    safe = F.regexp_replace(value, r"([\\$])", r"\\$1")
    changed = F.regexp_replace(xml, F.lit(f"<{tag}>[^<]*</{tag}>"), F.concat(F.lit(f"<{tag}>"), safe, F.lit(f"</{tag}>")))
    added = F.replace(xml, F.lit("</rdf:Description>"), F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}></rdf:Description>")))
    return F.when(there, changed).otherwise(added)


def with_attribute(xml: Column, name: str, value: Column) -> Column:
    """Sidecar text with one attribute of its description set; all else stays as it is."""
    new = F.concat(F.lit(f'{name}="'), value, F.lit('"'))
    safe = F.regexp_replace(new, r"([\\$])", r"\\$1")
    changed = F.regexp_replace(xml, F.lit(f'{name}="[^"]*"'), safe)
    added = F.replace(xml, F.lit("<rdf:Description"), F.concat(F.lit("<rdf:Description "), new))
    return F.when(F.contains(xml, F.lit(f"{name}=")), changed).otherwise(added)


def write_manifest(df: DataFrame, path_column: str, target: str) -> None:
    """XML list of paths; rows without one are left out."""
    rows = df.where(F.coalesce(F.col(path_column), F.lit("")) != "").select(F.col(path_column).alias("_path"))
    rows.write.format("xml").option("rootTag", "collection").option("rowTag", "photo").mode("overwrite").save(target)


def summary_json(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("report"))


def summary_html(summary: DataFrame) -> DataFrame:
    """One row of analyzed, kept, recovered, highlights as a page."""
    rows = F.concat(*(F.format_string(f"<div><b>{t}:</b> %d</div>", F.col(c)) for t, c in (("Analyzed", "analyzed"), ("Kept", "kept"), ("Recovered", "recovered"), ("Highlights", "highlights"))))
    return summary.select(F.concat(F.lit("<!DOCTYPE html><html><body><h1>Summary</h1>"), rows, F.lit("</body></html>")).alias("report"))


def routes(listing: DataFrame, selected: DataFrame, heroes: DataFrame, key: str) -> DataFrame:
    """key, route: a row for each place a file goes to: Best (selected), Hero (among the selected), Duplicates (all others)."""
    best = listing.join(selected.select(key), key, "left_semi").select(key, F.lit("Best").alias("route"))
    hero = best.join(heroes.select(key), key, "left_semi").select(key, F.lit("Hero").alias("route"))
    rest = listing.join(selected.select(key), key, "left_anti").select(key, F.lit("Duplicates").alias("route"))
    return best.unionByName(hero).unionByName(rest)


def routes_of_rows(rows: DataFrame, key: str, selected: Column, hero: Column) -> DataFrame:
    """The same from conditions on the rows themselves, which are read once; hero counts among the selected only."""
    to = lambda when, route: F.when(when, F.lit(route))
    places = F.array(to(selected, "Best"), to(selected & hero, "Hero"), to(~F.coalesce(selected, F.lit(False)), "Duplicates"))
    return rows.select(key, F.explode(places).alias("route")).where(F.col("route").isNotNull())


def audit(total: int, routed: DataFrame, categories: DataFrame) -> DataFrame:
    """One row: counts, percentages with one decimal, distribution of categories (a map)."""
    share = lambda n: F.floor(n * 1000 / F.lit(max(total, 1)) + 0.5) / 10
    n = routed.agg(*(F.count_if(F.col("route") == r).alias(c) for r, c in (("Best", "best_count"), ("Hero", "hero_count"), ("Duplicates", "duplicate_count"))))
    dist = categories.groupBy("category").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("category_distribution"))
    out = n.join(dist)  # two single rows
    return out.select(F.lit(total).cast("long").alias("total_photos"), "best_count", "hero_count", "duplicate_count", share(F.col("best_count")).alias("retention_percent"), share(F.col("hero_count")).alias("hero_percent"), "category_distribution")


def move_plan(df: DataFrame, name: str, key: str, taken: DataFrame | None = None) -> DataFrame:
    """df with target: name, name_1, name_2 ... so that no two rows and no file in `taken` (column name) clash.

    A made name may be the own name of another row or a taken one; numbers in use so are passed over: before the j-th number in use, u, lie u - j free
    ones, so the i-th free number is i and the count of those j with u - j < i. That count is a running total over rows and numbers
    in one order, dealt over all tasks, so neither a name nor its numbers have to fit anywhere."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    group, at = ["_s", "_e"], ["_at", "_used"]
    numbered = rank_in_large_groups(df.withColumns({"_s": stem, "_e": ext}), [name], [F.col(key)], "_i")  # one name may be that of most rows
    numbered = numbered.withColumn("_i", F.col("_i") - 1)
    own = df.select(F.col(name).alias("_n")).distinct()
    if taken is not None:
        t = taken.select(F.col("name").alias("_n")).distinct()
        numbered = numbered.join(t.select(F.col("_n").alias(name), F.lit(1).alias("_t")), name, "left").withColumn("_i", F.col("_i") + F.coalesce("_t", F.lit(0))).drop("_t")
        own = own.union(t).distinct()
    numbered = materialize(numbered, "moves")
    again = numbered.where("_i > 0")
    pattern = r"^(.*)_(\d+)(\.[^.]*)?$"
    parts = own.select(*(F.regexp_extract("_n", pattern, i).alias(c) for i, c in ((1, "_s"), (2, "_k"), (3, "_e")))).withColumn("_k", F.col("_k").try_cast("long"))
    used = parts.where("_k > 0").distinct().join(again.select(*group).distinct(), group, "left_semi")
    free = rank_in_large_groups(used, group, [F.col("_k")], "_j").select(*group, (F.col("_k") - F.col("_j")).alias("_at"), F.lit(1).alias("_used"))
    mixed = again.withColumns({"_at": F.col("_i"), "_used": F.lit(0)}).unionByName(free, allowMissingColumns=True)
    order = [F.col(c) for c in at]
    counted = running_total(deal_by_group(mixed, group, order), group, order, F.col("_used"), "_shift").where("_used = 0")
    made = counted.withColumn("target", F.concat("_s", F.lit("_"), F.col("_i") + F.col("_shift"), "_e"))
    return numbered.where("_i = 0").select(*df.columns, F.col(name).alias("target")).unionByName(made.select(*df.columns, "target"))


# Rating and label by preset, scene (null: any) and highlight, the first that holds.
PRESETS = (
    ("Wedding", None, True, 5, "Red"), ("Wedding", "Portraits", False, 4, "Blue"), ("Wedding", "Ceremony", False, 3, "Green"), ("Wedding", "Reception", False, 3, "Yellow"), ("Wedding", None, False, 2, "None"),
    ("Corporate", None, True, 5, "Blue"), ("Corporate", "Portraits", False, 4, "None"), ("Corporate", None, False, 3, "Purple"),
    ("Sports", None, True, 5, "Red"), ("Sports", None, False, 3, "None"),
)


def with_preset(df: DataFrame, preset: str) -> DataFrame:
    """df (scene, is_highlight) with rating, label and keywords of the preset; unknown presets rate 0."""
    scene, hl = F.coalesce("scene", F.lit("General")), F.coalesce("is_highlight", F.lit(False))
    rating, label = F.lit(0), F.lit("None")
    for p, s, h, r, text in reversed(PRESETS):
        if p == preset:
            holds = (hl == F.lit(h)) & (F.lit(True) if s is None else scene == s)
            rating, label = F.when(holds, r).otherwise(rating), F.when(holds, text).otherwise(label)
    return df.withColumns({"rating": rating, "label": label, "keywords": F.array_compact(F.array(scene, F.when(hl, F.lit("Highlight"))))})


def queue_progress(log: DataFrame, queue: str) -> DataFrame:
    """queue, waiting, completed, next_item from a log (seq, item, action): adding twice is adding once, completing
    takes an item out, adding again puts it back."""
    last = log.groupBy(queue, "item").agg(F.max_by("action", "seq").alias("action"), F.min(F.when(F.col("action") == "add", F.col("seq"))).alias("added"))
    waiting = F.col("action") == "add"
    return last.groupBy(queue).agg(F.count_if(waiting).alias("waiting"), F.count_if(F.col("action") == "done").alias("completed"), F.min_by("item", F.when(waiting, F.col("added"))).alias("next_item"))
