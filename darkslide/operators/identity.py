"""Clusters of faces, persons, and what is asked about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.functions.measures import cosine
from darkslide.operators.graph import connected_components
from darkslide.operators.ranking import rank_in_large_groups
from darkslide.operators.skew import split_keys


def merge_clusters(faces: DataFrame, cluster: str, merges: DataFrame) -> DataFrame:
    """faces with merged cluster numbers; merges: keep, gone. Chains are followed to their end, the least number."""
    closed = connected_components(merges, "keep", "gone").select(F.col("node").alias(cluster), F.col("component").alias("_to"))
    kind = faces.schema[cluster].dataType
    return faces.join(closed, cluster, "left").withColumn(cluster, F.coalesce("_to", cluster).cast(kind)).drop("_to")


def merge_history(merges: DataFrame, at: Column) -> DataFrame:
    """Rows for the history of clusters, one per merge."""
    return merges.select(F.lit("merge").alias("action"), F.col("keep").alias("first"), F.col("gone").alias("second"), at.alias("at"))


def split_cluster(faces: DataFrame, cluster: str, which: Column) -> DataFrame:
    """faces with the rows that `which` selects in a new cluster, the number after the highest."""
    top = faces.agg(F.max(cluster).alias("_top"))
    return faces.join(F.broadcast(top)).withColumn(cluster, F.when(which, F.col("_top") + 1).otherwise(F.col(cluster))).drop("_top")  # one row of top


def recovery_candidates(targets: DataFrame, faces: DataFrame, exclude_self: bool = False) -> DataFrame:
    """target, candidate: faces of the same person (else cluster) with open eyes and a like pose, smile and light.

    An equi-join on person and on cells of yaw, pitch and roll as wide as the tolerance; a candidate is in one
    cell and a target asks the 27 around it. Cells that hold very many faces of a person are dealt over many tasks."""
    who = F.coalesce(F.concat(F.lit("p"), F.col("person_id")), F.concat(F.lit("c"), F.col("cluster_id")))
    pose, cols = ("yaw", "pitch", "roll"), ("yaw", "pitch", "roll", "smile", "lighting")
    cell = {x: F.floor(F.col(x) / 12) for x in pose}
    t = targets.select(who.alias("who"), F.col("face_id").alias("target"), *(F.col(c).alias(f"t_{c}") for c in cols), *(cell[x].alias(f"_{x}") for x in pose))
    for x in pose:
        t = t.withColumn(f"_{x}", F.explode(F.array(*(F.col(f"_{x}") + d for d in (-1, 0, 1)))))
    c = faces.where(F.col("eye_openness") >= 75).select(who.alias("who"), F.col("face_id").alias("candidate"), *(F.col(x).alias(f"c_{x}") for x in cols), *(cell[x].alias(f"_{x}") for x in pose))
    on = ["who", *(f"_{x}" for x in pose)]
    t, c = split_keys(t, c, on, F.xxhash64("candidate"))
    near = lambda x, most: F.abs(F.col(f"t_{x}") - F.col(f"c_{x}")) <= most
    pairs = t.join(c, [*on, "_salt"]).where(near("yaw", 12) & near("pitch", 12) & near("roll", 12) & near("smile", 25) & near("lighting", 25))
    if exclude_self:
        pairs = pairs.where(F.col("target") != F.col("candidate"))
    return pairs.select("target", "candidate")


def enriched_faces(clustered: DataFrame, raw: DataFrame, stats: DataFrame, clusters: DataFrame, persons: DataFrame, photo: str = "photo_id") -> DataFrame:
    """Clustered faces with statistics, cluster and person; photos that have none give their raw faces, with nulls."""
    full = clustered.join(stats, "cluster_id", "left").join(clusters, "cluster_id", "left").join(persons, "person_id", "left")
    rest = raw.join(clustered.select(photo).distinct(), photo, "left_anti")
    return full.unionByName(rest, allowMissingColumns=True)


def matching_scores(faces: DataFrame, key: str, cluster: str, vec: str, centers: DataFrame) -> DataFrame:
    """faces with score: the similarity of each face to the centroid of its own cluster (centers: cluster, centroid); null for a face without
    a cluster or vector, or of a cluster without a centroid. Where there are few clusters they are broadcast by Spark's own measure."""
    c = centers.select(F.col(cluster), F.col("centroid").alias("_center"))
    return faces.join(c, cluster, "left").withColumn("score", cosine(F.col(vec), F.col("_center"))).drop("_center")


def cluster_view(clusters: DataFrame, faces: DataFrame, cluster: str, fields: list[str]) -> DataFrame:
    """clusters with faces (array of structs in order) and n_faces; clusters without faces keep an empty array."""
    nested = faces.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("faces"))
    out = clusters.join(nested, cluster, "left")
    empty = F.array().cast(nested.schema["faces"].dataType)
    return out.withColumn("faces", F.coalesce("faces", empty)).withColumn("n_faces", F.size("faces"))


def cluster_pages(clusters: DataFrame, faces: DataFrame, cluster: str, fields: list[str], size: int = 1000) -> DataFrame:
    """The rows of cluster_view in pages: clusters with page (from 0), n_faces (of the whole cluster) and faces, an array of at most `size`
    structs, in order over the pages; a cluster without faces has one empty page, and faces without a cluster are left out.

    For clusters of any size: faces are numbered over all tasks, and clusters and faces meet on cluster and page, so none comes together in one row or task."""
    mine = faces.where(F.col(cluster).isNotNull()).select(cluster, *fields)
    ranked = rank_in_large_groups(mine, [cluster], [F.col(c) for c in fields], "_place")
    page = F.floor((F.col("_place") - 1) / size).cast("long")
    pages = ranked.groupBy(cluster, page.alias("page")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("faces"))
    counts = mine.groupBy(cluster).agg(F.count("*").alias("n_faces"))
    counted = clusters.join(counts, cluster, "left").withColumn("n_faces", F.coalesce("n_faces", F.lit(0)).cast("long"))
    last = F.greatest(F.ceil(F.col("n_faces") / size).cast("long") - 1, F.lit(0).cast("long"))
    every = counted.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    empty = F.array().cast(pages.schema["faces"].dataType)
    return every.join(pages, [cluster, "page"], "left").withColumn("faces", F.coalesce("faces", empty))


def person_timeline(faces: DataFrame, photos: DataFrame, person: Column) -> DataFrame:
    """person, photo_id, captured_at, place: the distinct photos of each person with a known time, in order."""
    seen = faces.select(person.alias("person"), "photo_id").where("person is not null").distinct()
    t = seen.join(photos.where("captured_at is not null").select("photo_id", "captured_at"), "photo_id")
    return rank_in_large_groups(t, ["person"], [F.col("captured_at"), F.col("photo_id")], "place").withColumn("place", F.col("place").cast("int"))


def person_statistics(faces: DataFrame, person: Column, confidence: str) -> DataFrame:
    """person, face_count (faces with a confidence), key_face (the most confident, least id on ties)."""
    f = faces.select(person.alias("person"), "face_id", F.col(confidence).alias("c")).where("person is not null")
    best = F.max(F.when(F.col("c").isNotNull(), F.struct("c", (-F.col("face_id")).alias("k"))))
    return f.groupBy("person").agg(F.count("c").alias("face_count"), (-best["k"]).alias("key_face"))


def person_state(commands: DataFrame) -> DataFrame:
    """person_id, name from a log (seq, person_id, op, name): create and rename set the name, delete drops the person.

    Of living persons with the same name the one with the least id keeps it; the others resolve to that id."""
    last = commands.groupBy("person_id").agg(F.max_by("op", "seq").alias("op"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"))
    living = last.where((F.col("op") != "delete") & F.col("name").isNotNull())
    return living.groupBy("name").agg(F.min("person_id").alias("person_id")).select("person_id", "name")


def mapped_clusters(mapping: DataFrame, persons: DataFrame) -> DataFrame:
    """cluster_id, person_id: the last mapping of each cluster (seq, cluster_id, person_id); null if the person is gone."""
    last = mapping.groupBy("cluster_id").agg(F.max_by("person_id", "seq").alias("person_id"))
    alive = persons.select("person_id", F.lit(True).alias("_alive"))
    return last.join(alive, "person_id", "left").select("cluster_id", F.when(F.col("_alive"), F.col("person_id")).alias("person_id"))
