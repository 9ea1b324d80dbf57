"""Queries ST1 to ST7: streams run over the tables to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkslide.operators import vectors
from darkslide.plans.fixtures import table
from darkslide.plans.registry import query
from darkslide.plans.session import new_path
from darkslide.streaming import jobs


def events(spark, d):
    return jobs.source(spark, f"{d}/events.parquet")


@query("st1_continuous_ingest", "SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def st1(spark, d):
    target = new_path(spark, "ingest")
    s = events(spark, d).select("user_id", "event_id", "event_type")
    jobs.ingest(s, "user_id", "event_id", target, new_path(spark, "checkpoint"))
    return jobs.latest_version(spark, target, s.schema)


@query("st2_stream_dedup", "SELECT DISTINCT sha256(text) AS digest FROM documents")
def st2(spark, d):
    s = jobs.source(spark, f"{d}/documents.parquet").select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 3600).alias("arrived"), F.sha2("text", 256).alias("digest"))
    return jobs.drain(jobs.distinct_digests(s, "arrived", "digest")).select("digest")


@query("st3_stream_chapters", """WITH c AS (SELECT *, CASE WHEN epoch(ts)-epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))<=900 THEN 0 ELSE 1 END AS cut FROM events), g AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM c)
SELECT user_id, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n FROM g GROUP BY user_id, s""")
def st3(spark, d):
    s = jobs.ended(events(spark, d).select("user_id", "ts"), "ts")
    out = jobs.drain(jobs.sessions(s, "user_id", "ts")).where("user_id is not null")
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", f("started"), f("ended"), "n")


@query("st4_online_clusters")
def st4(spark, d):
    e = table(spark, d, "embeddings")
    centers = vectors.centroids(e.where("vec_id % 2 = 0"), "label", "embedding")
    target = new_path(spark, "online")
    jobs.online_clusters(jobs.source(spark, f"{d}/embeddings.parquet").where("vec_id % 2 = 1"), "vec_id", "embedding", centers, "label", target, 0.15, 0.63)
    return spark.read.option("basePath", f"{target}/assigned").parquet(f"{target}/assigned").select("vec_id", "cluster", "is_new")


@query("st5_resume", "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY event_type")
def st5(spark, d):
    """The job is started twice on one checkpoint: the second run finds nothing left to do."""
    checkpoint, target = new_path(spark, "checkpoint"), new_path(spark, "resumed")
    for _ in range(2):
        out = jobs.drain(events(spark, d).select("event_id", "event_type"), "append", checkpoint, target=target)
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("st6_stream_counters", "SELECT event_type AS metric, sum(event_id%7)::BIGINT AS total FROM events GROUP BY event_type")
def st6(spark, d):
    return jobs.last_totals(jobs.drain(jobs.counters(events(spark, d), "event_type", F.col("event_id") % 7), "update"), "metric").select("metric", "total")


@query("st7_stream_burst_pairs", "SELECT a.event_id AS src, b.event_id AS dst FROM events a JOIN events b ON a.user_id=b.user_id AND b.ts>=a.ts AND b.ts<=a.ts+INTERVAL 600 SECOND AND a.event_id<>b.event_id AND (b.ts>a.ts OR b.event_id>a.event_id)")
def st7(spark, d):
    return jobs.drain(jobs.burst_pairs(events(spark, d), events(spark, d), "event_id", "user_id", "ts", 600, "20 minutes")).select("src", "dst")
