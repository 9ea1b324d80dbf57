"""Queries A, J2 and J13: groups, reports, distributions, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkslide.operators import duplicates, ranking
from darkslide.plans.cull_queries import BEST, verdicts
from darkslide.plans.fixtures import face_rows, photo_rows, sql_views, table
from darkslide.plans.registry import query
from darkslide.plans.score_queries import SCORED_SQL, failure_class, scored
from darkslide.functions import measures as M

DIGEST = "CASE WHEN doc_id%50=0 THEN NULL ELSE sha256(text) END"


def items(spark, d):
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 != 0, F.sha2("text", 256)).alias("digest"))


@query("a01_exact_groups", f"SELECT coalesce({DIGEST}, concat('null:',doc_id)) AS group_key, min(doc_id) AS representative, count(*) AS n FROM documents GROUP BY 1")
def a01(spark, d):
    return duplicates.exact_groups(items(spark, d), "digest", "doc_id")


@query("a02_group_flags", "SELECT g, count(*) AS n, count(*)>1 AS is_duplicate_group, coalesce(count(t)>=2 AND max(epoch(t))-min(epoch(t))<=30, false) AS is_session_group FROM (SELECT epoch(date_trunc('minute',ts))::BIGINT AS g, CASE WHEN event_id%10=0 THEN NULL ELSE ts END AS t FROM events) GROUP BY g")
def a02(spark, d):
    e = table(spark, d, "events").select(F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("g"), F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("t"))
    return duplicates.group_flags(e, "g", "t")


@query("a03_duplicate_report", f"SELECT sum(n)::BIGINT AS total, count(*) AS groups, count(*) FILTER (n>1) AS duplicate_groups, round(coalesce(sum(n) FILTER (n>1),0)::DOUBLE/sum(n)::DOUBLE,4) AS recovery_rate, round((sum(n)-count(*))::DOUBLE/sum(n)::DOUBLE,4) AS burst_collapse FROM (SELECT count(*) AS n FROM documents GROUP BY coalesce({DIGEST}, concat('null:',doc_id)))")
def a03(spark, d):
    return duplicates.duplicate_report(duplicates.exact_groups(items(spark, d), "digest", "doc_id"))


@query("a07_category_totals", SCORED_SQL + "SELECT category, count(DISTINCT photo_id) AS n FROM scored GROUP BY category")
def a07(spark, d):
    return scored(spark, d).groupBy("category").agg(F.count_distinct("photo_id").alias("n"))


@query("a08_person_coverage", sql_views("v_face") + ", c AS (SELECT coalesce(person_id, cluster_id) AS p, count(*) AS n FROM v_face GROUP BY 1), w AS (SELECT s_suppkey AS person FROM supplier UNION ALL SELECT -s_suppkey-1 FROM supplier) SELECT person, coalesce(n,0) AS n, coalesce(n,0)::DOUBLE/(SELECT sum(n) FROM c)::DOUBLE<0.009::DOUBLE AS underrepresented FROM w LEFT JOIN c ON p=person")
def a08(spark, d):
    """Persons of every supplier's number, and as many that have no face."""
    faces = face_rows(spark, d).select(F.coalesce("person_id", "cluster_id").alias("person"))
    key = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person"))
    return coverage(key.union(key.select(-F.col("person") - 1)), faces, 0.009)


def coverage(persons, appearances, least: float = 0.05):
    """person, n, underrepresented (share below `least`); no rows if nobody appears."""
    counts = persons.join(appearances.groupBy("person").agg(F.count("*").alias("n")), "person")
    total = counts.agg(F.sum("n").alias("_total")).where("_total > 0")
    every = persons.join(counts, "person", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.join(F.broadcast(total)).select("person", "n", (F.col("n") / F.col("_total") < least).alias("underrepresented"))  # one row of total


@query("a09_totals", BEST + "SELECT count(*) FILTER (NOT auto_discard) AS selected, count(*) FILTER (decision='HERO') AS heroes, (sum(size_kb) FILTER (auto_discard))::BIGINT AS reclaimable_kb, CASE WHEN count(*) FILTER (NOT auto_discard)>0 THEN 100.0 ELSE 0.0 END AS completeness FROM verdict JOIN v_photo USING (photo_id)")
def a09(spark, d):
    t = verdicts(spark, d).join(photo_rows(spark, d).select("photo_id", "size_kb"), "photo_id")
    kept = F.count_if(~F.col("auto_discard"))
    return t.agg(kept.alias("selected"), F.count_if(F.col("decision") == "HERO").alias("heroes"), F.sum(F.when(F.col("auto_discard"), F.col("size_kb"))).alias("reclaimable_kb"), F.when(kept > 0, 100.0).otherwise(0.0).alias("completeness"))


FAILURES = """SELECT doc_id, lang AS stage, CASE WHEN doc_id%17=0 THEN 'Unsupported extension' WHEN doc_id%13=0 THEN 'Missing file' WHEN doc_id%5=0 THEN 'Empty file' WHEN doc_id%3=0 THEN 'Decode failure' END AS failure FROM documents"""


def failures(spark, d):
    k = F.col("doc_id")
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("stage"), F.when(k % 17 == 0, "txt").otherwise("jpg").alias("ext"), (k % 13 != 0).alias("found"), F.lit(None).cast("int").alias("errno"), F.when(k % 5 == 0, 0).otherwise(1).alias("size"), (k % 3 != 0).alias("decodes"), F.lit(False).alias("failed"))
    return t.select("doc_id", "stage", failure_class().alias("failure"))


@query("a10_failure_counts", f"SELECT failure, stage, count(*) AS n FROM ({FAILURES}) WHERE failure IS NOT NULL GROUP BY failure, stage")
def a10(spark, d):
    return failures(spark, d).where("failure is not null").groupBy("failure", "stage").agg(F.count("*").alias("n"))


@query("a11_histograms", """WITH v AS (SELECT l_suppkey AS k, (l_partkey*7%200)::DOUBLE AS x FROM lineitem), i AS (SELECT * FROM v WHERE x>=0 AND x<180), t AS (SELECT k, count(*) AS n, round(avg(x),6) AS mean, round(stddev_pop(x),6) AS std FROM i GROUP BY k),
b AS (SELECT k, floor(x/5.625::DOUBLE)::INTEGER AS bin, count(*) AS c FROM i GROUP BY 1,2), g AS (SELECT k, n, mean, std, unnest(range(32)) AS bin FROM t)
SELECT k, bin::INTEGER AS bin, round(coalesce(c,0)::DOUBLE/n::DOUBLE,9) AS share, mean, std FROM g LEFT JOIN b USING (k, bin)""")
def a11(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") * 7 % 200).cast("double").alias("x"))
    h = duplicates.histogram(v, "k", "x", 0, 180, 32)
    return h.select("k", F.posexplode("bins").alias("bin", "share"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")).withColumn("share", F.round("share", 9))


@query("a12_kpi_row", "SELECT count(o_orderpriority) AS total, count(*) FILTER (o_orderdate>=TIMESTAMP '1995-06-17') AS active, count(*) FILTER (o_orderdate<TIMESTAMP '1995-06-17') AS expired, coalesce(floor(avg(o_custkey)*10+0.5)/10,0.0) AS mean_seats, sum(o_custkey)::BIGINT AS seats FROM orders")
def a12(spark, d):
    day = F.lit("1995-06-17").cast("timestamp_ntz")
    return table(spark, d, "orders").agg(
        F.count("o_orderpriority").alias("total"), F.count_if(F.col("o_orderdate") >= day).alias("active"), F.count_if(F.col("o_orderdate") < day).alias("expired"),
        F.coalesce(M.round1(F.avg("o_custkey")), F.lit(0.0)).alias("mean_seats"), F.sum("o_custkey").alias("seats"),
    )


@query("a13_top_requested", "SELECT event_type, max(event_id%5) AS priority, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def a13(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.max(F.col("event_id") % 5).alias("priority"), F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "event_type").limit(5)


@query("a14_counters", "SELECT event_type AS metric, sum(event_id%7)::BIGINT AS total FROM events GROUP BY event_type")
def a14(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.sum(F.col("event_id") % 7).alias("total"))


@query("a15_percentiles", "SELECT event_type, round(quantile_cont(value,0.95),6) AS p95, round(quantile_cont(value,0.99),6) AS p99, round(count(*)/(epoch(max(ts))-epoch(min(ts))),9) AS per_second FROM events GROUP BY event_type")
def a15(spark, d):
    from darkslide.operators.timeline import seconds

    span = F.max(seconds("ts")) - F.min(seconds("ts"))
    e = table(spark, d, "events")
    p = ranking.percentiles(e, "event_type", "value", {"p95": 0.95, "p99": 0.99})
    g = e.groupBy("event_type").agg(F.round(F.count("*") / span, 9).alias("per_second"))
    return g.join(p, "event_type", "left").select("event_type", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"), "per_second")


@query("a17_distinct_photos", sql_views("v_face") + " SELECT cluster_id, count(DISTINCT photo_id) AS photos FROM v_face GROUP BY cluster_id")
def a17(spark, d):
    return face_rows(spark, d).groupBy("cluster_id").agg(F.count_distinct("photo_id").alias("photos"))


@query("j02_exact_self_match", "SELECT sha256(text) AS digest, doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents QUALIFY count(*) OVER (PARTITION BY sha256(text))>1")
def j02(spark, d):
    """Each row that has copies beside the first of them: a row for each copy, however many there are."""
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    groups = duplicates.exact_groups(t, "digest", "doc_id").where("n > 1").select(F.col("group_key").alias("digest"), F.col("representative").alias("first"))
    return t.join(groups, "digest").select("digest", "doc_id", "first")


@query("j13_failed_paths", f"SELECT doc_id, failure, failure IS NULL AS succeeded FROM ({FAILURES})")
def j13(spark, d):
    listing = table(spark, d, "documents").select("doc_id")
    failed = failures(spark, d).where("failure is not null").select("doc_id", "failure")
    done = listing.join(failed, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string").alias("failure"), F.lit(True).alias("succeeded"))
    return done.unionByName(listing.join(failed, "doc_id").withColumn("succeeded", F.lit(False)))
