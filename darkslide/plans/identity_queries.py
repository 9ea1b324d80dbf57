"""Queries J6 to J12, A6, G7 and G8: faces, persons, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkslide.operators import identity
from darkslide.plans.fixtures import face_rows, photo_rows, sql_views, table
from darkslide.plans.registry import query

_PAIR = sql_views("v_face") + """, f AS (SELECT *, coalesce('p'||person_id, 'c'||cluster_id) AS who FROM v_face),
pair AS (SELECT t.face_id AS target, c.face_id AS candidate, t.occlusion=0 AND c.occlusion=0 AS swappable FROM f t JOIN f c USING (who) WHERE t.is_blink AND c.eye_openness>=75 AND abs(t.yaw-c.yaw)<=12 AND abs(t.pitch-c.pitch)<=12 AND abs(t.roll-c.roll)<=12 AND abs(t.smile-c.smile)<=25 AND abs(t.lighting-c.lighting)<=25)
"""


def recovery(spark, d):
    f = face_rows(spark, d)
    return f, identity.recovery_candidates(f.where("is_blink"), f)


@query("j06_recovery_candidates", _PAIR + "SELECT target, candidate FROM pair")
def j06(spark, d):
    return recovery(spark, d)[1]


@query("j07_swap_eligible", _PAIR + "SELECT target, candidate, swappable FROM pair")
def j07(spark, d):
    return eligible(*recovery(spark, d))


@query("j06_recovery_candidates_all", _PAIR + "SELECT target, candidate FROM pair")
def j06_all(spark, d):
    return j06(spark, d)


@query("j07_swap_eligible_all", _PAIR + "SELECT target, candidate, swappable FROM pair")
def j07_all(spark, d):
    return j07(spark, d)


def eligible(f, pairs):
    eyes = f.select("face_id", (F.col("occlusion") == 0).alias("eyes"))
    both = pairs.join(eyes.toDF("target", "a"), "target").join(eyes.toDF("candidate", "b"), "candidate")
    return both.select("target", "candidate", (F.col("a") & F.col("b")).alias("swappable"))


@query("j08_enriched_faces", sql_views("v_face") + """, s AS (SELECT cluster_id, count(*) AS face_count, max(confidence_pct) AS best FROM v_face GROUP BY cluster_id), c AS (SELECT s_suppkey AS cluster_id, s_nationkey AS nation FROM supplier), p AS (SELECT s_suppkey AS person_id, s_name AS person_name FROM supplier),
k AS (SELECT face_id, photo_id, cluster_id, person_id, confidence_pct FROM v_face WHERE cluster_id%2=0)
SELECT face_id, photo_id, k.cluster_id, k.person_id, confidence_pct, face_count, best, nation, person_name FROM k LEFT JOIN s USING (cluster_id) LEFT JOIN c USING (cluster_id) LEFT JOIN p USING (person_id)
UNION ALL SELECT face_id, photo_id, NULL, NULL, confidence_pct, NULL, NULL, NULL, NULL FROM v_face WHERE cluster_id%2=1 AND photo_id NOT IN (SELECT photo_id FROM k)""")
def j08(spark, d):
    f = face_rows(spark, d)
    stats = f.groupBy("cluster_id").agg(F.count("*").alias("face_count"), F.max("confidence_pct").alias("best"))
    s = table(spark, d, "supplier")
    clustered = f.where("cluster_id % 2 = 0").select("face_id", "photo_id", "cluster_id", "person_id", "confidence_pct")
    raw = f.where("cluster_id % 2 = 1").select("face_id", "photo_id", "confidence_pct")
    clusters = s.select(F.col("s_suppkey").alias("cluster_id"), F.col("s_nationkey").alias("nation"))
    persons = s.select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("person_name"))
    return identity.enriched_faces(clustered, raw, stats, clusters, persons)


@query("j09_cluster_view", "SELECT c_custkey, count(o_orderkey)::INTEGER AS n_faces, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey),'') AS faces FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY c_custkey")
def j09(spark, d):
    faces = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    v = identity.cluster_view(table(spark, d, "customer").select("c_custkey"), faces, "c_custkey", ["o_orderkey"])
    return v.select("c_custkey", "n_faces", F.array_join(F.transform("faces", lambda f: f["o_orderkey"].cast("string")), ",").alias("faces"))


@query("j09_cluster_pages", """WITH r AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1)//4 AS page FROM orders), n AS (SELECT o_custkey, count(*) AS n_faces FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(page,0) AS page, coalesce(n_faces,0) AS n_faces, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey),'') AS faces
FROM customer LEFT JOIN r ON r.o_custkey=c_custkey LEFT JOIN n ON n.o_custkey=c_custkey GROUP BY 1, 2, 3""")
def j09_pages(spark, d):
    faces = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    v = identity.cluster_pages(table(spark, d, "customer").select("c_custkey"), faces, "c_custkey", ["o_orderkey"], 4)
    return v.select("c_custkey", "page", "n_faces", F.array_join(F.transform("faces", lambda f: f["o_orderkey"].cast("string")), ",").alias("faces"))


@query("j10_person_timeline", sql_views("v_face", "v_photo") + ", s AS (SELECT DISTINCT coalesce(person_id,cluster_id) AS person, photo_id FROM v_face) SELECT person, photo_id, captured_at, row_number() OVER (PARTITION BY person ORDER BY captured_at, photo_id)::INTEGER AS place FROM s JOIN v_photo USING (photo_id) WHERE photo_id%9<>0")
def j10(spark, d):
    p = photo_rows(spark, d).select("photo_id", F.when(F.col("photo_id") % 9 != 0, F.col("captured_at")).alias("captured_at"))
    return identity.person_timeline(face_rows(spark, d), p, F.coalesce("person_id", "cluster_id"))


@query("j11_photos_of_person", sql_views("v_face", "v_photo") + " SELECT photo_id, filename FROM v_photo WHERE photo_id IN (SELECT photo_id FROM v_face WHERE person_id=7)")
def j11(spark, d):
    return photo_rows(spark, d).join(face_rows(spark, d).where("person_id = 7"), "photo_id", "left_semi").select("photo_id", "filename")


@query("j12_registry_refresh", "WITH a AS (SELECT o_custkey, max(o_orderdate)::DATE AS day FROM orders WHERE o_orderstatus<>'F' GROUP BY o_custkey) SELECT c_custkey, coalesce(day::VARCHAR, 'none') AS last_day, day IS NOT NULL AS refreshed FROM customer LEFT JOIN a ON o_custkey=c_custkey")
def j12(spark, d):
    active = table(spark, d, "orders").where("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.max("o_orderdate")).alias("day"))
    return table(spark, d, "customer").join(active, "c_custkey", "left").select("c_custkey", F.coalesce(F.col("day").cast("string"), F.lit("none")).alias("last_day"), F.col("day").isNotNull().alias("refreshed"))


@query("a06_person_statistics", sql_views("v_face") + " SELECT person_id AS person, count(*) AS face_count, max_by(face_id, confidence_pct*1000000000000-face_id) AS key_face FROM v_face WHERE person_id IS NOT NULL GROUP BY person_id")
def a06(spark, d):
    return identity.person_statistics(face_rows(spark, d), F.col("person_id"), "confidence_pct")


_CMD = "cmd AS (SELECT event_id AS seq, user_id AS person_id, CASE WHEN event_id%7=0 THEN 'delete' WHEN event_id%3=0 THEN 'rename' ELSE 'create' END AS op, CASE WHEN event_id%7<>0 THEN concat('Name ', event_id%90) END AS name FROM events)"
_STATE = f"{_CMD}, st AS (SELECT person_id, max_by(op, seq) AS op, max_by(name, seq) FILTER (name IS NOT NULL) AS name FROM cmd GROUP BY person_id), alive AS (SELECT min(person_id) AS person_id, name FROM st WHERE op<>'delete' AND name IS NOT NULL GROUP BY name)"


def state(spark, d):
    k = F.col("event_id")
    op = F.when(k % 7 == 0, "delete").when(k % 3 == 0, "rename").otherwise("create")
    name = F.when(k % 7 != 0, F.concat(F.lit("Name "), k % 90))
    return identity.person_state(table(spark, d, "events").select(k.alias("seq"), F.col("user_id").alias("person_id"), op.alias("op"), name.alias("name")))


@query("g07_person_state", f"WITH {_STATE}, mp AS (SELECT s_suppkey AS cluster_id, s_suppkey%150 AS person_id FROM supplier) SELECT cluster_id, alive.person_id, name FROM mp LEFT JOIN alive USING (person_id)")
def g07(spark, d):
    persons = state(spark, d)
    mapping = table(spark, d, "supplier").select(F.lit(1).alias("seq"), F.col("s_suppkey").alias("cluster_id"), (F.col("s_suppkey") % 150).alias("person_id"))
    return identity.mapped_clusters(mapping, persons).join(persons, "person_id", "left").select("cluster_id", "person_id", "name")


@query("g08_person_lookup", f"WITH {_STATE} SELECT person_id, name FROM alive WHERE person_id=5 OR name='Name 42'")
def g08(spark, d):
    return state(spark, d).where("person_id = 5 OR name = 'Name 42'")
