"""Queries W, T and U: ranks, verdicts, sessions, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkslide.operators import cull, ranking, timeline
from darkslide.plans.fixtures import face_rows, photo_rows, photos, sql_views, table
from darkslide.plans.registry import query
from darkslide.plans.score_queries import FACE_QUALITY_AVG, QUALITY, SCORED_SQL, quality_of, scored

BEST = SCORED_SQL.rstrip() + """, best AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY round(overall,6) DESC, photo_id)::INTEGER AS rank FROM scored),
cand AS (SELECT * FROM best WHERE rank=1 AND decision<>'REJECT'),
smart AS (SELECT photo_id FROM (SELECT photo_id, row_number() OVER (ORDER BY round(overall,6) DESC, photo_id) AS r FROM cand) WHERE r<=greatest(1,ceil((SELECT count(*) FROM scored)*3/100.0))),
cov AS (SELECT c.photo_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY round(overall,6) DESC, photo_id) AS r FROM cand) c JOIN (SELECT category, count(*) AS n FROM scored GROUP BY category) t USING (category)
  WHERE r<=greatest(1,ceil(n*(CASE category WHEN 'Awards' THEN 30 WHEN 'Branding' THEN 60 WHEN 'Networking' THEN 60 WHEN 'Exhibition' THEN 70 ELSE 25 END)/100.0))),
heroes AS (SELECT photo_id FROM (SELECT *, row_number() OVER (ORDER BY round(overall,6) DESC, photo_id) AS r FROM best JOIN cov USING (photo_id) WHERE category<>'Branding' OR branding_presence>=75) WHERE r<=least(25,greatest(1,ceil((SELECT count(*) FROM scored)*2/100.0)))),
verdict AS (SELECT photo_id, group_id, rank, rank=1 AS is_best, category, floor(round(overall,6)*10+0.5)/10 AS overall, floor(round(publish,6)*10+0.5)/10 AS publish,
  CASE WHEN photo_id IN (SELECT photo_id FROM heroes) THEN 'HERO' WHEN photo_id IN (SELECT photo_id FROM cov) THEN 'KEEP' ELSE 'REJECT' END AS decision, photo_id NOT IN (SELECT photo_id FROM cov) AS auto_discard FROM best)
"""


def verdicts(spark, d):
    return cull.verdicts(scored(spark, d), coverage=True)


@query("w01_best_in_group", BEST + "SELECT photo_id, group_id, rank, rank=1 AS is_best FROM best")
def w01(spark, d):
    return cull.with_best(scored(spark, d)).select("photo_id", "group_id", "rank", "is_best")


@query("w02_top_percent", BEST + "SELECT photo_id, group_id, rank FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM best) WHERE rank<=greatest(1,ceil(n*30/100.0))")
def w02(spark, d):
    return ranking.top_percent(scored(spark, d), "group_id", cull.by_score(), 30).select("photo_id", "group_id", "rank")


@query("w03_smart_cull", BEST + "SELECT photo_id FROM smart")
def w03(spark, d):
    return cull.smart_keep(cull.with_best(scored(spark, d)), 3)


@query("w04_coverage_quota", BEST + "SELECT photo_id FROM cov")
def w04(spark, d):
    return cull.coverage_keep(cull.with_best(scored(spark, d)))


@query("w05_verdicts", BEST + "SELECT * FROM verdict")
def w05(spark, d):
    return verdicts(spark, d)


@query("w06_heroes", BEST + "SELECT photo_id FROM heroes")
def w06(spark, d):
    return verdicts(spark, d).where("decision = 'HERO'").select("photo_id")


@query("w07_chapters", "SELECT event_id, chapter::BIGINT AS chapter FROM (SELECT event_id, 1+sum(cut) OVER (ORDER BY ts, event_id) AS chapter FROM (SELECT event_id, ts, CASE WHEN epoch(ts)-epoch(lag(ts) OVER (ORDER BY ts, event_id))>900 THEN 1 ELSE 0 END AS cut FROM events))")
def w07(spark, d):
    return timeline.chapters(table(spark, d, "events"), "ts", "event_id").select("event_id", "chapter")


@query("w08_long_gaps", "SELECT user_id, gap_start, gap_end, round(epoch(gap_end)-epoch(gap_start),3) AS seconds FROM (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_start, ts AS gap_end FROM events) WHERE epoch(gap_end)-epoch(gap_start)>3600")
def w08(spark, d):
    return timeline.long_gaps(table(spark, d, "events"), "user_id", "ts", "event_id", 3600)


@query("w09_synthetic_times", """WITH e AS (SELECT event_id, CASE WHEN event_id%10=0 THEN NULL ELSE ts END AS t FROM events), m AS (SELECT min(t) AS base FROM e), u AS (SELECT event_id, row_number() OVER (ORDER BY event_id)-1 AS i FROM e WHERE t IS NULL)
SELECT event_id, coalesce(t, base + to_seconds(2*i)) AS captured_at, t IS NULL AS synthetic FROM e CROSS JOIN m LEFT JOIN u USING (event_id)""")
def w09(spark, d):
    t = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("captured_at"))
    return timeline.fill_times(t, "captured_at", "event_id")


@query("w10_best_shot", sql_views("v_face") + f" SELECT person, photo_id, q AS quality FROM (SELECT coalesce(person_id, cluster_id) AS person, photo_id, {QUALITY} AS q, row_number() OVER (PARTITION BY coalesce(person_id, cluster_id) ORDER BY {QUALITY} DESC, photo_id, face_pos) AS r FROM v_face) WHERE r=1 AND person IS NOT NULL")
def w10(spark, d):
    f = face_rows(spark, d).select(F.coalesce("person_id", "cluster_id").alias("person"), "photo_id", "face_pos", quality_of().alias("quality")).where("person is not null")
    best = f.groupBy("person").agg(F.max(F.struct(F.col("quality"), (-F.col("photo_id")).alias("p"), (-F.col("face_pos")).alias("f"))).alias("b"))
    return best.select("person", (-F.col("b.p")).alias("photo_id"), F.col("b.quality").alias("quality"))


@query("w11_neighbours", "SELECT event_id, array_to_string(list_concat(list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), list(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), ',') AS neighbours FROM events")
def w11(spark, d):
    t = ranking.neighbours(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id", 3)
    return t.select("event_id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


@query("w12_auto_names", """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN concat('Person ', s_suppkey//3) WHEN s_suppkey%7=0 THEN s_name END AS name FROM supplier),
m AS (SELECT coalesce(max(nullif(regexp_extract(name,'^Person ([0-9]+)$',1),'')::BIGINT) FILTER (regexp_matches(name,'^Person [0-9]+$')),0) AS top FROM s)
SELECT s_suppkey, coalesce(name, concat('Person ', top + row_number() OVER (PARTITION BY name IS NULL ORDER BY s_suppkey))) AS name FROM s, m""")
def w12(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.when(k % 3 == 0, F.concat(F.lit("Person "), F.floor(k / 3))).when(k % 7 == 0, F.col("s_name")).alias("name"))
    return timeline.auto_names(s, "s_suppkey", "name")


@query("w13_next_ids", "SELECT vec_id, label, CASE WHEN vec_id%4=0 THEN (SELECT max(vec_id) FROM embeddings)+row_number() OVER (PARTITION BY vec_id%4=0 ORDER BY vec_id) ELSE vec_id END AS new_id FROM embeddings")
def w13(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return timeline.next_ids(e, F.col("vec_id") % 4 == 0, "vec_id", "new_id")


_ACTIONS = "SELECT event_id AS seq, event_id%(SELECT count(*) FROM orders)+1 AS photo_id, CASE event_id%4 WHEN 0 THEN 'swap' WHEN 1 THEN 'toggle' WHEN 2 THEN 'discard' ELSE 'keep_only' END AS action FROM events WHERE event_id%3=0"


@query("w14_overrides", BEST.rstrip() + f""", acts AS ({_ACTIONS}), la AS (SELECT photo_id, max_by(action, seq) AS action, max(seq) AS seq FROM acts GROUP BY photo_id),
wl AS (SELECT v.*, action, seq FROM verdict v LEFT JOIN la USING (photo_id)), pk AS (SELECT group_id, max_by(photo_id, seq) AS pick, max_by(action, seq) AS pact FROM wl WHERE action IN ('swap','keep_only') GROUP BY group_id)
SELECT photo_id, wl.group_id, CASE WHEN pick IS NOT NULL THEN photo_id=pick ELSE is_best END AS is_best, CASE WHEN photo_id=pick THEN false WHEN action='toggle' THEN NOT auto_discard WHEN action='discard' THEN true WHEN pact='keep_only' THEN true WHEN pick IS NOT NULL AND is_best THEN true ELSE auto_discard END AS discarded FROM wl LEFT JOIN pk USING (group_id)""")
def w14(spark, d):
    n = table(spark, d, "orders").count()
    k = F.col("event_id")
    action = F.when(k % 4 == 0, "swap").when(k % 4 == 1, "toggle").when(k % 4 == 2, "discard").otherwise("keep_only")
    acts = table(spark, d, "events").where(k % 3 == 0).select(k.alias("seq"), (k % n + 1).alias("photo_id"), action.alias("action"))
    return cull.overridden(verdicts(spark, d), acts)


@query("t01_groups_by_size", sql_views("v_photo") + " SELECT group_id, n, row_number() OVER (ORDER BY n DESC, group_id) AS place FROM (SELECT group_id, count(*) AS n FROM v_photo GROUP BY group_id)")
def t01(spark, d):
    g = photo_rows(spark, d).groupBy("group_id").agg(F.count("*").alias("n"))
    return ranking.rank_all(g, [F.desc("n"), F.col("group_id")], "place")


@query("t02_highlights", sql_views("v_face", "v_photo") + FACE_QUALITY_AVG + " SELECT photo_id, CASE WHEN n IS NULL THEN 50.0 ELSE round(q10/10.0/n, 4) END AS score FROM v_photo LEFT JOIN fq USING (photo_id) ORDER BY 2 DESC, 1 LIMIT 10")
def t02(spark, d):
    from darkslide.functions.verdicts import highlight_score

    score = F.round(highlight_score(lambda f: quality_of(lambda k: f[k])), 4)
    return photos(spark, d).select("photo_id", score.alias("score")).orderBy(F.desc("score"), "photo_id").limit(10)


@query("t03_most_recent", "SELECT event_id, strftime(ts,'%Y-%m-%d %H:%M') AS at, substr(props,1,50) AS text FROM events ORDER BY ts DESC, event_id LIMIT 5")
def t03(spark, d):
    e = table(spark, d, "events").orderBy(F.desc("ts"), "event_id").limit(5)
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), F.substring("props", 1, 50).alias("text"))


@query("t04_persons_by_name", "SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_name, s_suppkey) AS place FROM supplier")
def t04(spark, d):
    return ranking.rank_all(table(spark, d, "supplier").select("s_suppkey", "s_name"), [F.col("s_name"), F.col("s_suppkey")], "place")


@query("t05_preview", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 4")
def t05(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").orderBy("source", "doc_id").limit(4)


@query("u01_difference", BEST + "SELECT photo_id FROM scored WHERE photo_id NOT IN (SELECT photo_id FROM cov)")
def u01(spark, d):
    s = scored(spark, d)
    return s.select("photo_id").join(cull.coverage_keep(cull.with_best(s)), "photo_id", "left_anti")


@query("u02_union", "SELECT doc_id, source, n_chars, 'reused' AS origin FROM documents WHERE doc_id%3<>0 UNION ALL SELECT doc_id, source, n_chars+1, 'new' FROM documents WHERE doc_id%3=0")
def u02(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    old = t.where("doc_id % 3 <> 0").withColumn("origin", F.lit("reused"))
    new = t.where("doc_id % 3 = 0").select(F.lit("new").alias("origin"), (F.col("n_chars") + 1).alias("n_chars"), "source", "doc_id")
    return old.unionByName(new)


@query("u03_resume_split", "SELECT doc_id, CASE WHEN doc_id%5<2 THEN 'processed' ELSE 'remaining' END AS part FROM documents WHERE doc_id%4<>0")
def u03(spark, d):
    k = F.col("doc_id")
    listing = table(spark, d, "documents").where(k % 4 != 0).select("doc_id")
    saved = table(spark, d, "documents").select("doc_id", F.when(k % 5 < 2, "processed").otherwise("remaining").alias("part"))
    return saved.join(listing, "doc_id", "left_semi")


@query("u04_kept_and_discarded", BEST + "SELECT photo_id, decision IN ('HERO','KEEP') AS kept, 1::BIGINT AS n FROM verdict")
def u04(spark, d):
    v = verdicts(spark, d).select("photo_id", F.col("decision").isin("HERO", "KEEP").alias("kept"))
    both = v.where("kept").unionByName(v.where("not kept"))
    return both.groupBy("photo_id", "kept").agg(F.count("*").alias("n"))


@query("u05_distinct", sql_views("v_face") + " SELECT DISTINCT photo_id, cluster_id FROM v_face")
def u05(spark, d):
    return face_rows(spark, d).select("photo_id", "cluster_id").distinct()


