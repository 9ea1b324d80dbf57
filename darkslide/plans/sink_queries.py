"""Queries K1 to K14: upserts, deliveries, sidecars, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkslide.functions.verdicts import story_scene
from darkslide.plans.cull_queries import BEST, verdicts
from darkslide.plans.fixtures import face_rows, photo_rows, photos, sql_views, table
from darkslide.plans.registry import query
from darkslide.plans.session import new_path
from darkslide.sources import bucketed
from darkslide.sources import catalog_sink as K

SCENE = "CASE WHEN n IS NULL THEN 'Details/Decor' WHEN n<=2 THEN 'General' WHEN n<=6 AND s>60 THEN 'Reception' WHEN n<=6 THEN 'Ceremony' WHEN s>55 THEN 'Dance Floor' ELSE 'Ceremony' END"
SCENES = sql_views("v_face", "v_photo") + f", sc AS (SELECT photo_id, {SCENE} AS scene FROM v_photo LEFT JOIN (SELECT photo_id, count(*) AS n, sum(smile)::DOUBLE/count(*) AS s FROM v_face GROUP BY photo_id) USING (photo_id))"


_K01 = "SELECT doc_id, source, n_chars FROM documents WHERE doc_id%6<>0 UNION ALL SELECT doc_id, 'updated', n_chars+1 FROM documents WHERE doc_id%6=0 UNION ALL SELECT doc_id+10000000, 'added', n_chars FROM documents WHERE doc_id%50=1"


@query("k01_upsert", _K01)
def k01(spark, d):
    return K.upsert(*catalog_and_updates(spark, d), "doc_id")


@query("k01_bucketed_upsert", _K01)
def k01_bucketed(spark, d):
    t, updates = catalog_and_updates(spark, d)
    return written(spark, t, "doc_id", lambda path: bucketed.upsert_into(spark, path, updates))


def catalog_and_updates(spark, d):
    t, k = table(spark, d, "documents").select("doc_id", "source", "n_chars"), F.col("doc_id")
    changed = t.where(k % 6 == 0).select("doc_id", F.lit("updated").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))
    added = t.where(k % 50 == 1).select((k + 10_000_000).alias("doc_id"), F.lit("added").alias("source"), "n_chars")
    return t, changed.union(added)


def written(spark, t, key, change):
    """The table in buckets in the shared folder, after a change."""
    path = new_path(spark, "bucketed")
    bucketed.create(t, path, key, 16)
    change(path)
    return bucketed.read(spark, path)


_K02 = sql_views("v_face") + " SELECT photo_id, face_id, confidence_pct FROM v_face WHERE photo_id%10<>0 UNION ALL SELECT photo_id, face_id, 99 FROM v_face WHERE photo_id%10=0 AND face_pos=1 AND photo_id%20=0"


@query("k02_replace_children", _K02)
def k02(spark, d):
    children, new, parents = children_and_new(spark, d)
    return K.replace_children(children, new, parents, "photo_id")


@query("k02_bucketed_children", _K02)
def k02_bucketed(spark, d):
    children, new, parents = children_and_new(spark, d)
    return written(spark, children, "photo_id", lambda path: bucketed.replace_children_in(spark, path, new, parents))


def children_and_new(spark, d):
    f = face_rows(spark, d).select("photo_id", "face_id", F.col("confidence_pct").cast("long").alias("confidence_pct"), "face_pos")
    new = f.where("photo_id % 20 = 0 and face_pos = 1").select("photo_id", "face_id", F.lit(99).cast("long").alias("confidence_pct"))
    return f.drop("face_pos"), new, f.where("photo_id % 10 = 0")


@query("k03_bucketed_cascade", sql_views("v_face") + " SELECT face_id, cluster_id, photo_id FROM v_face WHERE photo_id%6<>0")
def k03_bucketed(spark, d):
    """Faces of removed photos are deleted from the written table."""
    f = face_rows(spark, d).select("face_id", "cluster_id", "photo_id")
    gone = photo_rows(spark, d).where("photo_id % 6 = 0")
    return written(spark, f, "photo_id", lambda path: bucketed.delete_from(spark, path, gone))


@query("k03_cascade", sql_views("v_face") + " SELECT face_id, CASE WHEN cluster_id%7=0 THEN NULL ELSE cluster_id END AS cluster_id FROM v_face WHERE photo_id%6<>0")
def k03(spark, d):
    f = face_rows(spark, d).select("face_id", "photo_id", "cluster_id")
    alive = photo_rows(spark, d).where("photo_id % 6 <> 0")
    clusters = table(spark, d, "supplier").where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("cluster_id"))
    return K.set_null(K.cascade(f, alive, "photo_id"), clusters, "cluster_id").select("face_id", "cluster_id")


@query("k04_schema_evolution", "SELECT doc_id, CASE WHEN doc_id%2=0 THEN n_chars*2 ELSE n_chars END AS score, CASE WHEN doc_id%2=0 THEN 'none' ELSE lang END AS lang, 4 AS version FROM documents")
def k04(spark, d):
    t, k = table(spark, d, "documents"), F.col("doc_id")
    old = t.where(k % 2 == 0).select("doc_id", F.col("n_chars").alias("score"), F.lit(3).alias("version"))
    new = t.where(k % 2 == 1).select("doc_id", F.col("n_chars").alias("score"), "lang", F.lit(4).alias("version"))
    return K.evolve(old, new, {"lang": F.lit("none")}, "version", 4, {"score": F.col("score") * 2})


def delivery(spark, d):
    p = photos(spark, d).withColumn("scene", F.when(F.col("photo_id") % 8 != 0, story_scene()))
    names = table(spark, d, "nation").select(F.sort_array(F.collect_list("n_name")).alias("x")).first()[0]  # 25 names
    lookup = F.array(*(F.lit(x) for x in names))
    people = F.transform("faces", lambda f: F.when(f["person_id"].isNotNull(), F.get(lookup, (f["person_id"] % 25).cast("int"))))
    return p.select("photo_id", "scene", (F.col("photo_id") % 5 == 0).alias("is_highlight"), people.alias("person_names"))


@query("k05_delivery_folders", SCENES + ", nn AS (SELECT list_sort(list(n_name)) AS x FROM nation), f1 AS (SELECT photo_id, person_id FROM v_face WHERE face_pos=1) SELECT p.photo_id, CASE WHEN p.photo_id%8=0 THEN 'General' ELSE scene END AS by_scene, CASE WHEN p.photo_id%5=0 THEN 'Highlights' ELSE 'Regular' END AS by_highlight, CASE WHEN f1.photo_id IS NULL THEN 'No Faces' WHEN person_id IS NULL THEN 'Unresolved' ELSE x[person_id%25+1] END AS by_person FROM v_photo p JOIN sc USING (photo_id) CROSS JOIN nn LEFT JOIN f1 ON f1.photo_id=p.photo_id")
def k05(spark, d):
    return delivery(spark, d).select("photo_id", K.subfolder("scenes").alias("by_scene"), K.subfolder("highlights").alias("by_highlight"), K.subfolder("persons").alias("by_person"))


@query("k05_delivered", SCENES + " SELECT photo_id, CASE WHEN photo_id%8=0 THEN 'General' ELSE scene END AS subfolder FROM v_photo JOIN sc USING (photo_id)")
def k05_delivered(spark, d):
    """The delivery by scenes as it was written, a folder for each, read back from these folders."""
    path = new_path(spark, "delivery")
    K.deliver(delivery(spark, d), "scenes", path)
    return spark.read.parquet(path).select("photo_id", F.col("subfolder").cast("string").alias("subfolder"))


@query("k06_sidecar_fields", """SELECT photo_id, rating, label, CASE label WHEN 'Red' THEN '1' WHEN 'Blue' THEN '5' ELSE '0' END AS colorclass, CASE WHEN rej THEN -1 WHEN rating>=3 THEN 1 ELSE 0 END AS pick, CASE WHEN rej THEN 'false' ELSE 'true' END AS good,
 CASE WHEN rej THEN 'False' WHEN rating>=3 THEN 'True' ELSE 'False' END AS tagged FROM (SELECT o_orderkey AS photo_id, (o_orderkey%6)::INTEGER AS rating, CASE WHEN o_orderkey%3=0 THEN 'Red' WHEN o_orderkey%3=1 THEN 'Blue' ELSE '' END AS label, o_orderkey%4=0 AS rej FROM orders)""")
def k06(spark, d):
    k = F.col("photo_id")
    f = K.sidecar_fields((k % 6).cast("int"), F.when(k % 3 == 0, "Red").when(k % 3 == 1, "Blue").otherwise(""), k % 4 == 0)
    return photo_rows(spark, d).select("photo_id", *(c.alias(n) for n, c in f.items()))


@query("k07_sidecar_update", """SELECT doc_id, CASE WHEN doc_id%2=0 THEN concat('<rdf:Description xmp:Rating="', doc_id%6, '" tiff:Make="A"><dc:x>1</dc:x></rdf:Description>') ELSE concat('<rdf:Description xmp:Rating="', doc_id%6, '" tiff:Make="A"></rdf:Description>') END AS xml FROM documents""")
def k07(spark, d):
    k = F.col("doc_id")
    old = F.when(k % 2 == 0, F.lit('<rdf:Description xmp:Rating="9" tiff:Make="A"><dc:x>1</dc:x></rdf:Description>')).otherwise(F.lit('<rdf:Description tiff:Make="A"></rdf:Description>'))
    t = table(spark, d, "documents").select("doc_id", old.alias("xml"))
    return t.select("doc_id", K.with_attribute(F.col("xml"), "xmp:Rating", (k % 6).cast("string")).alias("xml"))


@query("k08_manifest", sql_views("v_photo") + " SELECT filename AS path FROM v_photo WHERE photo_id%3<>0")
def k08(spark, d):
    target = new_path(spark, "manifest")
    rows = photo_rows(spark, d).select(F.when(F.col("photo_id") % 3 != 0, F.col("filename")).otherwise("").alias("filename"))
    K.write_manifest(rows, "filename", target)
    return spark.read.format("xml").option("rowTag", "photo").schema("_path string").load(target).select(F.col("_path").alias("path"))


@query("k09_summary_report", BEST + "SELECT concat('{\"analyzed\":',count(*),',\"kept\":',count(*) FILTER (decision<>'REJECT'),',\"recovered\":',count(*) FILTER (photo_id%97=0),',\"highlights\":',count(*) FILTER (decision='HERO'),'}') AS report FROM verdict")
def k09(spark, d):
    v = verdicts(spark, d)
    s = v.agg(F.count("*").alias("analyzed"), F.count_if(F.col("decision") != "REJECT").alias("kept"), F.count_if(F.col("photo_id") % 97 == 0).alias("recovered"), F.count_if(F.col("decision") == "HERO").alias("highlights"))
    return K.summary_json(s)


def routed(spark, d):
    v = verdicts(spark, d)
    return v, K.routes_of_rows(v, "photo_id", ~F.col("auto_discard"), F.col("decision") == "HERO")


@query("k10_export_routes", BEST + "SELECT photo_id, 'Best' AS route FROM verdict WHERE NOT auto_discard UNION ALL SELECT photo_id, 'Hero' FROM verdict WHERE decision='HERO' UNION ALL SELECT photo_id, 'Duplicates' FROM verdict WHERE auto_discard")
def k10(spark, d):
    return routed(spark, d)[1]


@query("k11_audit_report", BEST + ", b AS (SELECT * FROM verdict WHERE NOT auto_discard) SELECT (SELECT count(*) FROM verdict) AS total_photos, (SELECT count(*) FROM b) AS best_count, (SELECT count(*) FROM b WHERE decision='HERO') AS hero_count, (SELECT count(*) FROM verdict WHERE auto_discard) AS duplicate_count, floor((SELECT count(*) FROM b)*1000.0/(SELECT count(*) FROM verdict)+0.5)::DOUBLE/10 AS retention_percent, floor((SELECT count(*) FROM b WHERE decision='HERO')*1000.0/(SELECT count(*) FROM verdict)+0.5)::DOUBLE/10 AS hero_percent, (SELECT string_agg(concat(category,'=',n), ';' ORDER BY category) FROM (SELECT category, count(*) AS n FROM b GROUP BY category)) AS distribution")
def k11(spark, d):
    v, r = routed(spark, d)
    a = K.audit(v.count(), r, v.where("not auto_discard"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("category_distribution")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return a.withColumn("distribution", text).drop("category_distribution")


@query("k12_move_plan", "SELECT doc_id, concat(source, CASE WHEN i=0 THEN '' ELSE concat('_',i) END, '.txt') AS target FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 AS i FROM documents)")
def k12(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(".txt")).alias("name"))
    return K.move_plan(t, "name", "doc_id").select("doc_id", "target")


@query("k13_presets", SCENES + " SELECT photo_id, CASE WHEN photo_id%5=0 THEN 5 WHEN scene='Portraits' THEN 4 WHEN scene IN ('Ceremony','Reception') THEN 3 ELSE 2 END AS rating, CASE WHEN photo_id%5=0 THEN 'Red' WHEN scene='Portraits' THEN 'Blue' WHEN scene='Ceremony' THEN 'Green' WHEN scene='Reception' THEN 'Yellow' ELSE 'None' END AS label, concat(scene, CASE WHEN photo_id%5=0 THEN ',Highlight' ELSE '' END) AS keywords FROM sc")
def k13(spark, d):
    p = photos(spark, d).select("photo_id", story_scene().alias("scene"), (F.col("photo_id") % 5 == 0).alias("is_highlight"))
    return K.with_preset(p, "Wedding").select("photo_id", "rating", "label", F.array_join("keywords", ",").alias("keywords"))


@query("k14_queue_progress", "WITH l AS (SELECT event_type AS queue, user_id AS item, event_id AS seq, CASE WHEN event_id%4=0 THEN 'done' ELSE 'add' END AS action FROM events), s AS (SELECT queue, item, max_by(action, seq) AS action, min(seq) FILTER (action='add') AS added FROM l GROUP BY queue, item) SELECT queue, count(*) FILTER (action='add') AS waiting, count(*) FILTER (action='done') AS completed, min_by(item, added) FILTER (action='add') AS next_item FROM s GROUP BY queue")
def k14(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("queue"), F.col("user_id").alias("item"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "done").otherwise("add").alias("action"))
    return K.queue_progress(log, "queue")
