"""Queries S1 to S12: listing, freshness, sidecars, tags, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkslide.functions.measures import ALLOWED, RAW, is_allowed
from darkslide.plans.fixtures import table
from darkslide.plans.registry import query
from darkslide.sources import catalog_source as S

NAMES = "SELECT page_id, concat(split_part(split_part(url,'://',2),'/',1), '/', CASE page_id%5 WHEN 0 THEN concat('a',page_id,'.JPG') WHEN 1 THEN concat('b',page_id,'.nef') WHEN 2 THEN concat('c',page_id,'.txt') WHEN 3 THEN concat('d.e',page_id,'.png') ELSE concat('noext',page_id) END) AS path FROM pages"
KINDS = "('" + "','".join(ALLOWED + RAW) + "')"


def listing(spark, d):
    k = F.col("page_id")
    name = F.when(k % 5 == 0, F.concat(F.lit("a"), k, F.lit(".JPG"))).when(k % 5 == 1, F.concat(F.lit("b"), k, F.lit(".nef"))).when(k % 5 == 2, F.concat(F.lit("c"), k, F.lit(".txt"))).when(k % 5 == 3, F.concat(F.lit("d.e"), k, F.lit(".png"))).otherwise(F.concat(F.lit("noext"), k))
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.concat(host, F.lit("/"), name).alias("path"))


@query("s01_list_pictures", f"SELECT page_id, path FROM ({NAMES}) WHERE contains(split_part(path,'/',-1),'.') AND lower(split_part(path,'.',-1)) IN {KINDS}")
def s01(spark, d):
    return S.listed(listing(spark, d), "path")


@query("s02_scan_profile", f"SELECT split_part(path,'/',1) AS folder, count(*) AS total, count(*) FILTER (ok) AS supported, count(*) FILTER (NOT ok) AS unsupported, bool_or(ok) AS has_pictures FROM (SELECT path, lower(split_part(path,'.',-1)) IN {KINDS} AS ok FROM ({NAMES})) GROUP BY 1")
def s02(spark, d):
    return S.scan_profile(listing(spark, d), "path", is_allowed(F.col("path"), ALLOWED + RAW))


_LIST = "SELECT doc_id, n_chars AS mtime, CASE WHEN doc_id%4=0 THEN NULL ELSE doc_id*2 END AS xmp_mtime FROM documents"
_CAT = "SELECT doc_id, n_chars + CASE WHEN doc_id%7=0 THEN 1 ELSE 0 END AS mtime, CASE WHEN doc_id%8=0 THEN 5 WHEN doc_id%4=0 THEN NULL ELSE doc_id*2 END AS xmp_mtime, CASE WHEN doc_id%11=0 THEN 3 ELSE 4 END AS version FROM documents WHERE doc_id%10<>9"


def listing_and_catalog(spark, d):
    t, k = table(spark, d, "documents"), F.col("doc_id")
    files = t.select("doc_id", F.col("n_chars").alias("mtime"), F.when(k % 4 != 0, k * 2).alias("xmp_mtime"))
    catalog = t.where(k % 10 != 9).select("doc_id", (F.col("n_chars") + F.when(k % 7 == 0, 1).otherwise(0)).alias("mtime"), F.when(k % 8 == 0, 5).when(k % 4 != 0, k * 2).alias("xmp_mtime"), F.when(k % 11 == 0, 3).otherwise(4).alias("version"))
    return files, catalog


@query("s03_incremental_split", f"SELECT l.doc_id, CASE WHEN c.doc_id IS NOT NULL AND l.mtime IS NOT DISTINCT FROM c.mtime AND l.xmp_mtime IS NOT DISTINCT FROM c.xmp_mtime AND version>=4 THEN 'done' ELSE 'todo' END AS state FROM ({_LIST}) l LEFT JOIN ({_CAT}) c USING (doc_id)")
def s03(spark, d):
    return S.freshness(*listing_and_catalog(spark, d), "doc_id")


@query("s04_cache_hits", f"SELECT c.doc_id, c.version FROM ({_CAT}) c JOIN ({_LIST}) l ON l.doc_id=c.doc_id AND l.mtime=c.mtime AND l.xmp_mtime IS NOT DISTINCT FROM c.xmp_mtime")
def s04(spark, d):
    files, catalog = listing_and_catalog(spark, d)
    return S.cached(files, catalog, "doc_id").select("doc_id", "version")


@query("s05_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def s05(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("s06_sidecar_paths", "SELECT doc_id, CASE WHEN doc_id%3=1 AND doc_id%2<>0 THEN concat('img_',doc_id,'.raw.nef.xmp') ELSE concat('img_',doc_id,'.raw.xmp') END AS sidecar FROM documents")
def s06(spark, d):
    t, k = table(spark, d, "documents"), F.col("doc_id")
    images = t.select("doc_id", F.concat(F.lit("img_"), k, F.lit(".raw.nef")).alias("name"))
    files = t.where(k % 2 == 0).select(F.concat(F.lit("img_"), k, F.lit(".raw.xmp")).alias("file")).union(t.where(k % 3 == 1).select(F.concat(F.lit("img_"), k, F.lit(".raw.nef.xmp"))))
    return S.sidecar_paths(images, files, "name").select("doc_id", "sidecar")


def sidecar_xml(k):
    """Sidecars of both styles, some broken or missing."""
    # Namespaces and tags of sidecars.
    rating, label = (k % 6).cast("string"), F.when(k % 4 == 0, "Red").when(k % 4 == 1, "Blue").otherwise("")
    head = F.lit('<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">')
    names = ' xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:xmpDM="http://ns.adobe.com/xmp/1.0/DynamicMedia/" xmlns:photomechanic="http://ns.camerabits.com/photomechanic/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    attrs = F.concat(F.lit(f"<rdf:Description{names} xmp:Rating=\""), rating, F.lit('" xmp:Label="'), label, F.lit('" xmpDM:pick="'), F.when(k % 5 == 0, "-1").otherwise("1"), F.lit('" photomechanic:colorclass="'), (k % 8).cast("string"), F.lit('"></rdf:Description>'))
    words = F.concat(F.lit("<dc:subject><rdf:Bag><rdf:li>w"), (k % 3).cast("string"), F.lit("</rdf:li><rdf:li>all</rdf:li></rdf:Bag></dc:subject>"))
    elems = F.concat(F.lit(f"<rdf:Description{names}><xmp:Rating>"), rating, F.lit("</xmp:Rating><xmp:Label>"), label, F.lit("</xmp:Label><xmpDM:good>"), F.when(k % 5 == 0, "false").otherwise("true"), F.lit("</xmpDM:good><photomechanic:colorclass>"), (k % 8).cast("string"), F.lit("</photomechanic:colorclass>"), words, F.lit("</rdf:Description>"))
    whole = F.concat(head, F.when(k % 2 == 0, attrs).otherwise(elems), F.lit("</rdf:RDF></x:xmpmeta>"))
    return F.when(k % 13 == 0, F.substring(whole, 1, 150)).when(k % 17 != 0, whole)


@query("s07_sidecar_read", """SELECT doc_id, CASE WHEN bad THEN 0 ELSE doc_id%6 END::INTEGER AS rating, CASE WHEN bad THEN '' WHEN doc_id%4=0 THEN 'Red' WHEN doc_id%4=1 THEN 'Blue' ELSE ['','Red','Orange','Yellow','Green','Blue','Purple','Grey'][doc_id%8+1] END AS label,
 NOT bad AND doc_id%5=0 AS rejected, CASE WHEN bad OR doc_id%2=0 THEN '' ELSE concat('w',doc_id%3,',all') END AS keywords FROM (SELECT doc_id, doc_id%13=0 OR doc_id%17=0 AS bad FROM documents)""")
def s07(spark, d):
    t = S.read_sidecars(table(spark, d, "documents").select("doc_id", sidecar_xml(F.col("doc_id")).alias("xml")), "xml")
    return t.select("doc_id", "sidecar.rating", "sidecar.label", "sidecar.rejected", F.array_join("sidecar.keywords", ",").alias("keywords"))


@query("s08_camera_tags", """SELECT o_orderkey, CASE WHEN o_orderkey%5=0 THEN 'Unknown' ELSE concat('Cam ',o_orderkey%4) END AS camera, CASE WHEN o_orderkey%3=0 THEN concat('LM',o_orderkey%7) WHEN o_orderkey%3=1 THEN concat('LI',o_orderkey%7) WHEN o_orderkey%2=0 THEN 'ID' ELSE 'Unknown' END AS lens,
 CASE WHEN o_orderkey%6=0 THEN NULL ELSE (o_orderkey%9)*100 END::INTEGER AS iso, CASE WHEN o_orderkey%8=0 THEN NULL WHEN o_orderkey%8=1 THEN floor((o_orderkey%20)::DOUBLE*10+0.5)/10 ELSE floor((o_orderkey%30)::DOUBLE/(o_orderkey%8)::DOUBLE*10+0.5)/10 END AS aperture,
 CASE WHEN o_orderkey%10=0 THEN NULL ELSE strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') END AS taken FROM orders""")
def s08(spark, d):
    k = F.col("o_orderkey")
    text = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    tags = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 5 != 0, F.concat(F.lit("Cam "), k % 4)).otherwise(" ").alias("model"), F.when(k % 3 == 0, F.concat(F.lit("LM"), k % 7)).alias("lens_model"), F.when(k % 3 <= 1, F.concat(F.lit("LI"), k % 7)).alias("lens_info"), F.when(k % 2 == 0, "ID").alias("lens_id"),
        F.when(k % 6 != 0, ((k % 9) * 100).cast("string")).otherwise("auto").alias("iso_text"), F.when(k % 8 == 0, "1/0").when(k % 8 == 1, (k % 20).cast("string")).otherwise(F.concat((k % 30).cast("string"), F.lit("/"), (k % 8).cast("string"))).alias("f_number"),
        F.when(k % 3 == 0, text).alias("date_original"), F.when((k % 3 == 1) & (k % 10 != 0), text).otherwise("not a date").alias("date_digitized"), F.when(k % 10 != 0, text).alias("date_time"),
    )
    tags = tags.withColumn("date_original", F.when(k % 10 != 0, F.col("date_original")))
    t = S.normalized_tags(tags)
    return t.select("o_orderkey", "camera", "lens", "iso", "aperture", F.date_format("taken", "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("s09_capture_time", "SELECT event_id, CASE WHEN event_id%4=3 THEN NULL ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS captured FROM events")
def s09(spark, d):
    k = F.col("event_id")
    tag, named = F.date_format("ts", "yyyy:MM:dd HH:mm:ss"), F.date_format("ts", "yyyyMMdd_HHmmss")
    t = table(spark, d, "events").select("event_id", F.when(k % 4 == 0, tag).otherwise("0000:00:00 00:00:00").alias("raw"), F.when(k % 4 == 1, tag).alias("exif"), F.when(k % 4 == 2, F.concat(F.lit("IMG_"), named, F.lit("_x.jpg"))).otherwise(F.concat(F.lit("IMG"), named, F.lit("9.jpg"))).alias("name"))
    return t.select("event_id", F.date_format(S.capture_time(F.col("raw"), F.col("exif"), F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("captured"))


@query("s11_telemetry", "SELECT event_id, event_type, json_extract_string(props,'$.k') AS k FROM events WHERE event_type='click'")
def s11(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query("s12_latest_per_device", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r=1")
def s12(spark, d):
    return S.latest_per_key(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")
