"""Queries P35 to P38, J1, J3 to J5, A4, A5, G1 to G6 and S10: vectors, edges, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from darkslide.functions import measures as M
from darkslide.operators import duplicates, graph, vectors
from darkslide.plans.aggregate_queries import items
from darkslide.plans.fixtures import table
from darkslide.plans.registry import query
from darkslide.plans.session import materialize
from darkslide.sources.catalog_sink import upsert

V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
NEXT = f"WITH {V}, n AS (SELECT a.vec_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id=a.vec_id+1)"
CENTER = f"{V}, cm AS (SELECT label, pos, avg(e[pos]) AS m FROM v, range(1,65) r(pos) GROUP BY label, pos), cn AS (SELECT label, sqrt(sum(m*m)) AS n FROM cm GROUP BY label), ce AS (SELECT label, list(m/n ORDER BY pos) AS c FROM cm JOIN cn USING (label) GROUP BY label)"


def emb(spark, d):
    return table(spark, d, "embeddings")


def neighbours(spark, d):
    e = emb(spark, d).select("vec_id", F.col("embedding").alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


_HIST = "h AS (SELECT k, bin, c::DOUBLE/sum(c) OVER (PARTITION BY k) AS s FROM (SELECT k, bin, coalesce(c,0) AS c FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) CROSS JOIN (SELECT unnest(range(16)) AS bin) LEFT JOIN (SELECT l_suppkey AS k, floor((l_partkey*7%256)/16.0)::INTEGER AS bin, count(*) AS c FROM lineitem GROUP BY 1,2) USING (k, bin)))"


@query("p35_histogram_agreement", f"WITH {_HIST} SELECT a.k, round(corr(a.s,b.s),6) AS correlation, corr(a.s,b.s)>=0.2 AS agree FROM h a JOIN h b ON b.k=a.k+1 AND b.bin=a.bin GROUP BY a.k")
def p35(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_partkey") * 7 % 256).cast("double").alias("x"))
    h = duplicates.histogram(v, "k", "x", 0, 256, 16).select("k", "bins")
    pairs = h.join(h.select((F.col("k") - 1).alias("k"), F.col("bins").alias("other")), "k")
    c = M.correlation(F.col("bins"), F.col("other"))
    return pairs.select("k", F.round(c, 6).alias("correlation"), (c >= 0.2).alias("agree"))


@query("p36_cosine", NEXT + " SELECT vec_id, round(list_cosine_similarity(a,b),6) AS sim FROM n")
def p36(spark, d):
    return neighbours(spark, d).select("vec_id", F.round(M.cosine(F.col("a"), F.col("b")), 6).alias("sim"))


@query("p37_distances", NEXT + " SELECT vec_id, round(1-list_cosine_similarity(a,b),6) AS cosine, round(list_distance(a,b),6) AS euclidean FROM n")
def p37(spark, d):
    return neighbours(spark, d).select("vec_id", F.round(M.distance(F.col("a"), F.col("b")), 6).alias("cosine"), F.round(M.distance(F.col("a"), F.col("b"), "euclidean"), 6).alias("euclidean"))


@query("p38_normalized", f"WITH {V} SELECT vec_id, (pos-1)::INTEGER AS pos, round(CASE WHEN vec_id%10=0 THEN 0.0 ELSE e[pos]*3/sqrt(list_sum(list_transform(e, lambda x: x*x*9))) END,6) AS x FROM v, range(1,65) r(pos)")
def p38(spark, d):
    scaled = F.transform("embedding", lambda x: F.when(F.col("vec_id") % 10 == 0, 0.0).otherwise(x.cast("double") * 3))
    t = emb(spark, d).select("vec_id", scaled.alias("v"))
    return t.select("vec_id", F.posexplode(M.normalized(F.col("v"))).alias("pos", "x")).withColumn("x", F.round("x", 6))


_EV = "SELECT event_id, epoch(ts) AS s, 1+(event_id%7)/10.0::DOUBLE AS ratio, event_id%40 AS saturation, event_id%64 AS fp, [event_id%5, event_id%3, 1]::DOUBLE[] AS hue, [event_id%2, event_id%3, 1]::DOUBLE[] AS sat, [1, event_id%4, 2]::DOUBLE[] AS val FROM events"


def _corr(x: str) -> str:
    ma, mb = f"list_avg(a.{x})", f"list_avg(b.{x})"
    sxy = "+".join(f"(a.{x}[{i}]-{ma})*(b.{x}[{i}]-{mb})" for i in (1, 2, 3))
    va = "+".join(f"(a.{x}[{i}]-{ma})*(a.{x}[{i}]-{ma})" for i in (1, 2, 3))
    vb = "+".join(f"(b.{x}[{i}]-{mb})*(b.{x}[{i}]-{mb})" for i in (1, 2, 3))
    return f"(CASE WHEN ({va})*({vb})<=1e-18 THEN 1.0 ELSE ({sxy})/sqrt(({va})*({vb})) END)"


@query("j01_near_duplicate_edges", f"""WITH e AS ({_EV}) SELECT a.event_id AS src, b.event_id AS dst FROM e a JOIN e b ON (b.s>a.s OR (b.s=a.s AND b.event_id>a.event_id)) AND b.s-a.s<=60
 WHERE abs(a.ratio-b.ratio)/greatest(a.ratio,b.ratio)<=0.25 AND (a.saturation<15)=(b.saturation<15) AND bit_count(xor(a.fp,b.fp))<=7 AND {_corr('hue')}>=0.9 AND {_corr('sat')}>=0.8 AND {_corr('val')}>=0.8""")
def j01(spark, d):
    k = F.col("event_id")
    arr = lambda *xs: F.array(*(F.lit(x).cast("double") if isinstance(x, int) else x.cast("double") for x in xs))
    e = table(spark, d, "events").select("event_id", "ts", (1 + (k % 7) / 10).alias("ratio"), (k % 40).alias("saturation"), (k % 64).alias("fp"), arr(k % 5, k % 3, 1).alias("hue"), arr(k % 2, k % 3, 1).alias("sat"), arr(1, k % 4, 2).alias("value"))
    return duplicates.near_duplicate_edges(e, "event_id", "ts", 60)


_UNKNOWN = """e AS (SELECT event_id, CASE WHEN event_id%3<>0 THEN epoch(ts) END AS s, 1+(event_id//7%5)/10.0::DOUBLE AS ratio, event_id//7%40 AS saturation, xor(('0x'||substr(sha256(concat('u', event_id//7)),1,15))::BIGINT, (1::BIGINT << ((event_id%7)*3)) * (event_id%7>4)::BIGINT) AS fp, [event_id//7%5, 2, event_id%7//5]::DOUBLE[] AS hue, [event_id//7%2, 3, 1]::DOUBLE[] AS sat, [1, event_id//7%4, 2]::DOUBLE[] AS val FROM events)"""


@query("j01_unknown_times", f"""WITH RECURSIVE {_UNKNOWN}, p AS (SELECT a.event_id AS x, b.event_id AS y FROM e a JOIN e b ON a.event_id<b.event_id AND bit_count(xor(a.fp,b.fp))<=7 AND (a.s IS NULL OR b.s IS NULL OR abs(a.s-b.s)<=60)
 WHERE abs(a.ratio-b.ratio)/greatest(a.ratio,b.ratio)<=0.25 AND (a.saturation<15)=(b.saturation<15) AND {_corr('hue')}>=0.9 AND {_corr('sat')}>=0.8 AND {_corr('val')}>=0.8), t AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
 w(a, b) AS (SELECT event_id, event_id FROM e UNION SELECT w.a, t.y FROM w JOIN t ON t.x=w.b) SELECT a AS event_id, min(b) AS group_id FROM w GROUP BY a""")
def j01_unknown(spark, d):
    """Groups of near duplicates where a third of the rows has no time."""
    k, g = F.col("event_id"), F.floor(F.col("event_id") / 7)
    arr = lambda *xs: F.array(*(F.lit(x).cast("double") if isinstance(x, int) else x.cast("double") for x in xs))
    base = F.conv(F.substring(F.sha2(F.concat(F.lit("u"), g), 256), 1, 15), 16, 10).cast("long")
    flip = F.when(k % 7 > 4, F.expr("shiftleft(1L, cast(event_id % 7 * 3 as int))")).otherwise(F.lit(0).cast("long"))
    e = table(spark, d, "events").select("event_id", F.when(k % 3 != 0, F.col("ts")).alias("ts"), (1 + (g % 5) / 10).alias("ratio"), (g % 40).alias("saturation"), base.bitwiseXOR(flip).alias("fp"), arr(g % 5, 2, F.floor(k % 7 / 5)).alias("hue"), arr(g % 2, 3, 1).alias("sat"), arr(1, g % 4, 2).alias("value"))
    edges = duplicates.near_duplicate_edges(e, "event_id", "ts", 60).unionByName(duplicates.unknown_time_edges(e, "event_id", "ts"))
    return duplicates.groups(e.withColumn("digest", F.lit(None).cast("string")), "event_id", "digest", edges)


@query("j01_text_fingerprints")
def j01_texts(spark, d):
    """Documents whose fingerprints (of their lowered words) differ in at most three bits, in groups."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0))
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), duplicates.simhash(words).alias("fp"))
    docs = materialize(docs, "fingerprints")
    return duplicates.groups(docs, "doc_id", "digest", duplicates.band_edges(docs, "doc_id", "fp", 3, copies=True))


FP = "SELECT doc_id, xor(('0x'||substr(sha256(concat('k', doc_id//5)),1,15))::BIGINT, (1::BIGINT << ((doc_id%5)*3)) * (doc_id%5>0)::BIGINT) AS fp FROM documents"


def prints(spark, d):
    k = F.col("doc_id")
    base = F.conv(F.substring(F.sha2(F.concat(F.lit("k"), F.floor(k / 5)), 256), 1, 15), 16, 10).cast("long")
    flip = F.when(k % 5 > 0, F.expr("shiftleft(1L, cast(doc_id % 5 * 3 as int))")).otherwise(F.lit(0).cast("long"))
    return table(spark, d, "documents").select("doc_id", base.bitwiseXOR(flip).alias("fp"))


@query("j01_band_edges", f"WITH f AS ({FP}), r AS (SELECT fp, min(doc_id) AS rep FROM f GROUP BY fp) SELECT a.rep AS src, b.rep AS dst, bit_count(xor(a.fp,b.fp))::INTEGER AS distance FROM r a JOIN r b ON a.rep<b.rep AND bit_count(xor(a.fp,b.fp))<=7")
def j01_bands(spark, d):
    return duplicates.band_edges(prints(spark, d), "doc_id", "fp", 7)


@query("j03_similarity_matrix", f"WITH {V} SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.e,b.e),6) AS sim FROM v a CROSS JOIN v b")
def j03(spark, d):
    return vectors.similarity_matrix(emb(spark, d), "vec_id", "embedding", 6)


@query("j04_threshold_search", f"WITH {V} SELECT a.vec_id AS query, b.vec_id AS candidate, round(list_cosine_similarity(a.e,b.e),6) AS sim FROM v a, v b WHERE a.vec_id%20=0 AND list_cosine_similarity(a.e,b.e)>=0.35")
def j04(spark, d):
    e = emb(spark, d)
    return vectors.search(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 0.35).withColumn("sim", F.round("sim", 6))


_NEAR = f"WITH {CENTER}, s AS (SELECT vec_id, ce.label, round(list_cosine_similarity(e,c),9) AS sim FROM v, ce), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM s) WHERE r=1)"


@query("j05_nearest_centroid", _NEAR + " SELECT vec_id, CASE WHEN sim>=0.3 THEN label END AS cluster, round(sim,6) AS sim FROM b")
def j05(spark, d):
    e = emb(spark, d)
    return vectors.nearest(e, "vec_id", "embedding", vectors.centroids(e, "label", "embedding"), "label", 0.3).withColumn("sim", F.round("sim", 6))


@query("a04_centroids", f"WITH {CENTER} SELECT label, (pos-1)::INTEGER AS pos, round(c[pos],6) AS x FROM ce, range(1,65) r(pos)")
def a04(spark, d):
    return vectors.centroids(emb(spark, d), "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("a05_cluster_statistics", f"WITH {CENTER} SELECT label, count(*) AS faces, round(avg((50+vec_id%50)/100.0),6) AS confidence, round(max(list_cosine_similarity(e,c)),6) AS max_similarity, round(min(list_cosine_similarity(e,c)),6) AS min_similarity FROM v JOIN ce USING (label) GROUP BY label")
def a05(spark, d):
    t = vectors.cluster_statistics(emb(spark, d), "label", "embedding", (50 + F.col("vec_id") % 50) / 100)
    return t.select("label", "faces", *(F.round(c, 6).alias(c) for c in ("confidence", "max_similarity", "min_similarity")))


@query("g01_components", f"""WITH RECURSIVE f AS ({FP}), r AS (SELECT fp, min(doc_id) AS rep FROM f GROUP BY fp), e AS (SELECT a.rep AS s, b.rep AS t FROM r a JOIN r b ON a.rep<>b.rep AND bit_count(xor(a.fp,b.fp))<=3),
x AS (SELECT doc_id, coalesce(CASE WHEN doc_id%50=0 THEN NULL ELSE sha256(text) END, concat('null:',doc_id)) AS g FROM documents), l AS (SELECT g, min(doc_id) AS rep FROM x GROUP BY g),
w(a, b) AS (SELECT rep, rep FROM l UNION SELECT w.a, e.t FROM w JOIN e ON e.s=w.b) SELECT doc_id, min(w.b) AS group_id FROM x JOIN l USING (g) JOIN w ON w.a=l.rep GROUP BY doc_id""")
def g01(spark, d):
    edges = duplicates.band_edges(prints(spark, d), "doc_id", "fp", 3)
    return duplicates.groups(items(spark, d), "doc_id", "digest", edges)


@query("g01_grown_components", f"""WITH RECURSIVE f AS ({FP}), r AS (SELECT fp, min(doc_id) AS rep FROM f GROUP BY fp), e AS (SELECT a.rep AS s, b.rep AS t FROM r a JOIN r b ON a.rep<>b.rep AND bit_count(xor(a.fp,b.fp))<=3),
w(a, b) AS (SELECT DISTINCT s, s FROM e UNION SELECT w.a, e.t FROM w JOIN e ON e.s=w.b) SELECT a AS node, min(b) AS component FROM w GROUP BY a""")
def g01_grown(spark, d):
    """Components of the edges among two thirds of the documents, to which those of the others then come."""
    edges = materialize(duplicates.band_edges(prints(spark, d), "doc_id", "fp", 3), "edges")
    there = (F.col("src") % 3 > 0) & (F.col("dst") % 3 > 0)
    known = materialize(graph.connected_components(edges.where(there), in_one_task=graph.ONE_TASK), "components")
    return upsert(known, graph.grown_components(known, edges.where(~there), in_one_task=graph.ONE_TASK), "node")


EPS = 0.63
_EDGE = f"e2 AS (SELECT a.vec_id AS s, b.vec_id AS t FROM v a JOIN v b ON a.vec_id<>b.vec_id AND list_cosine_similarity(a.e,b.e)>={1 - EPS:.2f}-1e-12)"


@query("g02_dbscan", f"""WITH RECURSIVE {V}, {_EDGE}, c AS (SELECT v.vec_id FROM v LEFT JOIN e2 ON s=vec_id GROUP BY v.vec_id HAVING count(t)+1>=3),
w(a,b) AS (SELECT vec_id, vec_id FROM c UNION SELECT w.a, e2.t FROM w JOIN e2 ON e2.s=w.b JOIN c ON c.vec_id=e2.t), k AS (SELECT a AS vec_id, min(b) AS root FROM w GROUP BY a),
n AS (SELECT root, dense_rank() OVER (ORDER BY root)-1 AS cluster FROM (SELECT DISTINCT root FROM k)), m AS (SELECT vec_id, cluster FROM k JOIN n USING (root)), b AS (SELECT e2.s AS vec_id, min(cluster) AS near FROM e2 JOIN m ON m.vec_id=e2.t GROUP BY e2.s)
SELECT v.vec_id, coalesce(m.cluster, b.near, -1)::BIGINT AS cluster FROM v LEFT JOIN m USING (vec_id) LEFT JOIN b USING (vec_id)""")
def g02(spark, d):
    return vectors.dbscan(emb(spark, d), "vec_id", "embedding", EPS, 3)


@query("g03_average_linkage")
def g03(spark, d):
    return vectors.average_linkage(emb(spark, d), "vec_id", "embedding", EPS)


@query("g04_assign_to_frozen", f"WITH v0 AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), v AS (SELECT * FROM v0 WHERE vec_id%2=0), cm AS (SELECT label, pos, avg(e[pos]) AS m FROM v, range(1,65) r(pos) GROUP BY label, pos), cn AS (SELECT label, sqrt(sum(m*m)) AS n FROM cm GROUP BY label), ce AS (SELECT label, list(m/n ORDER BY pos) AS c FROM cm JOIN cn USING (label) GROUP BY label), s AS (SELECT vec_id, ce.label, round(list_cosine_similarity(e,c),9) AS sim FROM v0, ce WHERE vec_id%2=1) SELECT vec_id, label AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS r FROM s) WHERE r=1 AND sim>=0.15")
def g04(spark, d):
    e = emb(spark, d)
    centers = vectors.centroids(e.where("vec_id % 2 = 0"), "label", "embedding")
    return vectors.assign(e.where("vec_id % 2 = 1"), "vec_id", "embedding", centers, "label", 0.15, EPS).where("not is_new").select("vec_id", "cluster")


def assigned_halves(spark, d):
    e = emb(spark, d)
    old, new = e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")
    return old, new, vectors.assign(new, "vec_id", "embedding", vectors.centroids(old, "label", "embedding"), "label", 0.15, EPS)


@query("g04_assign_all")
def g04_all(spark, d):
    return assigned_halves(spark, d)[2]


@query("g04_moved_centroids")
def g04_moved(spark, d):
    old, new, found = assigned_halves(spark, d)
    before = vectors.cluster_sums(old.withColumn("cluster", F.col("label").cast("long")), "cluster", "embedding")
    return vectors.moved(before, vectors.cluster_sums(new.join(found, "vec_id"), "cluster", "embedding"), "cluster")


@query("g05_merge_clusters", f"WITH v AS (SELECT vec_id, CASE WHEN label IN (3,7) THEN 1 WHEN label=5 THEN 2 ELSE label END AS label, embedding::DOUBLE[] AS e FROM embeddings), cm AS (SELECT label, pos, avg(e[pos]) AS m FROM v, range(1,65) r(pos) GROUP BY label, pos), cn AS (SELECT label, sqrt(sum(m*m)) AS n FROM cm GROUP BY label), k AS (SELECT label, count(*) AS faces FROM v GROUP BY label) SELECT label, faces, (pos-1)::INTEGER AS pos, round(m/n,6) AS x FROM cm JOIN cn USING (label) JOIN k USING (label)")
def g05(spark, d):
    from darkslide.operators.identity import merge_clusters

    merges = spark.createDataFrame([(1, 3), (3, 7), (2, 5)], "keep long, gone long")  # a chain is closed
    moved = merge_clusters(emb(spark, d), "label", merges)
    sizes = moved.groupBy("label").agg(F.count("*").alias("faces"))
    return vectors.centroids(moved, "label", "embedding").join(sizes, "label").select("label", "faces", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("g06_split_cluster", "WITH m AS (SELECT vec_id, CASE WHEN label=2 AND vec_id%3=0 THEN (SELECT max(label) FROM embeddings)+1 ELSE label END AS label FROM embeddings) SELECT label::BIGINT AS label, count(*) AS faces, round(avg((50+vec_id%50)/100.0),6) AS confidence FROM m GROUP BY label")
def g06(spark, d):
    from darkslide.operators.identity import split_cluster

    e = emb(spark, d).select("vec_id", F.col("label").cast("long").alias("label"))
    moved = split_cluster(e, "label", (F.col("label") == 2) & (F.col("vec_id") % 3 == 0))
    return moved.groupBy("label").agg(F.count("*").alias("faces"), F.round(F.avg((50 + F.col("vec_id") % 50) / 100), 6).alias("confidence"))


@query("g06_split_centroids", "WITH v AS (SELECT vec_id, CASE WHEN label=2 AND vec_id%3=0 THEN (SELECT max(label) FROM embeddings)+1 ELSE label END AS label, embedding::DOUBLE[] AS e FROM embeddings), cm AS (SELECT label, pos, avg(e[pos]) AS m FROM v, range(1,65) r(pos) WHERE label=2 OR label>(SELECT max(label) FROM embeddings) GROUP BY label, pos), cn AS (SELECT label, sqrt(sum(m*m)) AS n FROM cm GROUP BY label) SELECT label::BIGINT AS label, (pos-1)::INTEGER AS pos, round(m/n,6) AS x FROM cm JOIN cn USING (label)")
def g06_centroids(spark, d):
    """The centroids of both halves of a split cluster, built again."""
    from darkslide.operators.identity import split_cluster

    e = emb(spark, d).select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    top = e.agg(F.max("label")).first()[0]  # one number
    moved = split_cluster(e, "label", (F.col("label") == 2) & (F.col("vec_id") % 3 == 0))
    halves = moved.where((F.col("label") == 2) | (F.col("label") > (top if top is not None else 0)))
    return vectors.centroids(halves, "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("j08_matching_scores", f"WITH {CENTER} SELECT vec_id, label, round(list_cosine_similarity(e,c),6) AS score FROM v JOIN ce USING (label)")
def j08_scores(spark, d):
    from darkslide.operators.identity import matching_scores

    e = emb(spark, d)
    return matching_scores(e, "vec_id", "label", "embedding", vectors.centroids(e, "label", "embedding")).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("s10_packed_vectors", "SELECT vec_id, true AS same, 64 AS size FROM embeddings")
def s10(spark, d):
    back = vectors.unpack_vectors(vectors.pack_vectors(emb(spark, d), "embedding"), "packed")
    return back.select("vec_id", (F.col("vec") == F.col("embedding")).alias("same"), F.size("vec").alias("size"))
