"""Views of the driver's tables that stand in for a photo catalog.

Each is one SELECT that Spark SQL and DuckDB read alike. `face_rows` and `photo_rows` give them as
DataFrames, `photos` nests the faces of a photo in an array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACE_SQL = """SELECT l_orderkey * 100 + face_pos AS face_id, l_orderkey AS photo_id, face_pos,
       l_suppkey AS cluster_id,
       CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey END AS person_id,
       CASE WHEN l_orderkey % 4 < 2 THEN (l_orderkey * 37) % 500 + l_linenumber * 40
            ELSE (l_partkey * 37) % 900 END AS x,
       CASE WHEN l_orderkey % 2 = 0 THEN (l_orderkey * 53) % 440 + l_linenumber * 3
            ELSE (l_suppkey * 53) % 560 END AS y,
       40 + CAST(l_quantity AS BIGINT) AS w, 40 + CAST(l_quantity AS BIGINT) AS h,
       50 + (l_partkey * 7 + l_linenumber * 13) % 51 AS sharpness,
       CASE WHEN l_orderkey % 3 = 0 THEN 65 + (l_suppkey * 11) % 36
            ELSE (l_suppkey * 11 + l_linenumber * 17) % 101 END AS camera_facing,
       40 + (l_partkey * 3 + l_suppkey) % 61 AS eye_openness,
       (l_partkey + l_suppkey * 3) % 101 AS smile,
       40 + (l_partkey * 5) % 61 AS face_exposure,
       20 + (l_partkey * 5 + l_suppkey) % 81 AS lighting,
       l_partkey % 61 - 30 AS yaw, l_suppkey % 41 - 20 AS pitch, l_linenumber * 5 - 20 AS roll,
       CASE WHEN l_linenumber = 7 THEN 100 ELSE 0 END AS occlusion,
       (l_partkey + l_linenumber) % 23 = 0 AS is_blink,
       50 + l_partkey % 50 AS confidence_pct
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
             l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS face_pos FROM {lineitem}) t"""

PHOTO_SQL = """SELECT o_orderkey AS photo_id, o_custkey AS group_id, o_orderdate AS captured_at,
       1024 AS img_w, 683 AS img_h, 100 + (o_orderkey * 31) % 9000 AS size_kb,
       concat('img_', CASE o_orderkey % 41 WHEN 1 THEN 'award' WHEN 2 THEN 'handshake' WHEN 3 THEN 'network'
              WHEN 4 THEN 'vip' WHEN 5 THEN 'sponsor' WHEN 6 THEN 'audience' WHEN 7 THEN 'keynote'
              WHEN 8 THEN 'panel' ELSE 'plain' END, '_', CAST(o_orderkey AS VARCHAR(20)), '.jpg') AS filename,
       50 + (o_orderkey * 3) % 51 AS sharpness, 40 + (o_orderkey * 7) % 61 AS brightness,
       50 + (o_orderkey * 11) % 51 AS contrast, 60 + (o_orderkey * 13) % 41 AS composition,
       40 + (o_orderkey * 17) % 61 AS motion_blur,
       o_orderkey % 11 = 0 AS has_motion_blur, o_orderkey % 7 = 0 AS is_blurry,
       (o_orderkey * 19) % 101 AS stage_presence, (o_orderkey * 23 + 7) % 101 AS audience_presence,
       (o_orderkey * 29 + 3) % 101 AS branding_presence
FROM {orders}"""

FACE_FIELDS = ["face_pos", "face_id", "cluster_id", "person_id", "x", "y", "w", "h", "sharpness", "camera_facing", "eye_openness", "smile", "face_exposure", "lighting", "yaw", "pitch", "roll", "occlusion", "is_blink", "confidence_pct"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def face_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FACE_SQL, lineitem=table(spark, sf_dir, "lineitem"))


def photo_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PHOTO_SQL, orders=table(spark, sf_dir, "orders"))


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_rows with `faces`, an array of face structs in order of face_pos; empty without faces."""
    faces = face_rows(spark, sf_dir).groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct(*FACE_FIELDS))).alias("faces"))
    rows = photo_rows(spark, sf_dir).join(faces, "photo_id", "left")
    kind = faces.schema["faces"].dataType.simpleString()
    return rows.withColumn("faces", F.coalesce("faces", F.array().cast(kind)))


def sql_views(*names: str) -> str:
    """A WITH clause of the views for DuckDB, where the tables are views of their own name."""
    views = {"v_face": FACE_SQL.replace("{lineitem}", "lineitem"), "v_photo": PHOTO_SQL.replace("{orders}", "orders")}
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in names)
