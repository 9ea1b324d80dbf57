"""Listing, freshness, sidecars, tags and logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.measures import ALLOWED, RAW, is_allowed
from darkslide.plans.session import unused_name

# Colour classes of sidecars.
COLOR_CLASS = {"red": "1", "orange": "2", "yellow": "3", "green": "4", "blue": "5", "purple": "6", "grey": "7", "gray": "7", "": "0"}
COLOR_OF_CLASS = {"1": "Red", "2": "Orange", "3": "Yellow", "4": "Green", "5": "Blue", "6": "Purple", "7": "Grey", "0": ""}
SCORING_VERSION = 4


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, size of the picture files below a folder; contents are never read. Spark's listing passes over files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return listed(files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size")), "path")


def listed(files: DataFrame, path: str) -> DataFrame:
    """The rows of a listing with an allowed kind."""
    return files.where(is_allowed(F.col(path), ALLOWED + RAW))


def scan_profile(files: DataFrame, path: str, allowed: Column) -> DataFrame:
    """folder, total, supported, unsupported, has_pictures: counts for each folder. Names stay in the listing."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    ok = F.coalesce(allowed, F.lit(False))
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("total"), F.count_if(ok).alias("supported"), F.count_if(~ok).alias("unsupported"), F.bool_or(ok).alias("has_pictures"))


def freshness(listing: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """key, state: done where times of file and sidecar (null-safe) and the scoring version are as cached, else todo."""
    c = catalog.select(key, F.col("mtime").alias("_m"), F.col("xmp_mtime").alias("_x"), F.col("version").alias("_v"))
    j = listing.join(c, key, "left")
    fresh = F.col("mtime").eqNullSafe(F.col("_m")) & F.col("xmp_mtime").eqNullSafe(F.col("_x")) & (F.col("_v") >= SCORING_VERSION)
    return j.select(key, F.when(F.coalesce(fresh, F.lit(False)), "done").otherwise("todo").alias("state"))


def cached(listing: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Catalog rows whose two times match the listing's (hits)."""
    probe = listing.select(F.col(key).alias("_k"), F.col("mtime").alias("_m"), F.col("xmp_mtime").alias("_x"))
    same = (catalog[key] == probe["_k"]) & catalog["mtime"].eqNullSafe(probe["_m"]) & catalog["xmp_mtime"].eqNullSafe(probe["_x"])
    return catalog.join(probe, same, "left_semi")


def sidecar_paths(images: DataFrame, files: DataFrame, name: str, file: str = "file") -> DataFrame:
    """images with sidecar: <stem>.xmp if there, else <file>.xmp if there, else <stem>.xmp as the place to write."""
    stem = F.concat(F.regexp_replace(name, r"\.[^./]*$", ""), F.lit(".xmp"))
    there = files.select(F.col(file).alias("_f")).distinct()
    own = images.withColumn("_stem", stem).withColumn("_app", F.concat(F.col(name), F.lit(".xmp")))
    a = there.select(F.col("_f").alias("_stem"), F.lit(True).alias("_has_stem"))
    b = there.select(F.col("_f").alias("_app"), F.lit(True).alias("_has_app"))
    j = own.join(a, "_stem", "left").join(b, "_app", "left")
    use_app = F.col("_has_app").isNotNull() & F.col("_has_stem").isNull()
    return j.withColumn("sidecar", F.when(use_app, F.col("_app")).otherwise(F.col("_stem"))).drop("_stem", "_app", "_has_stem", "_has_app")


# What is read from a sidecar's description, each an attribute or an element.
SIDECAR_FIELDS = ("Rating", "Label", "colorclass", "pick", "good")


def read_sidecars(df: DataFrame, xml: str) -> DataFrame:
    """df with sidecar struct: rating, label, rejected, keywords. Attributes or elements, any prefix; without a
    label the colour class names one; missing or broken sidecars give the defaults. A text is parsed once, by a parser that takes
    broken XML for a row without values. The description is looked for in the root, below it and below an RDF element in it."""
    fields = ", ".join(f"_{n} string, {n} string" for n in SIDECAR_FIELDS)
    words = "subject array<struct<Bag: struct<li: array<string>>, Seq: struct<li: array<string>>, li: array<string>>>"
    one = f"{fields}, {words}"
    nested = re.sub(r"(\w+) (string|array)", r"\1: \2", one)
    schema = f"{one}, Description array<struct<{nested}>>, RDF array<struct<Description: array<struct<{nested}>>>>, broken string"
    parsed = unused_name(df, "parsed")
    options = {"ignoreNamespace": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "attributePrefix": "_"}
    read = df.withColumn(parsed, F.from_xml(F.when(F.regexp_like(xml, F.lit(r"^\s*<")), F.col(xml)), schema, options))
    whole = lambda c: F.when(F.col(parsed)["broken"].isNull(), c)
    get = lambda n: F.col(parsed)[n]
    own = F.struct(*(get(c).alias(c) for n in SIDECAR_FIELDS for c in (f"_{n}", n)), get("subject").alias("subject"))
    below = F.flatten(F.transform(get("RDF"), lambda r: F.coalesce(r["Description"], F.array().cast(f"array<struct<{nested}>>"))))
    every = lambda c: F.coalesce(c, F.array().cast(f"array<struct<{nested}>>"))
    descriptions = F.concat(F.array(own), every(get("Description")), every(below))
    found = unused_name(read, "found")
    read = read.withColumn(found, whole(descriptions))
    first = lambda c: F.nullif(F.get(F.filter(F.transform(found, lambda d: d[c]), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))
    pick = lambda n: F.coalesce(first(f"_{n}"), first(n))
    classes = F.create_map(*(F.lit(x) for kv in COLOR_OF_CLASS.items() for x in kv))
    listed = lambda s: F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in (s["li"], s["Bag"]["li"], s["Seq"]["li"])))
    keywords = F.flatten(F.transform(F.flatten(F.filter(F.transform(found, lambda d: d["subject"]), lambda s: s.isNotNull())), listed))
    return read.withColumn(
        "sidecar",
        F.struct(
            F.coalesce(pick("Rating").try_cast("int"), F.lit(0)).alias("rating"),
            F.coalesce(pick("Label"), F.nullif(F.element_at(classes, pick("colorclass")), F.lit("")), F.lit("")).alias("label"),
            F.coalesce((pick("pick") == "-1") | (pick("good") == "false"), pick("pick") == "-1", pick("good") == "false", F.lit(False)).alias("rejected"),
            F.coalesce(keywords, F.array().cast("array<string>")).alias("keywords"),
        ),
    ).drop(parsed, found)


def pictures_with_sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, size, sidecar_path, has_sidecar, sidecar of the picture files below a folder: one listing, of which the contents of
    sidecar files alone are read. A sidecar is <stem>.xmp, else <file>.xmp, beside its picture."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    there = files.select(F.col("path").alias("file"))
    pictures = sidecar_paths(list_files(spark, folder), there, "path").withColumnRenamed("sidecar", "sidecar_path")
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xmp").load(folder)
    texts = written.select(F.col("path").alias("sidecar_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("_xml"))
    both = pictures.join(texts, "sidecar_path", "left").withColumn("has_sidecar", F.col("_xml").isNotNull())
    return read_sidecars(both, "_xml").select("path", "modified", "size", "sidecar_path", "has_sidecar", "sidecar")


def normalized_tags(df: DataFrame) -> DataFrame:
    """Camera tags (columns by tag name) to camera, lens, iso, aperture, taken; the first tag that is set counts."""
    parts = F.split("f_number", "/")
    ratio = F.when(F.size(parts) == 2, F.try_divide(parts[0].try_cast("double"), parts[1].try_cast("double"))).otherwise(F.col("f_number").try_cast("double"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return df.withColumns(
        {
            "camera": F.coalesce(blank("model"), F.lit("Unknown")),
            "lens": F.coalesce(blank("lens_model"), blank("lens_info"), blank("lens_id"), F.lit("Unknown")),
            "iso": F.col("iso_text").try_cast("int"),
            "aperture": F.floor(ratio * 10 + 0.5) / 10,
            "taken": F.coalesce(*(F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss")) for c in ("date_original", "date_digitized", "date_time"))),
        }
    )


def capture_time(raw: Column, exif: Column, name: Column) -> Column:
    """Raw tag, then the camera's, then YYYYMMDD_HHMMSS in the file name; unknown is null, never the file's time."""
    fmt = F.lit("yyyy:MM:dd HH:mm:ss")
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    pattern = F.lit(r"(^|_)(\d{8})_(\d{6})(_|$)")
    digits = F.concat(F.regexp_extract(stem, r"(^|_)(\d{8})_(\d{6})(_|$)", 2), F.regexp_extract(stem, r"(^|_)(\d{8})_(\d{6})(_|$)", 3))
    named = F.when(F.regexp_like(stem, pattern), F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss")))
    return F.coalesce(F.try_to_timestamp(raw, fmt), F.try_to_timestamp(exif, fmt), named)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry of JSON lines: level, event, run_context, payload (maps of strings); broken lines are left out."""
    schema = "level string, event string, run_context map<string,string>, payload map<string,string>, _broken string"
    log = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_broken").json(path)
    return log.where("event is not null").drop("_broken")


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by `order`, by partial aggregation."""
    last = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r"))
    return last.select(*(F.col("r")[c].alias(c) for c in df.columns))
