"""Session settings and the shared folder where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "darkslide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on. Cluster settings (executors, shuffle partitions,
    spark.checkpoint.dir) are left to spark-submit unless given here."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only in local mode, where all of Spark is one process, a temporary folder is made and set if that is unset; elsewhere it
    is an error, since executors would write to folders that nobody else sees."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="darkslide-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts lineage: a lost
    executor costs a re-read, never a recomputation of what stands above."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() returned, once all that is read from them has been written."""
    for t in tables:
        drop_path(t.sparkSession, t.table_path)


def unused_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are done: it does so once the driver's garbage is collected, which by
    itself may be long after. For between the stages of a long job."""
    spark.sparkContext._jvm.System.gc()


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, through Hadoop's file system; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table written by this module, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
