"""Structured Streaming jobs. `drain` runs one over what its source holds and returns what it wrote."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from darkslide.operators import vectors
from darkslide.operators.timeline import seconds
from darkslide.plans.session import child_names, drop_path, new_path


def source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a table (a folder or one file), with the schema of the table as it is.

    All files that are there make the first batch, unless files_per_trigger is given: files are taken in order of their modification, and
    where that isn't the order of event time, rows of later batches would come behind the watermark and be dropped."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern: a plain path to one file isn't taken by the file source
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


class DroppedRows(StreamingQueryListener):
    """Counts the rows that come behind the watermark in every batch of a query; a query itself remembers its last batches only."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.changed = threading.Condition()
        self.over: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.changed:
            self.rows[str(p.runId)] = self.rows.get(str(p.runId), 0) + sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.over.add(str(event.runId))
            self.changed.notify_all()

    def of(self, run: str, patience: float = 600) -> int:
        """Rows of a run that has ended, once its last event is here."""
        with self.changed:
            if not self.changed.wait_for(lambda: str(run) in self.over, patience):
                raise TimeoutError(f"no end of the query {run} was reported")
            return self.rows.get(str(run), 0)


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, put: Callable[[DataFrame, int], None] | None = None, target: str | None = None) -> DataFrame | None:
    """Run a stream to the end of its source. Without `put` every batch is written as its own folder of
    `target`; a batch that is run again after a failure overwrites its own folder, so nothing is doubled. Rows that come
    behind the watermark are an error here, never dropped without a word."""
    spark = stream.sparkSession
    target = target or new_path(spark, "stream")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    dropped = DroppedRows()
    spark.streams.addListener(dropped)
    try:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or new_path(spark, "checkpoint")).trigger(availableNow=True).foreachBatch(put or write).start()
        q.awaitTermination()
        late = dropped.of(q.runId)
    finally:
        spark.streams.removeListener(dropped)
    if late:
        raise ValueError(f"{late} rows came behind the watermark; read the files in one batch or in order of time")
    if put:
        return None
    if not child_names(spark, target):  # no batch was written
        return spark.createDataFrame([], stream.schema).withColumn("epoch", F.lit(0))
    return spark.read.option("basePath", target).parquet(target)


def timed(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream with ts as a timestamp and a watermark of `delay`."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


#: Batches between two compactions of a kept table.
COMPACT_EVERY = 16


def ingest(stream: DataFrame, key: str, order: str, target: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> None:
    """Keep a table of the row of greatest `order` of each key. A batch adds its own rows alone (log/epoch=N); now and then
    they are put together with those before (base/upto=N), after which older ones are dropped. So a batch costs what it brings, and a
    repeated batch writes the same again."""
    spark = stream.sparkSession
    spark.range(1).select(F.lit(key).alias("key"), F.lit(order).alias("order")).write.mode("overwrite").parquet(f"{target}/about")

    def put(batch: DataFrame, epoch: int) -> None:
        _last(batch, key, order).write.mode("overwrite").parquet(f"{target}/log/epoch={epoch}")
        if epoch % compact_every == compact_every - 1:
            _kept(spark, target, batch.schema).write.mode("overwrite").parquet(f"{target}/base/upto={epoch}")
            for e in _numbers(spark, f"{target}/log"):
                if e <= epoch:
                    drop_path(spark, f"{target}/log/epoch={e}")
            for e in _numbers(spark, f"{target}/base"):
                if e < epoch:
                    drop_path(spark, f"{target}/base/upto={e}")

    drain(stream, "append", checkpoint, put)


def _last(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished tables of a folder."""
    names = [n for n in child_names(spark, folder) if "=" in n]
    return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in child_names(spark, f"{folder}/{n}"))


def _kept(spark: SparkSession, target: str, schema: T.StructType | None) -> DataFrame:
    base = _numbers(spark, f"{target}/base")[-1:]
    logs = [e for e in _numbers(spark, f"{target}/log") if not base or e > base[0]]
    paths = [f"{target}/base/upto={e}" for e in base] + [f"{target}/log/epoch={e}" for e in logs]
    if not paths:
        return spark.createDataFrame([], schema)
    about = spark.read.parquet(f"{target}/about").first()  # one row
    reader = spark.read.schema(schema) if schema else spark.read
    return _last(reader.parquet(*paths), about["key"], about["order"])


def latest_version(spark: SparkSession, target: str, schema: T.StructType | None) -> DataFrame:
    """The table that ingest keeps; schema is that of an empty table, where no batch has come yet."""
    return _kept(spark, target, schema)


def distinct_digests(stream: DataFrame, ts: str, digest: str, delay: str = "1 day") -> DataFrame:
    """Rows with a digest not seen within the watermark."""
    return timed(stream, ts, delay).dropDuplicatesWithinWatermark([digest])


def sessions(stream: DataFrame, by: str, ts: str, gap: str = "900 seconds", delay: str = "1 hour") -> DataFrame:
    """by, started, ended (last event), n of each run of events with no longer gap between them. In append mode a session is
    given out, and its state dropped, once the watermark has passed its end."""
    s = timed(stream, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
    return s.select(by, "started", "ended", "n")


#: Time and folder of the row that ends a stream.
END_OF_TIME = "2200-01-01 00:00:00"


def ended(stream: DataFrame, ts: str) -> DataFrame:
    """A stream that is over with its source, with one more row (all null but a time after all others), so that the watermark passes
    every session that is still open. Leave that row's own session out of the result."""
    spark, path = stream.sparkSession, new_path(stream.sparkSession, "end-of-stream")
    kinds = {f.name: f.dataType for f in stream.schema}
    row = spark.range(1).select(*(F.lit(END_OF_TIME if n == ts else None).cast(k).alias(n) for n, k in kinds.items()))
    row.coalesce(1).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def counters(stream: DataFrame, metric: str, delta) -> DataFrame:
    """Running totals; in update mode a batch gives the changed ones."""
    return stream.groupBy(F.col(metric).alias("metric")).agg(F.sum(delta).alias("total"))


def last_totals(updates: DataFrame, key: str) -> DataFrame:
    """The final state of a stream in update mode."""
    cols = [c for c in updates.columns if c not in (key, "epoch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*cols), "epoch").alias("r")).select(key, "r.*")


def burst_pairs(a: DataFrame, b: DataFrame, key: str, by: str, ts: str, gap: int = 60, delay: str = "2 minutes") -> DataFrame:
    """src, dst of events of the same `by` at most `gap` seconds apart, the earlier first: a join of the stream with itself."""
    left = timed(a.select(F.col(key).alias("src"), F.col(by).alias("a_by"), F.col(ts).alias("a_ts")), "a_ts", delay)
    right = timed(b.select(F.col(key).alias("dst"), F.col(by).alias("b_by"), F.col(ts).alias("b_ts")), "b_ts", delay)
    on = (F.col("a_by") == F.col("b_by")) & (F.col("b_ts") >= F.col("a_ts")) & (F.col("b_ts") <= F.col("a_ts") + F.make_interval(secs=F.lit(gap))) & (F.col("src") != F.col("dst"))
    joined = left.join(right, on)
    return joined.where((seconds("b_ts") > seconds("a_ts")) | (F.col("dst") > F.col("src"))).select("src", "dst")


def online_clusters(stream: DataFrame, key: str, vec: str, centers: DataFrame, group: str, target: str, least: float, eps: float, checkpoint: str | None = None) -> None:
    """Assign each batch against the centroids of the version before; new clusters join the next version. Versions
    hold sums and counts, so a centroid moves by the running mean.

    A batch reads the version before it and writes its own, so one that is run again after a failure gives the same; versions before these two are
    dropped. Started again on its checkpoint and target, the job goes on with the version of its last batch. Centroids are a table and not state
    by key, since every row has to see all of them and what it joins feeds back into them."""
    spark = stream.sparkSession
    if not checkpoint or not _numbers(spark, f"{target}/centers"):
        start = centers.select(F.col(group).cast("long").alias("cluster"), F.col("centroid").alias("sums"), F.lit(1).cast("long").alias("faces"))
        start.write.mode("overwrite").parquet(f"{target}/centers/version=-1")

    def put(batch: DataFrame, epoch: int) -> None:
        old = spark.read.parquet(f"{target}/centers/version={epoch - 1}")
        named = vectors.assign(batch, key, vec, old.select("cluster", F.col("sums").alias("centroid")), "cluster", least, eps)
        named.write.mode("overwrite").parquet(f"{target}/assigned/epoch={epoch}")
        done = spark.read.parquet(f"{target}/assigned/epoch={epoch}")
        added = vectors.cluster_sums(batch.join(done.select(key, "cluster"), key), "cluster", vec)
        vectors.moved(old, added, "cluster").select("cluster", "sums", "faces").write.mode("overwrite").parquet(f"{target}/centers/version={epoch}")
        for e in _numbers(spark, f"{target}/centers"):
            if e < epoch - 1:
                drop_path(spark, f"{target}/centers/version={e}")

    drain(stream.select(key, vec), "append", checkpoint, put)
