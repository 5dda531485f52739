"""Structured Streaming over files: state by key, event-time windows, change notices. Each job drains what is there and
gives its result as a table in the shared folder; started without ``availableNow`` the same plans run on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder


def read_files(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, ``files`` at most a batch; a single file is read through its folder."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).isFile()
    r = spark.readStream.schema(schema)
    if files:
        r = r.option("maxFilesPerTrigger", files)
    return r.option("pathGlobFilter", name).parquet(folder) if single else r.parquet(path)


def _drain(df: DataFrame, mode: str, merge) -> DataFrame:
    """Run to the end; ``merge(batch, number, folder)`` writes each batch."""
    spark = df.sparkSession
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(lambda b, n: merge(b, n, home)).start()
    q.awaitTermination()
    out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{home}/out")
    if not out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(out):  # nothing came
        merge(spark.createDataFrame([], df.schema), 0, home)
    return spark.read.parquet(f"{home}/out")


def _append(b: DataFrame, n: int, home: str) -> None:
    """One folder a batch, so that a batch that is run again replaces itself."""
    b.write.mode("overwrite").parquet(f"{home}/out/batch={n}")


def scene_states(spark: SparkSession, path: str) -> DataFrame:
    """The last outermost event of every scene, kept up to date; the newest notice of a scene counts."""
    e = read_files(spark, path).filter("scene_id is not null and (depth is null or depth = 0)")
    last = e.groupBy("project_id", "scene_id").agg(F.max_by("event", "event_no").alias("state"), F.max("event_no").alias("at"))
    out = _drain(last, "update", _append)
    return out.groupBy("project_id", "scene_id").agg(F.max_by("state", F.struct("at", "batch")).alias("state"), F.max("at").alias("at"))


def hourly_counts(spark: SparkSession, path: str, late: str = "1 hour", slide: str | None = None, files: int | None = None) -> DataFrame:
    """Events by type and hour of event time (with ``slide``, an hour from every such step on); events later than ``late`` behind the
    newest are dropped once their hour is closed. The newest notice of an hour counts."""
    e = read_files(spark, path, files).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    n = e.groupBy("event_type", F.window("at", "1 hour", slide) if slide else F.window("at", "1 hour")).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("hour"), "n")
    out = _drain(n, "update", _append)
    return out.groupBy("event_type", "hour").agg(F.max_by("n", "batch").alias("n")).select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "n")


def changed_keys(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Notices of changed keys, one a key and batch with the number of changes, added up."""
    e = read_files(spark, path).select(key)
    out = _drain(e, "append", lambda b, n, home: _append(b.groupBy(key).agg(F.count("*").alias("changes")), n, home))
    return out.groupBy(key).agg(F.sum("changes").alias("changes"))


def coalesced_changes(spark: SparkSession, path: str, key: str, ts: str, quiet: str, files: int | None = None) -> DataFrame:
    """``key, began, changes``: changes of a key as one notice as long as the next comes within ``quiet``. A batch's changes are made
    into runs before anything is written; runs that meet over batches are joined when read."""
    e = read_files(spark, path, files).select(key, F.col(ts).cast("timestamp").alias("at"))
    runs = lambda b: b.filter("at is not null").groupBy(key, F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("a"), F.col("w.end").alias("z"), "n")
    out = _drain(e, "append", lambda b, n, home: _append(runs(b), n, home))
    w = W.partitionBy(key).orderBy("a", "z")
    new = (F.col("a") >= F.coalesce(F.max("z").over(w.rowsBetween(W.unboundedPreceding, -1)), F.col("a"))).cast("int")
    run = out.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(key, "run").agg(F.min("a").alias("began"), F.sum("n").alias("changes")).select(key, "began", "changes")


def stale_entries(spark: SparkSession, path: str, key: str, ts: str, cached: DataFrame) -> DataFrame:
    """Which of the cached keys (``key, cached_at``) changed after they were cached: the newest change of every key is kept up to date."""
    e = read_files(spark, path).groupBy(key).agg(F.max(ts).alias("changed_at"))
    last = _drain(e, "update", _append).groupBy(key).agg(F.max("changed_at").alias("changed_at"))
    return cached.join(last, key, "left").select(key, F.coalesce(F.col("changed_at") > F.col("cached_at"), F.lit(False)).alias("stale"))
