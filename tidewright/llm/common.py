"""What the operators of this subpackage share: checkpoints in the shared folder, Arrow functions, slices of batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Code points that one pass over arrays may hold, so that a worker's memory doesn't grow with the batch.
SLICE_CHARS = 400_000
#: Rows that may be sent to every task: some 30 MB of keys.
SENT = 300_000


def _set_folder(spark: SparkSession) -> None:
    """Take ``spark.checkpoint.dir``; a folder of our own only where that is unset and all tasks run on this machine."""
    if spark.sparkContext.getCheckpointDir():
        return
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(there or tempfile.mkdtemp(prefix="checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``."""
    _set_folder(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is computed meanwhile go when it is done, not with some later garbage collection of the driver."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def folder(spark: SparkSession) -> str:
    """The URI of ``spark.checkpoint.dir``, for files that tasks share."""
    _set_folder(spark)
    uri = spark.sparkContext.getCheckpointDir()
    return uri if "://" in uri else "file://" + uri.removeprefix("file:")


def sent(df: DataFrame) -> DataFrame:
    """A written table of a few keys or numbers a row, to be sent to every task if its count is at most ``SENT``; larger ones are
    shuffled as usual."""
    return F.broadcast(df) if df.count() <= SENT else df


class Tables:
    """Tables written to the shared folder for one computation, and removed when it is over."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path = spark, f"{folder(spark)}/tables-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, partition: str | None = None) -> DataFrame:
        """The rows of ``df``, from now on read from the folder."""
        self.last = there = f"{self.path}/{uuid.uuid4().hex}"
        w = df.write.option("compression", "zstd")
        (w.partitionBy(partition) if partition else w).parquet(there)
        return self.spark.read.schema(df.schema).parquet(there)

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``limit`` code points in all (a longer text has a range of its own)."""
    a = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)


@arrow_udf(T.StringType())
def look_udf(x: pa.Array) -> pa.Array:
    from . import codes

    return pa.array(codes.looks(x.to_pylist()), pa.string())


@arrow_udf(T.StringType())
def name_key_udf(x: pa.Array) -> pa.Array:
    from . import codes

    return pa.array([None if s is None else "".join(s.split()).lower() or None for s in codes.looks(x.to_pylist())], pa.string())


@arrow_udf(T.StringType())
def category_key_udf(x: pa.Array) -> pa.Array:
    from . import look

    d = x.dictionary_encode()
    keys = pa.array([look.category_key(s) for s in d.dictionary.to_pylist()] + ["other"], pa.string())
    return keys.take(d.indices.fill_null(len(keys) - 1))


def instant(text: Column) -> Column:
    """Microseconds of a written instant; without a zone it means UTC. Null if missing or unreadable."""
    t = F.trim(text)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
    zoned = F.when(t.rlike(r"(Z|[T ].*[+-]\d{2}:?\d{2})$"), t).when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(shape), F.unix_micros(F.try_to_timestamp(zoned)))


def number_or_null(x: Column) -> Column:
    """A score with not-a-number as null."""
    return F.when(~F.isnan(x), x)


def packed(kind: type, x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()
