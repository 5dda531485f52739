"""Scans and sinks for the files such pipelines leave: feed pages, event lines, manifests, checkpoints, media folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "id string, title string, originalTitle string, summary string, category string, source struct<name:string>, links struct<aihot:string,original:string>, publishedAt string, discoveredAt string, score double, selected boolean, reason string"
PAGE = f"schemaVersion int, items array<struct<{ITEM.replace(' string', ':string').replace(' struct', ':struct').replace(' double', ':double').replace(' boolean', ':boolean')}>>, page struct<count:int,hasMore:boolean,nextCursor:string>"
EVENT = "event_no long, project_id string, ts string, tool string, event string, scene_id string, depth int, cost_usd double, duration_s double, success boolean, error string"


def feed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Items of saved feed pages, one JSON document a file, with the file and the place on its page. Strict: a page that isn't
    JSON fails the read."""
    pages = spark.read.schema(PAGE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return pages.select(F.col("_metadata.file_name").alias("file"), "page", F.posexplode("items").alias("pos", "item")).select("file", "pos", "page", "item.*")


def items_of_pages(pages: DataFrame, body: str) -> DataFrame:
    """Items of pages held as JSON strings; unreadable pages give none."""
    return pages.withColumn("_p", F.from_json(body, PAGE)).select(*[c for c in pages.columns if c != body], F.posexplode("_p.items").alias("pos", "item")).select("*", "item.*").drop("item")


def page_chain(pages: DataFrame) -> DataFrame:
    """``file, fault``: pages that say there is more without a cursor, and cursors that repeat."""
    lost = pages.filter("page.hasMore and page.nextCursor is null").select("file", F.lit("no_cursor").alias("fault"))
    again = pages.filter("page.nextCursor is not null").select("file", F.col("page.nextCursor").alias("c")).distinct().groupBy("c").agg(F.count("*").alias("n"), F.max("file").alias("file")).filter("n > 1").select("file", F.lit("repeated_cursor").alias("fault"))
    return lost.unionByName(again).distinct()


def json_lines(spark: SparkSession, path: str, schema: str, keep_bad: bool = False) -> DataFrame:
    """Lines of JSON; unreadable lines are skipped, or kept alone in ``_corrupt_record``."""
    df = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df if keep_bad else df.filter("_corrupt_record is null").drop("_corrupt_record")


def lines_of(df: DataFrame, body: str, schema: str) -> DataFrame:
    """The same for lines held in a column: only those that are JSON objects."""
    p = df.withColumn("_e", F.from_json(body, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return p.filter("_e is not null and _e._bad is null").select("_e.*").drop("_bad")


def append_lines(df: DataFrame, path: str) -> None:
    """Append as JSON lines; null fields are left out."""
    df.write.mode("append").json(path)


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows; 0 means all."""
    return df if n == 0 else df.orderBy(F.col(order).desc()).limit(n)


def checkpoint_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Checkpoint documents, their stage taken from the file name (``checkpoint_<stage>.json`` or ``checkpoint_<stage>_<n>.json``)."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return df.withColumn("stage_of_file", F.regexp_extract(F.col("_metadata.file_name"), r"checkpoint_(.+?)(?:_\d+)?\.json$", 1))


KINDS = {"video": ("mp4", "mov", "webm", "mkv"), "audio": ("mp3", "wav", "m4a", "flac"), "image": ("png", "jpg", "jpeg", "webp", "gif"), "text": ("json", "srt", "vtt", "md", "txt")}


def kind_of(name: Column) -> Column:
    """A file's kind by its extension."""
    ext, out = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)), None
    for kind, exts in KINDS.items():
        out = F.when(ext.isin(*exts), kind) if out is None else out.when(ext.isin(*exts), kind)
    return out.otherwise("other")


def media_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder with size, time and kind; contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", "length", "modificationTime", kind_of(F.col("path")).alias("kind"))


def canonical_json(**fields: Column) -> Column:
    """JSON with sorted keys, nulls written, nothing between."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def content_hash(**fields: Column) -> Column:
    return F.sha2(canonical_json(**fields), 256)


def idempotency_key(**fields: Column) -> Column:
    """The first 16 hex digits of the content's hash."""
    return F.left(content_hash(**fields), F.lit(16))


def write_table(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet") -> None:
    w = df.write.mode("overwrite").format(kind)
    (w.partitionBy(*by) if by else w).save(path)
