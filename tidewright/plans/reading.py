"""Source and sink queries (survey S1-S18) over the tables' own content as the documents it came from."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, table
from ..session import shared_folder
from ..sources import documents as S


@query("s01_feed_pages", "SELECT batch_no, id, row_number() OVER (PARTITION BY batch_no ORDER BY api_index) - 1 AS pos, title FROM aihot_24h")
def s01(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("api_index", "id", "title")))
    items = F.transform(rows, lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title")))
    listed = table(spark, d, "aihot_24h").groupBy("batch_no").agg(F.to_json(F.struct(items.alias("items"))).alias("body"))
    return S.items_of_pages(listed, "body").select("batch_no", "id", F.col("pos").cast("long").alias("pos"), "title")


@query("s05_event_lines", "SELECT event_no, project_id, tool, event, depth FROM event_log WHERE success IS NOT NULL")
def s05(spark, d):
    e = table(spark, d, "event_log")
    line = F.when(F.col("success").isNull(), F.concat(F.lit("{broken "), "project_id")).otherwise(F.to_json(F.struct("event_no", "project_id", "tool", "event", "depth")))
    return S.lines_of(e.select(line.alias("line")), "line", "event_no long, project_id string, tool string, event string, depth int")


@query("s05b_event_tail", "SELECT DISTINCT event_no, tool FROM event_log ORDER BY event_no DESC LIMIT 250")
def s05b(spark, d):
    return S.tail(table(spark, d, "event_log").select("event_no", "tool").distinct(), "event_no", 250)


@query("s03_address_keys", "SELECT api_index, sha256(links.original) AS key FROM aihot_24h WHERE links.original IS NOT NULL")
def s03(spark, d):
    return table(spark, d, "aihot_24h").filter("links.original is not null").select("api_index", F.sha2("links.original", 256).alias("key"))


@query("s07_aligned_truncation", "WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings), b AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) AS i FROM (SELECT DISTINCT clip_id FROM cache_manifest)) SELECT vec_id, clip_id FROM a JOIN b USING (i)")
def s07(spark, d):
    from ..operators.numbering import numbered

    a = numbered(table(spark, d, "embeddings").select("vec_id"), "vec_id", "i")
    b = numbered(table(spark, d, "cache_manifest").select("clip_id").distinct(), "clip_id", "i")
    return a.join(b, "i").select("vec_id", "clip_id")


@query("s11_media_kinds", "SELECT CASE WHEN regexp_matches(lower(file_name), '\\.(mp4|mov|webm|mkv)$') THEN 'video' WHEN regexp_matches(lower(file_name), '\\.(mp3|wav|m4a|flac)$') THEN 'audio' WHEN regexp_matches(lower(file_name), '\\.(png|jpg|jpeg|webp|gif)$') THEN 'image' WHEN regexp_matches(lower(file_name), '\\.(json|srt|vtt|md|txt)$') THEN 'text' ELSE 'other' END AS kind, count(*) AS n FROM cache_manifest GROUP BY 1")
def s11(spark, d):
    return table(spark, d, "cache_manifest").groupBy(S.kind_of(F.col("file_name")).alias("kind")).agg(F.count("*").alias("n"))


@query("s12_fan_out", "SELECT c.project_id AS q, s.source, count(*) AS candidates FROM (SELECT DISTINCT project_id, tool FROM cost_ledger WHERE project_id IS NOT NULL) c JOIN (SELECT DISTINCT source FROM cache_manifest) s ON true GROUP BY 1, 2")
def s12(spark, d):
    sources = table(spark, d, "cache_manifest").select("source").distinct()
    listed = F.broadcast(sources.agg(F.collect_set("source").alias("sources")))  # the catalogue of sources: a handful
    q = table(spark, d, "cost_ledger").filter("project_id is not null").select(F.col("project_id").alias("q"), "tool").distinct()
    return q.join(listed).select("q", F.explode("sources").alias("source")).groupBy("q", "source").agg(F.count("*").alias("candidates"))


@query("s17_content_hash", """SELECT DISTINCT id, sha256('{"id":"' || id || '","project_id":"' || project_id || '","tool":"' || tool || '"}') AS hash FROM cost_ledger WHERE project_id IS NOT NULL AND tool IS NOT NULL""")
def s17(spark, d):
    c = table(spark, d, "cost_ledger").filter("project_id is not null and tool is not null")
    return c.select("id", S.content_hash(tool=F.col("tool"), id=F.col("id"), project_id=F.col("project_id")).alias("hash")).distinct()


@query("s18_idempotency_key", """SELECT DISTINCT id, left(sha256('{"id":"' || id || '","operation":' || CASE WHEN operation IS NULL THEN 'null' ELSE '"' || operation || '"' END || '}'), 16) AS key FROM cost_ledger""")
def s18(spark, d):
    return table(spark, d, "cost_ledger").select("id", S.idempotency_key(id=F.col("id"), operation=F.col("operation")).alias("key")).distinct()


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query("s03b_conditional_fetches", "WITH b AS (SELECT batch_no, etag, max(CASE WHEN etag IS NOT NULL THEN batch_no END) OVER (PARTITION BY query ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM feed_batches) SELECT b.batch_no, CASE WHEN b.etag IS NULL THEN 'untagged' WHEN b.etag = o.etag THEN 'not modified' ELSE 'fetched' END AS state FROM b LEFT JOIN feed_batches o ON o.batch_no = b.p")
def s03b(spark, d):
    # what a cache keeps is an entry a query, renewed by its fetches in order
    b = table(spark, d, "feed_batches").select("batch_no", "etag", "query")
    held = F.last("etag", ignorenulls=True).over(W.partitionBy("query").orderBy("batch_no").rowsBetween(W.unboundedPreceding, -1))
    state = F.when(F.col("etag").isNull(), "untagged").when(F.col("etag") == F.col("held"), "not modified").otherwise("fetched")
    return b.withColumn("held", held).select("batch_no", state.alias("state"))


@query("s06_appended_lines", "SELECT event_no, project_id, tool, count(*) AS lines FROM event_log GROUP BY 1, 2, 3")
def s06(spark, d):
    e, there = table(spark, d, "event_log").select("event_no", "project_id", "tool", "success"), _folder(spark)
    for part in (e.filter("success"), e.filter("not success or success is null")):
        S.append_lines(part.drop("success"), there)
    return S.json_lines(spark, there, "event_no long, project_id string, tool string").groupBy("event_no", "project_id", "tool").agg(F.count("*").alias("lines"))


@query("s09_checkpoint_documents", "SELECT project_id, stage, status, count(*) AS n FROM (SELECT DISTINCT project_id, stage, status, timestamp FROM checkpoints WHERE stage IS NOT NULL AND project_id IS NOT NULL) GROUP BY 1, 2, 3")
def s09(spark, d):
    there = _folder(spark)
    c = table(spark, d, "checkpoints").filter("stage is not null and project_id is not null").select("project_id", "stage", "status", "timestamp").distinct()
    c.withColumn("of", F.col("stage")).write.partitionBy("of").json(there)
    return S.json_lines(spark, there, "project_id string, stage string, status string, timestamp string").groupBy("project_id", "stage", "status").agg(F.count("*").alias("n"))


@query("s19_formats", "SELECT f AS format, count(*) AS n, count(DISTINCT p_brand) AS brands, sum(p_size)::BIGINT AS sizes FROM part, (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS f) GROUP BY 1")
def s19(spark, d):
    t, out = table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), None
    for kind in ("csv", "json", "orc", "parquet"):
        there = _folder(spark)
        S.write_table(t, there, kind=kind)
        one = spark.read.schema(t.schema).format(kind).load(there).agg(F.lit(kind).alias("format"), F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"), F.sum("p_size").cast("long").alias("sizes"))
        out = one if out is None else out.unionByName(one)
    return out
