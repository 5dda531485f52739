"""Aggregation queries (survey A1-A21, D13, V A14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..registry import query, table
from .common import ITEMS_SQL, items


@query("a01_count_by_category", f"WITH {ITEMS_SQL} SELECT category, count(*) AS n FROM items GROUP BY 1")
def a01(spark, d):
    return items(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query(
    "a02_corpus_stats",
    """SELECT coalesce(source, '*') AS source, coalesce(license, '*') AS license, count(*) AS n, coalesce(round(sum(size_bytes)::DOUBLE / count(size_bytes), 3), 0) AS mean_size FROM cache_manifest
  WHERE source IS NOT NULL AND license IS NOT NULL GROUP BY GROUPING SETS ((source), (license), ()) """,
)
def a02(spark, d):
    c = table(spark, d, "cache_manifest").filter("source is not null and license is not null")
    g = c.groupingSets([["source"], ["license"], []], "source", "license").agg(F.count("*").alias("n"), F.coalesce(F.round(F.sum("size_bytes") / F.count("size_bytes"), 3), F.lit(0.0)).alias("mean_size"))
    return g.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("license", F.lit("*")).alias("license"), "n", "mean_size")


@query(
    "a03_ledger_sums",
    """WITH c AS (SELECT DISTINCT * FROM cost_ledger), m AS (SELECT project_id, status, CASE WHEN isnan(reserved_usd) THEN NULL ELSE reserved_usd::DECIMAL(18,4) END AS r, CASE WHEN isnan(actual_usd) THEN NULL ELSE actual_usd::DECIMAL(18,4) END AS a FROM c)
  SELECT project_id, coalesce(sum(r) FILTER (status = 'reserved'), 0)::DOUBLE AS reserved, coalesce(sum(a) FILTER (status IN ('completed', 'failed')), 0)::DOUBLE AS spent,
    greatest(0, 10 - coalesce(sum(a) FILTER (status IN ('completed', 'failed')), 0) - coalesce(sum(r) FILTER (status = 'reserved'), 0))::DOUBLE AS usable FROM m GROUP BY 1""",
)
def a03(spark, d):
    c = table(spark, d, "cost_ledger").distinct()
    reserved, spent = A.sum_where(F.col("reserved_usd"), F.col("status") == "reserved"), A.sum_where(F.col("actual_usd"), F.col("status").isin("completed", "failed"))
    g = c.groupBy("project_id").agg(reserved.alias("reserved"), spent.alias("spent"))
    return g.select("project_id", F.col("reserved").cast("double").alias("reserved"), F.col("spent").cast("double").alias("spent"), F.greatest(F.lit(0.0), (10 - F.col("spent") - F.col("reserved")).cast("double")).alias("usable"))


@query(
    "a04_pivot",
    "SELECT tool, count(*) FILTER (event = 'start') AS start, count(*) FILTER (event = 'finish') AS finish, count(*) FILTER (event = 'error') AS error FROM event_log GROUP BY 1",
)
def a04(spark, d):
    return A.counts_by_state(table(spark, d, "event_log"), "tool", "event", ["start", "finish", "error"])


@query(
    "a05_menu",
    """WITH g AS (SELECT operation, list_sort(list(DISTINCT tool) FILTER (status = 'completed')) AS done, list_sort(list(DISTINCT tool)) AS every FROM cost_ledger WHERE operation <> '' AND tool IS NOT NULL GROUP BY 1)
  SELECT operation, len(every) AS total, coalesce(len(done), 0) AS configured, coalesce(array_to_string(done, ','), '') AS available, array_to_string(list_sort(list_filter(every, lambda x: NOT list_contains(coalesce(done, []), x))), ',') AS unavailable FROM g""",
)
def a05(spark, d):
    c = table(spark, d, "cost_ledger").filter("operation <> '' and tool is not null")
    g = c.groupBy("operation").agg(F.array_sort(F.collect_set(F.when(F.col("status") == "completed", F.col("tool")))).alias("done"), F.array_sort(F.collect_set("tool")).alias("every"))
    return g.select("operation", F.size("every").cast("long").alias("total"), F.size("done").cast("long").alias("configured"), F.array_join("done", ",").alias("available"), F.array_join(F.array_except("every", "done"), ",").alias("unavailable"))


@query(
    "a06_nested_catalog",
    """SELECT source, string_agg(license || ':' || n, ';' ORDER BY license) AS licenses FROM (SELECT source, license, count(DISTINCT clip_id) AS n FROM cache_manifest WHERE license IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
)
def a06(spark, d):
    g = table(spark, d, "cache_manifest").filter("license is not null").groupBy("source", "license").agg(F.countDistinct("clip_id").alias("n"))
    return g.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("license", "n"))), lambda x: F.concat(x["license"], F.lit(":"), x["n"].cast("string"))), ";").alias("licenses"))


@query(
    "a07_mode_share",
    f"""WITH {ITEMS_SQL}, c AS (SELECT batch_no, category, count(*) AS n, min(api_index) AS f FROM items GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY batch_no) AS alln, row_number() OVER (PARTITION BY batch_no ORDER BY n DESC, f) AS rn FROM c)
  SELECT batch_no, category, n, round(n::DOUBLE / alln, 6) AS share FROM t WHERE rn = 1""",
)
def a07(spark, d):
    return A.mode_share(items(spark, d), "batch_no", "category", "api_index")


@query("a08_distinct_ratio", "SELECT doc_kind, round(count(DISTINCT left(lower(text), 50))::DOUBLE / count(*), 6) AS ratio FROM documents GROUP BY 1")
def a08(spark, d):
    return table(spark, d, "documents").groupBy("doc_kind").agg(F.round(F.countDistinct(F.left(F.lower("text"), F.lit(50))) / F.count("*"), 6).alias("ratio"))


@query(
    "a09_conditional_ratios",
    "SELECT project_id, round((count(*) FILTER (success))::DOUBLE / count(*), 9) AS succeeded, round((count(*) FILTER (scene_id IS NULL))::DOUBLE / count(*), 9) AS without_scene, round((count(*) FILTER (depth > 0))::DOUBLE / count(*), 9) AS nested FROM event_log GROUP BY 1",
)
def a09(spark, d):
    ratio = lambda c: F.round(F.count_if(c) / F.count("*"), 9)
    return table(spark, d, "event_log").groupBy("project_id").agg(ratio(F.col("success")).alias("succeeded"), ratio(F.col("scene_id").isNull()).alias("without_scene"), ratio(F.col("depth") > 0).alias("nested"))


@query(
    "a10_pacing_profile",
    """WITH x AS (SELECT tool, duration_s::DECIMAL(18,4) AS s FROM event_log WHERE duration_s > 0 AND NOT isnan(duration_s))
  SELECT tool, min(s)::DOUBLE AS least, max(s)::DOUBLE AS most, round(sum(s)::DOUBLE / count(*), 6) AS mean, round(count(*) / (sum(s)::DOUBLE / 60), 6) AS per_minute FROM x GROUP BY 1""",
)
def a10(spark, d):
    x = table(spark, d, "event_log").filter("duration_s > 0 and not isnan(duration_s)").select("tool", F.col("duration_s").cast("decimal(18,4)").alias("s"))
    total = F.sum("s").cast("double")
    return x.groupBy("tool").agg(F.min("s").cast("double").alias("least"), F.max("s").cast("double").alias("most"), F.round(total / F.count("*"), 6).alias("mean"), F.round(F.count("*") / (total / 60), 6).alias("per_minute"))


@query(
    "a11_class_counts",
    """WITH x AS (SELECT source, CASE WHEN n_chars < 200 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS class FROM documents)
  SELECT source, count_if(class = 'short') AS short, count_if(class = 'middle') AS middle, count_if(class = 'long') AS long, round(count_if(class = 'long')::DOUBLE / count(*), 6) AS long_share FROM x GROUP BY 1""",
)
def a11(spark, d):
    x = table(spark, d, "documents").withColumn("class", F.when(F.col("n_chars") < 200, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long"))
    counts = {c: F.count_if(F.col("class") == c) for c in ("short", "middle", "long")}
    return x.groupBy("source").agg(*(v.alias(k) for k, v in counts.items()), F.round(counts["long"] / F.count("*"), 6).alias("long_share"))


@query(
    "a12_score_evaluation",
    f"""WITH {ITEMS_SQL} SELECT batch_no, sum(score) AS total, round(sum(score) / count(score), 6) AS mean, count_if(score >= 80) >= 3 AND sum(score) / count(score) >= 60 AS passed FROM items GROUP BY 1 HAVING count(score) > 0""",
)
def a12(spark, d):
    return items(spark, d).groupBy("batch_no").agg(F.count("score").alias("k"), F.sum("score").alias("total"), F.round(F.try_divide(F.sum("score"), F.count("score")), 6).alias("mean"), ((F.count_if(F.col("score") >= 80) >= 3) & (F.try_divide(F.sum("score"), F.count("score")) >= 60)).alias("passed")).filter("k > 0").drop("k")


@query("a13_cache_stats", "SELECT source, count(*) AS clips, sum(size_bytes) AS bytes, round(sum(size_bytes)::DOUBLE / 21474836480, 9) AS fraction FROM (SELECT DISTINCT * FROM cache_manifest) GROUP BY 1")
def a13(spark, d):
    return table(spark, d, "cache_manifest").distinct().groupBy("source").agg(F.count("*").alias("clips"), F.sum("size_bytes").alias("bytes"), F.round(F.sum("size_bytes") / 21474836480, 9).alias("fraction"))


@query(
    "a15_signal_level",
    "SELECT user_id, round(20 * log10(nullif(sqrt(sum((value * 100)::DECIMAL(18,4) * (value * 100)::DECIMAL(18,4))::DOUBLE / count(*)), 0) / 32767), 4) AS dbfs, max(abs(value * 100)) AS peak, round(least(1.0, 32760 / nullif(max(abs(value * 100)), 0)), 6) AS headroom FROM events GROUP BY 1",
)
def a15(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("value") * 100).alias("x"))
    return A.level(e, ["user_id"], "x")


@query("a17_multiplicities", "SELECT id, count(*) AS n FROM cost_ledger GROUP BY 1 HAVING count(*) > 1")
def a17(spark, d):
    return table(spark, d, "cost_ledger").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


@query(
    "a18_word_accuracy",
    """WITH w AS (SELECT api_index, unnest(regexp_extract_all(lower("originalTitle"), '[a-z0-9]+')) AS t FROM aihot_24h), h AS (SELECT DISTINCT api_index, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM aihot_24h)
  , l AS (SELECT api_index, count(*) AS leaked FROM h WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.api_index = h.api_index AND w.t = h.t) GROUP BY 1)
  SELECT api_index, words, found, accuracy, coalesce(leaked, 0) AS leaked FROM (SELECT w.api_index, count(*) AS words, count(h.t) AS found, round(count(h.t)::DOUBLE / count(*), 6) AS accuracy FROM w LEFT JOIN h ON w.api_index = h.api_index AND w.t = h.t GROUP BY 1) LEFT JOIN l USING (api_index)""",
)
def a18(spark, d):
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    x = table(spark, d, "aihot_24h").select("api_index", words("originalTitle").alias("w"), F.coalesce(words("title"), F.array().cast("array<string>")).alias("h")).filter(F.size("w") > 0)
    found = F.size(F.filter("w", lambda t: F.array_contains("h", t)))
    return x.select("api_index", F.size("w").cast("long").alias("words"), found.cast("long").alias("found"), F.round(found / F.size("w"), 6).alias("accuracy"), F.size(F.array_except("h", "w")).cast("long").alias("leaked"))


@query(
    "a19_ordered_text",
    """SELECT project_id, coalesce(string_agg(x, '|' ORDER BY event_no), '') AS joined FROM (SELECT DISTINCT project_id, event_no, tool || ':' || event AS x FROM event_log) WHERE trim(x, ' ') <> '' GROUP BY 1""",
)
def a19(spark, d):
    e = table(spark, d, "event_log").select("project_id", "event_no", F.concat("tool", F.lit(":"), "event").alias("x")).distinct().filter(F.trim("x") != "")
    return A.ordered_text(e, "project_id", "event_no", "x", "|")


@query(
    "a20_outermost_cost",
    "SELECT project_id, coalesce(sum(cost_usd::DECIMAL(18,6)) FILTER (depth IS NULL AND NOT isnan(cost_usd)), 0)::DOUBLE AS cost FROM (SELECT DISTINCT project_id, event_no, depth, CASE WHEN isnan(cost_usd) THEN NULL ELSE cost_usd END AS cost_usd FROM event_log) GROUP BY 1",
)
def a20(spark, d):
    e = table(spark, d, "event_log").select("project_id", "event_no", "depth", F.when(~F.isnan("cost_usd"), F.col("cost_usd").cast("decimal(18,6)")).alias("c")).distinct()
    return e.groupBy("project_id").agg(F.coalesce(F.sum(F.when(F.col("depth").isNull(), F.col("c"))), F.lit(0)).cast("double").alias("cost"))


@query(
    "a21_weighted_blend",
    """SELECT project_id, round(least(0.95, greatest(0.0, sum(CASE event WHEN 'finish' THEN 8000 WHEN 'start' THEN 4000 WHEN 'error' THEN 1000 ELSE 5000 END)::DOUBLE / 10000 / count(*))), 9) AS blend FROM event_log GROUP BY 1""",
)
def a21(spark, d):
    return A.weighted_blend(table(spark, d, "event_log"), "project_id", "event", {"finish": 0.8, "start": 0.4, "error": 0.1}, 0.5)


@query(
    "d13_percent_of_total",
    "SELECT o_orderpriority, sum(o_totalprice::DECIMAL(18,4))::DOUBLE AS total, round(100 * sum(o_totalprice::DECIMAL(18,4))::DOUBLE / sum(sum(o_totalprice::DECIMAL(18,4))) OVER ()::DOUBLE, 6) AS percent FROM orders GROUP BY 1",
)
def d13(spark, d):
    return A.share_of_total(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
