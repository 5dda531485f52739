"""Expectation queries (survey R1-R18, as a generic rule engine), extension pack (ext_) and streaming parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import expectations as E
from ..registry import query, table
from ..streaming import jobs
from .common import ITEMS_SQL, items

_RULES_SQL = f"""WITH {ITEMS_SQL}, v AS (SELECT api_index::VARCHAR AS entity, unnest([CASE WHEN title IS NULL OR trim(title, ' ') = '' THEN 'no_title' END, CASE WHEN source_name IS NULL THEN 'no_source' END, CASE WHEN score < 0 OR score > 100 THEN 'score_range' END, CASE WHEN length(title) > 60 THEN 'long_title' END, CASE WHEN published_at IS NULL THEN 'no_time' END]) AS rule FROM items)"""


def _feed_rules():
    return [E.Rule("no_title", F.col("title").isNull() | (F.trim("title") == "")), E.Rule("no_source", F.col("source_name").isNull()), E.Rule("score_range", (F.col("score") < 0) | (F.col("score") > 100)), E.Rule("long_title", F.length("title") > 60), E.Rule("no_time", F.col("published_at").isNull())]


@query("r01_violations", f"{_RULES_SQL} SELECT entity, rule FROM v WHERE rule IS NOT NULL")
def r01(spark, d):
    return E.violations(items(spark, d), "api_index", _feed_rules()).select("entity", "rule")


@query("r04_verdicts", f"{_RULES_SQL} SELECT entity, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'fail' WHEN count(*) >= 2 THEN 'revise' ELSE 'pass' END AS verdict FROM v WHERE rule IS NOT NULL GROUP BY 1")
def r04(spark, d):
    return E.verdicts(E.violations(items(spark, d), "api_index", _feed_rules()), [(3, "fail"), (2, "revise")])


@query("r08_gates", f"{_RULES_SQL} SELECT " + ", ".join(f"count_if(rule = '{n}') = 0 AS {n}" for n in ("no_title", "no_source", "score_range", "long_title", "no_time")) + " FROM v")
def r08(spark, d):
    return E.gates(E.violations(items(spark, d), "api_index", _feed_rules()), [r.name for r in _feed_rules()])


@query("r11_gate_skips", "SELECT project_id, stage, bool_or(status = 'completed') AND NOT bool_or(coalesce(human_approved, false)) AS skipped FROM checkpoints WHERE stage IS NOT NULL GROUP BY 1, 2")
def r11(spark, d):
    c = table(spark, d, "checkpoints").filter("stage is not null")
    return c.groupBy("project_id", "stage").agg((F.bool_or(F.col("status") == "completed") & ~F.bool_or(F.coalesce("human_approved", F.lit(False)))).alias("skipped"))


@query("r12_mode_of_values", "SELECT project_id, CASE count(DISTINCT tool) WHEN 0 THEN 'none' WHEN 1 THEN max(tool) ELSE 'mixed' END AS mode FROM event_log GROUP BY 1")
def r12(spark, d):
    n = F.countDistinct("tool")
    return table(spark, d, "event_log").groupBy("project_id").agg(F.when(n == 0, "none").when(n == 1, F.max("tool")).otherwise("mixed").alias("mode"))


@query("r15_first_violation", f"WITH {ITEMS_SQL} SELECT api_index, CASE WHEN title IS NULL OR trim(title, ' ') = '' THEN 'no_title' WHEN source_name IS NULL THEN 'no_source' WHEN length(title) > 60 THEN 'long_title' END AS first_rule FROM items")
def r15(spark, d):
    rules = [r for r in _feed_rules() if r.name in ("no_title", "no_source", "long_title")]
    return items(spark, d).select("api_index", E.first_violation(F.col("api_index"), rules).alias("first_rule"))


@query("r16_nested_completeness", "SELECT project_id, stage, coalesce(len(map_keys(artifacts)) > 0 AND len(list_filter(map_values(artifacts), lambda v: v LIKE 'artifacts/%')) = len(map_keys(artifacts)), false) AS complete, count(*) AS n FROM checkpoints GROUP BY 1, 2, 3")
def r16(spark, d):
    v = F.map_values("artifacts")
    done = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.like("artifacts/%")), F.lit(False))
    return table(spark, d, "checkpoints").groupBy("project_id", "stage", done.alias("complete")).agg(F.count("*").alias("n"))


@query(
    "r18_reconciliation",
    """WITH a AS (SELECT batch_no, count(*)::VARCHAR AS n FROM aihot_24h GROUP BY 1), b AS (SELECT batch_no, coalesce(page.count, 0)::VARCHAR AS n FROM feed_batches)
  SELECT coalesce(a.batch_no, b.batch_no) AS batch_no, 'n' AS field, a.n AS a, b.n AS b FROM a FULL JOIN b ON a.batch_no = b.batch_no WHERE a.n IS DISTINCT FROM b.n""",
)
def r18(spark, d):
    a = table(spark, d, "aihot_24h").groupBy("batch_no").agg(F.count("*").alias("n"))
    b = table(spark, d, "feed_batches").select("batch_no", F.coalesce("page.count", F.lit(0)).cast("long").alias("n"))
    return E.reconcile(a, b, "batch_no", ["n"])


# --- streaming: the same results as in batch -------------------------------------------------------------------------


@query("stream_scene_states", "SELECT project_id, scene_id, arg_max(event, event_no) AS state, max(event_no) AS at FROM event_log WHERE scene_id IS NOT NULL AND (depth IS NULL OR depth = 0) GROUP BY 1, 2")
def stream_states(spark, d):
    return jobs.scene_states(spark, f"{d}/event_log.parquet")


@query("stream_hourly_windows", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hours(spark, d):
    return jobs.hourly_counts(spark, f"{d}/events.parquet")


@query("stream_changed_projects", "SELECT project_id, count(*) AS changes FROM event_log GROUP BY 1")
def stream_changes(spark, d):
    return jobs.changed_keys(spark, f"{d}/event_log.parquet", "project_id")


@query("stream_sliding_windows", "SELECT event_type, (time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i))::TIMESTAMP AS hour, count(*) AS n FROM events, (SELECT unnest(range(0, 4)) AS i) GROUP BY 1, 2")
def stream_sliding(spark, d):
    return jobs.hourly_counts(spark, f"{d}/events.parquet", slide="15 minutes")


@query("stream_coalesced_changes", "WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 3 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, min(ts)::TIMESTAMP AS began, count(*) AS changes FROM s GROUP BY user_id, s")
def stream_coalesced(spark, d):
    n = jobs.coalesced_changes(spark, f"{d}/events.parquet", "user_id", "ts", "3 hours")
    return n.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), "changes")


@query("stream_stale_entries", "WITH c AS (SELECT project_id, max(timestamp) AS cached_at FROM cost_ledger WHERE project_id IS NOT NULL GROUP BY 1), l AS (SELECT project_id, max(ts) AS changed_at FROM event_log GROUP BY 1) SELECT c.project_id, coalesce(changed_at > cached_at, false) AS stale FROM c LEFT JOIN l USING (project_id)")
def stream_stale(spark, d):
    cached = table(spark, d, "cost_ledger").filter("project_id is not null").groupBy("project_id").agg(F.max("timestamp").alias("cached_at"))
    return jobs.stale_entries(spark, f"{d}/event_log.parquet", "project_id", "ts", cached)


@query(
    "r03_composition_issues",
    "SELECT event_no, project_id, array_to_string(list_filter([CASE WHEN tool IS NULL THEN 'no source' END, CASE WHEN coalesce(duration_s, 0) <= 0 OR isnan(duration_s) THEN 'out before in' END, CASE WHEN duration_s > 120 AND NOT isnan(duration_s) THEN 'too long' END, CASE WHEN success IS FALSE THEN 'failed' END], lambda x: x IS NOT NULL), '; ') AS issues FROM (SELECT DISTINCT event_no, project_id, tool, duration_s, success FROM event_log WHERE event <> 'start')",
)
def r03(spark, d):
    e = table(spark, d, "event_log").filter("event <> 'start'").select("event_no", "project_id", "tool", "duration_s", "success").distinct()
    s = F.col("duration_s")
    rules = [(F.col("tool").isNull(), "no source"), ((F.coalesce(s, F.lit(0.0)) <= 0) | F.isnan(s), "out before in"), ((s > 120) & ~F.isnan(s), "too long"), (F.col("success") == False, "failed")]  # noqa: E712
    return e.select("event_no", "project_id", F.array_join(E.issues(rules), "; ").alias("issues"))


@query(
    "f11_probe_issues",
    "SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'empty' END, CASE WHEN lang IS NULL THEN 'no language' END, CASE WHEN n_chars NOT BETWEEN 40 AND 20000 THEN 'length' END, CASE WHEN project_id IS NULL THEN 'no project' END], lambda x: x IS NOT NULL), '; ') AS issues FROM documents",
)
def f11(spark, d):
    rules = [(F.col("text").isNull() | (F.trim("text") == ""), "empty"), (F.col("lang").isNull(), "no language"), (~F.col("n_chars").between(40, 20000), "length"), (F.col("project_id").isNull(), "no project")]
    return table(spark, d, "documents").select("doc_id", F.array_join(E.issues(rules), "; ").alias("issues"))


@query(
    "f13_renditions",
    "SELECT source, source_id, arg_min(file_name, struct_pack(p := CASE WHEN ends_with(lower(file_name), '.mp4') THEN 0 WHEN ends_with(lower(file_name), '.mov') THEN 1 ELSE 2 END, s := -coalesce(size_bytes, 0), f := file_name)) AS file_name FROM cache_manifest WHERE file_name IS NOT NULL GROUP BY 1, 2",
)
def f13(spark, d):
    low = F.lower("file_name")
    order = F.struct(F.when(low.endswith(".mp4"), 0).when(low.endswith(".mov"), 1).otherwise(2).alias("p"), (-F.coalesce("size_bytes", F.lit(0))).alias("s"), F.col("file_name").alias("f"))
    return table(spark, d, "cache_manifest").filter("file_name is not null").groupBy("source", "source_id").agg(F.min_by("file_name", order).alias("file_name"))


# --- extension pack: what Spark gives, on the driver's tables --------------------------------------------------------------


@query("ext_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity::DECIMAL(18,2))::DOUBLE, 2) AS sum_qty, round(sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DOUBLE, 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def ext_q1(spark, d):
    m = lambda c: F.col(c).cast("decimal(18,2)")
    l = table(spark, d, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum(m("l_quantity")).cast("double"), 2).alias("sum_qty"), F.round(F.sum(m("l_extendedprice") * (1 - m("l_discount"))).cast("double"), 2).alias("revenue"), F.count("*").alias("n"))


@query("ext_join_rollup", "SELECT coalesce(r_name, '*') AS region, coalesce(n_name, '*') AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def ext_rollup(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count("*").alias("customers")).select(F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("n_name", F.lit("*")).alias("nation"), "customers")


@query("ext_cube", "SELECT coalesce(event_type, '*') AS event_type, coalesce(d::VARCHAR, '*') AS day, count(*) AS n FROM (SELECT event_type, ts::DATE AS d FROM events) GROUP BY CUBE (event_type, d)")
def ext_cube(spark, d):
    e = table(spark, d, "events").select("event_type", F.to_date("ts").alias("d"))
    return e.cube("event_type", "d").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("*")).alias("event_type"), F.coalesce(F.col("d").cast("string"), F.lit("*")).alias("day"), "n")


@query("ext_semi_anti", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 1000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def ext_semi(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return c.join(o.filter("o_totalprice > 1000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(o.filter("o_orderpriority = '1-URGENT'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("ext_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, s AS session, count(*) AS n FROM s GROUP BY 1, 2")
def ext_sessions(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("session_window.start")).alias("session"), "n")


@query("ext_ntile", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS quarter FROM orders")
def ext_ntile(spark, d):
    from pyspark.sql import Window as W

    return table(spark, d, "orders").select("o_orderkey", F.ntile(4).over(W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).alias("quarter"))


@query("ext_window_functions", "SELECT o_orderkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, lead(o_orderkey) OVER w AS next_key, nth_value(o_orderkey, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS near FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def ext_windows(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    near = W.partitionBy("o_custkey").orderBy("o_totalprice").rangeBetween(-1000, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.lead("o_orderkey").over(w).alias("next_key"), F.nth_value("o_orderkey", 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("second_key"), F.count("*").over(near).alias("near"))


@query("ext_merged_sketches", "SELECT event_type, count(DISTINCT ts::DATE) AS days FROM events GROUP BY 1")
def ext_sketches(spark, d):
    parts = table(spark, d, "events").groupBy("event_type", F.pmod("user_id", F.lit(7)).alias("part")).agg(F.hll_sketch_agg(F.to_date("ts").cast("string")).alias("sketch"))
    return parts.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("days"))


@query("ext_aggregate_function", "SELECT event_type, round(exp(avg(ln(value)) FILTER (value > 0)), 6) AS mean FROM events GROUP BY 1")
def ext_udaf(spark, d):
    # a geometric mean of one's own, in two steps of built-in aggregates so that it is combined before the shuffle
    v = F.when(F.col("value") > 0, F.ln("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.exp(F.avg(v)), 6).alias("mean"))
