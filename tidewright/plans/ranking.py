"""Selection, ranking and top-k queries (survey W1-W5, U1-U2, T1-T12, F6-F8, F12-F13, S2, S12-S13)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import ranking as R
from ..registry import query, table
from .common import ITEMS_SQL, items

_ONCE = f"""WITH {ITEMS_SQL}, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY category, id ORDER BY api_index) AS rn FROM items WHERE selected AND trim(title, ' ') <> '') WHERE rn = 1)"""


def _candidates(spark, d):
    return items(spark, d).filter(F.col("selected") & (F.trim("title") != ""))


@query("u02_first_wins", f"{_ONCE} SELECT category, id, api_index FROM once")
def u02(spark, d):
    return R.first_wins(_candidates(spark, d), ["category", "id"], [F.col("api_index")]).select("category", "id", "api_index")


@query("w01_rank_in_dimension", f"{_ONCE} SELECT category, id, row_number() OVER (PARTITION BY category, batch_no ORDER BY score IS NULL, score DESC, api_index) AS rank FROM once")
def w01(spark, d):
    once = R.first_wins(_candidates(spark, d), ["category", "id"], [F.col("api_index")])
    return R.rank_in_group(once, ["category", "batch_no"], R.best_first("score", "api_index")).select("category", "id", "rank")


@query(
    "w02_rank_percentile",
    f"""{_ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY category, batch_no ORDER BY score IS NULL, score DESC, api_index) AS rank, count(*) OVER (PARTITION BY category, batch_no) AS n FROM once)
  SELECT api_index, n, CASE WHEN n = 1 THEN 1.0 ELSE round(1 - (rank - 1)::DOUBLE / n, 6) END AS percentile FROM r""",
)
def w02(spark, d):
    once = R.first_wins(_candidates(spark, d), ["category", "id"], [F.col("api_index")])
    ranked = R.rank_in_group(R.with_group_size(once, ["category", "batch_no"]), ["category", "batch_no"], R.best_first("score", "api_index"))
    return ranked.select("api_index", "n", R.rank_percentile().alias("percentile"))


@query(
    "w03_head_tier",
    f"""{_ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY category, batch_no ORDER BY score IS NULL, score DESC, api_index) AS rank, count(*) OVER (PARTITION BY category, batch_no) AS n FROM once)
  SELECT api_index, CASE WHEN rank <= CASE WHEN n <= 2 THEN n ELSE least(4, greatest(2, ceil(n * 0.5))) END THEN 'head' ELSE 'reserve' END AS tier FROM r""",
)
def w03(spark, d):
    once = R.first_wins(_candidates(spark, d), ["category", "id"], [F.col("api_index")])
    ranked = R.rank_in_group(R.with_group_size(once, ["category", "batch_no"]), ["category", "batch_no"], R.best_first("score", "api_index"))
    return ranked.select("api_index", F.when(F.col("rank") <= R.head_size(), "head").otherwise("reserve").alias("tier"))


@query(
    "w04_adaptive_selection",
    f"""{_ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score IS NULL, score DESC, api_index) AS rank, count(*) OVER (PARTITION BY category) AS n FROM once),
  t AS (SELECT *, CASE WHEN rank <= CASE WHEN n <= 2 THEN n ELSE least(4, greatest(2, ceil(n * 0.5))) END THEN 'head' ELSE 'reserve' END AS tier FROM r),
  s AS (SELECT *, row_number() OVER (ORDER BY tier = 'reserve', rank, category) AS seq FROM t WHERE rank <= 8)
  SELECT seq, category, id, api_index, rank, CASE WHEN n = 1 THEN 1.0 ELSE round(1 - (rank - 1)::DOUBLE / n, 6) END AS percentile, tier,
    CASE WHEN rank = 1 THEN 'dimension_leader' WHEN tier = 'head' THEN 'relative_head' ELSE 'reserve_fill' END AS reason FROM s WHERE seq <= 8 AND (tier = 'head' OR seq <= 6)""",
)
def w04(spark, d):
    return R.adaptive_selection(_candidates(spark, d), "category", "id", "score", "api_index")


@query(
    "w05_quota_then_backfill",
    f"""WITH {ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY api_index) AS i FROM items WHERE selected)
  SELECT category, api_index, (i > 2)::INT AS late FROM r ORDER BY late, api_index LIMIT 40""",
)
def w05(spark, d):
    return R.quota_then_backfill(items(spark, d).filter("selected").select("category", "api_index"), "category", "api_index", 2, 40)


@query("u01_union_all", "SELECT id, 'feed' AS origin FROM aihot_24h UNION ALL SELECT clip_id AS id, 'cache' AS origin FROM cache_manifest UNION ALL SELECT id, 'ledger' AS origin FROM cost_ledger")
def u01(spark, d):
    parts = [("aihot_24h", "id", "feed"), ("cache_manifest", "clip_id", "cache"), ("cost_ledger", "id", "ledger")]
    a, b, c = (table(spark, d, t).select(F.col(k).alias("id"), F.lit(o).alias("origin")) for t, k, o in parts)
    return a.unionByName(b).unionByName(c)


@query(
    "s02_category_scans",
    """WITH p AS (SELECT 1 AS pos, 'industry' AS cat UNION ALL SELECT 2, 'ai-models' UNION ALL SELECT 3, 'paper'), u AS (SELECT p.pos, a.api_index, a.id FROM aihot_24h a JOIN p ON a.category = p.cat)
  SELECT id, api_index, pos FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, api_index) AS rn FROM u) WHERE rn = 1""",
)
def s02(spark, d):
    t = table(spark, d, "aihot_24h")
    parts = [t.filter(F.col("category") == c).select("id", "api_index", F.lit(i).alias("pos")) for i, c in enumerate(("industry", "ai-models", "paper"), 1)]
    return R.first_wins(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["id"], [F.col("pos"), F.col("api_index")])


@query(
    "s13_per_query_quota",
    """WITH u AS (SELECT DISTINCT clip_id, source, license, size_bytes FROM cache_manifest)
  SELECT source, clip_id, size_bytes, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_bytes DESC NULLS LAST, clip_id, license) AS place FROM u) WHERE place <= 5""",
)
def s13(spark, d):
    u = table(spark, d, "cache_manifest").select("clip_id", "source", "license", "size_bytes").distinct()
    return R.per_query_quota(u, "source", [F.col("size_bytes").desc_nulls_last(), F.col("clip_id"), F.col("license").asc_nulls_last()], 5).select("source", "clip_id", "size_bytes", "place")


@query(
    "f06_bounded_largest",
    """SELECT source_id, clip_id, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY size_bytes DESC NULLS LAST, clip_id, file_name) AS rn FROM (SELECT DISTINCT source_id, clip_id, file_name, size_bytes FROM cache_manifest WHERE size_bytes <= 20000000)) WHERE rn = 1""",
)
def f06(spark, d):
    c = table(spark, d, "cache_manifest").filter("size_bytes <= 20000000").select("source_id", "clip_id", "file_name", "size_bytes").distinct()
    return R.first_wins(c, ["source_id"], [F.col("size_bytes").desc_nulls_last(), F.col("clip_id"), F.col("file_name")]).select("source_id", "clip_id", "size_bytes")


@query(
    "f07_priority_format",
    """WITH x AS (SELECT DISTINCT creator, clip_id, size_bytes, CASE WHEN upper(license) = 'CC0' THEN 1 WHEN upper(license) LIKE 'CC%BY' THEN 2 WHEN license IS NOT NULL THEN 3 END AS prio FROM cache_manifest WHERE creator IS NOT NULL)
  SELECT creator, clip_id, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY prio, size_bytes DESC NULLS LAST, clip_id) AS rn FROM x WHERE prio IS NOT NULL) WHERE rn = 1""",
)
def f07(spark, d):
    c = table(spark, d, "cache_manifest").filter("creator is not null")
    prio = F.when(F.upper("license") == "CC0", 1).when(F.upper("license").like("CC%BY"), 2).when(F.col("license").isNotNull(), 3)
    u = c.select("creator", "clip_id", "size_bytes", prio.alias("prio")).distinct()
    return R.priority_pick(u, "creator", F.col("prio"), [F.col("size_bytes").desc_nulls_last(), F.col("clip_id")]).select("creator", "clip_id", "size_bytes")


@query(
    "f08_dynamic_dimensions",
    f"""WITH {ITEMS_SQL}, k AS (SELECT 'ai-models' AS category, 0 AS pos UNION ALL SELECT 'ai-products', 1 UNION ALL SELECT 'industry', 2 UNION ALL SELECT 'paper', 3 UNION ALL SELECT 'tip', 4),
  c AS (SELECT category, count(*) AS n FROM items GROUP BY 1)
  SELECT c.category, n, row_number() OVER (ORDER BY pos IS NULL, pos, c.category) AS place FROM c LEFT JOIN k USING (category)""",
)
def f08(spark, d):
    known = spark.createDataFrame(list(enumerate(("ai-models", "ai-products", "industry", "paper", "tip"))), "pos int, known string")
    c = items(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(known), F.col("category") == F.col("known"), "left").select("category", "n", F.row_number().over(W.orderBy(F.col("pos").isNull(), "pos", "category")).alias("place"))


@query(
    "f12_first_nonempty",
    """WITH a AS (SELECT project_id AS q, event_no, 1 AS strategy FROM event_log WHERE event = 'error'), b AS (SELECT project_id AS q, event_no, 2 AS strategy FROM event_log WHERE depth IS NULL AND event = 'finish'), c AS (SELECT project_id AS q, event_no, 3 AS strategy FROM event_log),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), m AS (SELECT q, min(strategy) AS f FROM u GROUP BY q)
  SELECT u.q, u.strategy, count(*) AS n FROM u JOIN m ON u.q = m.q AND u.strategy = m.f GROUP BY 1, 2""",
)
def f12(spark, d):
    e = table(spark, d, "event_log").select(F.col("project_id").alias("q"), "event_no", "event", "depth")
    parts = [x.select("q", "event_no") for x in (e.filter("event = 'error'"), e.filter("depth is null and event = 'finish'"), e)]
    return R.first_nonempty(parts, "q").groupBy("q", "strategy").agg(F.count("*").alias("n"))


@query("t01_top_k", f"WITH {ITEMS_SQL} SELECT api_index, score FROM items ORDER BY score DESC NULLS LAST, api_index LIMIT 50")
def t01(spark, d):
    return items(spark, d).select("api_index", "score").orderBy(*R.best_first("score", "api_index")).limit(50)


@query(
    "t03_lexicographic_rank",
    f"""WITH {ITEMS_SQL} SELECT api_index, row_number() OVER (PARTITION BY batch_no ORDER BY selected DESC NULLS LAST, score DESC NULLS LAST, length(title) DESC NULLS LAST, api_index) AS place FROM items""",
)
def t03(spark, d):
    order = [F.col("selected").desc_nulls_last(), F.col("score").desc_nulls_last(), F.length("title").desc_nulls_last(), F.col("api_index")]
    return R.rank_in_group(items(spark, d), ["batch_no"], order, "place").select("api_index", "place")


@query("t04_pin_then_rank", f"WITH {ITEMS_SQL} SELECT api_index, category FROM items ORDER BY CASE category WHEN 'paper' THEN 0 WHEN 'tip' THEN 1 ELSE 2 END, score DESC NULLS LAST, api_index LIMIT 20")
def t04(spark, d):
    pin = F.when(F.col("category") == "paper", 0).when(F.col("category") == "tip", 1).otherwise(2)
    return items(spark, d).orderBy(pin, *R.best_first("score", "api_index")).limit(20).select("api_index", "category")


@query("t05_ordered_distinct", f"WITH {ITEMS_SQL} SELECT source_name, min(api_index) AS first_at FROM items WHERE source_name IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 60")
def t05(spark, d):
    return items(spark, d).filter("source_name is not null").groupBy("source_name").agg(F.min("api_index").alias("first_at")).orderBy("first_at").limit(60)


@query(
    "t06_fixed_order_sort",
    f"WITH {ITEMS_SQL} SELECT api_index, row_number() OVER (PARTITION BY batch_no ORDER BY CASE category WHEN 'ai-models' THEN 0 WHEN 'ai-products' THEN 1 WHEN 'industry' THEN 2 ELSE 9 END, api_index) AS place FROM items",
)
def t06(spark, d):
    order = spark.createDataFrame([("ai-models", 0), ("ai-products", 1), ("industry", 2)], "known string, pos int")
    x = items(spark, d).join(F.broadcast(order), F.col("category") == F.col("known"), "left")
    return R.rank_in_group(x, ["batch_no"], [F.coalesce("pos", F.lit(9)), F.col("api_index")], "place").select("api_index", "place")


@query(
    "t08_lru_eviction",
    """WITH u AS (SELECT DISTINCT clip_id, size_bytes, last_access_at FROM cache_manifest WHERE size_bytes IS NOT NULL), o AS (SELECT clip_id, max(size_bytes) AS size_bytes, max(CASE WHEN isnan(last_access_at) THEN NULL ELSE last_access_at END) AS acc FROM u GROUP BY 1),
  r AS (SELECT *, coalesce(sum(size_bytes) OVER (ORDER BY acc NULLS FIRST, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size_bytes) OVER () AS used FROM o)
  SELECT clip_id, size_bytes FROM r WHERE used - before > 2000000000""",
)
def t08(spark, d):
    c = table(spark, d, "cache_manifest").filter("size_bytes is not null").groupBy("clip_id").agg(F.max("size_bytes").alias("size_bytes"), F.max(F.when(~F.isnan("last_access_at"), F.col("last_access_at"))).alias("at"))
    return R.evict_until_fits(c, "size_bytes", "at", "clip_id", 2_000_000_000).select("clip_id", "size_bytes")


@query(
    "t10_natural_sort",
    "SELECT DISTINCT source, array_to_string(list_transform(regexp_extract_all(lower(source), '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(coalesce(nullif(ltrim(p, '0'), ''), '0'), 12, '0') ELSE p END), '') AS sort_key FROM documents",
)
def t10(spark, d):
    t = table(spark, d, "documents").select("source").distinct()
    return t.select("source", R.natural_key(F.col("source")).alias("sort_key"))


@query("t09_best_page", "SELECT batch_no, arg_max(api_index, struct_pack(s := coalesce(CASE WHEN isnan(score) THEN NULL ELSE score END, 0) / 100 + least(length(coalesce(summary, '')) * 1000 / 100000.0, 1.0)::DOUBLE, p := -api_index)) AS page FROM aihot_24h GROUP BY 1")
def t09(spark, d):
    t = table(spark, d, "aihot_24h").select("batch_no", "api_index", F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0)).alias("score"), (F.length(F.coalesce("summary", F.lit(""))) * 1000).alias("area"))
    return t.groupBy("batch_no").agg(R.best_page("api_index", F.col("score") / 100, F.col("area"), 100_000).alias("page"))


@query(
    "t12_stage_positions",
    "WITH c AS (SELECT project_id, stage, min(timestamp) AS since FROM checkpoints WHERE stage IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, coalesce(list_position(['research', 'proposal', 'idea', 'script', 'scene_plan', 'assets', 'edit', 'compose', 'publish'], stage), 1000) AS pos FROM c) SELECT project_id, stage, row_number() OVER (PARTITION BY project_id ORDER BY pos, since NULLS FIRST, stage) AS place FROM k",
)
def t12(spark, d):
    c = table(spark, d, "checkpoints").filter("stage is not null").groupBy("project_id", "stage").agg(F.min("timestamp").alias("since"))
    return R.in_known_order(c, "project_id", "stage", ["research", "proposal", "idea", "script", "scene_plan", "assets", "edit", "compose", "publish"], ["since", "stage"]).select("project_id", "stage", "place")


@query("t11_live_then_recent", "SELECT project_id, max(ts) AS last_ts, bool_or(event = 'start') AS live FROM event_log GROUP BY 1 ORDER BY live DESC, last_ts DESC, project_id LIMIT 100")
def t11(spark, d):
    g = table(spark, d, "event_log").groupBy("project_id").agg(F.max("ts").alias("last_ts"), F.bool_or(F.col("event") == "start").alias("live"))
    return g.orderBy(F.desc("live"), F.desc("last_ts"), "project_id").limit(100)
