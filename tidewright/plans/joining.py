"""Join queries (survey J1-J16, U3-U6, F3, S8-S10)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.timefmt import CONFUSED, hsl
from ..operators import joins as J
from ..operators.numbering import numbered
from ..registry import query, table
from .common import ITEMS_SQL, items
from .texts import COLORS_SQL, colors

#: Work on a scene as an interval of seconds: from an event's end minus its duration to its end.
_WORK = """work AS (SELECT DISTINCT event_no, project_id, scene_id, epoch(ts::TIMESTAMPTZ)::DOUBLE - duration_s AS w_start, epoch(ts::TIMESTAMPTZ)::DOUBLE AS w_end FROM event_log WHERE event = 'finish' AND duration_s > 0 AND NOT isnan(duration_s))"""


def _work(spark, d):
    e = table(spark, d, "event_log").filter("event = 'finish' and duration_s > 0 and not isnan(duration_s)")
    end = F.unix_timestamp(F.to_timestamp("ts")).cast("double")
    return e.select("event_no", "project_id", "scene_id", (end - F.col("duration_s")).alias("w_start"), end.alias("w_end")).distinct()


@query("j01_lookup", "SELECT c.id, c.project_id, p.stages FROM cost_ledger c LEFT JOIN (SELECT project_id, count(DISTINCT stage) AS stages FROM checkpoints GROUP BY 1) p USING (project_id)")
def j01(spark, d):
    dim = table(spark, d, "checkpoints").groupBy("project_id").agg(F.countDistinct("stage").alias("stages"))
    return J.lookup(table(spark, d, "cost_ledger").select("id", "project_id"), dim, "project_id", "project_id").select("id", "project_id", "stages")


@query(
    "j02_lookback_anti",
    """WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS day FROM orders), s AS (SELECT DISTINCT o_custkey AS k, day AS d FROM o)
  SELECT o_orderkey FROM o WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = o.o_custkey AND s.d < o.day AND s.d >= o.day - 7)""",
)
def j02(spark, d):
    o = table(spark, d, "orders")
    return J.lookback_anti(o, "o_custkey", F.col("o_orderdate"), o, "o_custkey", F.col("o_orderdate"), 7).select("o_orderkey")


@query(
    "j03_completeness",
    """WITH w AS (SELECT DISTINCT project_id AS k FROM checkpoints), h AS (SELECT project_id AS k, count(*) AS n FROM cost_ledger WHERE project_id IS NOT NULL GROUP BY 1)
  SELECT coalesce(w.k, h.k) AS project_id, CASE WHEN h.k IS NULL THEN 'missing' WHEN w.k IS NULL THEN 'extra' ELSE 'duplicate' END AS state FROM w FULL JOIN h ON w.k = h.k WHERE h.k IS NULL OR w.k IS NULL OR n > 1""",
)
def j03(spark, d):
    return J.completeness(table(spark, d, "checkpoints"), table(spark, d, "cost_ledger").filter("project_id is not null"), "project_id")


@query(
    "j04_largest_overlap",
    f"""WITH {_WORK}, i AS (SELECT a.event_no AS left_no, min(b.event_no) AS right_no FROM work a JOIN work b ON a.project_id = b.project_id AND a.scene_id = b.scene_id AND a.event_no <> b.event_no GROUP BY 1),
  p AS (SELECT a.event_no AS left_no, b.event_no AS right_no, least(a.w_end, b.w_end) - greatest(a.w_start, b.w_start) AS overlap FROM work a JOIN work b ON a.project_id = b.project_id AND a.event_no <> b.event_no AND a.w_start < b.w_end AND b.w_start < a.w_end WHERE a.event_no NOT IN (SELECT left_no FROM i))
  SELECT left_no, right_no, 'id' AS matched FROM i UNION ALL SELECT left_no, right_no, 'overlap' FROM (SELECT *, row_number() OVER (PARTITION BY left_no ORDER BY round(overlap, 6) DESC, right_no) AS rn FROM p) WHERE rn = 1""",
)
def j04(spark, d):
    w = _work(spark, d)
    seen = w.filter("scene_id is not null").select("project_id", "scene_id", "event_no").distinct()
    two = seen.withColumn("n", F.row_number().over(W.partitionBy("project_id", "scene_id").orderBy("event_no"))).filter("n <= 2").groupBy("project_id", "scene_id").agg(F.min("event_no").alias("one"), F.max("event_no").alias("two"), F.count("*").alias("n")).filter("n = 2")
    by_id = seen.join(two, ["project_id", "scene_id"]).groupBy(F.col("event_no").alias("left_no")).agg(F.min(F.when(F.col("event_no") != F.col("one"), F.col("one")).otherwise(F.col("two"))).alias("right_no"))
    left = w.join(by_id, F.col("event_no") == F.col("left_no"), "left_anti").select(F.col("event_no").alias("left_no"), "project_id", F.col("w_start").alias("a0"), F.col("w_end").alias("a1"))
    right = w.select(F.col("event_no").alias("right_no"), "project_id", F.col("w_start").alias("b0"), F.col("w_end").alias("b1"))
    pairs = J.interval_join(left, right, ("a0", "a1"), ("b0", "b1"), 60.0, ["project_id"]).filter("left_no <> right_no")
    best = pairs.withColumn("overlap", F.round(F.least("a1", "b1") - F.greatest("a0", "b0"), 6)).groupBy("left_no").agg(F.max(F.struct("overlap", (-F.col("right_no")).alias("n"))).alias("m"))
    return by_id.select("left_no", "right_no", F.lit("id").alias("matched")).unionByName(best.select("left_no", (-F.col("m.n")).alias("right_no"), F.lit("overlap").alias("matched")))


@query(
    "j05_point_in_interval",
    """WITH o AS (SELECT o_orderkey, o_totalprice AS p FROM orders), b AS (SELECT s_suppkey AS pos, s_acctbal AS lo, s_acctbal + 40 AS hi FROM supplier)
  SELECT o_orderkey, coalesce(min(pos), 0) AS section FROM o LEFT JOIN b ON p >= lo AND p <= hi GROUP BY 1""",
)
def j05(spark, d):
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("pos"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 40).alias("hi"))
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), (F.col("o_totalprice") + 1e-9).alias("p2"))
    wide = b.withColumn("lo2", F.col("lo") - 1e-3).withColumn("hi2", F.col("hi") + 1e-3)
    hit = J.interval_join(o, wide, ("p", "p2"), ("lo2", "hi2"), 100.0).filter("p >= lo and p <= hi").groupBy(F.col("o_orderkey").alias("k")).agg(F.min("pos").alias("pos"))
    return o.join(hit, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", F.coalesce("pos", F.lit(0)).alias("section"))


@query(
    "j06_nearest_with_tolerance",
    """WITH e AS (SELECT event_id, user_id, epoch(ts) AS t, event_type FROM events), m AS (SELECT p.event_id AS row_id, min(struct_pack(gap := round(abs(p.t - c.t), 6), o := c.event_id)) AS b FROM e p JOIN e c ON p.user_id = c.user_id AND c.event_type = 'click' AND abs(p.t - c.t) <= 3600 WHERE p.event_type = 'purchase' GROUP BY 1)
  SELECT event_id AS row_id, b.o AS click_id, b.gap AS gap FROM e LEFT JOIN m ON e.event_id = m.row_id WHERE event_type = 'purchase'""",
)
def j06(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "event_type")
    left = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("row_id"), "user_id", "t")
    right = e.filter("event_type = 'click'").select("user_id", F.col("t").alias("ct"), F.col("event_id").alias("click_id"))
    return J.nearest(left, right, "user_id", "t", "ct", "click_id", 3600.0).select("row_id", "click_id", F.round("gap", 6).alias("gap"))


@query(
    "j07_span_overlap_times",
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS q, l_partkey AS p, l_suppkey AS u FROM lineitem), w AS (SELECT *, sum(q) OVER (PARTITION BY k ORDER BY n, p, u, q ROWS UNBOUNDED PRECEDING) AS e FROM s)
  SELECT k, u.i AS unit, min(e - q) AS first_at, max(e) AS last_at, count(*) AS words FROM w JOIN (SELECT unnest(range(0, (SELECT ceil(max(e) / 40)::BIGINT FROM w))) AS i) u ON e - q < (u.i + 1) * 40 AND u.i * 40 < e GROUP BY 1, 2""",
)
def j07(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("u"))
    w = s.withColumn("e", F.sum("q").over(W.partitionBy("k").orderBy("n", "p", "u", "q").rowsBetween(W.unboundedPreceding, 0)))
    cells = F.sequence(F.floor((F.col("e") - F.col("q")) / 40), F.ceil(F.col("e") / 40) - 1)
    return w.withColumn("unit", F.explode(cells)).groupBy("k", "unit").agg(F.min(F.col("e") - F.col("q")).alias("first_at"), F.max("e").alias("last_at"), F.count("*").alias("words"))


@query(
    "j08_group_attach",
    """WITH e AS (SELECT DISTINCT project_id, scene_id, event_no, tool, event FROM event_log), p AS (SELECT project_id, arg_max(tool, event_no) AS tool FROM e WHERE scene_id IS NULL GROUP BY 1),
  g AS (SELECT project_id, scene_id, count(*) AS assets, arg_max(tool, event_no) FILTER (event = 'finish') AS shown, arg_max(tool, event_no) FILTER (event = 'error') AS missing FROM e WHERE scene_id IS NOT NULL GROUP BY 1, 2)
  SELECT project_id, scene_id, assets, coalesce(shown, missing, p.tool) AS active, CASE WHEN shown IS NOT NULL THEN 'shown' WHEN missing IS NOT NULL THEN 'missing' WHEN p.tool IS NOT NULL THEN 'project' END AS tier FROM g LEFT JOIN p USING (project_id)""",
)
def j08(spark, d):
    e = table(spark, d, "event_log").select("project_id", "scene_id", "event_no", "tool", "event").distinct()
    last = lambda cond: F.max_by("tool", F.when(cond & F.col("tool").isNotNull(), F.col("event_no")))
    g = e.filter("scene_id is not null").groupBy("project_id", "scene_id").agg(F.count("*").alias("assets"), last(F.col("event") == "finish").alias("shown"), last(F.col("event") == "error").alias("missing"))
    p = e.filter("scene_id is null").groupBy("project_id").agg(last(F.lit(True)).alias("tool"))
    tier = F.when(F.col("shown").isNotNull(), "shown").when(F.col("missing").isNotNull(), "missing").when(F.col("tool").isNotNull(), "project")
    return g.join(p, "project_id", "left").select("project_id", "scene_id", "assets", F.coalesce("shown", "missing", "tool").alias("active"), tier.alias("tier"))


@query(
    "j09_claimed_once",
    """WITH c AS (SELECT DISTINCT clip_id, source, unnest(regexp_extract_all(lower(source_tags), '[a-z]+')) AS tag FROM cache_manifest WHERE clip_id IS NOT NULL), b AS (SELECT source, min(clip_id) AS asset, row_number() OVER (ORDER BY source) - 1 AS pos FROM c WHERE source IS NOT NULL GROUP BY 1),
  t AS (SELECT DISTINCT b.pos, b.asset, c.tag FROM b JOIN c ON c.clip_id = b.asset), m AS (SELECT DISTINCT c.clip_id, t.pos FROM c JOIN t USING (tag) WHERE t.pos > 0 AND (c.clip_id = t.asset OR c.clip_id NOT IN (SELECT asset FROM b)))
  SELECT clip_id AS page, min(pos) AS beat FROM m GROUP BY 1""",
)
def j09(spark, d):
    c = table(spark, d, "cache_manifest").filter("clip_id is not null").select("clip_id", "source", F.explode(F.regexp_extract_all(F.lower("source_tags"), F.lit("[a-z]+"), F.lit(0))).alias("tag")).distinct()
    first = c.filter("source is not null").groupBy("source").agg(F.min("clip_id").alias("asset"))
    beats = numbered(first, "source", "place").select((F.col("place") - 1).alias("pos"), "asset")
    return J.claimed_once(c.select(F.col("clip_id").alias("page"), F.col("tag").alias("claim")).distinct(), beats, "pos", "asset", "page", "claim").select("page", F.col("pos").alias("beat"))


@query(
    "j10_containment",
    """WITH a AS (SELECT DISTINCT id, regexp_replace(title, '[ \\t\\n\\r\\f]+', '', 'g') AS t FROM aihot_24h WHERE title IS NOT NULL AND title <> ''), b AS (SELECT DISTINCT id, regexp_replace("originalTitle", '[ \\t\\n\\r\\f]+', '', 'g') AS o FROM aihot_24h WHERE "originalTitle" IS NOT NULL AND "originalTitle" <> '')
  SELECT a.id, count(*) AS pairs FROM a JOIN b USING (id) WHERE contains(t, o) OR contains(o, t) GROUP BY 1""",
)
def j10(spark, d):
    t = table(spark, d, "aihot_24h")
    blank = lambda c: F.regexp_replace(F.col(c), "[ \\t\\n\\r\\f]+", "")
    a = t.filter("title <> ''").select("id", blank("title").alias("t")).distinct()
    b = t.filter("originalTitle <> ''").select("id", blank("originalTitle").alias("o")).distinct()
    return J.containment(a, b, "id", "t", "o").groupBy("id").agg(F.count("*").alias("pairs"))


@query(
    "j11_theta_self_join",
    f"""WITH {COLORS_SQL}, z(kind, a0, a1, b0, b1) AS (VALUES {", ".join(map(str, CONFUSED))})
  SELECT DISTINCT x.k AS a, y.k AS b, kind FROM colors x JOIN colors y ON x.n = y.n AND x.k < y.k AND abs(x.l - y.l) <= 0.3 AND x.s >= 0.15 AND y.s >= 0.15 JOIN z ON (x.h BETWEEN a0 AND a1 AND y.h BETWEEN b0 AND b1) OR (y.h BETWEEN a0 AND a1 AND x.h BETWEEN b0 AND b1)""",
)
def j11(spark, d):
    c = colors(spark, d).select("k", "n", hsl(F.col("color")).alias("c")).filter("c.s >= 0.15").select("k", "n", F.col("c.h").alias("h"), F.col("c.l").alias("l"))
    pairs = J.confused_pairs(c, "n", "k", "h", CONFUSED).filter(F.abs(F.col("l_a") - F.col("l_b")) <= 0.3)
    return pairs.select(F.col("k_a").alias("a"), F.col("k_b").alias("b"), "kind").distinct()


@query(
    "j12_neighbour_compare",
    f"""WITH {ITEMS_SQL}, x AS (SELECT api_index, batch_no, category, lag(category) OVER w AS before, lead(category) OVER w AS after FROM items WINDOW w AS (PARTITION BY batch_no ORDER BY api_index))
  SELECT api_index, category FROM x WHERE category = before OR category = after""",
)
def j12(spark, d):
    w = W.partitionBy("batch_no").orderBy("api_index")
    x = items(spark, d).select("api_index", "batch_no", "category").withColumn("before", F.lag("category").over(w)).withColumn("after", F.lead("category").over(w))
    return x.filter("category = before or category = after").select("api_index", "category")


_ALIASES = [("sandbox", "sandbox"), ("sandbox", "沙箱"), ("benchmark", "benchmark"), ("benchmark", "基准"), ("drone", "drone"), ("drone", "无人机"), ("training", "training"), ("training", "训练")]


@query(
    "j13_dictionary_match",
    "WITH a(entity, alias) AS (VALUES " + ", ".join(f"('{e}', '{a}')" for e, a in _ALIASES) + r""")
  SELECT DISTINCT api_index, entity FROM aihot_24h JOIN a ON contains(lower(title), alias) AND (regexp_matches(alias, '[一-鿿]') OR regexp_matches(lower(title), '(^|[^a-z0-9_])' || alias || '($|[^a-z0-9_])'))""",
)
def j13(spark, d):
    a = spark.createDataFrame(_ALIASES, "entity string, alias string")
    return J.dictionary_match(table(spark, d, "aihot_24h").select("api_index", "title"), "title", a).select("api_index", "entity").distinct()


@query(
    "j14_version_trail",
    """WITH c AS (SELECT DISTINCT project_id, stage, status, timestamp FROM checkpoints WHERE timestamp IS NOT NULL)
  SELECT project_id, stage, status, timestamp, row_number() OVER (PARTITION BY project_id, stage ORDER BY timestamp, status NULLS FIRST) AS version, lag(status) OVER (PARTITION BY project_id, stage ORDER BY timestamp, status NULLS FIRST) AS was FROM c""",
)
def j14(spark, d):
    c = table(spark, d, "checkpoints").filter("timestamp is not null").select("project_id", "stage", "status", "timestamp").distinct()
    w = W.partitionBy("project_id", "stage").orderBy("timestamp", F.col("status").asc_nulls_first())
    return c.withColumn("version", F.row_number().over(w)).withColumn("was", F.lag("status").over(w))


_STAGES = ("research", "proposal", "idea", "script", "scene_plan", "assets", "edit", "compose", "publish")
_STAGES_SQL = "st(stage, pos) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(_STAGES)) + ")"


@query(
    "j15_predecessors_missing",
    f"""WITH {_STAGES_SQL}, c AS (SELECT project_id, stage, bool_or(status = 'completed' AND coalesce(human_approved, false)) AS ok FROM checkpoints WHERE stage IS NOT NULL GROUP BY 1, 2), x AS (SELECT c.*, st.pos FROM c JOIN st USING (stage))
  SELECT a.project_id, a.stage, count(b.stage) AS not_ready FROM x a LEFT JOIN x b ON a.project_id = b.project_id AND b.pos < a.pos AND NOT b.ok GROUP BY 1, 2""",
)
def j15(spark, d):
    st = spark.createDataFrame([(s, i) for i, s in enumerate(_STAGES)], "stage string, pos int")
    ok = (F.col("status") == "completed") & F.coalesce("human_approved", F.lit(False))
    c = table(spark, d, "checkpoints").filter("stage is not null").groupBy("project_id", "stage").agg(F.bool_or(ok).alias("ok")).join(F.broadcast(st), "stage")
    w = W.partitionBy("project_id").orderBy("pos").rangeBetween(W.unboundedPreceding, -1)
    return c.select("project_id", "stage", F.coalesce(F.count_if(~F.col("ok")).over(w), F.lit(0)).alias("not_ready"))


@query(
    "j16_against_first",
    """WITH e AS (SELECT DISTINCT project_id, event_no, tool, scene_id, depth FROM event_log), f AS (SELECT project_id, arg_min(struct_pack(tool := tool, scene_id := scene_id, depth := depth), event_no) AS f FROM e GROUP BY 1)
  SELECT event_no, concat_ws(',', CASE WHEN tool IS DISTINCT FROM f.f.tool THEN 'tool' END, CASE WHEN scene_id IS DISTINCT FROM f.f.scene_id THEN 'scene_id' END, CASE WHEN depth IS DISTINCT FROM f.f.depth THEN 'depth' END) AS differs FROM e JOIN f USING (project_id)
  WHERE tool IS DISTINCT FROM f.f.tool OR scene_id IS DISTINCT FROM f.f.scene_id OR depth IS DISTINCT FROM f.f.depth""",
)
def j16(spark, d):
    e = table(spark, d, "event_log").select("project_id", "event_no", "tool", "scene_id", "depth").distinct()
    return J.against_first(e, "project_id", "event_no", ["tool", "scene_id", "depth"]).select("event_no", "differs")


@query("u03_difference", "SELECT DISTINCT project_id FROM checkpoints EXCEPT SELECT project_id FROM cost_ledger")
def u03(spark, d):
    return table(spark, d, "checkpoints").select("project_id").exceptAll(table(spark, d, "cost_ledger").select("project_id")).distinct().join(table(spark, d, "cost_ledger").select("project_id").distinct(), "project_id", "left_anti")


@query("u04_intersection", "SELECT project_id FROM checkpoints INTERSECT SELECT project_id FROM cost_ledger")
def u04(spark, d):
    return table(spark, d, "checkpoints").select("project_id").intersect(table(spark, d, "cost_ledger").select("project_id"))


@query(
    "u04b_overlap_coefficient",
    """WITH a AS (SELECT DISTINCT project_id, tool FROM event_log WHERE tool IS NOT NULL), b AS (SELECT DISTINCT project_id, tool FROM cost_ledger WHERE tool IS NOT NULL), n AS (SELECT project_id, count(*) AS n FROM a GROUP BY 1), m AS (SELECT project_id, count(*) AS m FROM b GROUP BY 1), i AS (SELECT project_id, count(*) AS i FROM a JOIN b USING (project_id, tool) GROUP BY 1)
  SELECT n.project_id, round(coalesce(i, 0)::DOUBLE / least(n, m), 6) AS overlap FROM n JOIN m USING (project_id) LEFT JOIN i USING (project_id)""",
)
def u04b(spark, d):
    a = table(spark, d, "event_log").filter("tool is not null").groupBy("project_id").agg(F.collect_set("tool").alias("a"))
    b = table(spark, d, "cost_ledger").filter("tool is not null").groupBy("project_id").agg(F.collect_set("tool").alias("b"))
    return a.join(b, "project_id").select("project_id", F.round(F.size(F.array_intersect("a", "b")) / F.least(F.size("a"), F.size("b")), 6).alias("overlap"))


@query(
    "u05_numbering_complete",
    "SELECT project_id, count(*) = count(DISTINCT event_no) AND count(*) = max(event_no) - min(event_no) + 1 AS complete FROM event_log GROUP BY 1",
)
def u05(spark, d):
    return table(spark, d, "event_log").groupBy("project_id").agg(((F.count("*") == F.countDistinct("event_no")) & (F.count("*") == F.max("event_no") - F.min("event_no") + 1)).alias("complete"))


@query(
    "u06_idempotent_append",
    """WITH old AS (SELECT DISTINCT id, batch_no FROM aihot_24h WHERE batch_no <= 30), new AS (SELECT id, api_index, batch_no FROM aihot_24h WHERE batch_no > 30)
  SELECT id, api_index, batch_no FROM new WHERE id NOT IN (SELECT id FROM old WHERE id IS NOT NULL)""",
)
def u06(spark, d):
    t = table(spark, d, "aihot_24h").select("id", "api_index", "batch_no")
    return t.filter("batch_no > 30").filter("id is not null").join(t.filter("batch_no <= 30").select("id").distinct(), "id", "left_anti")


@query(
    "s08_last_wins_manifest",
    """SELECT clip_id, max(struct_pack(a := CASE WHEN isnan(last_access_at) THEN NULL ELSE last_access_at END, s := size_bytes)).s AS size_bytes FROM cache_manifest WHERE last_access_at IS NOT NULL AND NOT isnan(last_access_at) AND size_bytes IS NOT NULL GROUP BY 1""",
)
def s08(spark, d):
    c = table(spark, d, "cache_manifest").filter("last_access_at is not null and not isnan(last_access_at) and size_bytes is not null")
    return c.groupBy("clip_id").agg(F.max(F.struct("last_access_at", "size_bytes")).alias("m")).select("clip_id", F.col("m.size_bytes").alias("size_bytes"))


@query(
    "s10_coalesced_artifacts",
    """WITH c AS (SELECT DISTINCT project_id, map_extract(artifacts, 'script')[1] AS a FROM checkpoints WHERE stage = 'script'), l AS (SELECT project_id, max(operation) AS o FROM cost_ledger WHERE operation <> '' GROUP BY 1)
  SELECT p.project_id, coalesce(max(a), max(o), 'none') AS artifact FROM (SELECT DISTINCT project_id FROM checkpoints) p LEFT JOIN c USING (project_id) LEFT JOIN l USING (project_id) GROUP BY 1""",
)
def s10(spark, d):
    c = table(spark, d, "checkpoints")
    own = c.filter("stage = 'script'").groupBy("project_id").agg(F.max(F.col("artifacts").getItem("script")).alias("a"))
    led = table(spark, d, "cost_ledger").filter("operation <> ''").groupBy("project_id").agg(F.max("operation").alias("o"))
    return c.select("project_id").distinct().join(own, "project_id", "left").join(led, "project_id", "left").select("project_id", F.coalesce("a", "o", F.lit("none")).alias("artifact"))


@query(
    "f03_retrieval_filters",
    "SELECT vec_id FROM embeddings WHERE label = 3 AND vec_id NOT IN (SELECT s_suppkey FROM supplier) AND abs(embedding[1]) >= 0.05",
)
def f03(spark, d):
    e = table(spark, d, "embeddings").filter((F.col("label") == 3) & (F.abs(F.col("embedding")[0]) >= 0.05))
    return e.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("vec_id")), "vec_id", "left_anti").select("vec_id")
