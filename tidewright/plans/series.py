"""Time-series, run and state queries (survey W6-W25, D11, P6, T12)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import series as S
from ..registry import query, table
from .common import ITEMS_SQL, items

_EVENTS = "e AS (SELECT event_id, user_id, event_type, value, epoch(ts) AS t FROM events)"


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query(
    "w06_longest_run",
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events), r AS (SELECT user_id, event_type, g, count(*) AS n FROM x GROUP BY 1, 2, 3)
  SELECT user_id, coalesce(max(n) FILTER (event_type <> 'error'), 0) AS longest FROM r GROUP BY 1""",
)
def w06(spark, d):
    return S.longest_run(table(spark, d, "events"), "user_id", "event_id", F.col("event_type"), ignore="error")


@query("w07_timeline_starts", "SELECT event_id, round(coalesce(sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 2) AS start FROM events")
def w07(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.col("value").cast("decimal(18,2)").alias("v"))
    return S.starts(e, "user_id", ["event_id"], F.col("v")).select("event_id", F.round(F.col("start").cast("double"), 2).alias("start"))


@query(
    "w08_category_changes",
    f"""WITH {ITEMS_SQL}, x AS (SELECT api_index, batch_no, category, lag(category) OVER w AS before, row_number() OVER w AS n FROM items WHERE selected WINDOW w AS (PARTITION BY batch_no ORDER BY api_index))
  SELECT api_index, category, before FROM x WHERE n = 1 OR category IS DISTINCT FROM before""",
)
def w08(spark, d):
    return S.changes(items(spark, d).filter("selected").select("api_index", "batch_no", "category"), "batch_no", "api_index", "category").select("api_index", "category", "before")


_ORDER = "CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END"


@query(
    "w09_regressions",
    f"""WITH x AS (SELECT user_id, {_ORDER} AS r, event_id FROM events WHERE {_ORDER} IS NOT NULL), y AS (SELECT user_id, r, lag(r) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM x)
  SELECT user_id, count(*) FILTER (r < b) AS regressions FROM y GROUP BY 1""",
)
def w09(spark, d):
    return S.regressions(table(spark, d, "events"), "user_id", "event_id", F.expr(_ORDER))


@query("w10_moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 4) AS smooth FROM (SELECT event_id, user_id, round(value * 100)::BIGINT AS value FROM events)")
def w10(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.round(F.col("value") * 100).cast("long").alias("value"))
    return S.moving_average(e, "user_id", "event_id", "value", 3).select("event_id", F.round("smooth", 4).alias("smooth"))


@query(
    "w11_smooth_or_still",
    """WITH e AS (SELECT o_custkey AS g, o_orderkey AS k, round(o_totalprice)::BIGINT AS v FROM orders), s AS (SELECT g, max(v) - min(v) < 0.5 * max(v) AS still, avg(v) AS mean FROM e GROUP BY 1)
  SELECT k, still, round(CASE WHEN still THEN mean ELSE avg(v) OVER (PARTITION BY g ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 3) AS path FROM e JOIN s USING (g)""",
)
def w11(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("long").alias("v"))
    return S.smooth_or_still(o, "g", "k", "v", 0.5, 2).select("k", "still", F.round("path", 3).alias("path"))


@query(
    "w12_filled_steps",
    f"""WITH {_EVENTS}, x AS (SELECT user_id, floor(t / 86400)::BIGINT AS s, avg(round(value * 100)::BIGINT) FILTER (value > 2) AS v FROM e GROUP BY 1, 2), g AS (SELECT user_id, unnest(range(min(s), max(s) + 1)) AS s FROM x GROUP BY 1)
  SELECT g.user_id, g.s AS step_no, round(coalesce(v, -120), 3) AS value, v IS NOT NULL AS active FROM g LEFT JOIN x ON g.user_id = x.user_id AND g.s = x.s""",
)
def w12(spark, d):
    e = _events(spark, d).select("user_id", "t", F.round(F.col("value") * 100).cast("long").alias("v100"))
    return S.filled_steps(e, "user_id", "t", "v100", 86400.0, 200, -120.0).withColumn("value", F.round("value", 3))


@query(
    "w13_first_active_and_peak",
    "SELECT user_id, min(event_id) FILTER (value > 5) AS first_active, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS peak FROM events GROUP BY 1",
)
def w13(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.min(F.when(F.col("value") > 5, F.col("event_id"))).alias("first_active"), F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("peak"))


@query(
    "w14_best_window",
    """WITH x AS (SELECT user_id, event_id, round(avg(round(value * 100)::BIGINT) OVER w, 6) AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), b AS (SELECT user_id, max(m) AS mean FROM x WHERE n = 5 GROUP BY 1)
  SELECT b.user_id, mean, min(event_id) AS at FROM x JOIN b ON x.user_id = b.user_id AND m = mean AND n = 5 GROUP BY 1, 2""",
)
def w14(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return S.best_window(e, "user_id", "event_id", "v", 5)


@query(
    "w15_monotone_cues",
    """WITH c AS (SELECT user_id, event_id, (event_id * 10)::BIGINT AS a, (event_id * 10 + round(value * 3))::BIGINT AS z FROM events), k AS (SELECT * FROM c WHERE z > a),
  h AS (SELECT user_id, event_id, greatest(a, coalesce(max(z) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a)) AS a, z FROM k)
  SELECT user_id, event_id, a, z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS cue FROM h WHERE z > a""",
)
def w15(spark, d):
    c = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 10).alias("a"), (F.col("event_id") * 10 + F.round(F.col("value") * 3)).cast("long").alias("z"))
    return S.monotone(c, "user_id", ["event_id"], "a", "z", F.max("z").over(W.partitionBy("user_id")))


@query("w16_thinned_changes", "WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events), r AS (SELECT user_id, min(t) AS kept_at FROM e GROUP BY 1 UNION ALL SELECT r.user_id, min(e.t) FROM r JOIN e ON e.user_id = r.user_id AND e.t - r.kept_at >= 86400 GROUP BY 1) SELECT * FROM r")
def w16(spark, d):
    return S.thinned(_events(spark, d).select("user_id", F.col("t").alias("kept_at")), "user_id", "kept_at", 86400.0)


@query(
    "w17_complement_of_silences",
    """WITH s AS (SELECT user_id, a, z, max(z) OVER (PARTITION BY user_id) AS total FROM (SELECT user_id, min(event_id) * 10.0 AS a, min(event_id) * 10.0 + 4 AS z FROM events GROUP BY user_id, event_id)), p AS (SELECT user_id, greatest(0, coalesce(max(z - 0.5) OVER (PARTITION BY user_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS b, least(a + 0.5, total) AS e FROM s
  UNION ALL SELECT user_id, max(z - 0.5), max(z) FROM s GROUP BY 1), k AS (SELECT user_id, b::DOUBLE AS b, e::DOUBLE AS e FROM p WHERE e - b >= 0.01), i AS (SELECT *, sum(CASE WHEN b - le >= 0.05 OR le IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY b) AS g FROM (SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY b) AS le FROM k))
  SELECT user_id, min(b) AS seg_start, arg_max(e, b) AS seg_end FROM i GROUP BY user_id, g""",
)
def w17(spark, d):
    s = table(spark, d, "events").select("user_id", (F.col("event_id") * 10.0).alias("a"), (F.col("event_id") * 10.0 + 4).alias("z"))
    total = F.max("z").over(W.partitionBy("user_id"))
    return S.complement(s, "user_id", "a", "z", total, 0.5, 0.01, 0.05)


@query("w18_latest_state", "SELECT project_id, scene_id, arg_max(event, event_no) = 'start' AS generating, max(event_no) AS at FROM (SELECT DISTINCT project_id, scene_id, event, event_no FROM event_log WHERE scene_id IS NOT NULL AND (depth IS NULL OR depth = 0)) GROUP BY 1, 2")
def w18(spark, d):
    e = table(spark, d, "event_log").filter("scene_id is not null and (depth is null or depth = 0)")
    return S.latest(e, ["project_id", "scene_id"], ["event_no"], ["event", "event_no"]).select("project_id", "scene_id", (F.col("event") == "start").alias("generating"), F.col("event_no").alias("at"))


_STAGES = ("research", "proposal", "idea", "script", "scene_plan", "assets", "edit", "compose", "publish")


@query(
    "w19_first_incomplete",
    "WITH st(stage, pos) AS (VALUES " + ", ".join(f"('{s}', {i})" for i, s in enumerate(_STAGES)) + """), c AS (SELECT project_id, stage, bool_or(status = 'completed') AS ok FROM checkpoints WHERE stage IS NOT NULL GROUP BY 1, 2)
  SELECT project_id, arg_min(stage, pos) FILTER (NOT ok) AS next_stage FROM c JOIN st USING (stage) GROUP BY 1""",
)
def w19(spark, d):
    st = spark.createDataFrame([(s, i) for i, s in enumerate(_STAGES)], "stage string, pos int")
    c = table(spark, d, "checkpoints").filter("stage is not null").groupBy("project_id", "stage").agg(F.bool_or(F.col("status") == "completed").alias("ok")).join(F.broadcast(st), "stage")
    return c.groupBy("project_id").agg(F.min_by(F.when(~F.col("ok"), F.col("stage")), F.when(~F.col("ok"), F.col("pos"))).alias("next_stage"))


@query(
    "w20_subsample",
    """WITH v AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS a FROM events GROUP BY 1), n AS (SELECT user_id, CASE WHEN len(a) <= 3 THEN a ELSE list_transform([0, 1, 2], lambda i: a[(floor(i * len(a) / 3) + 1)::INT]) END AS s FROM v)
  SELECT user_id, array_to_string(s, ',') AS picks FROM n""",
)
def w20(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    return e.select("user_id", F.array_join(S.subsample(F.col("a"), 3), ",").alias("picks"))


@query("w21_even_positions", "SELECT doc_id, i, round((i + 0.5) * n_chars / 4, 3) AS at FROM documents, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE n_chars > 0")
def w21(spark, d):
    t = table(spark, d, "documents").filter("n_chars > 0")
    return t.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("doc_id", "i", F.round((F.col("i") + 0.5) * F.col("n_chars") / 4, 3).alias("at"))


@query(
    "w22_envelope",
    """WITH RECURSIVE v AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS step, value FROM events WHERE value IS NOT NULL), r AS (SELECT user_id, step, 0.6::DOUBLE * value AS level FROM v WHERE step = 0 AND value > 0 UNION ALL
  SELECT v.user_id, v.step, r.level + CASE WHEN v.value > r.level THEN 0.6::DOUBLE ELSE 0.1::DOUBLE END * (v.value - r.level) FROM r JOIN v ON v.user_id = r.user_id AND v.step = r.step + 1) SELECT user_id, step, round(level, 6) AS level FROM r""",
)
def w22(spark, d):
    return S.envelope(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value", 0.6, 0.1).withColumn("level", F.round("level", 6))


@query(
    "w24_gain_envelope",
    """WITH s AS (SELECT user_id, event_id * 10.0 AS t FROM events), g AS (SELECT user_id, min(event_id) * 10.0 AS a, max(event_id) * 10.0 AS z FROM events GROUP BY 1)
  SELECT user_id, t::DOUBLE AS t, round(greatest(0, least(1, (t - a) / 1000, (z - t) / 2000)), 6)::DOUBLE AS gain FROM s JOIN g USING (user_id)""",
)
def w24(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("event_id") * 10.0).alias("t"))
    g = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("z"))
    gain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("a")) / 1000, (F.col("z") - F.col("t")) / 2000))
    return e.join(g, "user_id").select("user_id", "t", F.round(gain, 6).alias("gain"))


@query(
    "w25_section_balance",
    f"""WITH {_EVENTS}, s AS (SELECT user_id, floor(t / 432000)::BIGINT AS section, sqrt(sum((value * 100)::DECIMAL(18,2) * (value * 100)::DECIMAL(18,2))::DOUBLE / count(*)) AS rms FROM e GROUP BY 1, 2)
  SELECT user_id, section, round(greatest(-30, least(30, -50 - 20 * log10(nullif(rms, 0) / 32767))), 4) AS gain FROM s""",
)
def w25(spark, d):
    s = _events(spark, d).groupBy("user_id", F.floor(F.col("t") / 432000).alias("section")).agg(F.sqrt(F.sum((F.col("value") * 100).cast("decimal(18,2)") * (F.col("value") * 100).cast("decimal(18,2)")).cast("double") / F.count("*")).alias("rms"))
    return s.select("user_id", "section", F.round(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), -50 - 20 * F.log10(F.nullif(F.col("rms"), F.lit(0.0)) / 32767))), 4).alias("gain"))


@query(
    "d11_proportional_timing",
    """WITH w AS (SELECT user_id, event_id, length(event_type) AS w FROM events), x AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY event_id) AS c, sum(w) OVER (PARTITION BY user_id) AS total FROM w)
  SELECT event_id, round(60.0 * (c - w) / total, 6)::DOUBLE AS starts, round(60.0 * c / total, 6)::DOUBLE AS ends FROM x""",
)
def d11(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.length("event_type").alias("w"))
    total = e.groupBy("user_id").agg(F.sum("w").alias("total"))
    x = S.starts(e, "user_id", ["event_id"], F.col("w"), "c").join(total, "user_id")
    return x.select("event_id", F.round(60.0 * F.col("c") / F.col("total"), 6).alias("starts"), F.round(60.0 * (F.col("c") + F.col("w")) / F.col("total"), 6).alias("ends"))


@query(
    "fold6_caption_pages",
    """WITH x AS (SELECT user_id, event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = 'purchase', false)::INT AS brk FROM events), i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM x), p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, island ORDER BY event_id) - 1) // 4 AS page FROM i)
  SELECT user_id, island, page, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS words FROM p GROUP BY 1, 2, 3""",
)
def fold6(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id")
    x = table(spark, d, "events").select("user_id", "event_id", F.coalesce(F.lag("event_type").over(w) == "purchase", F.lit(False)).cast("int").alias("brk"))
    i = x.withColumn("island", F.sum("brk").over(w))
    p = i.withColumn("page", F.floor((F.row_number().over(W.partitionBy("user_id", "island").orderBy("event_id")) - 1) / 4))
    return p.groupBy("user_id", "island", "page").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("words"))


@query(
    "d06_stalled",
    """WITH l AS (SELECT project_id, max(epoch(ts::TIMESTAMPTZ)) AS last FROM event_log GROUP BY 1), n AS (SELECT max(last) AS now FROM l)
  SELECT project_id, now - last < 300 AS live, CASE WHEN now - last > 600 THEN floor((now - last) / 60)::BIGINT END AS stalled_minutes FROM l, n""",
)
def d06(spark, d):
    last = table(spark, d, "event_log").groupBy("project_id").agg(F.max(F.unix_timestamp(F.to_timestamp("ts"))).alias("last"))
    now = last.agg(F.max("last").alias("now"))
    idle = F.col("now") - F.col("last")
    return last.crossJoin(F.broadcast(now)).select("project_id", (idle < 300).alias("live"), F.when(idle > 600, F.floor(idle / 60)).alias("stalled_minutes"))
