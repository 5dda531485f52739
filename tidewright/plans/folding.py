"""Packing and expansion queries (survey P1-P5, U7, S15, S16, W20b)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import timefmt as D
from ..operators import folds
from ..registry import query, table
from .common import items


@query(
    "fold1_greedy_cues",
    """WITH RECURSIVE v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_type AS w, event_id::DOUBLE AS a, event_id + value AS z FROM events), r AS (SELECT user_id, rn, 1 AS cue, 1 AS n, length(w) + 1 AS chars FROM v WHERE rn = 1 UNION ALL
  SELECT v.user_id, v.rn, CASE WHEN n < 7 AND chars + length(w) <= 40 THEN cue ELSE cue + 1 END, CASE WHEN n < 7 AND chars + length(w) <= 40 THEN n + 1 ELSE 1 END, CASE WHEN n < 7 AND chars + length(w) <= 40 THEN chars ELSE 0 END + length(w) + 1 FROM r JOIN v ON v.user_id = r.user_id AND v.rn = r.rn + 1)
  SELECT user_id, cue, string_agg(w, ' ' ORDER BY rn) AS text, min(a) AS starts, arg_max(z, rn) AS ends FROM r JOIN v USING (user_id, rn) GROUP BY 1, 2""",
)
def fold1(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    c = folds.pack_cues(e, "user_id", ["event_id"], "event_type", 7, 40)  # a cue has seven words at most
    words = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    return c.groupBy("user_id", "cue").agg(F.array_join(F.transform(words, lambda x: x["event_type"]), " ").alias("text"), F.min("event_id").cast("double").alias("starts"), F.max_by(F.col("event_id") + F.col("value"), "event_id").alias("ends"))


@query("fold2_phrase_cues")
def fold2(spark, d):
    def cues(batches):
        for p in batches:
            got = [folds.phrase_cues(list(t)) for t in p["text"]]
            yield pd.DataFrame({"doc_id": p["doc_id"].repeat([len(g) for g in got]).to_numpy(), "cue": [i for g in got for i in range(len(g))], "phrase": [x for g in got for x in g]})

    return table(spark, d, "documents").filter("text is not null").select("doc_id", "text").mapInPandas(cues, "doc_id long, cue int, phrase string")


@query(
    "fold3_pages",
    """WITH RECURSIVE v AS (SELECT source, doc_id, n_chars // 100 AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents), r AS (SELECT source, doc_id, rn, 0 AS page, h AS used FROM v WHERE rn = 1 UNION ALL
  SELECT v.source, v.doc_id, v.rn, CASE WHEN used > 0 AND used + h > 120 THEN page + 1 ELSE page END, CASE WHEN used > 0 AND used + h > 120 THEN h ELSE used + h END FROM r JOIN v ON v.source IS NOT DISTINCT FROM r.source AND v.rn = r.rn + 1) SELECT source, doc_id, page FROM r""",
)
def fold3(spark, d):
    h = table(spark, d, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 100).alias("h"))
    return folds.pages(h, "source", ["doc_id"], "h", 120).select("source", "doc_id", "page")


@query("fold3b_grid_height", "WITH x AS (SELECT batch_no, (row_number() OVER (PARTITION BY batch_no ORDER BY api_index) - 1) // 2 AS r, length(title) AS h FROM aihot_24h WHERE title IS NOT NULL), m AS (SELECT batch_no, r, max(h) AS h FROM x GROUP BY 1, 2) SELECT batch_no, (sum(h) + 8 * (count(*) - 1))::BIGINT AS height FROM m GROUP BY 1")
def fold3b(spark, d):
    x = table(spark, d, "aihot_24h").filter("title is not null").groupBy("batch_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("api_index", F.length("title").alias("h")))), lambda s: s["h"]).alias("h"))
    return x.select("batch_no", folds.grid_height(F.col("h")).cast("long").alias("height"))


@query("fold5_timeline_expansion", "SELECT event_id, s AS step, CASE s WHEN 0 THEN event_id * 1.0 WHEN 1 THEN event_id + 0.25 * value ELSE event_id + value END AS at FROM events, (SELECT unnest([0, 1, 2]) AS s)")
def fold5(spark, d):
    e = table(spark, d, "events")
    steps = F.array(*(F.struct(F.lit(i).alias("step"), at.alias("at")) for i, at in enumerate((F.col("event_id") * F.lit(1.0), F.col("event_id") + 0.25 * F.col("value"), F.col("event_id") + F.col("value")))))
    return e.select("event_id", F.inline(steps))


_CLUSTERS = [["frame", "image", "picture"], ["map", "chart"], ["image", "school", "lesson"], ["beat", "music"]]


@query(
    "u07_synonym_closure",
    "WITH w0 AS (SELECT DISTINCT clip_id, regexp_extract_all(lower(source_tags), '[a-z]+') AS w FROM cache_manifest WHERE source_tags IS NOT NULL), "
    + ", ".join(f"w{i + 1} AS (SELECT clip_id, CASE WHEN list_has_any(w, {c}) THEN list_concat(w, {c}) ELSE w END AS w FROM w{i})" for i, c in enumerate(_CLUSTERS))
    + f" SELECT DISTINCT clip_id, array_to_string(list_sort(list_distinct(w)), ' ') AS tags FROM w{len(_CLUSTERS)}",
)
def u07(spark, d):
    t = table(spark, d, "cache_manifest").filter("source_tags is not null").select("clip_id", F.regexp_extract_all(F.lower("source_tags"), F.lit("[a-z]+"), F.lit(0)).alias("w")).distinct()
    return t.select("clip_id", F.array_join(F.array_sort(F.array_distinct(folds.closure(F.col("w"), _CLUSTERS))), " ").alias("tags")).distinct()


_STAMP = "lpad((X // 3600000)::VARCHAR, greatest(2, length((X // 3600000)::VARCHAR))::INT, '0') || ':' || lpad((X // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((X // 1000 % 60)::VARCHAR, 2, '0') || 'M' || lpad((X % 1000)::VARCHAR, 3, '0')"
_CUES_SQL = "WITH e AS (SELECT user_id, event_type, event_id * 1000 AS a, (event_id * 1000 + round(value * 100) * 10)::BIGINT AS z, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"


def _cues(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.col("event_id").cast("double").alias("a"), (F.col("event_id") + F.col("value")).alias("z"), "event_type")


@query("s15_subtitles", f"{_CUES_SQL} SELECT user_id, string_agg(n || chr(10) || {_STAMP.replace('X', 'a').replace('M', ',')} || ' --> ' || {_STAMP.replace('X', 'z').replace('M', ',')} || chr(10) || event_type, chr(10) || chr(10) ORDER BY n) AS srt FROM e GROUP BY 1")
def s15(spark, d):
    return folds.subtitles(_cues(spark, d), "user_id", "event_id", "a", "z", "event_type", "srt")


@query("s15b_captions", f"{_CUES_SQL} SELECT user_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_STAMP.replace('X', 'a').replace('M', '.')} || ' --> ' || {_STAMP.replace('X', 'z').replace('M', '.')} || chr(10) || event_type, chr(10) || chr(10) ORDER BY n) AS vtt FROM e GROUP BY 1")
def s15b(spark, d):
    return folds.subtitles(_cues(spark, d), "user_id", "event_id", "a", "z", "event_type", "vtt")


@query(
    "s16_chapter_lines",
    """WITH c AS (SELECT batch_no, coalesce(nullif(trim(category, ' '), ''), 'other') AS category, min(api_index) AS n FROM aihot_24h GROUP BY 1, 2)
  SELECT batch_no, string_agg(CASE WHEN n >= 3600 THEN (n // 3600) || ':' || lpad((n // 60 % 60)::VARCHAR, 2, '0') ELSE (n // 60)::VARCHAR END || ':' || lpad((n % 60)::VARCHAR, 2, '0') || ' ' || category, chr(10) ORDER BY n) AS chapters FROM c GROUP BY 1""",
)
def s16(spark, d):
    x = items(spark, d).groupBy("batch_no", "category").agg(F.min("api_index").alias("n"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "category"))), lambda s: F.concat(D.chapter_time(s["n"]), F.lit(" "), s["category"]))
    return x.groupBy("batch_no").agg(F.array_join(lines, "\n").alias("chapters"))