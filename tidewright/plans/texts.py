"""Text, time and color queries (survey N1-N29, D1-D18, F1, F2, F10)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timefmt as D
from ..operators import ranking as R
from ..registry import query, table

_WS = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


def _docs(spark, d):
    return table(spark, d, "documents").filter("text is not null")


def _feed(spark, d):
    return table(spark, d, "aihot_24h")


@query("n01_collapsed", rf"SELECT api_index, trim(regexp_replace(title, '{_WS}+', ' ', 'g'), ' ') AS title FROM aihot_24h WHERE title IS NOT NULL")
def n01(spark, d):
    return _feed(spark, d).filter("title is not null").select("api_index", X.collapse(F.col("title")).alias("title"))


@query("n02_squeezed", rf"SELECT api_index, lower(regexp_replace(title, '{_WS}+', '', 'g')) AS title FROM aihot_24h WHERE title IS NOT NULL")
def n02(spark, d):
    return _feed(spark, d).filter("title is not null").select("api_index", X.squeezed(F.col("title")).alias("title"))


@query("n03_ungrouped")
def n03(spark, d):
    return _docs(spark, d).select("doc_id", X.ungrouped(F.col("text")).alias("text"))


@query("n04_visible_units", rf"SELECT api_index, length(regexp_replace(title, '{_WS}+', '', 'g')) - coalesce(list_sum(list_transform(regexp_extract_all(title, '(?:^|[^0-9])[0-9]{{1,3}}(?:[,，][0-9]{{3}})+(?:[^0-9]|$)'), lambda x: len(regexp_extract_all(x, '[0-9][,，][0-9]')))), 0)::BIGINT AS units FROM aihot_24h WHERE title IS NOT NULL")
def n04(spark, d):
    return _feed(spark, d).filter("title is not null").select("api_index", X.visible_units(F.col("title")).cast("long").alias("units"))


@query(
    "n05_sentences",
    "WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？!?；;]+[。！？!?；;]?')) AS s FROM documents) SELECT doc_id, count(*) AS sentences, max(length(trim(s, ' '))) AS longest FROM s WHERE trim(s, ' ') <> '' GROUP BY 1",
)
def n05(spark, d):
    s = _docs(spark, d).select("doc_id", X.sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return s.select("doc_id", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query("n06_caption_units")
def n06(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(X.caption_units_udf(X.collapse(F.col("text")))).alias("unit_no", "unit"))


@query("n08_spoken_rewrites")
def n08(spark, d):
    x = _feed(spark, d).filter("title is not null").select("api_index", X.rewritten_udf("title").alias("r"))
    return x.select("api_index", F.col("r.spoken").alias("spoken"), F.inline_outer("r.rewrites"))


@query(
    "n09_unsupported_tokens",
    """WITH t AS (SELECT api_index, list_distinct(list_concat(regexp_extract_all(title, '[A-Za-z][A-Za-z0-9]*'), regexp_extract_all(title, '[0-9]+(?:\\.[0-9]+)?[%KMB]?'))) AS a, list_concat(regexp_extract_all("originalTitle", '[A-Za-z][A-Za-z0-9]*'), regexp_extract_all("originalTitle", '[0-9]+(?:\\.[0-9]+)?[%KMB]?')) AS b FROM aihot_24h WHERE title IS NOT NULL AND "originalTitle" IS NOT NULL)
  SELECT api_index, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS unsupported FROM t""".replace("\\\\", "\\"),
)
def n09(spark, d):
    t = _feed(spark, d).filter("title is not null and originalTitle is not null")
    return t.select("api_index", F.array_join(X.unsupported(F.col("title"), F.col("originalTitle")), " ").alias("unsupported"))


@query(
    "n10_copied",
    rf"""WITH c AS (SELECT api_index, regexp_replace(title, '({_WS}|[\p{{P}}])+', '', 'g') AS t, regexp_replace(summary, '({_WS}|[\p{{P}}])+', '', 'g') AS s FROM aihot_24h WHERE title IS NOT NULL AND summary IS NOT NULL)
  SELECT api_index, t = s OR (length(t) >= 18 AND contains(s, t)) AS copied FROM c""",
)
def n10(spark, d):
    t = _feed(spark, d).filter("title is not null and summary is not null")
    return t.select("api_index", X.copied(F.col("title"), F.col("summary")).alias("copied"))


@query(
    "n11_missing_tokens",
    """SELECT api_index, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all("originalTitle", '[A-Z][a-z]{3,}'), lambda w: NOT regexp_matches(title, '(^|[^A-Za-z0-9])' || w || '($|[^A-Za-z0-9])', 'i')))), ' ') AS missing
  FROM aihot_24h WHERE title IS NOT NULL AND "originalTitle" IS NOT NULL""",
)
def n11(spark, d):
    t = _feed(spark, d).filter("title is not null and originalTitle is not null")
    names = F.regexp_extract_all("originalTitle", F.lit("[A-Z][a-z]{3,}"), F.lit(0))
    return t.select("api_index", F.array_join(X.missing_tokens(names, F.col("title")), " ").alias("missing"))


@query(
    "n12_fragments",
    """WITH p AS (SELECT api_index, list_concat([trim(coalesce(title, ''), ' ')], list_filter(list_transform(coalesce(regexp_extract_all(summary, '[^。！？!?；;]+[。！？!?；;]?'), []), lambda x: trim(x, ' ')), lambda x: x <> '')) AS p FROM aihot_24h),
  k AS (SELECT api_index, p, list_transform(p, lambda x: replace(regexp_replace(x, '[。！？!?；;\\s]+$', ''), ' ', '')) AS k FROM p), o AS (SELECT api_index, list_filter(p, lambda x, i: k[i] <> '' AND list_position(k, k[i]) = i) AS o FROM k),
  n AS (SELECT api_index, o, len(list_filter(range(1, len(o) + 1), lambda i: list_sum(list_transform(o[1:i], lambda x: length(x))) + i - 1 <= 155)) AS n FROM o)
  SELECT api_index, (i - 1)::INT AS place, o[i] AS fragment FROM n, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= len(o) AND i <= greatest(1, n)""",
)
def n12(spark, d):
    return _feed(spark, d).select("api_index", F.posexplode(X.fragments(F.col("title"), F.col("summary"))).alias("place", "fragment"))


@query(
    "n13_clauses",
    """WITH p AS (SELECT api_index, list_filter(list_transform(string_split_regex(summary, '[，,。；;]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS a FROM aihot_24h WHERE summary IS NOT NULL), q AS (SELECT api_index, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM p)
  SELECT api_index, array_to_string(list_concat(list_filter(a, lambda x: regexp_matches(x, '[0-9]')), list_filter(a, lambda x: NOT regexp_matches(x, '[0-9]')))[1:5], '|') AS clauses FROM q""",
)
def n13(spark, d):
    return _feed(spark, d).filter("summary is not null").select("api_index", F.array_join(X.clauses(F.col("summary")), "|").alias("clauses"))


@query(
    "n14_unique_labels",
    """WITH b AS (SELECT batch_no, api_index, left(coalesce(nullif(regexp_extract(title, '[A-Za-z][A-Za-z0-9.+-]*|[一-鿿]+'), ''), nullif(trim(title, ' '), ''), 'item'), 16) AS base FROM aihot_24h),
  r AS (SELECT *, row_number() OVER (PARTITION BY batch_no, base ORDER BY api_index) AS n FROM b), s AS (SELECT *, CASE WHEN n > 1 THEN row_number() OVER (PARTITION BY batch_no, left(base, 10), n > 1 ORDER BY api_index) END AS again FROM r)
  SELECT api_index, CASE WHEN n = 1 THEN base ELSE left(base, 10) || ' · ' || (again + 1) END AS label FROM s""",
)
def n14(spark, d):
    b = _feed(spark, d).select("batch_no", "api_index", X.label_base(F.col("title")).alias("base"))
    return R.unique_labels(b, "batch_no", "base", "api_index").select("api_index", "label")


@query("n15_tokens", """WITH t AS (SELECT unnest(regexp_extract_all(lower("originalTitle"), '[a-z0-9](?:[a-z0-9+._-]*[a-z0-9])?')) AS token FROM aihot_24h) SELECT token, count(*) AS n FROM t GROUP BY 1""")
def n15(spark, d):
    return _feed(spark, d).select(F.explode(X.tokens(F.col("originalTitle"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("n16_transcript_words", """WITH w AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(lower(text), '[^a-z0-9''\\- ]', ' ', 'g'), ' +')) AS w FROM documents WHERE doc_kind = 'transcript') SELECT doc_id, count(*) AS words, count(DISTINCT w) AS distinct_words FROM w WHERE w <> '' GROUP BY 1""")
def n16(spark, d):
    w = table(spark, d, "documents").filter("doc_kind = 'transcript' and text is not null").select("doc_id", X.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"))


@query(
    "n17_corrections",
    """SELECT api_index, array_to_string(list_transform(string_split("originalTitle", ' '), lambda w: coalesce(CASE lower(rtrim(w, '.,!?;:')) WHEN 'releases' THEN 'ships' WHEN 'updates' THEN 'renews' WHEN 'repository' THEN 'repo' END || substr(w, length(rtrim(w, '.,!?;:')) + 1), w)), ' ') AS title
  FROM aihot_24h WHERE "originalTitle" IS NOT NULL""",
)
def n17(spark, d):
    return _feed(spark, d).filter("originalTitle is not null").select("api_index", X.corrected(F.col("originalTitle"), {"releases": "ships", "updates": "renews", "repository": "repo"}).alias("title"))


@query(
    "n18_tags_flattened",
    "WITH t AS (SELECT DISTINCT clip_id, unnest(string_split_regex(lower(source_tags), '[,;|/ ]+')) AS tag FROM cache_manifest) SELECT tag, count(*) AS clips FROM t WHERE tag <> '' GROUP BY 1",
)
def n18(spark, d):
    t = table(spark, d, "cache_manifest").select("clip_id", F.explode(F.split(F.lower("source_tags"), "[,;|/ ]+")).alias("tag")).distinct()
    return t.filter("tag <> ''").groupBy("tag").agg(F.count("*").alias("clips"))


@query(
    "n18b_slugs_and_years",
    """SELECT DISTINCT source_url, array_to_string(list_filter(string_split_regex(lower(regexp_extract(rtrim(source_url, '/'), '([^/]*)$', 1)), '[-_.?=&]+'), lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9]+$')), ' ') AS tags,
  TRY_CAST(nullif(regexp_extract(source_url, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1), '') AS INTEGER) AS year, CASE WHEN contains(lower(license), 'cc0') OR contains(lower(license), 'public') THEN 'public' WHEN contains(lower(license), 'cc') THEN 'attribution' WHEN license IS NULL OR trim(license, ' ') = '' THEN 'unknown' ELSE 'other' END AS license_class FROM cache_manifest WHERE source_url IS NOT NULL""",
)
def n18b(spark, d):
    t = table(spark, d, "cache_manifest").filter("source_url is not null")
    return t.select("source_url", F.array_join(X.slug_tags(F.col("source_url")), " ").alias("tags"), X.year_token(F.col("source_url")).alias("year"), X.license_class(F.col("license")).alias("license_class")).distinct()


_PHRASES = ["in most regions", "according to the team", "本条由编辑部整理", "据公告"]


@query("n19_generic_phrases", "SELECT api_index, " + " OR ".join(f"contains(lower(summary), '{p}')" for p in _PHRASES) + " AS generic FROM aihot_24h WHERE summary IS NOT NULL")
def n19(spark, d):
    return _feed(spark, d).filter("summary is not null").select("api_index", X.has_phrase(F.col("summary"), _PHRASES).alias("generic"))


@query("n20_width_units", rf"WITH b AS (SELECT api_index, regexp_replace(title, '{_WS}+', '', 'g') AS b FROM aihot_24h WHERE title IS NOT NULL), w AS (SELECT api_index, length(b) AS n, length(regexp_replace(b, '[^\x{{2E80}}-\x{{10FFFF}}]', '', 'g')) AS w FROM b) SELECT api_index, round(w + 0.56 * (n - w), 4)::DOUBLE AS units FROM w")
def n20(spark, d):
    return _feed(spark, d).filter("title is not null").select("api_index", F.round(X.width_units(F.col("title")), 4).alias("units"))


@query("n21_layered_text", """SELECT api_index, concat_ws('. ', CASE WHEN trim(category, ' ') <> '' THEN category END, CASE WHEN trim("originalTitle", ' ') <> '' THEN "originalTitle" END, CASE WHEN trim(reason, ' ') <> '' THEN reason END) AS prompt FROM aihot_24h""")
def n21(spark, d):
    return _feed(spark, d).select("api_index", X.layered(F.col("category"), F.col("originalTitle"), F.col("reason")).alias("prompt"))


@query("n22_plain_dashes", "SELECT doc_id, translate(text, '‐‑‒–—―−', '-------') AS text FROM documents WHERE text IS NOT NULL")
def n22(spark, d):
    return _docs(spark, d).select("doc_id", X.plain_dashes(F.col("text")).alias("text"))


# Fragments of addresses and the platform they name, in the order in which they are asked.
_PLATFORMS = [("youtube.com/shorts", "shorts"), ("youtu.be+/shorts", "shorts"), ("youtube.com", "youtube"), ("youtu.be", "youtube"), ("instagram.com", "instagram"), ("tiktok.com", "tiktok"), ("vimeo.com", "vimeo"), ("twitter.com", "twitter"), ("x.com", "twitter")]
#: Addresses that the tables don't have, beside those they have.
_VIDEO_SQL = "u AS (SELECT api_index, links.original AS url FROM aihot_24h WHERE links.original IS NOT NULL UNION ALL SELECT -api_index - 1, ['https://www.youtube.com/shorts/', 'https://youtu.be/', 'https://www.youtube.com/watch?list=a&v=', 'https://www.youtube.com/embed/', 'https://VIMEO.com/', 'https://netflix.com/', 'https://tiktok.com/@', ''][(api_index % 8 + 1)::INT] || left(md5(api_index::VARCHAR), 11) FROM aihot_24h)"


def _video_links(spark, d):
    t = _feed(spark, d)
    heads = F.array(*map(F.lit, ("https://www.youtube.com/shorts/", "https://youtu.be/", "https://www.youtube.com/watch?list=a&v=", "https://www.youtube.com/embed/", "https://VIMEO.com/", "https://netflix.com/", "https://tiktok.com/@", "")))
    made = t.select((-F.col("api_index") - 1).alias("api_index"), F.concat(F.get(heads, (F.col("api_index") % 8).cast("int")), F.left(F.md5(F.col("api_index").cast("string").cast("binary")), F.lit(11))).alias("url"))
    return t.filter("links.original is not null").select("api_index", F.col("links.original").alias("url")).unionByName(made)


@query("n24_platforms", f"WITH {_VIDEO_SQL} SELECT api_index, CASE " + " ".join("WHEN " + " AND ".join(f"contains(lower(url), '{x}')" for x in f.split("+")) + f" THEN '{n}'" for f, n in _PLATFORMS) + " ELSE 'other_url' END AS platform FROM u")
def n24(spark, d):
    return _video_links(spark, d).select("api_index", X.ordered_case(F.col("url"), _PLATFORMS, "other_url").alias("platform"))


@query(
    "n25_ids_of_addresses",
    f"WITH {_VIDEO_SQL} SELECT api_index, CASE WHEN regexp_full_match(url, '[A-Za-z0-9_-]{{11}}') THEN url ELSE coalesce(nullif(regexp_extract(url, '(?:youtube\\.com/watch\\?.*v=|youtu\\.be/|youtube\\.com/embed/|youtube\\.com/shorts/)([A-Za-z0-9_-]{{11}})', 1), ''), trim(url, ' ')) END AS video_id FROM u",
)
def n25(spark, d):
    return _video_links(spark, d).select("api_index", X.video_id(F.col("url")).alias("video_id"))


@query(
    "n23_addresses_and_markup",
    """SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, 'https?://[^\\s]+', '', 'g'), '\\s+', ' ', 'g'), ' ')) AS clean_chars, contains(lower(text), '<script') OR contains(lower(text), 'javascript:') AS markup,
  source IS NULL OR starts_with(source, '/') OR list_contains(string_split(source, '/'), '..') AS escapes FROM documents WHERE text IS NOT NULL""".replace("\\\\", "\\"),
)
def n23(spark, d):
    t = _docs(spark, d)
    return t.select("doc_id", F.length(X.without_addresses(F.col("text"))).cast("long").alias("clean_chars"), X.has_markup(F.col("text")).alias("markup"), (F.col("source").isNull() | X.escapes(F.col("source"))).alias("escapes"))


@query("n26_fallback_lookup", "SELECT api_index, coalesce(CASE lower(trim(category, ' ')) WHEN 'paper' THEN 'serif' WHEN 'tip' THEN 'mono' END, CASE WHEN contains(lower(category), 'ai') THEN 'sans' END, 'default') AS family FROM aihot_24h")
def n26(spark, d):
    dim = spark.createDataFrame([("paper", "serif"), ("tip", "mono")], "known string, family string")
    x = _feed(spark, d).select("api_index", "category").join(F.broadcast(dim), F.lower(F.trim("category")) == F.col("known"), "left")
    return x.select("api_index", F.coalesce("family", F.when(F.lower("category").contains("ai"), F.lit("sans")), F.lit("default")).alias("family"))


@query(
    "n27_search_terms",
    """WITH t AS (SELECT api_index, list_filter(regexp_extract_all(lower("originalTitle"), '[a-z0-9](?:[a-z0-9+._-]*[a-z0-9])?'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'with', 'how')) AS w FROM aihot_24h WHERE "originalTitle" IS NOT NULL),
  x AS (SELECT api_index, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM t), p AS (SELECT *, row_number() OVER (PARTITION BY api_index ORDER BY length(w) DESC, i) AS r FROM x)
  SELECT t.api_index, coalesce(string_agg(p.w, ' ' ORDER BY r) FILTER (r <= 3), '') AS terms, coalesce(string_agg(p.w, ' ' ORDER BY r) FILTER (r <= 2), '') AS fewer FROM t LEFT JOIN p USING (api_index) GROUP BY t.api_index""",
)
def n27(spark, d):
    stop = ["the", "and", "with", "how"]
    return _feed(spark, d).filter("originalTitle is not null").select("api_index", *(F.array_join(X.search_terms(F.col("originalTitle"), stop, n), " ").alias(a) for n, a in ((3, "terms"), (2, "fewer"))))


@query("n28_event_keys", "SELECT api_index, id || '-' || left(sha1(coalesce(title, '')), 10) AS event_key FROM aihot_24h")
def n28(spark, d):
    return _feed(spark, d).select("api_index", F.concat("id", F.lit("-"), F.left(F.sha1(F.coalesce("title", F.lit("")).cast("binary")), F.lit(10))).alias("event_key"))


@query(
    "n28b_scaffolds",
    """WITH s AS (SELECT api_index, list_filter(list_transform(coalesce(regexp_extract_all(summary, '[^。！？!?；;]+[。！？!?；;]?'), []), lambda x: trim(x, ' ')), lambda x: x <> '') AS s, coalesce(title, '') || ' ' || coalesce(summary, '') AS t FROM aihot_24h)
  SELECT api_index, s[1] AS lead, s[2] AS support, nullif(regexp_extract(t, '[0-9]+(?:\\.[0-9]+)?[%KMB]?', 0), '') AS metric, CASE WHEN len(s) >= 4 THEN 'dense' WHEN len(s) >= 2 THEN 'normal' ELSE 'light' END AS density FROM s""".replace("\\\\", "\\"),
)
def n28b(spark, d):
    t = _feed(spark, d).select("api_index", F.coalesce(X.sentences(F.col("summary")), F.array().cast("array<string>")).alias("s"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("summary", F.lit(""))).alias("t"))
    density = F.when(F.size("s") >= 4, "dense").when(F.size("s") >= 2, "normal").otherwise("light")
    return t.select("api_index", F.get("s", F.lit(0)).alias("lead"), F.get("s", F.lit(1)).alias("support"), F.nullif(F.regexp_extract("t", r"[0-9]+(?:\.[0-9]+)?[%KMB]?", 0), F.lit("")).alias("metric"), density.alias("density"))


@query("n29_units_round_trip")
def n29(spark, d):
    u = _docs(spark, d).select("doc_id", "text").withColumn("clean", X.collapse(F.col("text"))).select("doc_id", "clean", X.caption_units_udf("clean").alias("units"))
    return u.select("doc_id", F.size("units").alias("units"), (X.squeezed(F.array_join("units", "")) == X.squeezed(F.col("clean"))).alias("whole"))


@query("d01_subtitle_times", "WITH s AS (SELECT event_id, (round(value * 100))::BIGINT * 10 + event_id * 1000 AS ms FROM events) SELECT event_id, CASE WHEN ms < 36000000 THEN '0' ELSE '' END || (ms // 3600000) || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS stamp FROM s WHERE ms IS NOT NULL")
def d01(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.round(F.col("value") * 100).cast("long") * 10 + F.col("event_id") * 1000) / 1000).alias("s"))
    return e.filter("s is not null").select("event_id", D.subtitle_time(F.col("s")).alias("stamp"))


@query("d02_chapter_times", "SELECT DISTINCT n_chars, CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || ':' || lpad((n_chars // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') ELSE (n_chars // 60) || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') END AS chapter FROM documents")
def d02(spark, d):
    return table(spark, d, "documents").select("n_chars").distinct().select("n_chars", D.chapter_time(F.col("n_chars")).alias("chapter"))


@query("d03_clock_times", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[([0-9]+:[0-9]+)\\]', 1)) AS c FROM documents) SELECT doc_id, max(split_part(c, ':', 1)::DOUBLE * 60 + split_part(c, ':', 2)::DOUBLE) AS last_s FROM t GROUP BY 1")
def d03(spark, d):
    t = _docs(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[([0-9]+:[0-9]+)\]"), F.lit(1))).alias("c"))
    return t.groupBy("doc_id").agg(F.max(D.parse_clock(F.col("c"))).alias("last_s"))


@query("d04_rates", "SELECT p_partkey, round(p_retailprice / nullif(p_size, 0), 6) AS rate FROM part")
def d04(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", F.round(D.parse_rate(F.concat(F.col("p_retailprice").cast("string"), F.lit("/"), F.col("p_size").cast("string"))), 6).alias("rate"))


@query("d09_contrast", "WITH c AS (SELECT s_suppkey AS k, (s_suppkey * 37) % 256 AS r, (s_suppkey * 91) % 256 AS g, (s_suppkey * 53) % 256 AS b FROM supplier), l AS (SELECT k, 0.2126 * (CASE WHEN r / 255.0::DOUBLE <= 0.03928 THEN r / 255.0::DOUBLE / 12.92 ELSE pow((r / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END) + 0.7152 * (CASE WHEN g / 255.0::DOUBLE <= 0.03928 THEN g / 255.0::DOUBLE / 12.92 ELSE pow((g / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END) + 0.0722 * (CASE WHEN b / 255.0::DOUBLE <= 0.03928 THEN b / 255.0::DOUBLE / 12.92 ELSE pow((b / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END) AS l FROM c) SELECT k, round(1.05 / (l + 0.05), 5) AS on_white FROM l")
def d09(spark, d):
    s = F.col("s_suppkey")
    color = F.format_string("#%02x%02x%02x", (s * 37) % 256, (s * 91) % 256, (s * 53) % 256)
    return table(spark, d, "supplier").select(s.alias("k"), F.round(D.contrast(F.lit("#ffffff"), color), 5).alias("on_white"))


@query("d10_gain", "SELECT event_id, round(pow(10, greatest(-30, least(30, value - 20)) / 20), 6) AS gain FROM events")
def d10(spark, d):
    return table(spark, d, "events").select("event_id", F.round(D.gain(F.col("value") - 20), 6).alias("gain"))


@query("d14_nested_json", "SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, -1) AS k FROM events")
def d14(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(-1)).alias("k"))


@query("d16_size_ladder", "SELECT doc_kind, CASE WHEN n_chars = 0 THEN 'none' WHEN n_chars < 200 THEN 'line' WHEN n_chars < 2000 THEN 'page' ELSE 'long' END AS ladder, count(*) AS n FROM documents GROUP BY 1, 2")
def d16(spark, d):
    ladder = F.when(F.col("n_chars") == 0, "none").when(F.col("n_chars") < 200, "line").when(F.col("n_chars") < 2000, "page").otherwise("long")
    return table(spark, d, "documents").groupBy("doc_kind", ladder.alias("ladder")).agg(F.count("*").alias("n"))


@query("f01_flat_projection", """SELECT api_index, nullif(trim(source.name, ' '), '') AS source_name, nullif(trim(links.original, ' '), '') AS url, nullif(trim(title, ' '), '') IS NULL AS without_title FROM aihot_24h""")
def f01(spark, d):
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return _feed(spark, d).select("api_index", clean("source.name").alias("source_name"), clean("links.original").alias("url"), clean("title").isNull().alias("without_title"))


@query("f02_merged_metadata", "SELECT a.api_index, a.id, b.etag, b.page.count AS page_count FROM aihot_24h a LEFT JOIN feed_batches b USING (batch_no)")
def f02(spark, d):
    b = table(spark, d, "feed_batches").select("batch_no", "etag", F.col("page.count").cast("long").alias("page_count"))
    return _feed(spark, d).select("api_index", "id", "batch_no").join(b, "batch_no", "left").select("api_index", "id", "etag", "page_count")


@query("f10_hosts", "SELECT lower(regexp_extract(links.original, '^[A-Za-z]+://([^/:?#]*)', 1)) AS host, count(*) AS n FROM aihot_24h WHERE links.original IS NOT NULL GROUP BY 1")
def f10(spark, d):
    return _feed(spark, d).filter("links.original is not null").groupBy(X.host(F.col("links.original")).alias("host")).agg(F.count("*").alias("n"))


@query("f09_prefix_filter", "SELECT event_no, tool FROM event_log WHERE starts_with(tool, 'image') OR starts_with(tool, 'audio')")
def f09(spark, d):
    return table(spark, d, "event_log").filter(F.col("tool").startswith("image") | F.col("tool").startswith("audio")).select("event_no", "tool")


@query("d07_lookback_days", "SELECT o_orderdate::DATE - n AS day, count(*) AS orders FROM orders, (SELECT unnest(range(1, 8))::INT AS n) GROUP BY 1")
def d07(spark, d):
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count("*").alias("c"))
    return days.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: F.date_sub("d", n))).alias("day"), "c").groupBy("day").agg(F.sum("c").alias("orders"))


@query("w02b_ranks_over_time", "SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r, dense_rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS dr FROM events")
def w02b(spark, d):
    w = W.partitionBy("user_id").orderBy(F.col("value").desc())
    return table(spark, d, "events").select("event_id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"))


@query("d05_ticks_and_bounds", "WITH w AS (SELECT user_id, event_id, (event_id * 7919 % 100000) * 100000 AS ticks, round(value * 10000000)::BIGINT AS d FROM events), u AS (SELECT *, ticks < max(ticks) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS back FROM w WHERE d > 0) SELECT event_id, ticks / 10000000.0::DOUBLE AS starts, (ticks + d) / 10000000.0::DOUBLE AS ends, coalesce(back, false) AS back FROM u")
def d05(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 7919 % 100000 * 100000).alias("ticks"), F.round(F.col("value") * 10000000).cast("long").alias("d")).filter("d > 0")
    before = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    return e.select("event_id", D.ticks(F.col("ticks")).alias("starts"), D.ticks(F.col("ticks") + F.col("d")).alias("ends"), F.coalesce(F.col("ticks") < F.max("ticks").over(before), F.lit(False)).alias("back"))


@query("d08_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, round_even((l_quantity / 2)::DECIMAL(12, 1), 0)::DOUBLE AS halves FROM lineitem")
def d08(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", D.half_even(F.col("l_quantity") / 2, 0).alias("halves"))


@query("d12_step_durations", "SELECT event_id, round(CASE event_type WHEN 'click' THEN ceil(length(props) * 0.035 * 30) / 30 + 0.3 WHEN 'view' THEN greatest(2, ceil(0.08 * 30)) / 30 + 0.15 WHEN 'purchase' THEN value ELSE 0 END, 6)::DOUBLE AS seconds FROM events")
def d12(spark, d):
    kind = F.when(F.col("event_type") == "click", "cmd").when(F.col("event_type") == "view", "out").when(F.col("event_type") == "purchase", "pause").otherwise("pill")
    return table(spark, d, "events").select("event_id", F.round(D.step_seconds(kind, F.length("props"), F.col("value")), 6).alias("seconds"))


@query("d17_layouts", "SELECT api_index, CASE WHEN length(summary) >= 120 AND regexp_matches(title, '[0-9]') THEN 'metric' WHEN length(summary) >= 120 THEN 'dense' WHEN coalesce(trim(summary, ' '), '') = '' THEN 'title' ELSE 'card' END AS layout, ['a', 'b', 'c'][(api_index % 3 + 1)::INT] AS variant FROM aihot_24h")
def d17(spark, d):
    long = F.length("summary") >= 120
    layout = F.when(long & F.col("title").rlike("[0-9]"), "metric").when(long, "dense").when(F.coalesce(F.trim("summary"), F.lit("")) == "", "title").otherwise("card")
    return _feed(spark, d).select("api_index", layout.alias("layout"), F.get(F.array(*map(F.lit, "abc")), (F.col("api_index") % 3).cast("int")).alias("variant"))


@query("d18_xfade_offsets", "SELECT event_id, round(greatest(0, value - 1.5), 3)::DOUBLE AS at FROM events")
def d18(spark, d):
    return table(spark, d, "events").select("event_id", D.xfade_offset(F.col("value"), 1.5).alias("at"))


COLORS_SQL = """c AS (SELECT s_suppkey AS k, s_nationkey AS n, (s_suppkey * 37) % 256 AS ri, (s_suppkey * 91) % 256 AS gi, (s_suppkey * 53) % 256 AS bi FROM supplier), f AS (SELECT *, ri / 255.0::DOUBLE AS r, gi / 255.0::DOUBLE AS g, bi / 255.0::DOUBLE AS b FROM c),
  m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d, (greatest(r, g, b) + least(r, g, b)) / 2 AS li FROM f), t AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN (g - b) / d WHEN hi = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END AS turn FROM m),
  colors AS (SELECT k, n, round(CASE WHEN turn < 0 THEN turn + 6 ELSE turn END * 60, 6) AS h, round(CASE WHEN d = 0 THEN 0 ELSE d / (1 - abs(2 * li - 1)) END, 6) AS s, round(li, 6) AS l FROM t)"""


def colors(spark, d):
    """Suppliers with a color made of their key."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("k"), F.col("s_nationkey").alias("n"), F.format_string("#%02x%02x%02x", (k * 37) % 256, (k * 91) % 256, (k * 53) % 256).alias("color"))


@query("d09b_hues", f"WITH {COLORS_SQL} SELECT k, h, s, l FROM colors")
def d09b(spark, d):
    return colors(spark, d).select("k", D.hsl(F.col("color")).alias("c")).select("k", "c.*")


@query("d09c_composites", "SELECT k, printf('#%02X%02X%02X', round_even(a * r + (1 - a) * 255, 0)::INT, round_even(a * g + (1 - a) * 255, 0)::INT, round_even(a * b + (1 - a) * 255, 0)::INT) AS color FROM (SELECT s_suppkey AS k, (s_suppkey * 37) % 256 AS r, (s_suppkey * 91) % 256 AS g, (s_suppkey * 53) % 256 AS b, 128 / 255.0::DOUBLE AS a FROM supplier)")
def d09c(spark, d):
    return colors(spark, d).select("k", D.composite(F.concat("color", F.lit("80")), F.lit("#ffffff")).alias("color"))


_PART = lambda n: f"round_even((l - s * least(l, 1 - l) * greatest(-1, least((x / 30 + {n}) % 12 - 3, 9 - (x / 30 + {n}) % 12, 1))) * 255, 0)::INT"


@query("d09d_harmonies", f"WITH {COLORS_SQL}, x AS (SELECT k, s, l, i, (h + i + 360) % 360 AS x FROM colors, (SELECT unnest([0, 120, 240]) AS i)) SELECT k, string_agg(printf('#%02X%02X%02X', {_PART(0)}, {_PART(8)}, {_PART(4)}), ' ' ORDER BY i) AS palette FROM x GROUP BY 1")
def d09d(spark, d):
    return colors(spark, d).select("k", F.array_join(D.harmony(F.col("color"), "triadic"), " ").alias("palette"))


@query("d09e_type_scales", "SELECT DISTINCT p_size, round_even(p_size / 1.25::DOUBLE, 0)::INT AS caption, round_even(p_size * 1.25::DOUBLE, 0)::INT AS subheading, round_even(p_size * 1.953125::DOUBLE, 0)::INT AS display FROM part")
def d09e(spark, d):
    return table(spark, d, "part").select("p_size").distinct().select("p_size", D.type_scale(F.col("p_size"), D.SCALES["major_third"]).alias("t")).select("p_size", "t.caption", "t.subheading", "t.display")
