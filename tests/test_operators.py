"""Operators on small frames with results worked out by hand."""

import json
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import text as X
from tidewright.functions import timefmt as D
from tidewright.operators import folds, joins, numbering, ranking, series, vectors
from tidewright.operators import expectations as E
from tidewright.sources import documents as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("s,want", [(0.9999, "00:00:01,000"), (59.9999, "00:01:00,000"), (3599.9999, "01:00:00,000"), (7261.9999, "02:01:02,000"), (0.4994, "00:00:00,499")])
def test_subtitle_time_carries(spark, s, want):
    assert one(spark, D.subtitle_time(F.lit(s))) == want


def test_clock_and_rate(spark):
    df = spark.createDataFrame([("1:02:03.5",), ("02:03",), ("7",), ("x",), (None,)], "t string")
    assert [r.s for r in df.select(D.parse_clock(F.col("t")).alias("s")).collect()] == [3723.5, 123.0, 7.0, 0.0, 0.0]
    assert one(spark, D.parse_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01)
    assert one(spark, D.parse_rate(F.lit("1/0"))) is None


def test_contrast(spark):
    assert one(spark, D.contrast(F.lit("#000000"), F.lit("#ffffff"))) == pytest.approx(21.0)


def test_diversify_extremes():
    v = np.array([[1, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
    assert vectors.diversify(v, 3, 1.0) == [0, 2, 3]
    assert vectors.diversify(v, 4, 0.0) == [0, 1, 2, 3]
    assert vectors.mmr([0, 1, 2, 3], v, np.array([0.9, 0.8, 0.7, 0.6]), 2, 0.9) == [0, 2]


def test_adaptive_selection_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([("a", "x", None, 1), ("a", "y", None, 2)], "g string, k string, score double, i long")
    got = {r.k: (r["rank"], r.percentile) for r in ranking.adaptive_selection(df, "g", "k", "score", "i").collect()}
    assert got == {"x": (1, 1.0), "y": (2, 0.5)}
    assert ranking.adaptive_selection(df.filter("1 = 0"), "g", "k", "score", "i").count() == 0


def test_quota_then_backfill(spark):
    df = spark.createDataFrame([("m", i) for i in range(5)] + [("p", 9)], "g string, i long")
    assert [r.i for r in ranking.quota_then_backfill(df, "g", "i", 2, 4).collect()] == [0, 1, 9, 2]


def test_longest_run(spark):
    rows = [("a", i, v) for i, v in enumerate(["wide", "wide", "cu", "cu", "med", "med"])] + [("b", 0, "unspecified"), ("b", 1, "unspecified")]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    assert {r.g: r.longest for r in series.longest_run(df, "g", "i", F.col("v")).collect()} == {"a": 2, "b": 0}


def test_complement_and_monotone(spark):
    df = spark.createDataFrame([("a", 2.0, 4.0), ("a", 7.0, 9.0)], "g string, a double, z double")
    got = sorted((r.seg_start, r.seg_end) for r in series.complement(df, "g", "a", "z", F.lit(10.0), 0.5, 0.01, 0.05).collect())
    assert got == [(0.0, 2.5), (3.5, 7.5), (8.5, 10.0)]
    cues = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, 3.0, 4.0), ("a", 3, 4.0, 8.0)], "g string, i int, s double, e double")
    got = [(r.i, r.s, r.e, r.cue) for r in series.monotone(cues, "g", ["i"], "s", "e", F.lit(7.0)).orderBy("i").collect()]
    assert got == [(1, 0.0, 5.0, 1), (3, 5.0, 7.0, 2)]


def test_folds_over_arrays(spark):
    rows = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 1.0), ("a", 1.9), ("a", 2.5), ("b", 0.1), (None, 3.0), (None, 9.0)], "g string, v double")
    assert sorted((r.g or "", r.v) for r in series.thinned(rows, "g", "v", 1.0).collect()) == [("", 3.0), ("", 9.0), ("a", 0.0), ("a", 1.0), ("a", 2.5), ("b", 0.1)]
    assert [(r.g, r.step, r.level) for r in series.envelope(rows.filter("g = 'b' or v = 1.0"), "g", ["v"], "v", 0.5, 0.5).orderBy("g").collect()] == [("a", 0, 0.5), ("b", 0, 0.05)]
    assert one(spark, series.subsample(F.lit([3, 1, 2, 2, 4]), 2)) == [1, 3]
    heights = spark.createDataFrame([("a", i, h) for i, h in enumerate([5, 5, 5, 20, 1])], "g string, i long, h long")
    assert [r.page for r in folds.pages(heights, "g", ["i"], "h", 10).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    assert one(spark, folds.grid_height(F.lit([5, 9, 3]), 2, 8)) == 20
    assert sorted(one(spark, folds.closure(F.lit(["a"]), [["a", "b"], ["b", "c"], ["x", "y"]]))) == ["a", "b", "c"]


def test_interval_join_meets_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0.0, 25.0), (2, 30.0, 31.0)], "l int, a0 double, a1 double")
    b = spark.createDataFrame([(7, 5.0, 40.0), (8, 25.0, 30.0)], "r int, b0 double, b1 double")
    got = sorted((x.l, x.r) for x in joins.interval_join(a, b, ("a0", "a1"), ("b0", "b1"), 10.0).collect())
    assert got == [(1, 7), (2, 7)]
    best = joins.largest_overlap(joins.interval_join(a, b, ("a0", "a1"), ("b0", "b1"), 10.0), ["l"], ("a0", "a1"), ("b0", "b1"), "r").collect()
    assert {(x.l, x.overlap) for x in best} == {(1, 20.0), (2, 1.0)}


def test_nearest(spark):
    a = spark.createDataFrame([(1, "g", 10.0), (2, "g", 50.0)], "row_id int, g string, t double")
    b = spark.createDataFrame([("g", 8.0, 5), ("g", 12.0, 4), ("h", 50.0, 6)], "g string, u double, o int")
    assert {x.row_id: x.o for x in joins.nearest(a, b, "g", "t", "u", "o", 5.0).collect()} == {1: 4, 2: None}


def test_dictionary_match(spark):
    lines = spark.createDataFrame([(1, "英伟达NVIDIA发布"), (2, "invidia"), (3, "NVIDIA ships")], "i int, t string")
    names = spark.createDataFrame([("nv", "nvidia"), ("nv", "英伟达")], "entity string, alias string")
    assert {r.i for r in joins.dictionary_match(lines, "t", names).collect()} == {1, 3}


def test_numbered_and_eviction(spark):
    df = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    assert {r.k: r.n for r in numbering.numbered(df, "k", "n").collect()} == {i: i + 1 for i in range(100)}
    c = spark.createDataFrame([("a", 5, 10.0), ("b", 5, None), ("c", 5, 9000.0)], "k string, s long, at double")
    assert {r.k for r in ranking.evict_until_fits(c, "s", "at", "k", 7).collect()} == {"a", "b"}


def test_spoken_numbers():
    want = {0: "零", 10: "十", 15: "十五", 101: "一百零一", 110: "一百一十", 1010: "一千零一十", 10001: "一万零一", 100000: "十万", 12030000: "一千二百零三万", 100000000: "一亿", -3: "负三", 20010: "二万零一十"}
    assert {n: X.spoken_integer(n) for n in want} == want
    assert X.spoken_number("3.14") == "三点一四" and X.spoken_number("x") == "x"


def test_rewriting_keeps_a_ledger():
    spoken, ledger = X.rewritten("增长1,200到5M，占95%")
    assert spoken == "增长一千二百到五百万，占百分之九十五"
    assert [r["kind"] for r in ledger] == ["display_number_separator", "million_unit", "count_or_measure", "plain_number"]
    assert ledger[0] == {"kind": "display_number_separator", "source": "1,200", "reading": "1200", "start": 2, "stop": 7}


@pytest.mark.parametrize(
    "text,want",
    [
        ("采用 Q4_K_M 量化（17GB），速度 14 tokens/s，窗口 262，144 token。", "采用 Q 四 K M 量化（十七吉字节），速度 每秒十四个 token，窗口 二十六万二千一百四十四个 token。"),
        ("包含 4，888 位说话人和 12 项属性。", "包含 四千八百八十八位说话人和 十二项属性。"),
        ("融资 1.5B 与 2.25K，0.5bn", "融资 十五亿 与 二千二百五十，五亿"),
        ("GPT-5.2mini 对 Qwen3", "G P T 五点二 m i n i 对 Qwen 三"),
        ("ABC-12_X 与 zh-CN，req/min，AI 和 NASA", "A B C 十二 X 与 zh C N，req 每 min，AI 和 N A S A"),
        ("好 。。！ a", "好！ a"),
        ("", ""),
    ],
)
def test_rewrites(text, want):
    assert X.rewritten(text)[0] == want


def test_caption_units_keep_the_text():
    text = "第一句很长，需要在软标点处切开，因为它超过了二十八个可见字符的限制。第二句！尾巴"
    units = X.caption_units(text, 28)
    assert "".join(units) == text and all(len(u.replace(" ", "")) <= 28 for u in units)
    assert X.caption_units("", 28) == [] and X.caption_units("   ", 28) == []


def test_labels_are_unique(spark):
    titles = ["Alpha news", "Alpha again", "Alpha", None, "  ", "Abcdefghijklmnopqrstuv", "Abcdefghijklmnopqrstuvwx", "Abcdefghijklmnopzz"]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, t string").select("i", F.lit(1).alias("g"), X.label_base(F.col("t")).alias("b"))
    got = [r.label for r in ranking.unique_labels(df, "g", "b", "i").orderBy("i").collect()]
    assert got == ["Alpha", "Alpha · 2", "Alpha · 3", "item", "item · 2", "Abcdefghijklmnop", "Abcdefghij · 2", "Abcdefghij · 3"]


def test_fragments(spark):
    f = lambda t, s: one(spark, X.fragments(F.lit(t), F.lit(s)))
    assert f("标题", "标题。第一句。第一 句！第二句") == ["标题", "第一句。", "第二句"]
    assert f("t" * 200, "x。") == ["t" * 200] and f("t" * 100, "y" * 60 + "。x") == ["t" * 100]
    assert f(None, "a。b。c。d") == ["a。", "b。", "c。"] and f(None, None) == []


def test_cues_and_phrases(spark):
    words = spark.createDataFrame([("x", i, w) for i, w in enumerate(["a", "b", "c", "d" * 12, "e"])] + [("y", 0, None)], "g string, i int, w string")
    assert [r.cue for r in folds.pack_cues(words, "g", ["i"], "w", 2, 10).orderBy("g", "i").collect()] == [1, 1, 2, 3, 4, 1]
    assert "".join(folds.phrase_cues(list("你好。今天天气不错，我们出去走走，好不好呢？好"))) == "你好。今天天气不错，我们出去走走，好不好呢？好"


def test_text_expressions(spark):
    assert one(spark, X.ungrouped(F.lit("4，888 和 1,234,567"))) == "4888 和 1234567"
    assert one(spark, X.collapse(F.lit(" a　 b\t"))) == "a b"
    assert one(spark, X.tokens(F.lit("Trailers, GPT-4.")) ) == ["trailers", "gpt-4"]
    assert one(spark, X.missing_tokens(F.lit(["AI", "GPT"]), F.lit("AI与gpt"))) == []
    assert one(spark, ranking.natural_key(F.lit("page10"))) > one(spark, ranking.natural_key(F.lit("page9")))


def test_sources_round_trip(spark, tmp_path):
    page = {"schemaVersion": 1, "items": [{"id": "a", "title": "t", "source": {"name": "s"}, "links": {"aihot": "x", "original": "y"}, "score": 1.0, "selected": True}], "page": {"count": 1, "hasMore": True, "nextCursor": None}}
    (tmp_path / "p1.json").write_text(json.dumps(page))
    pages = S.feed_pages(spark, str(tmp_path / "p1.json"))
    assert pages.select("id", "pos").collect()[0] == ("a", 0)
    assert [r.fault for r in S.page_chain(pages.select("file", "page")).collect()] == ["no_cursor"]
    (tmp_path / "e.jsonl").write_text('{"event_no": 1, "tool": "a"}\nbroken\n{"event_no": 2}\n')
    events = S.json_lines(spark, str(tmp_path / "e.jsonl"), S.EVENT)
    assert sorted(r.event_no for r in events.collect()) == [1, 2]
    S.append_lines(events.select("event_no"), str(tmp_path / "out"))
    S.append_lines(events.select("event_no"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "checkpoint_scene_plan_2.json").write_text('{"status": "completed"}')
    assert S.checkpoint_files(spark, str(tmp_path / "c"), "status string").first().stage_of_file == "scene_plan"
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.MP4").write_bytes(b"12")
    assert [(r.length, r.kind) for r in S.media_files(spark, str(tmp_path / "m")).collect()] == [(2, "video")]
    S.write_table(events, str(tmp_path / "orc"), kind="orc")
    assert spark.read.orc(str(tmp_path / "orc")).count() == 2


def test_expectations(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, "")], "i int, t string")
    rules = [E.Rule("none", F.col("t").isNull()), E.Rule("blank", F.col("t") == "", F.col("i"))]
    found = E.violations(df, "i", rules)
    assert {(r.entity, r["rule"], r.detail) for r in found.collect()} == {("1", "none", ""), ("3", "blank", "3")}
    assert E.gates(found, ["none", "other"]).first() == (False, True)
    assert {(r.k, r.a, r.b) for r in E.reconcile(df.select(F.col("i").alias("k"), "t"), df.filter("i > 1").select(F.col("i").alias("k"), "t"), "k", ["t"]).collect()} == set()


def test_late_events_are_dropped(spark, tmp_path):
    from datetime import datetime

    from tidewright.streaming import jobs

    for i, hours in enumerate(([9, 10, 14], [14], [10, 13, 14])):  # files in order; rows an hour behind what the batch before last had are late
        rows = [(datetime(2026, 1, 1, h, 30), "a") for h in hours]
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        time.sleep(1.1)
    got = {r.hour.hour: r.n for r in jobs.hourly_counts(spark, f"{tmp_path}/e", files=1).collect()}
    assert got == {9: 1, 10: 1, 13: 1, 14: 3}
    runs = [(r.began.hour, r.changes) for r in jobs.coalesced_changes(spark, f"{tmp_path}/e", "event_type", "ts", "2 hours", files=1).orderBy("began").collect()]
    assert runs == [(9, 3), (13, 4)]


def test_streams_of_nothing(spark, tmp_path):
    from tidewright.streaming import jobs

    spark.createDataFrame([], "project_id string, ts timestamp_ntz, event_type string").write.parquet(f"{tmp_path}/e")
    assert jobs.changed_keys(spark, f"{tmp_path}/e", "project_id").count() == 0
    assert jobs.hourly_counts(spark, f"{tmp_path}/e").count() == 0


def test_leaders_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(300, 8)), 1)
    v[100:140] = v[7]  # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "i long, v array<double>").repartition(5)
    monkeypatch.setattr(vectors, "QUERIES", 7)
    got = {}
    for r in vectors.rank_by_vector(df, df.filter("i % 20 = 0 or i = 7").select(F.col("i").alias("query_id"), F.col("v").alias("q")), "v", "i", 6, exclude_self=True).orderBy("place").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q in [*range(0, 300, 20), 7]:
        assert got[q] == sorted((i for i in range(300) if i != q), key=lambda i: (-round(float(v[q] @ v[i]), 6), i))[:6]
    assert vectors.rank_by_vector(df, df.filter("i < 0").select(F.col("i").alias("query_id"), F.col("v").alias("q")), "v", "i", 6).count() == 0


def test_diverse_sets_against_plain_loops(spark, data):
    from tidewright import catalog

    e = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    near = lambda q, n: sorted((i for i in e if i != q), key=lambda i: (-round(float(e[q] @ e[i]), 6), i))[:n]
    got = {name: {} for name in ("v04_marginal_relevance", "v05_diversified")}
    for name, sets in got.items():
        for r in catalog.QUERIES[name](spark, data).orderBy("place").collect():
            sets.setdefault(r.query_id, []).append(r.id)
    for q in (i for i in e if i % 20 == 0):
        left, picked = near(q, 30), []
        while len(picked) < 8 and left:
            value = [round(0.5 * round(float(e[q] @ e[i]), 6) - 0.5 * max([float(e[i] @ e[j]) for j in picked], default=0.0), 9) for i in left]
            picked.append(left.pop(value.index(max(value))))
        assert got["v04_marginal_relevance"][q] == picked
        first, *left = near(q, 20)
        kept = [first]
        while len(kept) < 6 and left:
            value = [round(-0.5 * max(float(e[i] @ e[j]) for j in kept) - 0.5 * p / max(1, len(left) - 1), 9) for p, i in enumerate(left)]
            kept.append(left.pop(value.index(max(value))))
        assert got["v05_diversified"][q] == kept


def test_colors(spark):
    assert one(spark, D.hsl(F.lit("#ff0000"))) == (0.0, 1.0, 0.5) and one(spark, D.hsl(F.lit("#0000ff")))[0] == 240.0 and one(spark, D.hsl(F.lit("#808080")))[:2] == (0.0, 0.0)
    assert one(spark, D.harmony(F.lit("#ff0000"), "triadic")) == ["#FF0000", "#00FF00", "#0000FF"]
    assert one(spark, D.harmony(F.lit("#ff0000"), "complementary")) == ["#FF0000", "#00FFFF"]
    assert one(spark, D.composite(F.lit("#00000080"), F.lit("#ffffff"))) == "#7F7F7F"
    assert one(spark, D.type_scale(F.lit(24), D.SCALES["major_third"])) == (19, 24, 30, 38, 47)
    assert one(spark, D.half_even(F.lit(2.5), 0)) == 2.0 and one(spark, D.half_even(F.lit(3.5), 0)) == 4.0


def test_ungrouped_against_a_plain_pattern(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("0123456789,，,, x", k=rnd.randrange(1, 24))) for _ in range(3000)] + ["1,234 and 91,2345", "1,234,5678", "5,1,234", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.t for r in df.select("i", X.ungrouped(F.col("t")).alias("t")).collect()}
    plain = lambda t: re.sub(r"(?<![0-9])[0-9]{1,3}(?:[,，][0-9]{3})+(?![0-9])", lambda m: re.sub("[,，]", "", m[0]), t)
    assert got == {i: t if t is None else plain(t) for i, t in enumerate(texts)}


def test_caption_units_against_a_plain_walk():
    rnd = random.Random(6)

    def plain(text, most):
        out = []
        for sentence in re.findall(r"[^。！？!?；;]+[。！？!?；;]?", text):
            s = sentence.strip()
            while s:
                seen, fit = 0, len(s)
                for i, c in enumerate(s):
                    seen += not c.isspace()
                    if seen > most:
                        fit = i
                        break
                if fit < len(s):
                    for cut in range(fit, max(1, fit // 2) - 1, -1):
                        if s[cut - 1] in "，、：；,;:）)" or s[cut - 1].isspace():
                            fit = cut
                            break
                out.append(s[:fit])
                s = s[fit:]
        return [u for u in out if u.strip()]

    for _ in range(2000):
        text = "".join(rnd.choices("abc文字 ，,、。！ )", k=rnd.randrange(0, 80)))
        assert X.caption_units(text, 7) == plain(text, 7), text
