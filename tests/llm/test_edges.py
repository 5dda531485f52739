"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute as B
from tidewright.llm import capping, codes, graph, history, leaks, look, looks, neardup, packing, segments, spans, topn

# --- problem 5: looks -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text,want",
    [("Αｐpӏе", "Apple"), ("e​́", "é"), ("ｎ̃", "ñ"), ("ѐ", "è"), ("²３", "²3"), ("⽂更‐x－y", "文更-x-y"), ("a\u00a0\u3000b\t", "a  b "), ("ﾊﾟ", "パ"), ("Straße", "Straße"), ("", ""), (None, None), ("﻿", "")],
)
def test_look(text, want):
    assert look.look(text) == want
    assert codes.looks([text]) == [want]


def test_what_changes_the_look():
    for a, b in (("a", "A"), ("e", "é"), ("马", "馬"), ("2", "²"), ("l", "I"), ("—", "-")):
        assert look.look(a) != look.look(b)


def test_representatives_follow_counts():
    f = look.LookFolder({"е": 10, "e": 3})
    assert f.look("e") == "е" and f.look("é") == f.look("é")
    assert codes.Tables(f).looks(["hello", "hеllo"]) == ["hеllo", "hеllo"]


def test_classes_are_transitive():
    got = {frozenset(c) for c in look.classes_of([("a", "b"), ("b", "c")])}
    assert got == {frozenset("abc")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_arrays_agree_with_strings(texts):
    assert codes.looks(texts) == [look.look(t) for t in texts]
    once = codes.looks(texts)
    assert codes.looks(once) == once
    assert codes.as_text(*codes.bare(texts)) == [look.bare(t) if t else "" for t in texts] or any("Σ" in (t or "") or any(len(c.lower()) > 1 for c in t or "") for t in texts)


def test_same_look_pairs(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "аb"), (3, "ab"), (4, None), (5, " "), (6, "　"), (7, "x" * 50_000), (8, "х" + "x" * 49_999)], "i long, t string").withColumn("look", F.lit("clash"))
    got = sorted(tuple(r) for r in looks.same_look_pairs(df, ["t"], "i").collect())
    assert got == [("t", 1, 2), ("t", 2, 3), ("t", 7, 8)]
    assert looks.same_look_pairs(df.filter("i > 99"), ["t"], "i").count() == 0
    out = looks.unify_looks(df, ["t"]).orderBy("i").collect()
    assert out[0].t == out[1].t and out[3].t is None and out[0].look == "clash"


# --- problem 1: capping -----------------------------------------------------------------------------------------------


def feed(spark):
    rows = [(i, 1, "a", float(i % 3)) for i in range(9)] + [(10, 1, "b", None), (11, 1, "b", float("nan")), (12, 1, "b", 1.0), (13, 1, None, 5.0), (14, 2, "a", 1.0)]
    return spark.createDataFrame(rows, "i long, s int, who string, score double").withColumn("rank", F.lit("clash")).withColumn("n", F.lit(0))


def test_count_limit_and_ties(spark):
    kept, cut = capping.cap_contributors(feed(spark), ["s"], "who", "score", "i", max_count=2)
    assert sorted(r.i for r in cut.collect()) == [0, 1, 3, 4, 6, 7, 8, 11]
    assert sorted(r.i for r in kept.collect()) == [2, 5, 10, 12, 14]
    assert capping.cap_contributors(feed(spark).filter("i > 99"), ["s"], "who", "score", "i", max_count=2)[1].count() == 0


@pytest.mark.parametrize("counts,share", [([100, 10, 10, 10], 0.4), ([5, 5, 5, 5], 0.3), ([50, 1], 0.5), ([9], 0.5), ([100, 90, 3, 2, 1], 0.25), ([7, 7, 7], 0.2)])
def test_water_level_is_the_largest_consistent(spark, counts, share):
    df = spark.createDataFrame([(1, n) for n in counts], "s int, n long")
    level = capping.water_levels(df, ["s"], None, share).first().level
    fits = [x for x in range(1, max(counts) + 1) if x <= share * sum(min(c, x) for c in counts) + 1e-9]
    assert level == (max(fits) if fits else min(counts))


def test_share_limit_keeps_the_best(spark):
    rows = [(i, "big", float(i % 10)) for i in range(100)] + [(100 + i, f"s{i % 4}", 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, who string, score double").withColumn("all", F.lit(1))
    kept, cut = capping.cap_contributors(df, ["all"], "who", "score", "i", max_share=0.4)
    k = [r.i for r in kept.collect()]
    big = [i for i in k if i < 100]
    assert len(big) == 26 and len(k) == 66
    assert sorted(big) == sorted(sorted(range(100), key=lambda i: (-(i % 10), i))[:26])
    assert len(k) + cut.count() == 140


# --- problem 3: leaders -----------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9)), max_size=12).map(sorted), max_size=5), st.integers(1, 3))
def test_loser_tree(runs, n):
    want, seen = [], {}
    for x in sorted(x for r in runs for x in r):
        seen[x[0]] = seen.get(x[0], 0) + 1
        if seen[x[0]] <= n:
            want.append(x)
    columns = [[np.array([x[i] for x in r], object) for i in range(len(runs[0][0]) if runs and runs[0] else 2)] for r in runs]
    assert list(topn.merge_top([topn.Run(*c) for c in columns], n)) == want


def test_leaders(spark):
    rows = [(1, "a", 1.0, 5), (2, "a", 1.0, 6), (3, "a", None, 9), (4, "a", float("nan"), None), (5, None, 2.0, None), (6, "a", 1.0, None), (7, "a", 9.0, 1), (7, "a", 9.0, 1)]
    df = spark.createDataFrame(rows, "i long, g string, s double, t long").withColumn("bucket", F.lit("clash"))
    got = sorted((r.i, r["rank"]) for r in topn.top_n_per_group(df, ["g"], "s", "i", 4, time="t").collect())
    assert got == [(1, 4), (2, 3), (5, 1), (7, 1), (7, 2)]
    assert topn.top_n_per_group(df.filter("i > 99"), ["g"], "s", "i", 4).count() == 0


def test_a_million_groups_in_one_task(spark):
    df = spark.range(0, 1_000_000, 1, 1).select(F.col("id").alias("g"), F.lit(1.0).alias("s"), "id")
    began = time.time()
    assert topn.top_n_per_group(df, ["g"], "s", "id", 3).agg(F.count("*"), F.sum("rank")).first()[:] == (1_000_000, 1_000_000)
    assert time.time() - began < 60  # cut once more at each doubling: about 15 s, where a cut a batch takes minutes


def test_one_group_over_many_runs(spark):
    df = spark.range(0, 200_000, 1, 16).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 100_003).cast("double").alias("s"), "id")
    got = [r.id for r in topn.top_n_per_group(df, ["g"], "s", "id", 3).orderBy("rank").collect()]
    assert got == [r.id for r in df.orderBy(F.desc("s"), "id").limit(3).collect()]


# --- problem 2: history ----------------------------------------------------------------------------------------------


def items(spark, rows):
    return spark.createDataFrame(rows, "i long, id string, t string, u string").withColumn("r", F.lit("clash")).withColumn("k", F.lit(1))


CASES = [
    (1, "a", "Alpha beta gamma 12", "https://x.example/p/1"), (2, "a", "something else entirely", None), (3, "b", "Alpha beta gamma! 12", ""), (4, "c", "Alpha beta gamma 13", "http://www.X.example/p/1/?utm=1#top"),
    (5, None, None, None), (6, None, "", "no address"), (7, "d", "ｓｏｍｅｔｈｉｎｇ else entirely", "https://y.example/a?id=1"), (8, "e", "x", "https://y.example/a?id=2&from=z"), (9, "f", "x", "https://y.example/a?from=q&id=2"), (10, "b", "zzz qqq", None), (11, "g", "zzz qqq", None),
]


@pytest.mark.parametrize("last", [1_000_000, 2])
def test_repeats(spark, last):
    got = sorted(tuple(r) for r in history.find_repeats(items(spark, CASES), "i", "id", "t", F.col("u"), last=last).collect())
    assert got == B.repeats(CASES)
    assert history.find_repeats(items(spark, CASES).filter("i > 99"), "i", "id", "t", F.col("u")).count() == 0


def noisy(n, seed=1):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "更新", "发布", "模型", "42", "7.5"]
    base = [" ".join(rnd.choices(words, k=6)) for _ in range(n // 4)]
    return [(i, f"id{rnd.randrange(n)}", (t := rnd.choice(base))[: rnd.randrange(len(t) // 2, len(t) + 1)], f"https://h{rnd.randrange(5)}.example/p/{rnd.randrange(n)}") for i in range(n)]


@pytest.mark.parametrize("size", [50_000, 12])
def test_repeats_of_a_table_in_increments(spark, monkeypatch, size):
    monkeypatch.setattr(neardup, "LIST", size)
    rows = noisy(160)
    got = sorted(tuple(r) for r in history.find_all_repeats(items(spark, rows), "i", "id", "t", F.col("u"), first=20, last=60).collect())
    assert got == B.repeats(rows)
    assert history.find_all_repeats(items(spark, rows).filter("i > 999"), "i", "id", "t", F.col("u"), first=20).count() == 0


def test_batches_against_a_store(spark, tmp_path):
    rows, got = noisy(120, 3), []
    for a in range(0, 120, 24):  # opened anew for every batch, whose rows are all that is given
        store = segments.Store(spark, f"file://{tmp_path}/store", buckets=4)
        got += [tuple(r) for r in history.find_repeats(items(spark, rows[a : a + 24]), "i", "id", "t", F.col("u"), store).collect()]
    assert sorted(got) == B.repeats(rows)
    sizes = [s["records"] for s in segments.Store(spark, f"file://{tmp_path}/store").segments]
    assert sum(sizes) == 120 - len(got) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_a_store_is_searched_without_reading_it(tmp_path):
    read, rnd = {}, np.random.default_rng(4)
    for n in (50_000, 500_000):
        keys = rnd.integers(0, 1 << 32, n, dtype=np.uint32)
        entries = np.zeros(n, segments.ENTRY)
        entries["at"] = np.arange(n)
        (tmp_path / "b").write_bytes(segments.bucket_bytes(keys, entries))
        asked = np.unique(np.r_[keys[:20], rnd.integers(0, 1 << 32, 20, dtype=np.uint32)])
        with pa.OSFile(str(tmp_path / "b")) as f:
            b = segments.BucketFile(f)
            fences = b.read
            which, found = b.find(asked)
        want = sorted((i, j) for i, k in enumerate(asked.tolist()) for j in np.flatnonzero(keys == k).tolist())
        assert sorted(zip(which.tolist(), found["at"].tolist())) == want
        read[n] = b.read - fences
        assert fences * 200 < (4 + segments.ENTRY.itemsize) * n
    assert read[500_000] <= read[50_000] * 1.2


@given(st.lists(st.integers(0, 40), max_size=600), st.lists(st.integers(0, 45), max_size=20))
@settings(max_examples=30, deadline=None)
def test_bucket_files_find_all(keys, asked):
    keys, asked = np.array(keys, np.uint32), np.unique(np.array(asked, np.uint32))
    entries = np.zeros(len(keys), segments.ENTRY)
    entries["at"] = np.arange(len(keys))
    which, found = segments.BucketFile(pa.BufferReader(segments.bucket_bytes(keys, entries))).find(asked)
    assert sorted(zip(which.tolist(), found["at"].tolist())) == sorted((i, j) for i, k in enumerate(asked.tolist()) for j in np.flatnonzero(keys == k).tolist())


@pytest.mark.parametrize("text,want", [("KеуfrаmЕ", "keyframe"), ("KЕУFRАME", "keyframe"), ("TҺE СARԀ", "thecard"), ("ӀICЕNSE", "license"), ("REꞬІONAL E\u0301", "regionalé"), ("ΝΗΡ", "nhp"), ("ꓮΡΡLЕ αpple Ⅷ Ⅴ ⅽ", "appleappleⅷvc"), ("ΥУ ΓЗ", "yyyз")])
def test_bare_of_look_alikes_in_capitals(text, want):
    assert look.bare(text) == want
    c, starts = codes.bare([text])
    assert codes.as_text(c, starts) == [want]


# --- problem 4: near-duplicates -----------------------------------------------------------------------------------------


def stories(n=60, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        base = " ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(20))
        for j in range(rnd.randrange(1, 5)):
            words = base.split()
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = "".join(rnd.choices("qrstuv", k=6))
            out.append((f"k{i}_{j}", " ".join(words[:8]), " ".join(words[8:]), None))
    return out + [("null", None, None, None), ("blank", " ", "", None), ("short", "ab", None, None), ("tiny1", "breaking news today", None, None), ("tiny2", "breaking news to-day!", None, None), ("copy1", "same text here for all", None, None), ("copy2", "Same text here, for all", None, None), ("k0_0", "a second text of one key, long enough", None, None)]


@pytest.mark.parametrize("few", [30, 2])
def test_groups(spark, few, monkeypatch):
    monkeypatch.setattr(neardup, "D", few)
    rows = stories()
    df = spark.createDataFrame(rows, "id string, a string, b string, c string").withColumn("group", F.lit("clash")).withColumn("d", F.lit(0))
    by = {}
    for r in neardup.near_duplicate_groups(df, "id", ["a", "b", "c"]).collect():
        by.setdefault(r.group, set()).add(r.key)
    got = sorted((x, y) for g in by.values() for x in g for y in g if x < y)
    assert got == B.similar_ids(rows)
    assert neardup.near_duplicate_groups(df.filter("id = 'none'"), "id", ["a", "b", "c"]).count() == 0


def groups_of(df):
    by = {}
    for r in neardup.near_duplicate_groups(df, "id", ["a", "b", "c"]).collect():
        by.setdefault(r.group, set()).add(r.key)
    return sorted((x, y) for g in by.values() for x in g for y in g if x < y)


def spoiled(text, words, rnd):
    """The text with some of its words replaced."""
    out = text.split()
    for i in words:
        out[i] = "".join(rnd.choices("qrstuv", k=len(out[i])))
    return " ".join(out)


def test_links_of_texts_with_a_widespread_stretch(spark):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=6))
    common = " ".join(word() for _ in range(14))
    rows = []
    for i in range(150):  # every text has the stretch; besides, two of a pair share words but no two neighbouring ones
        own = " ".join(word() for _ in range(12))
        rows += [(f"k{i}a", common, own, None), (f"k{i}b", common, spoiled(own, range(1, 12, 3), rnd), None)]
    want = B.similar_ids(rows)
    assert len(want) > 100
    assert groups_of(spark.createDataFrame(rows, "id string, a string, b string, c string")) == want


def test_links_of_texts_without_a_long_shared_stretch(spark):
    rnd = random.Random(12)
    rows = []
    for i in range(40):  # a letter in 14 differs, so 24 in a row never agree
        n = 90 + 8 * i
        text = rnd.choices("abcdefghijklmnop", k=n)
        other = ["z" if j % 14 == 7 else x for j, x in enumerate(text)]
        rows += [(f"k{i}a", "".join(text), None, None), (f"k{i}b", "".join(other), None, None)]
    want = B.similar_ids(rows)
    assert len(want) == 40
    assert groups_of(spark.createDataFrame(rows, "id string, a string, b string, c string")) == want


@pytest.mark.parametrize("size", [50_000, 20])
def test_links_beside_a_standing_passage(spark, monkeypatch, size):
    monkeypatch.setattr(neardup, "LIST", size)  # 20: lists of the passage's sequences are cut into ten parts
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    passage, rows = " ".join(word() for _ in range(36)), []
    for i in range(100):  # all share the passage; two of a kind share most of the rest
        body = [word() for _ in range(30)]
        other = [word() if j % 10 == 3 else w for j, w in enumerate(body)]
        rows += [(f"k{i}a", passage, " ".join(body), None), (f"k{i}b", passage, " ".join(other), None)]
    want = B.similar_ids(rows)
    assert len(want) >= 100
    assert groups_of(spark.createDataFrame(rows, "id string, a string, b string, c string")) == want


def test_sequences_are_counted_in_all_texts(spark):
    n = 120_000  # each text has a sequence of its own, all have one in common, and one more has a sequence very often
    own = [chr(0x4E00 + i // 400) + chr(0x4E00 + i % 400) + "." for i in range(n)]
    texts = spark.createDataFrame([("abc" + x,) for x in own] + [("z" * 600_000,)], "text string")
    classes, *rest, tokens = neardup._token_classes(texts, n + 1, 3)
    class_of = lambda x: classes[neardup._counter(codes.grams(*codes.codes(x), 3)[1])]
    assert (class_of(own) > 0).all()
    assert tokens == (4 * n + 599_998) / (n + 1)
    (greatest,) = rest
    abc, z = class_of(["abc", "zzz"])
    assert n <= greatest[abc] < 1.01 * n and abc < z == 63
    assert 599_998 <= greatest[z] < 600_100


def test_exact_similarity():
    a, b = ["abcdef", "abc", "", "abcd"], ["abcdeg", "xyz", "", "abcd"]
    assert neardup.similar(a, b, 3, 0.6).tolist() == [True, False, False, True]


def test_bitmaps_never_rule_out_a_link():
    rnd = random.Random(2)
    texts = ["".join(rnd.choices("abcde", k=n)) for n in (10, 60, 200, 500, 3000)]
    pairs = [(t, t[: int(len(t) * f)] + "z" * int(len(t) * (1 - f) / 2)) for t in texts for f in (0.7, 0.8, 0.95)]
    c, s = codes.codes([x for p in pairs for x in p])
    *_, n, bits, _ = neardup._tokens(c, s, 3, 0.6, np.zeros(neardup.COUNTERS, np.uint8))
    apart = np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1)
    for (a, b), d, x, y in zip(pairs, apart, n[::2], n[1::2]):
        ga, gb = B.grams(a, 3), B.grams(b, 3)
        assert d <= len(ga ^ gb) and (x, y) == (len(ga), len(gb))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (200, 200)], "u long, v long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# --- problem 6: packing -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("capacity", [16, 100, 512])
def test_packing_is_right_and_tight(spark, capacity):
    rnd = random.Random(capacity)
    sizes = [(i, rnd.choice([rnd.randrange(1, capacity // 4 + 2), rnd.randrange(1, capacity + 1), rnd.randrange(capacity, 3 * capacity)])) for i in range(800)] + [(900, None), (901, 0)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens long").withColumn("window", F.lit("clash"))
    rows = packing.pack(df, capacity).collect()
    fill, docs = {}, {}
    for r in rows:
        fill[r.window_no] = fill.get(r.window_no, 0) + r.tokens
        docs.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
    assert max(fill.values()) <= capacity
    for i, n in sizes[:800]:
        parts = sorted(docs[i])
        assert sum(t for _, t in parts) == n and (len(parts) == 1 or n > capacity)
        assert [a for a, _ in parts] == [capacity * j for j in range(len(parts))]
    assert set(docs) == set(range(800))
    assert len(fill) <= 1.05 * sum(n for _, n in sizes[:800]) / capacity + 2
    assert packing.pack(df.filter("doc_id > 5000"), capacity).count() == 0


def test_a_laying_of_documents_is_right(spark, data):
    docs = {r.doc_id: r.tokens for r in packing.token_counts(spark.read.parquet(f"{data}/documents.parquet"), "doc_id", "text").collect()}
    fill, parts = {}, {}
    for r in packing.QUERIES["p6_windows"](spark, data).collect():
        fill[r.window_no] = fill.get(r.window_no, 0) + r.tokens
        parts.setdefault(r.doc_id, []).append(r.tokens)
    assert max(fill.values()) <= 2048 and set(parts) == set(docs)
    assert all(sum(p) == docs[d] and (len(p) == 1 or docs[d] > 2048) for d, p in parts.items())
    assert len(fill) <= 1.03 * sum(docs.values()) / 2048 + 3


def test_blank_texts_are_not_counted(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, " "), (3, None), (4, "")], "doc_id long, text string")
    assert [(r.doc_id, r.tokens) for r in packing.token_counts(df, "doc_id", "text").collect()] == [(1, 2)]


# --- problem 7: leaks ------------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rnd = random.Random(7)
    item = "".join(rnd.choices("abcdefghij", k=100))
    other = lambda n: "".join(rnd.choices("uvwxyz", k=n))
    docs = [(1, other(500) + item[:50].upper() + other(400)), (2, other(40) + item[:49] + other(30)), (3, item[:30] + other(9) + item[60:90]), (4, item[:25] + other(5) + item[40:65]), (5, None), (6, ""), (7, other(20_000) + ", ".join(item) + other(20_000)), (8, "short")]
    items = [(1, item), (2, None), (3, ""), (4, "too short to leak"), (5, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0))
    e = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = sorted(tuple(r) for r in leaks.leaked_items(d, "doc_id", "text", e, "item_id", "text").collect())
    assert got == B.leaked(docs, items) == [(x, y) for x in (1, 3, 7) for y in (1, 5)]
    assert leaks.leaked_items(d, "doc_id", "text", e.filter("item_id > 9"), "item_id", "text").count() == 0
    assert leaks.leaked_items(d.filter("doc_id > 9"), "doc_id", "text", e, "item_id", "text").count() == 0


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_LETTERS", 60)
    items = [(i, chr(97 + i) * 5 + "".join(map(str, range(i, i + 30)))) for i in range(4)]
    docs = [(i, "zzz" + t + "yyy") for i, t in items]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in leaks.leaked_items(d, "doc_id", "text", e, "item_id", "text").collect()) == B.leaked(docs, items)


# --- problem 8: spans -----------------------------------------------------------------------------------------------------


def passages(seed=3):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choices("abcdefghij \n", k=n))
    shared, short, hot = text(220), text(190), text(205)
    docs = [(1, text(300) + shared + text(100)), (2, shared), (3, text(50) + shared[:199] + text(90)), (4, text(10) + shared[20:] + text(10)), (5, None), (6, ""), (7, "x" * 3000), (8, "x" * 1000), (9, "y" + "x" * 199)]
    docs += [(20 + i, text(60) + short + text(60)) for i in range(50)] + [(100 + i, text(40) + hot + text(20)) for i in range(45)]
    return docs + [(2, shared)]


def test_span_pairs(spark):
    docs = passages()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit("clash")).withColumn("at", F.lit(0)).repartition(3)
    got = sorted(tuple(r) for r in spans.span_pairs(df, "doc_id", "text").collect())
    assert got == B.sharing(docs)
    assert spans.span_pairs(df.filter("doc_id > 999"), "doc_id", "text").count() == 0


def test_shared_stretches_cover_what_is_shared(spark):
    docs = passages(4)[:4]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    by = {}
    for r in spans.shared_stretches(df, "doc_id", "text").collect():
        by.setdefault(r.doc, set()).update(range(r.start, r.stop))
    where = {}
    for i, t in docs:
        for p in range(len(t) - 199):
            where.setdefault(t[p : p + 200], set()).add((i, p))
    want = {}
    for s in where.values():
        if len({i for i, _ in s}) > 1:
            for i, p in s:
                want.setdefault(i, set()).update(range(p, p + 200))
    assert by == want
    removed = {r.doc for r in spans.shared_stretches(df, "doc_id", "text", first=True).collect()}
    assert 1 not in removed and removed


@pytest.mark.parametrize("k,w", [(3, 4), (10, 5)])
def test_anchors_meet_in_equal_stretches(k, w):
    rnd = random.Random(k)
    same = "".join(rnd.choices("abc", k=k + w - 1))
    a, b = "".join(rnd.choices("xyz", k=20)) + same + "xx", "zz" + same
    c, s = codes.codes([a, b, "", "ab"])
    p, h = codes.anchors(c, s, k, w)
    who = codes.owner(s)[p]
    assert set(h[who == 0]) & set(h[who == 1])
