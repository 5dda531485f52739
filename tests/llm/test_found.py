"""Every pN_found against its plain restatement over a whole small table."""

import os

import duckdb
import pytest

from tests.llm import brute as B
from tidewright.llm import queries

FEED, DOCS, EVAL = "aihot_24h", "documents", "eval_items"


def rows(data, name, cols):
    return duckdb.sql(f"SELECT {cols} FROM '{data}/{name}.parquet'").fetchall()


WANT = {
    "p1_found": lambda d: [(i,) for i in B.capped(rows(d, FEED, "batch_no, source.name, score, api_index"), 5)],
    "p2_found": lambda d: B.repeats(rows(d, FEED, "api_index, id, title, links.original")),
    "p3_found": lambda d: [(i,) for i in B.leaders(rows(d, FEED, "api_index, batch_no, id, category, score, publishedAt"), 3)],
    "p4_found": lambda d: B.similar_ids(rows(d, FEED, 'id, title, summary, "originalTitle"')),
    "p5_found": lambda d: B.same_looks(rows(d, FEED, "api_index, title, summary")),
    "p7_found": lambda d: B.leaked(rows(d, DOCS, "doc_id, text"), rows(d, EVAL, "item_id, text")),
    "p8_found": lambda d: B.sharing(rows(d, DOCS, "doc_id, text")),
}


@pytest.mark.parametrize("name", sorted(WANT))
def test_found(name, spark, data):
    df = queries.QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    assert sorted(got) == sorted(WANT[name](data))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(WANT) - {"p6_usage"}))
def test_others_give_rows(name, spark, data):
    assert queries.QUERIES[name](spark, data).count() >= 0
    assert os.path.isdir(data)


def test_share_against_a_plain_water_level(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    groups = {}
    for name, s, i in rows(d, FEED, "source.name, score, api_index"):
        if (k := B.name_key(name)) is not None:
            groups.setdefault(k, []).append((B.score_key(s), i))
    sizes = [len(g) for g in groups.values()]
    level = max(x for x in range(1, max(sizes) + 1) if x <= 0.05 * sum(min(n, x) for n in sizes) + 1e-9)
    want = sorted(i for g in groups.values() for _, i in sorted(g)[level:])
    assert sorted(r.api_index for r in queries.QUERIES["p1_share"](spark, d).collect()) == want
