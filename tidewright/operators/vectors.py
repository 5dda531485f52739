"""Retrieval over unit vectors: fused scores, top-k, and diverse choices among a bounded pool."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    both = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def fused(visual, tag, weight: float = 0.3):
    return (1 - weight) * visual + weight * tag


#: Queries that are compared in one pass over the corpus, and bytes their vectors may have; more are done in blocks of this size.
QUERIES, BYTES = 20_000, 64 << 20


def inner(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of two blocks of vectors."""
    return q @ v.T


class Leaders:
    """The k best of what was seen for every query: by score rounded to six digits, then by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], exclude_self: bool) -> None:
        self.ids, self.vectors, self.k, self.score, self.exclude_self = ids, vectors, k, score, exclude_self
        self.least = np.full(len(ids), -np.inf)
        self.at, self.found, self.value = (np.zeros(0, t) for t in (np.int64, np.int64, np.float64))

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        at, found, value = [self.at], [self.found], [self.value]
        step = max(1, 4_000_000 // max(1, len(ids)))
        for a in range(0, len(self.ids), step):
            s = self.score(self.vectors[a : a + step], vectors)
            if self.exclude_self:
                s[self.ids[a : a + step, None] == ids[None, :]] = -np.inf
            least = self.least[a : a + step]
            if len(ids) > self.k:
                least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((s >= least[:, None] - 2e-6) & (s > -np.inf))
            at.append(i + a), found.append(ids[j]), value.append(s[i, j])
        at, found, value = map(np.concatenate, (at, found, value))
        order = np.lexsort((found, -np.round(value, 6), at))
        at, found, value = at[order], found[order], value[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        self.at, self.found, self.value = at[keep], found[keep], value[keep]
        last = place[keep] == self.k - 1
        self.least[self.at[last]] = self.value[last]


def rank_by_vector(corpus: DataFrame, queries: DataFrame, vec: str, id_: str, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray] = inner, exclude_self: bool = False) -> DataFrame:
    """``query_id, id, score, place``: the k best of the corpus for each query (``query_id, q``); ties go to the least id.

    Blocks of vectors are multiplied with the queries' matrix; a task keeps its k best a query. The queries are counted first, and
    sent to the tasks in blocks of at most ``QUERIES`` and ``BYTES``, a pass over the corpus each. Null vectors take no part."""
    spark = corpus.sparkSession
    queries = queries.filter(F.col("q").isNotNull()).select(F.col("query_id").cast("long"), F.col("q").cast("array<double>").alias("q"))
    rows, size = queries.agg(F.count("*"), F.max(F.size("q"))).first()
    blocks = max(1, math.ceil(rows / QUERIES), math.ceil(rows * (size or 0) * 8 / BYTES))
    x = corpus.filter(F.col(vec).isNotNull()).select(F.col(id_).cast("long"), F.col(vec).cast("array<double>"))
    out = None
    for block in range(blocks):
        one = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        sent = spark.sparkContext.broadcast((one.column(0).to_numpy(), _matrix(one.column(1))))

        def search(batches, sent=sent):
            best = Leaders(*sent.value, k, score, exclude_self)
            for b in batches:
                if b.num_rows:
                    best.add(b.column(0).to_numpy(), _matrix(b.column(1)))
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(best.ids[best.at], pa.int64()), "id": pa.array(best.found, pa.int64()), "score": pa.array(best.value, pa.float64())})

        found = x.mapInArrow(search, "query_id long, id long, score double")
        out = found if out is None else out.unionByName(found)
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    return out.withColumn("score", F.round("score", 6)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else np.zeros((0, 0))


def mean_pool(df: DataFrame, group: str, vec: str) -> DataFrame:
    """``group, at, value``: the mean of a group's vectors scaled to unit length (norms under 1e-8 count as 1e-8)."""
    parts = df.select(group, F.posexplode(F.col(vec).cast("array<double>")).alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(W.partitionBy(group)))
    return parts.withColumn("value", F.col("m") / F.greatest(norm, F.lit(1e-8))).select(group, "at", "value")


def mmr(ids: list, vectors: np.ndarray, relevance: np.ndarray, n: int, balance: float) -> list[int]:
    """Positions picked one by one by (1 - balance) * relevance - balance * greatest likeness to what was picked; the first
    counts by relevance alone; the earliest position wins ties."""
    likeness = vectors @ vectors.T
    picked: list[int] = []
    worst = np.zeros(len(ids))
    left = list(range(len(ids)))
    while left and len(picked) < n:
        value = [(1 - balance) * relevance[i] - balance * (worst[i] if picked else 0.0) for i in left]
        best = left[int(np.argmax(np.round(value, 9)))]
        picked.append(best)
        left.remove(best)
        worst = likeness[best].copy() if len(picked) == 1 else np.maximum(worst, likeness[best])
    return picked


def diversify(vectors: np.ndarray, n: int, d: float) -> list[int]:
    """Keeps the first; then by d * (-greatest likeness to the kept) + (1 - d) * (-place among the rest / (rest - 1))."""
    likeness = vectors @ vectors.T
    kept, left = [0], list(range(1, len(vectors)))
    while left and len(kept) < n:
        last = max(1, len(left) - 1)
        value = [d * -max(likeness[i][j] for j in kept) + (1 - d) * (-p / last) for p, i in enumerate(left)]
        kept.append(left.pop(int(np.argmax(np.round(value, 9)))))
    return kept[:n]


def diverse_sets(corpus: DataFrame, seeds: DataFrame, vec: str, id_: str, n: int, pool: int = 30, balance: float = 0.5) -> DataFrame:
    """``query_id, id, place``: for every seed a set of n by maximal marginal relevance among its ``pool`` nearest."""
    near = rank_by_vector(corpus, seeds, vec, id_, pool, exclude_self=True).join(corpus.select(F.col(id_).alias("id"), F.col(vec).cast("array<double>").alias("v")), "id")

    def choose(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("place")
        at = mmr(p["id"].tolist(), np.stack(p["v"].to_numpy()), p["score"].to_numpy(), n, balance)
        return pd.DataFrame({"query_id": p["query_id"].iloc[0], "id": p["id"].iloc[at].to_numpy(), "place": range(1, len(at) + 1)})

    return near.groupBy("query_id").applyInPandas(choose, "query_id long, id long, place int")
