"""Problem 3: the N leading items of every group, by a sorted-run loser-tree merge.

Every task turns its rows into one run sorted by (group, score, time, ordinal), of which only the first N of a group can
matter; runs are cut by bucket of the group and sent to the bucket's task as packed columns. There a loser tree merges a
bucket's runs; after N outputs of a group, every run seeks to its next group. However large a group, a task gets at most
N of its rows from each run.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Rows after which a task cuts its run down to N a group, and again whenever it holds twice what the last cut left.
_COMPACT = 500_000
#: Rows of a bucket at most, on average, when runs are merged.
ROWS = 500_000


class LoserTree:
    """Tournament of k sources; ``keys[i]`` is source i's current key, None when it has ended."""

    def __init__(self, keys: list) -> None:
        self.keys = keys
        self.size = 1
        while self.size < max(1, len(keys)):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._play(1)

    def _less(self, a: int, b: int) -> bool:
        ka = self.keys[a] if a < len(self.keys) else None
        kb = self.keys[b] if b < len(self.keys) else None
        return ka is not None and (kb is None or ka < kb)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self._less(b, a):
            a, b = b, a
        self.losers[node] = b
        return a

    def replay(self, source: int, key) -> None:
        """Set the winner's next key and find the new winner."""
        self.keys[source] = key
        w, node = source, (source + self.size) // 2
        while node:
            if self._less(self.losers[node], w):
                self.losers[node], w = w, self.losers[node]
            node //= 2
        self.winner = w

    def top(self):
        return self.keys[self.winner] if self.winner < len(self.keys) else None


class Run:
    """A sorted run held as columns: its key at a place is made when the tree asks for it."""

    def __init__(self, groups: np.ndarray, *columns: np.ndarray) -> None:
        self.groups, self.columns, self.at, self.size = groups, columns, 0, len(groups)
        new = np.r_[np.flatnonzero(groups[1:] != groups[:-1]) + 1, len(groups)] if len(groups) else np.zeros(0, np.int64)
        self.ends, self.group = new.tolist(), 0

    def key(self) -> tuple | None:
        if self.at >= self.size:
            return None
        return (self.groups[self.at], *(c[self.at] for c in self.columns))

    def step(self) -> None:
        self.at += 1
        if self.group < len(self.ends) and self.at >= self.ends[self.group]:
            self.group += 1

    def seek(self) -> None:
        """To the next group."""
        self.at = self.ends[self.group]
        self.group += 1


def merge_top(runs: list[Run], n: int) -> Iterator[tuple]:
    """(group, rest of key...) of sorted runs, the first n of every group in order. The winner's run seeks past a group that has
    had its n outputs."""
    tree = LoserTree([r.key() for r in runs])
    group, given = object(), 0
    while (key := tree.top()) is not None:
        s = tree.winner
        if key[0] != group:
            group, given = key[0], 0
        if given < n:
            given += 1
            yield key
            runs[s].step()
        else:
            runs[s].seek()
        tree.replay(s, runs[s].key())


def _cut(t: pa.Table, n: int) -> pa.Table:
    """Sorted by group, score and time descending with nulls last, ordinal; the first n of every group."""
    t = t.take(pa.compute.sort_indices(t, sort_keys=[("g", "ascending"), ("s0", "ascending"), ("s", "descending"), ("t0", "ascending"), ("t", "descending"), ("o", "ascending")]))
    if not len(t):
        return t
    g = t["g"].combine_chunks().dictionary_encode() if t["g"].num_chunks else None
    ids = (g.combine_chunks() if isinstance(g, pa.ChunkedArray) else g).indices.to_numpy(zero_copy_only=False)
    first = np.r_[True, ids[1:] != ids[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    return t.filter(pa.array(np.arange(len(ids)) - start < n))


def top_n_per_group(df: DataFrame, group: list[str], score: str, ordinal: str, n: int, time: str | None = None, buckets: int | None = None) -> DataFrame:
    """The rows' ``ordinal`` and ``rank`` (1 to n) in their group, by ``score`` descending, ``time`` (any number)
    descending, ``ordinal`` ascending. Null or not-a-number scores and times come last; null group values are a group of
    their own; repeated rows each count. An empty table gives an empty result; other columns aren't looked at."""
    spark = df.sparkSession
    buckets = buckets or max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // ROWS)
    number = lambda c: F.coalesce(C.number_or_null(F.col(c).cast("double")), F.lit(0.0))
    missing = lambda c: (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("byte")
    rows = df.select(
        F.to_json(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(group))), {"ignoreNullFields": "false"}).alias("g"),
        missing(score).alias("s0"), number(score).alias("s"),
        (missing(time) if time else F.lit(0).cast("byte")).alias("t0"), (F.coalesce(F.col(time).cast("long"), F.lit(0)) if time else F.lit(0)).cast("long").alias("t"),
        F.col(ordinal).cast("long").alias("o"),
    )

    def make_run(batches):
        import pyarrow.compute  # noqa: F401

        held, count, most = [], 0, _COMPACT
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= most:
                t = _cut(pa.Table.from_batches(held), n)
                held, count = t.to_batches(), t.num_rows
                most = max(_COMPACT, 2 * count)
        if not held:
            return
        run = _cut(pa.Table.from_batches(held), n)
        groups = run["g"].to_pylist()
        of = np.fromiter((zlib.crc32(g.encode()) % buckets for g in groups), np.int32, len(groups))
        for k in np.unique(of).tolist():
            part = run.filter(pa.array(of == k))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as w:
                w.write_table(part.combine_chunks())
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "run": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def merge(t: pa.Table) -> pa.Table:
        runs = []
        for blob in t["run"].to_pylist():
            x = pa.ipc.open_stream(blob).read_all()
            runs.append(Run(x["g"].to_numpy(), x["s0"].to_numpy(), -x["s"].to_numpy(), x["t0"].to_numpy(), -x["t"].to_numpy(), x["o"].to_numpy()))
        out, rank, last = [], [], None
        for key in merge_top(runs, n):
            rank.append(rank[-1] + 1 if key[0] == last else 1)
            last = key[0]
            out.append(key[5])
        return pa.table({"ordinal": pa.array(out, pa.int64()), "rank": pa.array(rank, pa.int32())})

    runs = rows.mapInArrow(make_run, "bucket int, run binary")
    return runs.groupBy("bucket").applyInArrow(merge, "ordinal long, rank int").select(F.col("ordinal").alias(ordinal), "rank")


def feed_leaders(spark: SparkSession, sf_dir: str, n: int = 3) -> DataFrame:
    """Leading items of each batch and category; of rows with one id in one batch only the first takes part."""
    items = C.table(spark, sf_dir, "aihot_24h").select("api_index", "batch_no", "id", "category", "score", "publishedAt")
    first = items.groupBy("batch_no", F.coalesce("id", F.concat(F.lit("\0"), F.col("api_index").cast("string"))).alias("one")).agg(F.min_by(F.struct("api_index", "category", "score", "publishedAt"), "api_index").alias("r")).select("batch_no", "r.*")
    keyed = first.select("api_index", "batch_no", "score", C.instant(F.col("publishedAt")).alias("at"), C.category_key_udf("category").alias("category_key"))
    buckets = max(8, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), items.count() // ROWS)  # of the table, so that nothing is computed for it
    return top_n_per_group(keyed, ["batch_no", "category_key"], "score", "api_index", n, time="at", buckets=buckets)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_leaders(spark, sf_dir).select("api_index")


def p3_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three leaders with their rank and what they were ranked by."""
    items = C.table(spark, sf_dir, "aihot_24h").select("api_index", "batch_no", "category", "score")
    return feed_leaders(spark, sf_dir).join(items, "api_index").select("batch_no", "category", "rank", "api_index", "score")


QUERIES = {"p3_found": p3_found, "p3_leaders": p3_leaders}
