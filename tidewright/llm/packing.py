"""Problem 6: laying documents into windows of a fixed number of tokens.

Linear grouping: the large documents are cut, by a histogram of sizes, into groups of about equal number; within a group
every size is rounded up to the group's largest. For so few sizes the best mix of window configurations is a small linear
programme, solved by column generation (a knapsack prices the next configuration); its solution is rounded down. Actual
documents then take the places of their group by rank, and what they leave free, together with the large documents the
rounding left over, is filled with the small documents by best fit, in independent parts of the windows.

The driver sees the histogram alone (at most ``capacity`` entries). A document larger than a window fills whole windows and
its rest is laid like any other; no other document is split.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Groups of large documents; items that one task fills by best fit; items ranked in one slice.
GROUPS, PART, SLICE = 40, 20_000, 100_000
#: A document is large above this share of the capacity.
LARGE = 1 / 8


@lru_cache(4)
def encoder(path: str):
    """A tokenizer of ranks in the public format (``base64 rank`` a line)."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding(Path(path).stem, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens`` of every document whose text isn't null or blank."""

    def count(batches):
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            got = [(i, len(encode(t))) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t.strip()]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in got], pa.int64()), "tokens": pa.array([n for _, n in got], pa.int64())})

    return df.select(F.col(doc_id).cast("long"), text).filter(F.col(text).isNotNull()).mapInArrow(count, "doc_id long, tokens long")


def group_sizes(histogram: dict[int, int], capacity: int, groups: int = GROUPS) -> list[int]:
    """Rounded sizes of the large documents, descending; a size belongs to the least of them that isn't below it."""
    large = sorted((s for s in histogram if s > capacity * LARGE), reverse=True)
    each = sum(histogram[s] for s in large) / groups
    out, held = [], 0.0
    for s in large:
        if not out or held >= each:
            out.append(s)
            held = 0.0
        held += histogram[s]
    return out


def _best_configuration(sizes: list[int], value: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The windowful of most value, by the number of items in it."""
    best = np.zeros(capacity + 1)
    choice = []
    for _ in range(capacity // min(sizes)):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for g, s in enumerate(sizes):
            if value[g] > 0 and demand[g] > 0:
                with_g = best[: capacity + 1 - s] + value[g]
                better = with_g > new[s:] + 1e-12
                new[s:][better] = with_g[better]
                pick[s:][better] = g
        if (pick < 0).all():
            break
        choice.append(pick)
        best = new
    a, c = np.zeros(len(sizes)), capacity
    for pick in reversed(choice):
        if pick[c] >= 0:
            a[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(a @ value), a


def configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(documents of each group in a window, number of such windows), from the linear programme's solution rounded down."""
    if not sizes:
        return []
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(50 * len(sizes)):
        dual = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, a = _best_configuration(sizes, dual, demand, capacity)
        if worth <= 1 + 1e-7:
            break
        x, d = np.linalg.solve(basis, demand), np.linalg.solve(basis, a)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = a
    x = np.linalg.solve(basis, demand)
    return [(basis[:, j].round().astype(int), int(np.floor(max(0.0, x[j]) + 1e-9))) for j in range(len(sizes)) if x[j] >= 1]


def best_fit(rooms: list[tuple[int, int]], items: list[tuple[int, tuple]], capacity: int, new_id: int) -> list[tuple[int, tuple]]:
    """(window, item) for items (size, item), largest first, each in the fullest window that still has room."""
    of: dict[int, list[int]] = {}
    mask = 0
    for window, room in rooms:
        of.setdefault(room, []).append(window)
        mask |= 1 << room
    out = []
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        high = mask >> size
        if high:
            room = size + (high & -high).bit_length() - 1
            window = of[room].pop()
            if not of[room]:
                mask &= ~(1 << room)
        else:
            room, window, new_id = capacity, new_id, new_id + 1
        out.append((window, item))
        of.setdefault(room - size, []).append(window)
        mask |= 1 << (room - size)
    return out


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """``window_no, doc_id, piece, first_token, tokens`` for ``sizes`` (``doc_id, tokens``; a repeated id is laid as often as it
    stands). Null or non-positive sizes are left out; an empty table gives an empty result."""
    spark = sizes.sparkSession
    docs = sizes.filter("tokens > 0").select("doc_id", "tokens")
    whole = docs.filter(F.col("tokens") >= capacity).select("doc_id", F.explode(F.expr(f"sequence(0, int(tokens div {capacity}) - 1)")).alias("piece")).select(F.concat(F.lit("w"), "doc_id", F.lit("."), "piece").alias("window_no"), "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), F.lit(capacity).cast("long").alias("tokens"))
    rest = docs.select("doc_id", F.expr(f"int(tokens div {capacity})").alias("piece"), (F.col("tokens") % capacity).alias("tokens")).filter("tokens > 0")
    histogram = {r.tokens: r.n for r in rest.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    rounded = group_sizes(histogram, capacity)
    demand = np.zeros(len(rounded))
    up = np.array(rounded[::-1])
    group_of = {}
    for s, n in histogram.items():
        if s > capacity * LARGE:
            group_of[s] = len(rounded) - 1 - int(np.searchsorted(up, s))
            demand[group_of[s]] += n
    slots, taken, base = [], [0] * len(rounded), 0
    for a, n in configurations(rounded, demand, capacity):
        for g in np.flatnonzero(a).tolist():
            slots.append((g, taken[g], taken[g] + int(a[g]) * n, int(a[g]), base))
            taken[g] += int(a[g]) * n
        base += n
    groups = spark.createDataFrame([(int(s), int(g)) for s, g in group_of.items()], "size long, grp int")
    places = spark.createDataFrame(slots, "g int, lo long, hi long, a int, base long")
    items = sum(histogram.values())
    slice_ = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(-(-items // SLICE) or 1))
    grouped = rest.join(F.broadcast(groups), F.col("tokens") == F.col("size"), "left").withColumn("slice", slice_)
    large = grouped.filter("grp is not null")
    counts = large.groupBy("grp", "slice").agg(F.count("*").alias("n"))
    before = counts.select(F.col("grp").alias("g1"), F.col("slice").alias("s1"), F.coalesce(F.sum("n").over(W.partitionBy("grp").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = large.withColumn("nth", F.row_number().over(W.partitionBy("grp", "slice").orderBy("doc_id", "piece"))).join(before, (F.col("grp") == F.col("g1")) & (F.col("slice") == F.col("s1"))).withColumn("rank", F.col("before") + F.col("nth") - 1)
    put = ranked.join(F.broadcast(places), (F.col("grp") == F.col("g")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    laid = C.checkpoint(put.select("doc_id", "piece", "tokens", F.expr("base + (rank - lo) div a").alias("window")))
    rooms = laid.filter("window is not null").groupBy("window").agg((F.lit(capacity) - F.sum("tokens")).alias("room"))
    parts = -(-items // PART) or 1
    open_rooms = rooms.select(F.pmod(F.xxhash64("window"), F.lit(parts)).alias("part"), "window", F.col("room").alias("n"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("piece"))
    small = grouped.filter("grp is null").select("doc_id", "piece", "tokens").unionByName(laid.filter("window is null").select("doc_id", "piece", "tokens"))
    to_lay = small.select(F.pmod(F.xxhash64("doc_id", "piece", F.lit(1)), F.lit(parts)).alias("part"), F.lit(None).cast("long").alias("window"), F.col("tokens").alias("n"), "doc_id", "piece")

    def fill(t: pa.Table) -> pa.Table:
        rows = list(zip(*(t[c].to_pylist() for c in ("window", "n", "doc_id", "piece"))))
        part = t["part"][0].as_py()
        got = best_fit([(w, n) for w, n, _, _ in rows if w is not None], [(n, (d, p, n)) for w, n, d, p in rows if w is None], capacity, base + (part + 1) * (1 << 32))
        return pa.table({"window": pa.array([w for w, _ in got], pa.int64()), "doc_id": pa.array([x[0] for _, x in got], pa.int64()), "piece": pa.array([x[1] for _, x in got], pa.int32()), "tokens": pa.array([x[2] for _, x in got], pa.int64())})

    filled = open_rooms.unionByName(to_lay).groupBy("part").applyInArrow(fill, "window long, doc_id long, piece int, tokens long")
    both = laid.filter("window is not null").select("window", "doc_id", "piece", "tokens").unionByName(filled)
    return both.select(F.col("window").cast("string").alias("window_no"), "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first_token"), "tokens").unionByName(whole)


def _capacity(spark: SparkSession, sf_dir: str, label: str) -> int:
    return C.table(spark, sf_dir, "context_windows").filter(F.col("label") == label).first().capacity


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2,048 tokens."""
    counts = C.checkpoint(token_counts(C.table(spark, sf_dir, "documents"), "doc_id", "text"))
    return pack(counts, _capacity(spark, sf_dir, "base"))


def p6_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows used at every capacity, against the fewest that could hold all tokens."""
    counts = C.checkpoint(token_counts(C.table(spark, sf_dir, "documents"), "doc_id", "text"))
    out = None
    for r in C.table(spark, sf_dir, "context_windows").orderBy("capacity").collect():
        one = pack(counts, r.capacity).agg(F.lit(r.label).alias("label"), F.countDistinct("window_no").alias("windows"), F.ceil(F.sum("tokens") / r.capacity).alias("least"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"p6_windows": p6_windows, "p6_usage": p6_usage}
