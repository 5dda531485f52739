"""Problem 7: test items that stand, whole or in part, in documents of any length.

Containment by MinHash fails on a short item in a long document as long as the sets differ in size. So sizes are made
equal: both sides are cut into windows of the shortest run that counts (``run`` letters), each holding the same number of
shingles, and a window's signature is its one least shingle hash. A run of the item that stands in the document gives both
sides the same windows, the same sets and so, with certainty, the same minima. From the minima found, each item's greatest
possible coverage follows; only items that can reach the share are verified, exactly, by the shingles of ``run`` letters
that the document contains.

The items' bare texts lie in the shared folder in blocks of a bounded number of letters. A task makes one block's tables at a time and
searches them for as many of its documents as it may hold, so the documents are read once however many items there are. They
never leave their task, so there is no shuffle, and a hot source or a very long text costs what its length costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes as K
from . import common as C

#: Letters of items in one block, on average; a block's tables take about 40 bytes a letter in every worker.
BLOCK_LETTERS = 1_000_000
#: Letters of documents that a task holds while it goes through several blocks.
HELD = 8_000_000


class ItemIndex:
    """Window minima of a block of items: which minimum covers which of an item's letters."""

    def __init__(self, items: list[tuple[int, str]], run: int, share: float) -> None:
        self.run, self.share, self.k = run, share, run // 2
        self.w = run - self.k + 1
        kept = [(i, b) for i, b in items if len(b) >= run]
        self.ids, self.texts = [i for i, _ in kept], [b for _, b in kept]
        self.windows = []  # of each item: the minimum of every window of ``run`` letters
        minima = []
        for b in self.texts:
            h = K.hashes(K.codes([b])[0], self.k)
            low = K._slide(h, self.w, np.minimum)
            self.windows.append(low)
            minima.append(np.unique(low))
        which = np.repeat(np.arange(len(kept)), [len(m) for m in minima]) if kept else np.zeros(0, np.int64)
        flat = np.concatenate(minima) if kept else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.minima, self.which = flat[order], which[order]

    def covered(self, hit: np.ndarray, n: int) -> int:
        """Letters in the union of the windows that were hit."""
        d = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(hit)
        d[at] += 1
        d[at + self.run] -= 1
        return int((np.cumsum(d[:n]) > 0).sum())

    def search(self, c: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) for documents given as bare codes."""
        if not len(self.minima):
            return
        p, h = K.anchors(c, starts, self.k, self.w)
        at = np.searchsorted(self.minima, h)
        found = np.flatnonzero(self.minima[np.minimum(at, len(self.minima) - 1)] == h)
        if not len(found):
            return
        doc = np.searchsorted(starts, p[found], side="right") - 1
        lo, hi = at[found], np.searchsorted(self.minima, h[found], side="right")
        n = hi - lo
        each = np.repeat(np.arange(len(found)), n)
        entry = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.unique(doc[each] * np.int64(len(self.ids)) + self.which[entry])
        hits: dict[int, np.ndarray] = {}
        for d in np.unique(pair // len(self.ids)).tolist():
            hits[d] = np.unique(h[found[doc == d]])
        texts: dict[int, str] = {}
        for x in pair.tolist():
            d, i = divmod(x, len(self.ids))
            b = self.texts[i]
            possible = np.isin(self.windows[i], hits[d])
            if self.covered(possible, len(b)) < self.share * len(b):
                continue
            if d not in texts:
                texts = {d: c[starts[d] : starts[d + 1]].tobytes().decode("utf-32-le")}
            t = texts[d]
            real = np.array([ok and b[j : j + self.run] in t for j, ok in enumerate(possible.tolist())], bool)
            if self.covered(real, len(b)) >= self.share * len(b):
                yield d, self.ids[i]


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 30, share: float = 0.5) -> DataFrame:
    """``doc_id, item_id``: at least ``share`` of the item's bare letters lie in runs of ``run`` or more that also stand in the
    document's bare text. Null and blank texts, and items shorter than ``run``, match nothing; repeated rows of a document
    give repeated rows; an empty side gives an empty result."""
    kinds = f"{doc_id} long, {item_id} long"
    tables = C.Tables(docs.sparkSession)

    def bare_items(batches):
        for b in batches:
            texts = K.as_text(*K.bare(b.column(1).to_pylist()))
            ok = pa.array([len(x) >= run for x in texts])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), pa.array(texts, pa.string()).filter(ok)], ["i", "b"])

    wanted = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null")
    kept = tables.put(wanted.mapInArrow(bare_items, "i long, b string"))
    letters = kept.agg(F.sum(F.length("b"))).first()[0] or 0
    blocks = -(-letters // BLOCK_LETTERS)
    tables.put(kept.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(max(1, blocks)))), "block")
    where = tables.last

    def index_of(block: int) -> ItemIndex:
        fs, path = pafs.FileSystem.from_uri(f"{where}/block={block}")
        if fs.get_file_info(path).type != pafs.FileType.Directory:
            return ItemIndex([], run, share)
        t = pq.read_table(path, filesystem=fs, columns=["i", "b"], partitioning=None)
        return ItemIndex(list(zip(t["i"].to_pylist(), t["b"].to_pylist())), run, share)

    def search(batches):
        made: dict[int, ItemIndex] = {}

        def over(held):
            for block in range(blocks):
                if block not in made:
                    made.clear()  # one block at a time
                    made[block] = index_of(block)
                for ids, c, starts in held:
                    got = list(made[block].search(c, starts))
                    if got:
                        yield pa.RecordBatch.from_pydict({doc_id: pa.array([ids[d] for d, _ in got], pa.int64()), item_id: pa.array([x for _, x in got], pa.int64())})

        held, size = [], 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in C.slices(texts):
                c, starts = K.bare(texts[i:j])
                held.append((ids[i:j], c, starts))
                size += len(c)
                if blocks == 1 or size > HELD:
                    yield from over(held)
                    held, size = [], 0
        yield from over(held)

    found = C.checkpoint(docs.select(F.col(doc_id).cast("long"), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(search, kinds))
    tables.remove()
    return found


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(C.table(spark, sf_dir, "documents"), "doc_id", "text", C.table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents leak items of each task, and how many of its items leak."""
    items = C.table(spark, sf_dir, "eval_items")
    return p7_found(spark, sf_dir).join(items.select("item_id", "task"), "item_id").groupBy("task").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))


QUERIES = {"p7_found": p7_found, "p7_tasks": p7_tasks}
