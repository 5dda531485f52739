"""Problem 8: long spans that stand word for word in more than one record.

The method is hashing of units: digests of units are grouped globally, and the occurrence that ranks earliest is kept. Lines
and paragraphs can't be the units here, since a shared span may begin and end within a line; so a unit is a stretch of
``3/4 * length`` characters that is cut where its own content says so (least by hash among its neighbours). Every span of
``length`` characters holds such a unit, and wherever the span stands it holds the same one.

A digest seen twice brings its occurrences with the characters around them: two occurrences belong to one span of ``length``
characters exactly if what they share before and after the unit makes up the rest. Digests with many occurrences aren't
compared pair by pair but by the spans of ``length`` characters themselves, so that a passage just too short costs nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import codes as K
from . import common as C
from . import postings as P

#: Occurrences of a digest up to which they are compared pair by pair.
FEW = 40
#: Makes a second hash beside that of ``codes``, so that spans are compared by 128 bits.
_OTHER = np.uint64(0xD6E8FEB86659FD93)
#: Unit occurrences, and rows compared, of a bucket, on average.
UNITS, COMPARED = 1_000_000, 20_000


def _sizes(length: int) -> tuple[int, int]:
    k = max(1, length * 3 // 4)
    return k, length - k + 1


def shared_units(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """``doc, at, digest``: unit occurrences whose digest stands in at least two documents. A batch that sees a digest in two
    documents passes its occurrences on as they are and sends one witness, so that a digest's bucket gets at most one
    or two postings from each batch."""
    k, w = _sizes(length)
    rows = docs.select(F.col(doc_id).cast("long"), F.col(text)).filter(F.length(text) >= length)
    letters = rows.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(letters * 2 / (w + 1)) // UNITS)
    place = np.dtype([("doc", np.int64), ("at", np.int32)])

    def emit(batches):
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            docs_, ats, hs = [], [], []
            for i, j in C.slices(texts):
                c, starts = K.codes(texts[i:j])
                p, h = K.anchors(c, starts, k, w)
                who = np.searchsorted(starts, p, side="right") - 1
                docs_.append(np.array(ids[i:j], np.int64)[who])
                ats.append((p - starts[who]).astype(np.int32))
                hs.append(h)
            if not hs or not sum(map(len, hs)):
                continue
            doc, at, h = map(np.concatenate, (docs_, ats, hs))
            order = np.lexsort((doc, h))
            doc, at, h = doc[order], at[order], h[order]
            first = np.r_[True, h[1:] != h[:-1]]
            group = np.cumsum(first) - 1
            several = np.zeros(group[-1] + 1, bool)
            several[group[1:][(h[1:] == h[:-1]) & (doc[1:] != doc[:-1])]] = True
            shared = several[group]
            out = P.Buckets(buckets)
            one = np.zeros(len(h), place)
            one["doc"], one["at"] = doc, at
            send = ~shared | first
            out.add(h[send], one[send].view("V12").ravel(), shared[send].astype(np.uint8))
            yield from out.rows()
            if shared.any():  # where they go is no matter: spread by document
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([-1 - int(doc[shared][0]) % buckets], pa.int32()), "n": pa.array([int(shared.sum())], pa.int64()), "keys": pa.array([h[shared].tobytes()], pa.binary()), "owners": pa.array([one[shared].tobytes()], pa.binary()), "extra": pa.array([b""], pa.binary())})

    def meet(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() < 0:
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()])
            o = np.concatenate([np.frombuffer(x, place) for x in t["owners"].to_pylist()])
            return pa.table({"doc": pa.array(o["doc"]), "at": pa.array(o["at"]), "digest": pa.array((h & np.uint64(0xFFFFFFFF)).astype(np.int64) + ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) * np.int64(1 << 32))})
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in t["keys"].to_pylist()])
        owners = np.concatenate([np.frombuffer(x, place) for x in t["owners"].to_pylist()])
        witness = np.concatenate([np.frombuffer(x, np.uint8) for x in t["extra"].to_pylist()])
        order = np.lexsort((owners["doc"], keys))
        keys, owners, witness = keys[order], owners[order], witness[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        group = np.cumsum(first) - 1
        several = np.zeros(group[-1] + 1, bool)
        several[group[1:][(keys[1:] == keys[:-1]) & (owners["doc"][1:] != owners["doc"][:-1])]] = True
        several[group[witness > 0]] = True
        ok = several[group] & (witness == 0)
        return pa.table({"doc": pa.array(owners["doc"][ok]), "at": pa.array(owners["at"][ok]), "digest": pa.array(keys[ok].astype(np.int64) + np.int64(t["bucket"][0].as_py()) * np.int64(1 << 32))})

    return rows.mapInArrow(emit, P.SCHEMA).groupBy("bucket").applyInArrow(meet, "doc long, at int, digest long")


def occurrences(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """``doc, at, digest, around``: shared units with up to ``length - k`` characters before and after, the place of the unit in
    ``around`` as ``lead``."""
    k, _ = _sizes(length)
    side = length - k
    units = shared_units(docs, doc_id, text, length)
    t = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("_text")).filter(F.length("_text") >= length)
    start = F.greatest(F.col("at") - side, F.lit(0))
    placed = units.join(t, "doc").select("doc", "at", "digest", (F.col("at") - start).cast("int").alias("lead"), F.expr(f"substring(_text, int(greatest(at - {side}, 0)) + 1, int(at - greatest(at - {side}, 0)) + {k + side})").alias("around"))
    return C.checkpoint(placed)


def _common(a: str, b: str, most: int) -> int:
    n = min(len(a), len(b), most)
    if a[:n] == b[:n]:
        return n
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def span_pairs(docs: DataFrame, doc_id: str, text: str, length: int = 200, found: DataFrame | None = None) -> DataFrame:
    """``doc_lo, doc_hi``: pairs of documents that share a span of at least ``length`` code points, exactly as stored. Null
    and shorter texts share nothing; a span repeated within one document alone is no pair; rows repeating an id are one document."""
    k, _ = _sizes(length)
    found = (occurrences(docs, doc_id, text, length) if found is None else found).dropDuplicates(["doc", "digest", "lead", "around"])
    count = found.groupBy("digest").agg(F.count("*").alias("n"))
    sized = found.join(count, "digest")
    buckets = max(32, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.count() // COMPARED)

    def compare(t: pa.Table) -> pa.Table:
        rows = sorted(zip(*(t[c].to_pylist() for c in ("digest", "doc", "lead", "around"))))
        out, i = set(), 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            for x in range(i, j):
                _, dx, lx, ax = rows[x]
                before, unit, after = ax[:lx][::-1], ax[lx : lx + k], ax[lx + k :]
                for y in range(x + 1, j):
                    _, dy, ly, ay = rows[y]
                    if dx == dy or (dx, dy) in out or ay[ly : ly + k] != unit:
                        continue
                    if _common(before, ay[:ly][::-1], length) + k + _common(after, ay[ly + k :], length) >= length:
                        out.add((dx, dy))
            i = j
        return pa.table({"doc_lo": pa.array([a for a, _ in out], pa.int64()), "doc_hi": pa.array([b for _, b in out], pa.int64())})

    few = sized.filter(F.col("n") <= FEW).groupBy(F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("part")).applyInArrow(compare, "doc_lo long, doc_hi long")

    spans = _spans(sized.filter(F.col("n") > FEW), length).select("doc", "span", "earlier").distinct()
    a, b = spans.alias("a"), spans.alias("b")
    leftmost = F.col("a.earlier").isNull() | F.col("b.earlier").isNull() | (F.col("a.earlier") != F.col("b.earlier"))
    many = a.join(b, (F.col("a.span") == F.col("b.span")) & (F.col("a.doc") < F.col("b.doc")) & leftmost).select(F.col("a.doc").alias("doc_lo"), F.col("b.doc").alias("doc_hi"))
    return few.unionByName(many).distinct()


def _spans(found: DataFrame, length: int) -> DataFrame:
    """``doc, start, span, earlier``: every span of ``length`` characters around the occurrences, and the span one character
    before it (null at the first)."""

    def digests(h: np.ndarray) -> pa.Array:
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(h), [None, pa.py_buffer(np.ascontiguousarray(h).tobytes())]).cast(pa.binary())

    def cut(batches):
        for b in batches:
            docs, ats, leads = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            texts = b.column(3).to_pylist()
            for i, j in C.slices(texts):
                c, starts = K.codes(texts[i:j])
                h = np.column_stack([K.hashes(c, length), K.hashes(c, length, _OTHER)])
                who = K.owner(starts)[: len(h)]
                p = np.flatnonzero(np.arange(len(h)) + length <= starts[who + 1])
                first = p == starts[who[p]]  # no span before it
                before = digests(h[np.maximum(p - 1, 0)])
                w = who[p] + i
                yield pa.RecordBatch.from_pydict({"doc": pa.array(docs[w]), "start": pa.array(ats[w] - leads[w] + p - starts[who[p]]), "span": digests(h[p]), "earlier": pa.compute.if_else(pa.array(first), pa.scalar(None, pa.binary()), before)})

    return found.select("doc", "at", "lead", "around").mapInArrow(cut, "doc long, start long, span binary, earlier binary")


def shared_stretches(docs: DataFrame, doc_id: str, text: str, length: int = 200, first: bool = False) -> DataFrame:
    """``doc, start, stop``: the stretches of each document that stand elsewhere in spans of ``length`` or more, with offsets
    into the stored text. With ``first``, the occurrence that ranks earliest (least document, then offset) isn't given: what
    comes out is what a removal of repeats takes away."""
    spans = _spans(occurrences(docs, doc_id, text, length), length).select("doc", "start", "span").distinct()
    by = spans.groupBy("span").agg(F.min(F.struct("doc", "start")).alias("keep"), F.min("doc").alias("d0"), F.max("doc").alias("d1")).filter("d0 <> d1").select("span", "keep")
    again = spans.join(by, "span")
    if first:
        again = again.filter((F.col("doc") != F.col("keep.doc")) | (F.col("start") != F.col("keep.start")))
    w = W.partitionBy("doc").orderBy("start")
    marked = again.select("doc", "start").distinct().withColumn("new", (F.col("start") > F.coalesce(F.lag("start").over(w) + length, F.lit(-1))).cast("int")).withColumn("island", F.sum("new").over(w))
    return marked.groupBy("doc", "island").agg(F.min("start").alias("start"), (F.max("start") + length).alias("stop")).select("doc", "start", "stop")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_pairs(C.table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document stands elsewhere."""
    docs = C.table(spark, sf_dir, "documents")
    s = shared_stretches(docs, "doc_id", "text").groupBy("doc").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"), F.count("*").alias("stretches"))
    return s.join(docs.select(F.col("doc_id").alias("doc"), "n_chars"), "doc").select(F.col("doc").alias("doc_id"), "shared_chars", "stretches", "n_chars")


def p8_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a removal of repeats takes from each document."""
    return shared_stretches(C.table(spark, sf_dir, "documents"), "doc_id", "text", first=True).withColumnRenamed("doc", "doc_id")


QUERIES = {"p8_found": p8_found, "p8_shared": p8_shared, "p8_removed": p8_removed}
