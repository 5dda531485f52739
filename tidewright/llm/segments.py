"""Immutable sorted segments of accepted records in the shared folder, found again by binary search.

A segment holds, of a batch's accepted records, the suffixes of their concatenated titles, to the depth a query looks at (two
characters, led by the title's runs of digits), and the keys of ids and addresses. It is cut into buckets by key; a bucket's file has
its keys in order, and fences, every ``FENCE`` keys one, so that a search reads the fences and the blocks it falls into, never a
segment. What an entry stands for is read from the record itself, by place in a file. Segments of like size are merged, so that n
records lie in about log(n) segments, and none is ever changed.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Keys between two fences; distinct keys asked for, a fence each, above which a bucket is read whole.
FENCE = 256
#: What stands with a key: place of the record (file, offset), size of its set, bitmap of its set.
WORDS = 2
ENTRY = np.dtype([("at", np.uint64), ("n", np.uint32), ("bits", np.uint64, (WORDS,))])
OFFSET = 40


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [lo, hi), one after the other."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)


def bucket_bytes(keys: np.ndarray, entries: np.ndarray) -> bytes:
    """A bucket's file: number of keys, fences, keys in order, entries in the same order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return b"".join([np.uint64(len(keys)).tobytes(), keys[::FENCE].tobytes(), keys.tobytes(), entries[order].tobytes()])


class BucketFile:
    """Binary search in a bucket's file; ``read`` counts the bytes it took."""

    def __init__(self, file) -> None:
        self.file, self.read = file, 0
        self.size = int(self._part(0, 1, np.uint64)[0])
        self.fences = self._part(8, -(-self.size // FENCE), np.uint32)
        self.keys_at = 8 + 4 * len(self.fences)
        self.entries_at = self.keys_at + 4 * self.size

    def _part(self, at: int, n: int, kind) -> np.ndarray:
        kind = np.dtype(kind)
        self.read += n * kind.itemsize
        return np.frombuffer(self.file.read_at(n * kind.itemsize, at), kind)

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the ``asked``, entry) of all entries whose key is among the distinct, ordered ``asked``."""
        none = np.zeros(0, np.int64), np.zeros(0, ENTRY)
        if not self.size or not len(asked):
            return none
        # blocks a key can lie in, from the last fence below it to the first above it
        a = np.maximum(np.searchsorted(self.fences, asked, "left") - 1, 0)
        z = np.searchsorted(self.fences, asked, "right")
        some = np.flatnonzero(z > a)
        if not len(some):
            return none
        a, z = a[some], z[some]
        new = np.r_[True, a[1:] > np.maximum.accumulate(z)[:-1] + 8]  # blocks near each other are read at once
        which, entries = [], []
        edges = np.r_[np.flatnonzero(new), len(some)]
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            first, last = int(a[i]) * FENCE, min(self.size, int(z[i:j].max()) * FENCE)
            keys = self._part(self.keys_at + 4 * first, last - first, np.uint32)
            lo, hi = np.searchsorted(keys, asked[some[i:j]], "left"), np.searchsorted(keys, asked[some[i:j]], "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            lo, hi = lo[hit], hi[hit]
            which.append(np.repeat(some[i:j][hit], hi - lo))
            b = int(lo.min())
            if int((hi - lo).sum()) * 4 > int(hi.max()) - b:
                entries.append(self._part(self.entries_at + ENTRY.itemsize * (first + b), int(hi.max()) - b, ENTRY)[ranges(lo - b, hi - b)])
            else:
                entries += [self._part(self.entries_at + ENTRY.itemsize * (first + x), y - x, ENTRY) for x, y in zip(lo.tolist(), hi.tolist())]
        return (np.concatenate(which), np.concatenate(entries)) if which else none


class Records:
    """Records of segments by place, read one by one; ``read`` counts bytes."""

    def __init__(self, fs, path: str) -> None:
        self.fs, self.path, self.open, self.read = fs, path, {}, 0

    def __call__(self, segment: str, at: int) -> list:
        name = f"{segment}/records-{at >> OFFSET}"
        if name not in self.open:
            if len(self.open) > 64:
                self.open = {}
            self.open[name] = self.fs.open_input_file(f"{self.path}/{name}")
        at &= (1 << OFFSET) - 1
        head = self.open[name].read_at(512, at)
        n = int.from_bytes(head[:4], "little")
        body = head[4 : 4 + n] if n <= 508 else self.open[name].read_at(n, at + 4)
        self.read += max(512, n)
        return json.loads(body)


class Store:
    """Segments under a folder, by default one in ``spark.checkpoint.dir``. The list of segments is a small file, written anew
    when one is added; who opens the folder later goes on where it was left."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 32) -> None:
        self.spark, self.path = spark, path or f"{C.folder(spark)}/history-{uuid.uuid4().hex}"
        fs, p = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(p)
        if fs.get_file_info(f"{p}/segments.json").type == pafs.FileType.File:
            with fs.open_input_file(f"{p}/segments.json") as f:
                self.state = json.loads(f.read())
        else:
            self.state = {"buckets": buckets, "order": None, "segments": []}

    @property
    def buckets(self) -> int:
        return self.state["buckets"]

    @property
    def segments(self) -> list[dict]:
        """Name and number of records of each, the oldest first."""
        return self.state["segments"]

    def order(self, make) -> tuple[np.ndarray, int]:
        """The classes of frequency by which sequences are ordered, and how many titles they were counted in: made once, with the first
        records, and kept, since all segments must be ordered alike."""
        fs, p = pafs.FileSystem.from_uri(self.path)
        if self.state["order"] is None:
            self.state["order"] = f"order-{uuid.uuid4().hex}"
            classes, self.state["sampled"] = make()
            with fs.open_output_stream(f"{p}/{self.state['order']}") as f:
                f.write(classes.astype(np.uint8).tobytes())
        with fs.open_input_file(f"{p}/{self.state['order']}") as f:
            return np.frombuffer(f.read(), np.uint8), self.state["sampled"]

    def _save(self) -> None:
        fs, p = pafs.FileSystem.from_uri(self.path)
        with fs.open_output_stream(f"{p}/segments.new") as f:
            f.write(json.dumps(self.state).encode())
        fs.move(f"{p}/segments.new", f"{p}/segments.json")

    def add(self, records: DataFrame, postings, count: int) -> None:
        """A segment of the records (``r, id, page, digits, bare``), which are read from a written table. ``postings(batch)`` gives (row, 64-bit key, size, bitmap) arrays."""
        name, path, buckets = f"s-{uuid.uuid4().hex}", self.path, self.buckets
        pafs.FileSystem.from_uri(path)[0].create_dir(pafs.FileSystem.from_uri(f"{path}/{name}")[1])

        def write(batches):
            from pyspark import TaskContext

            fs, p = pafs.FileSystem.from_uri(path)
            part, attempt, at = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
            with fs.open_output_stream(f"{p}/{name}/new-{attempt}") as f:
                for b in batches:
                    places = []
                    for row in zip(*(c.to_pylist() for c in b.columns)):
                        body = json.dumps(row, ensure_ascii=False).encode("utf-8", "surrogatepass")
                        f.write(len(body).to_bytes(4, "little") + body)
                        places.append((part << OFFSET) | at)
                        at += 4 + len(body)
                    who, key, n, bits = postings(b)
                    e = np.empty(len(who), ENTRY)
                    e["at"], e["n"], e["bits"] = np.array(places, np.uint64)[who], n, bits
                    bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                    order = np.argsort(bucket, kind="stable")
                    low, e, bucket = key[order].astype(np.uint32), e[order], bucket[order]
                    cut = np.searchsorted(bucket, np.arange(buckets + 1))
                    have = [k for k in range(buckets) if cut[k] < cut[k + 1]]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(have, pa.int32()), "keys": pa.array([low[cut[k] : cut[k + 1]].tobytes() for k in have], pa.binary()), "entries": pa.array([e[cut[k] : cut[k + 1]].tobytes() for k in have], pa.binary())})
            fs.move(f"{p}/{name}/new-{attempt}", f"{p}/{name}/records-{part}")  # a task that runs again writes the same

        def seal(t: pa.Table) -> pa.Table:
            order = np.argsort([a[:64] for a in t["entries"].to_pylist()])
            keys = np.concatenate([np.frombuffer(t["keys"][i].as_py(), np.uint32) for i in order.tolist()])
            entries = np.concatenate([np.frombuffer(t["entries"][i].as_py(), ENTRY) for i in order.tolist()])
            return _write_bucket(path, name, t["bucket"][0].as_py(), bucket_bytes(keys, entries))

        records.select("r", "id", "page", "digits", "bare").mapInArrow(write, "bucket int, keys binary, entries binary").groupBy("bucket").applyInArrow(seal, "bucket int, bytes long").agg(F.sum("bytes")).first()
        self.segments.append({"name": name, "records": count, "of": [name]})
        like = lambda a, b: a["records"] < 2 * b["records"] and len(a["of"]) + len(b["of"]) < 1 << 12
        old = []
        while len(self.segments) > 1 and like(*self.segments[-2:]):
            old += self.segments[-2:]
            self._merge()
        self._save()
        fs, p = pafs.FileSystem.from_uri(path)
        for s in old:  # the sorted keys of these are in the new segment, their records stay
            for k in range(self.buckets):
                if fs.get_file_info(f"{p}/{s['name']}/bucket-{k}").type == pafs.FileType.File:
                    fs.delete_file(f"{p}/{s['name']}/bucket-{k}")

    def _merge(self) -> None:
        """The two newest segments as one. Records stay where they are: the merged segment's places lead to both."""
        b, a = self.segments.pop(), self.segments.pop()
        name, path = f"s-{uuid.uuid4().hex}", self.path
        fs, p = pafs.FileSystem.from_uri(path)
        fs.create_dir(f"{p}/{name}")
        shift = len(a["of"])

        def merge(batches):
            fs, p = pafs.FileSystem.from_uri(path)
            for x in batches:
                for k in x.column(0).to_pylist():
                    keys, entries = [], []
                    for i, s in enumerate((a, b)):
                        file = f"{p}/{s['name']}/bucket-{k}"
                        if fs.get_file_info(file).type == pafs.FileType.File:
                            with fs.open_input_file(file) as f:
                                bf = BucketFile(f)
                                keys.append(bf._part(bf.keys_at, bf.size, np.uint32))
                                e = bf._part(bf.entries_at, bf.size, ENTRY).copy()
                            e["at"] += np.uint64((i * shift) << (OFFSET + 12))
                            entries.append(e)
                    if keys:
                        _write_bucket(path, name, k, bucket_bytes(np.concatenate(keys), np.concatenate(entries)))
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32())})

        self.spark.range(0, self.buckets, 1, self.buckets).select(F.col("id").cast("int").alias("bucket")).mapInArrow(merge, "bucket int").count()
        self.segments.append({"name": name, "records": a["records"] + b["records"], "of": a["of"] + b["of"]})

    def remove(self) -> None:
        fs, p = pafs.FileSystem.from_uri(self.path)
        fs.delete_dir(p)


def place(segment: dict, at: int) -> tuple[str, int]:
    """The segment whose files hold a record, and the record's place there: 12 bits of the file number lie below those that say
    which of the merged segments it is."""
    return segment["of"][at >> (OFFSET + 12)], at & ((1 << (OFFSET + 12)) - 1)


def _write_bucket(path: str, name: str, bucket: int, body: bytes) -> pa.Table:
    fs, p = pafs.FileSystem.from_uri(path)
    new = f"{p}/{name}/new-{uuid.uuid4().hex}"
    with fs.open_output_stream(new) as f:
        f.write(body)
    fs.move(new, f"{p}/{name}/bucket-{bucket}")
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "bytes": pa.array([len(body)], pa.int64())})
