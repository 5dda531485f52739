"""Postings (key, owner, payload) shuffled as packed arrays: one row a batch and bucket instead of one a posting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "bucket int, n long, keys binary, owners binary, extra binary"


class Buckets:
    """Collects postings of a batch and gives one packed row a bucket. The bucket is taken from the key's high bits, so that
    equal keys meet; the low 32 bits go along as the key within the bucket."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.parts = buckets, []

    def add(self, keys: np.ndarray, owners: np.ndarray, extra: np.ndarray) -> None:
        self.parts.append((keys, owners, extra))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        keys, owners, extra = (np.concatenate([p[i] for p in self.parts]) for i in range(3))
        self.parts = []
        bucket = ((keys >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int32)
        order = np.lexsort((keys & np.uint64(0xFFFFFFFF), bucket))
        keys, owners, extra, bucket = keys[order].astype(np.uint32), owners[order], extra[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1))
        at = [k for k in range(self.buckets) if cut[k] < cut[k + 1]]
        part = lambda x: pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in at], pa.binary())
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int32()), "n": pa.array([int(cut[k + 1] - cut[k]) for k in at], pa.int64()), "keys": part(keys), "owners": part(owners), "extra": part(extra)})


def unpack(t: pa.Table, owner: str, extra: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners and extras of a bucket, sorted by key and owner without repeats of both, and where each key's list
    begins (one more entry than lists)."""
    join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t[c].to_pylist()])
    keys, owners, extras = join("keys", np.uint32), join("owners", owner), join("extra", extra)
    order = np.lexsort((owners, keys))
    keys, owners, extras = keys[order], owners[order], extras[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])]
    keys, owners, extras = keys[new], owners[new], extras[new]
    return keys, owners, extras, np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)]


def pairs_of_lists(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs within lists, by size of list."""
    for s in np.unique(sizes[sizes > 1]).tolist():
        at = starts[sizes == s]
        i, j = np.triu_indices(s, 1)
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(at), step):
            a = at[k : k + step, None]
            yield (a + i).ravel(), (a + j).ravel()
