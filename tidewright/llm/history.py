"""Problem 2: telling new records from those known already, batch by batch, against everything accepted before.

Accepted records lie in immutable sorted segments in the shared folder (``segments.Store``): the suffixes of a batch's concatenated
titles, led by the title's runs of digits and to the depth of two characters, which is what the criterion is on, and keys of ids and
addresses. For a new batch, the substrings of each title that any record with enough of them must share one of (the rarest 40 % in a
fixed order) are binary-searched in every segment; sizes and bitmaps by the entries leave few records, which are read by
place and compared exactly. No row of the history is read, so the cost follows the batch.

Within the batch the same substrings meet in the same buckets. Acceptance is in arrival order: a row is a repeat only if an *accepted*
row is like it. Rows known from the history are repeats; the others are settled in rounds, in each of which all rows are accepted that
are earliest among their undecided like; what remains under a stated bound is settled in one pass in arrival order. The accepted
ones become a new segment.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from urllib.parse import parse_qsl

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes as K
from . import common as C
from . import neardup
from . import postings as P
from .neardup import COUNTERS, _counter, _least, _list_pairs, _slices, lists_of, parted, similar
from .segments import WORDS, BucketFile, Records, Store, place

SHARE = 0.6
#: Titles whose sequences are counted for the order of tokens.
SAMPLE = 100_000
#: Claims that one task may settle.
LAST = 1_000_000
#: Rows of the first increment of a table that is taken in at once; with each later one ``GROWTH`` times as many are known.
FIRST, GROWTH = 25_000, 5
#: Titles of a file of sizes and bitmaps, numbered by 15 bits.
TITLES = 32_768
#: Range entries that are compared at once, so that memory is bounded whatever the number of hits.
READ = 1_000_000
_DIGITS = re.compile("[0-9]+")


def page_key(address: str | None) -> str | None:
    """Host without case and leading ``www.``, path without a final slash, and the values of ``id``, ``aid`` and ``cat``."""
    if not address or "://" not in address:
        return None
    rest = address.strip().partition("://")[2].partition("#")[0]
    where, _, query = rest.partition("?")
    host, slash, path = where.partition("/")
    host = host.lower()
    host = host[4:] if host.startswith("www.") else host
    if not host:
        return None
    path = slash + path
    path = path[:-1] if path.endswith("/") else path
    told = sorted((k, v) for k, v in parse_qsl(query, keep_blank_values=True) if k in ("id", "aid", "cat")) if query else ()
    return "\x1f".join([host, path, *(f"{k}={v}" for k, v in told)])


def digit_runs(title: str | None) -> str:
    """The runs of digits in a title's look as a multiset: sorted and joined."""
    return "-".join(sorted(_DIGITS.findall(title))) if title else ""


def _hash(kind: str, text: str) -> int:
    return int.from_bytes(hashlib.blake2b((kind + text).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def title_suffixes(bare: list[str], digits: list[str], classes: np.ndarray, share: float = SHARE):
    """(title, key, place, size, bitmap, class) of the substrings of which any title with the share has one: two characters, led by the
    digits, the rarest first."""
    c, starts = K.codes(bare)
    led = {d: _hash("d", d) for d in set(digits)}
    salt = np.array([led[d] for d in digits], np.uint64)
    h = K.hashes(c, 2)
    who = K.owner(starts)
    inside = who[: len(h)] == who[1:] if len(h) else np.zeros(0, bool)
    h = h[inside]
    key = K.sorted_set((who[: len(inside)][inside].astype(np.uint64) << np.uint64(53)) | (classes[_counter(h)].astype(np.uint64) << np.uint64(47)) | (h >> np.uint64(17)))
    who, t = (key >> np.uint64(53)).astype(np.int64), K.mix(key & np.uint64((1 << 53) - 1))
    n = np.bincount(who, minlength=len(starts) - 1)
    bit = np.zeros((len(n), 64 * WORDS), np.uint8)
    bit[who, (t % np.uint64(64 * WORDS)).astype(np.int64)] = 1
    at = np.arange(len(t)) - np.r_[0, np.cumsum(n)][who]
    keep = at <= (n - _least(n, share))[who]
    return who[keep], K.mix(t[keep] ^ salt[who[keep]]), at[keep], n, np.packbits(bit, axis=1).view(np.uint64), ((key[keep] >> np.uint64(47)) & np.uint64(63)).astype(np.int64)


def _suffixes(values: list[str], digits: list[str], classes: np.ndarray):
    """``title_suffixes`` of any number of titles."""
    parts = [(a, *title_suffixes(values[a:b], digits[a:b], classes)) for a, b in _slices(values)]
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*((who + a, *rest) for a, who, *rest in parts)))


def _equal(kinds: list[str], values: list[str]) -> np.ndarray:
    """Keys of ids and addresses."""
    return np.array([_hash(k, v) for k, v in zip(kinds, values)], np.uint64)


def read_rows(df: DataFrame, ordinal: str, id_: str, title: str, address) -> DataFrame:
    """``r, id, page, digits, bare`` of every row; digits are the title's digit runs as a multiset."""

    def read(batches):
        for b in batches:
            titles = b.column(2).to_pylist()
            bare = K.as_text(*K.bare(titles))
            yield pa.RecordBatch.from_pydict({
                "r": b.column(0), "id": b.column(1), "page": pa.array([page_key(x) for x in b.column(3).to_pylist()], pa.string()),
                "digits": pa.array([digit_runs(x) for x in K.looks(titles)], pa.string()), "bare": pa.array([s if len(s) > 1 else None for s in bare], pa.string()),
            })

    return df.select(F.col(ordinal).cast("long"), F.col(id_).cast("string"), title, address).mapInArrow(read, "r long, id string, page string, digits string, bare string")


def _classes(names: DataFrame) -> tuple[np.ndarray, int]:
    """Classes of frequency of two-character sequences in a sample of titles, by counter of their hash, and the titles of the sample."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int32)
        for b in batches:
            col = b.column(0).to_pylist()
            for i, j in C.slices(col):
                total += np.bincount(_counter(K.grams(*K.codes(col[i:j]), 2)[1]), minlength=COUNTERS).astype(np.int32)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array([C.packed(np.int32, at)], pa.binary()), "n": pa.array([C.packed(np.int32, total[at])], pa.binary())})

    titles = names.filter("kind = 't'").select("value")
    rows = titles.count()
    total = np.zeros(COUNTERS, np.int64)
    for r in (titles.sample(SAMPLE / rows, 7) if rows > SAMPLE else titles).mapInArrow(count, "at binary, n binary").toLocalIterator():
        total[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["n"], np.int32)
    return np.minimum(63, np.log2(total + 1) * 3.5).astype(np.uint8), min(rows, SAMPLE)


def like(names: DataFrame, classes: np.ndarray, scale: float, store: Store | None) -> DataFrame:
    """``a, b, segment``: names (``num, kind, digits, value``) that may be alike: pairs of titles of the batch (segment -1), and names
    with places of records in the store's segments."""
    path, segments, buckets = (store.path, store.segments, store.buckets) if store else (None, [], 32)
    order, most = names.sparkSession.sparkContext.broadcast(classes), neardup.LIST
    folder = f"{C.folder(names.sparkSession)}/titles-{uuid.uuid4().hex}"
    files = lambda: pafs.FileSystem.from_uri(folder)
    fs, here = files()
    fs.create_dir(here)

    def emit(batches):
        fs, here = files()
        for whole in batches:
            for at in range(0, whole.num_rows, TITLES):
                b = whole.slice(at, TITLES)
                num = b.column(0).to_numpy(zero_copy_only=False)
                kinds, digits, values = (b.column(i).to_pylist() for i in (1, 2, 3))
                titles = [i for i, k in enumerate(kinds) if k == "t"]
                others = [i for i, k in enumerate(kinds) if k != "t"]
                out, name = P.Buckets(buckets), uuid.uuid4().hex
                if titles:
                    who, key, place_, n, bits, classes_of = _suffixes([values[i] for i in titles], [digits[i] for i in titles], order.value)
                    out.add(*parted(key, who.astype(np.uint16), place_, np.exp2(classes_of / 3.5) * scale, num[titles][who], most, bool(segments)))
                    with fs.open_output_stream(f"{here}/{name}") as f:
                        f.write(np.column_stack([num[titles].view(np.uint64), n.astype(np.uint64), bits]).tobytes())
                    for r in out.rows():
                        yield r.append_column("name", pa.array([name] * r.num_rows))
                if others:
                    out.add(_equal([kinds[i] for i in others], [values[i] for i in others]), num[others], np.zeros(len(others), np.uint8))
                    for r in out.rows():
                        yield r.append_column("name", pa.array([""] * r.num_rows))

    def among(key, owner, at, sheet):
        """Pairs of the batch's titles."""
        order = np.argsort(sheet[:, 1], kind="stable")
        number = np.empty(len(sheet), np.uint64)
        number[order] = np.arange(len(sheet), dtype=np.uint64)
        sheet = sheet[order]
        who, at, cut, opposite = lists_of(key, number[owner], at)
        found, waiting, m = np.zeros(0, np.int64), [], len(sheet)
        for i, j in _list_pairs(who, at, cut, sheet[:, 1].astype(np.int64), sheet[:, 2:], SHARE, opposite):
            waiting.append(i * m + j)
            if len(waiting) >= 4096:
                found, waiting = K.sorted_set(np.concatenate([found, *waiting])), []
        found = K.sorted_set(np.concatenate([found, *waiting]))
        nums = np.ascontiguousarray(sheet[:, 0]).view(np.int64)
        return nums[found // m], nums[found % m], np.full(len(found), -1)

    def before(bucket, key, num, n, bits):
        """Records of the segments, by entries of the same key whose sizes and bitmaps don't rule them out."""
        fs, p = pafs.FileSystem.from_uri(path)
        o = np.argsort(key, kind="stable")
        key, num, n, bits = key[o], num[o], n[o], bits[o]
        asked, begin = np.unique(key, return_index=True)
        end = np.r_[begin[1:], len(key)]
        apart = (1 - SHARE) / (1 + SHARE)
        for s, segment in enumerate(segments):
            name = f"{p}/{segment['name']}/bucket-{bucket}"
            if fs.get_file_info(name).type != pafs.FileType.File:
                continue
            with fs.open_input_file(name) as f:
                which, entry = BucketFile(f).find(asked)
            width = end[which] - begin[which]
            total = np.r_[0, np.cumsum(width)]
            x = 0
            while x < len(which):
                y = max(x + 1, int(np.searchsorted(total, total[x] + READ, "right")) - 1)
                w = which[x:y]
                q = np.arange(int(total[y] - total[x])) + np.repeat(begin[w] - (total[x:y] - total[x]), width[x:y])
                e = entry[np.repeat(np.arange(x, y), width[x:y])]
                a, b = n[q], e["n"].astype(np.int64)
                ok = (SHARE * a <= b + 1e-9) & (SHARE * b <= a + 1e-9)  # ids and addresses have size 0 and meet their like only
                q, e, a, b = q[ok], e[ok], a[ok], b[ok]
                ok = np.bitwise_count(bits[q] ^ e["bits"]).sum(axis=1) <= apart * (a + b) + 1e-9
                yield num[q[ok]], e["at"][ok].astype(np.int64), np.full(int(ok.sum()), s)
                x = y

    def meet(t: pa.Table) -> pa.Table:
        fs, here = files()
        keys, owners, places, sheets, have, equal = [], [], [], [], 0, []
        for name, ks, os, ps in zip(*(t[c].to_pylist() for c in ("name", "keys", "owners", "extra"))):
            if not name:
                equal.append((np.frombuffer(ks, np.uint32), np.frombuffer(os, np.int64)))
                continue
            with fs.open_input_file(f"{here}/{name}") as f:
                sheet = np.frombuffer(f.read(), np.uint64).reshape(-1, 2 + WORDS)
            os = np.frombuffer(os, np.uint16)
            used = np.zeros(len(sheet), bool)
            used[os] = True
            keys.append(np.frombuffer(ks, np.uint32)), places.append(np.frombuffer(ps, np.uint16)), owners.append((np.cumsum(used) - 1)[os] + have), sheets.append(sheet[used])
            have += len(sheets[-1])
        out, bucket = [], t["bucket"][0].as_py()
        if sheets:
            key, owner, at, sheet = (np.concatenate(x) for x in (keys, owners, places, sheets))
            out.append(among(key, owner, at, sheet))
            if segments:
                out += before(bucket, key, sheet[owner, 0].view(np.int64), sheet[owner, 1].astype(np.int64), sheet[owner, 2:])
        if equal and segments:
            key, num = (np.concatenate(x) for x in zip(*equal))
            out += before(bucket, key, num, np.zeros(len(key), np.int64), np.zeros((len(key), WORDS), np.uint64))
        a, b, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "segment": pa.array(s.astype(np.int32))})

    posted = names.select("num", "kind", "digits", "value").mapInArrow(emit, P.SCHEMA + ", name string")
    met = C.checkpoint(posted.groupBy("bucket").applyInArrow(meet, "a long, b long, segment int").distinct())
    fs.delete_dir(here)
    return met


def _linked(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """``ka, kb``: keys of the pairs (a, b) of titles whose digits are equal and whose bare texts are similar."""

    def check(batches):
        for x in batches:
            a, b = x.column(2).to_pylist(), x.column(3).to_pylist()
            for i, j in C.slices([p + q for p, q in zip(a, b)]):
                ok = pa.array(similar(a[i:j], b[i:j], 2, SHARE))
                yield pa.RecordBatch.from_arrays([x.column(0).slice(i, j - i).filter(ok), x.column(1).slice(i, j - i).filter(ok)], ["ka", "kb"])

    named = C.sent(C.checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("num")).distinct()))
    names = names.join(named, "num", "left_semi")  # only what a pair names is shuffled
    side = lambda x: names.select(F.col("num").alias(x), F.col("k").alias(f"k{x}"), F.col("digits").alias(f"d{x}"), F.col("value").alias(f"v{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("da = db")
    return both.select("ka", "kb", "va", "vb").mapInArrow(check, "ka binary, kb binary")


def _known(candidates: DataFrame, names: DataFrame, store: Store) -> DataFrame:
    """``k, first``: names that records of the store are like, with the least ordinal of these."""
    path, segments = store.path, store.segments

    def check(batches):
        fs, p = pafs.FileSystem.from_uri(path)
        records = Records(fs, p)
        for x in batches:
            ks, kinds, digits, values, ats, segs = (c.to_pylist() for c in x.columns)
            got = [records(*place(segments[s], at)) for s, at in zip(segs, ats)]
            ok = [{"i": g[1], "p": g[2]}.get(kind) == v if kind != "t" else g[3] == d and g[4] is not None for kind, d, v, g in zip(kinds, digits, values, got)]
            title = [i for i, kind in enumerate(kinds) if kind == "t" and ok[i]]
            for i, j in C.slices([values[t] + got[t][4] for t in title]):
                near = similar([values[t] for t in title[i:j]], [got[t][4] for t in title[i:j]], 2, SHARE)
                for t, o in zip(title[i:j], near.tolist()):
                    ok[t] = o
            keep = [i for i, o in enumerate(ok) if o]
            yield pa.RecordBatch.from_pydict({"k": pa.array([ks[i] for i in keep], pa.binary()), "first": pa.array([got[i][0] for i in keep], pa.int64())})

    asked = C.sent(candidates).join(names, F.col("a") == F.col("num")).select("k", "kind", "digits", "value", "b", "segment").repartition("segment", "b")
    return asked.sortWithinPartitions("segment", "b").mapInArrow(check, "k binary, first long").groupBy("k").agg(F.min("first").alias("first"))


def settle(claims: DataFrame, last: int = LAST) -> DataFrame:
    """``r``: the accepted rows among those with claims (``r, k, own``): row r has key k, or (``own`` false) a title like those
    of key k. In order of r, a row is accepted unless an accepted earlier row owns one of its keys."""
    left, accepted = claims, None
    while left.count() > last:
        least = left.filter("own").groupBy("k").agg(F.min("r").alias("m"))
        seen = left.join(least, "k", "left")
        now = C.checkpoint(seen.groupBy("r").agg(F.min(F.coalesce(F.col("m"), F.col("r")) >= F.col("r")).alias("ok")).filter("ok").select("r"))
        accepted = now if accepted is None else accepted.unionByName(now)
        taken = left.filter("own").join(now, "r", "left_semi").groupBy("k").agg(F.min("r").alias("m"))
        repeated = left.join(taken, "k").filter("m < r").select("r")
        left = C.checkpoint(left.join(now.unionByName(repeated).distinct(), "r", "left_anti"))

    def in_order(t: pa.Table) -> pa.Table:
        r, k, own = t["r"].to_numpy(), t["k"].to_numpy(), t["own"].to_numpy(zero_copy_only=False)
        order = np.argsort(r, kind="stable")
        r, k, own = r[order].tolist(), k[order].tolist(), own[order].tolist()
        taken, out, i = set(), [], 0
        while i < len(r):
            j = i
            while j < len(r) and r[j] == r[i]:
                j += 1
            if taken.isdisjoint(k[i:j]):
                out.append(r[i])
                taken.update(x for x, o in zip(k[i:j], own[i:j]) if o)
            i = j
        return pa.table({"r": pa.array(out, pa.int64())})

    rest = left.groupBy(F.lit(0).alias("one")).applyInArrow(in_order, "r long")
    return rest if accepted is None else accepted.unionByName(rest)


def absorb(rows: DataFrame, tables: C.Tables, store: Store | None = None, keep: bool = True, last: int = LAST) -> DataFrame:
    """``first_index, dup_index`` of the rows (of ``read_rows``) that repeat a record of the store or an earlier accepted row. With
    ``keep``, the accepted rows are added to the store. All rows must come later than the store's."""
    key = lambda kind, *c: F.unhex(F.md5(F.concat_ws("\x1f", F.lit(kind), *(F.col(x) for x in c))))
    name = lambda kind, value, *c: F.when(F.col(value).isNotNull(), F.struct(key(kind, *c, value).alias("k"), F.lit(kind).alias("kind"), (F.col(c[0]) if c else F.lit("")).alias("digits"), F.col(value).alias("value")))
    titles = rows.filter("bare is not null").select(F.inline(F.array(name("t", "bare", "digits")))).distinct()  # a title once, however often it stands
    old = store is not None and bool(store.segments)
    asked = titles.unionByName(rows.select(F.inline(F.array_compact(F.array(name("i", "id"), name("p", "page")))))) if old else titles
    names = tables.put(asked.withColumn("num", F.monotonically_increasing_id()))
    classes, sampled = store.order(lambda: _classes(names)) if store else _classes(names)
    met = like(names, classes, max(1.0, names.filter("kind = 't'").count() / max(1, sampled)), store)
    links = C.checkpoint(_linked(met.filter("segment = -1"), names))
    keys = F.array_compact(F.array(*(F.when(F.col(c[-1]).isNotNull(), key(kind, *c)) for kind, *c in (("i", "id"), ("p", "page"), ("t", "digits", "bare")))))
    own = tables.put(rows.select("r", F.explode(keys).alias("k")))
    known = None
    if old:
        found = C.checkpoint(_known(met.filter("segment >= 0"), names, store))
        known = C.checkpoint(own.join(C.sent(found), "k").groupBy("r").agg(F.min("first").alias("first_index")))
        own = own.join(C.sent(known), "r", "left_anti")
    watch = links.unionByName(links.select(F.col("kb").alias("ka"), F.col("ka").alias("kb")))
    shared = C.checkpoint(own.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k").unionByName(watch.select(F.col("ka").alias("k"))).distinct())
    mine = own.join(C.sent(shared), "k", "left_semi").withColumn("own", F.lit(True))
    theirs = own.join(C.sent(watch), F.col("k") == F.col("ka")).select("r", F.col("kb").alias("k"), F.lit(False).alias("own"))
    claims = C.checkpoint(mine.select("r", "k", "own").unionByName(theirs))
    accepted = C.checkpoint(settle(claims, last))
    some = C.sent(accepted)
    owner = claims.filter("own").join(some, "r", "left_semi").groupBy("k").agg(F.min("r").alias("first_index"))
    rest = claims.join(some, "r", "left_anti")
    repeats = rest.join(owner, "k").filter("first_index < r").groupBy("r").agg(F.min("first_index").alias("first_index"))
    repeats = C.checkpoint(repeats if known is None else repeats.unionByName(known.select("r", "first_index")))
    if store and keep:
        # written first: a task that runs again must give a segment the same bytes, so its rows must not come from a shuffle
        new = tables.put(rows.join(C.sent(repeats), "r", "left_anti"))
        count = new.count()
        if count:
            store.add(new, lambda b: _record_postings(b, classes), count)
    return repeats.select("first_index", F.col("r").alias("dup_index"))


def _record_postings(b: pa.RecordBatch, classes: np.ndarray):
    """(row, key, size, bitmap) of records."""
    _, ids, pages, digits, bare = (c.to_pylist() for c in b.columns)
    titles = [i for i, x in enumerate(bare) if x is not None]
    who, key, _, n, bits, _ = _suffixes([bare[i] for i in titles], [digits[i] for i in titles], classes)
    others = [(i, kind, v) for kind, col in (("i", ids), ("p", pages)) for i, v in enumerate(col) if v is not None]
    zero = np.zeros(len(others), np.int64)
    return (
        np.r_[np.array(titles, np.int64)[who], np.array([i for i, *_ in others], np.int64)],
        np.r_[key, _equal([k for _, k, _ in others], [v for *_, v in others])],
        np.r_[n[who], zero],
        np.r_[bits[who], np.zeros((len(others), WORDS), np.uint64)],
    )


def find_repeats(df: DataFrame, ordinal: str, id_: str, title: str, address, store: Store | None = None, keep: bool = True, last: int = LAST) -> DataFrame:
    """``first_index, dup_index`` of every row that repeats an earlier accepted one by id, page or title.

    ``ordinal`` is unique and gives the order of arrival. Null ids, addresses without a host and titles with fewer than two
    letters match nothing. With a ``store``, its records count as accepted before, and the rows accepted now are added to it (unless
    ``keep`` is false); what is read of it follows the batch. An empty table gives an empty result."""
    tables = C.Tables(df.sparkSession)
    result = absorb(tables.put(read_rows(df, ordinal, id_, title, address)), tables, store, keep, last)
    tables.remove()
    return result


def find_all_repeats(df: DataFrame, ordinal: str, id_: str, title: str, address, first: int = FIRST, last: int = LAST) -> DataFrame:
    """The same for a whole table, taken in as increments against a store: ``first`` rows, then as many as are known each time.
    So every row is looked up against what came before its increment, and the number of increments is a logarithm of the rows'."""
    spark = df.sparkSession
    tables, store = C.Tables(spark), Store(spark)
    rows = df.count()
    shares, n = [], first
    while n < rows:
        shares.append(n / rows)
        n *= GROWTH
    cuts = df.approxQuantile(ordinal, shares, 0.002) if shares else []
    increment = F.lit(0)
    for c in cuts:
        increment = increment + (F.col("r") > c).cast("int")
    table = tables.put(read_rows(df, ordinal, id_, title, address).withColumn("increment", increment), "increment")
    found = None
    for i in range(len(cuts) + 1):
        mine = C.Tables(spark)
        now = absorb(table.filter(F.col("increment") == i).drop("increment"), mine, store, i < len(cuts), last)
        mine.remove()
        found = now if found is None else found.unionByName(now)
    tables.remove()
    store.remove()
    return found


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_all_repeats(C.table(spark, sf_dir, "aihot_24h"), "api_index", "id", "title", F.col("links.original"))


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and repeated items of every batch."""
    items = C.table(spark, sf_dir, "aihot_24h").select("api_index", "batch_no")
    return items.join(p2_found(spark, sf_dir), F.col("api_index") == F.col("dup_index"), "left").groupBy("batch_no").agg(F.count("*").alias("items"), F.count("dup_index").alias("repeats"))


QUERIES = {"p2_found": p2_found, "p2_batches": p2_batches}
