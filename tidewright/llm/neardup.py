"""Problem 4: groups of texts that share most of their content, by prefixes of their sequences.

A token is one of a text's k-letter sequences; all texts order them alike, rare ones first (by counts over all texts; they
decide the cost and never the result). Texts with the asked share have a token in
common among each one's first ``n - ceil(share n) + 1``, so the posting lists of these prefixes hold every pair:

* all pairs of a list are looked at, however long it is; a text with more than ``D``
  partners has them compared in place. Only those are left out whose
  sizes and whose token's places in them show that it can't be the first of enough shared ones;
* of each pair, sizes and bitmaps are compared where the list is: the bits in which two texts' bitmaps differ are no more than the
  sequences that differ, so a pair is given up only if it can't be similar. Sizes and bitmaps lie in the shared folder, one file a
  batch, and postings say the batch and the place in it.

Pairs left are verified exactly: the sets of 3-letter sequences of both texts, no hashing. Links become groups as connected
components. Texts equal in bare form are one node from the beginning, however often they stand.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes as K
from . import common as C
from . import postings as P
from .graph import components

#: Partners of a text in a list above which they are compared in place and not gathered; pairs gathered at once.
D, PAIRS = 1500, 30_000
#: Counters of sequences by their hash, and how many go into one row when tasks' counts are added up.
COUNTERS, RANGE = 1 << 20, 1 << 12
#: Postings of a bucket, on average: what one call has in memory.
POSTINGS = 1_000_000
#: Texts that may have a token before its list is cut into parts of so many, and every two parts become a list of their own.
LIST = 50_000
#: A place goes into 14 bits (greater ones as the greatest, which rules out less); above it the list is whole or which part this is.
PLACE = 14
#: Words of a bitmap for texts of up to 150 sequences on average (more for longer ones); texts of a file, numbered by 15 bits.
WORDS, TEXTS = 12, 32_768


def text_ids(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128-bit digest of every text, as 16 bytes."""
    raw = c.tobytes()
    return np.array([hashlib.blake2b(raw[4 * a : 4 * b], digest_size=16).digest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())], "V16")


def joined_bare(batch: pa.RecordBatch, fields: list[int]):
    """Bare texts of the fields, joined without separator, in slices: (first row, codes, starts)."""
    cols = [batch.column(i).to_pylist() for i in fields]
    whole = ["".join(x or "" for x in row) for row in zip(*cols)]
    for a, b in C.slices(whole):
        parts = [K.as_text(*K.bare(col[a:b])) for col in cols]
        yield a, *K.codes(["".join(x) for x in zip(*parts)])


def _least(n: np.ndarray, share: float) -> np.ndarray:
    """The least whole number that is this share of n."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def _slices(texts: list[str]):
    """Ranges of bounded letters and of no more texts than 11 bits number."""
    for a, b in C.slices(texts):
        for i in range(a, b, 2048):
            yield i, min(i + 2048, b)


def _token_classes(texts: DataFrame, rows: int, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """How frequent sequences are in all texts, as 64 classes on a logarithmic scale by counter of their hash; the greatest count of
    each class, which no sequence of it exceeds; and the mean number of sequences of a text."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            col = b.column(0).to_pylist()
            for i, j in _slices(col):
                np.add.at(total, _counter(K.grams(*K.codes(col[i:j]), k)[1]), 1)
        ranges = total.reshape(-1, RANGE)
        at = np.flatnonzero(ranges.any(axis=1))
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array([x.tobytes() for x in ranges[at]], pa.binary())})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[at] = total.get(at, 0) + np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(total), pa.int32()), "n": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    total = np.zeros((COUNTERS // RANGE, RANGE), np.int64)
    for r in texts.select("text").mapInArrow(count, "at int, n binary").repartition("at").mapInArrow(add, "at int, n binary").collect():
        total[r["at"]] = np.frombuffer(r["n"], np.int64)
    total = total.ravel()
    step = min(3.5, 63 / max(1.0, float(np.log2(total.max() + 1))))  # the greatest count is in the last class at most
    classes = np.minimum(63, np.log2(total + 1) * step).astype(np.uint8)
    greatest = np.zeros(64, np.int64)
    np.maximum.at(greatest, classes, total)
    return classes, greatest, int(total.sum()) / max(1, rows)


def _tokens(c: np.ndarray, starts: np.ndarray, k: int, share: float, classes: np.ndarray, words: int = WORDS):
    """Tokens of the texts' prefixes as (text, token, place), and each text's size and bitmap. A token is 6 bits of class
    and 47 of hash; up to 2,048 texts."""
    h = K.hashes(c, k)
    who = K.owner(starts)
    inside = who[: len(h)] == who[k - 1 :] if len(h) else np.zeros(0, bool)
    h = h[inside]
    key = (who[: len(inside)][inside].astype(np.uint64) << np.uint64(53)) | (classes[_counter(h)].astype(np.uint64) << np.uint64(47)) | (h >> np.uint64(17))
    key = K.sorted_set(key)
    who, t = (key >> np.uint64(53)).astype(np.int64), K.mix(key & np.uint64((1 << 53) - 1))
    n = np.bincount(who, minlength=len(starts) - 1)
    bit = np.zeros((len(n), 64 * words), np.uint8)
    bit[who, ((t >> np.uint64(8)) % np.uint64(64 * words)).astype(np.int64)] = 1
    place = np.arange(len(t)) - np.r_[0, np.cumsum(n)][who]
    keep = place <= (n - _least(n, share))[who]
    return who[keep], t[keep], place[keep], n, np.packbits(bit, axis=1).view(np.uint64), ((key[keep] >> np.uint64(47)) & np.uint64(63)).astype(np.int64)


def parted(t: np.ndarray, owner: np.ndarray, place: np.ndarray, texts: np.ndarray, who: np.ndarray, most: int, whole: bool = False):
    """Postings (token, owner, place with part). A token that more than ``most`` of all ``texts`` have is posted once for
    every other part of its texts and once for its own; ``who`` spreads texts over parts. With ``whole`` it is posted as it is, too,
    as no part of a list."""
    parts = np.ceil(texts / most).astype(np.int64)
    place = np.minimum(place, (1 << PLACE) - 1).astype(np.uint16)
    hot = np.flatnonzero(parts > 1)
    if not len(hot):
        return t, owner, place
    g = parts[hot]
    own = (K.mix(who[hot].astype(np.uint64) + np.uint64(1)) % g.astype(np.uint64)).astype(np.int64)
    h = np.repeat(np.arange(len(hot)), g)
    other = np.arange(len(h)) - np.repeat(np.cumsum(g) - g, g)
    own = own[h]
    mode = np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint16)
    key = K.mix(t[hot][h] + (np.minimum(own, other) * g[h] + np.maximum(own, other)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    cold = parts <= 1
    out = np.r_[t[cold], key], np.r_[owner[cold], owner[hot][h]], np.r_[place[cold], place[hot][h] | (mode << np.uint16(PLACE))]
    if whole:
        out = np.r_[out[0], t[hot]], np.r_[out[1], owner[hot]], np.r_[out[2], place[hot] | np.uint16(3 << PLACE)]
    return out


def _list_pairs(owner: np.ndarray, place: np.ndarray, cut: np.ndarray, n: np.ndarray, bits: np.ndarray, share: float, opposite: np.ndarray | None = None):
    """Pairs (i, j) of texts that meet in a list and that sizes, places and bitmaps don't rule out. Texts are numbered by size.
    ``opposite`` gives the list whose texts a list's are paired with: itself, another, or none (-1).

    Texts of sizes x and y need share / (1 + share) (x + y) shared sequences, and have x - place at most if the list's is the first.
    So each has a greatest size of the other. Bitmaps are compared folded to as few words as tell unlike texts of their size
    apart, and what is left by all words."""
    apart, both = (1 - share) / (1 + share), share / (1 + share)
    size = n[owner]
    most = ((1 - both) * size - place) / both + 1e-6
    columns = np.ascontiguousarray(bits.T)
    w = len(columns)
    #: (bits of the whole, part of it that is compared, words it is folded to)
    levels = [(64 * w // 4, 1, w // 4), (64 * w // 3, 1, w // 3), (64 * w // 2, 1, w // 2), (64 * w, 2 / 3, w), (64 * w, 1, w)] if w % 12 == 0 else [(64 * w, 1, w)]
    made: dict[tuple, list[np.ndarray]] = {}

    def level(part: float, to: int) -> list[np.ndarray]:
        """The words of every list entry, made when first asked for."""
        if (part, to) not in made:
            made[part, to] = [np.bitwise_or.reduce(columns[i::to])[owner] for i in range(int(part * to))]
        return made[part, to]

    bound = np.minimum(np.floor(apart * size + 0.5), 16_000).astype(np.int16)
    small = size.astype(np.int32)

    # a text's partners are those of the opposite list from its size (behind it, in its own) up to the greatest size it allows
    each = np.diff(cut)
    lists = np.repeat(np.arange(len(each)), each)
    to = lists if opposite is None else np.repeat(opposite, each)
    step = int(n.max()) + 2
    where = lists * step + size
    begin = np.arange(len(owner)) + 1
    cross = np.flatnonzero((to != lists) & (to >= 0))
    begin[cross] = np.where(to[cross] > lists[cross], np.searchsorted(where, to[cross] * step + size[cross], "left"), np.searchsorted(where, to[cross] * step + size[cross], "right"))
    end = np.searchsorted(where, np.maximum(to, 0) * step + np.clip(np.floor(most).astype(np.int64), 0, step - 1), "right")
    count = np.where(to >= 0, np.maximum(end - begin, 0), 0)

    def first_words(typical: float) -> list[np.ndarray]:
        """The fewest whose expected difference is well above what similar texts of this size can have."""
        for room, part, to in levels:
            full = 1 - np.exp(-typical / room)
            if 2 * full * (1 - full) * room * part - 3 * np.sqrt(room * part) / 2 > 2 * apart * typical:
                break
        return level(part, to)

    def rest(i, j):
        """The pairs of list entries that all words of the bitmaps and the places leave, as texts."""
        ok = size[i] <= most[j]
        i, j = i[ok], j[ok]
        far = np.bitwise_count(bits[owner[j]] ^ bits[owner[i]]).sum(axis=1, dtype=np.int64)
        ok = far <= apart * (size[i] + size[j]) + 1e-9
        return owner[i[ok]], owner[j[ok]]

    long = np.flatnonzero(count > D)
    for i in long.tolist():
        j = slice(int(begin[i]), int(begin[i] + count[i]))
        few = first_words(size[i])
        far = np.zeros(int(count[i]), np.uint8 if len(few) <= 4 else np.int16)  # 256 bits look like none and go on
        for w in few:
            far += np.bitwise_count(w[j] ^ w[i])
        near = np.flatnonzero(far <= bound[j] + bound[i])
        yield rest(np.full(len(near), i), begin[i] + near)
    count[long] = 0
    before = np.r_[0, np.cumsum(count)]
    a = 0
    while a < len(owner):
        z = max(a + 1, int(np.searchsorted(before, before[a] + PAIRS, "right")) - 1)
        c = count[a:z]
        j = np.arange(before[a], before[z]) + np.repeat(begin[a:z] - before[a:z], c)
        few = first_words(1.1 * float(small[j].mean())) if len(j) else []
        far = np.zeros(len(j), np.uint8 if len(few) <= 4 else np.int16)
        for w in few:
            far += np.bitwise_count(w[j] ^ np.repeat(w[a:z], c))
        near = np.flatnonzero(far <= bound[j] + np.repeat(bound[a:z], c))
        yield rest(np.repeat(np.arange(a, z), c)[near], j[near])
        a = z


def lists_of(key: np.ndarray, owner: np.ndarray, place: np.ndarray):
    """Owners and places in lists by key and part, where each list begins, and which list is its opposite."""
    part = place >> np.uint16(PLACE)
    # up to 2^30 owners a bucket
    whole = (key.astype(np.uint64) << np.uint64(32)) | (part.astype(np.uint64) << np.uint64(30)) | owner
    order = np.argsort(whole)
    whole, place = whole[order], place[order] & np.uint16((1 << PLACE) - 1)
    first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]])  # tokens of a text that look alike are one, at the least place
    place, whole = np.minimum.reduceat(place, first), whole[first]
    list_ = whole >> np.uint64(30)
    cut = np.r_[np.flatnonzero(np.r_[True, list_[1:] != list_[:-1]]), len(list_)]
    of = list_[cut[:-1]]
    opposite = np.arange(len(of))
    mode = of & np.uint64(3)
    opposite[mode > 0] = -1
    two = np.flatnonzero((mode[1:] == 2) & (mode[:-1] == 1) & ((of[1:] >> np.uint64(2)) == (of[:-1] >> np.uint64(2))))
    opposite[two], opposite[two + 1] = two + 1, two
    return (whole & np.uint64((1 << 30) - 1)).astype(np.int64), place, cut, opposite


def candidate_pairs(texts: DataFrame, k: int = 3, share: float = 0.6) -> DataFrame:
    """``a, b``: numbers of the distinct ``texts(num, text)``; every pair with the share is among them, and few others."""
    spark = texts.sparkSession
    rows = texts.count()
    classes, greatest, tokens = _token_classes(texts, rows, k)
    buckets = max(8, int(rows * tokens * (1 - share) / POSTINGS))
    words = WORDS * max(1, math.ceil(tokens / 150))
    most = LIST
    counts = spark.sparkContext.broadcast((classes, greatest))
    folder = f"{C.folder(spark)}/neardup-{uuid.uuid4().hex}"
    files = lambda: pafs.FileSystem.from_uri(folder)
    fs, path = files()
    fs.create_dir(path)

    def emit(batches):
        fs, path = files()
        classes, greatest = counts.value
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                out, sheets, col = P.Buckets(buckets), [], part.column(1).to_pylist()
                ids = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for i, j in _slices(col):
                    who, t, place, n, bits, classes_of = _tokens(*K.codes(col[i:j]), k, share, classes, words)
                    out.add(*parted(t, (who + i).astype(np.uint16), place, greatest[classes_of], ids[who + i], most))
                    sheets.append(np.column_stack([ids[i:j], n.astype(np.uint64), bits]))
                if sheets:
                    name = uuid.uuid4().hex
                    with fs.open_output_stream(f"{path}/{name}") as f:
                        f.write(np.concatenate(sheets).tobytes())
                    for r in out.rows():
                        yield r.append_column("name", pa.array([name] * r.num_rows))

    def meet(t: pa.Table) -> pa.Table:
        fs, path = files()
        keys, owners, places, sheets, have = [], [], [], [], 0
        for name, ks, os, ps in zip(*(t[c].to_pylist() for c in ("name", "keys", "owners", "extra"))):
            with fs.open_input_file(f"{path}/{name}") as f:
                sheet = np.frombuffer(f.read(), np.uint64).reshape(-1, 2 + words)
            os = np.frombuffer(os, np.uint16)
            used = np.zeros(len(sheet), bool)
            used[os] = True
            at = np.cumsum(used) - 1
            keys.append(np.frombuffer(ks, np.uint32)), places.append(np.frombuffer(ps, np.uint16)), owners.append(at[os] + have), sheets.append(sheet[used])
            have += len(sheets[-1])
        sheet = np.concatenate(sheets)
        order = np.argsort(sheet[:, 1])
        number = np.empty(have, np.uint64)
        number[order] = np.arange(have, dtype=np.uint64)  # texts by size
        sheet = sheet[order]
        key, owner, place = np.concatenate(keys), number[np.concatenate(owners)], np.concatenate(places)
        owner, place, cut, opposite = lists_of(key, owner, place)
        found, waiting, m = np.zeros(0, np.int64), [], len(sheet)
        for i, j in _list_pairs(owner, place, cut, sheet[:, 1].astype(np.int64), sheet[:, 2:], share, opposite):
            waiting.append(i * m + j)
            if len(waiting) >= 4096:
                found, waiting = K.sorted_set(np.concatenate([found, *waiting])), []
        found = K.sorted_set(np.concatenate([found, *waiting]))
        ids = np.ascontiguousarray(sheet[:, 0]).view(np.int64)
        a, b = ids[found // m], ids[found % m]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    with C.shuffles_dropped(spark):
        pairs = C.checkpoint(texts.select("num", "text").mapInArrow(emit, P.SCHEMA + ", name string").groupBy("bucket").applyInArrow(meet, "a long, b long").distinct())
    fs.delete_dir(path)
    return pairs


def similar(left: list[str], right: list[str], k: int, share: float) -> np.ndarray:
    """Exactly: of the k-letter sequences in either text, at least ``share`` are in both."""
    pairs = len(left)
    if not pairs:
        return np.zeros(0, bool)
    c, starts = K.codes([*left, *right])
    letters = np.unique(c)
    bits, room = max(1, int(len(letters)).bit_length()), int(pairs).bit_length() + 1
    n = len(c) - k + 1
    if n <= 0:
        return np.zeros(pairs, bool)
    if k * bits + room > 64:
        if pairs == 1:
            return np.array([_similar_sets(left[0], right[0], k, share)])
        half = pairs // 2
        return np.r_[similar(left[:half], right[:half], k, share), similar(left[half:], right[half:], k, share)]
    place = np.zeros(int(letters[-1]) + 1, np.uint64)
    place[letters] = np.arange(len(letters), dtype=np.uint64)
    c = place[c]
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = (g << np.uint64(bits)) | c[i : i + n]
    who = K.owner(starts)
    inside = who[:n] == who[k - 1 :]
    who = who[:n][inside]
    side = (who >= pairs).astype(np.uint64)
    pair = (who - pairs * side.astype(np.int64)).astype(np.uint64)
    key = K.sorted_set((pair << np.uint64(k * bits + 1)) | (g[inside] << np.uint64(1)) | side)
    pair = (key >> np.uint64(k * bits + 1)).astype(np.int64)
    all_ = np.bincount(pair, minlength=pairs)
    twice = np.flatnonzero((key[1:] >> np.uint64(1)) == (key[:-1] >> np.uint64(1)))
    both = np.bincount(pair[twice], minlength=pairs)
    either = all_ - both
    return (both >= share * either - 1e-9) & (either > 0)


def _similar_sets(a: str, b: str, k: int, share: float) -> bool:
    x, y = ({s[i : i + k] for i in range(len(s) - k + 1)} for s in (a, b))
    both = len(x & y)
    return bool(x or y) and both >= share * (len(x) + len(y) - both) - 1e-9


def verified(pairs: DataFrame, texts: DataFrame, k: int, share: float) -> DataFrame:
    """The pairs (a, b) whose texts (``num, text``) are similar."""

    def check(batches):
        for x in batches:
            a, b = x.column("ta").to_pylist(), x.column("tb").to_pylist()
            for i, j in C.slices([p + q for p, q in zip(a, b)]):
                ok = pa.array(similar(a[i:j], b[i:j], k, share))
                yield pa.RecordBatch.from_arrays([x.column("a").slice(i, j - i).filter(ok), x.column("b").slice(i, j - i).filter(ok)], ["a", "b"])

    one = pairs.join(texts.select(F.col("num").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("num").alias("b"), F.col("text").alias("tb")), "b")
    return two.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def near_duplicate_groups(df: DataFrame, key: str, fields: list[str], k: int = 3, share: float = 0.6) -> DataFrame:
    """``key, group``: every key whose text equals or is similar to another key's, with its group (an id that only means
    equality), directly or through others. A key's text is its fields' bare texts joined in order; a key with several rows
    has all their texts. Null and empty texts match nothing; texts of fewer than ``k`` letters have no sequences and so no
    links. An empty table gives an empty result."""

    def id_texts(batches):
        for b in batches:
            keys = b.column(len(fields))
            for a, c, starts in joined_bare(b, list(range(len(fields)))):
                n = len(starts) - 1
                ok = pa.array(np.diff(starts) >= k)
                ids = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(text_ids(c, starts).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids.filter(ok), keys.slice(a, n).filter(ok), pa.array(K.as_text(c, starts)).filter(ok)], ["d", "key", "text"])

    tables = C.Tables(df.sparkSession)
    keyed = df.filter(F.col(key).isNotNull()).select(*fields, F.col(key).cast("string"))
    rows = tables.put(keyed.mapInArrow(id_texts, "d binary, key string, text string"))  # folded once, read by all that follows
    with C.shuffles_dropped(df.sparkSession):
        texts = tables.put(rows.select("d", "text").distinct().withColumn("num", F.monotonically_increasing_id()))
    pairs = candidate_pairs(texts, k, share)
    links = verified(pairs, texts, k, share).select(F.col("a").alias("u"), F.col("b").alias("v"))
    owned = C.checkpoint(rows.select("d", "key").distinct().join(texts.select("d", "num"), "d").select("num", "key"))
    same_key = owned.groupBy("key").agg(F.min("num").alias("u"), F.max("num").alias("z")).filter("u <> z").select("key", "u").join(owned, "key").select("u", F.col("num").alias("v"))
    roots = components(links.unionByName(same_key))
    grouped = owned.join(roots, owned["num"] == roots["node"], "left").select("key", F.coalesce("root", "num").alias("group")).distinct()
    many = grouped.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    result = C.checkpoint(grouped.join(many, "group", "left_semi").select("key", "group"))
    tables.remove()
    return result


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(C.table(spark, sf_dir, "aihot_24h"), "id", ["title", "summary", "originalTitle"]).select(F.col("key").alias("id"), F.col("group").alias("group_id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = near_duplicate_groups(C.table(spark, sf_dir, "aihot_24h"), "id", ["title", "summary", "originalTitle"])
    a, b = g.alias("a"), g.alias("b")
    return a.join(b, (F.col("a.group") == F.col("b.group")) & (F.col("a.key") < F.col("b.key"))).select(F.col("a.key").alias("id_lo"), F.col("b.key").alias("id_hi"))


QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
