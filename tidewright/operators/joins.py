"""Joins beyond equality: look-back anti joins, completeness, intervals, nearest values, containment, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast without a further look at its size.
SMALL_ROWS = 10_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``most`` rows, else leave the choice to the optimizer."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, how: str = "left") -> DataFrame:
    d = dim.withColumnRenamed(dim_key, "_key")
    return df.join(d, df[key] == d["_key"], how).drop("_key")


def lookback_anti(df: DataFrame, key: str, at: Column, seen: DataFrame, seen_key: str, seen_at: Column, days: int) -> DataFrame:
    """Rows whose key wasn't seen in the ``days`` days before theirs. Seen keys are reduced to (key, day) first."""
    past = seen.select(F.col(seen_key).alias("_k"), F.to_date(seen_at).alias("_day")).distinct()
    now = df.withColumn("_now", F.to_date(at))
    return now.join(past, (F.col(key) == F.col("_k")) & (F.col("_day") < F.col("_now")) & (F.col("_day") >= F.date_sub("_now", days)), "left_anti").drop("_now")


def completeness(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """``key, state``: missing, extra or duplicate keys of ``have`` against ``want``."""
    w = want.select(F.col(key).alias("_w")).distinct()
    h = have.groupBy(F.col(key).alias("_h")).agg(F.count("*").alias("n"))
    state = F.when(F.col("_h").isNull(), "missing").when(F.col("_w").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return w.join(h, F.col("_w") == F.col("_h"), "full_outer").select(F.coalesce("_w", "_h").alias(key), state.alias("state")).filter("state is not null")


def interval_join(left: DataFrame, right: DataFrame, l: tuple[str, str], r: tuple[str, str], width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with ``l.start < r.end and r.start < l.end`` (and equal ``on``), as an equality join on buckets of ``width``: both
    sides stand in every bucket they touch, and a pair is kept only in the first bucket that both touch. Names must differ."""
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    a = left.withColumn("_lc", cell(l[0])).withColumn("_cell", F.explode(F.sequence(cell(l[0]), F.greatest(cell(l[0]), cell(l[1])))))
    b = right.withColumn("_rc", cell(r[0])).withColumn("_cell2", F.explode(F.sequence(cell(r[0]), F.greatest(cell(r[0]), cell(r[1])))))
    keys = [F.col(x) == F.col(f"r_{x}") for x in on or []]
    for x in on or []:
        b = b.withColumnRenamed(x, f"r_{x}")
    cond = [F.col("_cell") == F.col("_cell2"), *keys, F.col(l[0]) < F.col(r[1]), F.col(r[0]) < F.col(l[1]), F.col("_cell") == F.greatest("_lc", "_rc")]
    return a.join(b, cond).drop("_lc", "_rc", "_cell", "_cell2", *(f"r_{x}" for x in on or []))


def largest_overlap(pairs: DataFrame, key: list[str], l: tuple[str, str], r: tuple[str, str], position: str) -> DataFrame:
    """Of each left row's overlaps the largest; the earliest position wins ties."""
    x = pairs.withColumn("overlap", F.least(l[1], r[1]) - F.greatest(l[0], r[0]))
    return x.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(F.col("overlap").desc(), F.col(position)))).filter("_rn = 1").drop("_rn")


def nearest(left: DataFrame, right: DataFrame, group: str, at: str, right_at: str, order: str, tolerance: float) -> DataFrame:
    """The right row nearest to each left row in either direction within ``tolerance`` (its bucket width); the least ``order``
    wins ties; null where there is none. Left rows need a unique ``row_id``; a bucket holds one stretch of ``tolerance``."""
    cell = F.floor(F.col(at) / tolerance).cast("long")
    a = left.withColumn("_c", F.explode(F.array(cell - 1, cell, cell + 1)))
    b = right.select(F.col(group).alias("_g"), F.col(right_at).alias("_at"), F.col(order).alias("_o"), F.floor(F.col(right_at) / tolerance).cast("long").alias("_rc"))
    hit = a.join(b, (F.col(group) == F.col("_g")) & (F.col("_c") == F.col("_rc")) & (F.abs(F.col(at) - F.col("_at")) <= tolerance))
    best = hit.groupBy("row_id").agg(F.min(F.struct(F.abs(F.col(at) - F.col("_at")).alias("gap"), F.col("_o").alias("o"))).alias("m")).select(F.col("row_id").alias("_id"), F.col("m.gap").alias("gap"), F.col("m.o").alias(order))
    return left.join(best, F.col("row_id") == F.col("_id"), "left").drop("_id")


def containment(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Pairs of equal key in which one text, without white space, contains the other."""
    bare = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    r = right.withColumnRenamed(key, "_key")
    return left.join(r, left[key] == r["_key"]).filter(bare(a).contains(bare(b)) | bare(b).contains(bare(a))).drop("_key")


def dictionary_match(lines: DataFrame, text: str, aliases: DataFrame) -> DataFrame:
    """Rows of ``lines`` with every ``entity`` one of whose ``alias`` stands in the text: anywhere if the alias holds Han
    characters, between non-word characters if it is Latin. ``aliases`` is a dictionary; only a small one is sent to every task."""
    d = small(aliases.select("entity", "alias"))
    word = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.lower("alias"), F.lit(r"\E(?![A-Za-z0-9_])"))
    low = F.lower(F.col(text))
    return lines.join(d, low.contains(F.lower("alias"))).filter(F.when(F.col("alias").rlike(r"[一-鿿]"), F.lit(True)).otherwise(F.regexp_like(low, word)))


def against_first(df: DataFrame, group: str, order: str, fields: list[str]) -> DataFrame:
    """Rows that differ from their group's first row in one of the fields, with the names of those fields."""
    first = df.groupBy(group).agg(F.min_by(F.struct(*fields), order).alias("_f")).withColumnRenamed(group, "_g")
    names = F.array_join(F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_f.{f}")), F.lit(f)) for f in fields))), ",")
    return df.join(first, F.col(group) == F.col("_g")).withColumn("differs", names).filter("differs <> ''").drop("_g", "_f")


def claimed_once(pages: DataFrame, beats: DataFrame, pos: str, asset: str, page: str, claim: str) -> DataFrame:
    """``page, pos``: the earliest beat that binds each page, so that none is used twice. ``pages`` has a page's claims, one a row;
    ``beats`` a place and a planned asset, whose claims are the beat's. A beat takes its own asset and pages no beat plans, if a
    claim is shared; the beat at place 0 takes none."""
    planned = beats.select(F.col(asset).alias("_planned")).distinct()
    wanted = beats.filter(F.col(pos) > 0).join(pages.select(F.col(page).alias("_of"), F.col(claim).alias("_claim")), F.col(asset) == F.col("_of")).select(pos, asset, "_claim").distinct()
    free = pages.join(planned, F.col(page) == F.col("_planned"), "left").withColumn("_free", F.col("_planned").isNull())
    met = free.join(wanted, F.col(claim) == F.col("_claim")).filter(F.col("_free") | (F.col(page) == F.col(asset)))
    return met.groupBy(page).agg(F.min(pos).alias(pos))


def confused_pairs(df: DataFrame, group: str, key: str, value: str, ranges: list[tuple]) -> DataFrame:
    """Pairs of rows of a group, ``*_a`` with the lesser key, of which one's value lies in a range's first half and the other's in its
    second, with the range's ``kind``. Rows are spread over the ranges they lie in, so the join is one of equal keys."""
    halves = [(i, kind, side, lo, hi) for i, (kind, a0, a1, b0, b1) in enumerate(ranges) for side, lo, hi in ((0, a0, a1), (1, b0, b1))]
    lies = F.array_compact(F.array(*(F.when(F.col(value).between(lo, hi), F.struct(F.lit(i).alias("_range"), F.lit(kind).alias("kind"), F.lit(side).alias("_side"))) for i, kind, side, lo, hi in halves)))
    x = df.select("*", F.inline(lies))
    a, b = (x.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns), F.col("_range").alias(f"_range_{s}"), F.col("_side").alias(f"_side_{s}"), F.col("kind").alias(f"kind_{s}")) for s in "ab")
    on = (F.col(f"{group}_a") == F.col(f"{group}_b")) & (F.col("_range_a") == F.col("_range_b")) & (F.col("_side_a") != F.col("_side_b")) & (F.col(f"{key}_a") < F.col(f"{key}_b"))
    return a.join(b, on).withColumnRenamed("kind_a", "kind").drop("kind_b", "_range_a", "_range_b", "_side_a", "_side_b")
