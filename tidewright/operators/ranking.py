"""Ranking, selection and top-k. Every order ends in an ordinal, so results don't depend on how rows are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key by ``order``; all columns kept. Null keys are one key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def best_first(score: str, ordinal: str) -> list[Column]:
    """Scored rows first, by score descending, then by arrival."""
    return [F.col(score).desc_nulls_last(), F.col(ordinal).asc()]


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def with_group_size(df: DataFrame, group: list[str], name: str = "n") -> DataFrame:
    """Group sizes by a pre-aggregated join instead of a window, so that a group isn't brought into one task to be counted."""
    sizes = df.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group))).agg(F.count("*").alias(name))
    return df.join(sizes, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]).select(*df.columns, name)


def rank_percentile(rank: str = "rank", n: str = "n") -> Column:
    """1 for the first of a group, falling by 1/n; six decimals."""
    return F.when(F.col(n) == 1, F.lit(1.0)).otherwise(F.round(1 - (F.col(rank) - 1) / F.col(n), 6))


def head_size(n: str = "n", share: float = 0.5) -> Column:
    """Places of a group in the head tier: all of up to two, else a share of it, between 2 and 4."""
    return F.when(F.col(n) <= 2, F.col(n)).otherwise(F.least(F.lit(4), F.greatest(F.lit(2), F.ceil(F.col(n) * share)))).cast("int")


def adaptive_selection(items: DataFrame, group: str, key: str, score: str, ordinal: str, soft_min: int = 6, max_items: int = 8, share: float = 0.5) -> DataFrame:
    """Selection across groups, closed form: within a group rows are ranked; heads are taken interleaved by rank and group
    order; reserves fill up to ``soft_min``. Gives ``seq, group, rank, percentile, tier, reason`` with the key and ordinal.

    Only rows of rank up to ``max_items`` can be taken, so the last window sees at most groups * max_items rows."""
    once = first_wins(items, [group, key], [F.col(ordinal).asc()])
    sizes = once.groupBy(group).agg(F.count("*").alias("n")).withColumnRenamed(group, "_g")
    top = rank_in_group(once, [group], best_first(score, ordinal)).filter(F.col("rank") <= max_items)
    ranked = top.join(sizes, F.col(group) == F.col("_g")).drop("_g").withColumn("tier", F.when(F.col("rank") <= head_size(share=share), "head").otherwise("reserve"))
    seq = F.row_number().over(W.orderBy((F.col("tier") == "reserve").cast("int"), "rank", F.col(group)))
    taken = ranked.withColumn("seq", seq).filter((F.col("seq") <= max_items) & ((F.col("tier") == "head") | (F.col("seq") <= soft_min)))
    reason = F.when(F.col("rank") == 1, "dimension_leader").when(F.col("tier") == "head", "relative_head").otherwise("reserve_fill")
    return taken.select("seq", group, key, ordinal, "rank", rank_percentile().alias("percentile"), "tier", reason.alias("reason"))


def quota_then_backfill(items: DataFrame, group: str, ordinal: str, quota: int, most: int) -> DataFrame:
    """First ``quota`` rows of every group in order of arrival, then the rest in order of arrival, ``most`` in all."""
    ranked = rank_in_group(items, [group], [F.col(ordinal).asc()], "_in").filter(F.col("_in") <= most)
    late = (F.col("_in") > quota).cast("int")
    return ranked.withColumn("late", late).orderBy("late", ordinal).limit(most).drop("_in")


def per_query_quota(candidates: DataFrame, query: str, order: list[Column], k: int) -> DataFrame:
    return rank_in_group(candidates, [query], order, "place").filter(F.col("place") <= k)


def priority_pick(df: DataFrame, item: str, priority: Column, order: list[Column]) -> DataFrame:
    """One row an item: the least priority present, then ``order``; rows of null priority never."""
    return first_wins(df.withColumn("_p", priority).filter("_p is not null"), [item], [F.col("_p").asc(), *order]).drop("_p")


def first_nonempty(parts: list[DataFrame], query: str) -> DataFrame:
    """The rows of the first strategy that has any for a query; ``strategy`` numbers them from 1."""
    both = None
    for i, p in enumerate(parts, 1):
        p = p.withColumn("strategy", F.lit(i))
        both = p if both is None else both.unionByName(p)
    first = both.groupBy(query).agg(F.min("strategy").alias("_first")).withColumnRenamed(query, "_q")
    return both.join(first, (F.col(query) == F.col("_q")) & (F.col("strategy") == F.col("_first"))).drop("_q", "_first")


def evict_until_fits(df: DataFrame, size: str, recency: str, ordinal: str, capacity: int, need: int = 0) -> DataFrame:
    """Rows to evict, least recent first (nulls first of all), until what stays and ``need`` fit.

    Sizes are added up by hour of recency before anything meets in one task; exact running sums are then made within
    the hours alone."""
    hour = F.coalesce(F.floor(F.col(recency) / 3600), F.lit(-1)).cast("long")
    rows = df.withColumn("_h", hour)
    hours = rows.groupBy("_h").agg(F.sum(size).alias("_s"))
    totals = hours.select(F.col("_h").alias("_k"), F.coalesce(F.sum("_s").over(W.orderBy("_h").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"), F.sum("_s").over(W.partitionBy()).alias("_used"))
    within = F.coalesce(F.sum(size).over(W.partitionBy("_h").orderBy(F.col(recency).asc_nulls_first(), F.col(ordinal)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", within).join(totals, F.col("_h") == F.col("_k")).filter(F.col("_used") - F.col("_earlier") - F.col("_in") + need > capacity).drop("_h", "_k", "_in", "_earlier", "_used")


def natural_key(text: Column, width: int = 12) -> Column:
    """A sort key in which runs of digits count by value."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), width, "0")).otherwise(p)), "")


def unique_labels(df: DataFrame, group: str, base: str, ordinal: str) -> DataFrame:
    """Adds ``label``: the base for its first row in the group, for others its first ten characters and a number that no other row
    with these has."""
    x = df.withColumn("_n", F.row_number().over(W.partitionBy(group, base).orderBy(ordinal)))
    stem = F.left(F.col(base), F.lit(10))
    again = F.row_number().over(W.partitionBy(group, stem, F.col("_n") > 1).orderBy(ordinal))
    return x.withColumn("label", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(stem, F.lit(" · "), (again + 1).cast("string")))).drop("_n")


def best_page(page: str, explicit: Column, area: Column, full: int) -> Column:
    """The page with the greatest score plus share of a full area (1 at most); of equal ones the lowest."""
    return F.max_by(page, F.struct((explicit + F.least(area / full, F.lit(1.0))).alias("s"), (-F.col(page)).alias("p")))


def in_known_order(df: DataFrame, group: str, name: str, known: list[str], then: list[str]) -> DataFrame:
    """Adds ``place``: names stand where the known order has them, whether or not the group lists all; unknown ones come last, by ``then``."""
    at = F.array_position(F.array(*map(F.lit, known)), F.col(name))
    pos = F.when(at > 0, at).otherwise(F.lit(1000))
    return df.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(pos, *then)))
