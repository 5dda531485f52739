"""Problem 1: limiting each contributor to a count or a share, keeping its best records.

The limit is a water level: with counts c_i of a scope's contributors, the level x keeps min(c_i, x) of each. A share limit s
is met when x <= s * sum(min(c_i, x)); the right side is concave in x, so one pass over the sorted counts finds the largest
such x. Counts are aggregated before any shuffle, and the level works on the histogram of counts (at most about
sqrt(2 * rows) entries a scope), never on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C


def water_levels(counts: DataFrame, scope: list[str], max_count: int | None, max_share: float | None) -> DataFrame:
    """``scope..., level``: how many records a contributor of the scope may keep. ``counts`` has ``scope..., n`` by contributor.

    Where a scope has fewer contributors than 1 / max_share no level can meet the share; the level is then the least count,
    which makes all shares equal."""
    histogram = counts.groupBy(*scope, "n").agg(F.count("*").alias("m"))
    below = W.partitionBy(*scope).orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    sums = histogram.select(
        *scope, "n", "m", F.coalesce(F.sum(F.col("n") * F.col("m")).over(below), F.lit(0)).alias("kept_whole"), F.coalesce(F.sum("m").over(below), F.lit(0)).alias("m_below"),
        F.sum("m").over(W.partitionBy(*scope)).alias("m_all"), F.coalesce(F.max("n").over(below), F.lit(0)).alias("n_below"),
    )
    share = 1.0 if max_share is None else float(max_share)  # a share of 1 lets every level pass
    room = 1 - F.lit(share) * (F.col("m_all") - F.col("m_below"))
    fits = F.when(room <= 1e-12, F.col("n")).otherwise(F.least("n", F.floor(F.lit(share) * F.col("kept_whole") / F.when(room > 1e-12, room) + 1e-9)))
    level = F.coalesce(F.max(F.when(fits > F.col("n_below"), fits)), F.min("n"))
    if max_count is not None:
        level = F.least(level, F.lit(max_count))
    return sums.groupBy(*scope).agg(level.cast("long").alias("level"))


def _ranked(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """Adds ``rank`` in the group without bringing a group into one task: rows are cut into ordered ranges, ranked within
    range and group, and raised by what earlier ranges hold of the group."""
    ranges = C.checkpoint(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = sizes.select(*(F.col(g).alias(f"_{g}") for g in group), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = ranges.withColumn("_in", F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)))
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_range") == F.col("_r")]
    return inside.join(before, on).withColumn("rank", F.col("_in") + F.col("_before"))


def cap_contributors(df: DataFrame, scope: list[str], contributor: str, score: str, ordinal: str, max_count: int | None = None, max_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, cut): ``ordinal`` (unique) of the rows within and beyond their contributor's limit in their scope, best by ``score``
    first (null and not-a-number last), then by ``ordinal``. Rows without a contributor are in neither. Repeated rows count each.

    Only contributors above the level are ranked. With a count limit a group's ranking stops in every task at ``max_count``
    rows; a share limit has no such bound, so rows are then ranked over ranges."""
    if max_count is None and max_share is None:
        raise ValueError("give max_count, max_share or both")
    s = [f"_s{i}" for i in range(len(scope))]
    rows = df.filter(F.col(contributor).isNotNull()).select(*(F.col(c).alias(a) for c, a in zip(scope, s)), F.col(contributor).alias("_who"), C.number_or_null(F.col(score).cast("double")).alias("_score"), F.col(ordinal).alias("_o"))
    order = [F.col("_score").desc_nulls_last(), F.col("_o").asc()]
    rows = C.checkpoint(rows)  # the contributors' keys are made once
    counts = rows.groupBy(*s, "_who").agg(F.count("*").alias("n"))
    levels = water_levels(counts, s, max_count, max_share)
    l2 = levels.select(*(F.col(c).alias(f"l{c}") for c in s), "level")
    over = counts.join(l2, [F.col(c).eqNullSafe(F.col(f"l{c}")) for c in s]).filter(F.col("n") > F.col("level")).select(*(F.col(c).alias(f"v{c}") for c in s), F.col("_who").alias("v_who"), "level")
    crowded = rows.join(C.sent(C.checkpoint(over)), [F.col(c).eqNullSafe(F.col(f"v{c}")) for c in s] + [F.col("_who") == F.col("v_who")])
    if max_share is None:
        ranked = crowded.withColumn("rank", F.row_number().over(W.partitionBy(*s, "_who").orderBy(*order))).filter((F.col("rank") <= max_count) & (F.col("rank") <= F.col("level")))
        best = ranked.select(F.col("_o").alias("b"))
        cut = crowded.join(best, F.col("_o") == F.col("b"), "left_anti").select(F.col("_o").alias(ordinal))
    else:
        cut = _ranked(crowded, [*s, "_who"], order).filter(F.col("rank") > F.col("level")).select(F.col("_o").alias(ordinal))
    kept = rows.select(F.col("_o").alias(ordinal)).join(cut, ordinal, "left_anti")
    return kept, cut


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = C.table(spark, sf_dir, "aihot_24h")
    return items.select("api_index", "batch_no", "score", C.name_key_udf(F.col("source.name")).alias("who"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_contributors(_feed(spark, sf_dir), ["batch_no"], "who", "score", "api_index", max_count=5)[1]


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to cut so that no contributor has more than a twentieth of all kept rows."""
    return cap_contributors(_feed(spark, sf_dir).withColumn("all", F.lit(1)), ["all"], "who", "score", "api_index", max_share=0.05)[1]


QUERIES = {"p1_found": p1_found, "p1_share": p1_share}
