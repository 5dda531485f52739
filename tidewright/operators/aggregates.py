"""Aggregations: shares, modes, weighted blends, ordered text, signal levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def mode_share(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """``group, value, n, share``: each group's most common value (the one seen first by ``order`` wins ties)."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = counts.groupBy(group).agg(F.sum("n").alias("_all"), F.max(F.struct(F.col("n"), (-F.col("_first")).alias("f"), F.col(value).alias("v"))).alias("m"))
    return best.select(group, F.col("m.v").alias(value), F.col("m.n").alias("n"), F.round(F.col("m.n") / F.col("_all"), 6).alias("share"))


def counts_by_state(df: DataFrame, group: str, state: str, states: list[str]) -> DataFrame:
    """One row a group, one zero-filled column a state."""
    return df.groupBy(group).pivot(state, states).agg(F.count(F.lit(1))).na.fill(0, states)


def sum_where(value: Column, cond: Column) -> Column:
    """Money as decimal, so that sums don't depend on the order of rows."""
    return F.coalesce(F.sum(F.when(cond & ~F.isnan(value), value.cast("decimal(18,4)"))), F.lit(0).cast("decimal(18,4)"))


def weighted_blend(df: DataFrame, group: str, kind: str, weights: dict[str, float], fallback: float, most: float = 0.95) -> DataFrame:
    """``group, blend``: mean of the kinds' weights, unknown kinds at ``fallback``, held within 0 and ``most``."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    mean = F.sum(F.round(F.coalesce(F.try_element_at(w, F.col(kind)), F.lit(fallback)) * 10000).cast("long")) / 10000 / F.count("*")
    return df.groupBy(group).agg(F.round(F.least(F.lit(most), F.greatest(F.lit(0.0), mean)), 9).alias("blend"))


def ordered_text(df: DataFrame, group: str, order: str, text: str, sep: str = "\n", name: str = "joined") -> DataFrame:
    """A group's texts in order as one string, blanks dropped. The result is one value a group by its nature."""
    listed = F.array_sort(F.collect_list(F.when(F.trim(text) != "", F.struct(F.col(order).alias("o"), F.col(text).alias("t")))))
    return df.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["t"]), sep).alias(name))


def level(df: DataFrame, group: list[str], sample: str, full: float = 32767.0, safe: float = 32760.0) -> DataFrame:
    """Root mean square in dB of full scale, peak, and the gain that keeps the peak safe."""
    rms = F.sqrt(F.avg(F.col(sample) * F.col(sample)))
    peak = F.max(F.abs(F.col(sample)))
    return df.groupBy(*group).agg(F.round(20 * F.log10(F.nullif(rms, F.lit(0.0)) / full), 4).alias("dbfs"), peak.alias("peak"), F.round(F.least(F.lit(1.0), F.lit(safe) / F.nullif(peak, F.lit(0.0))), 6).alias("headroom"))


def share_of_total(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Sums of each group and their percentage of all; a total of zero counts as one."""
    sums = df.groupBy(*group).agg(F.sum(F.col(value).cast("decimal(18,4)")).alias("total"))
    whole = F.sum("total").over(W.partitionBy())
    return sums.withColumn("percent", F.round(100 * F.col("total").cast("double") / F.when(whole == 0, F.lit(1.0)).otherwise(whole.cast("double")), 6)).withColumn("total", F.col("total").cast("double"))
