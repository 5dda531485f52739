"""Time series and runs: islands, running starts, moving windows, gap filling, clamping, interval complements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import folds


def longest_run(df: DataFrame, group: str, order: str, value: Column, ignore: str = "unspecified") -> DataFrame:
    """``group, longest``: the greatest number of equal neighbours, runs of null or ``ignore`` aside (0 if none)."""
    w = W.partitionBy(group).orderBy(order)
    x = df.withColumn("_v", value).withColumn("_new", (~F.col("_v").eqNullSafe(F.lag("_v").over(w)) | (F.row_number().over(w) == 1)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    runs = x.groupBy(group, "_run").agg(F.count("*").alias("n"), F.first("_v").alias("v"))
    return runs.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("v").isNotNull() & (F.col("v") != ignore), F.col("n"))), F.lit(0)).alias("longest"))


def starts(df: DataFrame, group: str, order: list[str], length: Column, name: str = "start") -> DataFrame:
    """Where each row begins if the rows of a group follow each other."""
    return df.withColumn(name, F.coalesce(F.sum(length).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def changes(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """The rows whose value differs from the row before (a group's first row included), with the value before."""
    w = W.partitionBy(group).orderBy(order)
    x = df.withColumn("before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    return x.filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("before"))).drop("_n")


def regressions(df: DataFrame, group: str, order: str, rank: Column) -> DataFrame:
    """``group, regressions``: how often a known rank falls below the known rank before it."""
    known = df.withColumn("_r", rank).filter("_r is not null")
    x = known.withColumn("_b", F.lag("_r").over(W.partitionBy(group).orderBy(order)))
    return x.groupBy(group).agg(F.count_if(F.col("_r") < F.col("_b")).alias("regressions"))


def moving_average(df: DataFrame, group: str, order: str, value: str, half: int, name: str = "smooth") -> DataFrame:
    """Mean of ``half`` rows on either side, fewer at the edges."""
    return df.withColumn(name, F.avg(value).over(W.partitionBy(group).orderBy(order).rowsBetween(-half, half)))


def smooth_or_still(df: DataFrame, group: str, order: str, value: str, share: float, half: int) -> DataFrame:
    """A series whose range is under ``share`` of its greatest value stands still at its mean; others are smoothed."""
    s = df.groupBy(group).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.avg(value).alias("_mean")).withColumnRenamed(group, "_g")
    x = moving_average(df, group, order, value, half, "_m").join(s, F.col(group) == F.col("_g"))
    still = F.col("_hi") - F.col("_lo") < share * F.col("_hi")
    return x.withColumn("path", F.when(still, F.col("_mean")).otherwise(F.col("_m"))).withColumn("still", still).drop("_g", "_hi", "_lo", "_mean", "_m")


def filled_steps(df: DataFrame, group: str, at: str, value: str, step: float, silent: float, empty: float) -> DataFrame:
    """``group, step_no, value, active``: means of the values above ``silent`` by step, every step from the group's first to its
    last, ``empty`` where there is none."""
    x = df.withColumn("_s", F.floor(F.col(at) / step).cast("long"))
    by = x.groupBy(group, "_s").agg(F.avg(F.when(F.col(value) > silent, F.col(value))).alias("_v"))
    grid = by.groupBy(group).agg(F.min("_s").alias("a"), F.max("_s").alias("z")).select(F.col(group).alias("_g"), F.explode(F.sequence("a", "z")).alias("step_no"))
    return grid.join(by, (F.col("_g") == F.col(group)) & (F.col("step_no") == F.col("_s")), "left").select(F.col("_g").alias(group), "step_no", F.coalesce("_v", F.lit(empty)).alias("value"), (F.col("_v").isNotNull()).alias("active"))


def best_window(df: DataFrame, group: str, order: str, value: str, k: int) -> DataFrame:
    """``group, at, mean``: the k successive rows of greatest mean; the earliest wins ties."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(0, k - 1)
    x = df.withColumn("_m", F.round(F.avg(value).over(w), 6)).withColumn("_n", F.count("*").over(w)).filter(F.col("_n") == k)
    best = x.groupBy(group).agg(F.max("_m").alias("mean")).withColumnRenamed(group, "_g")
    return x.join(best, (F.col(group) == F.col("_g")) & (F.col("_m") == F.col("mean"))).groupBy(group, "mean").agg(F.min(order).alias("at"))


def monotone(df: DataFrame, group: str, order: list[str], start: str, end: str, total: Column) -> DataFrame:
    """Cues that don't overlap: ends held to ``total``, starts raised to the greatest end before, empty cues dropped, the rest
    numbered anew as ``cue``."""
    x = df.withColumn(end, F.least(F.col(end), total)).filter(F.col(end) > F.col(start))
    w = W.partitionBy(group).orderBy(*order)
    x = x.withColumn("_held", F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn(start, F.greatest(start, F.coalesce("_held", F.col(start)))).filter(F.col(end) > F.col(start)).drop("_held")
    return x.withColumn("cue", F.row_number().over(w))


def complement(df: DataFrame, group: str, start: str, end: str, total: Column, pad: float, least: float, merge: float) -> DataFrame:
    """``group, seg_start, seg_end``: what silences leave, ``pad`` kept around each, pieces under ``least`` dropped and pieces less
    than ``merge`` apart joined. Silences of a group are sorted by start and don't overlap."""
    w = W.partitionBy(group).orderBy(start, end)
    cursor = F.greatest(F.lit(0.0), F.coalesce(F.max(F.col(end) - pad).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    pieces = df.withColumn("_t", total).withColumn("seg_start", cursor).withColumn("seg_end", F.least(F.col(start) + pad, F.col("_t")))
    tail = df.withColumn("_t", total).groupBy(group).agg(F.greatest(F.lit(0.0), F.max(F.col(end) - pad)).alias("seg_start"), F.max("_t").alias("seg_end"))
    kept = pieces.select(group, "seg_start", "seg_end").unionByName(tail).filter(F.col("seg_end") - F.col("seg_start") >= least)
    v = W.partitionBy(group).orderBy("seg_start")
    island = kept.withColumn("_new", F.coalesce((F.col("seg_start") - F.lag("seg_end").over(v) >= merge).cast("int"), F.lit(1))).withColumn("_i", F.sum("_new").over(v))
    return island.groupBy(group, "_i").agg(F.min("seg_start").alias("seg_start"), F.max_by("seg_end", "seg_start").alias("seg_end")).drop("_i")


def subsample(values: Column, n: int) -> Column:
    """``n`` evenly spread values of an array, repeats removed and sorted first; all of them if there are fewer."""
    v = F.array_sort(F.array_distinct(values))
    return F.when(F.size(v) <= n, v).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(v, (F.floor(i * F.size(v) / n) + 1).cast("int"))))


def thinned(df: DataFrame, group: str, value: str, gap: float) -> DataFrame:
    """The group's rows, by ``value``, that are at least ``gap`` after the last one kept: each choice depends on the one before."""

    def feed(state, p):
        v, keep, i = p[value].to_numpy(), [], 0
        while i < len(v):
            if state["last"] is None or v[i] - state["last"] >= gap:
                keep.append(i)
                state["last"] = v[i]
                i += 1
            else:  # on to where the gap may be over
                i = max(i + 1, int(np.searchsorted(v, state["last"] + gap - 1e-6)))
        return p.iloc[keep]

    return folds.carried(df.filter(F.col(value).isNotNull()), group, [value], folds._with(df, "")[:-2], lambda: {"last": None}, feed)


def envelope(df: DataFrame, group: str, order: list[str], value: str, attack: float, release: float) -> DataFrame:
    """``group, step, level``: a follower that rises by ``attack`` and falls by ``release`` of the distance at every step."""

    def feed(state, p):
        steps, levels = [], []
        for v in p[value].tolist():
            state["level"] += (attack if v > state["level"] else release) * (v - state["level"])
            levels.append(state["level"])
            steps.append(state["step"])
            state["step"] += 1
        return pd.DataFrame({group: p[group].to_numpy(), "step": steps, "level": levels})

    kind = df.schema[group].dataType.simpleString()
    return folds.carried(df.filter(F.col(value).isNotNull()), group, order, f"`{group}` {kind}, step int, level double", lambda: {"level": 0.0, "step": 0}, feed)


def latest(df: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """The fields of every key's last row."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_m")).select(*keys, "_m.*")
