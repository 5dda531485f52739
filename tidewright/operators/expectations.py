"""Declared expectations whose violations come out as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``broken`` is true for rows that violate the rule; null counts as kept."""

    name: str
    broken: Column
    detail: Column | None = None


def violations(df: DataFrame, entity: str, rules: list[Rule]) -> DataFrame:
    """``entity, rule, detail``: one row for each rule a row breaks, all rules in one pass."""
    told = F.array_compact(F.array(*(F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), (r.detail if r.detail is not None else F.lit("")).cast("string").alias("detail"))) for r in rules)))
    return df.select(F.col(entity).cast("string").alias("entity"), F.explode(told).alias("v")).select("entity", "v.rule", F.coalesce("v.detail", F.lit("")).alias("detail"))


def first_violation(entity: Column, rules: list[Rule]) -> Column:
    return F.coalesce(*(F.when(r.broken, F.lit(r.name)) for r in rules))


def verdicts(found: DataFrame, ladder: list[tuple[int, str]], best: str = "pass") -> DataFrame:
    """``entity, n, verdict``: the first step of the ladder (least count, verdict), from the top, that an entity reaches."""
    v = None
    for n, name in sorted(ladder, reverse=True):
        v = F.when(F.col("n") >= n, name) if v is None else v.when(F.col("n") >= n, name)
    return found.groupBy("entity").agg(F.count("*").alias("n")).select("entity", "n", v.otherwise(best).alias("verdict"))


def gates(found: DataFrame, names: list[str]) -> DataFrame:
    """One row: for each named rule whether nothing breaks it."""
    return found.agg(*((F.count_if(F.col("rule") == n) == 0).alias(n) for n in names))


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key, field, a, b``: the fields in which two documents of one key disagree, nulls equal to each other."""
    b = right.select(F.col(key).alias("_k"), *(F.col(f).alias(f"_{f}") for f in fields))
    j = left.join(b, F.col(key) == F.col("_k"), "full_outer")
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("a"), F.col(f"_{f}").cast("string").alias("b")) for f in fields))
    return j.select(F.coalesce(key, "_k").alias(key), F.inline(cells)).filter(~F.col("a").eqNullSafe(F.col("b")))


def issues(rules: list[tuple[Column, str]]) -> Column:
    """The names of the rules a row breaks, in order."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for broken, name in rules)))
