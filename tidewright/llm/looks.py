"""Problem 5 over tables: counting characters, choosing representatives, and finding values that only look the same."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import codes as K
from . import common as C


def character_counts(df: DataFrame, fields: list[str]) -> dict[str, int]:
    """Occurrences of every code point over all rows. At most one entry a Unicode code point, so the result is bounded
    whatever the table's size; counts are added up within each task first."""

    def count(batches):
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            for col in b.columns:
                c, _ = K.codes(col.to_pylist())
                if len(c):
                    n = np.bincount(c)
                    total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"code": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    rows = df.select(*fields).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {chr(r.code): r.n for r in rows}


def unify_looks(df: DataFrame, fields: list[str], counts: dict[str, int] | None = None) -> DataFrame:
    """``df`` with every field of ``fields`` in its one form: look-alike classes take their member most frequent in the
    table (``counts``; counted here if not given). Null stays null; other columns are untouched."""
    counts = character_counts(df, fields) if counts is None else counts

    told = tuple(sorted(counts.items()))

    @arrow_udf("string")
    def unify(x: pa.Array) -> pa.Array:
        return pa.array(K.tables_by(told).looks(x.to_pylist()), pa.string())

    return df.withColumns({f: unify(F.col(f)) for f in fields})


def same_look_pairs(df: DataFrame, fields: list[str], ordinal: str, counts: dict[str, int] | None = None) -> DataFrame:
    """``field_name, index_lo, index_hi``: pairs of rows whose values of a field have one look but are different strings.

    Null and blank values don't count. Rows are first grouped to distinct spellings of a look, spellings are paired, and
    only pairs of different spellings get their rows, so the work follows the output and copies of one string cost nothing."""
    told = tuple(sorted((character_counts(df, fields) if counts is None else counts).items()))

    def spell(batches):
        t = K.tables_by(told)
        digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            ids = b.column(0).to_pylist()
            for j, f in enumerate(fields):
                texts = b.column(1 + j).to_pylist()
                looks = t.looks(texts)
                keep = [i for i, (s, x) in enumerate(zip(texts, looks)) if s and x.strip()]
                yield pa.RecordBatch.from_pydict({
                    "field_name": pa.array([f] * len(keep), pa.string()), "look": pa.array([digest(looks[i]) for i in keep], pa.binary()),
                    "spelling": pa.array([int.from_bytes(digest(texts[i])[:8], "little", signed=True) for i in keep], pa.int64()), "o": pa.array([ids[i] for i in keep], pa.int64()),
                })

    rows = df.select(F.col(ordinal).cast("long"), *fields).mapInArrow(spell, "field_name string, look binary, spelling long, o long")
    many = rows.groupBy("field_name", "look").agg(F.min("spelling").alias("a"), F.max("spelling").alias("z")).filter("a <> z").select("field_name", "look")
    varied = C.checkpoint(rows.join(many, ["field_name", "look"], "left_semi"))
    spellings = varied.select("field_name", "look", "spelling").distinct()
    two = spellings.alias("a").join(spellings.alias("b"), (F.col("a.field_name") == F.col("b.field_name")) & (F.col("a.look") == F.col("b.look")) & (F.col("a.spelling") < F.col("b.spelling"))).select("a.field_name", "a.look", F.col("a.spelling").alias("s1"), F.col("b.spelling").alias("s2"))
    left = two.join(varied.select("field_name", "look", F.col("spelling").alias("s1"), F.col("o").alias("x")), ["field_name", "look", "s1"])
    both = left.join(varied.select("field_name", "look", F.col("spelling").alias("s2"), F.col("o").alias("y")), ["field_name", "look", "s2"])
    return both.select("field_name", F.least("x", "y").alias("index_lo"), F.greatest("x", "y").alias("index_hi"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(C.table(spark, sf_dir, "aihot_24h"), ["title", "summary"], "api_index")


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose title or summary changes, in their one form."""
    raw = C.table(spark, sf_dir, "aihot_24h").select("api_index", "title", "summary", F.col("title").alias("was_title"), F.col("summary").alias("was_summary"))
    new = unify_looks(raw, ["title", "summary"])
    return new.filter(~F.col("title").eqNullSafe(F.col("was_title")) | ~F.col("summary").eqNullSafe(F.col("was_summary"))).select("api_index", "title", "summary")


QUERIES = {"p5_found": p5_found, "p5_unified": p5_unified}
