"""Base relations that several plans read, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import table

#: The feed with plain columns: blank categories are 'other', scores that aren't numbers are null.
ITEMS_SQL = """items AS (SELECT api_index, batch_no, id, title, summary, "originalTitle" AS original_title, links.original AS url, publishedAt AS published_at,
  coalesce(nullif(trim(category, ' '), ''), 'other') AS category, source.name AS source_name, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, selected FROM aihot_24h)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "aihot_24h")
    return t.select(
        "api_index", "batch_no", "id", "title", "summary", F.col("originalTitle").alias("original_title"), F.col("links.original").alias("url"), F.col("publishedAt").alias("published_at"),
        F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("other")).alias("category"), F.col("source.name").alias("source_name"), F.when(~F.isnan("score"), F.col("score")).alias("score"), "selected",
    )
