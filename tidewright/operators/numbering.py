"""Global row numbers without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 1 by a unique, sortable column: numbers within ordered ranges, raised by the ranges before."""
    ranges = checkpoint(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = ranges.withColumn("_in", F.row_number().over(W.partitionBy("_range").orderBy(order)))
    return inside.join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(name, F.col("_in") + F.col("_before")).drop("_range", "_r", "_in", "_before")
