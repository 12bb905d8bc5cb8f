"""Global row numbers without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.workspace import settle


def ordinal(df: DataFrame, lead: str, order: list[str], out: str, width: int = 4096) -> DataFrame:
    """Number rows from 0 by ``order``, whose first column is ``lead``, a whole number.

    Rows are numbered within ranges of ``width`` values of ``lead``, and a range starts where the ranges
    before it end: only one count for each range passes through one task.  The ranges stay dealt over all shuffle
    partitions: what follows may cost far more than their bytes say, by which adaptive execution would merge them.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_range", F.floor(F.col(lead) / width)).repartition(parts, "_range")
    counts = df.select(F.floor(F.col(lead) / width).alias("_range")).groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_place", place - 1).join(bases, "_range").withColumn(out, F.col("_base") + F.col("_place")).drop("_range", "_n", "_base", "_place")


def ranked(df: DataFrame, groups: list[str], order: list, out: str) -> DataFrame:
    """Number the rows of each group from 1 by ``order``, however many rows a group has: rows are dealt into ranges of the
    whole order, numbered inside their range, and a range starts where the group's ranges before it end.  Only a
    count for each range and group passes through one task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.repartitionByRange(parts, *groups, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*groups, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(*order))
    return dealt.withColumn("_place", place).join(bases, [*groups, "_part"]).withColumn(out, F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")
