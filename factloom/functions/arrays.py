"""Arrays inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_running_sums(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """Adds ``out``, the running sums of an array of whole numbers, each with its own number.

    A fold that appends copies all it holds at each step.  So the array is cut into about as many chunks as a
    chunk has numbers: each is folded by itself, then their totals, and n numbers cost n ** 1.5 copied ones.
    """
    n = F.size(lengths)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    empty = F.array().cast("array<int>")
    grow: Column = lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / width).cast("int") - 1)), lambda c: F.aggregate(F.slice(F.col(lengths), c * F.col("_width") + 1, F.col("_width")), empty, grow))
    # Columns that are used twice are not folded into what uses them, so each step is worked out once for a row.
    cut = df.withColumn("_width", width).withColumn("_chunks", F.when(n > 0, chunks).otherwise(F.array().cast("array<array<int>>")))
    bases = F.aggregate(F.transform("_chunks", lambda c: F.element_at(c, -1)), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return cut.withColumn(out, F.flatten(F.zip_with(F.col("_chunks"), F.slice(bases, F.lit(1), F.size("_chunks")), lambda c, b: F.transform(c, lambda x: x + b)))).drop("_width", "_chunks")
