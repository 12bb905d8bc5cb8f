"""What the corpus operators share: input columns, joins with hot keys, components, bitmaps."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.workspace import BATCH_BYTES, BATCH_ROWS, settle

#: Largest bitmap, 32 MB; bits for each value where there is room.
MOST_BITS, BITS_EACH = 28, 16


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most BATCH_ROWS rows and about BATCH_BYTES bytes: what Python makes of
    a batch stays small whatever the session's batch size is."""
    for batch in batches:
        rows = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, as ``doc_id`` long, and the text, null as empty: extra columns, whatever their names, stay out."""
    return documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def fold(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 5, the fold that the held-out contracts name."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 5


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b) as (node, component), the
    smallest reachable node.  Nodes without an edge do not appear.

    Every round each node takes the smallest label among its own, its neighbours'
    and its label's (a pointer jump), so long chains halve.  All rows stay in Spark;
    a hub's neighbours are pre-aggregated before the shuffle.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        step = labels.join(near, "node").join(jump, "component", "left")
        step = settle(step.select("node", F.least("component", "near", "jump").alias("component"), F.col("component").alias("before")), "labels")
        labels = step.select("node", "component")
        if step.where("component <> before").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A set of longs as bits, by their low bits; at most 2 ** MOST_BITS of them, however many
    values there are.  It never misses a value; those it lets in by chance are for a join to drop."""
    count = values.count()
    bits = min(MOST_BITS, max(10, int(count * BITS_EACH).bit_length()))
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = values.select(low.alias("low")).selectExpr("cast(shiftright(low, 5) AS int) AS at", "shiftleft(1L, cast(low & 31 AS int)) AS bit")
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    table = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[table.column("at").to_numpy()] = table.column("bits").to_numpy().astype(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    low = values & np.uint64(len(bits) * 32 - 1)
    return (bits[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0


#: A key with more than one in HOT_PARTS of all rows is hot; there are fewer than HOT_PARTS of them.
HOT_PARTS = 1000


def join_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of rows with a table of one row for each key and, under ``count``, the number of rows that have it.
    Hot keys, fewer than HOT_PARTS, are broadcast, so their rows stay where they lie; all others are joined by shuffle."""
    values = [c for c in table.columns if c not in (key, count)]
    hot = table.where(F.col(count) * HOT_PARTS > total).drop(count)
    if not hot.limit(1).count():
        return rows.join(table.drop(count), key, "left")
    at = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    rest = at.where("_hot IS NULL").drop("_hot", *values).join(table.where(F.col(count) * HOT_PARTS <= total).drop(count), key, "left")
    return at.where("_hot").drop("_hot").unionByName(rest)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished phases now: it does so for plans that
    nothing refers to any more, which it learns from the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
