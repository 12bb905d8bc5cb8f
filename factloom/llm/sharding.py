"""Best-fit-decreasing bin packing of indivisible groups into shards.

Groups of equal texts never split.  Taken by falling size, each enters the bin
whose remaining capacity is the tightest that still holds it; bins lie in a
balanced tree by remaining capacity, and a new bin opens only when none fits.

Groups of one size are interchangeable, so the packing runs over the histogram
(size, number of groups): a run of equal groups fills the tightest bin in one
step.  The histogram is what the driver receives, and it is bounded whatever the corpus:
sizes up to 2 ** EXACT_BITS are exact, larger ones are rounded up to EXACT_BITS leading bits,
to at most 0.01 % more, so there are 2 ** EXACT_BITS of them and half as many for each doubling
beyond (some 300,000 for groups of up to 100 TB).  A packing of the rounded sizes holds the true ones.
Documents, groups and assignments stay in Spark.

Defined cases: a null text is an empty one (size 1); equal rows and equal texts
share a shard; an empty table gives an empty result; a group larger than the
fair share gets a shard of its own, and the rest is shared by the others.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import join_by_key, settle

#: Leading bits of a size that count, and the rows that a bucket of a numbering aims at.
EXACT_BITS, BUCKET_ROWS = 14, 4096


class RemainingTree:
    """Bins by (remaining capacity, bin) in a two-level balanced tree: leaves of at
    most 2 * WIDTH entries that split when full, found through their largest keys."""

    WIDTH = 512

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.tops: list[tuple[int, int]] = []

    def add(self, key: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.tops = [[key]], [key]
            return
        at = min(bisect_left(self.tops, key), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, key)
        self.tops[at] = leaf[-1]
        if len(leaf) > 2 * self.WIDTH:
            self.leaves[at : at + 1] = [leaf[: self.WIDTH], leaf[self.WIDTH :]]
            self.tops[at : at + 1] = [leaf[self.WIDTH - 1], leaf[-1]]

    def pop_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity that holds size."""
        at = bisect_left(self.tops, (size, -1))
        if at == len(self.leaves):
            return None
        leaf = self.leaves[at]
        key = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.tops[at] = leaf[-1]
        else:
            del self.leaves[at], self.tops[at]
        return key


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """Pack (size, groups) into bins of one capacity: runs (size, bin, groups) and
    the number of bins; None as soon as more than ``most`` bins would be needed."""
    free, runs, bins = RemainingTree(), [], 0
    for size, count in sorted(histogram, reverse=True):
        if size > capacity:
            raise ValueError(f"a group of {size} does not fit into {capacity}")
        while count:
            found = free.pop_tightest(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            room, at = found
            took = min(count, room // size)
            runs.append((size, at, took))
            free.add((room - took * size, at))
            count -= took
    return runs, bins


def pack_into(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs (size, shard, groups) for a fixed number of shards: the least capacity,
    found by bisection, whose best-fit-decreasing packing needs no more shards."""
    left = dict(histogram)
    runs, used, total = [], 0, sum(s * n for s, n in histogram)
    for size in sorted(left, reverse=True):  # groups above the fair share of what is left
        while left[size] and used < shards - 1 and size * (shards - used) > total:
            runs.append((size, used, 1))
            left[size] -= 1
            total -= size
            used += 1
        if left[size]:
            break
    rest = [(s, n) for s, n in left.items() if n]
    if not rest:
        return runs
    low, step = max(-(-total // (shards - used)), max(s for s, _ in rest)), 1
    high, best = low, best_fit_decreasing(rest, low, shards - used)
    while best is None:
        low, high, step = high + 1, high + step, step * 2
        best = best_fit_decreasing(rest, high, shards - used)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(rest, middle, shards - used)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return runs + [(s, b + used, n) for s, b, n in best[0]]


def _rank(df: DataFrame, by: str, order: str, buckets: int, out: str) -> DataFrame:
    """Number rows from 0 within ``by``, gapless, in hash buckets of ``order``: no
    task sorts or holds all rows of one value."""
    df = df.withColumn("_sub", F.pmod(F.xxhash64(order), F.lit(buckets)))
    counts = df.groupBy(by, "_sub").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(by, "_sub", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(by, "_sub").orderBy(order)
    return df.withColumn("_row", F.row_number().over(inner) - 1).join(counts, [by, "_sub"]).withColumn(out, F.col("_base") + F.col("_row")).drop("_sub", "_base", "_row")


def rounded(size: str) -> Column:
    """A size rounded up to EXACT_BITS leading bits."""
    step = f"shiftleft(1L, greatest(0, length(bin({size})) - {EXACT_BITS}))"
    return F.expr(f"({size} + {step} - 1) div {step} * {step}").cast("long")


def shard_groups(groups: DataFrame, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """(group_key, group_size) -> (group_key, shard) and further columns: into ``shards`` shards of near
    equal size, or into as few shards of ``capacity`` as best-fit-decreasing needs."""
    spark, more = groups.sparkSession, [c for c in groups.columns if c not in ("group_key", "group_size")]
    size = rounded("group_size") if capacity is None else F.when(F.col("group_size") <= capacity, F.least(rounded("group_size"), F.lit(capacity))).otherwise(F.col("group_size"))
    sized = groups.select("group_key", *more, size.alias("group_size"))
    histogram = [(int(s), int(n)) for s, n in sized.groupBy("group_size").agg(F.count("*").alias("n")).toPandas().itertuples(index=False)]
    runs = pack_into(histogram, shards) if shards else best_fit_decreasing(histogram, capacity)[0]
    at: dict[int, int] = {}
    rows = []
    for size, shard, n in runs:
        rows.append((size, shard, at.get(size, 0), at.get(size, 0) + n))
        at[size] = at.get(size, 0) + n
    frame = pd.DataFrame(rows, columns=["group_size", "shard", "rank_from", "rank_to"])
    table = spark.createDataFrame(frame, "group_size long, shard int, rank_from long, rank_to long")
    if len(rows) > 100_000:
        table = settle(table, "runs")
    most = max((n for _, n in histogram), default=0)
    ranked = _rank(sized, "group_size", "group_key", max(64, -(-most // BUCKET_ROWS)), "rank")
    return ranked.join(table, "group_size").where("rank >= rank_from AND rank < rank_to").select("group_key", *more, "shard")


def shard_documents(documents: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in a shard) of every
    row; equal texts share a shard and the shards' bytes are near equal."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = documents.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group_key"), F.rand(29).alias("spread"))
    rows = settle(rows, "sizes")
    groups = settle(rows.groupBy("group_key").agg(F.sum("size").alias("group_size"), F.count("*").alias("members")), "groups")
    total = rows.count()
    placed = settle(shard_groups(groups, shards), "placed")
    out = join_by_key(rows, placed, "group_key", "members", total)
    buckets = max(1, -(-total // (shards * BUCKET_ROWS)))
    return _rank(out, "shard", "spread", buckets, "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long"))
