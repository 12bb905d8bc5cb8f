"""Mixing sources to target weights by capped water-filling.

Every source's target is its weight's part of the budget, clamped at
``max_epochs`` times its size; what the clamped sources leave over goes to the
others in proportion to their weights until none is above its cap.  The fixed
point is one water level L with sum(min(cap, L * weight)) = budget, found by a
window over the sources sorted by cap / weight.

A target of r epochs takes every document floor(r) times; the fraction that is
left takes documents in a seeded hash order until its words are used up, so a
source misses its target by less than one word.  The histogram (source, bucket of
the order) finds the bucket where that happens, and only that bucket's rows are
sorted: no task holds a whole source, however large its part of the rows is.

Defined cases: a null source is a source of its own and sorts last; a null text
has size 0; sources without words have target 0; rows without a doc_id, or with one doc_id,
have places of their own in the order by their texts; equal rows share a place and are
interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import join_by_key, settle

#: Bits of the sampling order that number its buckets; most sources whose plan is broadcast (about 100 bytes each).
BUCKET_BITS, BROADCAST_SOURCES = 10, 200_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, weight) -> plus target, for a budget of ``share`` of all sizes.  One row per source."""
    total = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy("_ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = sources.withColumn("_budget", F.lit(share) * F.sum("source_size").over(total)).withColumn("_cap", F.col("source_size") * F.lit(max_epochs)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    s = s.withColumn("_level", level)
    final = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_level"))).over(total)["_level"]
    s = s.withColumn("_final", final)
    clamped = F.col("_final").isNull() | (F.col("_ratio") <= F.col("_final"))
    return s.withColumn("target", F.when(clamped, F.col("_cap")).otherwise(F.col("_final") * F.col("weight"))).select(*sources.columns, "target")


def _order(seed: int) -> Column:
    """The seeded sampling order: 63 bits, so that signed comparison is the order.  ``mark`` is a hash of the text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "mark"), 1)


def mixing_plan(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: int) -> DataFrame:
    """(doc_id, mark, source, size) -> per source: its size and rows, target, whole epochs, and the
    point of the sampling order up to which documents are taken once more."""
    rows = sizes.select("source", "size", _order(seed).alias("h")).withColumn("bucket", F.shiftright("h", 63 - BUCKET_BITS).cast("int"))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    turn = (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    per_source = per_source.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    plan = water_fill(per_source, share, max_epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = settle(plan.select(F.col("source").alias("plan_source"), "source_size", "source_rows", "target", "whole", "rest"), "plan")
    same = F.col("source").eqNullSafe(F.col("plan_source"))
    ahead = Window.partitionBy("plan_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n")).join(plan, same).withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    edge = edge.where("base < rest AND rest <= base + n").select(F.col("plan_source").alias("edge_source"), F.col("bucket").alias("edge_bucket"), "base", "rest")
    at_edge = rows.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("bucket") == F.col("edge_bucket")))
    inner = Window.partitionBy("edge_source").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cut = at_edge.groupBy("edge_source", "h").agg(F.sum("size").alias("n"), F.count_if(F.col("size") > 0).alias("rows_at"), F.first("base").alias("base"), F.first("rest").alias("rest")).withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    cut = cut.where("before < rest AND rest <= before + n").select("edge_source", F.col("h").alias("cut"), (F.col("rest") - F.col("before")).alias("part"), F.col("n").alias("part_of"), "rows_at")
    return settle(plan.join(cut, F.col("plan_source").eqNullSafe(F.col("edge_source")), "left").select("plan_source", "source_size", "source_rows", "target", "whole", "cut", "part", "part_of", "rows_at"), "plan")


def _taken(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with doc_id, mark, source and size -> plus source_size, target and taken.  The plan has one
    row per source; it is broadcast up to a checked number of them, and beyond it the hot ones are."""
    if plan.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("plan_source")))
    else:
        named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias("source_key")
        total = plan.agg(F.sum("source_rows")).first()[0]
        joined = join_by_key(rows.select("*", named("source")), plan.select(named("plan_source"), *(c for c in plan.columns if c != "plan_source")), "source_key", "source_rows", total)
    h = _order(seed)
    extra = F.when(h < F.col("cut"), F.col("size")).when(h == F.col("cut"), F.expr("part * size div part_of")).otherwise(F.lit(0))
    return joined.withColumn("at_cut", F.coalesce((h == F.col("cut")) & (F.col("size") > 0), F.lit(False))).withColumn("taken", F.col("whole") * F.col("size") + F.when(F.col("size") > 0, extra).otherwise(F.lit(0)))


def mix(documents: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``documents``: doc_id, size, source_size, target and taken, the
    words the mix takes from it.  Sources by code point take the weights in turn."""
    sizes = settle(documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{source_col}`").alias("source"), word_count(text_col).alias("size")), "sizes")
    return _taken(sizes, mixing_plan(sizes, weights, share, max_epochs, seed), seed).select("doc_id", "size", "source_size", "target", "taken")


def repeat_rows(documents: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The mixed corpus itself, with the columns of ``documents``: each row as often
    as the mix takes it, in whole copies; the one row of a source that is taken
    in part rounds to the nearest.  Documents without words weigh nothing and stay
    once.  Texts are not shuffled: each row meets its source's plan where it lies."""
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")
    rows = documents.select("doc_id", F.xxhash64("text").alias("mark"), "source", word_count("text").alias("size"), row)
    plan = mixing_plan(settle(rows.drop("row"), "sizes"), weights, share, max_epochs, seed)
    mixed = _taken(rows, plan, seed)
    several = F.col("at_cut") & (F.col("rows_at") > 1)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(1))
    out = mixed.where(~F.coalesce(several, F.lit(False))).select("row", copies.alias("copies"))
    if plan.where("rows_at > 1").limit(1).count():
        out = out.union(_equal_rows(mixed.where(several)))
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def _equal_rows(rows: DataFrame) -> DataFrame:
    """(row, copies) of the equal rows at a source's cut: as many of them as its part holds are taken once more.
    They are numbered within the tasks that wrote them and by the counts of the tasks before, so no task holds all."""
    rows = settle(rows.select("row", "source", "whole", F.floor(F.col("part") / F.col("size") + 0.5).alias("once_more"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("line")), "equal")
    ahead = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("source", "task").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select(F.col("source").alias("of"), F.col("task").alias("by"), "before")
    numbered = rows.select("source", "task", "line", F.row_number().over(Window.partitionBy("source", "task").orderBy("line")).alias("place"))
    numbered = numbered.join(counts, F.col("source").eqNullSafe(F.col("of")) & (F.col("task") == F.col("by"))).select(F.col("line").alias("at"), (F.col("before") + F.col("place")).alias("number"))
    return rows.join(numbered, F.col("line") == F.col("at")).select("row", (F.col("whole") + (F.col("number") <= F.col("once_more")).cast("long")).cast("int").alias("copies"))
