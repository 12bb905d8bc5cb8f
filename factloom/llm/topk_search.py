"""Exact top-k by MaxScore over impact postings.

A vector is a document whose terms are its non-zero components by sign: term (d, +)
has the vectors with a positive component d, term (d, -) those with a negative one.
A query's positive component d pulls scores up through (d, +) only and down through
(d, -), so its query terms are the postings of its own signs; a term's bound is the
query's component times the largest value in the postings.

In each shard a query's terms are sorted by bound.  Those with the smallest bounds
whose sum stays below the k-th best score so far are non-essential: a vector in none of
the other, essential, postings cannot enter the result.  Essential postings are traversed,
their vectors' partial scores are compared with what the non-essential terms could
still add, and while they stay competitive the other terms are probed, largest bound
first; what is left gets its full inner product.  Comparisons keep equal scores, so
ties are decided by vec_id alone.  The threshold starts from a first sample of
scored vectors (any k scores bound the k-th best from below), travels with the
queries and rises within the shard; the shards' results merge to the k best.

Queries are broadcast in blocks of QUERY_BLOCK, vectors are read in shards of
SHARD_ROWS, so memory is bounded on both sides, and every vector meets every query.

Defined cases: vectors that are null or hold null, NaN or infinite components take
no part, as query or candidate; vectors of another length are compared over the
components both have; fewer than k other rows give all of them; every row is a candidate of
its own and every query row is searched for, also where rows repeat a vec_id: then its results
stand once for each of these rows, and a query leaves out its own row only (of equal rows one);
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import settle, sliced, union_all

QUERY_BLOCK, SHARD_ROWS, SEED_ROWS = 4096, 4096, 1024
_SCHEMA = "query long, query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): integer components floor(scale * x) of the usable vectors."""
    raw = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return raw.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of integers, missing components as 0, more than ``width`` cut."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max([0, *sizes.tolist()]) if width is None else width
    out = np.zeros((len(lists), width), dtype=np.int64)
    column = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, flat = np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)
    fits = column < width
    out[row[fits], column[fits]] = flat[fits]
    return out


class Shard:
    """Postings of a shard: for each signed component the rows that have it, and the largest value."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.marks, self.vectors = ids, marks, vectors
        self.columns = np.ascontiguousarray(vectors.T)
        self.rows = {(d, s): np.flatnonzero(c * s > 0) for d, c in enumerate(self.columns) for s in (1, -1)}
        self.largest = {t: int(np.abs(self.columns[t[0]][r]).max(initial=0)) for t, r in self.rows.items()}

    def search(self, query: np.ndarray, own: tuple[int, int], k: int, threshold: int | None) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of the shard that reach the threshold; rows equal to the query, ``own`` its id and mark, left out."""
        terms = sorted(((abs(int(q)) * self.largest[(d, 1 if q > 0 else -1)], d, 1 if q > 0 else -1) for d, q in enumerate(query.tolist()) if q), reverse=True)
        bounds = np.array([b for b, _, _ in terms], dtype=np.int64)
        rest = np.concatenate([np.cumsum(bounds[::-1])[::-1], [0]])  # what the terms from i on can still add
        if threshold is None or threshold <= 0:  # a vector in no posting at all may be competitive
            candidates = np.arange(len(self.ids))
        else:
            essential = int(np.count_nonzero(rest >= threshold))
            partial = np.zeros(len(self.ids), dtype=np.int64)
            for _, d, s in terms[:essential]:
                rows = self.rows[(d, s)]
                partial[rows] += query[d] * self.columns[d][rows]
            candidates = np.flatnonzero((partial > 0) & (partial + rest[essential] >= threshold))
            for i in range(essential, len(terms)):
                if not len(candidates) or len(candidates) * (len(terms) - i) < 256:
                    break
                _, d, s = terms[i]
                partial[candidates] += np.maximum(query[d] * self.columns[d][candidates], 0)
                candidates = candidates[partial[candidates] + rest[i + 1] >= threshold]
        candidates = candidates[(self.ids[candidates] != own[0]) | (self.marks[candidates] != own[1])]
        scores = self.vectors[candidates] @ query
        best = np.lexsort((self.ids[candidates], -scores))[:k]
        return [(int(scores[i]), int(self.ids[candidates[i]])) for i in best if threshold is None or scores[i] >= threshold]


def _shards(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Shard]:
    ids, marks, vectors, held = [], [], [], 0
    for batch in batches:
        ids.append(batch.column(0).to_numpy(zero_copy_only=False))
        marks.append(batch.column(1).to_numpy(zero_copy_only=False))
        vectors.append(_matrix(batch.column(2), width))
        held += batch.num_rows
        if held >= SHARD_ROWS:
            yield Shard(np.concatenate(ids), np.concatenate(marks), np.concatenate(vectors))
            ids, marks, vectors, held = [], [], [], 0
    if held:
        yield Shard(np.concatenate(ids), np.concatenate(marks), np.concatenate(vectors))


def _block(own: list[tuple[int, int]], queries: np.ndarray, seeds: Shard | None, k: int) -> list[int | None]:
    """Starting thresholds: the k-th best score among the seed vectors, None where these are fewer."""
    if seeds is None:
        return [None] * len(own)
    out: list[int | None] = []
    for (i, mark), scores in zip(own, queries @ seeds.vectors.T, strict=True):
        other = np.sort(scores[(seeds.ids != i) | (seeds.marks != mark)])
        out.append(int(other[-k]) if len(other) >= k else None)
    return out


def _search(k: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, own, queries, thresholds = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in own]
        now = list(thresholds)
        for shard in _shards(sliced(batches), queries.shape[1]):
            for q in range(len(own)):
                found = shard.search(queries[q], own[q], k, now[q])
                if found:
                    best[q] = sorted(best[q] + found, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best[q]) == k:
                        now[q] = max(best[q][-1][0], best[q][-1][0] if now[q] is None else now[q])
        rows = [(numbers[q], own[q][0], i, s) for q, found in enumerate(best) for s, i in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["query", "query_id", "vec_id", "score"])

    return run


def _lists(table: pa.Table, name: str) -> pa.Array:
    lists = table.column(name).combine_chunks()
    return lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product with each query row, that row left out.
    ``queries`` are rows of ``vectors``."""
    context = vectors.sparkSession.sparkContext
    marked = vectors.select("vec_id", F.xxhash64("v").alias("mark"), "v")
    first = marked.limit(SEED_ROWS).toArrow()
    # Equal query rows are searched for once and are candidates of each other.
    wanted = settle(queries.select("vec_id", F.xxhash64("v").alias("mark"), "v").groupBy("vec_id", "mark", "v").agg(F.count("*").alias("rows")).withColumn("query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK))
    numbered = wanted.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        part = numbered.where(F.col("block") == b).select("query", "vec_id", "mark", "v").toArrow()
        own, matrix = list(zip(part.column("vec_id").to_pylist(), part.column("mark").to_pylist(), strict=True)), _matrix(_lists(part, "v"))
        seeds = Shard(first.column("vec_id").to_numpy(), first.column("mark").to_numpy(), _matrix(_lists(first, "v"), matrix.shape[1])) if first.num_rows else None
        shared = context.broadcast((part.column("query").to_pylist(), own, matrix, _block(own, matrix, seeds, k)))
        found.append(marked.mapInArrow(_search(k, shared), _SCHEMA))
    one = wanted.select("query", F.col("vec_id").alias("query_id"), "vec_id", F.aggregate(F.transform("v", lambda x: x * x), F.lit(0).cast("long"), lambda a, x: a + x).alias("score"), "rows")
    twins = one.where("rows > 1").withColumn("_", F.explode(F.sequence(F.lit(1), F.least(F.col("rows") - 1, F.lit(k))))).select("query", "query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = union_all([*found, twins]).withColumn("rank", rank).where(F.col("rank") <= k)
    if wanted.where("rows > 1").limit(1).count():
        best = best.join(wanted.select("query", "rows"), "query").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return best.select("query_id", "rank", "vec_id", "score")
