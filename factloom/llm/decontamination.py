"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document long, so their Jaccard similarity says
nothing; what counts is containment, the part of the item's shingles that the
document holds.  Items are partitioned by size, and each partition has its own
sketch length, set from its largest item n: the floor((1 - t) * n) + 1 smallest
hash values of an item (all of them where an item has fewer).  A document that
holds at least the part t of the item's shingles misses at most
floor((1 - t) * n) of them, so it must hold one of the retained values: the
search loses nothing.  Probing a document is one pass over its shingle hashes, however long it is.

Candidates are verified by exact containment on the words themselves.

The test items are a stated query set.  Blocks of them are broadcast, each of at
most BLOCK_SHINGLES shingles by count; a larger set is searched block by block,
every document against every block.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  Defined cases: a null text has
no words, and items or documents without words match nothing; fewer than five
words are one shingle, the whole sequence; equal items and repeated documents
are each reported; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkernel
from factloom.llm.common import settle, sliced, texts, union_all

SHINGLE, THRESHOLD = 5, 0.75
BLOCK_SHINGLES = 500_000
_FILTER_BITS = 20
_SCHEMA = "doc_id long, item_id long, item_shingles int, shared int, containment double"


@dataclass
class Index:
    """Retained values of a block of items, sorted, each with its items; the exact shingles of the items."""

    values: np.ndarray
    item_bounds: np.ndarray
    items: np.ndarray
    item_ids: list[int]
    shingles: list[set[tuple[bytes, ...]]]
    present: np.ndarray


def size_partition(n: int) -> int:
    """Partition of an item by its number of shingles: powers of two."""
    return int(n - 1).bit_length()


def build_index(items: list[tuple[int, str]], threshold: float = THRESHOLD, shingle: int = SHINGLE) -> Index:
    item_ids, sets, hashes = [i for i, _ in items], [textkernel.shingle_set(t, shingle) for _, t in items], []
    for w in textkernel.words(pa.array([t for _, t in items], pa.large_string()), lower=True):
        hashes += list(textkernel.document_shingles(w, w.hashes(), shingle))
    largest: Counter = Counter()
    for h in hashes:
        if len(h):
            p = size_partition(len(h))
            largest[p] = max(largest[p], len(h))
    pairs = [(h[: int((1 - threshold) * largest[size_partition(len(h))] + 1e-9) + 1], i) for i, h in enumerate(hashes) if len(h)]
    value = np.concatenate([h for h, _ in pairs]) if pairs else np.zeros(0, dtype=np.uint64)
    owner = np.concatenate([np.full(len(h), i) for h, i in pairs]) if pairs else np.zeros(0, dtype=np.int64)
    order = np.argsort(value, kind="stable")
    values, at = np.unique(value[order], return_index=True)
    present = np.zeros(1 << _FILTER_BITS, dtype=bool)
    present[(values & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    return Index(values, np.append(at, len(value)), owner[order], item_ids, sets, present)


def probe(column: pa.Array, index: Index, shingle: int = SHINGLE) -> Iterator[tuple[int, int]]:
    """Candidate (row, item) pairs: the row's text holds a retained value of the item."""
    low = np.uint64((1 << _FILTER_BITS) - 1)
    for w in textkernel.words(column, lower=True):
        hashes = w.hashes()
        grams = textkernel.ngram_hashes(hashes, shingle)
        maybe = np.flatnonzero(index.present[(grams & low).astype(np.int64)])
        at = np.searchsorted(index.values, grams[maybe])
        hit = (at < len(index.values)) & (index.values[np.minimum(at, len(index.values) - 1)] == grams[maybe]) if len(index.values) else np.zeros(len(maybe), bool)
        maybe, at = maybe[hit], at[hit]
        doc = np.searchsorted(w.bounds, maybe, "right") - 1
        whole = maybe + shingle <= w.bounds[doc + 1] if len(maybe) else np.zeros(0, bool)
        found = {(int(d), int(i)) for d, a in zip(doc[whole], at[whole], strict=True) for i in index.items[index.item_bounds[a] : index.item_bounds[a + 1]]}
        for d in np.flatnonzero((np.diff(w.bounds) > 0) & (np.diff(w.bounds) < shingle)):
            one = textkernel.ngram_hashes(hashes[w.bounds[d] : w.bounds[d + 1]], int(np.diff(w.bounds)[d])) + np.uint64(np.diff(w.bounds)[d])
            a = int(np.searchsorted(index.values, one[0]))
            if a < len(index.values) and index.values[a] == one[0]:
                found |= {(int(d), int(i)) for i in index.items[index.item_bounds[a] : index.item_bounds[a + 1]]}
        yield from sorted((w.first + d, i) for d, i in found)


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in id order, in blocks of bounded size; one block is on the driver at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).orderBy("i", "t").toLocalIterator():
        n = len(r["t"].split())
        if block and size + n > BLOCK_SHINGLES:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += n
    yield block


def _held(column: pa.Array, index: Index, threshold: float, shingle: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared) where the row's text holds at least ``threshold`` of the item's shingles; rows ascend."""
    last, own = -1, set()
    for row, item in probe(column, index, shingle):
        if row != last:
            last, own = row, textkernel.shingle_set(column[row].as_py(), shingle)
        want = index.shingles[item]
        shared = len(want & own)
        if shared >= threshold * len(want) - 1e-9:
            yield row, item, shared


def contained_items(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment) of every document that holds at least ``threshold`` of an item's shingles."""
    docs = texts(documents, id_col, text_col)
    context = documents.sparkSession.sparkContext
    found = []
    for block in item_blocks(benchmark, item_col, item_text_col):
        shared_index = context.broadcast(build_index(block, threshold, shingle))

        def search(parts: Iterator[pa.RecordBatch], shared_index=shared_index) -> Iterator[pa.RecordBatch]:
            index = shared_index.value
            for batch in sliced(parts):
                rows = []
                for row, item, shared in _held(batch.column(1), index, threshold, shingle):
                    n = len(index.shingles[item])
                    rows.append((batch.column(0)[row].as_py(), index.item_ids[item], n, shared, shared / n))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.float64())], names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        found.append(docs.mapInArrow(search, _SCHEMA))
    return union_all(found)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose own text holds no test item, with all their columns, judged where they lie: nothing is
    shuffled, and null or repeated ids take no other row along.  What a block of items leaves is settled
    before the next one, so a task has one block in memory."""
    context = documents.sparkSession.sparkContext
    at = documents.columns.index(text_col)
    left = documents
    for turn, block in enumerate(item_blocks(benchmark, item_col, item_text_col)):
        shared_index = context.broadcast(build_index(block, threshold, shingle))

        def clean(parts: Iterator[pa.RecordBatch], shared_index=shared_index) -> Iterator[pa.RecordBatch]:
            index = shared_index.value
            for part in sliced(parts):
                keep = np.ones(part.num_rows, dtype=bool)
                keep[[row for row, _, _ in _held(part.column(at).fill_null(""), index, threshold, shingle)]] = False
                yield part.filter(pa.array(keep))

        left = (settle(left, "clean") if turn else left).mapInArrow(clean, documents.schema)
    return left
