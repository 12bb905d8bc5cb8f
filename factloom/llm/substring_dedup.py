"""Substring deduplication: seed with winnowed anchors, extend, remove repeats.

A window is WINDOW consecutive words of a document.  Winnowing gives each window
one anchor, the leftmost smallest hash of its runs of SEED words: the same words
have the same anchor wherever they stand, so documents that share a window meet at
its anchor.  Consecutive windows with one anchor form a block, the largest stretch
that the anchor stands for; about one word in five starts one.

1. Seed.  Anchors are joined over documents: the smallest doc_id that has the
   anchor, and whether more than one document has it.  All others are dropped.
2. Extend.  Where every occurrence of an anchor extends both ways to the same block,
   the whole block repeats.  Where the blocks differ, as at a passage's ends, each
   window through the anchor is compared by itself, so matches grow to the left and
   to the right exactly as far as the words agree.
3. Keep.  Blocks and windows that a smaller doc_id has merge into maximal repeats;
   their words are removed, all others are kept.

Everything is grouped by content, never by pairs of documents, so a passage in n
documents costs n rows.  Before a shuffle rows are dropped by bitmaps of bounded
size (MOST_BITS) over what they will be joined with; what a bitmap lets through
by chance is dropped by the join itself.  Words are compared by two independent hashes of their keys, 64 bits for
the anchor and 48 or 64 for what is around it.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Defined cases: a null text has no words;
documents with fewer than WINDOW words lose nothing; repeats within a document are
kept; rows of one doc_id do not remove each other's words; a null doc_id neither
removes nor is removed from; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkernel
from factloom.llm.common import bitmap, in_bitmap, settle, sliced, texts

WINDOW, SEED = 13, 5


def blocks(w: textkernel.Words, hashes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of a slice of documents: anchor, block hash, document, first window (as a word of the slice), windows.
    ``others`` is a second kind of the words' hashes: what is around an anchor is hashed apart from it."""
    span = WINDOW - SEED + 1
    grams = textkernel.ngram_hashes(hashes, SEED)
    per_doc = np.maximum(np.diff(w.bounds) - WINDOW + 1, 0)
    doc = np.repeat(np.arange(w.documents), per_doc)
    if not len(doc):
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    start = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + w.bounds[doc]
    least = np.argmin(np.lib.stride_tricks.sliding_window_view(grams, span), axis=1)
    anchor_at = start + least[start]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(doc)))
    a, to = start[first], start[first] + n - 1 + WINDOW
    power, inverse = textkernel.power_tables(len(others) + 1)
    prefix = np.zeros(len(others) + 1, dtype=np.uint64)
    np.cumsum(others * power[: len(others)], out=prefix[1:])
    body = (prefix[to] - prefix[a]) * inverse[a]
    shape = (n * 64 + anchor_at[first] - a).astype(np.uint64)
    return grams[anchor_at[first]], textkernel.mix64(body + textkernel.mix64(shape)), doc[first], a, n


def _tag(raw: bytes) -> int:
    """Tells texts under one doc_id apart; 31 bits, so that a place and its tag fit a long."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=4).digest(), "big") >> 1


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _doc_ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = _doc_ids(batch)
        for w in textkernel.words(batch.column(1), lower=False):
            keys = w.keys()
            anchor, block, doc, _, _ = blocks(w, textkernel.mixed(*keys), textkernel.mixed(*keys, 1))
            if len(anchor):
                yield _batch(anchor=anchor.view(np.int64), doc=ids[doc + w.first], block=(block >> np.uint64(16)).view(np.int64))


def _in(bits: np.ndarray, doc_ids: pa.Array) -> pa.Array:
    """Which doc_ids may be in the bitmap; null is not."""
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False)
    return pa.array(known & in_bitmap(bits, doc_ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)))


def _kept(doc_ids: pa.Array, kept: list[bytes], n_words: list[int], n_removed: list[int]) -> pa.RecordBatch:
    columns = [doc_ids, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "n_words", "n_removed"])


def _occurrences(one, several):
    """Occurrences of shared anchors: whole blocks (window 0) where all blocks agree, else single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _doc_ids(batch)
            for w in textkernel.words(batch.column(1), lower=False):
                keys = w.keys()
                others = textkernel.mixed(*keys, 1)
                anchor, _, doc, a, n = blocks(w, textkernel.mixed(*keys), others)
                if not len(anchor):
                    continue
                agree, differ = in_bitmap(one.value, anchor), in_bitmap(several.value, anchor)
                if not (agree | differ).any():
                    continue
                tags = np.zeros(w.documents, dtype=np.int64)
                for d in np.unique(doc[agree | differ]):
                    tags[d] = _tag(b" ".join(w.data[w.offsets[d] : w.offsets[d + 1]].tobytes().split()))
                grams = textkernel.ngram_hashes(others, WINDOW)
                many = np.flatnonzero(differ)
                each = np.repeat(many, n[many])
                at = a[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
                rows = np.concatenate([np.flatnonzero(agree), each])
                first = np.concatenate([a[agree], at])
                yield _batch(
                    anchor=anchor[rows].view(np.int64),
                    window=np.concatenate([np.zeros(int(agree.sum()), np.int64), (grams[at] | np.uint64(1)).view(np.int64)]),
                    doc=ids[doc[rows] + w.first],
                    at=(tags[doc[rows]] << 32) | (first - w.bounds[doc[rows]]),
                    n=np.concatenate([n[agree], np.ones(len(each), np.int64)]).astype(np.int32),
                )

    return run


def _untouched(bits):
    """The rows whose id is not in the bitmap, all words kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = batch.filter(pc.invert(_in(bits.value, batch.column(0))))
            found = [t.as_py().encode().split() for t in rows.column(1)]
            yield _kept(rows.column(0), [b" ".join(w) for w in found], [len(w) for w in found], [0] * len(found))

    return run


def _tagged(bits):
    """The rows whose id is in the bitmap, with their tags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = batch.filter(_in(bits.value, batch.column(0)))
            tags = [_tag(b" ".join(t.as_py().encode().split())) for t in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tags, pa.int64()), rows.column(1)], names=["doc", "tag", "text"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Remove the words of the repeats (first word, windows) from each text; null repeats remove none."""
    for batch in sliced(batches):
        kept, n_words, n_removed = [], [], []
        for text, starts, counts in zip(batch.column("text"), batch.column("starts"), batch.column("counts"), strict=True):
            found = text.as_py().encode().split()
            edge = np.zeros(len(found) + 1, dtype=np.int64)
            if starts.is_valid:
                start = starts.values.to_numpy(zero_copy_only=False)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + counts.values.to_numpy(zero_copy_only=False) + WINDOW - 1, -1)
            drop = np.cumsum(edge[:-1]) > 0
            kept.append(b" ".join([x for x, d in zip(found, drop.tolist(), strict=True) if not d]))
            n_words.append(len(found))
            n_removed.append(int(drop.sum()))
        yield _kept(batch.column("doc"), kept, n_words, n_removed)


def repeated_blocks(docs: DataFrame) -> DataFrame:
    """(doc, at, n): runs of n windows from word ``at`` on (low 32 bits; the text's tag above) that a smaller doc_id has too."""
    context = docs.sparkSession.sparkContext
    seeds = docs.mapInArrow(_seeds, "anchor long, doc long, block long")
    grouped = seeds.groupBy("anchor").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    shared = settle(grouped.where("first_doc < last").select("anchor", "first_doc", (F.col("b0") != F.col("b1")).alias("differ")), "anchors")
    one, several = context.broadcast(bitmap(shared.where("NOT differ"), "anchor")), context.broadcast(bitmap(shared.where("differ"), "anchor"))
    found = settle(docs.mapInArrow(_occurrences(one, several), "anchor long, window long, doc long, at long, n int"), "occurrences")
    whole = found.where("window = 0").join(shared.where("NOT differ"), "anchor").where("doc > first_doc").select("doc", "at", "n")
    windows = found.where("window <> 0")
    firsts = windows.groupBy("anchor", "window").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last")).where("first_doc < last").select("anchor", "window", "first_doc")
    single = windows.join(settle(firsts, "windows"), ["anchor", "window"]).where("doc > first_doc").select("doc", "at", "n")
    return whole.union(single)


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text (the words that stay, joined by one space), n_words before and n_removed.
    Only texts that may hold a repeat are shuffled, to meet its places; all others stay where they lie."""
    docs = texts(documents, id_col, text_col)
    known = docs.where("doc_id IS NOT NULL")
    repeats = repeated_blocks(known).select("doc", F.shiftright("at", 32).alias("tag"), F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"), F.col("n").cast("long").alias("n")).alias("run"))
    per_doc = settle(repeats.groupBy("doc", "tag").agg(F.collect_set("run").alias("runs")).select("doc", "tag", F.col("runs.at").alias("starts"), F.col("runs.n").alias("counts")), "repeats")
    ids = docs.sparkSession.sparkContext.broadcast(bitmap(per_doc, "doc"))
    kept = "doc_id long, text string, n_words long, n_removed long"
    hit = known.mapInArrow(_tagged(ids), "doc long, tag long, text string").join(per_doc, ["doc", "tag"], "left")
    return docs.mapInArrow(_untouched(ids), kept).union(hit.select("doc", "text", "starts", "counts").mapInArrow(_cut, kept))
