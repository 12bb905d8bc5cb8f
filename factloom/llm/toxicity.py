"""Toxicity by a factorization machine over hashed terms.

    logit(x) = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j / n

The terms of a text are its distinct lower-cased words and their prefixes of 4 to 6
bytes (stems), hashed into 2 ** BITS places, each present or not; n is their number,
so that long texts do not drown in pairs.  The second sum is linear to compute
(Rendle 2010) and learns pairs, such as an insult with the mention of a group, that
additive weights miss.

The machine is fitted on at most SAMPLE labelled documents, the first ones in a hash
order of their ids (of an id with several texts the first by a hash of the text), by mini-batch Adagrad with proximal L1 on the linear weights;
terms in fewer than LEAST sampled documents are not learnt; the sample's size does not grow with the corpus.  Every
document is scored whole, in one pass without a shuffle; the model is a broadcast of fixed size.

Defined cases: null and empty texts have no terms, their score is the bias alone;
null labels are not learnt from, several labels of one id count as its largest;
without labels everything scores below 0.5; repeated rows are scored alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import textkernel
from factloom.llm.common import sliced, texts

BITS, RANK, PREFIXES = 18, 4, (4, 5, 6)
#: Most labelled documents in the fit.
SAMPLE = 8_000
#: Terms that are counted at once.
COUNTED = 1 << 16
LEAST, EPOCHS, STEPS, BATCH, RATE, L1, L2 = 3, 6, 750, 64, 0.3, 5e-4, 1e-4


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of a text column: first row, bounds of each text's terms, distinct hashed terms."""
    for w in textkernel.words(column, lower=True, separators=textkernel.NOT_ALPHANUMERIC):
        doc = np.repeat(np.arange(w.documents, dtype=np.uint64), np.diff(w.bounds))
        length = w.ends - w.starts
        keys = [(doc << np.uint64(BITS)) | (w.hashes() >> np.uint64(64 - BITS))]
        for k in PREFIXES:
            long = length > k
            keys.append((doc[long] << np.uint64(BITS)) | (textkernel.mix64(w.hashes(k)[long] + np.uint64(k)) >> np.uint64(64 - BITS)))
        key = np.unique(np.concatenate(keys))
        bounds = np.searchsorted(key, np.arange(w.documents + 1, dtype=np.uint64) << np.uint64(BITS))
        yield w.first, bounds, (key & np.uint64((1 << BITS) - 1)).astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows between bounds; 0 where there are none."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def logits(machine: Machine, bounds: np.ndarray, index: np.ndarray) -> np.ndarray:
    v = machine.factors[index]
    s = _sums(v, bounds)
    pairs = 0.5 * ((s * s).sum(axis=1) - _sums((v * v).sum(axis=1), bounds))
    return machine.bias + _sums(machine.linear[index], bounds) + pairs / np.maximum(np.diff(bounds), 1)


def fit(bounds: np.ndarray, index: np.ndarray, labels: np.ndarray, seed: int = 7) -> Machine:
    """Fit to texts given by their terms and labels 0 or 1."""
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    positive = float(labels.sum())
    machine = Machine(float(np.log((positive + 0.5) / (len(labels) - positive + 1.5))), np.zeros(size), rng.normal(0, 0.002, (size, RANK)))
    # A text has each term once.  The sample is the driver's largest array, so nothing as long is made of it but what is kept.
    seen = sum((np.bincount(index[at : at + COUNTED], minlength=size) for at in range(0, len(index), COUNTED)), np.zeros(size, np.int64)) >= LEAST
    keep = seen[index]
    index, bounds = index[keep], np.cumsum([0, *(np.count_nonzero(keep[a:z]) for a, z in pairwise(bounds))])
    machine.factors[~seen] = 0
    g_bias, g_linear, g_factors = 1.0, np.full(size, 1e-3), np.full((size, RANK), 1e-3)
    batches = -(-len(labels) // BATCH)
    for _ in range(max(EPOCHS, -(-STEPS // batches)) if 0 < positive < len(labels) else 0):  # small samples are seen more often
        turn = rng.permutation(len(labels))
        for at in range(0, len(turn), BATCH):
            rows = turn[at : at + BATCH]
            sizes = bounds[rows + 1] - bounds[rows]
            inner = np.concatenate([[0], np.cumsum(sizes)])
            flat = index[np.repeat(bounds[rows] - inner[:-1], sizes) + np.arange(inner[-1])]
            error = sigmoid(logits(machine, inner, flat)) - labels[rows]
            error /= len(rows)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            used = flat[order][first]
            each = np.repeat(error, sizes)
            v = machine.factors[flat]
            s = np.repeat(_sums(v, inner), sizes, axis=0)
            grad = np.add.reduceat(each[order], first) if len(first) else each
            g_linear[used] += grad**2
            rate = RATE / np.sqrt(g_linear[used])
            moved = machine.linear[used] - rate * grad
            machine.linear[used] = np.sign(moved) * np.maximum(np.abs(moved) - rate * L1, 0)
            push = (each / np.repeat(np.maximum(sizes, 1), sizes))[:, None] * (s - v)
            grad = (np.add.reduceat(push[order], first) if len(first) else push) + L2 * machine.factors[used]
            g_factors[used] += grad**2
            machine.factors[used] -= 0.25 * RATE * grad / np.sqrt(g_factors[used])
            g_bias += float(error.sum()) ** 2
            machine.bias -= RATE * float(error.sum()) / np.sqrt(g_bias)
    return Machine(machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for first, bounds, index in terms(batch.column("text")):
            own = [batch.column(c).slice(first, len(bounds) - 1) for c in ("doc_id", "toxic", "mark")]
            yield pa.RecordBatch.from_arrays([*own, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(index))], names=["doc_id", "toxic", "mark", "terms"])


def _in_order(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, terms and labels of the sample by doc_id, so that the fit is the same whatever order the rows came in.  The terms are copied once."""
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    lists = []
    for chunk in found.column("terms").chunks:
        flat, at = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy(zero_copy_only=False)
        lists += [flat[a:z] for a, z in pairwise(at)]
    own = [lists[i] for i in order]
    bounds = np.cumsum([0, *map(len, own)], dtype=np.int64)
    return bounds, np.concatenate([np.zeros(0, np.int32), *own]), found.column("toxic").to_numpy()[order].astype(float)


def learn(documents: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fit on at most SAMPLE labelled documents for which ``learns``, a condition on doc_id, holds."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where(learns & F.col("toxic").isNotNull())
    sample = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    found = texts(documents, id_col, text_col).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("mark"), "text").mapInArrow(_featurise, "doc_id long, toxic int, mark long, terms array<int>")
    found = found.groupBy("doc_id").agg(F.min(F.struct("mark", "toxic", "terms")).alias("one")).select("doc_id", "one.toxic", "one.terms").toArrow()
    bounds, index, marks = _in_order(found)
    del found
    pa.default_memory_pool().release_unused()
    return fit(bounds, index, marks)


def score(documents: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    docs = texts(documents, id_col, text_col)
    shared = documents.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [sigmoid(logits(shared.value, bounds, index)) for _, bounds, index in terms(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def reject_toxic(documents: DataFrame, labels: DataFrame, learns: Column, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with all their columns, judged where they lie: nothing is shuffled."""
    machine = learn(documents, labels, learns)
    shared = documents.sparkSession.sparkContext.broadcast(machine)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = [logits(shared.value, bounds, index) < np.log(threshold / (1 - threshold)) for _, bounds, index in terms(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return documents.mapInArrow(run, documents.schema)
