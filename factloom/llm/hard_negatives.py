"""Hard negatives by blocked dense products.

Vectors are packed into blocks, a row of a table each: ids, labels and a matrix of whole numbers.
Candidate blocks are dealt to lanes of about LANE_VALUES components, and every block of anchors goes to
every lane.  A task holds the candidates of one lane and multiplies block after block of anchors with
them, in float64 where all sums stay below 2 ** 53 and are so exact, else in 64-bit integers.

First pass: products within a label only; each (lane, anchor) hands on its best ``positives`` rows,
which merge to the anchor's best over all lanes.  Second pass: the anchors come back with their positives,
whose scores open a window for each; of the rows of other labels inside it each lane hands on its best
``negatives``, which merge likewise.  Neither the driver nor a task ever holds all anchors or all
candidates, a tile of scores has at most TILE numbers, and the rows that leave a lane are at most
``positives`` for an anchor, or ``negatives`` for an anchor and positive, however many rows tie.

Defined cases: a row takes no part where its id, label or vector is null or a component is null, NaN or
infinite; vectors of another length are compared over the components both have; every anchor row is
searched for by itself, also where ids repeat, and leaves out its own row only; equal scores are ordered by
vec_id; fewer rows than asked for give all there are; a window that holds nothing gives no row; an empty
table gives an empty result.  Scores beyond a long raise an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import settle, sliced
from factloom.llm.topk_search import _matrix

#: Components of a lane's vectors, 32 MB as floats, and scores that a task holds at once.
LANE_VALUES, TILE = 1 << 22, 1 << 21
#: Bits of a row's place in its block, and of a block's place in its task.
ROW_BITS, TASK_BITS = 10, 30
EXACT = 1 << 53
_PACKED = "block long, rows int, width int, ids binary, labels binary, places binary, anchors binary, vectors binary"


def labelled(embeddings: DataFrame, anchor: Column, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(vec_id, label, anchor, v): the usable rows, components as floor(scale * x); ``anchor`` says which rows are anchors."""
    raw = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return raw.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite).select("vec_id", "label", "anchor", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


@dataclass
class Block:
    """Vectors side by side; ``places`` tell rows apart, whatever their ids."""

    block: int
    ids: np.ndarray
    labels: np.ndarray
    places: np.ndarray
    anchors: np.ndarray
    vectors: np.ndarray

    def row(self) -> tuple:
        small = not self.vectors.size or max(int(self.vectors.max()), -int(self.vectors.min())) < 1 << 31
        return (self.block, len(self.ids), self.vectors.shape[1], self.ids.tobytes(), self.labels.tobytes(), self.places.tobytes(), self.anchors.tobytes(), self.vectors.astype(np.int32 if small else np.int64).tobytes())

    @classmethod
    def read(cls, row: dict) -> Block:
        longs = lambda c: np.frombuffer(row[c], dtype=np.int64)
        shape = (row["rows"], row["width"])
        wide = len(row["vectors"]) == 8 * shape[0] * shape[1] and shape[0] * shape[1] > 0
        vectors = np.frombuffer(row["vectors"], dtype=np.int64 if wide else np.int32).reshape(shape)
        return cls(row["block"], longs("ids"), longs("labels"), longs("places"), np.frombuffer(row["anchors"], dtype=np.bool_), vectors)

    def take(self, chosen: np.ndarray) -> Block:
        return Block(self.block, self.ids[chosen], self.labels[chosen], self.places[chosen], self.anchors[chosen], self.vectors[chosen])


def _joined(blocks: list[Block], block: int = 0) -> Block:
    width = max((b.vectors.shape[1] for b in blocks), default=0)
    wide = [np.pad(b.vectors.astype(np.int64), ((0, 0), (0, width - b.vectors.shape[1]))) for b in blocks]
    both = lambda c, kind: np.concatenate([getattr(b, c) for b in blocks]) if blocks else np.zeros(0, dtype=kind)
    return Block(block, both("ids", np.int64), both("labels", np.int64), both("places", np.int64), both("anchors", np.bool_), np.concatenate(wide) if wide else np.zeros((0, 0), dtype=np.int64))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[s.split()[1]]) for c, s in zip(zip(*rows, strict=True), schema.split(", "), strict=True)], names=names)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = TaskContext.get().partitionId() << TASK_BITS
    for batch in sliced(batches):
        ids, labels, anchors = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        places = (at << ROW_BITS) + np.arange(len(ids), dtype=np.int64)
        yield _batch([Block(at, ids, labels, places, anchors.astype(np.bool_), _matrix(batch.column(3))).row()], _PACKED)
        at += 1


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of a task's blocks, in blocks of their own."""
    at, held = TaskContext.get().partitionId() << TASK_BITS, []
    most = 1 << ROW_BITS
    for batch in batches:
        for row in batch.to_pylist():
            block = Block.read(row)
            held.append(block.take(block.anchors))
            if sum(len(b.ids) for b in held) >= most:
                full = _joined(held)
                yield _batch([_at(full.take(np.arange(most)), at).row()], _PACKED)
                held, at = [full.take(np.arange(most, len(full.ids)))], at + 1
    if any(len(b.ids) for b in held):
        yield _batch([_at(_joined(held), at).row()], _PACKED)


def _at(block: Block, at: int) -> Block:
    block.block = at
    return block


class Lane:
    """The candidates of a lane, by vec_id; ``scores`` are exact."""

    def __init__(self, blocks: list[Block]) -> None:
        whole = _joined(blocks)
        self.rows = whole.take(np.argsort(whole.ids, kind="stable"))
        self.vectors = self.rows.vectors
        self.largest = int(np.abs(self.vectors).max(initial=0))
        self.floats = self.vectors.astype(np.float64)
        self.by_place = np.argsort(self.rows.places)
        # By label, then id: the products of the first pass are those within a label.
        self.by_label = np.argsort(self.rows.labels, kind="stable")
        self.label, self.start = np.unique(self.rows.labels[self.by_label], return_index=True)
        self.stop = np.append(self.start[1:], len(self.by_label))

    def scores(self, anchors: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
        """Inner products of anchors with the lane's rows, or those in ``columns``."""
        width = min(anchors.shape[1], self.vectors.shape[1])
        bound = width * int(np.abs(anchors).max(initial=0)) * self.largest
        if bound < EXACT:
            mine = self.floats if columns is None else self.floats[columns]
            return anchors[:, :width].astype(np.float64) @ mine[:, :width].T
        if bound >= 1 << 63:
            raise OverflowError("inner products beyond a long")
        mine = self.vectors if columns is None else self.vectors[columns]
        return anchors[:, :width].astype(np.int64) @ mine[:, :width].T

    def own(self, places: np.ndarray) -> np.ndarray:
        """The column of each place, -1 where it is in another lane."""
        if not len(self.by_place):
            return np.full(len(places), -1)
        known = self.rows.places[self.by_place]
        at = np.minimum(np.searchsorted(known, places), len(known) - 1)
        return np.where(known[at] == places, self.by_place[at], -1)


def _lowest(scores: np.ndarray):
    return -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min


def _first(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of the sorted row numbers are among the first k of their row."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows) < k


def best_of_label(lane: Lane, anchors: Block, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the anchor, vec_id, score): the k best rows of the anchor's label in the lane, not the anchor's own."""
    own = lane.own(anchors.places)
    for label in np.unique(anchors.labels):
        at = np.searchsorted(lane.label, label)
        if at == len(lane.label) or lane.label[at] != label:
            continue
        columns = lane.by_label[lane.start[at] : lane.stop[at]]
        mine = np.flatnonzero(anchors.labels == label)
        step = max(1, TILE // len(columns))
        for i in range(0, len(mine), step):
            part = mine[i : i + step]
            scores = lane.scores(anchors.vectors[part], columns)
            lowest = _lowest(scores)
            here = np.searchsorted(columns, own[part])  # columns of a label rise with the id, as own ones are numbered
            is_own = (own[part] >= 0) & (here < len(columns)) & (columns[np.minimum(here, len(columns) - 1)] == own[part])
            scores[np.flatnonzero(is_own), here[is_own]] = lowest
            enough = np.partition(scores, len(columns) - k, axis=1)[:, len(columns) - k] if len(columns) > k else np.full(len(part), lowest)
            r, c = np.nonzero((scores >= enough[:, None]) & (scores > lowest))
            order = np.lexsort((-scores[r, c], r))
            r, c = r[order], c[order]
            keep = _first(r, k)
            r, c = r[keep], c[keep]
            yield part[r], lane.rows.ids[columns[c]], scores[r, c].astype(np.int64)


def best_in_windows(lane: Lane, anchors: Block, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the anchor, window, vec_id, score): of each anchor's windows [low, high] the k best rows of other labels.
    A window with low above high holds nothing."""
    if not len(lane.rows.ids):
        return
    step = max(1, TILE // len(lane.rows.ids))
    for i in range(0, len(anchors.ids), step):
        part = slice(i, min(i + step, len(anchors.ids)))
        scores = lane.scores(anchors.vectors[part])
        # Windows over all of an anchor's positives first; what is left is sparse.
        r, c = np.nonzero((scores >= low[part].min(axis=1)[:, None]) & (scores <= high[part].max(axis=1)[:, None]) & (anchors.labels[part][:, None] != lane.rows.labels[None, :]))
        value = scores[r, c].astype(np.int64)
        order = np.lexsort((-value, r))
        r, c, value = r[order], c[order], value[order]
        for w in range(low.shape[1]):
            inside = np.flatnonzero((value >= low[part][r, w]) & (value <= high[part][r, w]))
            inside = inside[_first(r[inside], k)]
            yield r[inside] + i, np.full(len(inside), w), lane.rows.ids[c[inside]], value[inside]


def _lane_by_lane(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lane, Block, list]]:
    """Each block of anchors with the candidates of its lane, which come before it."""
    lane, at, blocks = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["lane"] != at:
                lane, at, blocks = None, row["lane"], []
            if not row["seeks"]:
                blocks.append(Block.read(row))
                continue
            lane = lane or Lane(blocks)
            blocks = []
            yield lane, Block.read(row), row["positives"] or []


_POSITIVES = "anchor long, anchor_id long, positive_id long, positive_score long"
_NEGATIVES = "anchor long, anchor_id long, window int, positive_id long, positive_score long, negative_id long, negative_score long"


def _positives(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, anchors, _ in _lane_by_lane(batches):
            for r, ids, scores in best_of_label(lane, anchors, k):
                yield pa.RecordBatch.from_arrays([pa.array((anchors.block << ROW_BITS) + r), pa.array(anchors.ids[r]), pa.array(ids), pa.array(scores)], names=[c.split()[0] for c in _POSITIVES.split(", ")])

    return run


def _negatives(positives: int, k: int, low: int, high: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lane, anchors, known in _lane_by_lane(batches):
            shape = (len(anchors.ids), positives)
            least, most = np.ones(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
            ids, scores = np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64)
            for p in known:
                at = (p["anchor"] & ((1 << ROW_BITS) - 1), p["rank"] - 1)
                ids[at], scores[at] = p["positive_id"], p["positive_score"]
                least[at], most[at] = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
            # An empty window widens neither end of what is looked at.
            none = least > most
            least[none], most[none] = np.iinfo(np.int64).max, np.iinfo(np.int64).min
            for r, w, negative, score in best_in_windows(lane, anchors, least, most, k):
                columns = [(anchors.block << ROW_BITS) + r, anchors.ids[r], w.astype(np.int32), ids[r, w], scores[r, w], negative, score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _NEGATIVES.split(", ")])

    return run


def _dealt(candidates: DataFrame, anchors: DataFrame, lanes: int) -> DataFrame:
    """Blocks of candidates in their lanes, before all blocks of anchors; a task for each lane."""
    kind = "array<struct<anchor:bigint,rank:int,positive_id:bigint,positive_score:bigint>>"
    lane = F.pmod(F.shiftright("block", TASK_BITS) + F.col("block").bitwiseAND((1 << TASK_BITS) - 1), F.lit(lanes)).cast("int")
    held = candidates.select(lane.alias("lane"), F.lit(0).alias("seeks"), "*", F.lit(None).cast(kind).alias("positives"))
    sent = anchors if "positives" in anchors.columns else anchors.withColumn("positives", F.lit(None).cast(kind))
    sent = sent.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(1).alias("seeks"), *candidates.columns, F.col("positives").cast(kind).alias("positives"))
    return held.unionByName(sent).repartitionById(lanes, "lane").sortWithinPartitions("lane", "seeks", "block")


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over ``labelled`` vectors: for each anchor and each
    of its ``positives`` best rows of the same label the first ``negatives`` rows of other labels whose score is ``low`` to ``high``
    hundredths of the positive's."""
    spark = vectors.sparkSession
    packed = settle(vectors.select("vec_id", "label", "anchor", "v").mapInArrow(_packed, _PACKED), "vectors")
    size = packed.agg(F.coalesce(F.sum(F.col("rows").cast("long") * F.col("width")), F.lit(0)).alias("values"), F.count("*").alias("blocks")).first()
    lanes = max(1, min(size["blocks"], max(2 * spark.sparkContext.defaultParallelism, -(-size["values"] // LANE_VALUES))))
    anchors = settle(packed.mapInArrow(_anchors, _PACKED), "anchors")
    found = settle(_dealt(packed, anchors, lanes).mapInArrow(_positives(positives), _POSITIVES), "positives")
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= positives)
    kept = best.groupBy(F.shiftright("anchor", ROW_BITS).alias("block")).agg(F.collect_list(F.struct("anchor", "rank", "positive_id", "positive_score")).alias("positives"))
    found = settle(_dealt(packed, settle(anchors.join(kept, "block"), "anchors"), lanes).mapInArrow(_negatives(positives, negatives, low, high), _NEGATIVES), "negatives")
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("negative_score"), "negative_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
