"""The trie of all conversations' prefixes, from the Cartesian tree of their sorted order.

Distinct sequences of turns are sorted over all tasks, by their turns' SHA-256 digests side by side, so
that a sequence's prefixes are prefixes of bytes.  ``lcp`` of a sequence is the number of turns it shares with the
one before it.  A position's nearest smaller values on both sides bound an interval of sequences: those that share so
many turns, a node of the Cartesian tree.  Positions of equal lcp in one interval are one node, told by its first.

All nearest smaller values are found in parallel.  A task scans one block of the sorted order with a stack.
What the stack cannot answer, because the smaller value lies in another block, is asked of the nearest block whose
minimum is small enough, which the broadcast minima name; each block offers its running minima from either end,
at most one for each depth, and question and answer meet in a join.  A question that finds an equal value on its left
belongs to a node that another block tells.

What a node needs is an interval's: members, leaves, characters in all and in distinct nodes are differences of sums
along the sorted order (a block's own plus those before it), the smallest member is the least of the interval's
parts.  A chain of nodes with the same members, the depths that the tree leaves out, is one row until it is exploded at the end.

Only block summaries pass through the driver, some numbers for each block of about BLOCK_ROWS sequences.  Equal
conversations are collapsed before the sort; the digest over their ids is made from chunks in order, by a
running hash, so a sequence that a third of all conversations share costs no task more than its chunks.

Defined cases: turns are ordered by turn (null first), then by their digests; null roles and texts are empty; rows whose
conversation is null take no part; a conversation without turns is a member of the root; an empty table has no node.
A conversation's digests (32 bytes a turn) have to fit a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import join_by_key, settle

#: Sequences of a block of the sorted order, and conversation ids of a chunk.
BLOCK_ROWS, CHUNK_IDS = 1 << 16, 1 << 15
DIGEST = 32
NO_ENDS = hashlib.sha256(b"").hexdigest()
_TURNS = "array<struct<symbol:string,size:bigint>>"
#: Sums along the sorted order, each up to and without a position: members, leaves, characters of all members, characters of distinct nodes.
_SUMS = ("n", "leaves", "chars", "distinct_chars")


def conversation_turns(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): a digest of role and text and the text's code points for each turn, in order.  Texts are not shuffled."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    symbol = F.sha2(F.concat(F.length(empty(role_col)).cast("string"), F.lit(":"), empty(role_col), empty(text_col)), 256)
    turns = rows.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), symbol.alias("symbol"), F.length(empty(text_col)).cast("long").alias("size")).alias("t"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["symbol"].alias("symbol"), t["size"].alias("size"))).cast(_TURNS).alias("turns"))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


# --- equal conversations ---

_CHUNK = pa.schema([("mark", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_ENDS = pa.schema([("mark", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one sequence, as the text that is hashed."""

    def runs() -> Iterator[tuple]:
        mark, ids = None, []
        for m, i in _rows(batches, "mark", "conv_id"):
            if ids and (m != mark or len(ids) >= CHUNK_IDS):
                yield mark, ids[0], len(ids), ",".join(map(str, ids)).encode()
                ids = []
            mark = m
            ids.append(i)
        if ids:
            yield mark, ids[0], len(ids), ",".join(map(str, ids)).encode()

    return _batches(runs(), _CHUNK)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def runs() -> Iterator[tuple]:
        mark, least, n, digest = None, None, 0, None
        for m, first, k, ids in _rows(batches, "mark", "first", "n", "ids"):
            if digest is not None and m == mark:
                digest.update(b",")
            else:
                if digest is not None:
                    yield mark, least, n, digest.hexdigest()
                mark, least, n, digest = m, first, 0, hashlib.sha256()
            digest.update(ids)
            n += k
        if digest is not None:
            yield mark, least, n, digest.hexdigest()

    return _batches(runs(), _ENDS)


def _distinct(sequences: DataFrame) -> DataFrame:
    """(mark, key, sizes, conv_id, n, ends): each distinct sequence with its smallest conversation, their number and the digest of all ids."""
    parts = max(2 * sequences.sparkSession.sparkContext.defaultParallelism, int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    members = sequences.select("mark", "conv_id").repartitionByRange(parts, "mark", "conv_id").sortWithinPartitions("mark", "conv_id")
    chunks = members.mapInArrow(_chunks, "mark binary, first long, n long, ids binary")
    ends = chunks.repartition(parts, "mark").sortWithinPartitions("mark", "first").mapInArrow(_hashed, "mark binary, conv_id long, n long, ends string")
    return sequences.groupBy("mark").agg(F.any_value("key").alias("key"), F.any_value("sizes").alias("sizes")).join(ends, "mark")


# --- the sorted order ---

_SORTED = pa.schema([("block", pa.int32()), ("place", pa.int64()), ("key", pa.binary()), ("sums", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("n", pa.int64()), ("lcp", pa.int64()), ("next", pa.int64())])


def _shared(a: bytes, b: bytes) -> int:
    """Digests that two sequences have in common at their beginning."""
    n, at = min(len(a), len(b)) // DIGEST, 0
    while at < n and a[at * DIGEST : (at + 1) * DIGEST] == b[at * DIGEST : (at + 1) * DIGEST]:
        at += 1
    return at


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places in the block and what neighbours share; null towards other blocks."""
    block = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        last, shared = None, None
        for place, (key, sizes, conv_id, n) in enumerate(_rows(batches, "key", "sizes", "conv_id", "n")):
            ahead = None if last is None else _shared(last[2], key)
            if last is not None:
                yield (*last, shared, ahead)
            last, shared = (block, place, key, list(accumulate(sizes, initial=0)), conv_id, n), ahead
        if last is not None:
            yield (*last, shared, None)

    return _batches(rows(), _SORTED)


@F.pandas_udf(T.LongType())
def _shared_turns(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([-1 if x is None or y is None else _shared(bytes(x), bytes(y)) for x, y in zip(a, b, strict=True)])


def _sorted(distinct: DataFrame) -> DataFrame:
    """(block, place, key, sums, conv_id, n, lcp, next): the sorted order in blocks; -1 is shared with what is before the first and after the last."""
    blocks = max(2 * distinct.sparkSession.sparkContext.defaultParallelism, -(-distinct.count() // BLOCK_ROWS))
    order = distinct.select("key", "sizes", "conv_id", "n").repartitionByRange(blocks, "key").sortWithinPartitions("key")
    order = settle(order.mapInArrow(_numbered, "block int, place long, key binary, sums array<long>, conv_id long, n long, lcp long, next long"), "order")
    # A row for each block, so this window and the broadcast stay small.
    ends = order.groupBy("block").agg(F.min_by("key", "place").alias("first"), F.max_by("key", "place").alias("last"))
    left = _shared_turns(F.lag("last").over(Window.partitionBy(F.lit(0)).orderBy("block")), "first")
    bounds = ends.withColumn("left", left).select("block", "left", F.coalesce(F.lead("left").over(Window.partitionBy(F.lit(0)).orderBy("block")), F.lit(-1).cast("long")).alias("right"))
    return order.join(F.broadcast(bounds), "block").withColumn("lcp", F.coalesce("lcp", "left")).withColumn("next", F.coalesce("next", "right")).drop("left", "right")


class Minima:
    """Of each block in order: its least lcp and conversation, and the sums before it; whole sums at the end."""

    def __init__(self, order: DataFrame) -> None:
        at = lambda i: F.element_at("sums", (F.greatest(i, F.lit(0)) + 1).cast("int"))
        whole = F.element_at("sums", -1)
        sums = {"n": F.col("n"), "leaves": (F.col("next") < F.size("sums") - 1).cast("long"), "chars": F.col("n") * whole, "distinct_chars": whole - at(F.col("lcp"))}
        table = order.groupBy("block").agg(F.min("lcp").alias("lcp"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(f"all_{s}") for s, c in sums.items())).orderBy("block").toArrow()
        column = lambda c: table.column(c).to_numpy().astype(np.int64)
        self.numbers = {b: i for i, b in enumerate(table.column("block").to_pylist())}
        self.lcp, self.conv_id = column("lcp"), column("conv_id")
        self.before = np.stack([np.concatenate([[0], np.cumsum(column(f"all_{s}"))]) for s in _SUMS], axis=1)

    def left(self, block: int, value: int) -> int:
        """The nearest block before this one with an lcp of at most the value; there is one, as the first lcp of all is -1."""
        return int(np.flatnonzero(self.lcp[:block] <= value)[-1])

    def right(self, block: int, value: int) -> int | None:
        """The nearest block after this one with an lcp below the value."""
        found = np.flatnonzero(self.lcp[block + 1 :] < value)
        return block + 1 + int(found[0]) if len(found) else None

    def least(self, start: int, stop: int) -> int:
        """Smallest conversation of the blocks from start to before stop."""
        return int(self.conv_id[start:stop].min()) if stop > start else FAR


FAR = (1 << 63) - 1

# One schema for what a block tells: whole chains (0), open ones (1), running minima towards its end (2) and its start (3).
_TOLD = "what int, id long, block int, depth long, above long, key binary, parent binary, conv_id long, n long, leaves long, chars long, distinct_chars long, before array<long>, left_value long, left_sums array<long>, left_block int, right_value long, right_sums array<long>, right_block int, place long"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
_TOLD_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _TOLD.split(", ")])


def _chain(depth: int, above: int, key: bytes, sums: list[int], conv_id: int, left: int, inside: list[int]) -> tuple:
    """The nodes from depth ``above`` + 1 to ``depth`` over one interval whose first lcp is ``left``; ``inside`` are the interval's sums."""
    n, leaves, chars, distinct = inside
    own = hashlib.sha256(key[: depth * DIGEST]).digest()
    parent = None if above < 0 else hashlib.sha256(key[: above * DIGEST]).digest()
    before = [sums[max(d - 1, 0)] for d in range(above + 1, depth + 1)]
    return (0, None, None, depth, above, own, parent, conv_id, n, leaves, chars, distinct + sums[max(left, 0)], before, *[None] * 7)


def _smaller_values(minima) -> Callable:
    """A block's chains, by a stack of rising lcp values: each entry is [value, left place or None where it lies before the block, smallest conversation since]."""

    def block_rows(number: int, rows: list[tuple]) -> Iterator[tuple]:
        known: Minima = minima.value
        base, asked = known.before[number], 0
        prefix = [list(map(int, base))]
        for _, key, sums, _, n, lcp, ahead in rows:
            depth, p = len(sums) - 1, prefix[-1]
            prefix.append([p[0] + n, p[1] + (ahead < depth), p[2] + n * sums[-1], p[3] + sums[-1] - sums[max(lcp, 0)]])
        difference = lambda a, b: [y - x for x, y in zip(a, b, strict=True)]
        stack: list[list] = []

        def told(entry: list, place: int, value: int | None, below: int | None) -> tuple | None:
            """The chain of a stack entry whose interval ends before ``place``, at an lcp of ``value``, None where it goes on in another block."""
            nonlocal asked
            depth, left, least = entry
            if depth < 0:
                return None
            _, key, sums, *_ = rows[place - 1]
            if left is not None and value is not None:
                return _chain(depth, max(below, value), key, sums, least, below, difference(prefix[left], prefix[place]))
            left_block = known.left(number, depth) if left is None else None
            right_block, right_value, right_sums = None, value, None
            if left_block is not None:
                least = min(least, known.least(left_block + 1, number))
            if value is not None:
                right_sums = prefix[place]
            else:
                right_block = known.right(number, depth)
                least = min(least, known.least(number + 1, len(known.lcp) if right_block is None else right_block))
                if right_block is None:
                    right_value, right_sums = -1, list(map(int, known.before[-1]))
            asked += 1
            return (1, (number << 32) + asked, number, depth, None, key[: depth * DIGEST], None, least, *[None] * 4, sums[: depth + 1], below, None if left is None else prefix[left], left_block, right_value, right_sums, right_block, None)

        for place, (_, key, sums, conv_id, n, lcp, ahead) in enumerate(rows):
            left, least = (place - 1, rows[place - 1][3]) if place else (None, FAR)
            while stack and stack[-1][0] > lcp:
                entry = stack.pop()
                entry[2] = min(entry[2], least)
                if chain := told(entry, place, lcp, stack[-1][0] if stack else None):
                    yield chain
                left, least = entry[1], entry[2]
            if stack and stack[-1][0] == lcp:
                stack[-1][2] = min(stack[-1][2], least)
            else:
                stack.append([lcp, left if stack else None, least])
            depth, above = len(sums) - 1, max(lcp, ahead)
            if depth > above:
                yield _chain(depth, above, key, sums, conv_id, lcp, difference(prefix[place], prefix[place + 1]))
        least = rows[-1][3]
        while stack:
            entry = stack.pop()
            least = entry[2] = min(entry[2], least)
            if chain := told(entry, len(rows), None, stack[-1][0] if stack else None):
                yield chain
        # Running minima: what a question from the right, or from the left, can find here.
        for what, places in ((2, range(len(rows) - 1, -1, -1)), (3, range(len(rows)))):
            lowest, least = FAR, FAR
            for place in places:
                _, _, _, conv_id, _, lcp, _ = rows[place]
                if what == 2:
                    least = min(least, conv_id)
                if lcp < lowest:
                    lowest = lcp
                    yield (what, None, number, lcp, None, None, None, least, *[None] * 5, None, prefix[place], None, None, None, None, place)
                if what == 3:
                    least = min(least, conv_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_blocks() -> Iterator[tuple]:
            block, rows = None, []
            for row in _rows(batches, "block", "key", "sums", "conv_id", "n", "lcp", "next"):
                if rows and row[0] != block:
                    yield from block_rows(minima.value.numbers[block], rows)
                    rows = []
                block = row[0]
                rows.append(row)
            if rows:
                yield from block_rows(minima.value.numbers[block], rows)

        return _batches(all_blocks(), _TOLD_SCHEMA)

    return run


def _answered(told: DataFrame) -> DataFrame:
    """Open chains closed by the running minima of the blocks they ask."""
    asked = told.where("what = 1")
    record = lambda what, side: told.where(F.col("what") == what).select(F.col("block").alias(f"{side}_block"), F.col("depth").alias("value"), F.col("place").alias("at"), F.col("left_sums").alias("found_sums"), F.col("conv_id").alias("found_conv"))
    found = F.struct("value", "found_sums", "found_conv")
    left = asked.where("left_block IS NOT NULL").select("id", "depth", "left_block").join(record(2, "left"), "left_block").where("value <= depth").groupBy("id").agg(F.max_by(found, "at").alias("l"))
    right = asked.where("right_block IS NOT NULL").select("id", "depth", "right_block").join(record(3, "right"), "right_block").where("value < depth").groupBy("id").agg(F.min_by(found, "at").alias("r"))
    both = asked.join(left, "id", "left").join(right, "id", "left").where("l IS NULL OR l.value < depth")
    both = both.withColumn("lv", F.coalesce("left_value", "l.value")).withColumn("rv", F.coalesce("right_value", "r.value")).withColumn("from", F.coalesce("left_sums", "l.found_sums")).withColumn("to", F.coalesce("right_sums", "r.found_sums"))
    both = both.withColumn("over", F.greatest("lv", "rv")).withColumn("chars_at", F.col("before"))
    inside = lambda i: F.element_at("to", i) - F.element_at("from", i)
    at: Callable[[Column], Column] = lambda d: F.element_at(F.col("chars_at"), (F.greatest(d, F.lit(0)) + 1).cast("int"))
    digest = lambda c: F.unhex(F.sha2(c, 256))
    return both.select(
        "depth", F.col("over").alias("above"), digest(F.col("key")).alias("key"),
        F.when(F.col("over") >= 0, digest(F.substr("key", F.lit(1), (F.col("over") * DIGEST).cast("int")))).alias("parent"),
        F.least("conv_id", "l.found_conv", "r.found_conv").alias("conv_id"),
        inside(1).alias("n"), inside(2).alias("leaves"), inside(3).alias("chars"), (inside(4) + at(F.col("lv"))).alias("distinct_chars"),
        F.transform(F.sequence(F.col("over") + 1, F.col("depth")), lambda d: at(d - 1)).alias("before"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of (conv_id, turns): conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over its subtree, members but one times the characters of a node's last turn) and
    ends_sha256 (over the members that end here)."""
    spark = conversations.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["symbol"]), ""))
    sequences = conversations.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    sequences = settle(sequences.withColumn("mark", F.unhex(F.sha2("key", 256))), "sequences")
    distinct = settle(_distinct(sequences), "distinct")
    order = settle(_sorted(distinct), "sorted")
    minima = Minima(order)
    shared = spark.sparkContext.broadcast(minima)
    blocks = max(1, len(minima.numbers))
    dense = F.broadcast(spark.createDataFrame(list(minima.numbers.items()), "block int, number int"))
    dealt = order.join(dense, "block").repartitionById(blocks, "number").sortWithinPartitions("number", "place")
    told = settle(dealt.mapInArrow(_smaller_values(shared), _TOLD), "told")
    answered = _answered(told)
    chains = settle(told.where("what = 0").select(*answered.columns).unionByName(answered), "chains")
    children = settle(chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children")), "children")
    above = chains.select("key", F.col("conv_id").alias("top_conv_id")).join(children, "key").withColumnRenamed("key", "parent")
    full = chains.join(children, "key", "left").join(distinct.select(F.col("mark").alias("key"), "ends"), "key", "left").withColumnRenamed("children", "own_children")
    full = join_by_key(full, above, "parent", "children", chains.count())
    nodes = full.select("*", F.posexplode("before").alias("step", "spent"))
    depth, bottom = F.col("above") + 1 + F.col("step"), F.col("above") + 1 + F.col("step") == F.col("depth")
    return nodes.select(
        "conv_id", depth.cast("long").alias("depth"), F.when(F.col("step") == 0, F.col("top_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(bottom, F.coalesce("own_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("chars") - F.col("distinct_chars") - (F.col("n") - 1) * F.col("spent")).alias("saved_tokens"), F.when(bottom, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )
