"""Token ids as one concatenated array with Elias-Fano encoded document boundaries.

The tokenizers library's BPE works on the pieces that its pre-tokenizer cuts.  Here a
numpy pass cuts a batch into the same pieces, a piece is encoded by the library and kept in a
table of fixed size, and a document's ids are put together from its pieces' ids.  A place of the table holds the
piece itself (one of more than 16 bytes: its length and 128-bit BLAKE2b digest), which is compared.
Whole texts go to the library where a tokenizer is of another make, or where a text
holds the string of a special token.

Format.  A store is a table of blocks in ascending doc_id order.  A block holds up to
BLOCK_IDS ids (at least one document) as

    ids    little-endian unsigned 16- or 32-bit integers, documents end to end
    low    the low l bits of each document's end offset, packed
    high   the high bits in unary: bit (end >> l) + i is set for document i
    docs   the doc_ids, as differences

With n documents over u ids, l = floor(log2(u / n)), and the boundaries take about
2 + log2(u / n) bits a document where a table of 64-bit offsets takes 64.  ``Boundaries``
answers select(i), the end of document i, from a sampled directory of the high bits.
Blocks are rows of Parquet: Spark's commit protocol makes the write safe against lost
executors, any file system that Spark reaches will do, and a block is read by itself.

A store has parts, ranges of documents of near equal bytes, about PART_BYTES each and at most MOST_PARTS.
They are cut by (doc_id, checksum of the text, a seeded number), found from a sample of
SAMPLE_EACH rows a part and all texts of a 64th of a part or more, so a doc_id or a text that a third of all rows has is spread over parts, too.

Defined cases: a null text is an empty one, whose only id is the end id; rows without a
doc_id come last; rows with equal doc_ids are stored one after the other, ordered by their texts'
checksum; an empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import textkernel
from factloom.llm.common import settle, texts
from factloom.plans.workspace import small_batches

BLOCK_IDS = 1 << 20
#: Bits of the table's places: a place keeps the last piece that fell on it.  Ids that are kept before the table starts anew.
TABLE_BITS, KEPT_IDS = 21, 1 << 24
#: Bytes of text in a part, most parts, sampled rows for each of them.
PART_BYTES, MOST_PARTS, SAMPLE_EACH = 24 << 20, 20_000, 100
#: Code points encoded at a time; some ten arrays of them are in memory.
SLICE_POINTS = 1 << 19
_STORE = "part int, block int, documents int, first_doc long, width int, total long, low_bits int, ids binary, low binary, high binary, docs binary"


class Boundaries:
    """Elias-Fano code of a non-decreasing sequence of end offsets."""

    SAMPLE = 64

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes) -> None:
        self.count, self.low_bits = count, low_bits
        self.low = np.unpackbits(np.frombuffer(low, np.uint8), bitorder="little")
        self.high = np.frombuffer(high, np.uint8)
        ones = np.concatenate([[0], np.cumsum(np.unpackbits(self.high[:, None], axis=1).sum(axis=1))]) if len(self.high) else np.zeros(1, np.int64)
        self.directory = np.searchsorted(ones, np.arange(0, count, self.SAMPLE), "right") - 1  # byte of every SAMPLE-th one
        self.before = ones[self.directory] if count else ones[:0]

    @staticmethod
    def encode(ends: np.ndarray) -> tuple[int, bytes, bytes]:
        n, u = len(ends), int(ends[-1]) if len(ends) else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        ends = ends.astype(np.int64)
        low = ((ends[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        high = np.zeros((u >> bits) + n + 1, dtype=np.uint8)
        high[(ends >> bits) + np.arange(n)] = 1
        return bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()

    def select(self, i: int) -> int:
        """End offset of document i: from the sampled byte on, the i-th one in the high bits."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        at, left = int(self.directory[i // self.SAMPLE]), i - int(self.before[i // self.SAMPLE])
        while True:
            ones = int(self.high[at]).bit_count()
            if left < ones:
                break
            left, at = left - ones, at + 1
        position = at * 8 + int(np.flatnonzero(np.unpackbits(self.high[at : at + 1], bitorder="little"))[left])
        low = self.low[i * self.low_bits : (i + 1) * self.low_bits]
        return ((position - i) << self.low_bits) | int((low.astype(np.int64) << np.arange(self.low_bits)).sum())

    def all(self) -> np.ndarray:
        """Every end offset, in one pass."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.count]
        low = self.low[: self.count * self.low_bits].reshape(self.count, self.low_bits).astype(np.int64)
        return ((ones - np.arange(self.count)) << self.low_bits) | (low << np.arange(self.low_bits)).sum(axis=1)


@lru_cache(maxsize=1)
def _character_classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, as the byte-level pre-tokenizer's pattern has them."""
    import regex

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = np.zeros(0x110000, dtype=np.uint8)
    for k, pattern in ((1, r"\p{L}"), (2, r"\p{N}"), (3, r"\s")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = k
    return out


def piece_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer's pieces start in texts laid end to end, as
    places of code points; ``firsts`` has each text's first place and the end.

    Runs of letters, numbers or other characters are pieces, with one space before
    them if there is one; the white space before that space, or up to the last
    character before anything else, is a piece; and 's 't 're 've 'm 'll 'd are pieces
    where an apostrophe starts one.
    """
    n = len(points)
    kind = _character_classes()[points]
    start = np.zeros(n + 1, dtype=bool)
    start[firsts] = True
    border = start[1:n].copy()  # no piece crosses a text's end
    start[1:n] |= kind[1:] != kind[:-1]
    before_solid = np.zeros(n, dtype=bool)  # the last white space before something solid
    before_solid[:-1] = (kind[:-1] == 3) & (kind[1:] != 3) & ~border
    start[:n] |= before_solid
    joined = np.flatnonzero(before_solid & (points == 0x20)) + 1
    start[joined] = False
    for q in np.flatnonzero(start[:n] & (points == 0x27)).tolist():
        stop = firsts[np.searchsorted(firsts, q, "right")]
        tail = "".join(map(chr, points[q + 1 : min(q + 3, stop)]))
        size = 3 if tail in ("re", "ve", "ll") else 2 if tail[:1] in ("s", "t", "m", "d") and tail else 0
        if size:
            start[q + 1 : q + size] = False
            if q + size < stop and kind[q + size] == 1:
                start[q + size] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Encodes texts with a tokenizer file, piece by piece where that is exact."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keys, self.places = np.zeros((1 << TABLE_BITS, 3), np.uint64), np.zeros(1 << TABLE_BITS, np.int64)  # a length of 0 marks a free place
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        form = self.tokenizer.pre_tokenizer
        self.whole = type(form).__name__ != "ByteLevel" or form.add_prefix_space or not form.use_regex or self.tokenizer.normalizer is not None

    def _library(self, batch: list[str]) -> list[bytes]:
        """Ids as native unsigned 32-bit integers."""
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts end to end, and the bounds of each text's."""
        odd = [self.whole or any(x in text for x in self.special) for text in batch]
        plain = [t for t, o in zip(batch, odd, strict=True) if not o]
        ids, bounds = self._pieces(plain)
        if not any(odd):
            return ids, bounds
        parts, own = iter(np.split(ids, bounds[1:-1]) if plain else []), (np.frombuffer(x, dtype=np.uint32) for x in self._library([t for t, o in zip(batch, odd, strict=True) if o]))
        found = [next(own) if o else next(parts) for o in odd]
        return np.concatenate(found), np.cumsum([0, *map(len, found)])

    def _keep(self, names: list[bytes]) -> np.ndarray:
        """Encode pieces, add their ids to the pool; each one's place there, shifted by 24 bits, and number of ids."""
        each = self._library([x.decode() for x in names])
        size = np.array([len(x) // 4 for x in each], dtype=np.int64)
        ids = np.frombuffer(b"".join(each), dtype=np.uint32)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        places = ((self.used + np.cumsum(size) - size) << 24) | size
        self.used += len(ids)
        return places

    def _pieces(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(batch)
        raw, points = np.frombuffer(text.encode(), dtype=np.uint8), np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        firsts = np.cumsum([0, *map(len, batch)])
        starts = piece_starts(points, firsts)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(batch) + 1, np.int64)
        if self.used > KEPT_IDS:
            self.keys[:] = 0
            self.pool, self.used = np.zeros(1 << 20, np.uint32), 0
        if len(raw) == len(points):
            edge = np.append(starts, len(raw))
        else:
            width = 1 + (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
            edge = np.append((np.cumsum(width, dtype=np.int64) - width)[starts], len(raw))
        keys = textkernel.Words(raw, edge[:-1], edge[1:], firsts, firsts, 0).keys()
        slot = (textkernel.mixed(*keys) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        keys, place = np.stack(keys, axis=1), self.places[slot]
        missing = np.flatnonzero((self.keys[slot] != keys).any(axis=1))
        if len(missing):
            new, one, kind = np.unique(keys[missing], axis=0, return_index=True, return_inverse=True)
            flat, one = raw.tobytes(), missing[one]
            found = self._keep([flat[a:b] for a, b in zip(edge[one].tolist(), edge[one + 1].tolist(), strict=True)])
            place[missing] = found[kind.ravel()]
            own, last = np.unique(slot[one], return_index=True)
            self.keys[own], self.places[own] = new[last], found[last]
        count = place & 0xFFFFFF
        end = np.cumsum(count)
        ids = self.pool[np.repeat((place >> 24) - (end - count), count) + np.arange(int(end[-1]))]
        return ids, np.concatenate([[0], end])[np.searchsorted(starts, firsts)]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """A worker process keeps its encoder, and the pieces it knows, from task to task."""
    return Encoder(path)


def _encoded(path: str, end_id: int, cuts: list[tuple]):
    """``cuts`` are the first places of the parts after the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts_, at = batch.column("text").to_pylist(), 0
            places = zip(*(batch.column(c).to_pylist() for c in ("last", "doc_id", "mark", "spread")), strict=True)
            parts = pa.array([bisect_right(cuts, (last, 0 if last else doc, mark, spread)) for last, doc, mark, spread in places], pa.int32())
            while at < len(texts_):
                to, held = at + 1, len(texts_[at])
                while to < len(texts_) and held + len(texts_[to]) <= SLICE_POINTS:
                    held, to = held + len(texts_[to]), to + 1
                ids, bounds = encoder.encode(texts_[at:to])
                rows = [np.append(ids[a:b], end_id).astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([parts.slice(at, to - at), *(batch.column(c).slice(at, to - at) for c in ("last", "doc_id", "mark")), pa.array(rows, pa.binary())], names=["part", "last", "doc_id", "mark", "ids"])
                at = to

    return run


def pack(part: int, block: int, docs: list[int | None], rows: list[bytes]) -> dict:
    """One block of the store; documents without an id stand last."""
    ids = np.frombuffer(b"".join(rows), dtype="<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    low_bits, low, high = Boundaries.encode(np.cumsum([len(x) // 4 for x in rows]))
    known = np.array([d for d in docs if d is not None], dtype="<i8")
    step = np.diff(known, prepend=known[:1])
    return {"part": part, "block": block, "documents": len(rows), "first_doc": int(known[0]) if len(known) else None, "width": width, "total": len(ids), "low_bits": low_bits, "ids": ids.astype("<u2").tobytes() if width == 2 else ids.tobytes(), "low": low, "high": high, "docs": zlib.compress(step.astype("<i8").tobytes(), 1)}


def _blocks(block_ids: int):
    """Pack the sorted documents of a partition, a block as soon as it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, docs, rows, held = 0, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            one = pack(part, block, docs, rows)
            kinds = {"part": pa.int32(), "block": pa.int32(), "documents": pa.int32(), "first_doc": pa.int64(), "width": pa.int32(), "total": pa.int64(), "low_bits": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in one.items()], names=list(one))

        for batch in batches:
            for p, d, x in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if rows and (held + len(x) // 4 > block_ids or p != part):
                    yield flush()
                    block, docs, rows, held = (block + 1 if p == part else 0), [], [], 0
                part = p
                docs.append(d)
                rows.append(x)
                held += len(x) // 4
        if rows:
            yield flush()

    return run


def _cuts(docs: DataFrame) -> tuple[int, list[tuple]]:
    """The number of parts, and where all but the first begin: places (last, doc_id, mark, spread) that split a
    sample of the rows, weighted by size, into near equal parts."""
    total = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("text") + 2), F.lit(0)).alias("bytes")).first()
    parts = min(MOST_PARTS, max(1, -(-total["bytes"] // PART_BYTES)))
    if parts == 1:
        return 1, []
    share = min(1.0, parts * SAMPLE_EACH / total["rows"])
    size = F.octet_length("text") + 2
    sure = size >= total["bytes"] // parts // 64
    sample = docs.where(sure | (F.pmod(F.xxhash64("spread"), F.lit(1_000_000)) < share * 1_000_000))
    sample = sample.select("last", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "mark", "spread", F.when(sure, size).otherwise(size / share).alias("size"))
    sample = sample.toPandas().sort_values(["last", "doc_id", "mark", "spread"])
    ends = sample["size"].cumsum().to_numpy()
    at = np.unique(np.searchsorted(ends, np.arange(1, parts) * (ends[-1] / parts)))
    return parts, [(bool(r[0]), int(r[1]), int(r[2]), float(r[3])) for r in sample.iloc[at][["last", "doc_id", "mark", "spread"]].itertuples(index=False)]


def write_store(documents: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenise every text, append ``end_id`` and write the store in ascending doc_id
    order; returns the store as read back.  Only the encoded ids are shuffled, each part to a task of its own."""
    spark = documents.sparkSession
    docs = texts(documents, id_col, text_col).select(F.col("doc_id").isNull().alias("last"), "doc_id", F.crc32("text").alias("mark"), F.rand(17).alias("spread"), "text")
    parts, cuts = _cuts(docs)
    # A row's part follows from its place; equal rows in one place may trade the seeded number, which changes nothing.
    encoded = docs.mapInArrow(_encoded(tokenizer, end_id, cuts), "part int, last boolean, doc_id long, mark long, ids binary")
    spread = encoded.repartitionById(parts, "part").sortWithinPartitions("part", "last", "doc_id", "mark")
    store = spread.select("part", "doc_id", "ids").mapInArrow(_blocks(block_ids), _STORE)
    if path is None:
        return settle(store, "tokens")
    with small_batches(spark):
        store.write.parquet(path)
    return spark.read.schema(store.schema).parquet(path)


def read_block(row: dict) -> tuple[np.ndarray, Boundaries, np.ndarray]:
    """Ids, boundaries and doc_ids of a stored block; the last documents of it may have no doc_id."""
    ids = np.frombuffer(row["ids"], dtype="<u2" if row["width"] == 2 else "<u4")
    docs = np.cumsum(np.frombuffer(zlib.decompress(row["docs"]), dtype="<i8")) + (row["first_doc"] or 0)
    return ids, Boundaries(row["documents"], row["low_bits"], row["low"], row["high"]), docs


def read_documents(store: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every stored document, from the stored bytes: ids as little-endian unsigned 32-bit
    integers, start the number of ids before them.  Block totals are summed up first: parts and blocks, which grow with the corpus only a millionth as fast as its ids."""
    sizes = store.groupBy("part").agg(F.sum("total").alias("n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    starts = store.select("part", "block", F.coalesce(F.sum("total").over(inner), F.lit(0)).alias("within")).join(bases, "part").select("part", "block", (F.col("base") + F.col("within")).alias("start"))
    blocks = store.join(settle(starts, "starts"), ["part", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                ids, boundaries, docs = read_block(row)
                ends = boundaries.all()
                begins = np.concatenate([[0], ends[:-1]])
                wide = ids.astype("<u4")
                each = [wide[a:b].tobytes() for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([*docs.tolist(), *[None] * (len(ends) - len(docs))], pa.int64()), pa.array(begins + row["start"]), pa.array(each, pa.binary())], names=["doc_id", "start", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, ids binary")
