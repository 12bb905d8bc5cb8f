"""Vectorised word and shingle kernels shared by the corpus operators.

All of them work straight on the value buffer of an Arrow string array, so a
batch of documents is tokenised and hashed by a few numpy passes instead of a
Python loop over words.  Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8
text; only A-Z is lower-cased when asked for.  A word's key is 128 bits: up to 16 bytes the
word itself, of a longer one its BLAKE2b digest.  Hashes are 64 well mixed bits of the key,
of two kinds that are independent, and the same in every process and every run.

Null texts count as empty.  Memory is bounded by ``SLICE_BYTES`` or one
document, whichever is larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of a word that are its key, and what is left of eight bytes of which so many count.
KEY_BYTES = 16
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_SEEDS = ((_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)), (_U(0x8EBC6AF09C88C6E3), _U(0x589965CC75374CC3)))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For terms rather than words: every ASCII byte but letters and digits separates.
NOT_ALPHANUMERIC = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the result."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for sums over some tens of mixed hashes; over longer runs of few values such sums may agree."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a run of documents: ``starts``/``ends`` are byte offsets into ``data``;
    document ``i`` owns the words ``bounds[i]:bounds[i + 1]`` and the bytes
    ``offsets[i]:offsets[i + 1]``; ``first`` is its row in the batch."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def documents(self) -> int:
        return len(self.bounds) - 1

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def keys(self, prefix_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length and key, as two numbers, of each word, or of its first bytes: equal for equal words only."""
        ends = self.ends if prefix_bytes is None else np.minimum(self.ends, self.starts + prefix_bytes)
        size, padded = ends - self.starts, self.data.tobytes() + bytes(KEY_BYTES)
        eight = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        low = eight[self.starts] & _FIRST[np.minimum(size, 8)]
        high = eight[self.starts + 8] & _FIRST[np.clip(size - 8, 0, 8)]
        long = np.flatnonzero(size > KEY_BYTES)
        if len(long):
            digests = b"".join(hashlib.blake2b(padded[a:b], digest_size=16).digest() for a, b in zip(self.starts[long].tolist(), ends[long].tolist(), strict=True))
            low[long], high[long] = np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T
        return size.astype(np.uint64), low, high

    def hashes(self, prefix_bytes: int | None = None, kind: int = 0) -> np.ndarray:
        """One 64-bit hash per word, or per its first bytes."""
        return mixed(*self.keys(prefix_bytes), kind)


def mixed(size: np.ndarray, low: np.ndarray, high: np.ndarray, kind: int = 0) -> np.ndarray:
    """A hash of words' keys, of one of two kinds."""
    a, b = _SEEDS[kind]
    return mix64(low * a ^ mix64(high * b + mix64(size + a)))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column, nulls as empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return offsets, data


def words(column: pa.Array, lower: bool, separators: np.ndarray = _IS_SPACE) -> Iterator[Words]:
    """Tokenise a string column in slices of at most SLICE_BYTES or one document."""
    offsets, data = string_buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        part, cut = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        if lower:
            part = _LOWER[part]
        yield _tokenise(part, cut, at, separators)
        at = to


def _tokenise(data: np.ndarray, cut: np.ndarray, first: int, separators: np.ndarray) -> Words:
    size = len(data)
    if not size:
        empty = np.zeros(0, dtype=np.int64)
        return Words(data, empty, empty, np.zeros(len(cut), dtype=np.int64), cut, first)
    space = separators[data]
    opens = np.empty(size, dtype=bool)
    opens[0] = True
    opens[1:] = space[:-1]
    opens[cut[:-1][cut[:-1] < size]] = True
    closes = np.empty(size, dtype=bool)
    closes[-1] = True
    closes[:-1] = space[1:]
    inner = cut[1:-1]
    closes[inner[inner > 0] - 1] = True
    solid = ~space
    starts = np.flatnonzero(opens & solid)
    ends = np.flatnonzero(closes & solid) + 1
    return Words(data, starts, ends, np.searchsorted(starts, cut), cut, first)


def ngram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; entry i starts at word i.

    Runs over document ends are included; callers cut them by their bounds.
    """
    if len(word_hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(word_hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        total *= _U(0xD6E8FEB86659FD93)
        total += word_hashes[k : len(word_hashes) - n + 1 + k]
    return mix64(total)


def document_shingles(w: Words, hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document.

    A document with fewer than n words has its whole sequence as one shingle;
    one without words has none.
    """
    grams = ngram_hashes(hashes, n)
    for i in range(w.documents):
        a, b = int(w.bounds[i]), int(w.bounds[i + 1])
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield ngram_hashes(hashes[a:b], b - a) + _U(b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)


def shingle_set(text: str | None, n: int, lower: bool = True) -> set[tuple[bytes, ...]]:
    """The exact shingle set, for confirming candidates."""
    raw = (text or "").encode()
    seq = (raw.lower() if lower else raw).split()
    if len(seq) < n:
        return {tuple(seq)} if seq else set()
    return set(zip(*(seq[k:] for k in range(n)), strict=False))
