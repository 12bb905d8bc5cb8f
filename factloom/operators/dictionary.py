"""All terms of a dictionary in texts, by one automaton: a text is read once, however many terms there are.

The Aho-Corasick automaton is built by each task that reads texts, from terms that are broadcast in blocks of at most
BLOCK_TERMS: a larger dictionary reads the texts once for each block.  Matches overlap, as ``in`` sees them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of one automaton; some 50 MB of them at most where terms have tens of characters.
BLOCK_TERMS = 200_000
#: Occurrences of one Arrow batch, those of a text's end above it.
BATCH_OCCURRENCES = 50_000


class Automaton:
    """Where the terms occur in a text, whatever the case; empty terms are none."""

    def __init__(self, terms: Iterable[str]) -> None:
        self.names: dict[str, list[int]] = {}
        for i, term in enumerate(terms):
            if term:
                self.names.setdefault(term.lower(), []).append(i)
        self.machine = ahocorasick.Automaton()
        for low in self.names:
            self.machine.add_word(low, (low, len(low), _word(low[0]), _word(low[-1])))
        if self.names:
            self.machine.make_automaton()

    def occurrences(self, text: str, whole_words: bool = False, apart: bool = False) -> Iterator[tuple[str, int, int]]:
        """(lower-cased term, start, end) of every occurrence, in code points of the text; with ``apart`` none that overlaps one of
        the same term before it."""
        if not self.names:
            return
        low, back = lowered(text)
        free: dict[str, int] = {}
        # A blank on either side of the text is no part of a word, as nothing is.
        padded = f" {low} " if whole_words else ""
        for last, (term, length, head, tail) in self.machine.iter(low):
            first = last + 1 - length
            # A word begins or ends where one of two neighbours is part of a word.
            if whole_words and (head == _word(padded[first]) or tail == _word(padded[last + 2])):
                continue
            if apart:
                if first < free.get(term, 0):
                    continue
                free[term] = last + 1
            yield term, first if back is None else back[first], last + 1 if back is None else back[last] + 1

    def found(self, text: str) -> set[int]:
        """The places in the dictionary of the terms that a text holds."""
        return {i for term in {t for _, (t, *_) in self.machine.iter(text.lower())} for i in self.names[term]} if self.names else set()


def lowered(text: str) -> tuple[str, list[int] | None]:
    """The text in lower case, and where each of its characters comes from if that changed their number."""
    low = text.lower()
    if len(low) == len(text):
        return low, None
    each = [c.lower() for c in text]
    return "".join(each), [i for i, c in enumerate(each) for _ in c]


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


@lru_cache(maxsize=4)
def automaton(terms: tuple[str, ...]) -> Automaton:
    """A worker builds the automaton of a dictionary once."""
    return Automaton(terms)


def find_terms(rows: DataFrame, terms: DataFrame, keys: list[str], text_col: str = "text", term_col: str = "term", whole_words: bool = False, apart: bool = False, written: bool = False) -> DataFrame:
    """(*keys, term, start, end): each occurrence of each term, lower-cased, in each row's text; offsets are code points, end
    exclusive.  With ``whole_words`` both ends lie at a word's edge, with ``apart`` occurrences of one term do not overlap, and
    with ``written`` a last column has what stands in the text between the offsets (so that nobody has to take the whole text
    along with each occurrence).  Null texts hold nothing."""
    distinct = terms.select(F.lower(F.col(term_col)).alias("term")).where("term <> ''").distinct()
    blocks = max(1, -(-distinct.count() // BLOCK_TERMS))
    numbered = distinct.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    named = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {named[k]}" for k in keys), "term string, start int, end int", *(["written string"] if written else [])])
    names = [*keys, "term", "start", "end", *(["written"] if written else [])]
    found = None
    for block in range(blocks):
        shared = rows.sparkSession.sparkContext.broadcast(tuple(sorted(numbered.where(F.col("block") == block).select("term").toArrow().column(0).to_pylist())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine = automaton(shared.value)
            for batch in batches:
                rows_at, each, as_written = [], [], []

                def made(batch=batch) -> pa.RecordBatch:
                    at = pa.array(rows_at, pa.int32())
                    terms_, starts, ends = zip(*each, strict=True)
                    columns = [*(batch.column(k).take(at) for k in range(len(keys))), pa.array(terms_), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
                    return pa.RecordBatch.from_arrays([*columns, *([pa.array(as_written)] if written else [])], names=names)

                for at, value in enumerate(batch.column(len(keys))):
                    text = value.as_py() or ""
                    new = list(machine.occurrences(text, whole_words, apart))
                    each += new
                    rows_at += [at] * len(new)
                    if written:
                        as_written += [text[start:end] for _, start, end in new]
                    if len(each) >= BATCH_OCCURRENCES:
                        yield made()
                        rows_at, each, as_written = [], [], []
                if each:
                    yield made()

        one = rows.select(*keys, text_col).mapInArrow(run, schema)
        found = one if found is None else found.unionByName(one)
    return found
