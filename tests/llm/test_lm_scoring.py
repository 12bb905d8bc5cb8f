"""Lattice likelihood against enumeration of all segmentations; the query's counts against plain Python."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import lm_scoring as lm
from factloom.llm.common import fold

PIECES = ["▁", "▁a", "a", "ab", "b", "▁ab", "c"]


def scores(size):
    weight = np.arange(1, size + 258, dtype=float)
    log = np.log(weight / weight.sum())
    return lm.Scores(log[:size], log[size : size + 256], float(log[-1]))


def brute(word, pieces, s):
    """Sum over all ways to write the word."""
    text = lm.MARK + word
    total = [0.0] * (len(text) + 1)
    total[0] = 1.0
    for i in range(len(text)):
        for k, p in enumerate(pieces):
            if text.startswith(p, i):
                total[i + len(p)] += total[i] * math.exp(s.pieces[k])
        total[i + 1] += total[i] * math.exp(sum(s.bytes[b] for b in text[i].encode()))
    return math.log(total[-1])


def test_marginals_equal_enumeration():
    vocabulary, s = lm.Vocabulary.of(PIECES), scores(len(PIECES))
    words = ["ab", "abab", "ca", "é日", "a", "aaaaaaaaaaaa", "x" * 40]
    got = lm.word_log_probabilities(words, vocabulary, s)
    assert got == pytest.approx([brute(w, PIECES, s) for w in words])


def test_expected_counts_are_derivatives():
    """An expected count is the derivative of the log likelihood by the piece's score."""
    vocabulary, s = lm.Vocabulary.of(PIECES), scores(len(PIECES))
    words, counts = ["abab", "ca", "bé"], np.array([2.0, 3.0, 1.0])
    used, spelled = lm.expected_counts(words, counts, vocabulary, s)
    for k in range(len(PIECES)):
        moved = lm.Scores(s.pieces + 1e-6 * (np.arange(len(PIECES)) == k), s.bytes, s.end)
        slope = (lm.word_log_probabilities(words, vocabulary, moved) - lm.word_log_probabilities(words, vocabulary, s)) @ counts / 1e-6
        assert used[k] == pytest.approx(slope, abs=1e-3)
    assert spelled[ord("b")] > 0 and spelled["é".encode()[0]] > 0


ROWS = [(0, "The cat\tsat."), (1, "the CAT"), (2, None), (3, ""), (4, "dog " * 300), (4, "dog " * 300), (5, "Ünïque " + "z" * 3000), (None, "the end"), (6, "a b c")]


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 2)  # so that words are joined, too
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    out = lm.score_documents(df, lm.Vocabulary.of(PIECES), trains=fold("doc_id") != 1).collect()
    assert len(out) == len(ROWS)
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in ROWS]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in ROWS]
    c = Counter(x for (i, _), t, h in zip(ROWS, tokens, held, strict=True) if i is not None and not h for x in t)
    total, distinct = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, h, len(t), sum(c[x] > 0 for x in t), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in t), 6)) for (i, _), t, h in zip(ROWS, tokens, held, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_score_is_the_lattice_of_pieces_alone(spark):
    """Words of the training texts, too, have the sum over their segmentations and nothing else."""
    rows, s = [(0, "ab ab CA"), (2, "abab ca"), (3, "é")], scores(len(PIECES))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score_documents(df, lm.Vocabulary.of(PIECES), trains=F.lit(True), scores=s).collect()}
    want = {i: (sum(brute(w, PIECES, s) for w in t.lower().split()) + s.end) / math.log(10) for i, t in rows}
    assert got == pytest.approx(want)


def test_whole_query_equals_the_marginals(spark):
    """Scores that the query fits for itself: each document's is the sum over its words' segmentations under them."""
    vocabulary = lm.Vocabulary.of(PIECES)
    df = spark.createDataFrame(ROWS[:4] + ROWS[7:], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.score) for r in lm.score_documents(df, vocabulary, trains=fold("doc_id") != 1).collect())
    train = [t or "" for i, t in ROWS[:4] + ROWS[7:] if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in t.lower().split())
    s = lm.fit_scores(spark.createDataFrame(list(counts.items()), "word string, c long"), len(train), vocabulary)
    want = sorted((str(i), (sum(brute(w, PIECES, s) for w in (t or "").lower().split()) + s.end) / math.log(10)) for i, t in ROWS[:4] + ROWS[7:])
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(df, lm.Vocabulary.of(PIECES), trains=fold("doc_id") != 1).collect() == []


def test_fit_raises_the_likelihood(spark):
    words = spark.createDataFrame([("abab", 5), ("ab", 9), ("ca", 2)], "word string, c long")
    vocabulary = lm.Vocabulary.of(PIECES)
    listed, counts = ["abab", "ab", "ca"], np.array([5.0, 9.0, 2.0])
    likelihood = lambda s: lm.word_log_probabilities(listed, vocabulary, s) @ counts
    one, three = lm.fit_scores(words, 4, vocabulary, rounds=1), lm.fit_scores(words, 4, vocabulary, rounds=3)
    assert likelihood(lm.starting_scores(len(PIECES))) < likelihood(one) <= likelihood(three) + 1e-6


def test_batches_of_long_words_stay_small():
    """A text without spaces is one word: batches are bounded by bytes, too."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 400)], names=["word"])
    sizes = [part.nbytes for part in lm._gathered(iter([batch, batch]))]
    assert sum(sizes) >= 80_000_000 and max(sizes) < 3 * lm.BATCH_BYTES + (1 << 24)
    few = pa.RecordBatch.from_arrays([pa.array(["ab"] * 50_000)], names=["word"])
    assert [p.num_rows for p in lm._gathered(iter([few]))] == [40_000, 10_000]
