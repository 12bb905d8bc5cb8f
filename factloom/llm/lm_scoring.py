"""Subword lattice likelihood: the marginal probability of a text over all its segmentations.

The pieces of an existing subword vocabulary are the symbols of a unigram model.
A word, with the vocabulary's word-start mark before it, spans a lattice with an
edge for each piece that matches; every segmentation is a path, its probability the
product of its pieces', and the word's probability the sum over all paths, by the
forward recursion in log space:

    alpha[j] = logsumexp over edges (i, j) of alpha[i] + score(piece)

The score is that of the pieces alone.  ``whole_words=True`` gives another model: training
words are edges too, each spanning its own word with its relative frequency as weight; the
share of such edges is one minus the part of training tokens seen only once (Good-Turing's
estimate of unseen words), so they take most of a known word's probability.

No piece crosses a word start, so a text's log probability is the sum over its words
plus that of the end symbol.  A character without a piece of its own is spelled in
byte pieces, so no text has probability zero.

The vocabulary is never trained.  Its own scores are merge ranks; ``fit_scores``
starts from them as a Zipf distribution and re-estimates the pieces' weights by
expectation maximisation: expected piece counts over all segmentations of all
training words.  ``score_documents`` takes any table of piece scores.

Words are counted once over the whole corpus, and each distinct word's lattice is
computed once.  The most frequent words, at most FREQUENT of them and found by their
count, go to the workers as a table; all others are joined by shuffle, so no hot word is shuffled.

Defined cases: a null or empty text is the end symbol alone; repeated rows are each
returned; a row without a doc_id has no fold: it is scored, neither held out nor learned from; without training documents all counts are 0 and the scores are the
starting ones; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import settle, sliced, texts

MARK = "▁"
FREQUENT, FREQUENT_BYTES = 1 << 18, 64
EM_ROUNDS, SMOOTHING = 2, 0.01
#: Words in a lattice batch; entries of a task's word counts before they are handed on.
BATCH_WORDS, BATCH_BYTES, HELD_WORDS = 40_000, 4 << 20, 400_000


@dataclass
class Vocabulary:
    """Pieces (without their scores) as a trie in sorted arrays, and the byte pieces."""

    pieces: list[str]
    classes: np.ndarray
    keys: np.ndarray
    children: np.ndarray
    terminal: np.ndarray
    longest: int

    @classmethod
    def of(cls, pieces: list[str]) -> Vocabulary:
        letters = sorted({c for p in pieces for c in p})
        classes = np.zeros(0x110000, dtype=np.int32)
        classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = edges.setdefault((node, int(classes[ord(c)])), len(edges) + 1)
            ends[node] = k
        keys = np.array([n * 0x10000 + c for n, c in edges], dtype=np.int64)
        order = np.argsort(keys)
        terminal = np.full(len(edges) + 1, -1, dtype=np.int32)
        terminal[list(ends)] = list(ends.values())
        return cls(pieces, classes, keys[order], np.array(list(edges.values()), dtype=np.int64)[order], terminal, max(map(len, pieces), default=1))

    def edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Lattice edges of words of one length, by start: (start, end, words, pieces)."""
        n, length = codes.shape
        for i in range(length):
            rows, node = np.arange(n), np.zeros(n, dtype=np.int64)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                key = node * 0x10000 + codes[rows, j - 1]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                rows, node = rows[hit], self.children[at[hit]]
                if not len(rows):
                    break
                piece = self.terminal[node]
                full = piece >= 0
                if full.any():
                    yield i, j, rows[full], piece[full]


@dataclass
class Scores:
    """Natural log probabilities of the pieces, of the 256 byte pieces, and of the end where a word could start."""

    pieces: np.ndarray
    bytes: np.ndarray
    end: float


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length as a matrix of code points, word-start mark first, with their places."""
    by: dict[int, list[int]] = {}
    for k, word in enumerate(words):
        by.setdefault(len(word), []).append(k)
    for length, places in by.items():
        flat = np.frombuffer("".join(words[k] for k in places).encode("utf-32-le"), dtype=np.uint32)
        yield np.array(places), np.column_stack([np.full(len(places), ord(MARK), dtype=np.uint32), flat.reshape(len(places), length)])


def _byte_scores(points: np.ndarray, scores: Scores) -> np.ndarray:
    """Score of spelling each character in bytes."""
    kinds, inverse = np.unique(points, return_inverse=True)
    return np.array([sum(scores.bytes[b] for b in chr(c).encode()) for c in kinds])[inverse].reshape(points.shape)


def _forward(codes: np.ndarray, spelled: np.ndarray, edges: list, scores: Scores) -> np.ndarray:
    alpha = np.full((len(codes), codes.shape[1] + 1), -np.inf)
    alpha[:, 0] = 0
    by_start: dict[int, list] = {}
    for e in edges:
        by_start.setdefault(e[0], []).append(e)
    for i in range(codes.shape[1]):
        alpha[:, i + 1] = np.logaddexp(alpha[:, i + 1], alpha[:, i] + spelled[:, i])
        for _, j, rows, piece in by_start.get(i, ()):
            alpha[rows, j] = np.logaddexp(alpha[rows, j], alpha[rows, i] + scores.pieces[piece])
    return alpha


def word_log_probabilities(words: list[str], vocabulary: Vocabulary, scores: Scores) -> np.ndarray:
    """Natural log marginal probability of each word."""
    out = np.zeros(len(words))
    for places, points in _by_length(words):
        codes = vocabulary.classes[points]
        out[places] = _forward(codes, _byte_scores(points, scores), list(vocabulary.edges(codes)), scores)[:, -1]
    return out


def expected_counts(words: list[str], counts: np.ndarray, vocabulary: Vocabulary, scores: Scores) -> tuple[np.ndarray, np.ndarray]:
    """Expected uses of pieces and bytes over all segmentations, by forward and backward recursion."""
    used, spelled_out = np.zeros(len(vocabulary.pieces)), np.zeros(256)
    for places, points in _by_length(words):
        codes, n = vocabulary.classes[points], counts[places]
        spelled, edges = _byte_scores(points, scores), list(vocabulary.edges(codes))
        alpha = _forward(codes, spelled, edges, scores)
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0
        by_start: dict[int, list] = {}
        for e in edges:
            by_start.setdefault(e[0], []).append(e)
        for i in range(codes.shape[1] - 1, -1, -1):
            single = spelled[:, i] + beta[:, i + 1]
            beta[:, i] = np.logaddexp(beta[:, i], single)
            for _, j, rows, piece in by_start.get(i, ()):
                beta[rows, i] = np.logaddexp(beta[rows, i], scores.pieces[piece] + beta[rows, j])
            share = n * np.exp(alpha[:, i] + single - alpha[:, -1])
            kinds, inverse = np.unique(points[:, i], return_inverse=True)
            for c, total in zip(kinds, np.bincount(inverse.ravel(), weights=share), strict=True):
                for b in chr(c).encode():
                    spelled_out[b] += total
            for _, j, rows, piece in by_start.get(i, ()):
                used += np.bincount(piece, weights=n[rows] * np.exp(alpha[rows, i] + scores.pieces[piece] + beta[rows, j] - alpha[rows, -1]), minlength=len(used))
    return used, spelled_out


def starting_scores(pieces: int) -> Scores:
    """Pieces in the order of their existing ranks, as a Zipf distribution; bytes and the end after them."""
    weight = 1 / (np.arange(pieces + 257) + 10.0)
    log = np.log(weight / weight.sum())
    return Scores(log[:pieces], log[pieces : pieces + 256], math.log(0.01))


def load_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece model by falling score, without control, byte and all-mark pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = [(-model.get_score(i), i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = [model.id_to_piece(i) for _, i in sorted(known)]
    return Vocabulary.of([p for p in pieces if p == MARK or MARK not in p[1:]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their counts, all and in training texts, pre-aggregated in the task."""
    every: Counter = Counter()
    train: Counter = Counter()

    def flush() -> pa.RecordBatch:
        words = list(every)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array([every[w] for w in words], pa.int64()), pa.array([train[w] for w in words], pa.int64())], names=["word", "n", "c"])

    for batch in batches:
        for text, learns in zip(batch.column("text"), batch.column("train").to_pylist(), strict=True):
            words = text.as_py().encode().lower().split()
            every.update(words)
            if learns:
                train.update(words)
            if len(every) > HELD_WORDS:
                yield flush()
                every.clear()
                train.clear()
    if every:
        yield flush()


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of some BATCH_WORDS words, or of BATCH_BYTES where words are long: a text without spaces is one word."""
    held, n, size = [], 0, 0
    for batch in sliced(batches):
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n >= BATCH_WORDS or size >= BATCH_BYTES:
            yield pa.Table.from_batches(held)
            held, n, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def fit_scores(words: DataFrame, ends: int, vocabulary: Vocabulary, rounds: int = EM_ROUNDS) -> Scores:
    """Expectation maximisation over (word, c): c is the count in training texts, ``ends`` the number of these.
    Each round gathers one expected count for each piece and byte, a number of rows that the vocabulary bounds."""
    context, size = words.sparkSession.sparkContext, len(vocabulary.pieces)
    opens = np.array([p.startswith(MARK) for p in vocabulary.pieces])
    scores = starting_scores(size)
    train = words.where("c > 0").select("word", "c")
    if not ends:
        return scores
    shared = context.broadcast(vocabulary)
    for _ in range(rounds):
        now = context.broadcast(scores)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 256)
            for part in _gathered(batches):
                used, spelled = expected_counts(part.column("word").to_pylist(), part.column("c").to_numpy().astype(float), shared.value, now.value)
                total += np.concatenate([used, spelled])
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "used"])

        used = np.full(size + 257, SMOOTHING)
        for row in train.mapInArrow(expect, "piece long, used double").groupBy("piece").agg(F.sum("used").alias("used")).collect():
            used[row["piece"]] += row["used"]
        used[-1] += ends
        log = np.log(used / used.sum())
        scores = Scores(log[:size], log[size:-1], math.log(used[-1] / (used[-1] + used[:size][opens].sum())))
    return scores


def score_documents(documents: DataFrame, vocabulary: Vocabulary, trains: Column, scores: Scores | None = None, whole_words: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed word unigram) and
    score, the lattice model's log10 probability.  ``trains`` is a condition on doc_id; scores are fitted unless given."""
    spark = documents.sparkSession
    docs = texts(documents, id_col, text_col).withColumn("train", F.coalesce(trains, F.lit(False)))
    words = settle(docs.mapInArrow(_count, "word string, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "words")
    ends = docs.where("train").count()
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count_if(F.col("c") > 0).alias("distinct"), F.count_if(F.col("c") == 1).alias("once")).first()
    tokens, distinct = totals["tokens"] + ends, totals["distinct"] + (ends > 0)
    scores = scores or fit_scores(words, ends, vocabulary)
    seen = 1 - totals["once"] / totals["tokens"] if whole_words and totals["tokens"] else 0.0
    each = seen * -math.expm1(scores.end) / max(1, totals["tokens"])
    shared, now = spark.sparkContext.broadcast(vocabulary), spark.sparkContext.broadcast(scores)

    def lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            pieces = word_log_probabilities(part.column("word").to_pylist(), shared.value, now.value)
            whole = each * part.column("c").to_numpy()
            log10 = np.logaddexp(pieces + math.log1p(-seen), np.log(whole, out=np.full(len(whole), -np.inf), where=whole > 0)) / math.log(10) if seen < 1 else np.log10(whole, out=np.array(pieces / math.log(10)), where=whole > 0)
            yield pa.RecordBatch.from_arrays([part.column(c).combine_chunks() for c in ("word", "n", "c")] + [pa.array(log10)], names=["word", "n", "c", "lp"])

    below = tokens + 0.5 * (distinct + 1)
    scored = settle(words.mapInArrow(lattice, "word string, n long, c long, lp double").withColumn("base", F.log10((F.col("c") + 0.5) / F.lit(below))), "scored")
    least, room = 1, FREQUENT
    for n, many in sorted(scored.where(F.octet_length("word") <= FREQUENT_BYTES).groupBy("n").agg(F.count("*").alias("many")).collect(), reverse=True):  # at most sqrt(2 * tokens) rows
        room -= many
        if room < 0:
            least = n + 1
            break
    often = F.coalesce((F.col("n") >= least) & (F.octet_length("word") <= FREQUENT_BYTES), F.lit(False))
    top = scored.where(often).select("word", "c", "lp", "base").toArrow()
    table = spark.sparkContext.broadcast(({w.encode(): k for k, w in enumerate(top.column("word").to_pylist())}, top.column("lp").to_numpy(), top.column("base").to_numpy(), top.column("c").to_numpy() > 0))
    end_base, end_lp, end_known = math.log10((ends + 0.5) / below), scores.end / math.log(10), int(ends > 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what the table knows of it, and a row for each other word in it."""
        place, lp, base, known = table.value
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_py().encode().lower()
                found = raw.split()
                at = np.array([place.get(w, -1) for w in found], dtype=np.int64)
                tag = int.from_bytes(hashlib.blake2b(raw, digest_size=7).digest(), "big")
                seen = at[at >= 0]
                rows.append((doc, tag, f" {doc} {tag}", 0, 1, len(found) + 1, int(known[seen].sum()) + end_known, float(base[seen].sum()) + end_base, float(lp[seen].sum()) + end_lp))
                if len(seen) < len(found):
                    rows += [(doc, tag, w.decode(), n, 0, 0, 0, 0.0, 0.0) for w, n in Counter([w for w, k in zip(found, at.tolist(), strict=True) if k < 0]).items()]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "tag", "word", "times", "rows", "n_tokens", "n_known", "base_score", "score"])

    parts = docs.mapInArrow(sums, "doc_id long, tag long, word string, times long, rows long, n_tokens long, n_known long, base_score double, score double")
    rare = scored.where(~often).select("word", "c", "lp", "base")
    joined = parts.join(rare, "word", "left")
    more = F.when(F.col("times") > 0, F.col("times")).otherwise(F.lit(0))
    joined = joined.select("doc_id", "tag", "rows", "n_tokens", (F.col("n_known") + F.coalesce(more * (F.col("c") > 0).cast("long"), F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce(more * F.col("base"), F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce(more * F.col("lp"), F.lit(0.0))).alias("score"))
    total = joined.groupBy("doc_id", "tag").agg(*(F.sum(c).alias(c) for c in ("rows", "n_tokens", "n_known", "base_score", "score")))
    once = total.select("doc_id", *((F.col(c) / F.col("rows")).alias(c) for c in ("base_score", "score")), *(F.expr(f"{c} div rows").alias(c) for c in ("n_tokens", "n_known")), "rows")
    once = once.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return once.select("doc_id", F.coalesce(~trains, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
