"""Sharding, mixing, tokens, search, toxicity, personal data and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import mixing, pii, queries, sharding, textkernel, token_store, topk_search, toxicity
from factloom.llm.common import components, fold


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).withColumn("size", F.lit("clash")).withColumn("shard", F.lit("clash"))


def personal_data(documents):
    return queries.span_digests(pii.find_personal_data(documents))


def stored_documents(store):
    return queries.id_digests(token_store.read_documents(store))


# --- components ---


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 51), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 51: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- sharding ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 9)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.integers(60, 150))
def test_best_fit_decreasing_equals_the_plain_one(histogram, capacity):
    runs, bins = sharding.best_fit_decreasing(histogram, capacity)
    rooms: list[int] = []
    for size in sorted((s for s, n in histogram for _ in range(n)), reverse=True):
        fit = [r for r in rooms if r >= size]
        if fit:
            rooms[rooms.index(min(fit))] -= size
        else:
            rooms.append(capacity - size)
    filled = defaultdict(int)
    for size, b, n in runs:
        filled[b] += size * n
    assert bins == len(rooms) and sorted(filled.values()) == sorted(capacity - r for r in rooms)
    assert Counter({s: n for s, n in histogram}) == sum((Counter({s: n}) for s, _, n in runs), Counter())


def test_tree_stays_sorted():
    rng, tree, plain = random.Random(1), sharding.RemainingTree(), []
    for i in range(5000):
        if rng.random() < 0.6 or not plain:
            key = (rng.randrange(1000), i)
            tree.add(key)
            plain.append(key)
        else:
            need = rng.randrange(1000)
            want = min((k for k in plain if k >= (need, -1)), default=None)
            assert tree.pop_tightest(need) == want
            if want:
                plain.remove(want)


def test_shards(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(200))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:50] + [None, "", None])] + [(0, texts[0]), (None, "x")]
    got = sharding.shard_documents(frame(spark, rows), 16).collect()
    assert len(got) == len(rows)
    bytes_, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        bytes_[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[(r.text_crc32, r["size"])].add(r.shard)
    assert max(bytes_.values()) - min(bytes_.values()) < 0.02 * max(bytes_.values()) and len(bytes_) == 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)


def test_rounded_sizes(spark):
    sizes = [1, 2, 3, 16383, 16384, 16385, 16387, 32768, 32769, 10**6 + 1, 2**40 + 1, 2**46 - 1]
    got = [r.r for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.rounded("s").alias("r")).collect()]
    for s, r in zip(sizes, got, strict=True):
        step = 1 << max(0, s.bit_length() - sharding.EXACT_BITS)
        assert r == -(-s // step) * step and r <= s * 1.0002


def plain_packing(sizes, shards):
    """Every group by itself: groups above the fair share alone, then the least capacity whose best-fit-decreasing
    packing, bin by bin, needs no more bins."""
    sizes = sorted(sizes, reverse=True)
    alone = []
    while sizes and len(alone) < shards - 1 and sizes[0] * (shards - len(alone)) > sum(sizes):
        alone.append(sizes.pop(0))

    def fill(capacity):
        rooms = []
        for s in sizes:
            fit = [r for r in rooms if r >= s]
            if fit:
                rooms[rooms.index(min(fit))] -= s
            elif s > capacity:
                return None
            else:
                rooms.append(capacity - s)
        return [capacity - r for r in rooms] if len(rooms) <= shards - len(alone) else None

    capacity = -(-sum(sizes) // (shards - len(alone))) if sizes else 0
    while fill(capacity) is None:
        capacity += 1
    return sorted(alone + fill(capacity))


def test_whole_query_equals_plain_packing(spark, monkeypatch):
    """Shard sizes of documents with copies, very long texts, nulls and rows without ids, with hot groups and numberings split."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    rng = random.Random(14)
    rows = [(rng.choice([None, i]), "y" * rng.choice([0, 3, rng.randrange(400)])) for i in range(500)] + [(600, "z" * 300_000), (601, None), (602, "é" * 9000), (602, "é" * 9000)]
    got = sharding.shard_documents(frame(spark, rows), 16).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    step = lambda s: 1 << max(0, s.bit_length() - sharding.EXACT_BITS)
    want = plain_packing([-(-s // step(s)) * step(s) for s in groups.values()], 16)
    assert sum(sizes.values()) == sum(groups.values())
    assert all(a <= b <= a + 64 for a, b in zip(sorted(sizes.values()), want, strict=True))


def test_oversized_group_gets_its_own_shard(spark):
    rows = [(i, "z" * 999) for i in range(50)] + [(100 + i, f"text {i}") for i in range(200)]
    got = sharding.shard_documents(frame(spark, rows), 16).collect()
    big = {r.shard for r in got if r.doc_id < 100}
    assert len(big) == 1 and not big & {r.shard for r in got if r.doc_id >= 100}
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    rest = [v for k, v in sizes.items() if k not in big]
    assert len(rest) == 15 and max(rest) <= sum(rest) / 15 + 9  # the least capacity: no shard is over the mean by a document
    assert sharding.shard_documents(frame(spark, []), 16).count() == 0


# --- mixing ---


def test_mix(spark):
    rng = random.Random(6)
    names = ["a", "b", "ä", "Z", "tiny", None]
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(40))), names[i % 5] if i % 7 else None) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "empty"), (5, rows[5][1], rows[5][2]), (None, "x y", "b")]
    df = frame(spark, rows, "doc_id long, text string, source string").drop("size")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=str)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").encode().split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] if s in over else share[s] for s in (over or open_)}
        left -= sum(2 * size[s] for s in over)
        open_ = open_ - over if over else set()
    source = {(i, len((t or "").encode().split())): s for i, t, s in rows}
    taken = Counter()
    for r in got:
        s = source[(r.doc_id, r["size"])]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 2 for s in order)


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    """Also hot ones, null among them, and very long texts."""
    rows = [(i, "w " * (1 + i % 5), None if i % 3 == 0 else f"s{i % 40}") for i in range(400)] + [(999, "long " * 100_000, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    for parts in (1000, 3):
        monkeypatch.setattr("factloom.llm.common.HOT_PARTS", parts)
        assert sorted(map(str, mixing.mix(df).collect())) == want


def test_repeated_rows(spark):
    rows = [(i, "one two three", "s") for i in range(100)] + [(200, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit(1))
    for n, more in ((1, []), (3, [(None, "one two three", "t")] * 40 + [(5, "x y", "t")] * 41)):
        df2 = spark.createDataFrame(rows + more, "doc_id long, text string, source string").repartition(n)
        mixed = mixing.repeat_rows(df2)
        words = Counter()
        for r in mixed.collect():
            words[r.source] += len((r.text or "").split())
        target = {r.source_size: r.target for r in mixing.mix(df2).where("size > 0").collect()}
        for s in {r[2] for r in rows + more}:
            own = sum(len((t or "").split()) for _, t, x in rows + more if x == s)
            assert abs(words[s] - target[own]) <= 1.5
    out = mixing.repeat_rows(df)
    assert out.columns == df.columns
    n = Counter(r.doc_id for r in out.collect())
    assert n.pop(200) == 1 and sum(n.values()) == 150 and max(n.values()) <= 2
    assert mixing.repeat_rows(df.limit(0)).count() == 0


# --- tokens ---


@pytest.fixture(scope="module")
def tokenizer_path():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab é's tmdrelv19٣½\n\t .!?$　日本’ x", max_size=30), max_size=4))
def test_pieces_equal_the_library(tokenizer_path, texts):
    from tokenizers import Tokenizer

    global _pair
    try:
        plain, own = _pair
    except NameError:
        plain, own = _pair = Tokenizer.from_file(tokenizer_path), token_store.Encoder(tokenizer_path)
    ids, bounds = own.encode([*texts, "<|endoftext|> don't"])
    want = [plain.encode(t, add_special_tokens=False).ids for t in [*texts, "<|endoftext|> don't"]]
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want


def test_long_pieces_of_one_rhythm_are_told_apart(tokenizer_path):
    from tokenizers import Tokenizer

    beat = [bin(k).count("1") % 2 for k in range(2048)]
    texts = ["".join("ab"[b] for b in beat), "".join("ba"[b] for b in beat), "a" * 16, "a" * 17, "a" * 16 + "b"]
    plain, own = Tokenizer.from_file(tokenizer_path), token_store.Encoder(tokenizer_path)
    for _ in range(2):
        ids, bounds = own.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_keys_are_the_words_themselves():
    w = next(textkernel.words(pa.array(["a a\x00 abcdefghijklmnop abcdefghijklmnopq abcdefghijklmnopr a"]), lower=False))
    size, low, high = w.keys()
    keys = list(zip(size.tolist(), low.tolist(), high.tolist(), strict=True))
    assert len(set(keys)) == 5 and keys[0] == keys[5] == (1, 97, 0)
    assert low[2:3].tobytes() + high[2:3].tobytes() == b"abcdefghijklmnop"
    assert len(set(w.hashes().tolist())) == len(set(w.hashes(kind=1).tolist())) == 5
    assert w.hashes(3)[2] == w.hashes(3)[3] != w.hashes(3)[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=300))
def test_boundaries(lengths):
    ends = np.cumsum(lengths)
    code = token_store.Boundaries(len(ends), *token_store.Boundaries.encode(ends))
    assert code.all().tolist() == ends.tolist() == [code.select(i) for i in range(len(ends))]
    with pytest.raises(IndexError):
        code.select(len(ends))


def test_boundaries_are_near_minimal():
    ends = np.cumsum(np.random.default_rng(0).integers(100, 900, 10_000))
    _, low, high = token_store.Boundaries.encode(ends)
    assert (len(low) + len(high)) * 8 < 10_000 * (2 + np.log2(ends[-1] / 10_000) + 0.5) < 10_000 * 64 / 4


@pytest.mark.parametrize("part_bytes", [1 << 20, 700])
def test_store_round_trip(spark, tokenizer_path, monkeypatch, part_bytes):
    """Rows without a doc_id come last; a doc_id with several texts has all of them."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "PART_BYTES", part_bytes)
    plain = Tokenizer.from_file(tokenizer_path)
    rng = random.Random(7)
    rows = [(i * 3, "".join(rng.choice("abc dé\n'") for _ in range(rng.randrange(80)))) for i in range(120)] + [(1, None), (2, "long " * 2000), (5000, ""), (None, "lost"), (None, None), (-4, "first")]
    rows += [(9, "one"), (9, "two"), (9, "one")] + [(77, "equal rows")] * 60 + [(None, "x")] * 40
    store = token_store.write_store(frame(spark, rows).repartition(5), tokenizer_path, block_ids=50)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in stored_documents(store).collect()]
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want and store.count() > 10
    assert (store.select("part").distinct().count() > 8) == (part_bytes < 1000)
    assert stored_documents(token_store.write_store(frame(spark, []), tokenizer_path)).count() == 0


# --- search ---


@pytest.mark.parametrize("width", [1, 3, 16])
def test_top_k(spark, monkeypatch, width):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 64)
    monkeypatch.setattr(topk_search, "SEED_ROWS", 10)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(width)
    x = np.round(rng.normal(size=(400, width)), 1 if width > 1 else 0)
    x[50:90] = x[49]  # one vector that many rows have
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [float("nan")] * width), (1100, [None] * width), (1150, [float("inf")] * width)]
    vectors = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)), 256)
    got = sorted(map(tuple, topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()))
    q = np.floor(x * 256).astype(int)
    want = []
    for i in range(0, 400, 50):
        s = q @ q[i]
        best = sorted((j for j in range(400) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, r + 1, j, int(s[j])) for r, j in enumerate(best)]
    assert got == sorted(want)


def test_repeated_queries_are_all_searched(spark, monkeypatch):
    """Rows that repeat a vec_id, with equal and with other vectors, against every row but the query's own."""
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (120, 4)).astype(float)
    ids = [i % 60 for i in range(120)]  # every id twice
    x[110] = x[50]  # id 50: two equal rows
    rows = [(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(0, x[0].tolist()), (0, x[0].tolist())]
    vectors = topk_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 256)
    q = np.array([[256 * int(c) for c in v] for _, v in rows])
    want = []
    for n, (i, _) in enumerate(rows):
        if i % 50 == 0:
            s = q @ q[n]
            best = sorted((j for j in range(len(rows)) if j != n), key=lambda j: (-s[j], rows[j][0]))[:5]
            want += [(i, r + 1, rows[j][0], int(s[j])) for r, j in enumerate(best)]
    for block in (4096, 2):
        monkeypatch.setattr(topk_search, "QUERY_BLOCK", block)
        got = topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few(spark):
    vectors = topk_search.quantised(spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (2, [0.0])], "vec_id long, embedding array<double>"), 256)
    assert [tuple(r) for r in topk_search.top_k(vectors, vectors.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(0, 1, 2, 0), (0, 2, 1, -65536)]
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0), 5).count() == 0


# --- toxicity ---


def labelled(rng, n):
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.3
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "loweiXY", "loweiAB"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_the_sample_is_not_copied_several_times_by_the_fit():
    import tracemalloc

    n, rows = 4_000_000, 4_000
    index = np.arange(n, dtype=np.int32) % 1000
    bounds = np.arange(rows + 1) * (n // rows)
    tracemalloc.start()
    toxicity.fit(bounds, index, np.zeros(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * index.nbytes + (32 << 20)  # what is kept, the marks, and the model of fixed size


def test_the_sample_is_put_in_order_whatever_its_chunks():
    parts = [pa.table({"doc_id": pa.array(ids, pa.int64()), "toxic": pa.array(y, pa.int32()), "terms": pa.array(t, pa.list_(pa.int32()))}) for ids, y, t in (([5, 1], [1, 0], [[7, 8], []]), ([3], [1], [[9]]))]
    parts.append(pa.table({c: parts[0].column(c).slice(0, 1) for c in ("doc_id", "toxic", "terms")}).set_column(0, "doc_id", pa.array([0], pa.int64())))
    bounds, index, y = toxicity._in_order(pa.concat_tables(parts))
    assert (bounds.tolist(), index.tolist(), y.tolist()) == ([0, 2, 2, 3, 5], [7, 8, 9, 7, 8], [1, 0, 1, 1])
    bounds, index, y = toxicity._in_order(parts[0].slice(0, 0))
    assert (bounds.tolist(), index.tolist(), y.tolist()) == ([0], [], [])


def test_held_out_accuracy(spark):
    rows = labelled(random.Random(9), 900)
    documents = frame(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5000, None)])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5001, None)], "doc_id long, toxic int")
    machine = toxicity.learn(documents, labels, learns=fold("doc_id") != 0)
    got = {r.doc_id: r.score for r in toxicity.score(documents, machine).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean(held) > 0.95
    assert got[5000] == got[5001] < 0.5 and all(0 <= s <= 1 for s in got.values())
    kept = toxicity.reject_toxic(documents, labels, learns=fold("doc_id") != 0)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5} and kept.columns == documents.columns


def test_pairs_are_learnt():
    """Toxic only where two terms meet: additive weights cannot tell, factors can."""
    rng = random.Random(3)
    texts, labels = [], []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["alpha"] * a + ["beta"] * b + [f"n{rng.randrange(3)}"]) or "x")
        labels.append(float(a == b))
    bounds, index = np.zeros(1, np.int64), []
    for _, b, i in toxicity.terms(pa.array(texts)):
        index.append(i)
        bounds = np.concatenate([bounds, b[1:] + bounds[-1]])
    machine = toxicity.fit(bounds, np.concatenate(index), np.array(labels))
    right = (toxicity.logits(machine, bounds, np.concatenate(index)) >= 0) == np.array(labels, bool)
    assert right.mean() > 0.95


def plain_terms(text):
    """Distinct places of a text's lower-cased words and prefixes, one text and one word at a time."""
    out = set()
    for word in re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
        raw = word.encode()
        w = next(textkernel.words(pa.array([word]), lower=True, separators=textkernel.NOT_ALPHANUMERIC))
        out.add(int(w.hashes()[0] >> np.uint64(64 - toxicity.BITS)))
        out |= {int(textkernel.mix64(w.hashes(k) + np.uint64(k))[0] >> np.uint64(64 - toxicity.BITS)) for k in toxicity.PREFIXES if len(raw) > k}
    return sorted(out)


def test_scores_equal_the_sum_over_all_pairs(spark):
    """The query's scores against the formula itself, pair by pair."""
    rng = random.Random(31)
    rows = labelled(rng, 200)
    very_long = " ".join(f"w{rng.randrange(300)}" for _ in range(20_000)) + " scum"
    more = [(900, None), (901, ""), (902, "Été! 日本 scum, (SCUM)"), (903, very_long), (None, "idiot w1"), (904, "...")]
    documents = frame(spark, [(i, t) for i, t, _ in rows] + more)
    machine = toxicity.learn(documents, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), learns=fold("doc_id") != 0)
    got = Counter((r.doc_id, round(r.score, 5)) for r in toxicity.score(documents, machine).collect())
    v, want = machine.factors.astype(float), Counter()
    for i, t in [(i, t) for i, t, _ in rows[:60]] + more:
        at = plain_terms(t)
        pairs = sum(float(v[a] @ v[b]) for k, a in enumerate(at) for b in at[:k]) if len(at) < 900 else (np.linalg.norm(v[at].sum(axis=0)) ** 2 - (v[at] ** 2).sum()) / 2
        logit = machine.bias + float(machine.linear[at].astype(float).sum()) + pairs / max(1, len(at))
        want[(i, round(1 / (1 + np.exp(-logit)), 5))] += 1
    assert not want - got


def test_repeated_labelled_ids_teach_one_text(spark, monkeypatch):
    """The sample is bounded in rows, and the fit does not depend on their order."""
    rows = [(1, f"word{i} scum") for i in range(50)] + [(i, f"fine words number{i}") for i in range(2, 40)]
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)] + [(i, 0) for i in range(2, 40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda bounds, index, y, seed=7: seen.append((bounds.tolist(), index.tolist(), y.tolist())))
    for part in (1, 7):
        toxicity.learn(frame(spark, rows).repartition(part), labels, learns=F.lit(True))
    assert seen[0] == seen[1] and len(seen[0][2]) == 39 and sum(seen[0][2]) == 1


def test_without_labels(spark):
    documents = frame(spark, [(1, "a b"), (2, None)])
    machine = toxicity.learn(documents, spark.createDataFrame([], "doc_id long, toxic int"), learns=fold("doc_id") != 0)
    assert all(r.score < 0.5 for r in toxicity.score(documents, machine).collect())
    assert toxicity.score(documents.limit(0), machine).count() == 0


# --- personal data ---

FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    spans = sorted((m.start(), k, m.end()) for k, (kind, form) in enumerate(FORMS.items()) for m in form.finditer(text or "") if valid(kind, m.group(0)))
    return ",".join(f"{list(FORMS)[k]}:{a}:{b}" for a, k, b in spans), [sum(x[1] == k for x in spans) for k in range(4)]


def test_base_spans(spark):
    rng = random.Random(12)
    texts = ["a@b.c@d.e_x@f.gg.h", "é 日 x.y+z%@mail-1.example.com.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 010-9999 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", None, "", "7" * 60_000, "a" * 60_000 + "@", "1." * 20_000, "+1" + "(" * 20_000, "5 " * 20_000]
    texts += ["".join(rng.choice("a.@-+ 0123 45(é") for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789 -") for _ in range(60)) for _ in range(100)]
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = personal_data(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        written, n = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n), texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(1)
    fill = lambda: " ".join(f"word{'abc'[rng.randrange(3)]}" for _ in range(6))
    rows = [(i, f"{fill()} hotline: +1 555 010 {1000 + i} the {10 + i} {fill()}") for i in range(30)]
    rows += [(100 + i, f"{fill()} the +1 555 020 {2000 + i} {fill()} version {i}.0") for i in range(5)]
    rows += [(200, f"{fill()} Hotline: 0800-CALL-42. {fill()} version 7.1 the 99"), (201, None)]
    got = {r.doc_id: r for r in personal_data(frame(spark, rows)).collect()}
    text = rows[-2][1]
    at = text.index("0800-CALL-42")
    assert got[200].spans == f"phone:{at}:{at + 12}" and got[200].n_phone == 0
    assert sum(r.n_found for r in got.values()) == 1  # "the" and "version" are no patterns


def test_patterns_without_seeds_are_reached_in_two_hops(spark, monkeypatch):
    """"helpdesk:" precedes discovered identifiers only; it is scored by what "hotline:" found."""
    rows = [(i, f"word hotline: +1 555 010 {1000 + i} word") for i in range(30)]
    rows += [(100 + i, f"word hotline: 0800-CALL-{i} word") for i in (42, 43)]
    rows += [(200 + i, f"word helpdesk: 0800-CALL-{i} word") for i in (42, 43, 44)]
    rows += [(300 + i, f"word version 7.{i} word") for i in range(5)]
    found = lambda: {r.doc_id: r.spans for r in personal_data(frame(spark, rows)).where("n_found > 0").collect()}
    want = {100 + i: "phone:14:26" for i in (42, 43)} | {200 + i: "phone:15:27" for i in (42, 43, 44)}
    assert found() == want
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", 0)
    assert found() == want


def test_context_words_may_hold_digits(spark):
    """"Line2:" is a pattern, and so is a word that is an identifier itself."""
    rows = [(i, f"word Line{i % 10}: +1 555 010 {1000 + i} word") for i in range(30)]
    rows += [(100, "word line7: 0800-CALL-42 word"), (101, "7 " + "x" * 60_000 + " b 5 " + "7" * 60_000 + " b 5")]
    got = {r.doc_id: r.spans for r in personal_data(frame(spark, rows)).where("n_found > 0").collect()}
    assert got == {100: "phone:12:24"}


def plain_extraction(texts):
    """spans of every text by dictionaries and loops: tokens, their patterns, the graph and its rounds."""
    kinds = pii.FOUND_KINDS
    tokens, bases, everywhere = [], [], Counter()
    for n, text in enumerate(texts):
        text = text or ""
        found = sorted((m.start(), k, m.end(), m.group()) for k, (kind, form) in enumerate(FORMS.items()) for m in form.finditer(text) if valid(kind, m.group(0)))
        bases.append(found)
        plain = [re.sub("[0-9]", "9", w.lower()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        everywhere.update(plain)
        everywhere.update(f"{a} {b}" for a, b in zip(plain, plain[1:], strict=False))
        everywhere.update(f"{a} {pii.GAP} {b}" for a, b in zip(plain, plain[2:], strict=False))
        words = [(m.start(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        idents = [i for i, (_, w) in enumerate(words) if re.search("[0-9@]", w)]
        for i in idents:
            at, w = words[i]
            label = (re.match(r"([A-Za-z][A-Za-z_.-]*[=:])(?=.)", w) or re.match("()", w)).group(1)
            body = w[len(label) :]
            lead = re.match(r"[\W_]*", body.replace("+", "x").replace("@", "x")).end()
            value = re.sub(r"[\W_]+$", "", body[lead:])
            if not value:
                continue
            low = [re.sub("[0-9]", "9", x.lower()) for _, x in words]
            patterns = [low[i - 1]] if i else []
            # The word before an identifier that touches another one is not read, see identifiers().
            if i > 1 and (i - 1 not in idents):
                patterns.append(f"{low[i - 2]} {low[i - 1]}")
            if i and i + 1 < len(words):
                patterns.append(f"{low[i - 1]} {pii.GAP} {low[i + 1]}")
            if label:
                patterns = [re.sub("[0-9]", "9", label.lower())]
            start = at + len(label) + lead
            over = [b for b in found if b[0] < start + len(value) and b[2] > start]
            if over and over[0][0] < start:
                continue
            seed = over[0][1] if over else 4 if re.fullmatch("[0-9a-fA-F]{32,}", value) and re.search("[0-9]", value) and re.search("[a-fA-F]", value) else None
            tokens.append((n, start, start + len(value), over[0][3] if over else value, patterns, bool(label), seed))
    edges, before, labelled = defaultdict(dict), Counter(), set()
    for _, _, _, value, patterns, own, seed in tokens:
        for p in patterns:
            edges[p][value] = max((x for x in (edges[p].get(value), seed) if x is not None), default=None)
            before[p] += 1
            labelled |= {p} if own else set()
    graph = {p: v for p, v in edges.items() if len(v) >= pii.SUPPORT and before[p] >= pii.SPECIFIC * (before[p] if p in labelled else everywhere[p])}
    seeds = {}
    for v in graph.values():
        for value, seed in v.items():
            if seed is not None:
                seeds[value] = (1.0, max(seed, seeds.get(value, (0, seed))[1]))
    trust, confident = dict(seeds), {}
    for _ in range(pii.ROUNDS):
        confident = {}
        for p, v in graph.items():
            held = Counter()
            for value in v:
                if value in trust:
                    held[trust[value][1]] += trust[value][0]
            if held:
                kind = min(held, key=lambda k: (-held[k], k))
                if held[kind] / len(v) >= pii.PRECISION:
                    confident[p] = (held[kind] / len(v), kind)
        doubt = defaultdict(lambda: 1.0)
        for p, (c, kind) in confident.items():
            for value in graph[p]:
                doubt[(value, kind)] *= 1.0001 - c
        trust = dict(seeds)
        for (value, kind), d in doubt.items():
            if value not in seeds and (value not in trust or (max(1 - d, 0), -kind) > (trust[value][0], -trust[value][1])):
                trust[value] = (max(1 - d, 0), kind)
    out = [{(a, k, b) for a, k, b, _ in found} for found in bases]
    for n, start, end, _, patterns, _, seed in tokens:
        known = [confident[p] for p in patterns if p in confident]
        if known and (seed is None or seed == 4):
            best = min(known, key=lambda x: (-x[0], x[1]))
            out[n].add((start, best[1], end))
    return [",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(x)) for x in out]


def test_pattern_graph_equals_the_plain_one(spark):
    rng = random.Random(40)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    things = [lambda: f"{rng.choice('abc')}{rng.randrange(9)}@mail.example.com", lambda: ".".join(str(rng.randrange(260)) for _ in range(4)), lambda: f"+1 (555) 010-{rng.randrange(10**4):04}", lambda: '"' + hexes(rng.choice([40, 12])) + '"###', lambda: f"0800-{rng.randrange(20)}", lambda: f"v{rng.randrange(3)}.0", lambda: f"id={rng.randrange(50)}", lambda: f"ref:{hexes(36)}", lambda: f"ref:{rng.randrange(9)}", lambda: "4111 1111 1111 1111", lambda: "(1) 2,"]
    leads = ["call", "Line2:", "token =", "the", "reach me at", "id", "Mail"]
    texts = []
    for k in range(260):
        words = []
        for _ in range(rng.randrange(1, 9)):
            lead = rng.randrange(len(leads))
            thing = things[(lead + rng.choice([0, 0, 0, 1, 5])) % len(things)]()
            words += [rng.choice(["alpha", "beta", "x"])] * rng.randrange(2) + [leads[lead]] * (rng.random() < 0.9) + [thing] + ["now"] * (rng.random() < 0.5)
        texts.append(rng.choice([" ", "  ", "\n"]).join(words))
    texts += [None, "", "é 日 call 0800-1 日", "\x01 7 \x01 8"]
    got = {r.doc_id: r for r in personal_data(frame(spark, list(enumerate(texts)))).collect()}
    want = plain_extraction(texts)
    for k, w in enumerate(want):
        assert got[k].spans == w, (texts[k], got[k].spans, w)
        assert got[k].n_spans == len(w.split(",")) * bool(w) and got[k].n_found == got[k].n_spans - len(base(texts[k])[0].split(",")) * bool(base(texts[k])[0])
    assert sum(r.n_found for r in got.values()) > 100


def test_secrets_are_found_by_their_pattern_only(spark):
    rows = [(i, f'word token = "{i:040x}" word'.replace("0000", "a1b2")) for i in range(20)] + [(50, "commit " + "ab12" * 10), (51, 'word token = "9f-x7"')]
    got = {r.doc_id: r.spans for r in personal_data(frame(spark, rows)).where("n_found > 0").collect()}
    assert got == {i: "secret:14:54" for i in range(20)} | {51: "secret:14:19"}


def test_personal_data_grows_with_the_text_only(spark):
    """Twice the identifiers in one text take about twice the time."""
    import time

    def took(n):
        began = time.perf_counter()
        (r,) = personal_data(spark.createDataFrame([(1, "call a@b.cd x7 " * n)], "doc_id long, text string")).collect()
        assert r.n_email == n
        return time.perf_counter() - began

    took(100)
    one, four = took(12_500), took(50_000)
    assert four < 4 * one + 10


def test_personal_data_of_nothing(spark):
    assert personal_data(frame(spark, [])).count() == 0


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(21)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, (_, t, _) in enumerate(labelled(rng, 300))]
    item = " ".join(f"q{i}" for i in range(30))
    rows += [(900, f"before {item} after", "en", "s1", 0), (901, rows[0][1], "en", "s2", 0), (902, None, None, None, None), (903, "idiot scum idiot here and there", "en", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, int(bool(re.search("idiot|scum|lowei", t or "")))) for i, t, *_ in rows[:300]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        counts.append((name, docs.count(), set(docs.select("doc_id").distinct().toPandas().doc_id)))
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = dict((n, ids) for n, _, ids in counts)
    assert 903 not in left["toxicity"] and {900, 902} <= left["toxicity"]
    assert left["near_dedup"] <= left["toxicity"] and not {0, 901} <= left["near_dedup"]
    assert left["decontamination"] == left["near_dedup"] - {900}
    assert left["mixing"] <= left["decontamination"] and left["sharding"] == left["mixing"]
    assert sorted(r.shard for r in docs.select("shard").distinct().collect()) == list(range(16))
    assert cp.run(spark, str(tmp_path)).count() == counts[-1][1]
