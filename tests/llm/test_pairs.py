"""Near-duplicates, containment and repeats against brute force on planted cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import decontamination, near_dedup, queries, substring_dedup
from factloom.llm.textkernel import shingle_set


def text_of(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def edited(rng, words, rate):
    return [f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in words]


def without_repeats(documents):
    return queries.text_digests(substring_dedup.remove_repeats(documents))


@pytest.fixture(scope="module")
def corpus():
    """Unrelated texts, exact copies, a dense group of near copies at all distances, chains, a line that
    all share, short and empty texts, repeats, a doc_id with two texts and rows without one."""
    rng = random.Random(3)
    line = text_of(rng, 20)
    texts = [text_of(rng, rng.randrange(1, 200)) for _ in range(40)]
    base = text_of(rng, 150)
    texts += [edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06])) for _ in range(60)]
    chain = text_of(rng, 120)
    for _ in range(8):
        chain = chain[4:] + text_of(rng, 4)
        texts.append(chain)
    texts += [line + text_of(rng, 30) + line for _ in range(25)] + [line + text_of(rng, 3) for _ in range(15)]
    texts += [["a"], ["a"], ["A"], ["a", "b"], [], ["x"] * 50, ["x"] * 80]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    rows += [(500, rows[3][1].upper()), (501, rows[4][1].replace(" ", "\t\n")), (502, None), (502, None), (503, rows[3][1]), (503, rows[9][1]), (None, rows[3][1]), (None, None), (504, " ".join(base)), (504, " ".join(base))]
    return rows


def frame(spark, rows, **extra):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("value", "rep", "key", "a", "doc", "keep_id", "bad_id"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def expected_components(rows):
    """For each row the rows that links between any two texts reach."""
    sets = [shingle_set(t, 5) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, r in enumerate(sets[:k]):
            both = len(s & r)
            if both and 100 * both >= 75 * (len(s) + len(r) - both):
                a, b = sorted((find(k), find(j)))
                parent[b] = a
    return [find(k) for k in range(len(rows))]


def smallest_ids(rows):
    """component_id of each row."""
    found, least = expected_components(rows), {}
    for (i, _), c in zip(rows, found, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return [least[c] for c in found]


def test_near_duplicates(spark, corpus):
    got = near_dedup.near_duplicates(frame(spark, corpus)).collect()
    want = [(i, len(shingle_set(t, 5)), c, i is not None and i == c) for (i, t), c in zip(corpus, smallest_ids(corpus), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len({c for _, _, c, _ in want}) < len(want) - 30


def test_one_row_of_each_group_stays(spark, corpus, monkeypatch):
    """Also of rows without a doc_id, and under one doc_id every text that is like no other."""
    rng = random.Random(5)
    lone = [" ".join(text_of(rng, 40)) for _ in range(4)]
    rows = corpus + [(700, lone[0]), (700, lone[1]), (None, lone[2]), (None, lone[3]), (None, lone[3]), (None, lone[3].upper()), (701, lone[0] + " more")]
    for most in (10**6, 0):
        monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", most)
        df = frame(spark, rows)
        left = near_dedup.remove_near_duplicates(df)
        assert left.columns == df.columns
        kept = [(r.doc_id, r.text) for r in left.collect()]
        groups = {}
        for (i, t), c in zip(rows, expected_components(rows), strict=True):
            if shingle_set(t, 5):
                groups.setdefault(c, []).append((i, t))
        assert sum(not shingle_set(t, 5) for _, t in kept) == sum(not shingle_set(t, 5) for _, t in rows)
        worded = [k for k in kept if shingle_set(k[1], 5)]
        assert len(worded) == len(groups)
        for members in groups.values():
            (one,) = [k for k in worded if k in members]
            ids = [i for i, _ in members if i is not None]
            assert one[0] == (min(ids) if ids else None)


def test_heavy_documents(spark, corpus, monkeypatch):
    """Every open document heavy, in blocks of a few."""
    monkeypatch.setattr(near_dedup, "MOST_ROWS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "MOST_HUB_ROUNDS", 1)
    rng = random.Random(17)
    base = text_of(rng, 80)
    rows = corpus + [(800 + k, " ".join(edited(rng, base, rng.choice([0.03, 0.06, 0.09])))) for k in range(60)]
    asked = []
    found = near_dedup._heavy_links
    monkeypatch.setattr(near_dedup, "_heavy_links", lambda h, t: asked.append(h.count()) or found(h, t))
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    want = [(i, len(shingle_set(t, 5)), c, i is not None and i == c) for (i, t), c in zip(rows, smallest_ids(rows), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert asked[0] > 10


def test_a_family_is_not_compared_with_itself(spark, monkeypatch):
    """Two families of near copies below the threshold to each other, with the real constants: each is one component by
    its hubs, so what is searched afterwards gives few rows."""
    rng = random.Random(23)
    first = text_of(rng, 120)
    second = [w if k % 40 > 5 else f"other{k}" for k, w in enumerate(first)]
    families = [[" ".join(w if rng.random() > 0.004 else f"{w}{rng.random()}" for w in base) for _ in range(n)] for base, n in ((first, 600), (second, 550))]
    rows = [(f * 10_000 + k, t) for f, family in enumerate(families) for k, t in enumerate(family)]
    candidates = []
    links, heavy = near_dedup._links, near_dedup._heavy_links
    monkeypatch.setattr(near_dedup, "_links", lambda pairs, *a, **k: candidates.append(pairs.count()) or links(pairs, *a, **k))

    def counted(h, t):
        found = heavy(h, t)
        candidates.append(0 if found is None else found.count())
        return found

    monkeypatch.setattr(near_dedup, "_heavy_links", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert sum(candidates) < 20_000
    assert got == {i: c for (i, _), c in zip(rows, smallest_ids(rows), strict=True)}


def test_exact_search_finds_what_sketches_lose(spark, corpus, monkeypatch):
    """With sketches too short to find much, only the search over full sets is sure."""
    monkeypatch.setattr(near_dedup, "K", 2)
    monkeypatch.setattr(near_dedup, "LEAST", 2)
    monkeypatch.setattr(near_dedup, "EXACT", 0)
    want = sorted(str((i, c)) for (i, _), c in zip(corpus, smallest_ids(corpus), strict=True))
    got = sorted(str((r.doc_id, r.component_id)) for r in near_dedup.near_duplicates(frame(spark, corpus), exact=True).collect())
    assert got == want


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


def test_long_words_of_one_rhythm_are_told_apart(spark):
    """Words whose sums of powers of an odd base agree modulo 2 ** 64, whatever the base."""
    one, other = thue_morse(2048), thue_morse(2048, "b", "a")
    tail = [f"t{k}" for k in range(12)]
    rows = [(1, " ".join([one, *tail])), (2, " ".join([other, *tail])), (3, one), (4, other), (5, " ".join([one, *tail]))]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in without_repeats(frame(spark, rows)).collect())
    assert got == expected_repeats(rows) and [n for _, _, n, _ in got] == [0, 0, 0, 0, 13]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, [*rows, (6, f"{one} a b c d {other} a b c d")])).collect()}
    assert found == {1: (9, 1), 2: (9, 1), 3: (1, 3), 4: (1, 4), 5: (9, 1), 6: (6, 6)}


def test_very_long_texts(spark):
    rng = random.Random(29)
    base = text_of(rng, 60_000)
    rows = [(1, " ".join(base)), (2, " ".join(base[:30_000] + ["new"] * 50 + base[30_000:])), (3, " ".join(base[:20_000])), (4, "word " * 200_000)]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in without_repeats(frame(spark, rows)).collect())
    assert got == expected_repeats(rows)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_lose_no_pair_at_the_threshold():
    """Pairs at the threshold share more values than the search asks for."""
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        shared, own = rng.integers(0, 1 << 62, 600), rng.integers(0, 1 << 62, (2, 100))
        a, b = (np.unique(np.concatenate([shared, x]))[: near_dedup.K] for x in own)
        assert len(np.intersect1d(a, b)) >= near_dedup.LEAST


def test_containment(spark):
    rng = random.Random(8)
    items = [text_of(rng, n, 10**6) for n in (5, 8, 40, 41, 300, 3)] + [[], ["solo"]]
    benchmark = [(k, " ".join(t)) for k, t in enumerate(items)] + [(90, None), (91, " ".join(items[2]))]
    docs = []
    for k, item in enumerate(items):
        for rate in (0, 0.02, 0.05, 0.1, 0.5):
            docs.append(" ".join(text_of(rng, rng.choice([0, 30, 3000])) + edited(rng, item, rate) + text_of(rng, 50)))
    docs += [" ".join(items[5]), "solo", "SOLO", "", None, " ".join(items[2]).upper() + " " + " ".join(items[3])]
    rows = list(enumerate(docs)) + [(3, docs[0]), (None, docs[10])]
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.item_id, r.item_shingles, r.shared) for r in decontamination.contained_items(frame(spark, rows), spark.createDataFrame(benchmark, "item_id long, text string")).collect())
    want = []
    for i, t in rows:
        for k, q in benchmark:
            need, have = shingle_set(q, 5), shingle_set(t, 5)
            if need and len(need & have) >= 0.75 * len(need):
                want.append((-1 if i is None else i, k, len(need), len(need & have)))
    assert got == sorted(want) and len(want) > 20


def test_containment_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(text_of(rng, 20))) for k in range(12)]
    docs = [(k, t + " tail") for k, t in items] + [(99, None)]
    whole = lambda: sorted(map(tuple, decontamination.contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()))
    one = whole()
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 50)
    assert whole() == one and len(one) == 12


def test_clean_documents_stay(spark):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = [(1, "x one two three four five six y"), (2, "clean"), (None, "clean"), (3, None)]
    kept = decontamination.remove_contaminated(frame(spark, docs), items).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept) == [-1, 2, 3] and kept[0].rep == "clash"
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.remove_contaminated(frame(spark, docs), empty).count() == 4


def test_only_contaminated_rows_go(spark, monkeypatch):
    """A contaminated row takes no other row of its id along, null or repeated."""
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "a b c d e f g")], "item_id long, text string")
    docs = [(None, "x one two three four five six y"), (None, "clean"), (None, None), (None, ""), (1, "a b c d e f g"), (1, "other"), (2, None)]
    want = [(-1, ""), (-1, "-"), (-1, "clean"), (1, "other"), (2, "-")]
    left = lambda: sorted((-1 if r.doc_id is None else r.doc_id, "-" if r.text is None else r.text) for r in decontamination.remove_contaminated(frame(spark, docs), items).collect())
    assert left() == want
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 6)
    assert left() == want


def expected_repeats(rows, window=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(spark, corpus):
    rng = random.Random(11)
    passage = text_of(rng, 60)
    more = [(600 + k, " ".join(text_of(rng, rng.randrange(30)) + passage[rng.randrange(20) : rng.randrange(30, 60)] + text_of(rng, rng.randrange(30)))) for k in range(40)]
    more += [(700, "x " * 500), (701, "x " * 500 + "y"), (702, "p q " * 60), (703, "q p " * 60), (704, " ".join(passage)), (704, " ".join(passage)), (704, " ".join(passage[::-1])), (None, " ".join(passage))]
    rows = corpus + more
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in without_repeats(frame(spark, rows)).collect())
    assert got == expected_repeats(rows)


def test_repeats_leave_the_other_words(spark):
    passage = [f"p{i}" for i in range(20)]
    rows = [(1, " ".join(passage)), (2, " ".join(["Ä", *passage, "\tend"])), (2, None), (None, " ".join(passage)), (2**60 + 1, " ".join(passage[:13])), (3, "")]
    got = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1])
    want = [(1, " ".join(passage), 20, 0), (2, "Ä end", 22, 20), (2, "", 0, 0), (None, " ".join(passage), 20, 0), (2**60 + 1, "", 13, 13), (3, "", 0, 0)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repeats_of_nothing(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert without_repeats(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 2
