"""The pipeline stage by stage against plain versions, and on tables that hold nothing or odd rows."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from factloom.llm import sharding, toxicity
from factloom.llm.common import fold
from factloom.llm.textkernel import shingle_set
from test_others import labelled, plain_packing, plain_terms
from test_pairs import edited, expected_components, text_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, size string, copies string"
ITEM = "benchmark item of ten words that nobody else has written"


def rows_of(rng):
    base = text_of(rng, 60)
    rows = [(i, t, f"s{i % 4}") for i, (_, t, _) in enumerate(labelled(rng, 200))]
    rows += [(300 + i, " ".join(edited(rng, base, 0.01)), "s1") for i in range(8)] + [(320, " ".join(base), None), (320, "another text under this id", "s2"), (None, " ".join(base).upper(), "s3")]
    rows += [(400, f"before {ITEM} after", "s1"), (None, f"{ITEM}", "s1"), (None, "clean and without an id", "s1"), (None, None, None), (401, "", "s2"), (402, "idiot scum idiot here", "s0")]
    rows += [(403, "long " * 30_000 + "end", "s0"), (404, "one row twice", "s2"), (404, "one row twice", "s2")]
    return rows


def written(spark, path, rows, items, labels):
    spark.createDataFrame([(i, t, "en", s, None, "clash", "clash", "clash") for i, t, s in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_equal_plain_ones(spark, tmp_path):
    rng = random.Random(51)
    rows = rows_of(rng)
    labels = [(i, 1, int(any(w in t for w in ("idiot", "scum", "lowei")))) for i, t, _ in rows[:200]]
    docs = written(spark, tmp_path, rows, [(1, ITEM), (2, None)], labels)
    stage = dict(cp.STAGES)
    run = lambda name, df: stage[name](spark, df, str(tmp_path)).cache()

    machine = toxicity.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), learns=fold("doc_id") != 0)
    v, want = machine.factors.astype(float), Counter()
    for i, t, _ in rows:
        at = plain_terms(t)
        logit = machine.bias + machine.linear[at].astype(float).sum() + (np.linalg.norm(v[at].sum(axis=0)) ** 2 - (v[at] ** 2).sum()) / 2 / max(1, len(at))
        want[(i, t)] += logit < 0
    clean = run("toxicity", docs)
    assert pairs(clean) == +want and (402, rows[-4][1]) not in pairs(clean)

    one = run("near_dedup", clean)
    left = [(r.doc_id, r.text) for r in clean.collect()]
    groups = {}
    for (i, t), c in zip(left, expected_components(left), strict=True):
        if shingle_set(t, 5):
            groups.setdefault(c, []).append((i is None, i or 0, t))
    empties = Counter(x for x in left if not shingle_set(x[1], 5))
    assert Counter(i for i, _ in pairs(one).elements()) == Counter(None if m[0] else m[1] for m in map(min, groups.values())) + Counter(i for i, _ in empties.elements())

    kept = run("decontamination", one)
    item = shingle_set(ITEM, 5)
    assert pairs(kept) == Counter({k: n for k, n in pairs(one).items() if len(shingle_set(k[1], 5) & item) < 0.75 * len(item)})

    mixed = run("mixing", kept)
    size, got = Counter(), Counter()
    for r in kept.collect():
        size[r.source] += len((r.text or "").split())
    for r in mixed.collect():
        got[r.source] += len((r.text or "").split())
    order = [*sorted(s for s in size if s is not None), *([None] if None in size else [])]
    weight, target, open_, budget = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, set(order), 1.5 * sum(size.values())
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        target |= {s: 2 * size[s] if s in over else share[s] for s in over or open_}
        budget -= sum(2 * size[s] for s in over)
        open_ = open_ - over if over else set()
    longest = {s: max(len((r.text or "").split()) for r in kept.where(F.col("source").eqNullSafe(s)).collect()) for s in order}
    assert all(abs(got[s] - target[s]) <= longest[s] / 2 + 1 for s in order)
    times = {k: n / pairs(kept)[k] for k, n in pairs(mixed).items()}
    assert all(n <= 2 for k, n in times.items() if k[1]) and all(times[k] == 1 for k in pairs(kept) if not k[1])

    shards = run("sharding", mixed)
    filled, texts = Counter(), Counter()
    for r in shards.collect():
        filled[r.shard] += r["size"]
    for r in mixed.collect():
        texts[r.text or ""] += len((r.text or "").encode()) + 1
    step = lambda s: 1 << max(0, s.bit_length() - sharding.EXACT_BITS)
    assert sum(filled.values()) == sum(texts.values())
    assert all(a <= b <= a + 64 for a, b in zip(sorted(filled.values()), plain_packing([-(-s // step(s)) * step(s) for s in texts.values()], 16), strict=True))
    for df in (clean, one, kept, mixed):
        assert df.columns == docs.columns


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_pipeline_of_nothing(spark, tmp_path, rows):
    written(spark, tmp_path, rows, [], [])
    assert cp.run(spark, str(tmp_path)).count() == len(rows)
