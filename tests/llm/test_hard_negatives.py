"""Hard negatives against plain loops: ties, repeated rows, nulls, blocks, lanes and large numbers."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import hard_negatives
from factloom.llm.hard_negatives import labelled, mine

SCHEMA = "vec_id long, embedding array<double>, label int, score string, lane string"


def plain(rows, positives=5, negatives=3):
    import math

    usable = [(i, label, [math.floor(x * 256) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, label, v) in enumerate(usable):
        if i % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=False)), j, other) for b, (j, other, w) in enumerate(usable) if b != a), key=lambda s: s[:2])
        for s, j, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(-t, k) for t, k, other in scored if other != label and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(i, j, r, k, -s, t) for r, (t, k) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def found(spark, rows, parts=5):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(parts)
    got = mine(labelled(df, F.col("vec_id") % 50 == 0, scale=256))
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("tile", [64, 1 << 21])
def test_equals_plain_loops(spark, monkeypatch, tile):
    monkeypatch.setattr(hard_negatives, "TILE", tile)
    rng = random.Random(5)
    rows = [(i, [rng.randint(-6, 6) / 16 for _ in range(4)], rng.choice([0, 0, 0, 1, 2])) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.5], i % 2) for i in range(60)]  # one common vector: ties everywhere
    rows += [rows[50], rows[100], (100, [0.1, 0.2, 0.3, 0.4], 0), (150, [0.25], 1), (200, [], 1)]
    rows += [(None, [0.5] * 4, 0), (5000, None, 0), (5050, [0.5] * 4, None), (5100, [0.5, None, 0.5, 0.5], 0), (5150, [0.5, float("nan"), 0.5, 0.5], 0), (5200, [float("inf")] * 4, 0)]
    expected = plain(rows)
    assert len(expected) > 50
    assert found(spark, rows) == expected


def test_lanes_and_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LANE_VALUES", 21)
    rng = random.Random(6)
    rows = [(i * 10, [rng.random() for _ in range(3)], rng.randint(0, 1)) for i in range(120)]
    assert found(spark, rows, parts=40) == plain(rows)


def test_sums_above_the_exact_floats(spark):
    rows = [(0, [2.0**22, 3.0], 0), (1, [2.0**21 + 0.5, 1.0], 0), (2, [1.5 * 2.0**20 + 1 / 256, 1.0], 1), (3, [1.5 * 2.0**20, 1.25], 1)]
    assert found(spark, rows) == plain(rows) != []


def test_of_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [0.5], 0), (2, [0.5], 1)]) == []  # no anchor
    assert found(spark, [(50, [0.5], 0), (2, [0.5], 1)]) == []  # no positive
    assert found(spark, [(50, [0.5], 0), (2, [0.5], 0)]) == []  # no negative
