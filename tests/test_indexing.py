"""Ranks without one task for a group, sums at all levels, and sparse vectors."""

import math
import random
from collections import Counter

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.operators import embedding, linking
from factloom.plans.indexing import ranked
from factloom.sources import ontology


def test_ranks_equal_a_window(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("ab"), rng.randint(0, 50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, n int, i int").repartition(5)
    order = [F.desc("n"), F.asc("i")]
    expected = {(r.g, r.i): r.p for r in df.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy(*order))).collect()}
    got = ranked(df, ["g"], order, "p")
    assert got.columns == ["g", "n", "i", "p"]
    assert {(r.g, r.i): r.p for r in got.collect()} == expected
    assert ranked(df.limit(0), ["g"], order, "p").count() == 0


def test_many_misses_in_one_slot(spark):
    rows = spark.range(200_000).select(F.col("id").alias("fact_index"), F.lit("drug").alias("slot"), F.lit(0).alias("pos"), F.concat(F.lit("term "), (F.col("id") % 150_000).cast("string")).alias("text"), F.lit("unmatched").alias("match_type"))
    report = linking.unmatched_report(rows)
    assert report.agg(F.count("*"), F.max("place"), F.max("unique_terms"), F.max("total_terms")).first() == (150_000, 150_000, 150_000, 200_000)
    top = report.where("place <= 2").orderBy("place").collect()
    assert [(r.text, r.n) for r in top] == [("term 0", 2), ("term 1", 2)]


def vector(text, weights):
    import hashlib
    import re

    w = re.findall("[a-z0-9]+", text.lower())
    counts = Counter(hashlib.md5(t.encode()).hexdigest()[: embedding.DIGITS] for t in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))])
    return {p: n * weights[p] for p, n in counts.items()} if weights is not None else set(counts)


def test_sparse_cosines_equal_plain_ones(spark):
    rows = [(0, "sertraline", "TREATS", "MDD", "Sertraline treats MDD."), (1, "zoloft", "IMPROVES", "anxiety", None), (2, "", "", "", "x"), (3, None, "TREATS", "MDD", "The weather is fine"), (4, "a", "b_c", "d", "A b c d")]
    df = spark.createDataFrame(rows, "fact_index long, drug_name string, relation string, condition_name string, span string")
    claims = [" ".join([d or "", (r or "").replace("_", " ").lower(), c or ""]) for _, d, r, c, _ in rows]
    texts = [*claims, *((s or "") for *_, s in rows)]
    df_of = Counter(p for t in texts for p in vector(t, None))
    weights = {p: math.log((1 + len(texts)) / (1 + n)) + 1 for p, n in df_of.items()}
    for r in embedding.with_similarity(df).collect():
        a, b = vector(claims[r.fact_index], weights), vector(rows[r.fact_index][4] or "", weights)
        norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        expected = sum(a[p] * b.get(p, 0) for p in a) / norm if norm else 0.0
        assert math.isclose(r.cosine, expected, abs_tol=1e-9) and r.similarity.likely_correct == (expected > 0.5)
        assert r.similarity.quality_score == int(r.cosine * 100)


def test_all_levels_agree(spark):
    columns = "fact_index long, load_seq long, drug_name string, condition_name string, relation string, outcome string, side_effects array<string>, source_id string, section string"
    rows = [(i, 0, ["Zoloft", "odd"][i % 2], "MDD", "TREATS", None, [], f"p{i % 3}", None if i % 4 == 0 else "results") for i in range(24)]
    n = linking.normalise(spark.createDataFrame(rows, columns), linking.concept_keys(ontology.concepts(spark, ontology.EXAMPLE)))
    got = linking.match_rollup(n).collect()
    by_slot = {r.slot: (r.matched, r.total - r.matched, r.total) for r in got if r.level == 6}
    assert by_slot == {r.slot: (r.matched, r.unmatched, r.total) for r in linking.match_summary(n).collect()}
    (everything,) = [r for r in got if r.level == 7]
    for level in (0, 2, 3):
        assert (sum(r.matched for r in got if r.level == level), sum(r.total for r in got if r.level == level)) == (everything.matched, everything.total)
    assert sum(r.section is None for r in got if r.level == 0) > 0


def test_similarity_does_not_move_facts(spark):
    facts = spark.createDataFrame([(i, f"drug{i % 5}", "TREATS", "mdd", f"drug{i % 7} treats mdd") for i in range(50)], "fact_index long, drug_name string, relation string, condition_name string, span string")
    found = embedding.with_similarity(facts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    alike = {r.fact_index for r in found.where("cosine > 0.999999").collect()}
    assert alike == {i for i in range(50) if i % 5 == i % 7}
