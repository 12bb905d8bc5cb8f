"""Cleaning, validation and quality of facts: every rule's branch."""

import re

import pytest
from pyspark.sql import functions as F

from factloom import schemas
from factloom.functions import text as text_functions
from factloom.operators import extraction, quality, validation
from factloom.plans import fixture

GOOD = {"drug_name": "sertraline", "condition_name": "major depressive disorder", "relation": "TREATS", "span": "Sertraline was an effective treatment of major depressive disorder.", "confidence": 0.9, "side_effects": [], "source_id": "p", "section": "results"}


def facts(spark, *changes):
    rows = [{**{n: None for n in schemas.FACT.names}, **GOOD, **c} for c in changes]
    df = spark.createDataFrame([tuple(r[n] for n in schemas.FACT.names) for r in rows], schemas.FACT).coalesce(1)
    return df.withColumn("fact_index", F.monotonically_increasing_id())


def issue_types(spark, profile="default", **change):
    (row,) = validation.validate(facts(spark, change), profile).select("is_valid", "issues").collect()
    return row.is_valid, sorted(i.issue_type for i in row.issues)


@pytest.mark.parametrize(
    ("change", "valid", "types"),
    [
        ({}, True, []),
        ({"confidence": 0.0}, False, ["missing_required_field"]),
        ({"confidence": None}, False, ["missing_confidence", "missing_required_field"]),
        ({"confidence": 1.2}, False, ["invalid_confidence_range"]),
        ({"confidence": float("nan")}, False, ["invalid_confidence_range"]),
        ({"drug_name": None}, False, ["drug_not_in_span", "missing_required_field", "placeholder_drug_name"]),
        ({"drug_name": " N/A "}, False, ["drug_not_in_span", "placeholder_drug_name"]),
        ({"drug_name": "treatment"}, False, ["generic_drug_name"]),
        ({"drug_name": "selective agent"}, True, ["drug_not_in_span"]),
        ({"drug_name": "novel agent"}, True, ["drug_not_in_span", "unknown_drug"]),
        ({"drug_name": "sertraline " * 10}, True, ["drug_name_too_long"]),
        ({"condition_name": "symptom remission"}, False, ["condition_not_in_span", "outcome_as_condition"]),
        ({"condition_name": "insomnia"}, False, ["condition_not_in_span", "symptom_as_condition"]),
        ({"condition_name": "drug abuse"}, False, ["condition_not_in_span", "invalid_condition_name"]),
        ({"condition_name": "treatment-resistant depression"}, False, ["condition_not_in_span", "invalid_condition_name"]),
        ({"condition_name": "severe major depressive disorder"}, True, ["condition_name_variant"]),
        ({"condition_name": "zzzz"}, True, ["condition_not_in_span", "unknown_condition"]),
        ({"condition_name": " "}, False, ["missing_required_field"]),
        ({"relation": "treats"}, True, []),
        ({"relation": "cures"}, False, ["invalid_relation"]),
        ({"side_effects": None}, True, ["invalid_side_effects_type"]),
        ({"side_effects": ["Nausea ", "odd", "odd"]}, True, ["unknown_side_effect", "unknown_side_effect"]),
        ({"effect_size": "large"}, True, ["vague_effect_size"]),
        ({"effect_size": "Cohen's d"}, True, []),
        ({"effect_size": "42%"}, True, []),
    ],
)
def test_validation_rules(spark, change, valid, types):
    assert issue_types(spark, **change) == (valid, types)


def test_strict_profile(spark):
    assert "wrong_comparison_direction" in issue_types(spark, "strict", relation="SUPERIOR_TO", span="Sertraline was less effective in major depressive disorder.")[1]
    assert "missing_equivalence_language" in issue_types(spark, "strict", relation="EQUIVALENT_TO")[1]
    assert "incomplete_span" in issue_types(spark, "strict", span="It helped sertraline users.")[1]
    assert "very_short_span" in issue_types(spark, "strict", span="sertraline helps")[1]
    assert issue_types(spark, "strict", drug_name="imipramine")[0] is False


def test_report_and_types(spark):
    checked = validation.validate(facts(spark, {}, {"relation": "cures"}, {"drug_name": "novel agent"}))
    (r,) = validation.validation_report(checked).collect()
    assert (r.total_facts, r.valid_facts, r.invalid_facts, r.warnings) == (3, 2, 1, 1)
    by = {x.issue_type: (x.n_issues, x.n_facts, x.samples) for x in validation.issues_by_type(validation.issues(checked)).collect()}
    assert by == {"invalid_relation": (1, 1, [1]), "drug_not_in_span": (1, 1, [2]), "unknown_drug": (1, 1, [2])}


def test_cleaning(spark):
    kept = extraction.clean_facts(
        facts(
            spark,
            {"condition_name": "MDD", "side_effects": ["nausea", "Side effects", "", "x" * 101], "sample_size": 100_001, "treatment_line": " First "},
            {"span": "No such drug."},
            {"drug_name": " "},
            {"span": "It showed that sertraline treats."},
            {"condition_name": "gout", "span": "sertraline and placebo"},
            {"condition_name": "gout", "span": "sertraline and placebo", "relation": "associated_with_se"},
            {"confidence": 1.2},
        )
    ).collect()
    assert [(r.fact_index, r.condition_name, r.side_effects) for r in kept] == [(0, "major depressive disorder", ["nausea"]), (5, "gout", [])]
    assert (kept[0].sample_size, kept[0].treatment_line) == (None, "first")


def test_sample_sizes(spark):
    df = spark.createDataFrame([("485",), ("485.7",), ("x",), ("0",), (None,)], "s string").select(extraction.sample_size("s"))
    assert [r[0] for r in df.collect()][0] == 485 and [r[0] for r in df.collect()][2:] == [None, None, None]


def test_dictionary_extractor(spark):
    parts = spark.createDataFrame([("p", "Results", "Sertraline treats MDD well in this long enough section of text. Nothing here."), ("p", "References", "Sertraline MDD " * 10)], "source_id string, name string, text string")
    found = extraction.extract(parts, extraction.DictionaryExtractor(["sertraline"], ["MDD"])).collect()
    assert [(r.drug_name, r.condition_name, r.section, r.side_effects, r.outcome) for r in found] == [("sertraline", "MDD", "Results", [], None)]


@pytest.mark.parametrize(
    ("change", "score", "correct"),
    [
        ({}, 100, True),
        ({"drug_name": "imipramine"}, 70, True),
        ({"drug_name": "imipramine", "condition_name": "gouty pains"}, 60, False),
        ({"relation": "SUPERIOR_TO"}, 80, True),
        ({"confidence": 0.5}, 85, True),
        ({"span": "sertraline disorder", "relation": "AUGMENTS"}, 90, True),
        ({"condition_name": "drug care", "drug_name": "zzz", "relation": "IMPROVES", "span": "no", "confidence": 0.1}, 0, False),
    ],
)
def test_heuristic(spark, change, score, correct):
    (r,) = facts(spark, change).select(quality.heuristic().alias("r")).select("r.*").collect()
    assert (r.quality_score, r.likely_correct) == (score, correct)


def test_combination_and_gate(spark):
    df = quality.assess(facts(spark, {"condition_name": "depression", "span": "no", "confidence": 0.1, "source_id": "a"}, {"source_id": "b"}))
    rows = df.orderBy("fact_index").collect()
    assert rows[0].likely_correct is False and rows[0].quality_score == (15 + 90) / 2  # a tie is no majority
    assert rows[1].quality_score == 100
    gates = {r.source_id: (r.status, r.total_facts) for r in quality.gate(df, 0.7, min_score=60).collect()}
    assert gates == {"a": ("QUALITY_GATE_FAILED", 0), "b": ("SUCCESS", 1)}
    (none,) = facts(spark, {}).transform(lambda d: quality.assess(d, {"judge": quality.no_judgement()})).collect()
    assert none.quality_score is None and none.likely_correct is None


def test_similarity_and_sample(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([1.0, 0.0], [-1.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<double>, b array<double>")
    got = [tuple(r) for r in df.select(quality.similarity("a", "b").alias("r")).select("r.*").collect()]
    assert got == [(70.0, True), (-70.0, False), (0.0, False), (None, None)]
    picked = facts(spark, *[{}] * 20)
    assert quality.sample(picked, 7, seed=1).count() == 7 and quality.sample(picked, 7, seed=1).collect() == quality.sample(picked, 7, seed=1).collect()


def test_judges(spark):
    import pandas as pd

    def judge(frames):
        for f in frames:
            yield pd.DataFrame({"fact_index": f.fact_index[:1], "confidence": 0.876, "likely_correct": True})

    got = quality.judged(facts(spark, {}, {}).coalesce(1), judge).orderBy("fact_index").select("llm_judge.*").collect()
    assert [tuple(r) for r in got] == [(87.0, True), (None, None)]


def test_any_of_finds_what_each_part_finds(spark):
    parts = ["care", "standard care", "vs.", "a-b", "^c", "comparison", "comparator", "c d"]
    texts = ["", "scare", "compar", "comparators", "vs", "vs.", "xa-b", "axb", "^c", "c  d", "c d", "co\nmparison"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t for r in df.where(text_functions.contains_any("t", parts)).collect()}
    assert got == {t for t in texts if any(p in t for p in parts)}
    assert re.findall("standard", text_functions.any_of(parts)) == []


def test_words_at_any_white_space(spark):
    df = spark.createDataFrame([(" one two three\n\nfour x ",)], "t string")
    assert df.select(text_functions.words("t", 1)).first()[0] == ["one", "two", "three", "four"]
    assert df.select(text_functions.blank(F.lit("  \t")), text_functions.blank(F.lit("")), text_functions.blank("t")).first()[:] == (True, True, False)


def test_cleaning_makes_the_facts_columns_once(spark):
    """A filter on the rules took what makes a span to each place where a rule looks at it."""
    plan = extraction.clean_facts(fixture.facts(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("It showed benefit.") == 1


def test_known_names_are_looked_up_and_mean_what_a_search_finds(spark):
    from factloom import vocab
    from factloom.functions.text import contains_any
    from factloom.operators.validation import _holds_any

    names = [*vocab.VALID_CONDITIONS, *vocab.CONDITION_EXCLUSIONS, *(f"severe {c}" for c in vocab.VALID_CONDITIONS), *(f"{c} remission" for c in vocab.VALID_CONDITIONS[:5]), "", "none", "chronic migraine"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    lists = {"outcome": vocab.OUTCOME_WORDS, "excluded": vocab.CONDITION_EXCLUSIONS, "valid": vocab.VALID_CONDITIONS, "none": ["zzz"]}
    both = rows.select("name", *(_holds_any(rows["name"], p, vocab.VALID_CONDITIONS).alias(f"{k}_got") for k, p in lists.items()), *(contains_any("name", p).alias(f"{k}_want") for k, p in lists.items()))
    for r in both.collect():
        for k, parts in lists.items():
            assert r[f"{k}_got"] == r[f"{k}_want"] == any(p in r["name"] for p in parts), (r["name"], k)
