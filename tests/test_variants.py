"""Facts of any types: what values mean, what the rules say of them, and what the graph keeps."""

import gzip
import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom import queries, vocab
from factloom.functions import variants
from factloom.operators import extraction, graph, graph_reads, linking, validation
from factloom.plans import fixture
from factloom.plans.workspace import sorted_groups, workspace
from factloom.sources import facts as fact_files
from factloom.sources import ontology

GOOD = {"drug_name": "sertraline", "condition_name": "major depressive disorder", "relation": "TREATS", "span": "Sertraline was an effective treatment of major depressive disorder.", "confidence": 0.9, "side_effects": [], "source_id": "p", "section": "results"}
SMALL = "/root/testdata/sf0.001"
VALUES = ["0.8", " 1_0 ", "high", "", "0", "[]", "1d", "nan", "-inf", "1e-3", 0, 1, 485.7, 1.0, -3, True, False, None, [], [1, "a"], {}, {"a": 1}]


def python_number(v):
    try:
        return float(v)
    except (ValueError, TypeError):
        return None


def python_whole(v):
    try:
        return int(v)
    except (ValueError, TypeError):
        return None


def test_values_mean_what_they_do_in_python(spark):
    df = spark.createDataFrame([(i, json.dumps({"x": v})) for i, v in enumerate(VALUES)], "i int, j string").select("i", variants.member(F.parse_json("j"), "x").alias("v"))
    rows = df.select("i", variants.truthy(F.col("v")).alias("t"), variants.number(F.col("v")).alias("n"), variants.whole_number(F.col("v")).alias("w"), variants.written(F.col("v")).alias("s"), variants.is_list(F.col("v")).alias("l"), variants.listed_texts(F.col("v")).alias("each")).collect()
    for r in rows:
        v = VALUES[r.i]
        assert r.t == bool(v) and r.l == isinstance(v, list), v
        assert str(r.n) == str(python_number(v)) and r.w == python_whole(v), v
        assert r.s == (v if isinstance(v, str) or v is None else json.dumps(v, separators=(",", ":")) if isinstance(v, list | dict) else str(v)), v
        assert r.each == ([str(x) for x in v] if isinstance(v, list) else [r.s] if v else []), v


def test_a_missing_key_is_not_a_null(spark):
    row = spark.createDataFrame([('{"a": null}',)], "j string").select(F.parse_json("j").alias("v")).select(variants.written(variants.member("v", "a"), "gone").alias("a"), variants.written(variants.member("v", "b"), "gone").alias("b")).first()
    assert (row.a, row.b) == (None, "gone")


def read(spark, tmp_path, *changes, wrapper=None):
    rows = [{k: v for k, v in {**GOOD, **c}.items() if v != "missing"} for c in changes]
    (tmp_path / "facts.json").write_text(json.dumps({"triples": "no list", wrapper: rows} if wrapper else rows))
    return fact_files.read_facts(spark, str(tmp_path / "facts.json"))


@pytest.mark.parametrize(
    ("change", "valid", "types"),
    [
        ({"confidence": "0.8"}, True, []),
        ({"confidence": "high"}, False, ["invalid_confidence_type"]),
        ({"confidence": [0.5]}, False, ["invalid_confidence_type"]),
        ({"confidence": True}, True, []),
        ({"confidence": "0"}, True, []),
        ({"confidence": 0}, False, ["missing_required_field"]),
        ({"confidence": ""}, False, ["invalid_confidence_type", "missing_required_field"]),
        ({"confidence": "missing"}, False, ["missing_confidence", "missing_required_field"]),
        ({"confidence": None}, False, ["missing_confidence", "missing_required_field"]),
        ({"side_effects": "nausea"}, True, ["invalid_side_effects_type"]),
        ({"side_effects": {"nausea": 1}}, True, ["invalid_side_effects_type"]),
        ({"side_effects": None}, True, ["invalid_side_effects_type"]),
        ({"side_effects": "missing"}, True, []),
        ({"side_effects": ["nausea", 7]}, True, ["unknown_side_effect"]),
        ({"drug_name": "missing"}, False, ["missing_required_field"]),
        ({"drug_name": None}, False, ["drug_not_in_span", "missing_required_field", "placeholder_drug_name"]),
        ({"drug_name": 0}, False, ["drug_not_in_span", "missing_required_field", "unknown_drug"]),
        ({"effect_size": False}, True, []),
        ({"effect_size": 0.4}, True, []),
        ({"effect_size": ["large"]}, True, ["vague_effect_size"]),
    ],
)
def test_rules_see_the_written_type(spark, tmp_path, change, valid, types):
    (row,) = validation.validate(read(spark, tmp_path, change, wrapper="validated_facts")).collect()
    assert (row.is_valid, sorted(i.issue_type for i in row.issues)) == (valid, types)


def test_code_of_the_rules_is_short_enough_to_be_compiled(spark, tmp_path):
    """The JVM interprets methods of more than 8,000 bytes for ever."""
    stages = validation.validate(read(spark, tmp_path, {}))._jdf.queryExecution().debug().codegenToSeq()
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) <= 8000


@pytest.mark.parametrize(("value", "missing"), [("0", False), (0, True), (0.0, True), (False, True), ("False", False), ([], True), ("[]", False), ({}, True), ("{}", False), ([0], False), ({"a": 0}, False), ("", True), (" ", True), (None, True), ("missing", True), ("true", False), (True, False)])
def test_what_is_missing_is_told_by_how_it_was_written(spark, tmp_path, value, missing):
    row = validation.validate(read(spark, tmp_path, dict.fromkeys(validation.REQUIRED, value))).first()
    assert {i.field for i in row.issues if i.issue_type == "missing_required_field"} == (set(validation.REQUIRED) if missing else set())


def test_fields_mean_what_their_values_do(spark):
    rows = [(json.dumps({"x": v}),) for v in [*VALUES, "true", "False", "0.80", "-1.50", "1e5", 1e20, 10**20, 0.8, 1.5e-7, "12_", "007", "[1]", [None, 0, {"b": 1.0}]]] + [("{}",)]
    df = spark.createDataFrame(rows, "j string").select("j", F.parse_json("j").alias("raw")).withColumn("fields", variants.texts(F.col("raw")))
    f, v = variants.Field("raw", "fields", "x"), variants.member("raw", "x")
    pairs = [(f.written(), variants.written(v)), (f.written("gone"), variants.written(v, "gone")), (f.number(), variants.number(v)), (f.whole_number().try_cast("int"), variants.whole_number(v).try_cast("int")), (f.listed_texts(), variants.listed_texts(v))]
    assert df.select("j", *(a.alias(f"a{i}") for i, (a, _) in enumerate(pairs)), *(b.alias(f"b{i}") for i, (_, b) in enumerate(pairs))).where(" OR ".join(f"NOT a{i} <=> b{i}" for i in range(len(pairs)))).collect() == []


def test_listing_tasks_do_not_grow_with_the_folders(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"file={i}").mkdir()
        (tmp_path / f"file={i}" / "a.json").write_text(json.dumps([GOOD]))
    tracker, before = spark.sparkContext.statusTracker(), spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None)
    seen = set(tracker.getJobIdsForGroup(None))
    assert fact_files.read_facts(spark, f"{tmp_path}/file=*").count() == 60
    jobs = sorted(set(tracker.getJobIdsForGroup(None)) - seen)
    assert tracker.getStageInfo(tracker.getJobInfo(jobs[0]).stageIds[0]).numTasks <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None) == before


def test_values_survive_the_reading(spark, tmp_path):
    rows = read(spark, tmp_path, {"confidence": "0.8", "side_effects": "nausea", "sample_size": 485.7}, {"sample_size": "485"}, {"sample_size": "485.7", "p_value": "0.05"}, {"dose": 20, "arm": "open", "null": None}).orderBy("fact_index").collect()
    assert (rows[0].confidence, rows[0].side_effects, rows[0].sample_size) == (0.8, ["nausea"], 485)
    assert rows[1].sample_size == 485 and rows[2].sample_size is None and rows[2].p_value == 0.05
    assert rows[3].dose == "20" and rows[3].extra == {"arm": "open"}
    assert [r.fact_index for r in rows] == [0, 1, 2, 3]


def test_cleaning_speaks_of_cleaned_facts(spark, tmp_path):
    cleaned = extraction.clean_facts(read(spark, tmp_path, {"sample_size": 485.7, "side_effects": ["nausea", "side effects"]}, {"sample_size": 0}))
    rows = validation.validate(cleaned).orderBy("fact_index").collect()
    assert "raw_fact" not in cleaned.columns and [r.sample_size for r in rows] == [485, None]
    assert [i.issue_type for i in rows[0].issues] == []


def test_facts_are_written_as_they_were(spark, tmp_path):
    loose = [{"confidence": "0.8", "arm": "open", "sample_size": 485.7}, {"side_effects": "nausea"}]
    fact_files.write_extracted(read(spark, tmp_path, *loose), str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("source_id=p/*.json")
    assert json.loads(file.read_text())["extracted_facts"] == [{**GOOD, **c} for c in loose]


def test_unknown_fields_become_properties_of_the_graph(spark, tmp_path):
    facts = read(spark, tmp_path, {"arm": "open", "sample_size": "485.7"}, {"condition_name": "generalized anxiety disorder", "sample_size": "485"})
    normalised = linking.normalise(facts, linking.concept_keys(ontology.concepts(spark, ontology.EXAMPLE)))
    store = graph.GraphStore(spark, str(tmp_path / "graph"))
    store.load(normalised, clear=True)
    found = {(r.kind, r.name, r.property) for r in graph_reads.schema_properties(store.table("nodes"), store.table("edges")).collect()}
    assert ("relation", "TREATS", "arm") in found and ("relation", "TREATS", "sample_size") in found and ("relation", "TREATS", "outcome") not in found
    assert sorted(r.sample_size or 0 for r in store.table("edges").collect()) == [0, 485]
    assert set(r.rel_type for r in store.table("edges").collect()) <= set(vocab.RELATIONS)


def bytes_on_disk(spark, kind):
    return sum(f.stat().st_size for d in Path(workspace(spark)).glob(f"{kind}-*") for f in d.rglob("*") if f.is_file())


@pytest.mark.parametrize(("query", "kind"), [("fact_files", "fact-files"), ("mixed_fact_files", "mixed-files")])
def test_written_facts_take_little_of_the_disk(spark, query, kind):
    """The files are a fraction of the facts' texts."""
    text = sum(len(r.fact) for r in fixture.mixed_facts(spark, SMALL).collect())
    before = bytes_on_disk(spark, kind)
    back = queries.QUERIES[query](spark, SMALL)
    assert 0 < bytes_on_disk(spark, kind) - before < text / 8
    assert back.groupBy("file").count().where("count <> 500").count() == 0


def test_a_files_facts_are_together_before_they_have_texts(spark):
    with sorted_groups(spark):
        lists = fixture.facts(spark, SMALL, by_file=True).groupBy(fixture.file_number().alias("file")).agg(F.collect_list("span")).sortWithinPartitions("file")
        plan = lists._jdf.queryExecution().executedPlan().toString().split("\n")
    made = next(i for i, line in enumerate(plan) if "CASE WHEN" in line)
    assert not [line for line in plan[:made] if "Exchange" in line or re.search(r"\bSort \[", line)] and any("Exchange" in line for line in plan[made:])


def test_compressed_files_hold_the_same_facts(spark, tmp_path):
    loose = [{"confidence": "0.8", "arm": "open"}, {"side_effects": "nausea"}]
    fact_files.write_wrapped(read(spark, tmp_path, *loose), str(tmp_path / "out"), "extracted_facts", compression="gzip")
    (file,) = (tmp_path / "out").glob("source_id=p/*.json.gz")
    assert json.loads(gzip.decompress(file.read_bytes())) == {"extracted_facts": [{**GOOD, **c} for c in loose], "total_facts": 2}
    assert [r.confidence for r in fact_files.read_facts(spark, f"{tmp_path}/out/source_id=*").orderBy("fact_index").collect()] == [0.8, 0.9]
