"""Linking and the graph."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import graph, graph_reads, linking, reports
from factloom.plans import evidence, fixture
from factloom.plans.indexing import ordinal
from factloom.sources import facts as fact_files
from factloom.sources import ontology
from factloom.operators.extraction import DictionaryExtractor

COLUMNS = "fact_index long, load_seq long, drug_name string, condition_name string, relation string, outcome string, side_effects array<string>, span string, confidence double, source_id string, section string, sample_size string, p_value double"


def facts(spark, *rows):
    made = [(i, r.get("load", 0), r.get("drug", "Zoloft"), r.get("condition", "MDD"), r.get("relation", "TREATS"), r.get("outcome"), r.get("side", []), r.get("span", f"s{i}"), r.get("confidence", 0.9), "p", "results", r.get("n"), None) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, COLUMNS)


def keys(spark):
    return linking.concept_keys(ontology.concepts(spark, ontology.EXAMPLE))


def test_index_order(spark):
    got = {(r.entity_type, r.key): (r.concept_id, r.match_type) for r in keys(spark).collect()}
    assert got[("outcomes", "functional improvement")] == ("DEMO:O3", "exact")  # a label before a synonym
    assert got[("drugs", "zoloft")] == ("DEMO:D1", "synonym")  # the first synonym stays


def test_fuzzy_equals_the_standard_library(spark):
    rng = random.Random(5)
    known = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(3, 9))).strip() or "a" for _ in range(60)})
    asked = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(3, 9))).strip() or "b" for _ in range(80)} - set(known))
    concepts = spark.createDataFrame([("e", i, f"id{i}", k, "x", [], {}) for i, k in enumerate(known)], "entity_type string, concept_seq int, concept_id string, label string, provider string, synonyms array<string>, metadata map<string,string>")
    index = linking.concept_keys(concepts).where("key <> ''")
    names = [r.key for r in index.collect()]
    misses = spark.createDataFrame([("e", a) for a in asked], "entity_type string, key string")
    got = {r.key: (r.known, r.score) for r in linking.link_fuzzy(misses, index, cutoff=0.7).collect()}
    want = {}
    for a in asked:
        if near := difflib.get_close_matches(a, names, n=1, cutoff=0.7):
            want[a] = (near[0], difflib.SequenceMatcher(None, a, near[0]).ratio())
    assert got == want and want


def test_normalise_and_summary(spark):
    n = linking.normalise(facts(spark, {"drug": "fluoxetin", "outcome": "Remission", "side": ["nausea", "odd"]}, {"drug": "", "relation": "FIRST_LINE_FOR"}), keys(spark))
    a, b = n.orderBy("fact_index").collect()
    assert (a.drug.match_type, a.drug.concept_id) == ("fuzzy", "DEMO:D3")
    assert [m.match_type for m in a.side_effect_matches] == ["exact", "unmatched"]
    assert b.drug.match_type == "unmatched" and b.drug.score == 0 and b.outcome_match is None and b.side_effect_matches == []
    got = {r.slot: (r.matched, r.unmatched) for r in linking.match_summary(n).collect()}
    assert got == {"drug": (1, 1), "condition": (2, 0), "relation": (1, 1), "outcome": (2, 0), "side_effects": (1, 1)}
    assert linking.drug_coverage(n).first()[0] == 0.5


def test_unmatched_report(spark):
    linked = linking.linked_slots(facts(spark, {"drug": "b"}, {"drug": "a"}, {"drug": "a"}, {"drug": "c"}), keys(spark))
    got = [(r.text, r.n, r.unique_terms, r.total_terms) for r in linking.unmatched_report(linked).where("slot = 'drug'").orderBy("place").collect()]
    assert got == [("a", 2, 3, 4), ("b", 1, 3, 4), ("c", 1, 3, 4)]


def normalised(spark, *rows):
    return linking.normalise(facts(spark, *rows), keys(spark))


def test_upserts(spark):
    n = normalised(spark, {"drug": "Sertraline", "span": "old", "n": "12"}, {"drug": "zoloft", "span": "new", "load": 1}, {"drug": "Zoloft", "span": "newest", "load": 1, "n": "1.5"})
    (node,) = graph.nodes(n).where("label = 'Drug'").collect()
    assert (node.id, node.name) == ("drug_DEMO_D1", "zoloft")  # first fact of the last load
    (edge,) = graph.edges(graph.edge_evidence(n)).collect()
    assert (edge.evidence, edge.sample_size) == ("newest", None)  # last fact of the last load, nulls and all
    assert graph.edge_evidence(n).count() == 3
    (dup,) = graph_reads.duplicates(graph.edge_evidence(n)).collect()
    assert dup.n == 3


def test_edges_need_both_ends(spark):
    n = normalised(spark, {"relation": "IMPROVES"}, {"relation": "IMPROVES", "outcome": "remission rate"}, {"relation": "treats"}, {"drug": ""}, {"drug": "TCAs"}, {"drug": "antidepressant"}, {"drug": "mystery"})
    edges = graph.edges(graph.edge_evidence(n)).collect()
    assert {(e.src_id, e.dst_id) for e in edges} == {("drug_DEMO_D1", "outcome_DEMO_O2"), ("drug_DEMO_D4", "condition_DEMO_C1"), ("drug_unmatched_" + __import__("hashlib").md5(b"mystery").hexdigest()[:8], "condition_DEMO_C1")}
    counters = {(r.counter, r.name): r.n for r in graph.load_counters(n, graph.edge_evidence(n)).collect()}
    assert counters[("relations", "TREATS")] == 3 and counters[("nodes", "Drug")] == 3
    assert graph.side_effect_edges(normalised(spark, {"relation": "ASSOCIATED_WITH_SE", "side": ["nausea"]})).first().dst_id == "side_effect_DEMO_S1"


def test_reads(spark):
    n = normalised(spark, {"drug": "Zoloft", "relation": "ASSOCIATED_WITH_SE"}, {"drug": "Prozac", "relation": "ASSOCIATED_WITH_SE", "confidence": 0.5}, {"drug": "Prozac"})
    nodes, edges, _ = evidence.graph_tables(n)
    (shared,) = graph_reads.shared_targets(edges, nodes, "Zoloft", "Prozac").collect()
    assert (shared.target, shared.first_reports, shared.second_reports) == ("MDD", 1, 1)
    assert [r.drug_id for r in graph_reads.low_confidence(edges).collect()] == ["drug_DEMO_D3"]
    assert [(r.name, r.connections) for r in graph_reads.top_connected_drugs(edges, nodes).collect()] == [("Prozac", 2), ("Zoloft", 1)]
    keys_ = {(r.name, r.property) for r in graph_reads.schema_properties(nodes, edges).collect()}
    assert ("Drug", "name") in keys_ and ("TREATS", "p_value") not in keys_


def test_stream_of_winners(spark, tmp_path):
    """Late files, files that come twice, a stream that goes on where it stopped, and a batch that is written again."""
    from factloom.streaming.upsert import WinnerSink, follow_winners, winners

    n = normalised(spark, *[{"drug": f"d{i % 5}", "span": f"s{i}", "load": (i * 7) % 11} for i in range(40)])
    sink = WinnerSink(spark, str(tmp_path / "graph"))
    for part in ("load_seq >= 6", "load_seq < 4", "load_seq >= 3"):
        n.where(part).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(n.schema).parquet(str(tmp_path / "in"))
        for q in follow_winners(stream, sink, str(tmp_path / "checkpoint")):
            q.awaitTermination()
    expected = graph.edge_evidence(n)
    key = lambda df: sorted((r.src_id, r.rel_type, r.dst_id, r.load_seq, r.fact_index, r.evidence) for r in df.collect())
    assert key(sink.edges()) == key(graph.edges(expected))
    assert sorted(map(str, sink.nodes().collect())) == sorted(map(str, graph.nodes(n).select(sink.nodes().columns).collect()))
    first = spark.read.parquet(str(tmp_path / "graph" / "edges" / "batch=0"))
    winners(graph.edge_evidence(n.where("load_seq >= 6")), "edges").write.mode("overwrite").parquet(str(tmp_path / "graph" / "edges" / "batch=0"))
    assert key(sink.edges()) == key(graph.edges(expected)) and first is not None


def test_store_versions(spark, tmp_path, monkeypatch):
    """A reader keeps its version, a load that dies leaves the old graph, a small load writes little, and segments merge."""
    store = graph.GraphStore(spark, str(tmp_path / "store"))
    many = normalised(spark, *[{"drug": f"d{i}", "condition": f"c{i % 7}", "load": i} for i in range(60)])
    store.load(many)
    one = store.manifest()
    edges_then = store.table("edges", one)
    store.load(normalised(spark, {"drug": "d3", "condition": "c3", "load": 3, "relation": "AUGMENTS"}))
    assert edges_then.count() == 60 and {r.rel_type for r in edges_then.collect()} == {"TREATS"}
    now = {(r.rel_type, r.load_seq) for r in store.table("edges").collect()}
    assert ("AUGMENTS", 3) in now and ("TREATS", 3) not in now and len(now) == 60
    delta = store.manifest()["segments"]["edges"][-1]
    assert spark.read.parquet(str(tmp_path / "store" / "edges" / f"segment={delta}")).count() == 2  # the new edge, and the one that is gone
    assert store.table("nodes").count() == 67
    store.load(normalised(spark, {"drug": "other", "load": 3}))  # nothing names drug d3 any more
    assert "d3" not in {r.name for r in store.table("nodes").collect()}
    before = sorted(map(str, store.table("edges").collect()))

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(graph.GraphStore, "_commit", dies)
        with pytest.raises(RuntimeError):
            store.load(normalised(spark, {"drug": "never", "load": 99}))
    assert sorted(map(str, store.table("edges").collect())) == before
    monkeypatch.setattr(graph, "MOST_SEGMENTS", 3)
    store.load(normalised(spark, {"drug": "last", "load": 60}))
    assert {len(x) for x in store.manifest()["segments"].values()} == {1}
    whole = normalised(spark, *[{"drug": "other" if i == 3 else "last" if i == 60 else f"d{i}", **({} if i in (3, 60) else {"condition": f"c{i % 7}"}), "load": i} for i in range(61)])
    expected = graph.edges(graph.edge_evidence(whole))
    key = lambda df: sorted((r.src_id, r.rel_type, r.dst_id, r.load_seq) for r in df.collect())
    assert key(store.table("edges")) == key(expected)


def test_store_and_stream(spark, tmp_path):
    from factloom.streaming.upsert import GraphSink, follow

    n = normalised(spark, {"span": "a"}, {"span": "b", "load": 1})
    store = graph.GraphStore(spark, str(tmp_path / "store"))
    store.load(n.where("load_seq = 1"), clear=True)
    store.load(n.where("load_seq = 0"))
    store.register()
    assert spark.sql("SELECT evidence FROM edges").first()[0] == "b"
    for _ in range(2):  # a load that is there already is replaced
        store.load(n.where("load_seq = 0").withColumn("span", F.lit("c")))
    assert sorted(r.evidence for r in store.table("edge_evidence").collect()) == ["b", "c"]
    store.load(n.where("load_seq = 1").withColumn("span", F.lit("d")))
    assert [r.evidence for r in store.table("edges").collect()] == ["d"] and store.table("mentions").count() == 4
    n.where("load_seq = 1").write.parquet(str(tmp_path / "in"))
    n.where("load_seq = 0").write.mode("append").parquet(str(tmp_path / "in"))
    sink = GraphSink(spark, str(tmp_path / "graph"))
    stream = spark.readStream.schema(n.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follow(stream, sink, str(tmp_path / "checkpoint")).awaitTermination()
    assert [r.evidence for r in sink.edges().collect()] == ["b"] and sink.nodes().count() == 2


def test_papers_end_to_end(spark):
    body = "Sertraline was an effective treatment of major depressive disorder in this trial."
    docs = spark.createDataFrame([("a", f"# Results\n{body}"), ("b", "# Results\nNothing to be found in this one, however long it may be."), ("c", f"# Discussion\n{body}")], "source_id string, markdown string")
    stages = evidence.process_papers(docs, DictionaryExtractor(["sertraline"], ["major depressive disorder"]), ontology.concepts(spark, ontology.EXAMPLE))
    runs = {r.source_id: (r.status, r.extracted, r.valid, r.normalised) for r in stages.runs.collect()}
    assert runs == {"a": ("SUCCESS", 1, 1, 1), "b": ("QUALITY_GATE_FAILED", 0, 0, 0), "c": ("SUCCESS", 1, 1, 1)}
    summary = reports.batch_summary(stages.runs).first()
    assert (summary.papers, summary.succeeded, summary.gate_failed, summary.mean_precision) == (3, 2, 1, 1.0)
    nodes, edges, proof = evidence.graph_tables(stages.normalised)
    assert (nodes.count(), edges.count(), proof.count()) == (2, 1, 2)


def test_sections_are_extracted_once_and_papers_keep_their_order(spark, tmp_path):
    """Two papers name one drug and condition: a node comes from the first fact of the last paper, an edge from its last."""
    asked = tmp_path / "asked"
    asked.mkdir()
    inner, folder = DictionaryExtractor(["Zoloft", "sertraline"], ["MDD"]), str(asked)

    def extractor(frames):
        import uuid

        for frame in frames:
            for _ in range(len(frame)):
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            yield from inner(iter([frame]))

    text = "## {0}\n{1} was an effective treatment of MDD, as this trial of {2} patients showed.\n"
    first = text.format("Results", "sertraline", 10) + text.format("Results", "Zoloft", 20)
    last = text.format("Zzz", "Zoloft", 30) + text.format("Abstract", "sertraline", 40)
    docs = spark.createDataFrame([("z", first, 1), ("a", last, 2)], "source_id string, markdown string, load_seq long")
    stages = evidence.process_papers(docs, extractor, ontology.concepts(spark, ontology.EXAMPLE))
    nodes, edges, proof = evidence.graph_tables(stages.normalised)
    (edge,) = edges.collect()
    assert edge.source_id == "a" and "40 patients" in edge.evidence
    assert [r.name for r in nodes.where("label = 'Drug'").collect()] == ["Zoloft"]
    assert [(r.source_id, r.fact_index) for r in proof.orderBy("load_seq", "fact_index").collect()] == [("z", 0), ("z", 1), ("a", 0), ("a", 1)]
    assert stages.runs.count() == 2 and stages.gates.count() == 2
    assert len(list(asked.iterdir())) == 4
    unordered = evidence.process_papers(docs.drop("load_seq"), inner, ontology.concepts(spark, ontology.EXAMPLE))
    assert evidence.graph_tables(unordered.normalised)[1].first().source_id == "z"


def test_fact_files(spark, tmp_path):

    (tmp_path / "list.json").write_text('[{"drug_name": "a"}, {"drug_name": "b", "confidence": 0.5}]')
    (tmp_path / "wrapped.json").write_text('{"total_facts": 1, "extracted_facts": [{"drug_name": "c"}]}')
    (tmp_path / "bad.json").write_text('{"facts": []}')
    got = sorted((r.fact_index, r.drug_name) for f in ("list", "wrapped") for r in fact_files.read_facts(spark, str(tmp_path / f"{f}.json")).collect())
    assert got == [(0, "a"), (0, "c"), (1, "b")]
    with pytest.raises(Exception, match="no list of facts"):
        fact_files.read_facts(spark, str(tmp_path / "bad.json")).collect()
    facts_ = fact_files.read_facts(spark, str(tmp_path / "list.json")).withColumn("source_id", F.lit("p"))
    fact_files.write_extracted(facts_, str(tmp_path / "out"))
    assert [r.drug_name for r in fact_files.read_facts(spark, str(tmp_path / "out" / "source_id=p")).orderBy("fact_index").collect()] == ["a", "b"]


def test_ordinal(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 40), rng.random()) for _ in range(300)]
    got = ordinal(spark.createDataFrame(rows, "k long, x double"), "k", ["k", "x"], "i", width=7).orderBy("i").collect()
    assert [(r.i, r.k, r.x) for r in got] == [(i, *r) for i, r in enumerate(sorted(rows))]


def test_fixture_facts(spark):
    assert fixture.facts(spark, "/root/testdata/sf0.001").count() == 6000


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_winners_are_found_by_hash(spark):
    """Structs of all properties were aggregated by sorting every row."""
    rows = spark.createDataFrame([("Drug", f"d{i % 3}", f"name{i % 2}", i % 4, i) for i in range(40)], "label string, id string, name string, load_seq long, fact_index long")
    mentions = rows.selectExpr("label", "id", "name", "'n' AS normalized_name", "'exact' AS match_type", "1.0D AS match_score", "label AS category", "load_seq", "fact_index")
    first = graph.first_mentions(mentions)
    assert "SortAggregate" not in _plan(first) and first.count() == 12
    assert sorted(map(tuple, graph.merged_nodes(first).collect())) == sorted(map(tuple, graph.merged_nodes(mentions).collect()))
    evidence = rows.selectExpr("id AS src_id", "'TREATS' AS rel_type", "name AS dst_id", "'treats' AS label", "load_seq", "fact_index", *(f"CAST(fact_index AS STRING) AS {c}" for c in graph.EDGE_PROPERTIES))
    found = {(r.src_id, r.dst_id): (r.load_seq, r.fact_index, r.evidence) for r in graph.edges(evidence).collect()}
    expected = {}
    for r in sorted(evidence.collect(), key=lambda r: (r.load_seq, r.fact_index)):
        expected[(r.src_id, r.dst_id)] = (r.load_seq, r.fact_index, r.evidence)
    assert found == expected


def test_unmatched_terms_are_counted_by_hash(spark, monkeypatch):
    from factloom.operators import linking

    plans = []
    monkeypatch.setattr(linking, "settle", lambda df, name: (plans.append(_plan(df)), df)[1])
    linked = spark.createDataFrame([("drug", t, i, p, "unmatched") for i, (t, p) in enumerate([("b", 1), ("a", 0), ("b", 0)])] + [("drug", "c", 1, 1, "unmatched")], "slot string, text string, fact_index long, pos int, match_type string")
    got = {r.text: (r.place, r.n) for r in linking.unmatched_report(linked).collect()}
    assert got == {"b": (1, 2), "a": (2, 1), "c": (3, 1)}
    assert "HashAggregate(keys=[slot" in plans[0]
