"""The commands, one after the other, on files."""

from factloom import cli

BODY = "Sertraline was an effective treatment of major depressive disorder in this trial."


def run(spark, *argv):
    return cli.run(spark, cli._parser().parse_args(argv))


def test_stage_by_stage(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "paper.md").write_text(f"# Results\n{BODY}\n# References\n{BODY}")
    at = lambda name: str(tmp_path / name)
    assert run(spark, "parse", "--source", at("in"), "--out", at("parsed")) == 0
    run(spark, "extract", "--input", at("parsed"), "--output", at("extracted"))
    run(spark, "validate", "--input", at("extracted"), "--output", at("checked"), "--show-details")
    assert run(spark, "quality", "--input", at("checked") + "/validated", "--output", at("quality")) == 0
    run(spark, "normalise", "--input", at("checked") + "/validated", "--output", at("normalised"))
    run(spark, "unmatched", "--input", at("checked") + "/validated")
    run(spark, "load", "--input", at("normalised"), "--graph", at("graph"), "--clear")
    (edge,) = spark.read.parquet(at("graph") + "/edges").collect()
    assert (edge.src_id, edge.rel_type, edge.dst_id, edge.section) == ("drug_DEMO_D1", "TREATS", "condition_DEMO_C1", "results")


def test_equal_facts_have_places_of_their_own(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "paper.md").write_text(f"# Results\n{BODY}\n{BODY}")
    at = lambda name: str(tmp_path / name)
    run(spark, "parse", "--source", at("in"), "--out", at("parsed"))
    run(spark, "extract", "--input", at("parsed"), "--output", at("extracted"), "--model", "mine", "--load-seq", "4")
    rows = spark.read.parquet(at("extracted")).orderBy("fact_index").collect()
    assert [(r.fact_index, r.load_seq, r.extraction_model) for r in rows] == [(0, 4, "mine"), (1, 4, "mine")]
    run(spark, "validate", "--input", at("extracted"), "--output", at("checked"), "--issues", at("found"))
    assert spark.read.parquet(at("checked") + "/validated").count() == 2 and (tmp_path / "found").exists()
    run(spark, "normalise", "--input", at("checked") + "/validated", "--output", at("normalised"))
    assert spark.read.parquet(at("normalised")).count() == 2


def test_pages_and_lists_of_sources(spark, tmp_path):
    (tmp_path / "page.html").write_text(f"<html><body><nav>menu</nav><article><p>{BODY}</p></article></body></html>")
    (tmp_path / "paper.md").write_text(f"# Results\n{BODY}")
    (tmp_path / "list.txt").write_text(f"# sources\n{tmp_path / 'page.html'}\n\n{tmp_path / 'paper.md'}\n")
    run(spark, "batch", "--file", str(tmp_path / "list.txt"), "--output-base", str(tmp_path / "out"))
    assert {r.source_id: r.status for r in spark.read.parquet(str(tmp_path / "out/runs")).collect()} == {"page": "SUCCESS", "paper": "SUCCESS"}
    assert {r.source_id: r.load_seq for r in spark.read.parquet(str(tmp_path / "out/normalised")).collect()} == {"page": 0, "paper": 1}


def test_batch_and_failing_gate(spark, tmp_path):
    (tmp_path / "a.md").write_text(f"# Results\n{BODY}")
    (tmp_path / "b.md").write_text("# Results\n" + "Nothing to see here. " * 5)
    run(spark, "batch", "--source", str(tmp_path / "a.md"), str(tmp_path / "b.md"), "--output-base", str(tmp_path / "out"))
    assert {r.source_id: r.status for r in spark.read.parquet(str(tmp_path / "out/runs")).collect()} == {"a": "SUCCESS", "b": "QUALITY_GATE_FAILED"}
    (summary,) = spark.read.json(str(tmp_path / "out/summary")).collect()
    assert (summary.papers, summary.succeeded) == (2, 1)
    bad = '[{"drug_name": "x", "condition_name": "drug care", "relation": "TREATS", "span": "no", "confidence": 0.1}]'
    (tmp_path / "bad.json").write_text(bad)
    assert run(spark, "quality", "--input", str(tmp_path / "bad.json")) == 1


def test_a_source_that_is_not_there_does_not_end_the_batch(spark, tmp_path):
    (tmp_path / "a.md").write_text(f"# Results\n{BODY}")
    run(spark, "batch", "--source", str(tmp_path / "none.md"), str(tmp_path / "a.md"), "--output-base", str(tmp_path / "out"), "--attempts", "1", "--whole-sections")
    rows = {r.source_id: (r.status, r.error) for r in spark.read.parquet(str(tmp_path / "out/runs")).collect()}
    assert rows["a"] == ("SUCCESS", None) and rows["none"][0] == "FAILED" and "AnalysisException" in rows["none"][1]
    (summary,) = spark.read.json(str(tmp_path / "out/summary")).collect()
    assert (summary.papers, summary.succeeded, summary.failed) == (2, 1, 1)


def test_similarity_is_a_method(spark, tmp_path):
    (tmp_path / "facts.json").write_text('[{"drug_name": "sertraline", "condition_name": "MDD", "relation": "TREATS", "span": "Sertraline treats MDD.", "confidence": "0.9"}]')
    assert run(spark, "quality", "--input", str(tmp_path / "facts.json"), "--methods", "heuristic", "similarity", "--output", str(tmp_path / "out")) == 0
    row = spark.read.parquet(str(tmp_path / "out")).first()
    assert row.method_results["similarity"].likely_correct and row.quality_score == (100 + row.method_results["similarity"].quality_score) / 2
