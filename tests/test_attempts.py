"""Sections that are tried again, sources that cannot be read, and runs that say so."""

import pandas as pd
import pytest

from factloom.operators import extraction
from factloom.plans import evidence
from factloom.sources import documents, ontology

TEXT = "Sertraline was an effective treatment of MDD in section {0} of this trial, as all patients showed."


def frames(*names):
    return iter([pd.DataFrame({"source_id": "p", "section_seq": range(len(names)), "section": names, "text": [f"text {n}" for n in names], "attempt": 1})])


def told(extractor, *names):
    rows = pd.concat(list(extraction._one_by_one(extractor)(frames(*names))))
    asked = rows[rows["asked"]]
    return list(zip(asked["section"], asked["error"], strict=True)), list(zip(rows[~rows["asked"].astype(bool)]["section_seq"], rows[~rows["asked"].astype(bool)]["span"], strict=True))


def facts(frame):
    return pd.DataFrame({"drug_name": ["d"] * len(frame), "span": frame["text"], "section": frame["section"], "source_id": frame["source_id"]})


def test_sections_are_told_apart_and_errors_stay_with_theirs():
    def extractor(given):
        for frame in given:
            if frame["section"].iloc[0] == "bad":
                raise ValueError("x")
            yield facts(frame)
            if frame["section"].iloc[0] == "two":
                yield facts(frame)

    asked, found = told(extractor, "a", "bad", "two", "bad", "bad", "z")
    assert asked == [("a", None), ("bad", "ValueError: x"), ("two", None), ("bad", "ValueError: x"), ("bad", "ValueError: x"), ("z", None)]
    assert found == [(0, "text a"), (2, "text two"), (2, "text two"), (5, "text z")]


def test_an_extractor_that_raises_late_or_says_nothing():
    def late(given):
        for frame in given:
            yield facts(frame)
            if frame["section"].iloc[0] == "b":
                raise RuntimeError("after")

    assert told(late, "a", "b", "c")[0] == [("a", None), ("b", "RuntimeError: after"), ("c", None)]
    assert told(lambda given: (f.iloc[:0] for f in given), "a", "b") == ([("a", None), ("b", None)], [])

    def broken(given):
        raise RuntimeError("at once")
        yield

    with pytest.raises(RuntimeError):
        told(broken, "a")


def counting(folder):
    """An extractor that raises for sections named so until an attempt; counts its calls in a folder."""

    def extractor(given):
        import uuid

        for frame in given:
            section, attempt = frame["section"].iloc[0], int(frame["attempt"].iloc[0])
            open(f"{folder}/{section}.{attempt}.{uuid.uuid4().hex}", "w").close()
            if section.startswith("Late") and attempt < 3 or section.startswith("Never"):
                raise TimeoutError("no answer")
            confidence = 1.5 if section.startswith("Odd") and attempt < 2 else 0.9
            yield pd.DataFrame({"drug_name": ["sertraline"], "condition_name": ["MDD"], "relation": ["TREATS"], "span": [frame["text"].iloc[0]], "confidence": [confidence], "section": [section], "source_id": frame["source_id"]})

    return extractor


@pytest.mark.parametrize("whole", [False, True])
def test_only_open_sections_are_asked_again(spark, tmp_path, whole):
    sections = spark.createDataFrame([("p", i, name, TEXT.format(i)) for i, name in enumerate(["Results", "Late", "Never", "Odd", "References"])], "source_id string, section_seq int, name string, text string")
    found, tries = extraction.extract_sections(sections, counting(str(tmp_path)), whole_sections=whole)
    assert {r.section: (r.attempts, r.error) for r in tries.collect()} == {"Results": (1, None), "Late": (3, None), "Never": (3, "TimeoutError: no answer"), "Odd": (2 if whole else 1, None)}
    assert sorted((r.section, r.confidence) for r in found.collect()) == [("Late", 0.9), ("Odd", 0.9 if whole else 1.5), ("Results", 0.9)]
    calls = sorted(".".join(f.name.split(".")[:2]) for f in tmp_path.iterdir())
    assert calls == sorted(["Results.1", "Late.1", "Late.2", "Late.3", "Never.1", "Never.2", "Never.3", "Odd.1", *(["Odd.2"] if whole else [])])


def test_a_source_that_fails_is_a_run(spark, tmp_path):
    for name in ("good", "bad"):
        (tmp_path / f"{name}.pdf").write_bytes(b"%PDF " + name.encode())

    def converter(given):
        for frame in given:
            if b"bad" in bytes(frame["content"].iloc[0]):
                raise OSError("damaged")
            yield pd.DataFrame({"path": frame["path"], "markdown": [f"# Results\n{TEXT.format(1)}"]})

    def fetcher(given):
        for frame in given:
            if "gone" in frame["url"].iloc[0]:
                raise OSError("404")
            yield pd.DataFrame({"url": frame["url"], "html": [f"<article><p>{TEXT.format(2)}</p></article>"]})

    files = documents.converted_files(spark, str(tmp_path / "*.pdf"), converter, errors=True).select("source_id", "markdown", "error")
    urls = spark.createDataFrame([("http://a.example/here",), ("http://a.example/gone",), ("file.md",)], "source string")
    pages = documents.page_documents(documents.fetched(urls, fetcher, errors=True)).selectExpr("source_id", "text AS markdown", "error")
    missing = documents.failed_source(spark, "papers/none.md", FileNotFoundError("none.md"))
    docs = files.unionByName(pages).unionByName(missing)
    runs = evidence.process_papers(docs, extraction.DictionaryExtractor(["sertraline"], ["MDD"]), ontology.concepts(spark, ontology.EXAMPLE)).runs
    got = {(r.status, r.error): r.extracted for r in runs.collect()}
    assert got == {("SUCCESS", None): 1, ("FAILED", "OSError: damaged"): 0, ("FAILED", "OSError: 404"): 0, ("FAILED", "FileNotFoundError: none.md"): 0}
    assert runs.where("status = 'SUCCESS'").count() == 2


def test_rows_of_sections_are_handed_on_together():
    """A frame for each section cost more than the search; their order and numbers stay."""
    made = list(extraction._one_by_one(lambda given: (facts(f) for f in given))(frames(*map(str, range(700)))))
    assert [len(f) for f in made] == [1000, 400]
    rows = pd.concat(made)
    assert list(rows["section_seq"]) == [i // 2 for i in range(1400)] and list(rows["place"]) == [0, 1] * 700


def test_sections_are_dealt_over_all_partitions(spark):
    def extractor(given):
        from pyspark import TaskContext

        for frame in given:
            yield frame[["source_id", "section"]].assign(drug_name=str(TaskContext.get().partitionId()))

    sections = spark.createDataFrame([("p", i, "Results", TEXT.format(i)) for i in range(200)], "source_id string, section_seq int, name string, text string").coalesce(1)
    found, _ = extraction.extract_sections(sections, extractor)
    assert found.count() == 200 and found.select("drug_name").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rows_of_a_step_are_handed_on_together(spark):
    def step(given):
        for frame in given:
            if (frame["n"] % 3 == 1).any():
                raise ValueError("no text")
            yield frame

    def numbered(given):
        for i, frame in enumerate(given):
            yield frame.assign(n=i)

    got = documents.tried(spark.range(90, numPartitions=1).selectExpr("id", "id AS n"), step, "id long, n long", "id")
    rows = {r.id: (r.n, r.error) for r in got.collect()}
    assert rows == {i: (None, "ValueError: no text") if i % 3 == 1 else (i, None) for i in range(90)}
    assert got.mapInPandas(numbered, "id long, n long, error string").select("n").distinct().count() == 1
