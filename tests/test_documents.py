"""Sections, sentences, pages and surfaces."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import arrays, text
from factloom.operators import sections
from factloom.sources import documents, ontology

MARKDOWN = "Before.\n# Background :\nFirst. Second one! (Third) one.\n## Empty\n## Results\n\n\n#\nLast  text"


def test_sections_and_their_names(spark):
    df = spark.createDataFrame([("p", MARKDOWN), ("q", None), ("r", "")], "source_id string, markdown string")
    rows = sections.split_sections(df).orderBy("source_id", "section_seq").collect()
    assert [(r.source_id, r.raw_name, r.name, r.text) for r in rows] == [
        ("p", "Document", "Document", "Before."),
        ("p", "Background :", "introduction", "First. Second one! (Third) one."),
        ("p", "Section", "Section", "Last  text"),
    ]
    assert all(MARKDOWN[r.start_offset : r.end_offset] == r.text for r in rows)


def test_section_not_found_in_full_text_starts_at_its_end(spark):
    df = spark.createDataFrame([("p", "# A\nbody", "other")], "source_id string, markdown string, full string")
    (row,) = sections.split_sections(df, full_text_col="full").collect()
    assert (row.start_offset, row.end_offset) == (5, 9)


def test_sentence_offsets(spark):
    body = "One.  Two? (Three) x. é Four!\nFive"
    df = spark.createDataFrame([(1, body)], "id long, text string")
    rows = sections.split_sentences(df, ["id"]).orderBy("sent_seq").collect()
    assert [r.sentence for r in rows] == ["One.", "Two?", "(Three) x. é Four!", "Five"]
    assert all(body[r.start : r.end].strip() == r.sentence for r in rows)


def plain_sections(markdown):
    """Line by line, as the rule is told."""
    name, lines, out = "Document", [], []
    for line in [*markdown.splitlines(), "# end"]:
        if line.strip().startswith("#"):
            body = "\n".join(lines).strip()
            if body:
                out.append((name, body))
            name, lines = re.sub(r"^#+\s*", "", line).strip() or "Section", []
        else:
            lines.append(line)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="#A b.\n\r\t\x0b\x1c\x85\u2028\xa0é", max_size=60), min_size=20, max_size=40))
def test_sections_equal_the_plain_ones(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "source_id long, markdown string")
    got = {}
    for r in sections.split_sections(df).orderBy("source_id", "section_seq").collect():
        got.setdefault(r.source_id, []).append((r.raw_name, r.text))
        at = texts[r.source_id].find(r.text)
        assert r.start_offset == (at if at >= 0 else len(texts[r.source_id]))
    assert got == {i: plain_sections(t) for i, t in enumerate(texts) if plain_sections(t)}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="Ab. (!?\n\xa0é", max_size=200), min_size=10, max_size=30))
def test_sentences_equal_the_plain_ones(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in sections.split_sentences(df, ["id"]).orderBy("id", "sent_seq").collect():
        got.setdefault(r.id, []).append((r.sentence, r.start, r.end))
    want = {}
    for i, t in enumerate(texts):
        bounds = [(0, 0), *((m.start(), m.end()) for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z(])", t)), (len(t), len(t))]
        for (_, a), (b, _) in zip(bounds, bounds[1:], strict=False):
            if t[a:b].strip():
                want.setdefault(i, []).append((t[a:b].strip(), a, b))
    assert got == want


def test_running_sums(spark):
    df = spark.createDataFrame([(1, list(range(n))) for n in (0, 1, 2, 3, 10, 99, 5000)] + [(2, None)], "id int, a array<int>")
    for r in arrays.with_running_sums(df, "a", "s").collect():
        assert r.s == ([sum(r.a[: i + 1]) for i in range(len(r.a))] if r.a is not None else []) or r.a is None


def test_a_long_document_takes_linear_time(spark):
    """1 MB of lines and sentences, a section for each 40 of them."""
    import time

    def took(n):
        began = time.perf_counter()
        text = "\n".join(f"# Head {i}" if i % 40 == 0 else f"Sentence number {i}.\nAnd more." for i in range(n))
        df = spark.createDataFrame([("x", text)], "source_id string, markdown string")
        assert sections.split_sections(df).where("end_offset > start_offset").count() == n // 40
        assert sections.split_sentences(df, ["source_id"], "markdown").where("end > start").count() > n
        return time.perf_counter() - began

    took(80)
    one, four = took(10_000), took(40_000)
    assert four < 4 * one + 8


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="Ab c'’é-9\t", max_size=12), min_size=1, max_size=20))
def test_surface_is_idempotent_and_plain(spark, terms):
    df = spark.createDataFrame([(t,) for t in terms], "t string").select("t", text.surface("t").alias("s"))
    for t, s, again in df.select("t", "s", text.surface("s")).collect():
        assert s == again
        plain = t.strip().lower().replace("’", "'")
        assert s == " ".join(re.sub(r"[^a-z0-9'\s]", " ", plain).split())


def test_paper_ids(spark):
    df = spark.createDataFrame([("https://x.org/a.pdf",), ("C:\\papers\\b.c.pdf",), ("/data/doc.md",), ("HTTP://x",)], "s string")
    got = [r[0] for r in df.select(text.paper_id("s")).collect()]
    assert got[1:3] == ["b.c", "doc"] and all(re.fullmatch("[0-9a-f]{12}", got[i]) for i in (0, 3))


def test_main_text():
    html = "<html><head><title>t</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b><br>three</p><script>x()</script><div class='ad-box ad'>buy</div></article><p>out</p></body></html>"
    assert documents.main_text(html) == "Head\nOne two\nthree"
    assert documents.main_text("<p>a</p><p>b</p>") == "a\nb"
    assert documents.main_text(None) == ""


def test_eligibility_is_by_exact_name(spark):
    long = "x" * 50
    df = spark.createDataFrame([("References", long), ("Acknowledgments", long), ("Results", "short"), ("Results", long)], "n string, t string")
    assert [r[0] for r in df.select(text.eligible("n", "t")).collect()] == [False, True, False, True]


def test_sizes_and_terms(spark):
    df = spark.createDataFrame([(512,), (1536,), (5 * 1024**4,)], "b long")
    assert [r[0] for r in df.select(text.readable_size("b")).collect()] == ["512.0 B", "1.5 KB", "5.0 TB"]
    df = spark.createDataFrame([("Use an SSRI.", "ssri"), ("selective", "ect"), ("x", None)], "s string, t string")
    assert [tuple(r) for r in df.select(text.contains_term("s", "t"), text.contains_term("s", "t", whole_words=True)).collect()] == [(True, True), (True, False), (False, False)]


def test_source_list_and_markdown(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# note\n\n https://a.org \nb.pdf\n")
    assert sorted(r[0] for r in documents.source_list(spark, str(tmp_path / "s.txt")).collect()) == ["b.pdf", "https://a.org"]
    (tmp_path / "doc.md").write_text("# A\ntext")
    (row,) = documents.markdown_files(spark, str(tmp_path / "doc.md")).collect()
    assert (row.source_id, row.markdown) == ("doc", "# A\ntext")
    parsed = sections.parsed_documents(documents.markdown_files(spark, str(tmp_path / "doc.md")))
    documents.write_parsed(parsed, str(tmp_path / "parsed"))
    (back,) = documents.read_parsed(spark, str(tmp_path / "parsed")).select(F.col("sections")[0]["text"].alias("t")).collect()
    assert back.t == "text"


def test_ontology_errors():
    import pytest

    for bad in ({}, {"entities": []}, {"entities": {"drugs": "x"}}, {"providers": [], "entities": {}}, {"entities": {"drugs": [{"id": "1"}]}}):
        with pytest.raises(ontology.OntologyError):
            ontology.concept_rows(bad)
    (row,) = ontology.concept_rows({"entities": {"drugs": [{"concept_id": 1, "name": None, "x": 2}]}})
    assert row == ("drugs", 0, "1", "None", "custom", [], {"x": "2"})


def test_references_without_a_semicolon_stay():
    """As the SQL of html_text has them: a heading that was cut inside a reference shows what is left of it."""
    html = "<article><h1>so &amp; and&amp</h1><p>a &lt;b&gt; &#x27;c&#x2 &quo</p><p>d&amp;lt; &amp</p></article>"
    assert documents.main_text(html) == "so & and&amp\na <b> 'c&#x2 &quo\nd&lt; &amp"
