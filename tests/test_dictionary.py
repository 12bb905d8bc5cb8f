"""The automaton against nested loops: offsets, words' edges, case, large dictionaries, and the extractor on it."""

import random
import re

import pandas as pd
import pytest

from factloom import queries
from factloom.functions.text import contains_term
from factloom.operators import dictionary, linking
from factloom.operators.extraction import DictionaryExtractor


def plain(text, terms, whole):
    low = text.lower()
    out = []
    for term in sorted({t.lower() for t in terms} - {""}):
        for m in re.finditer(f"(?={re.escape(term)})", low):
            a, b = m.start(), m.start() + len(term)
            if not whole or (re.compile(r"\b").match(low, a) and re.compile(r"\b").match(low, b)):
                out.append((term, a, b))
    return sorted(out)


@pytest.mark.parametrize("whole", [False, True])
def test_occurrences_equal_nested_loops(whole):
    rng = random.Random(7)
    terms = ["a", "ab", "bab", "ABA", "b.b", "é", "ab é", "_a", "", "a" * 5, ".", "x"]
    machine = dictionary.Automaton(terms)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "A", ".", " ", "é", "É", "_", "1"]) for _ in range(rng.randint(0, 25)))
        assert sorted(machine.occurrences(text, whole)) == plain(text, terms, whole)
        assert machine.found(text) == {i for i, t in enumerate(terms) if t and t.lower() in text.lower()}


def test_offsets_where_lower_case_is_longer():
    machine = dictionary.Automaton(["stanbul", "x"])
    text = "İİ İstanbul x"
    assert [(text[a:b], t) for t, a, b in machine.occurrences(text)] == [("stanbul", "stanbul"), ("x", "x")]


def test_large_dictionary_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    terms = list({"".join(rng.choice("abcde ") for _ in range(rng.randint(3, 9))).strip() or "z" for _ in range(100_000)})
    texts = ["".join(rng.choice("abcde ") for _ in range(2000)) for _ in range(8)]
    machine = dictionary.automaton(tuple(terms))
    for text in texts[:3]:
        assert machine.found(text) == {i for i, t in enumerate(terms) if t in text}
    monkeypatch.setattr(dictionary, "BLOCK_TERMS", 30_000)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(9, None, "clash"), (10, "", "clash")], "doc_id long, text string, start string").repartition(3)
    got = {(r.doc_id, r.term, r.start, r.end) for r in dictionary.find_terms(df, spark.createDataFrame([(t,) for t in terms], "term string"), ["doc_id"]).collect()}
    assert got == {(i, *o) for i, t in enumerate(texts) for o in machine.occurrences(t)}


def test_containment_between_words(spark):
    rows = [("the SSRI.", "ssri"), ("SSRIs", "ssri"), ("", "a"), (None, "a"), ("a+b", "a+b"), ("x a+b", "a+"), ("né", "n"), ("Qu\\E", "\\E")]
    df = spark.createDataFrame(rows, "s string, t string").select(contains_term("s", "t").alias("anywhere"), contains_term("s", "t", whole_words=True).alias("words"))
    assert [r.anywhere for r in df.collect()] == [True, True, False, False, True, True, True, True]
    assert [r.words for r in df.collect()] == [True, False, False, False, True, True, False, True]


def test_extractor_equals_nested_loops():
    rng = random.Random(9)
    drugs, conditions = ["Zoloft", "sertraline", "ser", "zoloft", "xr"], ["MDD", "mdd, severe", "anxiety"]
    words = ["Zoloft", "SERTRALINE", "helped.", "In", "mdd,", "severe", "Anxiety", "and", "(XR)", "no"]
    frame = pd.DataFrame({"source_id": "p", "section": "s", "text": [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]})
    (got,) = DictionaryExtractor(drugs, conditions)(iter([frame]))
    expected = [(d, c, s) for t in frame["text"] for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", t) for d in drugs if d.lower() in s.lower() for c in conditions if c.lower() in s.lower()]
    assert list(zip(got["drug_name"], got["condition_name"], got["span"], strict=True)) == expected


def test_fuzzy_join_of_all_words(spark, sf="/root/testdata/sf0.001"):
    import difflib

    terms, known = queries._halves(spark, sf)
    keys = [r.key for r in known.collect()]
    asked = sorted(r.key for r in terms.collect())
    got = {r.key: (r.known, r.score) for r in queries.link_fuzzy_words(spark, sf).collect()}
    for word in random.Random(1).sample(asked, 40):
        near = difflib.get_close_matches(word, keys, n=1, cutoff=linking.FUZZY_CUTOFF)
        assert got.get(word) == ((near[0], round(difflib.SequenceMatcher(None, word, near[0]).ratio(), 9)) if near else None)
    assert len(got) > 100


def test_what_is_written_at_the_offsets(spark):
    texts = ["Nausea and nausea.", "aaaa", None, "İ nausea"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame([("nausea",), ("aa",)], "term string")
    got = {(r.doc_id, r.start, r.written) for r in dictionary.find_terms(df, terms, ["doc_id"], apart=True, written=True).collect()}
    assert got == {(0, 0, "Nausea"), (0, 11, "nausea"), (1, 0, "aa"), (1, 2, "aa"), (3, 2, "nausea")}
    # A text is not taken along with each of its occurrences, nor sent to the JVM again.
    assert "text" not in dictionary.find_terms(df, terms, ["doc_id"], whole_words=True, written=True).columns


def test_batches_of_occurrences(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "BATCH_OCCURRENCES", 2)
    df = spark.createDataFrame([(i, "x y x") for i in range(5)], "doc_id long, text string")
    found = dictionary.find_terms(df, spark.createDataFrame([("x",)], "term string"), ["doc_id"], whole_words=True)
    assert sorted((r.doc_id, r.start) for r in found.collect()) == [(i, s) for i in range(5) for s in (0, 4)]
