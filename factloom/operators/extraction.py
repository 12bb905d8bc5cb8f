"""Sections into facts: a pluggable extractor, then declarative cleaning rules.

An extractor is any function from an iterator of pandas frames (source_id, section,
text) to one of facts; it runs in ``mapInPandas`` after the eligibility filter, so
the expensive call sees only what it should.  ``DictionaryExtractor`` is the offline default.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom import schemas, vocab
from factloom.functions.text import contains_any, contains_term, eligible, lookup, strip, text, truncated
from factloom.operators.dictionary import automaton
from factloom.plans.workspace import settle

Extractor = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


class DictionaryExtractor:
    """Facts from sentences that name a known drug and a known condition; the relation is a parameter.  Each sentence is
    read once, whatever the number of names."""

    def __init__(self, drugs: list[str], conditions: list[str], relation: str = "TREATS", confidence: float = 0.7) -> None:
        self.drugs, self.conditions, self.relation, self.confidence = drugs, conditions, relation, confidence

    def __call__(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = schemas.FACT.names
        index, known = pd.Index(names), automaton((*self.drugs, *self.conditions))
        for frame in frames:
            rows = []
            for body, source_id, section in zip(frame["text"], frame["source_id"], frame["section"], strict=True):
                for sentence in re.split(r"(?<=[.!?])\s+(?=[A-Z(])", body):
                    found = sorted(known.found(sentence))
                    conditions = [self.conditions[i - len(self.drugs)] for i in found if i >= len(self.drugs)]
                    for drug in (self.drugs[i] for i in found if i < len(self.drugs)):
                        for condition in conditions:
                            rows.append({"drug_name": drug, "condition_name": condition, "relation": self.relation, "side_effects": [], "source_id": source_id, "section": section, "span": sentence, "confidence": self.confidence})
            # As one block of objects: frames are often those of one section, where what pandas infers costs more than the search.
            cells = np.empty((len(rows), len(names)), dtype=object)
            for row, values in zip(cells, rows, strict=True):
                for place, name in enumerate(names):
                    row[place] = values.get(name)
            yield pd.DataFrame(cells, columns=index, copy=False)


def extract(sections: DataFrame, extractor: Extractor) -> DataFrame:
    """Facts of all eligible sections, nothing dropped for being a duplicate, with ``place``: a number that rises with
    the order in which a task's sections gave them.  Sections of a document that lie together in order, as
    ``split_sections`` leaves them, so have their facts in order.  Write the result before it is used twice:
    another evaluation asks the extractor again."""
    worth = sections.where(eligible("name", "text")).select("source_id", F.col("name").alias("section"), truncated("text").alias("text"))

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 33
        for facts in extractor(frames):
            yield facts.assign(place=range(at, at + len(facts)))
            at += len(facts)

    return worth.mapInPandas(placed, T.StructType([*schemas.FACT.fields, T.StructField("place", T.LongType())]))


#: Times that a section is sent to the extractor before it counts as empty.
ATTEMPTS = 3
_TRIED = T.StructType([*schemas.FACT.fields, T.StructField("section_seq", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("error", T.StringType()), T.StructField("asked", T.BooleanType())])


#: Rows that are handed on at once.
_TOLD_ROWS = 1000


def _one_by_one(extractor: Extractor) -> Extractor:
    """Each section's facts with its number, after a row (``asked``) that says how it went.  Where the extractor raises, it starts anew after
    that section.  Sections are asked one by one, but their rows are gathered as lists: a frame for each would cost more than most extractors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list[tuple] = []
        held: list[pd.DataFrame] = []
        out: list[list] = [[] for _ in _TRIED.names]
        full: list[pd.DataFrame] = []

        def each() -> Iterator[tuple[tuple, pd.DataFrame]]:
            for frame in frames:
                heads = list(zip(frame["source_id"].tolist(), frame["section"].tolist(), frame["section_seq"].tolist(), strict=True))
                given = frame.drop(columns="section_seq")
                for i, head in enumerate(heads):
                    yield head, given.iloc[i : i + 1]

        sections = each()

        def feed() -> Iterator[pd.DataFrame]:
            for head, section in sections:
                now.append(head)
                yield section

        def told(error: str | None = None) -> None:
            source_id, section, seq = now.pop(0)
            own = {"source_id": [source_id], "section": [section]}
            facts = [f for f in held if len(f)] if error is None else []
            n = 1 + sum(map(len, facts))
            own |= {"section_seq": [seq] * n, "place": range(n), "error": [error] + [None] * (n - 1), "asked": [True] + [False] * (n - 1)}
            cells = [(dict(zip(f.columns, f.to_numpy(dtype=object).T, strict=True)), len(f)) for f in facts]
            for column, name in zip(out, _TRIED.names, strict=True):
                column.extend(own.get(name, (None,)))
                if name not in ("section_seq", "place", "error", "asked"):
                    for values, size in cells:
                        column.extend(values[name] if name in values else [None] * size)
            held.clear()
            if len(out[0]) >= _TOLD_ROWS:
                full.append(gathered())

        def gathered() -> pd.DataFrame:
            made = pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(_TRIED.names, out, strict=True)}).where(lambda d: d.notna(), None)
            for column in out:
                column.clear()
            return made

        while True:
            try:
                for facts in extractor(feed()):
                    while len(now) > 1:  # it has asked for the next section
                        told()
                    held.append(facts)
                    while full:
                        yield full.pop(0)
                while now:
                    told()
                if out[0]:
                    full.append(gathered())
                yield from full
                return
            except Exception as e:
                while len(now) > 1:
                    told()
                if not now:
                    raise
                told(f"{type(e).__name__}: {e}")

    return run


def _out_of_range(facts: DataFrame) -> DataFrame:
    """Sections with a fact that would stay but has a value outside its field's range."""
    inside = F.coalesce(F.col("confidence").between(0, 1), F.lit(False)) & (F.col("p_value").isNull() | F.col("p_value").between(0, 1))
    return facts.where(rejection().isNull() & ~inside).select("source_id", "section_seq").distinct()


def extract_sections(sections: DataFrame, extractor: Extractor, attempts: int = ATTEMPTS, whole_sections: bool = False) -> tuple[DataFrame, DataFrame]:
    """Facts of all eligible sections, and how each went: (source_id, section_seq, section, attempts, error).

    The extractor gets frames of one section (source_id, section, text, attempt) and gives a section's facts before it asks for the
    next one.  A section where it raises is sent again, up to ``attempts`` times, with all others settled; after that it has
    no facts and its last error.  With ``whole_sections`` a section one of whose facts is out of range is sent again, too;
    without it such a fact is left to the cleaning.  ``place`` orders a section's facts."""
    keys = ["source_id", "section_seq"]
    # Few bytes, but much work: sections are dealt over all shuffle partitions, not over those that their bytes fill.
    parts = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = settle(sections.where(eligible("name", "text")).select(*keys, F.col("name").alias("section"), truncated("text").alias("text")), "sections")
    facts, outcomes = None, None
    for attempt in range(1, attempts + 1):
        tried = settle(left.repartition(parts, *keys).withColumn("attempt", F.lit(attempt)).mapInPandas(_one_by_one(extractor), _TRIED), "tried")
        went = tried.where("asked").select(*keys, "section", F.lit(attempt).alias("attempts"), "error")
        if whole_sections:
            bad = _out_of_range(tried.where("NOT asked")).withColumn("bad", F.lit("a fact is out of range"))
            went = went.join(bad, keys, "left").withColumn("error", F.coalesce("error", "bad")).drop("bad")
        went = settle(went, "went")
        done = went if attempt == attempts else went.where("error IS NULL")
        new = tried.where("NOT asked").join(went.where("error IS NULL").select(*keys), keys, "left_semi").select(*schemas.FACT.names, "section_seq", "place")
        facts, outcomes = (new, done) if facts is None else (facts.union(new), outcomes.union(done))
        if attempt == attempts or not went.where("error IS NOT NULL").limit(1).count():
            break
        left = settle(left.join(went.where("error IS NULL").select(*keys), keys, "left_anti"), "sections")
    return facts, outcomes


def numbered(placed: DataFrame) -> DataFrame:
    """Facts with ``fact_index``, from 0 in each document, in the order of their sections, if these are known, and places."""
    order = [c for c in ("section_seq", "place") if c in placed.columns]
    index = F.row_number().over(Window.partitionBy("source_id").orderBy(*order)) - 1
    return placed.withColumn("fact_index", index.cast("long")).drop(*order)


def sample_size(raw: Column | str) -> Column:
    """Whole numbers of 1 to 100000; a text with a fraction is none, a number with one is cut."""
    value = (F.col(raw) if isinstance(raw, str) else raw).try_cast("int")
    return F.when(value.between(1, 100_000), value)


def treatment_line(raw: Column | str) -> Column:
    line = F.lower(strip(F.col(raw) if isinstance(raw, str) else raw))
    return F.when(line.isin(vocab.TREATMENT_LINES), line)


def canonical_condition(raw: Column | str) -> Column:
    c = F.col(raw) if isinstance(raw, str) else raw
    return lookup(F.lower(strip(c)), vocab.CANONICAL_CONDITIONS, c)


def specific_side_effects(raw: Column | str) -> Column:
    """Side effects that name one: not empty, not one of the general terms, at most 100 characters."""
    listed = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.array().cast("array<string>"))
    return F.filter(listed, lambda s: s.isNotNull() & (s != "") & ~F.lower(strip(s)).isin(vocab.INVALID_SIDE_EFFECTS) & (F.length(strip(s)) <= 100))


def rejection(drug: str = "drug_name", condition: str = "condition_name", relation: str = "relation", span: str = "span") -> Column:
    """Why a raw fact is dropped, the first rule that says so; null for facts that stay.
    Nulls are the text "None" here, as they are to the rules of completeness."""
    d, c, s = (strip(F.coalesce(F.col(x).cast("string"), F.lit("None"))) for x in (drug, condition, span))
    low = F.lower(s)
    fits = contains_term(s, c) | contains_any(low, vocab.CLINICAL_CONTEXT) | (F.upper(text(relation)) == "ASSOCIATED_WITH_SE")
    dangling = F.substring(F.lower(text(span)), 1, 50).rlike(rf"^({'|'.join(vocab.PRONOUNS)})\s+({'|'.join(vocab.PRONOUN_VERBS)})")
    return F.when((d == "") | (c == "") | (s == ""), "incomplete").when(~contains_term(s, d), "drug_not_in_span").when(~fits, "condition_out_of_context").when(dangling, "dangling_pronoun")


def clean_facts(facts: DataFrame) -> DataFrame:
    """The facts that pass, with cleaned fields.  A fact outside its field's range is dropped by itself
    (confidence and p_value must lie in 0..1); it does not take its section's other facts with it."""
    has = set(facts.columns)
    stays = F.col("confidence").between(0, 1)
    if "p_value" in has:
        stays = stays & (F.col("p_value").isNull() | F.col("p_value").between(0, 1))
    # As rows of a list that is empty where a fact goes: a filter on the rules is moved to where the facts' columns are made, and
    # makes each of them once more wherever a rule looks at it.
    kept = facts.withColumn("_stays", F.explode_outer(F.when(stays & rejection().isNull(), F.array(F.lit(True))))).where("_stays").drop("_stays")
    changes = {"condition_name": canonical_condition(strip("condition_name")), "side_effects": specific_side_effects("side_effects")}
    if "sample_size" in has:
        changes["sample_size"] = sample_size("sample_size")
    if "treatment_line" in has:
        changes["treatment_line"] = treatment_line("treatment_line")
    # What was written is no longer what the fact says.
    return kept.withColumns(changes).drop("raw_fact")
