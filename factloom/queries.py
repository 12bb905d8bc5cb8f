"""Every operator as a query over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import difflib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import vocab
from factloom.functions.similarity import cosine
from factloom.functions.text import contains_term, eligible, paper_id, readable_size, section_name, surface, truncated
from factloom.operators import dictionary, embedding, extraction, graph, graph_reads, linking, quality, reports, sections, validation
from factloom.plans import evidence, fixture
from factloom.plans.workspace import settle, sorted_groups, workspace
from factloom.sources import documents as document_sources
from factloom.sources import facts as fact_sources
from factloom.sources import ontology
from factloom.streaming import upsert

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _keys(spark: SparkSession) -> DataFrame:
    return linking.concept_keys(ontology.concepts(spark, ontology.EXAMPLE))


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.normalise(fixture.facts(spark, sf_dir), _keys(spark))


_stores: dict[tuple, str] = {}


def _store(spark: SparkSession, sf_dir: str) -> graph.GraphStore:
    """The graph of a folder's facts, loaded once in a session; what the graph questions read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = (spark.sparkContext.applicationId, sf_dir, status.getModificationTime(), status.getLen())
    if key not in _stores:
        store = graph.GraphStore(spark, f"{workspace(spark)}/graph-{uuid.uuid4().hex[:8]}")
        store.load(linking.normalise(settle(fixture.facts(spark, sf_dir), "facts"), _keys(spark)), clear=True)
        _stores[key] = store.path
    return graph.GraphStore(spark, _stores[key])


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    store = _store(spark, sf_dir)
    return store.table("nodes"), store.table("edges"), store.table("edge_evidence")


# --- what DuckDB needs: expected matches from the standard library, and the tables built from them ---


def _surface(term: str) -> str:
    plain = term.strip().lower().replace("‘", "'").replace("’", "'")
    return " ".join(re.sub(r"[^a-z0-9'\s]", " ", plain).split())


def _expected_keys() -> dict[tuple[str, str], tuple]:
    found: dict[tuple[str, str], tuple] = {}
    for kind in ("synonym", "exact"):
        for entity, _, concept_id, label, provider, synonyms, _ in ontology.concept_rows(ontology.EXAMPLE):
            for term in synonyms if kind == "synonym" else [label]:
                if kind == "exact" or (entity, _surface(term)) not in found:
                    found[(entity, _surface(term))] = (concept_id, label, provider, kind, 1.0)
    return found


def _expected_match(entity: str, term: str) -> tuple:
    keys = _expected_keys()
    own = _surface(term)
    if (entity, own) in keys:
        return keys[(entity, own)]
    near = difflib.get_close_matches(own, [k for e, k in keys if e == entity], n=1, cutoff=linking.FUZZY_CUTOFF)
    if not near:
        return (None, None, None, "unmatched", 0.0)
    return (*keys[(entity, near[0])][:3], "fuzzy", difflib.SequenceMatcher(None, own, near[0]).ratio())


def _sql(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else f"{value!r}::DOUBLE" if isinstance(value, float) else repr(value)


_TERMS = [("drugs", t) for t in fixture.DRUGS] + [("conditions", t) for t in fixture.CONDITIONS] + [("relations", t) for t in fixture.RELATIONS] + [("outcomes", t) for t in fixture.OUTCOMES] + [("side_effects", t) for t in fixture.SIDE_EFFECTS]
_MATCHES = ",\n".join(f"({', '.join(map(_sql, (e, t, *_expected_match(e, t))))})" for e, t in _TERMS)
_FACTS = f"WITH facts AS ({fixture.FACTS_DUCKDB})"
_LINKED = f"""{_FACTS},
matches(entity_type, text, concept_id, label, provider, match_type, score) AS (VALUES {_MATCHES}),
slots AS (SELECT fact_index, 'drug' AS slot, 0 AS pos, 'drugs' AS entity_type, drug_name AS text FROM facts
  UNION ALL SELECT fact_index, 'condition', 0, 'conditions', condition_name FROM facts
  UNION ALL SELECT fact_index, 'relation', 0, 'relations', relation FROM facts
  UNION ALL SELECT fact_index, 'outcome', 0, 'outcomes', outcome FROM facts WHERE outcome IS NOT NULL
  UNION ALL SELECT fact_index, 'side_effect', p - 1, 'side_effects', side_effects[p] FROM (SELECT fact_index, side_effects, unnest(range(1, len(side_effects) + 1)) AS p FROM facts)),
linked AS (SELECT s.*, m.* EXCLUDE (entity_type, text) FROM slots s JOIN matches m ON m.entity_type = s.entity_type AND m.text = s.text)"""


def _node(prefix: str, alias: str) -> str:
    clean = f"replace(replace(replace({alias}.concept_id, ':', '_'), '/', '_'), ' ', '_')"
    return f"CASE WHEN {alias}.text IS NULL THEN NULL WHEN {alias}.concept_id IS NOT NULL THEN '{prefix}_' || {clean} ELSE '{prefix}_unmatched_' || substr(md5({alias}.text), 1, 8) END"


_GRAPH = f"""{_LINKED},
wide AS (SELECT f.*, {_node("drug", "d")} AS drug_id, {_node("condition", "c")} AS condition_id, {_node("outcome", "o")} AS outcome_id
  FROM facts f JOIN matches d ON d.entity_type = 'drugs' AND d.text = f.drug_name JOIN matches c ON c.entity_type = 'conditions' AND c.text = f.condition_name
  LEFT JOIN matches o ON o.entity_type = 'outcomes' AND o.text = f.outcome),
mentions AS (
  SELECT 'Drug' AS label, drug_id AS id, drug_name AS name, 'drugs' AS entity_type, load_seq, fact_index FROM wide
  UNION ALL SELECT 'Condition', condition_id, condition_name, 'conditions', load_seq, fact_index FROM wide
  UNION ALL SELECT 'Outcome', outcome_id, outcome, 'outcomes', load_seq, fact_index FROM wide WHERE outcome_id IS NOT NULL),
first_mentions AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, id ORDER BY load_seq DESC, fact_index) AS r FROM mentions) WHERE r = 1),
nodes AS (SELECT n.label, n.id, n.name, m.label AS normalized_name, m.match_type, CAST(m.score AS DOUBLE) AS match_score, n.label AS category
  FROM first_mentions n JOIN matches m ON m.entity_type = n.entity_type AND m.text = n.name),
edge_evidence AS (SELECT drug_id AS src_id, relation AS rel_type, CASE WHEN relation = 'IMPROVES' THEN outcome_id ELSE condition_id END AS dst_id,
    CASE relation WHEN 'ASSOCIATED_WITH_SE' THEN 'associated_with_side_effect' ELSE lower(relation) END AS label, load_seq, fact_index, span AS evidence, confidence, span AS source_text,
    source_id, section, sample_size, p_value, CAST(NULL AS VARCHAR) AS treatment_line, patient_subgroup, CAST(NULL AS VARCHAR) AS study_design, CAST(NULL AS VARCHAR) AS duration, CAST(NULL AS VARCHAR) AS dose,
    effect_size, CAST(NULL AS VARCHAR) AS confidence_interval, outcome
  FROM wide WHERE relation <> 'cures' AND (relation <> 'IMPROVES' OR outcome_id IS NOT NULL)),
edges AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY src_id, rel_type, dst_id ORDER BY load_seq DESC, fact_index DESC) AS r FROM edge_evidence) WHERE r = 1),
ends AS (SELECT e.*, s.name AS src_name, s.normalized_name AS src_label, t.name AS dst_name, t.normalized_name AS dst_label FROM edges e JOIN nodes s ON s.id = e.src_id JOIN nodes t ON t.id = e.dst_id)"""


def _any(column: str, parts: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _missing(term: str, longer: int) -> str:
    """No word of the term of more than so many characters stands in the span."""
    return f"len(list_filter(string_split(lower({term}), ' '), lambda w: length(w) > {longer} AND contains(lower(span), w))) = 0"


# --- documents ---


@query("SELECT item_id, trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9''\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM benchmark")
def surface_normalise(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select("item_id", surface("text").alias("key"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9''\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS key_md5 FROM documents")
def surface_documents(spark, sf_dir):
    """The lookup form of all whole texts."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(surface("text")).alias("key_md5"))


@query(r"""WITH parts AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)
SELECT doc_id, i - 1 AS sent_seq, trim(s[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM parts) WHERE sentence <> ''""")
def sentence_split(spark, sf_dir):
    found = sections.split_sentences(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.col("sent_seq").cast("long").alias("sent_seq"), "sentence")


@query("SELECT doc_id, CAST(1 AS BIGINT) AS anchored FROM documents WHERE trim(text) <> ''")
def sentence_offsets(spark, sf_dir):
    """Every sentence's offsets point at it."""
    found = sections.split_sentences(_table(spark, sf_dir, "documents"), ["doc_id", "text"])
    at = F.substr("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.groupBy("doc_id").agg(F.min((F.regexp_replace(at, r"(?U)^\s+|\s+$", "") == F.col("sentence")).cast("long")).alias("anchored"))


_SECTIONED = "SELECT doc_id, source, '# ' || CASE doc_id % 4 WHEN 0 THEN 'Background' WHEN 1 THEN 'Results :' WHEN 2 THEN 'Funding' ELSE '' END AS heading, text, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM documents"
_SECTION_SQL = f"""WITH d AS ({_SECTIONED}), s AS (
SELECT doc_id, 0 AS section_seq, 'Document' AS name, source AS text, 0 AS start_offset FROM d
UNION ALL SELECT doc_id, 1, CASE doc_id % 4 WHEN 0 THEN 'introduction' WHEN 1 THEN 'results' WHEN 2 THEN 'Funding' ELSE 'Section' END, body, instr(source || chr(10) || heading || chr(10) || text || chr(10) || '## Empty', body) - 1 FROM d WHERE body <> '')"""


def _sections(spark, sf_dir):
    heading = F.concat(F.lit("# "), F.element_at(F.array(F.lit("Background"), F.lit("Results :"), F.lit("Funding"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int")))
    made = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.concat_ws("\n", "source", heading, "text", F.lit("## Empty")).alias("markdown"))
    return sections.split_sections(made).withColumnRenamed("source_id", "doc_id")


@query(f"{_SECTION_SQL} SELECT doc_id, section_seq, name, md5(text) AS text_md5, start_offset, start_offset + length(text) AS end_offset FROM s")
def section_split(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "section_seq", "name", F.md5("text").alias("text_md5"), F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"))


@query(f"{_SECTION_SQL} SELECT doc_id, section_seq, length(substr(text, 1, 4000)) AS n, md5(substr(text, 1, 4000)) AS text_md5 FROM s WHERE lower(name) NOT IN {_in(vocab.SKIPPED_SECTIONS)} AND length(text) >= 50")
def section_eligibility(spark, sf_dir):
    kept = _sections(spark, sf_dir).where(eligible("name", "text")).withColumn("t", truncated("text"))
    return kept.select("doc_id", "section_seq", F.length("t").cast("long").alias("n"), F.md5("t").alias("text_md5"))


@query("SELECT page_id, CASE WHEN lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%' THEN substr(md5(url), 1, 12) ELSE url END AS source_id FROM pages")
def paper_ids(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", paper_id("url").alias("source_id"))


# The driver's pages have an article each; what is in it, tags off, by lines.
_HIDDEN = ["script", "style", "nav", "header", "footer", "aside", "noscript", "form", "template", "head"]
_ARTICLE = "regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '(?s)<!--.*?-->', '', 'g')"
for _tag in _HIDDEN:
    _ARTICLE = f"regexp_replace({_ARTICLE}, '(?s)<{_tag}[ >].*?</{_tag}>', '', 'g')"
_ARTICLE = f"regexp_replace({_ARTICLE}, '</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|blockquote)( [^>]*)?/?>', chr(10), 'g')"
_ARTICLE = f"regexp_replace({_ARTICLE}, '<[^>]*>', '', 'g')"
for _name, _sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("#39", "''"), ("nbsp", " "), ("amp", "&")):
    _ARTICLE = f"replace({_ARTICLE}, '&{_name};', '{_sign}')"
_ARTICLE = rf"array_to_string(list_filter(list_transform(string_split({_ARTICLE}, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10))"


@query(f"SELECT substr(md5(url), 1, 12) AS source_id, url, {_ARTICLE} AS text FROM pages")
def html_text(spark, sf_dir):
    return document_sources.page_documents(_table(spark, sf_dir, "pages"))


@query("SELECT DISTINCT source, CASE lower(trim(source, ' :')) WHEN 'abstract' THEN 'abstract' ELSE trim(source) END AS name FROM documents")
def section_names(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("source").distinct().select("source", section_name("source").alias("name"))


_TERMS_SQL = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS term FROM benchmark"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("term")).distinct()


@query(rf"""WITH t AS ({_TERMS_SQL}), w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents)
SELECT doc_id, term, count(*) AS n, count(*) AS n_anchored FROM w SEMI JOIN t ON t.term = w.term GROUP BY doc_id, term""")
def dictionary_words(spark, sf_dir):
    """The benchmark's words in all documents as whole words, and whether their offsets point at them."""
    docs = _table(spark, sf_dir, "documents")
    found = dictionary.find_terms(docs, _terms(spark, sf_dir), ["doc_id"], whole_words=True, written=True)
    there = F.lower("written") == F.col("term")
    return found.select("doc_id", "term", there.alias("there")).groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.count_if("there").alias("n_anchored"))


@query(f"WITH t AS ({_TERMS_SQL}) SELECT term, count(*) AS documents, CAST(sum((length(text) - length(replace(lower(text), term, ''))) // length(term)) AS BIGINT) AS least FROM t JOIN documents ON contains(lower(text), term) GROUP BY term")
def dictionary_substrings(spark, sf_dir):
    """The same words anywhere in the texts: documents that hold them, and occurrences that do not overlap."""
    found = dictionary.find_terms(_table(spark, sf_dir, "documents"), _terms(spark, sf_dir), ["doc_id"], apart=True)
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("least"))


# --- facts ---

_CLEAN_SQL = f"""{_FACTS} SELECT fact_index, drug_name, CASE lower(trim(condition_name)) WHEN 'mdd' THEN 'major depressive disorder' ELSE condition_name END AS condition_name, relation,
array_to_string(list_filter(side_effects, lambda s: lower(trim(s)) NOT IN {_in(vocab.INVALID_SIDE_EFFECTS)} AND length(s) <= 100), '|') AS side_effects, CASE WHEN sample_size BETWEEN 1 AND 100000 THEN sample_size END AS sample_size
FROM facts WHERE contains(lower(span), lower(drug_name)) AND (contains(lower(span), lower(condition_name)) OR {_any("lower(span)", vocab.CLINICAL_CONTEXT)} OR upper(relation) = 'ASSOCIATED_WITH_SE')
AND NOT regexp_matches(substr(lower(span), 1, 50), '^(it|this|that|these|they|those|which)\\s+(showed|demonstrated|resulted|found)') AND confidence BETWEEN 0 AND 1 AND p_value BETWEEN 0 AND 1"""


@query(_CLEAN_SQL)
def clean_facts(spark, sf_dir):
    kept = extraction.clean_facts(fixture.facts(spark, sf_dir))
    return kept.select("fact_index", "drug_name", "condition_name", "relation", F.array_join("side_effects", "|").alias("side_effects"), "sample_size")


@query(rf"""{_FACTS}, r AS (SELECT fact_index, CASE WHEN NOT contains(lower(span), lower(drug_name)) THEN 'drug_not_in_span'
WHEN NOT (contains(lower(span), lower(condition_name)) OR {_any("lower(span)", vocab.CLINICAL_CONTEXT)} OR upper(relation) = 'ASSOCIATED_WITH_SE') THEN 'condition_out_of_context'
WHEN regexp_matches(substr(lower(span), 1, 50), '^(it|this|that|these|they|those|which)\s+(showed|demonstrated|resulted|found)') THEN 'dangling_pronoun' END AS reason FROM facts)
SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1""")
def rejection_reasons(spark, sf_dir):
    return fixture.facts(spark, sf_dir).groupBy(F.coalesce(extraction.rejection(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_D, _C = "lower(trim(drug_name))", "lower(trim(condition_name))"
_NAMED = f"{_D} NOT IN {_in(vocab.PLACEHOLDER_DRUGS)} AND {_D} NOT IN {_in(vocab.GENERIC_DRUGS)}"
_NOT_OUTCOME = f"NOT {_any(_C, vocab.OUTCOME_WORDS)}"
_NOT_SYMPTOM = f"{_NOT_OUTCOME} AND {_C} NOT IN {_in(vocab.ISOLATED_SYMPTOMS)}"
_PLAUSIBLE = f"{_NOT_SYMPTOM} AND NOT {_any(_C, vocab.CONDITION_EXCLUSIONS)} AND {_C} NOT IN {_in(vocab.VALID_CONDITIONS)}"
_RELATED = "(" + " OR ".join(f"contains({_C}, '{c}') OR contains('{c}', {_C})" for c in vocab.VALID_CONDITIONS) + ")"
_RULES = [
    ("missing_required_field", "error", "confidence", "confidence = 0", True),
    ("placeholder_drug_name", "error", "drug_name", f"{_D} IN {_in(vocab.PLACEHOLDER_DRUGS)}", True),
    ("generic_drug_name", "error", "drug_name", f"{_D} IN {_in(vocab.GENERIC_DRUGS)}", True),
    ("unknown_drug", "info", "drug_name", f"{_NAMED} AND NOT {_any(_D, vocab.DRUG_PATTERNS)}", False),
    ("outcome_as_condition", "error", "condition_name", _any(_C, vocab.OUTCOME_WORDS), True),
    ("symptom_as_condition", "error", "condition_name", f"{_NOT_OUTCOME} AND {_C} IN {_in(vocab.ISOLATED_SYMPTOMS)}", True),
    ("invalid_condition_name", "error", "condition_name", f"{_NOT_SYMPTOM} AND {_any(_C, vocab.CONDITION_EXCLUSIONS)}", True),
    ("condition_name_variant", "info", "condition_name", f"{_PLAUSIBLE} AND {_RELATED}", False),
    ("unknown_condition", "info", "condition_name", f"{_PLAUSIBLE} AND NOT {_RELATED}", False),
    ("invalid_relation", "error", "relation", f"upper(trim(relation)) NOT IN {_in(vocab.RELATIONS)}", True),
    ("invalid_confidence_range", "error", "confidence", "confidence NOT BETWEEN 0 AND 1", True),
    ("drug_not_in_span", "warning", "span", f"NOT contains(lower(span), lower(drug_name)) AND {_missing('drug_name', 2)}", False),
    ("condition_not_in_span", "info", "span", f"length(condition_name) > 3 AND {_missing('condition_name', 3)}", False),
    ("vague_effect_size", "info", "effect_size", f"effect_size IS NOT NULL AND NOT regexp_matches(effect_size, '[0-9]') AND NOT {_any('lower(effect_size)', vocab.EFFECT_STATISTICS)}", False),
]
_SPAN = "lower(span)"
_TELLING = "list_filter(string_split(lower(drug_name), ' '), lambda w: length(w) > 3 AND w NOT IN " + _in(vocab.FILLER_WORDS) + ")"
_STRICT_RULES = [
    ("drug_not_in_span_strict", "error", "drug_name", f"len({_TELLING}) > 0 AND len(list_filter({_TELLING}, lambda w: contains(lower(span), w))) = 0", True),
    ("wrong_comparison_direction", "error", "relation", f"(relation = 'SUPERIOR_TO' AND {_any(_SPAN, vocab.COMPARISON_LANGUAGE['SUPERIOR_TO'])}) OR (relation = 'INFERIOR_TO' AND {_any(_SPAN, vocab.COMPARISON_LANGUAGE['INFERIOR_TO'])})", True),
    ("missing_equivalence_language", "warning", "relation", f"relation = 'EQUIVALENT_TO' AND NOT {_any(_SPAN, vocab.COMPARISON_LANGUAGE['EQUIVALENT_TO'])}", False),
    ("incomplete_span", "error", "span", "regexp_matches(lower(span), '^(it|this|that|these|they|those|which)\\s')", True),
    ("very_short_span", "warning", "span", "NOT regexp_matches(lower(span), '^(it|this|that|these|they|those|which)\\s') AND length(span) < 25", False),
]


def _issues_sql(rules: list[tuple]) -> str:
    parts = [f"SELECT fact_index, '{t}' AS issue_type, '{s}' AS severity, '{f}' AS field, CAST(NULL AS VARCHAR) AS detail, {str(fatal).lower()} AS fatal FROM facts WHERE {when}" for t, s, f, when, fatal in rules]
    parts.append(f"SELECT fact_index, 'unknown_side_effect', 'info', 'side_effects', s, false FROM (SELECT fact_index, unnest(side_effects) AS s FROM facts) WHERE lower(trim(s)) NOT IN {_in(vocab.COMMON_SIDE_EFFECTS)}")
    return f"{_FACTS}, issues AS ({' UNION ALL '.join(parts)})"


def _checked(spark, sf_dir, profile="default"):
    return validation.validate(fixture.facts(spark, sf_dir), profile)


@query(f"{_issues_sql(_RULES)} SELECT f.fact_index, NOT coalesce(bool_or(i.fatal), false) AS is_valid, count(i.issue_type) AS n_issues FROM facts f LEFT JOIN issues i ON i.fact_index = f.fact_index GROUP BY f.fact_index")
def validate_verdict(spark, sf_dir):
    return _checked(spark, sf_dir).select("fact_index", "is_valid", F.size("issues").cast("long").alias("n_issues"))


@query(f"{_issues_sql(_RULES)} SELECT fact_index, issue_type, severity, field, detail FROM issues")
def validate_issues(spark, sf_dir):
    return validation.issues(_checked(spark, sf_dir))


@query(f"{_issues_sql(_RULES + _STRICT_RULES)} SELECT fact_index, issue_type, severity, field, detail FROM issues")
def validate_strict(spark, sf_dir):
    return validation.issues(_checked(spark, sf_dir, "strict"))


@query(f"{_issues_sql(_RULES)} SELECT issue_type, severity, count(*) AS n_issues, count(DISTINCT fact_index) AS n_facts, array_to_string(list_slice(list_sort(list_distinct(list(fact_index))), 1, 3), ',') AS samples FROM issues GROUP BY ALL")
def issues_by_type(spark, sf_dir):
    return validation.issues_by_type(validation.issues(_checked(spark, sf_dir))).withColumn("samples", F.array_join("samples", ","))


@query(f"""{_issues_sql(_RULES)}, v AS (SELECT f.fact_index, any_value(f.source_id) AS source_id, coalesce(bool_or(i.fatal), false) AS bad, CAST(count_if(i.severity = 'warning') AS BIGINT) AS w, count(i.issue_type) AS k FROM facts f LEFT JOIN issues i ON i.fact_index = f.fact_index GROUP BY f.fact_index)
SELECT source_id, count(*) AS total_facts, CAST(count_if(NOT bad) AS BIGINT) AS valid_facts, CAST(count_if(bad) AS BIGINT) AS invalid_facts, CAST(sum(w) AS BIGINT) AS warnings, round(count_if(k = 0) * 100.0 / count(*), 6) AS clean_percent FROM v GROUP BY source_id""")
def validation_report(spark, sf_dir):
    return validation.validation_report(_checked(spark, sf_dir), "source_id").withColumn("clean_percent", F.round(F.col("clean_percent").cast("double"), 6))


# --- quality ---

_KEYWORDS = " OR ".join(f"(relation = '{r}' AND NOT {_any(_SPAN, k)})" for r, k in vocab.RELATION_KEYWORDS.items())
_SCORE = f"""100 - CASE WHEN {_missing("drug_name", 2)} THEN 30 ELSE 0 END - CASE WHEN {_missing("condition_name", 3)} AND len(list_filter(string_split(condition_name, ' '), lambda w: length(w) > 3)) > 0 THEN 10 ELSE 0 END
- CASE WHEN {_KEYWORDS} THEN 20 ELSE 0 END - CASE WHEN confidence < 0.6 THEN 15 ELSE 0 END - CASE WHEN length(span) < 20 THEN 10 ELSE 0 END - CASE WHEN {_any("lower(condition_name)", vocab.TREATMENT_WORDS)} THEN 50 ELSE 0 END"""
_KNOWN = " OR ".join(f"(contains(lower(drug_name), '{d}') AND contains(lower(condition_name), '{c}') AND relation = '{r}')" for d, c, r in vocab.KNOWN_PAIRS)
_ASSESSED = f"""{_FACTS}, scored AS (SELECT *, {_SCORE} AS raw, ({_KNOWN}) AS known FROM facts),
assessed AS (SELECT *, CASE WHEN known THEN (greatest(raw, 0) + 90) / 2.0 ELSE CAST(greatest(raw, 0) AS DOUBLE) END AS quality_score, raw >= 70 AS likely_correct FROM scored)"""


@query(f"{_ASSESSED} SELECT fact_index, CAST(greatest(raw, 0) AS DOUBLE) AS quality_score, raw >= 70 AS likely_correct FROM assessed")
def quality_heuristic(spark, sf_dir):
    return fixture.facts(spark, sf_dir).select("fact_index", quality.heuristic().alias("r")).select("fact_index", "r.*")


@query(f"{_ASSESSED} SELECT fact_index, CASE WHEN known THEN 90.0::DOUBLE END AS quality_score, CASE WHEN known THEN true END AS likely_correct FROM assessed")
def quality_kb(spark, sf_dir):
    return fixture.facts(spark, sf_dir).select("fact_index", quality.knowledge_base().alias("r")).select("fact_index", "r.*")


# With two votes one against one is a tie, which is not a majority.
@query(f"{_ASSESSED} SELECT fact_index, quality_score, likely_correct FROM assessed")
def quality_combined(spark, sf_dir):
    return quality.assess(fixture.facts(spark, sf_dir)).select("fact_index", "quality_score", "likely_correct")


@query(f"{_ASSESSED} SELECT source_id, count(*) AS total_facts, round(avg(quality_score), 6) AS average_quality_score, round(count_if(likely_correct) / count(*), 6) AS estimated_precision FROM assessed GROUP BY source_id")
def quality_report(spark, sf_dir):
    return quality.quality_report(quality.assess(fixture.facts(spark, sf_dir)), "source_id").withColumns({c: F.round(c, 6) for c in ("average_quality_score", "estimated_precision")})


@query(f"{_ASSESSED} SELECT source_id, count(*) AS total_facts, round(avg(quality_score), 6) AS average_quality_score, round(count_if(likely_correct) / count(*), 6) AS estimated_precision, CASE WHEN count_if(likely_correct) / count(*) >= 0.95 THEN 'SUCCESS' ELSE 'QUALITY_GATE_FAILED' END AS status FROM assessed WHERE quality_score >= 60 GROUP BY source_id")
def quality_gate(spark, sf_dir):
    gated = quality.gate(quality.assess(fixture.facts(spark, sf_dir)), threshold=0.95, min_score=60)
    return gated.withColumns({c: F.round(c, 6) for c in ("average_quality_score", "estimated_precision")})


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS similarity, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.5 AS likely_correct FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def quality_similarity(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = vectors.join(vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("span")), "vec_id")
    scored = pairs.select("vec_id", cosine(F.col("embedding"), F.col("span")).alias("c"), quality.similarity("embedding", "span").alias("r"))
    return scored.select("vec_id", F.round("c", 9).alias("similarity"), "r.likely_correct")


# Words and pairs of words at their places, weighted by rarity over claims and spans.
_GRAMS = "list_transform(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), lambda t: substr(md5(t), 1, 5))"


@query(f"""{_FACTS}, said AS (SELECT fact_index, 1 AS c, regexp_extract_all(lower(concat(drug_name, ' ', replace(relation, '_', ' '), ' ', condition_name)), '[a-z0-9]+') AS w FROM facts UNION ALL SELECT fact_index, 0, regexp_extract_all(lower(span), '[a-z0-9]+') FROM facts),
grams AS (SELECT fact_index, c, unnest({_GRAMS}) AS place FROM said), counts AS (SELECT fact_index, place, sum(c) AS c, sum(1 - c) AS s FROM grams GROUP BY ALL),
weights AS (SELECT place, ln((1 + (SELECT count(*) FROM said)) / (1 + sum(CAST(c > 0 AS INTEGER) + CAST(s > 0 AS INTEGER)))) + 1 AS weight FROM counts GROUP BY place),
sums AS (SELECT fact_index, sum(weight * weight * c * s) AS dot, sqrt(sum(weight * weight * c * c)) * sqrt(sum(weight * weight * s * s)) AS norm FROM counts JOIN weights USING (place) GROUP BY fact_index)
SELECT fact_index, round(CASE WHEN norm > 0 THEN dot / norm ELSE 0 END, 6) AS cosine, norm > 0 AND dot / norm > 0.5 AS likely_correct FROM sums""")
def claim_similarity(spark, sf_dir):
    """How near each fact's claim is to its span, by sparse vectors that no model makes."""
    scored = embedding.with_similarity(fixture.facts(spark, sf_dir))
    return scored.select("fact_index", F.round("cosine", 6).alias("cosine"), "similarity.likely_correct")


@query(f"{_FACTS} SELECT fact_index, drug_name, relation FROM facts ORDER BY md5('3:' || CAST(fact_index AS VARCHAR)), fact_index LIMIT 100")
def quality_sample(spark, sf_dir):
    return quality.sample(fixture.facts(spark, sf_dir), 100, seed=3).select("fact_index", "drug_name", "relation")


# --- linking ---


@query(f"{_LINKED} SELECT fact_index, slot, pos, text, CASE WHEN match_type IN ('exact', 'synonym') THEN concept_id END AS concept_id, CASE WHEN match_type IN ('exact', 'synonym') THEN match_type ELSE 'unmatched' END AS match_type FROM linked")
def link_exact(spark, sf_dir):
    found = linking.linked_slots(fixture.facts(spark, sf_dir), _keys(spark), fuzzy=False)
    return found.select("fact_index", "slot", F.col("pos").cast("long").alias("pos"), "text", "concept_id", "match_type")


@query(f"{_LINKED} SELECT DISTINCT entity_type, text, concept_id, label, match_type, round(CAST(score AS DOUBLE), 9) AS score FROM linked")
def link_fuzzy(spark, sf_dir):
    found = linking.linked_slots(fixture.facts(spark, sf_dir), _keys(spark))
    return found.select("entity_type", "text", "concept_id", "label", "match_type", F.round("score", 9).alias("score")).distinct()


_KEYS_SQL = ",\n".join(f"({', '.join(map(_sql, (e, k, *v)))})" for (e, k), v in _expected_keys().items())


@query(f"SELECT * FROM (VALUES {_KEYS_SQL}) t(entity_type, key, concept_id, label, provider, match_type, score)")
def concept_index(spark, sf_dir):
    return _keys(spark)


_SUMMARY = f"""{_LINKED}, ok AS (SELECT f.fact_index, coalesce(bool_and(l.match_type <> 'unmatched') FILTER (l.slot = 'drug'), true) AS drug, coalesce(bool_and(l.match_type <> 'unmatched') FILTER (l.slot = 'condition'), true) AS condition,
coalesce(bool_and(l.match_type <> 'unmatched') FILTER (l.slot = 'relation'), true) AS relation, coalesce(bool_and(l.match_type <> 'unmatched') FILTER (l.slot = 'outcome'), true) AS outcome, coalesce(bool_and(l.match_type <> 'unmatched') FILTER (l.slot = 'side_effect'), true) AS side_effects
FROM facts f LEFT JOIN linked l ON l.fact_index = f.fact_index GROUP BY f.fact_index)"""


@query(_SUMMARY + " UNION ALL ".join(f" SELECT '{s}' AS slot, CAST(count_if({s}) AS BIGINT) AS matched, CAST(count_if(NOT {s}) AS BIGINT) AS unmatched, count(*) AS total FROM ok" for s in ("drug", "condition", "relation", "outcome", "side_effects")))
def match_summary(spark, sf_dir):
    return linking.match_summary(_normalised(spark, sf_dir))


_OK_LONG = " UNION ALL ".join(f"SELECT fact_index, '{s}' AS slot, {s} AS good FROM ok" for s in ("drug", "condition", "relation", "outcome", "side_effects"))


@query(f"""{_SUMMARY}, long AS ({_OK_LONG})
SELECT source_id, section, slot, CAST(grouping(source_id, section, slot) AS INTEGER) AS level, CAST(count_if(good) AS BIGINT) AS matched, count(*) AS total FROM facts JOIN long ON long.fact_index = facts.fact_index
GROUP BY GROUPING SETS ((), (slot), (source_id), (source_id, slot), (source_id, section, slot))""")
def match_rollup(spark, sf_dir):
    return linking.match_rollup(_normalised(spark, sf_dir))


@query(f"{_SUMMARY} SELECT round(count_if(drug) / count(*), 9) AS drug_coverage FROM ok")
def drug_coverage(spark, sf_dir):
    return linking.drug_coverage(_normalised(spark, sf_dir)).withColumn("drug_coverage", F.round("drug_coverage", 9))


@query(f"""{_LINKED}, c AS (SELECT slot, text, count(*) AS n, min(fact_index * 1000 + pos) AS first FROM linked WHERE match_type = 'unmatched' AND slot <> 'relation' GROUP BY slot, text),
r AS (SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY n DESC, first, text) AS place, text, n, count(*) OVER (PARTITION BY slot) AS unique_terms, CAST(sum(n) OVER (PARTITION BY slot) AS BIGINT) AS total_terms FROM c)
SELECT * FROM r WHERE slot <> 'outcome' OR place <= 20""")
def unmatched_report(spark, sf_dir):
    return linking.unmatched_report(linking.linked_slots(fixture.facts(spark, sf_dir), _keys(spark))).withColumn("place", F.col("place").cast("long"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All words of the documents of five characters or more, dealt by their hash: concepts, and terms that are none."""
    words_ = _table(spark, sf_dir, "documents").select(F.explode(F.split(surface("text"), " ")).alias("key")).where(F.length("key") > 4).distinct()
    words_ = settle(words_, "words")  # both halves are read more than once
    dealt = words_.select(F.lit("drugs").alias("entity_type"), "key", (F.crc32("key") % 2 == 0).alias("known"))
    known = dealt.where("known").select("entity_type", "key", F.concat(F.lit("WORD:"), "key").alias("concept_id"), F.col("key").alias("label"), F.lit("custom").alias("provider"))
    return dealt.where("NOT known").drop("known"), known


@query()
def link_fuzzy_words(spark, sf_dir):
    """The fuzzy join where both sides are large: every word that is no concept to the most similar one that is."""
    terms, known = _halves(spark, sf_dir)
    return linking.link_fuzzy(terms, known).select("key", "known", F.round("score", 9).alias("score"))


# --- graph ---


@query(f"{_GRAPH} SELECT label, id, name, normalized_name, match_type, round(match_score, 9) AS match_score, category FROM nodes")
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].withColumn("match_score", F.round("match_score", 9))


@query(f"{_GRAPH} SELECT * FROM edges")
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(f"{_GRAPH} SELECT * FROM edge_evidence")
def edge_evidence(spark, sf_dir):
    return _graph(spark, sf_dir)[2]


@query(f"""{_GRAPH}, one AS (SELECT * FROM nodes), two AS (SELECT * FROM edges)
SELECT 'node' AS kind, label AS first, id AS second, '' AS third, name AS value FROM one UNION ALL SELECT 'edge', src_id, rel_type, dst_id, concat(load_seq, ':', fact_index) FROM two""")
def graph_in_loads(spark, sf_dir):
    """The graph loaded in pieces, out of order and with one load twice: what one load of all leaves."""
    store = graph.GraphStore(spark, f"{workspace(spark)}/graph-{uuid.uuid4().hex[:8]}")
    facts = settle(linking.normalise(settle(fixture.facts(spark, sf_dir), "facts"), _keys(spark)), "normalised")
    store.load(facts.where("load_seq >= 10").withColumn("span", F.lit("replaced below")))
    for part in ("load_seq < 10", "load_seq = 17", "load_seq >= 10"):
        store.load(facts.where(part))
    nodes, edges = (store.table(name) for name in ("nodes", "edges"))
    told = nodes.select(F.lit("node").alias("kind"), F.col("label").alias("first"), F.col("id").alias("second"), F.lit("").alias("third"), F.col("name").alias("value"))
    return told.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src_id").alias("first"), F.col("rel_type").alias("second"), F.col("dst_id").alias("third"), F.concat_ws(":", "load_seq", "fact_index").alias("value")))


_TOLD = """SELECT 'node' AS kind, label AS first, id AS second, '' AS third, name AS value FROM nodes UNION ALL SELECT 'edge', src_id, rel_type, dst_id, concat(load_seq, ':', fact_index, ':', evidence) FROM edges"""


@query(f"{_GRAPH} {_TOLD}")
def graph_from_stream(spark, sf_dir):
    """Facts as files that arrive out of order, one batch for some of them, two of them twice: the same graph as from one load."""
    path = f"{workspace(spark)}/stream-{uuid.uuid4().hex[:8]}"
    facts = settle(linking.normalise(settle(fixture.facts(spark, sf_dir), "facts"), _keys(spark)), "normalised")
    late = facts.withColumn("arrival", F.when(F.col("load_seq") % 7 == 3, 9).otherwise(F.pmod(-F.col("load_seq"), F.lit(4))).cast("int"))
    # Each task writes what it reads, by arrival: no task reads all of an arrival, and nothing is shuffled.
    late.write.partitionBy("arrival").parquet(f"{path}/in")
    late.where("load_seq in (2, 3)").withColumn("arrival", F.lit(1)).write.mode("append").partitionBy("arrival").parquet(f"{path}/in")
    files = max(3, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    stream = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in").drop("arrival")
    sink = upsert.WinnerSink(spark, f"{path}/graph")
    for running in upsert.follow_winners(stream, sink, f"{path}/checkpoint"):
        running.awaitTermination()
    nodes, edges = sink.nodes(), sink.edges()
    told = nodes.select(F.lit("node").alias("kind"), F.col("label").alias("first"), F.col("id").alias("second"), F.lit("").alias("third"), F.col("name").alias("value"))
    return told.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src_id").alias("first"), F.col("rel_type").alias("second"), F.col("dst_id").alias("third"), F.concat_ws(":", "load_seq", "fact_index", "evidence").alias("value")))


@query(f"{_GRAPH} SELECT 'nodes' AS counter, label AS name, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'relations', rel_type, count(*) FROM edge_evidence GROUP BY rel_type")
def load_counters(spark, sf_dir):
    facts = _normalised(spark, sf_dir)
    return graph.load_counters(facts, graph.edge_evidence(facts))


@query(f"{_GRAPH} SELECT src_id AS drug_id, rel_type, dst_id AS target_id, confidence FROM edges WHERE confidence < 0.6")
def low_confidence_edges(spark, sf_dir):
    return graph_reads.low_confidence(_graph(spark, sf_dir)[1])


@query(f"{_GRAPH} SELECT src_id, rel_type, dst_id, count(*) AS n FROM edge_evidence GROUP BY ALL HAVING count(*) > 1")
def duplicate_evidence(spark, sf_dir):
    return graph_reads.duplicates(_graph(spark, sf_dir)[2])


@query(f"{_GRAPH} SELECT label, count(*) AS n FROM nodes GROUP BY label")
def node_counts(spark, sf_dir):
    return graph_reads.node_counts(_graph(spark, sf_dir)[0])


@query(f"{_GRAPH} SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type")
def edge_counts(spark, sf_dir):
    return graph_reads.edge_counts(_graph(spark, sf_dir)[1])


@query(f"{_GRAPH} SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges")
def graph_totals(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph_reads.totals(nodes, edges)


@query(f"{_GRAPH} SELECT src_name, rel_type, dst_name, confidence FROM ends WHERE rel_type = 'FIRST_LINE_FOR' ORDER BY src_name, dst_name, confidence LIMIT 5")
def sample_edges(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph_reads.sample_edges(edges, nodes)


@query(f"{_GRAPH} SELECT src_name AS name, count(*) AS connections FROM ends GROUP BY src_name ORDER BY connections DESC, name LIMIT 10")
def top_connected_drugs(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph_reads.top_connected_drugs(edges, nodes)


@query(f"{_GRAPH} SELECT src_name AS drug, effect_size AS efficacy, confidence, sample_size AS n, source_id AS paper FROM ends WHERE rel_type = 'FIRST_LINE_FOR' AND contains(dst_label, 'depressive disorder') AND confidence > 0.8 ORDER BY confidence DESC, drug, paper, n LIMIT 10")
def first_line_treatments(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph_reads.first_line_treatments(edges, nodes)


@query(f"""{_GRAPH} SELECT a.dst_name AS target, count(*) AS first_reports, count(*) AS second_reports FROM ends a JOIN ends b ON a.dst_id = b.dst_id
WHERE a.rel_type = 'ASSOCIATED_WITH_SE' AND b.rel_type = 'ASSOCIATED_WITH_SE' AND a.src_name = 'escitalopram' AND b.src_name = 'venlafaxine' GROUP BY a.dst_name""")
def side_effect_comparison(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph_reads.shared_targets(edges, nodes, "escitalopram", "venlafaxine")


@query(f"{_GRAPH} SELECT src_name AS augmenting_drug, dst_name AS base_treatment, evidence, source_id AS paper FROM ends WHERE rel_type = 'AUGMENTS' AND patient_subgroup = 'treatment-resistant'")
def augmentation_pairs(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph_reads.augmentation_pairs(edges, nodes, "treatment-resistant")


@query(f"""{_GRAPH} SELECT e.source_id AS paper, e.section, e.evidence AS exact_text, e.confidence, e.study_design AS design, e.sample_size AS n, e.load_seq, e.fact_index FROM edge_evidence e JOIN nodes s ON s.id = e.src_id JOIN nodes t ON t.id = e.dst_id
WHERE e.rel_type = 'TREATS' AND s.name = 'escitalopram' AND contains(t.normalized_name, 'depress')""")
def fact_evidence(spark, sf_dir):
    nodes, _, evidence = _graph(spark, sf_dir)
    return graph_reads.fact_evidence(evidence, nodes, "escitalopram", "TREATS", "depress")


@query(f"{_GRAPH} SELECT DISTINCT 'label' AS kind, label AS name FROM nodes UNION ALL SELECT DISTINCT 'relation', rel_type FROM edges")
def schema_names(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph_reads.schema_names(nodes, edges)


_NODE_KEYS = ["id", "name", "normalized_name", "match_type", "match_score", "category"]


@query(_GRAPH + " UNION ALL ".join([f" SELECT DISTINCT 'label' AS kind, label AS name, '{c}' AS property FROM nodes WHERE {c} IS NOT NULL" for c in _NODE_KEYS] + [f" SELECT DISTINCT 'relation', rel_type, '{c}' FROM edges WHERE {c} IS NOT NULL" for c in ["label", *graph.EDGE_PROPERTIES]]))
def schema_properties(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph_reads.schema_properties(nodes, edges)


@query(f"{_GRAPH}, p AS (SELECT * FROM (SELECT label, id, name, row_number() OVER (PARTITION BY label ORDER BY id) AS r FROM nodes) WHERE r <= 3) SELECT p.label, p.id, p.name, e.rel_type, e.dst_id FROM p LEFT JOIN edges e ON e.src_id = p.id")
def schema_samples(spark, sf_dir):
    nodes, edges, _ = _graph(spark, sf_dir)
    return graph_reads.schema_samples(nodes, edges)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r}', 'Drug', '{'Outcome' if r == 'IMPROVES' else 'Condition'}')" for r in vocab.RELATIONS) + ") t(rel_type, source, target)")
def expected_schema(spark, sf_dir):
    return graph_reads.expected_schema(spark)


@query(f"""{_ASSESSED}, v AS (SELECT a.source_id, count(*) AS extracted, CAST(count_if(confidence BETWEEN 0 AND 1) AS BIGINT) AS valid, count_if(likely_correct) / count(*) AS p FROM assessed a GROUP BY a.source_id)
SELECT count(*) AS papers, CAST(count_if(p >= 0.7) AS BIGINT) AS succeeded, CAST(count_if(p < 0.7) AS BIGINT) AS gate_failed, CAST(0 AS BIGINT) AS failed, CAST(coalesce(sum(extracted) FILTER (p >= 0.7), 0) AS BIGINT) AS extracted, CAST(coalesce(sum(valid) FILTER (p >= 0.7), 0) AS BIGINT) AS valid, CAST(coalesce(sum(extracted) FILTER (p >= 0.7), 0) AS BIGINT) AS normalised, round(avg(p) FILTER (p >= 0.7), 6) AS mean_precision FROM v""")
def batch_summary(spark, sf_dir):
    assessed = quality.assess(fixture.facts(spark, sf_dir))
    counts = assessed.groupBy("source_id").agg(F.count("*").alias("extracted"), F.count_if(F.col("confidence").between(0, 1)).alias("valid"), F.count("*").alias("normalised"))
    return reports.batch_summary(quality.gate(assessed).join(counts, "source_id")).withColumn("mean_precision", F.round("mean_precision", 6))


# --- facts with nulls, blanks and values out of range ---

# A null name is the text "None" to the rules; what was null is kept beside it.
_ODD = f"""WITH odd AS ({fixture.ODD_DUCKDB}), facts AS (SELECT fact_index, coalesce(drug_name, 'None') AS drug_name, drug_name IS NULL AS no_drug, condition_name, coalesce(relation, 'None') AS relation,
coalesce(span, 'None') AS span, span IS NULL AS no_span, side_effects, side_effects IS NULL AS no_effects, effect_size, confidence AS raw, TRY_CAST(confidence AS DOUBLE) AS confidence, sample_size, p_value, treatment_line FROM odd)"""
_FILLED = {"drug_name": "drug_name <> ''", "condition_name": "condition_name <> ''"}
_ODD_RULES = [
    ("missing_required_field", "error", "drug_name", "no_drug OR trim(drug_name) = ''", True),
    ("missing_required_field", "error", "condition_name", "trim(condition_name) = ''", True),
    ("missing_required_field", "error", "relation", "trim(relation) = ''", True),
    ("missing_required_field", "error", "span", "no_span", True),
    ("missing_required_field", "error", "confidence", "raw IS NULL OR confidence = 0", True),
    ("drug_name_too_long", "warning", "drug_name", f"{_NAMED} AND length({_D}) > 100", False),
    ("missing_confidence", "error", "confidence", "raw IS NULL", True),
    ("invalid_confidence_type", "error", "confidence", "raw IS NOT NULL AND confidence IS NULL", True),
    ("invalid_side_effects_type", "warning", "side_effects", "no_effects", False),
    *((t, s, f, f"{_FILLED.get(f, 'true')} AND ({when})" + (" AND drug_name <> ''" if t == "drug_not_in_span" else ""), fatal) for t, s, f, when, fatal in _RULES if t != "missing_required_field"),
]


@query(_issues_sql(_ODD_RULES).replace(_FACTS, _ODD, 1) + " SELECT fact_index, issue_type, severity, field, detail FROM issues")
def validate_odd_facts(spark, sf_dir):
    return validation.issues(validation.validate(fixture.odd_facts(spark, sf_dir)))


@query(f"{_issues_sql(_ODD_RULES).replace(_FACTS, _ODD, 1)} SELECT count(*) AS total_facts, CAST(count_if(NOT bad) AS BIGINT) AS valid_facts, CAST(count_if(bad) AS BIGINT) AS invalid_facts, CAST(sum(w) AS BIGINT) AS warnings, round(count_if(k = 0) * 100.0 / count(*), 6) AS clean_percent FROM (SELECT f.fact_index, coalesce(bool_or(i.fatal), false) AS bad, CAST(count_if(i.severity = 'warning') AS BIGINT) AS w, count(i.issue_type) AS k FROM facts f LEFT JOIN issues i ON i.fact_index = f.fact_index GROUP BY f.fact_index)")
def odd_facts_report(spark, sf_dir):
    return validation.validation_report(validation.validate(fixture.odd_facts(spark, sf_dir))).withColumn("clean_percent", F.round(F.col("clean_percent").cast("double"), 6))


@query(f"""{_ODD} SELECT fact_index, CASE lower(trim(condition_name)) WHEN 'mdd' THEN 'major depressive disorder' ELSE condition_name END AS condition_name,
array_to_string(list_filter(coalesce(side_effects, []), lambda s: lower(trim(s)) NOT IN {_in(vocab.INVALID_SIDE_EFFECTS)}), '|') AS side_effects, CASE WHEN sample_size BETWEEN 1 AND 100000 THEN sample_size END AS sample_size,
CASE WHEN lower(trim(treatment_line)) IN {_in(vocab.TREATMENT_LINES)} THEN lower(trim(treatment_line)) END AS treatment_line
FROM facts WHERE trim(drug_name) <> '' AND condition_name <> '' AND span <> '' AND contains(lower(span), lower(trim(drug_name))) AND (contains(lower(span), lower(condition_name)) OR {_any("lower(span)", vocab.CLINICAL_CONTEXT)} OR upper(relation) = 'ASSOCIATED_WITH_SE')
AND NOT regexp_matches(substr(lower(span), 1, 50), '^(it|this|that|these|they|those|which)\\s+(showed|demonstrated|resulted|found)') AND confidence BETWEEN 0 AND 1 AND p_value BETWEEN 0 AND 1""")
def clean_odd_facts(spark, sf_dir):
    numeric = fixture.odd_facts(spark, sf_dir).withColumn("confidence", F.col("confidence").try_cast("double"))
    kept = extraction.clean_facts(numeric)
    return kept.select("fact_index", "condition_name", F.array_join("side_effects", "|").alias("side_effects"), "sample_size", "treatment_line")


# --- what the commands write, and small reports ---


@query(f"""{_issues_sql(_RULES)}, v AS (SELECT f.fact_index, coalesce(bool_or(i.fatal), false) AS bad FROM facts f LEFT JOIN issues i ON i.fact_index = f.fact_index GROUP BY f.fact_index)
SELECT 'valid' AS part, '' AS issue_type, '' AS severity, count(*) AS n, CAST(sum(fact_index) AS BIGINT) AS places FROM v WHERE NOT bad UNION ALL SELECT 'issues', issue_type, severity, count(*), CAST(sum(fact_index) AS BIGINT) FROM issues GROUP BY issue_type, severity""")
def validated_files(spark, sf_dir):
    """Valid facts and issues by type, written and read back from their folders."""
    path = f"{workspace(spark)}/validated-{uuid.uuid4().hex[:8]}"
    fact_sources.write_validated(settle(_checked(spark, sf_dir), "checked"), path)
    count = [F.count("*").alias("n"), F.sum("fact_index").alias("places")]
    valid = spark.read.parquet(f"{path}/validated").agg(*count).select(F.lit("valid").alias("part"), F.lit("").alias("issue_type"), F.lit("").alias("severity"), "n", "places")
    found = spark.read.schema("fact_index long, severity string, issue_type string").json(f"{path}/issues").groupBy("issue_type", "severity").agg(*count)
    return valid.unionByName(found.select(F.lit("issues").alias("part"), "issue_type", "severity", "n", "places"))


@query(f"{_ASSESSED}, r AS (SELECT source_id, count(*) AS total_facts, count_if(likely_correct) / count(*) AS p FROM assessed GROUP BY source_id) SELECT source_id, total_facts, round(p, 6) AS estimated_precision, round(total_facts / 10 * 0.01, 6) AS judge_cost, p < 0.95 AS refused FROM r")
def quality_files(spark, sf_dir):
    """The report of each paper as a file and a table by paper, read back; what a judge would cost, and what the gate of the command refuses."""
    path = f"{workspace(spark)}/quality-{uuid.uuid4().hex[:8]}"
    report = settle(quality.quality_report(quality.assess(fixture.facts(spark, sf_dir)), "source_id"), "report")
    fact_sources.write_report(report.select("source_id", "total_facts"), f"{path}/report")
    fact_sources.write_table(report.select("source_id", "estimated_precision"), f"{path}/table", "source_id")
    back = spark.read.schema("source_id string, total_facts long").json(f"{path}/report").join(spark.read.parquet(f"{path}/table"), "source_id")
    refused = F.col("estimated_precision") < 0.95
    return back.select("source_id", "total_facts", F.round("estimated_precision", 6).alias("estimated_precision"), F.round(reports.judge_cost(F.col("total_facts")), 6).alias("judge_cost"), refused.alias("refused"))


_SIZE = "CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024) ELSE printf('%.1f MB', b / 1048576) END"


@query(f"SELECT doc_id, {_SIZE} AS size FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * (1 + doc_id % 700) AS b FROM documents)")
def readable_sizes(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", readable_size(F.col("n_chars") * (1 + F.col("doc_id") % 700)).alias("size"))


@query(r"""WITH w AS (SELECT doc_id, lower(text) AS low, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words FROM documents)
SELECT doc_id, CASE WHEN len(words) = 0 THEN NULL ELSE words[1] END AS term, len(words) > 0 AND contains(low, words[len(words) // 2 + 1][1:2]) AS anywhere, len(words) > 0 AND list_contains(words, words[len(words) // 2 + 1][1:2]) AS as_word FROM w""")
def whole_word_containment(spark, sf_dir):
    """Whether the first two letters of a document's middle word stand in it, anywhere and as a word of their own."""
    words_ = _table(spark, sf_dir, "documents").withColumn("words", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    middle = F.substring(F.try_element_at("words", (F.floor(F.size("words") / 2) + 1).cast("int")), 1, 2)
    return words_.select("doc_id", F.try_element_at("words", F.lit(1)).alias("term"), contains_term("text", middle).alias("anywhere"), contains_term("text", middle, whole_words=True).alias("as_word"))


@query(f"{_FACTS} SELECT fact_index, drug_name, confidence FROM facts ORDER BY fact_index LIMIT 10")
def fact_preview(spark, sf_dir):
    return reports.preview(fixture.facts(spark, sf_dir), ["drug_name", "not there", "confidence"])


# --- papers end to end, and files ---

_PAPER_DRUGS, _PAPER_CONDITIONS = ["sertraline", "escitalopram", "fluoxetine"], ["major depressive disorder", "generalized anxiety disorder", "drug abuse"]
_PAPERS = f"""WITH p AS (SELECT p_partkey AS load_seq, concat('part_', CAST(p_partkey AS STRING)) AS source_id, CASE p_partkey % 3 WHEN 0 THEN '{_PAPER_DRUGS[0]}' WHEN 1 THEN '{_PAPER_DRUGS[1]}' ELSE '{_PAPER_DRUGS[2]}' END AS drug,
CASE p_partkey % 4 WHEN 0 THEN '{_PAPER_CONDITIONS[0]}' WHEN 1 THEN '{_PAPER_CONDITIONS[1]}' WHEN 2 THEN '{_PAPER_CONDITIONS[2]}' ELSE 'nothing that is known' END AS condition FROM part)"""


def _paper_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a paper: two facts that count, and the references, which do not.  The table has few bytes, each paper much
    work: they are dealt over all shuffle partitions."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _table(spark, sf_dir, "part").select("p_partkey").repartition(parts, "p_partkey").createOrReplaceTempView("part")
    told = lambda n: f"concat(drug, ' was an effective treatment of ', condition, ' in trial {n} of paper ', CAST(load_seq AS STRING), '.')"
    return spark.sql(f"{_PAPERS} SELECT source_id, load_seq, concat('# Results\n', {told(1)}, '\n## Zzz\n', {told(2)}, '\n# References\n', {told(3)}) AS markdown FROM p")


def _papers(spark: SparkSession, sf_dir: str):
    docs = _paper_texts(spark, sf_dir)
    return evidence.process_papers(docs, extraction.DictionaryExtractor(_PAPER_DRUGS, _PAPER_CONDITIONS), ontology.concepts(spark, ontology.EXAMPLE))


_RUNS = f"""{_PAPERS}, r AS (SELECT *, CASE WHEN load_seq % 4 = 3 THEN 0 ELSE 2 END AS n, load_seq % 4 < 2 AS ok FROM p)"""


@query(f"{_RUNS} SELECT source_id, CASE WHEN ok THEN 'SUCCESS' ELSE 'QUALITY_GATE_FAILED' END AS status, CAST(n AS BIGINT) AS extracted, CAST(CASE WHEN ok THEN 2 ELSE 0 END AS BIGINT) AS valid, CAST(CASE WHEN ok THEN 2 ELSE 0 END AS BIGINT) AS normalised, CASE WHEN ok THEN 1.0::DOUBLE END AS estimated_precision, CASE WHEN ok THEN 100.0::DOUBLE END AS average_quality_score FROM r")
def paper_runs(spark, sf_dir):
    return _papers(spark, sf_dir).runs


def _read_but_some(frames):
    """A converter that cannot read every tenth paper."""
    for frame in frames:
        if (frame["load_seq"] % 10 == 3).any():
            raise ValueError("no text")
        yield frame


class _Flaky:
    """Raises at the first attempts for a paper, as many as its number says, and for some always."""

    def __init__(self, inner: extraction.Extractor) -> None:
        self.inner = inner

    def __call__(self, frames):
        for frame in frames:
            if frame["attempt"].iloc[0] <= int(frame["source_id"].iloc[0].split("_")[1]) % 5:
                raise TimeoutError("no answer")
            yield from self.inner(iter([frame]))


@query(f"""{_RUNS}, f AS (SELECT *, load_seq % 10 = 3 AS failed, load_seq % 5 AS k FROM r)
SELECT source_id, CASE WHEN failed THEN 'FAILED' WHEN ok AND k < 3 THEN 'SUCCESS' ELSE 'QUALITY_GATE_FAILED' END AS status, CASE WHEN failed THEN 'ValueError: no text' END AS error, CAST(CASE WHEN failed OR k >= 3 THEN 0 ELSE n END AS BIGINT) AS extracted,
CAST(CASE WHEN NOT failed THEN least(k + 1, 3) END AS INTEGER) AS attempts, CASE WHEN NOT failed AND k >= 3 THEN 'TimeoutError: no answer' END AS last_error FROM f""")
def paper_attempts(spark, sf_dir):
    """Papers of which some cannot be read, by an extractor that answers some sections late or never: the others are done."""
    docs = document_sources.tried(_paper_texts(spark, sf_dir), _read_but_some, "source_id string, load_seq long, markdown string", "source_id")
    stages = evidence.process_papers(docs, _Flaky(extraction.DictionaryExtractor(_PAPER_DRUGS, _PAPER_CONDITIONS)), ontology.concepts(spark, ontology.EXAMPLE))
    tries = stages.attempts.groupBy("source_id").agg(F.max("attempts").alias("attempts"), F.max("error").alias("last_error"))
    return stages.runs.join(tries, "source_id", "left").select("source_id", "status", "error", "extracted", "attempts", "last_error")


@query(f"{_RUNS} SELECT count(*) AS papers, CAST(count_if(ok) AS BIGINT) AS succeeded, CAST(count_if(NOT ok) AS BIGINT) AS gate_failed, CAST(0 AS BIGINT) AS failed, CAST(2 * count_if(ok) AS BIGINT) AS extracted, CAST(2 * count_if(ok) AS BIGINT) AS valid, CAST(2 * count_if(ok) AS BIGINT) AS normalised, 1.0::DOUBLE AS mean_precision FROM r")
def paper_summary(spark, sf_dir):
    return reports.batch_summary(_papers(spark, sf_dir).runs)


# The last paper's second fact is the edge; every edge's proof is two facts for each paper.
@query(f"""{_RUNS}, k AS (SELECT drug, condition, max(load_seq) AS last, count(*) AS n FROM r WHERE ok GROUP BY drug, condition)
SELECT drug, condition, concat('part_', CAST(last AS STRING)) AS source_id, 'Zzz' AS section, concat(drug, ' was an effective treatment of ', condition, ' in trial 2 of paper ', CAST(last AS STRING), '.') AS evidence, CAST(1 AS BIGINT) AS fact_index, CAST(2 * n AS BIGINT) AS facts FROM k""")
def paper_graph(spark, sf_dir):
    nodes, edges, proof = evidence.graph_tables(_papers(spark, sf_dir).normalised)
    side = lambda label, end: nodes.where(F.col("label") == label).select(F.col("id").alias(end), F.col("name").alias(label.lower()))
    counted = proof.groupBy("src_id", "rel_type", "dst_id").agg(F.count("*").alias("facts"))
    found = edges.drop("label").join(counted, ["src_id", "rel_type", "dst_id"]).join(side("Drug", "src_id"), "src_id").join(side("Condition", "dst_id"), "dst_id")
    return found.select("drug", "condition", "source_id", "section", "evidence", "fact_index", "facts")


@query(f"{_FACTS} SELECT fact_index // 500 AS file, fact_index % 500 AS fact_index, drug_name, relation, confidence, array_to_string(side_effects, '|') AS side_effects, outcome, sample_size FROM facts")
def fact_files(spark, sf_dir):
    """Facts written as wrapped files of 500, compressed, and read back; their numbers are places in the files."""
    path = f"{workspace(spark)}/fact-files-{uuid.uuid4().hex[:8]}"
    made = fixture.facts(spark, sf_dir).withColumn("file", fixture.file_number())
    fact_sources.write_wrapped(made, path, "extracted_facts", by="file", compression="gzip")
    back = fact_sources.read_facts(spark, f"{path}/file=*")
    file = F.regexp_extract("origin", "file=([0-9]+)", 1).cast("long")
    return back.select(file.alias("file"), "fact_index", "drug_name", "relation", "confidence", F.array_join("side_effects", "|").alias("side_effects"), "outcome", "sample_size")


# Facts whose values are of any type, by DuckDB's JSON functions.  A missing name is empty, a null one the text "None".
_TYPE = "coalesce(json_type(fact, '$.{c}'), 'none')"
_VALUE = "json_extract_string(fact, '$.{c}')"
_ITEM = "coalesce(CASE json_type(x) WHEN 'VARCHAR' THEN json_extract_string(x, '$') WHEN 'NULL' THEN {null} ELSE CAST(x AS VARCHAR) END, {null})"
_MIXED = f"""WITH mixed AS ({fixture.MIXED_DUCKDB}), kinds AS (SELECT fact_index, fact, {", ".join(f"{_TYPE.format(c=c)} AS {c}_kind, {_VALUE.format(c=c)} AS {c}_text" for c in ("drug_name", "confidence", "side_effects", "sample_size", "effect_size"))},
  CAST(json_extract(fact, '$.side_effects') AS JSON) AS effects, {_VALUE.format(c="condition_name")} AS condition_name, {_VALUE.format(c="relation")} AS relation, {_VALUE.format(c="span")} AS span FROM mixed),
facts AS (SELECT fact_index, CASE drug_name_kind WHEN 'none' THEN '' WHEN 'NULL' THEN 'None' ELSE drug_name_text END AS drug_name, drug_name_kind IN ('none', 'NULL') AS no_drug, condition_name, relation, span,
  confidence_kind, CASE WHEN confidence_kind = 'VARCHAR' THEN TRY_CAST(replace(trim(confidence_text), '_', '') AS DOUBLE) WHEN confidence_kind = 'BOOLEAN' THEN CAST(confidence_text = 'true' AS INTEGER) WHEN confidence_kind IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(confidence_text AS DOUBLE) END AS confidence,
  CASE WHEN confidence_kind IN ('none', 'NULL') THEN true WHEN confidence_kind = 'VARCHAR' THEN trim(confidence_text) = '' WHEN confidence_kind IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(confidence_text AS DOUBLE) = 0 ELSE false END AS no_confidence,
  side_effects_kind NOT IN ('ARRAY', 'none') AS no_list, CASE WHEN side_effects_kind = 'ARRAY' THEN list_transform(CAST(effects AS JSON[]), lambda x: {_ITEM.format(null="'None'")}) ELSE [] END AS side_effects,
  CASE WHEN side_effects_kind = 'ARRAY' THEN array_to_string(list_transform(CAST(effects AS JSON[]), lambda x: {_ITEM.format(null="NULL")}), '|') WHEN side_effects_kind IN ('none', 'NULL') OR side_effects_text = '0' THEN '' ELSE side_effects_text END AS effects_text,
  CASE WHEN effect_size_kind IN ('none', 'NULL') OR effect_size_text = 'false' THEN NULL ELSE effect_size_text END AS effect_size,
  CASE WHEN sample_size_kind = 'VARCHAR' THEN TRY_CAST(CASE WHEN regexp_full_match(sample_size_text, '[0-9]+') THEN sample_size_text END AS INTEGER) WHEN sample_size_kind = 'BOOLEAN' THEN 1 WHEN sample_size_kind <> 'NULL' THEN CAST(trunc(CAST(sample_size_text AS DOUBLE)) AS INTEGER) END AS sample_size,
  CASE WHEN json_type(fact, '$.arm') IS NULL THEN '' ELSE 'arm' END AS extra FROM kinds)"""
_MIXED_RULES = [
    ("missing_required_field", "error", "drug_name", "no_drug", True),
    ("missing_required_field", "error", "confidence", "no_confidence", True),
    ("missing_confidence", "error", "confidence", "confidence_kind IN ('none', 'NULL')", True),
    ("invalid_confidence_type", "error", "confidence", "confidence_kind NOT IN ('none', 'NULL') AND confidence IS NULL", True),
    ("invalid_side_effects_type", "warning", "side_effects", "no_list", False),
    *((t, s, f, f"{_FILLED.get(f, 'true')} AND ({when})" + (" AND drug_name <> ''" if t == "drug_not_in_span" else ""), fatal) for t, s, f, when, fatal in _RULES if t != "missing_required_field"),
]


def _mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact files of 500, compressed, every other one a bare list, the others wrapped, with a first wrapper that holds no list; read back."""
    path = f"{workspace(spark)}/mixed-files-{uuid.uuid4().hex[:8]}"
    lines = fixture.mixed_facts(spark, sf_dir).groupBy(fixture.file_number().alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_index", "fact"))), lambda x: x["fact"]), ", ").alias("facts"))
    text = F.when(F.col("file") % 2 == 0, F.concat(F.lit("["), "facts", F.lit("]"))).otherwise(F.concat(F.lit('{"triples": 3, "validated_facts": ['), "facts", F.lit("]}")))
    with sorted_groups(spark):
        lines.select("file", text.alias("value")).write.partitionBy("file").text(path, compression="gzip")
    back = fact_sources.read_facts(spark, f"{path}/file=*")
    return back.withColumn("file", F.regexp_extract("origin", "file=([0-9]+)", 1).cast("long"))


@query(f"""{_issues_sql(_MIXED_RULES).replace(_FACTS, _MIXED, 1)}, told AS (SELECT fact_index, bool_or(fatal) AS bad, string_agg(issue_type, ',' ORDER BY issue_type) AS types FROM issues GROUP BY fact_index)
SELECT f.fact_index // 500 AS file, f.fact_index % 500 AS fact_index, CASE WHEN drug_name = 'None' THEN NULL ELSE drug_name END AS drug_name, confidence, sample_size, effects_text AS side_effects, extra, NOT coalesce(bad, false) AS is_valid, coalesce(types, '') AS issue_types FROM facts f LEFT JOIN told t ON t.fact_index = f.fact_index""")
def mixed_fact_files(spark, sf_dir):
    """Values of all types through fact files: what they are read as, and what the rules say of the fact as it was written."""
    checked = validation.validate(_mixed_files(spark, sf_dir))
    types = F.array_join(F.sort_array(F.transform("issues", lambda i: i["issue_type"])), ",")
    return checked.select("file", "fact_index", "drug_name", "confidence", "sample_size", F.array_join("side_effects", "|").alias("side_effects"), F.array_join(F.map_keys("extra"), ",").alias("extra"), "is_valid", types.alias("issue_types"))


@query("SELECT concat('item_', CAST(item_id AS VARCHAR)) AS source_id, 'introduction' AS name, md5(trim(text)) AS text_md5, CAST(13 AS BIGINT) AS start_offset, length(text) + 13 AS full_length, true AS parsed FROM benchmark WHERE trim(text) <> ''")
def parsed_files(spark, sf_dir):
    """Parsed documents written as JSON, one folder for each, and read back."""
    path = f"{workspace(spark)}/parsed-{uuid.uuid4().hex[:8]}"
    docs = _table(spark, sf_dir, "benchmark").where(F.trim("text") != "").select(F.concat(F.lit("item_"), F.col("item_id").cast("string")).alias("source_id"), F.concat(F.lit("# Background\n"), "text").alias("markdown"))
    document_sources.write_parsed(sections.parsed_documents(docs), path)
    back = document_sources.read_parsed(spark, path).select(F.regexp_extract(F.input_file_name(), "source_id=([^/]+)", 1).alias("source_id"), F.length("full_text").alias("full_length"), F.col("_corrupt_record").isNull().alias("parsed"), F.explode("sections").alias("s"))
    return back.select("source_id", "s.name", F.md5("s.text").alias("text_md5"), F.col("s.start_offset").cast("long").alias("start_offset"), F.col("full_length").cast("long").alias("full_length"), "parsed")


@query(f"SELECT * FROM (VALUES {_KEYS_SQL}) t(entity_type, key, concept_id, label, provider, match_type, score)")
def ontology_file(spark, sf_dir):
    """The ontology written as a file and read back into its index."""
    path = f"{workspace(spark)}/ontology-{uuid.uuid4().hex[:8]}.json"
    spark.createDataFrame([(json.dumps(ontology.EXAMPLE),)], "value string").coalesce(1).write.text(path)
    return linking.concept_keys(ontology.concepts(spark, ontology.read_config(spark, path)))
