"""Synthetic facts over the driver's ``lineitem`` table, one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.indexing import ordinal

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
DRUGS = ["sertraline", "Zoloft", "escitalopram", "fluoxetin", "TCAs", "medication", "n/a", "novel agent", "Prozac", "venlafaxine", "cognitive behavioral therapy", "buspirone"]
CONDITIONS = ["major depressive disorder", "MDD", "depression", "symptom remission", "insomnia", "treatment-resistant depression", "generalized anxiety disorder", "severe major depressive disorder", "chronic migraine"]
RELATIONS = ["TREATS", "IMPROVES", "ASSOCIATED_WITH_SE", "AUGMENTS", "CONTRAINDICATED_FOR", "SUPERIOR_TO", "EQUIVALENT_TO", "INFERIOR_TO", "PREVENTS_RELAPSE_IN", "FIRST_LINE_FOR", "MAINTENANCE_FOR", "WELL_TOLERATED_IN", "EFFECTIVE_IN_SUBGROUP", "cures"]
OUTCOMES = ["remission rate"]
SIDE_EFFECTS = ["nausea", "headache", "side effects", "vivid dreaming"]


def _case(expression: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expression} % {len(values)} {whens} END"


def facts_sql(rows: str, side_effects: str) -> str:
    """``rows`` is a relation with lineitem's columns and fact_index."""
    return f"""
SELECT fact_index, load_seq, concat('paper_', CAST(load_seq AS STRING)) AS source_id,
  CASE l_returnflag WHEN 'A' THEN 'results' WHEN 'N' THEN 'discussion' ELSE 'abstract' END AS section,
  drug_name, condition_name, relation,
  CASE WHEN relation = 'IMPROVES' AND l_quantity < 40 THEN 'remission rate' END AS outcome,
  {side_effects} AS side_effects,
  CASE WHEN l_tax < 0.03 THEN '42% vs 28%' WHEN l_tax < 0.05 THEN 'large' END AS effect_size,
  CAST(CAST(ROUND((1 - l_discount * 6) * 100) AS INT) / 100.0 AS DOUBLE) AS confidence,
  CASE WHEN l_quantity < 5 THEN 'It showed benefit.'
       WHEN l_quantity < 15 THEN concat('Patients on ', drug_name, ' improved.')
       WHEN l_quantity < 30 THEN concat(drug_name, ' was effective for ', condition_name, ' versus placebo.')
       WHEN l_quantity < 40 THEN concat('Results were similar for ', condition_name, ' across arms.')
       ELSE concat(drug_name, ' was better than control in ', condition_name, ', with adverse events.') END AS span,
  CAST(l_quantity AS INT) * 25 AS sample_size, l_tax AS p_value,
  CASE WHEN l_quantity < 25 THEN 'treatment-resistant' END AS patient_subgroup
FROM (SELECT CAST(fact_index AS BIGINT) AS fact_index, l_orderkey % 20 AS load_seq, l_quantity, l_discount, l_tax, l_returnflag,
    {_case("l_partkey", DRUGS)} AS drug_name, {_case("l_suppkey", CONDITIONS)} AS condition_name,
    {_case("(l_orderkey + l_linenumber)", RELATIONS)} AS relation
  FROM {rows}) v"""


#: Facts of one file.
FILE_FACTS = 500


def file_number() -> Column:
    return F.floor(F.col("fact_index") / FILE_FACTS)


def facts(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    """``by_file``: a file's facts lie in one partition, in order.  Their lines are dealt, before the texts are made of them: as facts
    they would fill several times the disk."""
    lines = ordinal(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", ORDER, "fact_index")
    if by_file:
        lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), file_number()).sortWithinPartitions(file_number(), "fact_index")
    listed = "CASE WHEN l_quantity < 10 THEN array('nausea', 'headache') WHEN l_quantity < 20 THEN array('side effects', 'vivid dreaming') ELSE CAST(array() AS array<string>) END"
    made = spark.sql(facts_sql("{lines}", listed), lines=lines)
    return made.withColumn("confidence_interval", F.lit(None).cast("string"))


FACTS_DUCKDB = facts_sql(
    f"(SELECT *, row_number() OVER (ORDER BY {', '.join(ORDER)}) - 1 AS fact_index FROM lineitem)",
    "CASE WHEN l_quantity < 10 THEN ['nausea', 'headache'] WHEN l_quantity < 20 THEN ['side effects', 'vivid dreaming'] ELSE CAST([] AS VARCHAR[]) END",
)

#: Facts with what the plain ones never have, by the remainder of their number: nulls, blanks, values out of range or of another kind.
ODD_PARTS = 13


def odd_facts_sql(rows: str, no_effects: str) -> str:
    """``rows`` has the columns of the plain facts; ``confidence`` becomes a text, as a careless file has it."""
    when = lambda k, value, column: f"CASE WHEN fact_index % {ODD_PARTS} = {k} THEN {value} ELSE {column} END"
    confidence = f"CASE WHEN fact_index % {ODD_PARTS} = 5 THEN NULL WHEN fact_index % {ODD_PARTS} = 6 THEN 'high' WHEN fact_index % {ODD_PARTS} = 7 THEN '1.2' ELSE CAST(confidence AS STRING) END"
    size = f"CASE WHEN fact_index % {ODD_PARTS} = 9 THEN 0 WHEN fact_index % {ODD_PARTS} = 10 THEN 200000 ELSE sample_size END"
    line = f"CASE fact_index % {ODD_PARTS} WHEN 9 THEN ' First ' WHEN 10 THEN 'third' WHEN 11 THEN 'acute' END"
    drug = f"CASE WHEN fact_index % {ODD_PARTS} = 0 THEN NULL WHEN fact_index % {ODD_PARTS} = 12 THEN concat(drug_name, ' {'with sertraline ' * 7}') ELSE drug_name END"
    return f"""SELECT fact_index, load_seq, source_id, section, {drug} AS drug_name, {when(1, "''", "condition_name")} AS condition_name, {when(2, "'  '", "relation")} AS relation,
  outcome, {when(4, no_effects, "side_effects")} AS side_effects, effect_size, {confidence} AS confidence, {when(3, "NULL", "span")} AS span, {size} AS sample_size, p_value, {line} AS treatment_line FROM {rows}"""


def odd_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(odd_facts_sql("{plain}", "CAST(NULL AS array<string>)"), plain=facts(spark, sf_dir))


ODD_DUCKDB = odd_facts_sql(f"({FACTS_DUCKDB})", "NULL")


#: Facts as careless files have them: each value of the type that its number deals it, some fields missing, some more than known.
_LOOSE = {
    "drug_name": (11, ['["sertraline"]', "7", None, "null"]),
    "confidence": (13, ['"0.8"', '"high"', "true", "[0.5]", '"1.7"', "null", "0", '""', '"0"', None, '" 1_0e-1 "']),
    "side_effects": (7, ['"nausea"', '["nausea", 7, null, "odd", ""]', "null", '{"a": 1}', None, "0"]),
    "sample_size": (9, ["485.7", '"485"', '"485.7"', "true", "0", "null"]),
    "effect_size": (5, ["0.4", "false", '"large"', "null"]),
    "arm": (3, ['"open"']),
}


def _mixed_fact() -> str:
    """A fact as a JSON text, the same in Spark and DuckDB."""
    plain = {"drug_name": """concat('"', drug_name, '"')""", "confidence": "CAST(confidence AS STRING)", "side_effects": "'[]'", "sample_size": "CAST(sample_size AS STRING)", "effect_size": "'\"42% vs 28%\"'", "arm": "''"}

    def field(name: str) -> str:
        n, values = _LOOSE[name]
        key = lambda v: f"""concat(', "{name}": ', {v})"""
        whens = " ".join(f"WHEN {i} THEN " + ("''" if v is None else key(f"'{v}'")) for i, v in enumerate(values))
        return f"CASE fact_index % {n} {whens} ELSE {key(plain[name]) if name != 'arm' else plain[name]} END"

    always = """concat('{"condition_name": "', condition_name, '", "relation": "', relation, '", "span": "', span, '", "source_id": "', source_id, '", "section": "', section, '"'"""
    return f"{always}, {', '.join(map(field, _LOOSE))}, '}}')"


def mixed_facts(spark: SparkSession, sf_dir: str, by_file: bool = False) -> DataFrame:
    return facts(spark, sf_dir, by_file).select("fact_index", "load_seq", F.expr(_mixed_fact()).alias("fact"))


MIXED_DUCKDB = f"SELECT fact_index, load_seq, {_mixed_fact()} AS fact FROM ({FACTS_DUCKDB})"
