"""Explicit schemas of the evidence tables."""

from pyspark.sql import types as T

_STRINGS = lambda *names: [T.StructField(n, T.StringType()) for n in names]

#: The superset of both generations of fact files; missing fields read as null.
FACT = T.StructType(
    [
        *_STRINGS("drug_name", "condition_name", "relation", "outcome"),
        T.StructField("side_effects", T.ArrayType(T.StringType())),
        *_STRINGS("effect_size", "confidence_interval", "source_id", "section", "span"),
        T.StructField("confidence", T.DoubleType()),
        *_STRINGS("treatment_line", "patient_subgroup", "study_design"),
        T.StructField("sample_size", T.IntegerType()),
        *_STRINGS("duration", "dose"),
        T.StructField("p_value", T.DoubleType()),
    ]
)

MATCH = T.StructType([*_STRINGS("text", "concept_id", "label", "provider", "match_type"), T.StructField("score", T.DoubleType())])
ISSUE = T.StructType(_STRINGS("issue_type", "severity", "field", "detail"))
SENTENCE = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
CONCEPT = T.StructType(
    [
        *_STRINGS("entity_type"),
        T.StructField("concept_seq", T.IntegerType()),
        *_STRINGS("concept_id", "label", "provider"),
        T.StructField("synonyms", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
