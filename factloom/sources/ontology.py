"""Ontology configuration: providers and, by entity type, concepts with synonyms."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from factloom import schemas


class OntologyError(RuntimeError):
    """The configuration is missing or not of the expected form."""


def _parsed(text: str, path: str) -> dict:
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise OntologyError("a YAML configuration needs a YAML reader; JSON does not") from e
        config = yaml.safe_load(text)
    else:
        config = json.loads(text)
    if not isinstance(config, Mapping):
        raise OntologyError("the configuration is not a mapping")
    return dict(config)


def load_config(path: str) -> dict:
    """A JSON or, where a YAML reader is installed, YAML file beside the driver."""
    file = Path(path)
    if not file.exists():
        raise OntologyError(f"no configuration at {path}")
    return _parsed(file.read_text(encoding="utf-8"), path)


def read_config(spark: SparkSession, path: str) -> dict:
    """The same from any file system that Spark reads."""
    found = spark.read.text(path, wholetext=True).first()
    if found is None:
        raise OntologyError(f"no configuration at {path}")
    return _parsed(found["value"], path)


def concept_rows(config: Mapping) -> list[tuple]:
    """Rows of schemas.CONCEPT in the order of the file.  A field that is there but empty of
    meaning (null) becomes the text "None", a concept without id or label is an error."""
    if not isinstance(config.get("providers", {}), Mapping):
        raise OntologyError("providers is not a mapping")
    if "entities" not in config or not isinstance(config["entities"], Mapping):
        raise OntologyError("entities is missing or not a mapping")
    rows = []
    for entity_type, listed in config["entities"].items():
        if not isinstance(listed, Iterable) or isinstance(listed, (str, Mapping)):
            raise OntologyError(f"the concepts of {entity_type} are not a list")
        for seq, item in enumerate(listed):
            first = lambda *names, item=item: next((str(item[n]) for n in names if n in item), "")
            concept_id, label, provider = first("id", "concept_id"), first("label", "name"), first("provider", "source") or "custom"
            if not concept_id or not label:
                raise OntologyError(f"a concept of {entity_type} lacks an id or a label")
            named = item.get("synonyms") or []
            synonyms = [str(s) for s in ([named] if isinstance(named, str) else named) if s]
            rest = {k: str(v) for k, v in item.items() if k not in ("id", "concept_id", "label", "name", "provider", "source", "synonyms")}
            rows.append((entity_type, seq, concept_id, label, provider, synonyms, rest))
    return rows


def concepts(spark: SparkSession, config: Mapping) -> DataFrame:
    return spark.createDataFrame(concept_rows(config), schemas.CONCEPT)


#: A small dictionary for examples and tests.
EXAMPLE = {
    "providers": {"demo": {"name": "Demonstration codes"}},
    "entities": {
        "drugs": [
            {"id": "DEMO:D1", "label": "Sertraline", "provider": "demo", "synonyms": ["Zoloft"]},
            {"id": "DEMO:D2", "label": "Escitalopram", "provider": "demo", "synonyms": ["Lexapro"]},
            {"id": "DEMO:D3", "label": "Fluoxetine", "provider": "demo", "synonyms": ["Prozac"]},
            {"id": "DEMO:D4", "label": "Tricyclic antidepressants", "provider": "demo", "synonyms": ["TCAs", "tricyclics"]},
            {"id": "DEMO:D4", "label": "Antidepressants", "provider": "demo", "synonyms": ["antidepressant"]},
            {"id": "DEMO:D5", "label": "Venlafaxine", "provider": "demo", "synonyms": []},
            {"id": "DEMO:D6", "label": "Cognitive behavioral therapy", "provider": "demo", "synonyms": ["CBT"]},
            {"id": "DEMO:D7", "label": "Buspirone", "provider": "demo", "synonyms": ["Zoloft"]},
        ],
        "conditions": [
            {"id": "DEMO:C1", "label": "Major depressive disorder", "provider": "demo", "synonyms": ["MDD", "depression"]},
            {"id": "DEMO:C2", "label": "Generalized anxiety disorder", "provider": "demo", "synonyms": ["GAD"]},
            {"id": "DEMO:C3", "label": "Insomnia", "provider": "demo", "synonyms": []},
            {"id": "DEMO:C4", "label": "Treatment-resistant depression", "provider": "demo", "synonyms": ["TRD", "depression"]},
        ],
        "relations": [
            {"id": "DEMO:R1", "label": "TREATS", "provider": "demo", "synonyms": ["treats"]},
            {"id": "DEMO:R2", "label": "IMPROVES", "provider": "demo", "synonyms": []},
            {"id": "DEMO:R3", "label": "ASSOCIATED_WITH_SE", "provider": "demo", "synonyms": ["causes"]},
            {"id": "DEMO:R4", "label": "AUGMENTS", "provider": "demo", "synonyms": []},
            {"id": "DEMO:R5", "label": "SUPERIOR_TO", "provider": "demo", "synonyms": []},
        ],
        "outcomes": [
            {"id": "DEMO:O1", "label": "Quality of life", "provider": "demo", "synonyms": ["functional improvement"]},
            {"id": "DEMO:O2", "label": "Remission", "provider": "demo", "synonyms": ["remission rate"]},
            {"id": "DEMO:O3", "label": "Functional improvement", "provider": "demo", "synonyms": []},
        ],
        "side_effects": [
            {"id": "DEMO:S1", "label": "Nausea", "provider": "demo", "synonyms": []},
            {"id": "DEMO:S2", "label": "Headache", "provider": "demo", "synonyms": ["head pain"]},
            {"id": "DEMO:S3", "label": "Vivid dreams", "provider": "demo", "synonyms": []},
        ],
    },
}
