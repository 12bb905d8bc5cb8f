"""From documents to a graph: all papers at once, each with its own quality gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import extraction, graph, linking, quality, sections, validation
from factloom.plans.workspace import settle


@dataclass
class Stages:
    """The tables of a run; facts are settled, what follows from them by expressions is lazy."""

    sections: DataFrame
    extracted: DataFrame
    checked: DataFrame
    assessed: DataFrame
    gates: DataFrame
    normalised: DataFrame
    runs: DataFrame
    attempts: DataFrame


def process_papers(documents: DataFrame, extractor: extraction.Extractor, concepts: DataFrame, methods: dict[str, Column] | None = None, threshold: float = 0.7, min_score: float | None = None, attempts: int = extraction.ATTEMPTS, whole_sections: bool = False) -> Stages:
    """``documents`` has (source_id, markdown) and may have ``load_seq``, the order in which papers are loaded into a
    graph; without it that is the order of their ids.  ``fact_index`` is a fact's place in its paper.  Papers that fail
    their gate go no further; a paper without valid facts fails it.  ``runs`` has a row for each paper that was parsed.
    The extractor is asked for each section until it answers, ``attempts`` times at most: its facts are settled, and all tables
    read them from there.  A document that has an ``error``, as sources that were read with errors have it, is a run that FAILED;
    the others go on."""
    failures = None
    if "error" in documents.columns:
        documents = settle(documents, "documents")
        failures = documents.where("error IS NOT NULL").groupBy("source_id").agg(F.min("error").alias("error"))
        documents = documents.where("error IS NULL").drop("error")
    parts = sections.split_sections(documents)
    raw, tries = extraction.extract_sections(parts, extractor, attempts, whole_sections)
    if "load_seq" in documents.columns:
        papers = documents.groupBy("source_id").agg(F.max("load_seq").alias("load_seq"))
    else:
        papers = documents.select("source_id").distinct().orderBy("source_id").withColumn("load_seq", F.monotonically_increasing_id())
    papers = settle(papers, "papers")
    extracted = settle(extraction.numbered(extraction.clean_facts(raw)).join(papers, "source_id"), "facts")
    checked = validation.validate(extracted)
    assessed = settle(quality.assess(checked.where("is_valid").drop("issues", "is_valid"), methods or {"heuristic": quality.heuristic()}), "assessed")
    gates = quality.gate(assessed, threshold, min_score)
    kept = assessed if min_score is None else quality.above(assessed, min_score)
    passed = kept.join(gates.where("status = 'SUCCESS'").select("source_id"), "source_id", "left_semi")
    keys = linking.concept_keys(concepts)
    normalised = settle(linking.normalise(passed.drop("method_results", "quality_score", "likely_correct"), keys), "normalised")
    counts = checked.groupBy("source_id").agg(F.count("*").alias("extracted"), F.count_if("is_valid").alias("valid"))
    done = normalised.groupBy("source_id").agg(F.count("*").alias("normalised"))
    runs = papers.join(counts, "source_id", "left").join(gates, "source_id", "left").join(done, "source_id", "left")
    runs = runs.select("source_id", F.coalesce("status", F.lit("QUALITY_GATE_FAILED")).alias("status"), *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("extracted", "valid", "normalised")), "estimated_precision", "average_quality_score")
    if failures is not None:
        failed = failures.select("source_id", F.lit("FAILED").alias("status"), *(F.lit(0).cast("long").alias(c) for c in ("extracted", "valid", "normalised")), *(F.lit(None).cast("double").alias(c) for c in ("estimated_precision", "average_quality_score")), "error")
        runs = runs.withColumn("error", F.lit(None).cast("string")).unionByName(failed)
    return Stages(parts, extracted, checked, assessed, gates, normalised, runs, tries)


def graph_tables(normalised: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, edge_evidence."""
    evidence = graph.edge_evidence(normalised)
    return graph.nodes(normalised), graph.edges(evidence), evidence
