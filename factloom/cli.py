"""Commands: parse, extract, validate, quality, normalise, unmatched, load, batch.

    python -m factloom.cli validate --input extracted.json --output out

Each reads what the one before writes; all work on files and folders that Spark reads.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import embedding, extraction, graph, linking, quality, reports, sections, validation
from factloom.plans import evidence
from factloom.sources import documents, facts, ontology


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="factloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        sub = commands.add_parser(name)
        for flag, settings in options:
            sub.add_argument(flag, **settings)

    needed, text = {"required": True}, {}
    config = ("--config", {"help": "ontology file; the built-in example without one"})
    command("parse", ("--source", needed), ("--out", needed))
    command("extract", ("--input", needed), ("--output", needed), ("--model", {"default": "dictionary", "help": "name that is written with the facts"}), ("--load-seq", {"type": int, "default": 0, "help": "place of these papers in the order of loads"}), config)
    command("validate", ("--input", needed), ("--output", needed), ("--issues", {"help": "folder for the issues by type; in the output's without one"}), ("--profile", {"default": "default", "choices": ["default", "strict"]}), ("--show-details", {"action": "store_true"}))
    command("quality", ("--input", needed), ("--output", text), ("--methods", {"nargs": "+", "default": ["heuristic"], "choices": ["heuristic", "knowledge_base", "similarity"]}), ("--sample-size", {"type": int}), ("--min-precision", {"type": float, "default": 0.95}))
    command("normalise", ("--input", needed), ("--output", needed), config, ("--min-fuzzy-score", {"type": float, "default": linking.FUZZY_CUTOFF}))
    command("unmatched", ("--input", needed), config)
    command("load", ("--input", needed), ("--graph", needed), ("--clear", {"action": "store_true"}))
    command("batch", ("--source", {"nargs": "+", "default": []}), ("--file", {"help": "list of sources, one a line"}), ("--output-base", needed), ("--quality-threshold", {"type": float, "default": 0.7}), ("--min-quality-score", {"type": float}), ("--attempts", {"type": int, "default": extraction.ATTEMPTS, "help": "times that a section is sent to the extractor"}), ("--whole-sections", {"action": "store_true", "help": "a fact out of range fails its section"}), config)
    return parser


def _concepts(spark: SparkSession, path: str | None) -> DataFrame:
    return ontology.concepts(spark, ontology.load_config(path) if path else ontology.EXAMPLE)


def _extractor(concepts: DataFrame) -> extraction.DictionaryExtractor:
    """The offline extractor over the ontology's labels: a vocabulary, not data."""
    names = lambda kind: sorted(r[0] for r in concepts.where(F.col("entity_type") == kind).select("label").distinct().collect())
    return extraction.DictionaryExtractor(names("drugs"), names("conditions"))


def _documents(spark: SparkSession, source: str, errors: bool = False) -> DataFrame:
    """(source_id, markdown) of Markdown files, HTML files (their main text) or a web address; with ``errors`` a source that
    cannot be read is a row that says why."""
    if errors:
        try:
            found = _documents(spark, source) if not _is_address(source) else _page(spark, source, errors)
        except AnalysisException as e:
            return documents.failed_source(spark, source, e)
        return found if "error" in found.columns else found.withColumn("error", F.lit(None).cast("string"))
    if _is_address(source):
        return _page(spark, source)
    if source.lower().endswith((".html", ".htm")):
        pages = spark.read.text(source, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
        return documents.page_documents(pages, by_name=True).select("source_id", F.col("text").alias("markdown"))
    return documents.markdown_files(spark, source).select("source_id", "markdown")


def _is_address(source: str) -> bool:
    return source.lower().startswith(("http://", "https://"))


def _page(spark: SparkSession, source: str, errors: bool = False) -> DataFrame:
    pages = documents.fetched(spark.createDataFrame([(source,)], "source string"), documents.download, errors)
    return documents.page_documents(pages).select("source_id", F.col("text").alias("markdown"), *(["error"] if errors else []))


def _facts(spark: SparkSession, path: str) -> DataFrame:
    """A fact file, or a table that an earlier command wrote."""
    return facts.read_facts(spark, path) if path.endswith(".json") else spark.read.parquet(path)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "parse":
        documents.write_parsed(sections.parsed_documents(_documents(spark, args.source)), args.out)
    elif args.command == "extract":
        parsed = documents.read_parsed(spark, args.input).select("source_id", F.explode("sections").alias("s")).select("source_id", "s.name", "s.text") if args.input.endswith(".json") else spark.read.json(args.input).select("source_id", F.explode("sections").alias("s")).select("source_id", "s.name", "s.text")
        found = extraction.clean_facts(extraction.extract(parsed, _extractor(_concepts(spark, args.config))))
        facts.write_table(extraction.numbered(found).withColumn("load_seq", F.lit(args.load_seq).cast("long")).withColumn("extraction_model", F.lit(args.model)), args.output)
    elif args.command == "validate":
        checked = validation.validate(_facts(spark, args.input), args.profile)
        facts.write_validated(checked, args.output, args.issues)
        validation.validation_report(checked).show()
        if args.show_details:
            validation.issues_by_type(validation.issues(checked)).show(truncate=False)
    elif args.command == "quality":
        rows = _facts(spark, args.input)
        rows = quality.sample(rows, args.sample_size) if args.sample_size else rows
        rows = embedding.with_similarity(rows) if "similarity" in args.methods else rows
        known = {"heuristic": quality.heuristic(), "knowledge_base": quality.knowledge_base(), "similarity": F.col("similarity") if "similarity" in args.methods else None}
        assessed = quality.assess(rows, {m: known[m] for m in args.methods})
        if args.output:
            facts.write_table(assessed, args.output)
        report = quality.quality_report(assessed).first()
        print(report)
        return int(report["estimated_precision"] < args.min_precision)
    elif args.command == "normalise":
        keys = linking.concept_keys(_concepts(spark, args.config))
        linked = linking.normalise(_facts(spark, args.input), keys, cutoff=args.min_fuzzy_score)
        facts.write_table(linked, args.output)
        linking.match_summary(spark.read.parquet(args.output)).show()
    elif args.command == "unmatched":
        linking.unmatched_report(linking.linked_slots(_facts(spark, args.input), linking.concept_keys(_concepts(spark, args.config)))).orderBy("slot", "place").show(200, truncate=False)
    elif args.command == "load":
        store = graph.GraphStore(spark, args.graph)
        store.load(spark.read.parquet(args.input), clear=args.clear)
        store.table("nodes").groupBy("label").count().show()
    elif args.command == "batch":
        concepts = _concepts(spark, args.config)
        listed = [*args.source, *([r["source"] for r in documents.source_list(spark, args.file).collect()] if args.file else [])]  # arguments, not data
        docs = None
        for load_seq, source in enumerate(listed):
            more = _documents(spark, source, errors=True).withColumn("load_seq", F.lit(load_seq).cast("long"))
            docs = more if docs is None else docs.unionByName(more)
        stages = evidence.process_papers(docs, _extractor(concepts), concepts, threshold=args.quality_threshold, min_score=args.min_quality_score, attempts=args.attempts, whole_sections=args.whole_sections)
        for name in ("extracted", "checked", "normalised", "runs", "attempts"):
            facts.write_table(getattr(stages, name), f"{args.output_base}/{name}")
        facts.write_report(reports.batch_summary(spark.read.parquet(f"{args.output_base}/runs")), f"{args.output_base}/summary")
    return 0


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    return run(SparkSession.builder.appName("factloom").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
