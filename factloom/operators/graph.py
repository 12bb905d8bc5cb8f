"""Normalised facts into a property graph of tables: nodes, edges, edge_evidence.

``edge_evidence`` keeps a row for each fact; ``nodes`` and ``edges`` are what loading file after file
with upserts leaves: a node takes its attributes from the first fact of the last load that names it,
an edge from the last fact of the last load.  Which fact wins is found by aggregates of numbers, which combine
map-side by hash; ``max_by``, whose structs are sorted, sees only what is left for each key and load.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import vocab
from factloom.functions import variants
from factloom.functions.text import lookup, text
from factloom.plans.workspace import settle

NODE_SLOTS = {"Drug": ("drug", "drug"), "Condition": ("condition", "condition"), "Outcome": ("outcome", "outcome_match")}
OPTIONAL = ["treatment_line", "patient_subgroup", "study_design", "duration", "dose", "effect_size", "confidence_interval", "outcome"]
EDGE_PROPERTIES = ["evidence", "confidence", "source_text", "source_id", "section", "sample_size", "p_value", *OPTIONAL]


def node_id(prefix: str, match: Column) -> Column:
    clean = F.translate(match["concept_id"], ":/ ", "___")
    hashed = F.concat(F.lit(f"{prefix}_unmatched_"), F.substring(F.md5(match["text"]), 1, 8))
    there = F.coalesce(match["text"] != "", F.lit(False))
    return F.when(there, F.when(F.coalesce(match["concept_id"] != "", F.lit(False)), F.concat(F.lit(f"{prefix}_"), clean)).otherwise(hashed))


def node_candidates(normalised: DataFrame) -> DataFrame:
    """(label, id, name, normalized_name, match_type, match_score, category, load_seq, fact_index), a row for each mention."""
    made = []
    for label, (prefix, column) in NODE_SLOTS.items():
        m = F.col(column)
        made.append(F.struct(F.lit(label).alias("label"), node_id(prefix, m).alias("id"), m["text"].alias("name"), m["label"].alias("normalized_name"), m["match_type"].alias("match_type"), m["score"].alias("match_score"), F.lit(label).alias("category")))
    rows = normalised.select("load_seq", "fact_index", F.explode(F.array(*made)).alias("n"))
    return rows.select("n.*", "load_seq", "fact_index").where("id IS NOT NULL")


def nodes(normalised: DataFrame) -> DataFrame:
    return merged_nodes(node_candidates(normalised))


def edge_evidence(normalised: DataFrame) -> DataFrame:
    """A row for each fact that makes an edge, with all properties; the relation's text counts as it is written."""
    has = set(normalised.columns)
    column = lambda c, kind="string": F.col(c).cast(kind) if c in has else F.lit(None).cast(kind)
    target = F.when(F.col("relation") == "IMPROVES", node_id("outcome", F.col("outcome_match"))).otherwise(node_id("condition", F.col("condition")))
    written = variants.written(variants.member("raw_fact", "sample_size")) if "raw_fact" in has else column("sample_size")
    size = F.when(written.rlike("^[0-9]+$"), written.try_cast("int"))
    # Fields that no column has: properties of their own.
    more = [F.col("extra")] if "extra" in has else []
    rows = normalised.where(F.col("relation").isin(vocab.RELATIONS)).select(
        node_id("drug", F.col("drug")).alias("src_id"),
        F.col("relation").alias("rel_type"),
        target.alias("dst_id"),
        lookup(F.col("relation"), vocab.RELATION_LABELS, F.lower("relation")).alias("label"),
        "load_seq",
        "fact_index",
        text("span").alias("evidence"),
        F.coalesce(column("confidence", "double"), F.lit(0.0)).alias("confidence"),
        text("span").alias("source_text"),
        text("source_id").alias("source_id"),
        text("section").alias("section"),
        size.alias("sample_size"),
        column("p_value", "double").alias("p_value"),
        *(column(c).alias(c) for c in OPTIONAL),
        *more,
    )
    return rows.where("src_id IS NOT NULL AND dst_id IS NOT NULL")


def edges(evidence: DataFrame) -> DataFrame:
    """One edge for each (src, type, dst): the last fact's properties, nulls and all.  Which fact that is takes only numbers, which are
    aggregated by hash; the properties of these facts alone are then looked up, and no row is sorted with all that it has."""
    keys = ["src_id", "rel_type", "dst_id"]
    more = [c for c in ("extra",) if c in evidence.columns]
    place = ["load_seq", "fact_index"]
    last = evidence.groupBy(*keys, "load_seq").agg(F.max("fact_index").alias("fact_index"))
    last = last.groupBy(*keys).agg(F.max(F.struct(*place)).alias("_last")).select(*keys, "_last.*")
    won = evidence.join(last, [*keys, *place], "left_semi")
    best = won.groupBy(*keys).agg(F.max_by(F.struct("label", *EDGE_PROPERTIES, *more, *place), F.struct(*place)).alias("e"))
    return best.select(*keys, "e.*")


def load_counters(normalised: DataFrame, evidence: DataFrame) -> DataFrame:
    """(counter, name, n): distinct nodes by label, and facts by relation, counted before edges merge."""
    by_label = node_candidates(normalised).select("label", "id").distinct().groupBy(F.col("label").alias("name")).agg(F.count("*").alias("n")).select(F.lit("nodes").alias("counter"), "name", "n")
    return by_label.unionByName(evidence.groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("relations").alias("counter"), "name", "n"))


def side_effect_edges(normalised: DataFrame) -> DataFrame:
    """Extension: Drug -> SideEffect edges, which the plain load does not make."""
    each = normalised.where("relation = 'ASSOCIATED_WITH_SE'").select(node_id("drug", F.col("drug")).alias("src_id"), "load_seq", "fact_index", F.explode("side_effect_matches").alias("m"))
    return each.select("src_id", F.lit("ASSOCIATED_WITH_SE").alias("rel_type"), node_id("side_effect", F.col("m")).alias("dst_id"), "load_seq", "fact_index").where("src_id IS NOT NULL AND dst_id IS NOT NULL")


def first_mentions(mentions: DataFrame) -> DataFrame:
    """Of the mentions of a load that are alike the first one; no other can name a node.  Columns are numbers and texts to group by,
    so they are aggregated by hash."""
    return mentions.groupBy(*(c for c in mentions.columns if c != "fact_index")).agg(F.min("fact_index").alias("fact_index"))


def merged_nodes(mentions: DataFrame) -> DataFrame:
    """One node for each (label, id): the attributes of the first fact of the last load."""
    attributes = ["name", "normalized_name", "match_type", "match_score", "category"]
    best = first_mentions(mentions).groupBy("label", "id").agg(F.max_by(F.struct(*attributes), F.struct("load_seq", -F.col("fact_index"))).alias("n"))
    return best.select("label", "id", "n.*")


#: The tables of a store: what a row is told apart by, and what it is made from.
WINNERS = {"nodes": (("label", "id"), "mentions"), "edges": (("src_id", "rel_type", "dst_id"), "edge_evidence")}
#: Segments of a table after which it is written anew as one.
MOST_SEGMENTS = 8


class GraphStore:
    """A graph in versions under one folder.  Tables are lists of segments, folders that are written once: ``mentions`` and
    ``edge_evidence`` have one for each load call, ``nodes`` and ``edges`` one with the keys that the call changed.  A version is a
    manifest, a file of one row that names each table's segments; it is written last, and Spark's commit moves it into its
    place by one rename.  So a reader has the old graph or the new one, and a load that dies leaves the old one.

    ``mentions`` keeps of the mentions of a load that are alike the first.  ``load`` adds loads; a load (load_seq) that is there already is replaced: its rows in older segments no longer count.  Only the
    keys of new and replaced rows get a new winner, or a mark that they are gone, so a load writes about as much as it
    brings.  Every MOST_SEGMENTS loads the tables are written as one segment.  One writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        """The newest version; version 0 has nothing."""
        try:
            rows = self.spark.read.schema("version long, token string, segments map<string,array<string>>").json(f"{self.path}/manifests")
            last = rows.orderBy(F.desc("version"), F.desc("token")).limit(1).collect()
        except AnalysisException:
            last = []
        return {"version": last[0]["version"], "segments": last[0]["segments"]} if last else {"version": 0, "segments": {}}

    def _read(self, name: str, segment: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/segment={segment}")

    def _rows(self, name: str, segments: dict) -> DataFrame:
        """Mentions or evidence: rows of loads that no later segment brings again."""
        found, later = None, None
        for segment in reversed(segments[name]):
            rows = self._read(name, segment)
            rows = rows if later is None else rows.join(later, "load_seq", "left_anti")
            found = rows if found is None else found.unionByName(rows, allowMissingColumns=True)
            loads = self._read("loads", segment)
            later = loads if later is None else later.union(loads)
        return found

    def _winners(self, name: str, segments: dict) -> DataFrame:
        keys, _ = WINNERS[name]
        parts = [self._read(name, x).withColumn("_segment", F.lit(i)) for i, x in enumerate(segments[name])]
        if len(parts) == 1:
            return parts[0].drop("_gone", "_segment")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        rest = [c for c in rows.columns if c not in (*keys, "_segment")]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_segment").alias("r")).select(*keys, "r.*")
        return last.where("NOT coalesce(_gone, false)").drop("_gone")

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """nodes, edges, mentions or edge_evidence of a version, the newest one by default."""
        segments = (manifest or self.manifest())["segments"]
        return self._winners(name, segments) if name in WINNERS else self._rows(name, segments)

    def load(self, normalised: DataFrame, clear: bool = False) -> None:
        before = self.manifest()
        old = {} if clear else before["segments"]
        new = f"{before['version'] + 1:06d}-{uuid.uuid4().hex[:8]}"
        facts = settle(normalised, "load")  # mentions and evidence are both read from here
        write = lambda df, name: df.write.parquet(f"{self.path}/{name}/segment={new}")
        write(facts.select("load_seq").distinct(), "loads")
        write(first_mentions(node_candidates(facts)), "mentions")
        write(edge_evidence(facts), "edge_evidence")
        segments = {name: [*old.get(name, []), new] for name in ("loads", "mentions", "edge_evidence", "nodes", "edges")}
        whole = not old or len(segments["mentions"]) > MOST_SEGMENTS
        for name, (keys, source) in WINNERS.items():
            merged = merged_nodes if name == "nodes" else edges
            if whole:
                write(merged(self._rows(source, segments)), name)
                continue
            replaced = self._rows(source, old).join(self._read("loads", new), "load_seq", "left_semi")
            changed = settle(self._read(source, new).select(*keys).union(replaced.select(*keys)).distinct(), "changed")
            won = settle(merged(self._rows(source, segments).join(changed, list(keys), "left_semi")).withColumn("_gone", F.lit(False)), "won")
            gone = changed.join(won, list(keys), "left_anti").withColumn("_gone", F.lit(True))
            write(won.unionByName(gone, allowMissingColumns=True), name)
        if whole:
            if old:
                one = f"{new}-all"
                for name in ("mentions", "edge_evidence"):
                    self._rows(name, segments).write.parquet(f"{self.path}/{name}/segment={one}")
                reduce(DataFrame.union, (self._read("loads", x) for x in segments["loads"])).distinct().write.parquet(f"{self.path}/loads/segment={one}")
                segments |= {name: [one] for name in ("loads", "mentions", "edge_evidence")}
            segments |= {name: [new] for name in WINNERS}
        self._commit(before["version"] + 1, segments)

    def _commit(self, version: int, segments: dict) -> None:
        row = self.spark.createDataFrame([(version, uuid.uuid4().hex, segments)], "version long, token string, segments map<string,array<string>>")
        row.coalesce(1).write.mode("append").json(f"{self.path}/manifests")

    def register(self) -> None:
        """Views nodes, edges and edge_evidence of one version, so that questions can be put in SQL."""
        manifest = self.manifest()
        for name in ("nodes", "edges", "edge_evidence"):
            self.table(name, manifest).createOrReplaceTempView(name)
