"""Questions to the graph: filters, degrees, two-hop patterns, schema inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom import vocab
from factloom.operators.graph import EDGE_PROPERTIES


def _ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the names of both ends.  Nodes are joined by id; adaptive execution broadcasts them where they are few."""
    side = lambda p: nodes.select(F.col("id").alias(f"{p}_id"), F.col("name").alias(f"{p}_name"), F.col("normalized_name").alias(f"{p}_label"))
    return edges.join(side("src"), "src_id").join(side("dst"), "dst_id")


def low_confidence(edges: DataFrame, below: float = 0.6) -> DataFrame:
    return edges.where(F.col("confidence") < below).select(F.col("src_id").alias("drug_id"), "rel_type", F.col("dst_id").alias("target_id"), "confidence")


def duplicates(evidence: DataFrame) -> DataFrame:
    """Facts that fall on one edge."""
    return evidence.groupBy("src_id", "rel_type", "dst_id").agg(F.count("*").alias("n")).where("n > 1")


def node_counts(nodes: DataFrame, labels: list[str] | None = None) -> DataFrame:
    picked = nodes if labels is None else nodes.where(F.col("label").isin(labels))
    return picked.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel_type")


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("total_nodes")).crossJoin(edges.agg(F.count("*").alias("total_edges")))  # one row each


def sample_edges(edges: DataFrame, nodes: DataFrame, rel_type: str = "FIRST_LINE_FOR", n: int = 5) -> DataFrame:
    return _ends(edges.where(F.col("rel_type") == rel_type), nodes).select("src_name", "rel_type", "dst_name", "confidence").orderBy("src_name", "dst_name", "confidence").limit(n)


def top_connected_drugs(edges: DataFrame, nodes: DataFrame, n: int = 10) -> DataFrame:
    drugs = nodes.where("label = 'Drug'").select(F.col("id").alias("src_id"), "name")
    return edges.join(drugs, "src_id").groupBy("name").agg(F.count("*").alias("connections")).orderBy(F.desc("connections"), "name").limit(n)


def first_line_treatments(edges: DataFrame, nodes: DataFrame, condition: str = "depressive disorder", above: float = 0.8, n: int = 10) -> DataFrame:
    wanted = edges.where((F.col("rel_type") == "FIRST_LINE_FOR") & (F.col("confidence") > above))
    found = _ends(wanted, nodes).where(F.contains("dst_label", F.lit(condition)))
    found = found.select(F.col("src_name").alias("drug"), F.col("effect_size").alias("efficacy"), "confidence", F.col("sample_size").alias("n"), F.col("source_id").alias("paper"))
    return found.orderBy(F.desc("confidence"), "drug", "paper", "n").limit(n)


def shared_targets(edges: DataFrame, nodes: DataFrame, first: str, second: str, rel_type: str = "ASSOCIATED_WITH_SE") -> DataFrame:
    """What two drugs both lead to by one relation, and how often.  Both numbers are those of the pattern of two
    edges, which pairs every edge of the one with every edge of the other; counted without making the pairs."""
    named = _ends(edges.where((F.col("rel_type") == rel_type)), nodes).where(F.col("src_name").isin(first, second))
    counted = named.groupBy("dst_id", "dst_name").agg(F.count_if(F.col("src_name") == first).alias("a"), F.count_if(F.col("src_name") == second).alias("b"))
    pairs = F.sum(F.col("a") * F.col("b"))
    return counted.where("a > 0 AND b > 0").groupBy(F.col("dst_name").alias("target")).agg(pairs.alias("first_reports"), pairs.alias("second_reports"))


def augmentation_pairs(edges: DataFrame, nodes: DataFrame, subgroup: str | None = None) -> DataFrame:
    wanted = edges.where("rel_type = 'AUGMENTS'")
    if subgroup is not None:
        wanted = wanted.where(F.col("patient_subgroup") == subgroup)
    return _ends(wanted, nodes).select(F.col("src_name").alias("augmenting_drug"), F.col("dst_name").alias("base_treatment"), "evidence", F.col("source_id").alias("paper"))


def fact_evidence(evidence: DataFrame, nodes: DataFrame, drug: str, rel_type: str, condition: str) -> DataFrame:
    """Every fact behind a drug's relation to the conditions whose normalised name holds a term."""
    found = _ends(evidence.where(F.col("rel_type") == rel_type), nodes).where((F.col("src_name") == drug) & F.contains("dst_label", F.lit(condition)))
    return found.select(F.col("source_id").alias("paper"), "section", F.col("evidence").alias("exact_text"), "confidence", F.col("study_design").alias("design"), F.col("sample_size").alias("n"), "load_seq", "fact_index")


def schema_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name) of all labels and relation types."""
    return nodes.select(F.lit("label").alias("kind"), F.col("label").alias("name")).distinct().union(edges.select(F.lit("relation").alias("kind"), F.col("rel_type").alias("name")).distinct())


def schema_properties(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, property): properties that some node or edge has, found in the tables: their columns, and the
    keys of ``extra``; a null is no property.  One count for each column and key, not a list of values."""

    def present(df: DataFrame, kind: str, by: str, *ends: str) -> DataFrame:
        columns = [c for c in df.columns if c not in (by, *ends, "extra")]
        counted = df.groupBy(F.col(by).alias("owner")).agg(*(F.count(c).alias(c) for c in columns))
        stacked = ", ".join(f"'{c}', `{c}`" for c in columns)
        known = counted.selectExpr(f"'{kind}' AS kind", "owner AS name", f"stack({len(columns)}, {stacked}) AS (property, n)").where("n > 0").drop("n")
        if "extra" not in df.columns:
            return known
        return known.unionByName(df.select(F.lit(kind).alias("kind"), F.col(by).alias("name"), F.explode(F.map_keys("extra")).alias("property"))).distinct()

    return present(nodes, "label", "label").unionByName(present(edges, "relation", "rel_type", "src_id", "dst_id", "load_seq", "fact_index"))


def schema_samples(nodes: DataFrame, edges: DataFrame, n: int = 3) -> DataFrame:
    """The first n nodes of each label by id, with their outgoing edges; nodes without any have one row."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    picked = nodes.withColumn("place", place).where(F.col("place") <= n).select("label", "id", "name")
    return picked.join(edges.select(F.col("src_id").alias("id"), "rel_type", "dst_id"), "id", "left").select("label", "id", "name", "rel_type", "dst_id")


def expected_schema(spark) -> DataFrame:
    """(rel_type, source, target) that the loader makes."""
    rows = [(r, "Drug", "Outcome" if r == "IMPROVES" else "Condition") for r in vocab.RELATIONS]
    return spark.createDataFrame(rows, "rel_type string, source string, target string")
