"""The graph kept up to date from a stream of normalised facts.

``follow`` keeps all evidence.  Each micro-batch is appended to the mention and evidence tables under its batch id, so a
batch that runs again replaces itself, and nodes and edges are then those of all batches.
The order of upserts is the facts' own (load_seq, fact_index), not that of arrival: late
files change what they should and nothing else.

``follow_winners`` keeps what each node and edge is by now.  Spark's state store holds the winner of every key, a batch is
merged into it and hands on only the keys that it changed; these are written under its batch id.  So a batch costs its
own keys, and a reader merges changes, not evidence.  (For state beyond memory set the RocksDB provider in
``spark.sql.streaming.stateStore.providerClass``.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from factloom.operators import graph


class GraphSink:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        graph.node_candidates(batch).write.mode("overwrite").parquet(f"{self.path}/mentions/batch={batch_id}")
        graph.edge_evidence(batch).write.mode("overwrite").parquet(f"{self.path}/edge_evidence/batch={batch_id}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}").drop("batch")

    def nodes(self) -> DataFrame:
        return graph.merged_nodes(self._read("mentions"))

    def edges(self) -> DataFrame:
        return graph.edges(self._read("edge_evidence"))


def follow(normalised_stream: DataFrame, sink: GraphSink, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of normalised facts to the sink; ``available_now`` takes what there is and ends."""
    writer = normalised_stream.writeStream.foreachBatch(sink.write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


KEYS = {kind: keys for kind, (keys, _) in graph.WINNERS.items()}


def _rank(kind: str) -> Column:
    """The first fact of the last load names a node, the last one makes an edge."""
    return F.struct("load_seq", -F.col("fact_index")) if kind == "nodes" else F.struct("load_seq", "fact_index")


def winners(rows: DataFrame, kind: str) -> DataFrame:
    """One row for each key, in a stream or not; rows keep load_seq and fact_index, so winners of parts merge to those of the whole."""
    keys = KEYS[kind]
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), _rank(kind)).alias("w"))
    return best.select(*keys, "w.*")


class WinnerSink:
    """Changes of nodes and edges by batch, below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def changes(self, kind: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{kind}").drop("batch")

    def nodes(self) -> DataFrame:
        return winners(self.changes("nodes"), "nodes").drop("load_seq", "fact_index")

    def edges(self) -> DataFrame:
        return winners(self.changes("edges"), "edges")


def follow_winners(normalised_stream: DataFrame, sink: WinnerSink, checkpoint: str, available_now: bool = True) -> list[StreamingQuery]:
    """A query for nodes and one for edges, each with its state and checkpoint; a batch that runs again replaces its own changes."""
    queries = []
    for kind, rows in (("nodes", graph.node_candidates(normalised_stream)), ("edges", graph.edge_evidence(normalised_stream))):

        def write(batch: DataFrame, batch_id: int, kind: str = kind) -> None:
            batch.write.mode("overwrite").parquet(f"{sink.path}/{kind}/batch={batch_id}")

        writer = winners(rows, kind).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{kind}")
        queries.append((writer.trigger(availableNow=True) if available_now else writer).start())
    return queries
