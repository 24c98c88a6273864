"""Property graphs: typed nodes with metadata and vectors, typed weighted edges, traversal and hybrid retrieval.

A graph is two frames and every change gives a new graph. Nodes: id, vector, node_type, content_ref, ts, attributes
(map of name to struct<s, i, f, b>). Edges: src, dst, edge_type, weight; (src, dst, edge_type) is unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import errors as E
from tessera.functions.lineage import cut_lineage
from tessera.operators.vector import knn

NODES = "id bigint, vector array<float>, node_type string, content_ref string, ts bigint, attributes map<string, struct<s: string, i: bigint, f: double, b: boolean>>"
EDGES = "src bigint, dst bigint, edge_type string, weight float"


def attribute(value) -> tuple:
    """A value of the attributes map."""
    return (value if isinstance(value, str) else None, value if isinstance(value, int) and not isinstance(value, bool) else None, value if isinstance(value, float) else None, value if isinstance(value, bool) else None)


class PropertyGraph:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    @staticmethod
    def empty(spark: SparkSession) -> PropertyGraph:
        return PropertyGraph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    # -- nodes
    def insert(self, rows: list[dict] | DataFrame) -> PropertyGraph:
        """With new nodes; an id that exists raises DuplicateExternalId."""
        spark = self.nodes.sparkSession
        if not isinstance(rows, DataFrame):
            rows = spark.createDataFrame([(r["id"], r.get("vector"), r.get("node_type"), r.get("content_ref"), r.get("ts", 0), {k: attribute(v) for k, v in r.get("attributes", {}).items()}) for r in rows], NODES)
        if not rows.groupBy("id").count().filter("count > 1").isEmpty() or not rows.join(self.nodes.select("id"), "id", "left_semi").isEmpty():
            raise E.DuplicateExternalId("a node id exists already")
        return PropertyGraph(self.nodes.unionByName(rows), self.edges)

    def update_metadata(self, node: int, **changes) -> PropertyGraph:
        """With other node_type, content_ref, ts or attributes of a node."""
        self._need(node, E.NodeNotFound)
        nodes = self.nodes
        for name, value in changes.items():
            if name == "attributes":
                kind = "struct<s: string, i: bigint, f: double, b: boolean>"
                pairs = [x for k, v in value.items() for x in (F.lit(k), F.struct(*[F.lit(a).cast(t).alias(n) for a, n, t in zip(attribute(v), "sifb", ("string", "bigint", "double", "boolean"))]).cast(kind))]
                new = F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string, {kind}>")
            else:
                new = F.lit(value)
            nodes = nodes.withColumn(name, F.when(F.col("id") == node, new).otherwise(F.col(name)))
        return PropertyGraph(nodes, self.edges)

    def remove_node(self, node: int) -> PropertyGraph:
        """Without a node and its edges."""
        self._need(node, E.NodeNotFound)
        return PropertyGraph(self.nodes.filter(F.col("id") != node), self.edges.filter((F.col("src") != node) & (F.col("dst") != node)))

    def nodes_by_type(self, kind) -> DataFrame:
        return self.nodes.filter(F.col("node_type") == kind).select("id")

    def nodes_by_path(self, path: str) -> DataFrame:
        return self.nodes.filter(F.col("content_ref") == path).select("id")

    def _need(self, node: int, error: type[E.EngineError]) -> None:
        if self.nodes.filter(F.col("id") == node).isEmpty():
            raise error(str(node))

    # -- edges
    def add_edge(self, src: int, dst: int, edge_type: str, weight: float = 1.0) -> PropertyGraph:
        """With an edge; one with the same ends and type is replaced."""
        self._need(src, E.SourceNodeNotFound)
        self._need(dst, E.DestinationNodeNotFound)
        new = self.edges.sparkSession.createDataFrame([(src, dst, edge_type, weight)], EDGES)
        return PropertyGraph(self.nodes, self.edges.filter(~self._same(src, dst, edge_type)).unionByName(new))

    def add_edges(self, rows: DataFrame) -> PropertyGraph:
        """With many edges (src, dst, edge_type, weight); of equal keys one stays, new before old, then the heaviest."""
        for end, error in (("src", E.SourceNodeNotFound), ("dst", E.DestinationNodeNotFound)):
            missing = rows.select(F.col(end).alias("id")).join(self.nodes.select("id"), "id", "left_anti").take(1)
            if missing:
                raise error(str(missing[0][0]))
        both = self.edges.withColumn("_new", F.lit(0)).unionByName(rows.select("src", "dst", "edge_type", F.col("weight").cast("float").alias("weight")).withColumn("_new", F.lit(1)))
        kept = both.groupBy("src", "dst", "edge_type").agg(F.max(F.struct("_new", "weight")).alias("x")).select("src", "dst", "edge_type", F.col("x.weight").alias("weight"))
        return PropertyGraph(self.nodes, kept)

    def remove_edge(self, src: int, dst: int, edge_type: str) -> PropertyGraph:
        if self.edges.filter(self._same(src, dst, edge_type)).isEmpty():
            raise E.EdgeNotFound(f"{src} -{edge_type}-> {dst}")
        return PropertyGraph(self.nodes, self.edges.filter(~self._same(src, dst, edge_type)))

    @staticmethod
    def _same(src: int, dst: int, edge_type: str):
        return (F.col("src") == src) & (F.col("dst") == dst) & (F.col("edge_type") == edge_type)

    def _typed(self, edge_type: str | None) -> DataFrame:
        return self.edges if edge_type is None else self.edges.filter(F.col("edge_type") == edge_type)

    def edges_of(self, node: int, edge_type: str | None = None) -> DataFrame:
        return self._typed(edge_type).filter((F.col("src") == node) | (F.col("dst") == node))

    def neighbors(self, node: int, edge_type: str | None = None) -> DataFrame:
        """The other end of each edge; duplicates stay, a self-loop gives the node once."""
        return self.edges_of(node, edge_type).select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("id"))

    def incoming(self, node: int, edge_type: str | None = None) -> DataFrame:
        return self._typed(edge_type).filter(F.col("dst") == node)

    def outgoing(self, node: int, edge_type: str | None = None) -> DataFrame:
        return self._typed(edge_type).filter(F.col("src") == node)

    # -- traversal
    def traverse_from(self, seeds: DataFrame, max_depth: int, edge_type: str | None = None) -> DataFrame:
        """(id, depth): all nodes within ``max_depth`` undirected steps of the seeds, with the fewest steps.

        Each step joins the frontier, not all that is known, with the edges in both directions and drops what was seen;
        it ends when nothing new appears. Frontiers are checkpointed, so plans don't grow with the depth.
        """
        edges = self._typed(edge_type)
        both = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("to")))
        frontier = cut_lineage(seeds.select(F.col("id").cast("long").alias("id")).distinct())
        seen = frontier.withColumn("depth", F.lit(0))
        for depth in range(1, max_depth + 1):
            step = frontier.join(both, "id").select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
            if depth == max_depth:
                return seen.unionByName(step.withColumn("depth", F.lit(depth)))
            frontier = cut_lineage(step)
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        return seen

    def traverse(self, start: int, max_depth: int, edge_type: str | None = None) -> DataFrame:
        return self.traverse_from(self.nodes.sparkSession.createDataFrame([(start,)], "id bigint"), max_depth, edge_type)

    # -- retrieval
    def search(self, query, k: int) -> DataFrame:
        return knn(self.nodes, "vector", query, k, "id")

    def search_by_type(self, query, k: int, kind) -> DataFrame:
        return knn(self.nodes.filter(F.col("node_type") == kind), "vector", query, k, "id")

    def search_then_traverse(self, query, k: int, edge_type: str | None = None, max_depth: int = 1) -> DataFrame:
        """(id, depth) around the k nearest nodes: one frontier for all of them."""
        return self.traverse_from(self.search(query, k).select("id"), max_depth, edge_type)

    # -- storage
    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    @staticmethod
    def load(spark: SparkSession, path: str) -> PropertyGraph:
        return PropertyGraph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


__all__ = ["PropertyGraph", "attribute"]
