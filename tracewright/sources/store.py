"""Graphs at rest: Parquet by analysis, published by a row of ``analyses`` that is written last.

Each table has a folder per analysis, so scans are pruned by it and an analysis is
written again or dropped as a whole. Edges lie twice, sorted by either end, so
that a neighbourhood reads few row groups. A failed run leaves a row and no graph.
"""

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.build import Graph

TABLES = ("nodes", "edges", "evidence", "node_refs", "edge_refs")
#: What else belongs to an analysis: what it had to say (seq, code, severity, message, path), and what was projected (kind, title, body).
OTHERS = ("diagnostics", "artifacts")
#: The orders in which tables are listed.
ORDERS = {"nodes": ("kind", "name", "id"), "edges": ("kind", "src", "id"), "evidence": ("path", "line", "id"), "diagnostics": ("seq",), "artifacts": ("kind",)}
ANALYSIS = "analysis_id string, name string, created_at timestamp, status string, message string, schema_version int"
SCHEMA_VERSION = 5


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, table: str, analysis_id: str) -> str:
        return f"{self.root}/{table}/analysis_id={analysis_id}"

    def _publish(self, analysis_id: str, name: str, status: str, message: str | None, created_at) -> None:
        row = (name, created_at or datetime.datetime.now(), status, message, SCHEMA_VERSION)
        fields = ANALYSIS.split(", ", 1)[1]
        self.spark.createDataFrame([row], fields).coalesce(1).write.mode("overwrite").parquet(self._at("analyses", analysis_id))

    def save(self, analysis_id: str, graph: Graph, name: str = "", created_at=None, **others: DataFrame) -> None:
        """Write a graph with its ``diagnostics`` and ``artifacts``, or write it again; it is listed once all of it is there."""
        if set(others) - set(OTHERS):
            raise ValueError(f"an analysis has no tables {sorted(set(others) - set(OTHERS))}")
        for table in (*TABLES, *OTHERS):
            rows = others.get(table) if table in OTHERS else getattr(graph, table)
            if rows is not None:
                rows.write.mode("overwrite").parquet(self._at(table, analysis_id))
        edges = self.spark.read.parquet(self._at("edges", analysis_id))
        for end in ("src", "dst"):
            edges.repartitionByRange(end).sortWithinPartitions(end, "id").write.mode("overwrite").parquet(self._at(f"edges_by_{end}", analysis_id))
        self._publish(analysis_id, name, "succeeded", None, created_at)

    def fail(self, analysis_id: str, message: str, name: str = "", created_at=None) -> None:
        self._publish(analysis_id, name, "failed", message, created_at)

    def analyses(self, limit: int | None = None) -> DataFrame:
        """The runs, newest first."""
        rows = self.spark.read.schema(ANALYSIS).parquet(f"{self.root}/analyses").orderBy(F.desc("created_at"), "analysis_id")
        return rows.limit(limit) if limit else rows

    def before(self, analysis_id: str) -> str | None:
        """The last successful run before one, to compare it with."""
        rows = self.analyses()
        own = rows.where(F.col("analysis_id") == analysis_id).select("created_at").first()
        if own is None:
            return None
        got = rows.where((F.col("status") == "succeeded") & (F.col("analysis_id") != analysis_id) & (F.col("created_at") < F.lit(own[0]))).select("analysis_id").first()
        return got[0] if got else None

    def table(self, name: str, analysis_id: str) -> DataFrame:
        return self.spark.read.parquet(self._at(name, analysis_id))

    def listed(self, name: str, analysis_id: str) -> DataFrame:
        """A table in the order in which it is listed."""
        return self.table(name, analysis_id).orderBy(*ORDERS[name])

    def compared(self, first: str, second: str) -> tuple[str, str]:
        """(base, target) of two analyses, whichever way round they are named: the older one is the base."""
        at = {r["analysis_id"]: (r["created_at"], r["analysis_id"]) for r in self.analyses().where(F.col("analysis_id").isin(first, second)).collect()}
        if set(at) != {first, second}:
            raise ValueError(f"no analysis {sorted({first, second} - set(at))}")
        return (first, second) if at[first] <= at[second] else (second, first)

    def graph(self, analysis_id: str) -> Graph:
        return Graph(*(self.table(t, analysis_id) for t in TABLES))

    def node(self, analysis_id: str, node_id: str) -> DataFrame:
        return self.table("nodes", analysis_id).where(F.col("id") == node_id)

    def outgoing(self, analysis_id: str, node_id: str) -> DataFrame:
        return self.table("edges_by_src", analysis_id).where(F.col("src") == node_id)

    def incoming(self, analysis_id: str, node_id: str) -> DataFrame:
        return self.table("edges_by_dst", analysis_id).where(F.col("dst") == node_id)

    def export(self, analysis_id: str, path: str) -> None:
        """Write the graph as JSON lines, a folder a table; rows of a table are in its order within each file."""
        for table in ("nodes", "edges", "evidence"):
            self.table(table, analysis_id).sortWithinPartitions(*ORDERS[table]).write.mode("overwrite").json(f"{path.rstrip('/')}/{table}")

    def summary(self, analysis_id: str) -> DataFrame:
        """(what, kind, n): nodes and edges by kind, most first."""
        counted = [self.table(t, analysis_id).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), "kind", "n") for t in ("nodes", "edges")]
        return counted[0].unionByName(counted[1]).orderBy(F.desc("what"), F.desc("n"), "kind")

    def delete(self, analysis_id: str) -> None:
        """Unlist an analysis, then drop its folders."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in ("analyses", *TABLES, *OTHERS, "edges_by_src", "edges_by_dst"):
            path = jvm.org.apache.hadoop.fs.Path(self._at(table, analysis_id))
            path.getFileSystem(conf).delete(path, True)
