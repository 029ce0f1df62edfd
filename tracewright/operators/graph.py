"""Keyed merges, the referential guard, filters, neighbourhoods, resolution and statistics.

Edges are rows (src, kind, dst, rank, ...), nodes (id, kind, name, rank). All of
it is joins and map-side combined aggregations on ids, which AQE splits on hot ids.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.identity import edge_id, level


def merge_edges(observed: DataFrame) -> DataFrame:
    """One edge per (src, kind, dst): its weakest confidence, and how many rows observed it."""
    merged = observed.groupBy("src", "kind", "dst").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("observations"))
    return merged.select(edge_id(F.col("src"), F.col("kind"), F.col("dst")).alias("id"), "src", "kind", "dst", "rank", "observations")


def first_non_null(value: str, order: Column) -> Column:
    """The first value that isn't null; ``order`` must be total."""
    return F.min_by(value, F.when(F.col(value).isNotNull(), order))


def merge_nodes(observed: DataFrame, order: Column, fields: list[str]) -> DataFrame:
    """One node per id: weakest confidence; each field the first that isn't null."""
    return observed.groupBy("id").agg(F.min("rank").alias("rank"), *[first_non_null(f, order).alias(f) for f in fields])


def guard(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges whose ends both exist."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return edges


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with an end that doesn't exist."""
    ids = nodes.select("id")
    a = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti")
    b = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return a.unionByName(b)


def stats(rows: DataFrame) -> DataFrame:
    """Rows per kind and how many of them are explicit."""
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 3).alias("n_explicit"))


def find_nodes(nodes: DataFrame, kind: str | None = None, confidence: str | None = None, q: str | None = None, limit: int = 500) -> DataFrame:
    """At most ``limit`` (1 to 5000) nodes in the order of their ids."""
    if kind:
        nodes = nodes.where(F.col("kind") == kind)
    if confidence:
        nodes = nodes.where(level(F.col("rank")) == confidence)
    if q:
        nodes = nodes.where(_mentions(nodes, q))
    return nodes.orderBy("id").limit(min(max(limit, 1), 5000))


def _mentions(nodes: DataFrame, q: str) -> Column:
    """Whether a node's name, qualified name or path holds a text, whatever its case."""
    said = [F.coalesce(F.lower(c).contains(q.lower()), F.lit(False)) for c in ("name", "qualified_name", "path") if c in nodes.columns]
    return reduce(Column.__or__, said)


def query(nodes: DataFrame, edges: DataFrame, kind: str | None = None, confidence: str | None = None, q: str | None = None, edge_kind: str | None = None, limit: int = 500, edge_limit: int = 1000) -> dict[str, DataFrame]:
    """A part of a graph: ``nodes``, the ``edges`` between them, and ``totals`` (nodes, edges, matching, truncated), one row.

    Edges whose ends aren't both among the nodes shown are left out; both are limited in the order of ids.
    """
    matching = nodes
    if kind:
        matching = matching.where(F.col("kind") == kind)
    if confidence:
        matching = matching.where(level(F.col("rank")) == confidence)
    if q:
        matching = matching.where(_mentions(nodes, q))
    shown = matching.orderBy("id").limit(limit)
    inside = guard(edges if edge_kind is None else edges.where(F.col("kind") == edge_kind), shown).orderBy("id").limit(edge_limit)
    count = lambda rows, name: rows.agg(F.count(F.lit(1)).alias(name)).withColumn("one", F.lit(1))
    totals = count(nodes, "nodes").join(count(edges, "edges"), "one").join(count(matching, "matching"), "one")
    return {"nodes": shown, "edges": inside, "totals": totals.select("nodes", "edges", "matching", (F.col("matching") > limit).alias("truncated"))}


def detail(graph, node: str) -> dict[str, DataFrame]:
    """A node with what it cites and the edges at it."""
    cited = graph.node_refs.where(F.col("id") == node).select("evidence")
    return {"node": graph.nodes.where(F.col("id") == node), "evidence": graph.evidence.join(cited, graph.evidence["id"] == cited["evidence"]).drop("evidence").orderBy("path", "line", "id"), "edges": neighbourhood(graph.edges, node)}


def explicit_share(rows: DataFrame) -> DataFrame:
    """(n, share): how many rows there are and the part of them that is explicit; 0 of none."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(F.count_if(F.col("rank") == 3), F.count(F.lit(1))), F.lit(0.0)).cast("double").alias("share"))


def neighbourhood(edges: DataFrame, node: str) -> DataFrame:
    """The edges at a node with their direction and other end."""
    out = edges.where(F.col("src") == node).select("id", "kind", F.lit("out").alias("direction"), F.col("dst").alias("other"))
    return out.unionByName(edges.where(F.col("dst") == node).select("id", "kind", F.lit("in").alias("direction"), F.col("src").alias("other")))


def resolve(calls: DataFrame, candidates: Column, index: DataFrame) -> DataFrame:
    """``calls`` (call_id, ...) with the target of the first candidate key that ``index`` (key, target) knows."""
    asked = calls.select("call_id", F.posexplode(candidates).alias("place", "key"))
    hit = asked.join(index, "key").groupBy("call_id").agg(F.min_by("target", "place").alias("target"), F.min("place").alias("place"))
    return calls.select("call_id").join(hit, "call_id", "left")


def omissions(dropped: DataFrame, examples: int = 5) -> DataFrame:
    """Per reason: how many ids were left out, and the first ``examples`` of them, comma-joined."""
    counts = dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("reason").orderBy("id"))
    shown = dropped.withColumn("place", place).where(F.col("place") <= examples)
    return counts.join(shown.groupBy("reason").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("examples")), "reason")


def digest(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One digest of a set of rows, whatever their order.

    Lanes of each row's SHA-256 are summed, so that map-side combine does the
    work and no task holds the rows.
    """
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]), 256)
    lanes = rows.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")).alias(f"l{k}") for k in range(8)])
    return lanes.select("n", F.sha2(F.concat_ws("|", "n", *[F.coalesce(F.col(f"l{k}").cast("string"), F.lit("0")) for k in range(8)]), 256).alias("digest"))


def running_total(rows: DataFrame, order: str, size: str, width: int) -> DataFrame:
    """``rows`` with ``total``: the sum of ``size`` up to and with each row, by integer ``order`` (unique).

    A sum in two levels: per range of ``width`` ids, then within ranges, so only
    one number per range meets in one task.
    """
    rows = rows.withColumn("_range", F.floor(F.col(order) / width))
    sums = rows.groupBy("_range").agg(F.sum(size).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, "_range").withColumn("total", (F.sum(size).over(inner) + F.col("_before")).cast("long")).drop("_range", "_before")
