"""What facts, observations and merged rows of a graph look like, and how observations are made and merged."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.identity import edge_id, slug
from tracewright.functions.paths import module_name
from tracewright.operators.graph import first_non_null

EXPLICIT, STRONG, WEAK, UNKNOWN = 3, 2, 1, 0

_AT = "path string, producer string, seq bigint"
SCHEMAS = {
    "files": "path string, language string, digest string, analyzable boolean, seq bigint",
    "entities": f"{_AT}, kind string, name string, qualified_name string, start_line int, end_line int, language string, extends_from array<string>, implements_from array<string>, is_async boolean, attributes map<string,string>",
    "imports": f"{_AT}, specifier string, names array<string>, kind string, line int, is_external boolean",
    "calls": f"{_AT}, callee string, line int, from_qualified_name string, awaited boolean",
    "markers": f"{_AT}, name string, line int, attributes map<string,string>",
    "returns": f"{_AT}, line int, from_qualified_name string, kind string, name string, awaited boolean, expression string",
    "bindings": f"{_AT}, name string, callee string, line int, from_qualified_name string, awaited boolean",
    "throws": f"{_AT}, line int, from_qualified_name string, expression string, via string, rejects boolean",
    "responses": f"{_AT}, line int, from_qualified_name string, method string, status int, status_only boolean, payload string, payload_kind string",
    "commits": "hash string, author_name string, author_email string, subject string, files array<string>, seq bigint",
}
#: An observation carries all of its evidence: the id and what it cites.
NODE = "id string, kind string, name string, qualified_name string, language string, path string, start_line int, end_line int, digest string, rank int, attributes map<string,string>, evidence struct<id:string,kind:string,path:string,line:int,producer:string>, seq bigint"
EDGE = "src string, kind string, dst string, rank int, label string, attributes map<string,string>, evidence struct<id:string,kind:string,path:string,line:int,producer:string>, seq bigint"
FIELDS = ["kind", "name", "qualified_name", "language", "path", "start_line", "end_line", "digest"]


@dataclass
class Graph:
    """nodes, edges and evidence with the evidence of each (``node_refs``, ``edge_refs``: id, evidence)."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    node_refs: DataFrame
    edge_refs: DataFrame
    counters: dict[str, int] | None = None
    truncated: bool = False


def typed(df: DataFrame, schema: str, given: dict[str, Column]) -> DataFrame:
    fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
    return df.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))


def attributes(**given) -> Column:
    """A map of the attributes that aren't null, as text."""
    parts = [F.struct(F.lit(k).alias("key"), (v if isinstance(v, Column) else F.lit(v)).cast("string").alias("value")) for k, v in given.items()]
    return F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull()))


def nodes_of(df: DataFrame, kind, name, rank=EXPLICIT, key=None, **given) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    key = name if key is None else key
    given = {"language": F.lit(None), **given}
    return typed(df, NODE, {"id": F.concat(kind, F.lit(":"), slug(key)), "kind": kind, "name": name, "rank": F.lit(rank) if isinstance(rank, int) else rank, "evidence": F.col("evidence"), "seq": F.col("seq"), **given})


def edges_of(df: DataFrame, src, kind, dst, rank=EXPLICIT, **given) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return typed(df, EDGE, {"src": src, "kind": kind, "dst": dst, "rank": F.lit(rank) if isinstance(rank, int) else rank, "evidence": F.col("evidence"), "seq": F.col("seq"), **given})


def module_id(path: Column) -> Column:
    return F.concat(F.lit("module:"), slug(module_name(path)))


def merged_nodes(observed: DataFrame) -> DataFrame:
    """One node an id; attributes as a map whose keys are each first come, first served."""
    seq = F.col("seq")
    rows = observed.groupBy("id").agg(*[first_non_null(f, seq).alias(f) for f in FIELDS], F.min("rank").alias("rank"))
    return rows.join(_attributes(observed, "id"), "id", "left")


def merged_edges(observed: DataFrame) -> DataFrame:
    observed = observed.withColumn("id", edge_id(F.col("src"), F.col("kind"), F.col("dst")))
    ends = [F.min(c).alias(c) for c in ("src", "kind", "dst")]
    rows = observed.groupBy("id").agg(*ends, F.min("rank").alias("rank"), first_non_null("label", F.col("seq")).alias("label"))
    return rows.join(_attributes(observed, "id"), "id", "left")


def merged_ranks(observed: DataFrame) -> DataFrame:
    """(id, rank) of ``merged_edges``, without making its attributes."""
    return observed.groupBy(edge_id(F.col("src"), F.col("kind"), F.col("dst")).alias("id")).agg(F.min("rank").alias("rank"))


def merged_values(observed: DataFrame, *names: str, **more: Column) -> DataFrame:
    """(id, names..., more...) of ``merged_nodes``: the attributes that are named alone, and aggregates of the same grouping."""
    value = lambda n: F.min_by(F.col("attributes")[n], F.when(F.col("attributes")[n].isNotNull(), F.col("seq")))
    return observed.groupBy("id").agg(*[value(n).alias(n) for n in names], *[c.alias(n) for n, c in more.items()])


def _attributes(observed: DataFrame, key: str) -> DataFrame:
    each = observed.select(key, "seq", F.explode("attributes").alias("name", "value"))
    first = each.groupBy(key, "name").agg(F.min_by("value", "seq").alias("value"))
    return first.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
