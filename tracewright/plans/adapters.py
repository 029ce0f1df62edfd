"""Graphs made of relational tables. Each is lazily built; a query reads only the columns that it uses."""

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.identity import edge_id
from tracewright.storage import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_letter(column: str, strongest: str, middle: str):
    """Rank 3, 2 or 1 from a status letter."""
    return F.when(F.col(column) == strongest, 3).when(F.col(column) == middle, 2).otherwise(1)


def _id(kind: str, column: str):
    return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, name, rank of regions, nations, customers, suppliers, parts and orders."""

    def of(name, kind, key, label, rank=None):
        rank = F.lit(3) if rank is None else rank
        return table(spark, sf_dir, name).select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("name"), rank.alias("rank"))

    return reduce(
        DataFrame.unionByName,
        [
            of("region", "package", "r_regionkey", "r_name"),
            of("nation", "module", "n_nationkey", "n_name"),
            of("customer", "function", "c_custkey", "c_name"),
            of("supplier", "deployment_component", "s_suppkey", "s_name"),
            of("part", "table", "p_partkey", "p_name"),
            of("orders", "api_endpoint", "o_orderkey", "o_orderpriority", by_letter("o_orderstatus", "F", "O")),
        ],
    )


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation per lineitem: its order reads or writes its part."""
    kind = F.when(F.col("l_linestatus") == "F", "writes").otherwise("reads")
    return table(spark, sf_dir, "lineitem").select(_id("api_endpoint", "l_orderkey").alias("src"), kind.alias("kind"), _id("table", "l_partkey").alias("dst"), by_letter("l_returnflag", "N", "R").alias("rank"))


def _items(spark: SparkSession, sf_dir: str, src_kind: str, src: str, how, dst_kind: str, dst: str) -> DataFrame:
    """src, kind, dst, rank of the merged edges that lineitems observe; merged by numbers, which are shorter to deal than ids."""
    rows = table(spark, sf_dir, "lineitem").select(src, how.alias("kind"), dst, by_letter("l_returnflag", "N", "R").alias("rank"))
    merged = rows.groupBy(src, "kind", dst).agg(F.min("rank").alias("rank"))
    return merged.select(_id(src_kind, src).alias("src"), "kind", _id(dst_kind, dst).alias("dst"), "rank")


def data_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, kind, dst, rank of the chain customer, order, part, supplier, nation, region."""
    used = F.when(F.col("l_linestatus") == "F", "writes").otherwise("reads")
    merged = [_items(spark, sf_dir, "api_endpoint", "l_orderkey", used, "table", "l_partkey"), _items(spark, sf_dir, "table", "l_partkey", F.lit("produces"), "deployment_component", "l_suppkey")]

    def of(name, src_kind, src, kind, dst_kind, dst, rank=None):
        rank = F.lit(3) if rank is None else rank
        s, d = _id(src_kind, src), _id(dst_kind, dst)
        return table(spark, sf_dir, name).select(s.alias("src"), F.lit(kind).alias("kind"), d.alias("dst"), rank.alias("rank"))

    rows = reduce(
        DataFrame.unionByName,
        [
            *merged,
            of("orders", "function", "o_custkey", "produces", "api_endpoint", "o_orderkey", by_letter("o_orderstatus", "F", "O")),
            of("supplier", "deployment_component", "s_suppkey", "communicates_with", "module", "s_nationkey"),
            of("nation", "module", "n_nationkey", "communicates_with", "package", "n_regionkey"),
        ],
    )
    return rows.select(edge_id(F.col("src"), F.col("kind"), F.col("dst")).alias("id"), *rows.columns)


def structure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, src, kind, dst, rank: what depends on, contains, deploys and calls what."""

    def of(name, src_kind, src, kind, dst_kind, dst):
        s, d = _id(src_kind, src), _id(dst_kind, dst)
        return table(spark, sf_dir, name).select(edge_id(s, F.lit(kind), d).alias("id"), s.alias("src"), F.lit(kind).alias("kind"), d.alias("dst"), F.lit(3).alias("rank"))

    return reduce(
        DataFrame.unionByName,
        [
            of("nation", "module", "n_nationkey", "depends_on", "package", "n_regionkey"),
            of("customer", "module", "c_nationkey", "contains", "function", "c_custkey"),
            of("supplier", "module", "s_nationkey", "deploys", "deployment_component", "s_suppkey"),
            of("orders", "api_endpoint", "o_orderkey", "calls", "function", "o_custkey"),
        ],
    )


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, n): lineitems by which customers of one nation bought from suppliers of another or the same."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    by_customer = orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    rows = items.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(by_customer, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of the orders: (id, rank, name) before and after."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _id("api_endpoint", "o_orderkey").alias("id"), by_letter("o_orderstatus", "F", "O").alias("rank"), F.col("o_orderpriority").alias("name"))
    key = F.col("o_orderkey")
    after = rows.where(key % 10 != 1).withColumn("rank", F.when(key % 7 == 0, 3).otherwise(F.col("rank"))).withColumn("name", F.when(key % 11 == 0, "moved").otherwise(F.col("name")))
    return rows.where(key % 10 != 0).drop("o_orderkey"), after.drop("o_orderkey")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lang, digest of each document's text."""
    return table(spark, sf_dir, "documents").select("doc_id", _id("module", "doc_id").alias("id"), F.col("lang"), F.sha2("text", 256).alias("digest"))


_WRITTEN: dict[tuple[str, str], str] = {}


def data_edges_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``data_edges``, merged and written once a session and set of tables, so that questions about them scan them; ids are made as they are read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/tracewright/data-edges-{uuid.uuid4().hex}"
        data_edges(spark, sf_dir).drop("id").write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key]).select(edge_id(F.col("src"), F.col("kind"), F.col("dst")).alias("id"), "src", "kind", "dst", "rank")
