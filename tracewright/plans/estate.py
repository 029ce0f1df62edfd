"""A whole repository's graph made of tables: SQL that Spark and DuckDB read alike.

Nations are modules with imports between them, suppliers components, customers
classes and their members, parts tables with a column, conversations control flow.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.adapters import table
from tracewright.storage import shared_dir

TABLES = ("nation", "region", "customer", "supplier", "orders", "lineitem", "part", "conversations")
#: id, kind, name, qualified_name, path, rank, start_line and what becomes attributes.
NODES = """SELECT 'repository:shop' AS id, 'repository' AS kind, 'shop' AS name, NULL AS qualified_name, '.' AS path, 3 AS rank, 0 AS start_line, NULL AS image, NULL AS declared_as, NULL AS data_type, NULL AS in_ddl
UNION ALL SELECT 'module:deploy/compose', 'module', 'deploy/compose', NULL, 'deploy/compose.yml', 3, 1, NULL, NULL, NULL, NULL
UNION ALL SELECT 'module:src/n' || n_nationkey, 'module', 'src/n' || n_nationkey, NULL, 'src/n' || n_nationkey || '.ts', 3, 1, NULL, NULL, NULL, NULL FROM nation
UNION ALL SELECT 'package:' || r_regionkey, 'package', r_name, NULL, NULL, 3, 1, NULL, NULL, NULL, NULL FROM region
UNION ALL SELECT 'deployment_component:s' || s_suppkey, 'deployment_component', CASE WHEN s_suppkey % 5 = 0 THEN 'node:' || (CASE WHEN s_suppkey % 2 = 0 THEN 'latest' ELSE '20' END) ELSE 's' || s_suppkey END, NULL, 'deploy/compose.yml', 3, s_suppkey,
 CASE s_suppkey % 4 WHEN 0 THEN 'postgres:16' WHEN 1 THEN 'acme/api:1' WHEN 2 THEN 'redis' ELSE 'docker.io/library/mongo:7' END, CASE WHEN s_suppkey % 5 = 0 THEN 'base_image' ELSE 'service' END, NULL, NULL FROM supplier
UNION ALL SELECT 'class:c' || c_custkey, 'class', 'C' || c_custkey, 'C' || c_custkey, 'src/n' || c_nationkey || '.ts', 3, c_custkey, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'function:c' || CAST(floor(c_custkey / 3) * 3 AS INT) || '.m' || c_custkey, 'function', 'm' || c_custkey, 'C' || CAST(floor(c_custkey / 3) * 3 AS INT) || '.m' || c_custkey, 'src/n' || c_nationkey || '.ts', 3, c_custkey, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 3 > 0
UNION ALL SELECT 'table:p' || p_partkey, 'table', 'p' || p_partkey, NULL, NULL, 3, 1, NULL, NULL, NULL, CASE WHEN p_partkey % 3 = 0 THEN 'false' ELSE 'true' END FROM part
UNION ALL SELECT 'column:p' || p_partkey || '.size', 'column', 'size', NULL, NULL, 3, 1, NULL, NULL, 'int' || (p_partkey % 3), NULL FROM part WHERE p_partkey % 3 > 0
UNION ALL SELECT 'test:t' || o_orderkey, 'test', 'checks TOKEN_' || (o_orderkey % 7) || ' of ' || o_orderkey, NULL, 'test/a.ts', 3, 1, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 300 = 0
UNION ALL SELECT 'api_endpoint:o' || o_orderkey, 'api_endpoint', 'GET /o/' || o_orderkey, NULL, 'src/n' || (o_orderkey % 25) || '.ts', 3, 1, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 50 = 1
UNION ALL SELECT 'secret:TOKEN_' || r_regionkey, 'secret', 'TOKEN_' || r_regionkey, NULL, NULL, 3, 1, NULL, NULL, NULL, NULL FROM region
UNION ALL SELECT 'condition:' || conv_id || '-' || turn || '-' || role, 'condition', role, NULL, NULL, 3, turn, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)
UNION ALL SELECT 'function:guard' || r_regionkey, 'function', 'guard' || r_regionkey, NULL, NULL, 3, 1, NULL, NULL, NULL, NULL FROM region
UNION ALL SELECT 'requirement:q' || s_suppkey, 'requirement', 'Q-' || s_suppkey, NULL, 'docs/needs.md', 3, s_suppkey, NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'actor:a' || n_nationkey, 'actor', 'A' || n_nationkey, NULL, 'src/n' || n_nationkey || '.ts', 3, 1, NULL, NULL, NULL, NULL FROM nation WHERE n_nationkey % 3 = 0"""
#: src, kind, dst, rank, scope, col, callee
EDGES = """SELECT *, NULL AS callee FROM (SELECT 'module:src/n' || s_nationkey AS src, 'deploys' AS kind, 'deployment_component:s' || s_suppkey AS dst, 2 AS rank, NULL AS scope, NULL AS col FROM supplier
UNION ALL SELECT 'module:deploy/compose', 'deploys', 'deployment_component:s' || s_suppkey, 3, NULL, NULL FROM supplier
UNION ALL SELECT DISTINCT 'module:src/n' || (o_custkey % 25), CASE WHEN o_orderstatus = 'F' THEN 'imports' ELSE 'calls' END, 'module:src/n' || (o_orderkey % 31), CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 1 END, NULL, NULL FROM orders WHERE o_orderkey % 9 = 0
UNION ALL SELECT 'module:src/n' || n_nationkey, 'depends_on', 'package:' || n_regionkey, 3, NULL, NULL FROM nation WHERE n_nationkey % 6 <> 5
UNION ALL SELECT 'module:src/n' || c_nationkey, 'contains', 'class:c' || c_custkey, 3, NULL, NULL FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'class:c' || c_custkey, 'extends', 'class:c' || c_custkey * 2, 2, NULL, NULL FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 4 = 0
UNION ALL SELECT 'table:p' || p_partkey, 'contains', 'column:p' || p_partkey || '.size', 3, NULL, NULL FROM part WHERE p_partkey % 3 > 0
UNION ALL SELECT 'table:p' || p_partkey, 'references', 'table:p' || CAST(floor(p_partkey / 2) AS INT), 3, NULL, 'size' FROM part
UNION ALL SELECT 'deployment_component:s' || s_suppkey, 'depends_on', 'deployment_component:s' || CAST(floor(s_suppkey / 2) AS INT), 3, 'deployment', NULL FROM supplier
UNION ALL SELECT 'deployment_component:s' || s_suppkey, 'references_secret', 'secret:TOKEN_' || (s_suppkey % 9), 3, NULL, NULL FROM supplier
UNION ALL SELECT 'api_endpoint:o' || o_orderkey, 'calls', 'function:c' || CAST(floor(o_custkey / 3) * 3 AS INT) || '.m' || o_custkey, 2, NULL, NULL FROM orders WHERE o_orderkey % 50 = 1 AND o_custkey % 3 > 0
UNION ALL SELECT DISTINCT 'function:c' || CAST(floor(o_custkey / 3) * 3 AS INT) || '.m' || o_custkey, 'calls', 'function:c' || CAST(floor((o_orderkey % 150) / 3) * 3 AS INT) || '.m' || (o_orderkey % 150), 2, NULL, NULL FROM orders WHERE o_custkey % 3 > 0 AND o_orderkey % 3 > 0
UNION ALL SELECT DISTINCT 'function:c' || CAST(floor(o_custkey / 3) * 3 AS INT) || '.m' || o_custkey, CASE WHEN l_linestatus = 'F' THEN 'writes' ELSE 'reads' END, 'table:p' || l_partkey, 3, NULL, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 3 > 0 AND l_linenumber = 1
UNION ALL SELECT DISTINCT 'test:t' || o_orderkey, 'tests', 'api_endpoint:o' || (o_orderkey + 1), 2, NULL, NULL FROM orders WHERE o_orderkey % 300 = 0
UNION ALL SELECT DISTINCT 'function:c' || CAST(floor(conv_id / 3) * 3 AS INT) || '.m' || conv_id, CASE WHEN role = 'user' THEN 'branches' ELSE 'loops' END, 'condition:' || conv_id || '-' || turn || '-' || role, 3, NULL, NULL FROM conversations WHERE conv_id % 3 > 0) e
UNION ALL SELECT 'function:c' || CAST(floor(c_custkey / 3) * 3 AS INT) || '.m' || c_custkey, 'calls', 'function:guard' || (c_custkey % 5), 2, NULL, NULL,
 CASE c_custkey % 5 WHEN 0 THEN 'validateOrder' WHEN 1 THEN 'invalidate' WHEN 2 THEN 'parse' WHEN 3 THEN 'hasPermissionTo' ELSE 'checkStock' END FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 8 = 1
UNION ALL SELECT 'requirement:q' || s_suppkey, 'implements_requirement', 'function:c' || CAST(floor(s_suppkey / 3) * 3 AS INT) || '.m' || s_suppkey, 3, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 3 > 0
UNION ALL SELECT 'deployment_component:s' || s_suppkey, 'authenticates', 'module:src/n' || s_nationkey, 3, NULL, NULL, NULL FROM supplier WHERE s_suppkey % 7 = 0
UNION ALL SELECT 'function:c' || CAST(floor((o_orderkey % 150) / 3) * 3 AS INT) || '.m' || (o_orderkey % 150), CASE WHEN o_orderkey % 4 = 1 THEN 'returns' ELSE 'throws' END, 'function:c' || CAST(floor(o_custkey / 3) * 3 AS INT) || '.m' || (o_custkey + CASE WHEN o_orderkey % 8 = 1 THEN 3 ELSE 0 END), 2, NULL, NULL, NULL FROM (SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders WHERE o_custkey % 3 > 0 AND o_orderkey % 3 > 0 GROUP BY o_custkey) x"""
#: The same as tables ``nodes`` and ``edges`` of a SQL statement.
WITH = f"nodes AS ({NODES}), edges0 AS ({EDGES}), edges AS (SELECT src || '|' || kind || '|' || dst AS id, * FROM edges0)"


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    import re

    return spark.sql(re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", sql), **{t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"(FROM|JOIN) {t}\b", sql)})


def _map(**columns):
    parts = [F.struct(F.lit(k).alias("key"), F.col(v).cast("string").alias("value")) for k, v in columns.items()]
    return F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull()))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, NODES)
    given = _map(image="image", declaredAs="declared_as", dataType="data_type", declaredInDdl="in_ddl")
    return rows.select("id", "kind", "name", F.col("qualified_name").cast("string").alias("qualified_name"), "path", "rank", F.col("start_line").cast("int").alias("start_line"), given.alias("attributes"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, EDGES)
    none = F.lit(None).cast("string")
    return rows.select(F.concat_ws("|", "src", "kind", "dst").alias("id"), "src", "kind", "dst", "rank", none.alias("label"), _map(scope="scope", column="col", callee="callee").alias("attributes"))


def dealt(rows: DataFrame, each: int = 1000) -> DataFrame:
    """Rows from which files are made, ``each`` a task: a table of keys is small and read by one task, the files to parse are not."""
    return rows.repartition(max(1, -(-rows.count() // each)))


_WRITTEN: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) written once a session and set of tables, so that views scan them instead of deriving them anew."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WRITTEN:
        path = f"{shared_dir(spark)}/tracewright/estate-{uuid.uuid4().hex}"
        nodes(spark, sf_dir).write.parquet(f"{path}/nodes")
        edges(spark, sf_dir).write.parquet(f"{path}/edges")
        _WRITTEN[key] = path
    return spark.read.parquet(f"{_WRITTEN[key]}/nodes"), spark.read.parquet(f"{_WRITTEN[key]}/edges")
