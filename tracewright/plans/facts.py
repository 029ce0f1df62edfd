"""Fact tables made of relational ones, so that every rule of the builder runs at any size.

Nations are source files, customers functions in them, suppliers classes, orders
calls and routes, lineitems SQL accesses, parts table declarations, conversations
control flow, events commits. ``SQL`` has the same rows for DuckDB.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.plans.adapters import table
from tracewright.plans.shapes import SCHEMAS

#: Each fact table as SQL that Spark and DuckDB read alike; what SCHEMAS names besides is null.
SQL = {
    "files": """SELECT 'src/n' || n_nationkey || '.ts' AS path, 'typescript' AS language, 'd' || n_name AS digest, true AS analyzable, n_nationkey AS seq FROM nation
UNION ALL SELECT 'src/r' || r_regionkey || '/index.ts', 'typescript', 'd' || r_name, true, 100 + r_regionkey FROM region
UNION ALL SELECT 'test/n' || n_nationkey || '.test.ts', 'typescript', 't' || n_name, true, 200 + n_nationkey FROM nation
UNION ALL SELECT 'db/schema.sql', 'sql', 'schema', true, 300""",
    "entities": """SELECT 'src/n' || c_nationkey || '.ts' AS path, 'function' AS kind, 'c' || c_custkey AS name, 'mod.c' || c_custkey AS qualified_name, c_custkey * 10 AS start_line, c_custkey * 10 + 9 AS end_line, CAST(NULL AS VARCHAR(9)) AS parent, c_custkey AS seq FROM customer
UNION ALL SELECT 'src/n' || s_nationkey || '.ts', 'class', 'S' || s_suppkey, 'S' || s_suppkey, s_suppkey, s_suppkey, 'S' || CAST(floor(s_suppkey / 2) AS INT), 1000000000 + s_suppkey FROM supplier""",
    "imports": """SELECT 'src/n' || s_nationkey || '.ts' AS path, CASE s_suppkey % 4 WHEN 0 THEN './n' || (s_suppkey % 30) || '.js' WHEN 1 THEN './r' || (s_suppkey % 7) WHEN 2 THEN 'pkg' || (s_suppkey % 7) ELSE '../src/./n' || (s_suppkey % 25) END AS specifier,
CASE WHEN s_suppkey % 4 = 3 THEN 'reexport' ELSE 'static' END AS kind, s_suppkey AS line, s_suppkey % 4 = 2 AS is_external, s_suppkey AS seq FROM supplier""",
    "calls": """SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'test/n' || (o_custkey % 25) || '.test.ts' ELSE 'src/n' || (o_custkey % 25) || '.ts' END AS path,
CASE o_orderkey % 3 WHEN 0 THEN 'repo.c' || (o_orderkey % 60 + 1) WHEN 1 THEN 'mod.c' || (o_orderkey % 90 + 1) || '()' ELSE 'unknown.fn' END AS callee, o_orderkey % 1000000 AS line, CASE WHEN o_orderstatus <> 'P' THEN 'mod.c' || o_custkey END AS scope, o_orderkey AS seq FROM orders""",
    "routes": """SELECT 'src/n' || (o_custkey % 25) || '.ts' AS path, 'GET' AS method, '/o/' || o_orderkey AS route, 'mod.c' || (o_orderkey % 45 + 1) AS handler, o_orderkey % 1000000 AS line, o_orderkey AS seq FROM orders WHERE o_orderkey % 40 = 0""",
    "tables": """SELECT 'db/schema.sql' AS path, 'p' || p_partkey AS tbl, p_size AS n_columns, p_partkey AS line, p_partkey AS seq FROM part WHERE p_partkey % 2 = 0""",
    "keys": """SELECT 'db/schema.sql' AS path, 'p' || p_partkey AS tbl, 'p' || CAST(floor(p_partkey / 2) AS INT) AS to_tbl, p_partkey AS line, 1000000000 + p_partkey AS seq FROM part WHERE p_partkey % 4 >= 2 OR p_partkey % 8 = 0""",
    "accesses": """SELECT 'src/n' || (l_suppkey % 25) || '.ts' AS path, 'p' || l_partkey AS tbl, CASE WHEN l_linestatus = 'F' THEN 'write' ELSE 'read' END AS operation, CASE WHEN l_returnflag <> 'R' THEN 'mod.c' || (l_orderkey % 100 + 1) END AS scope, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS seq FROM lineitem""",
    "flows": """SELECT 'src/n' || (conv_id % 25) || '.ts' AS path, CASE WHEN role = 'user' THEN 'branch' WHEN role = 'system' THEN 'handler' ELSE 'loop' END AS flow, 'mod.c' || (conv_id % 120 + 1) AS scope, turn AS line, conv_id * 100 + turn AS seq FROM conversations""",
    "throws": """SELECT 'src/n' || c_nationkey || '.ts' AS path, c_custkey * 10 + 1 AS line, 'mod.c' || c_custkey AS scope, CASE WHEN c_custkey % 2 = 0 THEN 'throw' ELSE 'reject' END AS via, c_custkey AS seq FROM customer WHERE c_custkey % 3 = 1""",
    "responses": """SELECT 'src/n' || c_nationkey || '.ts' AS path, c_custkey * 10 + 2 AS line, 'mod.c' || c_custkey AS scope, CASE WHEN c_custkey % 2 = 0 THEN 404 ELSE 200 END AS status, c_custkey % 5 = 0 AS status_only, c_custkey AS seq FROM customer""",
    "returns": """SELECT 'src/n' || (o_custkey % 25) || '.ts' AS path, o_orderkey % 1000000 AS line, 'mod.c' || o_custkey AS scope, CASE WHEN o_orderkey % 5 = 0 THEN 'identifier' ELSE 'call' END AS kind,
CASE WHEN o_orderkey % 5 = 0 THEN 'v' || (o_orderkey % 4) WHEN o_orderkey % 3 = 0 THEN 'repo.c' || (o_orderkey % 60 + 1) ELSE 'mod.c' || (o_orderkey % 90 + 1) END AS name, o_orderkey AS seq FROM orders WHERE o_orderkey % 2 = 0""",
    "bindings": """SELECT 'src/n' || (o_custkey % 25) || '.ts' AS path, 'v' || (o_orderkey % 4) AS name, 'mod.c' || (o_orderkey % 90 + 1) AS callee, 'mod.c' || o_custkey AS scope, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 = 1""",
    "commits": """SELECT 'h' || event_id AS hash, 'U' || user_id AS author, 'User' || user_id || '@X.org' AS email, 'src/n' || (event_id % 27) || '.ts' AS file, event_id AS seq FROM events WHERE event_type = 'purchase'""",
}


def _rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in ("nation", "region", "customer", "supplier", "orders", "lineitem", "part", "conversations", "events") if t in SQL[name]}
    sql = SQL[name]
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used)


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    def of(source, schema, **given):
        rows = _rows(spark, sf_dir, source)
        have = set(rows.columns)
        given = {"producer": F.lit("tables"), **given}
        return rows.select(*((given[n] if n in given else F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in (f.strip().split(" ", 1) for f in SCHEMAS[schema].split(", "))))

    def marker(source, marker, **attributes):
        # a value may be null: rules read attributes by key, and Spark then makes no map at all
        given = F.create_map(*(x for k, v in attributes.items() for x in (F.lit(k), v.cast("string"))))
        return of(source, "markers", name=marker if not isinstance(marker, str) else F.lit(marker), attributes=given)

    c = F.col
    markers = [
        marker("routes", "http.route", httpMethod=c("method"), path=c("route"), handler=c("handler")),
        marker("tables", "schema.table", table=c("tbl"), columnCount=c("n_columns")),
        marker("keys", "schema.foreign_key", table=c("tbl"), referencesTable=c("to_tbl")),
        marker("accesses", "sql.query", table=c("tbl"), operation=c("operation"), scope=c("scope")),
        marker("flows", F.concat(F.lit("control."), c("flow")), scope=c("scope")),
    ]
    both = markers[0]
    for m in markers[1:]:
        both = both.unionByName(m)
    return {
        "files": of("files", "files"),
        "entities": of("entities", "entities", extends_from=F.when(c("parent").isNotNull(), F.array("parent"))),
        "imports": of("imports", "imports"),
        "calls": of("calls", "calls", from_qualified_name=c("scope")),
        "markers": both,
        "returns": of("returns", "returns", from_qualified_name=c("scope")),
        "bindings": of("bindings", "bindings", from_qualified_name=c("scope")),
        "throws": of("throws", "throws", from_qualified_name=c("scope")),
        "responses": of("responses", "responses", method=F.lit("json"), from_qualified_name=c("scope")),
        "commits": of("commits", "commits", author_name=c("author"), author_email=c("email"), files=F.array("file")),
    }
