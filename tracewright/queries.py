"""The registered queries over the graphs made of tables, each with SQL that gives the same rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions.identity import edge_id, evidence_id, level, slug
from tracewright.functions.redact import MARK, SHAPES, redact, secret_kinds
from tracewright.operators import drift, graph, traverse
from tracewright.plans import adapters as made
from tracewright.registry import QUERIES, SQL, register
from tracewright.streaming import windows

START = "function:7"

_LETTER = "CASE WHEN {0} = '{1}' THEN 3 WHEN {0} = '{2}' THEN 2 ELSE 1 END"
_FLAG, _STATUS = _LETTER.format("l_returnflag", "N", "R"), _LETTER.format("o_orderstatus", "F", "O")
_NODES = f"""nodes AS (
  SELECT 'package:' || r_regionkey AS id, 'package' AS kind, r_name AS name, 3 AS rank FROM region
  UNION ALL SELECT 'module:' || n_nationkey, 'module', n_name, 3 FROM nation
  UNION ALL SELECT 'function:' || c_custkey, 'function', c_name, 3 FROM customer
  UNION ALL SELECT 'deployment_component:' || s_suppkey, 'deployment_component', s_name, 3 FROM supplier
  UNION ALL SELECT 'table:' || p_partkey, 'table', p_name, 3 FROM part
  UNION ALL SELECT 'api_endpoint:' || o_orderkey, 'api_endpoint', o_orderpriority, {_STATUS} FROM orders)"""
_ACCESS = f"""access AS (SELECT 'api_endpoint:' || l_orderkey AS src, CASE WHEN l_linestatus = 'F' THEN 'writes' ELSE 'reads' END AS kind, 'table:' || l_partkey AS dst, {_FLAG} AS rank FROM lineitem)"""
_MERGED = """merged AS (SELECT src || '|' || kind || '|' || dst AS id, src, kind, dst, min(rank) AS rank, count(*) AS observations FROM access GROUP BY src, kind, dst)"""
_DATA = f"""{_ACCESS}, raw AS (
  SELECT * FROM access UNION ALL SELECT 'table:' || l_partkey, 'produces', 'deployment_component:' || l_suppkey, {_FLAG} FROM lineitem),
data0 AS (SELECT src, kind, dst, min(rank) AS rank FROM raw GROUP BY ALL
  UNION ALL SELECT 'function:' || o_custkey, 'produces', 'api_endpoint:' || o_orderkey, {_STATUS} FROM orders
  UNION ALL SELECT 'deployment_component:' || s_suppkey, 'communicates_with', 'module:' || s_nationkey, 3 FROM supplier
  UNION ALL SELECT 'module:' || n_nationkey, 'communicates_with', 'package:' || n_regionkey, 3 FROM nation),
data AS (SELECT src || '|' || kind || '|' || dst AS id, * FROM data0)"""
_STRUCTURE = """structure0 AS (
  SELECT 'module:' || n_nationkey AS src, 'depends_on' AS kind, 'package:' || n_regionkey AS dst, 3 AS rank FROM nation
  UNION ALL SELECT 'module:' || c_nationkey, 'contains', 'function:' || c_custkey, 3 FROM customer
  UNION ALL SELECT 'module:' || s_nationkey, 'deploys', 'deployment_component:' || s_suppkey, 3 FROM supplier
  UNION ALL SELECT 'api_endpoint:' || o_orderkey, 'calls', 'function:' || o_custkey, 3 FROM orders),
structure AS (SELECT src || '|' || kind || '|' || dst AS id, * FROM structure0)"""
_TRADE = """trade AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
_LEDGER = f"""a AS (SELECT 'api_endpoint:' || o_orderkey AS id, {_STATUS} AS rank, o_orderpriority AS name FROM orders WHERE o_orderkey % 10 <> 0),
b AS (SELECT 'api_endpoint:' || o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE {_STATUS} END AS rank, CASE WHEN o_orderkey % 11 = 0 THEN 'moved' ELSE o_orderpriority END AS name FROM orders WHERE o_orderkey % 10 <> 1)"""


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


@register(f"WITH {_NODES} SELECT kind, count(*) AS n, count(*) FILTER (rank = 3) AS n_explicit FROM nodes GROUP BY kind")
def graph_stats_nodes(spark, sf):
    return graph.stats(made.nodes(spark, sf))


@register(f"WITH {_DATA} SELECT kind, count(*) AS n, count(*) FILTER (rank = 3) AS n_explicit FROM data GROUP BY kind")
def graph_stats_edges(spark, sf):
    return graph.stats(made.data_edges_at_rest(spark, sf))


@register(f"WITH {_ACCESS}, {_MERGED} SELECT id, rank, observations FROM merged")
def merge_edges_weakest_confidence(spark, sf):
    return graph.merge_edges(made.accesses(spark, sf)).select("id", "rank", "observations")


@register(f"WITH o AS (SELECT 'table:' || l_partkey AS id, {_FLAG} AS rank, CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS returned, l_orderkey AS first_order FROM lineitem) SELECT id, min(rank) AS rank, min(returned) AS returned, min(first_order) AS first_order FROM o GROUP BY id")
def merge_first_wins(spark, sf):
    rows = made.table(spark, sf, "lineitem").select(F.concat(F.lit("table:"), "l_partkey").alias("id"), made.by_letter("l_returnflag", "N", "R").alias("rank"), F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("returned"), F.col("l_orderkey").alias("first_order"))
    return graph.merge_nodes(rows, F.col("first_order"), ["returned", "first_order"])


@register("SELECT DISTINCT 'ev_' || substr(sha256('orders/' || l_orderkey || ':CALL_SITE:' || l_linenumber || ':tables'), 1, 16) AS id, 'orders/' || l_orderkey AS path, l_linenumber::BIGINT AS line FROM lineitem")
def evidence_ids(spark, sf):
    rows = made.table(spark, sf, "lineitem").select(F.concat(F.lit("orders/"), "l_orderkey").alias("path"), F.col("l_linenumber").cast("long").alias("line")).distinct()
    return rows.select(evidence_id(F.col("path"), F.lit("CALL_SITE"), F.col("line"), F.lit("tables")).alias("id"), "path", "line")


@register(r"SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9._/-]+', '-', 'g'), '-{2,}', '-', 'g'), '/{2,}', '/', 'g'), '^[-.]+|[-.]+$', '', 'g'), '^/+|/+$', '', 'g')) AS slug FROM pages")
def slug_ids(spark, sf):
    return made.table(spark, sf, "pages").select("page_id", slug(F.col("url")).alias("slug"))


@register(f"WITH {_ACCESS}, {_MERGED}, {_NODES}, known AS (SELECT id FROM nodes WHERE NOT (kind = 'table' AND name LIKE 'cold%')) SELECT id FROM merged WHERE src NOT IN (SELECT id FROM known) OR dst NOT IN (SELECT id FROM known)")
def dangling_edges(spark, sf):
    known = made.nodes(spark, sf).where("not (kind = 'table' and name like 'cold%')")
    return graph.dangling(graph.merge_edges(made.accesses(spark, sf)), known).select("id")


@register(f"WITH {_ACCESS}, {_MERGED}, {_NODES}, known AS (SELECT id FROM nodes WHERE NOT (kind = 'table' AND name LIKE 'cold%')) SELECT id, rank FROM merged WHERE src IN (SELECT id FROM known) AND dst IN (SELECT id FROM known)")
def referential_guard(spark, sf):
    known = made.nodes(spark, sf).where("not (kind = 'table' and name like 'cold%')")
    return graph.guard(graph.merge_edges(made.accesses(spark, sf)), known).select("id", "rank")


_FOUND = "found AS (SELECT * FROM nodes WHERE kind = 'function' AND rank = 3 AND contains(lower(name), '00007') ORDER BY id LIMIT 500)"


@register(f"WITH {_NODES}, {_FOUND} SELECT id, name FROM found")
def graph_filter(spark, sf):
    return graph.find_nodes(made.nodes(spark, sf), "function", "EXPLICIT", "00007").select("id", "name")


@register(f"WITH {_STRUCTURE}, {_DATA}, e AS (SELECT id, src, kind, dst FROM structure UNION ALL SELECT id, src, kind, dst FROM data) SELECT id, kind, 'out' AS direction, dst AS other FROM e WHERE src = 'module:3' UNION ALL SELECT id, kind, 'in', src FROM e WHERE dst = 'module:3'")
def node_neighbourhood(spark, sf):
    edges = made.structure_edges(spark, sf).unionByName(made.data_edges(spark, sf))
    return graph.neighbourhood(edges, "module:3")


_KEYS = "[split_part(text, ' ', 1) || '.' || split_part(text, ' ', 2), split_part(text, ' ', 2), split_part(text, ' ', 1)]"


@register(f"""WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), idx AS (SELECT split_part(text, ' ', 3) AS key, min(doc_id) AS target FROM d GROUP BY 1),
c AS (SELECT doc_id AS call_id, unnest(range(3)) AS place, unnest({_KEYS}) AS key FROM d), h AS (SELECT call_id, arg_min(target, place) AS target, min(place) AS place FROM c JOIN idx USING (key) GROUP BY 1)
SELECT doc_id AS call_id, target, place FROM d LEFT JOIN h ON doc_id = call_id""")
def symbol_resolution_rank(spark, sf):
    docs = made.table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("call_id"), *[F.split_part("text", F.lit(" "), F.lit(k)).alias(f"w{k}") for k in (1, 2, 3)])
    index = docs.groupBy(F.col("w3").alias("key")).agg(F.min("call_id").alias("target"))
    out = graph.resolve(docs, F.array(F.concat("w1", F.lit("."), "w2"), "w2", "w1"), index)
    return out.withColumn("place", F.col("place").cast("long"))


def _lineage_sql(near, far, limit=12):
    return f"""WITH RECURSIVE {_DATA}, reach AS (SELECT '{START if near == "src" else "package:1"}' AS node, 0 AS d UNION SELECT {far}, d + 1 FROM reach JOIN data ON {near} = node WHERE d < {limit}),
first AS (SELECT node, min(d) AS d FROM reach GROUP BY node) SELECT id, kind, d + 1 AS depth FROM first JOIN data ON {near} = node WHERE d < {limit}"""


def _hops(spark, sf, start, downstream=True):
    """Hops over edges without ids, which are made of their ends at last."""
    rows = traverse.lineage(made.data_edges_at_rest(spark, sf).drop("id"), start, downstream, at_rest=True)[0]
    return rows.select(edge_id(F.col("src"), F.col("kind"), F.col("dst")).alias("id"), "kind", "depth")


@register(_lineage_sql("src", "dst"))
def lineage_downstream(spark, sf):
    return _hops(spark, sf, START)


@register(_lineage_sql("dst", "src"))
def lineage_upstream(spark, sf):
    return _hops(spark, sf, "package:1", downstream=False)


def _main_trade(spark, sf):
    """Each nation's two largest flows."""
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return made.trade(spark, sf).withColumn("k", place).where("k <= 2")


@register(f"WITH RECURSIVE {_TRADE}, r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM trade), e AS (SELECT src, dst FROM r WHERE k <= 2), " """
p AS (SELECT src AS first, dst AS next, [src] AS path FROM e
UNION ALL SELECT first, e.dst, list_append(path, e.src) FROM p JOIN e ON p.next = e.src WHERE p.next > first AND NOT list_contains(path, p.next) AND len(path) < 64)
SELECT len(path)::INTEGER AS length, array_to_string(path, '>') AS key FROM p WHERE next = first ORDER BY length, key LIMIT 20""")
def dependency_cycles(spark, sf):
    """The first twenty among the nations' two largest flows."""
    return traverse.cycles(_main_trade(spark, sf))[0]


@register(f"WITH {_TRADE} SELECT src, dst, n FROM trade WHERE src <> dst")
def cross_container_deps(spark, sf):
    return made.trade(spark, sf).where("src <> dst")


_DRIFT = f"""WITH {_LEDGER}, j AS (SELECT coalesce(a.id, b.id) AS id, a.id AS ai, b.id AS bi, a.rank AS ar, b.rank AS br, a.name AS an, b.name AS bn FROM a FULL JOIN b ON a.id = b.id),
c AS (SELECT 'NODE_ADDED' AS category, id, '' AS detail FROM j WHERE ai IS NULL UNION ALL SELECT 'NODE_REMOVED', id, '{{removed}}' FROM j WHERE bi IS NULL
UNION ALL SELECT 'NODE_MODIFIED', id, 'name' FROM j WHERE ai IS NOT NULL AND bi IS NOT NULL AND an IS DISTINCT FROM bn
UNION ALL SELECT 'CONFIDENCE_CHANGED', id, ar || '>' || br FROM j WHERE ar <> br) """


@register(_DRIFT.format(removed="") + "SELECT * FROM c")
def drift_changes(spark, sf):
    return drift.node_drift(*made.ledger(spark, sf), ["name"])


@register(_DRIFT.format(removed="") + "SELECT category, count(*) AS n FROM c GROUP BY category")
def drift_counts(spark, sf):
    return drift_changes(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@register(_DRIFT.format(removed="INDETERMINATE") + "SELECT id, detail FROM c WHERE category = 'NODE_REMOVED'")
def drift_indeterminate(spark, sf):
    return drift.node_drift(*made.ledger(spark, sf), ["name"], truncated=True).where("category = 'NODE_REMOVED'").select("id", "detail")


@register("""WITH d AS (SELECT doc_id, 'module:' || doc_id AS id, lang, sha256(text) AS digest FROM documents WHERE text IS NOT NULL),
a AS (SELECT digest, min(id) AS id, min(lang) AS lang FROM d WHERE doc_id % 2 = 0 GROUP BY digest HAVING count(*) = 1), b AS (SELECT digest, min(id) AS id, min(lang) AS lang FROM d WHERE doc_id % 2 = 1 GROUP BY digest HAVING count(*) = 1)
SELECT a.id AS old_id, b.id AS new_id, digest FROM a JOIN b USING (digest) WHERE a.lang IS NOT DISTINCT FROM b.lang""")
def drift_renames(spark, sf):
    docs = made.corpus(spark, sf)
    return drift.renames(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["lang"])


@register(f"WITH {_NODES}, h AS (SELECT sha256(id || chr(31) || kind || chr(31) || coalesce(name, '') || chr(31) || rank) AS h FROM nodes) SELECT count(*) AS n, sha256(concat_ws('|', count(*), " + ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)" for k in range(8)) + ")) AS digest FROM h")
def snapshot_digest(spark, sf):
    return graph.digest(made.nodes(spark, sf), ["id", "kind", "name", "rank"])


@register(f"WITH {_DATA}, {_NODES} SELECT data.id, data.kind FROM data WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) ORDER BY data.id LIMIT 200")
def view_data_flow(spark, sf):
    edges = made.data_edges_at_rest(spark, sf)
    flow = edges.where(F.col("kind").isin(*traverse.DATA_KINDS))
    return graph.guard(flow, made.nodes(spark, sf)).orderBy("id").limit(200).select("id", "kind")


@register(f"WITH {_STRUCTURE}, {_NODES} SELECT structure.id, p.name AS package FROM structure JOIN nodes p ON dst = p.id WHERE structure.kind = 'depends_on'")
def view_dependency(spark, sf):
    targets = made.nodes(spark, sf).where("kind = 'package'").select(F.col("id").alias("dst"), F.col("name").alias("package"))
    return made.structure_edges(spark, sf).where("kind = 'depends_on'").join(targets, "dst").select("id", "package")


@register(f"WITH {_STRUCTURE} SELECT src, count(*) AS n FROM structure WHERE kind IN ('contains', 'declared_in') GROUP BY src")
def view_module(spark, sf):
    return made.structure_edges(spark, sf).where("kind in ('contains', 'declared_in')").groupBy("src").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {_STRUCTURE}, {_NODES} SELECT n.id, n.name, s.src AS container FROM structure s JOIN nodes n ON s.dst = n.id WHERE s.kind = 'deploys'")
def view_deployment(spark, sf):
    parts = made.nodes(spark, sf).where("kind = 'deployment_component'")
    edges = made.structure_edges(spark, sf).where("kind = 'deploys'").select(F.col("src").alias("container"), F.col("dst").alias("id"))
    return parts.join(edges, "id").select("id", "name", "container")


@register(f"WITH {_ACCESS}, {_MERGED}, o AS (SELECT id, 'weak ' || kind AS reason, row_number() OVER (PARTITION BY kind ORDER BY id) AS k FROM merged WHERE rank < 2) SELECT reason, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (k <= 5) AS examples FROM o GROUP BY reason")
def omission_log(spark, sf):
    weak = graph.merge_edges(made.accesses(spark, sf)).where("rank < 2")
    return graph.omissions(weak.select("id", F.concat(F.lit("weak "), "kind").alias("reason")))


@register(f"WITH {_ACCESS}, {_MERGED} SELECT src AS endpoint, count(*) FILTER (kind = 'reads') AS n_reads, count(*) FILTER (kind = 'writes') AS n_writes, bool_and(rank = 3) AS all_explicit FROM merged GROUP BY src")
def trace_index(spark, sf):
    edges = graph.merge_edges(made.accesses(spark, sf))
    return edges.groupBy(F.col("src").alias("endpoint")).agg(F.count_if(F.col("kind") == "reads").alias("n_reads"), F.count_if(F.col("kind") == "writes").alias("n_writes"), F.bool_and(F.col("rank") == 3).alias("all_explicit"))


@register("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn, role FROM conversations")
def activity_chain(spark, sf):
    follows = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return made.table(spark, sf, "conversations").select("conv_id", "turn", follows.alias("next_turn"), "role")


@register("WITH used AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), declared AS (SELECT p_partkey AS k FROM part WHERE p_size > 5) SELECT k, 'unused' AS finding FROM declared WHERE k NOT IN (SELECT k FROM used) UNION ALL SELECT k, 'undeclared' FROM used WHERE k NOT IN (SELECT k FROM declared)")
def dependency_hygiene(spark, sf):
    used = made.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).distinct()
    declared = made.table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("k"))
    unused = declared.join(used, "k", "left_anti").select("k", F.lit("unused").alias("finding"))
    return unused.unionByName(used.join(declared, "k", "left_anti").select("k", F.lit("undeclared").alias("finding")))


_OUTCOME = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' WHEN 'click' THEN 'timed_out' WHEN 'view' THEN 'blocked' ELSE 'not_run' END"


@register(f"SELECT user_id, arg_max({_OUTCOME}, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY user_id")
def latest_status(spark, sf):
    events = made.table(spark, sf, "events").withColumn("status", F.expr(_OUTCOME))
    return events.groupBy("user_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("n"))


@register("SELECT coalesce(lang, 'unknown') AS language, count(*) AS n FROM documents GROUP BY 1")
def language_counts(spark, sf):
    return made.table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT doc_id, total, total > 1000000 AS truncated FROM (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id)::BIGINT AS total FROM documents)")
def budget_truncation(spark, sf):
    rows = graph.running_total(made.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 10_000)
    return rows.select("doc_id", "total", (F.col("total") > 1_000_000).alias("truncated"))


def _shape_sql(name: str, shape: str) -> str:
    """A shape without back references, which DuckDB hasn't: quotes that pair are spelt out."""
    value = r"[^\s\"',;]{6,}"
    if name == "key-value-secret":
        shape = shape.replace(rf"([\"']?)({value})\2", rf"(?:\"{value}\"|'{value}'|{value})")
    return shape.replace(r"\"", '"').replace("'", "''")


def _redact_sql(text: str) -> str:
    for name, shape in SHAPES:
        new = {"bearer-token": rf"\1{MARK}", "key-value-secret": rf"\1{MARK}", "credential-in-url": rf"\1\2:{MARK}@"}.get(name, MARK)
        text = f"regexp_replace({text}, '{_shape_sql(name, shape)}', '{new}', 'g')"
    return text


@register(f"SELECT doc_id, sha256({_redact_sql('text')}) AS digest FROM documents")
def redact_documents(spark, sf):
    return made.table(spark, sf, "documents").select("doc_id", F.sha2(redact(F.col("text")), 256).alias("digest"))


_KINDS = ", ".join(f"CASE WHEN regexp_matches(text, '{_shape_sql(n, shape)}') THEN '{n}' END" for n, shape in SHAPES)


@register(f"SELECT * FROM (SELECT doc_id, concat_ws(',', {_KINDS}) AS kinds FROM documents) WHERE kinds <> ''")
def secret_kinds_found(spark, sf):
    return made.table(spark, sf, "documents").select("doc_id", secret_kinds(F.col("text")).alias("kinds")).where("kinds <> ''")


@register("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark, sf):
    return windows.tumbling(made.table(spark, sf, "events"))


@register("""WITH m AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 minutes THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    return windows.sessions(made.table(spark, sf, "events"))


@register(f"WITH {_NODES} SELECT id, CASE rank WHEN 3 THEN 'EXPLICIT' WHEN 2 THEN 'STRONGLY_INFERRED' WHEN 1 THEN 'WEEKLY_INFERRED' ELSE 'UNKNOWN' END AS confidence FROM nodes WHERE kind = 'api_endpoint'")
def confidence_levels(spark, sf):
    return made.nodes(spark, sf).where("kind = 'api_endpoint'").select("id", level(F.col("rank")).alias("confidence"))


from tracewright import queries_build, queries_code, queries_config, queries_rules, queries_sources, queries_view  # noqa: E402, F401, they register their queries
