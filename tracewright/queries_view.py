"""Queries of views, traversals and drift over whole graphs made of tables, each with SQL that gives the same rows."""

from pyspark.sql import functions as F

from tracewright.operators import drift, traverse
from tracewright.plans import estate, views
from tracewright.plans.build import Graph
from tracewright.registry import register

_G = f"WITH RECURSIVE {estate.WITH}"


def _graph(spark, sf):
    return estate.stored(spark, sf)


def _shown(view):
    return view.edges.select("id", "kind", "rank")


def _omitted(reason, rows, shown=5):
    """SQL of one omission: rows is SQL of (id)."""
    return f"SELECT '{reason}' AS reason, count(*) AS n, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT DISTINCT id FROM ({rows}) ORDER BY id LIMIT {shown})) AS examples FROM ({rows}) HAVING count(*) > 0"


_DEPENDS = "SELECT * FROM edges WHERE kind IN ('imports', 're_exports', 'depends_on') AND src IN (SELECT id FROM nodes WHERE kind = 'module')"


@register(f"{_G}, w AS ({_DEPENDS}) SELECT id, kind, rank FROM w WHERE dst IN (SELECT id FROM nodes WHERE kind IN ('module', 'package'))")
def view_dependency_edges(spark, sf):
    return _shown(views.dependencies(*_graph(spark, sf), most=None))


@register(f"{_G}, w AS ({_DEPENDS}), u AS (SELECT src AS id FROM w UNION SELECT dst FROM w) " + _omitted("modules without a dependency in either direction", "SELECT id FROM nodes WHERE kind = 'module' AND id NOT IN (SELECT id FROM u)") + " UNION ALL " + _omitted("an end isn''t drawn", "SELECT id FROM w WHERE dst NOT IN (SELECT id FROM nodes WHERE kind IN ('module', 'package'))"))
def view_dependency_omitted(spark, sf):
    return views.dependencies(*_graph(spark, sf), most=None).omitted


@register(f"{_G} SELECT id, kind, rank FROM edges WHERE kind IN ('contains', 'declared_in') AND src LIKE 'module:%'")
def view_module_edges(spark, sf):
    return _shown(views.modules(*_graph(spark, sf), most=None))


@register(f"""{_G}, t AS (SELECT * FROM nodes WHERE kind = 'class'), o AS (SELECT m.id, max_by(t.id, length(t.qualified_name)) AS owner, min(m.name) AS name FROM nodes m JOIN t ON starts_with(m.qualified_name, t.qualified_name || '.') WHERE m.kind = 'function' GROUP BY m.id),
l AS (SELECT owner, string_agg(name || '()', chr(10) || '+ ' ORDER BY name || '()') AS members FROM o GROUP BY owner) SELECT t.id, concat_ws(chr(10), t.path, '+ ' || members) AS detail FROM t LEFT JOIN l ON owner = t.id""")
def view_class_nodes(spark, sf):
    return views.classes(*_graph(spark, sf), most=None).nodes.select("id", "detail")


@register(f"{_G} SELECT id, kind, rank FROM edges WHERE kind IN ('extends', 'implements') AND dst IN (SELECT id FROM nodes)")
def view_class_edges(spark, sf):
    return _shown(views.classes(*_graph(spark, sf), most=None))


@register(f"{_G}, h AS (SELECT * FROM edges WHERE kind = 'extends'), t AS (SELECT id FROM nodes WHERE kind = 'class') " + _omitted("an end isn''t drawn", "SELECT id FROM h WHERE dst NOT IN (SELECT id FROM t)") + " UNION ALL " + _omitted("types that neither extend nor implement another one here", "SELECT id FROM t WHERE id NOT IN (SELECT src FROM h UNION SELECT dst FROM h)", 3))
def view_class_omitted(spark, sf):
    return views.classes(*_graph(spark, sf), most=None).omitted


@register(f"{_G} SELECT t.id, coalesce(c.name || ': ' || c.data_type, '(no columns detected)') AS detail FROM nodes t LEFT JOIN edges e ON e.src = t.id AND e.kind = 'contains' LEFT JOIN nodes c ON c.id = e.dst WHERE t.kind = 'table'")
def view_er_nodes(spark, sf):
    return views.tables(*_graph(spark, sf), most=None).nodes.select("id", "detail")


@register(f"{_G} SELECT id, 'references size' AS label FROM edges WHERE kind = 'references' AND dst IN (SELECT id FROM nodes)")
def view_er_edges(spark, sf):
    return views.tables(*_graph(spark, sf), most=None).edges.select("id", "label")


@register(f"{_G}, t AS (SELECT * FROM nodes WHERE kind = 'table') " + _omitted("tables that statements use and no schema here declares; what columns they have is not known", "SELECT id FROM t WHERE in_ddl = 'false'", 3) + " UNION ALL " + _omitted("tables whose columns were not read", "SELECT id FROM t WHERE id NOT IN (SELECT src FROM edges WHERE kind = 'contains')", 3))
def view_er_omitted(spark, sf):
    return views.tables(*_graph(spark, sf), most=None).omitted


_RUN = "SELECT * FROM nodes WHERE kind = 'deployment_component' AND declared_as IS DISTINCT FROM 'base_image'"
_KNOWN = "image LIKE 'postgres%' OR image LIKE 'redis%' OR image LIKE '%/mongo:%'"


@register(f"{_G}, r AS ({_RUN}) SELECT 'c4:context:repository:shop->' || id AS id, 'communicates_with' AS kind, 1 AS rank FROM r WHERE {_KNOWN}")
def view_c4_context(spark, sf):
    return _shown(views.context(*_graph(spark, sf), most=None))


_COUPLED = """d AS (SELECT src AS module, max(dst) AS container FROM edges WHERE kind = 'deploys' AND src <> 'module:deploy/compose' GROUP BY src),
x AS (SELECT a.container AS a, b.container AS b, count(*) AS n, min(rank) AS rank FROM edges JOIN d a ON a.module = src JOIN d b ON b.module = dst WHERE kind IN ('imports', 'calls') AND a.container <> b.container GROUP BY ALL)"""


@register(f"{_G}, {_COUPLED} SELECT a AS src, b AS dst, n, rank FROM x")
def container_coupling(spark, sf):
    return views.coupled(*_graph(spark, sf))


@register(f"{_G}, {_COUPLED}, r AS ({_RUN}) SELECT 'c4:container:repository:shop->' || id AS id, 'contains' AS kind, 3 AS rank FROM r UNION ALL SELECT 'c4:container:' || a || '->' || b, 'depends_on', rank FROM x WHERE a IN (SELECT id FROM r) AND b IN (SELECT id FROM r)")
def view_c4_container(spark, sf):
    return _shown(views.containers(*_graph(spark, sf), most=None))


@register(f"{_G}, {_COUPLED} SELECT id, kind, rank FROM edges WHERE kind IN ('imports', 'calls') AND src IN (SELECT module FROM d) AND dst IN (SELECT module FROM d)")
def view_c4_component(spark, sf):
    return _shown(views.components(*_graph(spark, sf), most=None))


@register(f"{_G} SELECT id, kind, rank FROM edges WHERE kind = 'depends_on' AND scope = 'deployment' AND dst IN (SELECT id FROM nodes)")
def view_deployment_edges(spark, sf):
    return _shown(views.deployment(*_graph(spark, sf), most=None))


_FLOWS = "f AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM edges WHERE kind IN ('reads', 'writes') AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))"


@register(f"{_G}, {_FLOWS} SELECT id, kind, rank FROM f WHERE k <= 200")
def view_data_flow_edges(spark, sf):
    return _shown(views.data_flow(*_graph(spark, sf)))


@register(f"{_G}, {_FLOWS} " + _omitted("more than 200 data flows", "SELECT id FROM f WHERE k > 200", 3))
def view_data_flow_omitted(spark, sf):
    return views.data_flow(*_graph(spark, sf)).omitted


@register(f"""{_G}, u AS (SELECT DISTINCT src FROM edges WHERE kind IN ('branches', 'loops') ORDER BY src LIMIT 1000), c AS (SELECT src AS unit, e.dst AS id, lag(e.dst) OVER (PARTITION BY src ORDER BY n.start_line, n.id) AS before FROM edges e JOIN nodes n ON n.id = e.dst JOIN u USING (src) WHERE e.kind IN ('branches', 'loops'))
SELECT 'act:' || coalesce(before, unit) || '->' || id AS id, 'activity' AS kind, 3 AS rank FROM c""")
def view_activity(spark, sf):
    return _shown(views.activity(*_graph(spark, sf)))


@register(f"""{_G}, s AS (SELECT coalesce(n.name, e.dst[8:]) AS name, count(*) AS n_references FROM edges e LEFT JOIN nodes n ON n.id = e.dst WHERE e.kind = 'references_secret' GROUP BY 1)
SELECT name, n_references, EXISTS (SELECT 1 FROM nodes t WHERE t.kind = 'test' AND contains(t.name, s.name)) AS covered FROM s""")
def view_security_secrets(spark, sf):
    return views.security(*_graph(spark, sf))["secrets"]


@register(f"{_G} SELECT id, name LIKE '%:20' AS pinned FROM nodes WHERE declared_as = 'base_image'")
def view_security_images(spark, sf):
    nodes, edges = _graph(spark, sf)
    named = nodes.where(F.col("attributes")["declaredAs"] == "base_image").select("id", "name")
    return named.select("id", views.pinned(F.col("name")).alias("pinned"))


@register(f"""{_G}, r AS ({_RUN}), e AS (SELECT 'c4:context:repository:shop->' || id AS id, 'repository:shop' AS src, id AS dst FROM r WHERE {_KNOWN}), n AS (SELECT id, name FROM r WHERE {_KNOWN} UNION ALL SELECT id, name FROM nodes WHERE kind = 'repository'),
z AS (SELECT 0 AS part, '' AS id, 'flowchart LR ' || CASE WHEN (SELECT count(*) FROM e) > (SELECT count(*) FROM n) THEN 'LR' ELSE 'TD' END AS line
UNION ALL SELECT 1, id, '  n_' || regexp_replace(id, '[^A-Za-z0-9_]', '_', 'g') || '["' || name || '"]' FROM n
UNION ALL SELECT 2, id, '  n_' || regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' -. "WEEKLY_INFERRED" .-> n_' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') FROM e) SELECT part, id, line FROM z""")
def mermaid_context(spark, sf):
    return views.mermaid(views.context(*_graph(spark, sf), most=None))


def _calls_of(spark, sf):
    nodes, edges = _graph(spark, sf)
    calls = edges.where("kind = 'calls'").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return calls, nodes.where("kind = 'api_endpoint'").select(F.col("id").alias("entry"))


# rounds of a breadth-first walk as tables: what is met first in a round, in the order of its first step
def _steps_sql(depth=6):
    out = [f"{_G}, c AS (SELECT id, src, dst FROM edges WHERE kind = 'calls' AND dst IN (SELECT id FROM nodes)), f0 AS (SELECT id AS entry, id AS node, 0::BIGINT AS met FROM nodes WHERE kind = 'api_endpoint'), seen0 AS (SELECT entry, node FROM f0)"]
    for k in range(1, depth + 1):
        out.append(f"h{k} AS (SELECT entry, c.id, src, dst, {k} AS depth, row_number() OVER (PARTITION BY entry ORDER BY met, c.id) AS within FROM f{k - 1} JOIN c ON src = node)")
        out.append(f"f{k} AS (SELECT entry, dst AS node, min(within) AS met FROM h{k} WHERE (entry, dst) NOT IN (SELECT (entry, node) FROM seen{k - 1}) GROUP BY ALL)")
        out.append(f"seen{k} AS (SELECT * FROM seen{k - 1} UNION SELECT entry, node FROM f{k})")
    every = " UNION ALL ".join(f"SELECT * FROM h{k}" for k in range(1, depth + 1))
    return ", ".join(out) + f", every AS (SELECT entry, id, depth, row_number() OVER (PARTITION BY entry ORDER BY depth, within) AS place FROM ({every}))"


@register(_steps_sql() + " SELECT entry, id, depth, place FROM every WHERE place <= 40")
def use_case_steps(spark, sf):
    calls, entries = _calls_of(spark, sf)
    return traverse.steps(calls, entries)[0].select("entry", "id", "depth", "place")


@register(_steps_sql() + " SELECT entry, count(*) AS n_cut FROM every WHERE place > 40 GROUP BY entry")
def use_case_cuts(spark, sf):
    calls, entries = _calls_of(spark, sf)
    return traverse.steps(calls, entries)[1]


@register()
def view_sequence(spark, sf):
    """Depth first: no SQL; held against a recursive walk in plain Python by the tests."""
    return views.sequences(*_graph(spark, sf)).edges.select("id", "src", "dst", "kind")


# -- drift of whole graphs: orders as nodes, lineitems as edges and their evidence

def _snapshot_sql(late: bool):
    skip, up = (1, True) if late else (0, False)
    name = "CASE WHEN o_orderkey % 11 = 0 THEN 'moved' ELSE o_orderpriority END" if up else "o_orderpriority"
    rank = "CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 2 END" if up else "2"
    key = "o_orderkey + CASE WHEN o_orderkey % 13 = 0 THEN 100000000 ELSE 0 END" if up else "o_orderkey"
    nodes = f"SELECT 'module:o' || ({key}) AS id, {name} AS name, {rank} AS rank, 'd' || CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey ELSE o_orderkey % 3 END AS digest, CASE WHEN o_orderkey % 17 = 0 THEN {'2' if up else '1'} ELSE 0 END AS version FROM orders WHERE o_orderkey % 10 <> {skip}"
    keep = "l_linenumber < 4" if up else "l_linenumber > 1"
    weak = "CASE WHEN l_returnflag = 'N' THEN 3 ELSE 1 END" if up else "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 3 END"
    edges = f"SELECT src, dst, min(rank) AS rank, CASE WHEN max(q) > {25 if up else 30} THEN 'large' END AS label FROM (SELECT 'module:o' || l_orderkey AS src, 'table:p' || (l_partkey % 50) AS dst, {weak} AS rank, l_quantity AS q FROM lineitem WHERE {keep}) GROUP BY src, dst"
    cited = f"SELECT DISTINCT 'module:o' || l_orderkey || '|reads|table:p' || (l_partkey % 50) AS id, 'src/' || (l_suppkey % 40) AS path, l_linenumber AS line FROM lineitem WHERE {keep}"
    return nodes, edges, cited


def _snapshot(spark, sf, late):
    import re

    def rows(sql):
        return spark.sql(re.sub(r"FROM (orders|lineitem)\b", r"FROM {\1}", sql), **{t: estate.table(spark, sf, t) for t in ("orders", "lineitem") if f"FROM {t}" in sql})

    none = F.lit(None).cast("string")
    nodes, edges, cited = map(rows, _snapshot_sql(late))
    nodes = nodes.select("id", F.lit("module").alias("kind"), "name", none.alias("qualified_name"), none.alias("path"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), none.alias("language"), "digest", "rank", F.create_map(F.lit("version"), F.col("version").cast("string")).alias("attributes"))
    edges = edges.select(F.concat_ws("|", "src", F.lit("reads"), "dst").alias("id"), "src", F.lit("reads").alias("kind"), "dst", "rank", "label", F.create_map().cast("map<string,string>").alias("attributes"))
    evidence = cited.select(F.concat_ws(":", "path", F.col("line").cast("string")).alias("id"), F.lit("CALL_SITE").alias("kind"), "path", "line").distinct()
    refs = cited.select("id", F.concat_ws(":", "path", F.col("line").cast("string")).alias("evidence")).distinct()
    return Graph(nodes, edges, evidence, refs.limit(0), refs)


def _drift_sql():
    (an, ae, ac), (bn, be, bc) = _snapshot_sql(False), _snapshot_sql(True)
    cited = "SELECT id, string_agg(path || ':' || line, ',' ORDER BY path, line) AS cited FROM {0} GROUP BY id"
    return f"""WITH an AS ({an}), bn AS ({bn}), ac AS ({ac}), bc AS ({bc}), ak AS ({cited.format("ac")}), bk AS ({cited.format("bc")}),
ae AS (SELECT src || '|reads|' || dst AS id, src, dst, rank, label FROM ({ae})), be AS (SELECT src || '|reads|' || dst AS id, src, dst, rank, label FROM ({be})),
went AS (SELECT * FROM an WHERE id NOT IN (SELECT id FROM bn)), came AS (SELECT * FROM bn WHERE id NOT IN (SELECT id FROM an)),
ren AS (SELECT b.id, a.id AS previous_id FROM (SELECT digest, min(id) AS id FROM went GROUP BY 1 HAVING count(*) = 1) a JOIN (SELECT digest, min(id) AS id FROM came GROUP BY 1 HAVING count(*) = 1) b USING (digest)),
n AS (SELECT b.id, a.rank AS ar, b.rank AS br, concat_ws(',', CASE WHEN a.name IS DISTINCT FROM b.name THEN 'name' END, CASE WHEN a.digest IS DISTINCT FROM b.digest THEN 'digest' END, CASE WHEN a.version <> b.version THEN 'attributes' END) AS fields FROM an a JOIN bn b USING (id)),
e AS (SELECT b.id, a.rank AS ar, b.rank AS br, concat_ws(',', CASE WHEN a.rank <> b.rank THEN 'confidence' END, CASE WHEN a.label IS DISTINCT FROM b.label THEN 'label' END) AS fields, ak.cited AS acite, bk.cited AS bcite FROM ae a JOIN be b USING (id) JOIN ak USING (id) JOIN bk USING (id)),
av AS (SELECT DISTINCT path || ':' || line AS id FROM ac), bv AS (SELECT DISTINCT path || ':' || line AS id FROM bc),
c AS (SELECT 'NODE_RENAMED' AS category, id, previous_id, 'path,qualified_name' AS fields FROM ren
UNION ALL SELECT 'NODE_REMOVED', id, NULL, '' FROM went WHERE id NOT IN (SELECT previous_id FROM ren) UNION ALL SELECT 'NODE_ADDED', id, NULL, '' FROM came WHERE id NOT IN (SELECT id FROM ren)
UNION ALL SELECT 'NODE_MODIFIED', id, NULL, fields FROM n WHERE fields <> '' UNION ALL SELECT 'CONFIDENCE_CHANGED', id, NULL, 'confidence' FROM n WHERE ar <> br
UNION ALL SELECT 'EDGE_REMOVED', id, NULL, '' FROM ae WHERE id NOT IN (SELECT id FROM be) UNION ALL SELECT 'EDGE_ADDED', id, NULL, '' FROM be WHERE id NOT IN (SELECT id FROM ae)
UNION ALL SELECT 'EDGE_MODIFIED', id, NULL, fields FROM e WHERE fields <> '' UNION ALL SELECT 'CONFIDENCE_CHANGED', id, NULL, 'confidence' FROM e WHERE ar <> br
UNION ALL SELECT 'EVIDENCE_CHANGED', id, NULL, 'evidence' FROM e WHERE acite <> bcite
UNION ALL SELECT 'EVIDENCE_REMOVED', id, NULL, '' FROM av WHERE id NOT IN (SELECT id FROM bv) UNION ALL SELECT 'EVIDENCE_ADDED', id, NULL, '' FROM bv WHERE id NOT IN (SELECT id FROM av))"""


@register(_drift_sql() + " SELECT category, id, previous_id, fields FROM c")
def drift_graphs(spark, sf):
    return drift.compare(_snapshot(spark, sf, False), _snapshot(spark, sf, True)).select("category", "id", "previous_id", "fields")


@register(_drift_sql() + ", v AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in drift.CATEGORIES) + "]) AS category) SELECT category, count(id) AS n FROM v LEFT JOIN c USING (category) GROUP BY category")
def drift_graph_counts(spark, sf):
    return drift.counts(drift.compare(_snapshot(spark, sf, False), _snapshot(spark, sf, True)))
