"""Queries of sources, stores, orders and table functions, each with SQL that gives the same rows."""

import datetime
import uuid

from pyspark.sql import functions as F

from tracewright.extract import functions
from tracewright.functions.order import by_folder, placed, shown
from tracewright.plans import estate, views
from tracewright.plans.shapes import Graph
from tracewright.queries_view import _G
from tracewright.registry import register
from tracewright.sources import blame, files
from tracewright.sources.store import Store
from tracewright.storage import shared_dir


@register("SELECT doc_id, t.name AS \"table\", t.access AS access FROM documents, LATERAL (VALUES ('t' || doc_id % 7, 'write'), ('u' || doc_id % 3, 'read')) t(name, access)")
def udtf_sql_access(spark, sf):
    """The SQL reader as a table function, in SQL, over whole texts."""
    functions.register(spark)
    docs = estate.table(spark, sf, "documents")
    return spark.sql(
        """SELECT d.doc_id, s.table, s.access FROM {docs} d, LATERAL sql_access(concat('INSERT INTO t', d.doc_id % 7, ' SELECT * FROM u', d.doc_id % 3, ' WHERE x = ''', replace(coalesce(d.text, ''), '''', ''''''), '''')) s""", docs=docs
    )


@register("SELECT c_custkey AS k, v.kind AS kind, v.name AS name FROM customer, LATERAL (VALUES ('class', 'C' || c_custkey), ('function', 'C' || c_custkey || '.m'), ('function', 'f' || c_nationkey)) v(kind, name)")
def udtf_code_entities(spark, sf):
    """The source reader as a table function, in SQL."""
    functions.register(spark)
    rows = estate.table(spark, sf, "customer")
    return spark.sql(
        """SELECT c.c_custkey AS k, f.fields['kind'] AS kind, f.fields['qualified'] AS name FROM {customer} c,
        LATERAL code_facts('a.ts', 'typescript', concat('class C', c.c_custkey, ' {{ m(): void {{ go(); }} }}\nexport const f', c.c_nationkey, ' = (x: number): string => g(x);')) f WHERE f.fact = 'entity'""", customer=rows
    )


@register("SELECT 'd' || c_custkey || '/compose.yml' AS path, 'compose' AS producer, 'compose.service' AS name, 's' || c_nationkey AS service FROM customer UNION ALL SELECT 'x' || c_custkey || '.sql', 'ddl', 'schema.table', 't' || c_custkey FROM customer")
def udtf_config_markers(spark, sf):
    """The reader of a file goes by its path."""
    functions.register(spark)
    rows = estate.table(spark, sf, "customer")
    return spark.sql(
        """WITH f AS (SELECT concat('d', c_custkey, '/compose.yml') AS path, concat('services:\n  s', c_nationkey, ':\n    image: a') AS text FROM {customer} UNION ALL SELECT concat('x', c_custkey, '.sql'), concat('CREATE TABLE t', c_custkey, ' (id INT)') FROM {customer}
        UNION ALL SELECT concat('y', c_custkey, '.bin'), 'x' FROM {customer}) SELECT f.path, m.producer, m.name, coalesce(m.attributes['service'], m.attributes['table']) AS service FROM f, LATERAL config_markers(f.path, f.text) m WHERE m.name IN ('compose.service', 'schema.table')""", customer=rows
    )


_LINES = "SELECT 'src/n' || (l_suppkey % 25) || '.ts' AS path, CAST(l_orderkey % 3000 AS INT) AS line, min(l_partkey) AS who FROM lineitem GROUP BY ALL"


def _blamed(spark, sf):
    rows = estate.table(spark, sf, "lineitem").groupBy(F.concat(F.lit("src/n"), F.col("l_suppkey") % 25, F.lit(".ts")).alias("path"), (F.col("l_orderkey") % 3000).cast("int").alias("line")).agg(F.min("l_partkey").alias("who"))
    commit = F.sha1(F.col("who").cast("string"))
    text = F.concat(commit, F.lit(" 1 "), "line", F.lit(" 1\nauthor A\nauthor-mail <User"), F.col("who") % 20, F.lit("@X.org>\nsummary author-mail <no>\n\tcode "), commit, F.lit(" 7 8\n"))
    return rows.groupBy("path").agg(F.array_join(F.collect_list(text), "").alias("value"))


@register(f"SELECT path, line, sha1(who::VARCHAR) AS commit, 'User' || who % 20 || '@X.org' AS email FROM ({_LINES})")
def blame_lines(spark, sf):
    """Exported blame, a text a file, back to lines."""
    return blame.lines(_blamed(spark, sf))


@register(
    f"""WITH l AS ({_LINES}), e AS (SELECT 'e' || c_custkey AS entity, 'src/n' || c_nationkey || '.ts' AS path, c_custkey * 17 % 2500 AS a, c_custkey * 17 % 2500 + c_custkey % 200 AS b FROM customer), m AS (SELECT entity, 'user' || who % 20 || '@x.org' AS email, count(*) AS n_lines FROM e JOIN l ON l.path = e.path AND line BETWEEN a AND b GROUP BY ALL)
SELECT entity, email, n_lines, n_lines / sum(n_lines) OVER (PARTITION BY entity) AS share FROM m"""
)
def entity_ownership(spark, sf):
    """Whose lines each declaration is made of."""
    start = F.col("c_custkey") * 17 % 2500
    entities = estate.table(spark, sf, "customer").select(F.concat(F.lit("e"), "c_custkey").alias("entity"), F.concat(F.lit("src/n"), "c_nationkey", F.lit(".ts")).alias("path"), start.cast("int").alias("start_line"), (start + F.col("c_custkey") % 200).cast("int").alias("end_line"))
    return blame.ownership(blame.lines(_blamed(spark, sf)), entities)


_PATHS = "SELECT 'src/n' || c_nationkey || '/f' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' ELSE '.lock.json' END AS path, c_custkey AS byte_size FROM customer"


def _listed(spark, sf):
    return spark.sql(_PATHS.replace("FROM customer", "FROM {customer}"), customer=estate.table(spark, sf, "customer"))


@register(f"SELECT path, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM ({_PATHS})")
def path_places(spark, sf):
    """Places of paths in the order of a sorted walk, dealt by ranges."""
    return placed(_listed(spark, sf), by_folder(F.col("path"))).select("path", "place")


@register(f"SELECT path, bytes FROM (SELECT path, sum(byte_size) OVER (ORDER BY string_split(path, '/')) AS bytes, row_number() OVER (ORDER BY string_split(path, '/')) AS n FROM ({_PATHS})) WHERE bytes <= 5000 AND n <= 100")
def budgeted_files(spark, sf):
    """The files that fit in a budget of bytes and files, in the order of a sorted walk."""
    rows = _listed(spark, sf).withColumn("listed", F.lit(True))
    return files.budgeted(rows, most_files=100, most_bytes=5000, width=13)[0].select("path", "bytes")


@register("SELECT n_name AS name, row_number() OVER (ORDER BY lower(n_name), n_name) AS place FROM nation")
def names_as_shown(spark, sf):
    """Names in the order of the root collation (these names have one case)."""
    return placed(estate.table(spark, sf, "nation").select(F.col("n_name").alias("name")), shown(F.col("name"))).select("name", "place")


def _store(spark, sf):
    store = Store(spark, f"{shared_dir(spark)}/tracewright/store-{uuid.uuid4().hex}")
    nodes, edges = estate.stored(spark, sf)
    day = datetime.datetime(2026, 1, 1)
    some = edges.select(F.xxhash64("id").alias("seq"), F.lit("X").alias("code"), F.lit("info").alias("severity"), F.col("id").alias("message"), F.lit(None).cast("string").alias("path")).where("message like '%|deploys|%'")
    store.save("a", Graph(nodes, edges, None, None, None), "first", day, diagnostics=some)
    store.fail("b", "broken", "second", day + datetime.timedelta(1))
    store.save("c", Graph(nodes.where("kind <> 'test'"), edges.where("kind <> 'tests'"), None, None, None), "third", day + datetime.timedelta(2))
    return store


@register(f"{_G} SELECT kind, count(*) AS n FROM nodes WHERE kind <> 'test' GROUP BY kind")
def store_nodes(spark, sf):
    """Nodes of the last analysis, as they come back from the store."""
    return _store(spark, sf).listed("nodes", "c").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register(f"{_G} SELECT 'out' AS way, id FROM edges WHERE src = 'module:src/n3' UNION ALL SELECT 'in', id FROM edges WHERE dst = 'module:src/n3'")
def store_neighbours(spark, sf):
    """Edges at either end of a node, each from the copy that is sorted by that end."""
    store = _store(spark, sf)
    out, into = store.outgoing("a", "module:src/n3"), store.incoming("a", "module:src/n3")
    return out.select(F.lit("out").alias("way"), "id").unionByName(into.select(F.lit("in").alias("way"), "id"))


@register(f"{_G} SELECT id AS message FROM edges WHERE kind = 'deploys'")
def store_diagnostics(spark, sf):
    return _store(spark, sf).listed("diagnostics", "a").select("message")


_NEEDS = ", ".join(f"('{kind}', '{title}', '{','.join(kinds)}')" for kind, (title, _, kinds) in views.REGISTERED.items())


@register(f"{_G}, v AS (SELECT * FROM (VALUES {_NEEDS}) v(kind, title, kinds)), n AS (SELECT v.kind, v.title, v.kinds, count(e.id) AS n_edges FROM v LEFT JOIN edges e ON list_contains(string_split(v.kinds, ','), e.kind) GROUP BY ALL) SELECT kind, title, n_edges, kinds = '' OR n_edges > 0 AS sufficient FROM n")
def views_supported(spark, sf):
    """The registered views and whether the graph has what they draw."""
    return views.supported(estate.stored(spark, sf)[1])
