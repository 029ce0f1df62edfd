"""An evidence graph out of fact tables.

Facts are DataFrames by name (``SCHEMAS``); a missing one counts as empty. Each rule
turns facts into observations of nodes and edges; observations are merged by id:
the weakest confidence, each field and attribute the first that isn't null by
``seq``, all evidence. Evidence ids stay rows (``node_refs``, ``edge_refs``), so a
node that everything mentions is no large array. All nodes exist before any edge
is guarded, so the order of the facts doesn't matter. Lookups are equi-joins on
candidate keys, ranked by their place.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.identity import edge_id, evidence_id, slug
from tracewright.functions.paths import module_name, normalised
from tracewright.operators.graph import guard
from tracewright.plans.deploy import Deployment
from tracewright.plans.shapes import EDGE, EXPLICIT, NODE, SCHEMAS, STRONG, UNKNOWN, WEAK, Graph, attributes, edges_of, merged_edges, merged_nodes, module_id, nodes_of, typed
from tracewright.storage import stored_table

def resolve_by_rank(rows: DataFrame, key: str, candidates: Column, index: DataFrame, keep: list[str]) -> DataFrame:
    """(key, keep...) of the first candidate that ``index`` (name, keep...) knows, for each ``key`` of ``rows``."""
    asked = rows.select(key, F.posexplode(candidates).alias("place", "name")).where("name is not null and name <> ''")
    hit = asked.join(index, "name").groupBy(key).agg(F.min_by(F.struct(*keep), "place").alias("hit"))
    return hit.select(key, "hit.*")


def callee_keys(callee: Column) -> Column:
    """The whole text, that without call brackets, its last part, its first part."""
    bare = F.regexp_replace(callee, r"\(\)", "")
    return F.array(callee, bare, F.substring_index(bare, ".", -1), F.substring_index(bare, ".", 1))


#: What may stand behind a relative specifier, in the order in which it is tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".py", ".json")


def import_keys(path: Column, specifier: Column) -> Column:
    """Paths that a relative specifier may mean; none for another specifier or one that leaves the repository."""
    folder = F.regexp_replace(path, r"(^|/)[^/]*$", "")
    whole = normalised(F.concat_ws("/", folder, specifier))
    ends = [whole, *(F.concat(whole, F.lit(e)) for e in EXTENSIONS), *(F.concat(whole, F.lit(f"/index{e}")) for e in EXTENSIONS[:4])]
    ends += [F.regexp_replace(whole, r"\.js$", ".ts"), F.regexp_replace(whole, r"\.js$", ".tsx"), F.regexp_replace(whole, r"\.mjs$", ".mts")]
    return F.when(specifier.startswith("."), F.array(*ends))


class Builder(Deployment):
    """The rules over one set of facts. Each rule gives (node observations, edge observations) or one of them."""

    def __init__(self, spark: SparkSession, facts: dict[str, DataFrame], name: str = "repository"):
        self.spark, self.root = spark, name
        self.facts = {k: facts.get(k) if k in facts else spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
        self.repository = F.lit(f"repository:{name}")
        self.known: dict[str, DataFrame] = {}  # what several rules read, stored by ``graph``
        self.asked: dict[str, tuple | DataFrame] = {}  # what rules gave to ``node_ids`` and ``edge_ids``
        self.sized = False  # whether lookups are stored, so that their true sizes decide how they are joined

    # -- evidence and lookups

    def cited(self, rows: DataFrame, kind: str, line: Column | None = None, path: Column | None = None, producer: Column | None = None) -> DataFrame:
        """``rows`` with their evidence: its id and what it cites."""
        line = F.greatest(F.col("line") if line is None else line, F.lit(0)).cast("int")
        path, producer = F.col("path") if path is None else path, F.col("producer") if producer is None else producer
        id_ = evidence_id(path, F.lit(kind), line, producer)
        return rows.withColumn("evidence", F.struct(id_.alias("id"), F.lit(kind).alias("kind"), path.alias("path"), line.alias("line"), producer.alias("producer")))

    def symbols(self) -> DataFrame:
        """(name, target, target_kind, at): each name's and qualified name's first declaration."""
        if "symbols" in self.known:
            return self.known["symbols"]
        rows = self.facts["entities"].select(F.explode(F.array_distinct(F.array("qualified_name", "name"))).alias("name"), self._entity().alias("target"), F.col("kind").alias("target_kind"), F.col("path").alias("at"), "seq")
        return rows.where("name is not null").groupBy("name").agg(F.min_by(F.struct("target", "target_kind", "at"), "seq").alias("s")).select("name", "s.*")

    def _lookup(self, rows: DataFrame) -> DataFrame:
        return stored_table(rows, "lookup") if self.sized else rows

    def _entity(self) -> Column:
        return F.concat(F.col("kind"), F.lit(":"), slug(F.coalesce("qualified_name", "name")))

    def scoped(self, rows: DataFrame, scope: Column) -> DataFrame:
        """``rows`` with ``owner``: the declared symbol of that name, else the module; ``known`` says which."""
        index = self.symbols().select(F.col("name").alias("_scope"), F.col("target").alias("_owner"))
        rows = rows.withColumn("_scope", scope)
        if self.sized:
            index = self._lookup(index.join(rows.select("_scope").distinct(), "_scope", "left_semi"))
        rows = rows.join(index, "_scope", "left")
        return rows.withColumn("owner", F.coalesce("_owner", module_id(F.col("path")))).withColumn("known", F.col("_owner").isNotNull()).drop("_scope", "_owner")

    def called(self, rows: DataFrame, callee: str = "callee") -> DataFrame:
        """``rows`` with target, target_kind and at of what ``callee`` means; rows whose callee isn't known go."""
        hit = resolve_by_rank(rows.select(callee).distinct(), callee, callee_keys(F.col(callee)), self.symbols(), ["target", "target_kind", "at"])
        return rows.join(self._lookup(hit), callee)

    def named(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` with target and target_kind of the declaration of exactly this name; others go."""
        index = self.symbols().select(F.col("name").alias(name), "target", "target_kind")
        return rows.join(index, name)

    def marked(self, *names: str) -> DataFrame:
        return self.facts["markers"].where(F.col("name").isin(*names))

    # -- rules

    def modules(self):
        rows = self.cited(self.facts["files"].where("analyzable"), "DECLARATION", F.lit(1), producer=F.lit("files"))
        nodes = nodes_of(rows, "module", module_name(F.col("path")), language=F.col("language"), path=F.col("path"), digest=F.col("digest"), start_line=F.lit(1))
        return nodes, edges_of(rows, self.repository, "contains", module_id(F.col("path")))

    def repository_node(self):
        row = self.spark.createDataFrame([(".", 0)], "path string, seq bigint")
        row = self.cited(row, "DECLARATION", F.lit(0), producer=F.lit("files"))
        return nodes_of(row, "repository", F.lit(self.root), path=F.lit("."))

    def entities(self):
        rows = self.cited(self.facts["entities"], "DECLARATION", F.col("start_line"))
        given = {c: F.col(c) for c in ("qualified_name", "language", "path", "start_line", "end_line")}
        nodes = nodes_of(rows, F.col("kind"), F.col("name"), key=F.coalesce("qualified_name", "name"), attributes=F.map_concat(attributes(isAsync=F.col("is_async")), F.coalesce("attributes", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))), **given)
        return nodes, edges_of(rows, module_id(F.col("path")), "contains", self._entity())

    def inheritance(self):
        rows = self.cited(self.facts["entities"], "DECLARATION", F.col("start_line"))
        each = rows.select("evidence", "seq", self._entity().alias("src"), F.explode(F.map_from_arrays(F.array(F.lit("extends"), F.lit("implements")), F.array(F.coalesce("extends_from", F.array().cast("array<string>")), F.coalesce("implements_from", F.array().cast("array<string>"))))).alias("how", "names"))
        each = each.select("evidence", "seq", "src", "how", F.explode("names").alias("callee"))
        hit = self.named(each, "callee").where(F.col("target_kind").isin("class", "interface", "type") & (F.col("target") != F.col("src")))
        return edges_of(hit, F.col("src"), F.col("how"), F.col("target"), STRONG)

    def _import_targets(self) -> DataFrame:
        rows = self.facts["imports"].withColumn("key", F.concat_ws("\x1f", "path", "specifier"))
        known = self.facts["files"].where("analyzable").select(F.col("path").alias("name"), F.col("path").alias("found")).distinct()
        asked = rows.select("key", "path", "specifier").distinct()
        return rows.join(resolve_by_rank(asked, "key", import_keys(F.col("path"), F.col("specifier")), known, ["found"]), "key", "left")

    def imports(self):
        rows = self.cited(self._import_targets(), "IMPORT_STATEMENT")
        inside, outside = rows.where("found is not null"), rows.where("found is null and is_external")
        source, label = module_id(F.col("path")), F.array_join("names", ", ")
        how = F.when(F.col("kind") == "reexport", "re_exports").otherwise("imports")
        package = F.concat(F.lit("package:"), slug(F.col("specifier")))
        edges = [
            edges_of(inside, source, how, module_id(F.col("found")), label=label, attributes=attributes(specifier=F.col("specifier"), typeOnly=F.col("kind") == "type_only")),
            edges_of(outside, self.repository, "contains", package),
            edges_of(outside, source, "depends_on", package, label=label, attributes=attributes(external=True)),
        ]
        return nodes_of(outside, "package", F.col("specifier")), reduce(DataFrame.unionByName, edges)

    def dangling_imports(self) -> DataFrame:
        """path, specifier, line of the relative imports that no file answers."""
        return self._import_targets().where("found is null and not is_external").select("path", "specifier", "line")

    def calls(self):
        if "calls" in self.known:
            return self.known["calls"]
        rows = self.scoped(self.called(self.cited(self.facts["calls"], "CALL_SITE")), F.col("from_qualified_name"))
        rows = rows.where("owner <> target")
        given = attributes(callee=F.col("callee"), sameModule=F.col("at") == F.col("path"))
        return edges_of(rows, F.col("owner"), "calls", F.col("target"), F.when(F.col("known"), STRONG).otherwise(WEAK), attributes=given)

    def _routes(self) -> DataFrame:
        rows = self.cited(self.marked("http.route"), "ROUTE_DECLARATION")
        name = F.concat_ws(" ", F.coalesce(F.col("attributes")["httpMethod"], F.lit("ANY")), F.coalesce(F.col("attributes")["path"], F.lit("/")))
        return rows.withColumn("endpoint", name).withColumn("endpoint_id", F.concat(F.lit("api_endpoint:"), slug(name))).withColumn("handler", F.col("attributes")["handler"])

    def routes(self):
        rows = self._routes()
        handled = self.named(rows.where("handler is not null"), "handler")
        module, a = module_id(F.col("path")), F.col("attributes")
        nodes = nodes_of(rows, "api_endpoint", F.col("endpoint"), path=F.col("path"), start_line=F.col("line"), attributes=attributes(httpMethod=F.coalesce(a["httpMethod"], F.lit("ANY")), route=F.coalesce(a["path"], F.lit("/")), handler=F.col("handler")))
        edges = [
            edges_of(rows, module, "exposes", F.col("endpoint_id")),
            edges_of(rows, F.col("endpoint_id"), "declared_in", module),
            edges_of(handled, F.col("endpoint_id"), "calls", F.col("target"), STRONG, attributes=attributes(derivedFrom="route.handler", handler=F.col("handler"))),
        ]
        return nodes, reduce(DataFrame.unionByName, edges)

    def schema(self):
        a = F.col("attributes")
        tables, columns, keys = (self.cited(self.marked(f"schema.{n}"), "SCHEMA_DDL") for n in ("table", "column", "foreign_key"))
        table = F.concat(F.lit("table:"), slug(a["table"]))
        column = F.concat_ws(".", a["table"], a["column"])
        nodes = [
            nodes_of(tables, "table", a["table"], path=F.col("path"), start_line=F.col("line"), attributes=attributes(columnCount=a["columnCount"], primaryKey=a["primaryKey"], declaredInDdl=True)),
            nodes_of(columns, "column", column, path=F.col("path"), start_line=F.col("line"), attributes=attributes(dataType=a["dataType"], primaryKey=a["primaryKey"], notNull=a["notNull"], unique=a["unique"], referencesTable=a["referencesTable"])),
        ]
        edges = [
            edges_of(tables, module_id(F.col("path")), "declares_schema", table),
            edges_of(columns, table, "contains", F.concat(F.lit("column:"), slug(column))),
            edges_of(keys, table, "references", F.concat(F.lit("table:"), slug(a["referencesTable"])), attributes=attributes(column=a["column"], referencesColumn=a["referencesColumn"])),
        ]
        return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)

    def _undeclared(self) -> DataFrame:
        """Nodes of the tables that statements name and no DDL declares: they stay unknown; a declared one isn't weakened by being used."""
        a = F.col("attributes")
        table = F.concat(F.lit("table:"), slug(a["table"]))
        declared = self.marked("schema.table").select(table.alias("declared")).distinct()
        unknown = self.cited(self.marked("sql.query"), "CALL_SITE").withColumn("declared", table).join(declared, "declared", "left_anti")
        return nodes_of(unknown, "table", a["table"], UNKNOWN, attributes=attributes(declaredInDdl=False))

    def sql(self):
        a = F.col("attributes")
        rows = self.scoped(self.cited(self.marked("sql.query"), "CALL_SITE"), a["scope"])
        table = F.concat(F.lit("table:"), slug(a["table"]))
        how = F.when(a["operation"] == "write", "writes").otherwise("reads")
        given = attributes(operation=a["operation"], role=a["role"], statement=a["statement"], statementCount=a["statementCount"], scopeUnknown=F.when(~F.col("known"), F.lit(True)))
        edges = edges_of(rows, F.col("owner"), how, table, F.when(F.col("known"), EXPLICIT).otherwise(WEAK), attributes=given)
        return self._undeclared(), edges

    def queries(self):
        """Common table expressions, and statements that could not be classified."""
        a = F.col("attributes")
        ctes = self.scoped(self.cited(self.marked("sql.cte"), "CALL_SITE"), a["scope"]).where("known")
        ctes = ctes.withColumn("cte", F.explode(F.split(a["names"], ","))).withColumn("cte", F.trim("cte")).where("cte <> ''")
        others = self.scoped(self.cited(self.marked("sql.statement"), "CALL_SITE"), a["scope"]).withColumn("summary", F.substring(F.coalesce(a["summary"], F.lit("statement")), 1, 120))
        cte = F.concat(F.lit("cte:"), a["scope"], F.lit("::"), F.col("cte"))
        other = F.concat_ws(":", F.lit("statement"), F.col("path"), F.col("line").cast("string"), F.col("summary"))
        nodes = [
            nodes_of(ctes, "constant", F.col("cte"), key=cte, qualified_name=cte, path=F.col("path"), start_line=F.col("line"), attributes=attributes(queryExpression=True, statement=a["statement"])),
            nodes_of(others, "constant", F.col("summary"), UNKNOWN, key=other, qualified_name=other, path=F.col("path"), start_line=F.col("line"), attributes=attributes(unclassifiedStatement=True, reason=a["unsupported"])),
        ]
        edges = [
            edges_of(ctes, F.col("owner"), "produces", F.concat(F.lit("constant:"), slug(cte)), attributes=attributes(queryExpression=True)),
            edges_of(others, F.col("owner"), "contains", F.concat(F.lit("constant:"), slug(other)), F.when(F.col("known"), EXPLICIT).otherwise(WEAK), attributes=attributes(unclassifiedStatement=True)),
        ]
        return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)

    def conditions(self):
        a = F.col("attributes")
        rows = self.cited(self.marked("control.branch", "control.loop", "control.handler"), "DECLARATION")
        rows = self.scoped(rows, a["scope"]).where("known").withColumn("flow", F.substring_index("name", ".", -1))
        key = F.concat(a["scope"], F.lit("#"), F.col("line").cast("string"), F.lit(":"), F.col("flow"))
        nodes = nodes_of(rows, "condition", F.coalesce(a["condition"], F.col("flow")), key=key, path=F.col("path"), start_line=F.col("line"), attributes=attributes(flow=F.col("flow"), condition=a["condition"], scope=a["scope"]))
        how = F.when(F.col("flow") == "loop", "loops").otherwise("branches")
        return nodes, edges_of(rows, F.col("owner"), how, F.concat(F.lit("condition:"), slug(key)))

    def requirements(self):
        a = F.col("attributes")
        rows = self.cited(self.marked("doc.requirement"), "DECLARATION")
        key = F.coalesce(a["identifier"], F.concat(F.col("path"), F.lit("#"), F.col("line").cast("string")))
        this, module = F.concat(F.lit("requirement:"), slug(key)), module_id(F.col("path"))
        rows = rows.withColumn("target_name", a["implementsRef"])
        symbols = self.symbols().select(F.col("name").alias("target_name"), "target")
        # a module is meant by its name, without an ending
        modules = self.facts["files"].where("analyzable").select(module_id(F.col("path")).alias("target_module")).distinct()
        linked = rows.where("target_name is not null").join(symbols, "target_name", "left").withColumn("target_module", F.concat(F.lit("module:"), slug(F.col("target_name"))))
        linked = linked.join(modules.withColumn("there", F.lit(True)), "target_module", "left").withColumn("to", F.coalesce("target", F.when(F.col("there"), F.col("target_module")))).where("to is not null")
        nodes = nodes_of(rows, "requirement", F.coalesce(a["identifier"], F.substring(a["statement"], 1, 80)), key=key, path=F.col("path"), start_line=F.col("line"), attributes=attributes(statement=a["statement"], identifier=a["identifier"]))
        return nodes, edges_of(rows, module, "declared_in", this).unionByName(edges_of(linked, this, "implements_requirement", F.col("to"), attributes=attributes(statedIn=F.col("path"), reference=F.col("target_name"))))

    def tests(self):
        a = F.col("attributes")
        rows = self.cited(self.marked("test.suite", "test.case"), "TEST_ASSERTION")
        key = F.concat(F.col("path"), F.lit("#"), F.col("line").cast("string"), F.lit(":"), F.substring_index("name", ".", -1), F.lit(":"), a["title"])
        nodes = nodes_of(rows, "test", a["title"], key=key, path=F.col("path"), start_line=F.col("line"), attributes=F.map_concat(attributes(declaration=F.substring_index("name", ".", -1)), a))
        return nodes, edges_of(rows, module_id(F.col("path")), "contains", F.concat(F.lit("test:"), slug(key)))

    def manifests(self):
        a = F.col("attributes")
        rows = self.cited(self.marked("manifest.dependency"), "MANIFEST_FIELD")
        nodes = nodes_of(rows, "package", a["dependency"], attributes=attributes(range=a["range"], section=a["section"]))
        return nodes, edges_of(rows, module_id(F.col("path")), "depends_on", F.concat(F.lit("package:"), slug(a["dependency"])), attributes=attributes(declared=True, declaredIn=F.col("path")))

    def git(self):
        rows = self.facts["commits"].withColumn("path", F.lit(".git")).withColumn("producer", F.lit("git"))
        rows = self.cited(rows, "GIT_COMMIT", F.lit(0))
        commit, person = F.concat(F.lit("commit:"), slug(F.col("hash"))), F.concat(F.lit("contributor:"), slug(F.lower("author_email")))
        changed = rows.select("hash", "evidence", "seq", F.explode("files").alias("path"))
        nodes = nodes_of(rows, "commit", F.col("hash"), attributes=attributes(subject=F.col("subject"))).unionByName(nodes_of(rows, "contributor", F.col("author_name"), key=F.lower("author_email")))
        edges = [edges_of(rows, self.repository, "contains", person), edges_of(rows, person, "authored_by", commit), edges_of(changed, commit, "modifies", module_id(F.col("path")))]
        return nodes, reduce(DataFrame.unionByName, edges)

    def returns(self):
        """Values that come back: from a call that is returned at once, if its function is known to make it, or from a variable that one call alone of the file is bound to."""
        rows = self.cited(self.facts["returns"], "CALL_SITE")
        keep = ["path", "seq", "evidence", "from_qualified_name", "kind", "awaited", "expression"]
        index = self.symbols().select(F.col("name").alias("from_qualified_name"), F.col("target").alias("owner"))
        direct = self.named(rows.where("name is not null").select(*keep, F.col("name").alias("callee")), "callee").join(index, "from_qualified_name").where("owner <> target")
        made = self.called(self.facts["calls"].where("from_qualified_name is not null").select("path", "from_qualified_name", "callee")).select("path", "from_qualified_name", "target").distinct()
        direct = direct.join(made, ["path", "from_qualified_name", "target"], "left_semi")
        given = attributes(returnKind=F.col("kind"), awaited=F.when(F.col("awaited"), True), expression=F.col("expression"))
        edges = edges_of(direct, F.col("target"), "returns", F.col("owner"), STRONG, attributes=given)

        once = self.facts["bindings"].where("from_qualified_name is not null").groupBy("path", "from_qualified_name", "name")
        once = once.agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("callee", "line", "producer")], F.max(F.coalesce("awaited", F.lit(False))).alias("awaited_binding")).where("n = 1")
        returned = rows.where("kind = 'identifier'").select("path", "seq", F.col("evidence").alias("returned_at"), "from_qualified_name", "name", "awaited")
        bound = self.cited(returned.join(once, ["path", "from_qualified_name", "name"]), "CALL_SITE")
        hit = self.called(bound).join(index, "from_qualified_name")
        given = attributes(returnKind="identifier", inferred=True, via=F.col("name"), awaited=F.when(F.col("awaited_binding") | F.coalesce("awaited", F.lit(False)), True))
        weak = edges_of(hit, F.col("target"), "returns", F.col("owner"), WEAK, attributes=given)
        also = edges_of(hit.withColumn("evidence", F.col("returned_at")), F.col("target"), "returns", F.col("owner"), WEAK, attributes=given)
        return edges.unionByName(weak).unionByName(also)

    def throws(self):
        rows = self.scoped(self.cited(self.facts["throws"], "CALL_SITE"), F.col("from_qualified_name")).where("known")
        handled = self._handled().select(F.col("endpoint_id").alias("caller"), F.col("target").alias("owner"))
        callers = self.calls().select(F.col("src").alias("caller"), F.col("dst").alias("owner")).unionByName(handled).distinct()
        hit = rows.join(callers, "owner").where("caller <> owner")
        return edges_of(hit, F.col("owner"), "throws", F.col("caller"), STRONG, attributes=attributes(via=F.col("via"), rejects=F.when(F.col("rejects"), True), expression=F.col("expression")))

    def _handled(self) -> DataFrame:
        """(endpoint_id, target): the endpoints whose handler is declared."""
        if "handled" in self.known:
            return self.known["handled"]
        return self.named(self._routes().where("handler is not null").select("endpoint_id", "handler"), "handler").select("endpoint_id", "target").distinct()

    def _answers(self) -> DataFrame:
        return self.named(self.cited(self.facts["responses"], "ROUTE_DECLARATION").where("from_qualified_name is not null"), "from_qualified_name")

    def responses(self):
        """Responses go to the endpoints whose handler is the declaration that makes them."""
        hit = self._answers().join(self._handled(), "target")
        given = attributes(httpResponse=True, method=F.col("method"), status=F.col("status"), payload=F.col("payload"), payloadKind=F.col("payload_kind"), statusOnly=F.when(F.col("status_only"), True))
        return edges_of(hit, F.col("target"), "returns", F.col("endpoint_id"), F.when(F.col("status_only"), STRONG).otherwise(EXPLICIT), attributes=given)

    def tested(self):
        """A caller that is a test or is declared in a test file tests the endpoints whose handler it calls.

        Calls between the same two meet endpoints once, as the first of them; ``graph`` cites the others.
        """
        handlers = self._handled().select(F.col("endpoint_id").alias("endpoint"), F.col("target").alias("dst"))
        declared = self.facts["entities"].select(self._entity().alias("src"), "path", "seq").unionByName(self.facts["files"].where("analyzable").select(module_id(F.col("path")).alias("src"), "path", "seq"))
        first = declared.groupBy("src").agg(F.min_by("path", "seq").alias("path")).where(is_test(F.col("path")) | F.col("src").startswith("test:")).select("src")
        calls = self.calls().join(first, "src", "left_semi").groupBy("src", "dst")
        calls = calls.agg(*[F.min_by(c, "seq").alias(c) for c in ("attributes", "evidence")], F.min("seq").alias("seq"))
        hit = calls.join(handlers, "dst")
        return edges_of(hit, F.col("src"), "tests", F.col("endpoint"), STRONG, attributes=attributes(viaHandler=F.col("attributes")["callee"], hops=1))

    def tallied(self) -> DataFrame:
        """Observations that add to declarations what they return, throw and answer; they cite nothing of their own."""
        index = self.symbols().select(F.col("name").alias("from_qualified_name"), F.col("target").alias("id"))
        of = lambda fact: self.facts[fact].join(index, "from_qualified_name")
        returned = of("returns").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max_by("kind", "seq").alias("shape"), F.max(F.coalesce("awaited", F.lit(False))).alias("awaited"))
        thrown = of("throws").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        statuses = of("responses").groupBy("id", "status").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"))
        seen = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status").isNotNull(), F.struct("seq", F.col("status").cast("string").alias("status"))))), lambda s: s["status"]), ",")
        answered = statuses.groupBy("id").agg(F.sum("n").alias("n"), seen.alias("statuses"))
        last = F.lit((1 << 62)).cast("bigint")
        parts = [
            returned.select("id", attributes(hasReturn=True, returnCount=F.col("n"), returnsShape=F.col("shape"), returnsAwaited=F.when(F.col("awaited"), True)).alias("attributes")),
            thrown.select("id", attributes(throwSites=F.col("n")).alias("attributes")),
            answered.select("id", attributes(httpResponses=F.col("n"), httpResponseStatuses=F.nullif(F.col("statuses"), F.lit(""))).alias("attributes")),
        ]
        rows = reduce(DataFrame.unionByName, parts)
        return typed(rows, NODE, {"id": F.col("id"), "rank": F.lit(EXPLICIT), "attributes": F.col("attributes"), "seq": last})

    # -- the whole

    def counters(self) -> dict[str, int]:
        """What ``graph`` counts as it writes, of the rules that it counts alone."""
        rules = Builder(self.spark, self.facts, self.root)
        rules.sized = True
        rules.known["symbols"] = stored_table(rules.symbols(), "symbols")
        n = lambda rows, *kinds: (rows.where(F.col("kind").isin(*kinds)) if kinds else rows).count()
        nodes = {"entities": n(rules.entities()[0]), "routes": n(rules.routes()[0]), "tests": n(rules.tests()[0]), "tables": n(rules.schema()[0], "table"), "commits": n(rules.git()[0], "commit")}
        linked = rules.imports()[1]
        return self._counters(nodes, {"calls": n(rules.calls()), "inside": n(linked, "imports", "re_exports"), "outside": n(linked, "depends_on")})

    #: Rules that give an end only where its node is observed too, or where it is a module's.
    CLOSED = ("modules", "entities", "inheritance", "imports", "calls", "routes", "sql", "queries", "conditions", "requirements", "tests", "manifests", "git", "returns", "throws", "responses", "tested")

    #: Rules that give nodes, besides those of tables that statements name.
    STATING = ("modules", "entities", "imports", "routes", "schema", "queries", "conditions", "requirements", "tests", "manifests", "git", "components", "deployed", "secrets", "configuration")

    def node_ids(self) -> DataFrame:
        """(id, kind) of the nodes of ``graph``, without merging what they say."""
        if "node_ids" not in self.known:
            self.sized = True
            if "symbols" not in self.known:
                self.known["symbols"] = stored_table(self.symbols(), "symbols")
            # each name once before it becomes an id; declared tables among them are nodes anyway
            named = self.marked("sql.query").select(F.col("attributes")["table"].alias("name")).distinct()
            named = named.select(F.concat(F.lit("table:"), slug(F.col("name"))).alias("id"), F.lit("table").alias("kind"))
            rules = {"repository": self.repository_node, "sql": lambda: named} | {rule: lambda rule=rule: getattr(self, rule)()[0] for rule in self.STATING}
            seen = reduce(DataFrame.unionByName, [rows().select("id", "kind") for rows in rules.values()])
            self.known["node_ids"] = stored_table(seen.where("id is not null and kind is not null").distinct(), "node-ids")
        return self.known["node_ids"]

    def edge_ids(self) -> DataFrame:
        """(src, kind, dst) of the edges of ``graph``, without merging what they say.

        Ends of ``CLOSED`` rules are nodes by themselves, so of those only modules are looked up, in a table that is small where
        files are few; all nodes are asked for the other ends alone.
        """
        parts = []
        for rule, got in self._rules().items():
            rows = got[1] if isinstance(got, tuple) else got
            if rows is not None:
                sure = lambda end: F.coalesce(F.lit(rule in self.CLOSED) & ~F.col(end).startswith("module:"), F.lit(False)).alias(f"{end}_there")  # noqa: B023, E731
                parts.append(rows.select("src", "kind", "dst", sure("src"), sure("dst")))
        nodes = self.node_ids()
        rows = reduce(DataFrame.unionByName, parts).groupBy("src", "kind", "dst").agg(F.max("src_there").alias("src_there"), F.max("dst_there").alias("dst_there"))
        modules = stored_table(nodes.where("id like 'module:%'").select("id"), "module-ids")
        for end in ("src", "dst"):
            rows = rows.join(modules.select(F.col("id").alias(end), F.lit(True).alias("_module")), end, "left").withColumn(f"{end}_there", F.col(f"{end}_there") | F.coalesce("_module", F.lit(False))).drop("_module")
        whole = F.col("src_there") & F.col("dst_there")
        return rows.where(whole).select("src", "kind", "dst").unionByName(guard(rows.where(~whole), nodes).select("src", "kind", "dst"))

    def _rules(self) -> dict:
        """What each rule gives, to be asked for ids alone: lookups and calls are stored without what they say."""
        if not self.asked:
            self.sized = True
            if "symbols" not in self.known:
                self.known["symbols"] = stored_table(self.symbols(), "symbols")
            between = stored_table(self.calls().select("src", "dst").distinct(), "calls-between")
            self.known["calls"] = typed(between, EDGE, {"src": F.col("src"), "kind": F.lit("calls"), "dst": F.col("dst")})
            self.known["handled"] = stored_table(self._handled(), "handled")
            self.asked = {rule: getattr(self, rule)() for rule in self.RULES}
        return self.asked

    RULES = ("modules", "entities", "inheritance", "imports", "calls", "routes", "schema", "sql", "queries", "conditions", "requirements", "tests", "manifests", "git", "returns", "throws", "responses", "tested", "components", "deployed", "secrets", "configuration", "reconciled")

    def observations(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) observed by all rules, with the rule that did."""
        nodes, edges = [self.repository_node().withColumn("rule", F.lit("repository")), self.tallied().withColumn("rule", F.lit("tallied"))], []
        for rule in self.RULES:
            got = getattr(self, rule)()
            seen, linked = got if isinstance(got, tuple) else (None, got)
            nodes += [] if seen is None else [seen.withColumn("rule", F.lit(rule))]
            edges += [] if linked is None else [linked.withColumn("rule", F.lit(rule))]
        return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)

    def graph(self, most_nodes: int | None = None, most_edges: int | None = None) -> Graph:
        """The graph; observations are computed once, written to the shared folder, and counted on the way.

        Beyond ``most_nodes`` and ``most_edges`` the ones seen last go, and ``truncated`` says so.
        """
        self.known["symbols"] = stored_table(self.symbols(), "symbols")
        self.known["calls"] = stored_table(self.calls(), "calls")
        self.known["handled"] = stored_table(self._handled(), "handled")
        observed_nodes, observed_edges = self.observations()
        counted = Observation("nodes"), Observation("edges")
        observed_nodes = stored_table(observed_nodes.observe(counted[0], *[F.count_if(F.col("rule") == r).alias(r) for r in ("entities", "routes", "tests", "schema")], F.count_if(F.expr("rule = 'schema' and kind = 'table'")).alias("tables"), F.count_if(F.expr("rule = 'git' and kind = 'commit'")).alias("commits")), "observed-nodes")
        observed_edges = stored_table(observed_edges.observe(counted[1], F.count_if(F.expr("rule = 'calls'")).alias("calls"), F.count_if(F.expr("rule = 'imports' and kind in ('imports', 're_exports')")).alias("inside"), F.count_if(F.expr("rule = 'imports' and kind = 'depends_on'")).alias("outside")), "observed-edges")
        cited = observed_nodes.select("evidence", "seq").unionByName(observed_edges.select("evidence", "seq")).where("evidence is not null")
        evidence = cited.groupBy(F.col("evidence.id").alias("id")).agg(F.min_by("evidence", "seq").alias("e")).select("e.*")
        nodes, edges = merged_nodes(observed_nodes).where("kind is not null"), merged_edges(observed_edges)
        nodes, more_nodes = first_seen(nodes, observed_nodes.groupBy("id").agg(F.min("seq").alias("first")), most_nodes)
        node_refs = observed_nodes.where("evidence is not null").select("id", F.col("evidence.id").alias("evidence")).distinct().join(nodes.select("id"), "id", "left_semi")
        edges = guard(edges, nodes)
        ids = observed_edges.withColumn("id", edge_id(F.col("src"), F.col("kind"), F.col("dst")))
        edges, more_edges = first_seen(edges, ids.groupBy("id").agg(F.min("seq").alias("first")), most_edges)
        tested = observed_edges.where("rule = 'calls'").join(self._handled().select(F.col("endpoint_id").alias("endpoint"), F.col("target").alias("dst")), "dst")
        tested = tested.select(edge_id(F.col("src"), F.lit("tests"), F.col("endpoint")).alias("id"), F.col("evidence.id").alias("evidence"))
        edge_refs = ids.select("id", F.col("evidence.id").alias("evidence")).unionByName(tested).distinct().join(edges.select("id"), "id", "left_semi")
        return Graph(nodes, edges, evidence, node_refs, edge_refs, self._counters(counted[0].get, counted[1].get), more_nodes or more_edges)

    def _counters(self, nodes: dict, edges: dict) -> dict[str, int]:
        """What was read and resolved: facts counted in one pass each, observations as they were written."""
        n = lambda name, *c: self.facts[name].agg(*(c or (F.count(F.lit(1)),))).first()
        files = n("files", F.count_if("analyzable"))[0]
        calls, imports = n("calls")[0], n("imports")[0]
        return {
            "files": files, "modules": files, "entities": nodes["entities"], "imports": imports, "resolvedInternalImports": edges["inside"], "externalDependencies": edges["outside"],
            "resolvedCalls": edges["calls"], "unresolvedCalls": calls - edges["calls"], "apiEndpoints": nodes["routes"], "tables": nodes["tables"], "tests": nodes["tests"], "commits": nodes["commits"],
            "contributors": n("commits", F.countDistinct(F.lower("author_email")))[0],
        }


def first_seen(rows: DataFrame, first: DataFrame, most: int | None) -> tuple[DataFrame, bool]:
    """(the ``most`` rows whose ids were observed first, whether any were left out)."""
    if most is None or rows.count() <= most:
        return rows, False
    kept = rows.select("id").join(first, "id").orderBy("first", "id").limit(most).select("id")
    return rows.join(stored_table(kept, "kept"), "id", "left_semi"), True


def is_test(path: Column) -> Column:
    """Whether a path is one of a test file."""
    return path.rlike(r"(?i)(^|/)(test|tests|__tests__)/") | path.rlike(r"(?i)\.(test|spec)\.[a-z]+$")
