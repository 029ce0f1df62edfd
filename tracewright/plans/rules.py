"""Rules over a graph: requirements, use cases, gaps, consistency, reconciliation, verification.

Rows of findings are unions of joins; nothing is concluded from absence alone: what
wasn't found is missing evidence, never a contradiction.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.identity import slug
from tracewright.operators import traverse
from tracewright.plans import deploy, views
from tracewright.plans.views import View, attribute, runs
from tracewright.storage import stored_table

# Names of calls that validate and that authorise.
VALIDATION = r"^(?i:validat)|^(?i:parse|safeParse|schema)$|^check[A-Z]|^assert[A-Z]"
AUTHORIZATION = r"^(?i:authenticate|authorize|isAuthenticated)$|^(?i:requireAuth|hasPermission)"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# -- requirements


def _guarding(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, edge, src, authorises, rank): calls whose callee is named as one that validates or authorises, with the caller's file."""
    callee = F.coalesce(attribute("callee"), F.lit(""))
    calls = edges.where("kind = 'calls'").where(callee.rlike(VALIDATION) | callee.rlike(AUTHORIZATION)).select(F.col("id").alias("edge"), "src", "rank", callee.rlike(AUTHORIZATION).alias("authorises"))
    return calls.join(nodes.where("path is not null").select(F.col("id").alias("src"), "path"), "src")


def _endpoints_by_file(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'api_endpoint'").select(F.col("id").alias("endpoint"), "path")


def guards(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(endpoint, edge, src, authorises, rank): an endpoint with each guarding call in its file."""
    return _endpoints_by_file(nodes).join(_guarding(nodes, edges), "path").drop("path")


def guarded(nodes: DataFrame, edges: DataFrame, guarding: DataFrame | None = None) -> DataFrame:
    """(endpoint, path, category, rank): endpoints with guarding calls in their file; the calls (those given, if they are known) are reduced by file before they meet endpoints."""
    files = (guarding or _guarding(nodes, edges)).groupBy("path").agg(F.max("authorises").alias("authorises"), F.when(F.min("rank") == 3, 3).otherwise(2).alias("rank"))
    category = F.when(F.col("authorises"), "operational_behaviour").otherwise("validation").alias("category")
    return _endpoints_by_file(nodes).distinct().join(files, "path").select("endpoint", "path", category, "rank")


def _persisted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, tables): the names of the tables that are read or written, sorted, as one text an operation."""
    named = edges.where(F.col("kind").isin("reads", "writes")).select("kind", F.col("dst").alias("id")).distinct().join(nodes.where("kind = 'table'").select("id", "name"), "id")
    return named.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("name")), "+").alias("tables"))


def requirements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, category, origin, status, rank): declared ones, an interface per endpoint, guards, persistence, what is deployed.

    The id of a persistence requirement ends with the names of the tables that it covers.
    """

    def row(df, id_, category, origin, status, rank="rank"):
        category = F.lit(category) if isinstance(category, str) else category
        return df.select(id_.alias("id"), category.alias("category"), F.lit(origin).alias("origin"), status.alias("status"), F.col(rank).cast("int").alias("rank") if isinstance(rank, str) else rank.cast("int").alias("rank"))

    seen = lambda when: F.when(when, "OBSERVED").otherwise("PARTIAL")
    done = edges.where("kind = 'implements_requirement'").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct().withColumn("met", F.lit(True))
    declared = nodes.where("kind = 'requirement'").join(done, "id", "left")
    endpoints = nodes.where("kind = 'api_endpoint'")
    kept, category = guarded(nodes, edges), F.col("category")
    touched = edges.where(F.col("kind").isin("reads", "writes")).groupBy("kind").agg(F.min("rank").alias("weakest"))
    named = _persisted(nodes, edges).join(touched, "kind")
    units = nodes.where("kind = 'deployment_component'").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("weakest")).where("n > 0")
    return _union(
        [
            row(declared, F.concat(F.lit("declared:declared:"), "id"), "declared", "declared", seen(F.col("met").isNotNull())),
            row(endpoints, F.concat(F.lit("derived:interface_behaviour:"), "id"), "interface_behaviour", "derived", seen(F.coalesce(attribute("handler"), F.lit("")) != "")),
            row(kept, F.concat(F.lit("derived:"), category, F.lit(":"), "endpoint"), category, "derived", F.lit("OBSERVED")),
            row(named, F.concat_ws(":", F.lit("derived:persistence"), "kind", "tables"), "persistence", "derived", seen(F.col("weakest") == 3), F.when(F.col("weakest") == 3, 3).otherwise(1)),
            row(units, F.lit("derived:operational_behaviour:declared_containers"), "operational_behaviour", "derived", F.lit("OBSERVED"), F.when(F.col("weakest") == 3, 3).otherwise(1)),
        ]
    )


#: Stands before an operation in place of the id of its persistence requirement, which names all tables.
_STORED = "derived:persistence:"


def _held(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(held: node, block, requirement; members: block, requirement): what requirements rest on, without a row for each pair.

    Requirements of the endpoints of one file rest alike on its guarding calls and on the module that serves them. They are the members
    of a block; a node that all of them rest on holds the block (requirement null), others a requirement, with its block if it has
    one. A requirement is in one block at most, as ids of nodes are unique. ``_STORED`` and the operation stand for the ids of
    persistence, so that rows stay short.
    """
    known = nodes.select(F.col("id").alias("node"))
    none = F.lit(None).cast("string")
    declared = edges.where("kind = 'implements_requirement'").join(nodes.where("kind = 'requirement'").select(F.col("id").alias("src")), "src", "left_semi")
    endpoints = nodes.where("kind = 'api_endpoint'")
    serving = F.concat(F.lit("module:"), slug(F.regexp_replace("path", r"\.[^.]+$", "")))
    interface = endpoints.select(F.concat(F.lit("serving:"), serving).alias("block"), F.concat(F.lit("derived:interface_behaviour:"), "id").alias("requirement"), F.col("id").alias("node"))
    guard = F.concat(F.lit("guards:"), "path")
    guarding = stored_table(_guarding(nodes, edges).select("path", "src", "authorises", "rank"), "guarding")
    kept = guarded(nodes, edges, guarding).select(guard.alias("block"), F.concat(F.lit("derived:"), "category", F.lit(":"), "endpoint").alias("requirement"), F.col("endpoint").alias("node"))
    accesses = edges.where(F.col("kind").isin("reads", "writes"))
    tables = nodes.where("kind = 'table'").select(F.col("id").alias("dst"))
    stored = accesses.join(tables, "dst", "left_semi").select("kind").distinct()  # only where a known table is met is there such a requirement
    ends = accesses.select("kind", F.explode(F.array("src", "dst")).alias("node")).distinct()
    held = _union(
        [
            declared.select(F.col("dst").alias("node"), none.alias("block"), F.concat(F.lit("declared:declared:"), "src").alias("requirement")),
            interface.select("node", "block", "requirement"),
            endpoints.where("path is not null").select(serving.alias("node"), F.concat(F.lit("serving:"), serving).alias("block"), none.alias("requirement")),
            kept.select("node", "block", "requirement"),
            guarding.select(F.col("src").alias("node"), guard.alias("block"), none.alias("requirement")),
            ends.join(stored, "kind").select("node", none.alias("block"), F.concat(F.lit(_STORED), "kind").alias("requirement")),
            nodes.where("kind = 'deployment_component'").select(F.col("id").alias("node"), none.alias("block"), F.lit("derived:operational_behaviour:declared_containers").alias("requirement")),
        ]
    )
    members = interface.where("block is not null").unionByName(kept).select("block", "requirement").distinct()
    return held.distinct().join(known, "node", "left_semi").select("node", "block", "requirement"), members


def _rests(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``supports`` with ``_STORED`` and the operation for the ids of persistence: the pairs of ``_held``, each met once, so none are dealt to be made distinct."""
    held, members = _held(nodes, edges)
    whole = held.where("requirement is null").select("node", "block")
    single = held.where("requirement is not null").join(whole, ["node", "block"], "left_anti")
    return whole.join(members, "block").select("requirement", "node").unionByName(single.select("requirement", "node"))


def supports(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(requirement, node): what each requirement rests on, a row each; for persistence the ends of every access.

    The ids of persistence requirements, at most one an operation, are put in last.
    """
    stored = _persisted(nodes, edges).select(F.concat(F.lit(_STORED), "kind").alias("requirement"), F.concat_ws(":", F.lit("derived:persistence"), "kind", "tables").alias("whole"))
    return _rests(nodes, edges).join(F.broadcast(stored), "requirement", "left").select(F.coalesce("whole", "requirement").alias("requirement"), "node")


def persistence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(operation, n_tables, all_explicit) over all tables."""
    touched = edges.where(F.col("kind").isin("reads", "writes")).join(nodes.where("kind = 'table'").select(F.col("id").alias("dst")), "dst", "left_semi")
    return touched.groupBy(F.col("kind").alias("operation")).agg(F.countDistinct("dst").alias("n_tables"), F.bool_and(F.col("rank") == 3).alias("all_explicit"))


# -- use cases


def entry_points(nodes: DataFrame) -> DataFrame:
    """(entry, entry_kind, path, rank): endpoints, handlers of events, scripts."""
    marker = F.coalesce(attribute("marker"), F.lit(""))
    kind = F.when(F.col("kind") == "api_endpoint", "api_endpoint").when((F.col("kind") == "configuration") & marker.startswith("async."), "event_consumer").when((F.col("kind") == "configuration") & (marker == "manifest.script"), "cli_command")
    return nodes.withColumn("entry_kind", kind).where("entry_kind is not null").select(F.col("id").alias("entry"), "entry_kind", "path", "rank")


def actors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(actor, path): declared ones, and what authenticates or authorises without being code."""
    subjects = edges.where(F.col("kind").isin("authenticates", "authorizes")).select(F.col("src").alias("id")).distinct()
    outside = nodes.where(~F.col("kind").isin("actor", "module", "class", "function")).join(subjects, "id", "left_semi")
    return nodes.where("kind = 'actor'").unionByName(outside).select(F.col("id").alias("actor"), "path").distinct()


def calls_between(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls of known nodes."""
    return edges.where("kind = 'calls'").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def walked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, cuts) of all entry points, along calls between known nodes; steps are stored, as several rules read them."""
    steps, cuts = traverse.steps(calls_between(nodes, edges), entry_points(nodes).select("entry"))
    return traverse.cut(steps), traverse.cut(cuts)


def use_cases(nodes: DataFrame, edges: DataFrame, walk: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, entry, entry_kind, n_steps, n_cut, actor, n_missing, status, reached_data): what each entry point starts.

    The actor is the one in the same file (the smallest id), else the only one. Missing can be the
    actor, steps (none, or some cut), and persistence. Status is UNKNOWN without steps, PARTIAL with
    more than one thing missing, else OBSERVED; data that is read or written by any step counts in
    ``reached_data``, and not against the status.
    """
    entries = entry_points(nodes)
    steps, cuts = walk or walked(nodes, edges)
    counted = steps.groupBy("entry").agg(F.count(F.lit(1)).alias("n_steps"))
    data = edges.where(F.col("kind").isin("reads", "writes")).select(F.col("src").alias("node"), "dst")
    touched = steps.select("entry", F.col("dst").alias("node")).unionByName(entries.select("entry", F.col("entry").alias("node"))).distinct()
    reached = touched.join(data, "node").groupBy("entry").agg(F.countDistinct("dst").alias("reached_data"))
    known = actors(nodes, edges)
    local = known.where("path is not null").groupBy("path").agg(F.min("actor").alias("local"))
    only = known.agg(F.count(F.lit(1)).alias("n"), F.min("actor").alias("only")).first()
    alone = F.lit(only["only"] if only["n"] == 1 else None).cast("string")
    rows = entries.join(counted, "entry", "left").join(cuts, "entry", "left").join(reached, "entry", "left").join(local, "path", "left").withColumn("actor", F.coalesce("local", alone))
    n, n_cut = F.coalesce("n_steps", F.lit(0)), F.coalesce("n_cut", F.lit(0))
    # no step is a data access, so persistence is always one of the things missing
    missing = F.lit(1) + F.col("actor").isNull().cast("int") + ((n == 0) | (n_cut > 0)).cast("int")
    status = F.when(n == 0, "UNKNOWN").when(missing > 1, "PARTIAL").otherwise("OBSERVED")
    id_ = F.concat_ws(":", F.lit("use_case"), "entry_kind", "entry")
    return rows.select(id_.alias("id"), "entry", "entry_kind", n.alias("n_steps"), n_cut.alias("n_cut"), "actor", missing.alias("n_missing"), status.alias("status"), F.coalesce("reached_data", F.lit(0)).alias("reached_data"))


def preconditions(nodes: DataFrame, edges: DataFrame, steps: DataFrame, most: int = 10) -> DataFrame:
    """(entry, conditions): the first ``most`` conditions, sorted, that the steps of an entry branch or loop on."""
    held = edges.where(F.col("kind").isin("branches", "loops")).select(F.col("src").alias("node"), F.col("dst").alias("condition"), "kind")
    texts = nodes.select(F.col("id").alias("condition"), F.coalesce(attribute("condition"), F.lit("a condition")).alias("text"))
    names = nodes.select(F.col("id").alias("node"), F.coalesce("qualified_name", "name").alias("who"))
    said = F.concat_ws(" ", "who", F.when(F.col("kind") == "loops", "loops while").otherwise("branches on"), "text")
    rows = steps.select("entry", F.col("dst").alias("node")).distinct().join(held, "node").join(texts, "condition").join(names, "node").select("entry", said.alias("said")).distinct()
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("entry").orderBy("said"))).where(F.col("k") <= most)
    return first.groupBy("entry").agg(F.array_sort(F.collect_list("said")).alias("conditions"))


def supported(nodes: DataFrame, edges: DataFrame, steps: DataFrame, rests: DataFrame | None = None) -> DataFrame:
    """(entry, requirement): requirements that rest on an entry point or on a node that it reaches; with other ``rests`` (node, ...) what these say."""
    rests = supports(nodes, edges) if rests is None else rests
    met = steps.select("entry", F.col("dst").alias("node")).unionByName(entry_points(nodes).select("entry", F.col("entry").alias("node"))).distinct()
    return met.join(rests, "node").drop("node").distinct()


# Statuses, so that none is left out where it has no rows.
STATUSES = {"use_case": ("OBSERVED", "PARTIAL", "UNKNOWN"), "requirement": ("OBSERVED", "DERIVED", "PARTIAL", "UNKNOWN", "UNSUPPORTED"), "gap": ("EXPLICIT", "PARTIALLY_EVIDENCED", "INFERRED", "NOT_FOUND"), "consistency": ("CONTRADICTION", "MISSING_EVIDENCE", "PARTIAL_EVIDENCE", "UNSUPPORTED_INFERENCE", "CONSISTENT")}


def status_counts(rows: DataFrame, of: str) -> DataFrame:
    every = rows.sparkSession.createDataFrame([(s,) for s in STATUSES[of]], "status string")
    return every.join(rows.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


# -- gaps


def gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, status): ten questions, each answered from counts of one pass over nodes and one over edges."""
    kinds = ("deployment_component", "api_endpoint", "table", "service", "actor", "test", "contributor", "commit", "requirement")
    n = nodes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count_if(F.col("kind") != "repository").alias("others"))
    n = n.withColumn("models", F.col("requirement") + F.col("deployment_component") + F.lit(entry_points(nodes).limit(1).count()) + F.lit(edges.where(F.col("kind").isin("reads", "writes")).limit(1).count()))
    links = ("deploys", "reads", "writes", "authenticates", "tests", "documents", "authored_by", "implements_requirement")
    e = edges.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_edges") for k in links])
    used, declared = dependencies(nodes, edges)
    unused = declared.join(used, "id", "left_anti").agg(F.count(F.lit(1)).alias("unused"))
    undeclared = used.join(declared, "id", "left_anti").agg(F.count(F.lit(1)).alias("undeclared"))
    # one row of counts each, put side by side through their only key
    one = lambda df: df.withColumn("one", F.lit(1))
    counts = one(n).join(one(e), "one").join(one(unused), "one").join(one(undeclared), "one")
    c = F.col
    found, partly, none = "EXPLICIT", "PARTIALLY_EVIDENCED", "NOT_FOUND"
    rules = {
        "deployment-architecture": F.when((c("deployment_component") > 0) & (c("deploys_edges") > 0), found).when(c("deployment_component") > 0, partly).otherwise(none),
        "api-surface": F.when(c("api_endpoint") == 0, none).otherwise(found),
        "data-storage": F.when(c("table") == 0, none).when(c("reads_edges") + c("writes_edges") == 0, partly).otherwise(found),
        "authentication": F.when((c("service") > 0) & ((c("actor") > 0) | (c("authenticates_edges") > 0)), found).otherwise(none),
        "test-coverage": F.when(c("test") == 0, none).when(c("tests_edges") > 0, found).otherwise(partly),
        "documentation-links": F.when(c("documents_edges") > 0, found).otherwise(none),
        "ownership": F.when((c("contributor") == 0) | (c("commit") == 0), none).when(c("authored_by_edges") > 0, found).otherwise(partly),
        "requirements": F.when(c("models") == 0, none).when(c("implements_requirement_edges") > 0, found).otherwise(partly),
        "dependency-hygiene": F.when(c("unused") + c("undeclared") == 0, found).otherwise(partly),
        "analysis-completeness": F.when(c("others") > 0, found).otherwise(none),
    }
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("id"), v.alias("status")) for k, v in rules.items()])).alias("g")).select("g.*")


def not_found_share(gap_rows: DataFrame) -> DataFrame:
    """(share): the part of the questions that nothing was found for; 0 without questions."""
    return gap_rows.agg(F.coalesce(F.try_divide(F.count_if(F.col("status") == "NOT_FOUND"), F.count(F.lit(1))), F.lit(0.0)).cast("double").alias("share"))


def dependencies(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages that code imports, packages that a manifest declares): id."""
    rows = edges.where("kind = 'depends_on' and dst like 'package:%'")
    declared = attribute("declared").eqNullSafe("true")
    return rows.where(~declared).select(F.col("dst").alias("id")).distinct(), rows.where(declared).select(F.col("dst").alias("id")).distinct()


# -- consistency


def projection_integrity(kind: str, view: View, nodes: DataFrame) -> DataFrame:
    """(id, rule, class, severity) of what a view draws without the graph having it."""
    known = nodes.select("id")
    loose = _union([view.edges.join(known.withColumnRenamed("id", end), end, "left_anti").select("id") for end in ("src", "dst")]).unionByName(view.nodes.select("id").join(known, "id", "left_anti"))
    return loose.distinct().select(F.concat(F.lit(f"projection-integrity:{kind}:"), "id").alias("id"), F.lit("projection-integrity").alias("rule"), F.lit("UNSUPPORTED_INFERENCE").alias("class"), F.lit("warning").alias("severity"))


def consistency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, rule, class, severity) of all findings, a union of anti joins; views of data and behaviour are held against the graph too."""

    def finding(df, name, rule, id_, class_, severity):
        class_ = F.lit(class_) if isinstance(class_, str) else class_
        return df.select(F.concat(F.lit(f"{name}:"), id_).alias("id"), F.lit(rule).alias("rule"), class_.alias("class"), F.lit(severity).alias("severity"))

    where, units, known = traverse.attribution(edges, nodes), runs(nodes), nodes.select("id")
    calls, entries = edges.where("kind = 'calls'"), entry_points(nodes)
    case = F.concat_ws(":", F.lit("use_case"), "entry_kind", "entry")
    touched = edges.where(F.col("kind").isin("reads", "writes"))
    stores = touched.select(F.col("dst").alias("id")).distinct()
    tested = edges.where("kind = 'tests'").select(F.col("dst").alias("entry")).distinct()
    called = calls.join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("entry")).distinct()
    some = F.lit(not calls.isEmpty())
    needs = requirements(nodes, edges).select("id", "origin", "status")
    claimed = edges.where("kind = 'implements_requirement'").join(nodes.where("kind = 'requirement'").select(F.col("id").alias("src")), "src", "left_semi")
    lost = claimed.join(known.withColumnRenamed("id", "dst"), "dst", "left_anti").select(F.concat(F.lit("declared:declared:"), "src").alias("id")).distinct()
    http = attribute("httpResponse").eqNullSafe("true")
    handed = edges.where(F.col("kind").isin("returns", "throws")).where(~((F.col("kind") == "returns") & http))
    pairs = calls.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    responses = edges.where("kind = 'returns'").where(http)
    endpoints = nodes.where("kind = 'api_endpoint'").select(F.col("id").alias("dst"))
    ctes = nodes.where(attribute("queryExpression") == "true").select(F.col("id").alias("dst"))
    inside = edges.where("kind = 'exposes'").select(F.col("dst").alias("entry"), F.col("src").alias("module")).join(where, "module").select("entry").distinct()
    any_unit = F.lit(not units.isEmpty())
    unclassified = nodes.where(attribute("unclassifiedStatement") == "true").select(F.lit("unclassified-statements").alias("what")).distinct()
    behaviour = called.join(entries, "entry", "left_semi").select(F.lit("behaviour-traced").alias("what")).distinct()
    data = touched.join(nodes.where("kind = 'table'").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.lit("data-traced").alias("what")).distinct()
    return _union(
        [
            finding(units.join(where.select(F.col("container").alias("id")).distinct(), "id", "left_anti"), "container-without-code", "c4-without-code", F.col("id"), "MISSING_EVIDENCE", "info"),
            finding(needs.where("origin = 'declared' and status = 'PARTIAL'").join(lost, "id", "left_anti"), "requirement-unimplemented", "requirement-implementation", F.col("id"), "MISSING_EVIDENCE", "warning"),
            finding(lost, "requirement-support", "requirement-implementation", F.col("id"), "CONTRADICTION", "warning"),
            finding(entries.join(called, "entry", "left_anti"), "use-case-unreachable", "use-case-reachability", case, F.when(some, "PARTIAL_EVIDENCE").otherwise("MISSING_EVIDENCE"), "info"),
            finding(entries.join(inside, "entry", "left_anti").where(any_unit), "entry-point-outside-container", "entry-point-coverage", case, "PARTIAL_EVIDENCE", "info"),
            finding(nodes.where("kind = 'table'").join(stores, "id", "left_anti"), "store-untouched", "data-coverage", F.col("id"), "MISSING_EVIDENCE", "info"),
            finding(entries.where("entry_kind = 'api_endpoint'").join(tested, "entry", "left_anti"), "entry-point-untested", "behaviour-coverage", case, "MISSING_EVIDENCE", "info"),
            finding(handed.join(pairs, ["src", "dst"], "left_anti"), "return-unsupported", "return-support", F.col("id"), "UNSUPPORTED_INFERENCE", "warning"),
            finding(responses.join(endpoints, "dst", "left_anti"), "response-unpaired", "response-pairing", F.col("id"), "UNSUPPORTED_INFERENCE", "warning"),
            finding(touched.join(ctes, "dst", "left_semi"), "cte-as-store", "query-expression-scope", F.col("id"), "CONTRADICTION", "warning"),
            finding(unclassified, "data-access", "data-classification", F.col("what"), "PARTIAL_EVIDENCE", "info"),
            finding(behaviour.unionByName(data), "agreement", "cross-artefact-agreement", F.col("what"), "CONSISTENT", "info"),
            projection_integrity("data-flow", views.data_flow(nodes, edges), nodes),
            projection_integrity("er-diagram", views.tables(nodes, edges, most=None), nodes),
            projection_integrity("activity", views.activity(nodes, edges), nodes),
        ]
    )


# -- traceability


#: Links of an implementation at most; direct calls all count.
MOST_LINKS = 24


def relevant(nodes: DataFrame, steps: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, entry): an entry point's own use case, for other subjects those of which they are a step."""
    entries = entry_points(nodes).select("entry")
    own = subjects.join(entries, subjects["subject"] == entries["entry"])
    others = subjects.join(own.select("subject"), "subject", "left_anti")
    return own.select("subject", "entry").unionByName(others.join(steps.select("entry", F.col("dst").alias("subject")).distinct(), "subject").select("subject", "entry"))


def implementation(nodes: DataFrame, edges: DataFrame, steps: DataFrame, subjects: DataFrame) -> DataFrame:
    """(subject, place, node): what serves a subject: what it calls, in the order of edges, then the steps of its use cases while there are fewer than ``MOST_LINKS``."""
    calls = edges.where("kind = 'calls'").select(F.col("src").alias("subject"), F.col("dst").alias("node"), F.lit(0).alias("role"), F.lit("").alias("entry"), F.lit(0).cast("long").alias("step"), F.col("id").alias("edge"))
    direct = calls.join(subjects, "subject", "left_semi")
    later = relevant(nodes, steps, subjects).join(steps.select("entry", F.col("place").alias("step"), F.col("dst").alias("node"), F.col("id").alias("edge")), "entry")
    rows = direct.unionByName(later.select("subject", "node", F.lit(1).alias("role"), "entry", "step", "edge")).where("node <> subject")
    first = rows.groupBy("subject", "node").agg(F.min(F.struct("role", "entry", "step", "edge")).alias("at"))
    place = F.row_number().over(Window.partitionBy("subject").orderBy("at", "node"))
    return first.withColumn("place", place).where((F.col("place") <= MOST_LINKS) | (F.col("at.role") == 0)).select("subject", "place", "node")


def _wanted(nodes: DataFrame, edges: DataFrame, steps: DataFrame, subjects: DataFrame, cases: DataFrame) -> DataFrame:
    """(subject, n): how many requirements rest on a subject or on what its use cases (subject, entry) reach; those of a block that is held are counted by its size."""
    held, members = _held(nodes, edges)
    held = stored_table(held, "held")
    own = subjects.join(held, F.col("subject") == F.col("node")).select("subject", "block", "requirement")
    rows = cases.join(supported(nodes, edges, steps, held), "entry").select("subject", "block", "requirement").unionByName(own)
    found = rows.groupBy("subject", "block").agg(F.bool_or(F.col("requirement").isNull()).alias("whole"), F.countDistinct("requirement").alias("some"))
    sizes = members.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    return found.join(sizes, "block", "left").groupBy("subject").agg(F.sum(F.when(F.col("whole"), F.coalesce("size", F.lit(0))).otherwise(F.col("some"))).alias("n"))


def trace(nodes: DataFrame, edges: DataFrame, subjects: DataFrame, walk: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(subject, requirements, use_cases, implementation, tests, breaks, complete): how far the chain of each subject goes, and where it breaks."""
    steps = walk[0] if walk else traverse.first_steps(calls_between(nodes, edges), entry_points(nodes).select("entry"))
    cases = relevant(nodes, steps, subjects)
    served = stored_table(implementation(nodes, edges, steps, subjects), "served")
    tests = edges.where("kind = 'tests'").select(F.col("dst").alias("node"), F.col("src").alias("test"))
    tested = served.select("subject", "node").unionByName(subjects.select("subject", F.col("subject").alias("node"))).join(tests, "node")
    counts = {"requirements": _wanted(nodes, edges, steps, subjects, cases), "use_cases": cases.groupBy("subject").agg(F.countDistinct("entry").alias("n")), "implementation": served.groupBy("subject").agg(F.count(F.lit(1)).alias("n")), "tests": tested.groupBy("subject").agg(F.countDistinct("test").alias("n"))}
    rows = subjects.select("subject")
    for name, counted in counts.items():
        rows = rows.join(counted.withColumnRenamed("n", name), "subject", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    broken = [F.when(F.col(name) == 0, kind) for name, kind in (("requirements", "NO_REQUIREMENT"), ("use_cases", "NO_USE_CASE"), ("implementation", "NO_IMPLEMENTATION"), ("tests", "NO_TEST"))]
    rows = rows.withColumn("breaks", F.filter(F.array(*broken), lambda b: b.isNotNull()))
    return rows.withColumn("complete", F.size("breaks") == 0)


def trace_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``trace`` of all endpoints."""
    return trace(nodes, edges, nodes.where("kind = 'api_endpoint'").select(F.col("id").alias("subject")))


def trace_totals(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("subjects"), F.count_if("complete").alias("complete"), F.count_if(~F.col("complete")).alias("incomplete"))


# -- reconciliation


def attributed(services: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Services (service, path, context) to the innermost modules (module, path) in their build context: see ``deploy.built``."""
    return deploy.built(services.select("service", deploy.context_folder(F.col("path"), F.col("context")).alias("folder")), modules)


# -- verification: records only, nothing is run

def asks_for_health(path: Column) -> Column:
    """Whether a path is one that health checks ask."""
    return F.coalesce(path.rlike(r"(?i)/(health|healthz|readyz|livez|ping|status)\b"), F.lit(False))


def verification_status(outcome: Column) -> Column:
    """Only a run that succeeded verifies; one that failed, timed out, was blocked or never ran leaves it unknown."""
    return F.when(outcome == "succeeded", "VERIFIED").otherwise("UNKNOWN")


def latest(records: DataFrame) -> DataFrame:
    """The status of the last record of each target (target, observed_at, record_id, outcome)."""
    last = records.groupBy("target").agg(F.max_by("outcome", F.struct("observed_at", "record_id")).alias("outcome"), F.count(F.lit(1)).alias("n_records"))
    return last.select("target", verification_status(F.col("outcome")).alias("status"), "n_records")
