"""Rules, drift and queries on small graphs whose results are known."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions.identity import stable_json
from tracewright.operators import drift, graph, traverse
from tracewright.plans import rules, views
from tracewright.plans.shapes import Graph
from tracewright.sources.store import Store


def made(spark, nodes, edges):
    """Nodes (id, attributes or None, path or None) and edges (src, kind, dst, attributes or None, rank or None)."""
    rows = [(i, i.split(":")[0], i.split(":")[1], None, path, 1, 3, given or {}) for i, given, path in nodes]
    links = [(f"{a}|{k}|{b}", a, k, b, 3 if rank is None else rank, None, given or {}) for a, k, b, given, rank in edges]
    return (
        spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, path string, start_line int, rank int, attributes map<string,string>"),
        spark.createDataFrame(links, "id string, src string, kind string, dst string, rank int, label string, attributes map<string,string>"),
    )


def call(a, b, callee=None, rank=None):
    return (a, "calls", b, {"callee": callee} if callee else None, rank)


NODES = [
    ("repository:r", None, "."), ("module:src/a", None, "src/a.ts"), ("api_endpoint:get-/x", {"handler": "h"}, "src/a.ts"), ("api_endpoint:get-/y", None, "src/b.ts"), ("api_endpoint:get-/z", None, None),
    ("function:h", None, "src/a.ts"), ("function:svc", None, "src/s.ts"), ("function:deep", None, "src/s.ts"), ("function:t", None, "test/a.test.ts"), ("table:users", None, None), ("table:audit", None, None),
    ("requirement:r1", None, "docs/r.md"), ("requirement:r2", None, "docs/r.md"), ("actor:user", None, "src/b.ts"), ("condition:c1", {"condition": "a > b"}, "src/s.ts"), ("deployment_component:web", {"declaredAs": "service"}, "compose.yml"),
    ("configuration:pkg", {"marker": "manifest.script"}, "package.json"), ("configuration:task", {"marker": "async.task"}, "src/t.py"), ("configuration:other", {"marker": "config.key"}, "x.yml"),
]
EDGES = [
    call("api_endpoint:get-/x", "function:h"), call("function:h", "function:svc", "svc.find"), call("function:svc", "function:deep"), call("function:h", "function:deep", "validateBody"), call("api_endpoint:get-/y", "function:deep"), call("function:deep", "function:gone"),
    ("function:svc", "reads", "table:users", None, 3), ("function:deep", "writes", "table:audit", None, 1), ("requirement:r1", "implements_requirement", "function:svc", None, None), ("function:t", "tests", "api_endpoint:get-/x", None, 2),
    ("function:svc", "branches", "condition:c1", None, None), ("function:svc", "returns", "function:h", None, 2), ("function:h", "returns", "function:deep", None, 2), ("function:h", "throws", "table:users", None, 2), ("function:h", "returns", "api_endpoint:get-/x", {"httpResponse": "true"}, None),
]


@pytest.fixture(scope="module")
def small(spark):
    nodes, edges = made(spark, NODES, EDGES)
    return traverse.cut(nodes), traverse.cut(edges)


def test_requirements(small):
    got = {r["id"]: (r["category"], r["status"], r["rank"]) for r in rules.requirements(*small).collect()}
    assert got == {
        "declared:declared:requirement:r1": ("declared", "OBSERVED", 3), "declared:declared:requirement:r2": ("declared", "PARTIAL", 3), "derived:interface_behaviour:api_endpoint:get-/x": ("interface_behaviour", "OBSERVED", 3),
        "derived:interface_behaviour:api_endpoint:get-/y": ("interface_behaviour", "PARTIAL", 3), "derived:interface_behaviour:api_endpoint:get-/z": ("interface_behaviour", "PARTIAL", 3), "derived:validation:api_endpoint:get-/x": ("validation", "OBSERVED", 3),
        "derived:persistence:reads:users": ("persistence", "OBSERVED", 3), "derived:persistence:writes:audit": ("persistence", "PARTIAL", 1), "derived:operational_behaviour:declared_containers": ("operational_behaviour", "OBSERVED", 3),
    }
    held = {(r["requirement"], r["node"]) for r in rules.supports(*small).collect()}
    assert ("derived:interface_behaviour:api_endpoint:get-/x", "module:src/a") in held and ("derived:validation:api_endpoint:get-/x", "function:h") in held and ("derived:persistence:writes:audit", "function:deep") in held


@pytest.mark.parametrize(("callee", "validates", "authorises"), [("validate", 1, 0), ("validateX", 1, 0), ("invalidate", 0, 0), ("parse", 1, 0), ("x.parse", 0, 0), ("safeparse", 1, 0), ("checkX", 1, 0), ("checked", 0, 0), ("assertX", 1, 0), ("hasPermissionTo", 0, 1), ("requireAuthentication", 0, 1), ("authorize", 0, 1), ("authorized", 0, 0)])
def test_names_of_guards(spark, callee, validates, authorises):
    row = spark.range(1).select(F.lit(callee).rlike(rules.VALIDATION).cast("int"), F.lit(callee).rlike(rules.AUTHORIZATION).cast("int")).first()
    assert tuple(row) == (validates, authorises)


def test_use_cases(small):
    rows = {r["entry"]: r for r in rules.use_cases(*small).collect()}
    assert {k: (r["entry_kind"], r["n_steps"], r["actor"], r["n_missing"], r["status"]) for k, r in rows.items()} == {
        "api_endpoint:get-/x": ("api_endpoint", 4, "actor:user", 1, "OBSERVED"), "api_endpoint:get-/y": ("api_endpoint", 1, "actor:user", 1, "OBSERVED"), "api_endpoint:get-/z": ("api_endpoint", 0, "actor:user", 2, "UNKNOWN"),
        "configuration:pkg": ("cli_command", 0, "actor:user", 2, "UNKNOWN"), "configuration:task": ("event_consumer", 0, "actor:user", 2, "UNKNOWN"),
    }
    steps = rules.walked(*small)[0]
    assert [tuple(r) for r in rules.preconditions(*small, steps).collect()] == [("api_endpoint:get-/x", ["svc branches on a > b"])]


def test_a_cut_walk_is_missing_steps(spark):
    nodes, edges = made(spark, [("api_endpoint:e", None, "a.ts"), ("actor:u", None, None), *((f"function:f{k:02}", None, None) for k in range(45))], [call("api_endpoint:e", f"function:f{k:02}") for k in range(45)])
    (row,) = rules.use_cases(nodes, edges).collect()
    assert (row["n_steps"], row["n_cut"], row["actor"], row["n_missing"], row["status"]) == (40, 5, "actor:u", 2, "PARTIAL")


def test_actors_are_declared_or_outside_the_code(spark):
    nodes, edges = made(spark, [("actor:a", None, "x"), ("service:idp", None, None), ("module:m", None, None), ("function:f", None, None)], [("service:idp", "authenticates", "module:m", None, None), ("module:m", "authorizes", "function:f", None, None), ("function:f", "authenticates", "module:m", None, None)])
    assert {r["actor"] for r in rules.actors(nodes, edges).collect()} == {"actor:a", "service:idp"}


def test_traces(spark, small):
    index = {r["subject"]: r for r in rules.trace_index(*small).collect()}
    x = index["api_endpoint:get-/x"]
    # declared r1, its own interface, validation (function:h is a step), reads (svc), writes (deep)
    assert (x["requirements"], x["use_cases"], x["implementation"], x["tests"], x["breaks"], x["complete"]) == (5, 1, 3, 1, [], True)
    assert index["api_endpoint:get-/y"]["breaks"] == ["NO_TEST"] and index["api_endpoint:get-/z"]["breaks"] == ["NO_IMPLEMENTATION", "NO_TEST"]
    assert rules.trace_totals(rules.trace_index(*small)).first()[:] == (3, 1, 2)
    others = {r["subject"]: (r["use_cases"], r["implementation"], r["breaks"]) for r in rules.trace(*small, spark.createDataFrame([("function:svc",), ("table:users",)], "subject string")).collect()}
    assert others == {"function:svc": (1, 2, ["NO_TEST"]), "table:users": (0, 0, ["NO_USE_CASE", "NO_IMPLEMENTATION", "NO_TEST"])}


def test_direct_calls_all_count_and_steps_up_to_the_limit(spark):
    fan = [call("api_endpoint:a", f"function:d{k:02}") for k in range(30)] + [call("function:d00", "function:later")]
    chain = [call("api_endpoint:b", "function:c00"), *(call(f"function:c{k:02}", f"function:c{k:02}x{j}") for k in range(1) for j in range(30))]
    nodes, edges = made(spark, [("api_endpoint:a", None, None), ("api_endpoint:b", None, None), *((i, None, None) for i in sorted({b for _, _, b, _, _ in fan + chain}))], fan + chain)
    got = {r["subject"]: r["implementation"] for r in rules.trace_index(nodes, edges).collect()}
    assert got == {"api_endpoint:a": 30, "api_endpoint:b": 24}


def test_gaps(spark, small):
    got = {r["id"]: r["status"] for r in rules.gaps(*small).collect()}
    assert got["requirements"] == "EXPLICIT" and got["deployment-architecture"] == "PARTIALLY_EVIDENCED" and got["data-storage"] == "EXPLICIT"
    assert rules.not_found_share(rules.gaps(*small)).first()["share"] == sum(v == "NOT_FOUND" for v in got.values()) / 10
    nothing = made(spark, [("repository:r", None, ".")], [("x:a", "calls", "x:b", None, None)])
    bare = {r["id"]: r["status"] for r in rules.gaps(*nothing).collect()}
    assert bare["requirements"] == "NOT_FOUND" and bare["analysis-completeness"] == "NOT_FOUND"
    assert {r["status"]: r["n"] for r in rules.status_counts(rules.gaps(*nothing), "gap").collect()} == {"EXPLICIT": 1, "PARTIALLY_EVIDENCED": 0, "INFERRED": 0, "NOT_FOUND": 9}


def test_consistency(small):
    got = {r["id"]: (r["rule"], r["class"]) for r in rules.consistency(*small).collect()}
    want = {
        "return-unsupported:function:h|returns|function:deep": ("return-support", "UNSUPPORTED_INFERENCE"), "return-unsupported:function:h|throws|table:users": ("return-support", "UNSUPPORTED_INFERENCE"), "requirement-unimplemented:declared:declared:requirement:r2": ("requirement-implementation", "MISSING_EVIDENCE"),
        "use-case-unreachable:use_case:api_endpoint:api_endpoint:get-/z": ("use-case-reachability", "PARTIAL_EVIDENCE"), "use-case-unreachable:use_case:cli_command:configuration:pkg": ("use-case-reachability", "PARTIAL_EVIDENCE"),
        "entry-point-untested:use_case:api_endpoint:api_endpoint:get-/y": ("behaviour-coverage", "MISSING_EVIDENCE"), "container-without-code:deployment_component:web": ("c4-without-code", "MISSING_EVIDENCE"), "agreement:behaviour-traced": ("cross-artefact-agreement", "CONSISTENT"), "agreement:data-traced": ("cross-artefact-agreement", "CONSISTENT"),
    }
    assert {k: got.get(k) for k in want} == want and not any(k.startswith(("response-unpaired", "projection", "store-untouched", "return-unsupported:function:svc")) for k in got)


def test_only_a_run_that_succeeded_verifies(spark):
    rows = spark.createDataFrame([(x,) for x in ("succeeded", "failed", "timed_out", "blocked", "unavailable", "not_run", None)], "outcome string")
    assert [r[0] for r in rows.select(rules.verification_status(F.col("outcome"))).collect()] == ["VERIFIED", *["UNKNOWN"] * 6]
    paths = spark.createDataFrame([(x,) for x in ("/api/health", "/HEALTHZ", "/healthy", "/statuses", "/v1/status?x", None)], "p string")
    assert [r[0] for r in paths.select(rules.asks_for_health(F.col("p"))).collect()] == [True, True, False, False, True, False]


def test_lineage_usage_and_message_totals(small):
    nodes, edges = small
    given = edges.withColumn("attributes", F.when(F.col("kind") == "reads", F.create_map(F.lit("operation"), F.lit("read"))).otherwise(F.col("attributes")))
    assert traverse.usage(given, "function:svc").first()[:] == (1, 0, 0) and traverse.usage(given, "table:audit").first()[:] == (0, 0, 1)
    entries = nodes.where("id = 'api_endpoint:get-/x'").selectExpr("id AS entry")
    messages = traverse.sequence(nodes, edges, entries)
    assert [r[:] for r in traverse.message_totals(messages, edges).collect()] == [("api_endpoint:get-/x", 4, 1, 1, 0)]


def test_parts_of_a_graph(spark, small):
    got = graph.query(*small, q="SRC/S", limit=2)
    assert [r["id"] for r in got["nodes"].collect()] == ["condition:c1", "function:deep"] and got["totals"].first()[:] == (len(NODES), len(EDGES), 3, True) and got["edges"].isEmpty()
    whole = graph.query(*small, q="src/s", edge_kind="calls")
    assert [r["id"] for r in whole["edges"].collect()] == ["function:svc|calls|function:deep"] and not whole["totals"].first()["truncated"]
    assert graph.explicit_share(small[1].where("false")).first()[:] == (0, 0.0)
    evidence = spark.createDataFrame([("e1", "DECLARATION", "b.ts", 1, "t"), ("e2", "DECLARATION", "a.ts", 2, "t"), ("e3", "x", "c", 3, "t")], "id string, kind string, path string, line int, producer string")
    refs = spark.createDataFrame([("function:h", "e1"), ("function:h", "e2"), ("function:svc", "e3")], "id string, evidence string")
    part = graph.detail(Graph(*small, evidence, refs, refs), "function:h")
    assert [r["id"] for r in part["evidence"].collect()] == ["e2", "e1"] and part["edges"].count() == 7 and part["node"].count() == 1


def test_snapshots_that_need_no_comparing(small):
    whole = Graph(*small, None, None, None)
    said, changes = drift.snapshots(whole, whole, {"extractor_version": "1", "schema_version": 5}, {"extractor_version": "2", "schema_version": 5}, truncated=True)
    assert changes is None and not said["comparable"] and "extractor" in said["reason"] and not said["identical"] and said["removal_confidence"] == "INDETERMINATE"
    said, changes = drift.snapshots(whole, whole, {"digest": "d"}, {"digest": "d"})
    assert changes is None and said["identical"] and said["comparable"] and said["reason"] is None
    assert drift.incomparable({"schema_version": 4}, {"schema_version": 5}) is not None


def test_maps_as_text_and_graphs_as_lines(spark, small, tmp_path):
    given = [{"b": 'x"y\\', "a": "é\n", "c": None}, {}, None]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in given], "m map<string,string>").select(stable_json(F.col("m"))).collect()]
    assert got[0] == '{"a":"é\\n","b":"x\\"y\\\\","c":null}' and got[1:] == ["{}", None] and json.loads(got[0]) == given[0]
    store = Store(spark, str(tmp_path / "store"))
    store.save("a", Graph(*small, spark.createDataFrame([("e", "k", "p", 1, "t")], "id string, kind string, path string, line int, producer string"), None, None))
    store.export("a", str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out" / "edges").glob("part-*") for x in f.read_text().splitlines()]
    assert {x["id"] for x in lines} == {r["id"] for r in small[1].collect()}
    assert [tuple(r) for r in store.summary("a").where("what = 'nodes'").limit(1).collect()] == [("nodes", "function", 4)]


def test_cycles_are_reported_with_the_dependency_view(spark):
    links = [("module:a", "imports", "module:b", None, None), ("module:b", "imports", "module:a", None, None), ("module:b", "re_exports", "module:c", None, None), ("module:c", "imports", "module:a", None, None), ("module:c", "depends_on", "package:p", None, None)]
    nodes, edges = made(spark, [(f"module:{x}", None, f"{x}.ts") for x in "abc"] + [("package:p", None, None)], links)
    view = views.dependencies(nodes, edges, longest=5)
    assert [tuple(r) for r in view.omitted.where("reason like '%in a circle'").collect()] == [("modules that import each other in a circle", 2, "module:a → module:b,module:a → module:b → module:c")]
    assert views.dependencies(nodes, edges).omitted.isEmpty() and view.edges.count() == 5


def test_ids_of_persistence_stay_short_until_the_end(spark):
    nodes = [(f"table:t{k}", "table", f"t{k}", None, None, 3, {}) for k in range(50)] + [("function:f", "function", "f", None, "a.ts", 3, {})]
    nodes = spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, path string, rank int, attributes map<string,string>")
    edges = spark.createDataFrame([(f"e{k}", "function:f", "reads", f"table:t{k}", 3, {}) for k in range(50)], "id string, src string, kind string, dst string, rank int, attributes map<string,string>")
    rests, whole = rules._rests(nodes, edges).collect(), rules.supports(nodes, edges).collect()
    assert len(rests) == len(whole) == 51 and {r["requirement"] for r in rests} == {"derived:persistence:reads"}
    assert {r["requirement"] for r in whole} == {r["id"] for r in rules.requirements(nodes, edges).collect()} == {"derived:persistence:reads:" + "+".join(sorted(f"t{k}" for k in range(50)))}


def test_guarding_calls_are_reduced_by_file_before_they_meet_endpoints(spark):
    nodes = [(f"api_endpoint:{k}", "api_endpoint", f"e{k}", None, "a.ts", 3, {}) for k in range(3)] + [(f"function:f{k}", "function", f"f{k}", None, "a.ts", 3, {}) for k in range(4)]
    nodes = spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, path string, rank int, attributes map<string,string>")
    edges = spark.createDataFrame([(f"e{k}", f"function:f{k}", "calls", "function:g", 2 + k % 2, {"callee": "parse" if k else "authorize"}) for k in range(4)], "id string, src string, kind string, dst string, rank int, attributes map<string,string>")
    assert rules.guards(nodes, edges).count() == 12
    assert sorted(tuple(r) for r in rules.guarded(nodes, edges).collect()) == [(f"api_endpoint:{k}", "a.ts", "operational_behaviour", 2) for k in range(3)]


def test_first_steps_are_those_of_the_whole_walk_and_walk_no_further(spark, monkeypatch):
    calls = sorted({(f"function:f{a:02}", f"function:f{(a * m + j) % 23:02}") for a in range(23) for m, j in ((3, 1), (5, 7), (7, 2), (1, 1))} | {(f"api_endpoint:e{k}", f"function:f{(5 * k) % 23:02}") for k in range(4)} | {("api_endpoint:e0", f"function:f{k:02}") for k in range(20)})
    edges = spark.createDataFrame([(f"{a}|calls|{b}", a, b) for a, b in calls], "id string, src string, dst string")
    entries = spark.createDataFrame([(f"api_endpoint:e{k}",) for k in range(5)], "entry string")
    written = []
    monkeypatch.setattr(traverse, "stored_table", lambda df, name, put=traverse.stored_table: written.append((name, put(df, name))) or written[-1][1])
    for depth, most in ((3, 5), (6, 30)):
        written.clear()
        want = traverse.steps(edges, entries, depth, most)[0]
        got = traverse.first_steps(edges, entries, depth, most)
        assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        assert sum(df.count() for name, df in written if name == "hop") == want.count()


def test_requirements_of_a_file_are_counted_without_a_row_for_each_pair(spark):
    nodes = [(f"api_endpoint:{k}", "api_endpoint", f"e{k}", None, f"src/{k % 2}.ts", 3, {}) for k in range(60)] + [(f"function:f{k}", "function", f"f{k}", None, f"src/{k % 3}.ts", 3, {}) for k in range(40)]
    nodes += [("module:src/0", "module", "m", None, "src/0.ts", 3, {}), ("table:t", "table", "t", None, None, 3, {}), ("api_endpoint:none", "api_endpoint", "n", None, None, 3, {})]
    nodes = spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, path string, rank int, attributes map<string,string>")
    calls = [(f"function:f{k}", f"function:f{(k + 1) % 40}") for k in range(0, 40, 2)] + [("api_endpoint:1", "function:f1"), ("api_endpoint:2", "function:f0"), ("api_endpoint:2", "module:src/0"), ("api_endpoint:2", "api_endpoint:4"), ("api_endpoint:3", "api_endpoint:5"), ("api_endpoint:none", "function:f9")]
    edges = spark.createDataFrame([(f"{a}|calls|{b}", a, "calls", b, 2, {"callee": "parse"} if a != "api_endpoint:3" else {}) for a, b in calls] + [("w", "function:f1", "writes", "table:t", 3, {})], "id string, src string, kind string, dst string, rank int, attributes map<string,string>")
    held, members = rules._held(nodes, edges)
    rests = rules._rests(nodes, edges)
    pairs = sorted(map(tuple, rests.collect()))
    assert len(pairs) == len(set(pairs)) and held.count() + members.count() < 400 < len(pairs)
    steps = rules.walked(nodes, edges)[0]
    want = {r["entry"]: r["n"] for r in rules.supported(nodes, edges, steps, rests).groupBy("entry").agg(F.countDistinct("requirement").alias("n")).collect()}
    got = {r["subject"]: r["requirements"] for r in rules.trace_index(nodes, edges).collect()}
    assert got == want and len(set(want.values())) > 3
    subjects = spark.createDataFrame([("function:f2",), ("module:src/0",), ("function:f30",), ("table:t",)], "subject string")
    of = rules.relevant(nodes, steps, subjects).join(rules.supported(nodes, edges, steps, rests), "entry").select("subject", "requirement").unionByName(rests.withColumnRenamed("node", "subject").join(subjects, "subject", "left_semi").select("subject", "requirement"))
    want = {r["subject"]: r["n"] for r in of.groupBy("subject").agg(F.countDistinct("requirement").alias("n")).collect()}
    assert {r["subject"]: r["requirements"] for r in rules.trace(nodes, edges, subjects).collect() if r["requirements"]} == want
