"""Builder, store, walks, drift and text functions on small graphs whose results are known."""

import datetime
import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from tracewright.functions import paths
from tracewright.functions.identity import slug
from tracewright.functions.redact import redact
from tracewright.operators import drift, traverse
from tracewright.plans import facts as made
from tracewright.plans import views
from tracewright.plans.build import SCHEMAS, Builder, Graph, callee_keys, import_keys
from tracewright.plans.shapes import merged_nodes, merged_values
from tracewright.sources.store import Store


def _facts(spark, **rows):
    out = {}
    for name, given in rows.items():
        fields = [f.strip().split(" ", 1)[0] for f in SCHEMAS[name].split(", ")]
        full = [tuple(({"producer": "test", "seq": k} | r).get(f) for f in fields) for k, r in enumerate(given)]
        out[name] = spark.createDataFrame(full, SCHEMAS[name])
    return out


ROUTE_CHAIN = {
    "files": [{"path": p, "language": "typescript", "digest": p, "analyzable": True} for p in ("src/routes.ts", "src/service.ts", "test/a.test.ts", "docs/req.md")],
    "entities": [
        {"path": "src/routes.ts", "kind": "function", "name": "handleList", "qualified_name": "handleList", "start_line": 3, "end_line": 9},
        {"path": "src/service.ts", "kind": "function", "name": "findAll", "qualified_name": "Service.findAll", "start_line": 2, "end_line": 8, "is_async": True},
        {"path": "src/service.ts", "kind": "class", "name": "Service", "qualified_name": "Service", "start_line": 1, "end_line": 20, "extends_from": ["Base", "Service"]},
        {"path": "src/service.ts", "kind": "class", "name": "Base", "qualified_name": "Base", "start_line": 30, "end_line": 31},
        {"path": "test/a.test.ts", "kind": "function", "name": "check", "qualified_name": "check", "start_line": 1, "end_line": 5},
    ],
    "imports": [
        {"path": "src/routes.ts", "specifier": "./service.js", "names": ["findAll"], "kind": "static", "line": 1, "is_external": False},
        {"path": "src/routes.ts", "specifier": "express", "names": [], "kind": "static", "line": 2, "is_external": True},
        {"path": "src/routes.ts", "specifier": "../../out", "names": [], "kind": "static", "line": 2, "is_external": False},
    ],
    "calls": [
        {"path": "src/routes.ts", "callee": "service.findAll", "line": 4, "from_qualified_name": "handleList"},
        {"path": "src/routes.ts", "callee": "service.findAll", "line": 5, "from_qualified_name": "handleList"},
        {"path": "src/routes.ts", "callee": "findAll()", "line": 12, "from_qualified_name": None},
        {"path": "test/a.test.ts", "callee": "handleList", "line": 2, "from_qualified_name": "check"},
        {"path": "src/routes.ts", "callee": "nowhere", "line": 6, "from_qualified_name": "handleList"},
    ],
    "markers": [
        {"path": "src/routes.ts", "name": "http.route", "line": 10, "attributes": {"httpMethod": "GET", "path": "/api/reports", "handler": "handleList"}},
        {"path": "src/service.ts", "name": "sql.query", "line": 4, "attributes": {"table": "reports", "operation": "read", "scope": "Service.findAll", "role": "from"}},
        {"path": "src/service.ts", "name": "sql.query", "line": 5, "attributes": {"table": "audit", "operation": "write"}},
        {"path": "src/service.ts", "name": "schema.table", "line": 1, "attributes": {"table": "reports", "columnCount": "2"}},
        {"path": "src/service.ts", "name": "schema.foreign_key", "line": 1, "attributes": {"table": "reports", "referencesTable": "users"}},
        {"path": "src/service.ts", "name": "control.branch", "line": 5, "attributes": {"scope": "Service.findAll", "condition": "a > b"}},
        {"path": "src/service.ts", "name": "control.loop", "line": 6, "attributes": {"scope": "nowhere"}},
        {"path": "docs/req.md", "name": "doc.requirement", "line": 1, "attributes": {"identifier": "REQ-001", "statement": "must list", "implementsRef": "handleList"}},
        {"path": "test/a.test.ts", "name": "test.case", "line": 1, "attributes": {"title": "lists"}},
    ],
    "returns": [
        {"path": "src/routes.ts", "line": 4, "from_qualified_name": "handleList", "kind": "call", "name": "findAll", "awaited": True},
        {"path": "src/routes.ts", "line": 5, "from_qualified_name": "handleList", "kind": "call", "name": "Base"},
    ],
    "throws": [{"path": "src/service.ts", "line": 3, "from_qualified_name": "Service.findAll", "via": "throw"}],
    "responses": [{"path": "src/routes.ts", "line": 5, "from_qualified_name": "handleList", "method": "json", "status": 200, "status_only": False}],
    "commits": [{"hash": "abc", "author_name": "A", "author_email": "A@x.org", "subject": "s", "files": ["src/routes.ts", "gone.ts"]}],
}
WANT = {
    "repository:shop|contains|module:src/routes": 3, "module:src/routes|contains|function:handlelist": 3, "class:service|extends|class:base": 2, "module:src/routes|imports|module:src/service": 3,
    "module:src/routes|depends_on|package:express": 3, "repository:shop|contains|package:express": 3, "function:handlelist|calls|function:service.findall": 2, "module:src/routes|calls|function:service.findall": 1,
    "function:check|calls|function:handlelist": 2, "module:src/routes|exposes|api_endpoint:get-/api/reports": 3, "api_endpoint:get-/api/reports|declared_in|module:src/routes": 3, "api_endpoint:get-/api/reports|calls|function:handlelist": 2,
    "module:src/service|declares_schema|table:reports": 3, "function:service.findall|reads|table:reports": 3, "module:src/service|writes|table:audit": 1, "function:service.findall|branches|condition:service.findall-5-branch": 3,
    "module:docs/req|declared_in|requirement:req-001": 3, "requirement:req-001|implements_requirement|function:handlelist": 3, "module:test/a.test|contains|test:test/a.test.ts-1-case-lists": 3,
    "function:service.findall|returns|function:handlelist": 2, "function:service.findall|throws|function:handlelist": 2, "function:service.findall|throws|module:src/routes": 2, "function:handlelist|returns|api_endpoint:get-/api/reports": 3,
    "function:check|tests|api_endpoint:get-/api/reports": 2, "commit:abc|modifies|module:src/routes": 3, "contributor:a-x.org|authored_by|commit:abc": 3, "repository:shop|contains|contributor:a-x.org": 3,
}


@pytest.fixture(scope="module")
def graph(spark):
    built = Builder(spark, _facts(spark, **ROUTE_CHAIN), "shop").graph()
    return Graph(*(traverse.cut(getattr(built, n)) for n in ("nodes", "edges", "evidence", "node_refs", "edge_refs")))


def test_a_whole_graph_is_built(graph):
    got = {r["id"]: r["rank"] for r in graph.edges.collect()}
    assert {k: v for k, v in got.items() if k in WANT} == WANT
    rest = set(got) - set(WANT)
    assert all("|contains|" in k for k in rest), rest
    nodes = {r["id"]: r for r in graph.nodes.collect()}
    assert nodes["table:reports"]["rank"] == 3 and nodes["table:audit"]["rank"] == 0 and nodes["table:audit"]["attributes"]["declaredInDdl"] == "false"
    assert "table:users" not in nodes and nodes["function:service.findall"]["attributes"] == {"isAsync": "true", "throwSites": "1"}


def test_every_fact_has_evidence(graph):
    for rows, refs in ((graph.nodes, graph.node_refs), (graph.edges, graph.edge_refs)):
        assert rows.join(refs, "id", "left_anti").isEmpty()
        assert refs.join(graph.evidence.withColumnRenamed("id", "evidence"), "evidence", "left_anti").isEmpty()
    row = graph.evidence.where("path = 'src/routes.ts' and kind = 'ROUTE_DECLARATION' and line = 10").first()
    assert row["id"] == "ev_" + hashlib.sha256(b"src/routes.ts:ROUTE_DECLARATION:10:test").hexdigest()[:16]


def test_the_order_of_facts_does_not_matter(spark, graph):
    turned = {k: [{"seq": i} | r for i, r in enumerate(v)][::-1] for k, v in ROUTE_CHAIN.items()}
    again = Builder(spark, _facts(spark, **turned), "shop").graph()
    key = lambda g: sorted((r["id"], r["rank"], str(r["label"]), str(r["attributes"])) for r in g.edges.collect())
    assert key(again) == key(graph)


def test_what_nothing_changed_in_has_no_drift(graph):
    assert drift.compare(graph, graph).isEmpty()


def test_drift_of_a_moved_module_and_a_lost_edge(graph):
    moved = graph.nodes.where("id <> 'module:docs/req'").unionByName(graph.nodes.where("id = 'module:docs/req'").withColumn("id", F.lit("module:docs/new")).withColumn("name", F.lit("docs/new")))
    target = Graph(moved, graph.edges.where("kind <> 'throws'"), graph.evidence, graph.node_refs, graph.edge_refs)
    rows = drift.compare(graph, target, truncated=True).collect()
    assert [(r["id"], r["previous_id"], r["claim"]) for r in rows if r["category"] == "NODE_RENAMED"] == [("module:docs/new", "module:docs/req", "STRONGLY_INFERRED")]
    assert not [r for r in rows if r["category"] in ("NODE_ADDED", "NODE_REMOVED")]
    gone = [r for r in rows if r["category"] == "EDGE_REMOVED"]
    assert len(gone) == 2 and all(r["indeterminate"] and r["claim"] == "INDETERMINATE" for r in gone)


def test_graphs_come_back_from_the_store(spark, graph, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    day = datetime.datetime(2026, 1, 1)
    store.save("a", graph, "first", day)
    store.fail("b", "broken", created_at=day + datetime.timedelta(1))
    store.save("c", graph, "second", day + datetime.timedelta(2))
    assert [(r["analysis_id"], r["status"]) for r in store.analyses().collect()] == [("c", "succeeded"), ("b", "failed"), ("a", "succeeded")]
    assert store.before("c") == "a" and store.before("a") is None and store.analyses(1).count() == 1
    assert store.graph("a").edges.count() == graph.edges.count()
    assert {r["kind"] for r in store.outgoing("a", "function:handlelist").collect()} == {"calls", "returns"} and store.incoming("a", "table:reports").count() == 2
    store.save("a", Graph(graph.nodes.limit(1), graph.edges.limit(1), graph.evidence, graph.node_refs, graph.edge_refs), "again", day)
    assert store.table("nodes", "a").count() == 1
    store.delete("a")
    assert [r["analysis_id"] for r in store.analyses().collect()] == ["c", "b"]


def test_sequences_by_a_recursive_walk(spark):
    import random

    draw = random.Random(4)
    calls = sorted({(f"f{draw.randrange(14)}", f"f{draw.randrange(14)}") for _ in range(60)} | {("e1", "f1"), ("e1", "f2"), ("e2", "f3")})
    backs = [(b, "returns", a) for a, b in calls[::2]] + [(b, "throws", a) for a, b in calls[::3]]
    edges = [(f"{a}|{k}|{b}", a, k, b, 3) for a, k, b in [*((a, "calls", b) for a, b in calls), *backs]]
    names = sorted({x for c in calls for x in c})
    nodes = spark.createDataFrame([(n, "api_endpoint" if n[0] == "e" else "function") for n in names], "id string, kind string")
    got = {}
    found = traverse.sequence(nodes, spark.createDataFrame(edges, "id string, src string, kind string, dst string, rank int"), nodes.where("kind = 'api_endpoint'").selectExpr("id AS entry"), depth=3, most=12)
    for r in found.orderBy("entry", "place").collect():
        got.setdefault(r["entry"], []).append(r["id"])

    def walked(entry):
        out, met, left = [], {entry}, [12]

        def walk(at, depth):
            for a, b in sorted((c for c in calls if c[0] == at), key=lambda c: f"{c[0]}|calls|{c[1]}"):
                if left[0] == 0:
                    return
                left[0] -= 1
                out.append(f"{a}|calls|{b}")
                if b not in met and depth < 3:
                    met.add(b)
                    walk(b, depth + 1)
                for kind in ("returns", "throws"):
                    if (b, kind, a) in backs:
                        out.append(f"{b}|{kind}|{a}")

        walk(entry, 0)
        return out

    assert got == {e: walked(e) for e in ("e1", "e2")}


def test_activity_and_mermaid(graph):
    view = views.activity(graph.nodes, graph.edges)
    assert [tuple(r) for r in view.edges.select("src", "dst").collect()] == [("function:service.findall", "condition:service.findall-5-branch")]
    text = [r["line"] for r in views.mermaid(views.classes(graph.nodes, graph.edges), "class-diagram").collect()]
    assert text[0] == "classDiagram TD" and '  n_class_service -. "STRONGLY_INFERRED" .-> n_class_base' in text


NAMES = ["café ﬁle ＡＢ", "café x", "½ a", "a\U0001f600b", "Ⅷ", "plain Name", "日本", "q́", "ǆ", "①②", "GET /api/reports", "..a--b//c..", ""]


def test_slugs_of_names_outside_ascii(spark):
    import re

    def want(name):
        out = unicodedata.normalize("NFKC", name)
        for pattern, new in (("[^A-Za-z0-9._/-]+", "-"), ("-{2,}", "-"), ("/{2,}", "/"), ("^[-.]+|[-.]+$", ""), ("^/+|/+$", "")):
            out = re.sub(pattern, new, out)
        return out.lower()

    rows = spark.createDataFrame([(n,) for n in NAMES], "n string").select("n", slug(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == {n: want(n) for n in NAMES}


def test_bearer_prefix_stays(spark):
    row = spark.createDataFrame([("Authorization: Bearer abcdefghijklmnop1234",)], "t string").select(redact(F.col("t")).alias("r")).first()
    assert row["r"] == "Authorization: Bearer [REDACTED]"


def test_paths_and_candidates(spark):
    rows = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/../../b",), ("",)], "p string").select("p", paths.normalised(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == {"a/./b/../c": "a/c", "../x": None, "a/../../b": None, "": ""}
    rows = spark.createDataFrame([("src/types.d.ts",), ("src/Panel.tsx",), ("Makefile",)], "p string").select(paths.module_name(F.col("p")).alias("m")).collect()
    assert [r["m"] for r in rows] == ["src/types", "src/Panel", "Makefile"]
    known = {"src/a.ts", "src/b.ts", "src/dir/index.ts"}
    asked = {("./b.js", "src/a.ts"): "src/b.ts", ("../b", "src/dir/x.ts"): "src/b.ts", ("./dir", "src/a.ts"): "src/dir/index.ts", ("express", "src/a.ts"): None}
    rows = spark.createDataFrame(list(asked), "s string, p string").select("s", "p", import_keys(F.col("p"), F.col("s")).alias("k")).collect()
    assert {(r["s"], r["p"]): next((k for k in r["k"] or [] if k in known), None) for r in rows} == asked
    row = spark.createDataFrame([("service.findById()",)], "c string").select(callee_keys(F.col("c")).alias("k")).first()
    assert row["k"] == ["service.findById()", "service.findById", "findById", "service"]


def test_files_are_classified_and_budgeted(spark, tmp_path):
    from tracewright.sources import files

    tree = {
        "src/a.ts": b"export {}", "src/b.d.ts": b"x", "node_modules/x/i.js": b"x", "package-lock.json": b"{}", "logo.PNG": b"x", "data.sql": b"a\x00b", "notes.xyz": b"text", "big.py": b"#" * (files.MOST_FILE_BYTES + 1),
        "Dockerfile.dev": b"FROM x", "Makefile": b"all:", "gen/keep.ts": b"x", "gen/drop.ts": b"x", "odd.md": bytes(range(128, 256)) * 3,
    }
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = files.classified(files.read(spark, str(tmp_path)), {"": "gen/*\n!gen/keep.ts\n# no\n"})
    got = {r["path"]: (r["language"], r["skip_reason"]) for r in rows.collect()}
    assert got == {
        "src/a.ts": ("typescript", None), "src/b.d.ts": ("typescript", None), "package-lock.json": ("json", "ignored_by_default"), "logo.PNG": ("unknown", "binary"), "data.sql": ("sql", "binary"), "notes.xyz": ("unknown", "unsupported_extension"),
        "big.py": ("python", "too_large"), "Dockerfile.dev": ("dockerfile", None), "Makefile": ("makefile", None), "gen/keep.ts": ("typescript", None), "gen/drop.ts": ("typescript", "ignored_by_vcs"), "odd.md": ("markdown", "binary"),
    }
    listed = spark.createDataFrame([(k, 10, True) for k in range(50)], "place int, byte_size int, listed boolean")
    kept, cut = files.budgeted(listed, most_files=100, most_bytes=125, width=7)
    assert sorted(r["place"] for r in kept.collect()) == list(range(12)) and cut
    assert files.budgeted(listed, most_files=3)[0].count() == 3 and not files.budgeted(listed)[1]


@pytest.mark.parametrize(
    "line, hits, misses",
    [("*.log", ["a.log", "x/y.log"], ["a.logs"]), ("/dist", ["dist/a", "dist"], ["x/dist/a"]), ("a/b", ["a/b", "a/b/c"], ["x/a/b"]), ("tmp/", ["tmp/x", "y/tmp/x"], ["tmp"]), ("**/x", ["x", "a/b/x"], ["xx"]), ("f?o[0-9]", ["foo1"], ["fo1"]), ("a/**/z", ["a/z", "a/b/c/z"], ["az"])],
)
def test_ignore_lines(line, hits, misses):
    import re

    from tracewright.sources.files import ignore_pattern

    shape = re.compile(ignore_pattern(line)[0])
    assert all(shape.match(h) for h in hits) and not any(shape.match(m) for m in misses)


def test_archives_and_logs(spark, tmp_path):
    import io
    import tarfile

    from tracewright.sources import files, tarball

    def archive(names, mode="w:gz"):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode=mode) as t:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size = 3
                t.addfile(info, io.BytesIO(b"abc"))
        return out.getvalue()

    (tmp_path / "tars").mkdir()
    (tmp_path / "tars" / "a.tgz").write_bytes(archive(["./src/a.ts", "b.md"]))
    assert sorted((r["path"], bytes(r["content"])) for r in tarball.read(spark, str(tmp_path / "tars")).collect()) == [("b.md", b"abc"), ("src/a.ts", b"abc")]
    held = spark.read.format("binaryFile").load(str(tmp_path / "tars"))
    assert sorted(r["path"] for r in tarball.unpacked(held).collect()) == ["b.md", "src/a.ts"]
    for bad in (archive(["../x"]), archive(["/x"], "w"), b"PK\x03\x04zip", b"none"):
        with pytest.raises(ValueError):
            list(tarball.members(bad))
    log = "\x1eabc\x1fab\x1fA B\x1fA@x.org\x1f2026-01-02T03:04:05+00:00\x1fsubject\n\nsrc/a.ts\nb.md\n\x1edef\x1fde\x1fC\x1fa@X.org\x1f2026-01-03T03:04:05+00:00\x1fother\n"
    rows = files.commits(spark.createDataFrame([(log,)], "value string"))
    assert [(r["hash"], r["subject"], r["files"]) for r in rows.orderBy("seq").collect()] == [("abc", "subject", ["src/a.ts", "b.md"]), ("def", "other", [])]
    assert files.contributors(rows).first()["n"] == 1


def test_calls_between_the_same_two_meet_endpoints_once_and_are_all_cited(spark):
    from tracewright.plans.build import Builder
    from tracewright.plans.shapes import SCHEMAS

    def of(name, *rows):
        fields = [f.strip().split(" ", 1)[0] for f in SCHEMAS[name].split(", ")]
        return spark.createDataFrame([tuple(r.get(f) for f in fields) for r in rows], SCHEMAS[name])

    at = {"producer": "p", "path": "test/a.ts"}
    facts = {
        "files": of("files", {"path": "test/a.ts", "analyzable": True, "seq": 1}),
        "entities": of("entities", {"path": "src/a.ts", "producer": "p", "seq": 1, "kind": "function", "name": "h", "qualified_name": "h", "start_line": 1}),
        "calls": of("calls", *({**at, "seq": k, "callee": "h", "line": k} for k in range(1, 21))),
        "markers": of("markers", *({"path": "src/a.ts", "producer": "p", "seq": k, "name": "http.route", "line": k, "attributes": {"httpMethod": "GET", "path": f"/{k}", "handler": "h"}} for k in range(3))),
    }
    assert Builder(spark, facts).tested().count() == 3  # not 60
    built = Builder(spark, facts).graph()
    refs = built.edge_refs.where("id like '%|tests|%'").groupBy("id").count().collect()
    assert len(refs) == 3 and {r["count"] for r in refs} == {20}


def _deployment_markers(spark, tmp_path):
    """Markers at rest, so that a plan shows how often they are scanned."""
    rows = [("a/compose.yml", "t", 1, "compose.service", 1, {"service": "w", "build": "./src"}), ("a/compose.yml", "t", 2, "compose.port_publish", 2, {"service": "w", "containerPort": "80", "hostPort": "8080"})]
    rows += [("a/compose.yml", "t", 3, "compose.network", 3, {"service": "gone", "network": "n"}), ("a/compose.yml", "t", 4, "compose.network_declared", 4, {"network": "n"}), ("a/compose.yml", "t", 5, "compose.depends_on", 5, {"service": "gone", "dependsOn": "w"})]
    rows += [("a/compose.yml", "t", 6, "compose.volume_mount", 6, {"service": "w", "volume": ""}), ("a/compose.yml", "t", 7, "compose.service", 7, {"service": "w", "image": "i"}), ("a/compose.yml", "t", 8, "compose.service_address", 8, {"service": "w", "target": "x", "port": ""})]
    spark.createDataFrame(rows, SCHEMAS["markers"]).write.parquet(str(tmp_path / "markers"))
    spark.createDataFrame([("a/src/m.ts", "typescript", None, True, 0), ("a/src.ts", "typescript", None, True, 1)], SCHEMAS["files"]).write.parquet(str(tmp_path / "files"))
    return Builder(spark, {n: spark.read.parquet(str(tmp_path / n)) for n in ("markers", "files")})


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_deployed_shapes_share_a_scan(spark, tmp_path):
    nodes, edges = _deployment_markers(spark, tmp_path).deployed()
    assert {(r["src"], r["kind"], r["dst"]) for r in edges.collect()} == {
        ("deployment_component:w", "exposes", "port:w-80"), ("deployment_component:gone", "joins_network", "network:n"), ("deployment_component:w", "communicates_with", "deployment_component:x"),
    }
    found = {r["id"]: (r["seq"], r["attributes"]) for r in nodes.collect()}
    assert set(found) == {"port:w-80", "network:n"} and found["network:n"] == (3, {"declaredIn": "a/compose.yml"}) and found["port:w-80"][1]["hostPort"] == "8080"
    assert _scans(edges) <= 3


def test_named_attributes_are_merged_without_the_others(spark, tmp_path):
    rules = _deployment_markers(spark, tmp_path)
    seen = rules.components()[0]
    whole = {r["id"]: (r["attributes"].get("build"), r["attributes"].get("image")) for r in merged_nodes(seen).collect()}
    few = merged_values(seen, "build", "image")
    assert {r["id"]: (r["build"], r["image"]) for r in few.collect()} == whole == {"deployment_component:w": ("./src", "i")}
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()


def test_services_are_merged_in_one_grouping(spark, tmp_path):
    rules = _deployment_markers(spark, tmp_path)
    assert [tuple(r[c] for c in ("service", "name", "path", "seq", "folder")) for r in rules.services().collect()] == [("deployment_component:w", "w", "a/compose.yml", 1, "a/src")]
    links = rules.reconciled()
    assert {(r["src"], r["kind"], r["dst"]) for r in links.collect()} == {("module:a/src/m", "deploys", "deployment_component:w")}


def test_ids_and_counters_alone_are_those_of_the_graph(spark):
    facts = made.facts(spark, "/root/testdata/sf0.001")
    whole, rules = Builder(spark, facts).graph(), Builder(spark, facts)
    assert {tuple(r) for r in rules.edge_ids().collect()} == {tuple(r) for r in whole.edges.select("src", "kind", "dst").collect()}
    assert {tuple(r) for r in rules.node_ids().collect()} == {tuple(r) for r in whole.nodes.select("id", "kind").collect()}
    assert rules.counters() == whole.counters
