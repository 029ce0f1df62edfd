"""Streams against the same batch queries; blame, orders, scans, stores and table functions on small cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tracewright.extract import code, functions
from tracewright.functions.order import by_folder, placed, shown
from tracewright.plans import deploy, views
from tracewright.plans.shapes import EDGE, NODE, Graph, edges_of, merged_edges, merged_nodes, nodes_of
from tracewright.sources import blame, files, tarball
from tracewright.sources.store import Store
from tracewright.streaming import graph as streams

TEXTS = {f"src/f{k}.ts": f"export function f{k}(x: number): number {{ return f{(k * 3 + 1) % 7}(x); }}" for k in range(7)}


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_a_graph_of_a_stream_is_that_of_the_batch(spark, tmp_path):
    """Files in two micro-batches, one of them changed in the second."""
    source, root, checkpoint = (str(tmp_path / n) for n in ("in", "facts", "checkpoint"))
    first = {p: t for p, t in TEXTS.items() if p < "src/f4"} | {"src/f1.ts": "export function old() { gone(); }"}
    second = {p: t for p, t in TEXTS.items() if p >= "src/f4" or p == "src/f1.ts"} | {"src/f2.ts": ""}
    for k, texts in enumerate((first, second)):
        spark.createDataFrame([(p, "typescript", t) for p, t in texts.items()], streams.FILE).coalesce(1).write.mode("append").parquet(source)
        query = streams.keep_facts(streams.read_files(spark, source), root, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None and len(list((tmp_path / "facts").glob("batch=*"))) == k + 1
    batch = spark.createDataFrame([(p, "typescript", "" if p == "src/f2.ts" else t) for p, t in TEXTS.items()], streams.FILE)
    now = streams.current_facts(spark, root)
    assert _rows(now.where("fact <> 'file'")) == _rows(code.facts(batch)) and now.where("fact = 'file'").count() == len(TEXTS)
    assert now.where("fact = 'entity' and path in ('src/f1.ts', 'src/f2.ts')").select(F.col("fields")["name"]).collect() == [("f1",)]


def test_observations_merge_alike_in_any_batches(spark, tmp_path):
    draw = random.Random(5)
    ev = lambda k: (f"e{k % 9}", "DECLARATION", f"p{k % 3}", k, "t")
    rows = [(f"n{draw.randrange(20)}", f"n{draw.randrange(20)}", draw.choice(["x", None]), draw.randrange(4), ev(k), k) for k in range(200)]
    given = spark.createDataFrame(rows, "a string, b string, name string, strength int, evidence struct<id:string,kind:string,path:string,line:int,producer:string>, seq bigint")
    nodes = nodes_of(given, "function", F.coalesce("name", "a"), F.col("strength"), key=F.col("a"), path=F.col("b"))
    edges = edges_of(given, F.col("a"), "calls", F.col("b"), F.col("strength"), label=F.col("name"))
    root = str(tmp_path / "observed")
    for number, part in ((2, "seq % 3 = 0"), (0, "seq % 3 = 1"), (1, "seq % 3 <> 1"), (1, "seq % 3 = 2"), (2, "seq % 3 = 0")):  # 1 is replaced, 2 repeated
        streams.keep_observations(nodes.where(part), "nodes", root, number)
        streams.keep_observations(edges.where(part), "edges", root, number)
    assert _rows(streams.merged(spark, "nodes", root)) == _rows(merged_nodes(nodes)) and _rows(streams.merged(spark, "edges", root)) == _rows(merged_edges(edges))
    assert NODE.split(", ")[0] == "id string" and EDGE.split(", ")[0] == "src string"


def test_the_latest_status_is_kept_over_batches_and_late_records(spark, tmp_path):
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at = lambda m: datetime.datetime(2026, 1, 1, 0, m)
        batches = [[("a", at(5), 1, "succeeded"), ("b", at(1), 2, "failed")], [("a", at(3), 3, "failed"), ("b", at(2), 4, "succeeded"), ("c", at(1), 5, "timed_out"), ("c", at(1), 6, "succeeded")], [("c", at(1), 7, "blocked")]]
        source, got = str(tmp_path / "in"), {}
        for rows in batches:
            spark.createDataFrame(rows, streams.RECORD).coalesce(1).write.mode("append").parquet(source)

            def keep(batch, _):
                got.update({r["target"]: (r["status"], r["record_id"], r["n_records"]) for r in batch.collect()})

            stream = spark.readStream.schema(streams.RECORD).parquet(source)
            query = streams.latest_status(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
        assert got == {"a": ("VERIFIED", 1, 2), "b": ("VERIFIED", 4, 2), "c": ("UNKNOWN", 7, 3)}
    finally:
        if held:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)


def test_blame(spark):
    block = lambda c, n, who, line="code": f"{c * 40} 1 {n} 1\nauthor X\n{who}summary s\nfilename f\n" + (f"\t{line}\n" if line is not None else "")
    text = block("a", 1, "author-mail <A@x.org>\n") + block("b", 2, "author-mail <b@x.org>\n", "a" * 40 + " 3 4") + block("a", 3, "") + block("c", 4, "author-mail <c@x.org>\n", None)
    got = blame.lines(spark.createDataFrame([("f.ts", text), ("empty.ts", "")], "path string, value string"))
    assert sorted(map(tuple, got.collect())) == [("f.ts", 1, "a" * 40, "A@x.org"), ("f.ts", 2, "b" * 40, "b@x.org"), ("f.ts", 3, "a" * 40, "unknown")]


def test_ownership_by_plain_python(spark):
    draw = random.Random(2)
    lines = [(f"p{k % 2}", k // 2, "c", draw.choice(["a@x", "A@x", "b@x"])) for k in range(900)]
    spans = [(f"e{k}", f"p{k % 3}", a := draw.randrange(450), a + draw.randrange(-2, 200)) for k in range(60)]
    want = {}
    for e, p, a, b in spans:
        own = [m.lower() for q, n, _, m in lines if q == p and a <= n <= b]
        want |= {(e, m): (own.count(m), own.count(m) / len(own)) for m in own}
    got = blame.ownership(spark.createDataFrame(lines, "path string, line int, commit string, email string"), spark.createDataFrame(spans, "entity string, path string, start_line int, end_line int"))
    assert {(r["entity"], r["email"]): (r["n_lines"], r["share"]) for r in got.collect()} == want


def test_orders_that_people_see(spark):
    names = ["b/a", "B/z", "a-b/c", "a/é", "a/e", "a/E", "a/f", "a/Z", "ab", "a.ts", "_x", "1", "10", "2", "Éa"]
    rows = spark.createDataFrame([(n,) for n in names], "path string").repartition(5)
    by_place = lambda df: [r["path"] for r in sorted(df.collect(), key=lambda r: r["place"])]
    assert by_place(placed(rows, by_folder(F.col("path")))) == ["_x", "1", "10", "2", "a/e", "a/E", "a/é", "a/f", "a/Z", "a-b/c", "a.ts", "ab", "b/a", "B/z", "Éa"]
    assert by_place(placed(rows, shown(F.col("path"))))[:7] == ["_x", "1", "10", "2", "a-b/c", "a.ts", "a/e"]
    many = placed(spark.range(10_000).repartition(7), F.col("id").desc())
    assert many.where("place <> 10000 - id").isEmpty() and many.count() == 10_000 and placed(rows.where("false"), F.col("path")).isEmpty()


def test_large_files_are_listed_and_not_opened(spark, tmp_path):
    for name, size in (("b.ts", 10), ("a/z.ts", 2000), ("a/b.ts", 5), ("C.ts", 7)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x" * size)
    got = files.read(spark, str(tmp_path), most_file_bytes=100)
    assert {r["path"]: (r["byte_size"], r["content"] is None) for r in got.collect()} == {"b.ts": (10, False), "a/z.ts": (2000, True), "a/b.ts": (5, False), "C.ts": (7, False)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,100)" in plan.replace(" ", "") and "GreaterThan(length,100)" in plan.replace(" ", "")
    kept, cut = files.budgeted(files.classified(got).withColumn("listed", F.lit(True)), most_bytes=2010)
    assert sorted((r["place"], r["path"], r["bytes"]) for r in kept.collect()) == [(1, "a/b.ts", 5), (2, "a/z.ts", 2005)] and cut


def test_stores_keep_diagnostics_and_tell_the_older_analysis(spark, tmp_path):
    store, day = Store(spark, str(tmp_path / "s")), datetime.datetime(2026, 1, 1)
    nodes = spark.createDataFrame([("n2", "k", "b"), ("n1", "k", "a"), ("n0", "z", "a")], "id string, kind string, name string")
    notes = spark.createDataFrame([(2, "B", "info", "m", None), (1, "A", "warn", "m", "p")], "seq bigint, code string, severity string, message string, path string")
    for name, at in (("new", day + datetime.timedelta(1)), ("old", day)):
        store.save(name, Graph(nodes, spark.createDataFrame([], "id string, src string, kind string, dst string"), None, None, None), created_at=at, diagnostics=notes)
    assert [r["id"] for r in store.listed("nodes", "old").collect()] == ["n1", "n2", "n0"] and [r["code"] for r in store.listed("diagnostics", "new").collect()] == ["A", "B"]
    assert store.compared("new", "old") == store.compared("old", "new") == ("old", "new")
    with pytest.raises(ValueError, match="gone"):
        store.compared("new", "gone")
    with pytest.raises(ValueError, match="other"):
        store.save("x", Graph(nodes, nodes, None, None, None), other=nodes)


def test_table_functions_in_sql(spark):
    functions.register(spark)
    got = spark.sql("SELECT s.* FROM (SELECT explode(array('DELETE FROM a USING b', 'nothing', null, 'SELECT 1')) AS q) t, LATERAL sql_access(t.q) s").collect()
    assert sorted((r["table"] or "", r["access"] or "") for r in got) == [("", ""), ("a", "write"), ("b", "read")]
    got = spark.sql("SELECT f.fact, f.fields['callee'] AS callee FROM (VALUES ('a.py', 'python', 'f(1)'), ('a.go', 'go', 'f(1)'), ('b.ts', 'typescript', null)) t(p, l, x), LATERAL code_facts(t.p, t.l, t.x) f").collect()
    assert [tuple(r) for r in got] == [("call", "f")]
    readers = {p: (r := functions.reader_of(p, l)) and r.producer for p, l in (("a.ts", "typescript"), ("docker-compose.yml", "yaml"), (".github/workflows/ci.yaml", "yaml"), ("x.sql", "sql"), ("k8s.yaml", "yaml"), ("a.bin", ""))}
    assert readers == {"a.ts": "code", "docker-compose.yml": "compose", ".github/workflows/ci.yaml": "workflow", "x.sql": "ddl", "k8s.yaml": "yaml", "a.bin": None}


def test_views_by_their_kind(spark):
    nodes = spark.createDataFrame([("module:a", "module", "a", 3), ("module:b", "module", "b", 3)], "id string, kind string, name string, rank int").withColumn("attributes", F.create_map().cast("map<string,string>"))
    edges = spark.createDataFrame([("module:a|imports|module:b", "module:a", "imports", "module:b", 3, None)], "id string, src string, kind string, dst string, rank int, label string").withColumn("attributes", F.create_map().cast("map<string,string>"))
    assert {r["kind"] for r in views.supported(edges).where("sufficient").collect()} == {"dependency-graph", "c4-context", "c4-container", "c4-component"}
    assert [r["id"] for r in views.project("dependency-graph", nodes, edges).edges.collect()] == ["module:a|imports|module:b"]
    with pytest.raises(ValueError, match="no view"):
        views.project("pie", nodes, edges)


def test_archives_of_any_store(spark, tmp_path):
    import io
    import tarfile

    def archive(name, entries, mode="w:gz"):
        with tarfile.open(tmp_path / name, mode) as t:
            for path, data in entries:
                info = tarfile.TarInfo(path)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))

    archive("a.tgz", [("x/a.ts", b"one"), ("b.ts", b"")])
    archive("bad.tar", [("ok.ts", b"1"), ("../up.ts", b"2")], "w")
    (tmp_path / "z.zip").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "big.tgz").write_bytes(b"\x1f\x8b" + b"0" * 30_000)
    got = {(r["archive"].rsplit("/", 1)[-1], r["path"]): (r["byte_size"], r["content"] and bytes(r["content"]), r["refused"] is not None) for r in tarball.read(spark, str(tmp_path), most_bytes=20_000).collect()}
    assert got == {("a.tgz", "x/a.ts"): (3, b"one", False), ("a.tgz", "b.ts"): (0, b"", False), ("bad.tar", None): (None, None, True), ("z.zip", None): (None, None, True), ("big.tgz", None): (None, None, True)}


def test_a_long_log_is_read_record_by_record(spark, tmp_path):
    record = lambda k: f"\x1e{k:040x}\x1f{k:07x}\x1fA\x1fa{k % 3}@X.org\x1f2026-01-{k % 28 + 1:02}T00:00:00+00:00\x1fdo {k}\n\nsrc/f{k}.ts\nb.ts\n"
    (tmp_path / "log.txt").write_text("".join(record(k) for k in range(500)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = files.read_log(spark, str(tmp_path))
        got = rows.orderBy("seq").collect()
        assert rows.rdd.getNumPartitions() > 3 and [r["subject"] for r in got] == [f"do {k}" for k in range(500)]
        assert got[7]["files"] == ["src/f7.ts", "b.ts"] and got[7]["ts"].day == 8 and files.contributors(rows).first()["n"] == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


# Deployment


def test_the_first_file_that_a_command_names(spark):
    modules = spark.createDataFrame([("m1", "api/src/main.ts"), ("m2", "src/main.ts"), ("m3", "api/app/run.py"), ("m4", "tool")], "module string, path string")
    cases = {
        "a": ("api", "node src/main.ts", None, "m1"), "b": ("api", "node --x /src/main.ts", None, "m2"), "c": ("web", "node src/main.ts", None, "m2"), "d": ("api", "python run.py", "/app", "m3"), "e": ("", '["node", "src/main.ts"]', None, "m2"),
        "f": ("api", "src/main.ts", None, None), "g": ("api", "sh -c node$X src/main.ts;", None, None), "h": ("api", "node ../src/main.ts", None, None), "i": ("", "x tool.js", None, "m4"), "j": (None, "node src/main.ts nowhere.ts", None, "m2"),
    }
    services = spark.createDataFrame([(k, v[0]) for k, v in cases.items()] + [("z", "api")], "service string, folder string")
    commands = spark.createDataFrame([(k, v[1], v[2]) for k, v in cases.items()], "service string, command string, workdir string")
    links, lost = deploy.started(services, commands, modules)
    assert {r["service"]: r["module"] for r in links.collect()} == {k: v[3] for k, v in cases.items() if v[3]}
    assert {r["subject"] for r in lost.collect()} == {"f", "g", "h", "z"}


def test_nested_contexts_give_all_services(spark):
    modules = spark.createDataFrame([(p, p) for p in ("apps/api/a.ts", "apps/api/lib/b.ts", "apps/web/c.ts", "apps/api/lib", "d.ts")], "module string, path string")
    services = spark.createDataFrame([("all", "compose.yml", "."), ("apps", "compose.yml", "apps"), ("api", "apps/compose.yml", "./api"), ("up", "apps/compose.yml", "../web"), ("abs", "c.yml", "/x"), ("none", "c.yml", None), ("empty", "c.yml", "nowhere")], "service string, path string, context string")
    links, lost = deploy.built(services.select("service", deploy.context_folder(F.col("path"), F.col("context")).alias("folder")), modules)
    got = {}
    for r in links.collect():
        got.setdefault(r["service"], set()).add(r["module"])
    inside = {"apps/api/a.ts", "apps/api/lib/b.ts"}
    assert got == {"all": inside | {"apps/web/c.ts", "d.ts"}, "apps": inside | {"apps/web/c.ts"}, "api": inside}
    assert {r["subject"]: r["reason"].startswith("no build context") for r in lost.collect()} == {"up": True, "abs": True, "none": True, "empty": False}




def test_contexts_of_services_with_several_folders_and_of_equal_rows(spark):
    services = spark.createDataFrame([("s", "a"), ("s", "a/b"), ("s", "x"), ("t", "a"), ("t", "a"), ("u", None), ("v", "y")], "service string, folder string")
    modules = spark.createDataFrame([("m", "a/b/m.ts"), ("m", "a/b/m.js"), ("n", "a/n.ts"), ("o", "a/b")], "module string, path string")
    links, lost = deploy.built(services, modules)
    assert sorted(map(tuple, links.collect())) == [("s", "m"), ("s", "n"), ("t", "m"), ("t", "n")]
    assert sorted(r["subject"] for r in lost.collect()) == ["u", "v"]


def test_pairs_of_services_with_one_folder_are_not_made_distinct(spark):
    services = spark.range(2000).selectExpr("concat('s', id) as service", "'a' as folder")
    modules = spark.range(2000).selectExpr("concat('m', id) as module", "concat('a/m', id, '.ts') as path")
    links = deploy.built(services, modules)[0]
    assert links.count() == 4_000_000
    assert links._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # no grouping of all pairs


def test_markers_of_deployment_are_parsed_once(spark):
    from tracewright import queries_config

    sf = "/root/testdata/sf0.001"
    first, again = (queries_config._deployment(spark, sf).facts["markers"] for _ in range(2))
    assert first.inputFiles() == again.inputFiles() and "MapIn" not in first._jdf.queryExecution().optimizedPlan().toString()
