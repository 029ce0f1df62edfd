"""The readers of sources on short texts whose facts are known, and from texts to a graph."""

import pytest
from pyspark.sql import functions as F

from tracewright.extract import code
from tracewright.extract.python import logical_lines, python
from tracewright.extract.typescript import typescript
from tracewright.plans.build import Builder


def of(rows, fact, *fields):
    out = [tuple(r[2].get(f) for f in fields) if len(fields) > 1 else r[2].get(fields[0]) for r in rows if r[0] == fact]
    return out


def ts(text, path="a.ts"):
    return list(typescript(text, path))


def named(rows):
    return of(rows, "entity", "qualified")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("function f(x: number): string { return g(x); }", ["f"]),
        ("class A { m(x): void { go(x); } n() { go(); } }", ["A", "A.m", "A.n"]),
        ("abstract class A<T extends B<C>> { abstract m(): void; get v(): number { return 1; } set v(x) {} static #p = 1; static { f(); } [k]() {} 'quoted'() {} constructor(private a = 1) {} }", ["A", "A.m", "A.quoted", "A.constructor"]),
        ("class A { f = (a: number): string => b(a); readonly n: Map<string, () => void> = make(); x!: number; }", ["A", "A.f", "A.n"]),
        ("const h = async <T,>(a: T): Promise<T> => a, k = 1, { z } = o;", ["h", "k"]),
        ("enum E { A = 1, 'B', C = f() }\nconst enum G { X }", ["E", "E.A", "E.B", "E.C", "G", "G.X"]),
        ("type A = { f(): void } | B<C<D>>[];\ntype F = (a: string) => void\nlet after = 1", ["A", "F", "after"]),
        ("interface I<T> extends J<T>, K { m(): void }\ndeclare function g(x: string): void;\nnamespace N { export function inner() {} }", ["I", "g", "inner"]),
        ("export default class extends B {}\nexport default function () { x(); }", ["default"]),
        ("const o = { m() { f(); }, async *g() {}, get p() { return 1; }, a: () => 1, [x]: 2, ...r };", ["o", "m", "g"]),
        ("function a(x: { b: string } = { b: '}' }, [y, z]: number[] = [], { p: q = f() }: P) { }", ["a"]),
        ("for (let i = 0, n = a.length; i < n; i++) {}\nfor (const x of y) {}\nfor (const k in o) {}", ["i", "n"]),
        ("const a = b ? (c) : d => e;\nconst t = <T,>(x: T) => x;", ["a", "t"]),
    ],
)
def test_declarations(text, want):
    assert named(ts(text)) == want and not of(ts(text), "problem", "code")


def test_scopes_lines_and_heritage():
    rows = ts("export class S<T> extends ns.Base<T> implements A, B<C> {\n  async m() {\n    const v = compute(input);\n    service.save(v);\n  }\n}\n")
    (s, m, v) = [r for r in rows if r[0] == "entity"]
    assert (s[1], s[2]["end"], s[2]["extends"], s[2]["implements"], s[2]["modifiers"]) == (1, 6, "ns.Base", "A\x1fB", "export")
    assert (m[1], m[2]["end"], m[2]["isAsync"], m[2]["signature"]) == (2, 5, True, "()") and v[2]["qualified"] == "S.m.v"
    assert of(rows, "call", "callee", "scope") == [("compute", "S.m"), ("service.save", "S.m")]
    assert of(rows, "binding", "name", "callee", "scope") == [("v", "compute", "S.m")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("parse<Foo>(x); m?.(); o?.p?.(1); a < b; c > (d);", ["parse", "m", "o.p"]),
        ("o['k'](1); o[k](2); f()(3); (g)(4); new X(5).run(); this.db.query(); super.go();", ["o[k]", "f()", "f", "g", "new X.run", "db.query", "go"]),
        ("a!.b(); (x as Y).c(); (<Z>x).d(); tag`t ${e()}`; x = y as unknown as Z<W>;", ["b", "c", "d", "e"]),
        ("const r = /https?:\\/\\/[/\"'`]/g; f(a / b / c); if (x) /re(/.test(y); g(1) / 2; h();", ["f", "test", "g", "h"]),
        ("f(`a ${b(`c ${d()}`)} }`); // g()\n/* h() */ k('l()');", ["f", "b", "d", "k"]),
        ("if (a) { b(); } while (c()) {} switch (d()) { case e(): f(); default: g(); } do { h(); } while (i());", ["b", "c", "d", "e", "f", "g", "h", "i"]),
        ("import('./x.js').then(y); const z = require('./w.js'); import.meta.url;", ["then", "require"]),
        ("@Dec({ a: f() }) class A { @Get('x') m(@Body() b: B) { g(); } }", ["Dec", "f", "Get", "Body", "g"]),
    ],
)
def test_calls(text, want):
    assert sorted(of(ts(text), "call", "callee")) == sorted(want) and not of(ts(text), "problem", "code")


def test_markup_is_not_code():
    rows = ts("export function Panel({ a }: P) {\n  const x = a < b ? 1 : 2;\n  return <div className='x' {...rest} onClick={() => go(a)}>it's {label(a)} <b/> if (x) {'}'}</div>;\n}\nfunction g() { f(); }\n", "a.tsx")
    assert named(rows) == ["Panel", "Panel.x", "g"] and of(rows, "call", "callee", "scope") == [("go", "Panel"), ("label", "Panel"), ("f", "g")]
    assert of(rows, "return", "kind") == ["expression"] and not of(rows, "problem", "code")


def test_imports_of_every_form():
    text = "import express from 'express';\nimport type { C as D } from './c.js';\nimport { readFile } from 'node:fs/promises';\nimport './side.js';\nexport { helper } from './helper.js';\nexport * as all from './all.js';\nimport old = require('old');\nimport d, * as ns from '../d';\nasync function l() { return import('./lazy.js'); }\nconst r = require('/abs.js');\n"
    got = [(r[1], r[2]["specifier"], r[2]["kind"], r[2]["names"], r[2]["external"]) for r in ts(text) if r[0] == "import"]
    assert got == [
        (1, "express", "static", "express", True), (2, "./c.js", "type_only", "C as D", False), (3, "node:fs/promises", "static", "readFile", False), (4, "./side.js", "static", "", False), (5, "./helper.js", "reexport", "helper", False),
        (6, "./all.js", "reexport", "", False), (7, "old", "require", "", True), (8, "../d", "static", "d\x1f* as ns", False), (9, "./lazy.js", "dynamic", "", False), (10, "/abs.js", "require", "", False),
    ]


def test_routes_take_the_second_argument():
    rows = ts("app.get('/a', auth, async (req, res) => { go(); });\nrouter.post('/b', async (req: R): Promise<void> => { return svc.make(req.body); });\nstore.get('/c');\napp.use('/api', router);\napp.api.put(`/d`, h.handle);\napp.get(path, x);")
    markers = [(r[1], r[2]["name"], r[2].get("httpMethod"), r[2]["path"], r[2].get("handler")) for r in rows if r[0] == "marker"]
    assert markers == [(1, "http.route", "GET", "/a", "auth"), (2, "http.route", "POST", "/b", "POST /b handler"), (4, "middleware.mount", None, "/api", None), (5, "http.route", "PUT", "/d", "h.handle")]
    (handler,) = [r[2] for r in rows if r[0] == "entity"]
    assert (handler["name"], handler["isAsync"], handler["routeHandler"]) == ("POST /b handler", True, True)
    assert ("svc.make", "POST /b handler") in of(rows, "call", "callee", "scope") and ("go", None) in of(rows, "call", "callee", "scope")


@pytest.mark.parametrize(
    ("said", "kind", "name"),
    [
        ("find(id)", "call", "find"), ("await svc.find(id)", "awaited_call", "svc.find"), ("(find(id))", "call", "find"), ("new User(id)", "constructor", "User"), ("id", "identifier", "id"), ("undefined", "identifier", "undefined"), ("'x'", "literal", None), ("`x`", "literal", None),
        ("{ a: 1 }", "literal", None), ("[1]", "literal", None), ("null", "literal", None), ("a + b", "expression", None), ("this.x", "expression", None), ("a ? b : c", "expression", None), ("`x${y}`", "expression", None), ("x as T", "expression", None), ("() => 1", "expression", None), ("", "bare", None),
    ],
)
def test_what_is_returned(said, kind, name):
    assert of(ts(f"function f() {{ return {said}; }}"), "return", "kind", "name", "scope") == [(kind, name, "f")]


def test_control_flow_needs_a_scope():
    text = "if (top) {}\nfunction f() { if (a && b) {} else if (c) {} for (const x of y) {} for (;i < 3;) {} while (w) {} do {} while (d); switch (s) {} try {} catch (e) {} const t = q ? 1 : r ? 2 : 3; }"
    flows = of(ts(text), "marker", "name", "condition")
    assert flows == [("control.branch", "a && b"), ("control.branch", "c"), ("control.loop", "y"), ("control.loop", "i < 3"), ("control.loop", "w"), ("control.loop", "d"), ("control.branch", "s"), ("control.handler", None), ("control.branch", "q"), ("control.branch", "r")]


def test_failures_and_answers():
    text = "async function f(res) { if (a) throw new Error('x'); return Promise.reject(e); }\nfunction g() { res.status(201).json(order); reply.status(404); queue.status(200); res.status('500').type('x').send(make()); return new Response(body); }"
    rows = ts(text)
    assert of(rows, "throw", "via", "expression", "inAsyncFunction") == [("throw", "new Error('x')", True), ("reject", "e", True)]
    assert of(rows, "response", "method", "status", "statusOnly", "payload") == [("json", 201, False, "order"), ("status", 404, True, None), ("send", None, False, "make"), ("status", 500, True, None), ("Response", None, False, "body")]


def test_statements_in_arguments():
    rows = ts("function f() { db.run(`WITH r AS (SELECT * FROM orders) SELECT * FROM r`); db.run('VACUUM'); const s = 'SELECT * FROM hidden'; it('SELECT', x); }")
    assert [(m["name"], m.get("table"), m.get("names"), m["scope"]) for m in (r[2] for r in rows if r[0] == "marker" and r[2]["name"].startswith("sql"))][:2] == [("sql.query", "orders", None, "f"), ("sql.cte", None, "r", "f")]
    assert "hidden" not in str(rows)


@pytest.mark.parametrize(("text", "code_"), [("function broken( { return;", "TS1005"), ("export class Good {\n  method() {}\n", "TS1005"), ("x = 'abc\ny()", "TS1002"), ("`a ${b", "TS1160"), ("/* x", "TS1010"), ("f())", "TS1128")])
def test_broken_text_gives_problems_and_what_can_be_read(text, code_):
    rows = ts(text)
    assert code_ in of(rows, "problem", "code")
    assert "Good" not in text or named(rows) == ["Good", "Good.method"]


def test_reading_is_linear():
    import time

    one = "export function f(x: number): string { if (x > 1) { return g(x, {a: [1, `b ${c}`]}); } const q = h(x as any) / 2; return q; }\n"
    took = []
    for n in (500, 4000):
        start = time.process_time()
        assert len(ts(one * n)) > n
        took.append(time.process_time() - start)
    assert took[1] < 8 * 3 * max(took[0], 0.02)


# Python


def test_logical_lines():
    lines, broken = logical_lines("a = f(1,\n  2)  # c\n\n\tif x: \\\n  y\n'''d\nef'''\nb = 'x # y'\r\nc")
    assert [(x.line, x.indent, x.code) for x in lines] == [(1, 0, "a = f(1, 2)"), (4, 4, "if x: y"), (6, 0, '""'), (8, 0, 'b = ""'), (9, 0, "c")] and broken is None
    assert lines[3].raw == "b = 'x # y'"
    assert logical_lines("def f():\n    t = 'open\n")[1] == 2 and logical_lines("x = (1,\n2")[1] == 1 and logical_lines("'''never")[1] == 1


def test_python_declarations():
    rows = list(python('import os.path, sys as s\nfrom .m import (\n  A as B,\n  C,\n)\nfrom x import *\nMAX = 1\nclass Repo(Base, metaclass=M):\n    """def no(): pass"""\n    async def fetch(self, x=make()):\n        return 1\ndef test_it(): pass\n# def commented(): pass\n'))
    assert of(rows, "entity", "kind", "qualified", "isAsync") == [("constant", "MAX", None), ("class", "Repo", None), ("function", "Repo.fetch", True), ("test", "test_it", False)]
    assert of(rows, "import", "specifier", "names", "external") == [("os.path", "", True), ("sys", "", True), (".m", "A\x1fC", False), ("x", "", True)]
    assert of(rows, "call", "callee", "scope") == [("make", "Repo.fetch")] and of(rows, "entity", "extends")[1] == "Base\x1fmetaclass"


def test_a_route_waits_for_its_definition():
    rows = list(python('class Api:\n    @app.route("/things")\n    @login\n    def things():\n        return []\n@router.post("/users")\nasync def create(r):\n    if True:\n        def inner():\n            return 1\n@app.get("/orphan")\nx = 1\n'))
    got = [(r[1], r[2]["httpMethod"], r[2]["path"], r[2].get("handler"), r[2].get("handlerQualifiedName")) for r in rows if r[0] == "marker" and r[2]["name"] == "http.route"]
    assert got == [(4, "ROUTE", "/things", "things", "Api.things"), (7, "POST", "/users", "create", "create"), (11, "GET", "/orphan", None, None)]


def test_python_results():
    rows = list(python("def h():\n    if a and b:\n        for x in y:\n            try:\n                db.run('SELECT * FROM t')\n            finally:\n                pass\n    raise ValueError(x)\n    return JSONResponse(d, status_code=201)\n    return await find(x)\n    response.json(y)\n    return\nreturn [1]\n"))
    assert of(rows, "marker", "name", "condition") == [("control.branch", "a and b"), ("control.loop", "x in y"), ("control.handler", None), ("sql.query", None), ("control.handler", None)]
    assert of(rows, "return", "kind", "name", "awaited") == [("call", "JSONResponse", None), ("call", "find", True), ("bare", None, None), ("literal", None, None)]
    assert of(rows, "throw", "expression") == ["ValueError(x)"] and of(rows, "response", "method", "status") == [("JSONResponse", 201), ("json", None)]


# From texts to a graph


def test_caps(spark):
    body = "\n".join(f"  step{i}();" for i in range(50))
    files = spark.createDataFrame([("a.ts", "typescript", f"function many() {{\n{body}\n}}"), ("b.ts", "typescript", "f())))"), ("c.txt", "text", "f()"), ("d.ts", "typescript", None)], "path string, language string, text string")
    rows = code.facts(files, most_calls=5, most_problems=2)
    assert rows.where("path = 'a.ts' and fact = 'call'").count() == 5 and rows.where("path = 'b.ts' and fact = 'problem'").count() == 2
    assert [r["fields"]["code"] for r in rows.where("path = 'a.ts' and fact = 'problem'").collect()] == ["CALLS_TRUNCATED"] and rows.where("path > 'c'").isEmpty()


def test_every_marker_reaches_the_graph(spark):
    texts = {
        "src/app.ts": "import { list } from './repo.js';\napp.get('/orders', async (req, res) => { const rows = await list(); res.status(200).json(rows); return rows; });\napp.use('/x', y);\n",
        "src/repo.ts": "export async function list(): Promise<Row[]> {\n  if (bad) { throw new Error('x'); }\n  db.run('VACUUM t');\n  return db.all(`WITH recent AS (SELECT * FROM orders), old AS (SELECT 1) SELECT * FROM recent`);\n}\n",
        "test/app.test.ts": "describe('orders', () => { it('lists', () => {}); });\n",
    }
    sources = spark.createDataFrame([(p, "typescript", t) for p, t in texts.items()], "path string, language string, text string")
    files = sources.select("path", "language", F.sha2("text", 256).alias("digest"), F.lit(True).alias("analyzable"), F.lit(0).cast("long").alias("seq"))
    graph = Builder(spark, {"files": files, **code.tables(code.facts(sources))}).graph()
    nodes = {r["id"]: r for r in graph.nodes.collect()}
    edges = {r["id"]: r["attributes"] for r in graph.edges.collect()}
    assert None not in nodes and all(r["kind"] and r["name"] for r in nodes.values())
    handler = "function:get-/orders-handler"
    for want in (
        f"api_endpoint:get-/orders|calls|{handler}", f"{handler}|calls|function:list", f"function:list|returns|{handler}", f"{handler}|returns|api_endpoint:get-/orders", f"function:list|throws|{handler}", "function:list|reads|table:orders",
        "function:list|produces|constant:cte-list-recent", "function:list|produces|constant:cte-list-old", "module:src/app|imports|module:src/repo", "module:src/app|configures|configuration:src/app.ts-2", "module:src/app|configures|configuration:src/app.ts-3",
    ):
        assert want in edges, (want, sorted(edges))
    assert nodes[handler]["attributes"] | {"hasReturn": "true", "returnCount": "1", "returnsShape": "identifier", "httpResponses": "1", "httpResponseStatuses": "200", "routeHandler": "true"} == nodes[handler]["attributes"]
    assert edges[f"function:list|returns|{handler}"]["via"] == "rows" and nodes["configuration:src/app.ts-3"]["attributes"]["marker"] == "middleware.mount"
    assert sum(r["attributes"] is not None and r["attributes"].get("unclassifiedStatement") == "true" for r in nodes.values()) == 1
    assert graph.counters | {"files": 3, "imports": 1, "resolvedInternalImports": 1, "apiEndpoints": 1, "tests": 2, "tables": 0} == graph.counters


def test_files_made_of_a_small_table_are_many_tasks(spark):
    from tracewright import queries_code, queries_config

    sf = "/root/testdata/sf0.1"
    assert queries_code._sources(spark, sf).rdd.getNumPartitions() == 30 and queries_config._files(spark, sf, "x").rdd.getNumPartitions() == 15


def test_bound_thrown_and_answered_in_one_pass(spark):
    from tracewright import queries_code

    plan = queries_code.code_results(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_gaps_are_looked_for_only_where_one_begins(monkeypatch):
    """Tokens that stand side by side cost no search for white space and comments; gaps of all sorts are still found."""
    from tracewright.extract import typescript as reader

    class Counted:
        n, skip = 0, reader._SKIP

        def match(self, *args):
            self.n += 1
            return self.skip.match(*args)

    counted = Counted()
    monkeypatch.setattr(reader, "_SKIP", counted)
    tokens = reader.Tokens("#!/bin/x\na.b(c)[d] /*e*/+//f\n(g) ;h", False)
    assert tokens.text == ["a", ".", "b", "(", "c", ")", "[", "d", "]", "+", "(", "g", ")", ";", "h"]
    assert [t for t, fresh in zip(tokens.text, tokens.fresh, strict=True) if fresh] == ["a", "("]
    assert counted.n < len(tokens.text) / 2


def test_facts_that_are_handed_on_keep_their_numbers(spark):
    files = spark.createDataFrame([("a.ts", "typescript", 'import { x } from "./x";\nexport function f() { return x(1); }\n'), ("b.py", "python", "from .x import y\n\ndef g():\n    return y()\n")], "path string, language string, text string")
    rows = lambda df: sorted((r["path"], r["fact"], r["line"], r["at"], sorted(r["fields"].items())) for r in df.collect())
    every = rows(code.facts(files))
    assert rows(code.facts(files, only=("import", "call"))) == [r for r in every if r[1] in ("import", "call")] != every
