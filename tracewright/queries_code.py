"""Queries of the source-code readers: sources made of tables, each with SQL of what is in them."""

from pyspark.sql import functions as F

from tracewright.extract import code
from tracewright.operators.graph import guard
from tracewright.plans import estate
from tracewright.plans.build import Builder, merged_edges, merged_nodes
from tracewright.registry import register
from tracewright.storage import stored_table

# @k@, @a@ and @b@ stand for numbers of customers.
_TS = r"""import { c@a@ as other } from "./f@a@.js";
import express, * as ns from 'express';
// c@b@(1) is not called here
export class S@k@<T> extends S@b@<T> implements I@k@ {
  private readonly rows: Map<string, number[]> = load@k@();
  get size(): number { return this.rows.size; }
  m@k@(x: number): void { c@a@(x); } n@k@<U>(y: U): U { return c@a@<U>(y); }
  async q@k@(x: number): Promise<number> {
    if (x > @k@) { return c@a@?.(x); }
    const found = await db.query(`SELECT * FROM p@k@ JOIN q@a@ ON 1`);
    return found;
  }
}
interface I@k@ { m@k@(x: number): void }
type T@k@ = { a: string } | ((x: number) => void);
export function c@k@(req: Request, res: Response): string { return t(`a ${c@a@(`b ${c@b@(req)}`)} "`); }
export const h@k@ = async (req: Request, res: Response): Promise<void> => {
  for (const y of req.items) { c@a@(y); }
  const ok = /https?:\/\/["'`]/.test(req.url) ? c@b@(1) : 2 / 1;
  if (!ok) throw new Error("c@b@(");
  res.status(201).json(ok);
};
app.get("/o/@k@", auth@k@, async (req, res) => { c@a@(req); });
app.post("/o/@k@", async (req: R, res: S): Promise<void> => { return c@a@(req); });
"""
_PY = '''from .f@a@ import (
    c@a@,  # a comment
    c@b@ as other,
)
LIMIT_@k@ = 10


class P@k@(Base):
    """c@b@() is not called here
    def nor_declared(): pass
    """

    @app.get("/p/@k@")
    @guarded
    async def g@k@(self, x=c@b@()):
        while x: 
            c@a@(one=x,
                 two=(1, 2))
        rows = db.run("WITH w@k@ AS (SELECT * FROM p@k@) SELECT * FROM w@k@")
        return JSONResponse(c@a@(rows), status_code=201)


def test_h@k@():
    if LIMIT_@k@ > 1:
        raise ValueError("c@b@()")
    return \\
        c@a@
'''


def _sources(spark, sf):
    """A TypeScript and a Python file for each customer, with links to other customers' files."""
    rows = estate.dealt(estate.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") * 7 % 50 + 1).alias("a"), (F.col("c_custkey") % 9 + 1).alias("b")))

    def text(of):
        out = F.lit(of)
        for c in ("k", "a", "b"):
            out = F.replace(out, F.lit(f"@{c}@"), F.col(c).cast("string"))
        return out

    ts = rows.select(F.concat(F.lit("src/f"), "k", F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), text(_TS).alias("text"))
    return ts.unionByName(rows.select(F.concat(F.lit("py/f"), "k", F.lit(".py")).alias("path"), F.lit("python").alias("language"), text(_PY).alias("text")))


def _facts(spark, sf, *only):
    return code.tables(code.facts(_sources(spark, sf), only=only or None))


def _found(columns, ts, py=()):
    """SQL of the rows that each customer's files have."""
    rows = [("'src/f' || k || '.ts'", *r) for r in ts] + [("'py/f' || k || '.py'", *r) for r in py]
    values = ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)
    names = ", ".join(("path", *columns))
    return f"WITH r AS (SELECT c_custkey AS k, c_custkey * 7 % 50 + 1 AS a, c_custkey % 9 + 1 AS b FROM customer) SELECT {names} FROM r, LATERAL (VALUES {values}) v({names})"


_C, _M, _Q, _H = "'S' || k", "'S' || k || '.m' || k", "'S' || k || '.q' || k", "'h' || k"
_N, _P, _PH, _T = "'S' || k || '.n' || k", "'P' || k", "'P' || k || '.g' || k", "'test_h' || k"
_POST = "'POST /o/' || k || ' handler'"


@register(
    _found(
        ("qualified_name", "kind", "start_line", "end_line", "extends_from", "is_async"),
        [
            (_C, "'class'", 4, 13, "'S' || b", "NULL::BOOLEAN"), (_C + " || '.rows'", "'constant'", 5, 5, "NULL", "NULL"), (_M, "'function'", 7, 7, "NULL", "false"), (_N, "'function'", 7, 7, "NULL", "false"), (_Q, "'function'", 8, 12, "NULL", "true"),
            (_Q + " || '.found'", "'constant'", 10, 10, "NULL", "NULL"), ("'I' || k", "'interface'", 14, 14, "NULL", "NULL"), ("'T' || k", "'type'", 15, 15, "NULL", "NULL"), ("'c' || k", "'function'", 16, 16, "NULL", "false"),
            (_H, "'function'", 17, 22, "NULL", "true"), (_H + " || '.ok'", "'constant'", 19, 19, "NULL", "NULL"), (_POST, "'function'", 24, 24, "NULL", "true"),
        ],
        [("'LIMIT_' || k", "'constant'", 5, 5, "NULL", "NULL"), (_P, "'class'", 8, 8, "'Base'", "NULL"), (_PH, "'function'", 15, 15, "NULL", "true"), (_T, "'test'", 23, 23, "NULL", "false")],
    )
)
def code_entities(spark, sf):
    rows = _facts(spark, sf)["entities"]
    return rows.select("path", "qualified_name", "kind", "start_line", "end_line", F.array_join("extends_from", ",").alias("extends_from"), "is_async")


@register(
    _found(
        ("line", "callee", "scope", "awaited"),
        [
            (5, "'load' || k", _C, "false"), (7, "'c' || a", _M, "false"), (7, "'c' || a", _N, "false"), (9, "'c' || a", _Q, "false"), (10, "'db.query'", _Q, "true"), (16, "'t'", "'c' || k", "false"), (16, "'c' || a", "'c' || k", "false"), (16, "'c' || b", "'c' || k", "false"),
            (18, "'c' || a", _H, "false"), (19, "'test'", _H, "false"), (19, "'c' || b", _H, "false"), (21, "'res.status().json'", _H, "false"), (21, "'res.status'", _H, "false"), (23, "'app.get'", "NULL", "false"), (23, "'c' || a", "NULL", "false"), (24, "'app.post'", "NULL", "false"), (24, "'c' || a", _POST, "false"),
        ],
        [(13, "'app.get'", _P, "false"), (15, "'c' || b", _PH, "false"), (17, "'c' || a", _PH, "false"), (19, "'db.run'", _PH, "false"), (20, "'JSONResponse'", _PH, "false"), (20, "'c' || a", _PH, "false"), (25, "'ValueError'", _T, "false")],
    )
)
def code_calls(spark, sf):
    return _facts(spark, sf)["calls"].select("path", "line", "callee", F.col("from_qualified_name").alias("scope"), F.coalesce("awaited", F.lit(False)).alias("awaited"))


@register(_found(("specifier", "names", "is_external"), [("'./f' || a || '.js'", "'c' || a || ' as other'", "false"), ("'express'", "'express,* as ns'", "true")], [("'.f' || a", "'c' || a || ',c' || b", "false")]))
def code_imports(spark, sf):
    return _facts(spark, sf, "import")["imports"].select("path", "specifier", F.array_join("names", ",").alias("names"), "is_external")


@register(
    _found(
        ("line", "name", "said", "scope"),
        [
            (9, "'control.branch'", "'x > ' || k", _Q), (10, "'sql.query'", "'p' || k", _Q), (10, "'sql.query'", "'q' || a", _Q), (18, "'control.loop'", "'req.items'", _H), (19, "'control.branch'", """'/https?:\\/\\/["''`]/.test(req.url)'""", _H),
            (20, "'control.branch'", "'!ok'", _H), (21, "'http.response'", "'ok'", _H), (23, "'http.route'", "'auth' || k", "NULL"), (24, "'http.route'", _POST, "NULL"),
        ],
        [(15, "'http.route'", "'g' || k", _PH), (16, "'control.loop'", "'x'", _PH), (19, "'sql.query'", "'p' || k", _PH), (19, "'sql.cte'", "'w' || k", _PH), (20, "'http.response'", "'201'", _PH), (24, "'control.branch'", "'LIMIT_' || k || ' > 1'", _T)],
    )
)
def code_markers(spark, sf):
    a = F.col("attributes")
    return _facts(spark, sf, "marker", "response")["markers"].select("path", "line", "name", F.coalesce(a["handler"], a["table"], a["names"], a["condition"], a["payload"], a["status"]).alias("said"), a["scope"].alias("scope"))


@register(
    _found(
        ("line", "kind", "name", "scope"),
        [(6, "'expression'", "NULL", _C), (7, "'call'", "'c' || a", _N), (9, "'call'", "'c' || a", _Q), (11, "'identifier'", "'found'", _Q), (16, "'call'", "'t'", "'c' || k"), (24, "'call'", "'c' || a", _POST)],
        [(20, "'call'", "'JSONResponse'", _PH), (26, "'identifier'", "'c' || a", _T)],
    )
)
def code_returns(spark, sf):
    return _facts(spark, sf)["returns"].select("path", "line", "kind", "name", F.col("from_qualified_name").alias("scope"))


@register(_found(("fact", "line", "said", "scope"), [("'binding'", 10, "'found=db.query'", _Q), ("'throw'", 20, "'new Error(\"c' || b || '(\")'", _H), ("'response'", 21, "'json 201 ok'", _H)], [("'response'", 20, "'JSONResponse 201'", _PH), ("'throw'", 25, "'ValueError(\"\")'", _T)]))
def code_results(spark, sf):
    """What is bound, thrown and answered, in one pass over the facts."""
    f = F.col("fields")
    said = {"binding": F.concat_ws("=", f["name"], f["callee"]), "throw": f["expression"], "response": F.concat_ws(" ", f["method"], f["status"].cast("int").cast("string"), f["payload"])}
    rows = code.facts(_sources(spark, sf)).where(F.col("fact").isin(*said))
    each = F.coalesce(*[F.when(F.col("fact") == fact, text) for fact, text in said.items()])
    return rows.select("path", "fact", "line", each.alias("said"), f["scope"].alias("scope"))


@register("""WITH r AS (SELECT c_custkey AS k, c_custkey * 7 % 50 + 1 AS a, c_custkey % 9 + 1 AS b FROM customer), f AS (SELECT 'function:s' || k || '.n' || k AS src, a AS t, k FROM r UNION ALL SELECT 'function:s' || k || '.m' || k, a, k FROM r UNION ALL SELECT 'function:s' || k || '.q' || k, a, k FROM r
UNION ALL SELECT 'function:c' || k, a, k FROM r UNION ALL SELECT 'function:c' || k, b, k FROM r UNION ALL SELECT 'function:h' || k, a, k FROM r UNION ALL SELECT 'function:h' || k, b, k FROM r UNION ALL SELECT 'function:post-/o/' || k || '-handler', a, k FROM r
UNION ALL SELECT 'function:p' || k || '.g' || k, a, k FROM r UNION ALL SELECT 'function:p' || k || '.g' || k, b, k FROM r),
e AS (SELECT 'module:src/f' || k || '|imports|module:src/f' || a AS id, 3 AS rank, a FROM r UNION ALL SELECT src || '|calls|function:c' || t, 2, t FROM f WHERE src <> 'function:c' || t UNION ALL SELECT 'module:src/f' || k || '|calls|function:c' || a, 1, a FROM r
UNION ALL SELECT 'class:s' || k || '|extends|class:s' || b, 2, b FROM r WHERE b <> k UNION ALL SELECT 'class:s' || k || '|implements|interface:i' || k, 2, k FROM r UNION ALL SELECT 'api_endpoint:post-/o/' || k || '|calls|function:post-/o/' || k || '-handler', 2, k FROM r)
SELECT DISTINCT id, rank FROM e WHERE a IN (SELECT k FROM r)
UNION ALL SELECT 'api_endpoint:get-/p/' || k || '|calls|function:p' || k || '.g' || k, 2 FROM r""")
def code_graph(spark, sf):
    """From sources to a graph: imports, calls, heritage and routes whose ends are known."""
    sources = _sources(spark, sf)
    files = sources.select("path", "language", F.sha2("text", 256).alias("digest"), F.lit(True).alias("analyzable"), F.lit(0).cast("long").alias("seq"))
    rules = Builder(spark, {"files": files, **code.tables(stored_table(code.facts(sources, only=("entity", "import", "call", "marker", "response")), "facts"))})  # parsed once, though several rules read them
    nodes = merged_nodes(rules.modules()[0].unionByName(rules.entities()[0]).unionByName(rules.routes()[0]))
    observed = rules.imports()[1].where("kind = 'imports'").unionByName(rules.calls()).unionByName(rules.inheritance()).unionByName(rules.routes()[1].where("kind = 'calls'"))
    return guard(merged_edges(observed), nodes).select("id", "rank")
