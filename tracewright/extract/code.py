"""Facts out of source code: TypeScript, JavaScript and Python, without their compilers.

``facts`` gives rows (path, fact, line, at, fields) of files; ``tables`` turns them into the
fact tables that the builder takes. A file that can't be read gives one problem. Of a
file at most ``most_calls`` calls and ``most_problems`` problems are kept, the first by place; a file that
has more says so in a problem of its own.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.extract.python import python
from tracewright.extract.typescript import typescript
from tracewright.plans.shapes import SCHEMAS

READERS = {"typescript": typescript, "javascript": typescript, "python": python}
FACTS = "path string, fact string, line int, at int, fields map<string,string>"
MOST_CALLS, MOST_PROBLEMS = 5000, 50
#: Rows of a batch that are handed on.
AT_ONCE = 20_000


def read(text: str, language: str, path: str, most_calls: int = MOST_CALLS, most_problems: int = MOST_PROBLEMS) -> list[tuple[str, int, dict]]:
    """A file's facts within the caps."""
    try:
        rows = list(READERS[language](text, path))
    except (ValueError, IndexError, KeyError, RecursionError) as e:
        return [("problem", 1, {"code": "PARSE_FAILED", "message": str(e)[:200]})]
    out, calls, problems = [], 0, 0
    for row in rows:
        calls += row[0] == "call"
        problems += row[0] == "problem"
        if (row[0] != "call" or calls <= most_calls) and (row[0] != "problem" or problems <= most_problems):
            out.append(row)
    if calls > most_calls:
        out.append(("problem", 0, {"code": "CALLS_TRUNCATED", "message": f"{most_calls} of {calls} calls are kept"}))
    return out


def facts(files: DataFrame, most_calls: int = MOST_CALLS, most_problems: int = MOST_PROBLEMS, only: tuple[str, ...] | None = None) -> DataFrame:
    """(path, fact, line, at, fields) of files (path, language, text); ``at`` numbers a file's facts.

    Files are read as a whole; ``only`` names the facts that are handed on, which keep their numbers.
    """

    def batch_of(rows: list) -> pa.RecordBatch:
        maps = [[(k, str(v).lower() if isinstance(v, bool) else str(v)) for k, v in r[4].items() if v is not None] for r in rows]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(maps, pa.map_(pa.string(), pa.string()))], ["path", "fact", "line", "at", "fields"])

    def work(batches):
        rows = []
        for batch in batches:
            for path, language, text in zip(batch.column("path").to_pylist(), batch.column("language").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if language in READERS and text is not None:
                    rows += [(path, fact, line, at, fields) for at, (fact, line, fields) in enumerate(read(text, language, path, most_calls, most_problems)) if only is None or fact in only]
                if len(rows) >= AT_ONCE:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return files.select("path", "language", "text").mapInArrow(work, FACTS)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The builder's fact tables of rows of ``facts``; ``seq`` orders them by file and place, whatever the partitions.

    Each table reads ``rows`` anew: store them first where sources are dear to parse.
    """
    f = F.col("fields")
    listed = lambda c: F.when(c.isNotNull() & (c != ""), F.split(c, "\x1f"))
    # a file's rank is the first 39 bits of its path's digest, so no global sort is needed
    seq = F.conv(F.substring(F.sha2("path", 256), 1, 9), 16, 10).cast("long") * F.lit(1 << 20) + F.col("at")
    base = {"producer": F.lit("code"), "seq": seq, "start_line": F.col("line"), "line": F.col("line"), "path": F.col("path"), "from_qualified_name": f["scope"], "awaited": f["awaited"] == "true"}
    own = {
        "entities": ("entity", {"kind": f["kind"], "name": f["name"], "qualified_name": f["qualified"], "end_line": f["end"], "language": f["language"], "extends_from": listed(f["extends"]), "implements_from": listed(f["implements"]), "is_async": f["isAsync"] == "true", "attributes": F.map_filter(f, lambda k, _: k.isin("signature", "modifiers", "declaredType", "routeHandler", "method", "path"))}),
        "imports": ("import", {"specifier": f["specifier"], "names": F.coalesce(listed(f["names"]), F.array().cast("array<string>")), "kind": f["kind"], "is_external": f["external"] == "true"}),
        "calls": ("call", {"callee": f["callee"]}),
        # a response is a marker too
        "markers": ("marker", {"name": F.coalesce(f["name"], F.lit("http.response")), "attributes": F.map_filter(f, lambda k, v: (k != "name") & ~((k == "statusOnly") & (v == "false")))}),
        "returns": ("return", {"kind": F.when((f["kind"] == "call") & (f["awaited"] == "true"), "awaited_call").otherwise(f["kind"]), "name": f["name"], "expression": f["expression"]}),
        "bindings": ("binding", {"name": f["name"], "callee": f["callee"]}),
        "throws": ("throw", {"expression": f["expression"], "via": f["via"], "rejects": f["inAsyncFunction"] == "true"}),
        "responses": ("response", {"method": f["method"], "status": f["status"], "status_only": f["statusOnly"] == "true", "payload": f["payload"], "payload_kind": f["payloadKind"]}),
    }
    out = {}
    for name, (fact, given) in own.items():
        given = base | given
        fields = [x.strip().split(" ", 1) for x in SCHEMAS[name].split(", ")]
        mine = rows.where(F.col("fact").isin(fact, "response") if fact == "marker" else F.col("fact") == fact)
        out[name] = mine.select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))
    return out
