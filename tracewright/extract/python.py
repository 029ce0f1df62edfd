"""Facts out of Python sources, read as logical lines.

One pass joins physical lines inside brackets and triple-quoted strings and after a
backslash, drops comments, and keeps two views of each logical line: ``code`` with empty
strings, ``raw`` with the values of strings on one line. Indentation gives the scopes; a
route's decorator waits for the next definition of its own indentation. A file that ends in a string or
bracket gives a problem and the facts up to there.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

from tracewright.extract.sql_access import analyse

Row = tuple[str, int, dict]

# Words before a bracket that aren't called, frameworks' decorators and answers.
NO_CALLS = {"if", "elif", "while", "for", "return", "assert", "not", "and", "or", "in", "is", "with", "print", "def", "class"}
FRAMEWORKS = (
    ("http.route", "fastapi", re.compile(r"@(\w+)\.(get|post|put|patch|delete)\s*\(\s*[\"']([^\"']+)[\"']")),
    ("http.route", "flask", re.compile(r"@(\w+)\.(route)\s*\(\s*[\"']([^\"']+)[\"']")),
    ("http.route", "django", re.compile(r"path\s*\(\s*[\"']([^\"']+)[\"']")),
    ("async.task", "celery", re.compile(r"@(\w+)\.task\s*\(")),
)
_ANSWER = re.compile(r"\b(JSONResponse|PlainTextResponse|HTMLResponse|RedirectResponse|Response)\s*\(")
_ANSWERING = re.compile(r"\bresponse\.(json|send|send_status|redirect|write|make_response)\s*\(")
_STATUS = re.compile(r"status(?:_code)?\s*=\s*(\d{3})")
MOST_SAID = 120

_TOKEN = re.compile(r"(?P<triple>\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z))|(?P<string>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<comment>#[^\n]*)|(?P<joined>\\\n)|(?P<end>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<code>[^\"'#\\\n()\[\]{}]+|\\)", re.S)
_DEF = re.compile(r"(async\s+)?def\s+([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?\((.*)$", re.S)
_CLASS = re.compile(r"class\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?")
_CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(")


@dataclass
class Line:
    line: int
    indent: int
    code: str
    raw: str


def logical_lines(text: str) -> tuple[list[Line], int | None]:
    """The logical lines that hold code, and the line of a string or bracket that never ends."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    out, code, raw, depth, line, first, begin, broken = [], [], [], 0, 1, 1, 0, None

    def flush(end: int) -> None:
        nonlocal first, begin
        said = " ".join("".join(code).split())
        if said:
            head = text[begin:end]
            blank = head[: len(head) - len(head.lstrip(" \t"))]
            out.append(Line(first, len(blank.expandtabs(4)) if "\t" not in blank.lstrip("\t") else sum(4 if c == "\t" else 1 for c in blank), said, " ".join("".join(raw).split())))
        code.clear()
        raw.clear()

    for m in _TOKEN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "end":
            if depth <= 0:
                flush(m.start())
                depth, first, begin = 0, line + 1, m.end()
            else:
                code.append(" ")
                raw.append(" ")
        elif kind == "triple":
            code.append('""')
            raw.append('""')
            if len(value) < 6 or value[-3:] != value[:3]:
                broken = broken or first
        elif kind == "string":
            if len(value) < 2 or value[-1] != value[0]:
                broken = broken or first
                value += value[0]
            code.append('""')
            raw.append(value)
        elif kind == "joined":
            code.append(" ")
            raw.append(" ")
        elif kind != "comment":
            depth += (kind == "open") - (kind == "close")
            code.append(value)
            raw.append(value)
        line += value.count("\n")
    if depth > 0:
        broken = broken or first
    flush(len(text))
    return out, broken


def clip(text: str) -> str:
    text = " ".join(text.split())
    return text if len(text) <= MOST_SAID else text[: MOST_SAID - 1] + "."


def shape(expression: str) -> tuple[str, str | None]:
    """What an expression is by its beginning: (kind, name). A constructor is written as a call."""
    if m := re.match(r"([A-Za-z_][\w.]*)\s*\(", expression):
        return "call", m[1]
    if re.fullmatch(r"[A-Za-z_]\w*", expression):
        return "identifier", expression
    return ("literal" if expression[:1] in "([{\"'`" else "expression"), None


def python(text: str, path: str = "") -> Iterator[Row]:
    lines, broken = logical_lines(text)
    scopes: list[tuple[int, str]] = []
    waiting: tuple[int, Row] | None = None
    for here in lines:
        while scopes and scopes[-1][0] >= here.indent:
            scopes.pop()
        scope = scopes[-1][1] if scopes else None
        declared = m[2] if (m := _DEF.match(here.code)) else m[1] if (m := _CLASS.match(here.code)) else None
        qualified = f"{scope}.{declared}" if scope and declared else declared
        if declared and waiting and waiting[0] == here.indent:
            fact, _, fields = waiting[1]
            yield fact, here.line, fields | {"handler": declared, "handlerQualifiedName": qualified, "handlerDerived": False, "scope": qualified}
            waiting = None
        for row in _facts(here, scope, qualified):
            if row[0] == "marker" and row[2]["name"] == "http.route":
                waiting = (here.indent, row)
            else:
                yield row
        if declared:
            scopes.append((here.indent, qualified))
    if waiting:
        yield waiting[1]
    if broken:
        yield "problem", broken, {"code": "PY_UNTERMINATED_LITERAL", "message": "the file ends inside a string or bracket"}


def _facts(here: Line, scope: str | None, qualified: str | None) -> Iterator[Row]:
    code, at = here.code, here.line
    if m := re.match(r"from\s+([.\w]+)\s+import\s+(.+)$", code):
        names = [x.split(" as ")[0].strip() for x in re.sub(r"[()]", "", m[2]).split(",")]
        yield "import", at, {"specifier": m[1], "kind": "static", "names": "\x1f".join(x for x in names if x and x != "*"), "external": not m[1].startswith(".")}
    elif m := re.match(r"import\s+(.+)$", code):
        for part in m[1].split(","):
            if module := part.split(" as ")[0].strip():
                yield "import", at, {"specifier": module, "kind": "static", "names": "", "external": not module.startswith(".")}
    elif m := _DEF.match(code):
        yield "entity", at, {"kind": "test" if m[2].startswith("test_") else "function", "name": m[2], "qualified": qualified, "end": at, "language": "python", "signature": f"({m[3]})", "modifiers": "async" if m[1] else None, "isAsync": bool(m[1])}
        yield from _calls(code[m.start(3) :], at, qualified)
    elif m := _CLASS.match(code):
        bases = [b.split("=")[0].strip() for b in (m[2] or "").split(",")]
        yield "entity", at, {"kind": "class", "name": m[1], "qualified": qualified, "end": at, "language": "python", "extends": "\x1f".join(b for b in bases if b) or None}
    elif m := re.match(r"([A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)", code):
        yield "entity", at, {"kind": "constant", "name": m[1], "qualified": f"{scope}.{m[1]}" if scope else m[1], "end": at, "language": "python"}
    else:
        yield from _calls(code, at, scope)
        if scope:
            yield from _flow(code, at, scope)
        yield from _results(here, scope)
        if scope:
            yield from _sql(here, scope)
        if m := next(((fact, name, m) for fact, name, p in FRAMEWORKS if (m := p.search(here.raw))), None):
            fact, name, m = m
            route = {"path": m[3], "httpMethod": m[2].upper()} if name in ("fastapi", "flask") else {}
            yield "marker", at, {"name": fact, "framework": name, **route}


def _calls(code: str, at: int, scope: str | None) -> Iterator[Row]:
    for m in _CALL.finditer(code):
        if m[1] not in NO_CALLS:
            before = code[: m.start()].rstrip()
            yield "call", at, {"callee": m[1], "scope": scope, "awaited": True if re.search(r"\bawait$", before) else None, "argCount": _arguments(code, m.end() - 1)}


def _arguments(code: str, opening: int) -> int:
    """Commas at the top level of a call's brackets and one, if anything stands there."""
    depth = commas = 0
    solid = False
    for c in code[opening:]:
        depth += (c in "([{") - (c in ")]}")
        if not depth:
            break
        commas += depth == 1 and c == ","
        solid = solid or depth > 1 or (depth == 1 and c not in " (")
    return commas + 1 if solid else 0


def _flow(code: str, at: int, scope: str) -> Iterator[Row]:
    if m := re.match(r"(if|elif|for|while)\s+(.+?):\s*$", code):
        flow = "branch" if m[1] in ("if", "elif") else "loop"
        yield "marker", at, {"name": f"control.{flow}", "flow": flow, "scope": scope, "condition": clip(m[2])}
    elif re.match(r"(try|finally)\s*:", code):
        yield "marker", at, {"name": "control.handler", "flow": "handler", "scope": scope}


def _results(here: Line, scope: str | None) -> Iterator[Row]:
    """What is returned, bound, raised and answered on a line."""
    code, at, expression = here.code, here.line, None
    if m := re.match(r"return\b\s*(.*)$", code):
        expression = m[1].strip()
        if expression:
            awaited = bool(re.match(r"await\s", expression))
            kind, name = shape(re.sub(r"^await\s+", "", expression))
            yield "return", at, {"scope": scope, "kind": kind, "name": name, "awaited": awaited or None, "expression": clip(expression)}
        else:
            yield "return", at, {"scope": scope, "kind": "bare"}
    elif m := re.match(r"raise\b\s*(.*)$", code):
        yield "throw", at, {"scope": scope, "via": "throw", "expression": clip(m[1]) or None}
    returned = True if expression is not None else None
    m = _ANSWER.search(clip(expression or "")) or _ANSWERING.search(code)
    if m:
        status = _STATUS.search(clip(expression) if expression and m.re is _ANSWER else code)
        yield "response", at, {"method": m[1], "status": int(status[1]) if status else None, "statusOnly": False, "returned": returned, "scope": scope}


def _sql(here: Line, scope: str) -> Iterator[Row]:
    for m in re.finditer(r"(['\"])(.*?)\1", here.raw, re.S):
        got = analyse(m[2]) if re.match(r"\s*[A-Za-z(]", m[2]) else None
        if not got:
            continue
        if not got.tables:
            yield "marker", here.line, {"name": "sql.statement", "scope": scope, "summary": got.summary, "unsupported": got.reason}
            continue
        for table, operation, role in got.tables:
            yield "marker", here.line, {"name": "sql.query", "table": table, "operation": operation, "role": role, "statement": got.summary, "scope": scope}
        if got.ctes:
            yield "marker", here.line, {"name": "sql.cte", "scope": scope, "names": ",".join(got.ctes), "statement": got.summary}
