"""Markers out of configuration, documentation and schema files.

Every reader takes files (path, text) and gives markers (path, name, line, attributes),
one file at a time. Markdown, Dockerfiles and manifests are read with SQL functions;
YAML and DDL, which nest, by generators in Arrow batches. Values of variables are
never kept, only their names.
"""

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKERS = "path string, name string, line int, attributes map<string,string>"
# Words in names of variables that hold credentials.
CREDENTIAL = r"(?i)(?:^|_)(?:SECRET|TOKEN|PASSWORD|PASSWD|APIKEY|API_KEY|PRIVATE_KEY|CREDENTIAL|CREDENTIALS|ACCESS_KEY|CLIENT_SECRET|AUTH)(?:$|_)"
OBLIGATION = r"(?i)\b(must not|shall not|may not|must|shall|should|is required to|has to|needs to)\b"


def lines(files: DataFrame) -> DataFrame:
    """(path, line, text): the lines of each file from 1."""
    each = files.select("path", F.posexplode(F.split("text", r"\r?\n", -1)).alias("at", "text"))
    return each.select("path", (F.col("at") + 1).cast("int").alias("line"), "text")


def _known(**given: Column) -> Column:
    parts = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in given.items()]
    return F.map_from_entries(F.filter(F.array(*parts), lambda e: e["value"].isNotNull()))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def markdown(files: DataFrame) -> DataFrame:
    """Requirements: numbered ones, and sentences with an obligation; not in fences, headings and tables."""
    rows = lines(files).withColumn("fence", F.col("text").rlike(r"^\s*(```|~~~)"))
    before = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("open", F.sum(F.col("fence").cast("int")).over(before) % 2).where("not fence and open = 0")
    text = F.trim("text")
    rows = rows.withColumn("text", F.regexp_replace(text, r"^(?:[-*]|\d+\.)\s+", "")).where((text != "") & ~text.rlike(r"^[#|]"))
    numbered = r"^([A-Z][A-Z0-9]*-\d+)\s*[:.—-]\s*(.+)$"
    rows = rows.withColumn("identifier", _part(F.col("text"), numbered)).withColumn("said", F.trim(F.coalesce(_part(F.col("text"), numbered, 2), "text")))
    rows = rows.where(F.col("identifier").isNotNull() | F.col("said").rlike(OBLIGATION))
    quoted, pointed = r"`([^`]+)`\s*$", r"(?:^|\s)((?:[\w.-]+/)*[\w.-]+\.[a-z]{1,5})\s*$"
    reference = F.coalesce(_part(F.col("said"), quoted), _part(F.col("said"), pointed))
    end = F.when(F.col("said").rlike(quoted), F.lit(quoted)).otherwise(F.lit(pointed))
    statement = F.trim(F.regexp_replace(F.col("said"), end, F.lit("")))
    rows = rows.withColumn("reference", reference).withColumn("statement", F.when(reference.isNull(), F.col("said")).otherwise(statement)).where("statement <> ''")
    return rows.select("path", F.lit("doc.requirement").alias("name"), "line", _known(statement=F.col("statement"), identifier=F.col("identifier"), implementsRef=F.col("reference")).alias("attributes"))


def _command(raw: Column) -> Column:
    """A command without the brackets and quotes of its list form."""
    bare = F.regexp_replace(F.regexp_replace(raw, r'^\[\s*"?', ""), r'"?\s*\]$', "")
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(bare, '"', ""), r"\s+", " ")), 1, 120)


def dockerfile(files: DataFrame) -> DataFrame:
    """One marker an instruction (an ENV one a variable), and the stages of the file."""
    rows = lines(files).withColumn("text", F.trim("text")).where("text <> '' and text not like '#%'")
    word, rest = F.upper(_part(F.col("text"), r"^([A-Za-z]+)\b")), F.trim(_part(F.col("text"), r"^[A-Za-z]+\s+(.+)$"))
    rows = rows.withColumn("word", word).withColumn("rest", rest)
    image, stage = _part(F.col("rest"), r"^(?:--platform=\S+\s+)?(\S+)"), _part(F.col("rest"), r"(?i)\s+AS\s+(\S+)$")
    sources = F.array_join(F.expr(r"slice(split(trim(regexp_replace(rest, '--[a-z-]+=\\S+', '')), '\\s+'), 1, greatest(size(split(trim(regexp_replace(rest, '--[a-z-]+=\\S+', '')), '\\s+')) - 1, 0))"), ",")

    def when(words, name, **given):
        return F.when(F.col("word").isin(*words) & (F.col("rest").isNotNull() | F.lit("HEALTHCHECK" in words)), F.struct(F.lit(name).alias("name"), _known(**given).alias("attributes")))

    first = lambda c: F.substring_index(F.regexp_replace(c, r"\s+", " "), " ", 1)
    found = F.coalesce(
        when(["FROM"], "docker.base_image", image=image, stage=F.coalesce(stage, F.lit("default"))),
        when(["EXPOSE"], "docker.expose", ports=F.col("rest")),
        when(["WORKDIR"], "docker.workdir", path=first(F.col("rest"))),
        when(["USER"], "docker.user", user=first(F.col("rest")), configured=F.lit("true")),
        when(["ENTRYPOINT"], "docker.entrypoint", value=_command(F.col("rest"))),
        when(["CMD"], "docker.cmd", value=_command(F.col("rest"))),
        when(["VOLUME"], "docker.volume", paths=F.col("rest")),
        when(["HEALTHCHECK"], "docker.healthcheck", configured=F.lit("true")),
        when(["COPY", "ADD"], "docker.copy", instruction=F.col("word"), sources=sources),
        when(["RUN"], "docker.run", present=F.lit("true")),
    )
    pairs = F.regexp_extract_all("rest", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)=(?:\"[^\"]*\"|'[^']*'|\S*)"), F.lit(1))
    names = F.when(F.size(pairs) > 0, pairs).otherwise(F.array(first(F.col("rest"))))
    env = F.transform(names, lambda v: F.struct(F.lit("docker.env").alias("name"), _known(variable=v, secretLike=v.rlike(CREDENTIAL)).alias("attributes")))
    # lines are read once for all instructions, and once more for the stages
    each = rows.select("path", "line", F.explode(F.when(F.col("word") == "ENV", F.when(F.col("rest").isNotNull(), env)).otherwise(F.array(found))).alias("m"))
    single = each.where("m is not null").select("path", "m.name", "line", "m.attributes")
    bases = rows.where("word = 'FROM' and rest is not null").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", F.coalesce(stage, F.lit("default")).alias("stage")))).alias("s"))
    stages = bases.select("path", F.lit("docker.build_stage").alias("name"), F.lit(1).alias("line"), _known(stageCount=F.size("s"), stages=F.array_join("s.stage", ",")).alias("attributes"))
    return single.unionByName(stages)


# The sections of a manifest, and its fields that name an entry point.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
ENTRY_POINTS = ("main", "module", "types", "browser", "bin")


def manifest(files: DataFrame) -> DataFrame:
    """The name, dependencies, scripts, entry points and workspaces of package manifests; comments are allowed."""
    maps = ", ".join(f"{s} map<string,string>" for s in (*SECTIONS, "scripts"))
    schema = f"name string, version string, {maps}, {', '.join(f'{f} string' for f in ENTRY_POINTS)}, workspaces array<string>"
    rows = files.select("path", "text", F.from_json("text", schema, {"allowComments": "true"}).alias("j")).where("j is not null")

    def line_of(key: Column) -> Column:
        head = F.split_part(F.col("text"), F.concat(F.lit('"'), key, F.lit('"')), F.lit(1))
        return F.when(head == F.col("text"), 1).otherwise(F.size(F.split(head, "\n"))).cast("int")

    def marker(rows, kind, key, **given):
        return rows.select("path", F.lit(kind).alias("name"), line_of(key).alias("line"), _known(**given).alias("attributes"))

    out = marker(rows.where("j.name is not null"), "manifest.name", F.lit("name"), name=F.col("j.name"), version=F.col("j.version"))
    for s in SECTIONS:
        each = rows.select("path", "text", F.explode(f"j.{s}").alias("key", "value"))
        out = out.unionByName(marker(each, "manifest.dependency", F.col("key"), dependency=F.col("key"), section=F.lit(s), range=F.col("value")))
    each = rows.select("path", "text", F.explode("j.scripts").alias("key", "value"))
    out = out.unionByName(marker(each, "manifest.script", F.col("key"), script=F.col("key"), command=F.col("value")))
    for f in ENTRY_POINTS:
        out = out.unionByName(marker(rows.where(f"j.{f} is not null"), "manifest.entrypoint", F.lit(f), field=F.lit(f), value=F.col(f"j.{f}")))
    return out.unionByName(marker(rows.where("j.workspaces is not null"), "manifest.workspaces", F.lit("workspaces"), patterns=F.array_join("j.workspaces", ",")))


# -- nested files, a text at a time

Marker = tuple[str, int, dict]


def _applied(files: DataFrame, read: Callable[[str], Iterator[Marker]]) -> DataFrame:
    def work(batches):
        kind = pa.map_(pa.string(), pa.string())
        for batch in batches:
            rows = [(p, *m) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist(), strict=True) for m in read(t or "")]
            maps = [[(k, str(v)) for k, v in r[3].items() if v is not None] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array(maps, kind)], ["path", "name", "line", "attributes"])

    return files.select("path", "text").mapInArrow(work, MARKERS)


_KEY = re.compile(r"""(?P<dash>(?:-\s+)*)(?:(?P<key>"[^"]*"|'[^']*'|[^\s:#"'\[{][^:#]*?)\s*:(?:\s+(?P<value>.*))?|(?P<item>.+))$""")


_COMMENT = re.compile(r"(^|\s)#.*$")
#: Values after which a block text follows.
_BLOCKS = {"|", "|+", "|-", ">", ">+", ">-"}


def yaml_rows(text: str) -> Iterator[tuple[int, tuple[str, ...], str]]:
    """(line, path, value) of every key and list item of block YAML; items have numbers in their paths, as ``[0]``.

    Comments go; quotes around a value go; a value in brackets becomes its items; a block text is one value.
    """
    stack: list[tuple[int, str]] = []
    counts: dict[tuple, int] = {}
    block: tuple[int, int, tuple] | None = None
    held: list[str] = []
    for number, raw in enumerate([*text.splitlines(), None], 1):
        line = "" if raw is None else raw.rstrip()
        indent = len(line) - len(line.lstrip())
        if block and raw is not None and (not line or indent > block[0]):
            held.append(line.strip())
            continue
        if block:
            yield block[1], block[2], " ".join(x for x in held if x)
            block, held = None, []
        body = line.strip()
        if not body or body.startswith(("#", "---", "...")):
            continue
        m = _KEY.match(body)
        if not m:
            continue
        dash, said, given, item = m.groups()
        at, dashes = indent, (dash.count("-") if dash else 0) + (body == "-")
        while stack and stack[-1][0] >= at and not (dashes and stack[-1][0] == at and not stack[-1][1].startswith("[")):
            stack.pop()
        for _ in range(dashes):
            above = tuple(k for _, k in stack)
            place = counts[above] = counts.get(above, -1) + 1
            stack.append((at, f"[{place}]"))
            at += 2
        path = tuple(k for _, k in stack)
        if said is None or body == "-":
            if body != "-":
                yield number, path, _scalar(item)
            continue
        key, value = _scalar(said), (_COMMENT.sub("", given) if given and "#" in given else given or "").strip()
        path = (*path, key)
        stack.append((at, key))
        if counts:
            for gone in [k for k in counts if k[: len(path)] == path]:
                del counts[gone]
        if value in _BLOCKS:
            block = (at, number, path)
        elif value.startswith("[") and value.endswith("]"):
            yield number, path, ""
            for k, item in enumerate(x for x in re.split(r",\s*", value[1:-1]) if x.strip()):
                yield number, (*path, f"[{k}]"), _scalar(item)
        else:
            yield number, path, _scalar(value)


def _scalar(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def keys_of(text: str) -> Iterator[Marker]:
    for number, path, value in yaml_rows(text):
        if len(path) <= 2 and not path[-1].startswith("["):
            yield "config.key", number, {"key": ".".join(path), "hasValue": str(bool(value)).lower()}


def config_keys(files: DataFrame) -> DataFrame:
    """The keys of the first two levels of YAML files."""
    return _applied(files, keys_of)


def _named_variable(path: tuple, value: str) -> str | None:
    """The variable of an ``environment`` entry, in either form."""
    return re.split(r"[=:]", value, maxsplit=1)[0].strip() if path[-1].startswith("[") else path[-1]


def compose_of(text: str) -> Iterator[Marker]:
    rows = list(yaml_rows(text))
    networks = {p[1] for _, p, _ in rows if p[0] == "networks" and len(p) == 2}
    by: dict[str, list] = {}
    for row in rows:
        if row[1][0] == "services" and len(row[1]) > 1:
            by.setdefault(row[1][1], []).append((row[0], row[1][2:], row[2]))
    for service, own in by.items():
        yield from _service(service, own, networks)
    for number, p, _ in rows:
        if p[0] in ("networks", "volumes") and len(p) == 2:
            yield f"compose.{p[0][:-1]}_declared", number, {p[0][:-1]: p[1]}


def _service(service: str, own: list[tuple[int, tuple, str]], networks: set[str]) -> Iterator[Marker]:
    """What a service declares: (line, path in the service, value) rows."""
    first, base = own[0][0], {"service": service}
    scalar = {p: v for _, p, v in own if v}
    listed = lambda *at: [(n, p, v) for n, p, v in own if p[:-1] == at]
    items = lambda *at: " ".join(v for _, _, v in listed(*at) if v)
    ports = [_port(v) for _, _, v in listed("ports") if v]
    ports = [p for p in ports if re.fullmatch(r"\d+(-\d+)?", p["containerPort"])]
    numbers = sorted({int(p["containerPort"]) for p in ports if p["containerPort"].isdigit()})
    yield "compose.service", first, base | {"image": scalar.get(("image",)), "build": scalar.get(("build",)) or scalar.get(("build", "context")), "publishedPorts": ",".join(map(str, numbers)), "buildFile": scalar.get(("build", "dockerfile"))}
    for n, _, v in listed("ports"):
        port = _port(v) if v else None
        if port and port in ports:
            ports.remove(port)
            yield "compose.port_publish", n, base | port
    for field, most in (("command", 200), ("entrypoint", 200)):
        line = next((n for n, p, _ in own if p == (field,)), first)
        if said := (items(field) or scalar.get((field,)) or "").strip():
            yield f"compose.{field}", line, base | {"value": " ".join(said.split())[:most]}
    for n, p, v in listed("depends_on"):
        yield "compose.depends_on", n, base | {"dependsOn": v if p[-1].startswith("[") else p[-1]}
    for n, p, v in listed("networks"):
        name = v if p[-1].startswith("[") else p[-1]
        if name in networks:
            yield "compose.network", n, base | {"network": name}
    for n, p, v in listed("environment"):
        if name := _named_variable(p, v):
            yield "compose.environment", n, base | {"variable": name}
            content = v.partition("=")[2] if p[-1].startswith("[") else v
            m = re.search(r"https?://([A-Za-z0-9][A-Za-z0-9_.-]*)(?::(\d+))?(?=[/\s?#]|$)", content)
            if m and "@" not in content[m.start() :] and m[1] != "localhost" and not re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m[1]):
                yield "compose.service_address", n, base | {"target": m[1], "variable": name, "port": m[2] or ""}
    for n, p, v in listed("volumes"):
        short = re.fullmatch(r"([^:]+)(?::([^:]+))?(?::(\w+))?", v or "")
        source, target, mode = short.groups() if short else (scalar.get(("volumes", p[-1], "source")), scalar.get(("volumes", p[-1], "target")), "ro" if scalar.get(("volumes", p[-1], "read_only")) == "true" else None)
        if source and (target or not short):
            named = re.fullmatch(r"[A-Za-z0-9_.-]+", source)
            yield "compose.volume_mount", n, base | {"volume": source if named else f"(bind) {source}", "target": target, "readOnly": "true" if mode == "ro" else None, "source": None if named else source}
    if any(p == ("healthcheck",) for _, p, _ in own):
        yield "compose.healthcheck", first, base | _healthcheck([v for _, _, v in listed("healthcheck", "test")] or [x for x in [scalar.get(("healthcheck", "test"))] if x])
    if ("restart",) in scalar:
        yield "compose.restart_policy", next(n for n, p, _ in own if p == ("restart",)), base | {"restart": scalar["restart",]}


def _healthcheck(parts: list[str]) -> dict:
    """How a check is made, its command and the path that it asks; never the host."""
    if not parts or parts[0] == "NONE":
        return {"kind": parts[0] if parts else "unknown"}
    command = " ".join(parts[1:])[:200]
    url = re.search(r"https?://[^\s\"'`)]+", command)
    path = re.split(r"[?#]", re.sub(r"(?i)^https?://[^/]+", "", url[0]))[0][:120] or "/" if url else None
    return {"kind": parts[0] if parts[0] in ("CMD", "CMD-SHELL") else "none", "command": command or None, "endpoint": path}


def _port(value: str) -> dict:
    """A published port in any of its three spellings: what the container has, what the host has, on which address."""
    value, _, protocol = value.partition("/")
    parts = value.rsplit(":", 2)
    host = parts[-2] if len(parts) > 1 and re.fullmatch(r"\d+(-\d+)?", parts[-2]) else None
    return {"containerPort": parts[-1], "hostPort": host, "hostIp": parts[0] if len(parts) == 3 else None, "protocol": protocol or None}


def compose(files: DataFrame) -> DataFrame:
    """Services, what they publish, need, join, mount and are told by name."""
    return _applied(files, compose_of)


# Words by which a step names what it does.
_DOES = {"namesDeployment": r"(?i)deploy|publish|release|push.*image|kubectl|helm", "namesBuild": r"(?i)build|compile|bundle", "namesTest": r"(?i)test|vitest|jest|pytest|spec"}


def workflow_of(text: str) -> Iterator[Marker]:
    rows = [r for r in yaml_rows(text) if r[1][0] == "jobs" and len(r[1]) > 1]
    for job in dict.fromkeys(p[1] for _, p, _ in rows):
        mine = [r for r in rows if r[1][1] == job]
        runs_on = next((v for _, p, v in mine if p[2:] == ("runs-on",)), None)
        steps = dict.fromkeys(p[3] for _, p, _ in mine if len(p) > 3 and p[2] == "steps")
        yield "workflow.job", mine[0][0], {"job": job, "runsOn": runs_on[:80] if runs_on else None, "stepCount": len(steps)}
        for step in steps:
            own = {p[4]: (n, v) for n, p, v in mine if len(p) == 5 and p[2:4] == ("steps", step)}
            number = min((n for n, _ in own.values()), default=mine[0][0])
            name, uses, run = (own.get(k, (0, None))[1] for k in ("name", "uses", "run"))
            said = " ".join(x for x in (name, uses, run) if x)
            does = {k: str(bool(re.search(shape, said))).lower() for k, shape in _DOES.items()}
            yield "workflow.step", number, {"job": job, "step": name, "uses": uses[:120] if uses else None, "run": " ".join(run.split())[:160] if run else None, **does}
        last = len(text.splitlines()) + 1
        start = mine[0][0]
        end = min((n for n, p, _ in rows if n > start and p[1] != job and len(p) == 2), default=last)
        for k, raw in enumerate(text.splitlines()[start - 1 : end - 1]):
            for variable in dict.fromkeys(re.findall(r"secrets\.([A-Za-z_][A-Za-z0-9_]*)", raw)):
                yield "workflow.secret", start + k, {"job": job, "variable": variable}


def workflow(files: DataFrame) -> DataFrame:
    """Jobs, their steps with what these name, and the secrets that they refer to by name."""
    return _applied(files, workflow_of)


_NAME = r"""["'`\[]?([A-Za-z_][\w.]*)["'`\]]?"""
_CREATE = re.compile(rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*\(", re.I)
_ALTER = re.compile(rf"ALTER\s+TABLE\s+(?:ONLY\s+)?{_NAME}\s+ADD\s+(?:CONSTRAINT\s+\S+\s+)?FOREIGN\s+KEY\s*\(([^)]*)\)\s*REFERENCES\s+{_NAME}(?:\s*\(\s*{_NAME}\s*\))?", re.I)
_REFERS = re.compile(rf"\bREFERENCES\s+{_NAME}(?:\s*\(\s*{_NAME}\s*\))?", re.I)
_TYPE_END = re.compile(r"\b(?:NOT\s+NULL|NULL|DEFAULT|PRIMARY|UNIQUE|REFERENCES|CHECK|CONSTRAINT|COLLATE|GENERATED)\b", re.I)


def _pieces(text: str, start: int) -> tuple[list[str], int]:
    """The comma parts of a parenthesis that opens before ``start``, and the place behind it; (what there is, -1) if it never closes."""
    out, depth, held, quote = [], 1, start, ""
    for k in range(start, len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*out, text[held:k]], k + 1
        elif c == "," and depth == 1:
            out.append(text[held:k])
            held = k + 1
    return out, -1


def _names(text: str) -> list[str]:
    m = re.search(r"\(([^)]*)\)", text)
    return re.findall(r"[A-Za-z_]\w*", m[1]) if m else []


def ddl_of(text: str) -> Iterator[Marker]:
    text = re.sub(r"--[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    for m in _CREATE.finditer(text):
        parts, end = _pieces(text, m.end())
        if end < 0:
            continue
        table, line, keys, columns = m[1], text.count("\n", 0, m.start()) + 1, [], []
        for part in map(str.strip, parts):
            word = part.split(None, 1)[0].upper() if part else ""
            constraint = re.sub(r"(?i)^CONSTRAINT\s+\S+\s+", "", part)
            refers = _REFERS.search(part)
            if re.match(r"(?i)PRIMARY\s+KEY\b", constraint):
                keys += _names(constraint)
            elif re.match(r"(?i)FOREIGN\s+KEY\b", constraint):
                for name in _names(constraint) if refers else []:
                    yield "schema.foreign_key", line, {"table": table, "column": name, "referencesTable": refers[1], "referencesColumn": refers[2]}
            elif part and word not in ("UNIQUE", "KEY", "INDEX", "CONSTRAINT", "CHECK", "EXCLUDE"):
                named = re.match(r"""["'`\[]?([A-Za-z_]\w*)["'`\]]?\s*(.*)$""", part, re.S)
                if named:
                    columns.append((named[1], named[2], refers))
                    if refers:
                        yield "schema.foreign_key", line, {"table": table, "column": named[1], "referencesTable": refers[1], "referencesColumn": refers[2]}
        own_keys = [name for name, body, _ in columns if re.search(r"(?i)\bPRIMARY\s+KEY\b", body)]
        yield "schema.table", line, {"table": table, "columnCount": len(columns), "primaryKey": ",".join(dict.fromkeys([*keys, *own_keys]))}
        for name, body, refers in columns:
            primary = name in keys or name in own_keys
            kind = re.sub(r"\s*\([^)]*\)", "", _TYPE_END.split(body, maxsplit=1)[0]).strip()
            flags = {"primaryKey": primary, "notNull": primary or bool(re.search(r"(?i)\bNOT\s+NULL\b", body)), "unique": bool(re.search(r"(?i)\bUNIQUE\b", body))}
            yield "schema.column", line, {"table": table, "column": name, "dataType": kind or None, **{k: str(v).lower() for k, v in flags.items()}, "referencesTable": refers[1] if refers else None}
    for m in _ALTER.finditer(text):
        for name in re.findall(r"[A-Za-z_]\w*", m[2]):
            yield "schema.foreign_key", text.count("\n", 0, m.start()) + 1, {"table": m[1], "column": name, "referencesTable": m[3], "referencesColumn": m[4]}


def ddl(files: DataFrame) -> DataFrame:
    """Tables with their primary keys, columns with their types and constraints, and foreign keys of all three forms."""
    return _applied(files, ddl_of)


def without_comments(text: str) -> str:
    """JSON without comments; what stands in strings stays."""
    return re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)


def capped(markers: DataFrame, most: int = 5000) -> DataFrame:
    """The first ``most`` markers of each file, with ``n_dropped`` of its others."""
    place = F.row_number().over(Window.partitionBy("path").orderBy("line", "name"))
    total = F.count(F.lit(1)).over(Window.partitionBy("path"))
    return markers.withColumn("k", place).withColumn("n_dropped", F.greatest(total - most, F.lit(0))).where(F.col("k") <= most).drop("k")
