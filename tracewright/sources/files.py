"""Files of a repository: what is read, what is skipped and why.

The listing is Spark's own binary-file source, so a folder may be in any store that
Spark reads; every decision is a column expression. Budgets are a running sum in the
order of paths. Content is asked for last, of files that are still in question.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.order import by_folder, placed
from tracewright.operators.graph import running_total

# Languages by extension and by name; folders and files that are left out; binary files.
LANGUAGES = {
    "typescript": ".ts .mts .cts .tsx", "javascript": ".js .mjs .cjs .jsx", "python": ".py .pyi", "go": ".go", "java": ".java", "csharp": ".cs", "ruby": ".rb", "php": ".php", "rust": ".rs", "sql": ".sql",
    "yaml": ".yml .yaml", "json": ".json .jsonc", "toml": ".toml", "markdown": ".md .markdown .mdx", "dockerfile": ".dockerfile", "graphql": ".graphql .gql", "proto": ".proto", "shell": ".sh .bash",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "gemfile": "ruby", "rakefile": "ruby"}
FOLDERS = (
    ".git .hg .svn .bzr node_modules bower_components vendor third_party .venv venv env __pycache__ .mypy_cache .pytest_cache .ruff_cache .tox dist build out target bin obj .next .nuxt .svelte-kit .turbo .cache "
    ".parcel-cache .gradle .idea .vscode-test coverage htmlcov .nyc_output .terraform Pods DerivedData site-packages .serverless .aws-sam"
).split()
LOCKS = "package-lock.json yarn.lock pnpm-lock.yaml bun.lock bun.lockb poetry.lock Pipfile.lock Cargo.lock composer.lock Gemfile.lock go.sum".split()
ENDINGS = (
    ".min.js .min.css .map .snap .snap.new .pyc .pyo .o .obj .class .jar .wasm .exe .dll .so .dylib .zip .tar .tgz .gz .rar .7z .pdf .png .jpg .jpeg .gif .webp .ico .mp3 .mp4 .mov .woff .woff2 .ttf .eot .wav .sqlite .sqlite3 .db"
).split()
BINARY = (
    ".png .jpg .jpeg .gif .bmp .ico .webp .tiff .avif .pdf .zip .tar .gz .tgz .bz2 .xz .zst .7z .rar .exe .dll .so .dylib .class .jar .war .wasm .pyc .pyo .o .obj .a .lib .bin .dat .db .sqlite .sqlite3 "
    ".mp3 .mp4 .wav .flac .ogg .avi .mov .mkv .webm .woff .woff2 .ttf .otf .eot"
).split()
GENERATED = {
    r"(^|/)(dist|build|out|lib-esm|esm|cjs)/": "build output directory", r"\.d\.ts$": "declaration file", r"\.generated\.[a-z]+$": "generated file suffix", r"(^|/)generated/": "generated directory",
    r"_pb2\.py$": "protobuf output", r"\.pb\.go$": "protobuf output", r"\.g\.dart$": "generated dart output", r"(^|/)__generated__/": "generated directory",
}
MOST_FILES, MOST_BYTES, MOST_FILE_BYTES, SNIFFED = 20_000, 512 << 20, 1 << 20, 8192


def _any(words) -> str:
    return "|".join(re.escape(w) for w in words)


def language(path: Column) -> Column:
    """By the name of the file, then by its extension; ``unknown`` otherwise."""
    name = F.lower(F.substring_index(path, "/", -1))
    ending = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    by_name = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[name]
    docker = F.when(name.startswith("dockerfile") | name.endswith(".dockerfile"), "dockerfile")
    by_ending = F.create_map(*[F.lit(x) for lang, ends in LANGUAGES.items() for e in ends.split() for x in (e, lang)])[ending]
    return F.coalesce(by_name, docker, by_ending, F.lit("unknown"))


def excluded_folder(path: Column) -> Column:
    """The first folder of the path that is never entered; null where there is none."""
    return F.nullif(F.regexp_extract(path, rf"^((?:[^/]+/)*?(?:{_any(FOLDERS)}))/", 1), F.lit(""))


def excluded_file(path: Column) -> Column:
    return path.rlike(rf"(^|/)(?:{_any(LOCKS)})$|(?:{_any(ENDINGS)})$")


def binary_name(path: Column) -> Column:
    return F.lower(path).rlike(rf"(?:{_any(BINARY)})$")


def generated(path: Column) -> Column:
    """Why a file counts as generated; null if it doesn't."""
    return F.coalesce(*(F.when(path.rlike(shape), reason) for shape, reason in GENERATED.items()))


def binary_content(content: Column) -> Column:
    """A NUL, or more than three tenths of bytes that no text has, in the first bytes."""
    head = F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")
    odd = F.length(F.regexp_replace(head, r"[\x20-\x7e\t\n\r\f\x1b]", ""))
    return head.contains("\x00") | (odd > 0.3 * F.length(head))


def inside(path: Column) -> Column:
    """Whether a path stays below its root: relative, without a NUL, never above its start."""
    from tracewright.functions.paths import normalised

    return ~(path.startswith("/") | path.contains("\x00") | path.rlike(r"^[A-Za-z]:") | path.contains("\\")) & normalised(path).isNotNull()


def ignore_pattern(line: str, folder: str = "") -> tuple[str, bool] | None:
    """(pattern over paths, whether it takes back) of a line of an ignore file in ``folder``; None for comments and blanks."""
    line = line.rstrip("\n")
    line = line if line.endswith("\\ ") else line.rstrip()
    if not line or line.startswith("#"):
        return None
    back, line = line.startswith("!"), line.removeprefix("!")
    only_folders, line = line.endswith("/"), line.rstrip("/")
    rooted = "/" in line
    out, k = "", 0
    line = line.removeprefix("/")
    while k < len(line):
        if line.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif line.startswith("/**", k) and k + 3 == len(line):
            out, k = out + "/.*", k + 3
        elif line[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif line[k] == "?":
            out, k = out + "[^/]", k + 1
        elif line[k] == "[" and "]" in line[k:]:
            end = line.index("]", k + 2 if line[k + 1 : k + 2] in "!]" else k + 1)
            out, k = out + "[" + line[k + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            k += line[k] == "\\" and k + 1 < len(line)
            out, k = out + re.escape(line[k]), k + 1
    start = re.escape(f"{folder}/") if folder else ""
    return f"^{start}{'' if rooted else '(?:.*/)?'}{out}{'/.+' if only_folders else '(?:/.+)?'}$", back


def ignored(path: Column, layers: dict[str, str]) -> Column:
    """Whether any layer (folder: text of its ignore file) leaves the path out; within a layer its last matching line says so."""
    out = F.lit(False)
    for folder, text in layers.items():
        layer = F.lit(False)
        for shape, back in filter(None, (ignore_pattern(line, folder) for line in text.splitlines())):
            layer = F.when(path.rlike(shape), F.lit(not back)).otherwise(layer)
        out = out | layer
    return out


def classified(files: DataFrame, layers: dict[str, str] | None = None) -> DataFrame:
    """Files (path, byte_size, content) with language, analyzable, skip_reason and listed; folders that are never entered are gone.

    Not listed are those that are skipped before their content is looked at.
    """
    path = F.col("path")
    rows = files.where(excluded_folder(path).isNull()).withColumn("language", language(path))
    early = F.when(~inside(path), "symlink_escape").when(ignored(path, layers or {}), "ignored_by_vcs").when(excluded_file(path) & ~binary_name(path), "ignored_by_default").when(F.col("byte_size") > MOST_FILE_BYTES, "too_large")
    late = F.when(binary_name(path) | binary_content(F.col("content")), "binary").when(F.col("language") == "unknown", "unsupported_extension")
    rows = rows.withColumn("listed", early.isNull()).withColumn("skip_reason", F.coalesce(early, late))
    return rows.withColumn("analyzable", F.col("skip_reason").isNull())


def budgeted(files: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES, width: int = 10_000) -> tuple[DataFrame, bool]:
    """(the listed files that fit, in the order of a sorted walk, whether any didn't): no file after the first that doesn't fit.

    ``place`` numbers the listed files in that order (``order.placed``: ranges, not a window over all rows).
    """
    listed = files.where("listed")
    listed = listed if "place" in listed.columns else placed(listed, by_folder(F.col("path")))
    rows = running_total(listed, "place", "byte_size", width).withColumnRenamed("total", "bytes")
    count = running_total(rows.withColumn("one", F.lit(1)), "place", "one", width).withColumnRenamed("total", "files")
    fits = (F.col("bytes") <= most_bytes) & (F.col("files") <= most_files)
    kept = count.where(fits)
    return kept, not count.where(~fits).isEmpty()


def read(spark: SparkSession, root: str, most_file_bytes: int = MOST_FILE_BYTES) -> DataFrame:
    """(path, byte_size, content) of all files below a folder, by paths relative to it.

    Content is null beyond ``most_file_bytes``: the size is a filter of the scan, so larger files are listed and not opened.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*").load(root)
    start = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{re.escape(start)}/", "")
    small = rows.where(F.col("length") <= most_file_bytes).select(relative.alias("path"), F.col("length").alias("byte_size"), "content")
    large = rows.where(F.col("length") > most_file_bytes).select(relative.alias("path"), F.col("length").alias("byte_size"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def scanned(files: DataFrame) -> DataFrame:
    """(skip_reason, n): how many files were skipped for which reason, and how many lie in folders that are never entered."""
    return files.groupBy(F.coalesce("skip_reason", F.lit("none")).alias("skip_reason")).agg(F.count(F.lit(1)).alias("n"))


LOG = "`git log --no-merges --name-only --no-renames --format=%x1e%H%x1f%h%x1f%an%x1f%ae%x1f%aI%x1f%s`"


def commits(exported: DataFrame) -> DataFrame:
    """Commits out of exported logs (column ``value``: a log or any part of one between records), records by U+001E and fields by U+001F (``LOG``)."""
    each = exported.select(F.explode(F.split("value", "\x1e")).alias("record")).where(F.trim("record") != "")
    head, names = F.split(F.substring_index("record", "\n", 1), "\x1f"), F.split(F.regexp_replace("record", r"^[^\n]*\n?", ""), "\n")
    fields = {n: head[k] for k, n in enumerate(("hash", "short_hash", "author_name", "author_email", "at", "subject"))}
    rows = each.where(F.size(head) >= 6).select(*(v.alias(k) for k, v in fields.items()), F.filter(F.transform(names, F.trim), lambda n: n != "").alias("files"))
    return rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("ts", F.try_to_timestamp("at"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Commits of the logs at a path: read record by record, so that one long log is many tasks."""
    return commits(spark.read.option("lineSep", "\x1e").text(path))


def contributors(rows: DataFrame) -> DataFrame:
    """How many people wrote the commits, by their addresses in lower case."""
    return rows.agg(F.countDistinct(F.lower("author_email")).alias("n"))
