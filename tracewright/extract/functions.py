"""The readers as table functions of SQL, and which reader a file goes to.

``register(spark)`` makes ``sql_access(text)``, ``code_facts(path, language, text)`` and
``config_markers(path, text)`` known to a session, for ``LATERAL`` joins. A reader says by ``supports`` which
files are its own; the first that does reads a file.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tracewright.extract import code, config
from tracewright.extract.sql_access import analyse


@dataclass(frozen=True)
class Reader:
    """A reader of files: its name, which it supports, and (fact or marker, line, fields) of a text."""

    producer: str
    supports: Callable[[str, str], bool]
    read: Callable[[str, str, str], Iterator[tuple[str, int, dict]]]


def _named(path: str) -> str:
    return path.rsplit("/", 1)[-1]


# Which files hold configuration of which kind.
READERS = [
    Reader("code", lambda path, language: language in code.READERS, lambda path, language, text: code.read(text, language, path)),
    Reader("compose", lambda path, _: _named(path).startswith(("docker-compose", "compose.")) and path.endswith((".yml", ".yaml")), lambda path, _, text: config.compose_of(text)),
    Reader("workflow", lambda path, _: ".github/workflows/" in path and path.endswith((".yml", ".yaml")), lambda path, _, text: config.workflow_of(text)),
    Reader("ddl", lambda path, language: language == "sql" or path.endswith(".sql"), lambda path, _, text: config.ddl_of(text)),
    Reader("yaml", lambda path, language: language == "yaml" or path.endswith((".yml", ".yaml")), lambda path, _, text: config.keys_of(text)),
]


def reader_of(path: str, language: str) -> Reader | None:
    return next((r for r in READERS if r.supports(path, language)), None)


def _text(fields: dict) -> dict[str, str]:
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in fields.items() if v is not None}


@udtf(returnType="statement string, operation string, n_statements int, reason string, table string, access string, role string")
class SqlAccess:
    """Tables that a text accesses as SQL; a row with a null table where it names none, none where it isn't SQL."""

    def eval(self, text: str):
        if s := analyse(text):
            for table in s.tables or [(None, None, None)]:
                yield s.statement, s.operation, s.count, s.reason, *table


@udtf(returnType="fact string, line int, at int, fields map<string,string>")
class CodeFacts:
    """Facts of a source file."""

    def eval(self, path: str, language: str, text: str):
        if language in code.READERS and text is not None:
            for at, (fact, line, fields) in enumerate(code.read(text, language, path or "")):
                yield fact, line, at, _text(fields)


@udtf(returnType="producer string, name string, line int, attributes map<string,string>")
class ConfigMarkers:
    """Markers of a configuration or schema file, by the reader that supports its path."""

    def eval(self, path: str, text: str):
        reader = reader_of(path or "", "")
        if reader and text is not None:
            for name, line, fields in reader.read(path, "", text):
                yield reader.producer, name, line, _text(fields)


def register(spark: SparkSession) -> None:
    for name, function in (("sql_access", SqlAccess), ("code_facts", CodeFacts), ("config_markers", ConfigMarkers)):
        spark.udtf.register(name, function)
