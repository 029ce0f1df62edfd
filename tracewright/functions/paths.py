"""Paths as column expressions: POSIX form, names, normalisation, ancestors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The endings that a module's name goes without; where several fit the longest is meant.
ENDINGS = (".d.ts", ".d.mts", ".d.cts", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyi", ".json", ".jsonc", ".yaml", ".yml", ".toml", ".md", ".mdx", ".sql", ".css", ".scss", ".html", ".sh", ".xml", ".ini")


def posix(path: Column) -> Column:
    """Backslashes turned, a leading ``./`` dropped."""
    return F.regexp_replace(F.regexp_replace(path, r"\\+", "/"), r"^(\./)+", "")


def module_name(path: Column) -> Column:
    any_of = "|".join(e.replace(".", r"\.") for e in sorted(ENDINGS, key=len, reverse=True))
    return F.regexp_replace(path, f"(?:{any_of})$", "")


def folder(path: Column) -> Column:
    """What stands before the last slash; empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def normalised(path: Column) -> Column:
    """The path without ``.`` and ``..``; null where it leaves its root."""
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("inside"))

    def step(state, part):
        up = F.struct(F.slice(state["at"], 1, F.greatest(F.size(state["at"]) - 1, F.lit(0))).alias("at"), (state["inside"] & (F.size(state["at"]) > 0)).alias("inside"))
        down = F.struct(F.concat(state["at"], F.array(part)).alias("at"), state["inside"].alias("inside"))
        return F.when((part == "") | (part == "."), state).when(part == "..", up).otherwise(down)

    return F.aggregate(F.split(path, "/"), start, step, lambda s: F.when(s["inside"], F.array_join(s["at"], "/")))


def ancestors(path: Column) -> Column:
    """Every folder above a path, the root (empty) first."""
    parts = F.split(path, "/")
    inner = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    return F.when(F.size(parts) > 1, F.concat(F.array(F.lit("")), inner)).otherwise(F.array(F.lit("")))
