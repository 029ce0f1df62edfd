"""Ids and confidence: every join of the graph rests on these expressions."""

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Confidence levels from weakest (rank 0) to strongest, spelt as stored.
CONFIDENCE = ("UNKNOWN", "WEEKLY_INFERRED", "STRONGLY_INFERRED", "EXPLICIT")


def rank(confidence: Column) -> Column:
    """0 to 3; what isn't a level is UNKNOWN."""
    return F.greatest(F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.coalesce(confidence, F.lit(""))) - 1, F.lit(0)).cast("int")


def level(ranked: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), ranked + 1)


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str]:
    """(JSON of the characters whose NFKC form has one that slugs keep, a pattern of ASCII letters that marks turn into others).

    All else that isn't ASCII becomes a hyphen, in whatever form.
    """
    kept = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._/-")
    forms = {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x20000))):
        form = unicodedata.normalize("NFKC", c)
        if form != c and not kept.isdisjoint(form):
            forms[c] = form
    marks = {m: "".join(x for x in map(chr, range(65, 123)) if x.isalpha() and len(unicodedata.normalize("NFKC", x + m)) == 1) for m in map(chr, range(0x300, 0x370))}
    return json.dumps(forms), "|".join(f"[{letters}]{m}" for m, letters in marks.items() if letters)


def _ascii_by_nfkc(name: Column) -> Column:
    """A name whose characters outside ASCII are those of its NFKC form as far as slugs can tell."""
    forms, composed = _compatible()
    known = F.from_json(F.lit(forms), "map<string,string>")
    out = F.array_join(F.transform(F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(known[c], c)), "")
    return F.regexp_replace(out, composed, "\u00e9")


def slug(name: Column) -> Column:
    """NFKC; runs of anything outside ``A-Za-z0-9._/-`` become one hyphen; ends are trimmed; lower case."""
    out = F.when(name.rlike(r"[^\x00-\x7F]"), _ascii_by_nfkc(name)).otherwise(name)
    for pattern, new in (("[^A-Za-z0-9._/-]+", "-"), ("-{2,}", "-"), ("/{2,}", "/"), ("^[-.]+|[-.]+$", ""), ("^/+|/+$", "")):
        out = F.regexp_replace(out, pattern, new)
    return F.lower(out)


def node_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), slug(name.cast("string")))


def edge_id(src: Column, kind: Column, dst: Column) -> Column:
    return F.concat_ws("|", src, kind, dst)


def evidence_id(path: Column, kind: Column, line: Column, producer: Column) -> Column:
    return F.concat(F.lit("ev_"), F.substring(F.sha2(F.concat_ws(":", path, kind, line.cast("string"), producer), 256), 1, 16))


def stable_json(given: Column) -> Column:
    """A map of text as JSON whose keys are in order, so that equal maps give equal texts; null for null."""
    entries = F.transform(F.array_sort(F.map_entries(given)), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), F.coalesce(_quoted(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.when(text.isNotNull(), F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1))
