"""Language identification by rank-order profiles.

A language's profile is the order of its most frequent letter n-grams (one to
three letters, words padded by a boundary) over all labelled training texts. A
document is compared to each profile by out-of-place distance: the sum, over
its own most frequent n-grams, of how far each stands from its place in the
profile (``PROFILE`` places if it isn't there).

Training reads every training text whole; workers count ``HELD`` n-grams at a
time and emit (language, n-gram, count), which Spark sums with map-side combine; the top
``PROFILE`` per language come back to the driver (languages x 300 rows) and are
broadcast. Prediction handles each row alone.

Defined results: null text, or text without a letter, gives ``und`` with score
0; ties between languages go to the first by name, ties between n-grams to the
smaller code; rows with null language don't teach; with no training rows every
prediction is ``und``; repeated rows give equal results; an empty table gives
an empty result.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_mod, table

PROFILE = 300
FOLDS, HELD_OUT = 3, 1
#: N-grams that a worker holds before it counts them (8 bytes each, and as many again to sort), but for one text's.
HELD = 4 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str) -> np.ndarray:
    """The codes (21 bits a letter, 0 the boundary) of all n-grams of a text, with repeats."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    letter = _letters()[codes]
    if not letter.any():
        return codes[:0]
    codes = np.where(letter, codes, 0)
    codes = np.concatenate([[np.uint64(0)], codes[letter | np.append(letter[1:], False) | np.append(False, letter[:-1])], [np.uint64(0)]])
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
    b = np.uint64(21)
    two = codes[:-1] << b | codes[1:]
    three = two[:-1] << b | codes[2:]
    # a word's own: no n-gram reaches over a boundary
    return np.concatenate([codes[codes != 0], two, three[codes[1:-1] != 0]])


def top(codes: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The n most frequent codes, most frequent first, ties by code."""
    codes = np.sort(codes)
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    counts = np.diff(np.append(starts, len(codes)))
    if len(starts) > n:
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        starts, counts = starts[counts >= least], counts[counts >= least]
    return codes[starts[np.argsort(-counts, kind="stable")[:n]]]


def _totals(parts: dict[str, list[np.ndarray]]):
    for lang in sorted(parts):
        codes, counts = np.unique(np.concatenate(parts[lang]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "code", "n"])


def _count(batches):
    parts: dict[str, list[np.ndarray]] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            codes = ngrams(text.as_py())
            parts.setdefault(lang.as_py(), []).append(codes)
            held += len(codes)
            if held >= HELD:
                yield from _totals(parts)
                parts, held = {}, 0
    yield from _totals(parts)


def train(labelled: DataFrame) -> dict[str, list[int]]:
    """The profiles learned from rows (lang, text): codes by rank."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(_count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():  # PROFILE rows a language
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Ranks:
    """All profiles side by side: the known codes, sorted, and each one's place per language."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.names = sorted(profiles)
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.uint64))
        self.places = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.places[np.searchsorted(self.codes, np.array(profiles[name], np.uint64)), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ngrams(text) if text else None
        if codes is None or not len(codes) or not self.names:
            return "und", 0.0
        own = top(codes)
        at = np.searchsorted(self.codes, own)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == own
        places = self.places[np.where(known, at, len(self.codes))]
        away = np.abs(places - np.arange(len(own))[:, None])
        away[places < 0] = PROFILE
        distance = np.minimum(away, PROFILE).sum(0) / (PROFILE * len(own))
        best = int(np.argmin(distance))
        return self.names[best], round(1.0 - float(distance[best]), 6)


def predict(df: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """``df`` with lang_pred and score (1 less the out-of-place distance over its largest value); columns of these names are replaced."""
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL("lang_pred string, score double")
    df = df.drop(*extra.names)
    ranks = Ranks(profiles)

    def work(batches):
        for batch in batches:
            got = [ranks.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names, *extra.names])

    return df.mapInArrow(work, StructType([*df.schema.fields, *extra.fields]))


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT
    profiles = train(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return predict(rows, profiles).drop("text")
