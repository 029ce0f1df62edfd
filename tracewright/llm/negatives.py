"""Hard negatives: an exact search of inverted lists, best bounds first.

K-means centroids are fitted on a bounded sample; every row goes to the list of
its nearest centroid, and each list stores its centroid's radius (the largest
distance of a row). By Cauchy-Schwarz the score of an anchor a with any row of a
list with centroid c and radius r lies in a.c - |a| r to a.c + |a| r. Each anchor
visits lists from the highest upper bound on, in waves that grow WAVE-fold, skips
those outside its window of scores, and stops where the bound falls strictly below its
kth score. Nothing that could be in a result is left out, so the search is exact
whatever the centroids are; they only decide how much is visited.

A list is cut into blocks of about BLOCK rows and anchors into chunks of about
CHUNK, so that a list with a third of all rows is many tasks. A wave joins the blocks
that a chunk's anchors want with these anchors and multiplies the two matrices; each
anchor keeps its best k, and from wave to wave asks for no less than its kth score. Scores are
whole numbers: products run in the narrowest float kind that is exact for the vectors' norms, else
in longs. Chunks are sent to blocks a few at a time, packed in the narrowest whole numbers, and
best ones are told by a window that spills, so no task holds what all blocks found for a chunk.

Defined results:

* rows without an id or label, with a null vector or with a null, NaN or
  infinite component (or one of LARGEST and more, whose scores may not fit a long) take no part; nor do
  vectors of another length than the commonest (of equally common ones the longest);
* rows are told apart by vec_id: none is a positive or negative of a row with
  its own id. Repeated ids give one anchor (the least by label and vector), and as
  candidates each row counts;
* equal scores: the smaller vec_id first. Fewer positives or negatives than
  asked for: all. Without any, and for empty tables, no rows;
* extra columns are left out.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import matrices, stored, table

SCALE = 256
LARGEST = float(2**20)
#: Rows that centroids are fitted on at most (those of the smallest hashes of their ids), centroids at most, rounds.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 1024, 8
#: Rows whose distances to all centroids are held at once.
SLICE = 1024
#: Rows of a block and of a chunk of anchors, on average.
BLOCK, CHUNK = 8192, 256
#: Lists that an anchor visits in its first wave, and the factor from wave to wave.
FIRST, WAVE = 16, 8
#: Bytes of packed anchors that are handed on at once, about.
AT_ONCE = 8 << 20
POSITIVES, NEGATIVES = 5, 3
#: A negative scores from LEAST to MOST percent of its positive.
LEAST, MOST = 50, 95

_ROWS = "vec_id bigint, label bigint, x array<bigint>"


def usable(embeddings: DataFrame, label: Column) -> DataFrame:
    """vec_id, label and whole numbers ``x`` of the rows that take part, all of the commonest length."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine & (F.size("embedding") > 0))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (top["d"] if top else 0))


def sample_of(rows: DataFrame, n: int) -> DataFrame:
    """The SAMPLE rows of the smallest hashes of their ids, at rest.

    Of many rows only those with hashes in the part that holds some 2 * SAMPLE are ordered; and written, as a limit that is
    collected sends up to SAMPLE rows of each partition to the driver, the whole table where partitions are smaller.
    """
    least = F.xxhash64("vec_id")
    if n > 2 * SAMPLE:
        rows = rows.where(least < int(-(2**63) + 2**64 * 2 * SAMPLE // n))
    return stored(rows.orderBy(least, "vec_id", "x").limit(SAMPLE).select("x"), "sample")


def centroids_of(rows: DataFrame, n: int) -> np.ndarray:
    """K-means on a sample: a quarter of the square root of the number of rows in lists, at most MOST_LISTS, as chunks are sent to each list."""
    sample = sample_of(rows, n).toArrow().column("x").combine_chunks()
    x = sample.flatten().to_numpy().reshape(len(sample), -1).astype(float)
    k = int(min(MOST_LISTS, max(1, n**0.5 / 4), len(x)))
    found = x[np.random.default_rng(0).choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, found)
        sums = np.zeros_like(found)
        np.add.at(sums, own, x)
        count = np.bincount(own, minlength=k)[:, None]
        found = np.where(count, sums / np.maximum(count, 1), found)
    return found


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, by slices of rows: distances to all centroids are never held for all rows."""
    norms = (centroids**2).sum(axis=1)
    return np.concatenate([np.zeros(0, int), *((norms - 2 * x[k : k + SLICE] @ centroids.T).argmin(axis=1) for k in range(0, len(x), SLICE))])


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with the list that each belongs to, its distance to the centroid and its squared norm."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, x in matrices(batch, "x"):
                own = nearest(x.astype(float), centroids)
                away = np.sqrt(((x - centroids[own]) ** 2).sum(axis=1))
                added = {"list": pa.array(own.astype(np.int32)), "away": pa.array(away), "norm2": pa.array((x.astype(float) ** 2).sum(axis=1))}
                yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    return rows.mapInArrow(part, f"{_ROWS}, list int, away double, norm2 double")


def exact_kind(norm2: float) -> type:
    """The narrowest kind of number in which inner products of vectors up to this squared norm are exact."""
    return np.float32 if norm2 < 2**24 else np.float64 if norm2 < 2**53 else np.int64


def stored_kind(kind: type) -> type:
    """The narrowest kind of whole number for the entries of vectors whose products are exact in ``kind``."""
    return np.int16 if kind is np.float32 else np.int32


def packed(rows: pd.DataFrame, kind: type) -> bytes:
    return np.array(rows["x"].tolist(), stored_kind(kind)).tobytes()


def blocks_of(rows: DataFrame, parts: list[int], kind: type) -> DataFrame:
    """Rows in blocks: list, block, ids (ascending), labels, the matrix."""

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        ids, labels = (rows[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "label"))
        return pd.DataFrame({"list": [key[0]], "block": [key[1]], "ids": [ids], "labels": [labels], "data": [packed(rows, kind)]})

    n = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), n).cast("int"))
    return rows.groupBy("list", "block").applyInPandas(block, "list int, block int, ids binary, labels binary, data binary")


#: The state of an anchor: windows of scores (lowest, highest) and for each the best found, (score, vec_id) from the best on.
_STATE = "chunk int, anchor_id bigint, label bigint, x array<bigint>, lows array<bigint>, highs array<bigint>, scores array<array<bigint>>, found array<array<bigint>>"
_BLOCK = "list int, block int, chunk int, anchors binary, anchor_labels binary, lows binary, highs binary, wanted binary"
_HIT = "anchor_id bigint, place int, score bigint, vec_id bigint"


def wants(anchors: DataFrame, centroids: np.ndarray, radii: np.ndarray, parts: list[int], most: int, first: int, last: int, kind: type) -> DataFrame:
    """For each chunk and block that some of its anchors visit in this wave (ranks first to last of their bounds): these anchors, packed."""

    names = ["list", "block", "chunk", "anchors", "anchor_labels", "lows", "highs", "wanted"]

    def chunk(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches)
        x = np.array(rows["x"].tolist(), float)
        middle, reach = x @ centroids.T, np.sqrt((x**2).sum(axis=1))[:, None] * radii
        slack = 1e-9 * (np.abs(middle) + reach + 1)  # bounds are floats
        upper, lower = middle + reach + slack, middle - reach - slack
        # below its kth score nothing is asked for; windows are as many for some anchors as they have positives
        width = max(len(h) for h in rows["highs"])
        lows = np.full((len(rows), width), np.iinfo(np.int64).max)
        highs = np.full((len(rows), width), np.iinfo(np.int64).min)
        for k, (had, low, high) in enumerate(zip(rows["scores"], rows["lows"], rows["highs"], strict=True)):
            lows[k, : len(low)] = [max(v, s[-1]) if len(s) >= most else v for v, s in zip(low, had, strict=True)]
            highs[k, : len(high)] = high
        visit = (upper >= lows.min(axis=1)[:, None]) & (lower <= highs.max(axis=1)[:, None])
        rank = np.argsort(np.argsort(-upper, axis=1, kind="stable"), axis=1)
        visit &= (rank >= first) & (rank < last)
        ids, labels, data = rows["anchor_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), x.astype(stored_kind(kind))
        out, held = [], 0
        for k in np.flatnonzero(visit.any(axis=0)):
            own = [c[visit[:, k]].tobytes() for c in (ids, labels, lows, highs, data)]
            for b in range(parts[k]):
                out.append((int(k), b, key[0], *own))
                held += sum(map(len, own))
                if held >= AT_ONCE:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
        yield pd.DataFrame(out, columns=names)

    return anchors.groupBy("chunk").applyInPandas(chunk, _BLOCK)


def scored(pairs: DataFrame, same: bool, most: int, d: int, kind: type) -> DataFrame:
    """The best rows of each block for each anchor and window: of the same label or of others."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                a, b = (np.frombuffer(row[c], stored_kind(kind)).reshape(-1, d).astype(kind) for c in ("wanted", "data"))
                anchors, anchor_labels, ids, labels = (np.frombuffer(row[c], np.int64) for c in ("anchors", "anchor_labels", "ids", "labels"))
                lows, highs = (np.frombuffer(row[c], np.int64).reshape(len(anchors), -1).astype(kind) for c in ("lows", "highs"))
                scores = a @ b.T
                fits = ((anchor_labels[:, None] == labels) == same) & (anchors[:, None] != ids)
                out = [best(scores, fits & (scores >= lows[:, [w]]) & (scores <= highs[:, [w]]), most) for w in range(lows.shape[1])]
                at, col = (np.concatenate([o[i] for o in out]) for i in (0, 1))
                place = np.repeat(np.arange(len(out), dtype=np.int32), [len(o[0]) for o in out])
                yield pa.RecordBatch.from_arrays([pa.array(anchors[at]), pa.array(place), pa.array(scores[at, col].astype(np.int64)), pa.array(ids[col])], names=["anchor_id", "place", "score", "vec_id"])

    return pairs.mapInArrow(part, _HIT)


def best(scores: np.ndarray, fits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``most`` fitting scores of each row: higher first, of equal ones the earlier column."""
    least = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    kth, many = np.full(len(scores), least, scores.dtype), np.flatnonzero(fits.sum(axis=1) > most)
    if len(many):
        kth[many] = np.partition(np.where(fits[many], scores[many], least), -most, axis=1)[:, -most]
    at, col = np.nonzero(fits & (scores >= kth[:, None]))
    order = np.lexsort((col, -scores[at, col], at))
    at, col = at[order], col[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < most], col[place < most]


def kept(states: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """The states with the best of what they had and what was hit: told by a window, which spills, so hits of any number are no group of a task's memory."""
    had = states.select("anchor_id", F.posexplode(F.arrays_zip("scores", "found")).alias("place", "hit")).select("anchor_id", "place", F.explode(F.arrays_zip("hit.scores", "hit.found")).alias("hit"))
    rows = hits.unionByName(had.select("anchor_id", "place", F.col("hit.scores").alias("score"), F.col("hit.found").alias("vec_id")))
    nth = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    rows = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    best_of = rows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "nth", "score", "vec_id"))).alias("best"))
    each = lambda field: F.transform("lows", lambda _, p: F.transform(F.filter(F.coalesce("best", F.array().cast("array<struct<place:int,nth:int,score:bigint,vec_id:bigint>>")), lambda h: h["place"] == p), lambda h: h[field]))
    return states.drop("scores", "found").join(best_of, "anchor_id", "left").select(*states.columns[:6], each("score").alias("scores"), each("vec_id").alias("found"))


def search(anchors: DataFrame, blocks: DataFrame, centroids: np.ndarray, radii: np.ndarray, parts: list[int], same: bool, most: int, kind: type) -> DataFrame:
    """The states of the anchors after all waves."""
    d, first, last = centroids.shape[1], 0, FIRST
    while first < len(centroids):
        # Spark takes what anchors want for as small as the anchors; it is as many times larger as they visit blocks, so it isn't to be broadcast
        pairs = wants(anchors, centroids, radii, parts, most, first, last, kind).join(blocks.hint("merge"), ["list", "block"])
        anchors = stored(kept(anchors, scored(pairs, same, most, d, kind), most), "anchors")
        first, last = last, last * WAVE
    return anchors


def windows(states: DataFrame) -> DataFrame:
    """States that look for negatives: a window for each positive."""
    low = F.transform("positive_scores", lambda p: F.ceil(p * LEAST / F.lit(100).cast("decimal(3)")).cast("bigint"))
    high = F.transform("positive_scores", lambda p: F.floor(p * MOST / F.lit(100).cast("decimal(3)")).cast("bigint"))
    none = F.transform("positive_scores", lambda _: F.array().cast("array<bigint>"))
    return states.where(F.size("positive_scores") > 0).withColumns({"lows": low, "highs": high, "scores": none, "found": none})


def mine(rows: DataFrame, every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors: ids divisible by ``every``. ``rows``: as from ``usable``."""
    spark, schema = rows.sparkSession, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = stored(rows, "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    centroids = centroids_of(rows, n)
    rows = stored(assign(rows, centroids), "assigned")
    size = {r["list"]: r for r in rows.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("norm2").alias("norm2")).collect()}  # a row for each centroid
    radii = np.array([size[k]["radius"] if k in size else 0.0 for k in range(len(centroids))]) * (1 + 1e-9)
    parts = [-(-size[k]["n"] // BLOCK) if k in size else 0 for k in range(len(centroids))]
    kind = exact_kind(max(r["norm2"] for r in size.values()))
    blocks = stored(blocks_of(rows, [max(p, 1) for p in parts], kind), "blocks")
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("least"))
    chunks = max(1, -(-anchors.count() // CHUNK))
    all_scores, nothing = F.array(F.lit(-(2**62)).cast("bigint")), F.array(F.array().cast("array<bigint>"))
    anchors = anchors.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), F.col("vec_id").alias("anchor_id"), "least.label", "least.x",
        all_scores.alias("lows"), F.transform(all_scores, lambda s: -s).alias("highs"), nothing.alias("scores"), nothing.alias("found"),
    )
    near = search(stored(anchors, "anchors"), blocks, centroids, radii, parts, True, POSITIVES, kind)
    near = near.withColumns({"positives": F.col("found")[0], "positive_scores": F.col("scores")[0]})
    positives = near.select("anchor_id", "positives", "positive_scores")
    far = search(stored(windows(near).select(*near.columns[:8]), "anchors"), blocks, centroids, radii, parts, False, NEGATIVES, kind)
    hit = far.select("anchor_id", F.posexplode(F.arrays_zip("scores", "found")).alias("place", "hit")).select("anchor_id", "place", F.posexplode(F.arrays_zip("hit.scores", "hit.found")).alias("rank", "hit"))
    hit = hit.join(positives, "anchor_id")
    return hit.select(
        "anchor_id", F.col("positives")[F.col("place")].alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("hit.found").alias("negative_id"),
        F.col("positive_scores")[F.col("place")].alias("positive_score"), F.col("hit.scores").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(usable(table(spark, sf_dir, "embeddings"), label))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
