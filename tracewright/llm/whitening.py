"""Whitening of embeddings: moments merged pairwise, an eigendecomposition, a second pass that checks it.

Each partition sums up its vectors as (count, exact sums, mean, centred scatter);
two such states merge by Chan's formula in a tree (``treeReduce``), so that the
driver gets about the square root of the number of partitions at most, each of
d * d doubles (32 kB for 64 dimensions). It decomposes one d * d matrix. A second pass takes
the covariance of the whitened vectors in the same way and compares it with the identity.

Defined results:

* a vector that is null, or holds a null, NaN or infinite entry (or one of 2^40
  and more, whose whole number has no exact double), is dropped;
* vectors have the commonest length (of equally common ones the longest); others
  are dropped. An empty table, or one of empty vectors, gives no rows;
* null and repeated ids and repeated rows each count and give rows of their own;
* a component without variance (eigenvalue at rounding level, as for a single
  row) whitens to 0.0 and takes no part in the check; ``explained`` is 0.0 where nothing varies;
* ``deviation`` is null where it does not fit in a long; ``deviation_digits`` has it always;
* vectors of any length work as far as d * d doubles fit in a task; extra columns are left out.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import matrices, table

SCALE, OFFSET = 1024, 100_000
#: Entries of this magnitude and more have no exact whole number.
LARGEST = float(2**40)
COMPONENTS = 8
TREE_DEPTH = 2

State = tuple[int, list[int], np.ndarray, np.ndarray]


def whole(vector: Column) -> Column:
    """Each entry c, as a double, as the long floor(1024 c) + 100000."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)


def state_of(x: np.ndarray) -> State:
    """Count, sums, mean and centred scatter of the rows of ``x``; sums of whole numbers are exact."""
    sums = [int(s) if x.dtype.kind == "i" else float(s) for s in x.sum(axis=0)]
    mean = np.array([s / len(x) for s in sums], float)
    away = x - mean
    return len(x), sums, mean, away.T @ away


def merge(a: State, b: State) -> State:
    """Chan's formula: the state of both sets of rows."""
    (n, s, m, c), (k, t, q, d) = a, b
    if not n or not k:
        return a if n else b
    gap = q - m
    return n + k, [x + y for x, y in zip(s, t, strict=True)], m + gap * (k / (n + k)), c + d + np.outer(gap, gap) * (n * k / (n + k))


def merged(a: dict[int, State], b: dict[int, State]) -> dict[int, State]:
    """States by vector length."""
    return a | {d: merge(a[d], state) if d in a else state for d, state in b.items()}


def moments(rows: DataFrame, change=None) -> dict[int, State]:
    """States of the column ``x`` by vector length; ``change``: what is done to each matrix of rows first."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, State] = {}
        for batch in batches:
            for d, _, x in matrices(batch, "x"):
                found = merged(found, {d: state_of(change(x) if change else x)})
        if found:
            n, sums, mean, scatter = zip(*found.values(), strict=True)
            yield pa.RecordBatch.from_pydict({
                "d": pa.array(found, pa.int32()), "n": pa.array(n, pa.int64()), "sums": pa.array([[str(s) for s in x] for x in sums], pa.list_(pa.string())),
                "mean": pa.array([m.tolist() for m in mean], pa.list_(pa.float64())), "scatter": pa.array([c.ravel().tolist() for c in scatter], pa.list_(pa.float64())),
            })

    def state(row) -> dict[int, State]:
        mean = np.array(row["mean"])
        return {row["d"]: (row["n"], [float(s) if change else int(s) for s in row["sums"]], mean, np.array(row["scatter"]).reshape(len(mean), len(mean)))}

    states = rows.select("x").mapInArrow(part, "d int, n bigint, sums array<string>, mean array<double>, scatter array<double>").rdd.map(state)
    if not states.getNumPartitions():
        return {}
    return states.mapPartitions(lambda found: [dict(x) for x in found] or [{}]).treeReduce(merged, depth=TREE_DEPTH)


@dataclass(frozen=True)
class Whitening:
    """n rows with sums S; the components (columns) and their eigenvalues, largest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they fit, else Python's whole numbers."""
        fits = self.n * max(int(np.abs(x).max(initial=0)), 1) < 2**62
        return (x if fits else x.astype(object)) * self.n - np.array(self.sums, np.int64 if fits else object)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        live, away = self.live, self.deviations(x)
        return (away / self.n).astype(float) @ np.where(live, self.components / np.sqrt(np.where(live, self.values, 1.0)), 0.0)


def decompose(state: State, most: int = COMPONENTS) -> Whitening:
    """Unit eigenvectors of the covariance (divisor n); each one's largest entry is positive."""
    n, sums, _, scatter = state
    cov = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Whitening(n, sums, vectors, values, float(np.trace(cov)))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and the whole numbers ``x`` of the vectors without null and non-finite entries."""
    fine = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST))  # false for NaN too: it is larger than all numbers
    return embeddings.where(F.col("embedding").isNotNull() & fine).select("vec_id", whole(F.col("embedding")).alias("x"))


def fit(rows: DataFrame, most: int = COMPONENTS) -> Whitening | None:
    """What the vectors of the commonest length have; None without any."""
    states = {d: s for d, s in moments(rows).items() if d}
    return decompose(states[max(states, key=lambda d: (states[d][0], d))], most) if states else None


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The second pass: how far the covariance of the whitened vectors is from the identity, at its worst entry."""
    d, live = len(model.sums), model.live
    if not live.any():
        return 0.0
    (state,) = moments(rows.where(F.size("x") == d), lambda x: model.whitened(x)[:, live]).values()
    return float(np.abs(state[3] / state[0] - np.eye(int(live.sum()))).max())


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, eigenvalue, deviation_digits."""
    rows = usable(embeddings)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, eigenvalue double, deviation_digits string"
    model = fit(rows, most)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    error, d, k = identity_error(rows, model), len(model.sums), len(model.values)
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at, x in matrices(batch, "x"):
                away = model.deviations(x)
                if away.dtype == object or len(model.sums) * float(np.abs(away).max(initial=0)) ** 2 >= 2**62:
                    away = away.astype(object)
                squares = [int(s) for s in (away * away).sum(axis=1)]
                m = len(x)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    pa.array([s if s < 2**63 else None for s in squares for _ in range(k)], pa.int64()), pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)), pa.array(np.tile(model.values, m)), pa.array([s for s in map(str, squares) for _ in range(k)], pa.string()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue", "deviation_digits"])

    return rows.where(F.size("x") == d).mapInArrow(lay_out, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
