"""Near duplicates by ProbMinHash over weighted word shingles.

A text's weights are the counts of its five-word shingles. Each shingle sends a
Poisson process of arrivals (rate: its weight) to random registers; a register
keeps its first arrival. A text's processes are followed in step and stop once
none can arrive before the latest first arrival (early termination). Two texts
agree in a register with the probability of their probability Jaccard
similarity, whatever their lengths. A text in which a shingle repeats has a second
row of registers, in which each shingle weighs one: there two texts agree with the
probability of their plain Jaccard similarity. (Where none repeats the two rows
are the same.) Registers are banded; texts in a common band bucket, by either row,
are candidates, and candidates are verified on the whole texts.

From links to classes:

1. Equal texts are one node (a 64-bit text hash, made unique), so copies cost one
   row each.
2. In every bucket all nodes are compared with the bucket's first node only
   (the pivot), which is linear in the bucket, however large.
3. Connected components by large-star / small-star rounds.
4. Where a bucket still spans several components, one node outside the bucket's
   largest component is a new pivot, for ``PIVOT_ROUNDS`` rounds.
5. Nodes of the buckets that are left are entered under their rarest shingles
   (an exact prefix filter); pairs of different components that meet there are
   compared if they can reach ``SIMILAR`` by what stands behind that shingle and by
   their parity sketches, both exact bounds. So every candidate pair is compared,
   or in one class already, or shown not to be similar; nothing is capped, and
   texts alike in a frequent passage don't meet.

What step 5 hands on is about the links that are left; the join looks at all pairs
of one rare shingle, which is the square of its texts in different components.

Joins are plain equi-joins on nodes or buckets (AQE splits skewed ones), and
rows are narrow but for the texts of candidate nodes. Rounds are cut by tables
in the shared folder, so a lost executor costs at most one round.

Linked are pairs whose probability Jaccard or plain Jaccard similarity reaches
``SIMILAR``; the two are equal where no shingle repeats.

Defined results: null text counts as empty; texts without a word are equal to
texts of the same bytes only; a text of one to four words is one shingle; the
class of a document is the smallest id in it (null if it has none) and
``is_kept`` marks one row of each class: smallest id, then text hash, repeated
rows being one; an empty table gives an empty result; extra columns are kept by
``dedupe`` and ignored by ``classes``.
"""

import operator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, stored, table, trimmed
from .hashing import counted, mix, shingles, word_hashes

WIDTH = 5
SIMILAR = 0.8
#: For sums of fractions: a pair at the limit is compared rather than left out.
EPS = 1e-9
BANDS, ROWS = 26, 6
PIVOT_ROUNDS = 1
#: Texts hashed at a time: the registers of so many, and the shingles of so many bytes (of a longer text alone), are held at once.
CHUNK, CHUNK_BYTES = 512, 1 << 21
#: Rows up to which the texts with a shared hash are broadcast (16 bytes each).
BROADCAST = 100_000
#: 64-bit words of a parity sketch.
SKETCH = 16
_BITS = [f"s{k}" for k in range(SKETCH)]
_T = "__tw_near"


def signatures(texts: list[bytes], bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(registers, the text of each row): a row for each text with a shingle, and one by distinct shingles where one repeats."""
    m = bands * rows
    value, owner, weight = counted(*shingles(*word_hashes(texts), WIDTH))
    repeats = np.zeros(len(texts), bool)
    repeats[owner[weight > 1]] = True
    again, second = repeats[owner], len(texts) + np.cumsum(repeats) - 1
    value, weight = np.concatenate([value, value[again]]), np.concatenate([weight, np.ones(again.sum(), np.int64)])
    owner = np.concatenate([owner, second[owner[again]]])
    text = np.concatenate([np.arange(len(texts)), np.flatnonzero(repeats)])
    full = np.bincount(owner, minlength=len(text)) > 0
    first = np.full((len(text), m), np.inf)
    kept = np.zeros((len(text), m), np.uint64)
    flat, flat_kept = first.reshape(-1), kept.reshape(-1)
    seed, at, clock = mix(value), owner, np.zeros(len(value))
    weight = weight.astype(float)
    while len(value):
        with np.errstate(over="ignore"):
            seed = seed + np.uint64(0x9E3779B97F4A7C15)
            drawn = mix(seed)
        uniform = ((drawn >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52
        clock = clock - np.log(uniform) / weight
        # early termination: no later arrival of this shingle can be a first one
        alive = clock < first.max(1)[at]
        seed, value, at, clock, weight = seed[alive], value[alive], at[alive], clock[alive], weight[alive]
        register = (mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)).astype(float) * 2.0**-53 * m
        slot = at * m + register.astype(np.int64)
        np.minimum.at(flat, slot, clock)
        won = flat[slot] == clock
        flat_kept[slot[won]] = value[won]
    return kept[full], text[full]


def band_keys(kept: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per row of registers and band."""
    parts = kept.reshape(len(kept), bands, rows)
    out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(kept), 1))
    with np.errstate(over="ignore"):
        for k in range(rows):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, k])
    return out.astype(np.int64)


def similarity(a: bytes, b: bytes) -> tuple[float, float]:
    """(probability Jaccard, plain Jaccard) of two texts."""
    return similarities([a], [b])[0]


def similarities(left: list[bytes], right: list[bytes]) -> list[tuple[float, float]]:
    value, owner, weight = counted(*shingles(*word_hashes(left + right), WIDTH))
    bounds = np.searchsorted(owner, np.arange(2 * len(left) + 1))
    out = []
    for k in range(len(left)):
        x, y = slice(bounds[k], bounds[k + 1]), slice(bounds[len(left) + k], bounds[len(left) + k + 1])
        va, vb, wa, wb = value[x], value[y], weight[x].astype(float), weight[y].astype(float)
        if not len(va) or not len(vb):
            out.append((0.0, 0.0))
            continue
        common, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
        plain = len(common) / (len(va) + len(vb) - len(common))
        if len(wa) == wa.sum() and len(wb) == wb.sum():
            out.append((plain, plain))
            continue
        # sum over common d of 1 / sum over all d' of max(wa(d')/wa(d), wb(d')/wb(d));
        # the maximum is the first where wa(d')/wb(d') >= wa(d)/wb(d): sort by that ratio
        every = np.union1d(va, vb)
        ea, eb = np.zeros(len(every)), np.zeros(len(every))
        ea[np.searchsorted(every, va)], eb[np.searchsorted(every, vb)] = wa, wb
        with np.errstate(divide="ignore"):
            ratio = ea / eb
        order = np.argsort(ratio, kind="stable")
        ratio, ea, eb = ratio[order], ea[order], eb[order]
        below_b, from_a = np.concatenate([[0], np.cumsum(eb)]), np.concatenate([np.cumsum(ea[::-1])[::-1], [0]])
        at = np.searchsorted(ratio, wa[ia] / wb[ib], side="left")
        out.append((float((1 / (from_a[at] / wa[ia] + below_b[at] / wb[ib])).sum()), plain))
    return out


def _bytes(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _band_rows(batches):
    for batch in trimmed(batches):
        for part in sliced(batch, ["text"], CHUNK, CHUNK_BYTES):
            kept, text = signatures(_bytes(part.column("text")))
            keys = band_keys(kept)
            node = np.repeat(part.column("node").to_numpy()[text], keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(node)], ["bucket", "node"])


def _verified(batches):
    for batch in trimmed(batches):
        for part in sliced(batch, ["a_text", "b_text"], CHUNK, CHUNK_BYTES):
            got = similarities(_bytes(part.column("a_text")), _bytes(part.column("b_text")))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array([max(g) for g in got], pa.float64())], ["a", "b", "similar"])


def sketches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct shingles, all shingles, parity sketch) of each text.

    A sketch has ``SKETCH`` words of 64 bits; each distinct shingle flips one bit.
    Two sketches differ in no more bits than the texts have distinct shingles apart.
    """
    value, owner, weight = counted(*shingles(*word_hashes(texts), WIDTH))
    size, total = np.bincount(owner, minlength=len(texts)), np.bincount(owner, weight, len(texts))
    bit = (mix(value) >> np.uint64(11)) % np.uint64(SKETCH * 64)
    flips = np.bincount(owner * SKETCH * 64 + bit.astype(np.int64), minlength=len(texts) * SKETCH * 64) & 1
    return size, total.astype(np.int64), np.packbits(flips.astype(np.uint8).reshape(len(texts), -1), axis=1).view(np.int64)


def _text_rows(batches):
    for batch in trimmed(batches):
        for part in sliced(batch, ["text"], CHUNK, CHUNK_BYTES):
            size, total, bits = sketches(_bytes(part.column("text")))
            columns = [part.column("node"), part.column("text"), pa.array(size), pa.array(total), *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(SKETCH))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "text", "size", "total", *_BITS])


def text_rows(texts: DataFrame) -> DataFrame:
    """(node, text) with size, total and sketch."""
    return texts.select("node", "text").mapInArrow(_text_rows, "node bigint, text string, size bigint, total bigint, " + ", ".join(f"{c} bigint" for c in _BITS))


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{side}_{c}") for c in rows.columns))


def _reaches(a, b):
    """Whether texts that have at least the shares a and b of their weight apart may reach ``SIMILAR``.

    Probability Jaccard similarity sums, over common shingles of normal weights x and
    y, at most 1 / (1 / x + b / y); that is concave, so the sum is at most its value at
    the sums 1 - a and 1 - b: (1 - a)(1 - b) / (1 - a b). By distinct shingles, where
    all weights are one, this is plain Jaccard similarity.
    """
    return (1 - a) * (1 - b) >= (SIMILAR - EPS) * (1 - a * b)


def can_be_similar():
    """Whether the texts a and b may reach ``SIMILAR``, by sizes and sketches; never false for a pair that does.

    A shingle weighs at least 1 / total, and the shares by distinct shingles are no
    smaller; so one condition serves for both similarities. Solved for the number of
    shingles apart it is one limit: the smaller root of a quadratic.
    """
    apart = reduce(operator.add, (F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _BITS))
    more = F.col("a_size") - F.col("b_size")
    half = (F.col("a_total") + F.col("b_total")) / 2
    rest = (1 - SIMILAR) * F.col("a_total") * F.col("b_total") - more * (F.col("b_total") - F.col("a_total")) / 2 - (1 + SIMILAR) * more * more / 4
    limit = (half - F.sqrt(F.greatest(half * half - (1 + SIMILAR) * rest, F.lit(0.0)))) * (2 / (1 + SIMILAR)) + F.lit(1e-6)
    return (F.abs(more) <= limit) & (apart <= limit)


def links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough: by sketches, then verified on whole texts."""
    narrow = texts.drop("text")
    rest = pairs.join(_side(narrow, "a"), F.col("a") == F.col("a_node")).join(_side(narrow, "b"), F.col("b") == F.col("b_node")).where(can_be_similar()).select("a", "b")
    with_a = rest.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    with_both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    checked = with_both.select("a", "b", "a_text", "b_text").mapInArrow(_verified, "a bigint, b bigint, similar double")
    return checked.where(F.col("similar") >= SIMILAR).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): comp is the component's smallest node.

    Large-star hangs each larger neighbour on the smallest one, small-star each
    smaller one; a round of both is two shuffles of number pairs, and the number
    of rounds grows with the logarithm of a component's diameter.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        new = stored(small, "edges")
        # done when every edge hangs a node on a root: no node has two parents or is a parent itself
        loose = new.groupBy("u").count().where("count > 1").select("u").unionByName(new.select("u").join(new.select(F.col("v").alias("u")), "u", "left_semi"))
        if loose.isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        edges = new


def _in_comps(members: DataFrame, comps: DataFrame) -> DataFrame:
    """members (bucket, node) with their component, of buckets that span several."""
    named = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = named.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    return named.join(split, "bucket", "left_semi")


def _linked(pairs: DataFrame, comps: DataFrame, done: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(components, pairs done) once the pairs that aren't done are compared."""
    new = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    new = stored(new.join(done, ["a", "b"], "left_anti"), "pairs")
    found = stored(links(new, texts), "links")
    if not found.isEmpty():
        comps = components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found))
    return comps, done.unionByName(new)


def _by_pivots(members: DataFrame, comps: DataFrame, done: DataFrame, texts: DataFrame) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(members of buckets that still span several components or None, components, pairs done) after ``PIVOT_ROUNDS``."""
    for k in range(PIVOT_ROUNDS + 1):
        left = stored(_in_comps(members, comps), "left")
        if left.isEmpty():
            return None, comps, done
        if k < PIVOT_ROUNDS:
            sizes = left.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
            pivots = sizes.groupBy("bucket").agg(F.min(F.struct("n", "comp", "first")).alias("small")).select("bucket", F.col("small.first").alias("b"), F.col("small.comp").alias("b_comp"))
            comps, done = _linked(left.join(pivots, "bucket").where("comp <> b_comp").select(F.col("node").alias("a"), "b"), comps, done, texts)
    return left, comps, done


def _shingle_rows(batches):
    for batch in trimmed(batches):
        for part in sliced(batch, ["text"], CHUNK, CHUNK_BYTES):
            value, owner, weight = counted(*shingles(*word_hashes(_bytes(part.column("text"))), WIDTH))
            size, total = np.bincount(owner, minlength=part.num_rows)[owner], np.bincount(owner, weight, part.num_rows)[owner]
            node = part.column("node").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(node), pa.array(weight / total), pa.array(1 / size)], ["bucket", "node", "mass", "part"])


def rare_members(texts: DataFrame) -> DataFrame:
    """(bucket, node, rest, rest_mass): each text under its rarest shingles.

    Exact, no sketch (prefix filter): shingles are ordered by how few of the texts
    hold them; the share ``rest`` of a text's distinct shingles, and ``rest_mass`` of
    its weight, stand at this place or later. A text is entered while one of them
    reaches ``SIMILAR``: were two texts' rarest common shingle later in either, they
    would have less than that in common.
    """
    rows = texts.select("node", "text").mapInArrow(_shingle_rows, "bucket bigint, node bigint, mass double, part double")
    held = rows.join(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket")
    after = Window.partitionBy("node").orderBy(F.col("n").desc(), "bucket").rowsBetween(Window.unboundedPreceding, 0)
    held = held.select("bucket", "node", "n", F.sum("part").over(after).alias("rest"), F.sum("mass").over(after).alias("rest_mass"))
    return held.where((F.col("n") > 1) & (F.greatest("rest", "rest_mass") >= SIMILAR - EPS)).drop("n")


def rare_pairs(rare: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that can be similar, judged by their rarest common shingle and their sketches.

    What both have from that shingle on bounds what they have in common.
    """
    a, b = _side(rare.withColumnRenamed("bucket", "at"), "a"), _side(rare.withColumnRenamed("bucket", "at"), "b")
    plain, weighted = (_reaches(1 - F.least(f"a_{c}", F.lit(1.0)), 1 - F.least(f"b_{c}", F.lit(1.0))) for c in ("rest", "rest_mass"))
    met = (F.col("a_at") == F.col("b_at")) & (F.col("a_comp") > F.col("b_comp")) & (plain | weighted) & can_be_similar()
    return a.join(b, met).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def node_classes(docs: DataFrame) -> DataFrame:
    """(node, comp) for the nodes that have a near duplicate of another text; docs: node, text."""
    rows = stored(docs.mapInArrow(_band_rows, "bucket bigint, node bigint"), "bands")
    grouped = rows.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    members = stored(rows.join(grouped.select("bucket", "low"), "bucket").distinct(), "members")
    wanted = members.select("node").distinct()
    texts = stored(text_rows(docs.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))), "texts")

    pairs = members.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    edges = stored(links(pairs, texts), "links")
    comps, done = components(edges), pairs
    left, comps, done = _by_pivots(members.select("bucket", "node"), comps, done, texts)
    if left is None:
        return comps
    entered = rare_members(texts.join(left.select("node").distinct(), "node", "left_semi")).join(texts.drop("text"), "node")
    rare = stored(_in_comps(entered, comps), "rare")
    return _linked(rare_pairs(rare), comps, done, texts)[0]


def with_nodes(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a column ``name``: a 64-bit number of the text, which unlike texts don't share.

    Texts whose hashes are equal but whose second hashes differ are numbered by the
    second. Of n texts about n^2 / 2^65 are: 70 of 5 * 10^10, so they are broadcast
    (up to ``BROADCAST`` of them, counted; more are joined).
    """
    text = F.coalesce(docs["text"], F.lit(""))
    hashed = docs.select(F.xxhash64(text).alias("node"), F.xxhash64(F.lit(7), text).alias("second"))
    shared = stored(hashed.groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high").select(F.struct("node").alias(_T)), "shared")
    named = docs.withColumn(name, F.xxhash64(text)).join(F.broadcast(shared) if shared.count() <= BROADCAST else shared, F.col(name) == F.col(f"{_T}.node"), "left")
    return named.withColumn(name, F.when(F.col(_T).isNull(), F.col(name)).otherwise(F.xxhash64(F.lit(7), text))).drop(_T)


def classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, node, class_id, is_kept."""
    base = with_nodes(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "node")
    comps = node_classes(base.select("node", "text"))
    rows = base.select("doc_id", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    first = rows.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first"))
    return rows.join(first, "comp").select(
        "doc_id", "node", "class_id", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))).alias("is_kept")
    )


def dedupe(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, one of each class, with their columns.

    Of rows with the same id and text, the one that comes first as JSON is kept.
    """
    kept = classes(docs).where("is_kept").groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    kept = stored(kept.select(F.struct("doc_id", "node", "n").alias(_T)), "kept")
    named = with_nodes(docs, f"{_T}_node")
    met = (F.col(f"{_T}_node") == F.col(f"{_T}.node")) & docs["doc_id"].eqNullSafe(F.col(f"{_T}.doc_id"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = named.join(kept.where(F.col(f"{_T}.n") == 1), met, "left_semi").select(*columns)
    repeated = kept.where(F.col(f"{_T}.n") > 1)
    if repeated.isEmpty():
        return once
    row = F.struct(*columns)
    often = named.join(repeated, met, "left_semi").groupBy("doc_id", f"{_T}_node").agg(F.min_by(row, F.to_json(row)).alias(_T))
    return once.unionByName(often.select(*(F.col(_T)[c].alias(c) for c in docs.columns)))


def op4_near_duplicates(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept")
