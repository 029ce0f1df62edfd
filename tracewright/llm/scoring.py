"""Language-model scores from a log-frequency Bloom filter.

The model has exact counts of single tokens and, in a Bloom filter, quantised
counts of runs of two and three: a run seen ``c`` times is entered as the events
(run, 1) .. (run, level), level = 1 + floor(log c / log BASE). Its count is read
back by asking for (run, 1), (run, 2), .. until one is missing, so an unseen run
is rarely taken for one seen once and almost never for a frequent one.
Probabilities are smoothed order by order, p = (c(run) + k * p_shorter) /
(c(context) + k), down to the single token's (c + 0.5) / (N + 0.5 * (V + 1)).

Building: workers count the runs of some texts at a time and deal them by hash
to parts, whose number grows with the corpus; each part merges its runs and
makes its own segment of the filter. Nothing is pruned. One shuffle, of some
five bytes a run (sorted, as gaps), whose files go once the segments are
written; a part's memory doesn't depend on the corpus. An event is five bits in
two words of one block, so that asking for it is at most two looks at memory.

Scoring: if all segments together take at most ``BOUND`` bytes (a size that is
measured, not guessed) they are laid out in one file of the shared folder, which
workers map, or broadcast where that is no local path, and texts aren't moved. Beyond it
texts are dealt to chunks, the distinct runs of each chunk are sent to their
segments, and a byte for each comes back to the chunk, which sorts its runs
again and so knows whose it is: the same bits are probed, so the results are the
same, with more shuffling.

Defined results: null text counts as empty, whose only token is the end; words
are compared by 64-bit hashes, runs of them by 44 bits; with no training rows N and V are 0 and every
token has the probability 1; repeated rows give equal results; an empty table
gives an empty result; extra columns are ignored.
"""

import math
import os
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod, shared_dir, stored, table
from .hashing import mix, word_hashes
from .warc import _local as local_path

FOLDS, HELD_OUT = 5, 1
BASE = 1.5
LEVELS = 64
#: Bits a filter has for each event, and how many an event sets in either of two words: 0.8 % of unseen runs are taken for runs seen once.
BITS, SET = 11, (3, 2)
#: Bits of a run's hash that don't count, so that gaps between sorted runs are short.
LOW = np.uint64(20)
#: Weight of the shorter run's probability, in sightings of the context: for runs of two, of three.
#: Chosen from 28 pairs on training folds alone: learned from folds 2 to 4 of sf0.1, compared on fold 0.
K_TWO, K_THREE = 5000.0, 3.0
#: Most bytes of segments that are mapped or broadcast.
BOUND = 256 << 20
#: Bytes of text for each part of the model, each chunk, and what a worker counts or scores at a time.
PART, CHUNK, COUNTED, SCORED = 4 << 20, 5 << 20, 4 << 20, 1 << 20
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
SEGMENT = "part int, bits binary, keys binary, counts binary"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
#: The middle of the counts that a level stands for.
_COUNTS = np.array([0.0] + [(math.ceil(BASE ** (j - 1)) + math.ceil(BASE**j) - 1) / 2 for j in range(1, LEVELS + 1)])


def level_of(counts: np.ndarray) -> np.ndarray:
    edges = np.ceil(BASE ** np.arange(LEVELS))
    return np.searchsorted(edges, counts, side="right")


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes of all texts with two starts before and an end after each, tokens per text without starts)."""
    words, n = word_hashes([t.lower() for t in texts])
    wide = n + 3
    out = np.empty(int(wide.sum()), np.uint64)
    ends = np.cumsum(wide)
    inner = np.ones(len(out), bool)
    for at, value in ((ends - wide, START), (ends - wide + 1, START), (ends - 1, END)):
        out[at], inner[at] = value, False
    out[inner] = words
    return out, n + 1


def runs_of(tokens: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Keys per counted token: one, two and three (the runs that end in it), pair (the two before it)."""
    wide = n + 2
    starts = np.cumsum(wide) - wide
    counted = np.ones(len(tokens), bool)
    counted[starts] = counted[starts + 1] = False
    at = np.flatnonzero(counted)
    c, b, a = tokens[at], tokens[at - 1], tokens[at - 2]
    with np.errstate(over="ignore"):

        def pair(x, y):
            return mix(mix(x + np.uint64(2)) * np.uint64(0xD6E8FEB86659FD93) + y) >> LOW << LOW

        two, context = pair(b, c), pair(a, b)
        three = mix(mix(context + np.uint64(3)) * np.uint64(0xD6E8FEB86659FD93) + c) >> LOW << LOW
    return {"one": c, "two": two, "pair": context, "three": three}


#: The run that stands before a text's first token.
HEAD = runs_of(np.array([START, START, END]), np.array([1]))["pair"]


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of keys, so that sorted keys lie part by part."""
    return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _events(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys + levels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _places(events: np.ndarray, size):
    """Twice (word, the bits that each event sets in it) in filters of ``size`` blocks of eight words."""
    word = ((events >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32) << np.uint64(3)) | (events >> np.uint64(30) & np.uint64(7))
    at = 0
    for n in SET:
        masks = np.zeros(len(events), np.uint64)
        for _ in range(n):
            masks |= np.uint64(1) << (events >> np.uint64(at) & np.uint64(63))
            at += 6
        yield word, masks
        word = word ^ (events >> np.uint64(33) & np.uint64(6) | np.uint64(1))


def make_bits(keys: np.ndarray, counts: np.ndarray) -> bytes:
    levels = level_of(counts)
    blocks = max(1, -(-int(levels.sum()) * BITS // 512))
    words = np.zeros(8 * blocks, np.uint64)
    for j in range(1, int(levels.max(initial=0)) + 1):
        for place, masks in _places(_events(keys[levels >= j], np.int64(j)), blocks):
            np.bitwise_or.at(words, place.astype(np.int64), masks)
    return words.astype("<u8").tobytes()


MAGIC = b"tracewright-lm-2"


def _laid(parts: int, sizes: dict[int, tuple[int, int]], rows):
    """(place, bytes) of some parts' segments in one buffer: sizes is {part: (bytes of bits, bytes of keys)}, rows come in any order; the end comes first.

    Parts are ranges of keys, so that keys in the order of parts are sorted.
    """
    starts, widths = np.zeros(parts, np.uint64), np.zeros(parts, np.uint64)
    n = sum(k for _, k in sizes.values()) // 8
    head = len(MAGIC) + 24
    tables = head + 16 * parts
    size = tables + 16 * n + sum(b for b, _ in sizes.values())
    yield size, b""
    yield 0, MAGIC + np.array([parts, n, size], "<i8").tobytes()
    at_keys, at_bits, places = 0, 0, {}
    for part in sorted(sizes):
        places[part] = at_keys, at_bits
        starts[part], widths[part] = at_bits // 8, sizes[part][0] // 64
        at_keys, at_bits = at_keys + sizes[part][1], at_bits + sizes[part][0]
    yield head, starts.astype("<u8").tobytes() + widths.astype("<u8").tobytes()
    for r in rows:
        k, b = places[r["part"]]
        yield tables + k, r["keys"]
        yield tables + 8 * n + k, r["counts"]
        yield tables + 16 * n + b, r["bits"]


def packed(parts: int, sizes: dict[int, tuple[int, int]], rows) -> bytearray:
    laid = _laid(parts, sizes, rows)
    out = bytearray(next(laid)[0])
    for at, raw in laid:
        out[at : at + len(raw)] = raw
    return out


def written(path: str, parts: int, sizes: dict[int, tuple[int, int]], rows) -> None:
    """The same as a file, a segment in memory at a time."""
    with open(path, "wb") as f:
        laid = _laid(parts, sizes, rows)
        f.truncate(next(laid)[0])
        for at, raw in laid:
            f.seek(at)
            f.write(raw)


def mapped(shared) -> np.ndarray:
    """A buffer by the path of its file, or a broadcast one; mapped from the executor's file where there is one, so that its workers have it once."""
    if isinstance(shared, str):
        return np.memmap(shared, np.uint8, "r")
    path = getattr(shared, "_path", None)
    if path and os.path.exists(path):
        with open(path, "rb") as f:
            at = f.read(64).find(MAGIC)
        if at >= 0:
            raw = np.memmap(path, np.uint8, "r", at)
            return raw[: int(np.frombuffer(raw[len(MAGIC) + 16 : len(MAGIC) + 24].tobytes(), "<i8")[0])]
    return np.frombuffer(shared.value, np.uint8)


class Filter:
    """Packed segments, read in place; keys of parts that aren't among them aren't known."""

    def __init__(self, raw: np.ndarray):
        self.parts, n, _ = np.frombuffer(raw[len(MAGIC) : len(MAGIC) + 24].tobytes(), "<i8").tolist()
        at = len(MAGIC) + 24

        def taken(count, kind):
            nonlocal at
            at += 8 * count
            return np.frombuffer(raw[at - 8 * count : at].tobytes(), kind)

        self.starts, self.sizes = taken(self.parts, "<u8"), taken(self.parts, "<u8")
        self.keys, self.counts = taken(n, "<u8"), taken(n, "<i8")
        self.bits = np.asarray(raw[at:]).view("<u8")

    @classmethod
    def of(cls, parts: int, rows: list[dict]) -> "Filter":
        sizes = {r["part"]: (len(r["bits"]), len(r["keys"])) for r in rows}
        return cls(np.frombuffer(packed(parts, sizes, rows), np.uint8))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: probed event by event until one is missing."""
        out = np.zeros(len(keys), np.int64)
        part = part_of(keys, self.parts)
        left = np.flatnonzero(self.sizes[part])
        keys, part = keys[left], part[left]
        starts, sizes = self.starts[part], self.sizes[part]
        for j in range(1, LEVELS + 1):
            hit = np.arange(len(keys))
            for place, masks in _places(_events(keys, np.int64(j)), sizes):
                masks = masks[hit]
                hit = hit[self.bits[(starts[hit] + place[hit]).astype(np.int64)] & masks == masks]
            if not len(hit):
                break
            left, keys, starts, sizes = left[hit], keys[hit], starts[hit], sizes[hit]
            out[left] = j
        return out

    def exact(self, keys: np.ndarray) -> np.ndarray:
        return _found(self.keys, self.counts, keys)


def _found(known: np.ndarray, values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], 0)


_ZSTD = pa.Codec("zstd", 1)


def _planes(values: np.ndarray) -> bytes:
    """Numbers compressed, all lowest bytes first: high ones are alike."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(values).to_bytes(4, "little") + _ZSTD.compress(raw, asbytes=True)


def _unplaned(raw: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(raw[:4], "little"), np.dtype(kind).itemsize
    got = np.frombuffer(_ZSTD.decompress(raw[4:], n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(got.reshape(width, n).T).view(kind).ravel()


def coded(runs: np.ndarray) -> bytes:
    """Sorted runs as gaps."""
    return _planes(np.diff(runs >> LOW, prepend=np.uint64(0)).astype("<u8"))


def decoded(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(raw, "<u8"), dtype=np.uint64) << LOW


def _texts(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _sliced(batches, limit: int):
    """Lists of batches' slices, of about ``limit`` bytes of text together."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            held.append(part)
            size += part.column("text").nbytes
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _counter(parts: int):
    def work(batches):
        for held in _sliced(batches, COUNTED):
            tokens, n = tokens_of([t for b in held for t in _texts(b.column("text"))])
            runs = runs_of(tokens, n)
            rows = []
            firsts = np.full(len(n), START, np.uint64)
            for order, keys in ((1, np.concatenate([runs["one"], firsts])), (2, np.concatenate([runs["two"], np.repeat(HEAD, len(n)), runs["three"]]))):
                keys, counts = np.unique(keys, return_counts=True)
                edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(edges)):
                    s = slice(edges[p], edges[p + 1])
                    rows.append((int(p), order, coded(keys[s]) if order > 1 else keys[s].astype("<u8").tobytes(), _planes(counts[s].astype("<u4"))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], ["part", "len", "keys", "counts"])

    return work


def _merged(orders, keys, counts, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    at = [k for k, o in enumerate(orders) if o == wanted]
    every = np.concatenate([decoded(keys[k]) if wanted > 1 else np.frombuffer(keys[k], "<u8") for k in at] or [np.zeros(0, np.uint64)])
    much = np.concatenate([_unplaned(counts[k], "<u4") for k in at] or [np.zeros(0, np.uint32)]).astype(np.int64)
    order = np.argsort(every, kind="stable")
    every, much = every[order], much[order]
    if not len(every):
        return every, much
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[first], np.add.reduceat(much, first)


def _segment(rows: pa.Table) -> pa.Table:
    orders, keys, counts = (rows.column(n).to_pylist() for n in ("len", "keys", "counts"))
    ones, n = _merged(orders, keys, counts, 1)
    bits = make_bits(*_merged(orders, keys, counts, 2))
    columns = [pa.array([rows.column("part")[0].as_py()], pa.int32()), *(pa.array([x], pa.binary()) for x in (bits, ones.tobytes(), n.astype("<i8").tobytes()))]
    return pa.Table.from_arrays(columns, ["part", "bits", "keys", "counts"])


def _totals(batches):
    for batch in batches:
        for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            keep = np.frombuffer(keys, "<u8") != START
            yield pa.RecordBatch.from_arrays([pa.array([int(np.frombuffer(counts, "<i8")[keep].sum())]), pa.array([int(keep.sum())])], ["tokens", "distinct"])


class Model:
    """Segments (a stored table), their number, N, V and the bytes of all segments."""

    def __init__(self, segments: DataFrame, parts: int):
        self.segments, self.parts = segments, parts
        total = segments.select("keys", "counts").mapInArrow(_totals, "tokens bigint, distinct bigint").agg(F.sum("tokens"), F.sum("distinct")).first()
        self.tokens, self.distinct = total[0] or 0, total[1] or 0
        self.bytes = segments.agg(F.sum(F.octet_length("bits") + F.octet_length("keys") + F.octet_length("counts")).cast("long")).first()[0] or 0


@contextmanager
def _freed(spark):
    """What is written meanwhile leaves no shuffle files behind: they aren't asked for again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def train(docs: DataFrame, part_bytes: int = PART) -> Model:
    """The model of the rows' texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    rows = docs.select("text").mapInArrow(_counter(parts), "part int, len int, keys binary, counts binary")
    with _freed(docs.sparkSession):
        segments = stored(rows.groupBy("part").applyInArrow(_segment, SEGMENT), "segments")
    return Model(segments, parts)


def _scores(texts: list[bytes], exact, levels, tokens: int, distinct: int):
    """Per text: (tokens, known tokens, base score, score)."""
    found, n = tokens_of(texts)
    runs = runs_of(found, n)
    owner = np.repeat(np.arange(len(n)), n)
    firsts = np.cumsum(n) - n

    def shifted(values, first):
        # what stands before a token is what was asked for one place earlier
        out = np.concatenate([np.zeros(1, values.dtype), values[:-1]])
        out[firsts] = first
        return out

    keys, back = np.unique(runs["one"], return_inverse=True)
    c = exact(keys)[back]
    one = (c + 0.5) / (tokens + 0.5 * (distinct + 1))
    before = shifted(c, exact(np.array([START]))[0])
    found_two = _COUNTS[levels(runs["two"])]
    two = (np.minimum(found_two, before) + K_TWO * one) / (before + K_TWO)
    pair = shifted(found_two, _COUNTS[levels(HEAD)][0])
    three = (np.minimum(_COUNTS[levels(runs["three"])], pair) + K_THREE * two) / (pair + K_THREE)

    def total(p):
        return np.bincount(owner, np.log10(np.minimum(p, 1.0)), len(n))

    return n, np.bincount(owner, c > 0, len(n)).astype(np.int64), total(one), total(three)


def _result(held, got, tokens: int) -> pa.RecordBatch:
    ids = pa.concat_arrays([b.column("doc_id") for b in held]).cast(pa.int64())
    folds = pa.concat_arrays([b.column("held_out") for b in held])
    n, known, base, score = got
    return pa.RecordBatch.from_arrays([ids, folds, pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def _by_one_filter(docs: DataFrame, model: Model) -> DataFrame:
    # at most BOUND bytes, fetched a partition at a time
    sizes = {r[0]: (r[1], r[2]) for r in model.segments.select("part", F.octet_length("bits"), F.octet_length("keys")).collect()}
    rows = model.segments.toLocalIterator()
    if folder := local_path(shared_dir(docs.sparkSession)):
        os.makedirs(f"{folder}/tracewright", exist_ok=True)
        shared = f"{folder}/tracewright/filter-{uuid.uuid4().hex}"
        written(shared, model.parts, sizes, rows)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(packed(model.parts, sizes, rows))
    tokens, distinct = model.tokens, model.distinct

    def work(batches):
        known = Filter(mapped(shared))
        for held in _sliced(batches, SCORED):
            got = _scores([t for b in held for t in _texts(b.column("text"))], known.exact, known.levels, tokens, distinct)
            yield _result(held, got, tokens)

    return docs.mapInArrow(work, SCORES)


def _by_chunks(docs: DataFrame, model: Model, chunk_bytes: int = CHUNK) -> DataFrame:
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    parts, tokens, distinct = model.parts, model.tokens, model.distinct
    docs = docs.select("doc_id", "held_out", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))

    def distinct_runs(texts: pa.Table) -> list[np.ndarray]:
        """What a chunk asks for, sorted: its tokens, its runs."""
        runs = runs_of(*tokens_of(_texts(texts.column("text"))))
        return [np.unique(np.append(runs["one"], START)), np.unique(np.concatenate([runs["two"], HEAD, runs["three"]]))]

    def ask(texts: pa.Table) -> pa.Table:
        rows = []
        for kind, keys in enumerate(distinct_runs(texts)):
            edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                own = keys[edges[p] : edges[p + 1]]
                rows.append((int(p), kind, coded(own) if kind else own.astype("<u8").tobytes()))
        chunk = pa.array(np.full(len(rows), texts.column("chunk")[0].as_py(), np.int64))
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), chunk, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["part", "chunk", "kind", "keys"])

    def answer(asked: pa.Table, segments: pa.Table) -> pa.Table:
        values = []
        own = Filter.of(parts, segments.to_pylist())
        for kind, keys in zip(asked.column("kind").to_pylist(), asked.column("keys").to_pylist(), strict=True):
            values.append(_planes(own.levels(decoded(keys)).astype(np.uint8) if kind else own.exact(np.frombuffer(keys, "<u8")).astype("<i8")))
        return pa.Table.from_arrays([asked.column("chunk"), asked.column("part"), asked.column("kind"), pa.array(values, pa.binary())], ["chunk", "part", "kind", "values"])

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = sorted(answers.select(["kind", "part", "values"]).to_pylist(), key=lambda r: (r["kind"], r["part"]))
        known = distinct_runs(texts)
        # parts are ranges, so answers in the order of parts are those of the sorted keys
        values = [np.concatenate([_unplaned(r["values"], own) for r in rows if r["kind"] == kind]) for kind, own in enumerate(("<i8", "<u1"))]

        def exact(keys):
            return _found(known[0], values[0], keys)

        def levels(keys):
            # neighbours are looked up one after another: far quicker than in the order of the text
            keys, back = np.unique(keys, return_inverse=True)
            return _found(known[1], values[1], keys)[back]

        held = _sliced(texts.to_batches(), SCORED)
        return pa.Table.from_batches([_result(h, _scores([t for b in h for t in _texts(b.column("text"))], exact, levels, tokens, distinct), tokens) for h in held])

    asked = docs.groupBy("chunk").applyInArrow(ask, "part int, chunk bigint, kind int, keys binary")
    answers = asked.groupBy("part").cogroup(model.segments.groupBy("part")).applyInArrow(answer, "chunk bigint, part int, kind int, values binary")
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORES)


def score(docs: DataFrame, model: Model, bound: int = BOUND) -> DataFrame:
    """doc_id, held_out and the scores for rows (doc_id, held_out, text)."""
    return _by_one_filter(docs, model) if model.bytes <= bound else _by_chunks(docs, model)


def op7_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return score(rows, train(rows.where(~F.col("held_out"))))
