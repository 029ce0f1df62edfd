"""SentencePiece encoding and decoding that keeps source offsets.

The normaliser walks the text with the model's compiled character map: at each
place the longest mapped prefix (or one code point) is replaced, and for every
normalised byte the source byte it came from is recorded. That normalised text is
what is split into pieces: the merges are the sentencepiece library's, with the
model's own normaliser taken out. The pieces' byte lengths are then laid along the
normalised text and each piece is projected to its span of original bytes. Where
pieces and normalised text disagree the row says so (``aligned``). Decoding is the
library's. A model whose map is empty (as ``piece_bpe_32k.model``) only changes
spaces; that is done without a walk.

The model travels to the workers as bytes (half a megabyte). Each row is
handled alone: no shuffle, memory bounded by one text.

Defined results: null text counts as empty, whose only id is the end id;
repeated rows give repeated results; an empty table gives an empty result;
very long texts are encoded whole; ``encode`` keeps the columns of its input and
adds to them, and columns of the names that it adds are replaced.
"""

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced, table, trimmed

MODEL = "piece_bpe_32k.model"
#: Texts, and bytes of text, whose ids and spans are held at a time (a longer text alone).
AT_ONCE, BYTES_AT_ONCE = 256, 1 << 20
_SPACE = "▁".encode()


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


class CharMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes, then the replacements it points to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.values = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest mapped prefix at ``at``, and the prefix's length."""
        if not self.units:
            return None
        units, best = self.units, None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = self.values[value : self.values.index(b"\0", value)], i + 1 - at
        return best


class Pieces:
    def __init__(self, blob: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=blob)
        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        self.spec = pb.NormalizerSpec()
        self.spec.CopyFrom(proto.normalizer_spec)
        self.map = CharMap(self.spec.precompiled_charsmap)
        kinds = pb.ModelProto.SentencePiece
        #: What each piece spells in the normalised text.
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else b"" if p.type in (kinds.CONTROL, kinds.UNKNOWN) else p.piece.encode() for p in proto.pieces]
        self.lengths = np.array([len(b) for b in self.bytes])
        self.unknown = self.sp.unk_id()
        self.names = [str(i) for i in range(len(proto.pieces))]
        bare = proto.normalizer_spec
        bare.precompiled_charsmap, bare.normalization_rule_tsv = b"", ""
        bare.add_dummy_prefix = bare.remove_extra_whitespaces = bare.escape_whitespaces = False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and the source offset of each and of the end."""
        if not self.map.units and not self.spec.remove_extra_whitespaces:
            return self._plain(text)
        out, source, at, fresh = bytearray(), [], 0, self.spec.remove_extra_whitespaces
        if self.spec.add_dummy_prefix and text:
            out += _SPACE
            source += [0] * 3
        end = len(text)
        while at < end:
            got = self.map.longest(text, at)
            if got:
                new, n = got
            else:
                n = 1 + (text[at] >= 0xC0) + (text[at] >= 0xE0) + (text[at] >= 0xF0)
                new = text[at : at + n]
            for b in new:
                if b == 32:
                    if self.spec.remove_extra_whitespaces and fresh:
                        continue
                    fresh = True
                    mark = _SPACE if self.spec.escape_whitespaces else b" "
                    out += mark
                    source += [at] * len(mark)
                else:
                    fresh = False
                    out.append(b)
                    source.append(at)
            at += n
        if self.spec.remove_extra_whitespaces:
            while out.endswith(_SPACE):
                del out[-3:], source[-3:]
        return bytes(out), np.array([*source, end])

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The same for a model whose map is empty: only spaces change."""
        raw = np.frombuffer(text, np.uint8)
        wide = np.where(raw == 32, 3, 1) if self.spec.escape_whitespaces else np.ones(len(raw), np.int64)
        out = text.replace(b" ", _SPACE) if self.spec.escape_whitespaces else text
        source = np.repeat(np.arange(len(raw)), wide)
        if self.spec.add_dummy_prefix and text:
            out, source = _SPACE + out, np.concatenate([np.zeros(3, np.int64), source])
        return out, np.append(source, len(raw))

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, bool]]:
        """Of each text the ids with the end id, for each id the start and end of its original bytes, and whether pieces and normalised text agree."""
        normal = [self.normalise(t.encode()) for t in texts]
        ids = self.merges.encode([n.decode() for n, _ in normal], add_eos=True, num_threads=1)
        return [(i, *self._spans(n, source, i)) for i, (n, source) in zip(ids, normal, strict=True)]

    def _spans(self, normal: bytes, source: np.ndarray, ids: list[int]) -> tuple[np.ndarray, bool]:
        lengths = self.lengths[np.array(ids, np.int64)] if ids else np.zeros(0, np.int64)
        if self.unknown in ids:
            lengths = self._with_unknown(normal, ids, lengths)
            aligned = int(lengths.sum()) == len(normal)
        else:
            aligned = b"".join([self.bytes[i] for i in ids]) == normal
        ends = np.minimum(np.cumsum(lengths), len(source) - 1)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return np.stack([source[starts], source[ends]], 1), aligned

    def _with_unknown(self, normal: bytes, ids: list[int], lengths: np.ndarray) -> np.ndarray:
        """An unknown piece covers whatever lies before the next known piece."""
        lengths, at = lengths.copy(), 0
        for k, i in enumerate(ids):
            if i == self.unknown:
                after = next((self.bytes[j] for j in ids[k + 1 :] if self.lengths[j]), b"")
                to = normal.find(after, at + 1) if after else len(normal)
                lengths[k] = (to if to >= 0 else len(normal)) - at
            at += int(lengths[k])
        return lengths


@lru_cache(maxsize=4)
def _loaded(blob: bytes) -> Pieces:
    return Pieces(blob)


def _with(df: DataFrame, add, fields: str) -> DataFrame:
    """``df`` with the columns that ``add(pieces, ids, spans, aligned)`` gives for each row's text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(fields)
    kept = [c for c in df.columns if c not in new.names]
    # the text comes first, however the kept columns are called
    df = df.select(df["text"], *(df[c] for c in kept))
    shared = df.sparkSession.sparkContext.broadcast(model_bytes())
    arrow = to_arrow_schema(new)

    def work(batches):
        pieces = _loaded(shared.value)
        for batch in trimmed(batches):
            # a few texts at a time: ids and spans of many long texts needn't be held together
            for part in sliced(batch, [0], AT_ONCE, BYTES_AT_ONCE):
                rows = [add(pieces, *got) for got in pieces.encode([t or "" for t in part.column(0).to_pylist()])]
                columns = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], [*kept, *new.names])

    return df.mapInArrow(work, StructType([*(f for f in df.schema.fields[1:]), *new.fields]))


def encode(df: DataFrame, prefix: str = "") -> DataFrame:
    """``df`` with ids, starts and ends (byte offsets in the source text), n_tokens, aligned."""

    def add(pieces, ids, spans, aligned):
        return ids, spans[:, 0].tolist(), spans[:, 1].tolist(), len(ids), aligned

    p = prefix
    return _with(df, add, f"{p}ids array<int>, {p}starts array<bigint>, {p}ends array<bigint>, {p}n_tokens bigint, {p}aligned boolean")


def digests(df: DataFrame) -> DataFrame:
    """``df`` with n_tokens and the digests of ids, decoded text and spans."""

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def add(pieces, ids, spans, aligned):
        spelt = " ".join([pieces.names[i] for i in ids])
        return len(ids), sha(spelt), sha(pieces.sp.decode(ids)), hashlib.sha256(spans.astype("<i8").tobytes()).hexdigest(), aligned

    return _with(df, add, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string, aligned boolean")


def op10_sentencepiece(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
