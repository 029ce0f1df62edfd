"""WARC archives: a native writer and a Python data source that reads them.

Writing: a record is one string of text lines; Spark's text writer with the
line separator CRLF lays records end to end exactly as a WARC file wants them
(gzip-compressed through the same writer), on any file system Spark can write,
with Spark's own commit protocol when executors are lost.

Reading: ``spark.read.format("tw_warc")`` plans one partition per file, accepts
equality and IN filters on ``record_type``, ``target_uri`` and ``payload_digest``
(and a ``columns`` option), parses a record's header block first, and skips the
payload of records that don't qualify or whose payload isn't wanted, without
decoding it. Files are streamed in blocks; memory is bounded by one payload.
File systems that Python can't open are read by ``read_binary``, through
Spark's own reader, one file to a row.

Deduplication: the largest id of each group of equal payloads is its response,
found by a map-side combined aggregation on the digest; the join back is a
plain equi-join, which AQE splits where one payload is very frequent.

Defined results: null html is the empty payload; null urls write an empty
target; a null page_id is the smallest id, and is the response only in a group
without other ids; rows that share the largest id are all responses; payloads
below ``min_bytes`` are all responses; an empty table gives an empty archive
and result; extra columns are ignored.
"""

import base64
import gzip
import hashlib
import io
import os
import uuid
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import let, shared_dir, table

MIN_BYTES = 0
BLOCK = 1 << 20
# spelt out: the reader's planner has no session to parse a schema string
SCHEMA = StructType(
    [StructField(n, StringType()) for n in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")]
    + [StructField("payload_length", LongType()), StructField("payload", BinaryType())]
)
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload):
    """Bare upper-case base32 of the SHA-1 of a string column."""
    def digits(bits):
        # 40 hexadecimal digits are 8 groups of 5, each of 20 bits: 4 base32 digits
        groups = F.array(*[F.conv(F.substring(bits, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)])
        return F.array_join(F.transform(groups, lambda g: F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])), "")

    # hashed once, not once a digit
    return F.when(payload.isNotNull(), let(F.sha1(payload.cast("binary")), digits))


def records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, digest, length, refers_to (null for responses)."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", digest(F.col("html"))).withColumn("length", F.octet_length("html").cast("long"))
    last = rows.where(F.col("length") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("last"))
    rows = rows.join(last.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left")
    revisit = (F.col("length") >= min_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return rows.select("page_id", "url", "html", "digest", "length", F.when(revisit, F.col("last")).alias("refers_to"))


def _urn(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, compression: str = "gzip") -> None:
    """Write a response or revisit record for each row of pages (page_id, url, html)."""
    rows = records(pages, min_bytes)
    response = F.col("refers_to").isNull()
    # a header value can't hold line ends
    url = F.regexp_replace("url", "[\r\n]+", " ")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")), F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(response, "").otherwise(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nX-Payload-Length: "), F.col("length").cast("string"),
        F.lit("\r\nContent-Length: "), F.when(response, F.col("length")).otherwise(0).cast("string"), F.lit("\r\n\r\n"),
    )
    body = F.when(response, F.col("html")).otherwise("")
    # each record ends with an empty line; its last line end is the writer's separator
    rows.select(F.concat(head, body, F.lit("\r\n")).alias("value")).write.option("lineSep", "\r\n").option("compression", compression).text(path)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _local(path: str) -> str | None:
    parts = urlsplit(path)
    return unquote(parts.path) if parts.scheme == "file" else path if not parts.scheme else None


def _listed(path: str) -> list[str]:
    """Archive files at ``path`` (a file or folder), the largest first, without markers and checksums."""
    local = _local(path)
    if local is not None:
        if os.path.isfile(local):
            return [local]
        found = [os.path.join(d, f) for d, _, names in os.walk(local) for f in names if f[0] not in "._"]
        return sorted(found, key=lambda f: (-os.path.getsize(f), f))
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = path.split("://")[0]
    return [f"{scheme}://{f.path.lstrip('/') if scheme == 's3' else f.path}" for f in sorted(found, key=lambda f: -(f.size or 0)) if f.is_file and f.base_name[0] not in "._"]


def _opened(path: str):
    local = _local(path)
    if local is not None:
        raw = open(local, "rb")  # noqa: SIM115
    else:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        raw = system.open_input_stream(inner)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def parse(stream, wanted=lambda head: True, payloads: bool = True):
    """(headers, payload or None) of each record that ``wanted`` accepts by its headers.

    Header blocks come first; the payload of any other record is skipped in blocks.
    """
    stream = io.BufferedReader(stream, BLOCK) if not isinstance(stream, io.BufferedIOBase) or isinstance(stream, gzip.GzipFile) else stream
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        left = int(head.get("content-length", 0))
        take = wanted(head)
        payload = stream.read(left) if take and payloads else None
        if payload is None:
            while left and (got := len(stream.read(min(left, BLOCK)))):
                left -= got
        elif len(payload) < left:
            raise ValueError("the archive ends inside a record")
        if take:
            yield head, payload


FIELDS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest"}


def row_of(head: dict, payload: bytes | None) -> tuple:
    bare = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    length = head.get("x-payload-length") or head.get("content-length")
    return head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"), bare, int(length) if length else None, payload


class WarcSource(DataSource):
    """Options: path; columns: a comma-separated choice of the schema's columns."""

    @classmethod
    def name(cls):
        return "tw_warc"

    def schema(self):
        every = SCHEMA
        chosen = [c.strip() for c in self.options.get("columns", ",".join(every.names)).split(",")]
        return StructType([every[c] for c in chosen])

    def reader(self, schema):
        return WarcReader(self.options["path"], schema)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.names, self.only = path, schema.names, {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if name in FIELDS and values is not None:
                self.only[name] = self.only.get(name, values) & values
            else:
                yield f

    def partitions(self):
        return [File(p) for p in _listed(self.path)] or [File("")]

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        if not partition.path:
            return
        every = SCHEMA
        schema = to_arrow_schema(StructType([every[n] for n in self.names]))
        at = [every.names.index(n) for n in self.names]

        def wanted(head):
            return all(head.get(FIELDS[n], "").removeprefix("sha1:" if n == "payload_digest" else "") in v for n, v in self.only.items())

        rows, held = [], 0
        with _opened(partition.path) as stream:
            for head, payload in parse(stream, wanted, "payload" in self.names):
                row = row_of(head, payload)
                rows.append([row[k] for k in at])
                held += 200 + len(payload or b"")
                if held >= 4 * BLOCK:
                    yield _batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def read(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("tw_warc").option("path", path)
    return (reader.option("columns", columns) if columns else reader).load()


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """All records, through Spark's binary file reader: for stores that only Spark can open."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCHEMA)

    def work(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = pa.BufferReader(content.as_buffer())
                yield _batch([row_of(*r) for r in parse(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw)], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, SCHEMA)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _digested(batches):
    for batch in batches:
        kinds, stated, lengths, payloads = (batch.column(n).to_pylist() for n in ("record_type", "payload_digest", "payload_length", "payload"))
        own = [sha1_base32(p) if k == "response" else d for k, d, p in zip(kinds, stated, payloads, strict=True)]
        size = [len(p) if k == "response" else n for k, n, p in zip(kinds, lengths, payloads, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), pa.array(size, pa.int64()), pa.array(own, pa.string()), batch.column("record_type"), batch.column("refers_to"), pa.array([a == b for a, b in zip(own, stated, strict=True)], pa.bool_())], ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok"])


def op3_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/tracewright/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    rows = read(spark, path).mapInArrow(_digested, "record_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, digest_ok boolean")

    def page(urn):
        return F.expr(f"try_cast(regexp_extract({urn}, 'page:(-?[0-9]+)', 1) AS bigint)")

    return rows.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "digest_ok")
