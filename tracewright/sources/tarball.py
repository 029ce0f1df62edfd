"""Tar archives as a data source: ``spark.read.format("tw_tar").load(folder)``.

One partition an archive. Members are checked by name, kind and size before their
content is read, so an archive never writes to a disk and can't outgrow its caps.
"""

import io
import tarfile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_MEMBERS, MOST_BYTES, MOST_DEPTH = 20_000, 512 << 20, 64


def kind(head: bytes) -> str:
    """What the first bytes of an archive say: gzip, zip, tar or unknown."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        return "zip"
    return "tar" if head[257:262] == b"ustar" else "unknown"


def safe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and "\x00" not in name and ":" not in parts[0] and len(parts) <= MOST_DEPTH


def members(blob: bytes):
    """(path, byte_size, content) of the files of an archive; ValueError for what is refused."""
    found = kind(blob[:512])
    if found not in ("gzip", "tar"):
        raise ValueError(f"archives of the kind {found} are not read")
    total = count = 0
    with tarfile.open(fileobj=io.BytesIO(blob), mode="r:*") as archive:
        for m in archive:
            count += 1
            if count > MOST_MEMBERS:
                raise ValueError("the archive has too many entries")
            if m.isdir():
                continue
            if not m.isfile() or not safe(m.name):
                raise ValueError(f"the entry {m.name!r} is no file inside the archive")
            total += m.size
            if total > MOST_BYTES:
                raise ValueError("the archive is too large when unpacked")
            yield m.name.removeprefix("./"), m.size, archive.extractfile(m).read()


class _Archive(InputPartition):
    def __init__(self, name: str, blob: bytes):
        self.name, self.blob = name, blob


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        import glob
        import os

        path = self.options["path"]
        names = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else [path]
        return [_Archive(n, b"") for n in names]

    def read(self, partition: _Archive):
        with open(partition.name, "rb") as f:
            for name, size, content in members(f.read()):
                yield partition.name, name, size, content


class Tar(DataSource):
    @classmethod
    def name(cls):
        return "tw_tar"

    def schema(self):
        return "archive string, path string, byte_size bigint, content binary"

    def reader(self, schema):
        return TarReader(self.options)


def read(spark: SparkSession, path: str):
    """The members of the archives of a folder that all executors mount; for other stores see ``unpacked``."""
    spark.dataSource.register(Tar)
    return spark.read.format("tw_tar").load(path)


def unpacked(archives):
    """The same for archives that Spark has read (path, content), in whatever store they are."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for name, blob in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for member, size, content in members(blob):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([size], pa.int64()), pa.array([content], pa.binary())], ["archive", "path", "byte_size", "content"])

    return archives.select("path", "content").mapInArrow(work, "archive string, path string, byte_size bigint, content binary")


def read(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES):
    """(archive, path, byte_size, content, refused) of the archives in a folder of any store that Spark reads.

    An archive that is refused gives one row that says why; one larger than ``most_bytes`` isn't opened, as the scan filters by size.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    schema = "archive string, path string, byte_size bigint, content binary, refused string"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small, large = rows.where(F.col("length") <= most_bytes), rows.where(F.col("length") > most_bytes)

    def work(batches):
        for batch in batches:
            for name, blob in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out = []
                try:
                    for path, size, content in members(blob.as_py()):
                        out.append((name, path, size, content, None))
                except (ValueError, EOFError, OSError, tarfile.TarError) as e:
                    out = [(name, None, None, None, str(e)[:200])]  # what was read before is dropped: an archive counts as a whole
                columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["archive", "path", "byte_size", "content", "refused"])

    none = lambda kind: F.lit(None).cast(kind)
    too_large = large.select(F.col("path").alias("archive"), none("string").alias("path"), none("bigint").alias("byte_size"), none("binary").alias("content"), F.lit("the archive is too large").alias("refused"))
    return small.select("path", "content").mapInArrow(work, schema).unionByName(too_large)
