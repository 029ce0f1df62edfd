"""What the operators of this package share: word patterns, shared storage, row keys."""

import ctypes
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.storage import shared_dir

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back.

    Unlike an executor-local checkpoint the files outlive any executor. They
    stay until the shared folder is emptied, as a lazily evaluated result may
    still need them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracewright/{name}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it.

    Catalyst evaluates what a lambda refers to anew for every element; a bound
    lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE, -1)
    return F.filter(parts, lambda w: w != "")


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def matrices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, the places of its rows, their entries as a matrix) for each length that the lists of a column have; no list or entry is null."""
    lists = batch.column(name)
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, values.reshape(len(sizes), d) if len(at) == len(sizes) else values[starts[at][:, None] + np.arange(d)]


def sliced(batch: pa.RecordBatch, texts: list[str | int], rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and ``most_bytes`` of the texts in these columns, or one row."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in texts))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        n = int(np.clip(np.searchsorted(ends, before + most_bytes, side="right") - at, 1, rows))
        yield batch.slice(at, n)
        at += n


@lru_cache(maxsize=1)
def _trim():
    """glibc's way of giving freed memory back to the system; nothing elsewhere."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what was freed while one was worked on goes back to the system, as idle workers of an executor stay for a while."""
    for batch in batches:
        yield batch
        pa.default_memory_pool().release_unused()
        if _trim():
            _trim()(0)
