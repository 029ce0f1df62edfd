"""The orders that people see: by the root collation of ICU, as ``localeCompare`` has it, and of paths folder by folder."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.storage import stored_table

COLLATION = "UNICODE"


def shown(text: Column) -> Column:
    """A key that sorts ``a`` before ``A``, accents behind their letters, punctuation first."""
    return F.collate(text, COLLATION)


def by_folder(path: Column) -> Column:
    """A key that sorts paths as a sorted walk meets them: name by name, in the order of ``shown``."""
    return F.transform(F.split(path, "/"), lambda name: F.collate(name, COLLATION))


def placed(rows: DataFrame, *keys: Column, name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``keys``, without a window over all of them.

    Rows are dealt by ranges of the keys and sorted in each; a place is that in the partition after the
    rows of the partitions before, which are counted (a number each). Equal keys keep some order.
    """
    partition, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    dealt = stored_table(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "placed")
    counts = dict(dealt.groupBy(partition.alias("p")).agg(F.max(within) + 1).collect())
    before, offsets = 0, []
    for p in sorted(counts):
        offsets += [F.lit(p), F.lit(before)]
        before += counts[p]
    if not offsets:
        return dealt.drop("_at").withColumn(name, F.lit(0).cast("long"))
    return dealt.withColumn(name, F.create_map(*offsets)[partition].cast("long") + within + 1).drop("_at")
