"""Graphs and statuses of streams.

Files arrive in a stream; each micro-batch's facts are written to a folder of its own number, so that a
batch that is run again replaces what it wrote. The current facts are those of the latest batch in which
a path arrived; a graph built of them is that of all files at their latest state, whatever
the batches were. Observations merge the same way: the merge takes minima and
first values by ``seq``, so it gives the same for any order and any repetition of batches.

Statuses of verification runs are kept by target in a stateful processor: the outcome of the latest record,
by time and record id. A record that comes late counts, but a later one that came before it stays.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tracewright.extract import code
from tracewright.plans.shapes import EDGE, NODE, merged_edges, merged_nodes

FILE = "path string, language string, text string"
_FACTS = f"{code.FACTS}, batch bigint"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files as rows, of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(FILE).parquet(folder)


def keep_facts(files: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Start writing the facts of each micro-batch below ``root``; a row without facts says that a path was seen."""

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.select("path", F.lit("file").alias("fact"), F.lit(0).alias("line"), F.lit(-1).alias("at"), F.create_map(F.lit("language"), F.coalesce("language", F.lit(""))).alias("fields"))
        code.facts(batch).unionByName(seen).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_facts(spark: SparkSession, root: str) -> DataFrame:
    """The facts of each path from the latest batch that had it."""
    rows = spark.read.schema(_FACTS).parquet(root)
    latest = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["path", "batch"]).select("path", "fact", "line", "at", "fields")


def keep_observations(observed: DataFrame, kind: str, root: str, number: int) -> None:
    """Write a batch's observations of ``nodes`` or ``edges``; the same batch again replaces them."""
    observed.select(*(f.split(" ", 1)[0] for f in (NODE if kind == "nodes" else EDGE).split(", "))).write.mode("overwrite").parquet(f"{root}/{kind}/batch={number}")


def merged(spark: SparkSession, kind: str, root: str) -> DataFrame:
    """The nodes or edges of all batches together."""
    rows = spark.read.parquet(f"{root}/{kind}").drop("batch")
    return merged_nodes(rows) if kind == "nodes" else merged_edges(rows)


RECORD = "target string, observed_at timestamp, record_id bigint, outcome string"
_STATE = "observed_at timestamp, record_id bigint, outcome string, n_records bigint"
STATUS = "target string, status string, observed_at timestamp, record_id bigint, n_records bigint"


class LatestStatus(StatefulProcessor):
    """For each target the latest record and how many there were."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("latest", _STATE)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803, the names are Spark's
        held = self.state.get() if self.state.exists() else None
        best, n = (None, 0) if held is None else ((held[0], held[1], held[2]), held[3])
        for batch in rows:
            n += len(batch)
            for at, record, outcome in zip(batch["observed_at"], batch["record_id"], batch["outcome"], strict=True):
                if best is None or (pd.Timestamp(at), record) > (pd.Timestamp(best[0]), best[1]):
                    best = (pd.Timestamp(at).to_pydatetime(), int(record), outcome)
        self.state.update((*best, n))
        status = "VERIFIED" if best[2] == "succeeded" else "UNKNOWN"
        yield pd.DataFrame({"target": [key[0]], "status": [status], "observed_at": [best[0]], "record_id": [best[1]], "n_records": [n]})

    def close(self) -> None:
        pass


def latest_status(records: DataFrame) -> DataFrame:
    """A stream of the status of each target that new records came for (target, observed_at, record_id, outcome). Needs the RocksDB state store."""
    return records.groupBy("target").transformWithStateInPandas(LatestStatus(), STATUS, "Update", "None")
