"""Documents made ready for training: filtered, deduplicated, pseudonymised, mixed, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's result to the
shared folder and reads it back, so a lost executor repeats a part of one stage.

Defined results: see the operators; an empty table passes through all stages,
and extra columns stay up to the last stage, which returns its own.
"""

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import minhash, mixing, pieces, pii, quality
from tracewright.llm.common import stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.dedupe(docs)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced."""
    return pii.pseudonymise(docs, pii.key_of(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources come near their targets."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, the byte span of each piece, n_tokens, aligned."""
    return pieces.encode(docs.select("doc_id", "text")).drop("text")


STAGES = [
    ("quality_rules", keep_good),
    ("near_dedup", near_dedup),
    ("pii", pseudonymise),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]

#: Near duplicates, pseudonyms and pieces have no SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
