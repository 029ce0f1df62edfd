"""Mixing sources to target weights.

Tokens are aggregated per source, the target of each source gives a repetition
rate, and every document is emitted ``floor(rate)`` times plus one hash-seeded
Bernoulli copy with probability equal to the fraction.

Scale: one narrow aggregation (map-side combined, so a hot source costs nothing)
yields one row per source; windows without a partition key run over that
per-source table only. Documents meet their rate in an equi-join on the source,
whose small side Spark broadcasts only if its measured size allows, and which
AQE splits on a hot source otherwise. Texts are never shuffled by the query.

Defined results: null or blank text has size 0 and is emitted like any other
document of its source; a null source is a source of its own that comes last;
repeated rows draw alike; an empty table gives an empty result; extra columns
are kept by ``mix`` and ignored by ``plan_mix``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
_T = "__tw_mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_rates(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Water-filling: sources ordered by ``cap * size / weight`` are capped one
    after the other while the level ``rest / rest_of_weight`` reaches their cap;
    the level left over is the fixed point of resharing the excess by weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", rest / open_weight)
    per = per.withColumn("capped", F.col("level") * F.col("weight") >= F.col("limit"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    per = per.withColumn("target", F.when(F.col("capped"), F.col("limit")).otherwise(F.col("weight") * level))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    return per.select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the document and the seed only: 52 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def copies(rate: Column, drawn: Column) -> Column:
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies, taken."""
    sized = docs.select("source", word_count(F.col("text")).alias("size"), "doc_id", draw(F.col("doc_id"), F.col("text"), seed).alias("drawn"))
    rates = source_rates(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, cap).withColumnRenamed("source", "_source")
    joined = sized.join(rates, F.col("source").eqNullSafe(F.col("_source")))
    n = copies(F.col("rate"), F.col("drawn"))
    return joined.select("doc_id", "source", "size", "source_size", "target", "rate", n.alias("copies"), (n * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its source's rate and its draw say."""
    rates = source_rates(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, cap)
    rates = rates.select(F.struct("source", "rate").alias(_T))
    joined = docs.join(rates, docs["source"].eqNullSafe(F.col(f"{_T}.source")))
    n = copies(F.col(f"{_T}.rate"), draw(docs["doc_id"], docs["text"], seed))
    # array_repeat + explode: a document with no copy leaves, one with two stays twice
    out = joined.withColumn(_T, F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
    return out.select(*docs.columns)


def op9_mix_sources(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(text, '')), 1, 13))::BIGINT / 4503599627370496.0 AS drawn
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS lim FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0.0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0)) AS level
      FROM w WINDOW before AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, level * weight >= lim AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN lim ELSE weight * max(CASE WHEN NOT capped THEN level END) OVER () END AS target FROM c),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
