"""Document fingerprints: a threshold-scaled sketch of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its length follows the document's, sketches merge by union, and containment can
be estimated between documents of very unequal length. The smallest hash is
kept in any case, so a text with a word never has an empty sketch.

Hashes are the first 64 bits of MD5 over five words joined by a space, written
in hexadecimal; a text of one to four words is one shingle. JVM-side throughout.

The neighbour in descending order of ids is found without a global sort:
documents are cut into ordered buckets of ids (quantiles, each cut evenly
again), each bucket also gets a copy of the first row of the next one, and
``lead`` runs within buckets. One wide shuffle; the rows that are copied
number one per bucket, at most ``MAX_BUCKETS``.

Defined results: null text counts as empty; a text without words has the empty
sketch, which is alike (1.0) to the empty sketch only; null ids come last; rows
with equal ids are ordered by their text's hash; an empty table gives an empty
result; extra columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table, words_of

WIDTH = 5
#: One hash in SCALE is kept: those whose first hexadecimal digit is below 16 / SCALE.
SCALE = 8
ROWS_PER_BUCKET = 4096
QUANTILES = 256
MAX_BUCKETS = 16384


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """The hash of each run of ``width`` words, in order; of all words if there are fewer."""

    def hashes(ws: Column) -> Column:
        n = F.size(ws)
        long = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.substring(F.md5(F.concat_ws(" ", F.slice(ws, i, width)).cast("binary")), 1, 16))
        short = F.array(F.substring(F.md5(F.concat_ws(" ", ws).cast("binary")), 1, 16))
        return F.when(n >= width, long).when(n > 0, short).otherwise(F.array().cast("array<string>"))

    return let(words_of(text), hashes)


def sketch(text: Column, width: int = WIDTH, scale: int = SCALE) -> Column:
    """Sorted distinct hashes below 1/scale of the range, and the smallest one in any case."""
    below = F.lit(format(16 // scale, "x"))

    def least_or_kept(hs: Column) -> Column:
        few = F.array_sort(F.array_distinct(F.filter(hs, lambda h: h < below)))
        return let(few, lambda f: F.when(F.size(f) > 0, f).when(F.size(hs) > 0, F.array(F.array_min(hs))).otherwise(f))

    return let(shingle_hashes(text, width), least_or_kept)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents together."""
    both = F.array_sort(F.array_union(a, b))
    below = F.lit(format(16 // scale, "x"))
    return let(both, lambda s: F.when(F.element_at(s, 1) < below, F.filter(s, lambda h: h < below)).otherwise(F.slice(s, 1, 1)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sketches."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, common / union).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """The share of a's sketch that b's has too: an estimate of how far a is contained in b."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def written(s: Column) -> Column:
    return F.concat_ws("", s)


def ordered_buckets(docs: DataFrame, key: str) -> Column:
    """A bucket number that grows as ``key`` falls; nulls come last. Balance alone depends on the quantiles."""
    points = [i / QUANTILES for i in range(QUANTILES + 1)]
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(key, points, 2000).alias("q")).first()
    cuts = sorted(set(row["q"] or []), reverse=True)
    if len(cuts) < 2:
        return F.when(F.col(key).isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long")
    wanted = min(MAX_BUCKETS, max(1, row["n"] // ROWS_PER_BUCKET))
    inner = max(1, -(-wanted // (len(cuts) - 1)))
    step = max(1, (len(cuts) - 1) // wanted)
    cuts = cuts[::step] + ([cuts[-1]] if (len(cuts) - 1) % step else [])
    last = len(cuts) - 2
    low = F.array(*[F.lit(c) for c in cuts[1:]])
    high = F.array(*[F.lit(c) for c in cuts[:-1]])
    at = F.least(F.size(F.filter(low, lambda c: c > F.col(key))), F.lit(last))
    part = let(at, lambda i: i.cast("long") * inner + F.least(F.lit(inner - 1), F.greatest(F.lit(0), F.floor((F.get(high, i) - F.col(key)).cast("double") * inner / F.greatest(F.lit(1), F.get(high, i) - F.get(low, i))).cast("int"))))
    return F.when(F.col(key).isNull(), F.lit((last + 2) * inner)).otherwise(part).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sk and next_text, next_sk: those of the next document in descending order of doc_id, cyclic."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("bucket", ordered_buckets(docs, "doc_id")).withColumn("tie", F.xxhash64("text"))
    first = F.min(F.struct((-F.col("doc_id")).alias("neg"), "tie", "doc_id"))
    heads = docs.groupBy("bucket").agg(first.alias("h"))
    order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    heads = heads.select(before.alias("to_bucket"), F.col("h.doc_id").alias("h_id"), F.col("h.tie").alias("h_tie"))
    # at most MAX_BUCKETS rows of three numbers
    texts = docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("tie") == F.col("h_tie")))
    copied = texts.dropDuplicates(["to_bucket"]).select("doc_id", "text", F.col("to_bucket").alias("bucket"), "tie", F.lit(True).alias("copied"))
    rows = docs.withColumn("copied", F.lit(False)).unionByName(copied).withColumn("sk", sketch(F.col("text")))
    within = Window.partitionBy("bucket").orderBy("copied", F.col("doc_id").desc_nulls_last(), "tie")
    rows = rows.withColumn("next", F.lead(F.struct("text", "sk")).over(within)).where(~F.col("copied"))
    return rows.select("doc_id", "text", "sk", F.col("next.text").alias("next_text"), F.col("next.sk").alias("next_sk"))


def op8_fingerprints(spark, sf_dir):
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - third), F.col("next_text").substr(F.lit(1), third)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sk", "next_sk", sketch(F.col("edited")).alias("edited_sk"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("sk")).alias("fingerprint"), written(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"), likeness(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER (ORDER BY doc_id DESC NULLS LAST), first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST)) AS next_text FROM d),
e AS (SELECT doc_id, text, next_text, length(text) AS n_chars, left(text, (length(text) - length(text) // 3)::BIGINT) || left(next_text, (length(text) // 3)::BIGINT) AS edited FROM n),
v AS (SELECT doc_id, 1 AS k, text AS t FROM e UNION ALL SELECT doc_id, 2, edited FROM e UNION ALL SELECT doc_id, 3, next_text FROM e),
ws AS (SELECT doc_id, k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM v),
hs AS (SELECT doc_id, k, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: substr(md5(array_to_string(w[i:i+4], ' ')), 1, 16))
                              WHEN len(w) > 0 THEN [substr(md5(array_to_string(w, ' ')), 1, 16)] ELSE []::VARCHAR[] END AS h FROM ws),
ks AS (SELECT doc_id, k, h, list_sort(list_distinct(list_filter(h, lambda x: x < '2'))) AS f FROM hs),
sk AS (SELECT doc_id, k, CASE WHEN len(f) > 0 THEN f WHEN len(h) > 0 THEN [list_min(h)] ELSE f END AS s FROM ks),
p AS (SELECT doc_id, any_value(s) FILTER (k = 1) AS a, any_value(s) FILTER (k = 2) AS b, any_value(s) FILTER (k = 3) AS c FROM sk GROUP BY doc_id)
SELECT e.doc_id, e.n_chars::BIGINT AS n_chars, sha256(e.edited) AS edited_sha256,
       array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END::DOUBLE AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0 ELSE len(list_intersect(a, c))::DOUBLE / len(list_distinct(list_concat(a, c))) END::DOUBLE AS near_next
FROM e JOIN p USING (doc_id)
"""
