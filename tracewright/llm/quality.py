"""Quality rules as weak supervision.

Nine rules vote good (1), bad (-1) or abstain (0) on each document. Rows are
aggregated to the vote patterns that occur (at most 3^9, whatever the size of
the corpus), expectation-maximisation over the patterns estimates how often
each rule is right on good and on bad documents and the share of good ones, and
a document is kept if its posterior probability of being good is at least
``THRESHOLD``. Nothing has to pass every rule.

The estimate is one SQL expression over the array of patterns. Texts are read
once for the query: their statistics go to the shared folder as a narrow table.
``keep_good`` (the filter of the pipeline) reads them twice instead of storing
texts again; it moves no text at all.

Defined results: null or blank text has no words, fails the base rule and is
not kept; repeated rows are judged alike; an empty table gives an empty result;
extra columns are kept by ``keep_good`` and ignored by the query.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, table, words_of

#: Starting belief in each rule, and its weight in documents.
ACCURACY, STRENGTH = 0.85, 20.0
#: A rule is never believed less than better than chance, nor beyond doubt.
LOWEST, HIGHEST = 0.55, 0.99
PRIOR, PRIOR_LOW, PRIOR_HIGH = 0.8, 0.05, 0.95
ROUNDS = 25
THRESHOLD = 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_T = "__tw_quality"

#: name: (bad if, good if) over the statistics; neither: the rule abstains.
RULES = {
    "length": ("n_words < 50", "n_words >= 80"),
    "repetition": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words < 10 * n_words"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines < n_lines"),
    "symbols": ("10 * n_symbols > 3 * n_words", "20 * n_symbols < n_words"),
    "capitals": ("10 * n_upper > 4 * word_chars", "10 * n_upper < word_chars"),
    "shouting": ("10 * n_bangs > 3 * n_words", "50 * n_bangs < n_words"),
    "word_length": ("word_chars < 2 * n_words or word_chars > 15 * n_words", "word_chars >= 3 * n_words and word_chars <= 10 * n_words"),
    "letters": ("10 * n_plain < 6 * word_chars", "10 * n_plain > 8 * word_chars"),
    "variety": ("10 * n_distinct < n_words", "4 * n_distinct > n_words"),
}


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that occurs twice or more in the text."""
    n = F.size(words)
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(hs: Column) -> Column:
        # sorted by hash, a window is repeated if a neighbour has its hash
        placed = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(placed, lambda ps: F.filter(ps, lambda p, k: (F.get(ps, k - 1)["h"] == p["h"]) | (F.get(ps, k + 1)["h"] == p["h"])))
        starts = F.array_sort(F.transform(found, lambda p: p["i"]))
        # each window adds what the one before it doesn't cover
        added = let(starts, lambda ss: F.transform(ss, lambda s, k: F.when(k == 0, 3).otherwise(F.least(F.lit(3), s - F.get(ss, k - 1)))))
        total = F.aggregate(added, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(total)

    return let(hashes, covered)


def statistics(text: Column) -> Column:
    """What the rules look at, as one struct."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    counted = let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), repeat_words(ws).alias("r"), F.size(F.array_distinct(ws)).cast("long").alias("d")))
    lined = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), F.size(F.array_distinct(ls)).cast("long").alias("d")))
    solid = F.translate(text, BLANKS, "")

    def made(c: Column, ls: Column, body: Column) -> Column:
        return F.struct(
            c["n"].alias("n_words"),
            F.length(body).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (ls["n"] - ls["d"]).alias("n_dup_lines"),
            c["r"].alias("n_repeat_words"),
            c["d"].alias("n_distinct"),
            ls["n"].alias("n_lines"),
            (F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
            F.length(F.regexp_replace(body, r"[^!]+", "")).cast("long").alias("n_bangs"),
            F.length(F.regexp_replace(body, r"[^\p{L}]+", "")).cast("long").alias("n_plain"),
        )

    return let(solid, lambda body: let(counted, lambda c: let(lined, lambda ls: made(c, ls, body))))


def votes(stats: str) -> Column:
    """The rules' votes over the struct column named ``stats``."""
    import re

    def over(rule: str) -> str:
        return re.sub(r"\b(n_\w+|word_chars)\b", rf"{stats}.\1", rule)

    return F.expr("array(" + ", ".join(f"CASE WHEN {over(bad)} THEN -1 WHEN {over(good)} THEN 1 ELSE 0 END" for bad, good in RULES.values()) + ")")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def fit(voted: DataFrame) -> tuple[float, list[float], list[float]]:
    """(share of good, right on good, right on bad) from rows with an array ``v`` of votes.

    The estimate itself runs in SQL over the patterns' counts; three small values come back.
    """
    k = len(RULES)
    patterns = voted.groupBy("v").agg(F.count(F.lit(1)).cast("double").alias("c"))
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("ps"))
    start = f"named_struct('pi', {PRIOR}D, 'g', array_repeat({ACCURACY}D, {k}), 'b', array_repeat({ACCURACY}D, {k}))"
    logs = "aggregate(sequence(0, {k} - 1), ln(s.pi / (1 - s.pi)), (a, j) -> a + CASE p.v[j] WHEN 1 THEN ln(s.g[j] / (1 - s.b[j])) WHEN -1 THEN ln((1 - s.g[j]) / s.b[j]) ELSE 0D END)".format(k=k)
    weighed = f"transform(ps, p -> named_struct('v', p.v, 'q', p.c / (1 + exp(-({logs}))), 'c', p.c))"

    def rate(weight: str, vote: int) -> str:
        hit = f"aggregate(qs, {STRENGTH * ACCURACY}D, (a, x) -> a + CASE WHEN x.v[j] = {vote} THEN {weight} ELSE 0D END)"
        said = f"aggregate(qs, {STRENGTH}D, (a, x) -> a + CASE WHEN x.v[j] <> 0 THEN {weight} ELSE 0D END)"
        return f"transform(sequence(0, {k} - 1), j -> least({HIGHEST}D, greatest({LOWEST}D, {hit} / {said})))"

    share = f"least({PRIOR_HIGH}D, greatest({PRIOR_LOW}D, ({STRENGTH * PRIOR}D + aggregate(qs, 0D, (a, x) -> a + x.q)) / ({STRENGTH}D + aggregate(qs, 0D, (a, x) -> a + x.c))))"
    step = f"element_at(transform(array({weighed}), qs -> named_struct('pi', {share}, 'g', {rate('x.q', 1)}, 'b', {rate('(x.c - x.q)', -1)})), 1)"
    got = one.select(F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, round) -> {step})").alias("m")).first()["m"]
    return got["pi"], list(got["g"]), list(got["b"])


def posterior(v: Column, model: tuple[float, list[float], list[float]]) -> Column:
    """The probability that a document with the votes ``v`` is good."""
    import math

    pi, good, bad = model
    odds = F.lit(math.log(pi / (1 - pi)))
    for j, (g, b) in enumerate(zip(good, bad, strict=True)):
        odds = odds + F.when(v[j] == 1, math.log(g / (1 - b))).when(v[j] == -1, math.log((1 - g) / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, quality (posterior), kept."""
    narrow = docs.select("doc_id", statistics(F.col("text")).alias("s"))
    narrow = stored(narrow.select("doc_id", "s", votes("s").alias("v")), "quality")
    quality = posterior(F.col("v"), fit(narrow))
    failed = base_failed(F.col("s"))
    rows = narrow.select("doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", failed.alias("base_failed"), F.round(quality, 6).alias("quality"))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= THRESHOLD))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    stats = statistics(docs["text"])
    model = fit(docs.select(stats.alias("s")).select(votes("s").alias("v")))
    rows = docs.withColumn(_T, stats)
    rows = rows.where(~base_failed(F.col(_T)) & (F.round(posterior(votes(_T), model), 6) >= THRESHOLD))
    return rows.select(*docs.columns)


def op1_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    k = len(RULES)
    vote = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in RULES.values())

    def odds(v: str) -> str:
        return f"list_reduce(list_prepend(ln(pi / (1 - pi)), list_transform(range(1, {k + 1}), lambda j: CASE {v}[j] WHEN 1 THEN ln(g[j] / (1 - b[j])) WHEN -1 THEN ln((1 - g[j]) / b[j]) ELSE 0.0::DOUBLE END)), lambda a, x: a + x)"

    def rate(weight: str, sign: int) -> str:
        hit = f"list_sum(list_transform(qs, lambda x: CASE WHEN x.v[j] = {sign} THEN {weight} ELSE 0.0::DOUBLE END))"
        said = f"list_sum(list_transform(qs, lambda x: CASE WHEN x.v[j] <> 0 THEN {weight} ELSE 0.0::DOUBLE END))"
        return f"list_transform(range(1, {k + 1}), lambda j: least({HIGHEST}::DOUBLE, greatest({LOWEST}::DOUBLE, ({STRENGTH * ACCURACY}::DOUBLE + {hit}) / ({STRENGTH}::DOUBLE + {said}))))"

    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS body,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g3 AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i+1], w[i+2]) AS n FROM g3),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(body)::BIGINT AS word_chars,
      length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
      coalesce(r, 0)::BIGINT AS n_repeat_words, len(list_distinct(w))::BIGINT AS n_distinct, len(ls)::BIGINT AS n_lines,
      length(regexp_replace(body, '[^\p{{Lu}}]+', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(body, '[^!]+', '', 'g'))::BIGINT AS n_bangs,
      length(regexp_replace(body, '[^\p{{L}}]+', '', 'g'))::BIGINT AS n_plain FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
v AS (SELECT *, [{vote}] AS v FROM s),
pat AS (SELECT list({{'v': v, 'c': c}} ORDER BY v) AS ps FROM (SELECT v, count(*)::DOUBLE AS c FROM v GROUP BY v)),
em AS (SELECT 0 AS r, {PRIOR}::DOUBLE AS pi, list_transform(range({k}), lambda x: {ACCURACY}::DOUBLE) AS g, list_transform(range({k}), lambda x: {ACCURACY}::DOUBLE) AS b
  UNION ALL
  SELECT r + 1, least({PRIOR_HIGH}::DOUBLE, greatest({PRIOR_LOW}::DOUBLE, ({STRENGTH * PRIOR}::DOUBLE + list_sum(list_transform(qs, lambda x: x.q))) / ({STRENGTH}::DOUBLE + list_sum(list_transform(qs, lambda x: x.c))))),
         {rate('x.q', 1)}, {rate('(x.c - x.q)', -1)}
  FROM (SELECT r, list_transform(ps, lambda p: {{'v': p.v, 'c': p.c, 'q': p.c / (1 + exp(-({odds('p.v')})))}}) AS qs FROM em, pat WHERE r < {ROUNDS}) z),
m AS (SELECT pi, g, b FROM em WHERE r = {ROUNDS}),
j AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      round(1 / (1 + exp(-({odds('v.v')}))), 6) AS quality FROM v, m)
SELECT *, NOT base_failed AND quality >= {THRESHOLD} AS kept FROM j
"""


ORACLE = _oracle()
