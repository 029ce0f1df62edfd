"""Whitening, hard negatives and main texts against plain Python over the same small tables, and their hard cases."""

import math
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import html, negatives, queries, warc, whitening

SF = "/root/testdata/sf0.001"
ROWS = "vec_id bigint, embedding array<float>, label int, n int, component string, x string, list int, chunk string"
#: Extra columns of clashing names.
CLASH = (7, "c", "x", 3, "k")


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, label, *CLASH) for i, v, label in rows], ROWS)


# Whitening


def by_numpy(rows):
    """(n, vec_id -> deviation, covariance's eigenvalues, sorted rows of |whitened|) of (vec_id, vector) rows."""
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows])
    n, sums = len(x), x.sum(axis=0)
    away = (n * x - sums).astype(object)
    cov = np.cov(x.T, bias=True).reshape(x.shape[1], x.shape[1])
    values, vectors = np.linalg.eigh(cov)
    return n, [int((a * a).sum()) for a in away], values[::-1], (x - x.mean(axis=0)) @ vectors[:, ::-1]


def test_whitening_by_numpy(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    n, deviations, values, projected = by_numpy(rows)
    got = queries.queries()["op11_whitening"](spark, SF).orderBy("vec_id", "component").collect()
    assert len(got) == 8 * n and {r["n"] for r in got} == {n} and [r["vec_id"] for r in got[::8]] == [i for i, _ in rows]
    assert [r["deviation"] for r in got[::8]] == deviations and [r["deviation_digits"] for r in got[::8]] == [str(d) for d in deviations]
    assert np.allclose([r["explained"] for r in got[:8]], values[:8] / values.sum(), rtol=1e-9)
    white = np.array([r["whitened"] for r in got]).reshape(n, 8)
    want = projected[:, :8] / np.sqrt(values[:8])
    assert np.abs(white - want * np.sign((white * want).sum(axis=0))).max() < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_merged_states_are_those_of_all_rows():
    x = np.random.default_rng(1).integers(99_000, 101_000, (500, 6))
    whole, parts = whitening.state_of(x), [whitening.state_of(p) for p in np.split(x, [1, 2, 90, 400])]
    for order in (parts, parts[::-1]):
        n, sums, mean, scatter = order[0]
        for p in order[1:]:
            n, sums, mean, scatter = whitening.merge((n, sums, mean, scatter), p)
        assert (n, sums) == whole[:2] and np.allclose(mean, whole[2], rtol=1e-13) and np.allclose(scatter, whole[3], rtol=1e-10)


def test_whitening_of_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    fine = [(1, [0.5, 0.25, 1.0]), (2, [0.1, -0.3, 1.0]), (2, [0.1, -0.3, 1.0]), (None, [-0.7, 0.9, 1.0]), (5, [0.0, 0.5, 1.0])]
    bad = [(6, None), (7, [nan, 0.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [None, 0.0, 0.0]), (10, [1.0, 2.0]), (11, []), (12, [-inf, 1.0, 1.0]), (13, [2.0**41, 1.0, 1.0])]
    got = whitening.whiten(embeddings(spark, [(i, v, 1) for i, v in fine + bad])).collect()
    n, deviations, values, _ = by_numpy(fine)
    assert Counter(r["vec_id"] for r in got) == {1: 3, 2: 6, None: 3, 5: 3} and {r["n"] for r in got} == {n}
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviations)
    assert all(r["whitened"] == 0 and r["explained"] == pytest.approx(0, abs=1e-12) for r in got if r["component"] == 3)  # the third entry never varies
    assert got[0]["identity_error"] < 1e-9 and {r["component"]: r["eigenvalue"] for r in got}[1] == pytest.approx(values[0])


def test_whitening_of_one_row_of_none_and_of_large_deviations(spark):
    (a, b) = whitening.whiten(embeddings(spark, [(1, [0.5, 0.25], 1)])).orderBy("component").collect()
    assert (a["n"], a["deviation"], a["whitened"], a["explained"], a["identity_error"], b["component"]) == (1, 0, 0.0, 0.0, 0.0, 2)
    for rows in ([], [(1, None, 1)], [(1, [], 1)]):
        assert whitening.whiten(embeddings(spark, rows)).collect() == []
    far = whitening.whiten(embeddings(spark, [(1, [2.0**39], 1), (2, [-(2.0**39)], 1)])).collect()
    exact = (2 * (2**49 + 100_000) - 200_000) ** 2
    assert [(r["deviation"], r["deviation_digits"]) for r in far] == [(None, str(exact))] * 2 and abs(far[0]["whitened"]) == pytest.approx(1)


# Hard negatives


def by_brute_force(rows, every=50):
    """(anchor, positive, rank, negative, positive's score, negative's score) of (vec_id, vector, label) rows."""
    x = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows]
    out, seen = [], set()
    for i, a, label in sorted(x, key=lambda r: (r[0], r[2], r[1])):
        if i % every or i in seen:
            continue
        seen.add(i)
        scored = sorted(((sum(p * q for p, q in zip(a, b, strict=True)), j, other) for j, b, other in x if j != i), key=lambda r: (-r[0], r[1]))
        for score, j, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score]
            out += [(i, j, k, b, score, s) for k, (s, b, _) in enumerate(fits[:3], 1)]
    return sorted(out)


def mined(df, every=50):
    return sorted(tuple(r) for r in negatives.mine(negatives.usable(df, F.col("label")), every).collect())


def test_negatives_of_hard_rows(spark):
    nan = float("nan")
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, 0.3, 3)], int(rng.integers(3))) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1], i % 3) for i in range(40)]  # ties
    rows += [(50, [0.5, 0.5, 0.5], 2), (7, [0.5, 0.1, 0.5], 1), (7, [0.5, 0.1, 0.5], 1), (-50, [0.1, 0.2, 0.3], 0), (250, [0.0, 0.0, 0.0], 0)]
    bad = [(300, None, 1), (350, [nan, 0.0, 0.0], 1), (400, [0.1, None, 0.2], 1), (450, [0.1, 0.2, 0.3], None), (None, [0.1, 0.2, 0.3], 1), (500, [0.1], 1), (550, [float("inf"), 0.0, 0.0], 1)]
    want = by_brute_force(rows, 10)
    assert len(want) > 50 and mined(embeddings(spark, rows + bad), 10) == want


def test_negatives_with_small_blocks_waves_and_wide_numbers(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("CHUNK", 2), ("FIRST", 1), ("WAVE", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (6, 4))
    for size in (1.0, 64.0, 2.0**17):  # products in short and long floats and in longs
        rows = [(i, [float(np.float32(c)) for c in (centres[i % 6] + rng.normal(0, 0.05, 4)) * size], int(i % 4)) for i in range(150)]
        assert mined(embeddings(spark, rows), 10) == by_brute_force(rows, 10)
    assert [negatives.exact_kind(n) for n in (2.0**23, 2.0**30, 2.0**60)] == [np.float32, np.float64, np.int64]


def test_lists_far_from_an_anchor_are_not_visited(spark):
    """Bounds rule out lists: two tight groups far apart, and the best of the near one already known."""
    near, far = [[1.0, 0.0]] * 6, [[-1.0, 0.0]] * 6
    schema = "chunk int, anchor_id bigint, label bigint, x array<bigint>, lows array<bigint>, highs array<bigint>, scores array<array<bigint>>, found array<array<bigint>>"
    anchors = spark.createDataFrame([(0, 0, 1, [256, 0], [-(2**62)], [2**62], [[65536] * 5], [[1, 2, 3, 4, 5]])], schema)
    centroids = np.array([near[0], far[0]]) * 256
    wanted = negatives.wants(anchors, centroids, np.zeros(2), [1, 1], 5, 0, 2, np.float32).collect()
    assert [(r["list"], r["block"]) for r in wanted] == [(0, 0)]
    window = anchors.withColumns({"lows": F.expr("array(-70000L)"), "highs": F.expr("array(-60000L)"), "scores": F.expr("array(cast(array() as array<bigint>))")})
    assert [r["list"] for r in negatives.wants(window, centroids, np.zeros(2), [1, 1], 3, 0, 2, np.float32).collect()] == [1]


def test_best_of_a_chunk_are_told_without_a_group_of_all_its_hits(spark):
    """Hits of all blocks meet in a window that spills; the next wave asks for no less than the kth score."""
    schema = "chunk int, anchor_id bigint, label bigint, x array<bigint>, lows array<bigint>, highs array<bigint>, scores array<array<bigint>>, found array<array<bigint>>"
    states = spark.createDataFrame([(0, 50, 1, [9, 0], [-5, 0], [99, 3], [[7], []], [[4], []]), (0, 100, 1, [9, 1], [-5], [99], [[]], [[]])], schema)
    hits = spark.createDataFrame([(50, 0, k % 9, 1000 - k) for k in range(900)], "anchor_id bigint, place int, score bigint, vec_id bigint")
    kept = negatives.kept(states, hits, 2)
    assert "CoGroup" not in kept._jdf.queryExecution().toString()
    got = {r["anchor_id"]: (r["scores"], r["found"]) for r in kept.collect()}
    assert got == {50: ([[8, 8], []], [[1000 - 899, 1000 - 890], []]), 100: ([[]], [[]])}
    sent = negatives.wants(kept, np.array([[9.0, 0.0]]), np.ones(1), [1], 2, 0, 1, np.float32).collect()
    assert [np.frombuffer(r["lows"], np.int64).reshape(2, -1).min(axis=1).tolist() for r in sent] == [[0, -5]]
    assert {np.frombuffer(r["lows"], np.int64).max() for r in sent} == {np.iinfo(np.int64).max}
    assert 8 in np.frombuffer(sent[0]["lows"], np.int64)


def test_neither_the_whole_table_nor_what_anchors_want_goes_through_the_driver(spark, monkeypatch):
    for name, value in {"SAMPLE": 50, "SLICE": 7, "FIRST": 2, "BLOCK": 8}.items():
        monkeypatch.setattr(negatives, name, value)
    values = np.random.default_rng(5).integers(-9, 9, (2000, 3))
    df = spark.createDataFrame([(k, k % 3, [float(v) for v in row]) for k, row in enumerate(values)], "vec_id bigint, label int, embedding array<float>").repartition(16)
    rows = negatives.usable(df, F.col("label"))
    sample = negatives.sample_of(rows, 2000)
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(50)
    assert sample.inputFiles() and sorted(r["x"] for r in sample.collect()) == sorted(r["x"] for r in first.collect())
    x, centres = values.astype(float), np.array([[0.0, 0.0, 0.0], [5.0, 5.0, 5.0], [-5.0, 1.0, 0.0]])
    assert (negatives.nearest(x, centres) == ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)).all() and negatives.nearest(x[:0], centres).size == 0
    plans = []
    monkeypatch.setattr(negatives, "scored", lambda pairs, *a, f=negatives.scored: plans.append(pairs._jdf.queryExecution().executedPlan().toString()) or f(pairs, *a))
    negatives.mine(rows, 100).collect()
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_negatives_of_empty_tables(spark):
    for rows in ([], [(1, None, 1)], [(50, [0.5], 1)], [(50, [0.5], 1), (51, [0.5], 2)], [(3, [0.5], 1), (4, [0.5], 1)]):
        assert mined(embeddings(spark, rows)) == []


# Main texts


class Reader(HTMLParser):
    """Another reading of the same pages: blocks of h1 and p inside article."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks, self.now = False, [], ""
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        self.blocks += [" ".join(self.now.split())] if self.on and self.now.split() else []
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "p", "article"):
            self.cut()
        self.now += " " if tag == "br" else ""
        self.on = self.on or tag == "article"

    def handle_endtag(self, tag):
        if tag in ("h1", "p", "article"):
            self.cut()
        self.on = self.on and tag != "article"

    def handle_data(self, data):
        self.now += data


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("most", [html.BROADCAST, 0], ids=["broadcast", "joined"])
def test_main_texts_by_another_parser(spark, monkeypatch, sf, most):
    monkeypatch.setattr(html, "BROADCAST", most)
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '/root/testdata/{sf}/pages.parquet'").fetchall()
    want = {i: (url, "\n\n".join(Reader(page).blocks)) for i, url, page in pages}
    got = queries.queries()["op13_main_text"](spark, f"/root/testdata/{sf}").collect()
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def site(n, body, host="a.example"):
    return [(k, f"http://{host}/p/{k}", f"<html><head><title>Site {k}</title></head><body>{body(k)}</body></html>") for k in range(n)]


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, host string, token int")
    return {r["page_id"]: r["text"] for r in html.extract(df).collect()}


def own(k):
    return f"Story {k} of {k * 7} words", f"Tell me about {k * 13} and {k}."


def test_page_without_article_gets_what_fills_its_largest_slot(spark):
    def body(k):
        a, b = own(k)
        return (
            f"<div id=top><p>All the news, every day.</p></div><div class='x1'><h1>{a}</h1><p>{b}</p><p>By the desk of the paper.</p><ul><li>first of {k}<li>second of {k}</ul></div>"
            f"<div class=x2><p><a href=/{k}>More on {k}</a> <a href=/y{k}>and {k}</a></p></div><div class=cookie-notice>We use {k} cookies</div><div class=x3>Printed daily.</div>"
        )

    got = texts(spark, site(9, body))
    assert got == {k: "\n\n".join([*own(k), f"first of {k}", f"second of {k}"]) for k in range(9)}


def test_what_is_no_article(spark):
    def body(k):
        a, b = own(k)
        return (
            f"<header>Paper {k}</header><nav>Home {k}</nav><aside>Also {k}</aside><div class=newsletter-signup>Sign {k}</div><form>Mail {k}<input></form><main><article><header><div><h1>{a}</h1></div><p>by {k}</p></header>"
            f"<script>x = '</p>{k}';</script><p>{b}<span class='ad'>Buy {k}</span><p hidden>no {k}</p><div role=alert>Notice {k}</div><figure><figcaption>Seen {k}</figcaption></figure><p>Follow us.</p><div class=post-share>Share {k}</div><footer>end {k}</footer></article>"
            f"<section id=comments><article class=comment><p>Nice {k}</p></article></section></main><footer>&copy; {k}</footer>"
        )

    got = texts(spark, site(9, body))
    assert got == {k: "\n\n".join([*own(k), f"Seen {k}"]) for k in range(9)}
    few = texts(spark, site(5, body))  # too few pages to be sure that a line in the article is the template's
    assert few == {k: "\n\n".join([*own(k), f"Seen {k}", "Follow us."]) for k in range(5)}


def test_hints_on_what_holds_all_of_a_page_do_not_empty_it(spark):
    got = texts(spark, site(4, lambda k: f"<div class='with-sidebar'><article><p>Whole {k} text</p></article><aside>no {k}</aside></div>"))
    assert got == {k: f"Whole {k} text" for k in range(4)}


def test_hard_pages(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    rows = [
        (1, None, "<article>a&amp;b &lt;c&gt; &#233;&nbsp;x<br>y<b>z</b>w\n\t q</article>"), (2, "u", None), (3, "u", ""), (4, "u", "no markup"), (5, "http://h/", "<article><p>cut <b>off"), (6, "http://h/", "<p>a<table><tr><td>b<td>c</table>d</p>e"),
        (7, "http://h/x", deep), (8, "http://h/x", "<article>" + "<p>long words</p>" * 20_000 + "</article>"), (8, "http://h/x", "<article>again</article>"), (9, "x", "<article><p>a<!-- <p>no</p> -->b<![CDATA[no]]>c</article"), (10, "x", "<article title='a>b'>t</article>"),
        (11, "x", "<nav>only</nav>"), (12, "x", "<style>p{}</style><script>never closed <p>x</p>"), (None, "x", "<article>1 < 2 & 3 > 2</article>"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(df).collect()), key=repr)
    long = "\n\n".join(["long words"] * 20_000)
    want = [
        (0, "1 < 2 & 3 > 2"), (1, "a&b <c> é x yzw q"), (2, ""), (3, ""), (4, "no markup"), (5, "cut off"), (6, "a\n\nb\n\nc\n\nd\n\ne"), (7, "deep"), (8, long), (8, "again"), (9, "abc"), (10, "t"), (11, ""), (12, ""),
    ]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=repr)
    assert html.extract(df.where("false")).collect() == []


def test_classes_are_the_tokens_of_equal_occurrence_vectors(spark):
    """Vectors counted page by page in plain Python, on one host, with a part that only some pages have and copies of pages."""
    def body(k):
        return f"<div class=a><p>fixed</p></div><ul>{'<li>x' * (k % 4 + 1)}</ul>" + ("<div class=b><i>some</i></div>" if k % 3 else "") + f"<article><p>own {k}</p></article>"

    pages = site(12, body)
    pages += [(100, *pages[1][1:]), (101, *pages[1][1:])]
    vectors = defaultdict(lambda: [0] * len(pages))
    for at, (_, _, page) in enumerate(pages):
        parsed = html.parse(page)
        for token, n in [*parsed.elements.items(), *Counter(b.token for b in parsed.blocks).items()]:
            vectors[html.signed(token)][at] += n
    content = [page for _, _, page in pages]
    want = defaultdict(set)
    for token, v in vectors.items():
        if sum(x > 0 for x in v) * 2 >= len(pages) and len({c for c, x in zip(content, v, strict=True) if x}) >= html.PAGES:
            want[tuple(v)].add(token)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = html.templates(df).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["class_id"]].add(r["token"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) == 3
    label = {r["label"]: r for r in sorted(rows, key=lambda r: r["class_id"]) if r["label"]}
    whole = label["body."]["class_id"]
    assert label["ul."]["class_id"] == label["div.a"]["class_id"] == whole and label["div.b"]["class_id"] != whole != label["li."]["class_id"]
    assert label["div.b"]["parent_class"] == label["li."]["parent_class"] == whole and not any(r["constant"] and r["words"] for r in rows)


def test_a_payload_is_hashed_once_and_not_once_a_digit(spark):
    rows = spark.createDataFrame([("",), ("<p>é</p>" * 9,), (None,)], "html string").select("html", warc.digest(F.col("html")).alias("d"))
    assert [r.d for r in rows.collect()] == [None if r.html is None else warc.sha1_base32(r.html.encode()) for r in rows.collect()]
    assert rows._jdf.queryExecution().analyzed().toString().lower().count("sha1(") == 1
