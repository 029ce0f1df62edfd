"""Main text of web pages: what is left in the slots of a template that is deduced per host.

Tokens are elements (an element stands for its start and its end tag) and runs of
text. A token's role is its chain of enclosing elements, each with its name,
class and id (digits masked) and the element before it, so tokens of
one role come in one order and nest as their elements do. A token's occurrence vector (how often each
page of a host has it) is carried as additive sums: pages, occurrences, two
sums of 32 bits of page hashes. Tokens with equal vectors form an equivalence class. A class
is valid if it is on at least PAGES pages of different content and on half of the host's pages,
and if its outermost tokens stand in an element of a valid class; valid classes nest
into the template. Text tokens of valid classes are constants: the template's
own words. All other text fills the slots, and the main text is what fills slots of the article.

All sums are pre-aggregated where the pages are read, so a host with a third of all pages
sends one row per token and task. Only tokens that may belong to a template meet by host.
Pages are parsed twice: for the sums, and once the templates are known. Templates of
at most BROADCAST tokens together are broadcast, larger ones join by host.

What a page's main text is:

* blocks of its ``article`` and ``main`` elements (``role=main`` and ``itemprop=articleBody`` too); without
  any, of the element that holds most words directly on the host's pages (of the page itself where its host has no template);
* without anything in navigation, header (its headings stay where it is the article's), footer, sidebar, form, script, style and the like
  by name, role or a word of its class or id (``HINTS``), without hidden elements, and without blocks that are mostly links
  (outside articles);
* without constants: outside articles those of every valid class, inside only those on all pages of a host with SURE
  pages of different content or more, as a line may well be common to a few articles.

Defined results: null and empty html give an empty text, a page without main text
too; null urls are one host; equal pages count as one page of different
content; repeated ids and rows are kept; a cut-off tag or an unclosed element ends with the page; extra columns are left out. White space is what
Unicode calls so, no-break space included; a line break (``br``) is white space.
"""

import html as references
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Pages of different content that a class needs, and those that make a constant inside an article sure.
PAGES, SURE = 3, 8
#: Tokens of all templates together up to which they are broadcast (8 bytes each).
BROADCAST = 1_000_000
#: Share of a block's characters in links from which on it is a menu.
LINKED = 0.6

_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_WORD = re.compile(r"[a-z]+")
_TELLING = re.compile(r"class|id|role|style|hidden|itemprop", re.I)

# Elements of HTML by their role in its parsing.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: What a start tag closes if it is open inside the nearest of the elements beside it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Elements that never hold main text, roles of the same kind, and words of a class or id that say so.
OUT = {"head", "nav", "header", "footer", "aside", "form", "noscript", "template", "svg", "math", "canvas", "object", "audio", "video", "button", "select", "dialog", "menu", *RAW}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form", "status"}
HINTS = {
    "ad", "ads", "adslot", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "dialog", "footer", "footnav", "gdpr", "hidden", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion", "reactions", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidenav", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
#: Elements that end the reach of an open paragraph, and those whose text belongs to what holds them.
SCOPES = {"table", "td", "th", "caption", "button", "object", "template"}
TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "figcaption", "caption", "address", "td", "th"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


def scramble(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


@lru_cache(maxsize=20_000)
def role_of(label: str, before: str, parent: int) -> int:
    return scramble(f"{label}\0{before}", parent)


@dataclass(slots=True)
class Element:
    """An open element: its role, whether text in it is out, whether it is (in) an article, its own or next enclosing block, the depth of an open paragraph."""

    name: str
    role: int
    out: bool
    article: bool
    inline: bool
    header: bool
    link: bool
    block: "Element | None" = None
    above: "Element | None" = None
    paragraph: int = 0
    last: str = ""


@dataclass(slots=True)
class Block:
    """A run of text up to the next start or end of a block element."""

    text: str
    token: int
    holder: int
    slot: int
    article: bool
    title: bool
    linked: int


@dataclass
class Page:
    elements: Counter = field(default_factory=Counter)
    parents: dict = field(default_factory=dict)
    labels: dict = field(default_factory=dict)
    blocks: list = field(default_factory=list)


@lru_cache(maxsize=20_000)
def looked_at(name: str, attributes: str, hints: bool) -> tuple[str, bool, bool]:
    """(the label in roles, whether it is out by itself, whether it is an article) of a start tag."""
    found: dict[str, str] = {}
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), a or b or c)
    named = references.unescape(f"{found.get('class', '')} {found.get('id', '')}")
    words = set(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()))
    role = found.get("role", "").lower()
    article = name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody"
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()))
    hinted = words & HINTS or ("header" in words and not words & {"article", "post", "entry", "story", "content"})
    out = name in OUT or role in ROLES or hidden or (hints and name not in ("html", "body", "main") and bool(hinted))
    return f"{name}.{re.sub(r'[0-9]+', '#', ' '.join(named.split()))}", out, article


def parse(page: str, hints: bool = True) -> Page:
    """The elements (by role, with their parents) and blocks of a page; ``hints``: whether words of a class or id put an element out."""
    done = Page()
    root = Element("", 0, False, False, False, False, False)
    root.block = root.above = root
    stack, is_open = [root], Counter()
    pieces: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                top = stack[-1]
                own = top.block
                slot = own.above if own.name in TEXTS else own  # a paragraph's text fills the slot of what holds the paragraph
                done.blocks.append(Block(text, scramble(text, own.role), own.role, slot.role, top.article, own.name == "h1", linked))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if text and not top.out:
            pieces.append(text)
            if top.link:
                linked += len(text.strip())

    def close(depth: int) -> None:
        if any(not e.inline for e in stack[depth:]):
            flush()
        for e in stack[depth:]:
            is_open[e.name] -= 1
        del stack[depth:]

    def within(names: set[str], stop: set[str]) -> int:
        """The depth of the outermost open element of these names above the nearest of ``stop``, or 0."""
        depth = 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in stop:
                break
            if stack[k].name in names:
                depth = k
        return depth

    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "br":
                say(" ")
            elif name == "p" and not is_open[name]:
                flush()
            elif is_open[name]:
                inline = name in INLINE
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        close(k)
                        break
                    if inline and not stack[k].inline:
                        break
            continue
        inline = name in INLINE
        if not inline and stack[-1].paragraph:
            close(stack[-1].paragraph)
        if name in CLOSES and any(is_open[x] for x in CLOSES[name][0]) and (k := within(*CLOSES[name])):
            close(k)
        if name in HEADINGS and stack[-1].name in HEADINGS:
            close(len(stack) - 1)
        if name in VOID:
            if name == "br":
                say(" ")
            elif not inline:
                flush()
            continue
        if not inline:
            flush()
        top = stack[-1]
        label, out, article = looked_at(name, m[3] if m[3] and _TELLING.search(m[3]) else "", hints)
        heads = top.header and name in HEADINGS  # the headings of an article's own header
        header = not top.out and name == "header" and top.article or top.header and not out
        out = (top.out and name != "main" or out) and not heads
        e = Element(name, top.role if inline else role_of(label, top.block.last, top.role), out, top.article or article, inline, header, top.link or name == "a")
        e.block, e.above = (top.block, top.above) if inline else (e, top.block)
        e.paragraph = len(stack) if name == "p" else 0 if name in SCOPES else top.paragraph
        if not inline:
            top.block.last = label
            done.elements[e.role] += 1
            done.parents[e.role], done.labels[e.role] = top.role, label
        stack.append(e)
        is_open[name] += 1
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
    say(page[at:])
    flush()
    return done


_LONG = (1 << 64) - 1
#: Bits of a lane: sums fit in a long up to 2^31 occurrences of a token on a host.
LANE = (1 << 32) - 1
_PARTIAL = "host bigint, token bigint, pages bigint, occurrences bigint, lane1 bigint, lane2 bigint, spread bigint, words bigint, parent bigint, constant boolean, label string"


def signed(x: int) -> int:
    x &= _LONG
    return x - (1 << 64) if x >> 63 else x


def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each host's tokens with sums over the pages of a batch: parts of occurrence vectors. Token 0 is the page itself."""
    for batch in batches:
        sums: dict = defaultdict(lambda: [0, 0, 0, 0, 0, 0])
        what: dict = {}
        for host, text in zip(batch["host"], batch["html"], strict=True):
            if not text:
                continue
            page, digest = parse(text), scramble(text)
            words, counts = Counter(), Counter(page.elements)
            for b in page.blocks:
                counts[b.token] += 1
                words[b.slot] += len(b.text.split()) if b.linked < LINKED * len(b.text) else 0
                what[host, b.token] = (b.holder, True, None)
            for token in page.elements:
                what[host, token] = (page.parents[token], False, page.labels[token])
            counts[0], what[host, 0] = 1, (0, False, None)
            lanes, bit = (digest >> 32, digest & LANE), 1 << digest % 64
            for token, n in counts.items():
                s = sums[host, token]
                s[0] += 1
                s[1] += n
                s[2] += lanes[0] * n
                s[3] += lanes[1] * n
                s[4] |= bit
                s[5] += words[token]
        rows = [(host, signed(token), *s[:4], signed(s[4]), s[5], signed(what[host, token][0]), *what[host, token][1:]) for (host, token), s in sums.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["host", "token", "pages", "occurrences", "lane1", "lane2", "spread", "words", "parent", "constant", "label"])


def nested(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Classes of one host's tokens, those that nest, and their place in the template."""
    rows = rows.sort_values(["pages", "occurrences", "lane1", "lane2", "token"], ascending=[False, False, True, True, True]).reset_index(drop=True)
    rows["class_id"] = rows.groupby(["pages", "occurrences", "lane1", "lane2"], sort=False).ngroup()
    own = dict(zip(rows["token"], rows["class_id"], strict=True))
    above = {c: {own.get(p) for p in part["parent"]} - {c} for c, part in rows.groupby("class_id")}
    valid, before = set(above), -1
    while len(valid) != before:
        before = len(valid)
        valid = {c for c in valid if above[c] <= valid}
    rows["parent_class"] = rows["class_id"].map({c: max(above[c], default=c) for c in valid}).astype("Int64")  # of several the one on fewest pages
    rows = rows[rows["parent_class"].notna() & (rows["token"] != 0)]
    return rows[["host", "class_id", "parent_class", "token", "parent", "pages", "occurrences", "spread", "words", "total", "constant", "label"]].astype({"parent_class": "int64"})


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the host (as a hash; null urls are one host)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", "url", "html", F.xxhash64(host).alias("host"))


def templates(pages: DataFrame) -> DataFrame:
    """The tokens of each host's template with their classes, and the class that each class nests in.

    host, class_id, parent_class, token, parent, pages and occurrences (of the vector), spread
    (a set of at most 64 bits of page contents), words (directly in an element), total (pages of the host), constant (text), label.
    """
    sums = with_host(pages).select("host", "html").mapInPandas(partial, _PARTIAL)
    own = [F.sum(c).alias(c) for c in ("pages", "occurrences", "lane1", "lane2", "words")]
    sums = sums.groupBy("host", "token").agg(*own, F.bit_or("spread").alias("spread"), F.min("parent").alias("parent"), F.min("constant").alias("constant"), F.min("label").alias("label"))
    sums = stored(sums.where(F.bit_count("spread") >= PAGES), "tokens")
    totals = sums.where("token = 0").select("host", F.col("pages").alias("total"))
    return (
        sums.join(totals, "host").where("2 * pages >= total").groupBy("host")
        .applyInPandas(nested, "host bigint, class_id bigint, parent_class bigint, token bigint, parent bigint, pages bigint, occurrences bigint, spread bigint, words bigint, total bigint, constant boolean, label string")
    )


def packed(template: DataFrame) -> DataFrame:
    """A row per host: its constants, those that hold inside articles too, and the element with most words."""
    sure = F.col("constant") & (F.col("pages") == F.col("total")) & (F.col("occurrences") == F.col("total")) & (F.bit_count("spread") >= SURE)
    return template.groupBy("host").agg(
        F.collect_set(F.when(F.col("constant"), F.col("token"))).alias("constants"), F.collect_set(F.when(sure, F.col("token"))).alias("sure"),
        F.coalesce(F.max_by("token", F.when(~F.col("constant") & (F.col("words") > 0), F.struct("words", "token"))), F.lit(0)).alias("main"),
    )


def main_text(page: str, constants: frozenset[int], sure: frozenset[int], main: int) -> str:
    """The blocks of the page's main slots."""
    for hints in (True, False):  # without the words of classes and ids where they leave nothing
        parsed = parse(page, hints)
        blocks = [b for b in parsed.blocks if b.article and signed(b.token) not in sure] or loose(parsed, constants, main)
        if blocks:
            break
    return "\n\n".join(b.text for b in blocks)


def loose(page: Page, constants: frozenset[int], main: int) -> list[Block]:
    """The main blocks of a page that marks no article: those of the template's largest slot, or else the page's."""
    left = [b for b in page.blocks if signed(b.token) not in constants and b.linked < LINKED * len(b.text)]
    inside: dict[int, set[int]] = {}  # what encloses each slot, itself included
    words: Counter = Counter()
    for b in left:
        words[b.slot] += len(b.text.split())
        up = b.slot
        if up not in inside:
            own = inside[up] = {signed(up), 0}  # the page itself is 0
            while up := page.parents.get(up, 0):
                own.add(signed(up))
    chosen = main if main and any(main in x for x in inside.values()) else signed(max(words, key=lambda k: (words[k], k), default=0))
    found = [b for b in left if chosen in inside[b.slot]]
    title = [] if any(b.title for b in found) else [b for b in left if b.title][:1]
    return title + found


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = stored(packed(templates(pages)), "templates")
    size = found.agg(F.sum(F.size("constants") + F.size("sure") + 4)).first()[0] or 0
    pages = with_host(pages).join(F.broadcast(found) if size <= BROADCAST else found, "host", "left")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known: dict = {}
            texts = []
            for host, page, constants, sure, main in zip(*(batch[c] for c in ("host", "html", "constants", "sure", "main")), strict=True):
                if host not in known:
                    known[host] = (frozenset(), frozenset(), 0) if constants is None else (frozenset(map(int, constants)), frozenset(map(int, sure)), int(main))
                texts.append(main_text(page, *known[host]) if page else "")
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html", "host", "constants", "sure", "main").mapInPandas(part, f"page_id {kind}, url string, text string, n_chars bigint")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
