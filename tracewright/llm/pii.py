"""Personal data: format-preserving Feistel pseudonyms.

Validated values (card numbers with a right check digit, IBANs, social security
and telephone numbers, IPv4 addresses, calendar dates, e-mail addresses,
secrets, named or of a known shape) are permuted by a keyed Feistel network within their own format: digits
stay digits, letters letters, separators stay, check digits are made right
again. The permutation is a bijection on each format, so equal values get equal
pseudonyms in every document and different values different ones.

A row is handled alone: no shuffle, nothing is remembered but a bounded cache.

Defined results: null text stays null with no finding, empty text stays empty;
whole texts are searched; where findings overlap the earlier kind in ``KINDS``
wins, then the longer one; cards may start and end at any group of a run of digits
(parts of a run that aren't grouped as cards are come after all kinds), IBANs end
at any group, so that what stands beside a number doesn't hide it; repeated rows
give equal results; an empty table
gives an empty result; other columns pass through untouched, and only ``text``
(and ``n_chars`` where there is one) changes; with ``report`` columns that are
called like its two columns are replaced by them. A dotted number after "version"
or "v" is no address; ten digits without separators are a telephone number only behind a word that
says so. An unquoted secret after a colon has a digit, or eight characters and a name that is a
password's, token's or API key's.

The key comes from the caller. The query takes ``spark.tracewright.pseudonym.key``
of the session or, where that is unset, draws a key for the run, so that pseudonyms
of different runs aren't linked.
"""

import bisect

import datetime
import hmac
import ipaddress
import re
import secrets
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, table, trimmed

KEY_NAME = "spark.tracewright.pseudonym.key"
ROUNDS = 8
#: Bytes of text that are rewritten at a time (a longer text alone).
BYTES_AT_ONCE = 4 << 20
#: Digits that one permutation takes at once.
LONGEST = 128
KINDS = ("email", "secret", "iban", "card", "ssn", "ip", "phone", "date")

_EMAIL_END = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NAME = r"(?:token|secret|passwd|password|passphrase|pwd|(?<![a-z])pass|credential|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|[_-]key)s?"
_NAMED = rf"(?i)(?<![a-z0-9])[a-z0-9_.-]{{0,40}}?{_NAME}[\"']?\s*"
_SURE = r"(?i)(?<![a-z0-9])[a-z0-9_.-]{0,40}?(?:token|passwd|password|passphrase|pwd|api[_-]?key)[\"']?\s*"
#: Words that say something about a password rather than being one.
_SAID = "required|optional|mandatory|necessary|invalid|incorrect|expired|forgotten|mismatch|disabled|enabled|changed|updated|protected|unknown|redacted|undefined"
_NAMES = ("token", "secret", "pass", "pwd", "credential", "key")
_SHAPES = ("gh[pousr]_", "github_pat_", "xox[abposr]-", "AIza", "npm_", "eyJ", "[rs]k_(?:live|test)_", "sk-(?:proj-|ant-)?", "glpat-", "hf_")
_SIGNS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "aiza", "npm_", "eyj", "k_live_", "k_test_", "sk-", "glpat-", "hf_")
#: Secrets as (what a text with one has in it in lower case, pattern whose last group is permuted, whether it is an upper-case key id).
_SECRETS = (
    (("private key-----",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----([\s\S]*?)-----END [A-Z ]*PRIVATE KEY-----"), False),
    (("akia", "asia", "abia", "acca"), re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ABIA|ACCA)([0-9A-Z]{16})(?![A-Za-z0-9])"), True),
    (_SIGNS, re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(_SHAPES)})([A-Za-z0-9_.-]{{16,}})"), False),
    (("bearer",), re.compile(r"(?<![A-Za-z0-9])[Bb]earer\s+([A-Za-z0-9._~+/-]{16,}=*)"), False),
    (("basic",), re.compile(r"(?i)authorization[\"']?\s*[:=]\s*[\"']?basic\s+([A-Za-z0-9+/]{6,}=*)"), False),
    (("://",), re.compile(r"(?i)(?<![a-z0-9])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]*:([^\s/@]+)@"), False),
    (_NAMES, re.compile(_NAMED + r"[:=]\s*(?:\"((?:[^\"\\\n]|\\.)+)\"|'((?:[^'\\\n]|\\.)+)')"), False),
    (_NAMES, re.compile(_NAMED + r"=\s*([^\s\"',;]{6,})"), False),
    (_NAMES, re.compile(_NAMED + r":\s*(?=[^\s\"',;\d]*\d)([^\s\"',;]{6,})"), False),
    (_NAMES, re.compile(_SURE + rf":\s*(?!(?:{_SAID})\b)([^\s\"',;]{{8,}})"), False),
)
_VERSION = re.compile(r"(?i)(?<![a-z])(?:v|ver|version|release)[.:=]?\s*\Z")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}|[a-z]{2}\d{2}(?:[ -]?[a-z0-9]){11,30}))")
_GROUP_END = re.compile(r"(?<=[A-Za-z0-9])(?![A-Za-z0-9])")
_CARD = re.compile(r"(?<!\d)\d(?:[ -]?\d){12,}")
_CARD_START = re.compile(r"[3-6]|2[2-7]")
_DIGITS = re.compile(r"\d+")
_SSN = re.compile(r"(?<![\d-])(?!000|666|9)(\d{3})([- ])(?!00)(\d\d)\2(?!0000)(\d{4})(?![\d-])")
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)")
_NANP = re.compile(r"(?<![\d+])(?:\+?1[ .-]?)?(?:\(([2-9]\d\d)\) ?|([2-9]\d\d)[ .-])([2-9]\d\d)[ .-](\d{4})(?!\d)")
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,39}(?![\w:])")
_CALLED = re.compile(r"(?i)(?<![a-z])(?:phone|tel|telephone|mobile|cell|call|fax|whatsapp|text)\W{0,3}(?:(?:number|no|me|us|at|is|on)\W{1,3}){0,3}([2-9]\d\d[2-9]\d{6})(?!\d)")
_WORLD = re.compile(r"(?<![\d+])\+(?!1[ .(-]?\(?[2-9]\d\d)[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)")
_DATE = re.compile(r"(?<![\d/.-])(?:(\d{4})([-/.])(\d\d?)\2(\d\d?)|(\d\d?)([-/.])(\d\d?)\6(\d{4}))(?![\d/-]|\.\d)")
_DIGIT = re.compile(r"\d")

_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permuted(value: int, size: int, tweak: bytes, key: bytes) -> int:
    """A keyed bijection of 0..size-1: a balanced Feistel network, walked until it stays inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, half // 8 + 1
    while True:
        left, right = value >> half, value & mask
        for k in range(ROUNDS):
            block = hmac.digest(key, b"%b|%d|%d|%b" % (tweak, size, k, right.to_bytes(width, "big")), "sha256")
            while len(block) < width:
                block += hmac.digest(key, block, "sha256")
            left, right = right, left ^ int.from_bytes(block[:width], "big") & mask
        value = left << half | right
        if value < size:
            return value


def permuted_digits(values: list[int], sizes: list[int], tweak: bytes, key: bytes) -> list[int]:
    """The same over a tuple of digits, each below its own size."""
    if len(values) > LONGEST:  # in parts, each with its place as a tweak: a bijection too, in linear time
        cut = range(0, len(values), LONGEST)
        return [d for k in cut for d in permuted_digits(values[k : k + LONGEST], sizes[k : k + LONGEST], b"%b|%d|%d" % (tweak, k, len(values)), key)]
    number, total = 0, 1
    for v, s in zip(values, sizes, strict=True):
        number, total = number * s + v, total * s
    number, out = permuted(number, total, tweak, key), []
    for s in reversed(sizes):
        number, v = divmod(number, s)
        out.append(v)
    return out[::-1]


def by_class(text: str, tweak: bytes, key: bytes) -> str:
    """Digits to digits and ASCII letters to letters of the same case; the rest stays."""
    at = [k for k, c in enumerate(text) if c.isascii() and c.isalnum()]
    digits = [ord(text[k]) - 48 if text[k].isdigit() else ord(text[k].lower()) - 97 for k in at]
    got = permuted_digits(digits, [10 if text[k].isdigit() else 26 for k in at], tweak, key)
    out = list(text)
    for k, v in zip(at, got, strict=True):
        out[k] = chr(48 + v) if text[k].isdigit() else chr((65 if text[k].isupper() else 97) + v)
    return "".join(out)


def refilled(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in pattern)


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn_digit(digits[:-1]) == digits[-1]


def card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"[ -]", "", value)
    if not _is_card(digits):
        return None
    body = digits[0] + "".join(map(str, permuted_digits([int(c) for c in digits[1:-1]], [10] * (len(digits) - 2), b"card" + digits[0].encode(), key)))
    return refilled(value, body + luhn_digit(body))


def _mod97(country: str, check: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + country + check)) % 97


def _is_iban(flat: str) -> bool:
    return 15 <= len(flat) <= 34 and _mod97(flat[:2], flat[2:4], flat[4:]) == 1


def iban(value: str, key: bytes) -> str | None:
    flat = re.sub("[ -]", "", value).upper()
    if not _is_iban(flat):
        return None
    body = by_class(flat[4:], b"iban" + flat[:2].encode(), key)
    new = flat[:2] + f"{98 - _mod97(flat[:2], '00', body):02d}" + body
    it = iter(new if value[0].isupper() else new.lower())
    return "".join(c if c in " -" else next(it) for c in value)


def ssn(value: str, key: bytes) -> str | None:
    m = _SSN.fullmatch(value)
    areas = [a for a in range(1, 900) if a != 666]
    got = permuted_digits([areas.index(int(m[1])), int(m[3]) - 1, int(m[4]) - 1], [len(areas), 99, 9999], b"ssn", key)
    return f"{areas[got[0]]:03d}{m[2]}{got[1] + 1:02d}{m[2]}{got[2] + 1:04d}"


def ip(value: str, key: bytes) -> str | None:
    return ".".join(map(str, permuted_digits([int(x) for x in value.split(".")], [256] * 4, b"ip", key)))


def ip6(value: str, key: bytes) -> str | None:
    """Hexadecimal digits to such digits, colons stay; fewer than three groups (``::1``, or names with a scope) are left."""
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return None
    digits = value.replace(":", "").lower()
    if len([g for g in value.split(":") if g]) < 3:
        return None
    it = iter(_within("0123456789abcdef", digits, b"ip6", key))
    new = "".join(c if c == ":" else next(it) for c in value)
    return new.upper() if value.isupper() else new


def phone(value: str, key: bytes) -> str | None:
    m = _NANP.fullmatch(value) or re.fullmatch(r"([2-9]\d\d)()([2-9]\d\d)(\d{4})", value)
    if not m:
        digits = re.sub(r"\D", "", value)
        if not 8 <= len(digits) <= 15:
            return None
        code = digits[: 1 if digits[0] in "17" else 2]  # the country code, or its beginning, stays
        rest = [int(c) for c in digits[len(code) :]]
        while True:  # walked on while it would read as a number of the other format
            rest = permuted_digits(rest, [10] * len(rest), b"phone" + code.encode(), key)
            new = refilled(value, code + "".join(map(str, rest)))
            if not _NANP.fullmatch(new):
                return new
    area = m[1] or m[2]
    got = permuted_digits([int(area) - 200, int(m[3]) - 200, int(m[4])], [800, 800, 10000], b"nanp", key)
    lead = re.sub(r"\D", "", value)[:-10]
    return refilled(value, f"{lead}{got[0] + 200}{got[1] + 200}{got[2]:04d}")


@lru_cache(maxsize=1)
def _late_days() -> tuple[list[int], dict[int, int]]:
    """The days after the twelfth of a month, in order, and their places."""
    days = [d for d in range(_FIRST_DAY, _LAST_DAY + 1) if datetime.date.fromordinal(d).day > 12]
    return days, {d: k for k, d in enumerate(days)}


def date(value: str, key: bytes) -> str | None:
    m = _DATE.fullmatch(value)
    parts = (m[1], m[3], m[4], m[2]) if m[1] else (m[8], m[5], m[7], m[6])
    year, a, b = map(int, parts[:3])
    day_first = not m[1] and (a > 12 or parts[3] == ".")
    try:
        day = datetime.date(year, b if day_first else a, a if day_first else b).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    if day_first and parts[3] != ".":
        days, place = _late_days()  # only these read as day first
        new = days[permuted(place[day], len(days), b"late", key)]
    else:
        new = _FIRST_DAY + permuted(day - _FIRST_DAY, _LAST_DAY - _FIRST_DAY + 1, b"date", key)
    got = datetime.date.fromordinal(new)
    wide = "02d" if max(len(parts[1]), len(parts[2])) == 2 else "d"
    x, y = (got.day, got.month) if day_first else (got.month, got.day)
    return parts[3].join([f"{got.year:04d}", f"{x:{wide}}", f"{y:{wide}}"] if m[1] else [f"{x:{wide}}", f"{y:{wide}}", f"{got.year:04d}"])


def email(value: str, key: bytes) -> str | None:
    local, _, host = value.rpartition("@")
    label, _, top = host.rpartition(".")
    return f"{by_class(local, b'local', key)}@{by_class(label, b'host', key)}.{top}"


def secret(value: str, key: bytes) -> str | None:
    if re.fullmatch(r"[0-9a-f]+", value):
        return _within("0123456789abcdef", value, b"hex", key)
    return by_class(value, b"secret", key)


def key_id(value: str, key: bytes) -> str | None:
    return _within("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", value, b"key", key)


def _within(letters: str, value: str, tweak: bytes, key: bytes) -> str:
    got = permuted_digits([letters.index(c) for c in value], [len(letters)] * len(value), tweak, key)
    return "".join(letters[v] for v in got)


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = _EMAIL_END.match(text, at + 1)
        if start < at and text[at - 1] != "." and end:
            yield start, end.end()
        last, at = at + 1, text.find("@", at + 1)


def _secrets(text: str):
    low = text.lower()
    for signs, pattern, upper in _SECRETS:
        if any(sign in low for sign in signs):
            for m in pattern.finditer(text):
                yield (*m.span(m.lastindex), key_id if upper else secret)


def _ibans(text: str):
    """(start, end) of the valid IBANs: from every start the longest that ends with a group."""
    for m in _IBAN.finditer(text):
        a, b = m.span(1)
        ends = [e.start() for e in _GROUP_END.finditer(text, a, min(b + 1, len(text))) if e.start() <= b]
        for end in reversed(ends):
            if _is_iban(re.sub("[ -]", "", text[a:end]).upper()):
                yield a, end
                break


def _cards(text: str):
    """(start, end, doubt) of the valid cards: all parts of a run of digit groups that start and end with a group.

    One part in ten has a right check digit by chance. Doubt is 0 for parts grouped as
    cards are and with first digits of cards, 1 for whole runs, 2 for other parts
    grouped so, 3 for the rest.
    """
    for m in _CARD.finditer(text):
        groups = [g.span() for g in _DIGITS.finditer(text, *m.span())]
        if re.search(r"\d\.\Z", text[max(0, m.start() - 2) : m.start()]):
            groups = groups[1:]  # decimals
        for k, (start, _) in enumerate(groups):
            digits, sizes = "", []
            for a, b in groups[k : k + 19]:
                digits += text[a:b]
                sizes.append(b - a)
                if len(digits) > 19:
                    break
                if _is_card(digits):
                    usual = len(sizes) == 1 or sizes in ([4, 6, 4], [4, 6, 5]) or (set(sizes[:-1]) == {4} and sizes[-1] <= 4)
                    yield start, b, 0 if usual and _CARD_START.match(digits) else 1 if len(sizes) == len(groups) else 2 if usual else 3


def found(text: str) -> list[tuple[float, int, int, str, Callable]]:
    """Candidates as (rank, start, end, kind, pseudonym function), whole text; all but IBANs and cards not yet validated."""
    order = {k: float(n) for n, k in enumerate(KINDS)}
    out = [(order["email"], a, b, "email", email) for a, b in _emails(text)] if "@" in text else []
    out += [(order["secret"], a, b, "secret", make) for a, b, make in _secrets(text)]
    if _DIGIT.search(text):
        out += [(order["iban"], a, b, "iban", iban) for a, b in _ibans(text)]
        out += [(order["card"] + doubt / 4 if doubt < 3 else float(len(KINDS)), a, b, "card", card) for a, b, doubt in _cards(text)]
        for kind, pattern, make in (("ssn", _SSN, ssn), ("ip", _IP, ip), ("phone", _NANP, phone), ("phone", _WORLD, phone), ("date", _DATE, date)):
            out += [(order[kind], *m.span(), kind, make) for m in pattern.finditer(text) if kind != "ip" or not _VERSION.search(text, max(0, m.start() - 12), m.start())]
        out += [(order["phone"], *m.span(1), "phone", phone) for m in _CALLED.finditer(text)]
    if text.count(":") > 1:
        out += [(order["ip"], *m.span(), "ip", ip6) for m in _IP6.finditer(text)]
    return out


class Pseudonyms:
    def __init__(self, key: bytes):
        self.make = lru_cache(maxsize=100_000)(lambda make, value: make(value, key))

    def rewrite(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and what was replaced as (start, end, kind) in the old text."""
        taken: list[tuple[int, int, str, str]] = []  # in order, apart from each other
        for _, a, b, kind, make in sorted(found(text), key=lambda x: (x[0], x[1] - x[2], x[1])):
            at = bisect.bisect_left(taken, (a, b))
            if at and taken[at - 1][1] > a or at < len(taken) and taken[at][0] < b:
                continue
            new = self.make(make, text[a:b])
            if new is not None:
                taken.insert(at, (a, b, kind, new))
        if not taken:
            return text, []
        out, last = [], 0
        for a, b, _, new in taken:
            out += [text[last:a], new]
            last = b
        return "".join(out) + text[last:], [(a, b, kind) for a, b, kind, _ in taken]


@lru_cache(maxsize=4)
def _loaded(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def key_of(spark) -> bytes:
    """The key that the session names, or one drawn for this run."""
    named = spark.conf.get(KEY_NAME, None)
    return named.encode() if named else secrets.token_bytes(32)


def pseudonymise(df: DataFrame, key: bytes, report: bool = False) -> DataFrame:
    """``df`` with rewritten ``text`` (and ``n_chars``); with ``report`` also n_found and kinds."""
    from pyspark.sql.types import StructType

    if len(key) < 16:
        raise ValueError("a key has at least 16 bytes")
    if report:
        df = df.drop("n_found", "kinds")
    names, counted = df.columns, "n_chars" in df.columns
    extra = StructType.fromDDL("n_found bigint, kinds string") if report else StructType([])
    schema = StructType([*df.schema.fields, *extra.fields])

    def work(batches):
        pseudonyms = _loaded(key)
        for batch in (part for whole in trimmed(batches) for part in sliced(whole, ["text"], whole.num_rows, BYTES_AT_ONCE)):
            texts = batch.column("text").to_pylist()
            done = [(None, []) if t is None else pseudonyms.rewrite(t) for t in texts]
            new = {"text": pa.array([t for t, _ in done], batch.schema.field("text").type)}
            columns = [new.get(n, batch.column(n)) for n in names]
            if report:
                columns += [pa.array([len(f) for _, f in done], pa.int64()), pa.array([",".join(sorted({k for _, _, k in f})) for _, f in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *extra.names])

    out = df.mapInArrow(work, schema)
    # formats keep their length, but for addresses and dates written without leading zeros
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(df.schema["n_chars"].dataType))) if counted else out


def op5_pseudonyms(spark, sf_dir):
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark), report=True)
