"""Credentials in text are replaced by a marker; the name of a key, the user of an address stay."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "[REDACTED]"
# The shapes of credentials, in the order in which they are replaced.
SHAPES = (
    ("aws-access-key-id", r"\b(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b"),
    ("github-token", r"\bgh[pousr]_[A-Za-z0-9]{16,}\b"),
    ("slack-token", r"\bxox[abposr]-[A-Za-z0-9-]{10,}\b"),
    ("google-api-key", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("private-key-block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("bearer-token", r"\b([Bb]earer\s+)[A-Za-z0-9._~+/-]{16,}=*"),
    ("key-value-secret", r"(?i)\b((?:api[_-]?key|apikey|secret|passwd|password|token|access[_-]?key|private[_-]?key|client[_-]?secret|auth[_-]?token)\s*[:=]\s*)([\"']?)([^\s\"',;]{6,})\2"),
    ("credential-in-url", r"(?i)\b([a-z][a-z0-9+.-]*://)([^\s/:@]+):([^\s/@]+)@"),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{30,}\b"),
)
_KEPT = {"bearer-token": f"$1{MARK}", "key-value-secret": f"$1{MARK}", "credential-in-url": f"$1$2:{MARK}@"}


_ANY = "|".join(f"(?:{shape})" for _, shape in SHAPES if "\\2" not in shape)


def redact(text: Column) -> Column:
    """One pattern says whether there is anything to replace; few texts are gone through shape by shape."""
    pairs = dict(SHAPES)["key-value-secret"]
    return F.when(text.rlike(_ANY) | text.rlike(pairs), _redacted(text)).otherwise(text)


def _redacted(text: Column) -> Column:
    for name, shape in SHAPES:
        text = F.regexp_replace(text, shape, _KEPT.get(name, MARK))
    return text


def secret_kinds(text: Column) -> Column:
    """The names of the shapes found, comma-joined in their order."""
    return F.concat_ws(",", *[F.when(text.rlike(shape), name) for name, shape in SHAPES])


def excerpt(text: Column, longest: int = 240) -> Column:
    """White space flattened, redacted, and cut to ``longest`` code points with an ellipsis inside."""
    flat = redact(F.trim(F.regexp_replace(text, r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+", " ")))
    return F.when(F.length(flat) > longest, F.concat(F.substring(flat, 1, longest - 1), F.lit("…"))).otherwise(flat)
