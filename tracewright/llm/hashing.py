"""Words and shingles of many texts at once as 64-bit hashes, in numpy.

A batch's texts are laid end to end as bytes; prefix sums of ``byte * BASE^i``
(modulo 2^64, BASE odd and so invertible) give the hash of any word without a
Python loop over words.
"""

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_GAP = np.uint8(10)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def lowered(texts: list[bytes]) -> list[bytes]:
    """A-Z lower-cased, all else as it is."""
    return [t.lower() for t in texts]


#: Bytes of text that are hashed at a time (a longer text alone); about 100 bytes of memory each.
AT_ONCE = 1 << 20


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, the number of words of each text)."""
    parts, at, size = [], 0, 0
    for k, text in enumerate(texts):
        if k > at and size + len(text) > AT_ONCE:
            parts.append(_word_hashes(texts[at:k]))
            at, size = k, 0
        size += len(text) + 1
    parts.append(_word_hashes(texts[at:]))
    return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    if not len(sizes):
        return np.zeros(0, np.uint64), sizes
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~_BLANK[raw]
    edge = np.diff(solid.view(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = 1 << int(len(raw)).bit_length()
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE)[: len(raw)], dtype=np.uint64)])
        hashes = mix((sums[ends] - sums[starts]) * _powers(n, _INVERSE)[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum(sizes)
    counts = np.diff(np.searchsorted(starts, bounds), prepend=0)
    return hashes, counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, the text of each): runs of ``width`` words; a shorter text with a word is one shingle."""
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - starts[owner] if len(hashes) else owner
    whole = np.minimum(counts, width)
    keep = place <= counts[owner] - whole[owner]
    at = np.flatnonzero(keep)
    own = owner[at]
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = k < whole[own]
            word = hashes[np.minimum(at + k, len(hashes) - 1)] if len(hashes) else hashes
            out = np.where(inside, mix(out * np.uint64(0xD6E8FEB86659FD93) + word + np.uint64(k + 1)), out)
    return out, own


def counted(values: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) with counts, sorted by owner and value."""
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    if not len(values):
        return values, owners, np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])))
    return values[first], owners[first], np.diff(np.append(first, len(values)))
