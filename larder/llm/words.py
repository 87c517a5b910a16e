"""Vectorised words of many texts: bytes in, 64-bit word hashes out, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np

#: The white space that separates words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Characters handled at once; a longer text is handled alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values, the same in every process."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_PLAIN = stream(11, 256)
_LOWER = _PLAIN.copy()
_LOWER[ord("A") : ord("Z") + 1] = _PLAIN[ord("a") : ord("z") + 1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the hash's base and of its inverse."""
    return _powers(1 << max(16, int(n - 1).bit_length()))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Words(NamedTuple):
    """hashes: of all words in order; first: index of each text's first word, and one past the last."""

    hashes: np.ndarray
    first: np.ndarray
    buffer: bytes
    starts: np.ndarray
    ends: np.ndarray


def words_of(texts: list[bytes], lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; lower folds A-Z only. Equal words have equal hashes everywhere."""
    data = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(data, np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    space = SPACE[buf]
    turn = np.flatnonzero(space[1:] != space[:-1]) + 1
    turn = np.concatenate([[0], turn]) if not space[0] else turn
    starts, ends = turn[0::2], turn[1::2]
    power, inverse = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _PLAIN)[buf] * power[: len(buf)], dtype=np.uint64, out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, offsets), data, starts, ends)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; as many as there are words, less n - 1 (none if fewer)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    factors = stream(1000 + n, n) | np.uint64(1)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        out += hashes[i : len(hashes) - n + 1 + i] * factors[i]
    return mix(out)


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit values for a whole sequence of words."""
    n = np.uint64(len(hashes))
    k = np.arange(1, len(hashes) + 1, dtype=np.uint64)
    return tuple(int(mix(np.array([(mix(hashes + k * f).sum(dtype=np.uint64)) + n]))[0].astype(np.int64)) for f in stream(77, 2) | np.uint64(1))


def chunked(rows: Iterable[tuple], at: int, limit: int = CHUNK) -> Iterator[list[tuple]]:
    """Lists of rows whose texts (position ``at``) add up to about limit."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[at] or "")
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some
