"""Vectorised word and character n-gram hashing over whole batches of texts.

Texts are lower-cased, joined into one code-point array and hashed with prefix
sums of a polynomial modulo 2**64, so no Python code runs per word. Words are
maximal runs of letters and digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_state: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def is_alnum(cp: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter or digit."""
    if "alnum" not in _state:
        _state["alnum"] = np.array([chr(i).isalnum() for i in range(0x10000)])
    out = _state["alnum"][np.minimum(cp, 0xFFFF)]
    if len(cp) and cp.max() > 0xFFFF:
        high = cp > 0xFFFF
        u, inv = np.unique(cp[high], return_inverse=True)
        out[high] = np.array([chr(i).isalnum() for i in u.tolist()])[inv]
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_state.get("pow", ())) < n + 1:
        size = max(n + 1, 1 << 20)
        a = np.full(size, _BASE, dtype=np.uint64)
        b = np.full(size, _INV, dtype=np.uint64)
        a[0] = b[0] = 1
        _state["pow"], _state["inv"] = np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)
    return _state["pow"][: n + 1], _state["inv"][: n + 1]


def slices(lengths: list[int], budget: int = 1_000_000, rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``budget`` characters and ``rows`` rows; one text is never cut."""
    a = total = 0
    for i, n in enumerate(lengths):
        if i > a and (total + n > budget or i - a >= rows):
            yield a, i
            a, total = i, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts joined by line feeds, and the start of each text in them."""
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate([[0], np.cumsum(lens + 1)])
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cp, starts


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, start, end) of every word of the lower-cased texts; offsets count from the joined start."""
    cp, starts = code_points([t.lower() for t in texts])
    ok = is_alnum(cp)
    edge = np.flatnonzero(ok[1:] != ok[:-1]) + 1
    if len(ok) and ok[0]:
        edge = np.concatenate([[0], edge])
    s, e = edge[0::2], edge[1::2]  # the joined text ends with a line feed, so runs always close
    up, down = _powers(len(cp))
    p = np.concatenate([[_U(0)], np.cumsum(mix(cp.astype(np.uint64) + _U(0x51ED27)) * up[: len(cp)], dtype=np.uint64)])
    h = mix((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64))
    doc = np.searchsorted(starts, s, side="right") - 1
    return h, doc, s, e


def sequence_keys(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the word sequence of each of n texts; ``h`` and ``doc`` are those of ``words``."""
    start = np.searchsorted(doc, np.arange(n + 1))
    up, down = _powers(len(h))
    out = []
    for salt in (0x0F1E2D3C4B5A6978, 0x7A6B5C4D3E2F1A0B):
        p = np.concatenate([[_U(0)], np.cumsum(mix(h + _U(salt)) * up[: len(h)], dtype=np.uint64)])
        out.append(mix((p[start[1:]] - p[start[:-1]]) * down[start[:-1]] + (start[1:] - start[:-1]).astype(np.uint64) + _U(salt)).view(np.int64))
    return out[0], out[1]


def shingles_of_words(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every sequence of ``k`` neighbouring words, repeats included."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - k + 1
    out = np.zeros(m, np.uint64)
    for i in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + h[i : i + m]
    same = doc[:m] == doc[k - 1 :]
    return mix(out[same]), doc[:m][same]


def shingles(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    h, doc, _, _ = words(texts)
    return shingles_of_words(h, doc, k)


def char_grams(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the ``k``-grams of every word, each word padded by a blank on both sides: word order leaves no trace."""
    cp, starts = code_points([" " + " ".join(t.lower().split()) + " " for t in texts])
    if len(cp) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(cp) - k + 1
    out, inner = np.zeros(m, np.uint64), np.zeros(m, bool)
    for i in range(k):
        c = cp[i : i + m]
        out = out * _U(0xD6E8FEB86659FD93) + mix(c.astype(np.uint64) + _U(7))
        inner |= (c == 10) | ((c == 32) & (0 < i < k - 1))
    at = np.flatnonzero(~inner)
    return mix(out[at]), np.searchsorted(starts, at, side="right") - 1


def distinct(x: np.ndarray) -> np.ndarray:
    """Different values in order; ``x`` itself is sorted. (Many times faster than a hash table for 64-bit keys.)"""
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def distinct_by_doc(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (48-bit hash, text index), ordered by text; at most 65,536 texts."""
    key = distinct((doc.astype(np.uint64) << _U(48)) | (h >> _U(16)))
    return key & _U((1 << 48) - 1), (key >> _U(48)).astype(np.int64)
