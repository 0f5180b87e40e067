"""Vectorised work on the UTF-8 bytes of many texts at once.

Hashes of spans come from prefix sums S[i] = sum(T[b_j] * B^j) modulo 2^64: the
span [s, e) has hash mix((S[e] - S[s]) * B^-s), whatever stands around it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_K = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(salt) * U(1_000_003)) * U(_B))


_TABLE = seeds(256, 11)
_powers = [np.ones(1, U), np.ones(1, U)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i for i < n at least; kept in the process."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, b in enumerate((_B, pow(_B, -1, 1 << 64))):
            a = np.full(size, b, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def prefix(data: np.ndarray) -> np.ndarray:
    s = np.zeros(len(data) + 1, U)
    np.cumsum(_TABLE[data] * _pow(len(data) + 1)[0][: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
    inv = _pow(len(s))[1]
    return mix((s[hi] - s[lo]) * inv[lo] + (hi - lo).astype(U) * _K + U(salt))


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets from 0; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[off[0] : off[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(off: np.ndarray, limit: int = 1 << 20):
    """Row ranges [a, b) with about limit bytes each; a longer row stands alone."""
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b
        a = b


def _table(test) -> np.ndarray:
    return np.array([test(i) for i in range(256)])


_LOWER = _table(lambda i: i + 32 if 65 <= i <= 90 else i).astype(np.uint8)
#: Bytes of words of letters and digits, once A-Z is lower case.
ALNUM = _table(lambda i: 48 <= i <= 57 or 97 <= i <= 122 or i >= 128)
#: Bytes of words that white space ends.
SOLID = _table(lambda i: i != 32 and not 9 <= i <= 13)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(low: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words; none crosses from one row to the next."""
    w = kind[low]
    start, stop = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    stop[:-1] &= ~w[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(w))]
    start[cut] = w[cut]
    stop[cut - 1] = w[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def shingles(h: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words for each row, sorted by row and hash.

    A row of fewer words, but not none, has one: all its words.
    Returns the hashes and rows + 1 offsets.
    """
    c = seeds(k, 7) | U(1)
    n = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    out, of = [], []
    if len(h) >= k:
        ok = np.flatnonzero(row[: len(h) - k + 1] == row[k - 1 :])
        v = np.full(len(ok), U(k * int(_K) % 2**64))
        for j in range(k):
            v += h[ok + j] * c[j]
        out.append(mix(v))
        of.append(row[ok])
    for m in range(1, k):
        short = np.flatnonzero(n == m)
        if len(short):
            v = np.full(len(short), U(m * int(_K) % 2**64))
            for j in range(m):
                v += h[first[short] + j] * c[j]
            out.append(mix(v))
            of.append(short)
    if not out:
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    v, r = np.concatenate(out), np.concatenate(of)
    order = np.lexsort((v, r))
    v, r = v[order], r[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    v, r = v[new], r[new]
    return v, np.searchsorted(r, np.arange(rows + 1))


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals [lo, hi), as sorted disjoint ones; touching ones join."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:] - 1, len(lo) - 1)]
