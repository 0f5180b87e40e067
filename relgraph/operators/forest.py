"""Many dependency trees at once: the tokens of a batch in flat arrays, walked together.

Every step moves all tokens or all rows that still have to move, so a batch takes as many steps as
its deepest tree is deep. Paths are known by numbers, made from that of the head's path and a label;
strings are made once for each path that occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Forest:
    """Trees of rows (head, dep); places of a row's tokens are global from here on."""

    def __init__(self, head: pa.Array, dep: pa.Array):
        self.n = np.asarray(head.value_lengths().fill_null(0), dtype=np.int64)
        self.begin = np.cumsum(self.n) - self.n
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.row)) - self.begin[self.row]
        self.head = np.asarray(head.flatten(), dtype=np.int64) + self.begin[self.row]
        labels = pc.dictionary_encode(dep.flatten())
        self.names: list[str] = labels.dictionary.to_pylist()
        self.dep = np.asarray(labels.indices, dtype=np.int64)
        self.root = self.head == np.arange(len(self.head))
        self.depth = self._depths()

    def label(self, name: str) -> int:
        return self.names.index(name) if name in self.names else -1

    def _depths(self) -> np.ndarray:
        """By doubling: after k rounds, up is the token 2^k above, or the root."""
        depth, up = (~self.root).astype(np.int64), self.head.copy()
        for _ in range(int(max(self.n, default=1)).bit_length()):
            depth, up = depth + depth[up], up[up]
        return depth

    def span_roots(self, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The highest token reached from the last one without leaving the span (TX8)."""
        at = end + self.begin[rows]
        low, high = start + self.begin[rows], at.copy()
        moving = np.arange(len(at))
        while len(moving):
            up = self.head[at[moving]]
            go = (up != at[moving]) & (low[moving] <= up) & (up <= high[moving])
            moving = moving[go]
            at[moving] = up[go]
        return at

    def whole(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows whose span is the compound that it belongs to (TX10, TX11, FI7)."""
        compound = self.dep == self.label("compound")
        last = np.minimum(end + self.begin, len(self.head) - 1) if len(self.head) else end
        right = (compound[last] & (self.head[last] > last)) if len(self.head) else np.zeros(len(end), bool)
        low, high = (start + self.begin)[self.row], (end + self.begin)[self.row]
        left = compound & (np.arange(len(self.head)) < low) & (low <= self.head) & (self.head <= high)
        out = ~right
        out[self.row[left]] = False
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lowest token above both, -1 in different trees."""
        a, b = a.copy(), b.copy()
        for x, y in ((a, b), (b, a)):
            moving = np.flatnonzero(self.depth[x] > self.depth[y])
            while len(moving):
                x[moving] = self.head[x[moving]]
                moving = moving[self.depth[x[moving]] > self.depth[y[moving]]]
        moving = np.flatnonzero((a != b) & ~self.root[a])
        while len(moving):
            a[moving], b[moving] = self.head[a[moving]], self.head[b[moving]]
            moving = moving[(a[moving] != b[moving]) & ~self.root[a[moving]]]
        return np.where(a == b, a, -1)

    def paths(self, rows: np.ndarray, one: tuple, two: tuple) -> tuple[list[list[str]], np.ndarray]:
        """Steps from span one to span two of each of the rows, and which tokens are on a branch (TX12, TX13). Spans (start, end)."""
        a, b = self.span_roots(*one, rows), self.span_roots(*two, rows)
        top = self.common(a, b)
        on = np.zeros(len(self.head), bool)
        joined = top >= 0
        on[top[joined]] = True
        for start, end in (one, two):
            size = np.where(joined, end - start + 1, 0)
            first = np.repeat(start + self.begin[rows] - (np.cumsum(size) - size), size)
            on[first + np.arange(len(first))] = True
        steps: list[list[str]] = [[] for _ in rows]
        for at, sign in ((a.copy(), "i_"), (b.copy(), "")):
            moving = np.flatnonzero(joined & (at != top))
            fall: list[tuple[int, str]] = []
            while len(moving):
                on[at[moving]] = True
                fall += [(k, sign + self.names[d]) for k, d in zip(moving.tolist(), self.dep[at[moving]].tolist(), strict=True)]
                at[moving] = self.head[at[moving]]
                moving = moving[at[moving] != top[moving]]
            for k, s in fall if sign else reversed(fall):
                steps[k].append(s)
        return steps, on

    def sub_paths(self, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[str, ...]]]:
        """(token, root on the branch, number of its path, paths): each token off the branch whose way up meets it, with the labels from there (TX16)."""
        root, number = np.full(len(on), -1), np.full(len(on), -1)
        found: list[tuple[str, ...]] = []
        off = np.flatnonzero(~on & ~self.root)
        first = off[on[self.head[off]]]
        level, above = first, np.zeros(len(first), np.int64)
        root[first] = self.head[first]
        while len(level):
            code, own = np.unique(above * len(self.names) + self.dep[level], return_inverse=True)
            number[level] = own + len(found)
            found += [(*(found[c // len(self.names) - 1] if c // len(self.names) else ()), self.names[c % len(self.names)]) for c in code.tolist()]
            waiting = off[number[off] < 0]
            level = waiting[number[self.head[waiting]] >= 0]
            above = number[self.head[level]] + 1
            root[level] = root[self.head[level]]
        met = np.flatnonzero(number >= 0)
        return met, root[met], number[met], found
