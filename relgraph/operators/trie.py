"""A token trie over a dictionary of any size, walked by the texts.

A node is known by two 64-bit hashes of the words that lead to it. Phrases, with all that
lead to them, are dealt by hash into parts of at most about PART nodes. One part at a time is
sorted, sent to the tasks and walked by all texts, a batch of texts at once: every place
whose word is a node goes on to the next word. A text stays in its row with what it has met, so
neither texts nor n-grams are shuffled, and the work is linear in texts and matches for each part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.sources.scratch import discard, materialise

#: Nodes of a part, 17 bytes each.
PART = 4_000_000

_U = np.uint64
_STEPS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))
HITS = "array<struct<start:int,size:int,whole:boolean>>"
_HIT = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("whole", pa.bool_())])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row ends of a column of arrays of hashes."""
    ends = np.cumsum(np.asarray(col.value_lengths().fill_null(0), dtype=np.int64))
    return np.asarray(col.flatten()).view(np.uint64), ends


#: Words that are walked at a time: a batch of texts is cut, so that a task's memory does not grow with it.
WALK_WORDS = 1 << 18


def cut(batch: pa.RecordBatch, column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A batch in slices of rows whose lists in a column have at most ``most`` words together, or of one row."""
    most = most or WALK_WORDS
    ends = np.cumsum(np.asarray(batch.column(batch.schema.get_field_index(column)).value_lengths().fill_null(0), dtype=np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def _hashes(words):
    return F.transform(words, lambda w: F.xxhash64(w))


def _grown(h: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    return _mixed((h + t) * _STEPS[k])


def nodes(dictionary: DataFrame) -> tuple[DataFrame, int]:
    """(part, h, g, whole): the nodes of phrases (phrase), words joined by single spaces, and the number of parts."""
    words = dictionary.select("phrase").where(F.col("phrase") != "").distinct().select(F.xxhash64("phrase").alias("p"), _hashes(F.split("phrase", " ")).alias("w"))
    words = materialise(words, "trie-phrases")
    total = words.agg(F.coalesce(F.sum(F.size("w")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART))

    def run(batches):
        for b in batches:
            t, ends = _flat(b.column(1))
            n = np.diff(ends, prepend=0)
            begin, part = ends - n, np.asarray(b.column(0)).view(np.uint64) % _U(parts)
            h, g, rows, size = np.zeros(len(n), _U), np.zeros(len(n), _U), np.arange(len(n)), 0
            while len(rows):
                h, g = _grown(h, t[begin[rows] + size], 0), _grown(g, t[begin[rows] + size], 1)
                size += 1
                yield pa.RecordBatch.from_arrays([pa.array(part[rows].astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(n[rows] == size)], names=["part", "h", "g", "whole"])
                on = n[rows] > size
                rows, h, g = rows[on], h[on], g[on]

    found = words.mapInArrow(run, "part int, h long, g long, whole boolean")
    return materialise(found.groupBy("part", "h", "g").agg(F.max("whole").alias("whole")), "trie-nodes"), parts


class Part:
    """Nodes sorted by h, and flags of their first bits, so that most other words are passed by at once."""

    def __init__(self, h: np.ndarray, g: np.ndarray, whole: np.ndarray):
        self.h, self.g, self.whole = h, g, whole
        self.shift = _U(64 - max(10, int(len(h)).bit_length() + 3))
        self.flags = np.zeros(1 << (64 - int(self.shift)), bool)
        self.flags[self.h >> self.shift] = True

    def places(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The place of each node, -1 of what is none. Of two nodes with one h, g tells."""
        out = np.full(len(h), -1)
        likely = np.flatnonzero(self.flags[h >> self.shift])
        if not len(self.h) or not len(likely):
            return out
        at = np.searchsorted(self.h, h[likely])
        while len(likely):
            inside = at < len(self.h)
            likely, at = likely[inside], at[inside]
            same = self.h[at] == h[likely]
            likely, at = likely[same], at[same]
            met = self.g[at] == g[likely]
            out[likely[met]] = at[met]
            likely, at = likely[~met], at[~met] + 1
        return out

    def walk(self, t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, sizes and wholeness of phrases, and of the longest way into the trie, among words whose rows end at ``ends``."""
        stop = np.repeat(ends, np.diff(ends, prepend=0))
        where, h, g, size = np.arange(len(t)), np.zeros(len(t), _U), np.zeros(len(t), _U), 0
        out = []
        while len(where):
            inside = where + size < stop[where]
            if size and not inside.all():
                out.append((where[~inside], size, np.zeros((~inside).sum(), bool)))
            where, h, g = where[inside], h[inside], g[inside]
            h, g = _grown(h, t[where + size], 0), _grown(g, t[where + size], 1)
            at = self.places(h, g)
            met = at >= 0
            if size and not met.all():
                out.append((where[~met], size, np.zeros((~met).sum(), bool)))
            where, h, g, at, size = where[met], h[met], g[met], at[met], size + 1
            whole = self.whole[at]
            if whole.any():
                out.append((where[whole], size, np.ones(whole.sum(), bool)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate([o[0] for o in out]), np.concatenate([np.full(len(o[0]), o[1]) for o in out]), np.concatenate([o[2] for o in out])


def from_left(start: np.ndarray, step: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which of the steps, sorted by row and start, are taken if each goes on where it ends."""
    taken, now, at = np.zeros(len(start), bool), -1, 0
    for i, (r, s, n) in enumerate(zip(row.tolist(), start.tolist(), step.tolist(), strict=True)):
        if r != now:
            now, at = r, 0
        if s >= at:
            taken[i], at = True, s + n
    return taken


def _lists(n: int, row: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> pa.Array:
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    inner = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(whole)], fields=list(_HIT))
    return pa.ListArray.from_arrays(pa.array(offsets), inner)


def hits(tokens: DataFrame, dictionary: DataFrame, choose: str | None = None) -> DataFrame:
    """tokens (tokens, ...) with ``hits``, (start, size, whole) of each text's matches, sorted by start.

    choose: none gives all phrases at all places and, not whole, the longest way into the trie at a place; longest gives, from the left,
    the longest phrase at a place, and on after it; read gives, from the left, as (start, size) the longest phrase
    among the words that lead into the trie (size 0 if none), and on after those words.
    """
    trie, parts = nodes(dictionary)
    rows = tokens.withColumn("__t", _hashes("tokens"))
    names = [f.name for f in tokens.schema]
    spark = tokens.sparkSession
    table = None
    for k in range(parts):
        own = trie.where(F.col("part") == k).select("h", "g", "whole").toArrow()
        h, g, whole = (c.to_numpy() for c in own.columns)
        order = np.argsort(h.view(np.uint64))
        held = spark.sparkContext.broadcast((h.view(np.uint64)[order], g.view(np.uint64)[order], whole.astype(bool)[order]))
        last = k == parts - 1

        def run(batches: Iterator[pa.RecordBatch], held=held, last=last):
            part = Part(*held.value)
            for b in (x for whole in batches for x in cut(whole, "__t")):
                t, ends = _flat(b.column(b.schema.get_field_index("__t")))
                where, size, full = part.walk(t, ends)
                row = np.searchsorted(ends, where, "right")
                start = where - (ends - np.diff(ends, prepend=0))[row]
                if "hits" in b.schema.names:
                    old = b.column(b.schema.get_field_index("hits"))
                    n = np.asarray(old.value_lengths())
                    s, z, w = old.flatten().flatten()
                    row, start, size, full = np.concatenate([np.repeat(np.arange(len(n)), n), row]), np.concatenate([np.asarray(s), start]), np.concatenate([np.asarray(z), size]), np.concatenate([np.asarray(w), full])
                order = np.lexsort((size, start, row))
                row, start, size, full = row[order], start[order], size[order], full[order]
                if last and choose and len(row):
                    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (start[1:] != start[:-1])))
                    reach, take = np.maximum.reduceat(size, first), np.maximum.reduceat(np.where(full, size, 0), first)
                    row, start = row[first], start[first]
                    if choose == "longest":
                        some = take > 0
                        row, start, reach, take = row[some], start[some], take[some], take[some]
                    taken = from_left(start, reach, row)
                    row, start, size = row[taken], start[taken], take[taken]
                    full = size > 0
                out = [b.column(i) for i, name in enumerate(b.schema.names) if name in names or (not last and name == "__t")]
                yield pa.RecordBatch.from_arrays([*out, _lists(b.num_rows, row, start, size, full)], names=[*(n for n in b.schema.names if n in names or (not last and n == "__t")), "hits"])

        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names or (not last and f.name == "__t")]
        rows = rows.mapInArrow(run, ", ".join([*fields, f"hits {HITS}"]))
        if not last:  # one part at a time is in memory
            before, table = table, materialise(rows, "trie-walked")
            rows = table
            if before is not None:
                discard(before)
    return rows
