"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items go into one automaton. Training words stream
through it, and the longest suffix of what was read that occurs in any item is
tracked. Where it reaches a window (``window`` words, or the whole of a shorter
item), the words of that window are hit. Before that, word pairs that no item
holds cut the stream: no match can cross them, so only the stretches between
them that are long enough for a window are streamed.

Defined cases: null or empty text has no words and no hits; an item without
words matches nothing; a null item id counts as the empty string; repeated ids
of items count once; repeated documents are judged each on its own; an empty
table of items leaves every document clean; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgraph.llm import textbytes as tb
from relgraph.llm.runtime import materialise

#: Words of items in one automaton; more items make more automata, each in a pass of its own.
BLOCK_WORDS = 200_000

ANNOTATED = "n_words long, hits array<long>, items array<string>, longest long"


class Automaton:
    """Generalised suffix automaton of word sequences, with the items at each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, words in items if words]
        rows = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in items if words]
        for row in rows:
            last = 0
            for c in row:
                last = self._extend(last, c)
        self.whole: list[list[tuple[int, int]]] = [[] for _ in self.link]
        self.holds: list[set[int]] = [set() for _ in self.link]
        self.shortest = min((min(len(r), window) for r in rows), default=0)
        for k, row in enumerate(rows):
            state = 0
            for c in row:
                state = self.next[state][c]
                if len(row) >= window:  # the items of a state are those of the states that link to it
                    up = state
                    while up > 0 and self.length[up] >= window and k not in self.holds[up]:
                        self.holds[up].add(k)
                        up = self.link[up]
            if len(row) < window:
                self.whole[self._of(state, len(row))].append((len(row), k))
        h = tb.prefix(np.frombuffer(b"".join(self.ids), np.uint8))
        ends = np.cumsum([len(w) for w in self.ids]) if self.ids else np.zeros(0, np.int64)
        own = tb.span_hash(h, ends - [len(w) for w in self.ids], ends) if self.ids else np.zeros(0, np.uint64)
        self.vocabulary = np.sort(own)
        pairs = {(a, b) for row in rows for a, b in zip(row, row[1:], strict=False)}
        a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        self.pairs = np.unique(_pair(own[a], own[b])) if pairs else np.zeros(0, np.uint64)

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of exactly length[p] + 1 words that p reaches by c."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def _of(self, state: int, k: int) -> int:
        """The state that the last k words have."""
        while self.length[self.link[state]] >= k:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit intervals, items and the longest match of a stretch of words."""
        state = matched = longest = 0
        spans, items = [], set()
        for i, w in enumerate(words):
            c = self.ids.get(w, -1)
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            longest = max(longest, matched)
            if matched >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                items |= self.holds[self._of(state, self.window)]
            up = state
            while up > 0:
                for k, item in self.whole[up]:
                    if matched >= k:
                        spans.append((i + 1 - k, i + 1))
                        items.add(item)
                up = self.link[up]
        return spans, items, longest

    def scan(self, data: np.ndarray, off: np.ndarray):
        """For each text: words, hit intervals (flat, disjoint), item names, longest match."""
        low = tb.lower(data)
        for a, b in tb.pieces(off):
            part, o = low[off[a] : off[b]], off[a : b + 1] - off[a]
            s, e, row = tb.words(part, o, tb.ALNUM)
            count = np.bincount(row, minlength=b - a)
            first = np.concatenate(([0], np.cumsum(count)))
            found: dict[int, tuple[list, set, int]] = {}
            for lo, hi in zip(*self._stretches(part, s, e, row), strict=True):
                spans, items, longest = self.stream([part[s[i] : e[i]].tobytes() for i in range(lo, hi)])
                if spans:
                    got = found.setdefault(int(row[lo]), ([], set(), 0))
                    got[0].extend((lo + x - first[row[lo]], lo + y - first[row[lo]]) for x, y in spans)
                    found[int(row[lo])] = (got[0], got[1] | items, max(got[2], longest))
            for r in range(b - a):
                spans, items, longest = found.get(r, ([], set(), 0))
                yield int(count[r]), spans, {self.names[k] for k in items}, longest

    def _stretches(self, part, s, e, row):
        if not self.shortest or not len(s):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = tb.span_hash(tb.prefix(part), s, e)
        known = _in(h, self.vocabulary)
        joined = np.zeros(len(h), bool)  # with the word before
        joined[1:] = known[1:] & known[:-1] & (row[1:] == row[:-1])
        at = np.flatnonzero(joined)
        joined[at] = _in(_pair(h[at - 1], h[at]), self.pairs)
        lo = np.flatnonzero(known & ~joined)
        after = np.append(joined[1:], False)
        hi = np.flatnonzero(known & ~after) + 1
        keep = hi - lo >= self.shortest
        return lo[keep], hi[keep]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return tb.mix(a * np.uint64(3) + b * np.uint64(0x9E3779B97F4A7C15))


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _blocks(items: DataFrame, item_id: str, item_text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as words, in blocks; the driver holds one block at a time."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.coalesce(F.col(item_text), F.lit("")))
    block, size = [], 0
    for name, text in rows.toLocalIterator(prefetchPartitions=False):
        raw = np.frombuffer(text.encode(), np.uint8)
        low = tb.lower(raw)
        s, e, _ = tb.words(low, np.array([0, len(low)]), tb.ALNUM)
        block.append((name, [low[a:b].tobytes() for a, b in zip(s, e, strict=True)]))
        size += len(s)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def annotate(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, a struct column ``decontam`` of ANNOTATED added after its columns.

    ``hits`` holds the disjoint intervals of hit words, flat: start, end, start,
    end ... One narrow pass over docs for each block of items; what the passes
    before the last found is written with docs, so each Python worker holds one
    automaton at a time. A column of docs named ``decontam`` is replaced.
    """
    spark = docs.sparkSession
    kept = docs.drop("decontam")
    place = kept.columns.index(text_col)
    kind = T._parse_datatype_string(ANNOTATED)
    schema = T.StructType([*kept.schema.fields, T.StructField("decontam", kind)])
    out, held = kept, None
    blocks = _blocks(items, item_id, item_text, block_words)
    for block in _peek(blocks):
        first = held is None
        if held is not None:
            out = materialise(out, "decontam-block")
            held.destroy()
        held = spark.sparkContext.broadcast(Automaton(block, window))

        def run(batches, held=held, fresh=first):
            auto = held.value
            for batch in batches:
                before = None if fresh else batch.column(batch.num_columns - 1).to_pylist()
                rows = []
                for k, (n, spans, items, longest) in enumerate(auto.scan(*tb.strings(batch.column(place)))):
                    if before:
                        old = before[k]
                        spans = [*spans, *zip(old["hits"][::2], old["hits"][1::2], strict=True)]
                        items, longest = items | set(old["items"]), max(longest, old["longest"])
                    lo, hi = tb.merged(*(np.array([p[i] for p in spans], np.int64) for i in (0, 1)))
                    rows.append({"n_words": n, "hits": np.column_stack((lo, hi)).ravel().tolist(), "items": sorted(items), "longest": longest})
                kept = batch.columns if fresh else batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, ARROW)], names=[*batch.schema.names[: len(kept)], "decontam"])

        out = out.mapInArrow(run, schema)
    return out


ARROW = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def _peek(blocks: Iterator) -> Iterator:
    """The blocks, or a single empty one."""
    any_ = False
    for b in blocks:
        any_ = True
        yield b
    if not any_:
        yield []


def remove(docs: DataFrame, items: DataFrame, *, text_col: str = "text", max_coverage: float = 0.8, min_span: int = 1, **more) -> DataFrame:
    """docs without their hit spans of min_span words and more.

    A document of which more than max_coverage of the words are hit goes as a
    whole. Columns stay as they are; n_chars, if there, is counted again.
    """
    marked = annotate(docs, items, text_col=text_col, **more)
    place, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for batch in batches:
            marks = batch.column(batch.num_columns - 1).to_pylist()
            texts = batch.column(place)
            new, keep = [], []
            for k, m in enumerate(marks):
                lo, hi = np.array(m["hits"][::2], np.int64), np.array(m["hits"][1::2], np.int64)
                if not len(lo):
                    new.append(texts[k].as_py())
                    keep.append(True)
                    continue
                keep.append((hi - lo).sum() <= max_coverage * m["n_words"])
                new.append(_cut(texts[k].as_py(), lo, hi, min_span))
            cols = [*batch.columns[:-1]]
            cols[place] = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    out = marked.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def _cut(text: str, lo: np.ndarray, hi: np.ndarray, min_span: int) -> str:
    raw = text.encode()
    low = tb.lower(np.frombuffer(raw, np.uint8))
    s, e, _ = tb.words(low, np.array([0, len(low)]), tb.ALNUM)
    out, at = [], 0
    for a, b in zip(lo, hi, strict=True):
        if b - a >= min_span:
            out.append(raw[at : s[a]])
            at = e[b - 1]
    return b"".join([*out, raw[at:]]).decode()
