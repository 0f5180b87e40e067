"""Removal of repeated byte strings with longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document of a smaller id, or earlier in its own.

No machine can hold the suffixes of the whole corpus, so windows (the strings of
``length`` bytes) are sharded by content first. Each window belongs to its
anchor, the 32 bytes in it with the least hash; equal windows have equal anchors,
so the shard of an anchor sees all of them. What a shard gets of a document is a
stretch: the bytes of neighbouring windows with one anchor, about 134 bytes for
every 35 of text.

1. One scan sends anchor and stretch hashes. Of equal stretches all but the first
   are repeats; most copies end here, many before the shuffle.
2. Only where one anchor has different stretches, the first of each comes with its
   bytes. Those without a window whose hash comes again in the shard repeat nothing;
   a suffix array over the shard's other stretches in corpus order, its common prefixes, and the previous and next smaller positions in suffix order give the
   longest previous factor of each position: length or more marks a repeat.
3. Anchors with more than HOT different stretches are split by single windows.
   Slots of anchors with far more stretches than others are found first; theirs meet
   by stretch, not by anchor, so no task gets all of one anchor.

Hashes decide equality of stretches (128 bits) and, for hot anchors, windows.

Defined cases: null text is empty; a text shorter than ``length`` keeps all;
documents of one id and text are one document, each row with its result;
documents of one id and other texts follow the hash of the text; null ids come
first; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relgraph.llm import textbytes as tb
from relgraph.llm.runtime import discard, materialise

LENGTH, GRAM = 100, 32
#: Window starts worked on at a time, bytes of one suffix array, different stretches of one anchor.
TILE, CHUNK, HOT = 1 << 20, 1 << 20, 4096
#: Rows of spans (24 bytes each) that may go to every task instead of shuffling texts.
BROADCAST_ROWS = 400_000


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive keys, by running minima of blocks."""
    n = len(key) - width + 1
    pad = -len(key) % width
    blocks = np.concatenate((key, np.full(pad, ~np.uint64(0)))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def stretches(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchor hash, stretch hash, row, start and end (bytes of the row) of all stretches."""
    out = [[np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64)]
    for a, b in tb.pieces(off, TILE):
        for start in range(int(off[a]), int(off[b]), TILE):  # more than one only for a long text
            stop = min(int(off[b]), start + TILE + length - 1)
            part, o = data[start:stop], np.clip(off[a : b + 1] - start, 0, stop - start)
            got = _stretches(part, o, length, min(gram, length))
            if got is not None:
                anchor, name, row, lo, hi = got
                base = start - off[a + row]
                for x, y in zip(out, (anchor, name, row + a, lo + base, hi + base), strict=True):
                    x.append(y)
            if stop == off[b]:
                break
    return tuple(np.concatenate(x) for x in out)


def _stretches(part, o, length, gram):
    n = len(part)
    if n < length:
        return None
    ok = np.ones(n - length + 1, bool)  # starts of windows inside one text
    cut = np.zeros(n + 1, np.int64)
    np.add.at(cut, o[1:-1], 1)
    inside = np.cumsum(cut)
    ok = inside[: n - length + 1] == inside[length - 1 : n]
    at = np.flatnonzero(ok)
    if not len(at):
        return None
    s = tb.prefix(part)
    i = np.arange(n - gram + 1)
    h = tb.span_hash(s, i, i + gram)
    key = (h & ~np.uint64(0xFFFFFF)) | i.astype(np.uint64)
    anchor = (_least(key, length - gram + 1)[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi, p = at[first], at[last] + length, anchor[first]
    name = tb.span_hash(s, lo, hi, 5) + (p - lo).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h[p], name, np.searchsorted(o, lo, "right") - 1, lo, hi


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first symbols (depth of them at least), ties by place; common prefixes of neighbours.

    Ranks of 4 symbols come from the symbols, ranks of three times as many from
    three ranks, as often as needed: symbols and ranks pack into 64-bit keys.
    """
    n = len(text)

    def packed(r: np.ndarray, step: int, count: int) -> np.ndarray:
        base = int(r.max(initial=0)) + 2  # 0 stands for what is past the end
        if base**count >= 1 << 63:
            raise ValueError("too many symbols for one suffix array")
        key = np.zeros(n, np.int64)
        for k in range(count):
            key *= base
            key[: max(n - k * step, 0)] += r[k * step :] + 1
        return np.unique(key, return_inverse=True)[1]

    symbols = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, p = [(1, symbols), (4, packed(symbols, 1, 4))], 4
    while p < depth:
        ranks.append((3 * p, packed(ranks[-1][1], p, 3)))
        p *= 3
    sa = np.argsort(ranks[-1][1], kind="stable")
    a, b, lcp = sa[:-1].copy(), sa[1:].copy(), np.zeros(n, np.int64)
    for k, (size, r) in reversed(list(enumerate(ranks))):
        for _ in range(1 if k == len(ranks) - 1 else 3 if k == 0 else 2):
            same = (a < n) & (b < n)
            same[same] = r[a[same]] == r[b[same]]
            step = same * size
            a, b = a + step, b + step
            lcp[1:] += step
    return sa, lcp


def previous_factors(text: np.ndarray, least: int) -> np.ndarray:
    """The longest previous factor of each place, where it is ``least`` or more; else 0.

    In suffix order, the previous and the next smaller position hold the longest
    match of all earlier ones. Matches of ``least`` lie in runs of suffixes with
    such common prefixes, so only runs are walked.
    """
    sa, lcp = suffix_order(text, least)
    out = np.zeros(len(text), np.int64)
    tied = lcp >= least
    member = tied.copy()
    member[:-1] |= tied[1:]
    stack: list[tuple[int, int]] = []  # position, common prefix with the one below
    for k in np.flatnonzero(member):
        at, common = int(sa[k]), int(lcp[k])
        if common < least:
            stack.clear()
            common = 0
        while stack and stack[-1][0] > at:
            top, with_below = stack.pop()
            # the next smaller position of top is at; the previous one lies below
            out[top] = max(out[top], common, with_below)
            common = min(common, with_below)
        if stack:
            out[at] = max(out[at], common)
        stack.append((at, common if stack else 0))
    return out


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc, id, text) for each row, and for each document once; doc orders documents."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema[id_col].dataType
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        n, known = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.col("id").isNull())).first()
        if n <= 1 and not known:
            plain = rows.select(F.col("id").cast("long").alias("doc"), "id", "text")
            return plain, plain
    keyed = rows.withColumn("th", F.xxhash64("text"))
    keys = keyed.select("id", "th").distinct().repartitionByRange("id", "th").sortWithinPartitions("id", "th")
    keys = materialise(keys.select(F.monotonically_increasing_id().alias("doc"), F.col("id").alias("id_"), F.col("th").alias("th_")), "suffix-keys")
    every = keyed.join(keys, keyed["id"].eqNullSafe(keys["id_"]) & (keyed["th"] == keys["th_"])).select("doc", "id", "text")
    return every, every.dropDuplicates(["doc"])


def _scan(docs: DataFrame, length: int) -> DataFrame:
    """(a, n, doc, lo, hi, dup): first of equal stretches in a task; repeats, joined up, as dup."""

    def run(batches):
        held: list = []
        size = 0

        def rows():
            a, n, doc, lo, hi = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((lo, doc))
            a, n, doc, lo, hi = (x[order] for x in (a, n, doc, lo, hi))
            again = _again(a * np.uint64(3) + tb.mix(n), a, n)
            first = np.flatnonzero(~again)
            d, x, y = _joined(doc[again], lo[again], hi[again])
            own = tb.mix(d.view(np.uint64) + tb.mix(x.astype(np.uint64)))  # any key: they only pass through
            yield from _rows(own, own, d, x, y, True)
            yield from _rows(a[first], n[first], doc[first], lo[first], hi[first], False)

        for batch in batches:
            doc = np.asarray(batch.column(0)).astype(np.int64)
            a, n, row, lo, hi = stretches(*tb.strings(batch.column(1)), length)
            held.append((a, n, doc[row], lo, hi))
            size += len(a)
            if size > 2_000_000:
                yield from rows()
                size = 0
        if held:
            yield from rows()

    return docs.select("doc", "text").mapInArrow(run, "a long, n long, doc long, lo int, hi int, dup boolean")


def _again(key: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which of the stretches equal the first of their key in both hashes."""
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    again = (a == a[first][group]) & (n == n[first][group])
    again[first] = False
    return again


def _rows(a, n, doc, lo, hi, dup):
    for k in range(0, len(a), 50_000):
        b = slice(k, k + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a[b].view(np.int64)), pa.array(n[b].view(np.int64)), pa.array(doc[b]), pa.array(lo[b].astype(np.int32)), pa.array(hi[b].astype(np.int32)), pa.array(np.full(len(a[b]), dup))],
            names=["a", "n", "doc", "lo", "hi", "dup"],
        )


def _joined(doc, lo, hi):
    """Unions of the intervals of each document; input sorted by document."""
    if not len(doc):
        return doc, lo, hi
    # documents one after another on one line, far enough apart not to touch
    _, group = np.unique(doc, return_inverse=True)
    gap = group * (int(hi.max()) + 2)
    x, y = tb.merged(lo + gap, hi + gap)
    who = x // (int(hi.max()) + 2)
    base = who * (int(hi.max()) + 2)
    return np.unique(doc)[who], x - base, y - base


def _candidates(raws: list[bytes], length: int) -> np.ndarray:
    """Which of the stretches hold a window whose hash comes more than once; equal windows have equal hashes, so no other repeats anything."""
    raw = np.frombuffer(b"".join(raws), np.uint8)
    size = np.array([len(r) for r in raws], np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    windows = np.maximum(size - length + 1, 0)
    at = np.arange(windows.sum()) + np.repeat(off[:-1] - np.cumsum(windows) + windows, windows)
    h = tb.span_hash(tb.prefix(raw), at, at + length)
    order = np.sort(h)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return np.zeros(0, np.int64)
    known = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h
    return np.unique(np.repeat(np.arange(len(raws)), windows)[known])


def _factors(parts: DataFrame, length: int) -> DataFrame:
    """Repeats (doc, lo, hi) among stretches (a, doc, lo, bytes); equal a stays together."""
    rows = parts.repartition("a").sortWithinPartitions("a", "doc", "lo")

    def work(held):
        held.sort(key=lambda r: r[:2])
        held = [held[k] for k in _candidates([r[2] for r in held], length)]
        size = [len(r[2]) for r in held]
        text = np.zeros(sum(size) + len(size), np.int64)
        cut = np.concatenate(([0], np.cumsum(np.array(size) + 1)))
        for k, r in enumerate(held):
            text[cut[k] : cut[k + 1] - 1] = np.frombuffer(r[2], np.uint8)
            text[cut[k + 1] - 1] = 256 + k  # every end is a symbol of its own
        at = np.flatnonzero(previous_factors(text, length) >= length)
        k = np.searchsorted(cut, at, "right") - 1
        lo = np.array([r[1] for r in held], np.int64)[k] + at - cut[k]
        doc = np.array([r[0] for r in held], np.int64)[k]
        d, x, y = _joined(doc, lo, lo + length)
        return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(x, pa.int32()), pa.array(y, pa.int32())], names=["doc", "lo", "hi"])

    def run(batches):
        held, size, key = [], 0, None
        for batch in batches:
            for a, doc, lo, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if a != key and size >= CHUNK:
                    yield work(held)
                    held, size = [], 0
                key = a
                held.append((doc, lo, raw))
                size += len(raw)
        if held:
            yield work(held)

    return rows.mapInArrow(run, "doc long, lo int, hi int")


def _cut_out(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, doc, lo, bytes, hot) of wanted (a, doc, lo, hi, hot). Texts meet their places by document."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("a", "lo", "hi", "hot")).alias("want"))
    joined = docs.select("doc", "text").join(lists.hint("shuffle_merge"), "doc")

    def run(batches):
        for batch in batches:
            for doc, text, want in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw, want = text.as_py().encode(), want.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w["a"] for w in want], pa.int64()), pa.array([doc.as_py()] * len(want), pa.int64()), pa.array([w["lo"] for w in want], pa.int32()), pa.array([raw[w["lo"] : w["hi"]] for w in want], pa.binary()), pa.array([w["hot"] for w in want])],
                    names=["a", "doc", "lo", "bytes", "hot"],
                )

    return joined.mapInArrow(run, "a long, doc long, lo int, bytes binary, hot boolean")


#: Anchors are counted in so many slots; those of slots far over the mean may be hot.
SLOTS = 65_536


def _windows(parts: DataFrame, length: int) -> DataFrame:
    """Repeats among the single windows of stretches, for hot anchors."""
    one = parts.select("doc", "lo", F.expr(f"explode(sequence(0, length(bytes) - {length}))").alias("k"), "bytes")
    one = one.select("doc", (F.col("lo") + F.col("k")).alias("lo"), F.expr(f"substring(bytes, k + 1, {length})").alias("w"))
    one = one.select("doc", "lo", F.xxhash64("w").alias("h"), F.xxhash64(F.lit(1), "w").alias("g"))
    first = one.groupBy("h", "g").agg(F.min(F.struct("doc", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first")
    first = materialise(first, "suffix-windows")  # then a common window is a skewed key of a plain shuffle, which is split
    return one.join(first, ["h", "g"]).where(F.struct("doc", "lo") > F.col("first")).select("doc", "lo", (F.col("lo") + length).alias("hi"))


def _gathered(spans: DataFrame) -> DataFrame:
    """(doc, cut): the disjoint intervals of each document, flat."""
    lists = spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("s"))

    def run(batches):
        for batch in batches:
            flat = batch.column(1).to_pylist()
            out = []
            for s in flat:
                x, y = tb.merged(np.array([r["lo"] for r in s], np.int64), np.array([r["hi"] for r in s], np.int64))
                out.append(np.column_stack((x, y)).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["doc", "cut"])

    return lists.mapInArrow(run, "doc long, cut array<long>")


def _known(rows: DataFrame) -> DataFrame:
    """rows (a, n, doc, lo, hi) with ``known``: whether an equal stretch stands before."""
    return rows.withColumn("known", F.row_number().over(Window.partitionBy("a", "n").orderBy("doc", "lo")) > 1)


def _marked(scan: DataFrame) -> DataFrame:
    """(a, doc, lo, hi, known, hot) of stretches that repeat, or whose anchor has others too."""
    every = scan.where("not dup").drop("dup")
    slot = F.pmod("a", F.lit(SLOTS)).alias("slot")
    sizes = every.groupBy(slot).agg(F.count("*").alias("n"))
    mean = every.count() / SLOTS
    slots = [r.slot for r in sizes.where(F.col("n") > 2 * mean + HOT).select("slot").collect()]  # SLOTS numbers at most
    by_anchor = Window.partitionBy("a")
    kinds = F.sum((~F.col("known")).cast("int")).over(by_anchor)
    cold = _known((every.where(~slot.isin(slots)) if slots else every).repartition("a"))
    cold = cold.withColumns({"least": F.min("n").over(by_anchor), "most": F.max("n").over(by_anchor), "kinds": kinds})
    out = cold.where(F.col("known") | (F.col("least") != F.col("most"))).select("a", "doc", "lo", "hi", "known", (F.col("kinds") > HOT).alias("hot"))
    if slots:
        many = materialise(_known(every.where(slot.isin(slots)).repartition("a", "n")).drop("n"), "suffix-hot")
        kinds = materialise(many.where(~F.col("known")).groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1"), "suffix-kinds")
        side = F.broadcast(kinds) if kinds.count() <= BROADCAST_ROWS else kinds
        new = many.where(~F.col("known")).join(side, "a").select("a", "doc", "lo", "hi", "known", (F.col("kinds") > HOT).alias("hot"))
        out = out.unionByName(many.where("known").withColumn("hot", F.lit(False))).unionByName(new)
    return materialise(out, "suffix-stretches")


def repeats(docs: DataFrame, length: int) -> DataFrame:
    """(doc, cut) for documents (doc, text) that hold repeats."""
    scan = materialise(_scan(docs, length), "suffix-scan")
    rows = _marked(scan)
    wanted = rows.where(~F.col("known")).select("a", "doc", "lo", "hi", "hot")
    parts = _cut_out(docs, wanted)
    found = rows.where("known").select("doc", "lo", "hi").unionByName(scan.where("dup").select("doc", "lo", "hi"))
    if wanted.where("hot").isEmpty():
        more = _factors(parts, length)
    else:
        parts = materialise(parts, "suffix-bytes")
        more = _factors(parts.where(~F.col("hot")), length).union(_windows(parts.where("hot"), length))
    out = materialise(_gathered(found.union(more)), "suffix-spans")
    discard(scan, rows)
    return out


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, n_bytes, spans (flat, disjoint byte intervals) and kept (the other bytes) of every row."""
    every, once = _ordered(docs, id_col, text_col)
    spans = repeats(once, length)
    small = spans.agg(F.coalesce(F.sum(F.size("cut")), F.lit(0))).first()[0] <= 2 * BROADCAST_ROWS
    joined = every.join(F.broadcast(spans) if small else spans, "doc", "left").select("id", "text", "cut")

    def run(batches):
        for batch in batches:
            data, off = tb.strings(batch.column(1))
            kept, cuts = [], []
            for k, cut in enumerate(batch.column(2).to_pylist()):
                raw = data[off[k] : off[k + 1]].tobytes()
                cut = cut or []
                at = [0, *cut, len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(at[::2], at[1::2], strict=True)))
                cuts.append(cut)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(cuts, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, spans array<long>, kept binary")
