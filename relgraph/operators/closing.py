"""Paths that close wanted pairs, matched in blocks of nodes instead of one joined row for each first step.

Nodes are dealt by hash to ``groups``. The pairs from group i to group j are one task's; the arcs out of i and into j
come to it by the group k of the node in the middle, so that a task holds its pairs and the arcs of two blocks at a
time. Arcs are moved ``groups`` times, first steps never. The best paths of three arcs go by tasks of first nodes. A pair is expanded from its end with fewer arcs in
the block, STEPS first steps at a time. Node ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: First steps that are matched at a time, and arcs of a block from which there are more groups.
STEPS, BLOCK_ARCS = 1 << 21, 1 << 21
#: Costs that differ by a smaller share than this are left to who ranks them.
MARGIN = 1e-9


def fits(*columns: tuple[DataFrame, str]) -> bool:
    """Whether node ids are integers."""
    return all(isinstance(df.schema[c].dataType, IntegralType) for df, c in columns)


def _dealt(wanted: DataFrame, arcs: DataFrame, values: list[str], groups: int) -> DataFrame:
    """(i, j, k, kind, n, ids, values...): pairs (k -1), then by k the arcs out of i (kind 1) and those into j (kind 2), as lists of a node."""
    group = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    none = [F.array().cast("array<double>" if c != "x" else "array<long>").alias(c) for c in values]
    pairs = wanted.select(F.col("a").cast("long").alias("n"), F.col("b").cast("long").alias("m")).where("n is not null and m is not null").withColumns({"i": group("n"), "j": group("m")})
    pairs = pairs.groupBy("i", "j", "n").agg(F.sort_array(F.collect_list("m")).alias("ids")).select("i", "j", F.lit(-1).alias("k"), F.lit(0).alias("kind"), "n", "ids", *none)

    def side(own: str, other: str, kind: int, at: str, along: str) -> DataFrame:
        rows = arcs.where(F.col(own).isNotNull() & F.col(other).isNotNull()).select(F.col(own).cast("long").alias("n"), F.col(other).cast("long").alias("m"), *values)
        lists = rows.groupBy("n", group("m").alias("k")).agg(F.collect_list(F.struct("m", *values)).alias("s"))
        lists = lists.select(group("n").alias(at), every.alias(along), "k", F.lit(kind).alias("kind"), "n", F.col("s.m").alias("ids"), *[F.col(f"s.{c}").alias(c) for c in values])
        return lists.select("i", "j", "k", "kind", "n", "ids", *values)

    rows = pairs.unionByName(side("u", "v", 1, "i", "j")).unionByName(side("v", "u", 2, "j", "i"))
    return rows.repartitionById(groups * groups, F.col("i") * groups + F.col("j")).sortWithinPartitions("i", "j", "k", "kind")


class _Lists:
    """Lists of nodes, flat: n, ids and values of the same length."""

    def __init__(self, values: list[str]):
        self.values, self.parts = values, []

    def add(self, rows: pa.RecordBatch) -> None:
        ids = rows.column("ids")
        n = np.repeat(rows.column("n").to_numpy(zero_copy_only=False), np.diff(ids.offsets.to_numpy()))
        flat = [rows.column(c).flatten().to_numpy(zero_copy_only=False) for c in self.values]
        self.parts.append([n, ids.flatten().to_numpy(zero_copy_only=False), *flat])

    def flat(self) -> list[np.ndarray]:
        if not self.parts:
            return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int64 if c == "x" else np.float64) for c in self.values]
        return [np.concatenate(c) for c in zip(*self.parts, strict=True)]


def _side(ends: np.ndarray, lists: list[np.ndarray], middle: np.ndarray):
    """Arcs at the given nodes, in the order of their key (place of the node, place of the middle): key, starts by node, values."""
    n, ids, *values = lists
    at = np.searchsorted(ends, n)
    known = ends[np.minimum(at, len(ends) - 1)] == n
    key = at[known] * len(middle) + np.searchsorted(middle, ids[known])
    order = np.argsort(key, kind="stable")
    key = key[order]
    return key, np.searchsorted(key, np.arange(len(ends) + 1) * len(middle)), [c[known][order] for c in values]


def _matches(pa_: np.ndarray, pb: np.ndarray, one, other, width: int, which: np.ndarray) -> Iterator[tuple]:
    """(pair, place of its arc in one, in other) of chosen pairs, expanded from one; pairs ascend."""
    key, start, _ = one
    far = other[0]
    counts = (start[1:] - start[:-1])[pa_[which]]
    which, counts = which[counts > 0], counts[counts > 0]
    if not len(which) or not len(far):
        return
    unique = bool((far[1:] != far[:-1]).all())
    ends = np.cumsum(counts)
    at = 0
    while at < len(which):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEPS, "right")))
        c = counts[at:upto]
        pair = np.repeat(which[at:upto], c)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(c) - c, c) + start[pa_[pair]]
        asked = pb[pair] * width + key[place] % width
        lo = np.searchsorted(far, asked)
        if unique:
            hit = np.flatnonzero(far[np.minimum(lo, len(far) - 1)] == asked)
            yield pair[hit], place[hit], lo[hit]
        else:
            times = np.searchsorted(far, asked, "right") - lo
            ends_of, done = np.cumsum(times), 0
            while done < len(times):  # parallel arcs: so many matches at a time
                last = max(done + 1, int(np.searchsorted(ends_of, (ends_of[done - 1] if done else 0) + STEPS, "right")))
                t = times[done:last]
                first = np.repeat(lo[done:last] - (np.cumsum(t) - t), t)
                yield np.repeat(pair[done:last], t), np.repeat(place[done:last], t), np.arange(len(first)) + first
                done = last
        at = upto


def _blocks(values: list[str], fresh):
    """A function of Arrow batches as _dealt sorts them. fresh(a, b) makes what takes the matches of a task's pairs: take(pair, middle, out, into)
    gives rows that are done, end() the rest, as columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = at = block = keep = None

        def close():
            """Match the two blocks at hand."""
            out, into = block[1].flat(), block[2].flat()
            if keep is None or not len(out[0]) or not len(into[0]):
                return
            a, b, ends_a, ends_b, sink = keep
            middle = np.unique(np.concatenate([out[1], into[1]]))
            left, right = _side(ends_a, out, middle), _side(ends_b, into, middle)
            fewer = np.diff(left[1])[a] <= np.diff(right[1])[b]
            pick = lambda side, place: [c[place] for c in side[2]]
            for pair, o, t in _matches(a, b, left, right, len(middle), np.flatnonzero(fewer)):
                yield from sink.take(pair, middle[left[0][o] % len(middle)], pick(left, o), pick(right, t))
            for pair, t, o in _matches(b, a, right, left, len(middle), np.flatnonzero(~fewer)):
                yield from sink.take(pair, middle[left[0][o] % len(middle)], pick(left, o), pick(right, t))

        for batch in batches:
            heads = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "k", "kind")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in heads], axis=0)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if s == e:
                    continue
                i, j, k, kind = (int(c[s]) for c in heads)
                if block is None or (i, j, k) != at:
                    if block is not None:
                        yield from close()
                    if (i, j) != task:
                        if keep is not None:
                            yield from keep[-1].end()
                        task, keep = (i, j), None
                    at, block = (i, j, k), [_Lists([]), _Lists(values), _Lists(values)]
                block[kind].add(batch.slice(s, e - s))
                if kind == 0:
                    n, m = block[0].flat()
                    (ends_a, a), (ends_b, b) = (np.unique(c, return_inverse=True) for c in (n, m))
                    keep = a, b, ends_a, ends_b, fresh(n, m)
        if block is not None:
            yield from close()
        if keep is not None:
            yield from keep[-1].end()

    return run


def _groups(arcs: DataFrame) -> int:
    return max(ceil(sqrt(3 * arcs.sparkSession.sparkContext.defaultParallelism)), ceil(sqrt(arcs.count() / BLOCK_ARCS)))


class _Rows:
    """All matches, as they come."""

    def __init__(self, a, b):
        self.a, self.b = a, b

    def take(self, pair, middle, out, into):
        a, b = self.a[pair], self.b[pair]
        good = (middle != a) & (middle != b)
        yield pa.RecordBatch.from_arrays([pa.array(c[good], from_pandas=True) for c in (a, middle, b, out[0], into[0])], ["a", "m", "b", "w0", "w1"])

    def end(self):
        return iter(())


def two_steps(arcs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, m, b, w0, w1): simple paths of two arcs (u, v, w) between wanted (a, b)."""
    rows = _dealt(wanted, arcs.select("u", "v", F.col("w").cast("double").alias("w")), ["w"], _groups(arcs))
    return rows.mapInArrow(_blocks(["w"], _Rows), "a long, m long, b long, w0 double, w1 double")


def _best(n: int):
    class Best:
        """The n matches of each pair that cost least, ties by the middle; of nearly equal costs all that could rank among n."""

        def __init__(self, a, b):
            self.a, self.b, self.kept, self.waiting = a, b, [], 0

        def take(self, pair, middle, out, into):
            good = (middle != self.a[pair]) & (middle != self.b[pair])
            pair, middle, w0, w1 = pair[good], middle[good], out[0][good], into[0][good]
            self.kept.append((pair, middle, w0, w1))
            self.waiting += len(pair)
            if self.waiting > STEPS:
                self.cut()
            return iter(())

        def cut(self):
            pair, middle, w0, w1 = (np.concatenate(c) for c in zip(*self.kept, strict=True))
            with np.errstate(divide="ignore"):
                cost = np.where(w0 > 0, 1 / w0, np.inf) + np.where(w1 > 0, 1 / w1, np.inf)
            order = np.lexsort((middle, cost, pair))
            pair, cost = pair[order], cost[order]
            starts = lambda new: np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            new = np.append(True, pair[1:] != pair[:-1])
            first = starts(new)
            same = starts(new | np.append(True, cost[1:] != cost[:-1]))
            nth = first + n - 1
            there = nth < len(pair)
            bound = np.where(there, cost[np.minimum(nth, len(pair) - 1)], np.inf)
            bound = np.where(there & (pair[np.minimum(nth, len(pair) - 1)] == pair), bound, np.inf)
            keep = order[(cost <= bound * (1 + MARGIN)) & (np.arange(len(pair)) - same < n)]
            whole = [np.concatenate(c)[keep] for c in zip(*self.kept, strict=True)]
            self.kept, self.waiting = [tuple(whole)], 0

        def end(self):
            if self.kept and sum(len(x[0]) for x in self.kept):
                self.cut()
                pair, middle, w0, w1 = self.kept[0]
                yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in (self.a[pair], middle, self.b[pair], w0, w1)], ["a", "m", "b", "w0", "w1"])

    return Best


def best_two_steps(arcs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """Of ``two_steps``, for each pair all that can be among its n best by harmonic mean to 12 places and then the middle; few more."""
    rows = _dealt(wanted, arcs.select("u", "v", F.col("w").cast("double").alias("w")), ["w"], _groups(arcs))
    return rows.mapInArrow(_blocks(["w"], _best(n)), "a long, m long, b long, w0 double, w1 double")


#: Pairs of a task, arcs of a block of middle nodes and what is made at a time, of paths of three arcs.
TASK_PAIRS, MIDDLE_ARCS, AT_A_TIME = 1 << 18, 1 << 19, 1 << 19


class _BestOfThree:
    """Of the paths of three arcs of each pair that come, the n that cost least, ties by nodes; of nearly equal costs all that could rank among n. bound: what no other path may cost more than."""

    def __init__(self, pairs: int, n: int):
        self.n, self.bound, self.kept, self.held, self.waiting = n, np.full(pairs, np.inf), [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        """pair, x, y, the weights, cost."""
        self.kept.append(columns)
        self.waiting += len(columns[0])
        if self.waiting > max(AT_A_TIME, self.held):
            self.cut()

    def cut(self) -> None:
        if not self.waiting:
            return
        columns = [np.concatenate(c) for c in zip(*self.kept, strict=True)]
        pair, x, y, *_, cost = columns
        some = np.flatnonzero(cost <= self.bound[pair])
        order = some[np.lexsort((y[some], x[some], cost[some], pair[some]))]
        pair, cost, n = pair[order], cost[order], self.n
        at = np.arange(len(pair))
        new = np.append(True, pair[1:] != pair[:-1])
        first = np.maximum.accumulate(np.where(new, at, 0))
        same = np.maximum.accumulate(np.where(new | np.append(True, cost[1:] != cost[:-1]), at, 0))
        nth = at - first == n - 1
        self.bound[pair[nth]] = cost[nth] * (1 + MARGIN)
        keep = order[(cost <= self.bound[pair]) & (at - same < n)]
        self.kept, self.held, self.waiting = [tuple(c[keep] for c in columns)], len(keep), 0


def _chunks(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of counts whose sum is AT_A_TIME at most, or of one count."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_A_TIME, "right")))
        yield at, upto
        at = upto


def _expanded(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, place): for each range its number, and each place in it."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) + (starts - (np.cumsum(counts) - counts))[which]


def _costs(w: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w > 0, 1 / w, np.inf)


def _ranges(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the range of each asked value among sorted ones."""
    at = np.searchsorted(known, asked)
    return at, np.searchsorted(known, asked, "right") - at


def _through(best: _BestOfThree, pairs: tuple, out: tuple, into: list, onward: list) -> None:
    """Give best the paths a, x, y, b of one block of nodes y. pairs: (places of a, b) by a, the nodes a, the nodes b; out: (place of a, x, weight, cost) by a; into: (y, x, weight), onward: (y, b, weight).

    The two first arcs are made once for each a, AT_A_TIME of them at a time, and found by (a, y); what cannot cost less than the bounds is left out at each step.
    """
    pa_, pb, ends_a, ends_b = pairs
    ys = np.unique(onward[0])
    order = np.argsort(into[1], kind="stable")
    x2, y2, w2 = into[1][order], np.searchsorted(ys, into[0][order]), into[2][order]
    order = np.argsort(onward[1], kind="stable")
    b3, y3, w3 = onward[1][order], np.searchsorted(ys, onward[0][order]), onward[2][order]
    c2, c3 = _costs(w2), _costs(w3)
    least2, least3 = c2.min(), c3.min()
    first_of = np.searchsorted(pa_, np.arange(len(ends_a) + 1))
    b_at, b_n = (c[pb] for c in _ranges(b3, ends_b))
    bound_a = np.maximum.reduceat(best.bound, first_of[:-1])
    cheap = np.flatnonzero(out[3] + least2 + least3 <= bound_a[out[0]])
    a1, x1, w1, c1 = (c[cheap] for c in out)
    heads = np.flatnonzero(np.append(True, x2[1:] != x2[:-1]))
    k = np.minimum(np.searchsorted(x2[heads], x1), len(heads) - 1)
    n1 = np.where(x2[heads][k] == x1, np.diff(np.append(heads, len(x2)))[k], 0)
    at1 = heads[k]
    for s, e in _chunks(n1):
        arc, two = _expanded(at1[s:e], n1[s:e])
        arc += s
        cost = c1[arc] + c2[two]
        of = a1[arc]
        bound_a = np.maximum.reduceat(best.bound, first_of[:-1]) if s else bound_a
        ok = np.flatnonzero((cost + least3 <= bound_a[of]) & (ys[y2[two]] != ends_a[of]))
        if not len(ok):
            continue
        arc, two, cost, of = arc[ok], two[ok], cost[ok], of[ok]
        a0, last = int(of[0]), int(of[-1])
        own = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        least = np.full(last - a0 + 1, np.inf)
        least[of[own] - a0] = np.minimum.reduceat(cost, own)
        key = (of - a0) * len(ys) + y2[two]
        order = np.argsort(key)
        size = (last - a0 + 1) * len(ys)
        dense = size <= 8 * AT_A_TIME
        if dense:
            times_of = np.bincount(key, minlength=size)
            start_of = np.cumsum(times_of) - times_of
        else:
            key = key[order]
        which = np.arange(first_of[a0], first_of[last + 1])
        which = which[b_n[which] > 0]
        for p, q in _chunks(b_n[which]):
            pair, three = _expanded(b_at[which[p:q]], b_n[which[p:q]])
            pair = which[p:q][pair]
            ok = np.flatnonzero(c3[three] + least[pa_[pair] - a0] <= best.bound[pair])
            pair, three = pair[ok], three[ok]
            asked = (pa_[pair] - a0) * len(ys) + y3[three]
            at, times = (start_of[asked], times_of[asked]) if dense else _ranges(key, asked)
            some = np.flatnonzero(times)
            pair, three, at, times = pair[some], three[some], at[some], times[some]
            for f, t in _chunks(times):
                one, wedge = _expanded(at[f:t], times[f:t])
                one, wedge = one + f, order[wedge]
                whole = cost[wedge] + c3[three[one]]
                ok = np.flatnonzero((whole <= best.bound[pair[one]]) & (x1[arc[wedge]] != ends_b[pb[pair[one]]]))
                one, wedge = one[ok], wedge[ok]
                best.add(pair[one], x1[arc[wedge]], ys[y3[three[one]]], w1[arc[wedge]], w2[two[wedge]], w3[three[one]], whole[ok])


def _three_steps(n: int):
    """A function of Arrow batches as best_three_steps sorts them: of a task its pairs (kind 0) and the arcs out of their first nodes (kind 1), then arcs into and out of nodes by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, state = (None, None), {}, None

        def lists(rows: list, ids: str, w: str | None) -> list[np.ndarray]:
            ends = [r.column("n").to_numpy(zero_copy_only=False).repeat(np.diff(r.column(ids).offsets.to_numpy())) for r in rows]
            flat = [[r.column(c).flatten().to_numpy(zero_copy_only=False) for r in rows] for c in (ids, w) if c]
            return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (ends, *flat)]

        def closed() -> None:
            """What rows at hand give: the task's pairs and first arcs, or the paths through a block."""
            nonlocal state
            if at[1] == -1:
                state = None
                a, b = lists(held.get(0, []), "ids", None)
                n1, x, w = lists(held.get(1, []), "ids", "w") if 1 in held else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
                if len(a) and len(x):
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], b[order]
                    (ends_a, a), (ends_b, b) = (np.unique(c, return_inverse=True) for c in (a, b))
                    place = np.minimum(np.searchsorted(ends_a, n1), len(ends_a) - 1)
                    known = np.flatnonzero(ends_a[place] == n1)
                    known = known[np.argsort(place[known], kind="stable")]
                    state = _BestOfThree(len(a), n), (a, b, ends_a, ends_b), (place[known], x[known], w[known], _costs(w[known]))
            elif state:
                _through(*state, lists(held[2], "ids", "w"), lists(held[2], "to", "v"))

        def ended() -> Iterator[pa.RecordBatch]:
            if state:
                best, (a, b, ends_a, ends_b), _ = state
                best.cut()
                for pair, x, y, *w, _ in best.kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in (ends_a[a[pair]], x, y, ends_b[b[pair]], *w)], ["a", "x", "y", "b", "w0", "w1", "w2"])

        for batch in batches:
            heads = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "l", "kind")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in heads], axis=0)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if s == e:
                    continue
                i, l, kind = (int(c[s]) for c in heads)  # noqa: E741
                if (i, l) != at:
                    if held:
                        closed()
                    if i != at[0]:
                        yield from ended()
                        state = None
                    at, held = (i, l), {}
                held.setdefault(kind, []).append(batch.slice(s, e - s))
        if held:
            closed()
        yield from ended()

    return run


def best_three_steps(arcs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(a, x, y, b, w0, w1, w2) of the simple paths of three arcs (u, v, w) between wanted (a, b): for each pair all that can be among its n best by harmonic mean to 12 places and then the nodes; few more.

    Pairs are dealt by their first node to tasks, arcs go to each task by blocks of the node before the last: moved once a task, whatever the paths are. No path is a row before it is among the best.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    arcs = arcs.select(long("u"), long("v"), F.col("w").cast("double").alias("w")).where("u is not null and v is not null and u <> v")
    wanted = wanted.select(long("a"), long("b")).where("a is not null and b is not null")
    tasks = max(2 * arcs.sparkSession.sparkContext.defaultParallelism, ceil(wanted.count() / TASK_PAIRS))
    blocks = max(1, ceil(arcs.count() / MIDDLE_ARCS))
    task = lambda c: F.pmod(F.xxhash64(c), F.lit(tasks)).cast("int").alias("i")
    none = lambda kind, *names: [F.array().cast(f"array<{kind}>").alias(c) for c in names]
    start = [F.lit(-1).alias("l")]
    pairs = wanted.groupBy("a").agg(F.collect_list("b").alias("ids")).select(task("a"), *start, F.lit(0).alias("kind"), F.col("a").alias("n"), "ids", *none("double", "w"), *none("long", "to"), *none("double", "v"))

    def lists(own: str, other: str, name: str) -> DataFrame:
        return arcs.groupBy(F.col(own).alias("n")).agg(F.sort_array(F.collect_list(F.struct(F.col(other).alias("m"), "w"))).alias(name))

    first = lists("u", "v", "s").select(task("n"), *start, F.lit(1).alias("kind"), "n", F.col("s.m").alias("ids"), F.col("s.w").alias("w"), *none("long", "to"), *none("double", "v"))
    middle = lists("v", "u", "s").join(lists("u", "v", "t"), "n")
    each = F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("i")
    middle = middle.select(each, F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("l"), F.lit(2).alias("kind"), "n", F.col("s.m").alias("ids"), F.col("s.w").alias("w"), F.col("t.m").alias("to"), F.col("t.w").alias("v"))
    rows = pairs.unionByName(first).unionByName(middle)
    rows = rows.repartitionById(tasks, F.col("i")).sortWithinPartitions("i", "l", "kind")
    return rows.mapInArrow(_three_steps(n), "a long, x long, y long, b long, w0 double, w1 double, w2 double")


class _Summary:
    """Of paths of four arcs that two wedges make: how many, the least cost, the least nodes."""

    def __init__(self, a, b):
        self.a, self.b = a, b
        self.n, self.cost = np.zeros(len(a), np.int64), np.full(len(a), np.inf)
        self.least = np.full((3, len(a)), np.iinfo(np.int64).max)

    def take(self, pair, middle, out, into):
        a, b, x, z = self.a[pair], self.b[pair], out[0], into[0]
        good = (middle != a) & (middle != b) & (x != b) & (z != a) & (x != z)
        if not good.any():
            return iter(())
        pair, nodes = pair[good], [x[good], middle[good], z[good]]
        cost = out[1][good] + out[2][good] + into[1][good] + into[2][good]
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        own, sizes = pair[starts], np.diff(np.append(starts, len(pair)))
        self.n[own] += sizes
        self.cost[own] = np.minimum(self.cost[own], np.minimum.reduceat(cost, starts))
        top = np.iinfo(np.int64).max
        live, least = np.ones(len(pair), bool), []
        for c in nodes:
            c = np.where(live, c, top)
            least.append(np.minimum.reduceat(c, starts))
            live &= c == np.repeat(least[-1], sizes)
        had = self.least[:, own]
        less = (least[0] < had[0]) | ((least[0] == had[0]) & ((least[1] < had[1]) | ((least[1] == had[1]) & (least[2] < had[2]))))
        self.least[:, own[less]] = np.array(least)[:, less]
        return iter(())

    def end(self):
        some = np.flatnonzero(self.n)
        columns = [self.a, self.b, self.n, self.cost, *self.least]
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], ["a", "b", "n", "cost", "x", "y", "z"])


def four_steps(arcs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, n, cost, x, y, z) of the simple paths of four arcs (u, v, w), w over 0, between wanted (a, b): how many, the least
    sum of 1 / w, and the nodes between a and b of the path whose nodes are least. Two wedges meet in the middle, so no path is a row."""
    arcs = arcs.select("u", "v", (1 / F.col("w")).alias("c"))
    wedges = arcs.select("u", F.col("v").alias("x"), F.col("c").alias("c0")).join(arcs.select(F.col("u").alias("x"), "v", F.col("c").alias("c1")), "x").where("u <> v and u <> x and v <> x")
    wedges = wedges.select("u", "v", F.col("x").cast("long").alias("x"), "c0", "c1")
    rows = _dealt(wanted, wedges, ["x", "c0", "c1"], _groups(wedges))
    return rows.mapInArrow(_blocks(["x", "c0", "c1"], _Summary), "a long, b long, n long, cost double, x long, y long, z long")
