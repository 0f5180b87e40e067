"""Dependency trees as token arrays: paths, spans, patterns, coverage.

A tree is arrays of heads and labels; the root's head is itself. The trees of an Arrow batch are
walked together (``forest``); functions of single trees say what is computed. Parsing is an input.
"""

from __future__ import annotations

import math
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.functions.scores import harmonic, pattern_freq
from relgraph.functions.text import let
from relgraph.operators.forest import Forest

# Labels of modifiers whose sub paths count towards coverage.
MODIFIERS = frozenset(
    (
        "acl", "advcl", "advmod", "amod", "det", "mark", "meta", "neg", "nn", "nmod", "npmod", "nummod", "poss", "prep", "quantmod", "relcl",
        "appos", "aux", "auxpass", "compound", "cop", "ccomp", "xcomp", "expl", "punct", "nsubj", "csubj", "csubjpass", "dobj", "iobj", "obj", "pobj",
    )
)


def ancestors(head: list[int], i: int) -> list[int]:
    """i and the tokens above it, up to the root."""
    out = [i]
    while head[i] != i and len(out) <= len(head):
        i = head[i]
        out.append(i)
    return out


def span_root(head: list[int], start: int, end: int) -> int:
    """The highest token reached from the last one without leaving the span (TX8); the end is inclusive."""
    i = end
    while head[i] != i and start <= head[i] <= end:
        i = head[i]
    return i


def span_extent(head: list[int], dep: list[str], start: int, end: int) -> tuple[int, int]:
    """The compound that a span belongs to: on the right along compound heads, on the left to compound children (TX10, TX11)."""
    while dep[end] == "compound" and head[end] > end:
        end = head[end]
    changed = True
    while changed:
        left = [k for k in range(start) if dep[k] == "compound" and start <= head[k] <= end]
        changed = bool(left)
        start = min([start, *left])
    return start, end


def path_between(head: list[int], dep: list[str], one: tuple[int, int], two: tuple[int, int]) -> tuple[list[str], list[float]]:
    """Steps from span one to span two, i_ upward, and the branch: 1 for tokens of spans and path (TX12, TX13).

    Spans in different trees have no path.
    """
    a, b = span_root(head, *one), span_root(head, *two)
    up, down = ancestors(head, a), ancestors(head, b)
    above = set(down)
    top = next((t for t in up if t in above), None)
    if top is None:
        return [], []
    rise, fall = up[: up.index(top)], down[: down.index(top)]
    steps = [f"i_{dep[t]}" for t in rise] + [dep[t] for t in reversed(fall)]
    branch = [0.0] * len(head)
    for t in (*range(one[0], one[1] + 1), *range(two[0], two[1] + 1), *rise, *fall, top):
        branch[t] = 1.0
    return steps, branch


def core_pattern(steps: list[str]) -> str:
    """As functions.text.core_pattern, for one path (SC22)."""
    if not any("i_nsubj" in s for s in steps):
        steps = [s[2:] if s.startswith("i_") else f"i_{s}" for s in reversed(steps)]
    kept = [s for k, s in enumerate(steps) if "appos" not in s and "conj" not in s and not (s == "prep" and k and steps[k - 1] == "prep")]
    return " ".join(kept)


def sub_pattern(path: str) -> str:
    for s in ("compound", "conj", "appos"):
        path = path.replace(s, "")
    return " ".join(path.split())


def sub_paths(head: list[int], dep: list[str], branch: list[float]) -> list[tuple[int, str, int]]:
    """(token on the branch, labels from it, token off the branch), each off token once (TX16)."""
    out = []
    for i in range(len(head)):
        if branch[i]:
            continue
        way = ancestors(head, i)
        stop = next((k for k, t in enumerate(way) if branch[t]), None)
        if stop is not None:
            out.append((way[stop], " ".join(dep[t] for t in reversed(way[:stop])), i))
    return out


def frequency(count: float, most: float) -> float | None:
    low = math.log(most + 1)
    return math.log((count or 0.5) + 1) / low if low else None


def weigh(head: list[int], dep: list[str], branch: list[float], sub_counts: dict[str, int]) -> list[float]:
    """The branch with weights for modifiers (TX17).

    The head of an on-branch conj token is taken off first. A modifier that can
    be reached gets the frequency of its sub pattern, or its root's weight if there is none.
    """
    most = max(sub_counts.values(), default=0)
    return [(frequency(sub_counts.get(p, 0), most) or 0.0) if p else w for w, p in _weights(head, dep, branch)]


def coverage(dep: list[str], branch: list[float]) -> float | None:
    """Mean weight of the tokens that are not punctuation (TX18)."""
    own = [w for d, w in zip(dep, branch, strict=True) if d != "punct"]
    return sum(own) / len(own) if own else None


def features_of(head, dep, one, two, core_counts: dict[str, int], sub_counts: dict[str, int]) -> dict | None:
    """Path, pattern, coverage, frequency and score of one pair of spans, or None where it is filtered out (TX15, FI7, FI8)."""
    got = _whole({"head": head, "dep": dep, **dict(zip(_PLACES, (*one, *two), strict=True))}, 0, len(head))
    if got is None:
        return None
    steps, branch, pattern = got
    cover = coverage(dep, weigh(head, dep, branch, sub_counts))
    freq = frequency(core_counts.get(pattern, 0), max(core_counts.values(), default=0))
    score = 2 / (1 / freq + 1 / cover) if freq and cover else None
    return {"dep_path": " ".join(steps), "pattern": pattern, "dep_coverage": cover, "pattern_freq": freq, "score": score}


FEATURES = "dep_path string, pattern string, dep_coverage double, pattern_freq double, score double"
_PLACES = ("s1", "e1", "s2", "e2")


def _whole(r: dict, low: int, high: int) -> tuple[list[str], list[float], str] | None:
    """Path, branch and core pattern of a row, or None where it is filtered out (FI1, FI7, FI8)."""
    head, dep, one, two = r["head"], r["dep"], (r["s1"], r["e1"]), (r["s2"], r["e2"])
    if not low <= len(head) <= high or span_extent(head, dep, *one) != one or span_extent(head, dep, *two) != two:
        return None
    steps, branch = path_between(head, dep, one, two)
    pattern = core_pattern(steps) if steps else ""
    return (steps, branch, pattern) if pattern.startswith("i_nsubj") else None


class _Batch(NamedTuple):
    """The rows of a batch that are not filtered out, with their steps, core patterns and branches."""

    forest: Forest
    rows: np.ndarray
    steps: list[list[str]]
    patterns: list[str]
    on: np.ndarray


def _batch(batch: pa.RecordBatch, low: int, high: int, every: bool = False) -> _Batch:
    """``_whole`` for all rows of a batch (id, head, dep, s1, e1, s2, e2, ...); with every, no row is filtered out (FI1, FI7, FI8)."""
    forest = Forest(batch.column(1), batch.column(2))
    s1, e1, s2, e2 = (np.asarray(batch.column(3 + k), dtype=np.int64) for k in range(4))
    fit = (forest.n >= low) & (forest.n <= high) & (forest.n > 0)
    if not every:
        fit &= forest.whole(s1, e1) & forest.whole(s2, e2)
    rows = np.flatnonzero(fit)
    steps, on = forest.paths(rows, (s1[rows], e1[rows]), (s2[rows], e2[rows]))
    if every:
        return _Batch(forest, rows, steps, [], on)
    known: dict[str, str] = {}
    patterns = []
    for x in steps:
        path = " ".join(x)
        if path not in known:
            known[path] = core_pattern(x) if x else ""
        patterns.append(known[path])
    kept = [k for k, p in enumerate(patterns) if p.startswith("i_nsubj")]
    on[~np.isin(forest.row, rows[kept])] = False
    return _Batch(forest, rows[kept], [steps[k] for k in kept], [patterns[k] for k in kept], on)


def _own_weights(forest: Forest, on: np.ndarray) -> np.ndarray:
    """1 for tokens on the branch, but 0 for heads of those that are conj (TX17)."""
    weight = on.astype(float)
    weight[forest.head[on & (forest.dep == forest.label("conj"))]] = 0.0
    return weight


def _weights(head: list[int], dep: list[str], branch: list[float]) -> list[tuple[float, str]]:
    """For each token its weight, and the sub pattern whose frequency is its weight instead, if any (TX17)."""
    out = [(w, "") for w in branch]
    for i, d in enumerate(dep):
        if branch[i] and d == "conj":
            out[head[i]] = (0.0, "")
    for root, path, i in sub_paths(head, dep, [w for w, _ in out]):
        if path.split(" ")[0] in MODIFIERS:
            out[i] = (out[root][0], sub_pattern(path))
    return out


def _frequencies(counts: DataFrame) -> DataFrame:
    """(pattern, freq, unseen) of counts (pattern, cnt); unseen: the frequency of any other pattern."""
    most = counts.agg(F.max("cnt").alias("most"))  # one row
    return counts.crossJoin(F.broadcast(most)).select("pattern", pattern_freq("cnt", "most").alias("freq"))


def _unseen(counts: DataFrame, name: str) -> DataFrame:
    """One row: the frequency of a pattern that counts do not hold; null without counts."""
    return counts.agg(pattern_freq(F.lit(0), F.max("cnt")).alias(name))


def features(pairs: DataFrame, core: DataFrame, sub: DataFrame, *, low: int = 5, high: int = 50) -> DataFrame:
    """(id, s1, e1, s2, e2, FEATURES) for rows (id, head, dep, s1, e1, s2, e2) with spans, ends inclusive (TX15, TX19, FI1).

    core, sub: (pattern, cnt). Trees are walked once, in Python; what depends on counts of the corpus is joined
    afterwards by pattern, so no task and no driver holds the counts. Repeated rows stay repeated.
    """
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = _batch(batch, low, high)
            forest, on = got.forest, got.on
            weight = _own_weights(forest, on)
            token, _, number, paths = forest.sub_paths(weight > 0)
            told = [(p[0] in MODIFIERS, sub_pattern(" ".join(p))) for p in paths]
            modifier, named = (np.array([x[0] for x in told], bool), np.array([bool(x[1]) for x in told], bool)) if told else (np.zeros(0, bool), np.zeros(0, bool))
            weight[token[modifier[number]]] = 1.0  # as its root, unless its pattern tells
            by = np.full(len(weight), -1)
            by[token] = np.where(modifier[number] & named[number], number, -1)
            counted = forest.dep != forest.label("punct")
            n = np.bincount(forest.row[counted], minlength=len(forest.n))
            fixed = np.bincount(forest.row[counted & (by < 0)], weight[counted & (by < 0)], len(forest.n))
            told_ = np.flatnonzero(counted & (by >= 0))
            subs: dict[int, Counter] = {}
            for r, p in zip(forest.row[told_].tolist(), by[told_].tolist(), strict=True):
                subs.setdefault(r, Counter())[told[p][1]] += 1
            lists = [[{"pattern": p, "times": c} for p, c in sorted(subs.get(r, {}).items())] for r in got.rows.tolist()]
            places = [np.asarray(batch.column(3 + k))[got.rows] for k in range(4)]
            cols = [*places, [" ".join(x) for x in got.steps], got.patterns, fixed[got.rows], n[got.rows], lists]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(got.rows)), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["id", *_PLACES, "dep_path", "pattern", "fixed", "n", "subs"])

    kinds = [pa.int32()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.list_(pa.struct([("pattern", pa.string()), ("times", pa.int32())]))]
    parts = pairs.select("id", "head", "dep", *(F.col(p).cast("int").alias(p) for p in _PLACES)).mapInArrow(run, f"id {kind}, s1 int, e1 int, s2 int, e2 int, dep_path string, pattern string, fixed double, n int, subs array<struct<pattern:string,times:int>>")
    key = ["id", *_PLACES, "dep_path", "pattern", "fixed", "n"]
    # a row without sub patterns is kept; each row has one first sub pattern, so these count repeated rows
    rows = parts.select(*key, F.posexplode_outer("subs").alias("k", "x")).select(*key, "k", F.col("x.pattern").alias("sub"), F.col("x.times").alias("times"))
    own = _frequencies(sub).select(F.col("pattern").alias("sub"), F.col("freq").alias("sub_freq"))
    rows = rows.join(own, "sub", "left").crossJoin(F.broadcast(_unseen(sub, "rare")))
    weight = F.when(F.col("sub").isNotNull(), F.col("times") * F.coalesce("sub_freq", "rare", F.lit(0.0))).otherwise(F.lit(0.0))
    rows = rows.groupBy(*key).agg(F.sum(weight).alias("more"), F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("rows"))
    rows = rows.join(_frequencies(core), "pattern", "left").crossJoin(F.broadcast(_unseen(core, "rare")))
    rows = rows.withColumns({"dep_coverage": F.try_divide(F.col("fixed") + F.col("more") / F.col("rows"), F.col("n")), "pattern_freq": F.coalesce("freq", "rare")})
    rows = rows.withColumn("score", F.when((F.col("pattern_freq") != 0) & (F.col("dep_coverage") != 0), harmonic("pattern_freq", "dep_coverage")))
    return rows.select("id", *_PLACES, "dep_path", "pattern", "dep_coverage", "pattern_freq", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("__copy")).drop("__copy")


def fitting(pairs: DataFrame, *, low: int = 5, high: int = 50) -> DataFrame:
    """The rows (id, head, dep, s1, e1, s2, e2, ...) that ``features`` does not filter out, all columns kept; nothing is joined (FI1, FI7, FI8)."""

    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(_batch(batch, low, high).rows))

    rows = pairs.select("id", "head", "dep", *(F.col(p).cast("int").alias(p) for p in _PLACES), *(c for c in pairs.columns if c not in ("id", "head", "dep", *_PLACES)))
    return rows.mapInArrow(run, rows.schema)


def patterns(pairs: DataFrame, *, sim_threshold: float | None = None, low: int = 5, high: int = 50) -> DataFrame:
    """(kind, pattern): core patterns of span pairs, and sub patterns once for each on-branch token (TX20, FI1, FI7, FI8, FI10).

    sim_threshold: pairs below it in column ``sim`` are left out before (FI2).
    """
    rows = pairs if sim_threshold is None else pairs.where(F.col("sim") >= sim_threshold)

    def run(batches):
        for batch in batches:
            got = _batch(batch, low, high)
            token, root, number, paths = got.forest.sub_paths(got.on)
            sub = ["" if "punct" in " ".join(p) else sub_pattern(" ".join(p)) for p in paths]
            names = sorted({x for x in sub if x})
            place = {x: k for k, x in enumerate(names)}
            own = np.array([place.get(x, -1) for x in sub], np.int64)[number] if sub else np.zeros(0, np.int64)
            each = np.unique(np.stack([root[own >= 0], own[own >= 0]]), axis=1)[1].tolist()  # once a token on the branch
            out = [*got.patterns, *(names[k] for k in each)]
            yield pa.RecordBatch.from_arrays([pa.array(["core"] * len(got.patterns) + ["sub"] * len(each), pa.string()), pa.array(out, pa.string())], names=["kind", "pattern"])

    return rows.select(F.lit(0).alias("id"), "head", "dep", *(F.col(p).cast("int").alias(p) for p in _PLACES)).mapInArrow(run, "kind string, pattern string")


def token_weights(pairs: DataFrame, sub: DataFrame) -> DataFrame:
    """(id, place, token, weight): how much each token of a sentence adds to its coverage, 0 outside (TX22).

    pairs: rows (id, tokens, head, dep, s1, e1, s2, e2); sub: (pattern, cnt). No row is filtered out.
    """
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got = _batch(batch, 0, 1 << 30, every=True)
            forest, on = got.forest, got.on
            weight = _own_weights(forest, on)
            token, _, number, paths = forest.sub_paths(weight > 0)
            told = [sub_pattern(" ".join(p)) if p[0] in MODIFIERS else None for p in paths]
            known = np.array([t is not None for t in told], bool)[number] if told else np.zeros(0, bool)
            weight[token[known]] = 1.0
            by = [""] * len(weight)
            for t, k in zip(token[known].tolist(), number[known].tolist(), strict=True):
                by[t] = told[k]
            cols = (forest.place, batch.column(7).flatten(), weight, by)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(forest.row)), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.float64(), pa.string()), strict=True))], names=["id", "place", "token", "fixed", "sub"])

    rows = pairs.select("id", "head", "dep", *(F.col(p).cast("int").alias(p) for p in _PLACES), "tokens").mapInArrow(run, f"id {kind}, place int, token string, fixed double, sub string")
    rows = rows.join(_frequencies(sub).withColumnRenamed("pattern", "sub"), "sub", "left").crossJoin(F.broadcast(_unseen(sub, "rare")))
    return rows.select("id", "place", "token", F.when(F.col("sub") == "", F.col("fixed")).otherwise(F.coalesce("freq", "rare", F.lit(0.0))).alias("weight"))


def noun_phrases(chunks: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Noun chunks (start, end, tag of the last token) without pronouns, adjacent ones joined (TX9)."""
    out: list[tuple[int, int]] = []
    for start, end, tag in chunks:
        if tag == "PRON":
            continue
        if out and out[-1][1] + 1 == start:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def merge_chunks(chunks) -> Column:
    """``noun_phrases`` as a column: chunks, an array of (start, end, tag), to an array of (start, end) (TX9)."""
    chunks = F.col(chunks) if isinstance(chunks, str) else chunks
    kept = F.transform(F.filter(chunks, lambda x: x["tag"] != "PRON"), lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    first = lambda k: F.filter(k, lambda x, i: F.coalesce(F.get(k, i - 1)["end"] + 1 != x["start"], F.lit(True)))
    last = lambda k: F.filter(k, lambda x, i: F.coalesce(F.get(k, i + 1)["start"] != x["end"] + 1, F.lit(True)))
    return let(kept, lambda k: F.transform(F.arrays_zip(first(k).alias("a"), last(k).alias("b")), lambda x: F.struct(x["a"]["start"].alias("start"), x["b"]["end"].alias("end"))))
