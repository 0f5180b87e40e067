"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Each text becomes a vector of statistics. Random cosines of it approximate a
Gaussian kernel. Partitions sum their part of the normal equations; the driver
solves the small system. A second, equally small sum over score bins gives the
isotonic curve that turns scores into probabilities.

Defined cases: a null text counts as empty and gets a score; a document or label
with a null id, and a label with a null mark or one that is no number, teach nothing; several labels of one
id teach as their mean; with no labelled text at all every score is 0.5;
other columns are never read.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm import textbytes as tb
from relgraph.llm.runtime import materialise

#: Labelled rows to fit on, in expectation: a sample by hash of the id, alike at every size.
MAX_FIT_ROWS = 20_000
FEATURES, BINS, RIDGE, GAMMA = 192, 512, 1e-3, 0.35

_upper = tb._table(lambda i: 65 <= i <= 90)
_digit = tb._table(lambda i: 48 <= i <= 57)
_space = tb._table(lambda i: i == 32 or 9 <= i <= 13)
_high = tb._table(lambda i: i >= 128)
_line = tb._table(lambda i: i == 10)
_end = tb._table(lambda i: chr(i) in ".!?")
_comma = tb._table(lambda i: chr(i) in ",;:")
_open = tb._table(lambda i: chr(i) in "()[]{}<>|/\\")
_odd = tb._table(lambda i: chr(i) in "#$%&*@^~_=+")
_bang = tb._table(lambda i: chr(i) in "!")
_cont = tb._table(lambda i: 128 <= i < 192)
CLASSES = (_upper, _digit, _space, _high, _line, _end, _comma, _open, _odd, _bang)
N_STATS = len(CLASSES) + 14


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """N_STATS figures for each text, all between about 0 and 3."""
    out = np.zeros((len(off) - 1, N_STATS))
    for a, b in tb.pieces(off):
        part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        rows = b - a
        size = np.diff(o)
        n = np.maximum(size, 1)
        x = out[a:b]
        for k, kind in enumerate(CLASSES):
            total = np.concatenate(([0], np.cumsum(kind[part])))
            x[:, k] = np.sqrt((total[o[1:]] - total[o[:-1]]) / n)
        k = len(CLASSES)
        s, e, row = tb.words(part, o, tb.SOLID)
        m = np.bincount(row, minlength=rows)
        w = np.maximum(m, 1)
        length = (e - s).astype(float)
        mean = np.bincount(row, length, rows) / w
        x[:, k] = np.log1p(size) / 5
        x[:, k + 1] = np.log1p(m) / 5
        x[:, k + 2] = mean / 8
        x[:, k + 3] = np.sqrt(np.maximum(np.bincount(row, length**2, rows) / w - mean**2, 0)) / 8
        low = tb.lower(part)
        h = tb.span_hash(tb.prefix(low), s, e)
        x[:, k + 4] = _distinct(h, row, rows) / w
        letters = tb.ALNUM[low]
        x[:, k + 5] = np.bincount(row, ~letters[e - 1], rows) / w if len(s) else 0
        x[:, k + 6] = np.bincount(row, _upper[part[s]], rows) / w if len(s) else 0
        x[:, k + 7] = np.bincount(row, length <= 3, rows) / w
        x[:, k + 8] = np.bincount(row, length >= 12, rows) / w
        # repeated words: how often the commonest and the next words follow themselves
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        x[:, k + 9] = np.bincount(row, same, rows) / w
        # lines
        ls, le, lr = tb.words(part, o, ~_line)
        lines = np.maximum(np.bincount(lr, minlength=rows), 1)
        lh = tb.span_hash(tb.prefix(part), ls, le)
        x[:, k + 10] = _distinct(lh, lr, rows) / lines
        x[:, k + 11] = np.log1p(lines) / 5
        x[:, k + 12] = np.log1p(size / lines) / 5
        g, goff = tb.shingles(h, row, rows, 3)
        x[:, k + 13] = np.diff(goff) / np.maximum(m - 2, 1)
    return out


def _distinct(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    if not len(h):
        return np.zeros(rows)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=rows)


def fourier(x: np.ndarray, model: dict) -> np.ndarray:
    """1 and FEATURES random cosines: inner products approximate a Gaussian kernel."""
    rng = np.random.Generator(np.random.PCG64(model["seed"]))
    w = rng.standard_normal((N_STATS, model["features"])) * np.sqrt(2 * model["gamma"])
    phase = rng.uniform(0, 2 * np.pi, model["features"])
    z = (x - np.array(model["mean"])) / np.array(model["scale"])
    return np.column_stack((np.ones(len(x)), np.sqrt(2 / model["features"]) * np.cos(np.clip(z, -6, 6) @ w + phase)))


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_rows: int, train) -> DataFrame:
    """(y, x): mean label and statistics of the labelled texts that may teach."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).where("_id is not null and y is not null and not isnan(y)")
    if train is not None:
        marks = marks.where(train(F.col("_id")))
    marks = marks.groupBy("_id").agg(F.avg("y").alias("y"))
    n = marks.count()
    share = min(1.0, max_rows / max(n, 1))
    marks = marks.where(F.pmod(F.xxhash64(F.lit("fit"), "_id"), F.lit(1 << 48)) < F.lit(int(share * (1 << 48))))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # max_rows bounds this side: 16 bytes a row
    found = texts.join(F.broadcast(marks), "_id").select("y", "text")

    def run(batches):
        for batch in batches:
            x = statistics(*tb.strings(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    return materialise(found.mapInArrow(run, "y double, x array<double>"), "quality-fit")


def _sums(df: DataFrame, width: int, part) -> np.ndarray:
    """The sum over partitions of part(y, x), a matrix: each of its rows is summed by itself.

    Every partition sends one row for each row of the matrix, whatever it holds.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                got = part(np.array(batch.column(0)), x)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    parts = df.mapInArrow(run, "i int, v array<double>")
    added = parts.groupBy("i").agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(width)]) if width <= 8 else (
        parts.select("i", F.posexplode("v").alias("k", "v")).groupBy("i", "k").agg(F.sum("v").alias("v")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("v"))
    )
    rows = sorted(added.collect(), key=lambda r: r["i"])
    if not rows:
        return np.zeros((0, width))
    return np.array([[r[f"v{k}"] for k in range(width)] for r in rows] if width <= 8 else [[p["v"] for p in r["v"]] for r in rows])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_FIT_ROWS, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE, seed: int = 7, train=None) -> dict:
    """A model as plain lists. train: a predicate on the id column of rows that may teach."""
    df = labelled(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, max_rows=max_rows, train=train)
    model = {"seed": seed, "features": features, "gamma": gamma / N_STATS, "mean": [0.0] * N_STATS, "scale": [1.0] * N_STATS}
    moments = _sums(df, 3, lambda y, x: np.column_stack((np.full(x.shape[1], len(x)), x.sum(0), (x**2).sum(0))))
    if not len(moments):
        return model | {"w": [0.0] * (features + 1), "knots": [0.0], "levels": [0.5]}
    n, s, q = moments.T
    model["mean"] = (s / n).tolist()
    model["scale"] = np.maximum(np.sqrt(np.maximum(q / n - (s / n) ** 2, 0)), 1e-3).tolist()

    def normal(y, x):
        z = fourier(x, model)
        return np.column_stack((z.T @ z, z.T @ y))

    a = _sums(df, features + 2, normal)
    model["w"] = np.linalg.solve(a[:, :-1] + ridge * n[0] * np.diag([1e-9, *np.ones(features)]) / features, a[:, -1]).tolist()

    def binned(y, x):
        at = _bin(fourier(x, model) @ np.array(model["w"]))
        return np.column_stack((np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)))

    count, hit = _sums(df, 2, binned).T
    model["knots"], model["levels"] = isotonic(count, hit)
    return model


def _bin(score: np.ndarray) -> np.ndarray:
    return np.clip(((score + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


def isotonic(count: np.ndarray, hit: np.ndarray) -> tuple[list, list]:
    """Pool adjacent violators over bins; knots are the pools' mean bins."""
    pools: list[list[float]] = []
    for k in np.flatnonzero(count):
        pools.append([count[k], hit[k], count[k] * (k + 0.5)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            top = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], top, strict=True)]
    # half a success and half a failure keep a pure pool from 0 and 1
    return [p[2] / p[0] / BINS * 2 - 0.5 for p in pools], [(p[1] + 0.5) / (p[0] + 1) for p in pools]


def predict(data: np.ndarray, off: np.ndarray, model: dict) -> np.ndarray:
    raw = fourier(statistics(data, off), model) @ np.array(model["w"])
    return np.interp(raw, model["knots"], np.maximum.accumulate(model["levels"]))


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every document, from its whole text alone."""
    said = json.dumps(model)

    def run(batches):
        own = json.loads(said)
        for batch in batches:
            got = predict(*tb.strings(batch.column(1)), own) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def keep(docs: DataFrame, model: dict, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents of at least that score, with all their columns."""
    said, place = json.dumps(model), docs.columns.index(text_col)

    def run(batches):
        own = json.loads(said)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(predict(*tb.strings(batch.column(place)), own) >= least))

    return docs.mapInArrow(run, docs.schema)
