"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components.

Every distinct vector gets, in each table, the signs of its products with random
hyperplanes. Vectors that share all signs of a table are compared by their cosine in double
precision. A pair counts in the first table that both share, so that links are counted once
however often they are met. Buckets of over BLOCK vectors are cut into blocks, and pairs of
blocks are dealt to tasks. A bucket hands on counts, and for its components one edge a
vector, never its pairs; components of the whole come from rounds of joins.

The signs of a table are so many that a random bucket holds few vectors; tables are as many
as find a pair at the threshold itself with the chance ``recall``, closer ones with more.
Products are of whole numbers below 2^53, exact in any order, so that signs agree in every task.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components
links with nothing, as does a row without an id; both are kept and are their own component
(of a null id: null). Equal vectors count as links of each other, also of rows of one id;
vectors of different lengths have no cosine; other columns are not read.
"""

from __future__ import annotations

from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.functions.text import let
from relgraph.llm.components import components
from relgraph.llm.runtime import discard, materialise

THRESHOLD, RECALL = 0.95, 0.999
#: Members of a bucket that are compared with each other in one go.
BLOCK = 1024
#: Pairs of small buckets that are looked at together.
PAIRS = 1 << 18
SCALE = 1 << 20


def tables_for(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Signs of a table, and tables, for n vectors."""
    bits = min(40, max(8, ceil(log2(max(n, 2))) + 2))
    met = (1 - acos(threshold) / pi) ** bits
    return bits, max(1, ceil(log(1 - recall) / log(1 - met)))


class Planes:
    """Hyperplanes of vectors of one length."""

    def __init__(self, dim: int, bits: int, tables: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.normals = np.round(rng.normal(size=(dim, tables * bits)) * 1024)
        self.bits, self.tables = bits, tables
        self.powers = 2.0 ** np.arange(bits)

    def signs(self, units: np.ndarray) -> np.ndarray:
        """(vectors, tables) of whole numbers."""
        above = np.round(units * SCALE) @ self.normals >= 0
        return (above.reshape(len(units), self.tables, self.bits) @ self.powers).astype(np.int64)


def _vectors(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), dim)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def _pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All x < y within groups that stand one after another."""
    n, begins = int(sizes.sum()), np.cumsum(sizes) - sizes
    ends = np.repeat(begins + sizes, sizes)
    after = ends - np.arange(n) - 1
    x = np.repeat(np.arange(n), after)
    return x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)


def least_of(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least row that each of n rows is linked to by pairs (x, y)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def classes_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(v, least, m, c, u): distinct vectors that have a direction, the least id and the number of their rows; u has length one."""
    x = F.col(vector_col)
    fit = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = vectors.where(fit).groupBy(x.alias("v")).agg(F.min(id_col).alias("least"), F.count("*").alias("m"))
    most = F.array_max(F.transform("v", lambda e: F.abs(e.cast("double"))))
    scaled = let(most, lambda m: F.transform("v", lambda e: e.cast("double") / m))  # so that squares neither vanish nor overflow
    length = lambda w: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, e: a + e * e))
    unit = let(scaled, lambda w: let(length(w), lambda n: F.transform(w, lambda e: e / n)))
    return rows.withColumns({"u": unit, "c": F.monotonically_increasing_id()})


def _buckets(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(t, dim, sign, c, n): in each table the bucket of every vector that is not alone in it; n is its size."""

    def run(batches):
        planes: dict[int, Planes] = {}
        for b in batches:
            dims = np.asarray(b.column(1))
            for dim in np.unique(dims):
                p = planes.setdefault(dim, Planes(dim, bits, tables, seed))
                own = b.filter(pa.array(dims == dim))
                for k in range(0, own.num_rows, 256):
                    part = own.slice(k, 256)
                    s = p.signs(_vectors(part.column(2), dim))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables), len(s)), pa.int32()), pa.array(np.full(s.size, dim), pa.int32()), pa.array(s.ravel()), pa.array(np.repeat(np.asarray(part.column(0)), tables))], names=["t", "dim", "sign", "c"])

    signs = materialise(classes.select("c", F.size("u").alias("dim"), "u").mapInArrow(run, "t int, dim int, sign long, c long"), "neardup-signs")
    size = signs.groupBy("t", "dim", "sign").agg(F.count("*").alias("n")).where("n > 1")
    return signs.join(size, ["t", "dim", "sign"])


def links(classes: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(c, other, n): parts of the links of distinct vectors; other is a vector of the same component, n counts rows."""
    bits, tables = tables_for(classes.count(), threshold, recall)
    met = _buckets(classes, bits, tables, seed)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("c"), blocks).cast("int")
    met = met.select("t", "dim", "sign", "c", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    met = met.select("t", "dim", "sign", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), F.col("own").alias("side"), "c")
    met = met.join(classes.select("c", "m", "u"), "c")
    key = ["t", "dim", "sign", "i", "j"]

    def run(batches):
        planes: dict[int, Planes] = {}

        def found(t, c, m, u, side, x, y, count):
            """Rows of linked pairs x, y; count: whether a pair is counted here, not in the blocks' own comparison."""
            p = planes.setdefault(u.shape[1], Planes(u.shape[1], bits, tables, seed))
            rows = np.unique(np.concatenate([x, y]))
            if not len(rows):
                return None
            signs = np.zeros((len(c), tables), np.int64)
            signs[rows] = p.signs(u[rows])
            total = np.zeros(len(c), np.int64)
            for k in range(0, len(x), PAIRS // 16):
                a, b, tt = x[k : k + PAIRS // 16], y[k : k + PAIRS // 16], t[x[k : k + PAIRS // 16]]
                first = (signs[a] == signs[b]).argmax(1) == tt  # the first table they share
                first &= count[k : k + PAIRS // 16]
                np.add.at(total, a[first], m[b[first]])
                np.add.at(total, b[first], m[a[first]])
            label = least_of(len(c), x, y)
            return pa.RecordBatch.from_arrays([pa.array(c[rows]), pa.array(c[label[rows]]), pa.array(total[rows])], names=["c", "other", "n"])

        def small(t, c, m, u, side, sizes):
            """Many groups of a block each, one after another."""
            cut = np.cumsum(sizes * (sizes - 1) // 2) // PAIRS
            for part in np.unique(cut):
                g = np.flatnonzero(cut == part)
                a = int(sizes[: g[0]].sum())
                b = a + int(sizes[g].sum())
                x, y = _pairs_of(sizes[g])
                near = np.concatenate([np.einsum("ij,ij->i", u[a:b][x[k : k + 8192]], u[a:b][y[k : k + 8192]]) >= threshold for k in range(0, len(x), 8192)] or [np.zeros(0, bool)])
                if near.any():
                    yield found(t[a:b], c[a:b], m[a:b], u[a:b], side[a:b], x[near], y[near], np.ones(int(near.sum()), bool))

        def large(t, c, m, u, side, pair):
            """One group: a block with itself, or two blocks; what either holds by itself is counted in its own comparison."""
            left, right = (np.flatnonzero(side == pair[0]), np.flatnonzero(side == pair[1]))
            for k in range(0, len(left), 256):
                rows = left[k : k + 256]
                hit = u[rows] @ u[right].T >= threshold
                x, y = np.nonzero(hit)
                x, y = rows[x], right[y]
                if pair[0] == pair[1]:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    yield found(t, c, m, u, side, x, y, np.ones(len(x), bool))

        def close(held, key):
            t, c, m, side = (np.concatenate([h[k] for h in held]) for k in range(4))
            u = np.concatenate([h[4] for h in held])
            yield from large(t, c, m, u, side, (key[3], key[4]))

        held, key, size = [], None, 0
        for b in batches:
            t, dim, sign, i, j, side, c, m = (np.asarray(b.column(k)) for k in range(8))
            cut = _runs(t, dim, sign, i, j)
            ends = np.append(cut[1:], len(t)).astype(np.int64)
            keys = [tuple(int(col[a]) for col in (t, dim, sign, i, j)) for a in cut]
            whole = []  # small groups that lie inside this batch
            for g, (a, e) in enumerate(zip(cut, ends, strict=True)):
                inside = 0 < g < len(cut) - 1 and i[a] == j[a] and e - a <= 64
                if inside:
                    whole.append(g)
                    continue
                if keys[g] != key:
                    if held:
                        yield from close(held, key)
                    held, key = [], keys[g]
                held.append((t[a:e], c[a:e], m[a:e], side[a:e], _vectors(b.column(8).slice(a, e - a), dim[a])))
            for d in {int(dim[cut[g]]) for g in whole}:
                own = [g for g in whole if dim[cut[g]] == d]
                rows = np.concatenate([np.arange(cut[g], ends[g]) for g in own])
                u = _vectors(b.column(8).take(pa.array(rows)), d)
                yield from small(t[rows], c[rows], m[rows], u, side[rows], ends[own] - cut[own])
        if held:
            yield from close(held, key)

    rows = met.repartition(*key).sortWithinPartitions(*key).select(*key, "side", "c", "m", "u")
    return rows.mapInArrow(run, "c long, other long, n long")


def join(vectors: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """(id, n_links, component_id) of every row: links to other rows, and the least id that links reach."""
    classes = materialise(classes_of(vectors, id_col, vector_col), "neardup-classes")
    found = materialise(links(classes, threshold=threshold, recall=recall, block=block, seed=seed), "neardup-links")
    total = found.groupBy("c").agg(F.sum("n").alias("n"))
    edges = found.where("c <> other").select(F.col("c").alias("a"), F.col("other").alias("b"))
    of = materialise(components(edges), "neardup-components").withColumnRenamed("node", "c")
    roots = of.join(classes.select("c", "least"), "c").groupBy("root").agg(F.min("least").alias("root_id"))
    known = classes.join(total, "c", "left").join(of.join(roots, "root").select("c", "root_id"), "c", "left")
    known = known.select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("root_id", "least").alias("component"))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(F.col(id_col).isNotNull(), F.col(vector_col)).alias("v"))
    out = rows.join(known, "v", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
