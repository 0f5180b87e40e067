"""Exact top-k inner products with an impact-ordered, score-at-a-time index.

Vectors are dealt into shards. In a shard, every dimension has a posting list cut
into LEVELS segments by quantised value, each with the least and the largest
value in it. A query processes segments by descending impact: the segment's
best contribution less the worst that its dimension can give. Sums of impacts, and
the next impact for every segment of a vector still to come, bound all scores from
above; the vectors of the highest bounds are scored to bound the k-th best from below.
Processing stops only on proof: when all but a few upper bounds are under that score,
or when no segment is left. Whatever may still be among the best is rescored exactly.

Defined cases: rows with a null id, a null vector, or null or non-finite
components take no part; of several vectors with one id the smallest counts;
only vectors of the query's length have a score with it; ties go to the smaller
id; other columns are not read. Where sums could pass 2^53, all of a shard is scored
in 64-bit integers, which scores must fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.llm.runtime import materialise

SCALE, LEVELS, SHARD = 256, 32, 8192
#: Shares of the postings after which a proof is looked for, and members that are few enough to rescore.
LOOKS, FEW = (0.6, 0.7, 0.8, 0.9), 256


class Shard:
    """The index of some integer vectors; ids ascend."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.x = ids[order], vectors[order]
        n, d = self.x.shape
        low, high = self.x.min(0), self.x.max(0)
        width = np.maximum((high - low) // LEVELS + 1, 1)
        level = (self.x - low) // width
        self.postings, lo, hi, dim = [], [], [], []
        for k in range(d):
            by = np.argsort(level[:, k], kind="stable")
            cut = np.flatnonzero(np.diff(level[by, k])) + 1
            for own in np.split(by, cut):
                self.postings.append(own)
                lo.append(self.x[own, k].min())
                hi.append(self.x[own, k].max())
                dim.append(k)
        self.lo, self.hi, self.dim = np.array(lo), np.array(hi), np.array(dim)
        self.size = np.array([len(p) for p in self.postings])
        self.low, self.high = low, high

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best."""
        n, d = self.x.shape
        other = self.ids != own
        few = np.flatnonzero(other)
        floor = np.minimum(q * self.low, q * self.high)  # the worst that a dimension can give
        gain = np.maximum(q[self.dim] * self.lo, q[self.dim] * self.hi) - floor[self.dim]
        span = np.abs(q.astype(float)) @ (self.high - self.low).astype(float)
        unit = 2.0 ** np.ceil(np.log2(span + 2))
        # one sum holds the gains of a vector's segments and, in units above them, their number
        most = max(FEW, k)
        if n > most and unit * (d + 1) < 2**53 and np.abs(self.x).max() * np.abs(q).max() * float(d) < 2**53:
            order = np.argsort(-gain, kind="stable")
            done = np.cumsum(self.size[order])
            looks = np.unique(np.append(np.searchsorted(done, done[-1] * np.array(LOOKS)) + 1, len(order)))
            total, ends = np.zeros(n), floor.sum()
            for a, b in zip(np.append(0, looks[:-1]), looks, strict=True):
                new = order[a:b]
                who = np.concatenate([self.postings[s] for s in new])
                total += np.bincount(who, np.repeat(gain[new] + unit, self.size[new]), n)
                met = np.floor(total / unit)
                ahead = gain[order[b]] if b < len(order) else 0  # no unseen segment gives more
                bound = np.where(other, ends + total - met * unit + (d - met) * ahead, -np.inf)
                likely = np.argpartition(-bound, most - 1)[:most]  # the query's own row is last of all
                few = np.flatnonzero(bound >= np.sort(self.x[likely] @ q)[-k])
                if len(few) <= most:
                    break
        score = self.x[few] @ q
        best = np.lexsort((self.ids[few], -score))[:k]
        return self.ids[few][best], score[best]


def quantise(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of every component, x as double; unfit rows left out."""
    x = F.col(vector_col)
    fit = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.where(fit).select(F.col(id_col).alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, queries, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, id, score): the k best of each query, over all shards.

    queries: a predicate on the id. A shard's vectors reach its task before the queries
    do, so its index is built once and the queries pass it by in Arrow batches: a task
    holds one shard and one batch, however many queries there are.
    """
    spark = vectors.sparkSession
    rows = materialise(quantise(vectors, id_col=id_col, vector_col=vector_col, scale=scale).where(F.size("v") > 0), "topk-vectors")
    shards = max(1, -(-rows.count() // shard))
    size = F.size("v").alias("dim")
    asked = rows.where(queries(F.col("id"))).select(size, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("asks"), "id", "v")
    every = rows.select(size, F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v").union(asked)

    def run(batches):
        key, held, index = None, [], None
        for batch in batches:
            dim, own, asks, ids = (np.asarray(batch.column(i)) for i in range(4))
            cut = np.flatnonzero(np.append(True, (dim[1:] != dim[:-1]) | (own[1:] != own[:-1]) | (asks[1:] != asks[:-1]))) if len(ids) else []
            for a, b in zip(cut, np.append(cut[1:], len(ids)), strict=True):
                if (dim[a], own[a]) != key:
                    key, held, index = (dim[a], own[a]), [], None
                x = np.asarray(batch.column(4).slice(a, b - a).flatten()).reshape(b - a, dim[a])
                if not asks[a]:
                    held.append((ids[a:b], x))
                    continue
                if index is None:
                    if not held:  # no vector of this length here
                        continue
                    index, held = Shard(*(np.concatenate(c) for c in zip(*held, strict=True))), []
                found = [index.top(q, i, k) for i, q in zip(ids[a:b], x, strict=True)]
                who = np.repeat(ids[a:b], [len(f) for f, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (who, *(np.concatenate(c) for c in zip(*found, strict=True)))], names=["query_id", "id", "score"])

    # shards are dealt by number, so no task has two while another has none
    tasks = min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = every.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("dim", "shard", "asks").mapInArrow(run, "query_id long, id long, score long")
    # a window's limit is applied before the shuffle too, so k rows a query leave each task
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
