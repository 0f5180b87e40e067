"""How far the sources of a language differ in their words, over integer-coded terms.

Terms of every document are counted in tasks and summed. Each language keeps the terms of
at least ``min_docs`` of its documents. Kept terms are ranged in UTF-8 order into chunks;
in a chunk, the sorted array of kept terms is the dictionary: searchsorted gives every
term an integer, bincount every source a dense vector of counts, zeros included. Since integers
keep UTF-8 order, ties are decided by them. Sums over chunks are added up by pairs of sources.

Sources of a language are dealt to blocks by hash, and a task holds two blocks and a chunk, so
neither a language, a source nor a term is held whole. Shares and divergences are integers.

Defined cases: a null text, language or source is the empty string; a group of documents
without terms, and one of a language without kept terms, has pairs of value 0; other columns
are not read; without documents there are no rows. Counts may reach 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.llm.runtime import materialise

MIN_DOCS, TOP = 10, 10
UNIT = 1_000_000_000
#: Terms that a task has at hand before it passes its counts on; bytes of a text cut at a time.
HELD, CUT = 200_000, 1 << 22
#: Sources of a block, and terms of a dense vector.
BLOCK, DENSE = 256, 2048

#: Letters in lower case, bytes of other scripts as they are; all else is between terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes):
    """Terms of a text, a few MB at a time."""
    clean, a = text.translate(_TERMS), 0
    while a < len(clean):
        b = clean.find(b" ", a + CUT) if a + CUT < len(clean) else -1
        b = len(clean) if b < 0 else b
        yield clean[a:b].split()
        a = b


def _count(batches):
    said, docs = defaultdict(Counter), defaultdict(Counter)

    def flush():
        for (lang, source), counts in said.items():
            n, of = len(counts), docs[lang, source]
            columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array([of[t] for t in counts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        said.clear()
        docs.clear()

    for b in batches:
        for lang, source, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            own, seen = said[lang, source], set()
            for part in terms(text):
                own.update(part)
                seen.update(part)
            docs[lang, source].update(seen)
        if sum(map(len, said.values())) > HELD:
            yield from flush()
    yield from flush()


def share(count: np.ndarray, total, kept: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), by steps that 64 bits hold."""
    left, of = count.astype(np.int64) + 2, np.asarray(total, np.int64) + 2 * kept
    out = np.zeros(np.broadcast_shapes(left.shape, of.shape), np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // of
        left = left % of
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Pairs:
    """One chunk of terms and one pair of blocks of a language's sources."""

    def __init__(self, key, sources, blocks, totals, kept: int, total: int, here: int, top: int):
        self.key, self.kept, self.total, self.top, self.unseen = key, kept, total, top, here
        order = sorted(range(len(sources)), key=sources.__getitem__)
        self.sources = np.array([sources[i] for i in order], object)
        self.blocks, self.totals = np.array([blocks[i] for i in order]), np.array([totals[i] for i in order], np.int64)[:, None]
        self.sums = np.zeros((len(order), len(order)), np.int64)
        self.named: list[tuple] = []

    def add(self, term: np.ndarray, source: np.ndarray, n: np.ndarray, lang_n: np.ndarray) -> None:
        """Rows sorted by term, all rows of their terms."""
        begins = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        self.unseen -= len(begins)
        words = term[begins]  # sorted: the dictionary
        ids = np.searchsorted(words, term)
        who = np.searchsorted(self.sources, source)
        s, w = len(self.sources), len(words)
        counts = np.bincount(who * w + ids, n, s * w).astype(np.int64).reshape(s, w)
        p = share(counts, self.totals, self.kept)
        same = self.key[2] == self.key[3]
        for a in range(s):
            others = np.arange(a + 1, s) if same else np.flatnonzero(self.blocks == self.key[3]) if self.blocks[a] == self.key[2] else []
            for k in range(0, len(others), 64):
                b = others[k : k + 64]
                self.sums[a, b] += divergence(p[a], p[b]).sum(1)
        if same:
            q = share(lang_n[begins], self.total, self.kept)
            f = np.where((counts > 0) & (p > q), divergence(p, q), -1)
            for a in range(s):
                own = np.flatnonzero(f[a] >= 0)
                best = own[np.lexsort((own, -f[a, own]))][: self.top]
                self.named += [(self.sources[a], words[i], int(f[a, i])) for i in best]

    def rows(self) -> pa.RecordBatch:
        same = self.key[2] == self.key[3]
        if self.unseen:  # terms of the chunk that no source here has
            p = share(np.zeros((len(self.sources), 1), np.int64), self.totals, self.kept)
            self.sums += self.unseen * divergence(p, p.T)
        a, b = np.triu_indices(len(self.sources), 1) if same else np.nonzero((self.blocks == self.key[2])[:, None] & (self.blocks == self.key[3])[None, :])
        value = self.sums[a, b].tolist() * 2
        name = self.sources.tolist()
        left, right = [name[i] for i in a], [name[i] for i in b]
        source, item = [*left, *right, *(x for x, _, _ in self.named)], [*(x.encode() for x in right), *(x.encode() for x in left), *(t for _, t, _ in self.named)]
        part = ["pair"] * len(value) + ["term"] * len(self.named)
        value += [v for _, _, v in self.named]
        return pa.RecordBatch.from_arrays([pa.array([self.key[0]] * len(value), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.binary()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


def counted(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, lang_n, first, chunk): kept terms of each group, ranged in UTF-8 order of language and term."""
    rows = _named(docs).select("lang", "source", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = rows.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = rows.repartitionByRange("lang", "term").withColumns({"all": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return rows.where(F.col("all") >= min_docs).select("lang", "term", "source", "n", "lang_n", "first", F.spark_partition_id().alias("chunk"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("lang", "source")})


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, dense: int = DENSE) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group (lang, source) of documents.

    part ``pair``: each other source of the language and its divergence, summed over all kept
    terms; part ``term``: the ``top`` kept terms of which the group has a larger share than the language.
    """
    spark = docs.sparkSession
    kept = materialise(counted(docs, min_docs), "audit-terms")
    groups = _named(docs).select("lang", "source").distinct()
    groups = materialise(groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"]), "audit-groups")
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).join(kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kept"), F.sum("n").alias("total")), "lang", "left").fillna(0)
    chunks = kept.groupBy("lang", "chunk").agg(F.sum(F.col("first").cast("long")).alias("here")).unionByName(langs.select("lang", F.lit(-1).alias("chunk"), F.lit(0).cast("long").alias("here")))  # every pair has a value
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")

    def dealt(rows: DataFrame, *more) -> DataFrame:
        rows = rows.withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        return rows.select("lang", "chunk", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), *more)

    ends = dealt(groups.join(langs, "lang").join(chunks, "lang"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("term"), "source", "own", "n", "kept", "total", "here")
    said = dealt(kept.join(langs.select("lang", "blocks"), "lang"), F.lit(1).alias("kind"), "term", "source", "own", "n", F.lit(0).cast("long").alias("kept"), F.col("lang_n").alias("total"), F.lit(0).cast("long").alias("here"))

    def run(batches):
        now, key, held = None, None, []

        def flush(last: bool):
            """Whole terms of what is held go into the sums."""
            nonlocal held
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
            new = np.append(True, columns[0][1:] != columns[0][:-1])
            begins = np.append(np.flatnonzero(new), len(new))
            stop = len(begins) - 1 if last else len(begins) - 2
            for k in range(0, stop, dense):
                a, b = begins[k], begins[min(k + dense, stop)]
                now.add(*(c[a:b] for c in columns))
            if not last:
                held = [[c[begins[stop] :] for c in columns]]

        for b in batches:
            lang, source, term = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 6, 5))
            chunk, i, j, kind, at, n, kept_, total, here = (np.asarray(b.column(k)) for k in (1, 2, 3, 4, 7, 8, 9, 10, 11))
            cut = np.flatnonzero(np.append(True, (lang[1:] != lang[:-1]) | (chunk[1:] != chunk[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (kind[1:] != kind[:-1]))) if len(lang) else []
            for x, y in zip(cut, np.append(cut[1:], len(lang)).astype(int), strict=True):
                if (lang[x], chunk[x], i[x], j[x]) != key:
                    if now is not None:
                        if held:
                            flush(True)
                        yield now.rows()
                    key, now, ends_ = (lang[x], chunk[x], i[x], j[x]), None, []
                if not kind[x]:
                    ends_.append((source[x:y].tolist(), at[x:y].tolist(), n[x:y].tolist()))
                    now = Pairs(key, *(sum(c, []) for c in zip(*ends_, strict=True)), int(kept_[x]), int(total[x]), int(here[x]), top)
                    continue
                held.append([term[x:y], source[x:y], n[x:y], total[x:y]])
                if sum(len(h[0]) for h in held) >= 1 << 16:
                    flush(False)
        if now is not None:
            if held:
                flush(True)
            yield now.rows()

    key = ["lang", "chunk", "i", "j"]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.unionByName(said).repartitionById(tasks, F.pmod(F.col("chunk") + 7919 * F.col("i") + 104729 * F.col("j"), F.lit(tasks)))
    rows = rows.sortWithinPartitions(*key, "kind", "term", "source").select(*key, "kind", "term", "source", "own", "n", "kept", "total", "here")
    found = materialise(rows.mapInArrow(run, "lang string, source string, part string, item binary, value long"), "audit-parts")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = [r.withColumn("rank", F.row_number().over(place)) for r in (pairs, found.where("part = 'term'"))]
    out = ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
    return out.select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
