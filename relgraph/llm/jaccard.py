"""Similarity self-join on word shingles by chosen paths.

A set goes down a tree of shared samples: at every node, each of its tokens is
chosen with probability BOOST / (similarity * size) by a hash of the node and the
token, and the set goes on to the children of its chosen tokens. Similar sets choose
one common token in the mean at the first node and DEEP below, so the chance that a
pair meets in a tree, however deep, is known, and some independent trees
bring it together with the target recall. Small buckets are compared by
brute force; a large bucket is split further by sampled tokens, unless that
does not cut its pairs by half, as with a group of near copies, which is compared in
blocks. One-bit minwise sketches of 64 bits, as in Christiani, Pagh and Sivertsen
(2018), tell first which members of a bucket can be similar; only these send
their whole sets, on which every candidate is verified.

Documents with equal sets are one class, and only classes are compared. A class goes
by a number of 64 bits; sets, told apart by 128 bits, that would share a number get
others. A pair
that shares several buckets is counted in the least of them alone, so links are
counted without being listed; a bucket gives at most one edge a member for the
components.

Defined cases: null and empty texts, and texts without words, have no shingle and
link to nothing, not even each other; a text of fewer words than a shingle is one
shingle; repeated ids are repeated documents; rows with a null id are compared
and returned with the ids null; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.llm import textbytes as tb
from relgraph.llm.components import components
from relgraph.llm.runtime import materialise

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Members of a bucket that is not split; members of a block of one that splitting does not help.
SMALL, BLOCK = 1024, 1024
#: Tokens chosen below the first level, in the mean of the least similar pair, and levels at most.
DEEP, LEVELS = 3.0, 8
#: Equal bits of 64 that similar sets have at least: 6 standard deviations below the mean
#: of the least similar pair, so a sketch loses one pair in eight million (binomial tail, 1.2e-7).
SIGMAS = 6.0
#: Bytes of sets that are compared at a time; blocks of more are dealt into smaller ones.
BLOCK_BYTES = 256 << 20
#: Rows of ids (24 bytes) that may go to every task instead of shuffling texts.
BROADCAST_ROWS = 400_000
U = np.uint64


def runs(recall: float) -> int:
    """Trees until the least similar pair has met with that probability, whatever is split on the way.

    Its common tokens are at least ``similarity`` of the larger set, so at a node the number of them that are
    chosen is at least a Poisson number, of mean 1 first and DEEP below. A node leads to a common bucket without
    limit of depth with probability s = 1 - exp(-DEEP s); a tree does not with exp(-s).
    """
    s = 1.0
    for _ in range(100):
        s = 1 - math.exp(-DEEP * s)
    return math.ceil(-math.log(1 - recall) / s)


def sets(data: np.ndarray, off: np.ndarray, words: int = WORDS):
    """Pieces of (first row, rows, sorted distinct shingle hashes, offsets)."""
    for a, b in tb.pieces(off):
        low = tb.lower(data[off[a] : off[b]])
        s, e, row = tb.words(low, off[a : b + 1] - off[a], tb.ALNUM)
        yield a, b - a, *tb.shingles(tb.span_hash(tb.prefix(low), s, e), row, b - a, words)


def _level(size: np.ndarray, rate: float) -> np.ndarray:
    """Hashes below this are chosen."""
    return np.minimum(rate / np.maximum(size, 1) * 2.0**64, 2.0**64 - 2048).astype(U)


def _first(h: np.ndarray, cut: np.ndarray, n_runs: int, similarity: float):
    """(set, bucket) of the first level of every tree."""
    size = np.diff(cut)
    row = np.repeat(np.arange(len(size)), size)
    most = _level(size, 1 / similarity)[row]
    who, where = [], []
    for seed in tb.seeds(n_runs, 31):
        on = np.flatnonzero(tb.mix(h ^ seed) <= most)
        who.append(row[on])
        where.append(tb.mix(h[on] + seed))
    return np.concatenate(who), np.concatenate(where)


def least_bits(similarity: float) -> int:
    p = (1 + similarity) / 2
    return max(0, math.floor(64 * p - SIGMAS * math.sqrt(64 * p * (1 - p))))


_SKETCH = tb.seeds(64, 53) | U(1)


def _sketch(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One bit of the least of each of 64 hashes of a set; sets are not empty."""
    out = np.zeros(len(cut) - 1, U)
    h = h ^ (h >> U(32))
    for k, m in enumerate(_SKETCH):
        low = np.minimum.reduceat(h * m, cut[:-1])
        out |= (tb.mix(low) & U(1)) << U(k)
    return out


def _children(h: np.ndarray, bucket: int, rate: float, salt: int) -> np.ndarray:
    seed = tb.mix(np.array([bucket], np.int64).view(U) + U(salt))
    on = tb.mix(h ^ seed) <= _level(np.array([len(h)]), rate)
    return tb.mix(h[on] + seed * U(3)).view(np.int64)


def documents(docs: DataFrame, *, id_col: str, text_col: str, words: int, similarity: float, n_runs: int) -> DataFrame:
    """(id, th, s1, s2, n, sketch, buckets) of every row: its text's hash, its set by two hashes and its size, its first buckets."""

    def run(batches):
        for batch in batches:
            s1, s2, size, sketch, lists = [], [], [], [], []
            for _, rows, h, cut in sets(*tb.strings(batch.column(2)), words):
                n = np.diff(cut)
                full = n > 0
                for out, salt in ((s1, 1), (s2, 2)):
                    x = np.zeros(rows, U)
                    if full.any():
                        x[full] = np.add.reduceat(tb.mix(h + U(salt)), cut[:-1][full])
                    out.append(x.view(np.int64))
                x = np.zeros(rows, U)
                x[full] = _sketch(h, np.append(cut[:-1][full], len(h))) if full.any() else 0
                sketch.append(x.view(np.int64))
                size.append(n)
                who, where = _first(h, cut, n_runs, similarity)
                order = np.lexsort((where, who))
                at = np.searchsorted(who[order], np.arange(rows + 1))
                where = where[order].view(np.int64)
                lists += [where[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(np.concatenate(x), pa.int64()) for x in (s1, s2, size, sketch)), pa.array(lists, pa.list_(pa.int64()))], names=["id", "th", "s1", "s2", "n", "sketch", "buckets"])

    kind = docs.schema[id_col].dataType.simpleString()
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th")
    return docs.select(F.col(id_col).alias("id"), th, text_col).mapInArrow(run, f"id {kind}, th long, s1 long, s2 long, n long, sketch long, buckets array<long>")


def _sets_of(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """(class, set) of wanted (class, doc, th), from one more scan of the texts."""
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    on = (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col("th")) & F.col("id").eqNullSafe(F.col("doc"))

    def run(batches):
        for batch in batches:
            raw = [h[x:y].tobytes() for _, _, h, cut in sets(*tb.strings(batch.column(1)), words) for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["class", "set"])

    return texts.join(side, on).select("class", "text").mapInArrow(run, "class long, set binary")


def _offspring(big: DataFrame, sets_: DataFrame, similarity: float, salt: int) -> DataFrame:
    """(bucket, class, child): the chosen tokens of rows (bucket, class, times), times DEEP in the mean of a similar pair."""

    def run(batches):
        for batch in batches:
            parent, who, child = [], [], []
            for b, c, times, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                got = _children(np.frombuffer(raw, U), b, DEEP * times / similarity, salt)
                parent += [b] * len(got)
                who += [c] * len(got)
                child += got.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (parent, who, child)], names=["bucket", "class", "child"])

    rows = big.join(sets_, "class").select("bucket", "class", "times", "set").mapInArrow(run, "bucket long, class long, child long")
    return materialise(rows, "jaccard-children")


def _split(big: DataFrame, sets_: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Buckets that stay (to be compared in blocks), and the next level of the others.

    A bucket that stands for several with the same members (times) is split for each of them, once it is
    known that splitting helps, so no pair loses the chances of independent trees.
    """
    pairs = lambda n: F.col(n).cast("double") * (F.col(n) - 1)
    large = lambda rows: materialise(rows.groupBy("bucket", "child").agg(F.count("*").alias("c")).where("c > 1"), "jaccard-counts")
    rows = _offspring(big.withColumn("times", F.lit(1)), sets_, similarity, 77)
    counts = large(rows)
    work = counts.groupBy("bucket").agg(F.sum(pairs("c")).alias("after"))
    parents = big.select("bucket", "m").distinct().join(work, "bucket", "left")
    good = F.coalesce("after", F.lit(0.0)) <= 0.5 * pairs("m")
    parents = materialise(parents.select("bucket", good.alias("good")), "jaccard-parents")
    stay = big.join(parents.where("not good"), "bucket").select("bucket", "m", "class")

    def kept(rows, counts):
        some = materialise(counts.join(parents.where("good"), "bucket").select("bucket", "child", F.col("c").alias("m")), "jaccard-kept")
        if some.count() <= BROADCAST_ROWS:  # 24 bytes a row; beyond that a hot child is a skewed key of a plain shuffle
            some = F.broadcast(some)
        return rows.join(some, ["bucket", "child"]).select(F.col("child").alias("bucket"), "class")

    down = kept(rows, counts)
    again = big.where("times > 1").join(parents.where("good"), "bucket").withColumn("times", F.col("times") - 1)
    if not again.isEmpty():
        more = _offspring(again, sets_, similarity, 78)
        down = down.unionByName(kept(more, large(more)))
    return stay, down


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, m, times, class) of rows (bucket, class): buckets of two and more; ``times`` of them with equal members are one."""
    marks = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.xxhash64("class") % F.lit(1 << 40)).alias("sum"), F.bit_xor(F.xxhash64(F.lit(7), "class")).alias("xor"))
    kept = marks.where("m > 1").groupBy("m", "sum", "xor").agg(F.min("bucket").alias("bucket"), F.count("*").alias("times")).select("bucket", "m", "times")
    return rows.join(kept, "bucket").select("bucket", "m", "times", "class")


def _dealt(buckets: DataFrame) -> DataFrame:
    """(bucket, x, y, block, class): every pair of members meets in one pair of blocks (x, y)."""
    n = F.ceil(F.col("m") / BLOCK)
    n = F.when(F.col("m") <= BLOCK, 1).otherwise(n).cast("int")
    rows = buckets.select("bucket", "class", n.alias("nb"), F.pmod(F.xxhash64(F.lit("block"), "class"), n).cast("int").alias("block"))
    rows = rows.select("bucket", "class", "block", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k"))
    return rows.select("bucket", F.least("block", "k").alias("x"), F.greatest("block", "k").alias("y"), "block", "class")


_GROUP = ["bucket", "x", "y", "u", "v"]


def _by_bytes(needed: DataFrame, sizes: DataFrame) -> DataFrame:
    """needed (bucket, x, y, block, class) with sub, u, v: groups whose sets are too many bytes are dealt into pairs (u, v) of smaller ones."""
    key = ["bucket", "x", "y"]
    heavy = needed.join(sizes, "class").groupBy(*key).agg(F.sum(F.col("n") * 8).alias("bytes")).where(F.col("bytes") > BLOCK_BYTES)
    heavy = materialise(heavy.select(*key, F.ceil(2 * F.col("bytes") / F.lit(BLOCK_BYTES)).cast("int").alias("p")), "jaccard-heavy")
    if heavy.isEmpty():
        return needed.withColumns({k: F.lit(0) for k in ("sub", "u", "v")})
    rows = needed.join(heavy, key, "left").withColumn("p", F.coalesce("p", F.lit(1)))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64(F.lit("sub"), "class"), F.col("p")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("p") - 1)))
    return rows.withColumns({"u": F.least("sub", "k"), "v": F.greatest("sub", "k")}).drop("p", "k")


def _by_task(rows: DataFrame, work, group: list[str], names: list[str]) -> DataFrame:
    """work(key, members) over rows that share the columns of group; a task holds one such group at a time."""
    rows = rows.repartition(*group).sortWithinPartitions(*group, "block", "class")

    def run(batches):
        key, held, done = None, [], []

        def out():
            cols = list(zip(*done, strict=True)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for batch in batches:
            for r in batch.to_pylist():
                k = tuple(r[g] for g in group)
                if k != key:
                    if len(held) > 1:
                        done.extend(work(key, held))
                    key, held = k, []
                    if len(done) > 10_000:
                        yield out()
                if not held or held[-1]["class"] != r["class"]:  # repeated rows of a document
                    held.append(r)
        if len(held) > 1:
            done.extend(work(key, held))
        yield out()

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _before(held: list, bucket: int) -> np.ndarray:
    """Which pairs share a bucket before this one, where they are compared."""
    lists = [np.asarray(r["buckets"]) for r in held]
    lists = [x[: np.searchsorted(x, bucket)] for x in lists]
    row = np.repeat(np.arange(len(held)), [len(x) for x in lists])
    _, col = np.unique(np.concatenate(lists), return_inverse=True)
    met = np.zeros((len(held), len(held)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for k in range(0, int(col.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(col, (k, k + 4096))
        m = np.zeros((len(held), int(col[b - 1]) - k + 1 if b > a else 1), np.float32)
        m[row[a:b], col[a:b] - k] = 1
        met += m @ m.T
    return met > 0


def _open(key: tuple, held: list, bits: int) -> np.ndarray:
    """Which pairs of members this task has to verify, as an upper triangle."""
    bucket, x, y, u, v = (*key, 0, 0)[:5]
    mark = np.array([r["sketch"] for r in held], np.int64).view(U)
    todo = np.bitwise_count(mark[:, None] ^ mark[None, :]) <= 64 - bits
    if x != y:
        block = np.array([r["block"] for r in held])
        todo &= block[:, None] != block[None, :]
    if u != v:
        sub = np.array([r["sub"] for r in held])
        todo &= sub[:, None] != sub[None, :]
    todo = np.triu(todo, 1)
    return todo & ~_before(held, bucket) if todo.any() else todo


def _needed(bits: int):
    def work(key, held):
        todo = _open(key, held, bits)
        for k in np.flatnonzero(todo.any(0) | todo.any(1)):
            yield *key, held[k]["block"], held[k]["class"]

    return work


def _common(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the members' sets and of all their intersections."""
    own = [np.frombuffer(r["set"], U) for r in held]
    size = np.array([len(x) for x in own])
    token, row = np.concatenate(own), np.repeat(np.arange(len(own)), size)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    group = np.cumsum(new) - 1
    shared = np.bincount(group)[group] > 1
    group, row = np.unique(group[shared], return_inverse=True)[1], row[shared]
    common = np.zeros((len(own), len(own)), np.float32)  # whole numbers below 2^24 are exact
    for k in range(0, int(group.max(initial=-1)) + 1, 4096):
        a, b = np.searchsorted(group, (k, k + 4096))
        m = np.zeros((len(own), int(group[b - 1]) - k + 1), np.float32)
        m[row[a:b], group[a:b] - k] = 1
        common += m @ m.T
    return size, common


def _linked(similarity: float):
    def work(key, held):
        size, common = _common(held)
        ok = common.astype(float) >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
        i, j = np.nonzero(ok & _open(key, held, least_bits(similarity)))
        if not len(i):
            return
        copies = np.array([r["size"] for r in held])
        links = np.bincount(i, copies[j], len(held)) + np.bincount(j, copies[i], len(held))
        root = list(range(len(held)))

        def find(k):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        for k in np.flatnonzero(links):
            yield held[k]["class"], int(links[k]), held[find(k)]["class"]

    return work


def _number(again: int):
    """The number of a set's class; another one for each time that it was another set's too."""
    return F.xxhash64(*([F.lit(again)] if again else []), "s1", "s2")


def _classes(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``documents`` with class (null without shingles), and one row for each class."""
    every, again = every.withColumn("class", F.when(F.col("n") > 0, _number(0))), 0
    while True:
        # equal sets are summed before the shuffle; they have equal buckets
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep")
        mixed = (F.min("s1") != F.max("s1")) | (F.min("s2") != F.max("s2"))
        whole = every.where("n > 0").groupBy("class").agg(least, F.count("*").alias("size"), *(F.first(c).alias(c) for c in ("n", "sketch", "buckets")), mixed.alias("mixed"))
        whole = materialise(whole.select("class", F.col("rep.id").alias("doc"), F.col("rep.th").alias("th"), "size", "n", "sketch", "buckets", "mixed"), "jaccard-classes")
        clash = whole.where("mixed").select("class", "mixed")
        if clash.isEmpty():
            return every, whole.drop("mixed")
        again += 1
        every = materialise(every.join(clash, "class", "left").withColumn("class", F.when(F.col("mixed"), _number(again)).otherwise(F.col("class"))).drop("mixed"), "jaccard-docs")


def join(docs: DataFrame, *, id_col: str = "doc_id", **more) -> DataFrame:
    """One row for each document: id, class_id, n_links, copy_id.

    class_id: the least id of the documents that links connect it to, its own
    among them; copy_id: the least id of the documents with an equal set; n_links:
    how many other documents have that similarity to it, copies included.
    """
    return groups(docs, id_col=id_col, **more).select(id_col, "class_id", "n_links", "copy_id")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``join`` with th, the hash of the text, and leads: whether (id, th) is its group's least.

    Null ids come after all others. Documents without shingles are groups of their own.
    """
    given = {"id_col": id_col, "text_col": text_col, "words": words}
    every = materialise(documents(docs, similarity=similarity, n_runs=runs(recall), **given), "jaccard-docs")
    every, whole = _classes(every)
    place = whole.select("class", "doc", "th")
    now = _distinct_buckets(whole.select("class", F.explode(F.array_distinct("buckets")).alias("bucket")))
    final = materialise(now, "jaccard-buckets")
    big = final.where(F.col("m") > SMALL)
    if not big.isEmpty():
        done = final.where(F.col("m") <= SMALL).drop("times")
        own = materialise(_sets_of(docs, big.select("class").distinct().join(place, "class"), **given), "jaccard-sets")
        for _ in range(LEVELS):
            if big.isEmpty():
                break
            stay, down = _split(big, own, similarity)
            down = materialise(_distinct_buckets(down.select("bucket", "class").distinct()), "jaccard-buckets")
            done = done.unionByName(stay).unionByName(down.where(F.col("m") <= SMALL).drop("times"))
            big = down.where(F.col("m") > SMALL)
        final = materialise(done.unionByName(big.drop("times")), "jaccard-buckets")
    lists = materialise(final.groupBy("class").agg(F.sort_array(F.collect_list("bucket")).alias("buckets")).join(whole.select("class", "size", "sketch"), "class"), "jaccard-lists")
    needed = _by_task(_dealt(final).join(lists.select("class", "buckets", "sketch"), "class"), _needed(least_bits(similarity)), _GROUP[:3], ["bucket", "x", "y", "block", "class"])
    needed = _by_bytes(materialise(needed, "jaccard-needed"), whole.select("class", "n"))
    # the texts are read again for the classes that may have a similar one
    own = _sets_of(docs, needed.select("class").distinct().join(place, "class"), **given)
    links = _by_task(own.join(needed, "class").join(lists, "class"), _linked(similarity), _GROUP, ["class", "links", "root"])
    links = materialise(links, "jaccard-links")
    # classes are joined by number, then named by their least document
    roots = components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    named = whole.select("class", "doc", "th", "size").join(links.groupBy("class").agg(F.sum("links").alias("links")), "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("class", "doc", "th", "size", "links", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "th")).alias("lead"))
    least = least.select("root", F.col("lead.doc").alias("class_id"), F.col("lead.th").alias("lead_th"))
    out = named.join(least, "root").select("class", "class_id", "lead_th", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.col("doc").alias("copy_id"))
    # documents without shingles have no class and stand alone
    rows = every.select("id", "th", "class").join(out, "class", "left")
    leads = F.when(F.col("lead_th").isNull(), True).otherwise(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("lead_th")))
    return rows.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_id", "id").alias("copy_id"), "th", leads.alias("leads"))
