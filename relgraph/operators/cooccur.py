"""Co-occurrence graphs of entities that share a note (a sentence, an order)."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from relgraph.sources import scratch


#: Bytes of a table's (note, ent) columns, as its files hold them, whose notes are a task: what its pairs take grows with the table otherwise.
NOTE_BYTES = 2 << 20
MOST_TASKS = 50_000


def baskets(rows: DataFrame, ent: str, note: str) -> DataFrame:
    """(note, ents): the distinct entities of each note, sorted. Large tables get as many tasks as their size asks for."""
    rows = rows.where(F.col(ent).isNotNull() & F.col(note).isNotNull()).select(F.col(note).alias("note"), F.col(ent).alias(ent))
    tasks = scratch.size_of(rows) // NOTE_BYTES
    if rows.sparkSession.sparkContext.defaultParallelism < tasks <= MOST_TASKS:  # more: a size that is not known
        rows = rows.repartition(tasks, "note")
    return rows.groupBy("note").agg(F.array_sort(F.collect_set(ent)).alias("ents"))


def pairs(lists: DataFrame) -> DataFrame:
    """(note, a, b): pairs of entities of one note in list order (JN6).

    A narrow plan, without a self-join: one row for each entity with those after it, then one for each pair,
    so that no row holds all pairs of a long note.
    """
    each = lists.select("note", "ents", F.posexplode("ents").alias("i", "a"))
    return each.select("note", "a", F.explode(F.slice("ents", F.col("i") + 2, F.size("ents"))).alias("b"))


def counts(lists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (a, b, c), nodes (ent, c) and the graph's total (z) (AG5)."""
    edges = pairs(lists).groupBy("a", "b").agg(F.count("*").alias("c"))
    nodes = lists.select(F.explode("ents").alias("ent"), (F.size("ents") - 1).alias("k")).where("k > 0").groupBy("ent").agg(F.sum("k").alias("c"))
    total = lists.agg(F.coalesce(F.sum(F.size("ents") * (F.size("ents") - 1)), F.lit(0)).alias("z"))
    return edges, nodes, total


#: Entities of a block of a long note.
BLOCK = 512


def long_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(note, a, b): pairs of entities of one note, a before b, from rows (note, ent, at), each entity of a note once (JN6).

    For notes of any length: a note is never a row. Its entities are dealt by hash to blocks of about ``block``,
    and pairs of blocks, a triangle of them, to tasks; a row holds two blocks at most.
    """
    sizes = rows.groupBy("note").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    one = rows.join(sizes, "note").withColumn("own", F.pmod(F.xxhash64("ent"), F.col("blocks")).cast("int"))
    met = one.select("note", "ent", "at", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    met = met.select("note", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).alias("right"), "at", "ent")
    held = met.groupBy("note", "i", "j").agg(F.array_sort(F.collect_list(F.struct("at", "ent", "right"))).alias("s"))
    each = held.select("note", "i", "j", "s", F.posexplode("s").alias("k", "x"))
    # within a block all, of two blocks those of one with those of the other
    after = F.filter(F.slice("s", F.col("k") + 2, F.size("s")), lambda y: (F.col("i") == F.col("j")) | (y["right"] != F.col("x.right")))
    return each.select("note", F.col("x.ent").alias("a"), F.explode(after).alias("y")).select("note", "a", F.col("y.ent").alias("b"))


def long_counts(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``counts`` of rows (note, ent, at) instead of lists (AG5)."""
    sizes = rows.groupBy("note").agg(F.count("*").alias("k"))
    edges = long_pairs(rows, block).groupBy("a", "b").agg(F.count("*").alias("c"))
    nodes = rows.join(sizes.where("k > 1"), "note").groupBy("ent").agg(F.sum(F.col("k") - 1).alias("c"))
    return edges, nodes, sizes.agg(F.coalesce(F.sum(F.col("k") * (F.col("k") - 1)), F.lit(0)).alias("z"))


#: Entities of a table that counts their pairs, notes that are counted at a time, rows of a batch of results, rows (note, ent) of a block.
COUNT_BLOCK, COUNT_NOTES, COUNT_ROWS, COUNT_HELD = 2048, 512, 1 << 18, 1 << 20
#: Pairs of blocks for each core, where there are entities enough.
COUNT_TASKS = 8


def _table(left: list, right: list, nx: int, ny: int) -> np.ndarray:
    """How many notes hold each pair; left, right: the places of a note's entities in either block."""
    table = np.zeros((nx, ny), np.int64)
    for s in range(0, len(left), COUNT_NOTES):
        xs, ys = left[s : s + COUNT_NOTES], right[s : s + COUNT_NOTES]
        if 16 * sum(len(x) * len(y) for x, y in zip(xs, ys, strict=True)) > nx * ny * len(xs):  # dense: as a product
            x, y = np.zeros((len(xs), nx), np.float32), np.zeros((len(xs), ny), np.float32)
            for k, (p, q) in enumerate(zip(xs, ys, strict=True)):
                x[k, p] = y[k, q] = 1
            table += (x.T @ y).astype(np.int64)
        else:
            for p, q in zip(xs, ys, strict=True):
                table[np.ix_(p, q)] += 1
    return table


def _cut(notes: np.ndarray, ents: np.ndarray, block: int) -> list[tuple]:
    """(entities, notes, places) for each ``block`` entities of rows (note, ent) by note: the notes that hold some of them, ascending, and where these are among the entities."""
    names, at = np.unique(ents, return_inverse=True)
    order = np.argsort(at // block, kind="stable")  # rows of a note stay together
    notes, at = notes[order], at[order]
    ends = np.searchsorted(at // block, np.arange(-(-len(names) // block) + 1))
    cut = []
    for k, (s, e) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        first = np.flatnonzero(np.append(True, notes[s + 1 : e] != notes[s : e - 1]))
        cut.append((names[k * block : (k + 1) * block], notes[s:e][first], np.split(at[s:e] - k * block, first[1:])))
    return cut


def _count_blocks(block: int):
    """A function of Arrow batches: (a, b, c) of rows (pair, note, right, ents), sorted by pair and note: ents of the one block, then those of the other, counted in tables of ``block`` entities a side."""

    def counted(rows: list) -> Iterator[pa.RecordBatch]:
        # notes by their place, and the entities of either block
        place = np.cumsum([k > 0 and rows[k][0] != rows[k - 1][0] for k in range(len(rows))])
        flat = lambda right: [np.concatenate([x[:0], *y]) for x, y in ((place, [np.full(len(r[2]), n) for n, r in zip(place, rows, strict=True) if r[1] == right]), (rows[0][2], [r[2] for r in rows if r[1] == right]))]
        left, right = (_cut(*flat(side), block) for side in (False, True))
        own = not right  # a block with itself, or with one that is not there
        for p, (xs, x_notes, x_at) in enumerate(left):
            for q, (ys, y_notes, y_at) in enumerate(left[p:] if own else right):
                _, i, j = np.intersect1d(x_notes, y_notes, assume_unique=True, return_indices=True)
                table = _table([x_at[k] for k in i], [y_at[k] for k in j], len(xs), len(ys))
                x, y = np.nonzero(np.triu(table, 1) if own and q == 0 else table)
                for s in range(0, len(x), COUNT_ROWS):
                    i, j = x[s : s + COUNT_ROWS], y[s : s + COUNT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(xs[i], ys[j]), np.maximum(xs[i], ys[j]), table[i, j])], ["a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            ents = batch.column("ents")
            offsets, flat = ents.offsets.to_numpy(), ents.values.to_numpy(zero_copy_only=False)
            for k, (pair, note, is_right) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("pair", "note", "right")), strict=True)):
                if pair != at and rows:
                    yield from counted(rows)
                    rows = []
                at = pair
                rows.append((note, is_right, flat[offsets[k] : offsets[k + 1]]))
        if rows:
            yield from counted(rows)

    return run


def ordered_counts(rows: DataFrame, block: int = COUNT_BLOCK) -> DataFrame:
    """(a, b, c), a < b: how many notes of rows (note, ent) hold both, each entity of a note once (AG5).

    ``long_counts`` in the order of entities, which are integers, without a row for each pair of a note: entities are dealt by hash to
    blocks of about COUNT_HELD rows, fewer where cores would have no work, and what notes share of each pair of blocks is counted in
    tables of ``block`` entities a side, one at a time. Rows are moved once for each block, not for each table.
    A task holds two blocks' rows and a table; other entities go by ``long_counts``.
    """
    if not isinstance(rows.schema["ent"].dataType, IntegralType):
        return long_counts(rows.withColumn("at", F.col("ent")), block)[0]
    rows = rows.where("note is not null and ent is not null")
    n, ents = rows.agg(F.count("*"), F.count_distinct("ent")).first()
    tasks = COUNT_TASKS * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, min(ceil(ents / block), max(ceil(sqrt(2 * tasks)), ceil(n / COUNT_HELD))))
    pairs = blocks * (blocks + 1) // 2
    own = F.pmod(F.xxhash64("ent"), F.lit(blocks)).cast("long").alias("own")
    lists = rows.groupBy("note", own).agg(F.collect_list(F.col("ent").cast("long")).alias("ents"))
    met = lists.select("note", "ents", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("with"))
    i, j = F.least("own", "with"), F.greatest("own", "with")
    met = met.select((j * (j + 1) / 2).cast("long").alias("of"), i.alias("i"), "note", (F.col("own") > F.col("with")).alias("right"), "ents").select((F.col("of") + F.col("i")).alias("pair"), "note", "right", "ents")
    parts = min(pairs, MOST_TASKS)
    met = met.repartitionById(parts, (F.col("pair") % parts).cast("int")).sortWithinPartitions("pair", "note")
    kind = rows.schema["ent"].dataType
    return met.select("pair", "note", "right", "ents").mapInArrow(_count_blocks(block), "a long, b long, c long").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "c")


def npmi(lists: DataFrame) -> DataFrame:
    """(a, b, c, npmi): normalised pointwise mutual information of every edge (AG6); null where 2c is the total."""
    edges, nodes, total = counts(lists)
    joined = edges.join(nodes.select(F.col("ent").alias("a"), F.col("c").alias("ca")), "a").join(nodes.select(F.col("ent").alias("b"), F.col("c").alias("cb")), "b")
    joined = joined.crossJoin(F.broadcast(total))  # one row
    up = -F.ln(2.0 * F.col("z") * F.col("c") / (F.col("ca").cast("double") * F.col("cb")))
    return joined.select("a", "b", "c", F.try_divide(up, F.ln(2.0 * F.col("c") / F.col("z"))).alias("npmi"))


def subgraph(graph: DataFrame, npmi_min: float, min_count: int, npmi_max: float = 1.0) -> DataFrame:
    """Edges above a score and a count and below an upper bound (FI12)."""
    return graph.where((F.col("npmi") > npmi_min) & (F.col("c") >= min_count) & (F.col("npmi") < npmi_max))


def occurrences(lists: DataFrame) -> DataFrame:
    """(ent, note): the occurrence index in long form; empty names are no entities (AG3)."""
    rows = lists.select(F.explode("ents").alias("ent"), "note")
    return rows.where(F.col("ent").cast("string") != "").distinct()


def notes_of_texts(wanted: DataFrame, found: DataFrame, sents: DataFrame) -> DataFrame:
    """(a, b, text, note) for wanted (a, b, text): the shared note (a, b, note) whose sentence (note, text) is that text, the least of several (JN13)."""
    said = found.join(sents.select("note", "text"), "note")
    return wanted.join(said, ["a", "b", "text"]).groupBy("a", "b", "text").agg(F.min("note").alias("note"))


def notes_saying(wanted: DataFrame, said: DataFrame) -> DataFrame:
    """``notes_of_texts`` of sentences that hold their entities, said (note, text, ents): pairs are made once, within notes, and meet wanted by (a, b, text) alone (JN13)."""
    each = said.where("text is not null").select("note", "text", "ents", F.posexplode("ents").alias("i", "a"))
    each = each.select("note", "text", "a", F.explode(F.slice("ents", F.col("i") + 2, F.size("ents"))).alias("b"))
    return wanted.join(each, ["a", "b", "text"]).groupBy("a", "b", "text").agg(F.min("note").alias("note"))


def shared(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, note): notes that both ends of wanted (a, b) occur in (JN7).

    Pairs are made within notes, of wanted entities alone: a note holds few, while an entity may have many notes.
    """
    names = wanted.select(F.explode(F.array("a", "b")).alias("ent")).distinct()
    found = pairs(baskets(index.join(names, "ent", "left_semi"), "ent", "note")).withColumnsRenamed({"a": "x", "b": "y"})
    return found.join(wanted.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), ["x", "y"]).select("a", "b", "note")
