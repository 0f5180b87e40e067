"""Edge tables: building, filtering, paths and triangles.

An edge row is (src, dst, sim, data), data an array of (score, note, significant,
explicit, span_head, span_tail). Every ranking has an explicit last key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.operators import closing, ranked


def oriented(features: DataFrame, sim_threshold: float = -1.0) -> DataFrame:
    """(src, dst, sim, item): a row for each sentence of features (kw1, kw2, sim, dep_path, note, score, ...), from head to tail (AG4, GR1).

    Head and tail change places where the path has no i_nsubj. The graph in long form: an edge may have any number of sentences.
    """
    swap = ~F.contains("dep_path", F.lit("i_nsubj"))
    rows = features.where(F.col("sim") >= sim_threshold)
    flip = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    item = F.struct("score", "note", "significant", "explicit", flip("kw1_span", "kw2_span").alias("span_head"), flip("kw2_span", "kw1_span").alias("span_tail"))
    return rows.select(flip("kw1", "kw2").alias("src"), flip("kw2", "kw1").alias("dst"), "sim", item.alias("item"))


def ranked_sentences(rows: DataFrame, threshold: float = 0.75, feature: str = "score", most: int | None = None, directed: bool = True) -> DataFrame:
    """(src, dst, sim, item, rank) of ``oriented`` rows: an edge's sentences that reach a threshold, best first, ties by note (FI6, GR2, GR3).

    ``sentence_graph`` in long form; with ``most``, the limit of an edge holds before the shuffle too.
    """
    if not directed:
        rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sim", "item")
    order = Window.partitionBy("src", "dst").orderBy(F.desc(f"item.{feature}"), "item.note")
    rows = rows.where(F.col(f"item.{feature}") >= threshold).withColumn("rank", F.row_number().over(order))
    return rows if most is None else rows.where(F.col("rank") <= most)


def digraph(features: DataFrame, sim_threshold: float = -1.0, directed: bool = True) -> DataFrame:
    """``oriented`` grouped by pair, all sentences of an edge in a row (AG4, GR1). sim: the largest.

    Not directed: ``undirected`` of it, but grouped once (GR2).
    """
    rows = oriented(features, sim_threshold)
    if not directed:
        rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sim", "item")
    return rows.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.array_sort(F.collect_list("item")).alias("data"))


def undirected(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair, sentence lists joined (GR2)."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("sim").alias("sim"), F.array_sort(F.flatten(F.collect_list("data"))).alias("data"))


def sentence_graph(edges: DataFrame, threshold: float = 0.75, feature: str = "score") -> DataFrame:
    """Edges whose sentences reach a threshold, best first, ties by note (FI6, GR3). No shuffle."""
    data = F.filter("data", lambda x: x[feature] >= threshold)
    best_first = lambda x, y: F.when(x[feature] > y[feature], -1).when(x[feature] < y[feature], 1).when(x["note"] < y["note"], -1).when(x["note"] > y["note"], 1).otherwise(0)
    return edges.withColumn("data", F.array_sort(data, best_first)).where(F.size("data") > 0)


def best_sentences(features: DataFrame, sim_threshold: float = 0.5, threshold: float = 0.75, most: int = 2) -> DataFrame:
    """(src, dst, sim, data): a sentence graph of unordered pairs with only the ``most`` best sentences of an edge (FI4, FI6, GR2, GR3).

    ``sentence_graph`` of an undirected ``digraph`` keeps all sentences of an edge in a row; paths use one or two.
    Here rows stay long until that limit, which is applied before the shuffle too. sim is a function of the pair.
    """
    rows = ranked_sentences(oriented(features, sim_threshold), threshold, "score", most, directed=False).withColumnRenamed("rank", "k")
    rows = rows.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.sort_array(F.collect_list(F.struct("k", "item"))).alias("data"))
    return rows.withColumn("data", F.transform("data", lambda x: x["item"]))


def related(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges of at least that similarity; nodes without edges vanish (FI5, GR13)."""
    return edges.where(F.col("sim") >= threshold)


def random_sentences(shared: DataFrame, seed: int, most: int = 2) -> DataFrame:
    """At most two notes of each pair, in an order that a hash of seed gives (GR8, TK6)."""
    order = Window.partitionBy("a", "b").orderBy(F.md5(F.concat_ws("|", F.col("note").cast("string"), F.lit(str(seed)))), "note")
    return shared.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, w): every undirected edge (a, b, w) in both directions."""
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").union(edges.select("b", "a", "w"))


def paths(arcs: DataFrame, wanted: DataFrame, hops: int) -> DataFrame:
    """(a, b, nodes, weights): simple paths of exactly that many arcs (u, v, w) between wanted (a, b) (GR4, GR5).

    Paths of two and more start at the wanted pairs and close with a join on both ends, so that the last step
    never fans out. Those of two start at the end with fewer arcs, so a hub costs no more than what it is asked for with.
    Where nodes are integers those of two are matched in blocks, so that first steps are not shuffled.
    """
    if hops == 2 and closing.fits((arcs, "u"), (arcs, "v"), (wanted, "a"), (wanted, "b")):
        found = closing.two_steps(arcs, wanted)
        node = [F.col(c).cast(arcs.schema["v"].dataType) for c in ("a", "m", "b")]
        return found.select(*[F.col(c).cast(wanted.schema[c].dataType) for c in ("a", "b")], F.array(*node).alias("nodes"), F.array("w0", "w1").alias("weights"))
    if hops == 2:
        out_, into = arcs.groupBy(F.col("u").alias("a")).agg(F.count("*").alias("da")), arcs.groupBy(F.col("v").alias("b")).agg(F.count("*").alias("db"))
        sized = wanted.select("a", "b").join(out_, "a").join(into, "b")
        there = sized.where("da <= db").join(arcs.select(F.col("u").alias("a"), F.col("v").alias("m"), F.col("w").alias("w0")), "a").where("m <> b and m <> a")
        there = there.join(arcs.select(F.col("u").alias("m"), F.col("v").alias("b"), F.col("w").alias("w1")), ["m", "b"])
        back = sized.where("da > db").join(arcs.select(F.col("u").alias("m"), F.col("v").alias("b"), F.col("w").alias("w1")), "b").where("m <> b and m <> a")
        back = back.join(arcs.select(F.col("u").alias("a"), F.col("v").alias("m"), F.col("w").alias("w0")), ["a", "m"])
        both = there.select("a", "b", "m", "w0", "w1").unionByName(back.select("a", "b", "m", "w0", "w1"))
        return both.select("a", "b", F.array("a", "m", "b").alias("nodes"), F.array("w0", "w1").alias("weights"))
    now = wanted.select("a", "b", F.array("a").alias("nodes"), F.array().cast("array<double>").alias("weights"), F.col("a").alias("u"))
    for _ in range(hops - 1):
        step = now.join(arcs, "u").where((F.col("v") != F.col("b")) & ~F.array_contains("nodes", F.col("v")))
        now = step.select("a", "b", F.concat("nodes", F.array("v")).alias("nodes"), F.concat("weights", F.array("w")).alias("weights"), F.col("v").alias("u"))
    last = now.join(arcs.withColumnsRenamed({"v": "b"}), ["u", "b"])
    return last.select("a", "b", F.concat("nodes", F.array("b")).alias("nodes"), F.concat("weights", F.array("w")).alias("weights"))


def paths_through(arcs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, nodes, weights): paths of two arcs (u, v, w) that go from a to b by m, for wanted (a, b, m), each once. Joins on whole arcs, so nothing fans out."""
    first, then = arcs.select(F.col("u").alias("a"), F.col("v").alias("m"), F.col("w").alias("w0")), arcs.select(F.col("u").alias("m"), F.col("v").alias("b"), F.col("w").alias("w1"))
    rows = wanted.where("m <> a and m <> b").join(first, ["a", "m"]).join(then, ["m", "b"])
    return rows.select("a", "b", F.array("a", "m", "b").alias("nodes"), F.array("w0", "w1").alias("weights"))


def paths_up_to(arcs: DataFrame, wanted: DataFrame, max_hops: int, least: int = 1) -> DataFrame:
    return reduce(DataFrame.unionByName, (paths(arcs, wanted, h) for h in range(least, max_hops + 1)))


def best_paths(arcs: DataFrame, wanted: DataFrame, max_hops: int, path_num: int) -> DataFrame:
    """(a, b, nodes, weights): the path_num best paths of 2 to max_hops arcs (3 at most), as ``samples.rank_paths`` ranks them, or all if there are fewer."""
    none = F.lit(None).cast("long")
    slim = arcs.select("u", "v", F.lit(0).cast("long").alias("n0"), none.alias("n1"), F.col("w").alias("w0"), F.lit(None).cast("double").alias("w1"))
    two = three = None
    if closing.fits((arcs, "u"), (arcs, "v"), (wanted, "a"), (wanted, "b")):
        two = closing.best_two_steps(arcs, wanted, path_num)
        two = two.select(*[F.col(c).cast(wanted.schema[c].dataType) for c in ("a", "b")], F.col("m").cast(arcs.schema["v"].dataType).alias("m"), "w0", "w1")

        def three(pairs: DataFrame) -> DataFrame:
            found = closing.best_three_steps(arcs, pairs, path_num)
            return found.select(*[F.col(c).cast(wanted.schema[c].dataType) for c in ("a", "b")], *[F.col(c).cast(arcs.schema["v"].dataType).alias(c) for c in ("x", "y")], "w0", "w1", "w2")

    return ranked.best_paths(wanted.select("a", "b", none.alias("target")), slim, max_hops=max_hops, path_num=path_num, two=two, three=three).drop("picks")


def four_hop_summary(arcs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, b, paths, best, nodes) of the simple paths of four arcs between wanted (a, b): how many, the best harmonic mean and the least nodes (GR5, TK2).

    Nodes are integers, weights over 0. What ``paths`` of four arcs grouped by pair gives, without a row for each path.
    """
    node = [F.col(c).cast(arcs.schema["v"].dataType) for c in ("a", "x", "y", "z", "b")]
    ends = [F.col(c).cast(wanted.schema[c].dataType) for c in ("a", "b")]
    return closing.four_steps(arcs, wanted).select(*ends, F.col("n").alias("paths"), (F.lit(4.0) / F.col("cost")).alias("best"), F.array(*node).alias("nodes"))


def triangles(edges: DataFrame) -> DataFrame:
    """(x, y, z), x < y < z, over undirected edges (a, b), each once (GR7). Each triangle comes once.

    Edges go from the end of smaller degree to the other, so no node has more than the root of twice
    the edges of its own, and wedges are fewer than their number to the power of 1.5, hubs or not.
    """
    degree = edges.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    of = lambda c: degree.select(F.col("n").alias(c), F.struct("d", "n").alias(f"d{c}"))
    rows = edges.join(of("a"), "a").join(of("b"), "b")
    up = F.col("da") < F.col("db")
    flip = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))
    arcs = rows.select(flip("a", "b").alias("u"), flip("b", "a").alias("v"), F.greatest("da", "db").alias("dv"))
    wedges = arcs.join(arcs.select("u", F.col("v").alias("w"), F.col("dv").alias("dw")), "u").where(F.col("dv") < F.col("dw"))
    closed = wedges.select("u", "v", "w").join(arcs.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    s = F.array_sort(F.array("u", "v", "w"))
    return closed.select(F.get(s, 0).alias("x"), F.get(s, 1).alias("y"), F.get(s, 2).alias("z"))


def triangles_of(edges: DataFrame, node) -> DataFrame:
    """Triangles through one node: edges between its neighbours (GR6). No others are made."""
    near = edges.where((F.col("a") == node) | (F.col("b") == node)).select(F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a")).alias("n"))
    ends = edges.join(near.withColumnRenamed("n", "a"), "a", "left_semi").join(near.withColumnRenamed("n", "b"), "b", "left_semi")
    s = F.array_sort(F.array("a", "b", F.lit(node)))
    return ends.select(F.get(s, 0).alias("x"), F.get(s, 1).alias("y"), F.get(s, 2).alias("z"))
