"""Datasets of path samples: target sentences, ranked source paths, coded triples.

Graphs are sentence graphs (src, dst, sim, data), data best first. Paths carry
nodes, weights and which sentence of an edge they use; the sentences themselves
are joined only to the paths that stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.functions.scores import harmonic_mean
from relgraph.operators import ranked
from relgraph.operators.samples import best_of_pairs


def arcs_of(edges: DataFrame, directed: bool) -> DataFrame:
    """(u, v, sim, data): an undirected edge goes both ways; loops are no steps."""
    there = edges.where(F.col("src") != F.col("dst")).select(F.col("src").alias("u"), F.col("dst").alias("v"), "sim", "data")
    return there if directed else there.unionByName(edges.where(F.col("src") != F.col("dst")).select(F.col("dst").alias("u"), F.col("src").alias("v"), "sim", "data"))


def source_paths(targets: DataFrame, arcs: DataFrame, *, max_hops: int, feature: str | None, replaceable: bool, enough: int) -> DataFrame:
    """(a, b, nodes, picks, weights): simple paths of 2 to max_hops arcs whose sentences differ from the target (GR4, GR9).

    targets: (a, b, target). A step that would repeat the target ends its path there and then. With a feature,
    fewer hops rank first, so only the ``enough`` best of each pair come, up to three hops by ``ranked.best_paths``.
    """
    first, second = F.get("data", F.lit(0)), F.get("data", F.lit(1))
    w = (lambda x: x[feature].cast("double")) if feature else (lambda x: F.lit(1.0))
    slim = arcs.select("u", "v", first["note"].alias("n0"), second["note"].alias("n1"), w(first).alias("w0"), w(second).alias("w1"))
    if feature and max_hops <= 3:
        return ranked.best_paths(targets.select("a", "b", "target"), slim, max_hops=max_hops, path_num=enough, replaceable=replaceable)
    pick = ranked.choose(F.col("target"), F.col("n0"), F.col("n1"), replaceable)

    def grow(joined: DataFrame, end) -> DataFrame:
        rows = joined.withColumn("pick", pick).where(F.col("pick").isNotNull())
        grown = {"nodes": F.concat("nodes", F.array(end)), "picks": F.concat("picks", F.array("pick")), "weights": F.concat("weights", F.array(F.when(F.col("pick") == 0, F.col("w0")).otherwise(F.col("w1"))))}
        return rows.withColumns(grown)

    empty = lambda t: F.array().cast(f"array<{t}>")
    now = targets.select("a", "b", "target", F.array("a").alias("nodes"), empty("int").alias("picks"), empty("double").alias("weights"), F.col("a").alias("u"))
    done = []
    for hop in range(1, max_hops + 1):
        if hop > 1:
            last = grow(now.join(slim.withColumnRenamed("v", "b"), ["u", "b"]), F.col("b"))
            done.append(last.select("a", "b", "nodes", "picks", "weights"))
            if feature and hop < max_hops:
                full = reduce(DataFrame.unionByName, (p.select("a", "b") for p in done)).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
                now = now.join(full, ["a", "b"], "left_anti")
        if hop < max_hops:
            step = now.join(slim, "u").where((F.col("v") != F.col("b")) & ~F.array_contains("nodes", F.col("v")))
            now = grow(step, F.col("v")).select("a", "b", "target", "nodes", "picks", "weights", F.col("v").alias("u"))
    return reduce(DataFrame.unionByName, done)


def collect_samples(
    target_graph: DataFrame, source_graph: DataFrame, *, pairs: DataFrame | None = None, directed: bool = False, max_hops: int = 3,
    path_num: int = 5, feature: str | None = "score", replaceable: bool = False, seed: int = 0, keep_failed: bool = False, sample_num: int = -1,
) -> DataFrame:
    """(a, b, sim, entity, target, source, triple): a sample for each pair with path_num paths (GR9, GR12).

    pairs: (a, b), by default the target graph's edges; directed: whether the source graph is. An undirected
    target edge is found from either end by sorted names. Paths come by hops, score to 12 places, nodes; without a feature in
    an order that a hash of seed gives (TK6). Lists are in order of first occurrence; places and pid start at 0.
    keep_failed: pairs without a sample stay, with nulls. sample_num: only the first so many by name, if not negative (TK8). A zero feature gives no score and ranks last.
    """
    best = F.get("data", F.lit(0))
    targets = target_graph.where(F.size("data") > 0).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("sim").alias("target_sim"), best["note"].alias("target")).where(F.col("a") != F.col("b"))
    wanted = targets if pairs is None else pairs.select("a", "b").distinct().join(targets, ["a", "b"])
    arcs = arcs_of(source_graph.where(F.size("data") > 0), directed)
    found = source_paths(wanted, arcs, max_hops=max_hops, feature=feature, replaceable=replaceable, enough=path_num)
    if feature:
        order = [F.size("picks"), F.desc_nulls_last(F.round(harmonic_mean("weights"), 12)), F.col("nodes")]
    else:
        order = [F.md5(F.concat_ws("|", F.concat_ws(",", F.transform("nodes", lambda x: x.cast("string"))), F.lit(str(seed)))), F.col("nodes")]
    best_ = best_of_pairs(found, path_num, *order)

    hop = F.transform("picks", lambda p, i: F.struct(i.alias("hop"), p.alias("pick"), F.get("nodes", i).alias("u"), F.get("nodes", i + 1).alias("v")))
    steps = best_.select("a", "b", "rank", F.explode(hop).alias("s")).select("a", "b", "rank", "s.*").join(arcs, ["u", "v"])
    item = F.get("data", F.col("pick"))
    fields = ["score", "significant", "explicit", "span_head", "span_tail"]
    rows = steps.groupBy("a", "b").agg(F.sort_array(F.collect_list(F.struct("rank", "hop", "u", "v", item["note"].alias("note"), "sim", *[item[f].alias(f) for f in fields]))).alias("s"))
    rows = rows.withColumns({"entity": F.array_distinct(F.flatten(F.transform("s", lambda x: F.array(x["u"], x["v"])))), "source": F.array_distinct(F.transform("s", lambda x: x["note"]))})
    place = lambda c, x: (F.array_position(c, x) - 1).cast("int")
    coded = lambda x: F.struct(*[x[f].alias(f) for f in fields], x["sim"].alias("sim"), (x["rank"] - 1).alias("pid"), place("source", x["note"]).alias("sent"), place("entity", x["u"]).alias("e1"), place("entity", x["v"]).alias("e2"))
    triple = F.transform(F.sequence(F.lit(1), F.lit(path_num)), lambda r: F.transform(F.filter("s", lambda x: x["rank"] == r), coded))
    rows = rows.select("a", "b", "entity", "source", triple.alias("triple"))
    kept = (pairs.select("a", "b").distinct().join(targets, ["a", "b"], "left") if pairs is not None else targets) if keep_failed else wanted
    out = kept.join(rows, ["a", "b"], "left" if keep_failed else "inner")
    out = out.select("a", "b", F.col("target_sim").alias("sim"), "entity", "target", "source", "triple")
    return out if sample_num < 0 else out.orderBy("a", "b").limit(sample_num)


def decode(found: DataFrame) -> DataFrame:
    """(a, b, pid, nodes, notes, score): paths of samples, read back through their lists (IO16)."""
    rows = found.select("a", "b", "entity", "source", F.explode("triple").alias("t"))
    nodes = F.concat(F.transform(F.slice("t", 1, 1), lambda x: F.get("entity", x["e1"])), F.transform("t", lambda x: F.get("entity", x["e2"])))
    return rows.select("a", "b", F.get("t", F.lit(0))["pid"].alias("pid"), nodes.alias("nodes"), F.transform("t", lambda x: F.get("source", x["sent"])).alias("notes"), harmonic_mean(F.transform("t", lambda x: x["score"])).alias("score"))


def sample_yield(found: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (samples, edges, yield): samples over target edges (AG14); no yield without edges."""
    both = found.agg(F.count("*").alias("samples")).crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    return both.withColumn("yield", F.try_divide(F.col("samples").cast("double"), F.col("edges")))


def review_sheet(targets: DataFrame, graphs: dict[str, tuple[DataFrame, bool]], outputs: dict[str, DataFrame]) -> DataFrame:
    """Rows for human readers, blank score columns beside every sentence (EV6, JN12).

    targets: (place, a, b, target); graphs: name to (edges, whether directed), each gives its first sentence
    for the pair, null if it has no such edge (Q30); outputs: name to (place, line).
    """
    rows = targets.select("place", "a", "b", "target")
    for name, (edges, directed) in graphs.items():
        first = arcs_of(edges, directed).select(F.col("u").alias("a"), F.col("v").alias("b"), F.get("data", F.lit(0))["note"].alias(name))
        rows = rows.join(first, ["a", "b"], "left")
    for name, lines in outputs.items():
        rows = rows.join(lines.select("place", F.col("line").alias(name)), "place", "left")
    shown = [*graphs, "scr", *outputs]
    rows = rows.withColumnRenamed("target", "scr")
    pair = F.concat(F.lit("ent1: "), F.col("a").cast("string"), F.lit(" ent2: "), F.col("b").cast("string")).alias("pair")
    return rows.select("place", pair, *[c for name in shown for c in (F.col(name), F.lit("").alias(f"{name}_score"))])
