"""The best paths of pairs without all paths: cheapest arcs first, more only where a bound asks for them.

The cost of an arc is one over its weight, so the harmonic mean of a path falls as the sum of its
costs rises. In a round, a pair sees only the ``level`` cheapest arcs that leave its first node and the same
of those that enter its last one. What it has not seen costs at least a sum of the next costs there;
a pair whose best paths so far are cheaper is done, as is one that has seen all. The others
go into the next round, with LEVEL_STEP times as many arcs. Where all first steps are no more
than FULL rows a core, all paths are made at once. Weights are not negative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relgraph.sources.scratch import materialise

LEVEL, LEVEL_STEP = {2: 32, 3: 16}, 8
#: So many rows of first steps for each core are made without bounds.
FULL = 8e6
#: Scores are told apart to 12 places, so a bound has to be passed by more.
MARGIN = 1e-9
_INF = float("inf")


def cost(weight):
    return F.when(weight > 0, 1 / weight).otherwise(F.lit(_INF))


def choose(target, n0, n1, replaceable: bool):
    """0 or 1: the sentence that an edge gives to a path; null where it would repeat the target (FI13)."""
    other = F.when(n1.isNotNull(), 1) if replaceable else F.lit(None).cast("int")
    return F.when(n0.eqNullSafe(target), other).otherwise(0)


def _cheapest(arcs: DataFrame, end: str, far: str, level: int) -> DataFrame:
    """The ``level`` + 1 cheapest arcs at each node, with their rank; the limit holds before the shuffle too."""
    order = Window.partitionBy(end).orderBy("c", far)
    return arcs.withColumn("r", F.row_number().over(order)).where(F.col("r") <= level + 1)


def _ends(cheapest: DataFrame, end: str, far: str, level: int) -> DataFrame:
    """(node, first, next, cut_c, cut_far): the least cost at a node, the first cost not seen (null: all are seen), and the last arc seen."""
    at = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    return cheapest.groupBy(F.col(end).alias("node")).agg(at(1, "c").alias("first"), at(level + 1, "c").alias("next"), at(level, "c").alias("cut_c"), at(level, far).alias("cut_far"))


def best_paths(targets: DataFrame, arcs: DataFrame, *, max_hops: int, path_num: int, replaceable: bool = False, two: DataFrame | None = None, three=None) -> DataFrame:
    """(a, b, nodes, picks, weights): the path_num best simple paths of 2 to max_hops arcs, 3 at most, by hops, score to 12 places and nodes.

    targets: (a, b, target), each pair once; arcs: (u, v, n0, n1, w0, w1), the sentences that an edge can give and their weights. A pair has
    fewer paths only if there are no more; one with enough is not followed to more hops (GR4, GR9, TK1).
    Where first sentences and no targets count, two: (a, m, b, w0, w1), paths of two arcs, all that can be among the path_num best; three(pairs):
    the same of three arcs, (a, x, y, b, w0, w1, w2), instead of rounds.
    """
    least = F.least(cost(F.col("w0")), cost(F.col("w1"))) if replaceable else cost(F.col("w0"))
    arcs = materialise(arcs.withColumn("c", least), "ranked-arcs")
    each = arcs.groupBy("u").agg(F.count("*").alias("n"), F.min("c").alias("c"))
    total, widest, cheapest_arc = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.min("c"), F.lit(0.0))).first()
    most = FULL * arcs.sparkSession.sparkContext.defaultParallelism
    open_ = targets.withColumn("have", F.lit(0))

    def take(rows: DataFrame, step: DataFrame, k: int, on: dict[str, str]) -> DataFrame:
        """Rows with an arc more: which of its sentences they use, and its weight; those that would repeat the target end."""
        names = {"u": f"u{k}", "v": f"v{k}"} | on
        step = step.withColumnsRenamed(names).withColumnsRenamed({c: f"_{c}" for c in ("n0", "n1", "w0", "w1", "c")})
        rows = rows.join(step, list(on.values())).withColumn(f"p{k}", choose(F.col("target"), F.col("_n0"), F.col("_n1"), replaceable)).where(f"p{k} is not null")
        return rows.withColumn(f"x{k}", F.when(F.col(f"p{k}") == 0, F.col("_w0")).otherwise(F.col("_w1")).cast("double")).drop("_n0", "_n1", "_w0", "_w1")

    def paths(rows: DataFrame, nodes: list, hops: int) -> DataFrame:
        each = range(hops)
        return rows.select("a", "b", F.array(*nodes).alias("nodes"), F.array(*[F.col(f"p{k}") for k in each]).alias("picks"), F.array(*[F.col(f"x{k}") for k in each]).alias("weights"), sum((cost(F.col(f"x{k}")) for k in each), F.lit(0.0)).alias("cost"))

    def candidates(pairs: DataFrame, out: DataFrame, into: DataFrame, level: int, hops: int) -> DataFrame:
        seen_out, seen_in = out.where(F.col("r") <= level).drop("r"), into.where(F.col("r") <= level).drop("r")
        there = take(pairs, seen_out, 0, {"u": "a"}).where("v0 <> b").drop("_c")
        if hops == 3:
            rows = take(there, seen_in, 2, {"v": "b"}).where("u2 <> a and u2 <> v0").drop("_c")
            return paths(take(rows, arcs, 1, {"u": "v0", "v": "u2"}), ["a", "v0", "u2", "b"], 3)
        # from the other end, what the first node has not seen itself
        back = take(pairs.where("cut_c is not null"), seen_in, 1, {"v": "b"}).where("u1 <> a").drop("_c")
        back = take(back, arcs, 0, {"u": "a", "v": "u1"}).where("_c > cut_c or (_c = cut_c and u1 > cut_far)")
        return paths(take(there, arcs, 1, {"u": "v0", "v": "b"}), ["a", "v0", "b"], 2).unionByName(paths(back, ["a", "u1", "b"], 2))

    def full(pairs: DataFrame, hops: int) -> DataFrame:
        """All paths, where they are few."""
        rows = take(pairs, arcs, 0, {"u": "a"}).where("v0 <> b").drop("_c")
        if hops == 2:
            return paths(take(rows, arcs, 1, {"u": "v0", "v": "b"}), ["a", "v0", "b"], 2)
        rows = take(rows, arcs, 1, {"u": "v0"}).where("v1 <> a and v1 <> b").drop("_c")
        return paths(take(rows, arcs, 2, {"u": "v1", "v": "b"}), ["a", "v0", "v1", "b"], 3)

    def known(hops: int) -> DataFrame:
        found, middle = (two, ["m"]) if hops == 2 else (three(open_), ["x", "y"])
        rows = found.select("a", "b", *middle, *[F.lit(0).alias(f"p{k}") for k in range(hops)], *[F.col(f"w{k}").alias(f"x{k}") for k in range(hops)])
        return paths(rows, ["a", *middle, "b"], hops)

    def limited(found: DataFrame, hops: int) -> DataFrame:
        order = [F.desc(F.round(F.lit(float(hops)) / F.col("cost"), 12)), F.col("nodes")]
        return found.withColumn("rank", F.row_number().over(Window.partitionBy("a", "b").orderBy(*order))).where(F.col("rank") <= path_num)

    out_of = arcs.groupBy(F.col("u").alias("a")).agg(F.count("*").alias("da"))
    into_b = arcs.groupBy(F.col("v").alias("b")).agg(F.count("*").alias("db"))
    done = []
    for hops in range(2, max_hops + 1):
        rows = F.col("da") if hops == 2 else F.col("da") * F.col("db")
        few = total * widest ** (hops - 1) <= most or (hops == 2 and two is not None)
        few = few or open_.join(out_of, "a").join(into_b, "b").agg(F.coalesce(F.sum(rows.cast("double")), F.lit(0.0))).first()[0] <= most
        if few or (hops == 3 and three is not None):
            found = limited(known(hops) if (hops == 2 and two is not None) or not few else full(open_, hops), hops)
            if hops < max_hops:
                found = materialise(found, "ranked-paths")
            done.append(found.select("a", "b", "nodes", "picks", "weights"))
            met = found.groupBy("a", "b").agg(F.count("*").cast("int").alias("n"))
            closed = [open_.join(met, ["a", "b"], "left").select("a", "b", "target", (F.col("have") + F.coalesce("n", F.lit(0))).alias("have"))]
            waiting = None
        else:
            level, waiting, closed = LEVEL[hops], open_, []
        while waiting is not None and not waiting.isEmpty():
            out, into = _cheapest(arcs, "u", "v", level), _cheapest(arcs, "v", "u", level)
            a = _ends(out, "u", "v", level).select(F.col("node").alias("a"), F.col("first").alias("first_a"), F.col("next").alias("next_a"), "cut_c", "cut_far")
            b = _ends(into, "v", "u", level).select(F.col("node").alias("b"), F.col("first").alias("first_b"), F.col("next").alias("next_b"))
            pairs = materialise(waiting.select("a", "b", "target", "have").join(a, "a", "left").join(b, "b", "left"), "ranked-pairs")
            found = materialise(limited(candidates(pairs, out, into, level, hops), hops), "ranked-paths")
            if hops == 2:  # unseen at both ends
                rest = F.col("next_a") + F.col("next_b")
                every = F.col("next_a").isNull() | F.col("next_b").isNull()
            else:
                rest = F.least(F.coalesce("next_a", F.lit(_INF)) + F.col("first_b"), F.col("first_a") + F.coalesce("next_b", F.lit(_INF))) + cheapest_arc
                every = (F.col("next_a").isNull() & F.col("next_b").isNull()) | F.col("first_a").isNull() | F.col("first_b").isNull()
            got = found.join(pairs.select("a", "b", "have"), ["a", "b"]).groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == path_num - F.col("have"), F.col("cost"))).alias("last"))
            state = pairs.join(got, ["a", "b"], "left").withColumn("over", every | F.coalesce(F.col("last") * (1 + MARGIN) < rest, F.lit(False)))
            state = materialise(state.select("a", "b", "target", "have", F.coalesce("n", F.lit(0)).cast("int").alias("n"), "over"), "ranked-pairs")
            done.append(found.join(state.where("over").select("a", "b"), ["a", "b"], "left_semi").select("a", "b", "nodes", "picks", "weights"))
            closed.append(state.where("over").select("a", "b", "target", (F.col("have") + F.col("n")).alias("have")))
            waiting, level = state.where("not over"), level * LEVEL_STEP
        if hops < max_hops:
            open_ = reduce(DataFrame.unionByName, closed).where(F.col("have") < path_num) if closed else open_.limit(0)
    return reduce(DataFrame.unionByName, done)
