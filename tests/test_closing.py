"""Paths matched in blocks of nodes, against joins and plain loops."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from relgraph.operators import closing, cooccur, graph, ranked, samples
from relgraph.plans import queries


def edges(spark, seed, nodes=40, n=150):
    """Edges of a random graph with a hub, as integers and as names."""
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(nodes), 2))) for _ in range(n)} | {(0, k) for k in range(1, nodes)}
    rows = [(a, b, r.choice([0.5, 0.75, 0.9, 1.0])) for a, b in sorted(pairs)]
    return rows, spark.createDataFrame(rows, "a long, b long, w double"), spark.createDataFrame([(f"{a:03}", f"{b:03}", w) for a, b, w in rows], "a string, b string, w double")


@pytest.mark.parametrize("seed", range(2))
def test_two_steps_need_no_joined_rows(spark, seed):
    _, w, named = edges(spark, seed)
    found = graph.paths(graph.both_ways(w), w, 2)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    said = lambda df: Counter((int(r.a), int(r.b), tuple(map(int, r.nodes)), tuple(r.weights)) for r in df.collect())
    assert said(found) == said(graph.paths(graph.both_ways(named), named, 2))
    assert found.schema["a"].dataType.simpleString() == "bigint"
    # parallel arcs are paths of their own, loops and nulls none
    arcs = spark.createDataFrame([(1, 2, 0.5), (1, 2, 0.6), (2, 3, 0.7), (2, 3, 0.8), (1, 1, 0.1), (3, 3, 0.1), (None, 3, 0.1), (1, None, 0.1)], "u int, v int, w double")
    wanted = spark.createDataFrame([(1, 3), (3, 1), (None, 3)], "a int, b int")
    assert sorted(tuple(r.weights) for r in graph.paths(arcs, wanted, 2).collect()) == [(0.5, 0.7), (0.5, 0.8), (0.6, 0.7), (0.6, 0.8)]
    assert graph.paths(arcs.limit(0), wanted, 2).collect() == [] and graph.paths(arcs, wanted.limit(0), 2).collect() == []


@pytest.mark.parametrize("enough", [1, 3, 5])
def test_best_of_two_steps_need_no_rounds(spark, monkeypatch, enough):
    _, w, named = edges(spark, 5, n=500)
    every = samples.rank_paths(graph.paths(graph.both_ways(named), named, 2), enough)
    monkeypatch.setattr(ranked, "FULL", 0)  # rounds of cheapest arcs, before
    monkeypatch.setattr(ranked, "_cheapest", lambda *_: pytest.fail("arcs of two steps were joined"))
    got = samples.rank_paths(graph.best_paths(graph.both_ways(w), w, 2, enough), enough)
    said = lambda df: sorted((int(r.a), int(r.b), r["rank"], tuple(map(int, r.nodes)), r.score) for r in df.collect())
    assert said(got) == said(every) and got.count() > 100


@pytest.mark.parametrize("seed", [7, 8])
def test_best_of_three_steps_need_no_rounds(spark, monkeypatch, seed):
    _, w, named = edges(spark, seed, nodes=60, n=110)
    monkeypatch.setattr(closing, "MIDDLE_ARCS", 40)  # seven blocks
    every = samples.rank_paths(graph.paths(graph.both_ways(named), named, 2).unionByName(graph.paths(graph.both_ways(named), named, 3)), 4)
    said = lambda df: sorted((int(r.a), int(r.b), r["rank"], tuple(map(int, r.nodes)), r.score) for r in df.collect())
    want = said(every)
    monkeypatch.setattr(ranked, "FULL", 0)
    monkeypatch.setattr(ranked, "_cheapest", lambda *_: pytest.fail("arcs of three steps were joined"))
    assert said(samples.rank_paths(graph.best_paths(graph.both_ways(w), w, 3, 4), 4)) == want
    assert len({x[:2] for x in want}) > 30 and {len(x[3]) for x in want} == {3, 4}


@pytest.mark.parametrize("steps", [20, 1 << 21])
def test_best_of_three_steps_through_blocks(monkeypatch, steps):
    monkeypatch.setattr(closing, "AT_A_TIME", steps)
    r = random.Random(3)
    arcs = [(r.randrange(15), r.randrange(15), r.choice([0.0, 0.5, 0.75, 1.0])) for _ in range(150)]  # parallel ones, and loops
    arcs = [x for x in arcs if x[0] != x[1]]
    wanted = sorted({(r.randrange(15), r.randrange(15)) for _ in range(60)})
    a, b, (u, v, w) = *(np.array(c) for c in zip(*wanted, strict=True)), (np.array(c) for c in zip(*arcs, strict=True))
    (ends_a, pa_), (ends_b, pb) = (np.unique(c, return_inverse=True) for c in (a, b))
    own = np.flatnonzero(np.isin(u, ends_a))
    own = own[np.argsort(u[own], kind="stable")]
    best = closing._BestOfThree(len(a), 3)
    for k in range(3):
        into, onward = (np.flatnonzero(c % 3 == k) for c in (v, u))
        closing._through(best, (pa_, pb, ends_a, ends_b), (np.searchsorted(ends_a, u[own]), v[own], w[own], closing._costs(w[own])), [v[into], u[into], w[into]], [u[onward], v[onward], w[onward]])
    best.cut()
    got = defaultdict(list)
    for pair, x, y, w0, w1, w2, cost in zip(*best.kept[0], strict=True):
        got[a[pair], b[pair]].append((round(float(cost), 9), int(x), int(y), w0, w1, w2))
    cost = lambda *w: round(sum(1 / x if x else float("inf") for x in w), 9)
    for p, q in wanted:
        paths = sorted((cost(w0, w1, w2), x, y, w0, w1, w2) for s, x, w0 in arcs if s == p and x != q for t, y, w1 in arcs if t == x and y not in (p, q) for z, e, w2 in arcs if z == y and e == q)
        found = sorted(got[p, q])
        assert [x[:3] for x in found[:3]] == [x[:3] for x in paths[:3]] and Counter(found) <= Counter(paths)
    assert sum(len(x) for x in got.values()) > 100


def test_four_steps_are_counted_without_rows(spark):
    rows, w, _ = edges(spark, 3, nodes=14, n=30)
    near = defaultdict(dict)
    for a, b, x in rows:
        near[a][b] = near[b][a] = x
    want = {}
    for a, b, _ in rows:
        found = [(4 / (1 / near[a][x] + 1 / near[x][y] + 1 / near[y][z] + 1 / near[z][b]), [a, x, y, z, b]) for x in near[a] for y in near[x] for z in near[y] if b in near[z] and len({a, x, y, z, b}) == 5]
        if found:
            want[a, b] = (len(found), round(max(s for s, _ in found), 9), min(p for _, p in found))
    got = {(r.a, r.b): (r.paths, round(r.best, 9), r.nodes) for r in graph.four_hop_summary(graph.both_ways(w), w).collect()}
    assert got == want and len(want) > 20


def test_matches_in_small_steps(monkeypatch):
    r = np.random.default_rng(1)
    arcs = [[r.integers(0, 9, 200), r.integers(0, 30, 200), r.random(200)] for _ in range(2)]
    a, b = r.integers(0, 9, 60), r.integers(0, 9, 60)
    ends, middle = np.arange(9), np.arange(30)
    left, right = (closing._side(ends, x, middle) for x in arcs)
    want = Counter((k, arcs[0][2][o], arcs[1][2][t]) for k in range(60) for o in range(200) for t in range(200) if arcs[0][0][o] == a[k] and arcs[1][0][t] == b[k] and arcs[0][1][o] == arcs[1][1][t])
    for steps in (7, 1 << 20):
        monkeypatch.setattr(closing, "STEPS", steps)
        got = Counter()
        for pair, o, t in closing._matches(a, b, left, right, 30, np.arange(60)):
            assert len(pair) <= max(steps, 60)
            got.update(zip(pair.tolist(), left[2][0][o].tolist(), right[2][0][t].tolist(), strict=True))
        assert got == want


def test_covers_come_from_short_notes_alone(spark, tmp_path, monkeypatch):
    r = random.Random(2)
    notes = {k: r.sample(range(12), r.choice([2, 3, 3, 4])) for k in range(750, 1000)}
    spark.createDataFrame([(k, e) for k, ents in notes.items() for e in ents], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(graph, "paths", lambda *_: pytest.fail("paths of all pairs were made"))
    got = sorted(map(tuple, queries.paragraph_cover(spark, str(tmp_path)).collect()))
    good = [(a, b, k) for k, ents in notes.items() for a in ents for b in ents if a < b and (a * 31 + b * 17) % 100 >= 50 and k * 7919 % 1000 >= 750]
    near = {(a, b) for a, b, _ in good} | {(b, a) for a, b, _ in good}
    want = [(a, b, k, sum(set(notes[k]) - {a, b} <= {m} for m in range(12) if (a, m) in near and (m, b) in near)) for a, b, k in good if len(notes[k]) > 2]
    assert [x[:4] for x in got] == sorted(x for x in want if x[3]) and len(got) > 5
    assert all(p == f"{a}-{next(iter(set(notes[k]) - {a, b}))}-{b}" for a, b, k, _, p in got)


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_counts_of_blocks_need_no_row_for_each_pair(spark, block):
    r = random.Random(block)
    rows = [(k, e) for k in range(60) for e in r.sample(range(-20, 30), r.randrange(1, 40) if k else 50)] + [(99, 1), (98, None), (None, 4)]
    frame = spark.createDataFrame(rows, "note int, ent int")
    got = cooccur.ordered_counts(frame, block)
    assert got.schema["a"].dataType.simpleString() == "int"
    want = Counter((x, y) for n, x in rows for m, y in rows if n is not None and n == m and x is not None and y is not None and x < y)
    assert Counter({(x.a, x.b): x.c for x in got.collect()}) == want
    assert cooccur.ordered_counts(frame.limit(0), block).collect() == []
    names = frame.where("ent is not null and note is not null").select("note", F.format_string("%04d", F.col("ent") + 100).alias("ent"))
    assert {(int(x.a) - 100, int(x.b) - 100): x.c for x in cooccur.ordered_counts(names, 50).collect()} == want


@pytest.mark.parametrize("held", [40, 1 << 20])
def test_rows_are_moved_by_block_and_not_by_table(spark, monkeypatch, held):
    r = random.Random(held)
    rows = [(k, e) for k in range(30) for e in r.sample(range(200), r.randrange(1, 60))]
    monkeypatch.setattr(cooccur, "COUNT_HELD", held)
    monkeypatch.setattr(cooccur, "COUNT_TASKS", 1)
    got = cooccur.ordered_counts(spark.createDataFrame(rows, "note int, ent long"), 5)  # 40 tables a side
    blocks = max(-(-len(rows) // held), 3)  # 4 cores
    assert got.rdd.getNumPartitions() == blocks * (blocks + 1) // 2 < 40 * 41 // 2
    want = Counter((x, y) for n, x in rows for m, y in rows if n == m and x < y)
    found = got.collect()
    assert Counter({(x.a, x.b): x.c for x in found}) == want and len(found) == len(want)


def test_tables_of_few_and_of_many_notes():
    r = random.Random(4)
    for n, most in ((700, 3), (40, 30)):
        left, right = ([np.array(sorted(r.sample(range(40), r.randrange(1, most)))) for _ in range(n)] for _ in range(2))
        want = Counter((x, y) for p, q in zip(left, right, strict=True) for x in p.tolist() for y in q.tolist())
        table = cooccur._table(left, right, 40, 40)
        assert {(x, y): int(table[x, y]) for x, y in zip(*np.nonzero(table), strict=True)} == want
