"""Late sessions, near-duplicate embeddings and the audit of sources against brute force, and on odd input."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from relgraph.llm import audit, neardup, sessions
from relgraph.llm.runtime import prepare


@pytest.fixture(autouse=True)
def _ready(spark):
    prepare(spark)


# 11


def plain_sessions(events, gap):
    """Versions by sorting all events so far, after each batch."""
    by_user = defaultdict(list)
    for user, batch, at, h in events:
        if None not in (user, batch, at):
            by_user[user].append((batch, at, h or 0))
    out = []
    for user, own in by_user.items():
        standing, made = [], []
        for batch in sorted({b for b, _, _ in own}):
            groups = []
            for b, at, h in sorted((e for e in own if e[0] <= batch), key=lambda e: e[1]):
                if groups and at - groups[-1][-1][1] <= gap:
                    groups[-1].append((b, at, h))
                else:
                    groups.append([(b, at, h)])
            for g in groups:
                new = sum(b == batch for b, _, _ in g)
                if not new:
                    continue
                x, y = g[0][1], g[-1][1]
                gone = [v for v in standing if x <= v["x"] and v["y"] <= y]
                standing = [v for v in standing if v not in gone]
                v = {"row": [user, batch, x, y, len(g), new, len(gone), sum(h for _, _, h in g), None, None], "x": x, "y": y}
                for o in gone:
                    o["row"][8:] = [batch, x]
                made.append(v)
                standing.append(v)
        out += [tuple(v["row"]) for v in made]
    return sorted(out, key=repr)


EVENTS = "user long, batch long, at long, h long, n_new string, kind string"


@pytest.mark.parametrize("seed,span,late", [(1, 3000, 4), (2, 40000, 4), (3, 20000, 9), (4, 90000, 2)])
def test_sessions_equal_sorting_after_each_batch(spark, seed, span, late):
    rng = random.Random(seed)
    events = []
    for user in range(5):
        for _ in range(rng.randrange(1, 250)):
            at = rng.randrange(-2000, span)
            events.append((user, at // 1800 + rng.choice([0, 0, 0, rng.randrange(-1, late)]), at, rng.randrange(1 << 32)))
    events += [(9, 3, 10, 5), (9, 3, 10, 5), (9, 4, 250, None), (9, 5, 491, 7), (9, 9, 252, 1), (None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1)]
    table = spark.createDataFrame([(*e, "x", "y") for e in events], EVENTS).repartition(3)
    got = sessions.versions(table, batches=1)
    assert got.columns == sessions.NAMES[:10]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_sessions(events, 240)


def test_sessions_of_one_user_over_many_parts(spark):
    rng = random.Random(7)  # one run of 700 hours, late pieces of it, and holes that close late
    events = [(1, at // 1800 + (3 if rng.random() < 0.02 else 0), at, at) for at in range(0, 2_500_000, 200)] + [(2, 0, 0, 1), (2, 1500, 2_700_000, 1)]
    table = spark.createDataFrame([(*e, "x", "y") for e in events], EVENTS).repartition(4)
    got = sessions.versions(table)
    seen = {(r.user, r.batch, r.start_s): r for r in got.collect()}
    last = [r for r in seen.values() if r.user == 1 and r.retracted_batch is None]
    assert len(last) == 1 and last[0].start_s == 0 and last[0].n_events == 12_500 and last[0].h_sum == sum(range(0, 2_500_000, 200))
    assert sum(r.n_new for r in seen.values()) == len(events)
    short = [e for e in events if e[2] < 130_000]
    table = spark.createDataFrame([(*e, "x", "y") for e in short], EVENTS)
    assert sorted(map(tuple, sessions.versions(table, batches=4).collect()), key=repr) == plain_sessions(short, 240)
    assert sessions.versions(table.limit(0)).collect() == []


def test_sessions_of_users_with_names(spark):
    table = spark.createDataFrame([("a", 0, 5, 1), ("a", 0, 5, 1), ("é", 2, 5, 1)], "user string, batch long, at long, h long")
    assert sorted(map(tuple, sessions.versions(table).collect()), key=repr) == [("a", 0, 5, 5, 2, 2, 0, 2, None, None), ("é", 2, 5, 5, 1, 1, 0, 1, None, None)]


# 12


def near_rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    rows = [v for v in base]
    for k, (n, noise) in enumerate([(40, 0.05), (12, 0.12), (5, 0.3), (3, 0.0)]):
        rows += [base[k] + noise * rng.normal(size=16) for _ in range(n)]
    step = np.zeros(16)
    for k in range(12):  # a chain whose ends are far apart
        step[:2] = np.cos(k * 0.25), np.sin(k * 0.25)
        rows.append(step * 7.0)
    order = rng.permutation(len(rows))
    return [(int(i), rows[j].astype(np.float32).tolist()) for i, j in enumerate(order)]


def plain_near(rows, threshold):
    fit = [v is not None and i is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    x = {k: np.array(v, float) / np.linalg.norm(v) for k, (_, v) in enumerate(rows) if fit[k]}
    near = defaultdict(set)
    for a, b in itertools.combinations(x, 2):
        if len(x[a]) == len(x[b]) and x[a] @ x[b] >= threshold:
            near[a].add(b)
            near[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        out.append((i, len(near[k]), i if i is None else min(rows[s][0] for s in seen)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1024, 7])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, block):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")  # groups over several batches
    monkeypatch.setattr(neardup, "PAIRS", 64)
    rows = near_rows()
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [1.0] * 15), (1004, [1.0, None] * 8), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, rows[0][1]), (rows[0][0], rows[0][1]), (1008, [1e-30, 2e-30]), (1009, rows[0][1])]
    table = spark.createDataFrame([(i, v, "s", 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, label string, c long, n long").repartition(3)
    got = neardup.join(table, recall=1 - 1e-9, block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_near(rows + odd, 0.95)
    assert neardup.join(table.limit(0)).collect() == []


def test_near_duplicates_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(400, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = a * 0.9501 + o * np.sqrt(1 - 0.9501**2)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    found = neardup.join(table).where("n_links > 0").count()
    assert found >= 2 * 400 * 0.98
    below = a * 0.9499 + o * np.sqrt(1 - 0.9499**2)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, below]))], "vec_id long, embedding array<double>")
    assert neardup.join(table).where("n_links > 0").count() == 0


# 13


def plain_audit(rows, min_docs, top):
    said, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        said[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in {lg for lg, _ in said}:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        own = {s: c for (lg, s), c in said.items() if lg == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)
        share = lambda c: [1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept]  # noqa: B023, E731
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(map(f, p[s], p[o])), o) for o in own if o != s]
            named = [(f(a, b), t) for t, a, b in zip(kept, p[s], q) if own[s][t] > 0 and a > b]
            for part, got, most in (("pair", pairs, None), ("term", named, top)):
                ranked = sorted(got, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block,dense", [(256, 2048), (2, 3)])
def test_audit_equals_plain_counts(spark, monkeypatch, block, dense):
    monkeypatch.setattr(audit, "HELD", 40)
    monkeypatch.setattr(audit, "CUT", 50)
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "éa", "zeta", "日本", "z", "Ωmega", "x_y", "d1e", "ﬀ", "🤗"]
    rows = []
    for k in range(150):
        source = rng.choice(["s1", "s2", "s3", "S1", "", None, "é"])
        pool = words if source != "s1" else words[:4]
        rows.append((rng.choice([" ", ", ", "\n", "\x7f"]).join(rng.choice(pool) for _ in range(rng.randrange(0, 40))), rng.choice(["en", "en", "fr", None, ""]), source))
    rows += [(None, "en", "none"), ("", "en", "empty"), ("rare words here", "de", "a"), (None, "de", "b"), ("12 34 !", "de", "c"), ("x" * 5000, "en", "s1"), *[("alpha", "en", "s2")] * 30]
    table = spark.createDataFrame([(i, *r, 1, "k", 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string, kept long").repartition(5)
    for least, top in ((10, 10), (3, 2)):
        got = audit.audit(table, min_docs=least, top=top, block=block, dense=dense)
        assert sorted(map(tuple, got.collect())) == plain_audit(rows, least, top)
    assert audit.audit(table.limit(0)).collect() == []


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for total in (10, 10**9, 10**13, 9 * 10**15 - 10**7):
        kept = rng.randrange(1, 10**6)
        counts = [0, total, *(rng.randrange(total) for _ in range(50))]
        assert audit.share(np.array(counts), total, kept).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * kept) for c in counts]
    p, q = np.array([1, 10**9 + 1, 5, 10**9]), np.array([10**9 + 1, 1, 5, 3])
    assert audit.divergence(p, q).tolist() == [(int(a) - int(b)) ** 2 // (int(a) + int(b)) for a, b in zip(p, q)]
