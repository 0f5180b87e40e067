"""The training-data operators against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest

from relgraph.llm import brown, chat, decontam, jaccard, pieces, pii, quality, sharding, suffixdup, textbytes, topk
from relgraph.llm.runtime import crc_mod, prepare, scratch_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, hits string, found string"


@pytest.fixture(autouse=True)
def _ready(spark):
    prepare(spark)


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "la", "mu"]) + str(rng.randrange(60)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(20, 120)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1], texts[2] + " " + texts[3]]
    for k in range(8):
        w = texts[4].split() + prose(random.Random(99), 60).split()
        w[rng.randrange(len(w))] = f"edit{k}"
        texts.append(" ".join(w))
    return [None, "", "   ", "one", "two words", "é ß 日本 🤗", *texts, prose(rng, 3000), "x" * 2500]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), "k", "h", "f") for i, t in enumerate(texts)], SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


@pytest.mark.parametrize("few", [3, 24])
def test_topk_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(topk, "FEW", few)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(7 * few))  # shards and queries over several batches
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[17] = x[3]
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(300, None, "z"), (301, [1.0, None] * 4, "z"), (302, [float("nan")] * 8, "z"), (303, [float("inf")] * 8, "z"), (None, x[0].tolist(), "z"), (304, [1.0, 2.0], "z"), (0, x[0].tolist(), "z"), (350, [], "z")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = topk.search(table, lambda c: c % 50 == 0, k=5, shard=64).collect()
    q = np.floor(x.astype(float) * 256).astype(int)
    want = set()
    for i in range(0, 300, 50):
        s = q @ q[i]
        best = sorted((-s[j], j) for j in range(300) if j != i)[:5]
        want |= {(i, r + 1, j, -v) for r, (v, j) in enumerate(best)}
    assert {tuple(r) for r in got} == want and len(got) == 30
    assert topk.search(table.limit(0), lambda c: c % 50 == 0).collect() == []


def test_topk_of_a_shard_stops_early_and_takes_large_numbers():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (3000, 16))
    for v in (x, x * (1 << 25)):
        index = topk.Shard(np.arange(3000)[::-1], v)
        for i in range(0, 3000, 300):
            ids, score = index.top(v[i], 2999 - i, 5)
            s = v @ v[i]
            assert [(a, b) for a, b in zip(ids, score)] == [(j, t) for t, j in ((-u, j) for u, j in sorted((-s[2999 - j], j) for j in range(3000) if j != 2999 - i)[:5])]


# 2


def test_sharding_versions_and_merging(spark):
    path = scratch_path(spark, "t")
    table = sharding.ShardedTable(spark, path, target=20_000, fanin=3)
    frame = lambda a, b: spark.createDataFrame([(i, None if i % 7 == 0 else f"text {i} " * 5) for i in range(a, b)], "doc_id long, text string")
    with pytest.raises(ValueError):
        table.read()
    for k in range(7):
        table.append(frame(k * 50, k * 50 + 50).coalesce(1))
    table.append(frame(0, 0))
    before = table.manifest()
    assert before["version"] == 8 and sum(s["rows"] for s in before["shards"]) == 350
    after = table.compact()
    assert len(after["shards"]) < len(before["shards"]) and table.read().count() == 350
    assert sorted(map(tuple, table.read(before["version"]).collect()), key=repr) == sorted(map(tuple, table.read().collect()), key=repr)
    with pytest.raises(sharding.Conflict):
        table._commit(before, [], before["schema"], "late")
    assert table.expire() > 0 and table.versions() == [after["version"]] and table.read().count() == 350
    whole = sharding.ingest(docs(spark, corpus()), scratch_path(spark, "t"), (topk.F.col("doc_id") % 5).cast("int"), target=1 << 20, fanin=2)
    assert whole.read().count() == len(corpus()) and whole.read().columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_two_compactions_at_once(spark, monkeypatch):
    path = scratch_path(spark, "t")
    table, other = (sharding.ShardedTable(spark, path, target=20_000, fanin=3) for _ in range(2))
    for k in range(4):
        table.append(spark.range(k * 50, k * 50 + 50).coalesce(1))
    update, late = table._update, []

    def behind(change, schema, what):
        if not late:
            late.append(other.compact())  # the other one commits while this one merges
        return update(change, schema, what)

    monkeypatch.setattr(table, "_update", behind)
    table.compact()
    assert sorted(r.id for r in table.read().collect()) == list(range(200))
    table.expire()
    listed = {s["file"] for s in table.manifest()["shards"]}
    files = [p.removeprefix("file:").split("/data/")[1] for p in spark.read.option("recursiveFileLookup", True).parquet(f"{path}/data").inputFiles()]
    assert {f"data/{f}" for f in files} == listed
    table.append(spark.range(200, 210))
    assert table.expire(age=3600) == 0 and len(table.versions()) == 2


def test_sharding_of_odd_columns(spark):
    rows = spark.createDataFrame([(1, 2, None), (1, 2, None), (None, None, "x")], "doc_id long, __arrival int, file string")
    whole = sharding.ingest(rows, scratch_path(spark, "t"), topk.F.coalesce("doc_id", topk.F.lit(0)))
    assert sorted(map(tuple, whole.read().collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    assert sharding.ingest(rows.limit(0), scratch_path(spark, "t"), topk.F.col("doc_id")).read().count() == 0


def test_sharding_takes_other_columns_and_sweeps_what_died(spark):
    path = scratch_path(spark, "t")
    table = sharding.ShardedTable(spark, path, fanin=2)
    table.append(spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1))
    table.append(spark.createDataFrame([(2, "en")], "doc_id long, lang string").coalesce(1))
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([("x",)], "doc_id string"))
    want = [(1, "a", None), (2, None, "en")]
    for step in (lambda: None, table.compact, table.expire):
        step()
        assert table.read().columns == ["doc_id", "text", "lang"] and sorted(map(tuple, table.read().collect())) == want
    spark.range(5).coalesce(1).write.parquet(f"{path}/data/died")
    draft = table._path("manifest/.0123")
    table._fs.create(draft, False).close()
    assert table.sweep() == 0  # all is younger than a day
    assert table.sweep(age=-1) >= 3 and not table._fs.exists(draft)
    assert sorted(map(tuple, table.read().collect())) == want and table.sweep(age=-1) == 0


# 3


def windows(text, items, n=10):
    w = WORD.findall(low(text))
    hit, found = [False] * len(w), set()
    for name, said in items:
        v = WORD.findall(low(said))
        k = min(n, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in grams:
                hit[i : i + k] = [True] * k
                found.add(str(name) if name is not None else "")
    return len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("block", [15, 10_000])
def test_decontamination_equals_brute_force(spark, block):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "D"]
    texts = [None, "", *[" ".join(rng.choices(vocabulary, k=rng.randrange(1, 60))) for _ in range(60)]]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 25)))) for k in range(12)] + [(3, "a b c d a b"), (None, "b b b b b"), (50, None), (51, " - ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.annotate(docs(spark, texts), bench, block_words=block).collect()
    for r in got:
        hits = r.decontam.hits
        n = sum(b - a for a, b in zip(hits[::2], hits[1::2], strict=True))
        assert (r.decontam.n_words, n, r.decontam["items"]) == windows(texts[r.doc_id], items), r
    assert len(got) == len(texts)
    assert decontam.annotate(docs(spark, texts), bench.limit(0)).where("size(decontam.hits) > 0").count() == 0
    assert decontam.annotate(empty(spark), bench).count() == 0


def test_decontamination_holds_one_automaton_at_a_time(spark, monkeypatch):
    rng = random.Random(13)
    items = [(k, prose(rng, 30)) for k in range(12)]
    texts = [" ".join([prose(rng, 20), said, prose(rng, 20)]) for _, said in items] + [" ".join(said for _, said in items), prose(rng, 50)]
    written = []
    monkeypatch.setattr(decontam, "materialise", lambda df, name, write=decontam.materialise: written.append(name) or write(df, name))
    got = decontam.annotate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_words=60)
    assert str(got._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 1 and len(written) == 5
    for r in got.collect():
        n = sum(r.decontam.hits[1::2]) - sum(r.decontam.hits[::2])
        assert (r.decontam.n_words, n, r.decontam["items"]) == windows(texts[r.doc_id], items), r


def test_decontamination_of_long_and_repeated_texts(spark):
    rng = random.Random(12)
    said = " ".join(rng.choices([f"w{k}" for k in range(50)], k=40))
    long = " ".join([*rng.choices([f"w{k}" for k in range(50)], k=200_000), said, *rng.choices([f"w{k}" for k in range(50)], k=1000)])
    texts = [long, long, said, said]
    got = decontam.annotate(docs(spark, texts), spark.createDataFrame([(1, said)], "item_id long, text string")).collect()
    assert all((r.decontam.n_words, sum(r.decontam.hits[1::2]) - sum(r.decontam.hits[::2]), r.decontam["items"]) == windows(texts[r.doc_id], [(1, said)]) for r in got) and len(got) == 4


def test_decontamination_removes_spans(spark):
    passage = "the quick brown fox jumps over the lazy dog and runs away today"
    texts = [f"before it all. {passage.upper()}! after, it goes on and on for some time yet", passage, "clean text", None]
    out = {r.doc_id: r for r in decontam.remove(docs(spark, texts), spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert out[0].text == "before it all. ! after, it goes on and on for some time yet" and out[0].n_chars == len(out[0].text)
    assert 1 not in out and out[2].text == "clean text" and out[3].text is None
    assert list(out[0].asDict()) == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


# 4


def plain_base(text):
    found = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((*m.span(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and s % 10 == 0:
            found.append((*m.span(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans_equal_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.co", "@", "x.y-z@", ".", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "411111111111111", "+1 (499) 555-6503", "+", "7", "77", "-", " ", "é", "b.c", "@d.e@f.g", "0001.2.3.4"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 12)))
        assert pii.base(text) == plain_base(text), text


def test_disclosing_words(spark):
    filler = random.Random(8)
    texts = [f"{prose(filler, 30)} zorblax writes from jane{k} at jo@x.org today {prose(filler, 30)}" for k in range(6)]
    texts += [f"{prose(filler, 40)} today it rains" for _ in range(80)] + [texts[0]] * 5 + [None, "", "mail me: solo@y.net please"]
    got = {r.doc_id: r for r in pii.all_spans(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for k in range(6):
        said = {texts[k][f.start : f.end] for f in got[k].found}
        assert {"zorblax", "writes"} <= said and f"jane{k}" not in said and "jo" not in said
    assert all(not got[k].found for k in range(6, 86)) and got[91].base == [] and got[93].found == []
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "[EMAIL]" in clean[0] and "zorblax" not in clean[0] and clean[10] == texts[10] and clean[91] is None and clean[93] == "mail me: [EMAIL] please"
    assert pii.all_spans(empty(spark)).count() == 0 and pii.sanitise(empty(spark)).count() == 0


def plain_shares(texts, window, support):
    """Shares of information by word, from words and mentions counted one by one."""
    n, total, near, contexts = Counter(), 0, Counter(), defaultdict(set)
    for t in texts:
        spots = list(WORD.finditer(low(t)))
        n.update(m[0] for m in spots)
        found = pii.base(t or "")
        free = [k for k, m in enumerate(spots) if all(m.end() <= a or m.start() >= b for a, b, _ in found)]
        seen = set()
        for a, b, kind in found:
            left, right = [k for k, m in enumerate(spots) if m.end() <= a], [k for k, m in enumerate(spots) if m.start() >= b]
            around = [k for k in left[-window:] + right[:window] if k in free]
            e = (kind, t[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", t[a:b]))
            for k in around:
                if (e, k) not in seen:
                    seen.add((e, k))
                    near[e, spots[k][0]] += 1
                    contexts[e, spots[k][0]].add(tuple(spots[x][0] for x in around))
    total, of = sum(n.values()), Counter()
    for (e, _), c in near.items():
        of[e] += c
    out = {}
    for (e, t), c in near.items():
        if len(contexts[e, t]) >= support and of[e] < total:
            pmi, ic = np.log2(total * c / (of[e] * n[t])), np.log2(total / of[e])
            out[t] = max(out.get(t, -9), pmi / ic)
    return out


def test_shares_of_information_equal_brute_force(spark):
    rng = random.Random(14)
    names, cities = [f"name{k}" for k in range(12)], [f"city{k}" for k in range(4)]
    texts = [None, ""]
    for _ in range(400):
        k = rng.randrange(12)
        mail = f" {names[k]} of {cities[k % 4]} at u{k}@x.org" + (f" or 10.0.0.{k % 3}" if rng.random() < 0.3 else "") if rng.random() < 0.5 else f" {rng.choice(cities)}"
        texts.append(f"{prose(rng, rng.randrange(10, 40))}{mail} {prose(rng, rng.randrange(10, 40))}")
    texts += texts[2:8] + [f"{prose(rng, 30_000)} name3 {prose(rng, 1000)}"]
    want = plain_shares([*texts, texts[3]], pii.WINDOW, pii.SUPPORT)
    told = {t for t, s in want.items() if s >= pii.GENERALISE}
    assert set(names) <= told and not told & {*cities, "at", "of"}
    rows = [(None if i % 9 == 5 else i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    got = pii.all_spans(frame).collect()
    assert len(got) == len(rows) + 1
    by = defaultdict(list)
    for r in pii.terms(frame).join(frame.select("doc_id", "text", topk.F.xxhash64(topk.F.coalesce("text", topk.F.lit(""))).alias("th")).distinct(), "th").collect():
        by[r.text].append(r)
    for text, found in by.items():
        base = pii.base(text)
        outside = [m for m in WORD.finditer(low(text)) if all(m.end() <= a or m.start() >= b for a, b, _ in base)]
        spans = [(m.start(), m.end(), want[m[0]]) for m in outside if m[0] in told]
        assert all([(f.start, f.end) for f in r.found] == [s[:2] for s in spans] for r in found) and [f.share for f in found[0].found] == pytest.approx([s[2] for s in spans])
    assert set(by) == {t for t in texts if t and any(m[0] in told for m in WORD.finditer(low(t)))}


def test_disclosing_words_go_wherever_they_stand(spark):
    filler = random.Random(8)
    texts = [f"{prose(filler, 30)} zorblax writes at jo@x.org today {prose(filler, 30)}" for k in range(9)]
    texts += [f"{prose(filler, 40)} today it rains" for _ in range(80)]
    texts += [f"é zorblax, {prose(filler, 40)} mail jo@x.org or zorblax@y.org", f"{prose(filler, 20)} Zorblax rains"]
    got = {r.doc_id: r for r in pii.all_spans(docs(spark, texts)).collect()}
    assert [[texts[k][f.start : f.end] for f in got[k].found] for k in (89, 90)] == [["zorblax"], ["Zorblax"]]
    assert not {"today", "it", "rains"} & {texts[k][f.start : f.end] for k in range(9, 89) for f in got[k].found}
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, texts)).collect()}
    assert "zorblax" not in (clean[89] + clean[90]).lower() and "[EMAIL]" in clean[89]


# 5


def shingle_sets(texts):
    out = {}
    for i, t in enumerate(texts):
        w = WORD.findall(low(t))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


@pytest.mark.parametrize("small, clash", [(2, False), (1024, False), (1024, True)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, small, clash):
    if clash:  # numbers of which many sets share one, twice over
        number = jaccard._number
        monkeypatch.setattr(jaccard, "_number", lambda again: number(again) % (3 if again == 0 else 40) + 1000 * again if again < 2 else number(again))
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", 3 if small == 2 else 512)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000 if small == 2 else 1 << 28)
    texts = corpus()
    sets = shingle_sets(texts)
    link = defaultdict(set)
    for i in sets:
        for j in sets:
            if i != j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                link[i].add(j)
    root = {}
    for i in sets:
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += link[k]
    got = jaccard.join(docs(spark, texts)).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, root[i], len(link[i])) for i in sets}
    assert all(r.copy_id == min(j for j in sets if sets[j] == sets[r.doc_id]) for r in got if sets[r.doc_id])
    assert jaccard.join(empty(spark)).count() == 0


def test_jaccard_repeated_and_null_ids(spark):
    text = prose(random.Random(1), 50)
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    got = sorted(map(tuple, jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_links").collect()), key=repr)
    assert got == sorted([(1, 2), (1, 2), (None, 2), (2, 0), (3, 0)], key=repr)


def test_jaccard_of_many_near_copies_in_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 8)
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(31)
    heads = [prose(rng, 40) for _ in range(30)]
    texts = [" ".join(w if rng.random() > 0.01 else f"e{k}" for w in heads[k % 30].split()) for k in range(300)]
    common = prose(rng, 12)  # a passage of all texts
    texts = [f"{t} {common}" for t in texts]
    sets = shingle_sets(texts)
    links = Counter(i for i in sets for j in sets if i != j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    got = {r.doc_id: r.n_links for r in jaccard.join(docs(spark, texts)).collect()}
    assert got == {i: links[i] for i in sets} and sum(got.values()) > 500


def test_trees_until_the_recall():
    # pairs whose buckets are split at every level survive as a branching process does
    rng = np.random.default_rng(3)
    n, lost = 4000, 0
    for _ in range(n):
        met = False
        for _ in range(jaccard.runs(0.99)):
            nodes = rng.poisson(1.0)
            for _ in range(jaccard.LEVELS):
                nodes = min(rng.poisson(jaccard.DEEP * nodes), 1000)
            met |= nodes > 0
        lost += not met
    assert lost / n < 0.014


# 6


def brute_repeats(rows, n):
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - n + 1):
            if raw[k : k + n] in seen:
                gone[k : k + n] = True
            seen.add(raw[k : k + n])
        out[i] = (len(raw), bytes(b for b, g in zip(raw, gone, strict=True) if not g))
    return out


def test_stretches_are_equal_in_both_hashes():
    a, n = np.array([5, 5, 6, 5, 6, 7], np.uint64), np.array([1, 1, 1, 2, 1, 1], np.uint64)
    key = np.array([9, 9, 9, 9, 8, 8], np.uint64)
    assert suffixdup._again(key, a, n).tolist() == [False, True, False, False, False, False]


@pytest.mark.parametrize("length,hot", [(100, 4096), (20, 4096), (20, 1)])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(suffixdup, "HOT", hot)
    monkeypatch.setattr(suffixdup, "TILE", 1500)
    texts = corpus()
    want = brute_repeats(list(enumerate(texts)), length)
    got = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in suffixdup.remove(docs(spark, texts), length=length).collect()}
    assert got == want


def test_suffix_dedup_of_a_line_in_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(suffixdup, "SLOTS", 64)
    monkeypatch.setattr(suffixdup, "HOT", 12)
    rng = random.Random(17)
    line = "all of this is common to many texts, whatever else they may say of other things, and it is long enough"
    texts = [f"{prose(rng, rng.randrange(3, 9))} {line} {prose(rng, rng.randrange(3, 9))}" for _ in range(150)] + [None, prose(rng, 50)]
    seen = []
    marked = suffixdup._marked
    monkeypatch.setattr(suffixdup, "_marked", lambda scan: seen.append(marked(scan)) or seen[-1])
    monkeypatch.setattr(suffixdup, "discard", lambda *tables: None)
    got = {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in suffixdup.remove(docs(spark, texts), length=100).collect()}
    assert got == brute_repeats(list(enumerate(texts)), 100) and sum(len(k) < n for n, k in got.values()) == 149
    assert seen[0].where("hot").count() > 100


def test_suffix_dedup_repeated_and_null_ids(spark):
    text = prose(random.Random(1), 40)
    rows = [(2, text), (2, text), (None, text), (3, "short"), (4, None)]
    got = sorted((repr(r.doc_id), len(r.kept)) for r in suffixdup.remove(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("2", 0), ("2", 0), ("None", len(text.encode())), ("3", 5), ("4", 0)])
    assert suffixdup.remove(empty(spark)).count() == 0


def test_candidates_are_all_stretches_that_repeat():
    rng = random.Random(8)
    raws = [bytes(rng.randrange(3) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + [b"", b"abcdef"]
    windows = Counter(r[k : k + 6] for r in raws for k in range(len(r) - 5))
    want = [i for i, r in enumerate(raws) if any(windows[r[k : k + 6]] > 1 for k in range(len(r) - 5))]
    assert suffixdup._candidates(raws, 6).tolist() == want and 0 < len(want) < len(raws)
    assert suffixdup._candidates([], 6).tolist() == suffixdup._candidates([b"abcdef", b"abc"], 6).tolist() == []


def test_longest_previous_factors():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, 300)
    text[200:260] = text[20:80]
    said = text.tolist()
    for least in (4, 30):
        got = suffixdup.previous_factors(text, least)
        for i in range(300):
            best = max((next((k for k in range(300 - i) if said[i + k] != said[j + k]), 300 - i) for j in range(i)), default=0)
            assert (got[i] >= least) == (best >= least) and got[i] <= best


# 7


def test_quality_on_held_out_labels(spark):
    rng = random.Random(4)
    good = lambda: (prose(rng, rng.randrange(20, 80)).capitalize() + ".").replace("0", "")
    bad = lambda: " | ".join(w.upper() + "!!" for w in prose(rng, rng.randrange(20, 80)).split())
    marks = [rng.random() < 0.7 for _ in range(400)]
    texts = [good() if m else bad() for m in marks] + [None, ""]
    labels = spark.createDataFrame([*((i, int(m), 0) for i, m in enumerate(marks)), (None, 1, 0), (5, None, 0), (400, 0, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    train = lambda c: crc_mod(c, 3) != 1
    model = quality.fit(docs(spark, texts), labels, train=train, features=64)
    got = {r.doc_id: r.score for r in quality.score(docs(spark, texts), model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.5) == marks[i] for i in held) >= 0.97 * len(held)
    assert len(got) == 402 and all(0 <= s <= 1 for s in got.values()) and got[400] == got[401]
    kept = quality.keep(docs(spark, texts), model)
    assert kept.columns == docs(spark, texts).columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}
    none = quality.fit(empty(spark), labels.limit(0), train=train)
    assert {r.score for r in quality.score(docs(spark, texts), none).collect()} == {0.5}
    assert quality.score(empty(spark), model).count() == 0


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, quality.N_STATS))
    model = {"seed": 7, "features": 20_000, "gamma": quality.GAMMA / quality.N_STATS, "mean": [0.0] * quality.N_STATS, "scale": [1.0] * quality.N_STATS}
    z = quality.fourier(x, model)[:, 1:]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-model["gamma"] * far)).max() < 0.04


def test_weights_equal_plain_ridge(spark):
    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(5, 60)).upper() if k % 3 else prose(rng, rng.randrange(5, 60)) for k in range(120)]
    rows = [(k, float(k % 3 == 0), 0.0) for k in range(120)] + [(7, float("nan"), 0.0), (None, 1.0, 0.0), (8, None, 0.0)]
    frame = spark.createDataFrame([*enumerate(texts), (None, "null id"), (3, texts[3])], "doc_id long, text string").repartition(3)
    model = quality.fit(frame, spark.createDataFrame(rows, "doc_id long, quality double, toxic double"), features=32)
    said = [*texts, texts[3]]  # a repeated row teaches twice
    y = np.array([*(k % 3 == 0 for k in range(120)), True], float)
    x = quality.statistics(*textbytes.strings(pa.array(said)))
    np.testing.assert_allclose(model["mean"], x.mean(0), atol=1e-12)
    np.testing.assert_allclose(model["scale"], np.maximum(x.std(0), 1e-3), atol=1e-9)
    z = quality.fourier(x, model)
    w = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.diag([1e-9, *np.ones(32)]) / 32, z.T @ y)
    np.testing.assert_allclose(model["w"], w, atol=1e-6)
    got = {(r.doc_id, r.score) for r in quality.score(frame, model).collect()}
    assert len(got) == 121 and all(0 <= s <= 1 for _, s in got)


def test_isotonic_is_monotone():
    knots, levels = quality.isotonic(np.array([4, 0, 4, 4]), np.array([2, 0, 1, 4]))
    assert len(levels) == 2 and levels[0] < levels[1] and knots[0] < knots[1]


# 8


def test_chat_round_trip(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 3)
    odd = ["\\### Assistant: </turn> ok", "####", "\\\\###\\", "</turn></turn>", "", None, "### user:\n", "é日本🤗 <|endoftext|> \n\n", " lead", "trail \n"]
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b\n", None]), rng.choice(odd), "x") for c in range(12) for t in range(rng.randrange(1, 9))]
    rows += [(3, 0, "assistant", "same", "x"), (3, 0, "assistant", "same", "x"), (None, 1, "user", "u", "x"), (None, None, "assistant", "v", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string").repartition(4)
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(table)).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digest(chat.format_chats(table.limit(0))).count() == 0
    one = chat.format_chats(table.where("conv_id = 3")).first()
    assert len(one.token_ids) == len(one.loss_mask) and any(one.loss_mask)
    parts = chat.format_chats(table)
    assert parts.where("n_turns > 3").count() == 0 and parts.count() > len(by)
    own = chat.load(open(chat.TOKENIZER, "rb").read())
    for r in chat.whole(parts).collect():
        text, lo, hi = chat.render([(r_, x) for _, r_, x in sorted(by[r.conv_id])])
        made = own.encode(text, add_special_tokens=False)
        wanted = np.array([r_ == "assistant" for _, r_, _ in sorted(by[r.conv_id])])
        a, b = np.array(made.offsets).reshape(-1, 2).T
        on, spans = chat.mask(a, b, lo[wanted], hi[wanted])
        assert (r.formatted, r.token_ids, r.loss_mask, r.n_turns) == (text, made.ids, on.tolist(), len(by[r.conv_id]))
        assert r.loss_spans == [x for s in spans for x in s]


def test_a_tokenizer_that_joins_turns_is_refused(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer, models

    own = Tokenizer(models.BPE({chr(k): k for k in range(32, 127)} | {"\n": 127}, []))
    own.save(str(tmp_path / "t.json"))
    assert not chat.splits(own, "user")
    table = spark.createDataFrame([(1, k, "user", "a") for k in range(9)], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(table, tokenizer=str(tmp_path / "t.json")).count() == 1
    monkeypatch.setattr(chat, "PART_TURNS", 4)
    with pytest.raises(Exception, match="between turns"):
        chat.format_chats(table, tokenizer=str(tmp_path / "t.json")).count()


# 9


def test_pieces_do_not_depend_on_the_batch():
    voc = pieces.Vocabulary()
    rng = random.Random(23)
    texts = [prose(rng, 40) + chr(rng.randrange(200, 5000)) for _ in range(300)]
    alone = pieces._points(*textbytes.strings(pa.array(texts[150:151])))
    many = pieces._points(*textbytes.strings(pa.array(texts)))
    cut = many[1][150:152]
    _, token, run, of = pieces._filter(many[0], many[1], voc)
    _, token_, run_, of_ = pieces._filter(alone[0], alone[1], voc)
    at, at_ = of[cut[0] : cut[1]], of_
    for a, b in zip(at, at_, strict=True):
        k = 0
        while True:
            assert run[a + k] == run_[b + k] and token[a + k] == token_[b + k]
            if run[a + k] == 2.0:
                break
            k += 1


def test_pieces_of_null_keys_and_equal_rows(spark):
    text = prose(random.Random(2), 30)
    rows = [(None, text), (None, text), (1, text), (1, text), (2, text), (None, None)]
    got = [(r.doc_id, tuple(r.pieces)) for r in pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert len(set(got)) == 4 and Counter(got)[None, ()] == 1 and sorted(Counter(got).values()) == [1, 1, 2, 2]


def test_pieces_are_lossless_and_reproducible(spark):
    texts = [*corpus(), "▁x  ▁ y", "\n\n\t\x00", "   ", "<s></s><unk>", "a" * 300]
    got = {r.doc_id: r for r in pieces.encode(docs(spark, texts), decoded=True).collect()}
    again = {r.doc_id: r.pieces for r in pieces.encode(docs(spark, texts).repartition(7)).collect()}
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for i, t in enumerate(texts):
        assert got[i].decoded == (t or "") and got[i].pieces == again[i]
        if t and "\x00" not in t:
            assert sp.decode(got[i].pieces) == t
    assert pieces.encode(docs(spark, texts), seed=1).where("doc_id = 10").first().pieces != got[10].pieces
    assert {r.decoded for r in pieces.decode(pieces.encode(docs(spark, texts))).collect()} == {t or "" for t in texts}
    assert pieces.encode(empty(spark)).count() == 0


def test_strings_past_a_batch_of_32_bits_come_in_parts():
    data, off = np.frombuffer(b"abcdefghij", np.uint8), np.array([0, 3, 3, 6, 10, 10])
    for most in (1, 3, 4, 6, 100):
        got = list(pieces._strings(data, off, most))
        assert [x for _, _, part in got for x in part.to_pylist()] == ["abc", "", "def", "ghij", ""]
        assert [a for a, _, _ in got] == [0, *(b for _, b, _ in got[:-1])] and got[-1][1] == 5
        assert all(b - a == len(part) and (off[b] - off[a] <= most or off[b] - off[a] == np.diff(off[a : b + 1]).max()) for a, b, part in got)
    assert [(a, b, len(x)) for a, b, x in pieces._strings(data[:0], np.array([0]), 5)] == [(0, 0, 0)]



def test_sampling_follows_the_lattice():
    voc = pieces.Vocabulary()
    word = "that"
    said, n = "▁" + word, len(word) + 1
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    weight = {sp.id_to_piece(int(i)): w for i, w in zip(voc.id, voc.weight, strict=True)}
    ways = {}

    def walk(at, done, total):
        if at == n:
            ways[tuple(done)] = total
        for k in range(at + 1, n + 1):
            if said[at:k] in weight:
                walk(k, [*done, said[at:k]], total + weight[said[at:k]])

    walk(0, [], 0.0)
    z = sum(np.exp(v) for v in ways.values())
    data, off = textbytes.strings(pa.array([word] * 40_000))
    ids, cut = pieces.sample(data, off, np.arange(40_000), pieces.Parts(voc))
    seen = Counter(tuple(sp.id_to_piece(int(i)) for i in ids[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True))
    assert set(seen) <= set(ways)
    for way, v in ways.items():
        p = np.exp(v) / z
        assert abs(seen[way] / 40_000 - p) < 5 * (p * (1 - p) / 40_000) ** 0.5 + 1e-4


# 10


def test_brown_base_score_and_model(spark):
    texts = [t for t in corpus() if t is None or len(t) < 2000]
    frame = docs(spark, texts)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", low(t)) if w] + [None]
    count = Counter(w for i, t in enumerate(texts) if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    flag = crc_mod(brown.F.col("doc_id"), 7) == 2
    model = brown.fit(frame.where(~flag), head=30, classes=6)
    assert (model["tokens"], model["words"]) == (n, v)
    np.testing.assert_allclose((10 ** model["step"]).sum(1), 1)
    for most in (brown.MAX_WORDS, 5):
        got = {r.doc_id: r for r in brown.score(frame, model, keep={"held_out": flag}, max_words=most).collect()}
        for i, t in enumerate(texts):
            w = tokens(t)
            assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held(i), len(w), sum(x in count for x in w), n)
            assert got[i].base_score == pytest.approx(sum(log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
            assert got[i].score < 0
    none = brown.fit(empty(spark))
    assert brown.score(frame, none).where("n_known > 0").count() == 0 and brown.score(empty(spark), model).count() == 0


def test_brown_score_equals_plain_class_bigrams(spark):
    texts = [t for t in corpus() if t is None or len(t) < 2000]
    rows = [*enumerate(texts), (None, texts[9]), (3, "one two"), (3, "one two")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    teach = topk.F.coalesce("doc_id", topk.F.lit(0)) % 3 != 0
    model = brown.fit(frame.where(teach), head=30, classes=6)
    of = {r["word"]: (r["class"], r["n"]) for r in model["vocabulary"].collect()}
    end = int(brown.END.view(np.int64))

    def classes(t):
        h, shape, _ = brown.tokens(*textbytes.strings(pa.array([t or ""])))
        return [of[w][0] if w in of else int(model["class"][1 + s]) for w, s in zip(h.view(np.int64).tolist(), shape.tolist(), strict=True)] + [of[end][0]]

    taught = [t for i, t in rows if (0 if i is None else i) % 3 != 0]
    k = len(model["step"])
    big = np.zeros((k, k))
    for t in taught:
        c = classes(t)
        for a, b in zip([0, *c[:-1]], c, strict=True):
            big[a, b] += 1
    step = np.log10((big + 0.1) / (big.sum(1, keepdims=True) + 0.1 * k))
    size = Counter()
    for c, n in of.values():
        size[c] += n + 1
    words = lambda t: brown.tokens(*textbytes.strings(pa.array([t or ""])))[0].view(np.int64).tolist() + [end]
    want = Counter()
    for i, t in rows:
        c = classes(t)
        want[i, round(sum(step[a, b] + log10(of.get(w, (0, 0))[1] + 1) - log10(size[b] + 1) for a, b, w in zip([0, *c[:-1]], c, words(t), strict=True)), 6)] += 1
    assert Counter((r.doc_id, round(r.score, 6)) for r in brown.score(frame, model).collect()) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_words_are_found_from_their_slots(n):
    rng = np.random.default_rng(3)
    near = np.arange(20, dtype=np.uint64) + np.uint64(1 << 60)  # of one slot
    word = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, np.uint64), near, np.array([0, (1 << 64) - 1], np.uint64)])) if n > 2 else np.sort(rng.integers(0, 1 << 64, n, np.uint64))
    slot, most = brown._slots(word)
    asked = np.concatenate([word, word + np.uint64(1), word - np.uint64(1), rng.integers(0, 1 << 64, 500, np.uint64)])
    at, there = brown._find({"word": word, "slot": slot, "most": most}, asked)
    assert (there == np.isin(asked, word)).all() and (word[at[there]] == asked[there]).all()


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(0)
    n = np.zeros((13, 13))
    for _ in range(4000):  # units 1-6 follow 7-12 and the other way round
        a = rng.integers(1, 7)
        b = rng.integers(7, 13)
        n[a, b] += 1
        n[b, a if rng.random() < 0.5 else rng.integers(1, 7)] += 1
    of = brown.exchange(n, 3)
    assert len({*of[1:7]}) == 1 and len({*of[7:13]}) == 1 and of[1] != of[7]


def test_every_word_moves_to_the_class_of_most_likelihood():
    rng = np.random.default_rng(1)
    m, k = 12, 4
    n = rng.integers(0, 9, (m, m)).astype(float)
    of = np.array([0, *rng.integers(1, k, m - 1)])

    def likelihood(of):
        pick = np.eye(k)[of]
        big = pick.T @ n @ pick
        return brown._xlogx(big).sum() - brown._xlogx(big.sum(0)).sum() - brown._xlogx(big.sum(1)).sum()

    pick = np.eye(k)[of]
    for u in range(1, m):
        row, col, own = n[u] @ pick, n[:, u] @ pick, n[u, u]
        row[of[u]] -= own
        col[of[u]] -= own
        counts = np.array([*col, *row, own])
        got = brown.best_class(np.zeros(len(counts), int), np.arange(len(counts)), counts, of[[u]], pick.T @ n @ pick)[0]
        want = [likelihood(np.where(np.arange(m) == u, b, of)) for b in range(1, k)]
        assert want[got - 1] == pytest.approx(max(want), abs=1e-9)


def test_brown_words_outside_the_head_have_classes_by_context(spark):
    rng = random.Random(9)
    rare = [f"{c}{x}aaa" for c in "bcdfgh" for x in "eiou"]  # one shape
    texts = [f"to {w} go" if k % 2 else f"the {w} is" for k, w in enumerate(rare) for _ in range(2 + k % 2)]
    texts += [x for k in range(60) for x in ("the cat is", "the dog is", "to eat go", "to run go")]
    rng.shuffle(texts)
    model = brown.fit(docs(spark, texts), head=8, classes=9)
    assert model["vocabulary"].count() == model["words"] == len(rare) + 9 and model["vocabulary"].where("class is null").count() == 0
    hashes = dict(zip(rare, brown.tokens(*textbytes.strings(pa.array([" ".join(rare)])))[0].view(np.int64).tolist(), strict=True))
    of = {r["word"]: r["class"] for r in model["vocabulary"].collect()}
    odd, even = ({of[hashes[w]] for w in rare[a::2]} for a in (1, 0))
    assert len(odd) == len(even) == 1 and odd != even
    few = brown.fit(docs(spark, texts), head=8, classes=9, max_words=3)
    np.testing.assert_array_equal(few["step"], model["step"])
    seen = [{r.doc_id: r.score for r in brown.score(docs(spark, texts), x, max_words=most).collect()} for x, most in ((model, 100), (few, 3))]
    assert seen[0] == pytest.approx(seen[1])
