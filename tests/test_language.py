"""Sentence ends learnt from a corpus, stems and alignments, against plain versions."""

import math
import random
import time
from collections import Counter, defaultdict

import pytest
import regex
from pyspark.sql import functions as F

from relgraph.functions.stem import stem
from relgraph.operators import metrics, punkt
from relgraph.sources import scratch


def core(w):
    return regex.sub(punkt.TAIL, "", regex.sub(punkt.LEAD, "", w))


def look(w):
    c = core(w)
    dots = bool(regex.search(r"\.\.+$", c))
    bare = regex.sub(r"\.$", "", c)
    of = punkt.NUMBER_TYPE if regex.search(punkt.NUMBER, bare) else (c if dots else bare).lower()
    return {"of": of, "dots": dots, "period": c.endswith(".") and not dots, "mark": bool(regex.search("[!?]$", c)), "upper": bool(regex.match(r"\p{Lu}", c)), "lower": bool(regex.match(r"\p{Ll}", c))}


def ll(a, b, ab, n):
    p, p1, p2 = b / n, ab / a if a else None, (b - ab) / (n - a) if n != a else None
    of = lambda k, m, q: 0.0 if q is None or q <= 0 or q >= 1 else k * math.log(q) + (m - k) * math.log(1 - q)
    return -2 * (of(ab, a, p) + of(b - ab, n - a, p) - of(ab, a, p1) - of(b - ab, n - a, p2))


def plain_types(texts):
    seen = [look(w) for t in texts for w in t.split()]
    n, k = Counter(x["of"] for x in seen), Counter(x["of"] for x in seen if x["period"])
    p, out = sum(k.values()) / len(seen), {}
    for of in n:
        score = 0.0
        if k[of] and regex.search(r"\p{L}", of) and of != punkt.NUMBER_TYPE and not regex.search(r"\.\.+$", of):
            lg = lambda m, q: m * math.log(q) if m else 0.0
            d = lg(k[of], p) + lg(n[of] - k[of], 1 - p) - lg(k[of], 0.99) - lg(n[of] - k[of], 0.01)
            dots = of.count(".") + 1
            long = len(of) - dots + 1
            score = -2 * d * math.exp(-long) * dots * float(long) ** (k[of] - n[of])
        out[of] = (n[of], k[of], score)
    return out


def plain_sentences(texts, known=()):
    types = plain_types(texts)
    abbr = {of for of, x in types.items() if x[2] >= 0.3} | set(known)
    rows = [[look(w) for w in t.split()] for t in texts]
    for r in rows:
        for x in r:
            x["abbr"] = x["period"] and x["of"] in abbr
            x["end"] = (x["period"] and not x["abbr"]) or x["mark"]
    n, breaks = sum(map(len, rows)), sum(x["end"] for r in rows for x in r)
    single = lambda of: bool(regex.fullmatch(r"\p{L}", of))
    case, at, two = defaultdict(set), Counter(), Counter()
    for r in rows:
        for b, x in zip([None, *r], r):
            begins, unsure = b is None or b["end"], b is not None and (b["abbr"] or b["dots"])
            if x["upper"]:
                case[x["of"]] |= {"uc"} if begins or unsure else {"uc", "mid"}
            if x["lower"]:
                case[x["of"]] |= {"lc", "beg"} if begins else {"lc"}
            if b is not None:
                number = b["of"] == punkt.NUMBER_TYPE or single(b["of"])
                if b["end"] and not number and regex.fullmatch(r"\p{L}+", x["of"]):
                    at[x["of"]] += 1
                if b["period"] and number and regex.search(r"\p{L}", x["of"]):
                    two[b["of"], x["of"]] += 1
    starters = {of for of, k in at.items() if ll(breaks, types[of][0], k, n) >= 30 and n / breaks > types[of][0] / k}
    pairs = {(a, b) for (a, b), k in two.items() if k > 1 and ll(types[a][1], types[b][0], k, n) >= 7.88 and n / types[a][1] > types[b][0] / k}
    out = []
    for t, r in zip(texts, rows):
        now, got = [], []
        for i, (w, x) in enumerate(zip(t.split(), r)):
            now.append(w)
            if i + 1 == len(r):
                got.append(" ".join(now))
                continue
            if not (x["period"] or x["mark"] or x["dots"]):
                continue
            a = r[i + 1]
            c = case[a["of"]]
            small, large = a["lower"] and ("uc" in c or "beg" not in c), a["upper"] and "lc" in c and "mid" not in c
            if x["mark"]:
                end = True
            elif (x["of"], a["of"]) in pairs:
                end = False
            elif (x["abbr"] or x["dots"]) and not single(x["of"]):
                end = large or (a["upper"] and a["of"] in starters)
            elif single(x["of"]) or x["of"] == punkt.NUMBER_TYPE:
                end = not small and not (single(x["of"]) and not large and a["upper"] and "lc" not in c)
            else:
                end = True
            if end:
                got.append(" ".join(now))
                now = []
        out.append(got)
    return out


def corpus(seed):
    rng = random.Random(seed)
    names, words = ["Smith", "Jones", "Lee"], "river stone paid walked old red house then after many we they it".split()
    texts = []
    for _ in range(120):
        out = []
        for _ in range(rng.randrange(0, 6)):
            s = [rng.choice(["Then", "We", "They", "It", "River"])] + rng.choices(words, k=rng.randrange(1, 7))
            if rng.random() < 0.5:
                s.insert(rng.randrange(1, len(s)), rng.choice(["Dr.", "Dr.", "etc.", "e.g.", "J.", "3.5", "7.", "No.", "..."]) + " " + rng.choice([*names, "stone", "it"]))
            out.append(" ".join(s) + rng.choice([".", ".", ".", "!", '."', "?)", "...", ""]))
        texts.append(rng.choice([" ", "\n", "  "]).join(out))
    return [*texts, None, "", "  ", "One", "A. B.", "U.S. forces left. He"]


@pytest.mark.parametrize("seed", [1, 2])
def test_learnt_sentences_equal_a_plain_version(spark, monkeypatch, seed):
    texts = corpus(seed)
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    plain = [t or "" for t in texts]
    want = plain_types(plain)
    got = {r.of: (r.n, r.periods, r.score) for r in punkt.types(punkt.tokens(table)).collect()}
    assert set(got) == set(want) and all(got[k][:2] == want[k][:2] and got[k][2] == pytest.approx(want[k][2], rel=1e-9) for k in want)
    assert got["dr"][2] >= 0.3 > got["stone"][2]
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", (200_000, 0)[seed - 1])
    said = {}
    for r in punkt.sentences(table, punkt.fit(table)).orderBy("id", "sent").collect():
        said.setdefault(r.id, []).append(r.text)
    assert [said.get(i, []) for i in range(len(texts))] == plain_sentences(plain)
    empty = table.limit(0)
    assert punkt.sentences(empty, punkt.fit(empty)).collect() == []


def test_words_are_read_once_and_texts_are_cut_at_ends_alone(spark, monkeypatch):
    texts = ['He  paid\t3. "Dr.) Lee left?" (We ran!) Mr.\n\nNo. 7 is here.”  ', " \x0b\f\r ", "...", "a\u00a0b. c", "x\u2028y.) Z\x00 e.g. them. ", "no end", "He said. . and ! then .. so ?;: It", "".join(["w. "] * 50)]
    table = spark.createDataFrame(list(enumerate(texts * 2)), "id long, text string")
    want = [[] for _ in texts]
    for k, t in enumerate(texts):
        w, now = [x for x in regex.split("[ \t\n\x0b\f\r]+", t) if x], []
        for i, x in enumerate(w):
            now.append(x)
            c = core(x)
            if i == len(w) - 1 or c[-1:] in set(".!?") - {""}:
                want[k].append(now)
                now = []
    got = {r.id: r.p for r in table.select("id", punkt.pieces("text").alias("p")).collect()}
    assert [[[w for w in p.split(" ") if w] for p in got[i]] for i in range(len(texts))] == want
    # what is counted are different pairs of words, which two copies of a text do not add to
    counts = punkt.followed(table)
    once = punkt.followed(table.where(f"id < {len(texts)}"))
    assert counts.count() == once.count() and counts.agg(F.sum("times")).first()[0] == 2 * once.agg(F.sum("times")).first()[0] == 2 * sum(len(p) for t in want for p in t)
    # not a word of a text is a row of its own after that
    monkeypatch.setattr(punkt, "tokens", lambda *_: pytest.fail("each word was read"))
    model = punkt.fit(table)
    said = {(r.id, r.sent): r.text for r in punkt.sentences(table, model).collect()}
    assert " ".join(said[0, k] for k in range(len([x for x in said if x[0] == 0]))) == " ".join(texts[0].split())


def test_abbreviations_and_numbers_end_no_sentence(spark):
    model = punkt.fit(spark.createDataFrame(list(enumerate(corpus(3))), "id long, text string"))
    table = spark.createDataFrame([(1, "Dr. Smith paid 3.5 pounds. Then he left.")], "id long, text string")
    assert [r.text for r in punkt.sentences(table, model).orderBy("sent").collect()] == ["Dr. Smith paid 3.5 pounds.", "Then he left."]
    bare = spark.createDataFrame([(1, "we met Prof. Lee here. they met us")], "id long, text string")
    taught = punkt.fit(bare, known=["Prof."])
    assert [r.text for r in punkt.sentences(bare, taught).orderBy("sent").collect()] == ["we met Prof. Lee here.", "they met us"]


# examples that the paper gives for its steps
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl
sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll""".split()


def test_stems_of_the_paper():
    assert [stem(w) for w in STEMS[::2]] == STEMS[1::2]
    assert [stem(w) for w in ("is", "été", "3rds", "running", "runs", "")] == ["is", "été", "3rds", "run", "run", ""]


def plain_align(hyp, ref):
    """All alignments, one by one."""
    left, right = Counter(hyp), Counter(ref)
    exact = {w: min(n, right[w]) for w, n in left.items()}
    stems = Counter()
    for s in {stem(w) for w in hyp}:
        stems[s] = min(sum(n - exact[w] for w, n in left.items() if stem(w) == s), sum(n - exact.get(w, 0) for w, n in right.items() if stem(w) == s))
    best = [99]

    def go(i, used, pairs, e, t):
        if i == len(hyp):
            if all(e[w] == exact[w] for w in exact) and all(t[s] == stems[s] for s in stems):
                best[0] = min(best[0], sum(not (k and pairs[k - 1] == (a - 1, b - 1)) for k, (a, b) in enumerate(pairs)))
            return
        go(i + 1, used, pairs, e, t)
        for j, v in enumerate(ref):
            if j in used:
                continue
            if v == hyp[i] and e[v] < exact[v]:
                go(i + 1, used | {j}, [*pairs, (i, j)], e + Counter([v]), t)
            elif v != hyp[i] and stem(v) == stem(hyp[i]) and t[stem(v)] < stems[stem(v)]:
                go(i + 1, used | {j}, [*pairs, (i, j)], e, t + Counter([stem(v)]))

    go(0, frozenset(), [], Counter(), Counter())
    total = sum(exact.values()) + sum(stems.values())
    return total, best[0] if total else 0


def test_alignments_equal_brute_force():
    rng = random.Random(2)
    for k in range(150):
        pool = ["run", "running", "runs", "the", "cat", "cats"] if k % 3 else ["a", "b", "run", "runs", "c", "d", "e", "f", "the"]
        n = rng.randrange(0, 6 if k % 3 else 9)
        hyp, ref = rng.choices(pool, k=n), rng.choices(pool, k=rng.randrange(0, 6 if k % 3 else 9))
        assert metrics.align(hyp, ref, beam=1 << 14) == plain_align(hyp, ref), (hyp, ref)
        m, c = metrics.align(hyp, ref)
        assert m == plain_align(hyp, ref)[0] and c >= plain_align(hyp, ref)[1]


def test_meteor(spark):
    rows = spark.createDataFrame([(1, "The cat sat", "the cat sat"), (2, "cats running", "the cat runs"), (3, None, "x"), (4, "a b", "c"), (5, "b a", "a b")], "id int, hyp string, ref string")
    got = {r.id: r for r in metrics.meteor(rows).collect()}
    assert got[1].score == pytest.approx(1 - 0.5 / 27) and (got[2].matches, got[2].chunks) == (2, 1) and got[3].score == got[4].score == 0
    p, r = 1, 2 / 3
    assert got[2].score == pytest.approx(p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * (1 / 2) ** 3)) and got[5].score == pytest.approx(0.5)


def test_counts_by_type_come_from_one_pass(spark):
    kept = {}

    def keep(df, name):
        kept[name] = set(df.columns)
        return df

    model = punkt.fit(spark.createDataFrame([(1, "He left. She stayed. It rained.")], "id long, text string"), keep=keep)
    assert {"uc", "beg_lc", "k", "m", "breaks"} <= kept["punkt-case"] and model.case.columns == ["of", "uc", "mid_uc", "lc", "beg_lc"]


def test_alignment_of_a_word_that_comes_again_and_again():
    # ways that are not kept are not made: 64 a word, not 64 times the places of the word
    text = [w for k in range(200) for w in ("the", f"w{k % 20}")]
    begun = time.perf_counter()
    assert metrics.align(text, text) == (400, 1) and metrics.align(text, text[200:])[0] == 200
    assert time.perf_counter() - begun < 3


def test_words_are_typed_once_for_all_their_places(spark):
    said = ["Dr. Smith (paid) 3.5 pounds. Then Dr. Wu...", "", None, "wait... \"Mr.\" e.g. e.g. -- 7, U.S. us.", "Dr. dr. DR"] * 3
    table = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    counts = punkt.word_counts(table)
    each = punkt.tokens(table).groupBy("of", "period").count()
    assert sorted(map(repr, map(tuple, counts.collect()))) == sorted(map(repr, map(tuple, each.collect())))
    key = lambda df: sorted(map(tuple, df.select("of", "n", "periods", "score", "abbreviation").collect()))
    assert key(punkt.types(counts)) == key(punkt.types(punkt.tokens(table)))
    typed, read = counts._jdf.queryExecution().optimizedPlan().toString().split("Generate ")
    assert "Aggregate [w#" in typed and "regexp_replace" in typed and "regexp_replace" not in read  # types are made of grouped words
