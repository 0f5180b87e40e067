"""Hand-computed cases of text functions, scores and matchers."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relgraph.functions import scores, text
from relgraph.operators import cooccur, generation, graph, mentions, metrics, parse, samples, trie
from relgraph.sources import io


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given,want",
    [("a (b (c) d) e", "a e"), ("x [1 (2] 3)", "x [1"), ("{a{b{c{d}}}} z", "z"), ("un(balanced", "un(balanced"), ("", "")],
)
def test_strip_brackets(spark, given, want):
    assert one(spark, text.strip_brackets(F.lit(given))) == want


def nested(s):
    for left, right in ("{}", "()", "[]"):
        stack = [""]
        for c in s:
            if c == left:
                stack.append("")
            elif c == right and len(stack) > 1:
                stack.pop()
            else:
                stack[-1] += c
        s = left.join(stack)
    return " ".join(s.split())


def test_strip_brackets_of_any_depth(spark):
    rng = random.Random(4)
    given = ["(" * 40 + "deep" + ")" * 40 + " q", None, *["".join(rng.choices("(){}[]ab ", k=rng.randrange(0, 60))) for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", text.strip_brackets("t").alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: t if t is None else nested(t) for i, t in enumerate(given)}


def test_treebank_and_full_match(spark):
    assert one(spark, text.treebank(F.lit('He said, "I can\'t go (now)... it\'s 5%." They cannot.'))) == ["He", "said", ",", "``", "I", "ca", "n't", "go", "(", "now", ")", "...", "it", "'s", "5", "%", ".", "''", "They", "can", "not", "."]
    for given, pattern, want in (("ab", "a|ab", False), ("ab", "ab|a", True), ("", "a*", True), ("b", "a", False)):
        assert one(spark, text.full_match(F.lit(given), pattern)) is want


@pytest.mark.parametrize("given,want", [("Paris, Texas", "paris"), ("Mercury (planet)", "mercury"), ("(1) (2)", "( 1 ) ( 2 )")])
def test_entity_name(spark, given, want):
    assert one(spark, text.entity_name(F.lit(given))) == want


@pytest.mark.parametrize("given,want", [("A%20B+C", "A B+C"), ("bad%zz", "bad%zz"), ("%C3%A9", "é"), ("50%", "50%")])
def test_unquote(spark, given, want):
    assert one(spark, text.unquote(F.lit(given))) == want


@pytest.mark.parametrize("shown,want", [("apple", "big apple"), ("Apple", "Big Apple"), ("city", "city"), ("", ""), ("x apple", "x apple")])
def test_link_text(spark, shown, want):
    assert one(spark, text.link_text(F.lit(shown), F.lit("Big Apple"), F.lit("big apple"))) == want


@pytest.mark.parametrize("shown,want", [("2010", "Census 2010"), ("census 2010", "Census 2010"), ("CENSUS 2010", "Census 2010"), ("10", "Census 2010"), ("us 2010", "census 2010"), ("", ""), ("2011", "2011")])
def test_link_text_of_numbers(spark, shown, want):
    # small only if it has a letter of lower case and none of upper case
    want = want.lower() if any(c.islower() for c in shown) and shown == shown.lower() and want != shown else want
    assert one(spark, text.link_text(F.lit(shown), F.lit("Census 2010"), F.lit("census 2010"))) == want


@pytest.mark.parametrize("given,want", [("nsubj i_dobj", "dobj i_nsubj"), ("i_nsubj dobj conj", "i_nsubj dobj"), ("i_nsubj prep prep pobj", "i_nsubj prep pobj")])
def test_core_pattern(spark, given, want):
    assert one(spark, text.core_pattern(F.lit(given))) == want == parse.core_pattern(given.split())


@pytest.mark.parametrize("given,want", [("compound amod", "amod"), ("conj", ""), ("preconj", "pre")])
def test_sub_pattern(spark, given, want):
    assert one(spark, text.sub_pattern(F.lit(given))) == want == parse.sub_pattern(given)


def test_answers_and_normal_forms(spark):
    assert one(spark, text.normalize_answer(F.lit("The Cat's  hat!"))) == "cats hat"
    assert one(spark, metrics.exact_match(F.lit("the cat"), F.array(F.lit("dog"), F.lit("Cat!"))))
    assert one(spark, metrics.contains_answer(F.lit("It is New York."), F.lit("new york"))) and not one(spark, metrics.contains_answer(F.lit("x"), F.lit("")))
    assert one(spark, text.nfd(F.lit("é"))) == "é"
    assert one(spark, text.mark_spans(F.array(*map(F.lit, "a b c".split())), F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"))))) == "<E1> a b <E1> c"


def test_scores(spark):
    assert one(spark, scores.harmonic(F.lit(0.5), F.lit(1.0))) == pytest.approx(2 / 3)
    assert one(spark, scores.harmonic(F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, metrics.inversions(F.array(F.lit(2), F.lit(0), F.lit(1)))) == 2
    order = F.array(F.lit(2), F.lit(0), F.lit(1))
    assert one(spark, metrics.topk_overlap(order, 2)) == 0.5 and one(spark, metrics.cover_index(order, 2)) == 3


def test_npmi(spark):
    lists = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["a", "c"]), (4, ["b", "c", "d"])], "note int, ents array<string>")
    got = {r.a + r.b: r.npmi for r in cooccur.npmi(lists).collect()}
    assert got == pytest.approx({"ab": 1.26186, "ac": 0.547411, "bc": 0.386853, "bd": 0.613147, "cd": 0.773706}, abs=1e-5)
    assert cooccur.npmi(lists.where("note = 1")).first().npmi is None


def by_trie(tokens, phrases, greedy=False):
    out, i = set(), 0
    while i < len(tokens):
        sizes = [n for n in range(1, 9) if " ".join(tokens[i : i + n]) in phrases and i + n <= len(tokens)]
        out |= {" ".join(tokens[i : i + n]) for n in (sizes if greedy else sizes[-1:])}
        i += 1 if greedy or not sizes else sizes[-1]
    return out


def test_match_phrases(spark, monkeypatch):
    phrases = {"a b", "a b c", "b", "c d e", "d"}
    rng = random.Random(0)
    rows = [(i, rng.choices("abcdex", k=rng.randrange(0, 9))) for i in range(200)] + [(1000, "a b c d".split()), (1001, "a b x b".split()), (1002, "c d x".split())]
    tokens = spark.createDataFrame(rows, "id int, tokens array<string>")
    words = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    for mode in ("longest", "greedy"):
        for most in (trie.PART, 3):  # all in one part, and a part for about every phrase
            monkeypatch.setattr(trie, "PART", most)
            got = {}
            for r in mentions.match_phrases(tokens, words, mode).collect():
                got.setdefault(r.id, set()).add(r.phrase)
            assert all(got.get(i, set()) == by_trie(t, phrases, mode == "greedy") for i, t in rows)


def test_paths_and_ranks(spark):
    w = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.5), ("a", "d", 0.6), ("b", "d", 0.6), ("c", "d", 0.9)], "a string, b string, w double")
    found = graph.paths_up_to(graph.both_ways(w), w.where("a = 'a' and b = 'b'"), 3, least=2)
    ranked = samples.rank_paths(found, 4).orderBy("rank").collect()
    assert ["".join(r.nodes) for r in ranked] == ["acb", "adb", "acdb", "adcb"]
    assert [round(r.score, 6) for r in ranked] == [0.615385, 0.6, 0.744828, 0.627907]
    for enough in (1, 2, 3):  # pairs that have enough are not followed further, with equal results
        every = samples.rank_paths(graph.paths_up_to(graph.both_ways(w), w, 3, least=2), enough)
        short = samples.rank_paths(graph.best_paths(graph.both_ways(w), w, 3, enough), enough)
        assert sorted(map(repr, short.collect())) == sorted(map(repr, every.collect())) and short.count() >= 6
    assert samples.rank_paths(found, 5).count() == 0 and graph.triangles(w.select("a", "b")).count() == 4


TREE = ([1, 2, 2, 4, 2, 4, 5, 2], "compound nsubj ROOT det dobj prep pobj punct".split())
CORE, SUB = {"i_nsubj dobj prep pobj": 7, "i_nsubj dobj": 15}, {"det": 7, "amod": 31}


def test_dependency_features():
    got = parse.features_of(*TREE, (0, 1), (6, 6), CORE, SUB)
    assert got["dep_path"] == "i_nsubj dobj prep pobj" and got["dep_coverage"] == pytest.approx(0.942857, abs=1e-6)
    assert got["pattern_freq"] == pytest.approx(0.75) and got["score"] == pytest.approx(0.835443, abs=1e-6)
    back = parse.features_of(*TREE, (6, 6), (0, 1), CORE, SUB)
    assert back["dep_path"] == "i_pobj i_prep i_dobj nsubj" and back["pattern"] == got["pattern"]
    assert parse.features_of(*TREE, (6, 6), (4, 4), CORE, SUB) is None
    two = parse.features_of([1, 1, 1, 2, 2], "nsubj ROOT dobj cc conj".split(), (0, 0), (4, 4), CORE, SUB)
    assert two["pattern"] == "i_nsubj dobj" and two["dep_coverage"] == pytest.approx(0.646797, abs=1e-6) and two["score"] == pytest.approx(0.785521, abs=1e-6)


def trees(seed, n=120):
    """Random projective-free trees with random labels and spans."""
    rng, out = random.Random(seed), []
    for k in range(n):
        size = rng.randrange(4, 14)
        order = rng.sample(range(size), size)
        head = [0] * size
        for j, i in enumerate(order):
            head[i] = order[rng.randrange(j)] if j else i
        dep = [rng.choice("nsubj dobj prep pobj amod conj appos compound punct det".split()) for _ in range(size)]
        a, b = rng.randrange(size), rng.randrange(size)
        out.append((k % 100, head, dep, a, a, b, min(size - 1, b + rng.randrange(2)), rng.random()))
    return out


def test_features_and_patterns_equal_single_sentences(spark):
    rows = trees(5, 1500) + trees(5, 1)
    frame = spark.createDataFrame(rows, "id int, head array<int>, dep array<string>, s1 int, e1 int, s2 int, e2 int, sim double")
    seen = Counter()
    for _, head, dep, a, b, c, d, sim in rows:
        whole = len(head) >= 5 and parse.features_of(head, dep, (a, b), (c, d), {}, {})
        if whole and sim >= 0.4:
            seen["core", whole["pattern"]] += 1
            _, branch = parse.path_between(head, dep, (a, b), (c, d))
            seen.update({("sub", s, root): 1 for root, p, _ in parse.sub_paths(head, dep, branch) if "punct" not in p and (s := parse.sub_pattern(p))})
    want = Counter()
    for key, n in seen.items():
        want[key[:2]] += n
    got = {(r.kind, r.pattern): r["count"] for r in parse.patterns(frame, sim_threshold=0.4).groupBy("kind", "pattern").count().collect()}
    assert got == want and len(got) > 20
    core, sub = ({p: n for (k, p), n in got.items() if k == kind} for kind in ("core", "sub"))
    table = lambda c: spark.createDataFrame(list(c.items()), "pattern string, cnt long")
    found = sorted(((r.id, r.s1, r.e2, r.dep_path, round(r.dep_coverage, 9), round(r.pattern_freq, 9), round(r.score or 0, 9)) for r in parse.features(frame, table(core), table(sub)).collect()))
    plain = []
    for i, head, dep, a, b, c, d, _ in rows:
        f = parse.features_of(head, dep, (a, b), (c, d), core, sub) if 5 <= len(head) <= 50 else None
        if f:
            plain.append((i, a, d, f["dep_path"], round(f["dep_coverage"], 9), round(f["pattern_freq"], 9), round(f["score"] or 0, 9)))
    assert found == sorted(plain) and len(plain) > 50
    none = spark.createDataFrame([], "pattern string, cnt long")
    assert parse.features(frame, none, none).where("score is not null").count() == 0


def test_token_weights(spark):
    frame = spark.createDataFrame([(1, "New York kept the keys of town .".split(), *TREE, 0, 1, 6, 6)], "id int, tokens array<string>, head array<int>, dep array<string>, s1 int, e1 int, s2 int, e2 int")
    got = parse.token_weights(frame, spark.createDataFrame(list(SUB.items()), "pattern string, cnt long")).orderBy("place").collect()
    _, branch = parse.path_between(*TREE, (0, 1), (6, 6))
    assert [r.weight for r in got] == pytest.approx(parse.weigh(*TREE, branch, SUB)) and [r.token for r in got][:2] == ["New", "York"]


def test_noun_phrases(spark):
    chunks = [(0, 1, "NOUN"), (2, 3, "NOUN"), (4, 4, "NOUN"), (6, 7, "PRON"), (8, 9, "NOUN"), (11, 12, "PROPN")]
    frame = spark.createDataFrame([(chunks,), ([],)], "c array<struct<start:int,end:int,tag:string>>")
    assert [[tuple(x) for x in r.m] for r in frame.select(parse.merge_chunks("c").alias("m")).collect()] == [parse.noun_phrases(chunks), []]


def test_spans_and_hits(spark):
    c = lambda *x: F.array(*map(F.lit, x))
    assert [tuple(s) for s in one(spark, mentions.spans(c(*"a a a b".split()), c("a", "a")))] == [(0, 1), (1, 2)]
    assert one(spark, mentions.spans(c("a"), c("a", "b"))) == [] and one(spark, mentions.phrase_words(F.lit("Well-known  Man"))) == ["well", "-", "known", "man"]
    assert one(spark, metrics.hit_vector(F.array(F.lit("in New York."), F.lit(None), F.lit("york new")), c("new york", "x"))) == [True, False, False]
    rows = spark.createDataFrame([(["a", "b"], ["NNS", "VB"])], "w array<string>, t array<string>")
    assert rows.select(mentions.lemmatise("w", "t", F.create_map(F.lit("a"), F.lit("A"), F.lit("b"), F.lit("B"))).alias("x")).first().x == ["A", "b"]


def test_generation_hook(spark):
    rows = spark.createDataFrame([(f"q{k}", ["c1", "c2"], "t") for k in range(20)], "question string, contexts array<string>, target string")
    load = lambda: lambda qs, cs: [f"{q}:{len(c)}:{len(qs) <= 8}" for q, c in zip(qs, cs, strict=True)]
    assert {r.output for r in generation.generate(rows, load).collect()} == {f"q{k}:2:True" for k in range(20)}


def test_prompt_and_split(spark):
    c = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, samples.prompt(F.lit("A"), F.lit("B"), c("A", "C", "B"), c("s1", "s2"))) == "entity1: a entity2: b path: A; C; B sentence1: s1 sentence2: s2"
    assert one(spark, samples.prompt(F.lit("A"), F.lit("B"), c("A"), c("s"), True, True)) == "entity1: a entity2: b  "
    assert one(spark, samples.pad_contexts(c("c1", "c2"), 5)) == ["c1", "c2", "c1", "c2", "c1"]
    for n, want in ((100, [96, 2, 2]), (10, [9, 0, 1])):
        got = {r.part: r["count"] for r in samples.split(spark.range(n), F.md5(F.col("id").cast("string"))).groupBy("part").count().collect()}
        assert [got.get(k, 0) for k in ("train", "dev", "test")] == want


def test_dump_rules(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "w").write_text('<doc id="1" url="u" title="The "Foo"  band">\nThe "Foo" band\n\nBar\n The "Foo" band\t\r\nThe "Foo"  band\nx">y\n</doc>\n<doc id="2" url="u" title="Bar">\nBar\nOne\n\nBar\nBar two\rBar\n</doc>\n')
    got = [(r.doc, r.title, r.line) for r in io.read_dump(spark, str(tmp_path / "d")).orderBy("doc", "para").collect()]
    # a title goes up to the end of its tag; every line that equals it is left out, white space at its ends aside
    assert got == [("1", 'The "Foo" band', "Bar"), ("1", 'The "Foo" band', 'The "Foo"  band'), ("1", 'The "Foo" band', 'x">y'), ("2", "Bar", "One"), ("2", "Bar", "Bar two")]
    lines = spark.createDataFrame([('<doc id="7" url="u" title="A "b" c">',), ('<doc id="8" url="é" title="A">',), ('<doc id="9" url="u" title="é">',), ("text",), ('x <doc id="1" url="u" title="A">',)], "value string")
    assert [tuple(r) for r in io.read_ids(lines).collect()] == [("7", 'A "b" c')]


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text('<doc id="1" url="u" title="T">\nT\n\nline one\nline two\n</doc>\n<doc id="2" url="u" title="é">\nother\n</doc>\n')
    got = [(r.title, r.line) for r in io.read_dump(spark, str(tmp_path / "a")).orderBy("doc", "para").collect()]
    assert got == [("T", "line one"), ("T", "line two"), ("é", "other")]
    (tmp_path / "p.tsv").write_text("id\ttext\ttitle\n1\tx\ty\n2\tz\n")
    assert [tuple(r) for r in io.read_passages(spark, str(tmp_path / "p.tsv")).collect()] == [("1", "x", "y")]
    (tmp_path / "v").write_text("2 3\nNew_York 1 0 2\nx 0 1 0\n")
    assert {r.ent: r.vec for r in io.read_vectors(spark, str(tmp_path / "v")).collect()} == {"New York": [1, 0, 2], "x": [0, 1, 0]}
    (tmp_path / "n").mkdir()
    for name, said, _ in (files := [("1", "a\nb\n", 3), ("2", "a\nb", 2), ("4", "\n", 2), ("5", "é\r\nb", 2)]):
        (tmp_path / "n" / name).write_bytes(said.encode())
    assert {r.file.rsplit("/", 1)[1]: r.lines for r in io.count_lines(spark, str(tmp_path / "n")).collect()} == {k: n for k, _, n in files}
    (tmp_path / "m").mkdir()
    for name in "ba":
        (tmp_path / "m" / f"{name}.txt").write_text(f"{name}1\n{name}2\n")
    io.merge_lines(spark, str(tmp_path / "m"), str(tmp_path / "merged"))
    assert next((tmp_path / "merged").glob("part*")).read_text() == "a1\na2\nb1\nb2\n" and not (tmp_path / "m").exists()
    with pytest.raises(ValueError):
        io.split_outputs(spark.createDataFrame([("q", "o", None)], "question string, output string, target string"))
    (tmp_path / "c").write_text("a\tb\n\nc\n")
    assert [r.ents for r in io.read_cooccurrence(spark, str(tmp_path / "c")).collect()] == [["a", "b"], [], ["c"]]
