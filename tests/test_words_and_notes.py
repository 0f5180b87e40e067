"""Long notes, graphs in long form, lemmas, spans, table functions and the commands that use them."""

import itertools
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relgraph import __main__ as cli
from relgraph.functions import lines, text
from relgraph.operators import cooccur, dataset, graph, mentions
from relgraph.plans import queries
from relgraph.sources import io, scratch


@pytest.mark.parametrize("block", [3, 512])
def test_pairs_of_long_notes(spark, block):
    rng = random.Random(2)
    notes = {k: rng.sample(range(400), n) for k, n in enumerate([0, 1, 2, 5, 17, 60, 60, 3])}
    rows = [(k, f"e{e}", at) for k, ents in notes.items() for at, e in enumerate(ents)]
    frame = spark.createDataFrame(rows, "note long, ent string, at int").repartition(3)
    got = Counter(map(tuple, cooccur.long_pairs(frame, block).collect()))
    assert got == Counter((k, f"e{a}", f"e{b}") for k, ents in notes.items() for a, b in itertools.combinations(ents, 2))
    ordered = frame.withColumn("at", F.col("ent"))
    lists = cooccur.baskets(frame, "ent", "note")
    for one, two in zip(cooccur.long_counts(ordered, block), cooccur.counts(lists), strict=True):
        assert sorted(map(tuple, one.select(two.columns).collect())) == sorted(map(tuple, two.collect()))
    assert cooccur.long_pairs(frame.limit(0), block).collect() == []


def test_no_row_holds_a_long_note(spark):
    frame = spark.range(2500).select(F.lit(1).alias("note"), F.col("id").alias("ent"), F.col("id").alias("at"))
    assert cooccur.long_pairs(frame, 100).count() == 2500 * 2499 // 2
    sizes = frame.groupBy("note").agg(F.ceil(F.count("*") / 100).alias("b")).first().b
    assert sizes == 25  # so a row holds about 200 of the 2500


def test_graphs_in_long_form_equal_grouped_ones(spark):
    rng = random.Random(5)
    rows = [(a, b, round(rng.random(), 2), rng.choice(["i_nsubj dobj", "nsubj i_dobj"]), f"n{k}", round(rng.random(), 3), 0.5, 0.6, (0, 1), (2, 3)) for k, (a, b) in enumerate(rng.choices(list(itertools.permutations("abcd", 2)), k=200))]
    frame = spark.createDataFrame(rows, "kw1 string, kw2 string, sim double, dep_path string, note string, score double, significant double, explicit double, kw1_span struct<start:int,end:int>, kw2_span struct<start:int,end:int>")
    long = graph.ranked_sentences(graph.oriented(frame, 0.3), 0.5)
    whole = graph.sentence_graph(graph.digraph(frame, 0.3), 0.5).select("src", "dst", F.posexplode("data").alias("k", "item"))
    key = lambda df: sorted((r.src, r.dst, r.rank, r.item.note, r.item.score, tuple(r.item.span_head)) for r in df.collect())
    assert key(long) == key(whole.withColumn("rank", F.col("k") + 1))
    both = graph.ranked_sentences(graph.oriented(frame, 0.3), 0.5, directed=False, most=2)
    assert {(r.src, r.dst) for r in both.collect()} == {tuple(sorted((a, b))) for a, b, sim, _, _, score, *_ in rows if sim >= 0.3 and score >= 0.5}


def plain_lemma(word, vocabulary, exceptions):
    forms = exceptions.get(word) or [word[: len(word) - len(e)] + new for e, new in mentions.NOUN_ENDINGS if word.endswith(e)]
    now = [word, *forms]
    while now:
        good = [f for f in now if f in vocabulary]
        if good:
            return min(good, key=len)
        forms = [f[: len(f) - len(e)] + new for f in forms for e, new in mentions.NOUN_ENDINGS if f.endswith(e)]
        now = [f for f in forms if f]
    return word


def test_noun_lemmas(spark):
    vocabulary = {"church", "wolf", "box", "city", "man", "dog", "lens", "bus", "quiz", "wish", "mouse", "as", "a", "buse", "glasse", "s"}
    words = ["churches", "wolves", "boxes", "cities", "women", "men", "dogs", "lenses", "lens", "buses", "quizzes", "wishes", "mice", "as", "sss", "dogss", "xyz", "", "s", "glasses", None]
    exceptions = {"mice": ["mouse"], "geese": ["goose"]}
    one = lambda rows, c: spark.createDataFrame([(r,) for r in rows], f"{c} string")
    odd = spark.createDataFrame([(w, x) for w, xs in exceptions.items() for x in xs], "word string, lemma string")
    got = {r.word: r.lemma for r in mentions.noun_lemmas(one(words, "word"), one(vocabulary, "word"), odd).collect()}
    assert got == {w: plain_lemma(w, vocabulary, exceptions) for w in words if w is not None}
    assert got["mice"] == "mouse" and got["wolves"] == "wolf" and got["dogss"] == "dog" and got["xyz"] == "xyz"
    rows = spark.createDataFrame([(1, ["two", "wolves", None]), (2, []), (3, None)], "id int, tokens array<string>")
    table = spark.createDataFrame([("wolves", "wolf")], "word string, lemma string")
    assert {r.id: r.tokens for r in mentions.lemmatised(rows, table).collect()} == {1: ["two", "wolf", None], 2: [], 3: None}


def test_spans_in_the_tokens_that_fit(spark):
    word = "array<struct<text:string,lemma:string,pos:string>>"
    rows = [
        (1, "The cats sat.", [("The", "the", "DET"), ("cats", "cat", "NOUN"), ("sat", "sit", "VERB"), (".", ".", "PUNCT")], "cat", [("cat", "cat", "NOUN")], ["The", "cat", "sat", "."]),
        (2, 'A well - known "cat".', [("A", "a", "DET"), ("well", "well", "ADV"), ("-", "-", "PUNCT"), ("known", "know", "VERB"), ('"', '"', "P"), ("cat", "cat", "NOUN"), ('"', '"', "P"), (".", ".", "P")], "Well-Known", [("Well-Known", "x", "X")], ["A", "well", "-", "known", "``", "cat", "''", "."]),
        (3, "well-known cats", [("well", "well", "ADV"), ("-", "-", "PUNCT"), ("known", "know", "VERB"), ("cats", "cat", "NOUN")], "known cats", [("known", "know", "VERB"), ("cats", "cat", "NOUN")], ["well-known", "cat"]),
    ]
    frame = spark.createDataFrame(rows, f"id int, text string, tokens {word}, phrase string, ptokens {word}, plain array<string>")
    c = F.col
    got = {r.id: [tuple(x) for x in r.s] for r in frame.select("id", mentions.find_spans(c("text"), c("tokens"), c("phrase"), c("ptokens"), c("plain")).alias("s")).collect()}
    # the first two are read by the Treebank, hyphens of the phrase apart; the parser parts what the Treebank does not in the third
    assert got == {1: [(1, 1)], 2: [(1, 3)], 3: [(2, 3)]}
    raw = {r.id: r.s for r in frame.select("id", mentions.find_spans(c("text"), c("tokens"), c("phrase"), c("ptokens"), c("plain"), lower=False).alias("s")).collect()}
    assert raw[2] == [] and len(raw[3]) == 1


def test_table_functions(spark):
    spark.createDataFrame([(f, k, f"{f}{k % 3}") for f in "ab" for k in range(20)] + [("c", 0, None)], "file string, k int, line string").createOrReplaceTempView("some_lines")

    def step(state, row):
        state.append(row["line"])
        yield row["file"], row["k"], len(set(state))

    spark.udtf.register("distinct_so_far", lines.line_function(list, step, "file string, k int, n int"))
    got = sorted(map(tuple, spark.sql("SELECT * FROM distinct_so_far(TABLE(some_lines) PARTITION BY file ORDER BY k)").collect()))
    assert got == sorted([(f, k, min(3, k + 1)) for f in "ab" for k in range(20)] + [("c", 0, 1)])
    pairs = "array<struct<sim:double,kw1:string,kw2:string>>"
    spark.createDataFrame([("x y", [(0.5, "x", "y"), (0.1, "y", "x")]), ("z", []), ("n", None)], f"sent string, pairs {pairs}").createOrReplaceTempView("some_sents")
    spark.udtf.register("as_rows", lines.process_pairs(lambda sent, ps: ((sent, p["kw1"], p["sim"]) for p in ps), "sent string, kw string, sim double"))
    assert sorted(map(tuple, spark.sql("SELECT * FROM as_rows(TABLE(some_sents))").collect())) == [("x y", "x", 0.5), ("x y", "y", 0.1)]


def test_commands_with_tokens_lemmas_and_learnt_ends(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    page = lambda i, title, body: f'<doc id="{i}" url="u" title="{title}">\n{title}\n\n{body}\n</doc>\n'
    w = "river stone house road field hill".split()
    said = " ".join(f'Dr. Lee met <a href="Wolf">wolf</a> number {k} by {w[k % 6]} {w[(k + 1) % 6]}. It ran to {w[(k + 2) % 6]} and {w[(k + 3) % 6]}.' for k in range(60))
    (tmp_path / "d" / "w").write_text(page(1, "Wolf", "The wolves can't wait by river. " + said) + page(2, "Lee", "Dr. Lee saw wolves."))
    spark.createDataFrame([("Wolf", [1.0, 0.0]), ("Lee", [0.0, 1.0])], "ent string, vec array<float>").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([("wolves", "wolf")], "word string, lemma string").write.parquet(str(tmp_path / "l"))
    cli.main(["preprocess", str(tmp_path / "d"), str(tmp_path / "v"), str(tmp_path / "o"), "--dim", "2", "--tokens", "treebank", "--lemmas", str(tmp_path / "l"), "--learn"], spark)
    sents = [r.text for r in spark.read.parquet(str(tmp_path / "o" / "sentences")).where("title = 'Wolf'").orderBy("para", "sent").collect()]
    assert sents[:3] == ["The wolves can't wait by river.", "Dr. Lee met wolf number 0 by river stone.", "It ran to house and road."]
    raw = spark.read.parquet(str(tmp_path / "o" / "raw"))
    assert raw.where("name = 'wolf' and sent = 0").first().start == 1  # wolves by their lemma
    (tmp_path / "t.tsv").write_text("q\tthe cat\tthe cat\nq\ta dog\tdogs\n")
    cli.main(["score_outputs", str(tmp_path / "t.tsv")], spark)
    out = dict(line.rsplit(" ", 1) for line in capsys.readouterr().out.strip().splitlines())
    assert float(out["EM"]) == 0.5 and float(out["ROUGE-1"]) == 0.5 and 0.5 < float(out["METEOR"]) < 1
    tree = [(1, [1, 1, 1, 1, 1], "nsubj ROOT dobj advmod advmod".split(), 0, 0, 2, 2)]
    spark.createDataFrame(tree, "id int, head array<int>, dep array<string>, s1 int, e1 int, s2 int, e2 int").write.parquet(str(tmp_path / "trees"))
    spark.createDataFrame([("i_nsubj dobj", 3)], "pattern string, cnt long").write.parquet(str(tmp_path / "core"))
    spark.createDataFrame([("advmod", 3)], "pattern string, cnt long").write.parquet(str(tmp_path / "sub"))
    cli.main(["score_sent", str(tmp_path / "trees"), str(tmp_path / "core"), str(tmp_path / "sub")], spark)
    assert float(capsys.readouterr().out) == pytest.approx(1.0)


def test_first_samples_and_yield(spark):
    item = "array<struct<score:double,note:string,significant:double,explicit:double,span_head:struct<start:int,end:int>,span_tail:struct<start:int,end:int>>>"
    edges = [(a, b, 0.9, [(0.9, f"{a}{b}", 0.9, 0.9, (0, 0), (1, 1))]) for a, b in itertools.combinations("abcdef", 2)]
    frame = spark.createDataFrame(edges, f"src string, dst string, sim double, data {item}")
    found = dataset.collect_samples(frame, frame, path_num=3, sample_num=4)
    assert [(r.a, r.b) for r in found.orderBy("a", "b").collect()] == [("a", "b"), ("a", "c"), ("a", "d"), ("a", "e")]
    assert tuple(dataset.sample_yield(found, frame).first()) == (4, 15, pytest.approx(4 / 15))
    assert tuple(dataset.sample_yield(found.limit(0), frame.limit(0)).first()) == (0, 0, None)


def test_sentences_of_a_pair_and_release(spark, tmp_path):
    occurrences = spark.createDataFrame([("x", "n1"), ("y", "n1"), ("x", "n2"), ("y", "n3"), ("x", "n1")], "ent string, note string")
    sents = spark.createDataFrame([("n1", "both"), ("n2", "one")], "note string, text string")
    assert [r.text for r in io.sentences_of_pair(occurrences, sents, "x", "y").collect()] == ["both"]
    kept = scratch.materialise(sents, "kept")
    scratch.discard(kept)
    with pytest.raises(Exception, match="(?i)exist|found"):
        kept.count()


def test_words_are_made_once_a_text_not_once_a_place(spark):
    rows = spark.range(1).select(F.repeat(F.lit("So Well "), 10_000).alias("text"))
    word = lambda x: F.struct(x.alias("text"), x.alias("lemma"), F.lit("VERB").alias("pos"))
    found = mentions.find_spans(F.col("text"), F.transform(text.tokenize("text"), word), F.lit("Well"), F.array(word(F.lit("Well"))), text.treebank("text"))
    begun = time.perf_counter()
    assert rows.select(F.size(found).alias("n")).first().n == 10_000
    assert time.perf_counter() - begun < 20


def test_large_tables_get_tasks_by_size(spark, tmp_path, monkeypatch):
    spark.range(40_000).select((F.col("id") % 9000).alias("n"), F.hash("id").alias("e")).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    whole = cooccur.baskets(rows, "e", "n")
    monkeypatch.setattr(cooccur, "NOTE_BYTES", 16 << 10)
    parts = cooccur.baskets(rows, "e", "n")
    assert parts.rdd.getNumPartitions() == scratch.size_of(rows) // (16 << 10) > 4
    assert parts.exceptAll(whole).isEmpty() and parts.count() == 9000


@pytest.mark.parametrize("kind", ["long", "string"])
def test_vectors_are_not_shuffled_with_pairs(spark, monkeypatch, kind):
    rng = random.Random(4)
    vecs = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(60)] + [(7, [1.0] * 6), (60, [0.0] * 6), (61, None), (62, [1.0] * 4), (63, [1.0, None] * 3), (None, [1.0] * 6)]
    pairs = [(rng.randrange(70), rng.randrange(70), k) for k in range(900)] + [(None, 3, 900), (62, 62, 901)]
    vectors = spark.createDataFrame(vecs, "ent long, vec array<float>").withColumn("ent", F.col("ent").cast(kind)).repartition(3)
    frame = spark.createDataFrame(pairs, "a long, b long, c int").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "c").repartition(5)
    key = lambda df: sorted(map(repr, df.select("a", "b", "c", "sim").collect()))
    small = key(mentions.attach_vectors(frame, vectors, 6))
    monkeypatch.setattr(mentions, "VECTOR_BYTES", 0)
    for block in (20, 1 << 16):
        monkeypatch.setattr(mentions, "VECTOR_BLOCK", block)
        large = mentions.attach_vectors(frame, vectors, 6)
        assert "Join" not in large._jdf.queryExecution().executedPlan().toString()
        assert key(large) == small
    assert mentions.attach_vectors(frame, vectors.limit(0), 6).where("sim <> 0").count() == 0


def test_notes_of_texts_make_pairs_twice_at_most(spark, tmp_path):
    rng = random.Random(6)
    notes = {k: sorted(rng.sample(range(12), rng.randrange(6))) for k in range(300)}
    frame = spark.createDataFrame([(k, f"t{k % 40}" if k % 7 else None, e) for k, e in notes.items()], "note long, text string, ents array<int>")
    wanted = spark.createDataFrame([(a, b, f"t{rng.randrange(41)}") for a, b in itertools.combinations(range(12), 2)] * 2, "a int, b int, text string")
    want = {}
    for a, b, t in map(tuple, wanted.collect()):
        found = [k for k, e in notes.items() if k % 7 and f"t{k % 40}" == t and a in e and b in e]
        if found:
            want[a, b, t] = min(found)
    got = cooccur.notes_saying(wanted, frame)
    assert {tuple(r[:3]): r.note for r in got.collect()} == want and got.count() == len(want)
    old = cooccur.notes_of_texts(wanted, cooccur.pairs(frame.select("note", "ents")), frame.select("note", "text"))
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, got.collect()))
    spark.createDataFrame([(n, s) for n in range(40) for s in rng.sample(range(9), 4)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    made = queries.notes_of_texts(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("posexplode")
    assert made <= 2  # for the wanted texts and for what notes say


def test_phrases_of_large_and_small_scopes(spark, monkeypatch):
    rng = random.Random(8)
    draw = lambda n: [rng.choice("abcd") for _ in range(n)]
    texts = [(k, k % 5, draw(rng.randrange(12))) for k in range(80)] + [(80, None, ["a"]), (81, 1, None), (82, 1, ["a", None, "b"]), (83, 1, ["", "a"])]
    said = [(s, " ".join(draw(rng.randrange(1, 4)))) for s in range(4) for _ in range(3 + 4 * s)] + [(0, ""), (None, "a")]
    tokens = spark.createDataFrame(texts, "id int, page int, tokens array<string>").repartition(3)
    names = spark.createDataFrame(said * 2, "page int, phrase string")
    want = sorted((i, k, len(p.split(" ")), p) for i, s, w in texts if w and None not in w for t, p in set(said) if p and t is not None and t == s for k in range(len(w)) if w[k : k + len(p.split(" "))] == p.split(" "))
    for most in (1024, 4, 0):  # all scopes small, some, none
        monkeypatch.setattr(mentions, "SCOPE_PHRASES", most)
        got = mentions.match_phrases(tokens, names, "greedy", scope=("page",))
        assert sorted(map(tuple, got.where("id <> 82").collect())) == want
    plan = lambda: mentions.match_phrases(tokens, names, "greedy", scope=("page",))._jdf.queryExecution().optimizedPlan().toString()
    joined = plan()
    monkeypatch.setattr(mentions, "SCOPE_PHRASES", 1024)
    assert "phrase#" in joined and plan().count("Join Inner") < joined.count("Join Inner")  # no n-gram meets the phrases in a join
