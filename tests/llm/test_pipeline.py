"""The pipeline against a plain version of its stages, and on odd input."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from relgraph.llm import pieces, pii, quality, textbytes
from relgraph.llm.runtime import crc_mod, prepare
from tests.llm.test_operators import WORD, low, prose, shingle_sets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "seven wise owls read an old map by the pale light of one small lamp"


def corpus():
    rng = random.Random(11)
    good = [prose(rng, rng.randrange(40, 90)).capitalize() + "." for _ in range(60)]
    for k in range(8, 20):
        good[k] += f" Write to u{k}@home.org or 10.0.0.{k} now."
    for k in range(20, 26):
        good[k] += f" {PASSAGE.capitalize()}."
    bad = [" | ".join(w.upper() + "!!" for w in prose(rng, rng.randrange(30, 60)).split()) for _ in range(30)]
    texts = good + bad
    texts += [texts[0], texts[1] + " end", texts[2].replace(texts[2].split()[20], "other"), PASSAGE, None, ""]
    return texts, [(i, int(i < 60), 0) for i in range(90)]


def write(spark, path, texts, labels, items):
    rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def plain(texts, model):
    data, off = textbytes.strings(pa.array(texts, pa.string()))
    kept = {i: texts[i] for i in np.flatnonzero(quality.predict(data, off, model) >= 0.5).tolist()}
    sets = shingle_sets([kept.get(i) for i in range(len(texts))])
    root = {i: i for i in kept}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in kept:
        for j in kept:
            if i < j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = {i: t for i, t in kept.items() if find(i) == i}
    said = WORD.findall(low(PASSAGE))
    grams = {tuple(said[k : k + 10]) for k in range(len(said) - 9)}
    out = {}
    for i, t in kept.items():
        spots = list(WORD.finditer(low(t)))
        hit = [False] * len(spots)
        for k in range(len(spots) - 9):
            if tuple(m[0] for m in spots[k : k + 10]) in grams:
                hit[k : k + 10] = [True] * 10
        if sum(hit) > 0.8 * len(hit):
            continue
        t = t or ""
        for run in reversed(list(re.finditer("1+", "".join("01"[h] for h in hit)))):
            t = t[: spots[run.start()].start()] + t[spots[run.end() - 1].end() :]
        for a, b, k in reversed(pii.base(t)):
            t = f"{t[:a]}[{pii.KINDS[k].upper()}]{t[b:]}"
        out[i] = t
    return out


def test_pipeline_equals_plain_stages(spark, tmp_path):
    prepare(spark)
    texts, labels = corpus()
    write(spark, tmp_path, texts, labels, [(1, PASSAGE), (2, None)])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), train=lambda c: crc_mod(c, 3) != 1)
    want = plain(texts, model)
    got = {r.doc_id: r.decoded for r in pieces.decode(corpus_pipeline.run(spark, str(tmp_path))).collect()}
    assert got == want
    assert not {90, 91, 92, 93} & set(got) and not any("owls" in t.lower() or "@" in t for t in got.values())
    assert sum("[EMAIL]" in t and "[IP]" in t for t in got.values()) >= 10
    assert sum(i < 60 for i in got) >= 56 and not any(60 <= i < 90 for i in got)


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    prepare(spark)
    texts, labels = corpus()
    write(spark, tmp_path, texts, labels, [(1, PASSAGE)])
    rows = [(None, None, None, None, None), (1, texts[0], None, "s", 5), (1, texts[0], None, "s", 5), (2, "", "en", None, 0), (None, texts[3], None, None, 1)]
    odd = spark.createDataFrame(rows, DOCS)
    model = quality.fit(odd, spark.read.parquet(f"{tmp_path}/labels.parquet"), train=lambda c: crc_mod(c, 3) != 1)
    odd_kept = sum(r.score >= 0.5 for r in quality.score(odd, model).collect())
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n == (0 if docs.isEmpty() else {"near-duplicates": 4, "quality": odd_kept}.get(name, 5))
            assert out.columns == (docs.columns if name != "sentencepiece" else ["doc_id", "pieces"])
    assert corpus_pipeline.one_of_each_group(spark, odd, str(tmp_path)).where("doc_id = 1").count() == 1


def test_near_duplicates_of_null_and_shared_ids(spark, tmp_path):
    prepare(spark)
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(None, a), (None, b), (None, a + " end"), (7, c), (7, d), (3, d), (3, d), (None, c), (4, b + " end"), (None, None), (None, ""), (5, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], DOCS)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path)).collect()]
    first = [t for i, t in got if i is None and t in (a, a + " end")]
    assert len(first) == 1  # both ids are null: the text's hash decides
    want = [(None, first[0]), (4, b + " end"), (7, c), (3, d), (None, None), (None, ""), (5, ""), (5, None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_of_equal_rows_the_first_by_its_other_columns_stays(spark, tmp_path):
    prepare(spark)
    text = prose(random.Random(5), 60)
    rows = [(7, text, "fr", "b", 3), (7, text, "de", "z", 9), (7, text, "de", "a", 4), (7, text, None, "a", 1), (8, "other", "en", "a", 1)]
    for k in range(3):
        docs = spark.createDataFrame(rows[k:] + rows[:k], DOCS).repartition(3)
        got = corpus_pipeline.one_of_each_group(spark, docs, str(tmp_path))
        assert got.columns == docs.columns
        assert sorted(map(tuple, got.collect())) == [(7, text, "de", "a", 4), (8, "other", "en", "a", 1)]


@pytest.mark.parametrize("name", ["documents", "benchmark", "labels"])
def test_pipeline_with_an_empty_table(spark, tmp_path, name):
    prepare(spark)
    texts, labels = corpus()
    write(spark, tmp_path, [] if name == "documents" else texts[:8], [] if name == "labels" else labels, [] if name == "benchmark" else [(1, PASSAGE)])
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # without labels every score is 0.5, which is enough; without items nothing is taken out
    texts = [] if name == "documents" else texts[:8]
    assert got == set(range(len(texts)))
