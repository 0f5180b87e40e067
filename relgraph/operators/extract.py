"""From annotated paragraphs to sentences, entities, pairs and feature rows.

A note is (page, para, sent), written page:para:sent. Parse trees and vectors are inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relgraph.functions import text
from relgraph.operators import cooccur, mentions, parse, punkt
from relgraph.sources import scratch


def links(paras: DataFrame) -> DataFrame:
    """(page, para, seq, entity, name): the links of paragraphs (page, para, title, line), name in lower case (SC2, SC6)."""
    rows = paras.select("page", "para", F.posexplode(text.links("line")).alias("seq", "l"))
    return rows.select("page", "para", "seq", F.col("l.href").alias("entity"), F.lower(text.entity_name("l.href", lower=False)).alias("name")).where("name <> ''")


def titles(paras: DataFrame) -> DataFrame:
    """(page, title, name): the name that each page's title gives, if any (SC2)."""
    return paras.select("page", "title").distinct().withColumn("name", text.entity_name("title")).where("name <> ''")


def words(sents: DataFrame, kind: str = "plain", lemmas: DataFrame | None = None):
    """sents and a column of it, the words of a sentence in lower case: plain tokens or the Treebank's, words of lemmas (word, lemma) in their dictionary form (TX6)."""
    tokens = F.transform(text.treebank("text"), lambda t: F.lower(t)) if kind == "treebank" else text.tokenize("text", lower=True)
    if lemmas is None:
        return sents, tokens
    rows = mentions.lemmatised(sents.select(F.struct("page", "para", "sent").alias("id"), "title", "text", tokens.alias("tokens")), lemmas)
    return rows.select("id.*", "title", "text", "tokens"), F.col("tokens")


def _unlinked(paras: DataFrame) -> DataFrame:
    """(page, para, title, line): links replaced by names (SC7)."""
    name = lambda l: text.entity_name(l["href"], lower=False)  # noqa: E731, E741
    found = F.transform(text.links("line"), lambda l: F.struct(l["raw"].alias("raw"), text.let(name(l), lambda n: text.link_text(l["shown"], n, F.lower(n))).alias("text")))  # noqa: E741
    return paras.select("page", "para", "title", text.resolve_links("line", found).alias("line"))


def learnt_sentences(paras: DataFrame, known: list[str] | None = None) -> DataFrame:
    """As ``sentences``, their ends learnt from all paragraphs (SC8)."""
    rows = scratch.materialise(_unlinked(paras).select(F.struct("page", "para", "title").alias("id"), F.col("line").alias("text")), "unlinked")
    found = punkt.sentences(rows, punkt.fit(rows, known, scratch.materialise), scratch.materialise)
    return found.select("id.page", "id.para", "sent", "id.title", text.strip_brackets("text").alias("text"))


def sentences(paras: DataFrame) -> DataFrame:
    """(page, para, sent, title, text): sentences of paragraphs, links replaced by names, brackets dropped (SC1, SC7, SC8)."""
    rows = _unlinked(paras).select("page", "para", "title", F.posexplode(text.sentences("line")).alias("sent", "text"))
    return rows.select("page", "para", "sent", "title", text.strip_brackets("text").alias("text"))


def found_entities(paras: DataFrame, sents: DataFrame, tokens=None) -> DataFrame:
    """(page, para, sent, start, name, entity): names in sentences, from the left, the longest first (TX1, TX5, TX6).

    A page knows its title's name, and a link's name from its paragraph on; an entity is the one that the latest
    link up to the paragraph gave the name, or the title, which is said again at the start of each paragraph.
    tokens: the words of a sentence as a column, by default lower-cased tokens.
    """
    own = titles(paras)
    said = scratch.materialise(links(paras), "links")  # read four times
    known = own.select("page", F.col("name").alias("phrase"), F.lit(-1).alias("para")).unionByName(said.select("page", F.col("name").alias("phrase"), "para"))
    known = scratch.materialise(known.groupBy("page", "phrase").agg(F.min("para").alias("since")), "names")
    words = sents.select(F.struct("page", "para", "sent").alias("id"), "page", (text.tokenize("text", lower=True) if tokens is None else tokens).alias("tokens"))
    got = mentions.match_phrases(words, known, "greedy", scope=("page",)).withColumn("page", F.col("id.page"))
    got = mentions.longest_from_left(got.join(known, ["page", "phrase"]).where(F.col("since") <= F.col("id.para")).select("id", "start", "size", "phrase"))
    got = got.select("id.page", "id.para", "id.sent", "start", F.col("phrase").alias("name"))
    return mentions.latest(got, said, own).select("page", "para", "sent", "start", "name", "entity")


def resolve(found: DataFrame, sents: DataFrame, vectors: DataFrame) -> DataFrame:
    """found with entities that are titles: equal, the only one equal but for case, or of these the nearest to the page (JN2-JN4).

    vectors: (ent, vec). Entities that are no title in any case are dropped, as are those that no vector decides.
    """
    titles = sents.select("title").distinct()
    folded = titles.groupBy(F.lower("title").alias("key")).agg(F.count("*").alias("n"), F.min("title").alias("sole"))
    rows = found.withColumn("key", F.lower("entity")).join(titles.select(F.col("title").alias("entity"), F.lit(True).alias("exact")), "entity", "left").join(folded, "key")
    sure = rows.where("exact or n = 1").withColumn("entity", F.when(F.col("exact"), F.col("entity")).otherwise(F.col("sole")))
    place = ["page", "para", "sent", "start", "name"]
    of_page = sents.select("page", F.col("title").alias("ent")).distinct().join(vectors, "ent").select("page", F.col("vec").alias("page_vec"))
    open_ = rows.where("exact is null and n > 1").select(F.struct(*place).alias("id"), "page", "key").join(of_page, "page")
    options = titles.select(F.lower("title").alias("key"), F.col("title").alias("ent")).join(vectors, "ent").select("key", F.col("ent").alias("entity"), "vec")
    near = mentions.resolve_by_vector(open_.select("id", "key", "page_vec"), options).select("id.*", "entity")
    return sure.select(*place, "entity").unionByName(near.select(*place, "entity"))


def lists(found: DataFrame) -> DataFrame:
    """(note, ents): the entities of each sentence in order of first occurrence, each once."""
    rows = found.groupBy("page", "para", "sent").agg(F.sort_array(F.collect_list(F.struct("start", "entity"))).alias("s"))
    return rows.select(F.concat_ws(":", "page", "para", "sent").alias("note"), F.array_distinct(F.transform("s", lambda x: x["entity"])).alias("ents"))


def pairs(entities: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(note, a, b, sim): pairs of entities that share a sentence, with the cosine of their vectors (JN5, JN6)."""
    return mentions.attach_vectors(cooccur.pairs(entities), vectors, dim)


def tree_pairs(pairs: DataFrame, trees: DataFrame) -> DataFrame:
    """(id, sim, head, dep, s1, e1, s2, e2): places of both entities in parsed sentences (note, tokens, head, dep) (TX7, TX15).

    id: (note, a, b). tokens: array of (text, lemma, pos).
    """
    words = lambda c: mentions.phrase_words(text.entity_name(c))
    rows = pairs.join(trees, "note").select(F.struct("note", "a", "b").alias("id"), "sim", "head", "dep", mentions.span_words(F.col("tokens")).alias("words"), words("a").alias("kw1"), words("b").alias("kw2"))
    return mentions.span_pairs(rows).drop("words", "kw1", "kw2")


def feature_rows(placed: DataFrame, core: DataFrame, sub: DataFrame) -> DataFrame:
    """Features in the columns that ``graph.digraph`` takes, of ``tree_pairs`` and pattern counts (TX19, D6)."""
    sims = placed.select("id", "sim").distinct()
    rows = parse.features(placed, core, sub).join(sims, "id")
    span = lambda s, e: F.struct(F.col(s).alias("start"), F.col(e).alias("end"))
    return rows.select(
        F.col("id.a").alias("kw1"), F.col("id.b").alias("kw2"), "sim", "dep_path", "pattern", F.col("id.note").alias("note"), "score",
        F.col("dep_coverage").alias("significant"), F.col("pattern_freq").alias("explicit"), span("s1", "e1").alias("kw1_span"), span("s2", "e2").alias("kw2_span"),
    )
