"""Phrases, page-scoped names and entity resolution."""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from relgraph.functions.scores import cosine, dot, norm
from relgraph.functions.text import let, treebank
from relgraph.operators import trie
from relgraph.sources import scratch


def match_phrases(tokens: DataFrame, dictionary: DataFrame, mode: str = "longest", scope: tuple[str, ...] = ()) -> DataFrame:
    """(id, start, size, phrase): dictionary phrases in token arrays (id, tokens) (TX1, TX2).

    greedy: every phrase at every place. longest: from the left, the longest phrase at
    a place, and on after it. dictionary: (phrase), words joined by single spaces, of any number (TX3, TX4).
    scope: columns of both tables; a phrase is known only where they are equal (TX5).
    """
    if not scope:
        rows = trie.hits(tokens.select("id", "tokens"), dictionary, None if mode == "greedy" else "longest")
        said = lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.array_join(F.slice("tokens", x["start"] + 1, x["size"]), " ").alias("phrase"))
        return rows.select("id", F.explode(F.transform(F.filter("hits", lambda x: x["whole"]), said)).alias("m")).select("id", "m.*")
    words = dictionary.select(*scope, "phrase").where(F.col("phrase") != "").distinct().withColumn("size", F.size(F.split("phrase", " ")))
    own = words.groupBy(*scope).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("size")).alias("sizes"))  # that occur in the dictionary
    few = words.join(own.where(F.col("n") <= SCOPE_PHRASES).select(*scope), list(scope), "left_semi").groupBy(*scope).agg(F.collect_list(F.struct("phrase", "size")).alias("known"))
    found = _within(tokens, few, scope)
    many = scratch.materialise(own.where(F.col("n") > SCOPE_PHRASES), "large-scopes")
    if not many.isEmpty():  # their phrases are no row
        at = tokens.join(many, list(scope)).select("id", *scope, "tokens", F.explode("sizes").alias("size")).where(F.size("tokens") >= F.col("size"))
        gram = F.transform(F.sequence(F.lit(0), F.size("tokens") - F.col("size")), lambda i: F.struct(i.alias("start"), F.array_join(F.slice("tokens", i + 1, F.col("size")), " ").alias("phrase")))
        grams = at.select("id", *scope, "size", F.explode(gram).alias("g")).select("id", *scope, "size", "g.start", "g.phrase")
        found = found.unionByName(grams.join(words, [*scope, "phrase", "size"]).select("id", "start", "size", "phrase"))
    if mode == "greedy":
        return found
    return longest_from_left(found)


#: Phrases of a scope that go with each of its texts.
SCOPE_PHRASES = 1024


def _within(tokens: DataFrame, known: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """(id, start, size, phrase) of texts (id, scope..., tokens) and the phrases of their scope, known (scope..., known: list of (phrase, size)).

    No n-gram is made of a phrase that the text as a whole does not hold.
    """
    spaced = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    rows = tokens.select("id", *scope, F.struct("tokens", spaced(F.array_join("tokens", " ")).alias("text")).alias("t")).join(known, list(scope))
    held = rows.select("id", "t.tokens", F.explode(let(F.col("t.text"), lambda x: F.filter("known", lambda p: F.contains(x, spaced(p["phrase"]))))).alias("p"))
    held = held.where(F.size("tokens") >= F.col("p.size"))
    starts = F.filter(F.sequence(F.lit(0), F.size("tokens") - F.col("p.size")), lambda i: F.array_join(F.slice("tokens", i + 1, F.col("p.size")), " ") == F.col("p.phrase"))
    return held.select("id", F.explode(starts).alias("start"), F.col("p.size").alias("size"), F.col("p.phrase").alias("phrase"))


def longest_from_left(found: DataFrame) -> DataFrame:
    """Of matches (id, start, size, phrase) the longest at a place, from the left, and on after it (TX1)."""
    best = found.groupBy("id", "start").agg(F.max(F.struct("size", "phrase")).alias("m")).select("id", "start", "m.size", "m.phrase")
    kind = found.schema["id"].dataType.simpleString()

    def run(batches):
        now, at = None, 0  # a text may go on in the next batch
        for b in batches:
            taken = []
            for i, s, n in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                if i != now:
                    now, at = i, 0
                taken.append(s >= at)
                at = s + n if taken[-1] else at
            yield b.filter(pa.array(taken, pa.bool_()))

    return best.repartition("id").sortWithinPartitions("id", "start").mapInArrow(run, f"id {kind}, start int, size int, phrase string")


def reform(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, text): token arrays (id, tokens) with the words of each dictionary phrase joined by _ (SC31).

    From the left, words are read as long as they begin some phrase; the longest phrase among them becomes
    one word. What was read beyond it is kept as it is and not looked at again (Q20).
    """
    rows = trie.hits(tokens.select("id", "tokens"), dictionary, "read")

    def run(batches):
        for b in (x for whole in batches for x in trie.cut(whole, "tokens")):
            out = []
            for words, joins in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts, at = [], 0
                for x in joins:
                    if x["size"] > 1:
                        parts += [*words[at : x["start"]], "_".join(words[x["start"] : x["start"] + x["size"]])]
                        at = x["start"] + x["size"]
                out.append(None if words is None else " ".join([*parts, *words[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return rows.mapInArrow(run, f"id {tokens.schema['id'].dataType.simpleString()}, text string")


def page_names(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page, name, entity, since, until): what a name stands for in paragraphs since to until of a page, both included (TX5).

    pages: (page, title, name), the name that the title gives; links: (page, para, seq, name, entity). A paragraph knows its page's title and the links so far; the latest
    writer of a name wins, and the title is written again at the start of each paragraph, so a link of the title's name holds in its own alone.
    since is null from the start, until null to the end. Rows are as many as links, twice at most, whatever the number of paragraphs.
    """
    own = pages.select("page", "name", "title").where(F.col("name") != "").distinct()
    last = links.where(F.col("name") != "").groupBy("page", "name", "para").agg(F.max(F.struct("seq", "entity")).alias("m"))
    after = F.lead("para").over(Window.partitionBy("page", "name").orderBy("para"))
    last = last.select("page", "name", "para", F.col("m.entity").alias("entity"), after.alias("next")).join(own, ["page", "name"], "left")
    until = F.when(F.col("title").isNotNull(), F.col("para")).otherwise(F.col("next") - 1)
    rows = last.select("page", "name", "entity", F.col("para").alias("since"), until.alias("until"))
    between = last.where("title is not null and (next is null or next > para + 1)").select("page", "name", F.col("title").alias("entity"), (F.col("para") + 1).alias("since"), (F.col("next") - 1).alias("until"))
    first = last.where("title is not null").groupBy("page", "name").agg((F.min("para") - 1).alias("until"))
    begin = own.join(first, ["page", "name"], "left").select("page", "name", F.col("title").alias("entity"), F.lit(None).cast("int").alias("since"), "until")
    return rows.unionByName(between).unionByName(begin)


def latest(wanted: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """wanted (page, para, name, ...) with ``entity``, what the name stands for there (TX5); names that nothing gives are left out.

    One sorted pass over wanted and links together, not a join of each with all earlier ones. Arguments as of ``page_names``.
    """
    own = pages.select("page", "name", "title").where(F.col("name") != "").distinct()
    kept = F.struct(*[c for c in wanted.columns if c not in ("page", "para", "name")])
    rows = wanted.select("page", "name", "para", F.lit(1).alias("kind"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("writes"), kept.alias("__kept"))
    said = links.select("page", "name", "para", F.lit(0).alias("kind"), "seq", F.col("entity").alias("writes")).withColumn("__kept", F.lit(None).cast(rows.schema["__kept"].dataType))
    order = Window.partitionBy("page", "name").orderBy("para", "kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.unionByName(said).withColumns({"__at": F.last(F.when(F.col("kind") == 0, F.col("para")), ignorenulls=True).over(order), "__by": F.last("writes", ignorenulls=True).over(order)})
    rows = rows.where("kind = 1").join(own, ["page", "name"], "left")
    mine = F.when(F.col("title").isNotNull() & ~F.coalesce(F.col("__at") == F.col("para"), F.lit(False)), F.col("title")).otherwise(F.col("__by"))
    return rows.withColumn("entity", mine).where(F.col("entity").isNotNull()).select("page", "para", "name", "__kept.*", "entity")


def resolve_titles(mentions: DataFrame, titles: DataFrame) -> DataFrame:
    """mentions (name, ...) with ``entity``: the equal title, else the only one equal but for case (JN2, JN3)."""
    exact = titles.select(F.col("title").alias("name"), F.col("title").alias("exact")).distinct()
    folded = titles.groupBy(F.lower("title").alias("folded")).agg(F.count_distinct("title").alias("n"), F.min("title").alias("only"))
    out = mentions.join(exact, "name", "left").join(folded, F.lower("name") == F.col("folded"), "left")
    return out.withColumn("entity", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only")))).drop("exact", "folded", "n", "only")


def resolve_by_vector(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, entity, sim): the candidate nearest to the page's vector (JN4).

    mentions: (id, key, page_vec), null vectors drop the mention; candidates: (key, entity, vec). Ties go
    to the smaller entity; a candidate has to be above -1.
    """
    rows = mentions.where(F.col("page_vec").isNotNull()).join(candidates.where(F.col("vec").isNotNull()), "key")
    rows = rows.select("id", "entity", cosine("page_vec", "vec").alias("sim")).where("sim > -1")
    best = Window.partitionBy("id").orderBy(F.desc("sim"), "entity")
    return rows.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


#: Bytes of vectors that may go to every task, and vectors of a block that a task holds beside another.
VECTOR_BYTES, VECTOR_BLOCK = 8 << 20, 1 << 16


def attach_vectors(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """pairs (a, b, ...) with ``sim``, the cosine of their vectors (ent, vec); missing ones are zero (JN5).

    Vectors too large for every task go to blocks of entities instead, once for each block of the other end: none is shuffled with a pair.
    """
    vectors = vectors.where("ent is not null")
    count = vectors.select("ent").count()
    if count * dim * 4 > VECTOR_BYTES and pairs.schema["a"].dataType == pairs.schema["b"].dataType == vectors.schema["ent"].dataType:
        return _attach_blocks(pairs, vectors, dim, max(ceil(count / VECTOR_BLOCK), ceil(sqrt(2 * pairs.sparkSession.sparkContext.defaultParallelism))))
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    left, right = (vectors.select(F.col("ent").alias(k), F.col("vec").alias(f"v{k}"), norm("vec").alias(f"n{k}")) for k in "ab")  # a vector's norm once, not for each pair
    if count * dim * 4 <= VECTOR_BYTES:
        left, right = F.broadcast(left), F.broadcast(right)
    out = pairs.join(left, "a", "left").join(right, "b", "left")
    length = lambda k: F.when(F.col(f"v{k}").isNull(), 0.0).otherwise(F.col(f"n{k}"))
    sim = F.try_divide(dot(F.coalesce("va", zero), F.coalesce("vb", zero)), length("a") * length("b"))
    return out.withColumn("sim", F.coalesce(sim, F.lit(0.0))).drop("va", "vb", "na", "nb")


def _attach_blocks(pairs: DataFrame, vectors: DataFrame, dim: int, groups: int) -> DataFrame:
    """``attach_vectors`` in groups x groups tasks: the pairs from one block of entities to another meet the vectors of both."""
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    own = vectors.select("ent", F.col("vec").cast("array<double>" if vectors.schema["vec"].dataType.elementType.typeName() == "double" else "array<float>").alias("vec"), group("ent").alias("g"))
    no_pair = F.lit(None).cast(pairs.select(F.struct("*").alias("p")).schema["p"].dataType).alias("p")
    sent = [own.select("g", every.alias("o"), F.lit(kind).alias("kind"), "ent", "vec") for kind in (0, 1)]
    rows = sent[0].select((F.col("g") * groups + F.col("o")).alias("cell"), "kind", "ent", "vec", no_pair)
    rows = rows.unionByName(sent[1].select((F.col("o") * groups + F.col("g")).alias("cell"), "kind", "ent", "vec", no_pair))
    # an empty list, not null: Arrow's writer goes over all nulls before a row again for each row
    none = [F.lit(None).cast(own.schema["ent"].dataType).alias("ent"), F.array().cast(own.schema["vec"].dataType).alias("vec")]
    rows = rows.unionByName(pairs.select((group("a") * groups + group("b")).alias("cell"), F.lit(2).alias("kind"), *none, F.struct("*").alias("p")))
    rows = rows.repartitionById(groups * groups, F.col("cell")).sortWithinPartitions("kind")
    names = pairs.columns

    def run(batches):
        held, sides = ([], []), None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for side in (0, 1):
                part = batch.slice(int(np.searchsorted(kinds, side)), int((kinds == side).sum()))
                if part.num_rows:
                    held[side].append((part.column("ent"), part.column("vec")))
            part = batch.slice(int(np.searchsorted(kinds, 2)))
            if part.num_rows:
                if sides is None:
                    sides = [_Block(x, dim) for x in held]
                    held = ((), ())
                p = part.column("p")
                row, sim = _cosines(*sides, p.field("a"), p.field("b"))
                got = [p.field(k).take(pa.array(row)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*got, pa.array(sim)], names=[*names, "sim"])

    out = StructType([*pairs.schema.fields, StructField("sim", DoubleType())])
    return rows.select("kind", "ent", "vec", "p").mapInArrow(run, out)


class _Block:
    """Vectors by entity, the last of them the zero that missing ones are; those of an entity stand together."""

    def __init__(self, parts: list, dim: int):
        ents = pa.concat_arrays([e for e, _ in parts]) if parts else None
        codes = ents.dictionary_encode() if parts else None
        self.known = codes.dictionary if parts else None
        code = codes.indices.to_numpy() if parts else np.zeros(0, np.int32)
        order = np.argsort(code, kind="stable")
        self.count = np.append(np.bincount(code, minlength=1) if parts else np.zeros(0, np.int64), 1)
        self.first = np.append(0, np.cumsum(self.count))[:-1]
        vecs = pa.concat_arrays([v for _, v in parts]) if parts else None
        null = vecs.is_null().to_numpy(zero_copy_only=False)[order] if parts else np.zeros(0, bool)
        size = vecs.value_lengths().fill_null(dim).to_numpy(zero_copy_only=False)[order] if parts else np.zeros(0, np.int32)
        self.size, width = np.append(size, dim), int(max(size.max(initial=0), dim))
        self.sound, self.values = np.ones(len(size) + 1, bool), np.zeros((width, len(size) + 1))  # by component: sums go in its order
        if parts:
            flat, at = vecs.flatten(), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.where(vecs.is_null().to_numpy(zero_copy_only=False), 0, vecs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))])
            x, holes = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
            begin, full = at[:-1][order], np.where(null, 0, size)
            self.sound[:-1] = holes[begin + full] == holes[begin]
            for d in range(width):
                has = np.nonzero(full > d)[0]
                self.values[d, has] = x[begin[has] + d]
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_dot(self.values, self.values))

    def find(self, ents: pa.Array) -> np.ndarray:
        if self.known is None:
            return np.zeros(len(ents), np.int64)
        return pc.index_in(ents, value_set=self.known, skip_nulls=True).fill_null(len(self.count) - 1).to_numpy(zero_copy_only=False).astype(np.int64)


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of columns, summed in the order of components as ``scores.dot`` does."""
    total = np.zeros(x.shape[1])
    for p, q in zip(x, y, strict=False):
        total += p * q
    return total


def _cosines(left: _Block, right: _Block, a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(place, cosine) of pairs; a pair whose ends have several vectors comes once for each two."""
    i, j = left.find(a), right.find(b)
    n, m = left.count[i], right.count[j]
    row = np.repeat(np.arange(len(i)), n * m)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    i, j = left.first[i][row] + k // m[row], right.first[j][row] + k % m[row]
    total = np.zeros(len(row))
    with np.errstate(all="ignore"):
        for p, q in zip(left.values, right.values, strict=False):
            total += p[i] * q[j]
        length = left.norm[i] * right.norm[j]
        fits = left.sound[i] & right.sound[j] & (left.size[i] == right.size[j]) & (length != 0)
        return row, np.where(fits, total / length, 0.0)


# Words that are no keywords, beside single letters other than c: some of the domain, then the common English ones.
STOP = (
    "can it work in form parts is its or and "
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers "
    "herself it it's its itself they them their theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over under again further then once here there when where why how all "
    "any both each few more most other some such no nor not only own same so than too very s t can will just don don't should should've now d ll "
    "m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't "
    "mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def drop_keywords(words: DataFrame, stop=STOP) -> DataFrame:
    """words (kw) without stop words, empty ones and single letters other than c (SC11)."""
    return words.where(~F.col("kw").isin(*stop) & ((F.length("kw") > 1) | (F.col("kw") == "c")))


# Endings of English nouns and what takes their place, in order.
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))


def noun_lemmas(words: DataFrame, vocabulary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(word, lemma) of distinct words (word): the shortest form that the vocabulary (word) has (SC10, SC12).

    Forms are the word itself and what its endings give, or for a word that exceptions (word, lemma) hold what they
    say; where the vocabulary has none of them, endings are taken off those forms again. A word without a form is its own lemma.
    """
    words = words.select("word").where("word is not null").distinct()
    forms = lambda c: F.filter(F.array(*[F.when(F.endswith(c, F.lit(e)), F.concat(F.expr(f"substring({c}, 1, length({c}) - {len(e)})"), F.lit(new))) for e, new in NOUN_ENDINGS]), lambda x: x.isNotNull())
    by_rule = words.select("word", F.posexplode(F.concat(F.array("word"), forms("word"))).alias("k", "form"))
    if exceptions is not None:
        odd = exceptions.select("word", F.col("lemma").alias("form")).distinct()
        own = words.join(odd.select("word").distinct(), "word", "left_semi").select("word", F.lit(0).alias("k"), F.col("word").alias("form"))
        by_rule = by_rule.join(odd.select("word").distinct(), "word", "left_anti").unionByName(own).unionByName(words.join(odd, "word").select("word", F.lit(1).alias("k"), "form"))
    known = vocabulary.select(F.col("word").alias("form")).distinct()
    tried, out = scratch.materialise(by_rule.where("form <> ''"), "lemma-forms"), []
    while not tried.isEmpty():
        good = tried.join(known, "form", "left_semi")
        best = scratch.materialise(good.groupBy("word").agg(F.min(F.struct(F.length("form").alias("n"), "k", "form")).alias("m")).select("word", F.col("m.form").alias("lemma")), "lemmas")
        out.append(best)
        rest = tried.where("k > 0" if len(out) == 1 else "true").join(best.select("word"), "word", "left_anti")
        tried = scratch.materialise(rest.select("word", F.posexplode(forms("form")).alias("k", "form")).where("form <> ''"), "lemma-forms")
    found = reduce(DataFrame.unionByName, out) if out else words.limit(0).withColumn("lemma", F.col("word"))
    return words.join(found, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))


def lemmatised(rows: DataFrame, lemmas: DataFrame, words: str = "tokens") -> DataFrame:
    """rows (id, tokens, ...) with each token that lemmas (word, lemma) hold in its dictionary form; ids are unique (SC10, TX6)."""
    each = rows.select("id", F.posexplode(words).alias("k", "word")).join(scratch.small(lemmas.select("word", "lemma")), "word", "left")
    done = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", F.coalesce("lemma", "word").alias("w")))).alias("s")).select("id", F.transform("s", lambda x: x["w"]).alias("__w"))
    out = rows.join(done, "id", "left")
    return out.withColumn(words, F.coalesce("__w", words)).drop("__w")


def lemmatise(tokens, tags, lemmas):
    """Token array with the dictionary form (map column ``lemmas``) of each noun; other words stay (SC10)."""
    return F.transform(F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t")), lambda x: F.when(F.startswith(x["t"], F.lit("NN")), F.coalesce(F.element_at(lemmas, x["w"]), x["w"])).otherwise(x["w"]))


def span_words(tokens):
    """Words by which phrases are found in a parsed sentence: nouns by their lemma, all in lower case (TX7). tokens: array of (text, lemma, pos)."""
    return F.transform(tokens, lambda t: F.lower(F.when(t["pos"] == "NOUN", t["lemma"]).otherwise(t["text"])))


def phrase_words(phrase):
    """A phrase as words, hyphens apart, in lower case (TX7)."""
    return F.filter(F.split(F.lower(F.replace(phrase, F.lit("-"), F.lit(" - "))), r"\s+"), lambda x: x != "")


def spans(words, phrase):
    """All places (start, end; inclusive) of a phrase in a sentence, overlapping ones too; both are word arrays (TX7)."""
    def within(x):
        found = F.filter(F.sequence(F.lit(0), F.size(x["w"]) - F.size(x["p"])), lambda i: F.slice(x["w"], i + 1, F.size(x["p"])) == x["p"])
        some = F.transform(found, lambda i: F.struct(i.alias("start"), (i + F.size(x["p"]) - 1).alias("end")))
        return F.when((F.size(x["p"]) > 0) & (F.size(x["w"]) >= F.size(x["p"])), some).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    return let(F.struct(words.alias("w"), phrase.alias("p")), within)  # not once for each place


def find_spans(text, tokens, phrase, phrase_tokens, plain, use_lemma: bool = True, lower: bool = True):
    """Places (start, end; inclusive) of a phrase in a parsed sentence, in whichever tokens fit (TX7).

    tokens, phrase_tokens: arrays of (text, lemma, pos) of a parser. Where the Treebank's tokens of the text, with plain quotes, are the parser's, the
    sentence is read as ``plain``, its words by the Treebank with nouns in their dictionary form, and the phrase as words with hyphens apart.
    Else both are read as parsed, nouns by their lemma with use_lemma.
    """
    same = F.transform(treebank(text), lambda t: F.when(t.isin("``", "''"), F.lit('"')).otherwise(t)) == F.transform(tokens, lambda t: t["text"])
    parsed = lambda c: F.transform(c, lambda t: F.when((t["pos"] == "NOUN") & F.lit(use_lemma), t["lemma"]).otherwise(t["text"]))
    cased = (lambda c: F.transform(c, lambda w: F.lower(w))) if lower else (lambda c: c)
    apart = F.filter(F.split(F.replace(phrase, F.lit("-"), F.lit(" - ")), r"\s+"), lambda x: x != "")
    return F.when(same, spans(cased(plain), cased(apart))).otherwise(spans(cased(parsed(tokens)), cased(parsed(phrase_tokens))))


def span_pairs(rows: DataFrame) -> DataFrame:
    """rows (..., words, kw1, kw2), word arrays, once for each place of kw1 and each of kw2: s1, e1, s2, e2 added (TX15)."""
    kept = rows.columns
    one = rows.select(*kept, F.explode(spans(F.col("words"), F.col("kw1"))).alias("__one"))
    both = one.select(*kept, "__one", F.explode(spans(F.col("words"), F.col("kw2"))).alias("__two"))
    return both.select(*kept, F.col("__one.start").alias("s1"), F.col("__one.end").alias("e1"), F.col("__two.start").alias("s2"), F.col("__two.end").alias("e2"))


def reformed(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """(kw, lemma, stable): words and their dictionary forms; a word without one is its own (SC12)."""
    out = words.join(lemmas, words["kw"] == lemmas["word"], "left").select("kw", F.coalesce("lemma", "kw").alias("lemma"))
    return out.withColumn("stable", F.col("kw") == F.col("lemma"))


def keyword_lists(words: DataFrame, lemmas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keywords (kw) that keep their form, and lines (line) of the others, tab, their form (SC12)."""
    known = reformed(drop_keywords(words), lemmas)
    return known.where("stable").select("kw"), known.where("not stable").select(F.concat_ws("\t", "kw", "lemma").alias("line"))
