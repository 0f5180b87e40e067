"""Evaluation: exact match, answer hits, ranking measures, n-gram overlap."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from relgraph.functions.stem import stem
from relgraph.functions.text import normalize_answer, tokenize


def exact_match(prediction, references):
    """Whether the normalised prediction equals any normalised reference (SC27, EV1)."""
    return F.exists(references, lambda r: normalize_answer(r) == normalize_answer(prediction))


def contains_answer(text, answer):
    """Whether the answer's lower-cased tokens stand in a row in the text's; null texts and empty answers do not match (EV2, EV3, Q27)."""
    padded = lambda c: F.concat(F.lit(" "), F.array_join(tokenize(c, lower=True), " "), F.lit(" "))
    return F.coalesce(F.contains(padded(text), padded(answer)) & (F.size(tokenize(answer)) > 0), F.lit(False))


def answers_in_texts(answers: DataFrame, texts: DataFrame, key: int = 6) -> DataFrame:
    """(answer_id, text_id) of answers (answer_id, answer) that stand in texts (text_id, text), both ids unique (EV2 at scale).

    A hash of an answer's first ``key`` tokens is joined with hashes of the token windows of the texts;
    only what meets is compared whole. No pair is made without a common window, and no
    window carries its text. Answers go to every task only if their keys take at most 64 MB.
    """
    first = lambda t, p, k: F.xxhash64(k, F.array_join(F.slice(t, p, k), " ")).alias("h")
    a = answers.select("answer_id", tokenize("answer", lower=True).alias("t")).where(F.size("t") > 0).withColumn("k", F.least(F.size("t"), F.lit(key)))
    a = a.select("answer_id", "k", first(F.col("t"), F.lit(1), F.col("k")))
    sizes = a.select(F.array_sort(F.collect_set("k")).alias("ks"))  # at most ``key`` numbers
    t = texts.select("text_id", tokenize("text", lower=True).alias("t"))
    t = t.crossJoin(F.broadcast(sizes)).select("text_id", "t", F.explode("ks").alias("k")).where(F.size("t") >= F.col("k"))
    grams = t.select("text_id", "k", "t", F.explode(F.sequence(F.lit(1), F.size("t") - F.col("k") + 1)).alias("p")).select("text_id", first(F.col("t"), F.col("p"), F.col("k")))
    if answers.agg(F.coalesce(F.sum(F.length(F.col("answer_id").cast("string")) + 24), F.lit(0))).first()[0] <= 64 << 20:
        a = F.broadcast(a)
    met = grams.join(a, "h").select("answer_id", "text_id").distinct()
    whole = met.join(answers.select("answer_id", "answer"), "answer_id").join(texts.select("text_id", "text"), "text_id")
    return whole.where(contains_answer("text", "answer")).select("answer_id", "text_id")


def hit_vector(contexts, answers):
    """For each text of an array, whether it holds one of the answers; a null text does not (EV3)."""
    return F.transform(contexts, lambda c: F.exists(answers, lambda a: contains_answer(c, a)))


def hit_vectors(contexts: DataFrame, answers: DataFrame) -> DataFrame:
    """(question, hits): for each context (question, rank, text) of a question, by rank, whether it holds one of the answers (EV3 at scale).

    answers: (answer_id, answer), the same for all questions. Texts meet answers by their common windows, as in ``answers_in_texts``.
    """
    rows = contexts.withColumn("text_id", F.struct("question", "rank"))
    found = answers_in_texts(answers, rows.where("text is not null").select("text_id", "text")).select("text_id", F.lit(True).alias("hit")).distinct()
    rows = rows.select("text_id").join(found, "text_id", "left").select("text_id.*", F.coalesce("hit", F.lit(False)).alias("hit"))
    return rows.groupBy("question").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "hit"))), lambda x: x["hit"]).alias("hits"))


def topk_curve(hits: DataFrame, n: int) -> DataFrame:
    """(k, hits): questions (question, rank, hit) with a hit among the first k contexts, k up to n (AG9, EV4)."""
    best = hits.where("hit").groupBy("question").agg(F.min("rank").alias("best")).groupBy("best").agg(F.count("*").alias("m"))
    curve = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k")
    ks = hits.sparkSession.range(1).select(curve)
    return ks.join(F.broadcast(best), F.col("best") <= F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("hits"))


def mean_of_batches(rows: DataFrame, batch: str, value: str) -> DataFrame:
    """One row: the mean over batches of their means, which weighs small batches more (AG10, Q19)."""
    return rows.groupBy(batch).agg(F.avg(value).alias("mean")).agg(F.avg("mean").alias("mean"))


def top_places(values, n: int, largest: bool = True):
    """Places (from 0) of the n largest or smallest values of an array; equal ones by place (TK3)."""
    ranked = F.array_sort(F.transform(values, lambda x, i: F.struct((-x if largest else x).alias("x"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, n), lambda s: s["i"])


def most_common(counts: DataFrame) -> DataFrame:
    """One row (pattern, cnt): the commonest of counts (pattern, cnt), of equal ones the least (TK4)."""
    best = F.min(F.struct((-F.col("cnt")).alias("c"), "pattern")).alias("m")
    return counts.agg(best).select("m.pattern", (-F.col("m.c")).alias("cnt"))


def count_inversions(values: np.ndarray) -> int:
    """Pairs in the wrong order, bit by bit of the values' ranks: a stable split by each bit, whose ones before zeros are counted within equal higher bits."""
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    total = 0
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        high, one = rank >> (bit + 1), rank >> bit & 1
        before = np.cumsum(one) - one
        first = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(high) else np.zeros(0, np.int64)
        own = before - np.repeat(before[first], np.diff(np.append(first, len(high))))
        total += int(own[one == 0].sum())
        rank = rank[np.argsort(rank >> bit, kind="stable")]
    return total


@F.pandas_udf(LongType())
def _inversions(a: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else count_inversions(np.asarray(x)) for x in a], dtype="Int64")


def inversions(ranking) -> Column:
    """Pairs of a ranking in the wrong order (AG11); places without a value are in none. Linear in places but for the number of bits."""
    ranking = F.col(ranking) if isinstance(ranking, str) else ranking
    return _inversions(F.filter(ranking, lambda x: x.isNotNull()))


def topk_overlap(order, k: int):
    """Share of the first k places that hold one of the k best (AG12). order: gold ranks, from 0."""
    return F.aggregate(F.slice(order, 1, k), F.lit(0.0), lambda a, x: a + F.when(x < k, 1.0).otherwise(0.0)) / F.least(F.lit(k), F.size(order))


def cover_index(order, k: int):
    """How many places it takes to hold all of the k best (AG12)."""
    return F.array_max(F.transform(order, lambda x, i: F.when(x < k, i + 1).otherwise(0)))


def weighted_mean(value, weight):
    """Sum of value times weight over the sum of weights (AG8)."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def _tokens(c):
    return F.coalesce(tokenize(c, lower=True), F.array().cast("array<string>"))


@F.pandas_udf(ArrayType(IntegerType()))
def _common_grams(a: pd.Series, b: pd.Series, orders: pd.Series) -> pd.Series:
    grams = lambda t, n: Counter(zip(*(t[k:] for k in range(n)), strict=False))
    return pd.Series([[(grams(x, n) & grams(y, n)).total() for n in ns] for x, y, ns in zip(map(list, a), map(list, b), orders, strict=True)])


def _overlaps(pairs: DataFrame, orders: list[int]) -> DataFrame:
    """(id, common, h, r) of rows (id, hyp, ref): for each order the common n-grams, clipped; sizes of both texts in tokens.

    Both texts are in one row, so n-grams are counted there, in Python, and never shuffled.
    """
    rows = pairs.select("id", _tokens("hyp").alias("h"), _tokens("ref").alias("r"))
    return rows.select("id", _common_grams("h", "r", F.array(*map(F.lit, orders))).alias("common"), F.size("h").alias("h"), F.size("r").alias("r"))


def _grams(size: str, n: int):
    return F.greatest(F.col(size) - (n - 1), F.lit(0))


def ngram_overlap(pairs: DataFrame, n: int = 1) -> DataFrame:
    """(id, common, n_hyp, n_ref, f1) of rows (id, hyp, ref), each id once: clipped n-gram counts, as ROUGE-n (EV5).

    The work is linear in the texts; null texts have no n-grams.
    """
    rows = _overlaps(pairs, [n]).select("id", F.get("common", 0).alias("common"), _grams("h", n).alias("n_hyp"), _grams("r", n).alias("n_ref"))
    return rows.withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("common"), F.col("n_hyp") + F.col("n_ref")), F.lit(0.0)))


def bleu(pairs: DataFrame, order: int = 4) -> DataFrame:
    """One row: corpus BLEU of rows (id, hyp, ref) (EV5). Zero where an order has no match. All orders come from one pass over the texts."""
    orders = list(range(1, order + 1))
    sums = [s for n in orders for s in (F.sum(F.get("common", n - 1)).alias(f"c{n}"), F.sum(_grams("h", n)).alias(f"h{n}"), F.sum(_grams("r", n)).alias(f"r{n}"))]
    parts = _overlaps(pairs, orders).agg(*sums)
    logs = sum((F.ln(F.try_divide(F.col(f"c{n}"), F.col(f"h{n}"))) for n in orders), F.lit(0.0)) / order
    brevity = F.least(F.lit(0.0), 1 - F.try_divide(F.col("r1"), F.col("h1")))
    return parts.select(F.coalesce(F.exp(logs + brevity), F.lit(0.0)).alias("bleu"))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence. Columns of the table are the bits of one number."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        meet = row & at.get(y, 0)
        row = (row + meet | row - meet) & full
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(id, common, n_hyp, n_ref, f1) of rows (id, hyp, ref): longest common subsequences of tokens, as ROUGE-L (EV5).

    Null texts have no tokens. Python, as the table of a subsequence is a loop with a state.
    """
    rows = pairs.select("id", _tokens("hyp").alias("h"), _tokens("ref").alias("r"))
    rows = rows.select("id", _common("h", "r").alias("common"), F.size("h").alias("n_hyp"), F.size("r").alias("n_ref"))
    return rows.withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("common"), F.col("n_hyp") + F.col("n_ref")), F.lit(0.0)))


#: Open alignments that are kept for each word; below that many the fewest chunks are certain.
BEAM = 64


def align(hyp: list[str], ref: list[str], beam: int = BEAM) -> tuple[int, int]:
    """Matches of two token lists and the fewest chunks that they can stand in (METEOR's exact and stem stages).

    As many tokens as can be match equal ones; of those left over, as many as can match tokens of the same stem.
    A chunk is a run of matches that follow each other in both lists.

    A way is one number: a bit for each place of ref that is used, and above these, for what may match by stem, counters. Ways that differ
    in their last match alone go on together, and only as many are made as are kept, however often a word comes again.
    """
    left, right = Counter(hyp), Counter(ref)
    exact = {w: min(n, right[w]) for w, n in left.items() if w in right}
    stems = {w: stem(w) for w in left | right}
    stems_l, stems_r = Counter(), Counter()
    for of, counts in ((stems_l, left), (stems_r, right)):
        for w, n in counts.items():
            of[stems[w]] += n - exact.get(w, 0)
    by_stem = {s: min(n, stems_r[s]) for s, n in stems_l.items() if stems_r[s] > 0 and n > 0}
    total = sum(exact.values()) + sum(by_stem.values())
    if not total:
        return 0, 0
    places, stem_places = Counter(), defaultdict(list)  # bits of a word's places
    for j, w in enumerate(ref):
        places[w] |= 1 << j
        if stems[w] in by_stem:
            stem_places[stems[w]].append(j)
    siblings = defaultdict(list)  # words with a stem that have to match equal ones
    for w in exact:
        siblings[stems[w]].append(w)
    # counters: matches so far of words as such (0), by stem (1), and of ref's words by stem (2)
    width = len(hyp).bit_length()
    names = [(1, s) for s in by_stem] + [(0, w) for s in by_stem for w in siblings[s]] + [(2, w) for w in right if stems[w] in by_stem]
    at = {name: len(ref) + k * width for k, name in enumerate(names)}
    most = (1 << width) - 1
    words_after, stems_after = left.copy(), Counter()  # how often a word and a stem are still to come
    for w, n in left.items():
        stems_after[stems[w]] += n
    open_ = {0: [0, 0]}  # way: fewest chunks, bits of the places that would go on with one of its last matches
    for w in hyp:
        s = stems[w]
        words_after[w] -= 1
        stems_after[s] -= 1
        need, need_s = exact.get(w, 0), by_stem.get(s, 0)
        if not need and not need_s:
            open_ = {way: [chunks, 0] for way, (chunks, _) in open_.items()}
            continue
        mask, after = places[w] if need else 0, words_after[w]
        own = 1 << at[0, w] if need and need_s else 0
        made, above = [], []  # by chunks: way, the place that goes on
        now, space, more = -2, beam, 0  # room for ways of so few chunks, and how many have one more
        for way, (chunks, next_) in open_.items():
            if chunks != now:
                if chunks != now + 1:
                    above = []
                    made.append((chunks, above))
                here, above, more = above, [], 0
                space, now = beam - sum(len(x) for _, x in made), chunks
                made.append((chunks + 1, above))
            if space <= 0:
                break
            used = way & mask
            had = way >> at[0, w] & most if own else used.bit_count()
            if had < need:
                free = mask ^ used
                near = free & next_
                if near:
                    free ^= near
                    while near:
                        bit = near & -near
                        here.append(((way | bit) + own, bit << 1))
                        near ^= bit
                        space -= 1
                while free and more < space:
                    bit = free & -free
                    above.append(((way | bit) + own, bit << 1))
                    free ^= bit
                    more += 1
            if had + after < need:
                continue
            if need_s:
                had_s = way >> at[1, s] & most
                if had_s < need_s:  # by stem: not needed as an equal word
                    for j in stem_places[s]:
                        v, bit = ref[j], 1 << j
                        if not way & bit and v != w and (way >> at[2, v] & most) < right[v] - exact.get(v, 0):
                            (here if next_ & bit else above).append(((way | bit) + (1 << at[1, s]) + (1 << at[2, v]), bit << 1))
                if had_s + stems_after[s] - sum(exact[x] - (way >> at[0, x] & most) for x in siblings[s]) < need_s:
                    continue
            here.append((way, 0))
            space -= 1
        open_, space = {}, beam
        for chunks, ways in made:
            for way, bit in ways[:space] if len(ways) > space else ways:
                if way not in open_:
                    open_[way] = [chunks, bit]
                elif bit and open_[way][0] == chunks:
                    open_[way][1] |= bit
            space = max(0, space - len(ways))
    return total, min((chunks for chunks, _ in open_.values()), default=0)


@F.pandas_udf(StructType([StructField("matches", IntegerType()), StructField("chunks", IntegerType())]))
def _aligned(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([align(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["matches", "chunks"], dtype="int32")


def meteor(pairs: DataFrame, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> DataFrame:
    """(id, matches, chunks, n_hyp, n_ref, score) of rows (id, hyp, ref): METEOR by exact and stem matches (EV5).

    score: the mean of precision and recall, alpha weighing recall, less gamma times the share of chunks to the power of beta.
    Python, as an alignment is a search with a state.
    """
    rows = pairs.select("id", _tokens("hyp").alias("h"), _tokens("ref").alias("r")).withColumn("m", _aligned("h", "r"))
    rows = rows.select("id", "m.matches", "m.chunks", F.size("h").alias("n_hyp"), F.size("r").alias("n_ref"))
    p, r = F.col("matches") / F.col("n_hyp"), F.col("matches") / F.col("n_ref")
    mean = F.try_divide(p * r, F.lit(alpha) * p + F.lit(1 - alpha) * r)
    score = mean * (1 - F.lit(gamma) * F.pow(F.try_divide(F.col("chunks").cast("double"), F.col("matches")), F.lit(beta)))
    return rows.withColumn("score", F.when(F.col("matches") > 0, score).otherwise(0.0))
