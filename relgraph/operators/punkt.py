"""Sentence ends learnt from the corpus, after Kiss and Strunk (2006): no list of abbreviations, no labels (SC8).

Words are what white space parts. A word's type is in lower case without marks around it and without a
period at its end; numbers are one type. From counts of types with and without a period come the
abbreviations, from what stands around breaks the words that start sentences, the pairs that a period does not part, and
the letter case of types. Words are counted once, each with the word before it where that one may end a sentence; every further
step is a grouped count over these counts, then a column expression.
A break is decided for each word that ends with a period and has another after it; texts are cut there and not into words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relgraph.sources.scratch import small

# Marks around words, what a number is, and the thresholds of the paper.
LEAD = r"""^["'(\[{<*_«“‘]+"""
TAIL = r"""["')\]}>*_»”’,;:]+$"""
NUMBER = r"^-?[.,]?[0-9][0-9,.-]*$"
NUMBER_TYPE = "##number##"
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0

def words(text) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def _core(w) -> Column:
    return F.regexp_replace(F.regexp_replace(w, LEAD, ""), TAIL, "")


def tokens(texts: DataFrame) -> DataFrame:
    """(id, place, of, period, mark, dots, upper, lower, before, after, ...) of the words of texts (id, text).

    of: the type; period, mark, dots: whether the word ends with a period, with ! or ?, with more than one period; the same
    of the word before (b_) and after (a_), null at the ends.
    """
    w = texts.select("id", words("text").alias("w"))
    shifted = F.arrays_zip(F.col("w").alias("w"), F.concat(F.array(F.lit(None).cast("string")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))).alias("b"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("a"))
    rows = w.where(F.size("w") > 0).select("id", F.posexplode(shifted).alias("place", "x")).select("id", "place", *[_core(f"x.{k}").alias(k) for k in "wba"])
    out = ["id", "place"]
    for k, p in (("w", ""), ("b", "b_"), ("a", "a_")):
        rows = rows.withColumns({**_typed(k, p), **_shown(k, p)})
        out += [f"{p}{c}" for c in ("of", "dots", "period", "mark", "upper", "lower")]
    return rows.select(out)


def _typed(k: str, p: str = "") -> dict[str, Column]:
    """Type of a word k without marks around it, and whether it ends with dots and with a period."""
    dots, bare = F.rlike(k, F.lit(r"\.\.+$")), F.regexp_replace(k, r"\.$", "")
    return {f"{p}of": F.when(F.rlike(bare, F.lit(NUMBER)), NUMBER_TYPE).otherwise(F.lower(F.when(dots, F.col(k)).otherwise(bare))), f"{p}dots": dots, f"{p}period": F.endswith(k, F.lit(".")) & ~dots}


def _marked(w: str) -> Column:
    """Whether a word can end with a period or a mark, by what it holds."""
    return F.contains(w, F.lit(".")) | F.contains(w, F.lit("!")) | F.contains(w, F.lit("?"))


def _mark(k: str) -> Column:
    return F.endswith(k, F.lit("!")) | F.endswith(k, F.lit("?"))


def _shown(k: str, p: str = "") -> dict[str, Column]:
    """Whether a word k without marks around it ends with ! or ?, and the case of its first letter."""
    return {f"{p}mark": _mark(k), f"{p}upper": F.rlike(k, F.lit(r"^\p{Lu}")), f"{p}lower": F.rlike(k, F.lit(r"^\p{Ll}"))}


def followed(texts: DataFrame) -> DataFrame:
    """(b_of, b_period, b_mark, b_dots, of, period, dots, mark, upper, lower, times): how often words of texts (id, text) come, by their type and by the word before.

    b_: null at a text's start; of a word that can end no sentence, '' and false. Each different pair is read once, not each word.
    """
    w = texts.select(words("text").alias("w"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))
    rows = w.where(F.size("w") > 0).select(F.explode(F.arrays_zip(F.col("w").alias("w"), before.alias("b"))).alias("x"))
    rows = rows.select("x.w", F.when(_marked("x.b") | F.col("x.b").isNull(), F.col("x.b")).otherwise("").alias("b")).groupBy("b", "w").agg(F.count("*").alias("times"))
    rows = rows.select(_core("w").alias("w"), _core("b").alias("b"), "times").withColumns({**_typed("w"), **_shown("w"), **_typed("b", "b_"), "b_mark": _mark("b")})
    by = ["b_of", "b_period", "b_mark", "b_dots", "of", "period", "dots", "mark", "upper", "lower"]
    return rows.groupBy(*by).agg(F.sum("times").alias("times"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(of, period, times): types of the words of texts (id, text), with a period and without, and how often: each different word is read once, not each word."""
    rows = texts.select(F.explode(words("text")).alias("w")).groupBy("w").agg(F.count("*").alias("times"))
    rows = rows.select(_core("w").alias("w"), "times").withColumns(_typed("w"))
    return rows.groupBy("of", "period").agg(F.sum("times").alias("times"))


def initial(of: str) -> Column:
    """Whether a type is a single letter."""
    return F.rlike(of, F.lit(r"^\p{L}$"))


def _ln(n: Column, p: Column) -> Column:
    """n * ln(p), 0 where n is."""
    return F.when(n == 0, F.lit(0.0)).otherwise(n * F.ln(p))


def types(found: DataFrame) -> DataFrame:
    """(of, n, periods, score, abbreviation) of every type, from words (of, period) or their counts (of, period, times).

    score: how much likelier a period after it is than by chance, less for long types and for each time there is none.
    """
    if "times" not in found.columns:
        found = found.select("of", "period", F.lit(1).cast("long").alias("times"))
    both = lambda n, k: (F.sum("times").alias(n), F.coalesce(F.sum(F.when(F.col("period"), F.col("times"))), F.lit(0)).alias(k))
    rows = found.groupBy("of").agg(*both("n", "periods"))
    total = found.agg(*both("all_n", "all_periods"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    n, k, p = F.col("n").cast("double"), F.col("periods").cast("double"), F.col("all_periods") / F.col("all_n")
    null, with_ = _ln(k, p) + _ln(n - k, 1 - p), _ln(k, F.lit(0.99)) + _ln(n - k, F.lit(0.01))
    dots = F.length("of") - F.length(F.replace("of", F.lit("."), F.lit(""))) + 1
    long = (F.length("of") - dots + 1).cast("double")
    score = -2 * (null - with_) * F.exp(-long) * dots * F.pow(long, k - n)
    fits = (F.col("periods") > 0) & F.rlike("of", F.lit(r"\p{L}")) & (F.col("of") != NUMBER_TYPE) & ~F.rlike("of", F.lit(r"\.\.+$"))
    return rows.select("of", "n", "periods", F.when(fits, score).otherwise(0.0).alias("score")).withColumn("abbreviation", F.col("score") >= ABBREVIATION)


def likelihood(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log likelihood ratio of ab joint occurrences of what occurs a and b times among n."""
    a, b, ab, n = (x.cast("double") for x in (a, b, ab, n))
    p, p1, p2 = b / n, F.try_divide(ab, a), F.try_divide(b - ab, n - a)
    of = lambda k, m, q: F.when((q <= 0) | (q >= 1) | q.isNull(), 0.0).otherwise(k * F.ln(q) + (m - k) * F.ln(1 - q))
    return -2 * (of(ab, a, p) + of(b - ab, n - a, p) - of(ab, a, p1) - of(b - ab, n - a, p2))


class Model:
    """What ``fit`` has learnt; tables of types."""

    def __init__(self, types: DataFrame, starters: DataFrame, pairs: DataFrame, case: DataFrame):
        self.types, self.starters, self.pairs, self.case = types, starters, pairs, case


def _abbreviated(found: DataFrame, abbreviations: DataFrame, *ends: str) -> DataFrame:
    """found with ``abbr`` (b_abbr, a_abbr): whether the type is an abbreviation and the word has its period."""
    for p in ends:
        own = abbreviations.select(F.col("of").alias(f"{p}of"), F.lit(True).alias(f"{p}abbr"))
        found = found.join(own, f"{p}of", "left").withColumn(f"{p}abbr", F.coalesce(f"{p}abbr", F.lit(False)) & F.coalesce(f"{p}period", F.lit(False)))
    return found


def fit(texts: DataFrame, known: list[str] | None = None, keep=lambda df, name: df) -> Model:
    """The model of texts (id, text). known: abbreviations beside those that are learnt; keep(table, name) materialises what is used again."""
    found = keep(followed(texts), "punkt-words")
    every = keep(types(found), "punkt-types")
    if known:
        spark = texts.sparkSession
        every = every.join(spark.createDataFrame([(k.lower().removesuffix("."),) for k in known], "of string").distinct().withColumn("known", F.lit(True)), "of", "full")
        every = every.select("of", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "periods")], F.coalesce("score", F.lit(0.0)).alias("score"), (F.coalesce("abbreviation", F.lit(False)) | F.col("known").isNotNull()).alias("abbreviation"))
    abbreviations = small(every.where("abbreviation").select("of"))
    found = _abbreviated(found, abbreviations, "", "b_")
    ends = lambda p: (F.col(f"{p}period") & ~F.col(f"{p}abbr")) | F.col(f"{p}mark")
    begins = F.coalesce(ends("b_"), F.lit(True))  # a text's first word begins a sentence
    unsure = F.coalesce(F.col("b_abbr") | F.col("b_dots"), F.lit(False))
    number = lambda p: (F.col(f"{p}of") == NUMBER_TYPE) | initial(f"{p}of")
    starts = F.coalesce(ends("b_"), F.lit(False)) & ~number("b_") & F.rlike("of", F.lit(r"^\p{L}+$"))
    times = lambda which: F.coalesce(F.sum(F.when(which, F.col("times"))), F.lit(0))
    # all that is counted by type in one pass
    one = found.groupBy("of").agg(
        F.max("upper").alias("uc"), F.max(F.col("upper") & ~begins & ~unsure).alias("mid_uc"), F.max("lower").alias("lc"), F.max(F.col("lower") & begins).alias("beg_lc"),
        times(starts).alias("k"), F.sum("times").alias("m"), times(ends("")).alias("breaks"),
    )
    one = keep(one, "punkt-case")
    case = one.select("of", "uc", "mid_uc", "lc", "beg_lc")
    total = one.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("breaks"), F.lit(0)).alias("all_breaks"))
    at = one.where("k > 0").select("of", "k")
    at = at.join(every.select("of", "n"), "of").crossJoin(F.broadcast(total))  # one row
    starters = at.where((likelihood(F.col("all_breaks"), F.col("n"), F.col("k"), F.col("all_n")) >= STARTER) & (F.col("all_n") / F.col("all_breaks") > F.col("n") / F.col("k"))).select("of")
    two = found.where(F.coalesce(F.col("b_period"), F.lit(False)) & number("b_") & F.rlike("of", F.lit(r"\p{L}"))).groupBy("b_of", "of").agg(F.sum("times").alias("k"))
    two = two.where("k > 1").join(every.select("of", "n"), "of").join(every.select(F.col("of").alias("b_of"), F.col("periods").alias("b_n")), "b_of").crossJoin(F.broadcast(total))
    two = two.where((likelihood(F.col("b_n"), F.col("n"), F.col("k"), F.col("all_n")) >= COLLOCATION) & (F.col("all_n") / F.col("b_n") > F.col("n") / F.col("k")))
    return Model(every, keep(starters, "punkt-starters"), keep(two.select("b_of", "of"), "punkt-pairs"), case)


def pieces(text) -> Column:
    """A text cut after each word that can end a sentence; words are parted by spaces alone. White space around it and empty pieces go."""
    flat = F.trim(F.regexp_replace(text, r"[\t\n\x0B\f\r]+", " "))
    return F.array_remove(F.split(F.regexp_replace(flat, f"([.!?]{TAIL.removesuffix('+$')}*+) +", "$1\n"), "\n"), "")


def breaks(texts: DataFrame, model: Model, keep=lambda df, name: df) -> DataFrame:
    """(id, place): pieces of texts (id, text) after which a sentence ends; a text's last one is none.

    Only words that can end a sentence are looked at, and only those that a period alone does not decide meet what was learnt; keep(table, name)
    materialises them.
    """
    w = texts.select("id", pieces("text").alias("p")).where(F.size("p") > 1)
    rows = w.select("id", F.posexplode(F.arrays_zip(F.slice("p", 1, F.size("p") - 1).alias("w"), F.slice("p", 2, F.size("p") - 1).alias("a"))).alias("place", "x"))
    rows = rows.select("id", "place", _core(F.substring_index("x.w", " ", -1)).alias("w"), F.substring_index("x.a", " ", 1).alias("a"))
    found = rows.withColumns({**_typed("w"), "mark": _mark("w")})
    found = _abbreviated(found.select("id", "place", "of", "dots", "period", "mark", "a"), small(model.types.where("abbreviation").select("of")), "")
    single, number = initial("of"), F.col("of") == NUMBER_TYPE
    unsure = ~F.col("mark") & (F.col("abbr") | F.col("dots") | single | number)
    found = keep(found.select("id", "place", *[F.when(unsure, F.col(c)).alias(c) for c in ("of", "dots", "abbr", "a")]), "punkt-ends")
    sure = found.where("of is null").select("id", "place")
    found = found.where("of is not null").withColumn("a", _core("a")).withColumns({**_typed("a", "a_"), **_shown("a", "a_")})
    found = found.join(small(model.starters.select(F.col("of").alias("a_of"), F.lit(True).alias("starts"))), "a_of", "left")
    found = found.join(small(model.pairs.select(F.col("b_of").alias("of"), F.col("of").alias("a_of"), F.lit(True).alias("paired"))), ["of", "a_of"], "left")
    found = found.join(small(model.case.withColumnRenamed("of", "a_of")), "a_of", "left")
    said = {c: F.coalesce(c, F.lit(False)) for c in ("starts", "paired", "uc", "mid_uc", "lc", "beg_lc")}
    found = found.withColumns(said)
    small_then = F.col("a_lower") & (F.col("uc") | ~F.col("beg_lc"))  # its case says that no sentence starts here
    large_then = F.col("a_upper") & F.col("lc") & ~F.col("mid_uc")  # its case says that one does
    of_short = large_then | (F.col("a_upper") & F.col("starts"))
    of_number = ~small_then & ~(single & ~large_then & F.col("a_upper") & ~F.col("lc"))
    ends = F.when(F.col("paired"), False).when((F.col("abbr") | F.col("dots")) & ~single, of_short).otherwise(of_number)
    return sure.unionByName(found.where(ends).select("id", "place"))


def sentences(texts: DataFrame, model: Model, keep=lambda df, name: df) -> DataFrame:
    """(id, sent, text): sentences of texts (id, text), each id once, in order; white space becomes single spaces."""
    ends = breaks(texts, model, keep).groupBy("id").agg(F.array_sort(F.collect_list("place")).alias("ends"))  # of one text
    rows = texts.select("id", "text").join(ends, "id", "left")  # texts are moved whole, not as words
    rows = rows.select("id", pieces("text").alias("p"), F.coalesce("ends", F.array().cast("array<int>")).alias("ends")).where(F.size("p") > 0)
    last = F.concat("ends", F.array(F.size("p") - 1))
    first = F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: e + 1))
    rows = rows.select("id", "p", F.arrays_zip(first.alias("a"), last.alias("b")).alias("s"))
    rows = rows.select("id", F.posexplode(F.transform("s", lambda x: F.array_join(F.slice("p", x["a"] + 1, x["b"] - x["a"] + 1), " "))).alias("sent", "text"))
    return rows.withColumn("text", F.regexp_replace("text", " {2,}", " "))
