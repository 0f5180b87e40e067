"""Text functions as column expressions; only Unicode normalisation needs Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns and label sets that results depend on.
TOKEN = r"([\p{L}\p{N}\p{M}]+)|([^\p{Z}\p{C}])"
LOOSE_TOKEN = r"[\p{L}\p{N}'.]+|\S"
SENTENCE = r"[^.!?\n]+[.!?]*"
LINK = r'<a href="([^"]*)">([^<]*)</a>'
ARTICLES = r"(?<![\p{L}\p{N}])(a|an|the)(?![\p{L}\p{N}])"
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
BRACKETS = ("{}", "()", "[]")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def let(c, f) -> Column:
    """f(c) with c evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(_col(c)), f), 0)


def _depth(c, left: str, right: str) -> Column:
    """How many brackets are open at most."""
    now = lambda a, x: F.when(x == left, a["now"] + 1).otherwise(F.greatest(a["now"] - 1, F.lit(0)))
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, x: let(now(a, x), lambda n: F.struct(n.alias("now"), F.greatest(a["most"], n).alias("most")))
    return F.aggregate(F.regexp_extract_all(c, F.lit(rf"[\{left}\{right}]"), F.lit(0)), zero, step, lambda a: a["most"])


def strip_brackets(c) -> Column:
    """Drop {}, then (), then [] with what they hold, however deep (SC1). Brackets without a partner stay.

    A pass of a pattern takes the innermost; there are as many passes as brackets are open at once, one for most texts.
    """
    for left, right in BRACKETS:
        flat = rf"\{left}[^\{left}\{right}]*\{right}"
        rest = lambda y: F.aggregate(F.sequence(F.lit(1), _depth(y, left, right)), y, lambda a, _: F.regexp_replace(a, flat, ""))  # noqa: B023, E731
        once = lambda x: let(F.regexp_replace(x, flat, ""), lambda y: F.when(F.rlike(y, F.lit(flat)), rest(y)).otherwise(y))  # noqa: B023, E731
        c = let(c, lambda x: F.when(F.contains(x, F.lit(left)) & F.contains(x, F.lit(right)), once(x)).otherwise(x))  # noqa: B023
    return collapse(c)


def tokenize(c, lower: bool = False) -> Column:
    """Words, and single characters that are neither space nor control (SC25)."""
    c = _col(c)
    return F.regexp_extract_all(F.lower(c) if lower else c, F.lit(TOKEN), F.lit(0))


def normalize_text(c) -> Column:
    """Lower case, punctuation split off except apostrophes and full stops (SC3)."""
    return F.array_join(F.regexp_extract_all(F.lower(_col(c)), F.lit(LOOSE_TOKEN), F.lit(0)), " ")


def clean_text(c) -> Column:
    """Brackets dropped, normalised, and only a-z, 0-9, comma, full stop, semicolon, hyphen left (SC4)."""
    return collapse(F.regexp_replace(normalize_text(strip_brackets(c)), r"[^a-z0-9,.;\s-]", ""))


def clean_phrase(c) -> Column:
    """Only a-z and 0-9 left; the input's case stays (SC5)."""
    return collapse(F.regexp_replace(_col(c), r"[^a-z0-9\s]", ""))


def entity_name(c, lower: bool = True) -> Column:
    """The name a title gives: without brackets, up to the first comma, as tokens (SC2)."""
    c = _col(c)
    bare = strip_brackets(c)
    own = F.when(bare == "", c).otherwise(F.get(F.split(bare, ","), 0))
    return F.array_join(tokenize(F.lower(own) if lower else own), " ")


# The rules of the Penn Treebank's tokenizer, in order: pattern and what takes its place.
TREEBANK = (
    (r'^"', "`` "), (r'([ (\[{<])"', "$1 `` "), (r"\.\.\.", " ... "), (r"[,;:@#$%&]", " $0 "), (r"([^.])([.])([\])}>\"']*)\s*$", "$1 $2$3 "), (r"[?!]", " $0 "),
    (r"[\]\[(){}<>]", " $0 "), (r"--", " -- "), (r"^|$", " "), (r'"', " '' "), (r"([^'])' ", "$1 ' "), (r"'([sSmMdD]) ", " '$1 "),
    (r"('ll|'re|'ve|n't|'LL|'RE|'VE|N'T) ", " $1 "), (r" ([Cc])annot ", " $1an not "), (r" ([Dd])'ye ", " $1' ye "), (r" ([Gg])imme ", " $1im me "),
    (r" ([Gg])onna ", " $1on na "), (r" ([Gg])otta ", " $1ot ta "), (r" ([Ll])emme ", " $1em me "), (r" ([Mm])ore'n ", " $1ore 'n "),
    (r" '([Tt])is ", " '$1 is "), (r" '([Tt])was ", " '$1 was "), (r" ([Ww])anna ", " $1an na "),
)


def treebank(c) -> Column:
    """Tokens by the Treebank's rules: punctuation, quotes and contractions apart, the last full stop too (SC9)."""
    c = _col(c)
    for pattern, said in TREEBANK:
        c = F.regexp_replace(c, pattern, said)
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def full_match(c, pattern: str) -> Column:
    """Whether the first way that a pattern matches at the start takes the whole text (SC13)."""
    c, begins = _col(c), f"^(?:{pattern})"
    return F.rlike(c, F.lit(begins)) & (F.length(F.regexp_extract(c, begins, 0)) == F.length(c))


def sentences(c) -> Column:
    """Stretches up to sentence marks or line ends (SC8)."""
    found = F.transform(F.regexp_extract_all(_col(c), F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s))
    return F.filter(found, lambda s: s != "")


def normalize_answer(c) -> Column:
    """Lower case without ASCII punctuation and articles (SC26)."""
    bare = F.regexp_replace(F.lower(_col(c)), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, ARTICLES, " "))


def unquote(c) -> Column:
    """URL decoding that keeps plus signs; bad escapes leave the text as it is (Q8)."""
    c = _col(c)
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def links(c) -> Column:
    """Anchors of a text: raw tag, decoded target, shown text, in order (SC6)."""
    c = _col(c)
    raw, href, shown = (F.regexp_extract_all(c, F.lit(LINK), F.lit(k)) for k in (0, 1, 2))
    return F.transform(F.arrays_zip(raw.alias("raw"), href.alias("href"), shown.alias("shown")), lambda x: F.struct(x["raw"].alias("raw"), collapse(unquote(x["href"])).alias("href"), x["shown"].alias("shown")))


def link_text(shown, name, lower_name) -> Column:
    """What replaces an anchor: the entity's name if the shown text ends it, else the shown text (SC7).

    The name is in lower case if the shown text has letters of lower case and no others; nothing stays nothing.
    """
    shown, name, lower_name = _col(shown), _col(name), _col(lower_name)
    fits = (shown != "") & F.endswith(lower_name, F.lower(shown))
    small = F.rlike(shown, F.lit(r"\p{IsLowercase}")) & ~F.rlike(shown, F.lit(r"[\p{IsUppercase}\p{Lt}]"))
    return F.when(~fits, shown).when(small, lower_name).otherwise(name)


def resolve_links(line, found) -> Column:
    """line with every raw anchor of found (raw, text) replaced."""
    return F.aggregate(_col(found), _col(line), lambda acc, x: F.replace(acc, x["raw"], x["text"]))


def reverse_path(tokens) -> Column:
    """A dependency path seen from its other end: reversed, i_ marks toggled (SC21)."""
    return F.transform(F.reverse(_col(tokens)), lambda t: F.when(F.startswith(t, F.lit("i_")), F.substring(t, 3, 1 << 20)).otherwise(F.concat(F.lit("i_"), t)))


def core_pattern(path) -> Column:
    """Path string to pattern: read from the subject, without appos and conj, chained prep once (SC22)."""
    path = _col(path)
    tokens = F.split(path, " ")
    tokens = F.when(F.contains(path, F.lit("i_nsubj")), tokens).otherwise(reverse_path(tokens))
    keep = lambda t, i: ~F.contains(t, F.lit("appos")) & ~F.contains(t, F.lit("conj")) & ~((t == "prep") & (i > 0) & F.coalesce(F.get(tokens, i - 1) == "prep", F.lit(False)))
    return F.array_join(F.filter(tokens, keep), " ")


def sub_pattern(path) -> Column:
    """Sub path string to pattern: the strings compound, conj and appos go (SC23)."""
    path = _col(path)
    for s in ("compound", "conj", "appos"):
        path = F.replace(path, F.lit(s), F.lit(""))
    return collapse(path)


def mark_spans(tokens, spans) -> Column:
    """Token array with <E1> and <E2> around the spans (start, end; end exclusive), as text (SC29)."""
    tokens, spans = _col(tokens), _col(spans)
    marks = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("<E"), (i + 1).cast("string"), F.lit(">")).alias("m")))
    around = lambda t, i: F.concat(F.array_join(F.transform(F.filter(marks, lambda m: m["start"] == i), lambda m: F.concat(m["m"], F.lit(" "))), ""), t, F.array_join(F.transform(F.filter(marks, lambda m: m["end"] == i + 1), lambda m: F.concat(F.lit(" "), m["m"])), ""))
    return F.array_join(F.transform(tokens, around), " ")


def nfd(c) -> Column:
    """Canonical decomposition (SC24); Spark has no built-in for it."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFD")

    return run(_col(c))
