"""Scores as column expressions. Zero denominators give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def harmonic(a, b) -> Column:
    """2 / (1/a + 1/b) (SC16)."""
    a, b = _col(a), _col(b)
    return F.try_divide(F.lit(2.0), F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b))


def harmonic_mean(values) -> Column:
    """Harmonic mean of an array (SC17, TK2)."""
    values = _col(values)
    return F.try_divide(F.size(values).cast("double"), F.aggregate(values, F.lit(0.0), lambda a, x: a + F.try_divide(F.lit(1.0), x)))


def pattern_freq(count, most) -> Column:
    """ln(count + 1) / ln(most + 1); unseen patterns count one half (SC15)."""
    seen = F.when(_col(count) > 0, _col(count)).otherwise(F.lit(0.5))
    return F.try_divide(F.ln(seen + 1), F.ln(_col(most) + 1))


def keyword_recall(keyword, full) -> Column:
    """ln(words + 0.5) of the keyword over that of the full name; words are spaces and one (SC14)."""
    words = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1
    return F.try_divide(F.ln(words(_col(keyword)) + 0.5), F.ln(words(_col(full)) + 0.5))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def unit(v) -> Column:
    """A vector over its length; a zero vector stays (SC18, SC19)."""
    n = norm(v)
    return F.transform(_col(v), lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a, b) -> Column:
    """Cosine; 0 if a vector is zero (SC20)."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def retriever_score(a, b) -> Column:
    """Inner product over the root of the dimension (ML4)."""
    return dot(a, b) / F.sqrt(F.size(_col(a)))


def warmup_linear(step, warmup: int, total: int, least: float = 0.0) -> Column:
    """Learning-rate factor: up linearly, then down to ``least`` (SC32)."""
    step = _col(step).cast("double")
    down = F.greatest(F.lit(0.0), F.lit(1.0) + (F.lit(least) - 1.0) * (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup))) * (1 - least) + least).otherwise(down)
