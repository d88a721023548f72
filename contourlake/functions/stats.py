"""Statistics as column expressions. NULL is what cannot be computed; NaN does not occur inside the engine."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.95996


def no_nan(x: Column) -> Column:
    """NULL for NaN: apply at ingestion, since Spark sorts NaN above all numbers."""
    return F.when(~F.isnan(x), x)


def at_least(x: Column, threshold: Column | float) -> Column:
    """x >= threshold, and false where x is missing or NaN."""
    return F.coalesce(~F.isnan(x.cast("double")) & (x >= threshold), F.lit(False))


def at_most_or_missing(x: Column, threshold: Column | float) -> Column:
    """A ceiling that a missing control passes; what misses it is for the evidence check to say."""
    return x.isNull() | F.isnan(x.cast("double")) | (x <= threshold)


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x within the limits; greatest and least alone would make a limit of NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation as an aggregate over rows that have both; NULL without spread."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def rounded(x: Column, digits: int = 4) -> Column:
    return F.round(no_nan(x), digits)


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """Struct of the share and the limits of its Wilson interval, within 0 and 1; NULLs for n = 0."""
    p = share(k, n)
    d = 1 + F.lit(z * z) / n
    mid = (p + F.lit(z * z) / (2 * n)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z) / (4 * n * n)) / d
    some = n > 0
    return F.struct(F.when(some, p).alias("p"), F.when(some, F.greatest(F.lit(0.0), mid - half)).alias("lo"), F.when(some, F.least(F.lit(1.0), mid + half)).alias("hi"))


#: What Stirling's formula lacks of log n!, for n below 16.
STIRLING_GAP = tuple(math.lgamma(n + 1) - (n * math.log(n) - n + 0.5 * math.log(2 * math.pi * n) if n else 0.0) for n in range(16))


def _gap(n: Column) -> Column:
    """What Stirling's formula lacks of log n!."""
    x = F.greatest(n, F.lit(16)).cast("double")
    series = F.lit(1 / 12) / x - F.lit(1 / 360) / F.pow(x, 3) + F.lit(1 / 1260) / F.pow(x, 5)
    return F.when(n < 16, F.element_at(F.array(*map(F.lit, STIRLING_GAP)), F.least(n, F.lit(15)).cast("int") + 1)).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x log(x / mean) + mean - x, without loss of digits where x is close to the mean."""
    return x * F.log1p((x - mean) / mean) + mean - x


def binom_half_pmf(k: Column, n: Column) -> Column:
    """Probability of k heads in n > 0 throws."""
    x, m = k.cast("double"), n.cast("double")
    inner = _gap(n) - _gap(k) - _gap(n - k) - _deviance(x, m / 2) - _deviance(m - x, m / 2) + F.log(m / (F.lit(2 * math.pi) * x * (m - x))) / 2
    return F.when((k == 0) | (k == n), F.exp(-m * F.lit(math.log(2)))).otherwise(F.exp(inner))


def binom_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided test of k in n against one half: twice the smaller tail, at most 1; NULL for n = 0.

    The tail is summed downwards, each term from the one before. Terms beyond
    seven times the root of n from the first are below 1e-40 of it and left
    out, so the work is the root of the trials.
    """
    tail = F.least(k, n - k)
    m = n.cast("double")
    steps = F.least(tail, F.ceil(7 * F.sqrt(m)) + 64).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * (tail - j + 1).cast("double") / (m - tail + j)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    each = F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    p = 2 * binom_half_pmf(tail, n) * F.aggregate(each, start, step, lambda acc: acc["sum"])
    return F.when(n > 0, F.when(2 * k == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p)))


def sign_test(wins: Column, losses: Column) -> Column:
    """Ties are out before."""
    return binom_two_sided(wins, wins + losses)


def kappa(agree: Column, chance: Column) -> Column:
    """Cohen's kappa from observed and expected agreement; full expected agreement gives 1 or 0."""
    return F.when(chance >= 1, F.when(agree >= 1, 1.0).otherwise(0.0)).otherwise((agree - chance) / (1 - chance))


def semitone(hz: Column, reference: float = 100.0) -> Column:
    return F.when(hz.isNotNull(), F.lit(12.0) * F.log2(F.greatest(hz, F.lit(1e-6)) / F.lit(reference)))


def len_ratio(dur: Column, text: Column, per_char: float = 0.157) -> Column:
    return F.when(text.isNotNull(), dur / F.greatest(F.lit(per_char) * F.length(text), F.lit(1e-6)))


def expected_dur(text: Column, per_char: float = 0.157) -> Column:
    return F.greatest(F.lit(0.3), F.lit(per_char) * F.length(text))


def length_ok(dur: Column, text: Column, per_char: float = 0.157) -> Column:
    e = expected_dur(text, per_char)
    return dur.between(0.6 * e, 1.6 * e)


def training_steps(clips: Column, epochs: int, clips_per_step: float) -> Column:
    """At least 50; halves go to the even number."""
    return F.greatest(F.lit(50), F.bround(epochs * clips / F.lit(clips_per_step)).cast("int"))


def hash_number(*parts: Column) -> Column:
    """A number below 2**32 from an MD5 over the parts: the engine's deterministic randomness."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")
