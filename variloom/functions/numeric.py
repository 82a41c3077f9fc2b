"""Numeric helpers as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = math.log(10)


def phred_to_error(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def error_to_phred(p: Column) -> Column:
    return -10 * F.log10(p)


def posterior(gq: Column) -> Column:
    """log10 odds of a call from its phred quality."""
    return F.log(F.pow(F.lit(10.0), gq / 10) - 1) / LN10


def solexa_to_phred(code: Column) -> Column:
    """Phred value of a solexa quality character code."""
    return F.floor(10 * F.log10(1 + F.pow(F.lit(10.0), (code - 64) / 10)) + 0.5).cast("int")


def round_half_up(x: Column, digits: int = 0) -> Column:
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def string_hash(text: Column, seed: int = 0) -> Column:
    """Base-31 hash of the characters over a seed, its low 16 bits; for sampling by name."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(seed).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFF))


def log_binomial(n: Column, k: Column) -> Column:
    """ln of n over k, summed term by term."""
    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.log((n - k + i) / i))


def hoeffding_ln(n: Column, observed: Column, p: Column) -> Column:
    return F.when(n > 0, -2 * F.pow(n * p - observed, F.lit(2)) / n)


def chi_squared(observed: Column, expected: Column) -> Column:
    """Pearson's statistic of two arrays; cells that expect nothing are left out."""
    terms = F.zip_with(observed, expected, lambda o, e: F.when(e > 0, (o - e) * (o - e) / e).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
