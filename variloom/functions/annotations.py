"""Derived annotations of records and samples as Column builders, with a registry by name.

Record annotations take (ref, alts, gts, ...): ``gts`` is an array of genotypes.  Sample
annotations take one genotype and its fields.  Null means that the annotation isn't given.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alleles import any_missing, is_het, is_missing


def _diploid(gts: Column) -> Column:
    return F.filter(gts, lambda g: F.size(g) == 2)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _het_count(gts: Column) -> Column:
    return F.size(F.filter(_diploid(gts), lambda g: g[0] != g[1]))


def expected_het(alts: Column, gts: Column) -> Column:
    """Probability of a heterozygous call under equilibrium; missing alleles count as reference."""
    calls = F.transform(F.flatten(_diploid(gts)), lambda a: F.greatest(a, F.lit(0)))
    share = lambda i: F.size(F.filter(calls, lambda a: a == i)) / F.size(calls)
    # 2 * sum over pairs of p q is one less the sum of squares.
    return 1 - _sum(F.transform(F.sequence(F.lit(0), F.size(alts)), lambda i: share(i) * share(i)))


def inbreeding_coefficient(alts: Column, gts: Column) -> Column:
    n, e = F.size(_diploid(gts)), expected_het(alts, gts)
    return F.when((n > 0) & (e > 1e-12), 1 - _het_count(gts) / (n * e))


def equilibrium(alts: Column, gts: Column) -> Column:
    """Phred of Hoeffding's bound on the heterozygous count."""
    n, e = F.size(_diploid(gts)), expected_het(alts, gts)
    return F.when(n > 0, F.lit(20 / math.log(10)) * F.pow(n * e - _het_count(gts), F.lit(2)) / n)


def longest_allele(ref: Column, alts: Column) -> Column:
    return F.array_max(F.transform(F.concat(F.array(ref), alts), lambda a: F.length(a)))


def _per_depth(value: Column, depth: Column) -> Column:
    return F.when(depth <= 0, F.lit(math.inf)).otherwise(value / depth)


def qual_over_depth(qual: Column, info_dp: Column, dps: Column) -> Column:
    """QUAL by INFO depth, else by the sum of the samples' depths."""
    known = F.filter(dps, lambda d: d.isNotNull())
    total = F.when(F.size(dps) > 0, F.aggregate(known, F.lit(0), lambda a, b: a + b))
    return F.when(qual.isNotNull(), _per_depth(qual, F.coalesce(info_dp, total)))


def n_alts(alts: Column) -> Column:
    return F.size(alts)


def allele_counts(alts: Column, gts: Column) -> Column:
    """Calls of each ALT over all samples; null without ALT."""
    calls = F.flatten(gts)
    return F.when(F.size(alts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(alts), F.lit(1))), lambda i: F.size(F.filter(calls, lambda a: a == i))))


def n_called(gts: Column) -> Column:
    return F.size(F.filter(F.flatten(gts), lambda a: a >= 0))


def gq_over_depth(gq: Column, dp: Column) -> Column:
    return F.when(gq.isNotNull() & dp.isNotNull(), _per_depth(gq, dp))


def allelic_fractions(ad: Column) -> Column:
    """Share of each ALT in the allelic depths; null with fewer than two alleles or no depth."""
    total = F.aggregate(ad, F.lit(0.0), lambda a, b: a + b)
    return F.when((F.size(ad) > 1) & (total > 0), F.transform(F.slice(ad, 2, F.greatest(F.size(ad) - 1, F.lit(1))), lambda d: d / total))


def largest_fraction(ad: Column) -> Column:
    return F.array_max(allelic_fractions(ad))


def zygosity(gt: Column) -> Column:
    return F.when(~any_missing(gt), F.when(is_het(gt), F.lit("e")).otherwise(F.lit("o")))


def ploidy(gt: Column) -> Column:
    return F.when(~any_missing(gt), F.when(F.size(gt) == 1, F.lit("h")).when(F.size(gt) == 2, F.lit("d")).otherwise(F.lit("p")))


def mean_quality_difference(gt: Column, ad: Column, aq: Column) -> Column:
    """Difference of mean allele qualities of a heterozygous call; signed only against the reference."""
    low, high = F.array_min(gt), F.array_max(gt)
    mean = lambda i: F.get(aq, i) / F.get(ad, i)
    usable = (F.size(gt) >= 2) & (gt[0] != gt[1]) & (low >= 0) & (F.get(ad, low) > 0) & (F.get(ad, high) > 0)
    diff = mean(low) - mean(high)
    return F.when(usable, F.when(low == 0, diff).otherwise(F.abs(diff)))


def alt_quality(aq: Column, va: Column) -> Column:
    return F.get(aq, va)


def ref_alt(gt: Column) -> Column:
    """RR, AA, RA or AB by the called alleles."""
    called = F.array_distinct(F.filter(gt, lambda a: a >= 0))
    alone = F.size(called) == 1
    return F.when(is_missing(gt), None).when(alone & (called[0] == 0), F.lit("RR")).when(alone, F.lit("AA")).when((F.size(called) == 2) & F.array_contains(called, 0), F.lit("RA")).otherwise(F.lit("AB"))


def contrary(derived: Column, originals: Column, ad_derived: Column, ad_originals: Column) -> Column:
    """Evidence against a somatic or de novo call: alleles that derived and original samples don't share.

    ``originals`` and ``ad_originals`` are arrays over the antecedents.  Gives counts and
    fractions of original reads with the derived alleles, and of derived reads with the
    original alleles that the call lacks.
    """
    mine = F.array_distinct(F.filter(derived, lambda a: a >= 0))
    theirs = F.array_distinct(F.filter(F.flatten(originals), lambda a: a >= 0))
    new, lost = F.array_except(mine, theirs), F.array_except(theirs, mine)
    total = lambda ad: F.aggregate(ad, F.lit(0), lambda a, b: a + b)
    at = lambda ad, alleles: F.aggregate(alleles, F.lit(0), lambda s, a: s + F.coalesce(F.get(ad, a), F.lit(0)))
    in_original = F.aggregate(F.transform(ad_originals, lambda ad: at(ad, new)), F.lit(0), lambda a, b: a + b)
    all_original = F.aggregate(F.transform(ad_originals, total), F.lit(0), lambda a, b: a + b)
    in_derived, all_derived = at(ad_derived, lost), total(ad_derived)
    share = lambda a, b: F.when(b > 0, a / b)
    return F.struct(in_derived.alias("derived_count"), share(in_derived, all_derived).alias("derived_share"), in_original.alias("original_count"), share(in_original, all_original).alias("original_share"))


def _repeat_run(template: Column, pos: Column, unit: int, most: int) -> Column:
    """(bases, -unit size, repeats, unit) of the run of one unit from a place."""
    first = template.substr(pos + 1, F.lit(unit))
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(run: Column, k: Column) -> Column:
        on = run["on"] & (template.substr(pos + 1 + k * unit, F.lit(unit)) == first)
        return F.struct((run["n"] + F.when(on, 1).otherwise(0)).alias("n"), on.alias("on"))

    n = F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), start, step)["n"]
    return F.struct((n * unit).alias("bases"), F.lit(-unit).alias("short"), n.alias("repeats"), first.alias("unit"))


def tandem_repeats(template: Column, pos: Column, most_unit: int = 3, most: int = 100) -> Column:
    """(repeats, unit) of the simple tandem repeat that runs on from 0-based ``pos``; the best unit of at most three bases."""
    best = F.array_max(F.array(*(_repeat_run(template, pos, unit, most) for unit in range(1, most_unit + 1))))
    return F.when(best["repeats"] > 1, F.struct(best["repeats"].alias("repeats"), best["unit"].alias("unit")))


#: Name -> (level, builder) of the derived annotations.
REGISTRY = {
    "IC": ("record", inbreeding_coefficient),
    "EP": ("record", equilibrium),
    "LAL": ("record", longest_allele),
    "QD": ("record", qual_over_depth),
    "NAA": ("record", n_alts),
    "AC": ("record", allele_counts),
    "AN": ("record", n_called),
    "GQD": ("sample", gq_over_depth),
    "VAF": ("sample", allelic_fractions),
    "VAF1": ("sample", largest_fraction),
    "ZY": ("sample", zygosity),
    "PD": ("sample", ploidy),
    "MEANQAD": ("sample", mean_quality_difference),
    "QA": ("sample", alt_quality),
    "RA": ("sample", ref_alt),
    "SCONT": ("sample", contrary),
}
