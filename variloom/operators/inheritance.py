"""Inheritance checks on trios: rows with father, mother and child genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A
from . import intervals

#: What a parent's genotype says about an allele.
NO, MAYBE, YES = 0, 1, 2


def contains(gt: Column, allele: Column) -> Column:
    """YES, NO, or MAYBE where the allele or part of the genotype is missing."""
    return F.when(allele < 0, MAYBE).when(F.array_contains(gt, allele), YES).when(A.any_missing(gt), MAYBE).otherwise(NO)


def _diploid(father: Column, mother: Column, child: Column) -> Column:
    f1, f2 = contains(father, child[0]), contains(father, child[1])
    m1, m2 = contains(mother, child[0]), contains(mother, child[1])
    partial = A.any_missing(father) | A.any_missing(mother)
    one_no = F.least(f1, m1) == NO
    hom = (
        F.when((f1 == MAYBE) & (m1 == MAYBE), "incomplete_unknown")
        .when((f1 == MAYBE) | (m1 == MAYBE), F.when(one_no, "incomplete_inconsistent").otherwise("incomplete_unknown"))
        .when(partial, F.when((f1 == YES) & (m1 == YES), "incomplete_consistent").otherwise("incomplete_inconsistent"))
        .when((f1 == YES) & (m1 == YES), "consistent")
        .otherwise("inconsistent")
    )
    either = ((f1 == YES) & (m2 == YES)) | ((m1 == YES) & (f2 == YES))
    none = ((f1 == NO) & (f2 == NO)) | ((m1 == NO) & (m2 == NO)) | ((f1 == NO) & (m1 == NO)) | ((f2 == NO) & (m2 == NO))
    sure = (f1 != MAYBE) & (f2 != MAYBE) & (m1 != MAYBE) & (m2 != MAYBE)
    het = F.when(sure, F.when(either, "consistent").otherwise("inconsistent")).when(none, "incomplete_inconsistent").when(either, "incomplete_consistent").otherwise("incomplete_unknown")
    return F.when(child[0] == child[1], F.when(child[0] < 0, "incomplete_unknown").otherwise(hom)).otherwise(het)


def _haploid(father: Column, mother: Column, child: Column) -> Column:
    f, m = contains(father, child[0]), contains(mother, child[0])

    def of(parent: Column, state: Column) -> Column:
        return F.when(state == MAYBE, "incomplete_unknown").when(state == NO, "inconsistent").when(A.any_missing(parent), "incomplete_consistent").otherwise("consistent")

    return (
        F.when(child[0] < 0, "incomplete_unknown")
        .when(F.size(mother) > 1, of(mother, m))
        .when(F.size(father) > 1, of(father, f))
        .when(m == MAYBE, F.when(f == MAYBE, "incomplete_unknown").when(f == YES, "consistent").otherwise("inconsistent"))
        .when(f == MAYBE, "inconsistent")
        .when((f == NO) & (m == NO), "inconsistent")
        .otherwise("consistent")
    )


def trio_status(father: Column, mother: Column, child: Column) -> Column:
    """consistent, inconsistent, or incomplete_ with consistent, inconsistent or unknown; null for other ploidies of the child."""
    return F.when(F.size(child) == 1, _haploid(father, mother, child)).when(F.size(child) == 2, _diploid(father, mother, child))


def check_trios(df: DataFrame) -> DataFrame:
    """Rows whose child is called and in which some genotype varies, with ``status``."""
    some = A.is_variant(F.col("father")) | A.is_variant(F.col("mother")) | A.is_variant(F.col("child"))
    return df.where(~A.is_missing(F.col("child")) & some).withColumn("status", trio_status(F.col("father"), F.col("mother"), F.col("child")))


def route(df: DataFrame, by: str = "row_id") -> DataFrame:
    """The worst status per record: inconsistent if any trio is, then incomplete, else consistent."""
    rank = F.when(F.col("status") == "inconsistent", 2).when(F.col("status").startswith("incomplete"), 1).otherwise(0)
    return df.groupBy(by).agg(F.max(rank).alias("r_")).select(by, F.when(F.col("r_") == 2, "inconsistent").when(F.col("r_") == 1, "incomplete").otherwise("consistent").alias("outcome"))


def ploidy_expected(df: DataFrame, ploidies: DataFrame, width: int = intervals.DEFAULT_WIDTH) -> DataFrame:
    """``df`` (seq, start, end, sex, ..) with the ploidy expected at each record's middle; ``ploidies``: (sex, seq, start, end, ploidy)."""
    middle = ((F.col("start") + F.col("end")) / 2).cast("int")
    places = df.select("seq", "sex", middle.alias("start"), (middle + 1).alias("end")).distinct()
    table = ploidies.select("seq", F.col("sex").alias("sex_"), "start", "end", "ploidy")
    met = intervals.overlap_join(places, table, width).where("sex = sex_").groupBy("seq", "sex", F.col("start").alias("middle_")).agg(F.min("ploidy").alias("expected"))
    return df.withColumn("middle_", middle).join(met, ["seq", "sex", "middle_"], "left").drop("middle_")


def ploidy_ok(gt: Column, expected: Column, lenient: bool = False) -> Column:
    """A call of the expected ploidy; leniently, a homozygous diploid stands for a haploid."""
    exact = F.size(gt) == expected
    return exact | ((expected == 1) & (F.size(gt) == 2) & (gt[0] == gt[1])) if lenient else exact


def phase_child(father: Column, mother: Column, child: Column) -> Column:
    """Child genotype (paternal, maternal) where only one order fits the parents; a homozygous one always; else null."""
    a, b = child[0], child[1]
    fits = lambda p, q: (contains(father, p) == YES) & (contains(mother, q) == YES)
    one, other = fits(a, b), fits(b, a)
    return F.when((F.size(child) == 2) & ~A.any_missing(child), F.when(a == b, F.array(a, b)).when(one & ~other, F.array(a, b)).when(other & ~one, F.array(b, a)))


def genotype_proportions(df: DataFrame, canonical: bool = False, diploid_only: bool = False, biallelic_only: bool = False) -> DataFrame:
    """Counts of child genotypes by the sorted pair of parents' genotypes, with the pair's total.

    ``canonical`` renames alleles in order of first appearance over the parents.
    """
    text = lambda g: A.join_gt(F.array_sort(g), F.lit(False))
    if diploid_only:
        df = df.where((F.size("father") == 2) & (F.size("mother") == 2) & (F.size("child") == 2))
    every = F.concat("father", "mother", "child")
    if biallelic_only:
        df = df.where(~F.exists(every, lambda a: a > 1))
    df = df.where(~F.exists(every, lambda a: a < 0))
    if canonical:
        seen = F.array_distinct(F.concat(F.array(F.lit(0)), F.filter(F.flatten(F.array_sort(F.array(F.array_sort("father"), F.array_sort("mother")))), lambda a: a > 0), F.filter("child", lambda a: a > 0)))
        df = df.withColumn("seen_", seen)
        for who in ("father", "mother", "child"):
            df = df.withColumn(who, F.transform(who, lambda a: (F.array_position(F.col("seen_"), a) - 1).cast("int")))
    pair = F.array_sort(F.array(text(F.col("father")), text(F.col("mother"))))
    counts = df.groupBy(pair[0].alias("parent_a"), pair[1].alias("parent_b"), text(F.col("child")).alias("child_gt")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("parent_a", "parent_b").agg(F.sum("n").alias("total"))
    return counts.join(totals, ["parent_a", "parent_b"])


def pair_relation(parent: Column, child: Column) -> Column:
    """ignored, unrelated, parent or same, of two complete diploid genotypes."""
    usable = (F.size(parent) == 2) & (F.size(child) == 2) & ~A.any_missing(parent) & ~A.any_missing(child)
    related = F.array_contains(parent, child[0]) | F.array_contains(parent, child[1])
    return F.when(~usable, "ignored").when(parent == child, "same").when(related, "parent").otherwise("unrelated")


def concordance(df: DataFrame, by: tuple[str, ...] = ("trio",), least_variants: int = 2000, least_percent: float = 99.0) -> DataFrame:
    """Per trio: counts of each relation to father and mother, consistent and inconsistent trios, and who disagrees."""
    f, m = pair_relation(F.col("father"), F.col("child")), pair_relation(F.col("mother"), F.col("child"))
    status = trio_status(F.col("father"), F.col("mother"), F.col("child"))
    kinds = ("ignored", "unrelated", "parent", "same")
    counted = df.select(*by, f.alias("f"), m.alias("m"), status.alias("s")).groupBy(*by).agg(
        *(F.count_if(F.col(p) == k).alias(f"{n}_{k}") for p, n in (("f", "father"), ("m", "mother")) for k in kinds),
        F.count_if(F.col("s") == "consistent").alias("trio_consistent"), F.count_if(F.col("s") == "inconsistent").alias("trio_inconsistent"),
    )

    def bad(good: Column, size: Column) -> Column:
        return (size >= least_variants) & (good / F.greatest(size, F.lit(1)) * 100 < least_percent)

    side = lambda n: bad(F.col(f"{n}_parent") + F.col(f"{n}_same"), F.col(f"{n}_parent") + F.col(f"{n}_same") + F.col(f"{n}_unrelated"))
    dad, mum = side("father"), side("mother")
    trio = bad(F.col("trio_consistent"), F.col("trio_consistent") + F.col("trio_inconsistent")) | (dad & mum)
    return counted.withColumn("verdict", F.when(dad & ~mum, "father").when(mum & ~dad, "mother").when(trio, "both").otherwise("ok"))
