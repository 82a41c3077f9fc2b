"""Per-sample variant statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A

COUNTED = A.TYPES[1:8]


def calls(df: DataFrame) -> DataFrame:
    """One row per sample call of records (ref, alts, filters, samples: array of (sample, gt, phased)): ploidy class, type, transitions.

    A spanning deletion has a class but no type.
    """
    each = df.select("ref", "alts", F.explode("samples").alias("s")).select("ref", "alts", "s.sample", F.col("s.gt").alias("gt"), F.col("s.phased").alias("phased"))
    strings = A.unpadded(F.col("ref"), F.col("alts"))
    each = each.withColumn("strings", strings).where(A.is_valid(F.col("gt"), F.col("alts")))
    kind = F.when(A.is_missing(F.col("gt")), "missing").when(A.any_missing(F.col("gt")), "partial").when(~A.is_variant(F.col("gt")), "unchanged").otherwise("variant")
    trimmed = F.transform("gt", lambda a: A.trim_mnp(F.col("strings")[0], F.get("strings", a)))
    each = each.withColumn("kind", kind).withColumn("alleles", F.when(F.col("kind") == "variant", trimmed))
    each = each.withColumn("types", F.transform("alleles", lambda x: A.allele_type(x["ref"], x["alt"])))
    zygosity = F.when(F.size("gt") == 1, "haploid").when(F.size("gt") > 2, "polyploid").when(F.get(F.col("alleles"), F.lit(0))["alt"] == F.get(F.col("alleles"), F.lit(1))["alt"], "hom").otherwise("het")
    each = each.withColumns({"zygosity": F.when(F.col("kind") == "variant", zygosity), "type": A.precedence(F.col("types"))})
    snps = F.filter("alleles", lambda x, i: F.get(F.col("types"), i) == "SNP")
    transition = lambda x: F.concat(x["ref"], x["alt"]).isin("AG", "GA", "CT", "TC")
    single = F.col("type") == "SNP"
    return each.withColumns({"transitions": F.when(single, F.size(F.filter(snps, transition))).otherwise(0), "transversions": F.when(single, F.size(F.filter(snps, lambda x: ~transition(x)))).otherwise(0)})


def per_sample(df: DataFrame) -> DataFrame:
    """Counts of every sample: missing, partial, unchanged, phased, each zygosity and type, transitions and transversions."""
    c = calls(df)
    n = lambda cond: F.count_if(cond).alias
    kinds = [n(F.col("kind") == k)(k) for k in ("missing", "unchanged", "variant")]
    kinds.append(n((F.col("kind") == "partial") | (F.col("type") == "SV_MISSING"))("partial"))
    zygosities = [n(F.col("zygosity") == z)(z) for z in ("het", "hom", "haploid", "polyploid")]
    types = [n(F.col("type") == t)(t.lower()) for t in COUNTED]
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in ("transitions", "transversions")]
    return c.groupBy("sample").agg(*kinds, n(F.col("phased"))("phased"), *zygosities, *types, *sums)


def by_zygosity(df: DataFrame) -> DataFrame:
    """Counts per sample, zygosity and type (a row for each pair), pivoted by zygosity."""
    c = calls(df).where("kind = 'variant' and type != 'SV_MISSING'")
    return c.groupBy("sample", "type").pivot("zygosity", ["het", "hom", "haploid", "polyploid"]).count().na.fill(0)


def ratio(part: Column, whole: Column) -> Column:
    """Text ``x.xx (part/whole)``, or ``-`` when the whole is nothing."""
    return F.when(whole == 0, F.lit("-")).otherwise(F.concat(F.format_string("%.2f", part / whole), F.lit(" ("), part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(")")))


def with_ratios(stats: DataFrame) -> DataFrame:
    """The usual ratios beside the counts of ``per_sample``."""
    c = F.col
    return stats.select("*", ratio(c("transitions"), c("transversions")).alias("titv"), ratio(c("het"), c("hom")).alias("het_hom"), ratio(c("insertion"), c("deletion")).alias("ins_del"), ratio(c("insertion") + c("deletion") + c("indel"), c("snp") + c("mnp")).alias("indel_snp"))


def record_counts(df: DataFrame, filtered: Column) -> DataFrame:
    """Records that are filtered, pass, and have no genotype."""
    return df.agg(F.count_if(filtered).alias("filtered"), F.count_if(~filtered).alias("passed"), F.count_if(~filtered & (F.size("samples") == 0)).alias("no_genotype"))


def length_bin(length: Column) -> Column:
    """Start of the bin: single lengths below 100, then in steps that grow a hundredfold each hundred steps."""
    return F.when(length < 100, length).when(length < 10_000, F.floor(length / 100) * 100).when(length < 1_000_000, F.floor(length / 10_000) * 10_000).otherwise(F.floor(length / 1_000_000) * 1_000_000).cast("long")


def length_histogram(df: DataFrame) -> DataFrame:
    """Allele lengths by type: of the allele for substitutions, of the change for indels."""
    c = calls(df).where("kind = 'variant'").select(F.explode(F.arrays_zip("alleles", "types")).alias("x")).select("x.alleles.*", F.col("x.types").alias("type"))
    c = c.where(~F.col("type").startswith("SV_") & (F.col("type") != "UNCHANGED"))
    size = F.when(F.col("type").isin(*A.INDEL_TYPES), F.abs(F.length("alt") - F.length("ref"))).otherwise(F.length("alt"))
    return c.groupBy("type", length_bin(size).alias("length")).agg(F.count("*").alias("n"))


def allele_count_histogram(df: DataFrame) -> DataFrame:
    """Records by how many different alleles their samples call."""
    called = F.array_distinct(F.filter(F.flatten(F.transform("samples", lambda s: s["gt"])), lambda a: a >= 0))
    return df.groupBy(F.size(called).alias("alleles")).agg(F.count("*").alias("n"))
