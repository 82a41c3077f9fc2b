"""Merging of records of several files, and set operations by position."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A

#: FORMAT and INFO fields tied to the ALTs, dropped when a merge changes those.
ALLELE_DEPENDENT = ("A", "R", "G")


def compare_positions(a: DataFrame, b: DataFrame, also: Iterable[str] = ()) -> DataFrame:
    """Counts of rows that are the same, different, or in one set only, by (seq, start).

    Rows at one place in both are the same if the ``also`` columns agree too; repeated rows
    meet many to many.
    """
    also = list(also)
    left = a.select("seq", "start", *(F.col(c).alias(f"a_{c}") for c in also), F.lit(True).alias("in_a"))
    right = b.select("seq", "start", *(F.col(c).alias(f"b_{c}") for c in also), F.lit(True).alias("in_b"))
    same = F.lit(True)
    for c in also:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    where = F.when(F.col("in_b").isNull(), "first_only").when(F.col("in_a").isNull(), "second_only").when(same, "same").otherwise("different")
    return left.join(right, ["seq", "start"], "full_outer").groupBy(where.alias("outcome")).agg(F.count("*").alias("n"))


def interleave(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge on (seq, start, end) and occurrence: a_row and b_row as structs."""
    from pyspark.sql import Window

    keys = ["seq", "start", "end"]

    def numbered(df: DataFrame, name: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        w = Window.partitionBy(*keys).orderBy(*rest) if rest else Window.partitionBy(*keys).orderBy("start")
        return df.withColumn("n_", F.row_number().over(w)).select(*keys, "n_", F.struct(*rest).alias(name) if rest else F.lit(True).alias(name))

    return numbered(a, "a_row").join(numbered(b, "b_row"), [*keys, "n_"], "full_outer").drop("n_")


def merge_records(records: DataFrame, padding_aware: bool = True, keep_alts_apart: bool = False) -> DataFrame:
    """Records of several files (column ``file``) that share place and REF span, as one.

    Columns: file, seq, start, ref, alts, id (array), qual, filters, samples (array of
    (sample, gt)).  QUAL and FILTER are the first file's, ids and ALTs are united in file
    order, genotypes are renumbered, a sample found twice keeps its first; ``changed`` tells
    that some file's ALTs differ from the union (fields that depend on them go).  With
    ``keep_alts_apart`` only records with equal ALTs merge.  A group holds what the files
    have at one place and so is as small as they are many.
    """
    pad = A.redundant_first_base(F.col("ref"), F.col("alts")) if padding_aware else F.lit(False)
    keys = ["seq", "start", "ref", "pad"] + (["alts_key"] if keep_alts_apart else [])
    df = records.withColumns({"ref": A.normalise_allele(F.col("ref")), "alts": F.transform("alts", A.normalise_allele)}).withColumn("pad", pad)
    if keep_alts_apart:
        df = df.withColumn("alts_key", F.array_join("alts", ","))
    grouped = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("file", "alts", "id", "qual", "filters", "samples"))).alias("r"))
    alts = F.array_distinct(F.flatten(F.transform("r", lambda r: r["alts"])))
    grouped = grouped.withColumn("all_alts", alts)

    def renumber(gt: Column, own: Column) -> Column:
        return F.transform(gt, lambda a: F.when(a <= 0, a).otherwise(F.array_position(F.col("all_alts"), F.get(own, a - 1)).cast("int")))

    samples = F.flatten(F.transform("r", lambda r: F.transform(r["samples"], lambda s: F.struct(s["sample"].alias("sample"), renumber(s["gt"], r["alts"]).alias("gt")))))
    grouped = grouped.withColumn("all_samples", samples)
    first_of = F.filter("all_samples", lambda s, i: ~F.exists(F.slice("all_samples", 1, i), lambda t: t["sample"] == s["sample"]))
    return grouped.select("seq", "start", "ref", F.col("all_alts").alias("alts"), F.array_distinct(F.flatten(F.transform("r", lambda r: r["id"]))).alias("id"), F.col("r")[0]["qual"].alias("qual"), F.col("r")[0]["filters"].alias("filters"), F.array_sort(first_of).alias("samples"), F.exists("r", lambda r: r["alts"] != F.col("all_alts")).alias("changed"))


def majority_genotype(df: DataFrame, by: Iterable[str], gt: str = "gt", share: float = 0.75) -> DataFrame:
    """The genotype (as a set of alleles) that more than ``share`` of the rows of a group call; else missing."""
    by = list(by)
    counts = df.groupBy(*by, F.array_sort(F.col(gt)).alias("g_")).agg(F.count("*").alias("n_"))
    best = counts.groupBy(*by).agg(F.max(F.struct("n_", "g_")).alias("b_"), F.sum("n_").alias("all_"))
    return best.select(*by, F.when(F.col("b_.n_") > share * F.col("all_"), F.col("b_.g_")).otherwise(F.transform(F.sequence(F.lit(1), F.size("b_.g_")), lambda _: F.lit(-1))).alias(gt))


def clean_alts(df: DataFrame, gts: str = "gts") -> DataFrame:
    """Records without ALTs that no genotype uses, their genotypes renumbered."""
    used = F.array_sort(F.array_distinct(F.filter(F.flatten(F.col(gts)), lambda a: a > 0)))
    df = df.withColumn("used_", used)
    fresh = lambda a: F.when(a <= 0, a).otherwise(F.array_position(F.col("used_"), a).cast("int"))
    return df.withColumns({"alts": F.filter("alts", lambda _, i: F.array_contains(F.col("used_"), i + 1)), gts: F.transform(F.col(gts), lambda g: F.transform(g, fresh))}).drop("used_")


def duplicate_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Names found more than once, with how often; exact, not by hash."""
    return df.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")


# ------------------------------------------------------------------ projections


def keep_samples(df: DataFrame, names: Iterable[str], known: Iterable[str], remove: bool = False) -> DataFrame:
    """Records with only (or without) the named samples; an unknown name is an error."""
    names = list(names)
    lost = sorted(set(names) - set(known))
    if lost:
        raise ValueError(f"no such sample: {', '.join(lost)}")
    return df.withColumn("samples", F.filter("samples", lambda s: ~s["sample"].isin(names) if remove else s["sample"].isin(names)))


def keep_info(df: DataFrame, keys: Iterable[str], remove: bool = False) -> DataFrame:
    keys = list(keys)
    return df.withColumn("info", F.map_filter("info", lambda k, _: ~k.isin(keys) if remove else k.isin(keys)))


def keep_format(df: DataFrame, keys: Iterable[str], remove: bool = False) -> DataFrame:
    """Only (or without) the named FORMAT fields; records left without any go."""
    keys = list(keys)
    test = lambda k: ~k.isin(keys) if remove else k.isin(keys)
    cut = df.withColumn("samples", F.transform("samples", lambda s: F.map_filter(s, lambda k, _: test(k))))
    return cut.where(F.exists("samples", lambda s: F.size(s) > 0))


def keep_filters(df: DataFrame, tags: Iterable[str], remove: bool = False) -> DataFrame:
    tags = list(tags)
    return df.withColumn("filters", F.filter("filters", lambda f: ~f.isin(tags) if remove else f.isin(tags)))


def clear_qual(df: DataFrame) -> DataFrame:
    return df.withColumn("qual", F.lit(None).cast("double"))


def clear_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.array().cast("array<string>"))


def rename_samples(df: DataFrame, names: dict[str, str]) -> DataFrame:
    if not names:
        return df
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return df.withColumn("samples", F.transform("samples", lambda s: s.withField("sample", F.coalesce(F.try_element_at(table, s["sample"]), s["sample"]))))


def split_samples(df: DataFrame, keep_ref: bool = False) -> DataFrame:
    """One row per record and sample with a valid, not missing genotype (a variant one unless ``keep_ref``); write partitioned by sample."""
    each = df.select("*", F.explode("samples").alias("s")).drop("samples").select("*", F.col("s.sample").alias("sample"), F.col("s.gt").alias("gt")).drop("s")
    good = A.is_valid(F.col("gt"), F.col("alts")) & ~A.is_missing(F.col("gt"))
    return each.where(good if keep_ref else good & A.is_variant(F.col("gt")))
