"""Sequence sets and reads: statistics, trimming, subsets, interleaving.

Rows: seq_id, name, residues, quals (array of phred ints, or null), arm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A


def residue_counts(df: DataFrame, residues: str = "ACGTN") -> DataFrame:
    """One row: sequences, total, least and most length, and the count of each residue."""
    n = F.length("residues")
    each = [F.sum(n - F.length(F.translate(F.upper("residues"), r, ""))).alias(r.lower()) for r in residues]
    return df.agg(F.count("*").alias("sequences"), F.sum(n).cast("long").alias("total"), F.min(n).alias("shortest"), F.max(n).alias("longest"), *each)


def n_blocks(df: DataFrame) -> DataFrame:
    """(length, n): runs of N by length."""
    return df.select(F.explode(F.regexp_extract_all("residues", F.lit("[Nn]+"), F.lit(0))).alias("run")).groupBy(F.length("run").alias("length")).agg(F.count("*").alias("n"))


def n_by_position(df: DataFrame) -> DataFrame:
    """(position, n): how many sequences have an N there."""
    each = df.select(F.posexplode(F.filter(F.split(F.upper("residues"), ""), lambda c: c != "")).alias("position", "c"))
    return each.groupBy("position").agg(F.count_if(F.col("c") == "N").alias("n"), F.count("*").alias("of"))


def mean_quality(df: DataFrame) -> DataFrame:
    """Phred of the mean error probability over all bases."""
    p = df.select(F.explode("quals").alias("q")).agg(F.avg(F.pow(F.lit(10.0), -F.col("q") / 10)).alias("p"))
    return p.select((-10 * F.log10("p")).alias("quality"))


def quality_by_position(df: DataFrame) -> DataFrame:
    each = df.select(F.posexplode("quals").alias("position", "q"))
    return each.groupBy("position").agg((-10 * F.log10(F.avg(F.pow(F.lit(10.0), -F.col("q") / 10)))).alias("quality"), F.count("*").alias("n"))


# ------------------------------------------------------------------ trimming: each takes and gives a struct (residues, quals)


def _cut(read: Column, start: Column, length: Column) -> Column:
    length = F.greatest(length, F.lit(0))
    return F.struct(read["residues"].substr(start + 1, length).alias("residues"), F.slice(read["quals"], start + 1, length).alias("quals"))


def drop_first(n: int):
    return lambda read: _cut(read, F.lit(n), F.length(read["residues"]) - n)


def drop_last(n: int):
    return lambda read: _cut(read, F.lit(0), F.length(read["residues"]) - n)


def _best_sum(quals: Column, threshold: int) -> Column:
    """Bases to keep, from the front, of qualities whose bad ones stand at the back: where the sum of (threshold - quality) from the back is largest.

    Only if the last quality is below the threshold; of equal sums the longest trim.
    """
    back = F.reverse(quals)
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("best"), F.lit(0).alias("cut"), F.lit(0).alias("i"), F.lit(True).alias("on"))

    def step(acc: Column, q: Column) -> Column:
        total = acc["sum"] + threshold - q
        on = acc["on"] & (total >= 0)
        better = on & (total >= acc["best"])
        return F.struct(total.alias("sum"), F.when(better, total).otherwise(acc["best"]).alias("best"), F.when(better, acc["i"] + 1).otherwise(acc["cut"]).alias("cut"), (acc["i"] + 1).alias("i"), on.alias("on"))

    cut = F.aggregate(back, start, step)["cut"]
    return F.size(quals) - F.when(F.coalesce(F.get(back, F.lit(0)) < threshold, F.lit(False)), cut).otherwise(0)


def trim_end_quality(threshold: int):
    return lambda read: _cut(read, F.lit(0), _best_sum(read["quals"], threshold))


def trim_start_quality(threshold: int):
    def run(read: Column) -> Column:
        kept = _best_sum(F.reverse(read["quals"]), threshold)
        return _cut(read, F.length(read["residues"]) - kept, kept)

    return run


def least_length(n: int):
    return lambda read: F.when(F.length(read["residues"]) < n, _cut(read, F.lit(0), F.lit(0))).otherwise(read)


def reverse_complement():
    return lambda read: F.struct(A.reverse_complement(read["residues"]).alias("residues"), F.reverse(read["quals"]).alias("quals"))


def trim(df: DataFrame, first: int = 0, last: int = 0, start_quality: int = 0, end_quality: int = 0, min_length: int = 0, revcomp: bool = False, discard_empty: bool = False, subsample: float | None = None, seed: int = 1) -> DataFrame:
    """The trims in their fixed order: first, last, start quality, end quality, least length, reverse complement."""
    read = F.struct(F.col("residues"), F.col("quals"))
    steps = [(first, drop_first), (last, drop_last), (start_quality, trim_start_quality), (end_quality, trim_end_quality), (min_length, least_length)]
    out = df.withColumn("read_", read)
    for n, make in steps:
        if n:
            out = out.withColumn("read_", make(n)(F.col("read_")))
    if revcomp:
        out = out.withColumn("read_", reverse_complement()(F.col("read_")))
    out = out.withColumns({"residues": F.col("read_.residues"), "quals": F.col("read_.quals")}).drop("read_")
    if discard_empty:
        out = out.where(F.length("residues") > 0)
    return out.where(F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(1 << 20)) < int(subsample * (1 << 20))) if subsample is not None else out


def mask_lower(residues: Column) -> Column:
    """Dust: lower-case residues as N."""
    return F.regexp_replace(residues, "[a-z]", "N")


def subsequence(residues: Column, start: Column, end: Column, pad: str | None = None) -> Column:
    """[start, end) of a sequence; places outside are left out, or padded."""
    inside = residues.substr(F.greatest(start, F.lit(0)) + 1, F.greatest(end - F.greatest(start, F.lit(0)), F.lit(0)))
    if pad is None:
        return inside
    fill = lambda n: F.repeat(F.lit(pad), F.greatest(n, F.lit(0)))
    before = F.least(-start, end - start)
    return F.concat(fill(before), inside, fill(end - start - F.length(inside) - F.greatest(before, F.lit(0))))


def interleave(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of two arms, met on seq_id, as alternating rows with ``place`` in order."""
    met = left.select("seq_id", F.struct(*(c for c in left.columns if c != "seq_id")).alias("l")).join(right.select("seq_id", F.struct(*(c for c in right.columns if c != "seq_id")).alias("r")), "seq_id")
    return met.select("seq_id", F.posexplode(F.array("l", "r")).alias("side", "read")).select((2 * F.col("seq_id") + F.col("side")).alias("place"), "seq_id", "read.*")


def deinterleave(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left and right arms of alternating rows (column ``place``)."""
    own = df.withColumn("seq_id", F.floor(F.col("place") / 2).cast("long"))
    return tuple(own.where(F.col("place") % 2 == side).drop("place") for side in (0, 1))


def dedup_names(df: DataFrame) -> DataFrame:
    """The first row of each name and arm."""
    return df.groupBy("name", "arm").agg(F.min_by(F.struct(*df.columns), "seq_id").alias("r_")).select("r_.*")
