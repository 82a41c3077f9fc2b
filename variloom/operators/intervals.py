"""Interval algebra on half-open, 0-based (seq, start, end) rows.

Overlap joins cut both sides into fixed-width bins and meet on (seq, bin), so a sequence that
holds most rows is spread over its bins; each pair is kept in the one bin that holds the
larger start.  ``width`` should be near the usual length of the intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_WIDTH = 1024


def merge(df: DataFrame) -> DataFrame:
    """Disjoint union per sequence; intervals that touch join."""
    ordered = Window.partitionBy("seq").orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.where("start < end").select("seq", "start", "end", F.when(F.col("start") <= before, 0).otherwise(1).alias("new_"))
    islands = flagged.withColumn("island_", F.sum("new_").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("seq", "island_").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("seq", "start", "end")


def _depths(*sides: DataFrame) -> DataFrame:
    """Elementary ranges (seq, start, end) with the number d0, d1, .. of intervals of each side over them."""
    events = None
    for i, side in enumerate(sides):
        for place, step in (("start", 1), ("end", -1)):
            part = side.where("start < end").select("seq", F.col(place).alias("pos"), *(F.lit(step if j == i else 0).alias(f"d{j}") for j in range(len(sides))))
            events = part if events is None else events.unionByName(part)
    names = [f"d{j}" for j in range(len(sides))]
    points = events.groupBy("seq", "pos").agg(*(F.sum(n).alias(n) for n in names))
    ordered = Window.partitionBy("seq").orderBy("pos")
    running = points.select("seq", F.col("pos").alias("start"), F.lead("pos").over(ordered).alias("end"), *(F.sum(n).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias(n) for n in names))
    return running.where("end is not null")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(a.select("seq", "start", "end").unionByName(b.select("seq", "start", "end")))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(_depths(a, b).where("d0 > 0 and d1 > 0"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(_depths(a, b).where("d0 > 0 and d1 = 0"))


def covered(df: DataFrame) -> DataFrame:
    """Covered length and number of merged regions per sequence."""
    return merge(df).groupBy("seq").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("covered"), F.count("*").alias("regions"))


def elementary(df: DataFrame, label: str, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Ranges between neighbouring breakpoints that some interval covers, with the sorted labels over each."""
    ranges = _depths(df).where("d0 > 0").select("seq", "start", "end")
    named = overlap_join(ranges, df.select("seq", "start", "end", F.col(label).alias("label_")), width)
    return named.groupBy("seq", "start", "end").agg(F.array_sort(F.collect_set("label_")).alias("labels"))


def bins(start: Column, end: Column, width: int) -> Column:
    """Numbers of the bins that [start, end) touches; an empty interval touches that of its start."""
    at = lambda x: F.floor(x / width).cast("long")
    return F.sequence(at(start), F.greatest(at(start), at(end - 1)))


def overlap_join(a: DataFrame, b: DataFrame, width: int = DEFAULT_WIDTH, how: str = "overlap") -> DataFrame:
    """Pairs of rows; columns of ``b`` but seq, start and end are joined, its places as b_start and b_end.

    ``how``: ``overlap``, or ``within`` (a lies in b).
    """
    left = a.withColumn("bin_", F.explode(bins(F.col("start"), F.col("end"), width)))
    right = b.withColumnsRenamed({"start": "b_start", "end": "b_end"}).withColumn("bin_", F.explode(bins(F.col("b_start"), F.col("b_end"), width)))
    met = left.join(right, ["seq", "bin_"])
    if how == "within":
        kept = (F.col("b_start") <= F.col("start")) & (F.col("end") <= F.col("b_end"))
    else:
        kept = (F.col("b_start") < F.col("end")) & (F.col("b_end") > F.col("start"))
    once = F.floor(F.greatest("start", "b_start") / width).cast("long") == F.col("bin_")
    return met.where(kept & once).drop("bin_")


def _member(a: DataFrame, b: DataFrame, width: int, how: str, kind: str) -> DataFrame:
    """Semi or anti join.  As ``b`` is merged first, an ``a`` that meets it within its own bins is found by those alone."""
    keys = ["seq", "start", "end"]
    regions = merge(b.select(*keys))
    spans = a.select(*keys).distinct()
    hits = overlap_join(spans, regions, width, how).select(*keys).distinct()
    return a.join(hits, keys, kind)


def keep_overlapping(a: DataFrame, b: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Rows of ``a`` that overlap some interval of ``b``."""
    return _member(a, b, width, "overlap", "left_semi")


def drop_enclosed(a: DataFrame, b: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Rows of ``a`` that don't lie within one merged interval of ``b``."""
    return _member(a, b, width, "within", "left_anti")


def annotate(a: DataFrame, b: DataFrame, label: str, into: str, whole: bool = True, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``a`` with the distinct labels, sorted, of all intervals over each row's span (or over its start alone)."""
    keys = ["seq", "start", "end"]
    spans = a.select(*keys).distinct()
    probe = spans if whole else spans.select("seq", "start", (F.col("start") + 1).alias("end")).distinct()
    labels = overlap_join(probe, b.select(*keys, F.col(label).alias("label_")), width).groupBy(*keys).agg(F.array_sort(F.collect_set("label_")).alias(into))
    if not whole:
        labels = labels.drop("end")
    return a.join(labels, ["seq", "start"] if not whole else keys, "left").withColumn(into, F.coalesce(into, F.array().cast(labels.schema[into].dataType)))


def tiles(lengths: DataFrame, width: int) -> DataFrame:
    """Windows of ``width`` over each (seq, length); the last may be shorter."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(width)))
    return lengths.where("length > 0").select("seq", "length", starts.alias("start")).select("seq", "start", F.least(F.col("start") + width, F.col("length")).alias("end"))


def as_of(a: DataFrame, b: DataFrame, value: str, offset: int = 0) -> DataFrame:
    """``a`` with the greatest ``value`` of ``b`` in its sequence that is at most start - ``offset``.

    Both sides are lined up by place and a running maximum carries the value on, so no pairs
    are made.
    """
    points = b.select("seq", F.col(value).alias("at_"), F.lit(0).alias("side_"), F.col(value).alias("point_"))
    probes = a.select("seq", (F.col("start") - offset).alias("at_"), F.lit(1).alias("side_"), F.lit(None).cast(b.schema[value].dataType).alias("point_")).distinct()
    ordered = Window.partitionBy("seq").orderBy("at_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    found = points.unionByName(probes).withColumn("found_", F.max("point_").over(ordered)).where("side_ = 1").select("seq", (F.col("at_") + offset).alias("start"), F.col("found_").alias("as_of"))
    return a.join(found, ["seq", "start"], "left")
