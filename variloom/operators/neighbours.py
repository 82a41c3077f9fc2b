"""Operators that look at the neighbours of a record in its sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals


def density_window(df: DataFrame, distance: int, pos: str = "pos") -> DataFrame:
    """Rows without another of their sequence within ``distance`` of their corrected place."""
    ordered = Window.partitionBy("seq").orderBy(pos, "start", "end")
    gap = lambda other: F.abs(other - F.col(pos)) <= distance
    marked = df.withColumns({"near_a": gap(F.lag(pos).over(ordered)), "near_b": gap(F.lead(pos).over(ordered))})
    return marked.where(~(F.coalesce("near_a", F.lit(False)) | F.coalesce("near_b", F.lit(False)))).drop("near_a", "near_b")


def unsorted(df: DataFrame, order: str) -> DataFrame:
    """Rows that start before the row that precedes them (by column ``order``) in their sequence."""
    w = Window.partitionBy("seq").orderBy(order)
    return df.withColumn("before_", F.lag("start").over(w)).where("start < before_").drop("before_")


def remove_overlapping(df: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Rows that don't start before the end of the last row kept before them.

    The choice depends on those before, so it is made row by row; but only within runs of rows
    that overlap in a chain, which never look at each other.  So runs, not whole sequences,
    are dealt out, and rows are streamed within a task.
    """
    ordered = Window.partitionBy("seq").orderBy("start", "end", *tie)
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    chained = df.withColumn("new_", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("run_", F.sum("new_").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")
    dealt = chained.repartition("seq", "run_").sortWithinPartitions("seq", "run_", "start", "end", *tie)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, end = None, 0
        for batch in batches:
            kept = []
            for seq, run, start, stop in zip(batch["seq"], batch["run_"], batch["start"], batch["end"], strict=True):
                if (seq, run) != here:
                    here, end = (seq, run), start
                kept.append(start >= end)
                if kept[-1]:
                    end = stop
            yield batch[kept]

    return dealt.mapInPandas(keep, dealt.schema).drop("run_")


def cluster_count(df: DataFrame, distance: int = 5, width: int = 1 << 16) -> DataFrame:
    """``df`` (with a row_id that no other row has) and ``cluster``: how many other variant rows lie within ``distance``.

    Of two rows, the earlier must not end before the later starts less the distance.  No pairs
    are made: the rows near one are those that start by its end plus the distance, less those
    that end before its start less the distance.  Both are running counts, taken in bins of
    ``width`` positions and added to the counts of the bins before.  A row without a sequence or a place has 0.
    """
    start, end = F.col("start").cast("long"), F.col("end").cast("long")

    # At one place starts come first, then the questions, then ends.
    def event(at: Column, turn: int, sign: int) -> Column:
        return F.struct(at.alias("at_"), F.lit(turn).alias("turn_"), F.lit(sign).alias("sign_"))

    events = df.where(start.isNotNull() & end.isNotNull())
    events = events.select("seq", "row_id", F.explode(F.array(event(start, 0, 0), event(end + distance, 1, 1), event(start - distance, 1, -1), event(end, 2, 0))).alias("e"))
    events = events.select("seq", F.floor(F.col("e.at_") / width).cast("long").alias("bin_"), "row_id", "e.*")
    n_start, n_end = F.count_if(F.col("turn_") == 0), F.count_if(F.col("turn_") == 2)
    before = Window.partitionBy("seq").orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)
    totals = events.groupBy("seq", "bin_").agg(n_start.alias("s_"), n_end.alias("e_"))
    totals = totals.select("seq", "bin_", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("s_", "e_")))
    here = Window.partitionBy("seq", "bin_").orderBy("at_", "turn_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = events.withColumns({"in_s_": n_start.over(here), "in_e_": n_end.over(here)}).where("turn_ = 1").join(totals, ["seq", "bin_"])
    near = F.when(F.col("sign_") > 0, F.col("in_s_") + F.col("s_")).otherwise(-F.col("in_e_") - F.col("e_"))
    counts = asked.groupBy("row_id").agg((F.sum(near) - 1).alias("cluster"))
    return df.join(counts, "row_id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))


def loose_matches(errors: DataFrame, matches: DataFrame, distance: int = 30, width: int = intervals.DEFAULT_WIDTH) -> DataFrame:
    """``errors`` with ``loose``: whether a row of ``matches`` lies within ``distance``."""
    keys = ["seq", "start", "end"]
    near = errors.select("seq", (F.col("start") - distance).alias("start"), (F.col("end") + distance).alias("end")).distinct()
    hit = intervals.overlap_join(near, matches.select(*keys), width).select("seq", (F.col("start") + distance).alias("start"), (F.col("end") - distance).alias("end")).distinct()
    return errors.join(hit.withColumn("loose", F.lit(True)), keys, "left").withColumn("loose", F.coalesce("loose", F.lit(False)))
