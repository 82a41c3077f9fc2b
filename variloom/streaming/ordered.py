"""Streams of records ordered by place or time, as Structured Streaming.

A position takes the place of event time: base n of a sequence is second n + 1 after the epoch,
so that watermarks, windows and late rows work on positions as they do on clocks (a stream's
first watermark is the epoch itself, and what does not lie after it is late).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Second of base 0.
FIRST = 1


def position_time(start: Column) -> Column:
    return F.timestamp_seconds(start + FIRST)


def _edges(window: str, time: str) -> list[Column]:
    """Start and stop of a window; of positions, as seconds that count from 0."""
    shift = F.expr(f"INTERVAL {FIRST if time == 'ptime' else 0} SECONDS")
    return [(F.col(f"{window}.start") - shift).alias("start"), (F.col(f"{window}.end") - shift).alias("stop")]


def _window(time: str, width: int, step: int, unit: str) -> Column:
    return F.window(time, f"{width} {unit}", f"{step} {unit}", f"{FIRST if time == 'ptime' else 0} seconds")


def with_lateness(df: DataFrame, within: int = 10_000, start: str = "start") -> DataFrame:
    """A stream whose rows may come up to ``within`` positions out of order; later ones are late and dropped by what follows."""
    return df.withColumn("ptime", position_time(F.col(start))).withWatermark("ptime", f"{within} seconds")


def tumbling(df: DataFrame, width: int, by: tuple[str, ...] = ("seq",), time: str = "ptime", unit: str = "seconds") -> DataFrame:
    """Counts per tile of ``width``."""
    return df.groupBy(*by, _window(time, width, width, unit)).agg(F.count("*").alias("n")).select(*by, *_edges("window", time), "n")


def sliding(df: DataFrame, width: int, step: int, by: tuple[str, ...] = ("seq",), time: str = "ptime", unit: str = "seconds") -> DataFrame:
    return df.groupBy(*by, _window(time, width, step, unit)).agg(F.count("*").alias("n")).select(*by, *_edges("window", time), "n")


def sessions(df: DataFrame, gap: int, by: tuple[str, ...] = ("seq",), time: str = "ptime", unit: str = "seconds") -> DataFrame:
    """Runs of rows with less than ``gap`` between neighbours."""
    w = F.session_window(time, f"{gap} {unit}")
    return df.groupBy(*by, w).agg(F.count("*").alias("n")).select(*by, *_edges("session_window", time), "n")


def drop_repeats(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first row of each key that comes within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def near_pairs(a: DataFrame, b: DataFrame, distance: int) -> DataFrame:
    """Rows of two streams (with watermarks on ``ptime``) of one sequence within ``distance``; the watermark lets old rows go.

    They meet in tiles of 2 * ``distance`` + 1 seconds, so that a row looks at its neighbours only, not at
    all held rows of its sequence: a row of ``a`` is in its own tile, one of ``b`` in each (two, or one) that it can reach.
    """
    reach = distance * 1_000_000
    tile = lambda shift: F.floor((F.unix_micros("ptime") + shift) / F.lit(2 * abs(reach) + 1_000_000))
    left = a.select(F.col("seq").alias("a_seq"), F.col("ptime").alias("a_time"), F.col("start").alias("a_start"), tile(0).alias("a_tile"))
    right = b.select(F.col("seq").alias("b_seq"), F.col("ptime").alias("b_time"), F.col("start").alias("b_start"), F.explode(F.sequence(tile(-reach), tile(reach))).alias("b_tile"))
    near = F.expr(f"a_seq = b_seq AND a_tile = b_tile AND a_time >= b_time - INTERVAL {distance} SECONDS AND a_time <= b_time + INTERVAL {distance} SECONDS")
    return left.join(right, near).drop("a_tile", "b_tile")


def density_filter(df: DataFrame, distance: int) -> DataFrame:
    """Rows without a neighbour within ``distance``, for streams that are in order within each sequence.

    The state of a sequence is its last row's place and whether that was already too near
    the one before; a row is told when its successor comes.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        places = sorted(p for batch in batches for p in batch["start"].tolist())
        out = []
        for p in places:
            if held is not None:
                last, dense = held
                near = p - last <= distance
                if not dense and not near:
                    out.append(last)
                held = (p, near)
            else:
                held = (p, False)
        if held is not None:
            state.update(held)
        yield pd.DataFrame({"seq": [key[0]] * len(out), "start": out})

    return df.groupBy("seq").applyInPandasWithState(step, "seq string, start int", "last int, dense boolean", "append", GroupStateTimeout.NoTimeout)


def cluster_counts(df: DataFrame, distance: int = 5) -> DataFrame:
    """(seq, start, cluster): how many rows of an ordered stream lie within ``distance`` of each.

    Only rows that a later one can still reach are held; the others are told and go.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, counts = (list(x) for x in state.get) if state.exists else ([], [], [])
        out = []
        rows = sorted((r.start, r.end) for batch in batches for r in batch.itertuples(index=False))
        for s, e in rows:
            live = [i for i in range(len(starts)) if ends[i] >= s - distance]
            gone = [i for i in range(len(starts)) if ends[i] < s - distance]
            out += [(key[0], starts[i], counts[i]) for i in gone]
            for i in live:
                counts[i] += 1
            starts, ends, counts = ([x[i] for i in live] + [y] for x, y in ((starts, s), (ends, e), (counts, len(live))))
        state.update((starts, ends, counts))
        yield pd.DataFrame(out, columns=["seq", "start", "cluster"])

    return df.groupBy("seq").applyInPandasWithState(step, "seq string, start int, cluster int", "starts array<int>, ends array<int>, counts array<int>", "append", GroupStateTimeout.NoTimeout)
