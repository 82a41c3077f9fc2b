"""Record and sample filters.

Each criterion is a Column that is true for a row that passes.  ``first_failure`` names the
first criterion, in the given order, that a row fails, which is what the counters count.
Rows are records: seq, start, end, id, ref, alts, qual, filters, info (map), samples (array
of maps), gts (array of genotypes) as far as a criterion needs them.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import numeric as N
from . import intervals, neighbours


def keep_tags(filters: Iterable[str] = (), infos: Iterable[str] = ()) -> Column:
    """Any of the FILTER tags (``.`` is an empty FILTER) or INFO keys."""
    filters, infos = list(filters), list(infos)
    tests = [F.exists("filters", lambda f: f.isin(filters)), F.exists(F.map_keys("info"), lambda k: k.isin(infos))]
    if "." in filters:
        tests.append(F.size("filters") == 0)
    return tests[0] | tests[1] | (tests[2] if len(tests) > 2 else F.lit(False))


def without_info(keys: Iterable[str]) -> Column:
    keys = list(keys)
    return ~F.exists(F.map_keys("info"), lambda k: k.isin(keys))


def without_filters(tags: Iterable[str]) -> Column:
    tags = list(tags)
    hit = F.exists("filters", lambda f: f.isin(tags))
    return ~(hit | (F.size("filters") == 0)) if "." in tags else ~hit


def check_tags(tags: Iterable[str], declared: Iterable[str], kind: str) -> None:
    unknown = sorted(set(tags) - set(declared) - {"."})
    if unknown:
        raise ValueError(f"no {kind} declared for {', '.join(unknown)}")


def in_range(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within the inclusive range; a missing value passes."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (value >= low)
    if high is not None:
        ok = ok & (value <= high)
    return F.coalesce(ok, F.lit(True))


def allele_count(low: int | None = None, high: int | None = None) -> Column:
    return in_range(F.size("alts") + 1, low, high)


def sample_value(sample: Column, key: str) -> Column:
    """A numeric FORMAT field of a sample (a map); null if missing."""
    return F.try_element_at(sample, F.lit(key)).try_cast("double")


def samples_in_range(key: str, low: float | None = None, high: float | None = None, samples: Column | str = "samples") -> Column:
    """All samples within the range: if any fails, the record does."""
    return F.forall(samples, lambda s: in_range(sample_value(s, key), low, high))


def posteriors_in_range(low: float | None = None, high: float | None = None, samples: Column | str = "samples") -> Column:
    return F.forall(samples, lambda s: in_range(N.posterior(sample_value(s, "GQ")), low, high))


def info_in_range(key: str, low: float | None = None, high: float | None = None) -> Column:
    """INFO field as one number; text that is none is an error."""
    return in_range(F.try_element_at("info", F.lit(key)).cast("double"), low, high)


def denovo(sample: int, low: float, high: float, samples: Column | str = "samples") -> Column:
    """The sample is called de novo with a score in range (or none), and no other is."""
    samples = F.col(samples) if isinstance(samples, str) else samples
    called = lambda s: (F.try_element_at(s, F.lit("DN")) == "Y") & in_range(sample_value(s, "DNP"), low, high)
    hits = F.filter(F.transform(samples, lambda s, i: F.when(F.coalesce(called(s), F.lit(False)), i).otherwise(-1)), lambda i: i >= 0)
    return (F.size(hits) == 1) & (hits[0] == sample)


def _multi_base(gt: Column) -> Column:
    return (F.length("ref") > 1) | F.exists(gt, lambda a: (a > 0) & F.coalesce(F.length(F.get("alts", a - 1)) > 1, F.lit(False)))


def snps_only(gts: Column | str = "gts") -> Column:
    return F.forall(gts, lambda g: ~_multi_base(g))


def non_snps_only(gts: Column | str = "gts") -> Column:
    return F.forall(gts, _multi_base)


def _alike(gt: Column) -> Column:
    return F.size(F.array_distinct(gt)) == 1


def not_same_as_ref(gts: Column | str = "gts") -> Column:
    """No sample has alleles that are all alike and the reference (or missing)."""
    return F.forall(gts, lambda g: ~(_alike(g) & (g[0] <= 0)))


def not_hom(gts: Column | str = "gts") -> Column:
    return F.forall(gts, lambda g: ~_alike(g))


def some_variant(gts: Column | str = "gts") -> Column:
    return F.exists(gts, A.is_variant)


def single_alt_type(types: Iterable[str]) -> Column:
    types = list(types)
    strings = A.unpadded(F.col("ref"), F.col("alts"))
    return (F.size("alts") == 1) & A.allele_type(strings[0], F.get(strings, F.lit(1))).isin(types)


def passed() -> Column:
    return F.forall("filters", lambda f: f.isin("PASS", "."))


def is_known() -> Column:
    return F.size("id") > 0


_OPERATORS: dict[str, Callable] = {"==": operator.eq, "=": operator.eq, "!=": operator.ne, "<>": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}


def expression(text: str, sample: Column | None = None) -> Column:
    """``FIELD op value``, on ``INFO.FIELD`` (any value of it) or the sample's FORMAT field; a missing field fails.

    A value that is a number compares numbers; any other only as equal or not.
    """
    m = re.fullmatch(r"\s*(INFO\.)?(\w+)\s*(==|!=|<>|<=|>=|=|<|>)\s*(.*?)\s*", text)
    if not m:
        raise ValueError(f"not an expression: {text}")
    info, field, op, value = m.groups()
    try:
        number = float(value)
    except ValueError:
        number = None
        if op not in ("==", "=", "!=", "<>"):
            raise ValueError(f"{op} needs a number: {text}") from None
    test = lambda v: _OPERATORS[op](v.try_cast("double"), number) if number is not None else _OPERATORS[op](v, F.lit(value))
    if info:
        values = F.split(F.try_element_at("info", F.lit(field)), ",")
        return F.coalesce(F.exists(values, test), F.lit(False))
    if sample is None:
        raise ValueError("a sample expression needs a sample")
    return F.coalesce(test(F.try_element_at(sample, F.lit(field))), F.lit(False))


def all_of(criteria: dict[str, Column]) -> Column:
    out = F.lit(True)
    for c in criteria.values():
        out = out & F.coalesce(c, F.lit(False))
    return out


def first_failure(criteria: dict[str, Column]) -> Column:
    """Name of the first criterion that isn't met; null for a row that passes."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in criteria.items()))


def counters(df: DataFrame, failed: str = "failed") -> DataFrame:
    """Rows per first failed criterion; ``WRITTEN`` counts those that pass."""
    return df.groupBy(F.coalesce(failed, F.lit("WRITTEN")).alias("criterion")).agg(F.count("*").alias("n"))


def mark_failures(df: DataFrame, failed: str = "failed", label: str | None = None, sample_label: str | None = None, reset_gt: bool = False) -> DataFrame:
    """Rather than drop rows: add a FILTER label, add an FT label to the samples, or reset their genotypes."""
    bad = F.col(failed).isNotNull()
    if label:
        df = df.withColumn("filters", F.when(bad, F.array_union(F.filter("filters", lambda f: ~f.isin("PASS", ".")), F.array(F.lit(label)))).otherwise(F.col("filters")))
    if sample_label:
        mark = lambda s: F.map_concat(F.map_filter(s, lambda k, _: k != "FT"), F.create_map(F.lit("FT"), F.lit(sample_label)))
        df = df.withColumn("samples", F.when(bad, F.transform("samples", mark)).otherwise(F.col("samples")))
    if reset_gt:
        df = df.withColumn("gts", F.when(bad, F.transform("gts", lambda g: F.transform(g, lambda _: F.lit(-1)))).otherwise(F.col("gts")))
    return df


def scripted(df: DataFrame, accept: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Rows for which a Python callable, given a batch, is true; it may change the batch.  SQL text goes to ``df.where``."""

    def run(batches):
        for batch in batches:
            keep = accept(batch)
            yield batch[keep]

    return df.mapInPandas(run, df.schema)


def filter_records(df: DataFrame, criteria: dict[str, Column], include: DataFrame | None = None, exclude: DataFrame | None = None, drop_overlaps: bool = False, density: int | None = None, width: int = intervals.DEFAULT_WIDTH) -> DataFrame:
    """The filters in their fixed order: overlaps, (tags, genotypes: first in ``criteria``), regions, the rest, density.

    Overlaps are judged before any other filter, so a row that fails later still shadows.
    Include regions keep what overlaps them; exclude regions drop only what they enclose.
    """
    if drop_overlaps:
        df = neighbours.remove_overlapping(df)
    df = df.where(all_of(criteria)) if criteria else df
    if exclude is not None:
        df = intervals.drop_enclosed(df, exclude, width)
    if include is not None:
        df = intervals.keep_overlapping(df, include, width)
    if density is not None:
        pad = A.redundant_first_base(F.col("ref"), F.col("alts")) if {"ref", "alts"} <= set(df.columns) else F.lit(False)
        df = neighbours.density_window(df.withColumn("pos", F.col("start") + pad.cast("int")), density).drop("pos")
    return df


def sam_filters(min_mapq: int | None = None, require: int = 0, forbid: int = 0, max_nh: int | None = None, max_as_mated: int | None = None, max_as_unmated: int | None = None, min_length: int | None = None, max_length: int | None = None, read_groups: Iterable[str] | None = None, subsample: float | None = None, subsample_end: float | None = None, seed: int = 0, drop_unplaced: bool = False, invert: bool = False) -> Column:
    """Alignment rows: flag, mapq, nh, as_score, length, read_group, name, pos, seq_length.

    ``subsample`` keeps names by hash; with ``subsample_end`` the rate runs linearly along the
    sequence from the one to the other.
    """
    flag = F.col("flag")
    tests = [flag.bitwiseAND(require) == require, flag.bitwiseAND(forbid) == 0]
    if drop_unplaced:
        tests.append(F.col("pos") >= 0)
    if min_mapq is not None:
        tests.append(F.col("mapq") >= min_mapq)
    if max_nh is not None:
        tests.append(in_range(F.col("nh"), None, max_nh))
    mated = flag.bitwiseAND(3) == 3
    if max_as_mated is not None:
        tests.append(~mated | in_range(F.col("as_score"), None, max_as_mated))
    if max_as_unmated is not None:
        tests.append(mated | in_range(F.col("as_score"), None, max_as_unmated))
    tests += [F.col("length") >= min_length] if min_length is not None else []
    tests += [F.col("length") <= max_length] if max_length is not None else []
    tests += [F.col("read_group").isin(list(read_groups))] if read_groups is not None else []
    if subsample is not None:
        rate = F.lit(subsample) if subsample_end is None else subsample + (subsample_end - subsample) * F.col("pos") / F.col("seq_length")
        tests.append(N.string_hash(F.col("name"), seed) < rate * 65536)
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return ~out if invert else out


def drop_repeated_secondary(df: DataFrame) -> DataFrame:
    """Alignments without repeats of a secondary one of the same name and arm (kept: the first by place)."""
    from pyspark.sql import Window

    secondary = F.col("flag").bitwiseAND(256) != 0
    w = Window.partitionBy("name", F.col("flag").bitwiseAND(192), secondary).orderBy("seq", "pos", "flag")
    return df.withColumn("n_", F.row_number().over(w)).where(~secondary | (F.col("n_") == 1)).drop("n_")


def cnv_records(df: DataFrame, sequences: Iterable[str], drop_overlaps: bool = False) -> DataFrame:
    """Deletions and duplications with an END on known sequences."""
    df = df.where(F.col("svtype").isin("DEL", "DUP") & F.col("end").isNotNull() & F.col("seq").isin(list(sequences)))
    if not drop_overlaps:
        return df
    # The last kept record's end counts with one base more.
    moved = neighbours.remove_overlapping(df.withColumn("end", F.col("end") + 1))
    return moved.withColumn("end", F.col("end") - 1)


def select_sequences(df: DataFrame, ids: str | None = None, names: Iterable[str] | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of a sequence set by id text (``3``, ``5-9`` inclusive, ``7-``), by names, or by [start, end) of ids."""
    test = F.lit(ids is None and names is None)
    for part in (ids or "").split(",") if ids else []:
        m = re.fullmatch(r"\s*(\d*)(-?)(\d*)\s*", part)
        if not m or not (m[1] or m[3]):
            raise ValueError(f"not an id range: {part}")
        low = int(m[1]) if m[1] else None
        high = (int(m[3]) if m[3] else None) if m[2] else low
        test = test | in_range(F.col("seq_id"), low, high)
    if names is not None:
        test = test | F.col("name").isin(list(names))
    if start is not None:
        test = test & (F.col("seq_id") >= start)
    if end is not None:
        test = test & (F.col("seq_id") < end)
    return df.where(test)
