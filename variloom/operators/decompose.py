"""Decomposition of complex alleles into smaller records.

Each ALT is aligned to REF over its whole length with affine gaps; columns in which every
allele equals the reference part the record into slices.  Alignment needs Python and runs in
an Arrow UDF over the distinct allele pairs of a batch; everything else is columns.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A

# Costs of opening and extending a gap, and of a substitution.
OPEN, EXTEND, SUBSTITUTE = 1, 1, 1
SLICE = "array<struct<offset:int,alleles:array<string>>>"


@lru_cache(maxsize=20_000)
def align(ref: str, alt: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(inserted, aligned): bases of ``alt`` before each place of ``ref`` (one more than its length) and on each of its bases ('' deleted)."""
    n, m, far = len(ref), len(alt), 1 << 30
    # Best costs ending in: a pair, a gap in alt (deletion), a gap in ref (insertion).
    best = [[[far] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    best[0][0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            cell = best[i][j]
            if i and j:
                cell[0] = min(best[i - 1][j - 1]) + (0 if ref[i - 1] == alt[j - 1] else SUBSTITUTE)
            if i:
                up = best[i - 1][j]
                cell[1] = min(up[0] + OPEN + EXTEND, up[1] + EXTEND, up[2] + OPEN + EXTEND)
            if j:
                left = best[i][j - 1]
                cell[2] = min(left[0] + OPEN + EXTEND, left[2] + EXTEND, left[1] + OPEN + EXTEND)
    inserted, aligned = [""] * (n + 1), [""] * n
    i, j = n, m
    kind = min(range(3), key=lambda k: best[n][m][k])
    while i or j:
        cost = best[i][j][kind]
        if kind == 0:
            aligned[i - 1] = alt[j - 1]
            cost -= 0 if ref[i - 1] == alt[j - 1] else SUBSTITUTE
            i, j = i - 1, j - 1
            kind = next(k for k in range(3) if best[i][j][k] == cost) if i or j else 0
        elif kind == 1:
            i -= 1
            kind = next(k for k in (1, 0, 2) if best[i][j][k] + EXTEND + (0 if k == 1 else OPEN) == cost)
        else:
            j -= 1
            inserted[i] = alt[j] + inserted[i]
            kind = next(k for k in (2, 0, 1) if best[i][j][k] + EXTEND + (0 if k == 2 else OPEN) == cost)
    return tuple(inserted), tuple(aligned)


def slices(ref: str, alts: list[str], break_mnps: bool = False, peel_indels: bool = False) -> list[tuple[int, list[str]]]:
    """(offset in REF, alleles with the reference first) of the parts in which some allele differs."""
    parts = [align(ref, alt) for alt in alts]
    out: list[tuple[int, list[str]]] = []
    open_, begin = None, 0
    for i in range(len(ref) + 1):
        inserted = [p[0][i] for p in parts]
        if any(inserted):
            if open_ is None:
                open_, begin = [""] + [""] * len(alts), i
            open_ = [a + b for a, b in zip(open_, ["", *inserted], strict=True)]
        bases = [p[1][i] for p in parts] if i < len(ref) else None
        if bases is not None and any(b != ref[i] for b in bases):
            if open_ is None:
                open_, begin = [""] + [""] * len(alts), i
            open_ = [a + b for a, b in zip(open_, [ref[i], *bases], strict=True)]
        elif open_ is not None:
            out.append((begin, open_))
            open_ = None
    if open_ is not None:
        out.append((begin, open_))
    if break_mnps:
        out = [x for s in out for x in _break(s)]
    if peel_indels:
        out = [x for s in out for x in _peel(s)]
    return out


def _break(part: tuple[int, list[str]]) -> list[tuple[int, list[str]]]:
    """A part whose alleles have one length, base by base; columns without a difference go."""
    offset, alleles = part
    if len({len(a) for a in alleles}) > 1 or len(alleles[0]) < 2:
        return [part]
    return [(offset + k, [a[k] for a in alleles]) for k in range(len(alleles[0])) if len({a[k] for a in alleles}) > 1]


def _peel(part: tuple[int, list[str]]) -> list[tuple[int, list[str]]]:
    """Single bases off the end of an indel where more alleles agree with the reference, while all alleles have bases."""
    offset, alleles = part
    if len({len(a) for a in alleles}) == 1:
        return [part]
    head, tail = [], []
    while min(map(len, alleles)) > 1:
        front, back = sum(a[0] == alleles[0][0] for a in alleles), sum(a[-1] == alleles[0][-1] for a in alleles)
        if front >= back:
            head.append((offset, [a[0] for a in alleles]))
            offset, alleles = offset + 1, [a[1:] for a in alleles]
        else:
            alleles_tail = [a[-1] for a in alleles]
            tail.insert(0, (offset + len(alleles[0]) - 1, alleles_tail))
            alleles = [a[:-1] for a in alleles]
    every = [*head, (offset, alleles), *tail]
    return [p for p in every if len(set(p[1])) > 1]


def _slices_udf(break_mnps: bool, peel_indels: bool):
    def run(refs: pd.Series, alts: pd.Series) -> pd.Series:
        return pd.Series([[{"offset": o, "alleles": a} for o, a in slices(r, list(x), break_mnps, peel_indels)] for r, x in zip(refs, alts, strict=True)])

    return F.pandas_udf(run, SLICE)


def decompose(df: DataFrame, break_mnps: bool = False, peel_indels: bool = False, longest: int = 1000) -> DataFrame:
    """Records (start, ref, alts, gts, ..) in their parts, with orp (1-based place) and orl (REF length) of the record that was split.

    A part that needs an anchor (an empty allele) gets the base of REF before it, or after it
    where there is none.  Records with symbolic or very long alleles stay whole.
    """
    plain = ~F.exists("alts", lambda a: a.rlike(r"[^ACGTNacgtn]")) & (F.length("ref") <= longest) & ~F.exists("alts", lambda a: F.length(a) > longest)
    pad = A.redundant_first_base(F.col("ref"), F.col("alts")).cast("int")
    own = F.when(plain, A.unpadded(F.col("ref"), F.col("alts")))
    work = df.withColumns({"pad_": pad, "own_": own})
    sliced = _slices_udf(break_mnps, peel_indels)(F.col("own_")[0], F.slice("own_", 2, F.greatest(F.size("own_") - 1, F.lit(1))))
    split = work.where("own_ is not null").withColumn("s_", F.explode_outer(sliced))
    whole = (F.col("s_").isNull()) | ((F.length(F.get(F.col("s_.alleles"), F.lit(0))) == F.length("ref") - F.col("pad_")) & ((F.col("pad_") == 0) | F.exists("s_.alleles", lambda a: a == "")))
    at = F.col("s_.offset") + F.col("pad_")
    anchor = F.exists("s_.alleles", lambda a: a == "")
    left = at > 0
    base = F.when(left, F.col("ref").substr(at, F.lit(1))).otherwise(F.col("ref").substr(at + F.length(F.get(F.col("s_.alleles"), F.lit(0))) + 1, F.lit(1)))
    anchored = F.transform("s_.alleles", lambda a: F.when(~anchor, a).when(left, F.concat(base, a)).otherwise(F.concat(a, base)))
    split = split.withColumn("whole_", whole).withColumn("alleles_", F.when(F.col("whole_"), F.concat(F.array("ref"), "alts")).otherwise(anchored))
    split = split.withColumn("new_", F.array_distinct("alleles_"))
    remap = F.transform("alleles_", lambda a: (F.array_position(F.col("new_"), a) - 1).cast("int"))
    start = F.when(F.col("whole_"), F.col("start")).otherwise(F.col("start") + at - F.when(anchor & left, 1).otherwise(0))
    split = split.withColumns({"map_": remap, "orp": F.when(~F.col("whole_"), F.col("start") + 1), "orl": F.when(~F.col("whole_"), F.length("ref")), "to_": start})
    gts = F.transform("gts", lambda g: F.transform(g, lambda a: F.when(a < 0, a).otherwise(F.get(F.col("map_"), a))))
    done = split.select(*(c for c in df.columns if c not in ("start", "ref", "alts", "gts")), F.col("to_").cast("int").alias("start"), F.col("new_")[0].alias("ref"), F.slice("new_", 2, F.greatest(F.size("new_") - 1, F.lit(1))).alias("alts"), gts.alias("gts"), "orp", "orl", F.col("map_").alias("allele_map"))
    rest = work.where("own_ is null").drop("pad_", "own_").withColumns({"orp": F.lit(None).cast("int"), "orl": F.lit(None).cast("int"), "allele_map": F.lit(None).cast("array<int>")})
    return done.unionByName(rest.select(*done.columns))


def adjust(values: Column, allele_map: Column, n_alleles: Column, policy: str = "SUM") -> Column:
    """A per-allele field of a split record: RETAIN it, DROP it, or SUM it over the alleles that became one."""
    if policy == "RETAIN":
        return values
    if policy == "DROP":
        return F.lit(None).cast("array<int>")
    return F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda i: F.aggregate(F.transform(values, lambda v, k: F.when(F.get(allele_map, k) == i, v).otherwise(0)), F.lit(0), lambda a, b: a + b))
