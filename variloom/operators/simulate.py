"""Seeded simulation of references, reads, populations, samples, children and mutations.

Every random number is a hash of the seed and a row's own key, so results don't depend on how
rows are dealt out, and a lost task makes the same rows again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BASES = "ACGT"


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) for each row's keys."""
    return (F.xxhash64(F.lit(seed), *keys).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)


def _pick(u: Column, weights: dict[str, float]) -> Column:
    """The label that a uniform number falls on."""
    total, at, out = sum(weights.values()), 0.0, None
    for label, w in weights.items():
        at += w / total
        out = F.when(u < at, label) if out is None else out.when(u < at, label)
    return out.otherwise(list(weights)[-1])


def reference(spark: SparkSession, sequences: int, least: int, most: int, seed: int = 1, frequencies: dict[str, float] | None = None, tile: int = 10_000) -> DataFrame:
    """(seq, tile, bases): random sequences in tiles, of lengths uniform in [least, most] and bases by frequency."""
    frequencies = frequencies or dict.fromkeys(BASES, 1.0)
    names = spark.range(sequences).select(F.concat(F.lit("seq"), F.col("id") + 1).alias("seq"))
    sized = names.withColumn("length", (least + F.floor(uniform(seed, "seq", F.lit("length")) * (most - least + 1))).cast("int"))
    tiles = sized.withColumn("tile", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / tile).cast("int"))))
    own = F.least(F.lit(tile), F.col("length") - F.col("tile") * tile)
    letters, p = list(frequencies), np.array(list(frequencies.values())) / sum(frequencies.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bases = ["".join(np.random.default_rng([seed, k & 0xFFFFFFFF, k >> 32 & 0xFFFFFFFF]).choice(letters, n, p=p)) for k, n in zip(b["key"], b["n"], strict=True)]
            yield pd.DataFrame({"seq": b["seq"], "tile": b["tile"], "bases": bases})

    return tiles.select("seq", F.col("tile").cast("long").alias("tile"), own.cast("int").alias("n"), F.abs(F.xxhash64(F.lit(seed), "seq", "tile")).alias("key")).mapInPandas(run, "seq string, tile long, bases string")


def reads(spark: SparkSession, template: DataFrame, n: int, length: int = 100, seed: int = 1, tile: int = 10_000, substitution: float = 0.01, insertion: float = 0.001, deletion: float = 0.001, paired_gap: tuple[int, int] | None = None, most_n: float = 0.1, homopolymer_shrink: float = 0.0, homopolymer_grow: float = 0.0, duplicate: float = 0.0, chimera: float = 0.0) -> DataFrame:
    """(seq_id, arm, name, residues, quals): reads of random places, on random strands, with errors per base.

    A fragment lies within one tile (fragments across a border are drawn anew), and more than
    ``most_n`` of N rejects it.  ``homopolymer_*`` shorten or lengthen runs of three and more;
    ``duplicate`` repeats a fragment, ``chimera`` joins it with the next of its batch.
    """
    tiles = template.withColumn("size", F.length("bases"))
    total = tiles.agg(F.sum("size")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "seq_id long, arm string, name string, residues string, quals array<int>")
    # Each tile gets reads in proportion to its bases.
    share = F.floor(F.col("size") / total * n + uniform(seed, "seq", "tile")).cast("int")
    drawn = tiles.withColumn("k", F.explode(F.when(share > 0, F.sequence(F.lit(1), share)))).withColumn("key", F.abs(F.xxhash64(F.lit(seed), "seq", "tile", "k")))
    span = length if paired_gap is None else 2 * length + paired_gap[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        comp = str.maketrans("ACGTN", "TGCAN")
        for b in batches:
            out, held = [], ""
            for seq, t, bases, key in zip(b["seq"], b["tile"], b["bases"], b["key"], strict=True):
                rng = np.random.default_rng(int(key))
                for _ in range(1000):
                    size = length if paired_gap is None else 2 * length + int(rng.integers(paired_gap[0], paired_gap[1] + 1))
                    if len(bases) < min(size, span):
                        fragment = None
                        break
                    at = int(rng.integers(0, len(bases) - size + 1))
                    fragment = bases[at : at + size]
                    if fragment.count("N") <= most_n * size:
                        break
                if not fragment:
                    continue
                if held:
                    fragment, held = held + fragment, ""
                elif rng.random() < chimera:
                    held = fragment
                    continue
                if rng.random() < 0.5:
                    fragment = fragment[::-1].translate(comp)
                arms = [("single", fragment[:length])] if paired_gap is None else [("left", fragment[:length]), ("right", fragment[-length:][::-1].translate(comp))]
                for copy in range(2 if rng.random() < duplicate else 1):
                    for arm, part in arms:
                        text, q = _errors(part, rng, substitution, insertion, deletion, homopolymer_shrink, homopolymer_grow)
                        out.append((int(key) + copy, arm, f"{seq}:{t * tile + at}:{key}/{copy}", text, q))
            yield pd.DataFrame(out, columns=["seq_id", "arm", "name", "residues", "quals"])

    return drawn.select("seq", "tile", "bases", "key").mapInPandas(run, "seq_id long, arm string, name string, residues string, quals array<int>")


def _errors(part: str, rng: np.random.Generator, substitution: float, insertion: float, deletion: float, shrink: float, grow: float) -> tuple[str, list[int]]:
    out, quals, run = [], [], 0
    good = max(2, round(-10 * math.log10(max(substitution + insertion + deletion, 1e-4))))
    for i, c in enumerate(part):
        run = run + 1 if i and part[i - 1] == c else 1
        last = run > 2 and (i + 1 == len(part) or part[i + 1] != c)
        u = rng.random()
        if last and rng.random() < shrink:
            continue
        if u < deletion:
            continue
        if u < deletion + insertion:
            out.append(BASES[rng.integers(4)])
            quals.append(good // 2)
        if u > 1 - substitution:
            out.append(BASES[(BASES.find(c) + 1 + rng.integers(3)) % 4])
            quals.append(good // 2)
        else:
            out.append(c)
            quals.append(good)
        if last and rng.random() < grow:
            out.append(c)
            quals.append(good // 2)
    return "".join(out), quals


def population(template: DataFrame, rate: float = 0.001, seed: int = 1, tile: int = 10_000, kinds: dict[str, float] | None = None, longest: int = 6) -> DataFrame:
    """Records (seq, start, end, ref, alts, af): random places mutated by kind, without overlaps or N; the ALT frequency leans to the rare."""
    kinds = kinds or {"snp": 0.85, "mnp": 0.05, "insert": 0.05, "delete": 0.05}
    n = F.floor(F.length("bases") * rate + uniform(seed, "seq", "tile")).cast("int")
    drawn = template.withColumn("k", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))))
    u = lambda name: uniform(seed, "seq", "tile", "k", F.lit(name))
    drawn = drawn.withColumns({"at": F.floor(u("at") * F.greatest(F.length("bases") - longest - 1, F.lit(1))).cast("int"), "kind": _pick(u("kind"), kinds), "size": (1 + F.floor(u("size") * longest)).cast("int")})
    size = F.when(F.col("kind") == "snp", 1).when(F.col("kind") == "mnp", F.greatest(F.col("size"), F.lit(2))).when(F.col("kind") == "delete", F.col("size") + 1).otherwise(1)
    ref = F.col("bases").substr(F.col("at") + 1, size)
    turn = (1 + F.floor(u("turn") * 3)).cast("int")
    other = F.array_join(F.transform(F.filter(F.split(ref, ""), lambda c: c != ""), lambda c: F.lit(BASES * 2).substr(F.call_function("instr", F.lit(BASES), c) + turn, F.lit(1))), "")
    new = F.array_join(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.lit(BASES).substr((1 + F.floor(uniform(seed, "seq", "tile", "k", i) * 4)).cast("int"), F.lit(1))), "")
    alt = F.when(F.col("kind").isin("snp", "mnp"), other).when(F.col("kind") == "insert", F.concat(ref, new)).otherwise(F.substring(ref, 1, 1))
    found = drawn.select("seq", (F.col("tile") * tile + F.col("at")).cast("int").alias("start"), ref.alias("ref"), F.array(alt).alias("alts"), F.round(F.pow(u("af"), F.lit(3)) * 0.98 + 0.01, 3).alias("af"))
    found = found.where(~F.contains("ref", F.lit("N"))).withColumn("end", F.col("start") + F.length("ref"))
    from .neighbours import remove_overlapping

    return remove_overlapping(found, ("ref", "alts", "af"))


def sample(records: DataFrame, name: str, seed: int = 1, ploidy: int = 2) -> DataFrame:
    """``records`` with ``gt``: an allele for each haplotype by the ALT frequency (array ``afs`` or one ``af``); frequencies over one in sum call the reference."""
    afs = F.col("afs") if "afs" in records.columns else F.array("af")
    total = F.aggregate(afs, F.lit(0.0), lambda a, b: a + b)

    def draw(h: int) -> Column:
        u = uniform(seed, F.lit(name), "seq", "start", "ref", F.lit(h))
        state = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(0).alias("hit"))
        step = lambda s, a: F.struct((s["sum"] + a).alias("sum"), (s["i"] + 1).alias("i"), F.when((s["hit"] == 0) & (u < s["sum"] + a), s["i"] + 1).otherwise(s["hit"]).alias("hit"))
        return F.when(total > 1, 0).otherwise(F.aggregate(afs, state, step)["hit"])

    return records.withColumn("gt", F.array(*(draw(h) for h in range(ploidy))))


def child(parents: DataFrame, name: str, seed: int = 1, extra: float = 0.3, length: Column | None = None) -> DataFrame:
    """Rows (seq, start, .., father, mother: phased genotypes) with ``child``: a haplotype of each parent, with crossovers.

    Each parent's haplotype starts at random and changes at one uniform place of the
    sequence, and at a second with probability ``extra``.
    """
    size = length if length is not None else F.max("start").over(Window.partitionBy("seq")) + 1
    df = parents.withColumn("size_", size)

    def inherit(parent: str) -> Column:
        u = lambda k: uniform(seed, F.lit(name), F.lit(parent), "seq", F.lit(k))
        first = (u("start") < 0.5).cast("int")
        crossed = (F.col("start") >= u("cross") * F.col("size_")).cast("int") + ((u("again") < extra) & (F.col("start") >= u("cross2") * F.col("size_"))).cast("int")
        return F.get(F.col(parent), F.pmod(first + crossed, F.lit(2)))

    return df.withColumn("child", F.array(inherit("father"), inherit("mother"))).drop("size_")


def genetic_map_place(u: Column, cdf: list[tuple[int, float]]) -> Column:
    """The place at which a map's cumulative crossover probability reaches ``u``, by straight lines between its points."""
    out, (p0, c0) = F.lit(cdf[-1][0]).cast("double"), cdf[0]
    for p1, c1 in reversed(list(zip([p for p, _ in cdf[1:]], [c for _, c in cdf[1:]], strict=True))):
        i = [p for p, _ in cdf].index(p1)
        p0, c0 = cdf[i - 1]
        out = F.when(u <= c1, p0 + (p1 - p0) * (u - c0) / max(c1 - c0, 1e-12)).otherwise(out)
    return out


def crossover_cdf(points: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """(place, share) of a map of (place, centimorgans), by the share of crossovers 0.5 (1 - exp(-cM / 50))."""
    raw = [(p, 0.5 * (1 - math.exp(-cm / 50))) for p, cm in points]
    top = raw[-1][1] or 1.0
    return [(p, x / top) for p, x in raw]


def de_novo(template: DataFrame, existing: DataFrame, expected: float, seed: int = 2, tile: int = 10_000) -> DataFrame:
    """About ``expected`` new heterozygous mutations over the genome (with ``dn`` Y), none on an existing record."""
    from .intervals import overlap_join

    size = template.agg(F.sum(F.length("bases"))).first()[0] or 1
    new = population(template, expected / size, seed, tile).drop("af")
    hit = overlap_join(new.select("seq", "start", "end"), existing.select("seq", "start", "end")).select("seq", "start").distinct()
    left = new.join(hit, ["seq", "start"], "left_anti")
    return left.withColumns({"gt": F.when(uniform(seed, "seq", "start", F.lit("hap")) < 0.5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0))), "dn": F.lit("Y")})


def replay(template: DataFrame, records: DataFrame, haplotype: int, tile: int = 10_000) -> DataFrame:
    """(seq, tile, bases): the reference with one haplotype's alleles put in; a record belongs to the tile it starts in.

    What a deletion takes of the next tile is cut from that tile's front.
    """
    allele = F.get("gt", F.lit(haplotype))
    used = records.where(allele > 0).select("seq", "start", (F.col("start") + F.length("ref")).alias("end"), F.get("alts", allele - 1).alias("alt")).where(~F.col("alt").rlike(r"[^ACGTNacgtn]"))
    each = used.withColumn("tile", F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("end") - 1) / tile))))
    edits = each.groupBy("seq", "tile").agg(F.array_sort(F.collect_list(F.struct("start", "end", "alt"))).alias("edits"))
    joined = template.join(edits, ["seq", "tile"], "left").withColumn("from_", (F.col("tile") * tile).cast("int"))
    state = F.struct(F.col("from_").alias("at"), F.lit("").alias("out"))

    def step(s: Column, e: Column) -> Column:
        before = F.col("bases").substr(s["at"] - F.col("from_") + 1, F.greatest(e["start"] - s["at"], F.lit(0)))
        mine = e["start"] >= F.col("from_")
        return F.struct(F.greatest(s["at"], e["end"]).alias("at"), F.concat(s["out"], before, F.when(mine, e["alt"]).otherwise("")).alias("out"))

    done = F.aggregate("edits", state, step)
    rest = F.col("bases").substr(done["at"] - F.col("from_") + 1, F.length("bases"))
    return joined.select("seq", "tile", F.when(F.col("edits").isNull(), F.col("bases")).otherwise(F.concat(done["out"], rest)).alias("bases"))


def pedigree_samples(template: DataFrame, records: DataFrame, families: list[tuple[str, str, str]], founders: list[str], seed: int = 1, de_novo_expected: float = 0.0) -> dict[str, DataFrame]:
    """Genotyped records of every member: founders by frequency, children (child, father, mother) in order, each with new mutations if any are expected."""
    out = {f: sample(records, f, seed) for f in founders}
    for name, father, mother in families:
        keys = ["seq", "start", "end", "ref", "alts"]
        both = out[father].select(*keys, F.col("gt").alias("father")).join(out[mother].select(*keys, F.col("gt").alias("mother")), keys)
        own = child(both, name, seed).select(*keys, F.col("child").alias("gt"))
        if de_novo_expected:
            new = de_novo(template, records, de_novo_expected, seed + sum(map(ord, name)))
            own = own.unionByName(new.select(*keys, "gt"))
        out[name] = own
    return out
