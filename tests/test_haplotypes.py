"""The haplotype search against trying every choice of variants."""

import itertools
import random

from pyspark.sql import Row

from variloom.operators import haplotypes as H
from variloom.sources.text import template_tiles


def spelled(template, chosen):
    out = []
    for h in range(2):
        at, s = 0, ""
        for v, alleles in chosen:
            if alleles[h] > 0:
                start, end, bases = v.trimmed[alleles[h]]
                if start < at:
                    return None
                s, at = s + template[at:start] + bases, end
        out.append(s + template[at:])
    return tuple(out)


def brute(template, variants):
    order = sorted(variants, key=lambda v: (min(t[0] for t in v.trimmed.values()), v.end, v.side, v.id))
    best = []
    for side in (0, 1):
        mine, found = [v for v in order if v.side == side], {}
        for combo in itertools.product(*[[None, *H.orientations(v, 2, False, "ignore")] for v in mine]):
            chosen = [(v, a) for v, a in zip(mine, combo, strict=True) if a is not None]
            haps = spelled(template, chosen)
            if haps is not None:
                found[haps] = max(found.get(haps, 0), len(chosen))
        best.append(found)
    return max(n + best[1][h] for h, n in best[0].items() if h in best[1])


def cases(rng, n):
    for i in range(n):
        alphabet = ("A", "AC", "ACGT")[i % 3]
        template = "".join(rng.choice(alphabet) for _ in range(30))
        variants = []
        for k in range(rng.randint(1, 3)):
            start, length = rng.randint(2, 22), rng.randint(1, 3)
            ref = template[start : start + length]
            alt = ref[0] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 3)))
            if alt == ref:
                alt = ref + rng.choice("ACGT")
            gt = rng.choice([[0, 1], [1, 1], [1, 0]])
            variants.append(H.Variant(0, 2 * k, start, start + length, ref, [alt], gt))
            if rng.random() < 0.8:  # the same change, perhaps told one base on, or with another genotype
                shift = rng.choice([0, 0, 1, -1])
                s = start + shift
                r = template[s : s + length]
                variants.append(H.Variant(1, 2 * k + 1, s, s + length, r, [r[0] + alt[1:]] if r[0] + alt[1:] != r else [r + "G"], rng.choice([gt, gt, [0, 1]])))
        yield template, variants


def test_search_finds_the_largest_match():
    included = 0
    for template, variants in cases(random.Random(7), 300):
        got = H.search(template, 0, variants, prune=False)
        sides = [spelled(template, [(v, a) for v, a, _ in got if v.side == side]) for side in (0, 1)]
        assert sides[0] == sides[1] and sides[0] is not None
        assert len(got) == brute(template, variants)
        included += len(got)
    assert included > 300


def test_statuses_and_weights():
    t = "ACGTACGTACGTACGT"
    v = lambda side, id, start, ref, alt, gt: H.Variant(side, id, start, start + len(ref), ref, [alt], gt)
    # An MNP in the baseline is two SNPs in the calls; one call has the wrong genotype; one is false.
    got = H.evaluate(t, 0, [v(0, 1, 2, "GT", "CA", [0, 1]), v(1, 1, 2, "G", "C", [0, 1]), v(1, 2, 3, "T", "A", [0, 1]), v(0, 2, 8, "A", "T", [0, 1]), v(1, 3, 8, "A", "T", [1, 1]), v(1, 4, 12, "A", "G", [0, 1])])
    by = {(r["side"], r["id"]): r for r in got}
    assert by[0, 1]["status"] == H.GT_MATCH and by[1, 1]["weight"] == by[1, 2]["weight"] == 0.5
    assert by[0, 2]["status"] == by[1, 3]["status"] == H.ALLELE_MATCH
    assert by[1, 4]["status"] == H.NO_MATCH
    assert H.search(t, 0, [v(0, i, 2, "G", "C", [0, 1]) for i in range(9)], most_states=1) is None


def test_compare_runs_over_islands(spark):
    t = "".join(random.Random(3).choice("ACGT") for _ in range(5000))
    rows = lambda places: spark.createDataFrame([Row(seq="c1", id=i, start=p, end=p + 1, ref=t[p], alts=["A" if t[p] != "A" else "C"], gt=[0, 1], phased=False, outside=False) for i, p in enumerate(places)])
    template = template_tiles(spark.createDataFrame([("c1", t)], "name string, residues string"), 1000)
    got = {(r["side"], r["id"]): r["label"] for r in H.compare(rows([10, 990, 3000]), rows([10, 995, 3000, 4900]), template, gap=100, tile=1000).collect()}
    assert got == {(0, 0): "TP", (0, 1): "FN", (0, 2): "TP", (1, 0): "TP", (1, 1): "FP", (1, 2): "TP", (1, 3): "FP"}
