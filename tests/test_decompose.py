import random

from variloom.operators import decompose as D


def test_alignment_spells_both():
    rng = random.Random(1)
    for _ in range(300):
        ref, alt = ("".join(rng.choice("ACG") for _ in range(rng.randint(1, 9))) for _ in range(2))
        inserted, aligned = D.align(ref, alt)
        assert len(inserted) == len(ref) + 1 and len(aligned) == len(ref)
        assert "".join(i + a for i, a in zip(inserted, [*aligned, ""], strict=True)) == alt


def test_slices_rebuild_the_alleles():
    rng = random.Random(2)
    for _ in range(300):
        ref = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 8)))
        alts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 8))) for _ in range(2)]
        for flags in ((False, False), (True, False), (True, True)):
            for k, alt in enumerate(alts, 1):
                out, at = "", 0
                for offset, alleles in D.slices(ref, alts, *flags):
                    out += ref[at:offset] + alleles[k]
                    at = offset + len(alleles[0])
                assert out + ref[at:] == alt


def test_records(spark):
    df = spark.createDataFrame([("c", 9, "CGTA", ["CATG"], [[0, 1]]), ("c", 30, "A", ["T"], [[1, 1]]), ("c", 50, "A", ["<DEL>"], [[0, 1]])], "seq string, start int, ref string, alts array<string>, gts array<array<int>>")
    got = sorted((r["start"], r["ref"], tuple(r["alts"]), r["gts"][0], r["orp"]) for r in D.decompose(df, break_mnps=True).collect())
    assert got == [(10, "G", ("A",), [0, 1], 10), (12, "A", ("G",), [0, 1], 10), (30, "A", ("T",), [1, 1], None), (50, "A", ("<DEL>",), [0, 1], None)]
