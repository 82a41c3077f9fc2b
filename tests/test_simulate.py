from pyspark.sql import functions as F

from variloom.operators import simulate as S


def whole(tiles):
    out = {}
    for r in tiles.orderBy("seq", "tile").collect():
        out[r["seq"]] = out.get(r["seq"], "") + r["bases"]
    return out


def test_reference_and_population(spark):
    ref = S.reference(spark, 3, 900, 1500, seed=5, tile=400).cache()
    text = whole(ref)
    assert len(text) == 3 and all(900 <= len(t) <= 1500 and set(t) <= set("ACGT") for t in text.values())
    assert whole(S.reference(spark, 3, 900, 1500, seed=5, tile=400).repartition(7)) == text
    pop = S.population(ref, 0.02, seed=3, tile=400).cache()
    rows = pop.orderBy("seq", "start").collect()
    assert 30 < len(rows) < 90
    for r in rows:
        assert text[r["seq"]][r["start"] : r["end"]] == r["ref"] and r["alts"][0] != r["ref"]
    assert all(a["seq"] != b["seq"] or a["end"] <= b["start"] for a, b in zip(rows, rows[1:]))
    got = S.sample(pop, "s", 1).cache()
    for h in (0, 1):
        spelled = whole(S.replay(ref, got, h, 400))
        for seq, t in text.items():
            for r in reversed([r for r in got.orderBy("start").collect() if r["seq"] == seq]):
                if r["gt"][h]:
                    t = t[: r["start"]] + r["alts"][0] + t[r["end"] :]
            assert spelled[seq] == t


def test_children_inherit(spark):
    ref = S.reference(spark, 2, 3000, 3000, seed=5, tile=1000)
    pop = S.population(ref, 0.01, seed=3, tile=1000)
    family = S.pedigree_samples(ref, pop, [("kid", "dad", "mum")], ["dad", "mum"], 4, de_novo_expected=5)
    keys = ["seq", "start", "ref"]
    met = family["kid"].join(family["dad"].select(*keys, F.col("gt").alias("d")), keys, "left").join(family["mum"].select(*keys, F.col("gt").alias("m")), keys, "left").collect()
    old = [r for r in met if r["d"] is not None]
    assert old and all(r["gt"][0] in r["d"] and r["gt"][1] in r["m"] for r in old) and len(met) > len(old)


def test_reads_come_from_the_reference(spark):
    ref = S.reference(spark, 1, 5000, 5000, seed=1, tile=2500)
    text = whole(ref)["seq1"]
    back = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
    clean = S.reads(spark, ref, 50, 80, tile=2500, substitution=0, insertion=0, deletion=0).collect()
    assert 45 <= len(clean) <= 55 and all(r["residues"] in text or r["residues"] in back for r in clean)
    pairs = S.reads(spark, ref, 20, 50, tile=2500, paired_gap=(10, 30)).collect()
    assert {r["arm"] for r in pairs} == {"left", "right"} and all(len(r["quals"]) == len(r["residues"]) for r in pairs)


def test_genetic_map(spark):
    cdf = S.crossover_cdf([(0, 0.0), (100, 10.0), (1000, 20.0)])
    assert cdf[0] == (0, 0.0) and cdf[-1] == (1000, 1.0)
    r = spark.range(1).select(*(S.genetic_map_place(F.lit(u), cdf).alias(f"p{i}") for i, u in enumerate((0.0, cdf[1][1], 1.0)))).first()
    assert [round(x) for x in r] == [0, 100, 1000]
