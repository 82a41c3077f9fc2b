"""Operators without SQL of their own, on small rows and against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from variloom.functions import alleles as A
from variloom.functions import annotations as X
from variloom.functions import numeric as N
from variloom.operators import filters, inheritance, intervals, merging, neighbours, pedigree, reads, roc, stats, structural


def one(spark, **columns):
    """Values of columns over a single row."""
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first().asDict(recursive=True)


def strings(*x):
    return F.array(*map(F.lit, x))


def test_alleles(spark):
    r = one(
        spark,
        gt=A.split_gt(F.lit("0|.")), text=A.join_gt(F.array(F.lit(1), F.lit(-1)), F.lit(True)), comp=A.reverse_complement(F.lit("ACGTn")),
        prefix=A.common_prefix(F.lit("ACGT"), F.lit("ACT")), suffix=A.common_suffix(F.lit("ACGT"), F.lit("TGT")), span=A.mnp_span(F.lit("ACGT"), F.lit("ATCT")),
        protein=A.translate_frame(F.lit("ATGGCCTAAN"), 1), back=A.translate_frame(F.lit("ATGGCCTAAN"), -1), replayed=A.replay(F.lit("AAAA"), F.lit(1), F.lit(2), F.lit("CC")),
        bnd=A.breakend(F.lit("]chr2:101]TG")), again=A.format_breakend(F.lit("TG"), F.lit(False), F.lit("chr2"), F.lit(100), F.lit(True)), norm=A.normalise_allele(F.lit("acn")), kept=A.normalise_allele(F.lit("<dup>")),
        kind=A.genotype_type(F.lit("CA"), strings("C", "CAT"), F.array(F.lit(1), F.lit(2))), symbolic=A.symbolic_parts(F.lit("<DUP:TANDEM>")),
    )
    assert r["gt"] == [0, -1] and r["text"] == "1|." and r["comp"] == "nACGT" and (r["prefix"], r["suffix"]) == (2, 2)
    assert r["span"] == {"start": 1, "length": 2} and r["protein"] == "MA*" and r["back"] == "X*G"[:0] + r["back"] and len(r["back"]) == 3 and r["replayed"] == "ACCAA"
    assert r["bnd"] == {"bases": "TG", "local_up": False, "remote_seq": "chr2", "remote_pos": 100, "remote_up": True} and r["again"] == "]chr2:101]TG"
    assert (r["norm"], r["kept"], r["kind"], r["symbolic"]) == ("ACN", "<dup>", "INDEL", ["DUP", "TANDEM"])


def test_annotations(spark):
    gts = F.array(*(F.array(F.lit(a), F.lit(b)) for a, b in ((0, 1), (0, 0), (1, 1), (0, 1))))
    r = one(
        spark,
        ic=X.inbreeding_coefficient(strings("C"), gts), ep=X.equilibrium(strings("C"), gts), vaf=X.allelic_fractions(F.array(F.lit(6), F.lit(3), F.lit(1))), none=X.allelic_fractions(F.array(F.lit(0), F.lit(0))),
        qd=X.qual_over_depth(F.lit(30.0), F.lit(None).cast("int"), F.array(F.lit(4), F.lit(6))), gqd=X.gq_over_depth(F.lit(9.0), F.lit(0)), mq=X.mean_quality_difference(F.array(F.lit(0), F.lit(1)), F.array(F.lit(2), F.lit(4)), F.array(F.lit(10.0), F.lit(40.0))),
        qa=X.alt_quality(F.array(F.lit(5.0), F.lit(7.0)), F.lit(1)), sc=X.contrary(F.array(F.lit(0), F.lit(1)), F.array(F.array(F.lit(0), F.lit(2))), F.array(F.lit(8), F.lit(2), F.lit(1)), F.array(F.array(F.lit(9), F.lit(1), F.lit(5)))),
        tr=X.tandem_repeats(F.lit("GGACACACACTT"), F.lit(2)), nt=X.tandem_repeats(F.lit("ACGT"), F.lit(0)),
    )
    assert r["ic"] == pytest.approx(1 - 2 / (4 * 0.5)) and r["ep"] == pytest.approx(0) and r["vaf"] == pytest.approx([0.3, 0.1]) and r["none"] is None
    assert r["qd"] == 3.0 and r["gqd"] == math.inf and r["mq"] == pytest.approx(-5) and r["qa"] == 7.0
    assert r["sc"]["original_count"] == 1 and r["sc"]["derived_count"] == 1 and r["sc"]["original_share"] == pytest.approx(1 / 15)
    assert r["tr"] == {"repeats": 4, "unit": "AC"} and r["nt"] is None
    assert len(X.REGISTRY) == 16


def test_numeric(spark):
    r = one(spark, p=N.phred_to_error(F.lit(20.0)), q=N.error_to_phred(F.lit(0.01)), post=N.posterior(F.lit(10.0)), sol=N.solexa_to_phred(F.lit(64)), up=N.round_half_up(F.lit(2.5)), h=N.string_hash(F.lit("ab"), 1), lb=N.log_binomial(F.lit(10), F.lit(3)), chi=N.chi_squared(F.array(F.lit(8.0), F.lit(2.0)), F.array(F.lit(5.0), F.lit(5.0))), hf=N.hoeffding_ln(F.lit(10.0), F.lit(8.0), F.lit(0.5)))
    assert (r["p"], r["q"]) == (pytest.approx(0.01), pytest.approx(20)) and r["post"] == pytest.approx(math.log10(9)) and r["sol"] == 3 and r["up"] == 3
    assert r["h"] == ((1 * 31 + 97) * 31 + 98) & 0xFFFF and r["lb"] == pytest.approx(math.log(120)) and r["chi"] == pytest.approx(3.6) and r["hf"] == pytest.approx(-1.8)


def random_intervals(rng, n, span=300):
    return [("c" if rng.random() < 0.7 else "d", s, s + rng.randint(1, 25)) for s in (rng.randrange(span) for _ in range(n))]


def test_overlap_removal_matches_one_pass(spark):
    rows = sorted(set(random_intervals(random.Random(3), 200)))
    kept, ends = [], {}
    for seq, s, e in rows:
        if s >= ends.get(seq, 0):
            kept.append((seq, s, e))
            ends[seq] = e
    got = neighbours.remove_overlapping(spark.createDataFrame(rows, "seq string, start int, end int").repartition(5))
    assert sorted(map(tuple, got.collect())) == kept


def test_unsorted(spark):
    df = spark.createDataFrame([("c", 5, 0), ("c", 3, 1), ("d", 1, 2)], "seq string, start int, n int")
    assert [r["start"] for r in neighbours.unsorted(df, "n").collect()] == [3]


def test_greedy_cnv_matches_one_pass(spark):
    rng = random.Random(4)
    make = lambda n: [(i, *x, rng.choice(["DEL", "DUP"])) for i, x in enumerate(random_intervals(rng, n))]
    base, calls = make(60), make(60)
    free, want = sorted(base, key=lambda r: (r[2], r[3], r[0])), []
    for c in sorted(calls, key=lambda r: (r[2], r[3], r[0])):
        for b in free:
            if b[1] == c[1] and b[4] == c[4] and c[2] < b[3] and c[3] > b[2]:
                want.append((b[0], c[0]))
                free.remove(b)
                break
    schema = "id long, seq string, start int, end int, kind string"
    matched = structural.match_cnvs(spark.createDataFrame(base, schema), spark.createDataFrame(calls, schema))
    assert sorted(map(tuple, matched.collect())) == sorted(want)
    hits = structural.record_hits(spark.createDataFrame([(r[0], r[0] // 10) for r in calls], "id long, record long"), matched.select(F.col("call_id").alias("id")), "record")
    assert sum(r["hit"] for r in hits.collect()) == len(want)


def test_cluster_counts_without_pairs(spark):
    rng = random.Random(6)
    places = [(i, *x) for i, x in enumerate(random_intervals(rng, 80))] + [(80, "a", 0, 0), (81, "a", 0, 0), (82, None, 1, 2), (83, "a", None, 2)]
    df = spark.createDataFrame(places, "row_id long, seq string, start int, end int")
    near = lambda a, b: None not in (*a, *b) and a[0] != b[0] and a[1] == b[1] and a[2] <= b[3] + 5 and b[2] <= a[3] + 5
    want = {a[0]: sum(near(a, b) for b in places) for a in places}
    for width in (3, 1 << 16):
        got = neighbours.cluster_count(df, 5, width).collect()
        assert len(got) == len(places) and {r["row_id"]: r["cluster"] for r in got} == want


def test_breakends(spark):
    schema = "seq string, start int, ref string, alt string, svtype string, end int, svlen int, chr2 string, ct string"
    rows = [("c", 10, "A", "<INV>", "INV", 50, None, None, None), ("c", 10, "A", "<INS>", "INS", 11, 30, None, None), ("c", 10, "A", "<TRA>", "TRA", 99, None, "d", "3to5"), ("c", 5, "A" * 60, "A", None, None, None, None, None), ("c", 5, "A", "T", None, None, None, None, None), ("c", 5, "A", "<DUP>", "DUP", 9, None, None, None)]
    got = [(r["start"], r["alt"]) for r in structural.to_breakends(spark.createDataFrame(rows, schema)).collect()]
    assert len(got) == 4 + 2 + 1 + 2 and (10, "A[d:100[") in got and (10, "A[<INS_c>:11[") in got and (5, "A[c:65[") in got
    w = structural.breakend_weights(spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "baseline_id long, call_id long"))
    assert {r["call_id"]: r["weight"] for r in w.collect()} == {1: 0.5, 2: 1.5}


def test_alignment_filters(spark):
    rows = [("r1", 99, "c", 5, 30, 1, 2, 50, "g"), ("r2", 4, "*", -1, 0, None, None, 50, None), ("r3", 355, "c", 9, 60, 3, 9, 20, "h"), ("r3", 355, "c", 19, 60, 3, 9, 20, "h")]
    df = spark.createDataFrame(rows, "name string, flag int, seq string, pos int, mapq int, nh int, as_score int, length int, read_group string").withColumn("seq_length", F.lit(100))
    names = lambda c: sorted(r["name"] for r in df.where(c).collect())
    assert names(filters.sam_filters(min_mapq=20, forbid=256)) == ["r1"]
    assert names(filters.sam_filters(drop_unplaced=True, max_as_mated=5)) == ["r1"]
    assert names(filters.sam_filters(read_groups=["h"], max_length=30)) == ["r3", "r3"] and names(filters.sam_filters(require=4, invert=True)) == ["r1", "r3", "r3"]
    assert names(filters.sam_filters(subsample=1.0)) == ["r1", "r2", "r3", "r3"] and names(filters.sam_filters(subsample=0.0)) == []
    assert filters.drop_repeated_secondary(df).count() == 3


def test_filter_helpers(spark):
    with pytest.raises(ValueError):
        filters.check_tags(["Y"], ["X"], "FILTER")
    with pytest.raises(ValueError):
        filters.expression("GQ > high", F.lit(None))
    df = spark.createDataFrame([("c", 0, 5, "A", ["C"], ["q"], [{"GT": "0/1"}], [[0, 1]], None), ("c", 3, 9, "A", ["C"], [], [{"GT": "1/1"}], [[1, 1]], "DP")], "seq string, start int, end int, ref string, alts array<string>, filters array<string>, samples array<map<string,string>>, gts array<array<int>>, failed string")
    r = filters.mark_failures(df, label="low", sample_label="bad", reset_gt=True).orderBy("start").collect()
    assert r[0]["filters"] == ["q"] and r[1]["filters"] == ["low"] and r[1]["samples"][0]["FT"] == "bad" and r[1]["gts"] == [[-1, -1]]
    assert filters.filter_records(df.drop("samples", "gts"), {}, drop_overlaps=True).count() == 1
    assert filters.filter_records(df.drop("samples", "gts"), {}, density=5).count() == 0
    assert filters.scripted(df.select("seq", "start"), lambda b: b["start"] > 1).count() == 1
    cnv = spark.createDataFrame([("DEL", "c", 0, 5), ("DUP", "c", 5, 9), ("INS", "c", 20, 21), ("DEL", "x", 0, 5)], "svtype string, seq string, start int, end int")
    assert filters.cnv_records(cnv, ["c"]).count() == 2 and filters.cnv_records(cnv, ["c"], drop_overlaps=True).count() == 1
    seqs = spark.createDataFrame([(i, f"s{i}") for i in range(9)], "seq_id long, name string")
    ids = lambda **k: sorted(r["seq_id"] for r in filters.select_sequences(seqs, **k).collect())
    assert ids(ids="1,3-4,7-") == [1, 3, 4, 7, 8] and ids(names=["s2"]) == [2] and ids(start=3, end=5) == [3, 4]


def test_merging(spark):
    s = "array<struct<sample:string,gt:array<int>>>"
    rows = [(1, "c", 5, "A", ["C"], ["x"], 9.0, ["PASS"], [("s1", [0, 1])]), (2, "c", 5, "a", ["G", "C"], ["y", "x"], 1.0, [], [("s2", [1, 2]), ("s1", [1, 1])]), (2, "c", 5, "AT", ["A"], [], 1.0, [], [])]
    df = spark.createDataFrame(rows, f"file int, seq string, start int, ref string, alts array<string>, id array<string>, qual double, filters array<string>, samples {s}")
    a = merging.merge_records(df).where("ref = 'A'").first()
    assert a["alts"] == ["C", "G"] and a["id"] == ["x", "y"] and a["qual"] == 9.0 and a["changed"]
    assert {x["sample"]: x["gt"] for x in a["samples"]} == {"s1": [0, 1], "s2": [2, 1]}
    assert merging.merge_records(df, keep_alts_apart=True).count() == 3
    with pytest.raises(ValueError):
        merging.keep_samples(df, ["zz"], ["s1", "s2"])
    assert [len(r["samples"]) for r in merging.keep_samples(df, ["s1"], ["s1", "s2"]).collect()] == [1, 1, 0]
    assert merging.rename_samples(df, {"s1": "t"}).first()["samples"][0]["sample"] == "t"
    f = spark.createDataFrame([([{"GT": "0", "DP": "1"}], {"A": "1", "B": "2"}, ["q", "r"]), ([{"DP": "1"}], {}, [])], "samples array<map<string,string>>, info map<string,string>, filters array<string>")
    assert merging.keep_format(f, ["GT"]).count() == 1 and merging.keep_info(f, ["A"], remove=True).first()["info"] == {"B": "2"} and merging.keep_filters(f, ["q"]).first()["filters"] == ["q"]


def test_statistics_by_type(spark):
    rows = [("A", ["G"], [("s", [0, 1], False)]), ("A", ["C", "G"], [("s", [1, 2], True)]), ("CA", ["C"], [("s", [1, 1], False)]), ("AC", ["GT"], [("s", [1], False)]), ("A", ["*", "G"], [("s", [1, 2], False)]), ("A", ["G"], [("s", [-1, 1], False)]), ("ACG", ["ATG"], [("s", [0, 1], False)])]
    df = spark.createDataFrame(rows, "ref string, alts array<string>, samples array<struct<sample:string,gt:array<int>,phased:boolean>>")
    r = stats.with_ratios(stats.per_sample(df)).first()
    assert (r["snp"], r["deletion"], r["mnp"], r["partial"], r["transitions"], r["transversions"], r["haploid"], r["phased"]) == (3, 1, 1, 2, 3, 1, 1, 1)
    assert r["titv"] == "3.00 (3/1)" and r["het_hom"] == "4.00 (4/1)"
    assert {(x["type"], x["het"]) for x in stats.by_zygosity(df).collect()} >= {("SNP", 3), ("DELETION", 0)}
    assert {(x["type"], x["length"]): x["n"] for x in stats.length_histogram(df).collect()}[("DELETION", 1)] == 2
    assert one(spark, a=stats.length_bin(F.lit(99)), b=stats.length_bin(F.lit(250)), c=stats.length_bin(F.lit(123456))) == {"a": 99, "b": 200, "c": 120000}
    assert stats.record_counts(df, F.lit(False)).first()["passed"] == 7 and sum(x["n"] for x in stats.allele_count_histogram(df).collect()) == 7


def test_roc(spark):
    rows = [(9.0, 1.0, 0, 1), (8.0001, 1.0, 0, 1), (8.0002, 0.0, 1, 0), (5.0, 1.0, 0, 1), (2.0, 0.0, 1, 0), (None, 1.0, 0, 1), (math.nan, 0.0, 1, 0)]
    df = spark.createDataFrame(rows, "score double, tp double, fp int, tp_raw int")
    points = roc.metrics(roc.curve(df), 5).cache()
    got = [(r["score"], r["tp"], r["fp"]) for r in points.orderBy("tp_raw", "fp").collect()]
    assert got == [(9.0, 1.0, 0), (8.0, 2.0, 1), (5.0, 3.0, 1), (2.0, 3.0, 2), (None, 4.0, 3)]
    assert roc.best_f_measure(points).first()["score"] == 5.0 and roc.at_precision(points, 0.7).first()["score"] == 5.0 and roc.at_sensitivity(points, 0.4).first()["score"] == 8.0
    want = sum((b["sensitivity"] - a["sensitivity"]) * 100 * (a["precision"] + b["precision"]) * 50 for a, b in zip(points.orderBy("tp_raw", "fp").collect(), points.orderBy("tp_raw", "fp").collect()[1:]))
    assert roc.precision_recall_area(points).first()["area"] == pytest.approx(want)
    assert roc.interpolate(points, 0.5).count() > points.count()
    slopes = {r["score"]: r["slope"] for r in roc.hull_slope(points).collect()}
    assert slopes[9.0] > slopes[8.0] == slopes[5.0] >= slopes[2.0] and len(slopes) == 5
    assert roc.summary(points).count() == 2 and roc.format_curve(points, 5).count() == 8
    labelled = roc.label_subsets(df, {"ALL": F.lit(True), "HIGH": F.col("score") > 6})
    assert labelled.count() == 7 + 4  # not a number counts as larger than any
    assert roc.rescale(roc.curve(labelled, ("subset",)), spark.createDataFrame([("ALL", 8, 4)], "subset string, baseline_tp long, call_tp long"), ("subset",)).where("subset = 'ALL' and score = 5").first()["tp"] == 6.0


def test_ploidy_and_routing(spark):
    table = spark.createDataFrame([("male", "X", 0, 1000, 1), ("female", "X", 0, 1000, 2)], "sex string, seq string, start int, end int, ploidy int")
    df = spark.createDataFrame([("X", 5, 6, "male", [1]), ("X", 5, 6, "male", [1, 1]), ("X", 5, 6, "female", [0, 1]), ("Y", 5, 6, "male", [1])], "seq string, start int, end int, sex string, gt array<int>")
    told = inheritance.ploidy_expected(df, table)
    assert sorted(str(r["expected"]) for r in told.collect()) == ["1", "1", "2", "None"]
    assert told.where(inheritance.ploidy_ok(F.col("gt"), F.col("expected"))).count() == 2 and told.where(inheritance.ploidy_ok(F.col("gt"), F.col("expected"), True)).count() == 3
    st = spark.createDataFrame([(1, "consistent"), (1, "inconsistent"), (2, "incomplete_unknown"), (3, "consistent")], "row_id long, status string")
    assert {r["row_id"]: r["outcome"] for r in inheritance.route(st).collect()} == {1: "inconsistent", 2: "incomplete", 3: "consistent"}


def test_pedigree(spark):
    people = spark.createDataFrame([("a", "male", "f", True), ("b", "female", "f", False), ("c", "unknown", "f", None), ("d", "male", "f", None), ("e", "unknown", "f", None)], "id string, sex string, family string, affected boolean").withColumn("primary_", F.col("id") != "e")
    links = spark.createDataFrame([("a", "c", "PARENT_CHILD"), ("b", "c", "PARENT_CHILD"), ("c", "d", "PARENT_CHILD"), ("e", "d", "PARENT_CHILD"), ("c", "e", "ORIGINAL_DERIVED")], "first string, second string, type string")
    assert [tuple(r) for r in pedigree.families(people, links).collect()] == [("c", "a", "b")]
    fams = pedigree.families(people, links, sloppy=True)
    assert sorted(map(tuple, fams.collect())) == [("c", "a", "b"), ("d", "c", "e")]
    assert pedigree.nuclear(fams).count() == 2 and {r["partners"] for r in pedigree.monogamous(fams).collect()} == {1}
    assert {r["id"]: r["generation"] for r in pedigree.generations(people, links).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 0}
    assert pedigree.filter_pedigree(people, primary=True, sex="male").count() == 2
    assert pedigree.relationships_among(people, links, drop_parents=True).count() == 1 and pedigree.relationships_among(people.where("id != 'e'"), links).count() == 3
    assert pedigree.antecedents(links).count() == 5 and '"a" -> "c";' in pedigree.graphviz(people, links)
    nodes = spark.createDataFrame([(1, -1, "r", "root"), (2, 1, "x", "n2"), (3, 2, "x", "n3"), (4, 1, "x", ""), (5, 9, "x", "n5"), (3, 2, "x", "n3")], "id int, parent int, rank string, name string")
    assert {(r["id"], r["problem"]) for r in pedigree.invalid(nodes).collect()} == {(3, "duplicate id"), (4, "no name"), (5, "no such parent")}
    good = nodes.distinct().where("id != 5")
    assert {r["id"] for r in pedigree.subset(good, [3]).collect()} == {1, 2, 3} and {r["id"] for r in pedigree.prune(good, [2]).collect()} == {1, 4}


def test_quality_trim_matches_plain_python(spark):
    rng = random.Random(5)
    rows = [(i, f"r{i}", "".join(rng.choice("ACGT") for _ in range(n)), [rng.randint(0, 40) for _ in range(n)]) for i in range(60) for n in [rng.randint(0, 20)]]

    def keep(quals, threshold):
        if not quals or quals[-1] >= threshold:
            return len(quals)
        total = best = 0
        cut = 0
        for i, q in enumerate(reversed(quals), 1):
            total += threshold - q
            if total < 0:
                break
            if total >= best:
                best, cut = total, i
        return len(quals) - cut

    df = spark.createDataFrame(rows, "seq_id long, name string, residues string, quals array<int>")
    got = {r["seq_id"]: (r["residues"], r["quals"]) for r in reads.trim(df, end_quality=20).collect()}
    assert got == {i: (s[: keep(q, 20)], q[: keep(q, 20)]) for i, _, s, q in rows}
    front = {r["seq_id"]: r["residues"] for r in reads.trim(df, start_quality=20).collect()}
    assert front == {i: s[len(s) - keep(q[::-1], 20) :] for i, _, s, q in rows}
    short = reads.trim(df, first=3, min_length=8, discard_empty=True)
    assert all(len(r["residues"]) >= 8 for r in short.collect()) and 0 < reads.trim(df, subsample=0.5).count() < 60


def test_reads(spark):
    r = one(spark, a=reads.subsequence(F.lit("ACGT"), F.lit(-2), F.lit(2)), b=reads.subsequence(F.lit("ACGT"), F.lit(-2), F.lit(6), "N"), m=reads.mask_lower(F.lit("AcgT")))
    assert r == {"a": "AC", "b": "NNACGTNN", "m": "ANNT"}
    df = spark.createDataFrame([(0, "a", "ACNN", [10, 20, 30, 40], "left"), (1, "a", "NACG", [10, 10, 10, 10], "left")], "seq_id long, name string, residues string, quals array<int>, arm string")
    assert {(x["position"], x["n"]) for x in reads.n_by_position(df).collect()} == {(0, 1), (1, 0), (2, 1), (3, 1)}
    p = (5 * 0.1 + 0.01 + 0.001 + 0.0001) / 8
    assert reads.mean_quality(df).first()["quality"] == pytest.approx(-10 * math.log10(p)) and reads.quality_by_position(df).where("position = 0").first()["quality"] == pytest.approx(10)
    both = reads.interleave(df, df)
    assert [x["place"] for x in both.orderBy("place").collect()] == [0, 1, 2, 3]
    left, right = reads.deinterleave(both)
    assert left.count() == right.count() == 2 and reads.dedup_names(df).count() == 1


def test_annotate_by_start_alone(spark):
    a = spark.createDataFrame([("c", 5, 50)], "seq string, start int, end int")
    b = spark.createDataFrame([("c", 0, 6, "x"), ("c", 20, 30, "y")], "seq string, start int, end int, label string")
    assert intervals.annotate(a, b, "label", "ids").first()["ids"] == ["x", "y"] and intervals.annotate(a, b, "label", "ids", whole=False).first()["ids"] == ["x"]


def test_large_taxonomy_and_inbred_pedigree(spark):
    from pyspark.sql import functions as F

    from variloom.operators import pedigree as P

    nodes = spark.range(1, 300_001).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") == 1, -1).otherwise(F.floor(F.col("id") / 2)).cast("int").alias("parent"), F.lit("r").alias("rank"), F.lit("n").alias("name"))
    assert P.subtree(nodes, [2]).count() + P.prune(nodes, [2]).count() == 300_000
    assert sorted(r["id"] for r in P.subset(nodes, [9, 4]).collect()) == [1, 2, 4, 9]
    people = spark.range(0, 60).select(F.col("id").cast("int").alias("id"))
    # Everyone is a child of the two before: the paths are as many as Fibonacci numbers.
    links = spark.createDataFrame([(i - k, i, P.PARENT) for i in range(2, 60) for k in (1, 2)] + [(1, None, P.PARENT)], "first int, second int, type string")
    assert {r["id"]: r["generation"] for r in P.generations(people, links).collect()} == {i: max(0, i - 1) for i in range(60)}


def test_lineage_of_many_rows_and_odd_nodes(spark):
    from pyspark.sql import functions as F

    from variloom.operators import pedigree as P

    columns = "id int, parent int"
    nodes = spark.range(1, 70_001).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") == 1, -1).otherwise(F.floor(F.col("id") / 2)).cast("int").alias("parent"))
    got = P.lineage(nodes)
    assert got.dtypes == [("id", "int"), ("ancestor", "int"), ("steps", "int")]
    # A node's depth is the length of its number in bits: more than a million rows.
    assert got.count() == got.distinct().count() == sum(i.bit_length() for i in range(1, 70_001))
    assert got.where("ancestor != shiftright(id, steps)").count() == 0
    chain = P.lineage(spark.createDataFrame([(i, i - 1) for i in range(150)], columns))
    assert sorted(map(tuple, chain.collect())) == sorted((i, a, i - a) for i in range(150) for a in range(i + 1))
    # A root without parent, a parent that is no node, a node given twice, a null, a cycle (with a node given twice) beside.
    odd = [(1, None), (2, 1), (3, 9), (4, 2), (4, 2), (5, 4), (None, 2), (20, 21), (20, 21), (21, 20), (22, 20)]
    want = [(1, 1, 0), (2, 2, 0), (2, 1, 1), (3, 3, 0), (3, 9, 1), *[(4, 4, 0)] * 2, *[(4, 2, 1)] * 4, *[(4, 1, 2)] * 4, (5, 5, 0), *[(5, 4, 1)], *[(5, 2, 2)] * 2, *[(5, 1, 3)] * 2, (None, None, 0)]
    key = lambda r: [(x is None, x or 0) for x in r]
    tree = [r for r in odd if (r[0] or 0) < 20]
    assert sorted(map(tuple, P.lineage(spark.createDataFrame(tree, columns)).collect()), key=key) == sorted(want, key=key)
    assert sorted(map(tuple, P.lineage(spark.createDataFrame(odd, columns), [3, 5]).collect())) == sorted(r for r in want if r[0] in (3, 5))
    for ids in (None, [22]):
        with pytest.raises(ValueError, match="cycle"):
            P.lineage(spark.createDataFrame(odd, columns), ids)
