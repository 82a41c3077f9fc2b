import pytest

from variloom.sources import text as T

VCF = """##fileformat=VCFv4.2
##contig=<ID=c1,length=100>
##INFO=<ID=DP,Number=1,Type=Integer,Description="depth, all">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##SAMPLE=<ID=s1,Sex=MALE>
##PEDIGREE=<Child=s2,Father=s1>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
c1\t5\trs1\tA\tC,G\t30\tPASS\tDP=7;X\tGT:GQ\t0/1:9\t1/2
c1\t9\t.\tAT\t.\t.\t.\t.\tGT:GQ\t./.\t.
"""


def test_vcf_round_trip(spark, tmp_path):
    path = tmp_path / "in.vcf"
    path.write_text(VCF)
    header, df = T.read_vcf(spark, str(path))
    assert header.samples == ["s1", "s2"] and header.info["DP"].type == "Integer" and header.contigs == {"c1": 100}
    a, b = df.orderBy("start").collect()
    assert (a["start"], a["end"], a["alts"], a["qual"], a["info"]) == (4, 5, ["C", "G"], 30.0, {"DP": "7", "X": ""})
    assert a["samples"][1]["fields"] == {"GT": "1/2", "GQ": "."}
    assert (b["alts"], b["qual"], b["filters"], b["end"]) == ([], None, [], 10)
    assert T.header_pedigree(header)[1] == [{"first": "s1", "second": "s2", "type": "PARENT_CHILD"}]
    T.write_vcf(df, header, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(x for x in lines if x[0] != "#") == sorted(VCF.strip().split("\n")[7:])


def test_bad_records_fail(spark, tmp_path):
    path = tmp_path / "bad.vcf"
    path.write_text(VCF + "c1\tx\t.\tA\tC\t.\t.\t.\tGT\t0\t0\n")
    with pytest.raises(Exception, match="not a record"):
        T.read_vcf(spark, str(path))[1].collect()


def test_headers_merge():
    a, b = T.Header(info={"X": T.Field("X", "1", "Integer")}), T.Header(info={"X": T.Field("X", "1", "Float")})
    assert a.merge(b).info["X"].type == "Float"
    with pytest.raises(ValueError):
        a.merge(T.Header(info={"X": T.Field("X", "1", "String")}))


@pytest.mark.parametrize("text, want", [("c", ("c", None, None)), ("c:5", ("c", 4, None)), ("c:1,005-2,000", ("c", 1004, 2000)), ("c:5+10", ("c", 4, 14)), ("c:5~10", ("c", 0, 14))])
def test_regions(text, want):
    assert T.parse_region(text) == want


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 first\nACgt\nNN\n>s2\nA\n")
    got = {r["name"]: r["residues"] for r in T.read_fasta(spark, str(tmp_path / "a.fa"), mask_lower=True).collect()}
    assert got == {"s1": "ACNNNN", "s2": "A"}
    (tmp_path / "a.fq").write_text("@r1 x\nACG\n+\n!+5\n@r2\nT\n+\n@\n")
    got = {r["name"]: (r["residues"], r["quals"]) for r in T.read_fastq(spark, str(tmp_path / "a.fq")).collect()}
    assert got == {"r1": ("ACG", [0, 10, 20]), "r2": ("T", [31])}
    assert [r["value"] for r in T.format_fastq(T.read_fastq(spark, str(tmp_path / "a.fq"))).orderBy("value").collect()] == ["@r1\nACG\n+\n!+5", "@r2\nT\n+\n@"]


def test_alignments_and_tables(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t16\tc1\t5\t9\t3M\t=\t1\t0\tACG\t!+5\tNH:i:2\tRG:Z:g\nbroken\n")
    r = T.read_sam(spark, str(tmp_path / "a.sam")).collect()
    assert len(r) == 1 and (r[0]["pos"], r[0]["nh"], r[0]["read_group"]) == (4, 2, "g")
    read = T.sam_to_reads(T.read_sam(spark, str(tmp_path / "a.sam"))).collect()[0]
    assert (read["residues"], read["quals"], read["arm"]) == ("CGT", [20, 10, 0], "single")
    (tmp_path / "a.ped").write_text("#x\nf a 0 0 1 2\nf b 0 0 2 1\nf c a b 2 0\n")
    people, links = T.read_ped(spark, str(tmp_path / "a.ped"))
    assert people.count() == 3 and {(x["first"], x["second"]) for x in links.collect()} == {("a", "c"), ("b", "c")}
    (tmp_path / "a.bed").write_text("track x\nc1\t3\t3\tlab\nc1\t5\t9\n")
    assert sorted((x["start"], x["end"], x["fields"]) for x in T.read_bed(spark, str(tmp_path / "a.bed"), widen_empty=True).collect()) == [(3, 4, ["lab"]), (5, 9, [])]
    (tmp_path / "roc.tsv").write_text("#total baseline variants: 7\n#score\ttrue positives\n3.5\t2\n")
    values, points = T.read_roc(spark, str(tmp_path / "roc.tsv"))
    assert values == {"total baseline variants": "7"} and points.collect()[0].asDict() == {"score": 3.5, "true_positives": 2.0}
