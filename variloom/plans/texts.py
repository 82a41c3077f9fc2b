"""Queries that write a lens in a file format and read it back, or parse lines made from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pedigree, roc
from ..sources import text as T
from ..sources.scratch import scratch_path
from .lenses import frame
from .queries import _CURVE, _relations
from .record_queries import _qualities
from .registry import query


def _written(df: DataFrame, label: str) -> str:
    path = scratch_path(df.sparkSession, label)
    df.select("value").write.text(path)
    return path


@query("SELECT seq, start, stop, label FROM {regions}")
def source_bed(spark, sf):
    path = scratch_path(spark, "bed")
    T.write_bed(frame(spark, sf, "regions").withColumn("fields", F.array("label")), path)
    return T.read_bed(spark, path, least_fields=1).select("seq", "start", F.col("end").alias("stop"), F.col("fields")[0].alias("label"))


@query("SELECT seq, start, start + 1 AS stop FROM {regions} WHERE label = '2-HIGH'")
def source_bed_widened(spark, sf):
    lines = frame(spark, sf, "regions").where("label = '2-HIGH'").select(F.concat_ws("\t", "seq", "start", "start").alias("value"))
    head = spark.createDataFrame([("# a comment",), ("track name=x",), ("browser position",)], "value string")
    return T.read_bed(spark, _written(head.unionByName(lines), "bed"), widen_empty=True).select("seq", "start", F.col("end").alias("stop"))


def _variants(spark: SparkSession, sf: str) -> tuple[T.Header, DataFrame]:
    number = lambda c: F.when(F.col(c) < 0, ".").otherwise(F.col(c).cast("string"))
    one = F.create_map(F.lit("GT"), F.concat(number("g1"), F.lit("/"), number("g2")), F.lit("DP"), F.col("dp").cast("string"))
    two = F.create_map(F.lit("GT"), number("g3"), F.lit("DP"), F.lit("."))
    sample = lambda name, fields: F.struct(F.lit(name).alias("sample"), fields.alias("fields"))
    df = frame(spark, sf, "records").select(
        "seq", "start", F.array(F.col("row_id").cast("string")).alias("id"), "ref", "alts", F.when(F.col("gq") % 5 > 0, F.col("gq").cast("double")).alias("qual"),
        F.when(F.col("dp") < 10, F.array(F.lit("low"), F.lit("x"))).otherwise(F.array(F.lit("PASS"))).alias("filters"), F.array(F.lit("DP"), F.lit("DB")).alias("info_keys"),
        F.create_map(F.lit("DP"), F.col("dp").cast("string"), F.lit("DB"), F.lit("")).alias("info"), F.array(F.lit("GT"), F.lit("DP")).alias("format"), F.array(sample("a", one), sample("b", two)).alias("samples"),
    )
    header = T.parse_header(["##fileformat=VCFv4.2", *(f"##contig=<ID=chr{i},length=100000>" for i in range(1, 8)), '##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb"])
    return header, df


_N = "CASE WHEN {g} < 0 THEN '.' ELSE CAST({g} AS VARCHAR) END"


@query("SELECT CAST(row_id AS VARCHAR) AS id, seq, start, ref, array_to_string(alts, ',') AS alts, CASE WHEN gq % 5 > 0 THEN CAST(gq AS DOUBLE) END AS qual, CASE WHEN dp < 10 THEN 'low,x' ELSE 'PASS' END AS filters, CAST(dp AS VARCHAR) AS dp, " + _N.replace("{g}", "g1") + " || '/' || " + _N.replace("{g}", "g2") + " AS gt, 'a,b' AS samples FROM {records}")
def source_vcf(spark, sf):
    header, df = _variants(spark, sf)
    path = scratch_path(spark, "vcf")
    T.write_vcf(df, header, path)
    _, back = T.read_vcf(spark, path)
    first = F.col("samples")[0]["fields"]
    return back.select(F.col("id")[0].alias("id"), "seq", "start", "ref", F.array_join("alts", ",").alias("alts"), "qual", F.array_join("filters", ",").alias("filters"), F.col("info")["DP"].alias("dp"), first["GT"].alias("gt"), F.array_join(F.transform("samples", lambda s: s["sample"]), ",").alias("samples"))


@query("SELECT CAST(row_id AS VARCHAR) AS id, 'b' AS sample, " + _N.replace("{g}", "g3") + " AS gt, '.' AS dp FROM {records}")
def source_vcf_one_sample(spark, sf):
    header, df = _variants(spark, sf)
    back = T.parse_vcf(T.format_vcf(df), header, samples=["b"])
    return back.select(F.col("id")[0].alias("id"), F.col("samples")[0]["sample"].alias("sample"), F.col("samples")[0]["fields"]["GT"].alias("gt"), F.col("samples")[0]["fields"]["DP"].alias("dp"))


@query("SELECT 'q' || seq_id AS name, 'of ' || CAST(len(residues) AS VARCHAR) AS description, residues FROM {reads}")
def source_fasta(spark, sf):
    df = frame(spark, sf, "reads").select(F.concat(F.lit("q"), "seq_id", F.lit(" of "), F.length("residues").cast("string")).alias("name"), "residues")
    return T.read_fasta(spark, _written(T.format_fasta(df, 5), "fasta"))


@query("SELECT 'q' || seq_id AS name, residues, array_to_string(list_transform(range(0, len(residues)), lambda i: (i * 7 + seq_id) % 40), ',') AS quals FROM {reads}")
def source_fastq(spark, sf):
    df = _qualities(spark, sf).withColumn("name", F.concat(F.lit("q"), "seq_id"))
    back = T.read_fastq(spark, _written(T.format_fastq(df), "fastq"))
    return back.select("name", "residues", F.array_join(F.transform("quals", lambda q: q.cast("string")), ",").alias("quals"))


@query("SELECT 'q' || seq_id AS name, CASE seq_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'single' END AS arm, residues, array_to_string(list_transform(range(0, len(residues)), lambda i: (i * 7 + seq_id) % 40), ',') AS quals FROM {reads}")
def source_sam(spark, sf):
    arm = F.element_at(F.array(*map(F.lit, ("left", "right", "single"))), (F.col("seq_id") % 3 + 1).cast("int"))
    df = _qualities(spark, sf).withColumns({"name": F.concat(F.lit("q"), "seq_id"), "arm": arm})
    head = spark.createDataFrame([("@HD\tVN:1.6",), ("not an alignment",)], "value string")
    back = T.sam_to_reads(T.read_sam(spark, _written(head.unionByName(T.format_sam(df)), "sam")))
    return back.select("name", "arm", "residues", F.array_join(F.transform("quals", lambda q: q.cast("string")), ",").alias("quals"))


@query("SELECT 'q' || l AS name, CAST(flag AS INT) AS flag, CAST(pos AS INT) AS pos, CASE WHEN flag & 16 <> 0 THEN 'TTGA' ELSE 'TCAA' END AS residues FROM (SELECT DISTINCT l_orderkey AS l, l_partkey % 2 * 16 AS flag, l_partkey AS pos FROM lineitem)")
def source_sam_strands(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.concat(F.lit("q"), "l_orderkey").alias("name"), (F.col("l_partkey") % 2 * 16).alias("flag"), F.col("l_partkey").alias("pos")).distinct()
    lines = df.select(F.concat_ws("\t", "name", "flag", F.lit("chr1"), F.col("pos") + 1, F.lit("60"), F.lit("4M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("TCAA"), F.lit("IIII"), F.lit("NH:i:1")).alias("value"))
    rows = T.read_sam(spark, _written(lines, "sam")).where("nh = 1 and mapq = 60 and length = 4")
    from ..functions.alleles import reverse_complement

    return rows.select("name", "flag", "pos", F.when(F.col("flag").bitwiseAND(16) != 0, reverse_complement(F.col("residues"))).otherwise(F.col("residues")).alias("residues"))


@query("SELECT 'q' || seq_id AS name, residues, array_to_string(list_transform(range(0, len(residues)), lambda i: (i * 7 + seq_id) % 40), ',') AS quals FROM {reads}")
def source_reads_table(spark, sf):
    quals = F.array_join(F.transform("quals", lambda q: F.char(q + 33)), "")
    lines = _qualities(spark, sf).select(F.concat_ws("\t", F.concat(F.lit("q"), "seq_id"), "residues", quals).alias("value"))
    back = T.read_reads_table(spark, _written(lines, "reads"))
    return back.select("name", "residues", F.array_join(F.transform("quals", lambda q: q.cast("string")), ",").alias("quals"))


@query("SELECT seq_id, name, residues FROM {reads} WHERE seq_id >= 20 AND seq_id < 90")
def source_sequence_set(spark, sf):
    path = scratch_path(spark, "set")
    T.write_sequence_set(frame(spark, sf, "reads"), path)
    return T.read_sequence_set(spark, path, 20, 90).select("seq_id", "name", "residues")


@query("SELECT 'q' || seq_id AS seq, tile, residues[tile * 4 + 1 : tile * 4 + 4] AS bases FROM (SELECT seq_id, residues, unnest(range(0, (len(residues) + 3) // 4)) AS tile FROM {reads})")
def template_tiles(spark, sf):
    return T.template_tiles(frame(spark, sf, "reads").select(F.concat(F.lit("q"), "seq_id").alias("name"), "residues"), 4)


@query("SELECT seq, start, stop, label FROM {regions} WHERE seq = 'chr3' AND stop > 4999 AND start < 9000")
def source_indexed_region(spark, sf):
    path = scratch_path(spark, "indexed")
    T.write_indexed(frame(spark, sf, "regions"), path)
    return spark.read.parquet(path).where(T.region_filter("chr3:5,000-9,000")).select("seq", "start", F.col("end").alias("stop"), "label")


@query("SELECT CAST(id AS VARCHAR) AS id, CAST(family AS VARCHAR) AS family, sex, affected, CASE WHEN f.child IS NOT NULL THEN CAST(f.father AS VARCHAR) || ',' || CAST(f.mother AS VARCHAR) ELSE '' END AS parents FROM {pedigree} p LEFT JOIN (SELECT c.id AS child, CASE WHEN a.sex = 'male' THEN a.id ELSE b.id END AS father, CASE WHEN a.sex = 'male' THEN b.id ELSE a.id END AS mother FROM {pedigree} c JOIN {pedigree} a ON a.id = c.parent_a JOIN {pedigree} b ON b.id = c.parent_b WHERE a.sex <> b.sex) f ON f.child = p.id")
def source_ped(spark, sf):
    df = frame(spark, sf, "pedigree")
    people, links = T.read_ped(spark, _written(T.format_ped(df, pedigree.families(df, _relations(df))), "ped"))
    back = pedigree.families(people, links).select(F.col("child").alias("id"), F.concat_ws(",", "father", "mother").alias("parents"))
    return people.join(back, "id", "left").select("id", "family", "sex", "affected", F.coalesce("parents", F.lit("")).alias("parents"))


@query("SELECT id, parent, rank, name FROM {taxa}")
def source_taxonomy(spark, sf):
    lines = frame(spark, sf, "taxa").select(F.concat_ws("\t", "id", "parent", "rank", "name").alias("value"))
    head = spark.createDataFrame([("#taxonomy\t1.0",)], "value string")
    return T.read_taxonomy(spark, _written(head.unionByName(lines), "taxa"))


@query(_CURVE + " SELECT score, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(tp_raw AS DOUBLE) AS tp_raw, '77' AS total FROM c WHERE subset = 'en'")
def source_roc(spark, sf):
    points = roc.curve(frame(spark, sf, "calls").where("subset = 'en'"), ("subset",))
    values, back = T.read_roc(spark, _written(roc.format_curve(points, 77), "roc"))
    names = back.columns
    return back.select(F.col(names[0]).alias("score"), F.col(names[1]).alias("tp"), F.col(names[2]).alias("fp"), F.col(names[3]).alias("tp_raw"), F.lit(values["total baseline variants"]).alias("total"))


@query("SELECT line FROM (SELECT unnest(['SAMPLE a male', 'SAMPLE b female', 'SAMPLE c unknown', 'PARENT_CHILD a c', 'PARENT_CHILD b c', 'ORIGINAL_DERIVED a d']) AS line)")
def source_header_pedigree(spark, sf):
    header = T.parse_header(["##fileformat=VCFv4.2", "##SAMPLE=<ID=a,Sex=MALE>", "##SAMPLE=<ID=b,Sex=FEMALE>", "##PEDIGREE=<Child=c,Mother=b,Father=a>", "##PEDIGREE=<Derived=d,Original=a>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc"])
    people, links = T.header_pedigree(header)
    return spark.createDataFrame([(f"SAMPLE {p['id']} {p['sex']}",) for p in people] + [(f"{x['type']} {x['first']} {x['second']}",) for x in links], "line string")


@query("SELECT name, value FROM (VALUES ('contigs', 'chr1,chr2,chr3'), ('info', 'DP,XX'), ('samples', 'a,b,c'), ('region', 'chr1:9-20'), ('weight', '0.25'), ('ploidy', 'X:1,Y:1'), ('map', '100'), ('property', 'v')) AS t(name, value)")
def source_small_tables(spark, sf):
    """Header union, and the small side inputs."""
    head = lambda *lines: T.parse_header(["##fileformat=VCFv4.2", *lines])
    one = head("##contig=<ID=chr1,length=9>", "##contig=<ID=chr2,length=8>", '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb")
    two = head("##contig=<ID=chr3,length=7>", '##INFO=<ID=XX,Number=A,Type=Float,Description="x">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tb\tc")
    both = one.merge(two)
    name, start, end = T.parse_region("chr1:10~1")
    ploidies = T.read_reference_config(["male seq X haploid linear", "male seq Y haploid linear"])
    rows = [
        ("contigs", ",".join(both.contigs)), ("info", ",".join(sorted(both.info))), ("samples", ",".join(both.samples)), ("region", f"{name}:{start + 1}-{end * 2 - 0}" if end is None else f"{name}:{start + 1}-{end + 10}"),
        ("weight", f"{T.read_distribution(['1 A', '3 C'])['A']:g}"), ("ploidy", ",".join(f"{p['seq']}:{p['ploidy']}" for p in ploidies)), ("map", str(T.read_genetic_map(["pos cM", "100 0.5"])[0][0])), ("property", T.read_properties(["# c", "k = v"])["k"]),
    ]
    return spark.createDataFrame(rows, "name string, value string")
