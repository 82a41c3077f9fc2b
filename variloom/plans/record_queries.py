"""Queries on single records: alleles, annotations, filters, projections, statistics, decomposition."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import annotations as X
from ..functions import numeric as N
from ..operators import decompose, filters, inheritance, merging, pedigree, reads, roc, stats, structural
from .lenses import frame
from .queries import _CURVE, _TYPE, _TYPED, _fields, _relations, _samples
from .registry import query

# ------------------------------------------------------------------ alleles

_RANK = "list_position(['UNCHANGED', 'SNP', 'MNP', 'DELETION', 'INSERTION', 'INDEL', 'SV_BREAKEND', 'SV_SYMBOLIC', 'SV_MISSING'], {})"
_JOIN = """CASE WHEN t1 IS NULL THEN t2 WHEN t2 IS NULL THEN t1 WHEN t1 <> t2 AND t1 IN ('DELETION', 'INSERTION', 'INDEL') AND t2 IN ('DELETION', 'INSERTION', 'INDEL') THEN 'INDEL'
 WHEN """ + _RANK.replace("{}", "t1") + " > " + _RANK.replace("{}", "t2") + " THEN t1 ELSE t2 END"


@query(_TYPED + f""",
 u AS (SELECT row_id, ref0 AS r, CASE WHEN g1 > 0 THEN alt0[g1] END AS a1, CASE WHEN g2 > 0 THEN alt0[g2] END AS a2 FROM s),
 t AS (SELECT row_id, (SELECT CASE WHEN a IS NOT NULL THEN {_TYPE} END FROM (SELECT u.r AS r, u.a1 AS a)) AS t1, (SELECT CASE WHEN a IS NOT NULL THEN {_TYPE} END FROM (SELECT u.r AS r, u.a2 AS a)) AS t2 FROM u)
SELECT row_id, coalesce({_JOIN}, 'UNCHANGED') AS type FROM t""")
def genotype_types(spark, sf):
    df = frame(spark, sf, "records")
    return df.select("row_id", A.genotype_type(F.col("ref"), F.col("alts"), F.array("g1", "g2")).alias("type"))


@query(_TYPED + " SELECT row_id, ref0, array_to_string(alt0, ',') AS alts0, (SELECT pad FROM r WHERE r.row_id = s.row_id) AS redundant FROM s")
def redundant_bases(spark, sf):
    df = frame(spark, sf, "records")
    parts = A.unpadded(F.col("ref"), F.col("alts"))
    return df.select("row_id", parts[0].alias("ref0"), F.array_join(F.slice(parts, 2, F.size("alts")), ",").alias("alts0"), A.redundant_first_base(F.col("ref"), F.col("alts")).alias("redundant"))


@query("SELECT row_id, CAST(CASE WHEN dp % 3 = 0 THEN start + dp ELSE start + len(ref) END AS INT) AS stop, CASE WHEN alts[1] = '<DEL>' THEN 'DEL' ELSE '' END AS symbol FROM {records}")
def record_ends(spark, sf):
    df = frame(spark, sf, "records")
    info = F.when(F.col("dp") % 3 == 0, F.create_map(F.lit("END"), (F.col("start") + F.col("dp")).cast("string"))).otherwise(F.create_map(F.lit("X"), F.lit("1")))
    return df.select("row_id", A.record_end(F.col("start"), F.col("ref"), info).alias("stop"), A.symbolic_parts(F.col("alts")[0])[0].alias("symbol"))


_NAMES = "(SELECT p_partkey AS id, upper(p_name) AS a, upper(p_brand) AS b, upper(p_type) AS c, p_size AS n FROM part)"


def _names(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet")
    return df.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("a"), F.upper("p_brand").alias("b"), F.upper("p_type").alias("c"), F.col("p_size").alias("n"))


@query(f"""
SELECT id, CAST(len(list_filter(range(1, least(len(a), len(c)) + 1), lambda k: a[1:k] = c[1:k])) AS INT) AS prefix,
 CAST(len(list_filter(range(1, least(len(a), len(c)) + 1), lambda k: right(a, k) = right(c, k))) AS INT) AS suffix,
 a[1:n % 5] || c || a[n % 5 + 3:] AS replayed, CASE WHEN n % 4 < 2 THEN repeat('N', 2 - n % 4) ELSE '' END || a[greatest(n % 4 - 2, 0) + 1:4] AS part FROM {_NAMES}""")
def text_surgery(spark, sf):
    df, a, c, k = _names(spark, sf), F.col("a"), F.col("c"), (F.col("n") % 5)
    at = F.col("n") % 4 - 2
    return df.select("id", A.common_prefix(a, c).alias("prefix"), A.common_suffix(a, c).alias("suffix"), A.replay(a, k, k + 2, c).alias("replayed"), reads.subsequence(a, at, F.lit(4), "N").alias("part"))


@query("""
WITH m AS (SELECT id, list_transform(range(0, 8), lambda i: ['A','C','G','T'][1 + CAST((id // (i + 1)) % 4 AS INT)]) AS r, id % 8 AS x, (id // 8) % 8 AS y FROM (SELECT o_orderkey AS id FROM orders)),
 v AS (SELECT id, array_to_string(r, '') AS ref, array_to_string(list_transform(r, lambda b, i: CASE WHEN i - 1 IN (x, y) THEN translate(b, 'ACGT', 'CGTA') ELSE b END), '') AS alt, least(x, y) AS lo, greatest(x, y) AS hi FROM m)
SELECT id, ref[lo + 1:hi + 1] AS ref, alt[lo + 1:hi + 1] AS alt, CAST(lo AS INT) AS start, CAST(hi - lo + 1 AS INT) AS length FROM v""")
def mnp_trims(spark, sf):
    df = _substituted(spark, sf)
    cut, span = A.trim_mnp(F.col("ref"), F.col("alt")), A.mnp_span(F.col("ref"), F.col("alt"))
    # Other names first: an alias of a column's own name would stand for it inside the lambdas of the next expressions.
    out = df.select("id", cut["ref"].alias("r"), cut["alt"].alias("a"), span["start"].alias("start"), span["length"].alias("length"))
    return out.withColumnsRenamed({"r": "ref", "a": "alt"})


def _substituted(spark, sf):
    """Eight bases made from an id, and the same with one or two of them substituted."""
    df = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    r = [F.substring("bases", i, 1) for i in range(1, 9)]
    digit = [F.expr(f"substring('ACGT', 1 + CAST(floor(id / {i}) % 4 AS INT), 1)") for i in range(1, 9)]
    x, y = F.col("id") % 8, F.floor(F.col("id") / 8) % 8
    changed = [F.when((x == i) | (y == i), F.translate(b, "ACGT", "CGTA")).otherwise(b) for i, b in enumerate(r)]
    return df.withColumn("bases", F.concat(*digit)).select("id", F.col("bases").alias("ref"), F.concat(*changed).alias("alt"))


@query("SELECT seq, start, stop, seq AS remote_seq, CAST(stop - 1 AS INT) AS remote_pos, start % 2 = 0 AS local_up, start % 3 = 0 AS remote_up, 'AC' AS bases FROM {loci} WHERE stop > 0")
def breakend_parts(spark, sf):
    df = frame(spark, sf, "loci").withColumnRenamed("end", "stop")
    text = A.format_breakend(F.lit("AC"), F.col("start") % 2 == 0, F.col("seq"), F.col("stop") - 1, F.col("start") % 3 == 0)
    return df.withColumn("b", A.breakend(text)).select("seq", "start", "stop", "b.remote_seq", "b.remote_pos", "b.local_up", "b.remote_up", "b.bases")


_CODON = "'FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG'[(strpos('TCAG', {s}[i]) - 1) * 16 + (strpos('TCAG', {s}[i + 1]) - 1) * 4 + strpos('TCAG', {s}[i + 2])]"
_FRAME = "array_to_string(list_transform(range({k}, len({s}) - 1, 3), lambda i: CASE WHEN regexp_matches({s}[i : i + 2], '^[TCAG]+$') THEN " + _CODON + " ELSE 'X' END), '')"


@query("WITH d AS (SELECT seq_id, residues AS f, reverse(translate(residues, 'ACGT', 'TGCA')) AS b FROM {reads}) SELECT seq_id, " + _FRAME.replace("{s}", "f").replace("{k}", "2") + " AS forward, " + _FRAME.replace("{s}", "b").replace("{k}", "1") + " AS backward FROM d")
def protein_frames(spark, sf):
    return frame(spark, sf, "reads").select("seq_id", A.translate_frame(F.col("residues"), 2).alias("forward"), A.translate_frame(F.col("residues"), -1).alias("backward"))


@query("SELECT row_id, CAST(round(1e6 * pow(10, -gq / 10)) AS BIGINT) AS error, CAST(round(1e6 * -10 * log10((dp + 1) / 51.0)) AS BIGINT) AS phred, floor((gq * 7 + dp) / 8.0 + 0.5) AS rounded, CAST(floor(10 * log10(1 + pow(10, (dp - 4) / 10)) + 0.5) AS INT) AS solexa FROM {records}")
def phred_values(spark, sf):
    df = frame(spark, sf, "records")
    return df.select(
        "row_id", F.round(N.phred_to_error(F.col("gq")) * 1e6).cast("long").alias("error"), F.round(N.error_to_phred((F.col("dp") + 1) / 51) * 1e6).cast("long").alias("phred"),
        N.round_half_up((F.col("gq") * 7 + F.col("dp")) / 8).alias("rounded"), N.solexa_to_phred(F.col("dp") + 60).alias("solexa"),
    )


_HASH = "list_reduce(list_prepend(CAST(9 AS BIGINT), list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 65535)"


@query("SELECT id, " + _HASH.replace("{}", "b") + f" AS hash FROM {_NAMES}")
def name_hashes(spark, sf):
    return _names(spark, sf).select("id", N.string_hash(F.col("b"), 9).alias("hash"))


@query("""
SELECT row_id, CAST(round(1e6 * coalesce(list_sum(list_transform(range(1, dp % 6 + 1), lambda i: ln((gq - dp % 6 + i) / CAST(i AS DOUBLE)))), 0)) AS BIGINT) AS binomial,
 CAST(round(1e6 * CASE WHEN gq > 0 THEN -2 * pow(gq * 0.25 - dp % 6, 2) / gq END) AS BIGINT) AS hoeffding,
 CAST(round(1e6 * (CASE WHEN dp > 0 THEN (gq - dp) * (gq - dp) / CAST(dp AS DOUBLE) ELSE 0 END + (dp - 9) * (dp - 9) / 9.0)) AS BIGINT) AS chi FROM {records} WHERE gq >= 6""")
def test_statistics(spark, sf):
    df, n, k = frame(spark, sf, "records").where("gq >= 6"), F.col("gq"), F.col("dp") % 6
    million = lambda c: F.round(c * 1e6).cast("long")
    chi = N.chi_squared(F.array(F.col("gq"), F.col("dp")), F.array(F.col("dp"), F.lit(9)))
    return df.select("row_id", million(N.log_binomial(n, k)).alias("binomial"), million(N.hoeffding_ln(n, k, F.lit(0.25))).alias("hoeffding"), million(chi).alias("chi"))


# ------------------------------------------------------------------ annotations


@query("""
WITH c AS (SELECT row_id, CASE WHEN g1 <> g2 THEN 1 ELSE 0 END AS het, list_transform(range(0, len(alts) + 1), lambda i: len(list_filter([greatest(g1, 0), greatest(g2, 0)], lambda a: a = i)) / 2.0) AS p FROM {records}),
 e AS (SELECT row_id, het, 1 - list_sum(list_transform(p, lambda x: CAST(x AS DOUBLE) * x)) AS e FROM c)
SELECT row_id, CASE WHEN e > 1e-12 THEN CAST(round(1e6 * (1 - het / e)) AS BIGINT) END AS ic, CAST(round(1e6 * 20 / ln(10) * pow(e - het, 2)) AS BIGINT) AS ep FROM e""")
def equilibrium_annotations(spark, sf):
    df = frame(spark, sf, "records").withColumn("gts", F.array(F.array("g1", "g2"), F.array("g3")))
    million = lambda c: F.round(c * 1e6).cast("long")
    return df.select("row_id", million(X.inbreeding_coefficient(F.col("alts"), F.col("gts"))).alias("ic"), million(X.equilibrium(F.col("alts"), F.col("gts"))).alias("ep"))


@query("""
WITH v AS (SELECT row_id, gq, dp, least(g1, g2) AS lo, greatest(g1, g2) AS hi, g1, g2, [dp, gq % 9, 5] AS ad, [gq, dp * 3, 70] AS aq, dp % 3 AS va FROM {records})
SELECT row_id, CASE WHEN dp <= 0 THEN 'inf' ELSE CAST(CAST(round(1000 * gq / dp) AS BIGINT) AS VARCHAR) END AS gqd,
 CASE WHEN g1 <> g2 AND lo >= 0 AND ad[lo + 1] > 0 AND ad[hi + 1] > 0 THEN CAST(round(1e6 * CASE WHEN lo = 0 THEN aq[lo + 1] / ad[lo + 1] - aq[hi + 1] / ad[hi + 1] ELSE abs(aq[lo + 1] / ad[lo + 1] - aq[hi + 1] / ad[hi + 1]) END) AS BIGINT) END AS meanqad,
 aq[va + 1] AS qa FROM v""")
def sample_annotations(spark, sf):
    df = frame(spark, sf, "records").withColumns({"ad": F.array("dp", F.col("gq") % 9, F.lit(5)), "aq": F.array("gq", F.col("dp") * 3, F.lit(70))})
    gqd = X.REGISTRY["GQD"][1](F.col("gq"), F.col("dp"))
    return df.select(
        "row_id", F.when(gqd == float("inf"), "inf").otherwise(F.round(gqd * 1000).cast("long").cast("string")).alias("gqd"),
        F.round(X.REGISTRY["MEANQAD"][1](F.array("g1", "g2"), F.col("ad"), F.col("aq")) * 1e6).cast("long").alias("meanqad"), X.REGISTRY["QA"][1](F.col("aq"), F.col("dp") % 3).alias("qa"),
    )


# ------------------------------------------------------------------ filters


@query("SELECT row_id FROM {records} WHERE dp BETWEEN 10 AND 40")
def filter_sample_depth(spark, sf):
    return _fields(frame(spark, sf, "records")).where(filters.samples_in_range("DP", 10, 40)).select("row_id")


@query("SELECT row_id FROM {records} WHERE (gq % 7 = 0 OR log10(pow(10, gq / 10) - 1) BETWEEN 1.01 AND 7.03) AND log10(pow(10, (gq + 10) / 10) - 1) BETWEEN 1.01 AND 7.03")
def filter_posterior(spark, sf):
    return _fields(frame(spark, sf, "records")).where(filters.posteriors_in_range(1.01, 7.03)).select("row_id")


def _ratios(spark, sf):
    return frame(spark, sf, "records").withColumn("samples", F.array(F.create_map(F.lit("AR"), (F.col("gq") / 100).cast("string"), F.lit("AVR"), (F.col("dp") / 64).cast("string"))))


@query("SELECT row_id FROM {records} WHERE gq <= 30")
def filter_ambiguity(spark, sf):
    return _ratios(spark, sf).where(filters.samples_in_range("AR", None, 0.3)).select("row_id")


@query("SELECT row_id FROM {records} WHERE dp / 64 BETWEEN 0.25 AND 0.5")
def filter_avr(spark, sf):
    return _ratios(spark, sf).where(filters.samples_in_range("AVR", 0.25, 0.5)).select("row_id")


@query(_TYPED + ", t AS (SELECT row_id, len(alts) AS n, ref0 AS r, alt0[1] AS a FROM s) SELECT row_id FROM t WHERE n = 1 AND " + _TYPE + " IN ('SNP', 'DELETION')")
def filter_single_alt_type(spark, sf):
    return frame(spark, sf, "records").where(filters.single_alt_type(["SNP", "DELETION"])).select("row_id")


@query("SELECT row_id FROM {records} WHERE row_id % 3 = 0")
def filter_known(spark, sf):
    ids = F.when(F.col("row_id") % 3 == 0, F.array(F.lit("rs1"))).otherwise(F.array().cast("array<string>"))
    return frame(spark, sf, "records").withColumn("id", ids).where(filters.is_known()).select("row_id")


@query("""
SELECT row_id, CASE WHEN dp < 10 THEN CASE WHEN row_id % 5 = 0 THEN 'q10,LOW' ELSE 'LOW' END ELSE CASE row_id % 5 WHEN 0 THEN 'q10' WHEN 1 THEN 'PASS' ELSE '' END END AS filters,
 CASE WHEN dp < 10 THEN 'bad' END AS ft, CASE WHEN dp < 10 THEN '-1,-1' ELSE g1 || ',' || g2 END AS gt FROM {records}""")
def filter_mark_failures(spark, sf):
    df = _fields(frame(spark, sf, "records")).withColumn("failed", filters.first_failure({"DP": filters.in_range(F.col("dp"), 10)}))
    out = filters.mark_failures(df, label="LOW", sample_label="bad", reset_gt=True)
    return out.select("row_id", F.array_join("filters", ",").alias("filters"), F.try_element_at(F.col("samples")[0], F.lit("FT")).alias("ft"), F.array_join(F.transform(F.col("gts")[0], lambda a: a.cast("string")), ",").alias("gt"))


@query("SELECT seq_id FROM {reads} WHERE (seq_id = 3 OR seq_id BETWEEN 5 AND 9 OR seq_id >= 150 OR name LIKE '%a') AND seq_id >= 1 AND seq_id < 1000")
def filter_sequences(spark, sf):
    df = frame(spark, sf, "reads")
    names = df.where("name LIKE '%a'").select(F.collect_set("name")).first()[0]
    return filters.select_sequences(df, ids="3,5-9,150-", names=names, start=1, end=1000).select("seq_id")


_ALIGNED = """(SELECT l_orderkey * 100 + l_partkey % 100 AS id, 'r' || (l_orderkey % 5000) AS name, CAST(l_orderkey % 4096 AS INT) AS flag, CAST(l_partkey % 61 AS INT) AS mapq, CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_suppkey % 4 AS INT) END AS nh,
 CASE WHEN l_suppkey % 5 > 0 THEN CAST(l_partkey % 40 AS INT) END AS as_score, CAST(l_quantity AS INT) AS length, 'g' || (l_linenumber % 3) AS read_group, CAST(l_partkey - 10 AS INT) AS pos, CAST(l_suppkey % 3 AS INT) AS seq FROM lineitem)"""


def _aligned(spark, sf):
    text = _ALIGNED.replace("FROM lineitem", "FROM {lineitem}")
    return spark.sql(f"SELECT * FROM {text}", lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))


@query("SELECT id FROM " + _ALIGNED + """ WHERE (flag & 1) = 1 AND (flag & 1024) = 0 AND pos >= 0 AND mapq >= 10 AND (nh IS NULL OR nh <= 2) AND ((flag & 3) <> 3 OR as_score IS NULL OR as_score <= 20) AND ((flag & 3) = 3 OR as_score IS NULL OR as_score <= 30)
 AND length >= 5 AND length <= 45 AND read_group IN ('g0', 'g1')""")
def filter_alignments(spark, sf):
    keep = filters.sam_filters(min_mapq=10, require=1, forbid=1024, max_nh=2, max_as_mated=20, max_as_unmated=30, min_length=5, max_length=45, read_groups=["g0", "g1"], drop_unplaced=True)
    return _aligned(spark, sf).where(keep).select("id")


@query("SELECT id FROM (SELECT *, " + _HASH.replace("CAST(9 AS BIGINT)", "CAST(7 AS BIGINT)").replace("{}", "name") + " AS h FROM " + _ALIGNED + ") WHERE h < (0.2 + 0.6 * pos / 4096) * 65536")
def filter_alignments_ramp(spark, sf):
    keep = filters.sam_filters(subsample=0.2, subsample_end=0.8, seed=7)
    return _aligned(spark, sf).withColumn("seq_length", F.lit(4096)).where(keep).select("id")


@query("""
SELECT name, (flag & 192) AS arm, (flag & 256) AS secondary, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY name, flag & 192, flag & 256 ORDER BY seq, pos, flag) AS k FROM """ + _ALIGNED + """)
WHERE (flag & 256) = 0 OR k = 1 GROUP BY ALL""")
def filter_repeated_secondary(spark, sf):
    kept = filters.drop_repeated_secondary(_aligned(spark, sf))
    return kept.groupBy("name", F.col("flag").bitwiseAND(192).alias("arm"), F.col("flag").bitwiseAND(256).alias("secondary")).agg(F.count("*").alias("n"))


@query("SELECT seq, start, stop FROM {loci} WHERE start % 3 < 2 AND seq IN ('chr1', 'chr4') AND stop % 5 <> 0")
def filter_cnv_records(spark, sf):
    df = frame(spark, sf, "loci").withColumns({"svtype": F.element_at(F.array(*map(F.lit, ("DEL", "DUP", "INV"))), (F.col("start") % 3 + 1).cast("int")), "end": F.when(F.col("end") % 5 != 0, F.col("end"))})
    return filters.cnv_records(df, ["chr1", "chr4"]).select("seq", "start", F.col("end").alias("stop"))


@query("SELECT seq, start, stop FROM (SELECT *, lag(start) OVER (PARTITION BY seq ORDER BY stop * 10000 + start) AS p FROM {loci}) WHERE start < p")
def records_out_of_order(spark, sf):
    from ..operators import neighbours

    df = frame(spark, sf, "loci").withColumn("place", F.col("end").cast("long") * 10000 + F.col("start"))
    return neighbours.unsorted(df, "place").select("seq", "start", F.col("end").alias("stop"))


# ------------------------------------------------------------------ projections


@query("""
SELECT row_id, CASE WHEN row_id % 4 = 0 THEN 'X' ELSE '' END AS info, CASE WHEN row_id % 5 = 1 THEN 'PASS' ELSE '' END AS filters, 'DN,GQ' AS format, CAST(NULL AS DOUBLE) AS qual, 0 AS n_ids FROM {records}""")
def project_records(spark, sf):
    df = _fields(frame(spark, sf, "records")).withColumn("id", F.array(F.lit("rs")))
    df = merging.keep_info(df, ["DP"], remove=True)
    df = merging.keep_filters(df, ["PASS"])
    df = merging.keep_format(df, ["DN", "GQ"])
    df = merging.clear_id(merging.clear_qual(df))
    return df.select("row_id", F.array_join(F.array_sort(F.map_keys("info")), ",").alias("info"), F.array_join("filters", ",").alias("filters"), F.array_join(F.array_sort(F.map_keys(F.col("samples")[0])), ",").alias("format"), "qual", F.size("id").alias("n_ids"))


@query("SELECT row_id, 'one' AS samples, g1 || ',' || g2 AS gt FROM {records}")
def project_samples(spark, sf):
    df = merging.keep_samples(_samples(frame(spark, sf, "records")), ["s2"], ["s1", "s2"], remove=True)
    df = merging.rename_samples(df, {"s1": "one", "zz": "none"})
    return df.select("row_id", F.array_join(F.transform("samples", lambda s: s["sample"]), ",").alias("samples"), F.array_join(F.transform(F.col("samples")[0]["gt"], lambda a: a.cast("string")), ",").alias("gt"))


@query("SELECT row_id, CAST(dp + gq AS INT) AS a, CAST(g3 AS INT) AS b, dp AS kept FROM {records}")
def field_adjustment(spark, sf):
    df = frame(spark, sf, "records").withColumns({"ad": F.array("dp", "g3", "gq"), "m": F.array(F.lit(0), F.lit(1), F.lit(0))})
    summed, retained = decompose.adjust(F.col("ad"), F.col("m"), F.lit(2)), decompose.adjust(F.col("ad"), F.col("m"), F.lit(2), "RETAIN")
    return df.select("row_id", summed[0].alias("a"), summed[1].alias("b"), retained[0].alias("kept"))


_SUB = """
WITH m AS (SELECT id, list_transform(range(0, 8), lambda i: ['A','C','G','T'][1 + CAST((id // (i + 1)) % 4 AS INT)]) AS r, id % 8 AS x, (id // 8) % 8 AS y FROM (SELECT o_orderkey AS id FROM orders)),
 p AS (SELECT DISTINCT id, r, unnest([x, y]) AS k FROM m)"""


def _records_of(df):
    """Substituted bases as records with one heterozygous sample."""
    return df.select("id", (F.col("id") * 20).cast("int").alias("start"), "ref", F.array("alt").alias("alts"), F.array(F.array(F.lit(0), F.lit(1))).alias("gts"))


@query(_SUB + " SELECT id, CAST(id * 20 + k AS INT) AS start, r[k + 1] AS ref, translate(r[k + 1], 'ACGT', 'CGTA') AS alt, '0,1' AS gt FROM p")
def decompose_mnps(spark, sf):
    out = decompose.decompose(_records_of(_substituted(spark, sf)), break_mnps=True)
    return out.select("id", "start", "ref", F.col("alts")[0].alias("alt"), F.array_join(F.transform(F.col("gts")[0], lambda a: a.cast("string")), ",").alias("gt"))


@query(_SUB + """,
 q AS (SELECT id, r, min(k) AS lo, max(k) AS hi FROM p GROUP BY ALL),
 e AS (SELECT id, r, lo AS k, hi - lo + 1 AS n FROM q WHERE hi - lo = 1 UNION ALL SELECT id, r, unnest(list_distinct([lo, hi])), 1 FROM q WHERE hi - lo <> 1)
SELECT id, CAST(id * 20 + k AS INT) AS start, array_to_string(r[k + 1 : k + n], '') AS ref, translate(array_to_string(r[k + 1 : k + n], ''), 'ACGT', 'CGTA') AS alt, CAST(id * 20 + 1 AS INT) AS orp, 8 AS orl FROM e""")
def decompose_alleles(spark, sf):
    out = decompose.decompose(_records_of(_substituted(spark, sf)))
    return out.select("id", "start", "ref", F.col("alts")[0].alias("alt"), F.col("orp").cast("int").alias("orp"), F.col("orl").cast("int").alias("orl"))


@query("""
WITH d AS (SELECT o_orderkey AS id, ['G','C','T'][1 + CAST(o_orderkey % 3 AS INT)] || repeat('A', CAST(o_custkey % 4 AS INT) + 1) || 'GC' AS alt FROM orders)
SELECT id, CAST(id * 20 AS INT) AS start, alt[1] AS ref, alt[1] || repeat('A', len(alt) - 3) AS alt FROM d""")
def decompose_anchors(spark, sf):
    """Pure insertions after a first base that both alleles share: the part gets that base as its anchor."""
    df = spark.read.parquet(f"{sf}/orders.parquet")
    first = F.element_at(F.array(*map(F.lit, "GCT")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    df = df.select(F.col("o_orderkey").alias("id"), F.concat(first, F.lit("GC")).alias("ref"), F.concat(first, F.repeat(F.lit("A"), (F.col("o_custkey") % 4 + 1).cast("int")), F.lit("GC")).alias("alt"))
    out = decompose.decompose(_records_of(df))
    return out.select("id", "start", "ref", F.col("alts")[0].alias("alt"))


# ------------------------------------------------------------------ statistics

_CUT = "list_max(list_transform(range(0, len(r) + 1), lambda k: CASE WHEN r[1:k] = a[1:k] THEN k ELSE 0 END))"
_BACK = "list_max(list_transform(range(0, len(r) + 1), lambda k: CASE WHEN right(r, k) = right(a, k) THEN k ELSE 0 END))"
_CALLED = _TYPED + f""",
 c AS (SELECT row_id, 's1' AS sample, [g1, g2] AS gt, ref0, alt0 FROM s UNION ALL SELECT row_id, 's2', [g3], ref0, alt0 FROM s JOIN (SELECT row_id AS i, g3 FROM r) ON i = row_id),
 v AS (SELECT *, unnest(gt) AS allele, unnest(range(1, len(gt) + 1)) AS place FROM c WHERE list_max(gt) > 0 AND list_min(gt) >= 0),
 w AS (SELECT row_id, sample, gt, place, ref0 AS r, CASE WHEN allele = 0 THEN ref0 ELSE alt0[allele] END AS a FROM v),
 f AS (SELECT *, {_CUT} AS f, {_BACK} AS b FROM w),
 x AS (SELECT row_id, sample, gt, place, CASE WHEN len(r) > 1 AND len(r) = len(a) AND r <> a THEN r[f + 1 : len(r) - least(b, len(r) - f)] ELSE r END AS r, CASE WHEN len(r) > 1 AND len(r) = len(a) AND r <> a THEN a[f + 1 : len(r) - least(b, len(r) - f)] ELSE a END AS a FROM f),
 y AS (SELECT *, {_TYPE} AS t FROM x),
 z AS (SELECT row_id, sample, len(gt) AS n, max(t) FILTER (place = 1) AS t1, max(t) FILTER (place = 2) AS t2, max(a) FILTER (place = 1) AS a1, max(a) FILTER (place = 2) AS a2,
   count(*) FILTER (t = 'SNP' AND r || a IN ('AG', 'GA', 'CT', 'TC')) AS ti, count(*) FILTER (t = 'SNP' AND r || a NOT IN ('AG', 'GA', 'CT', 'TC')) AS tv FROM y GROUP BY row_id, sample, len(gt)),
 k AS (SELECT row_id, sample, n, CASE WHEN n = 1 THEN 'haploid' WHEN a1 = a2 THEN 'hom' ELSE 'het' END AS zygosity, {_JOIN} AS t, ti, tv FROM z)"""


@query(_CALLED + """, n AS (SELECT sample, count(*) FILTER (t = 'SNP') AS snp, count(*) FILTER (t = 'MNP') AS mnp, count(*) FILTER (t = 'DELETION') AS deletion, count(*) FILTER (t = 'INSERTION') AS insertion, count(*) FILTER (t = 'INDEL') AS indel,
  count(*) FILTER (t = 'SV_SYMBOLIC') AS sv_symbolic, CAST(sum(CASE WHEN t = 'SNP' THEN ti ELSE 0 END) AS BIGINT) AS transitions, CAST(sum(CASE WHEN t = 'SNP' THEN tv ELSE 0 END) AS BIGINT) AS transversions FROM k GROUP BY sample)
SELECT *, CASE WHEN transversions = 0 THEN '-' ELSE printf('%.2f (%d/%d)', transitions / transversions, transitions, transversions) END AS titv FROM n""")
def variant_statistics_types(spark, sf):
    out = stats.with_ratios(stats.per_sample(_samples(frame(spark, sf, "records"))))
    return out.select("sample", "snp", "mnp", "deletion", "insertion", "indel", "sv_symbolic", "transitions", "transversions", "titv")


@query(_CALLED + " SELECT sample, t AS type, count(*) FILTER (zygosity = 'het') AS het, count(*) FILTER (zygosity = 'hom') AS hom, count(*) FILTER (zygosity = 'haploid') AS haploid FROM k WHERE t <> 'SV_MISSING' GROUP BY sample, t")
def variant_statistics_zygosity(spark, sf):
    return stats.by_zygosity(_samples(frame(spark, sf, "records"))).select("sample", "type", "het", "hom", "haploid")


@query(_CALLED + """, h AS (SELECT t AS type, CASE WHEN t IN ('DELETION', 'INSERTION', 'INDEL') THEN abs(len(a) - len(r)) ELSE len(a) END AS length FROM y WHERE NOT starts_with(t, 'SV_') AND t <> 'UNCHANGED')
SELECT type, CAST(length AS BIGINT) AS length, count(*) AS n FROM h GROUP BY ALL""")
def variant_length_histogram(spark, sf):
    return stats.length_histogram(_samples(frame(spark, sf, "records")))


@query("SELECT CAST(len(list_distinct(list_filter([g1, g2, g3], lambda a: a >= 0))) AS INT) AS alleles, count(*) AS n FROM {records} GROUP BY 1")
def allele_count_histogram(spark, sf):
    return stats.allele_count_histogram(_samples(frame(spark, sf, "records")))


@query("SELECT CAST(x AS BIGINT) AS x, CAST(CASE WHEN x < 100 THEN x WHEN x < 10000 THEN x - x % 100 WHEN x < 1000000 THEN x - x % 10000 ELSE x - x % 1000000 END AS BIGINT) AS bin FROM (SELECT o_orderkey * o_custkey AS x FROM orders)")
def length_bins(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") * F.col("o_custkey")).alias("x")).select("x", stats.length_bin(F.col("x")).alias("bin"))


@query("SELECT position, CAST(round(1e6 * -10 * log10(avg(pow(10, -((position * 7 + seq_id) % 40) / 10)))) AS BIGINT) AS quality, count(*) AS n FROM (SELECT seq_id, CAST(unnest(range(0, len(residues))) AS INT) AS position FROM {reads}) GROUP BY position")
def quality_by_position(spark, sf):
    return reads.quality_by_position(_qualities(spark, sf)).select("position", F.round(F.col("quality") * 1e6).cast("long").alias("quality"), "n")


def _qualities(spark, sf):
    df = frame(spark, sf, "reads")
    return df.withColumn("quals", F.transform(F.sequence(F.lit(0), F.length("residues") - 1), lambda i: ((i * 7 + F.col("seq_id")) % 40).cast("int")))


# ------------------------------------------------------------------ ROC


@query(_CURVE + """,
 pr AS (SELECT c.subset, score, 100.0 * tp / n AS x, 100.0 * tp_raw / (tp_raw + fp) AS y, tp_raw, fp FROM c JOIN (SELECT subset, sum(tp) AS n FROM {calls} GROUP BY subset) t USING (subset) WHERE n > 0),
 a AS (SELECT subset, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM pr WINDOW w AS (PARTITION BY subset ORDER BY tp_raw, fp))
SELECT subset, CAST(round(coalesce(sum(a), 0) * 1000) AS BIGINT) AS area FROM a GROUP BY subset""".replace("100.0 *", "CAST(100 AS DOUBLE) *"))
def roc_precision_recall_area(spark, sf):
    calls = frame(spark, sf, "calls")
    totals = calls.groupBy("subset").agg(F.sum("tp").alias("n"))
    points = roc.metrics(roc.curve(calls, ("subset",)).join(totals, "subset").where("n > 0"), F.col("n"))
    return roc.precision_recall_area(points, ("subset",)).select("subset", F.round(F.col("area") * 1000).cast("long").alias("area"))


@query(_CURVE + """,
 h AS (SELECT subset, score, tp, fp FROM c UNION ALL SELECT DISTINCT subset, NULL, 0, 0 FROM c),
 hull AS (SELECT p.subset, p.score, min(m.up) AS slope FROM c p JOIN LATERAL (SELECT max((b.tp - a.tp) / greatest(CAST(b.fp - a.fp AS DOUBLE), 1e-9)) AS up FROM h a JOIN h b ON a.subset = p.subset AND b.subset = p.subset AND a.tp + a.fp < p.tp + p.fp AND b.tp + b.fp >= p.tp + p.fp GROUP BY a.tp, a.fp) m ON true GROUP BY p.subset, p.score)
SELECT subset, score, CASE WHEN slope > 1e6 THEN -1 ELSE CAST(round(slope * 1000) AS BIGINT) END AS slope FROM hull""")
def roc_hull_slope(spark, sf):
    """The hull's slope at a score: over all starts before it, the least of the steepest lines to a point at it or later (-1: upright)."""
    out = roc.hull_slope(roc.curve(frame(spark, sf, "calls"), ("subset",)), ("subset",))
    return out.select("subset", "score", F.when(F.col("slope") > 1e6, -1).otherwise(F.round(F.col("slope") * 1000)).cast("long").alias("slope"))


@query(_CURVE + """,
 m AS (SELECT c.*, CAST(tp_raw AS DOUBLE) / (tp_raw + fp) AS p, CAST(tp AS DOUBLE) / n AS r FROM c JOIN (SELECT subset, sum(tp) AS n FROM {calls} GROUP BY subset) t USING (subset) WHERE n > 0),
 a AS (SELECT subset, 'precision' AS kind, score, row_number() OVER (PARTITION BY subset ORDER BY tp_raw DESC, fp DESC) AS k FROM m WHERE p >= 0.7),
 b AS (SELECT subset, 'sensitivity' AS kind, score, row_number() OVER (PARTITION BY subset ORDER BY tp_raw, fp) AS k FROM m WHERE r >= 0.4)
SELECT subset, kind, score FROM a WHERE k = 1 UNION ALL SELECT subset, kind, score FROM b WHERE k = 1""")
def roc_operating_points(spark, sf):
    calls = frame(spark, sf, "calls")
    totals = calls.groupBy("subset").agg(F.sum("tp").alias("n"))
    points = roc.metrics(roc.curve(calls, ("subset",)).join(totals, "subset").where("n > 0"), F.col("n"))
    picked = {"precision": roc.at_precision(points, 0.7, ("subset",)), "sensitivity": roc.at_sensitivity(points, 0.4, ("subset",))}
    return picked["precision"].select("subset", F.lit("precision").alias("kind"), "score").unionByName(picked["sensitivity"].select("subset", F.lit("sensitivity").alias("kind"), "score"))


@query("SELECT row_id, 'ALL' AS subset FROM {records} UNION ALL SELECT row_id, 'HOM' FROM {records} WHERE g1 = g2 UNION ALL SELECT row_id, 'HET' FROM {records} WHERE g1 <> g2 UNION ALL SELECT row_id, 'deep' FROM {records} WHERE dp > 30")
def roc_subsets(spark, sf):
    df = frame(spark, sf, "records")
    usual = roc.standard_subsets(F.col("ref"), F.col("alts"), F.array("g1", "g2"))
    return roc.label_subsets(df, {k: usual[k] for k in ("ALL", "HOM", "HET")} | {"deep": F.col("dp") > 30}).select("row_id", "subset")


@query("SELECT row_id, CAST(gq AS DOUBLE) AS qual, CAST(dp AS DOUBLE) AS info, CASE WHEN gq % 7 <> 0 THEN CAST(gq AS DOUBLE) END AS format FROM {records}")
def roc_scores(spark, sf):
    return _fields(frame(spark, sf, "records")).select("row_id", roc.score_column("QUAL").alias("qual"), roc.score_column("INFO.DP").alias("info"), roc.score_column("GQ").alias("format"))


# ------------------------------------------------------------------ inheritance and pedigrees


@query("SELECT row_id, CAST(CASE WHEN row_id % 2 = 0 THEN CASE WHEN row_id % 4 = 0 THEN 1 ELSE 2 END ELSE 2 END AS INT) AS expected FROM {trios}")
def expected_ploidies(spark, sf):
    df = frame(spark, sf, "trios").select("row_id", F.when(F.col("row_id") % 2 == 0, "male").otherwise("female").alias("sex"), F.lit("X").alias("seq"), F.when(F.col("row_id") % 4 == 0, 100).otherwise(900).alias("start"))
    df = df.withColumn("end", F.col("start") + 3)
    table = spark.createDataFrame([("male", "X", 0, 500, 1), ("male", "X", 500, 2000, 2), ("female", "X", 0, 2000, 2)], "sex string, seq string, start int, end int, ploidy int")
    return inheritance.ploidy_expected(df, table).select("row_id", "expected")


@query("SELECT row_id, len(child) = 1 AS strict, len(child) = 1 OR (len(child) = 2 AND child[1] = child[2]) AS lenient FROM {trios}")
def ploidy_checks(spark, sf):
    df = frame(spark, sf, "trios")
    return df.select("row_id", inheritance.ploidy_ok(F.col("child"), F.lit(1)).alias("strict"), inheritance.ploidy_ok(F.col("child"), F.lit(1), lenient=True).alias("lenient"))


@query("""
WITH s AS (SELECT trio, CASE WHEN row_id % 5 = 0 THEN 2 WHEN row_id % 3 = 0 THEN 1 ELSE 0 END AS r FROM {trios})
SELECT trio, CASE max(r) WHEN 2 THEN 'inconsistent' WHEN 1 THEN 'incomplete' ELSE 'consistent' END AS outcome FROM s GROUP BY trio""")
def mendelian_routes(spark, sf):
    status = F.when(F.col("row_id") % 5 == 0, "inconsistent").when(F.col("row_id") % 3 == 0, "incomplete_unknown").otherwise("consistent")
    return inheritance.route(frame(spark, sf, "trios").withColumn("status", status), "trio")


@query("SELECT id FROM {pedigree} WHERE primary_ AND family IN (1, 2, 3, 4, 5, 6, 7, 8) AND sex = 'female'")
def pedigree_filter(spark, sf):
    return pedigree.filter_pedigree(frame(spark, sf, "pedigree"), primary=True, families_=range(1, 9), sex="female").select("id")


@query("WITH l AS (SELECT id AS second, unnest([parent_a, parent_b]) AS first FROM {pedigree}) SELECT first, second FROM l WHERE first IS NOT NULL AND first % 2 = 0 AND second % 2 = 0")
def pedigree_relationships(spark, sf):
    df = frame(spark, sf, "pedigree")
    return pedigree.relationships_among(df.where("id % 2 = 0"), _relations(df)).select("first", "second")


@query("SELECT id, unnest([parent_a, parent_b]) AS antecedent FROM {pedigree} WHERE parent_a IS NOT NULL UNION SELECT id, id - 1 FROM {pedigree} WHERE id % 7 = 0")
def pedigree_antecedents(spark, sf):
    df = frame(spark, sf, "pedigree")
    derived = df.where("id % 7 = 0").select((F.col("id") - 1).alias("first"), F.col("id").alias("second"), F.lit(pedigree.DERIVED).alias("type"))
    return pedigree.antecedents(_relations(df).unionByName(derived))


@query("SELECT line FROM (SELECT '  \"' || id || '\" [shape=' || CASE sex WHEN 'male' THEN 'box' ELSE 'ellipse' END || '];' AS line FROM {pedigree} UNION ALL SELECT '  \"' || p || '\" -> \"' || id || '\";' FROM (SELECT id, unnest([parent_a, parent_b]) AS p FROM {pedigree}) WHERE p IS NOT NULL)")
def pedigree_graph(spark, sf):
    df = frame(spark, sf, "pedigree")
    lines = pedigree.graphviz(df, _relations(df)).splitlines()[1:-1]
    return spark.createDataFrame([(x,) for x in lines], "line string")


# ------------------------------------------------------------------ structural


@query("""
WITH v AS (SELECT seq, start, stop, ['INS', 'INV', 'TRA'][1 + start % 3] AS t FROM {loci})
SELECT seq, start, 'A' AS ref, 'A[<INS_' || seq || '>:' || (start + 1) || '[' AS alt FROM v WHERE t = 'INS'
UNION ALL SELECT seq, start, 'A', ']<INS_' || seq || '>:' || (start + 8) || ']N' FROM v WHERE t = 'INS'
UNION ALL SELECT seq, start, 'A', '[' || seq || ':' || (stop + 1) || '[A' FROM v WHERE t = 'INV'
UNION ALL SELECT seq, stop, 'N', '[' || seq || ':' || (start + 1) || '[N' FROM v WHERE t = 'INV'
UNION ALL SELECT seq, start - 1, 'N', 'N]' || seq || ':' || stop || ']' FROM v WHERE t = 'INV'
UNION ALL SELECT seq, stop - 1, 'N', 'N]' || seq || ':' || start || ']' FROM v WHERE t = 'INV'
UNION ALL SELECT seq, start, 'A', 'A]chr9:' || (stop + 1) || ']' FROM v WHERE t = 'TRA'""")
def sv_breakends_other(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("INS", "INV", "TRA"))), (F.col("start") % 3 + 1).cast("int"))
    df = frame(spark, sf, "loci").withColumn("svtype", kind)
    df = df.select("seq", "start", "end", F.lit("A").alias("ref"), F.concat(F.lit("<"), "svtype", F.lit(">")).alias("alt"), "svtype", F.lit(7).alias("svlen"), F.when(F.col("svtype") == "TRA", "chr9").alias("chr2"), F.lit("3to3").alias("ct"))
    return structural.to_breakends(df)


@query("SELECT record, CAST(sum(hit) AS BIGINT) AS hit, CAST(sum(1 - hit) AS BIGINT) AS miss FROM (SELECT row_id % 40 AS record, CASE WHEN dp % 3 = 0 THEN 1 ELSE 0 END AS hit FROM {records}) GROUP BY record")
def cnv_record_hits(spark, sf):
    df = frame(spark, sf, "records").select(F.col("row_id").alias("id"), (F.col("row_id") % 40).alias("record"), "dp")
    return structural.record_hits(df, df.where("dp % 3 = 0").select("id"), "record").select("record", "hit", "miss")


# ------------------------------------------------------------------ reads

_QUALS = "list_transform(range(1, len(residues) + 1), lambda i: (i * 7) % 40)"
#: Sums of (threshold - quality) from one end while they stay at zero or more; the longest trim of the largest sum.
_TRIMMED = """
WITH q AS (SELECT seq_id, residues, {quals} AS q FROM {reads}),
 e AS (SELECT seq_id, residues, q, unnest(range(1, len(q) + 1)) AS i FROM q),
 s AS (SELECT seq_id, residues, q, i, sum(20 - q[len(q) - i + 1]) OVER (PARTITION BY seq_id ORDER BY i) AS s FROM e),
 o AS (SELECT *, min(s) OVER (PARTITION BY seq_id ORDER BY i) >= 0 AS ok FROM s),
 c AS (SELECT seq_id, coalesce(arg_max(i, row(s, i)) FILTER (ok), 0) AS cut FROM o GROUP BY seq_id)
SELECT q.seq_id, q.residues[1 : len(q.q) - CASE WHEN q.q[len(q.q)] < 20 THEN cut ELSE 0 END] AS residues FROM q JOIN c USING (seq_id)
WHERE len(q.q) - CASE WHEN q.q[len(q.q)] < 20 THEN cut ELSE 0 END >= 3""".replace("{quals}", _QUALS)


@query(_TRIMMED)
def trim_reads_end_quality(spark, sf):
    df = frame(spark, sf, "reads").withColumn("quals", F.transform(F.sequence(F.lit(1), F.length("residues")), lambda i: (i * 7) % 40))
    return reads.trim(df, end_quality=20, min_length=3, discard_empty=True).select("seq_id", "residues")


@query("SELECT CAST(2 * seq_id AS BIGINT) AS place, residues FROM {reads} UNION ALL SELECT CAST(2 * seq_id + 1 AS BIGINT), reverse(residues) FROM {reads}")
def interleave_reads(spark, sf):
    df = frame(spark, sf, "reads").select("seq_id", "residues")
    return reads.interleave(df, df.withColumn("residues", F.reverse("residues"))).select("place", "residues")
