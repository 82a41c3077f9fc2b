"""Queries that apply the operators to the lenses, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import alleles as A
from ..functions import annotations as X
from ..operators import filters, inheritance, intervals, merging, neighbours, pedigree, reads, roc, stats, structural
from ..streaming import ordered
from .lenses import frame
from .registry import query


def _stop(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"end": "stop", "b_end": "b_stop"})


# ------------------------------------------------------------------ intervals

_MERGE = """
{name} AS (SELECT seq, min(start) AS start, max(stop) AS stop FROM (SELECT *, sum(fresh) OVER (PARTITION BY seq ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM (
  SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY seq ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY seq, island)"""


def _merged(name: str, source: str) -> str:
    return _MERGE.replace("{name}", name).replace("{source}", source)


@query("WITH " + _merged("m", "{loci}") + " SELECT * FROM m")
def interval_merge(spark, sf):
    return _stop(intervals.merge(frame(spark, sf, "loci")))


@query("WITH " + _merged("m", "{loci}") + " SELECT seq, CAST(sum(stop - start) AS BIGINT) AS covered, count(*) AS regions FROM m GROUP BY seq")
def interval_coverage(spark, sf):
    return intervals.covered(frame(spark, sf, "loci"))


@query("WITH " + _merged("a", "{loci}") + "," + _merged("b", "{regions}") + ", x AS (SELECT a.seq, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop FROM a JOIN b ON a.seq = b.seq AND a.start < b.stop AND a.stop > b.start)," + _merged("m", "x") + " SELECT * FROM m")
def interval_intersect(spark, sf):
    return _stop(intervals.intersect(frame(spark, sf, "loci"), frame(spark, sf, "regions")))


@query("WITH " + _merged("u", "(SELECT seq, start, stop FROM {loci} UNION ALL SELECT seq, start, stop FROM {regions})") + " SELECT * FROM u")
def interval_union(spark, sf):
    return _stop(intervals.union(frame(spark, sf, "loci"), frame(spark, sf, "regions")))


@query(
    "WITH " + _merged("a", "{loci}") + "," + _merged("b", "{regions}") + """,
 cuts AS (SELECT a.seq, a.start AS a0, a.stop AS a1, b.start AS b0, b.stop AS b1 FROM a LEFT JOIN b ON a.seq = b.seq AND a.start < b.stop AND a.stop > b.start),
 gaps AS (SELECT seq, a0, a1, coalesce(lag(b1) OVER w, a0) AS g0, coalesce(b0, a1) AS g1 FROM cuts WINDOW w AS (PARTITION BY seq, a0, a1 ORDER BY b0)
   UNION ALL SELECT seq, a0, a1, max(b1), a1 FROM cuts WHERE b1 IS NOT NULL GROUP BY seq, a0, a1),
 s AS (SELECT seq, greatest(g0, a0) AS start, least(g1, a1) AS stop FROM gaps WHERE greatest(g0, a0) < least(g1, a1)),"""
    + _merged("m", "s") + " SELECT * FROM m"
)
def interval_subtract(spark, sf):
    return _stop(intervals.subtract(frame(spark, sf, "loci"), frame(spark, sf, "regions")))


@query("SELECT a.seq, a.start, a.stop, b.start AS b_start, b.stop AS b_stop, b.label FROM {loci} a JOIN {regions} b ON a.seq = b.seq AND a.start < b.stop AND a.stop > b.start")
def interval_overlap_join(spark, sf):
    return _stop(intervals.overlap_join(frame(spark, sf, "loci"), frame(spark, sf, "regions"), 64))


@query("SELECT a.seq, a.start, a.stop, coalesce(string_agg(DISTINCT b.label, ',' ORDER BY b.label), '') AS labels FROM {loci} a LEFT JOIN {regions} b ON a.seq = b.seq AND a.start < b.stop AND a.stop > b.start GROUP BY ALL")
def interval_annotate(spark, sf):
    out = intervals.annotate(frame(spark, sf, "loci"), frame(spark, sf, "regions"), "label", "labels", width=64)
    return _stop(out.withColumn("labels", F.array_join("labels", ",")))


@query("SELECT a.* FROM {loci} a WHERE EXISTS (SELECT 1 FROM {regions} b WHERE a.seq = b.seq AND a.start < b.stop AND a.stop > b.start)")
def filter_include_regions(spark, sf):
    return _stop(intervals.keep_overlapping(frame(spark, sf, "loci"), frame(spark, sf, "regions"), 64))


@query("WITH " + _merged("m", "{regions}") + " SELECT a.* FROM {loci} a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE a.seq = b.seq AND b.start <= a.start AND a.stop <= b.stop)")
def filter_exclude_regions(spark, sf):
    return _stop(intervals.drop_enclosed(frame(spark, sf, "loci"), frame(spark, sf, "regions"), 64))


@query("""
WITH p AS (SELECT DISTINCT seq, start AS pos FROM {regions} UNION SELECT DISTINCT seq, stop FROM {regions}),
 r AS (SELECT * FROM (SELECT seq, pos AS start, lead(pos) OVER (PARTITION BY seq ORDER BY pos) AS stop FROM p) WHERE stop IS NOT NULL)
SELECT r.seq, r.start, r.stop, string_agg(DISTINCT g.label, ',' ORDER BY g.label) AS labels FROM r JOIN {regions} g ON r.seq = g.seq AND g.start <= r.start AND r.stop <= g.stop GROUP BY ALL""")
def interval_elementary(spark, sf):
    out = intervals.elementary(frame(spark, sf, "regions"), "label", 64)
    return _stop(out.withColumn("labels", F.array_join("labels", ",")))


@query("SELECT seq, CAST(start AS INT) AS start, CAST(least(start + 100, length) AS INT) AS stop FROM (SELECT seq, length, unnest(range(0, length, 100)) AS start FROM (SELECT seq, CAST(max(stop) AS BIGINT) AS length FROM {regions} GROUP BY seq))")
def interval_tiles(spark, sf):
    return _stop(intervals.tiles(frame(spark, sf, "regions").groupBy("seq").agg(F.max("end").alias("length")), 100))


@query("SELECT a.seq, a.start, max(b.start) AS as_of FROM (SELECT DISTINCT seq, start FROM {loci}) a LEFT JOIN (SELECT DISTINCT seq, start FROM {regions}) b ON a.seq = b.seq AND b.start <= a.start - 1 GROUP BY ALL")
def interval_as_of(spark, sf):
    return intervals.as_of(frame(spark, sf, "loci").select("seq", "start").distinct(), frame(spark, sf, "regions"), "start", 1)


# ------------------------------------------------------------------ neighbours and filters


@query("""
SELECT seq, start, stop FROM (SELECT *, coalesce(start - lag(start) OVER w <= 4, false) AS a, coalesce(lead(start) OVER w - start <= 4, false) AS b
  FROM {loci} WINDOW w AS (PARTITION BY seq ORDER BY start, stop)) WHERE NOT a AND NOT b""")
def filter_density_window(spark, sf):
    return _stop(neighbours.density_window(frame(spark, sf, "loci"), 4, "start"))


@query("""
WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY start, stop) AS n FROM {loci}),
 k(seq, n, start, stop) AS (SELECT seq, n, start, stop FROM o WHERE n = 1
   UNION ALL SELECT seq, n, start, stop FROM (SELECT o.seq, o.n, o.start, o.stop, row_number() OVER (PARTITION BY o.seq ORDER BY o.n) AS r FROM k JOIN o ON o.seq = k.seq AND o.n > k.n AND o.start >= k.stop) WHERE r = 1)
SELECT seq, start, stop FROM k""")
def filter_remove_overlapping(spark, sf):
    return _stop(neighbours.remove_overlapping(frame(spark, sf, "loci")))


@query("""
WITH v AS (SELECT *, seq || ':' || start || '-' || stop AS row_id FROM {loci})
SELECT a.row_id, count(b.row_id) AS cluster FROM v a LEFT JOIN v b ON a.seq = b.seq AND a.row_id <> b.row_id AND a.start <= b.stop + 5 AND b.start <= a.stop + 5 GROUP BY a.row_id""")
def window_cluster_count(spark, sf):
    loci = frame(spark, sf, "loci")
    return neighbours.cluster_count(loci.withColumn("row_id", F.concat("seq", F.lit(":"), "start", F.lit("-"), "end")), 5).select("row_id", F.col("cluster").cast("long").alias("cluster"))


@query("SELECT a.seq, a.start, a.stop, EXISTS (SELECT 1 FROM {regions} b WHERE a.seq = b.seq AND a.start - 30 < b.stop AND a.stop + 30 > b.start) AS loose FROM {loci} a")
def window_loose_match(spark, sf):
    return _stop(neighbours.loose_matches(frame(spark, sf, "loci"), frame(spark, sf, "regions"), 30, 128))


@query("SELECT coalesce(criterion, 'WRITTEN') AS criterion, count(*) AS n FROM (SELECT CASE WHEN len(alts) + 1 > 2 AND dp < 3 THEN 'ALLELES' WHEN dp < 10 THEN 'DEPTH' WHEN gq < 20 THEN 'GQ' WHEN NOT (g1 > 0 OR g2 > 0) THEN 'REF' END AS criterion FROM {records}) GROUP BY 1")
def filter_first_failure(spark, sf):
    criteria = {
        "ALLELES": (F.col("dp") >= 3) | filters.allele_count(None, 2),
        "DEPTH": filters.in_range(F.col("dp"), 10),
        "GQ": filters.in_range(F.col("gq"), 20),
        "REF": A.is_variant(F.array("g1", "g2")),
    }
    return filters.counters(frame(spark, sf, "records").withColumn("failed", filters.first_failure(criteria)))


@query("""
SELECT row_id FROM {records} WHERE NOT (len(ref) > 1 OR (g1 > 0 AND g1 <= len(alts) AND len(alts[g1]) > 1) OR (g2 > 0 AND g2 <= len(alts) AND len(alts[g2]) > 1)) AND NOT (g1 = g2)""")
def filter_snps_het(spark, sf):
    df = frame(spark, sf, "records").withColumn("gts", F.array(F.array("g1", "g2")))
    return df.where(filters.snps_only() & filters.not_hom()).select("row_id")


# ------------------------------------------------------------------ records

_PAD = "(len(list_filter(alts, lambda x: x[1] <> '*')) > 0 AND list_bool_and(list_transform(list_filter(alts, lambda x: x[1] <> '*'), lambda x: x[1] = ref[1])))"
_TYPED = """
WITH r AS (SELECT *, """ + _PAD + """ AS pad FROM {records}),
 s AS (SELECT row_id, alts, g1, g2, CASE WHEN pad THEN substr(ref, 2) ELSE ref END AS ref0, list_transform(alts, lambda x: CASE WHEN pad AND x[1] <> '*' THEN substr(x, 2) ELSE x END) AS alt0 FROM r)"""
_TYPE = """CASE WHEN r = a THEN 'UNCHANGED' WHEN len(r) = 1 AND len(a) = 1 AND a <> '*' THEN 'SNP' WHEN a[1] = '<' THEN 'SV_SYMBOLIC' WHEN a[1] = '*' THEN 'SV_MISSING' WHEN len(r) = len(a) THEN 'MNP'
 WHEN list_bool_or(list_transform(range(0, least(len(r), len(a)) + 1), lambda k: substr(r, 1, CAST(k AS BIGINT)) = substr(a, 1, CAST(k AS BIGINT)) AND right(r, CAST(least(len(r), len(a)) - k AS BIGINT)) = right(a, CAST(least(len(r), len(a)) - k AS BIGINT)))) THEN CASE WHEN len(r) < len(a) THEN 'INSERTION' ELSE 'DELETION' END ELSE 'INDEL' END"""


@query(_TYPED + ", t AS (SELECT row_id, i AS allele, ref0 AS r, alt0[i] AS a FROM (SELECT *, unnest(range(1, len(alt0) + 1)) AS i FROM s)) SELECT row_id, CAST(allele AS INT) AS allele, " + _TYPE + " AS type FROM t")
def allele_types(spark, sf):
    df = frame(spark, sf, "records").withColumn("s", A.unpadded(F.col("ref"), F.col("alts")))
    each = df.select("row_id", F.col("s")[0].alias("r"), F.posexplode(F.slice("s", 2, F.size("s") - 1)).alias("i", "a"))
    return each.select("row_id", (F.col("i") + 1).alias("allele"), A.allele_type(F.col("r"), F.col("a")).alias("type"))


@query("""
SELECT row_id, CAST(len(alts) AS INT) AS naa, CAST(greatest(len(ref), list_max(list_transform(alts, lambda x: len(x)))) AS INT) AS lal,
  array_to_string(list_transform(range(1, len(alts) + 1), lambda i: len(list_filter([g1, g2, g3], lambda a: a = i))), ',') AS ac,
  CAST(len(list_filter([g1, g2, g3], lambda a: a >= 0)) AS INT) AS an,
  CASE WHEN g1 >= 0 AND g2 >= 0 THEN CASE WHEN g1 <> g2 THEN 'e' ELSE 'o' END END AS zy, CASE WHEN g1 >= 0 AND g2 >= 0 THEN 'd' END AS pd,
  CASE WHEN g1 < 0 AND g2 < 0 THEN NULL WHEN g1 = g2 OR g1 < 0 OR g2 < 0 THEN CASE WHEN greatest(g1, g2) = 0 THEN 'RR' ELSE 'AA' END WHEN g1 = 0 OR g2 = 0 THEN 'RA' ELSE 'AB' END AS ra
FROM {records}""")
def derived_annotations(spark, sf):
    df = frame(spark, sf, "records").withColumns({"gt": F.array("g1", "g2"), "gts": F.array(F.array("g1", "g2"), F.array("g3"))})
    return df.select(
        "row_id", X.n_alts(F.col("alts")).alias("naa"), X.longest_allele(F.col("ref"), F.col("alts")).alias("lal"),
        F.array_join(F.transform(X.allele_counts(F.col("alts"), F.col("gts")), lambda n: n.cast("string")), ",").alias("ac"), X.n_called(F.col("gts")).alias("an"),
        X.zygosity(F.col("gt")).alias("zy"), X.ploidy(F.col("gt")).alias("pd"), X.ref_alt(F.col("gt")).alias("ra"),
    )


def _samples(df: DataFrame) -> DataFrame:
    call = lambda name, gt, phased: F.struct(F.lit(name).alias("sample"), gt.alias("gt"), phased.alias("phased"))
    return df.withColumn("samples", F.array(call("s1", F.array("g1", "g2"), F.col("dp") % 2 == 0), call("s2", F.array("g3"), F.lit(False))))


@query(_TYPED + """,
 c AS (SELECT row_id, 's1' AS sample, [s.g1, s.g2] AS gt, ref0, alt0, dp % 2 = 0 AS phased FROM s JOIN (SELECT row_id AS i, dp FROM r) ON i = row_id
   UNION ALL SELECT row_id, 's2', [g3], ref0, alt0, false FROM s JOIN (SELECT row_id AS i, g3 FROM r) ON i = row_id),
 k AS (SELECT *, CASE WHEN list_max(gt) < 0 THEN 'missing' WHEN list_min(gt) < 0 THEN 'partial' WHEN list_max(gt) = 0 THEN 'unchanged' ELSE 'variant' END AS kind FROM c)
SELECT sample, count(*) FILTER (kind = 'missing') AS missing, count(*) FILTER (kind = 'unchanged') AS unchanged, count(*) FILTER (kind = 'variant') AS variant, count(*) FILTER (phased) AS phased,
 count(*) FILTER (kind = 'variant' AND len(gt) = 1) AS haploid, count(*) FILTER (kind = 'variant' AND len(gt) = 2 AND gt[1] = gt[2]) AS hom, count(*) FILTER (kind = 'variant' AND len(gt) = 2 AND gt[1] <> gt[2]) AS het FROM k GROUP BY sample""")
def variant_statistics(spark, sf):
    return stats.per_sample(_samples(frame(spark, sf, "records"))).select("sample", "missing", "unchanged", "variant", "phased", "haploid", "hom", "het")


@query("""
WITH a AS (SELECT seq, start, stop FROM {loci} WHERE start % 3 < 2), b AS (SELECT seq, start, stop FROM {loci} WHERE start % 3 > 0)
SELECT CASE WHEN b.seq IS NULL THEN 'first_only' WHEN a.seq IS NULL THEN 'second_only' WHEN a.stop = b.stop THEN 'same' ELSE 'different' END AS outcome, count(*) AS n FROM a FULL JOIN b ON a.seq = b.seq AND a.start = b.start GROUP BY 1""")
def compare_positions(spark, sf):
    loci = frame(spark, sf, "loci")
    return merging.compare_positions(loci.where("start % 3 < 2"), loci.where("start % 3 > 0"), ["end"])


@query("""
WITH f AS (SELECT row_id % 3 AS file, seq, CAST(floor(start / 30.0) AS INT) AS start, ref, [list_filter(alts, lambda x: x <> ref)[1]] AS alts, row_id FROM {records} WHERE alts[1] <> ref),
 d AS (SELECT file, seq, start, ref, min(alts[1]) AS alt FROM f GROUP BY ALL),
 g AS (SELECT seq, start, ref, alt[1] = ref[1] AS pad, min(file) AS first, alt FROM d GROUP BY ALL)
SELECT seq, start, ref, string_agg(alt, ',' ORDER BY first, alt) AS alts FROM g GROUP BY seq, start, ref, pad""")
def merge_records(spark, sf):
    alts = F.col("alts")[0]
    df = frame(spark, sf, "records").where(F.col("alts")[0] != F.col("ref"))
    one = df.groupBy((F.col("row_id") % 3).alias("file"), "seq", F.floor(F.col("start") / 30).cast("int").alias("start"), "ref").agg(F.min(alts).alias("alt"))
    empty = F.array().cast("array<string>")
    full = one.select("file", "seq", "start", "ref", F.array("alt").alias("alts"), empty.alias("id"), F.lit(1.0).alias("qual"), empty.alias("filters"), F.array(F.struct(F.concat(F.lit("s"), "file").alias("sample"), F.array(F.lit(0), F.lit(1)).alias("gt"))).alias("samples"))
    return merging.merge_records(full).select("seq", "start", "ref", F.array_join("alts", ",").alias("alts"))


@query("""
WITH c AS (SELECT seq, CAST(floor(start / 12.0) AS INT) AS bin, least(g1, g3) AS a, greatest(g1, g3) AS b, count(*) AS n FROM {records} GROUP BY ALL),
 m AS (SELECT seq, bin, max(row(n, a, b)) AS top, sum(n) AS total FROM (SELECT seq, bin, a, b, n FROM c) GROUP BY seq, bin)
SELECT seq, bin, CASE WHEN t.n > 0.75 * total THEN CAST(t.a AS VARCHAR) || '/' || CAST(t.b AS VARCHAR) ELSE '-1/-1' END AS gt
FROM (SELECT seq, bin, total, {'n': struct_extract(top, 1), 'a': struct_extract(top, 2), 'b': struct_extract(top, 3)} AS t FROM m)""")
def majority_genotype(spark, sf):
    df = frame(spark, sf, "records").select("seq", F.floor(F.col("start") / 12).cast("int").alias("bin"), F.array("g1", "g3").alias("gt"))
    out = merging.majority_genotype(df, ["seq", "bin"])
    return out.select("seq", "bin", F.array_join(F.transform("gt", lambda a: a.cast("string")), "/").alias("gt"))


@query("SELECT row_id, array_to_string(list_filter(alts, lambda x, i: i = g1 OR i = g2), ',') AS alts FROM {records}")
def clean_alts(spark, sf):
    df = frame(spark, sf, "records").withColumn("gts", F.array(F.array("g1", "g2")))
    return merging.clean_alts(df).select("row_id", F.array_join("alts", ",").alias("alts"))


@query("SELECT name, count(*) AS n FROM (SELECT substr(name, 1, 8) AS name FROM {reads}) GROUP BY name HAVING count(*) > 1")
def duplicate_names(spark, sf):
    return merging.duplicate_names(frame(spark, sf, "reads").select(F.substring("name", 1, 8).alias("name")))


# ------------------------------------------------------------------ ROC

_CURVE = """
WITH p AS (SELECT subset, CAST(score AS DOUBLE) AS score, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tp_raw) AS BIGINT) AS tp_raw FROM {calls} GROUP BY subset, score),
 c AS (SELECT subset, score, CAST(sum(tp) OVER w AS BIGINT) AS tp, CAST(sum(fp) OVER w AS BIGINT) AS fp, CAST(sum(tp_raw) OVER w AS BIGINT) AS tp_raw FROM p WINDOW w AS (PARTITION BY subset ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query(_CURVE + " SELECT * FROM c")
def roc_curve(spark, sf):
    return roc.curve(frame(spark, sf, "calls"), ("subset",))


@query(_CURVE + """,
 m AS (SELECT c.*, tp_raw / (tp_raw + fp) AS precision, tp / n AS sensitivity FROM c JOIN (SELECT subset, sum(tp) AS n FROM {calls} GROUP BY subset) t USING (subset)),
 f AS (SELECT *, CASE WHEN precision + sensitivity > 0 THEN 2 * precision * sensitivity / (precision + sensitivity) ELSE 0 END AS f_measure FROM m)
SELECT subset, score, tp, fp FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY f_measure DESC, tp_raw DESC, fp DESC) AS r FROM f) WHERE r = 1""")
def roc_best_threshold(spark, sf):
    calls = frame(spark, sf, "calls")
    totals = calls.groupBy("subset").agg(F.sum("tp").alias("n"))
    points = roc.metrics(roc.curve(calls, ("subset",)).join(totals, "subset"), F.col("n"))
    return roc.best_f_measure(points, ("subset",)).select("subset", "score", "tp", "fp")


# ------------------------------------------------------------------ structural


@query("""
WITH v AS (SELECT seq, start, stop, (ARRAY['DEL', 'DUP'])[1 + start % 2] AS svtype FROM {loci})
SELECT seq, p AS start, r AS ref, t AS alt FROM (
 SELECT seq, start AS p, 'A' AS r, CASE svtype WHEN 'DEL' THEN 'A[' || seq || ':' || stop || '[' ELSE ']' || seq || ':' || (stop + 1) || ']A' END AS t FROM v
 UNION ALL SELECT seq, CASE svtype WHEN 'DEL' THEN stop - 1 ELSE stop END, 'N', CASE svtype WHEN 'DEL' THEN ']' || seq || ':' || (start + 1) || ']A' ELSE 'N[' || seq || ':' || (start + 1) || '[' END FROM v)""")
def sv_breakends(spark, sf):
    df = frame(spark, sf, "loci")
    dup = F.col("start") % 2 == 1
    df = df.select("seq", "start", "end", F.lit("A").alias("ref"), F.when(dup, "<DUP:TANDEM>").otherwise("<DEL>").alias("alt"), F.when(dup, "DUP").otherwise("DEL").alias("svtype"), F.lit(None).cast("int").alias("svlen"), F.lit(None).cast("string").alias("chr2"), F.lit(None).cast("string").alias("ct"))
    return structural.to_breakends(df)


_BND = "(SELECT start * 100000 + stop AS id, seq AS x_seq, start AS x, start % 2 = 0 AS x_up, seq AS y_seq, stop * 3 AS y, stop % 2 = 0 AS y_up FROM {source})"


def _bnd(df: DataFrame) -> DataFrame:
    return df.select((F.col("start").cast("long") * 100000 + F.col("end")).alias("id"), F.col("seq").alias("x_seq"), F.col("start").alias("x"), (F.col("start") % 2 == 0).alias("x_up"), F.col("seq").alias("y_seq"), (F.col("end") * 3).alias("y"), (F.col("end") % 2 == 0).alias("y_up"))


@query("""
WITH b AS """ + _BND.replace("{source}", "{regions}").replace("start * 100000", "CAST(start AS BIGINT) * 100000") + ", c AS " + _BND.replace("{source}", "{loci}").replace("start * 100000", "CAST(start AS BIGINT) * 100000") + """
SELECT DISTINCT b.id AS baseline_id, c.id AS call_id FROM b JOIN c USING (x_seq, x_up, y_seq, y_up) WHERE abs(b.x - c.x) <= 20 AND abs(b.y - c.y) <= 20
 AND abs((CASE WHEN x_up THEN 1 ELSE -1 END) * (b.x - c.x) + (CASE WHEN y_up THEN 1 ELSE -1 END) * (b.y - c.y)) <= 20""")
def sv_match_breakends(spark, sf):
    return structural.match_breakends(_bnd(frame(spark, sf, "regions")), _bnd(frame(spark, sf, "loci")), 10)


@query("""
SELECT a.seq, greatest(a.start, b.start) AS start, least(a.stop, b.stop) AS stop, CASE WHEN a.start <= b.start AND a.stop >= b.stop THEN 'FULL' ELSE 'PARTIAL' END AS span, a.start AS record_start, a.stop AS record_stop
FROM {loci} a JOIN (SELECT DISTINCT seq, start, stop FROM {regions}) b ON a.seq = b.seq AND a.start < b.stop AND a.stop > b.start""")
def cnv_split_by_regions(spark, sf):
    out = structural.split_by_regions(frame(spark, sf, "loci"), frame(spark, sf, "regions").select("seq", "start", "end").distinct(), 64)
    return _stop(out).withColumnRenamed("record_end", "record_stop")


def _cnv(df: DataFrame) -> DataFrame:
    return df.select((F.col("start").cast("long") * 100000 + F.col("end")).alias("id"), "seq", "start", "end", F.when(F.col("start") % 2 == 0, "DEL").otherwise("DUP").alias("kind")).dropDuplicates(["id", "seq"])


@query()
def cnv_greedy_match(spark, sf):
    return structural.match_cnvs(_cnv(frame(spark, sf, "regions")), _cnv(frame(spark, sf, "loci")))


# ------------------------------------------------------------------ inheritance, pedigree, taxonomy

_STATE = "CASE WHEN {a} < 0 THEN 1 WHEN list_contains({g}, {a}) THEN 2 WHEN list_contains({g}, -1) THEN 1 ELSE 0 END"


def _state(g: str, i: int) -> str:
    return _STATE.replace("{a}", f"child[{i}]").replace("{g}", g)


@query(f"""
WITH t AS (SELECT *, {_state('father', 1)} AS f1, {_state('father', 2)} AS f2, {_state('mother', 1)} AS m1, {_state('mother', 2)} AS m2 FROM {{trios}} WHERE list_max(child) >= 0 AND greatest(list_max(father), list_max(mother), list_max(child)) > 0)
SELECT row_id, CASE WHEN len(child) = 1 THEN CASE WHEN len(mother) > 1 THEN CASE m1 WHEN 1 THEN 'incomplete_unknown' WHEN 0 THEN 'inconsistent' ELSE CASE WHEN list_contains(mother, -1) THEN 'incomplete_consistent' ELSE 'consistent' END END
   WHEN len(father) > 1 THEN CASE f1 WHEN 1 THEN 'incomplete_unknown' WHEN 0 THEN 'inconsistent' ELSE CASE WHEN list_contains(father, -1) THEN 'incomplete_consistent' ELSE 'consistent' END END
   WHEN f1 = 0 AND m1 = 0 THEN 'inconsistent' ELSE 'consistent' END
 WHEN child[1] = child[2] THEN CASE WHEN f1 = 1 AND m1 = 1 THEN 'incomplete_unknown' WHEN f1 = 1 OR m1 = 1 THEN CASE WHEN f1 = 0 OR m1 = 0 THEN 'incomplete_inconsistent' ELSE 'incomplete_unknown' END
   WHEN list_contains(father, -1) OR list_contains(mother, -1) THEN CASE WHEN f1 = 2 AND m1 = 2 THEN 'incomplete_consistent' ELSE 'incomplete_inconsistent' END WHEN f1 = 2 AND m1 = 2 THEN 'consistent' ELSE 'inconsistent' END
 WHEN f1 <> 1 AND f2 <> 1 AND m1 <> 1 AND m2 <> 1 THEN CASE WHEN (f1 = 2 AND m2 = 2) OR (m1 = 2 AND f2 = 2) THEN 'consistent' ELSE 'inconsistent' END
 WHEN (f1 = 0 AND f2 = 0) OR (m1 = 0 AND m2 = 0) OR (f1 = 0 AND m1 = 0) OR (f2 = 0 AND m2 = 0) THEN 'incomplete_inconsistent'
 WHEN (f1 = 2 AND m2 = 2) OR (m1 = 2 AND f2 = 2) THEN 'incomplete_consistent' ELSE 'incomplete_unknown' END AS status FROM t""")
def mendelian_status(spark, sf):
    return inheritance.check_trios(frame(spark, sf, "trios")).select("row_id", "status")


_TEXT = "array_to_string(list_sort({g}), '/')"


@query(f"""
WITH t AS (SELECT least({_TEXT.replace('{g}', 'father')}, {_TEXT.replace('{g}', 'mother')}) AS parent_a, greatest({_TEXT.replace('{g}', 'father')}, {_TEXT.replace('{g}', 'mother')}) AS parent_b, {_TEXT.replace('{g}', 'child')} AS child_gt
  FROM {{trios}} WHERE len(father) = 2 AND len(mother) = 2 AND len(child) = 2 AND NOT list_contains(father || mother || child, -1))
SELECT *, CAST(sum(n) OVER (PARTITION BY parent_a, parent_b) AS BIGINT) AS total FROM (SELECT parent_a, parent_b, child_gt, count(*) AS n FROM t GROUP BY ALL)""")
def genotype_proportions(spark, sf):
    return inheritance.genotype_proportions(frame(spark, sf, "trios"), diploid_only=True)


@query("""
WITH p AS (SELECT trio, CASE WHEN len(father) <> 2 OR len(child) <> 2 OR list_contains(father || child, -1) THEN 'ignored' WHEN father = child THEN 'same' WHEN list_has_any(father, child) THEN 'parent' ELSE 'unrelated' END AS f FROM {trios})
SELECT trio, count(*) FILTER (f = 'ignored') AS father_ignored, count(*) FILTER (f = 'unrelated') AS father_unrelated, count(*) FILTER (f = 'parent') AS father_parent, count(*) FILTER (f = 'same') AS father_same FROM p GROUP BY trio""")
def trio_concordance(spark, sf):
    return inheritance.concordance(frame(spark, sf, "trios"), ("trio",), 20).select("trio", "father_ignored", "father_unrelated", "father_parent", "father_same")


def _relations(df: DataFrame) -> DataFrame:
    each = df.select(F.col("id").alias("second"), F.explode(F.array_compact(F.array("parent_a", "parent_b"))).alias("first"))
    return each.select("first", "second", F.lit(pedigree.PARENT).alias("type"))


@query("SELECT c.id AS child, CASE WHEN a.sex = 'male' THEN a.id ELSE b.id END AS father, CASE WHEN a.sex = 'male' THEN b.id ELSE a.id END AS mother FROM {pedigree} c JOIN {pedigree} a ON a.id = c.parent_a JOIN {pedigree} b ON b.id = c.parent_b WHERE a.sex <> b.sex")
def pedigree_families(spark, sf):
    df = frame(spark, sf, "pedigree")
    return pedigree.families(df, _relations(df))


@query("SELECT count(*) AS members, count(*) FILTER (sex = 'male') AS males, count(*) FILTER (sex = 'female') AS females, count(*) FILTER (parent_a IS NULL) AS founders, count(*) FILTER (affected) AS affected, count(DISTINCT family) AS families FROM {pedigree}")
def pedigree_summary(spark, sf):
    df = frame(spark, sf, "pedigree")
    return pedigree.summary(df, _relations(df))


@query("SELECT DISTINCT id FROM {pedigree} WHERE (sex = 'male' AND id IN (SELECT parent_a FROM {pedigree} UNION SELECT parent_b FROM {pedigree})) OR parent_a IS NULL")
def pedigree_id_list(spark, sf):
    df = frame(spark, sf, "pedigree")
    return pedigree.id_list(df, _relations(df), ["paternal", "founder"])


@query("""
WITH RECURSIVE walk(id, generation) AS (SELECT id, 0 FROM {pedigree} WHERE parent_a IS NULL
  UNION SELECT c.id, w.generation + 1 FROM walk w JOIN {pedigree} c ON c.parent_a = w.id OR c.parent_b = w.id)
SELECT id, CAST(max(generation) AS INT) AS generation FROM walk GROUP BY id""")
def pedigree_generations(spark, sf):
    df = frame(spark, sf, "pedigree")
    return pedigree.generations(df, _relations(df))


@query("""
WITH RECURSIVE up(id, ancestor, steps) AS (SELECT id, id, 0 FROM {taxa} UNION ALL SELECT u.id, t.parent, u.steps + 1 FROM up u JOIN {taxa} t ON t.id = u.ancestor WHERE t.parent <> -1)
SELECT id, ancestor, CAST(steps AS INT) AS steps FROM up""")
def taxonomy_lineage(spark, sf):
    return pedigree.lineage(frame(spark, sf, "taxa"))


@query("WITH RECURSIVE d(id) AS (SELECT 5 UNION ALL SELECT t.id FROM d JOIN {taxa} t ON t.parent = d.id) SELECT t.id, t.parent FROM {taxa} t JOIN d USING (id)")
def taxonomy_subtree(spark, sf):
    return pedigree.subtree(frame(spark, sf, "taxa"), [5]).select("id", "parent")


# ------------------------------------------------------------------ reads


@query("SELECT count(*) AS sequences, CAST(sum(len(residues)) AS BIGINT) AS total, CAST(min(len(residues)) AS INT) AS shortest, CAST(max(len(residues)) AS INT) AS longest, " + ", ".join(f"CAST(sum(len(residues) - len(replace(residues, '{r}', ''))) AS BIGINT) AS {r.lower()}" for r in "ACGTN") + " FROM {reads}")
def residue_statistics(spark, sf):
    return reads.residue_counts(frame(spark, sf, "reads"))


@query("SELECT CAST(len(run) AS INT) AS length, count(*) AS n FROM (SELECT unnest(regexp_extract_all(residues, 'N+')) AS run FROM {reads}) GROUP BY 1")
def n_block_histogram(spark, sf):
    return reads.n_blocks(frame(spark, sf, "reads"))


@query("SELECT seq_id, reverse(translate(substr(residues, 3, len(residues) - 4), 'ACGT', 'TGCA')) AS residues FROM {reads}")
def trim_reads(spark, sf):
    df = frame(spark, sf, "reads").withColumn("quals", F.transform(F.sequence(F.lit(1), F.length("residues")), lambda i: (i * 7) % 40))
    return reads.trim(df, first=2, last=2, revcomp=True).select("seq_id", "residues")


# ------------------------------------------------------------------ more filters, annotations and projections



def _fields(df: DataFrame) -> DataFrame:
    """Records with INFO, FILTER, QUAL and two samples' fields made of their numbers."""
    info = F.map_concat(F.create_map(F.lit("DP"), F.col("dp").cast("string")), F.when(F.col("row_id") % 4 == 0, F.create_map(F.lit("X"), F.lit(""))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    marks = F.when(F.col("row_id") % 5 == 0, F.array(F.lit("q10"))).when(F.col("row_id") % 5 == 1, F.array(F.lit("PASS"))).otherwise(F.array().cast("array<string>"))
    one = F.create_map(F.lit("GQ"), F.when(F.col("gq") % 7 == 0, F.lit(".")).otherwise(F.col("gq").cast("string")), F.lit("DP"), F.col("dp").cast("string"), F.lit("DN"), F.when(F.col("dp") % 3 == 0, "Y").otherwise("N"), F.lit("DNP"), F.col("gq").cast("string"))
    two = F.create_map(F.lit("GQ"), (F.col("gq") + 10).cast("string"), F.lit("DP"), F.lit("."), F.lit("DN"), F.when(F.col("dp") % 4 == 0, "Y").otherwise("N"), F.lit("DNP"), F.lit("."))
    return df.withColumns({"info": info, "filters": marks, "samples": F.array(one, two), "qual": F.col("gq").cast("double"), "gts": F.array(F.array("g1", "g2"), F.array("g3"))})


@query("SELECT row_id FROM {records} WHERE (row_id % 5 = 0 OR row_id % 4 = 0) AND row_id % 5 <> 1")
def filter_tags(spark, sf):
    df = _fields(frame(spark, sf, "records"))
    return df.where(filters.keep_tags(["q10"], ["X"]) & filters.without_filters(["PASS"])).select("row_id")


@query("SELECT row_id FROM {records} WHERE row_id % 5 <> 0")
def filter_passed(spark, sf):
    return _fields(frame(spark, sf, "records")).where(filters.passed()).select("row_id")


@query("SELECT row_id FROM {records} WHERE gq >= 30 AND dp BETWEEN 5 AND 40 AND len(alts) + 1 <= 2 AND (gq % 7 = 0 OR gq >= 25)")
def filter_ranges(spark, sf):
    df = _fields(frame(spark, sf, "records"))
    criteria = {"QUAL": filters.in_range(F.col("qual"), 30), "DP": filters.info_in_range("DP", 5, 40), "ALLELES": filters.allele_count(None, 2), "GQ": filters.samples_in_range("GQ", 25)}
    return df.where(filters.all_of(criteria)).select("row_id")


@query("SELECT row_id FROM {records} WHERE dp > 20 AND gq % 7 <> 0 AND gq <= 50 AND NOT (row_id % 4 = 0)")
def filter_expressions(spark, sf):
    df = _fields(frame(spark, sf, "records"))
    keep = filters.expression("INFO.DP > 20") & filters.expression("GQ <= 50", F.col("samples")[0]) & filters.without_info(["X"])
    return df.where(keep).select("row_id")


@query("SELECT row_id FROM {records} WHERE dp % 3 = 0 AND gq BETWEEN 10 AND 60 AND dp % 4 <> 0")
def filter_denovo(spark, sf):
    return _fields(frame(spark, sf, "records")).where(filters.denovo(0, 10, 60)).select("row_id")


@query("SELECT row_id FROM {records} WHERE NOT (g1 = g2 AND g1 <= 0) AND NOT (g3 <= 0) AND (g1 > 0 OR g2 > 0 OR g3 > 0)")
def filter_same_as_ref(spark, sf):
    return _fields(frame(spark, sf, "records")).where(filters.not_same_as_ref() & filters.some_variant()).select("row_id")


@query("SELECT row_id, CASE WHEN dp = 0 THEN 'inf' ELSE CAST(CAST(floor(gq * 1000 / dp) AS BIGINT) AS VARCHAR) END AS qd, CASE WHEN g1 >= 0 AND g2 >= 0 AND dp + gq > 0 THEN CAST(floor(gq * 1000 / (dp + gq)) AS BIGINT) END AS vaf FROM {records}")
def depth_annotations(spark, sf):
    df = _fields(frame(spark, sf, "records"))
    qd = X.qual_over_depth(F.col("qual"), F.col("dp"), F.array().cast("array<int>"))
    vaf = X.largest_fraction(F.array("dp", "gq"))
    told = F.when(F.col("g1") < 0, None).when(F.col("g2") < 0, None).otherwise(F.floor(F.round(vaf * 1000, 6)))
    return df.select("row_id", F.when(qd == float("inf"), "inf").otherwise(F.floor(F.round(qd * 1000, 6)).cast("string")).alias("qd"), told.alias("vaf"))


@query("SELECT trio, row_id, CASE WHEN len(child) = 2 AND NOT list_contains(child, -1) THEN CASE WHEN child[1] = child[2] THEN child[1] || '|' || child[2] WHEN p AND NOT q THEN child[1] || '|' || child[2] WHEN q AND NOT p THEN child[2] || '|' || child[1] END END AS phased FROM (SELECT *, list_contains(father, child[1]) AND list_contains(mother, child[2]) AS p, list_contains(father, child[2]) AND list_contains(mother, child[1]) AS q FROM {trios})")
def child_phasing(spark, sf):
    df = frame(spark, sf, "trios")
    return df.select("trio", "row_id", A.join_gt(inheritance.phase_child(F.col("father"), F.col("mother"), F.col("child")), F.lit(True)).alias("phased"))


@query(_CURVE + " SELECT c.subset, score, CAST(floor(10000 * tp_raw / (tp_raw + fp)) AS BIGINT) AS precision, CAST(floor(10000 * tp / n) AS BIGINT) AS sensitivity FROM c JOIN (SELECT subset, sum(tp) AS n FROM {calls} GROUP BY subset) t USING (subset) WHERE n > 0")
def roc_metrics(spark, sf):
    calls = frame(spark, sf, "calls")
    totals = calls.groupBy("subset").agg(F.sum("tp").alias("n"))
    points = roc.metrics(roc.curve(calls, ("subset",)).join(totals, "subset").where("n > 0"), F.col("n"))
    cut = lambda c: F.floor(F.round(F.col(c) * 10000, 6))
    return points.select("subset", "score", cut("precision").alias("precision"), cut("sensitivity").alias("sensitivity"))


@query("SELECT row_id, 's1' AS sample, g1 || '/' || g2 AS gt FROM {records} WHERE NOT (g1 < 0 AND g2 < 0) AND (g1 > 0 OR g2 > 0) UNION ALL SELECT row_id, 's2', CAST(g3 AS VARCHAR) FROM {records} WHERE g3 > 0")
def split_samples(spark, sf):
    df = merging.split_samples(_samples(frame(spark, sf, "records")))
    return df.select("row_id", "sample", F.array_join(F.transform("gt", lambda a: a.cast("string")), "/").alias("gt"))


@query("""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY seq, start, stop) AS n FROM (SELECT seq, start, stop FROM {loci} WHERE start % 3 < 2)), b AS (SELECT *, row_number() OVER (PARTITION BY seq, start, stop) AS n FROM (SELECT seq, start, stop FROM {loci} WHERE start % 3 > 0))
SELECT coalesce(a.seq, b.seq) AS seq, coalesce(a.start, b.start) AS start, coalesce(a.stop, b.stop) AS stop, a.seq IS NOT NULL AS in_a, b.seq IS NOT NULL AS in_b FROM a FULL JOIN b ON a.seq = b.seq AND a.start = b.start AND a.stop = b.stop AND a.n = b.n""")
def interleave_sets(spark, sf):
    loci = frame(spark, sf, "loci")
    out = merging.interleave(loci.where("start % 3 < 2"), loci.where("start % 3 > 0"))
    return _stop(out.select("seq", "start", "end", F.col("a_row").isNotNull().alias("in_a"), F.col("b_row").isNotNull().alias("in_b")))


@query("SELECT CAST(row_id AS BIGINT) AS row_id, CAST(list_sum(list_transform([g1, g2, g3], lambda a: CASE WHEN a = 1 THEN 1 ELSE 0 END)) AS INT) AS ones, g1 > 0 OR g2 > 0 AS variant, g1 <> g2 AS het, g1 < 0 AND g2 < 0 AS missing FROM {records}")
def genotype_predicates(spark, sf):
    gt = F.array("g1", "g2")
    df = frame(spark, sf, "records")
    return df.select("row_id", F.size(F.filter(F.array("g1", "g2", "g3"), lambda a: a == 1)).alias("ones"), A.is_variant(gt).alias("variant"), A.is_het(gt).alias("het"), A.is_missing(gt).alias("missing"))


@query("SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumn("time", F.col("ts").cast("timestamp"))
    tiles = ordered.tumbling(df, 1, ("user_id",), "time", "hours")
    return tiles.select("user_id", F.floor(F.unix_timestamp("start") / 3600).alias("hour"), "n")
