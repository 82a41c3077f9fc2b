"""Views of the driver's tables as loci, regions, records, trios, reads and pedigrees.

One text serves Spark and DuckDB: tables stand in braces, ``@arr`` makes an array.  Intervals
end in ``stop`` here, as ``end`` is a keyword; ``frame`` renames it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOCI = """
SELECT DISTINCT 'chr' || CAST(l_suppkey % 7 + 1 AS STRING) AS seq, CAST(l_partkey * 10 + l_linenumber AS INT) AS start,
  CAST(l_partkey * 10 + l_linenumber + 1 + CAST(l_quantity AS INT) % 20 AS INT) AS stop
FROM {lineitem}"""

REGIONS = """
SELECT DISTINCT 'chr' || CAST(o_custkey % 7 + 1 AS STRING) AS seq, CAST((o_orderkey * 37) % 30000 AS INT) AS start,
  CAST((o_orderkey * 37) % 30000 + 3 + o_custkey % 40 AS INT) AS stop, o_orderpriority AS label
FROM {orders}"""

RECORDS = """
SELECT o_orderkey AS row_id, 'chr' || CAST(o_custkey % 7 + 1 AS STRING) AS seq, CAST(o_orderkey * 3 AS INT) AS start, ref,
  CASE WHEN o_orderkey % 3 = 0 THEN @arr(alt1) ELSE @arr(alt1, alt2) END AS alts,
  CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE CAST(o_custkey % 2 AS INT) END AS g1, CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE CAST(o_custkey % (CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 3 END) AS INT) END AS g2,
  CAST(o_orderkey % 2 AS INT) AS g3, CAST(o_custkey % 50 AS INT) AS dp, CAST(o_orderkey % 97 AS INT) AS gq
FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'CA' WHEN 2 THEN 'CTT' WHEN 3 THEN 'ACGT' ELSE 'T' END AS ref,
    CASE o_custkey % 6 WHEN 0 THEN 'G' WHEN 1 THEN 'CAGG' WHEN 2 THEN 'C' WHEN 3 THEN 'CTG' WHEN 4 THEN 'ACCC' ELSE '<DEL>' END AS alt1,
    CASE o_custkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'CATT' WHEN 2 THEN 'AG' ELSE 'GTTTT' END AS alt2 FROM {orders}) x"""

TRIOS = """
SELECT c_custkey AS row_id, CAST(c_nationkey AS INT) AS trio,
  CASE WHEN c_custkey % 10 = 0 THEN @arr(CAST(-1 AS INT), CAST(-1 AS INT)) WHEN c_custkey % 17 = 0 THEN @arr(CAST(c_custkey % 2 AS INT)) ELSE @arr(CAST(c_custkey % 2 AS INT), CAST(c_nationkey % 3 AS INT)) END AS father,
  CASE WHEN c_custkey % 14 = 0 THEN @arr(CAST(-1 AS INT), CAST(1 AS INT)) WHEN c_custkey % 19 = 0 THEN @arr(CAST(c_custkey % 3 AS INT)) ELSE @arr(CAST(c_custkey % 3 AS INT), CAST(c_nationkey % 2 AS INT)) END AS mother,
  CASE WHEN c_custkey % 15 = 0 THEN @arr(CAST(c_custkey % 2 AS INT)) WHEN c_custkey % 22 = 0 THEN @arr(CAST(-1 AS INT), CAST(0 AS INT)) ELSE @arr(CAST(c_nationkey % 2 AS INT), CAST(c_custkey % 2 AS INT)) END AS child
FROM {customer}"""

#: Half the score decides whether a call is right, so that curves bend; scores tie often.
CALLS = """
SELECT CAST(d.n_chars % 100 AS INT) AS score, d.lang AS subset, CAST(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS BIGINT) AS tp,
  CAST(CASE WHEN l.quality = 1 THEN 0 ELSE 1 END AS BIGINT) AS fp, CAST(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS BIGINT) AS tp_raw
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""

READS = """
SELECT p_partkey AS seq_id, p_name AS name, translate(upper(p_name), 'BDEFHIJKLMOPQRSUVWXYZ -', 'ACGTNACGTNACGTNACGTNACG') AS residues FROM {part}"""

PEDIGREE = """
SELECT CAST(c_custkey AS INT) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex, CAST(c_nationkey AS INT) AS family, c_acctbal < 0 AS affected,
  c_custkey % 3 = 0 AS primary_, CASE WHEN c_custkey > 8 THEN CAST(floor(c_custkey / 4.0) AS INT) END AS parent_a, CASE WHEN c_custkey > 8 THEN CAST(floor(c_custkey / 4.0) AS INT) + 1 END AS parent_b
FROM {customer}"""

TAXA = """
SELECT CAST(p_partkey + 1 AS INT) AS id, CASE WHEN p_partkey = 0 THEN -1 ELSE CAST(floor((p_partkey + 1) / 2.0) AS INT) END AS parent, p_type AS rank, p_name AS name FROM {part}"""

LENSES = {"loci": LOCI, "regions": REGIONS, "records": RECORDS, "trios": TRIOS, "calls": CALLS, "reads": READS, "pedigree": PEDIGREE, "taxa": TAXA}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")


def frame(spark: SparkSession, sf_dir: str, lens: str) -> DataFrame:
    text = LENSES[lens]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    df = spark.sql(text.replace("@arr", "array"), **used)
    return df.withColumnRenamed("stop", "end")


def duckdb(lens: str) -> str:
    text = LENSES[lens].replace("@arr", "list_value")
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def oracle(query: str) -> str:
    """A DuckDB query with the lenses that it names (in braces) before it."""
    used = [name for name in LENSES if "{" + name + "}" in query]
    for name in used:
        query = query.replace("{" + name + "}", name)
    head = ", ".join(f"{name} AS ({duckdb(name)})" for name in used)
    query = query.strip()
    if not used:
        return query
    if query.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {query[15:]}"
    if query.upper().startswith("WITH "):
        return f"WITH {head}, {query[5:]}"
    return f"WITH {head} {query}"
