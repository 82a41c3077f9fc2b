"""Every query with SQL against DuckDB, on the smallest tables; the others run and give rows."""

import os

import duckdb
import pandas as pd
import pytest

from variloom.plans.all import ORACLE_SQL, QUERIES


def rows(df: pd.DataFrame) -> list[str]:
    columns = sorted(df.columns)
    plain = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(str([plain(v) for v in r]) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_places_beyond_int(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_partkey", F.col("l_partkey") + 1_400_000).write.parquet(f"{tmp_path}/lineitem.parquet")
    near, far = (sorted(map(tuple, QUERIES["records_out_of_order"](spark, d).collect())) for d in (sf, str(tmp_path)))
    assert far == [(seq, start + 14_000_000, stop + 14_000_000) for seq, start, stop in near] and near
