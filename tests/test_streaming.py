import time

import pytest

from variloom.streaming import ordered as O


def run(spark, tmp_path, rows, schema, build, mode="append"):
    """Feed rows in batches, one file each, and collect what the query gives."""
    path = tmp_path / "in"
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


PLACES = "seq string, start int, end int"


def test_density(spark, tmp_path):
    rows = [[("a", s, s + 1) for s in (1, 3, 20, 40)], [("a", s, s + 1) for s in (43, 60, 90)], [("b", 5, 6), ("a", 200, 201)]]
    got = run(spark, tmp_path, rows, PLACES, lambda df: O.density_filter(df, 4))
    assert sorted(r["start"] for r in got if r["seq"] == "a") == [20, 60, 90]


def test_clusters(spark, tmp_path):
    rows = [[("a", 1, 2), ("a", 4, 5), ("a", 30, 31)], [("a", 33, 34), ("a", 36, 37), ("a", 90, 91)]]
    got = run(spark, tmp_path, rows, PLACES, lambda df: O.cluster_counts(df, 5))
    assert sorted((r["start"], r["cluster"]) for r in got) == [(1, 1), (4, 1), (30, 2), (33, 2), (36, 2)]


def test_windows_and_late_rows(spark, tmp_path):
    rows = [[("a", 5, 6), ("a", 12, 13)], [("a", 500, 501)], [("a", 510, 511)], [("a", 7, 8)], [("a", 900, 901)]]
    got = run(spark, tmp_path, rows, PLACES, lambda df: O.tumbling(O.with_lateness(df, 50), 10))
    by = {r["start"].minute * 60 + r["start"].second: r["n"] for r in got}
    assert by[0] == 1 and by[10] == 1  # the row at 7 came too late for its tile


@pytest.mark.parametrize("build", [lambda df: O.sliding(O.with_lateness(df, 50), 20, 10), lambda df: O.sessions(O.with_lateness(df, 50), 20), lambda df: O.drop_repeats(O.with_lateness(df, 50), ("seq", "start"))])
def test_others_run(spark, tmp_path, build):
    rows = [[("a", 5, 6), ("a", 5, 6), ("a", 12, 13)], [("a", 500, 501)], [("a", 900, 901)]]
    assert run(spark, tmp_path, rows, PLACES, build)


def test_near_pairs(spark, tmp_path):
    rows = [[("a", 5, 6), ("a", 12, 13), ("a", 100, 101)]]
    got = run(spark, tmp_path, rows, PLACES, lambda df: O.near_pairs(O.with_lateness(df, 50), O.with_lateness(df, 50), 10))
    assert {(r["a_start"], r["b_start"]) for r in got} == {(5, 5), (5, 12), (12, 5), (12, 12), (100, 100)}


def test_near_pairs_in_a_large_sequence(spark, tmp_path):
    """Rows look at their neighbours only; all pairs of the sequence would be 1.6 billion."""
    from pyspark.sql import functions as F

    places = spark.range(40_000).select(F.lit("a").alias("seq"), (F.col("id") * 10).cast("int").alias("start"))
    for side, shift in (("a", 0), ("b", 7)):
        places.withColumn("start", F.col("start") + shift).write.parquet(f"{tmp_path}/{side}")
    a, b = (O.with_lateness(spark.readStream.schema(places.schema).parquet(f"{tmp_path}/{side}"), 1_000_000) for side in "ab")
    q = O.near_pairs(a, b, 7).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    # b is 7 after its own a and 3 before the next one.
    got = sorted((r["a_start"], r["b_start"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted([(10 * i, 10 * i + 7) for i in range(40_000)] + [(10 * i, 10 * i - 3) for i in range(1, 40_000)])


@pytest.mark.parametrize("distance", [0, 1, 4])
def test_near_pairs_at_tile_borders(spark, tmp_path, distance):
    rows = [[("a", s, s + 1) for s in range(12)] + [("b", 3, 4), (None, 3, 4)], [("a", 5, 6)]]
    got = run(spark, tmp_path, rows, PLACES, lambda df: O.near_pairs(O.with_lateness(df, 50), O.with_lateness(df, 50), distance))
    starts = [*range(12), 5]
    want = sorted([(s, t) for s in starts for t in starts if abs(s - t) <= distance] + [(3, 3)])
    assert sorted((r["a_start"], r["b_start"]) for r in got) == want


def test_append_streams_are_written_to_files(spark, sf):
    from variloom.plans import comparisons as C

    got = C.stream_near_pairs(spark, sf)
    assert got.inputFiles() and got.count()
    none = C._run(O.with_lateness(C._stream(spark.range(3).selectExpr("cast(id as int) AS start")), 10).where("start < 0"), "append")
    assert none.count() == 0 and none.columns == ["start", "ptime"]
