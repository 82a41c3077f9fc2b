"""Helpers that the corpus operators share: materialised tables, row keys, text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it.  Only where it is unset (a local session, as in
    the tests) is a temporary folder of this machine taken.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="variloom-"))
    return "file://" + _local_dir[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread.

    It cuts lineage and survives the loss of executors, as nothing of it is kept on them.
    Results are lazy and may be read until the session ends, so the files go at its end
    unless ``drop_materialized`` deletes them before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def drop_materialized(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame that ``materialize`` returned."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_hash(*cols: str) -> tuple[Column, Column]:
    """Two 64-bit hashes that together stand for the values of ``cols`` in a row.

    Rows with the same id and another text get other keys; rows alike in all of ``cols``
    get the same.  Nulls count as a value of their own.
    """
    parts: list[Column] = []
    for c in cols:
        parts += [F.col(c), F.col(c).isNull()]
    return F.xxhash64(*parts), F.xxhash64(F.lit(7), *reversed(parts))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or it with underscores before it until no column of ``taken`` has it."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


#: Rows of an Arrow batch: texts may be long, and a batch is held as a whole.
BATCH_ROWS = 500


def limit_batches(spark: SparkSession) -> None:
    """Have the session send texts to Python in batches of BATCH_ROWS at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release_memory() -> None:
    """Give a Python worker's free memory back, as workers live on beside others in an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only some C libraries have it
        pass


_codec = pa.Codec("zstd", compression_level=3)


def squeeze(text: bytes) -> bytes:
    """Compressed bytes, their size before them."""
    return len(text).to_bytes(8, "little") + _codec.compress(text, asbytes=True)


def squeezed_size(z: bytes) -> int:
    return int.from_bytes(z[:8], "little")


def unsqueeze(z: bytes) -> bytes:
    return _codec.decompress(z[8:], decompressed_size=squeezed_size(z), asbytes=True)


def runs_of(sizes: list[int], most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of ``most`` bytes and ``rows`` rows at most (a larger row is a range of its own)."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > most or i - begin == rows):
            yield begin, i
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        yield begin, len(sizes)


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` in bounded batches, with memory given back after each partition."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    limit_batches(df.sparkSession)
    return df.mapInArrow(tidy, schema)
