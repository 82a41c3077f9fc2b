"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words and pairs of words, lower case) are counted: one
of target text (labelled good), one of all raw text.  A document's importance weight is the
mean logarithm of the models' ratio over its n-grams, times ``evidence`` (the number of n-grams
that a text counts as, so that length alone neither favours nor harms).  Adding Gumbel noise and
keeping the top share draws that share without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, row_hash
from .words import chunks, mix, words_of

PAIR = np.uint64(0x9E3779B97F4A7C15)


def bucket_grams(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text, and for each text where its own begin (n + 1 places)."""
    w = words_of(column, lower=True)
    shift = np.uint64(64 - bits)
    ones = mix(w.hash) >> shift
    n = len(w.hash)
    pairs = mix(w.hash[:-1] * PAIR + w.hash[1:]) >> shift if n else ones
    inner = np.ones(max(0, n - 1), dtype=bool)
    cut = w.first[1:-1]
    inner[cut[(cut > 0) & (cut < n)] - 1] = False
    place = np.concatenate([np.arange(n), np.flatnonzero(inner) + 0.5])
    order = np.argsort(place, kind="stable")
    grams = np.concatenate([ones, pairs[inner]])[order].astype(np.int64)
    at = w.first + np.concatenate([[0], np.cumsum(inner)])[np.maximum(w.first - 1, 0)] * (w.first > 0)
    return grams, at


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for lo, hi in chunks(batch.column(0)):
                grams, _ = bucket_grams(batch.column(0).slice(lo, hi - lo), bits)
                total += np.bincount(grams, minlength=1 << bits)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 100_000):
            part = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text: str, bits: int) -> np.ndarray:
    """Counts of all n-grams of all rows by bucket: at most 2**bits rows reach the driver."""
    counted = arrow_map(docs.select(F.col(text).alias("text_")), _count(bits), "bucket int, n long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, dtype=np.float64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, pseudo: float = 3.0, spread: float = 0.5) -> np.ndarray:
    """log p_target - log p_raw per bucket, shrunk towards 0 where it is hard to tell.

    The target's counts are held against those expected from the raw text, with ``pseudo``
    n-grams added to both.  A ratio shrinks by the square of its share in the sum of its
    square and of the variance that chance (by both counts) and the mix of sources
    (``spread``, a deviation) bring: no n-gram is left out, whatever the target's size.
    """
    expected = raw * (target.sum() / max(1.0, raw.sum()))
    ratio = np.log((target + pseudo) / (expected + pseudo))
    noise = 1 / (target + pseudo) + 1 / (expected + pseudo) + spread**2
    return (ratio * (ratio**2 / (ratio**2 + noise)) ** 2).astype(np.float32)


def _score(table, bits: int, evidence: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        for batch in batches:
            for lo, hi in chunks(batch.column("text_")):
                part = batch.slice(lo, hi - lo)
                grams, at = bucket_grams(part.column("text_"), bits)
                total = np.concatenate([[0.0], np.cumsum(ratio[grams], dtype=np.float64)])
                n = at[1:] - at[:-1]
                weight = np.where(n > 0, (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1) * evidence, 0.0)
                yield pa.RecordBatch.from_arrays([part.column("id_"), part.column("k1_"), pa.array(n), pa.array(weight)], names=["id_", "k1_", "n_grams", "log_weight"])

    return run


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column without nulls, by counts in ever finer ranges.

    Only the counts of ``bins`` ranges reach the driver at a time, whatever the rows.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        width = (high - low) / bins
        if low + width <= low or high - width >= high:
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(width)).cast("int"))
        inside = df.where(F.col(column).between(low, high))
        rows = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["bin"]):
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return high


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str = "toxic", keep: float | None = None, cover: float = 0.99, bits: int = 20, evidence: float = 256.0, target_rows: int = 20_000, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: key, n_grams, log_weight, sample_key, kept.

    The target model is fitted on at most ``target_rows`` labelled ids (those with the least
    hashes), good and not toxic in all their labels; the raw model on all rows.  ``keep`` is
    the share to draw (rows that tie with the last are drawn too); unless given, as
    many are drawn as weigh no less than the lightest hundredth (1 - ``cover``) of a quarter of
    those labelled rows that is kept out of the fit, and none where there are no such rows.  A text without words has
    weight 0; null keys draw by their text; repeated rows draw alike; an empty table gives
    no rows.
    """
    good = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id_")).agg(F.min(quality).alias("q_"), F.max(toxic).alias("t_")).where("q_ = 1 and coalesce(t_, 0) = 0")
    chosen = good.select("id_").orderBy(F.xxhash64("id_", F.lit(seed)), "id_").limit(target_rows)
    apart = F.pmod(F.xxhash64("id_", F.lit(seed + 1)), F.lit(4)) == 0
    fit, held = chosen.where(~apart), chosen.where(apart)
    id_type = docs.schema[key].dataType.simpleString()
    k1, _ = row_hash(key, text)
    base = docs.select(F.col(key).alias("id_"), k1.alias("k1_"), F.col(text).alias("text_"))
    raw = bucket_counts(base, "text_", bits)
    target = bucket_counts(base.join(F.broadcast(fit), "id_", "left_semi"), "text_", bits)
    table = docs.sparkSession.sparkContext.broadcast(log_ratio(target, raw))
    scored = arrow_map(base, _score(table, bits, evidence), f"id_ {id_type}, k1_ long, n_grams long, log_weight double")
    uniform = (F.xxhash64("k1_", F.lit(seed)).bitwiseAND((1 << 52) - 1) + 0.5) / float(1 << 52)
    drawn = materialize(scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))), "importance")
    if keep is None:
        # The rows held out are at most ``target_rows`` ids, so their exact quantile is one small aggregate.
        least = drawn.join(F.broadcast(held), "id_", "left_semi").agg(F.percentile("log_weight", 1 - cover)).first()[0]
        k = drawn.where(F.col("log_weight") >= least).count() if least is not None else 0
    else:
        k = round(keep * drawn.count())
    last = kth_largest(drawn, "sample_key", k)
    return drawn.select(F.col("id_").alias(key), "n_grams", "log_weight", "sample_key", (F.col("sample_key") >= F.lit(last)).alias("kept") if last is not None else F.lit(False).alias("kept"))
