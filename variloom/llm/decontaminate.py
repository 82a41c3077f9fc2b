"""Benchmark decontamination by exact windows of normalised words, in DataFrame functions only.

A window is ``size`` consecutive words of a benchmark item, or a whole shorter item.  The scan
cuts each document into blocks of half a window's words: any window that occurs contains a
whole block, so looking up one hash per block, not per word, misses nothing.  Around a block
that is known, the windows themselves are looked up by their words, which verifies the hit.
The benchmark's hash set and windows are broadcast only within a bound on rows and bytes;
beyond it the lookups are shuffled joins.  No text is shuffled but the words around known
blocks.  Contaminated rows are removed by the keys of their texts, 16 bytes each, which are
broadcast within the same bound; beyond it the rows are shuffled to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, row_hash

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Normalised words of a text; a null text has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _steps(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _block(length: int) -> int:
    """Words of a block such that any run of ``length`` words holds a whole one."""
    return (length + 1) // 2


def _benchmark(items: DataFrame, item: str, text: str, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows (size_, window_, w_id_), the items of each (w_id_, item_), and the hashes of all their blocks (size_, h_)."""
    w = items.select(F.col(item).alias("item_"), words(F.col(text)).alias("words_")).where(F.size("words_") > 0)
    w = w.withColumn("size_", F.least(F.lit(size), F.size("words_")))
    each = w.select("item_", "size_", F.explode(F.transform(_steps(F.size("words_") - F.col("size_") + 1), lambda i: F.array_join(F.slice("words_", i + 1, F.col("size_")), " "))).alias("window_"))
    each = each.withColumn("w_id_", F.xxhash64("size_", "window_"))
    g = F.floor((F.col("size_") + 1) / 2).cast("int")
    blocks = w.select("size_", F.explode(F.transform(_steps(F.size("words_") - g + 1), lambda i: F.xxhash64(F.slice("words_", i + 1, g)))).alias("h_")).distinct()
    return each.select("size_", "window_", "w_id_").distinct(), each.where("item_ is not null").select("w_id_", "item_").distinct(), blocks


def _small(t: DataFrame, width: Column, rows: int, most_bytes: int) -> DataFrame:
    """``t``, marked to be broadcast if it has ``rows`` rows and ``most_bytes`` bytes (``width`` a row) at most."""
    n, n_bytes = t.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(t) if n <= rows and n_bytes <= most_bytes else t


def window_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13, broadcast_rows: int = 2_000_000, broadcast_bytes: int = 100_000_000) -> DataFrame:
    """Per distinct text with a hit (text column as ``k1_``, ``k2_`` of ``row_hash(text)``): windows found.

    Columns: k1_, k2_, n_words_, windows_ (array of start, length in words), items_ (array of item ids).
    Each of the benchmark's tables is broadcast only within ``broadcast_rows`` and ``broadcast_bytes``.
    """
    windows, of_items, blocks = (materialize(t, name) for t, name in zip(_benchmark(benchmark, item, item_text, size), ("windows", "window-items", "blocks"), strict=True))
    sizes = [r[0] for r in windows.select("size_").distinct().collect()]  # at most ``size`` rows

    windows, blocks = (_small(t, w, broadcast_rows, broadcast_bytes) for t, w in ((windows, F.octet_length("window_") + 40), (blocks, F.lit(40))))
    k1, k2 = row_hash(text)
    split = docs.select(k1.alias("k1_"), k2.alias("k2_"), words(F.col(text)).alias("words_"))

    def known(length: int) -> Column:
        g = _block(length)

        def one(i: Column) -> Column:
            first = F.greatest(F.lit(0), i * g - (length - g))
            around = F.slice("words_", first + 1, i * g + length - first)
            return F.struct(F.lit(length).alias("size_"), F.xxhash64(F.slice("words_", i * g + 1, F.lit(g))).alias("h_"), first.alias("first_"), around.alias("around_"))

        return F.transform(_steps(F.floor(F.size("words_") / g).cast("int")), one)

    if not sizes:
        split = split.where("false")
    parts = split.select("k1_", "k2_", F.size("words_").alias("n_words_"), F.explode(F.concat(*(known(s) for s in sizes or [size]))).alias("b_")).select("k1_", "k2_", "n_words_", "b_.*")
    near = parts.join(blocks, ["size_", "h_"], "left_semi")
    each = near.select("k1_", "k2_", "n_words_", "size_", F.posexplode(F.transform(_steps(F.size("around_") - F.col("size_") + 1), lambda i: F.array_join(F.slice("around_", i + 1, F.col("size_")), " "))).alias("at_", "window_"), "first_")
    found = each.join(windows, ["size_", "window_"]).select("k1_", "k2_", "n_words_", F.struct((F.col("first_") + F.col("at_")).alias("start"), F.col("size_").alias("length")).alias("w_"), "w_id_")
    # A document's hits are bounded by its words; repeats of the same text add equal windows, which the set drops.
    found = materialize(found.groupBy("k1_", "k2_").agg(F.max("n_words_").alias("n_words_"), F.collect_set("w_").alias("windows_"), F.collect_set("w_id_").alias("w_ids_")), "hits")
    named = found.select("k1_", "k2_", F.explode("w_ids_").alias("w_id_")).join(of_items, "w_id_").select("k1_", "k2_", "item_").distinct()
    named = named.groupBy("k1_", "k2_").agg(F.array_sort(F.collect_set("item_")).alias("items_"))
    empty = F.array().cast(named.schema["items_"].dataType)
    # Written, so that the joins to come read plain exchanges, which Spark splits where many rows share a text.
    return materialize(found.join(named, ["k1_", "k2_"], "left").select("k1_", "k2_", "n_words_", "windows_", F.coalesce("items_", empty).alias("items_")), "hit-items")


def _covered(windows: Column) -> Column:
    """Distinct word places inside any of the windows."""
    return F.array_distinct(F.flatten(F.transform(windows, lambda w: F.sequence(w["start"], w["start"] + w["length"] - 1))))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13, share: int = 20, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_hit, items (ids), hit_words (places), contaminated.

    Contaminated: some word is hit, and at least one in ``share``.  Null and empty texts have
    no words and no hits; items without words have no window, and an item without an id hits
    words but is not listed; repeated rows get equal results; an empty benchmark hits nothing.
    """
    k1, k2 = row_hash(text)
    base = docs.select(F.col(key).alias("id_"), k1.alias("k1_"), k2.alias("k2_"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    hits = window_hits(docs, benchmark, text, item, item_text, size, broadcast_rows).select("k1_", "k2_", F.array_sort(_covered(F.col("windows_"))).alias("hit_words"), "items_")
    out = base.join(hits, ["k1_", "k2_"], "left")
    n_hit = F.coalesce(F.size("hit_words"), F.lit(0)).cast("long")
    n_hit = F.when(F.col("hit_words").isNull(), F.lit(0).cast("long")).otherwise(n_hit)
    empty = F.array().cast(benchmark.schema[item].dataType.simpleString().join(["array<", ">"]))
    out = out.select(F.col("id_").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce("items_", empty).alias("items"), F.coalesce("hit_words", F.array().cast("array<int>")).alias("hit_words"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13, share: int = 20, remove: str = "documents", broadcast_rows: int = 2_000_000, broadcast_bytes: int = 100_000_000) -> DataFrame:
    """``docs`` with its own columns, without the contaminated rows, which the keys of their texts name.

    With ``remove="spans"`` all rows stay, and hit words (with the separators before them) go.
    """
    a, b, hit = (fresh(n, docs.columns) for n in ("k1_", "k2_", "hit_words_"))
    k1, k2 = row_hash(text)
    keyed = docs.withColumns({a: k1, b: k2})
    hits = window_hits(docs, benchmark, text, item, item_text, size, broadcast_rows, broadcast_bytes).select(F.col("k1_").alias(a), F.col("k2_").alias(b), "n_words_", _covered(F.col("windows_")).alias(hit))
    if remove == "documents":
        bad = materialize(hits.where(share * F.size(hit) >= F.col("n_words_")).select(a, b), "contaminated")
        return keyed.join(_small(bad, F.lit(16), broadcast_rows, broadcast_bytes), [a, b], "left_anti").select(*docs.columns)
    keyed = keyed.join(hits.drop("n_words_"), [a, b], "left")
    # Each word with what stands before it, then the rest: joined, they are the whole text.
    parts = F.regexp_extract_all(F.col(text), F.lit(f"(?:[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+)?[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0))
    tail = F.regexp_extract(F.col(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0)
    left = F.filter(parts, lambda _, i: ~F.array_contains(F.col(hit), i))
    cleaned = F.when(F.col(hit).isNull(), F.col(text)).otherwise(F.concat(F.array_join(left, ""), tail))
    return keyed.withColumn(text, cleaned).select(*docs.columns)
