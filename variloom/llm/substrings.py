"""Removal of passages that documents share: seed and extend on winnowed anchors.

Anchors are the hashes of ``seed`` words that winnowing picks: of any ``window`` consecutive
words, one seed is picked, by the window's content alone, so two equal windows pick the same.
Documents meet on equal anchors.  Each anchor is extended both ways over all windows that
picked it (the block); equal blocks need no further look.  Where one anchor has different
blocks, each block is extended window by window, and equal windows meet.  Texts move between
stages compressed.  So every shared
window is found, in time linear in the anchors however many documents share one: no pairs
are made.  Overlapping windows join to maximal repeats.

A word goes when it lies in a window whose words also start in a document with a smaller id.
Rows with the same id are no sources for each other, and a row without id is neither a
source nor cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, row_hash, runs_of, squeeze, squeezed_size, unsqueeze
from .words import WORD_BASES, Prefix, chunks, words_of

ANCHOR = "struct<a:bigint,b:bigint,s:int,n:int>"


def _signed(x: np.ndarray, kind) -> np.ndarray:
    return x.astype(np.dtype(kind).str.replace("i", "u")).view(kind)


def winnow(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of ``w`` gram hashes the place of the last least one, as (place, first run that picked it)."""
    n = len(grams) - w + 1
    runs = np.lib.stride_tricks.sliding_window_view(grams, w)
    picks = np.empty(n, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        part = runs[i : i + (1 << 15), ::-1]
        picks[i : i + len(part)] = w - 1 - np.argmin(part, axis=1) + np.arange(i, i + len(part))
    change = np.flatnonzero(np.concatenate([[True], picks[1:] != picks[:-1]]))
    return picks[change], change


def _scan(window: int, seed: int):
    """Each text compressed, with its anchors: hash of the seed and of its block, first window and windows of the block."""
    w = window - seed + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in chunks(batch.column("text_")):
                part = batch.slice(lo, hi - lo)
                words = words_of(part.column("text_"))
                grams_of, blocks_of = (Prefix.of(words.hash, base) for base in WORD_BASES)
                first, last = words.first[:-1], words.first[1:]
                counts, cols = np.zeros(len(first), np.int64), [[], [], [], []]
                for d in np.flatnonzero(last - first >= window):
                    lo_w, n = first[d], last[d] - first[d]
                    at = lo_w + np.arange(n - seed + 1)
                    grams = grams_of.window(at, at + seed)
                    place, run0 = winnow(grams, w)
                    run1 = np.concatenate([run0[1:], [n - window + 1]])
                    shift = (place - run0).astype(np.uint64)
                    counts[d] = len(place)
                    block = blocks_of.window(lo_w + run0, lo_w + run1 - 1 + window) + shift * np.uint64(0x9E3779B97F4A7C15)
                    for col, value in zip(cols, (grams[place], block, run0, run1 - run0), strict=True):
                        col.append(value)
                flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
                arrays = [pa.array(v.view(np.int64)) for v in flat[:2]] + [pa.array(v.astype(np.int32)) for v in flat[2:]]
                anchors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.StructArray.from_arrays(arrays, names=["a", "b", "s", "n"]))
                z = [None if t is None else squeeze(t.encode()) for t in part.column("text_").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id_"), part.column("k1_"), pa.array(z, pa.binary()), anchors], names=["id_", "k1_", "z_", "anchors_"])

    return run


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in parts of bounded size, with their texts; null texts are empty."""
    z = batch.column("z_").to_pylist()
    for lo, hi in runs_of([squeezed_size(x) if x else 0 for x in z], 1 << 20):
        yield batch.slice(lo, hi - lo), [unsqueeze(x) if x else b"" for x in z[lo:hi]]


def _windows(window: int):
    """Hashes of the windows that start in given places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                words = words_of(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
                pre = [Prefix.of(words.hash, base) for base in WORD_BASES]
                which, place = [], []
                for d, edges in enumerate(part.column("edges_").to_pylist()):
                    for e in edges:
                        which.append(np.full(e["n"], d))
                        place.append(np.arange(e["s"], e["s"] + e["n"]))
                if not which:
                    continue
                d, s = np.concatenate(which), np.concatenate(place)
                at = words.first[d] + s
                w1, w2 = pre[0].window(at, at + window), pre[1].window(at, at + window)
                take = pa.array(d)
                yield pa.RecordBatch.from_arrays([part.column(c).take(take) for c in ("id_", "k1_")] + [pa.array(s.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(_signed(w2, np.int32))], names=["id_", "k1_", "s", "w1", "w2"])

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of [start, end) ranges, those that touch joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    for batch in batches:
        for part, texts in _texts(batch):
            rows = []
            for text, spans in zip(texts, part.column("spans_").to_pylist(), strict=True):
                words = text.split()
                n, merged = len(words), merge_spans([(s["s"], s["e"]) for s in spans or ()])
                for s, e in reversed(merged):
                    del words[s:e]
                rows.append((n, n - len(words), [{"s": s, "e": e} for s, e in merged], b" ".join(words).decode()))
            n, gone, spans, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([part.column("id_"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["id_", "n_words", "n_removed", "spans", "kept_text"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, seed: int = 20) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, spans (word ranges removed), kept_text.

    ``window`` is the least length of a repeat in words, ``seed`` that of an anchor.  Null
    and empty texts have no words; texts shorter than a window stay as they are; repeated
    rows get equal results; an empty table gives no rows.  Other columns are not used.
    """
    id_type = docs.schema[key].dataType.simpleString()
    row = ["id_", "k1_"]  # a row's id with a hash of id and text; rows without id get no spans, so they need no key
    base = docs.select(F.col(key).alias("id_"), row_hash(key, text)[0].alias("k1_"), F.col(text).alias("text_"))
    scanned = materialize(arrow_map(base, _scan(window, seed), f"id_ {id_type}, k1_ long, z_ binary, anchors_ array<{ANCHOR}>"), "anchors")
    seeds = scanned.where("id_ is not null and size(anchors_) > 0").select(*row, F.explode("anchors_").alias("x")).select(*row, "x.*")

    # Only anchors that several documents have matter.  If all their blocks are equal, all but the first are repeats whole.
    # Sides of joins that come from aggregates are written first: Spark splits a hot key only between plain exchanges.
    shared = materialize(seeds.groupBy("a").agg(F.min("id_").alias("first_"), F.max("id_").alias("last_"), (F.min("b") != F.max("b")).alias("split_")).where("first_ < last_").drop("last_"), "shared")
    met = materialize(seeds.join(shared, "a").withColumn("earlier_", F.expr("first_ < id_ and not split_")).where("split_ or earlier_").select(*row, "a", "b", "s", "n", "split_"), "met")
    blocks = materialize(met.where("split_").groupBy("a", "b").agg(F.min("id_").alias("first_"), F.max("id_").alias("last_")).where("first_ < last_").drop("last_"), "blocks")
    told = materialize(met.where("split_").join(blocks, ["a", "b"], "left").select(*row, "s", "n", F.coalesce(F.expr("first_ < id_"), F.lit(False)).alias("earlier_")), "told")
    whole = met.where("not split_").select(*row, "s", "n").unionByName(told.where("earlier_").select(*row, "s", "n")).select(*row, "s", (F.col("s") + F.col("n") - 1 + window).cast("int").alias("e"))

    # Windows of the first occurrence of blocks that differ under one anchor.
    edges = told.where("not earlier_").groupBy(*row).agg(F.collect_set(F.struct("s", "n")).alias("edges_"))
    texts = scanned.select(*row, "z_").join(edges, row)
    windows = materialize(arrow_map(texts, _windows(window), f"id_ {id_type}, k1_ long, s int, w1 long, w2 int"), "windows")
    firsts = materialize(windows.groupBy("w1", "w2").agg(F.min("id_").alias("first_"), F.max("id_").alias("last_")).where("first_ < last_").drop("last_"), "firsts")
    single = windows.join(firsts, ["w1", "w2"]).where("first_ < id_").select(*row, "s", (F.col("s") + window).alias("e"))

    spans = whole.unionByName(single).groupBy(*row).agg(F.collect_set(F.struct("s", "e")).alias("spans_"))
    cut = scanned.select(*row, "z_").join(spans, row, "left").select("id_", "z_", "spans_")
    return arrow_map(cut, _cut, f"id_ {id_type}, n_words long, n_removed long, spans array<struct<s:int,e:int>>, kept_text string").withColumnRenamed("id_", key)
