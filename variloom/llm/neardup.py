"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (a shorter text is one shingle), in lower case; a shingle
weighs its count in the text times a damped inverse document frequency, counted over all
documents in ``2**idf_bits`` hashed buckets.  ``bands`` x ``rows`` samples are drawn per text, so that two
samples agree with the probability of the weighted Jaccard similarity; texts that agree in
all rows of a band are candidates, verified by the exact weighted Jaccard similarity.

Texts with the same words are one node from the start.  A bucket's leader is the node in it
that meets the most others.  Every node is first compared with the best of its leaders, which
makes a forest; then with those leaders that lie in another component.  What is left are
buckets with several components: there the nodes outside the leader's component are held
against all others in blocks, and a pair is verified unless an exact bound, from what each
node lacks of the leader and has beyond it, rules it out.  Of the pairs of a node with one
component the likeliest are verified first, more in each round while the components differ.
No pairs are made of nodes already joined, so a large group of near copies costs about one
comparison a node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, drop_materialized, materialize, row_hash, runs_of, squeeze, squeezed_size, unsqueeze
from .components import join_labels, roots
from .words import WORD_BASES, Prefix, chunks, mix, words_of


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    shingle: int = 5
    bands: int = 15
    rows: int = 4
    idf_bits: int = 20
    #: Share of the logarithm in a shingle's weight, 1 + share * ln(..).  Were it larger, the
    #: shingles that a large group of copies has in common would weigh far less than the few
    #: in which its copies differ, and the group would come apart.
    idf_share: float = 0.05
    #: Nodes of a block, and pairs of a node with one component that a first round verifies.
    block: int = 2048
    first_pairs: int = 16
    seed: int = 11


@dataclass
class Shingles:
    """Distinct shingles of some texts, flat: text i has entries first[i] to first[i+1]."""

    doc: np.ndarray
    hash: np.ndarray
    count: np.ndarray
    first: np.ndarray
    n_words: np.ndarray
    node: list[bytes | None]


def shingles_of(column: pa.Array, k: int) -> Shingles:
    w = words_of(column, lower=True)
    begin, end = w.first[:-1], w.first[1:]
    n_words = end - begin
    n = np.where(n_words > 0, np.maximum(n_words - k + 1, 1), 0)
    pre = [Prefix.of(w.hash, base) for base in WORD_BASES]
    ids = np.stack([p.window(begin, end) for p in pre], axis=1)
    node = [row.tobytes() if m else None for row, m in zip(ids, n_words, strict=True)]
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + begin[doc]
    h = pre[0].window(at, np.minimum(at + k, end[doc]))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    place = np.flatnonzero(new)
    count = np.diff(np.append(place, len(h)))
    return Shingles(doc[place], h[place], count, np.searchsorted(doc[place], np.arange(len(n) + 1)), n_words, node)


def _frequencies(bits: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << bits) + 1, dtype=np.int64)
        for batch in batches:
            total[-1] += len(batch)
            for lo, hi in chunks(batch.column(0), 1 << 19):
                s = shingles_of(batch.column(0).slice(lo, hi - lo), k)
                total[:-1] += np.bincount((s.hash >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        used = np.flatnonzero(total)
        for i in range(0, len(used), 100_000):
            part = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], names=["bucket", "n"])

    return run


def idf_table(docs: DataFrame, text: str, settings: Settings) -> np.ndarray:
    """1 + idf_share * ln(1 + documents / (1 + documents with the bucket)), for each bucket; at most 2**idf_bits + 1 rows reach the driver."""
    counted = arrow_map(docs.select(F.col(text).alias("text_")), _frequencies(settings.idf_bits, settings.shingle), "bucket int, n long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((1 << settings.idf_bits) + 1)
    total[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return (1 + settings.idf_share * np.log1p(total[-1] / (1 + total[:-1]))).astype(np.float32)


def weights(s: Shingles, idf: np.ndarray) -> np.ndarray:
    bits = len(idf).bit_length() - 1
    return s.count.astype(np.float32) * idf[(s.hash >> np.uint64(64 - bits)).astype(np.int64)]


class Sampler:
    """Consistent weighted samples; draws come from tables that a hash of the shingle indexes.

    A sample is the least of ln a = ln c - r (t - beta) - r with t = floor(ln S / r + beta)
    over the shingles, r and c gamma(2, 1) and beta uniform.  As equal samples have equal
    shingle and t, the least value itself stands for the sample.
    """

    BITS = 16

    def __init__(self, settings: Settings):
        rng = np.random.default_rng(settings.seed)
        n = 1 << self.BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32)
        self.beta = rng.random(n).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, settings.bands * settings.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(self, s: Shingles, weight: np.ndarray) -> np.ndarray:
        """(texts with shingles, samples) as int32."""
        has = np.flatnonzero(np.diff(s.first))
        out = np.empty((len(has), len(self.odd)), dtype=np.float32)
        if len(has):
            log_s, starts = np.log(weight), s.first[has]
            for k, odd in enumerate(self.odd):
                i = ((s.hash * odd) >> np.uint64(64 - self.BITS)).astype(np.int32)
                r, beta = self.r[i], self.beta[i]
                t = np.floor(log_s / r + beta)
                out[:, k] = np.minimum.reduceat(self.log_c[i] - r * (t - beta + np.float32(1)), starts)
        return out.view(np.int32)


def _sign(idf, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(settings)
        band_salt = mix(np.arange(1, settings.bands + 1, dtype=np.uint64))
        for batch in batches:
            for lo, hi in chunks(batch.column("text_"), 1 << 19):
                part = batch.slice(lo, hi - lo)
                s = shingles_of(part.column("text_"), settings.shingle)
                sig = sampler.sign(s, weights(s, idf.value))
                value = np.repeat(band_salt[None, :], len(sig), axis=0)
                for r in range(settings.rows):
                    value = mix(value + sig[:, r :: settings.rows].astype(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                bands, z = [None] * len(part), [None] * len(part)
                texts = part.column("text_").to_pylist()
                for row, d in enumerate(np.flatnonzero(np.diff(s.first))):
                    bands[d], z[d] = value[row].view(np.int64), squeeze(texts[d].encode())
                yield pa.RecordBatch.from_arrays([part.column("id_"), part.column("k1_"), part.column("k2_"), pa.array(s.n_words), pa.array(s.node, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(z, pa.binary())], names=["id_", "k1_", "k2_", "n_words_", "node_", "bands_", "z_"])

    return run


GAP = 256


def weighted_overlap(left: Shingles, right: Shingles, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts side by side: weights of both and of their intersection, and what each has beyond it, in GAP buckets."""
    n = len(left.n_words)
    doc, h = np.concatenate([left.doc, right.doc]), np.concatenate([left.hash, right.hash])
    wl, wr = weights(left, idf).astype(np.float64), weights(right, idf).astype(np.float64)
    order = np.lexsort((h, doc))
    doc_o, h_o = doc[order], h[order]
    new = np.ones(len(h_o), dtype=bool)
    new[1:] = (h_o[1:] != h_o[:-1]) | (doc_o[1:] != doc_o[:-1])
    group = np.empty(len(h_o), dtype=np.int64)
    group[order] = np.cumsum(new) - 1
    m = int(new.sum())
    l_w, r_w = np.bincount(group[: len(wl)], wl, minlength=m), np.bincount(group[len(wl) :], wr, minlength=m)
    both = np.minimum(l_w, r_w)
    of = doc_o[new]
    cell = of * GAP + (h_o[new] >> np.uint64(56)).astype(np.int64)
    lacks, extra = (np.bincount(cell, w - both, minlength=n * GAP).reshape(n, GAP) for w in (l_w, r_w))
    return np.bincount(of, l_w, minlength=n), np.bincount(of, r_w, minlength=n), np.bincount(of, both, minlength=n), lacks, extra


def half(lacks: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Half precision, rounded so that bounds stay bounds: what is lacked stays finite, what is extra may become infinite."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.minimum(lacks * 0.999, np.finfo(np.float16).max), extra * 1.001], axis=1).astype(np.float16)


def _verify(idf, settings: Settings):
    """Weights of pairs of texts and of what they share; texts are opened some MB at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            za, zb = (batch.column(c).to_pylist() for c in ("za_", "zb_"))
            for lo, hi in runs_of([squeezed_size(x) + squeezed_size(y) for x, y in zip(za, zb, strict=True)], 1 << 20, 256):
                part = batch.slice(lo, hi - lo)
                sides = [shingles_of(pa.array([unsqueeze(x).decode() for x in z[lo:hi]], pa.large_string()), settings.shingle) for z in (za, zb)]
                wa, wb, both, lacks, extra = weighted_overlap(*sides, idf.value)
                gap = half(lacks, extra)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(wa), pa.array(wb), pa.array(both), pa.array([g.tobytes() for g in gap], pa.binary())], names=["a", "b", "wa", "wb", "both", "gap"])

    return run


def _compare_blocks(settings: Settings, most_pairs: int):
    """Pairs of nodes in different components that may reach the threshold; rows come sorted by bucket and block pair.

    Of a node and a component, the ``most_pairs`` likeliest; a pair of nulls tells that more are left.
    """

    def pairs(rows: list[dict], found: set) -> None:
        gap = np.stack([np.frombuffer(r["gap"], dtype=np.float16) if r["gap"] is not None else np.zeros(2 * GAP, np.float16) for r in rows]).astype(np.float32)
        lacks, extra = gap[:, :GAP], gap[:, GAP:]
        comp = np.unique([r["comp"] for r in rows], return_inverse=True)[1]
        w, inside = (np.array([r[c] for r in rows]) for c in ("w", "both"))
        stray, whole = np.array([r["side"] for r in rows]), rows[0]["wo"]
        others = np.flatnonzero(stray != 1)  # side 1: of the block of strays, 2: of the other block, 3: of both
        for x in np.flatnonzero(stray != 2):
            y = others[comp[others] != comp[x]]
            shared = np.minimum(np.minimum(inside[x], inside[y]), whole - np.maximum(lacks[x], lacks[y]).sum(axis=1))
            most = shared + np.minimum(extra[x], extra[y]).sum(axis=1)
            ratio = most * (1 + 1e-5) / np.maximum(w[x] + w[y] - most, 1e-9)
            may = (ratio >= settings.threshold) | (most >= w[x] + w[y])
            y, ratio = y[may], ratio[may]
            order = np.lexsort((-ratio, comp[y]))
            y = y[order]
            start = np.flatnonzero(np.concatenate([[True], comp[y][1:] != comp[y][:-1]])) if len(y) else y
            rank = np.arange(len(y)) - np.repeat(start, np.diff(np.append(start, len(y))))
            if (rank >= most_pairs).any():
                found.add((None, None))
            for z in y[rank < most_pairs]:
                found.add((min(rows[x]["node"], rows[z]["node"]), max(rows[x]["node"], rows[z]["node"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        found: set = set()

        def take():
            out = pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
            found.clear()
            return out

        for batch in batches:
            for row in batch.to_pylist():
                here = (row["bucket"], row["i"], row["j"])
                if here != last and held:
                    pairs(held, found)
                    held = []
                    if len(found) > 20_000:
                        yield take()
                held.append(row)
                last = here
        if held:
            pairs(held, found)
        yield take()

    return run


def _named(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """One row per row of ``docs``: id_, k1_, k2_, node (null without words), class_ (a name of its class)."""
    id_type = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    k1, k2 = row_hash(key, text)
    base = docs.select(F.col(key).alias("id_"), k1.alias("k1_"), k2.alias("k2_"), F.col(text).alias("text_"))
    idf = spark.sparkContext.broadcast(idf_table(base, "text_", settings))
    signed = materialize(arrow_map(base, _sign(idf, settings), f"id_ {id_type}, k1_ long, k2_ long, n_words_ long, node_ binary, bands_ array<long>, z_ binary"), "signatures")

    # One row stands for each node; only nodes that share a bucket go on.
    stand = signed.where("node_ is not null").groupBy(F.col("node_").alias("node")).agg(F.min(F.struct("k1_", "k2_")).alias("k_")).select("node", "k_.*")
    stand = materialize(stand, "nodes")
    chosen = signed.join(stand, ["k1_", "k2_"], "left_semi").select("node_", "bands_")
    spread = chosen.select(F.col("node_").alias("node"), F.explode("bands_").alias("bucket")).distinct()
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(spread.join(shared, "bucket"), "members")
    pop = members.groupBy("node").agg(F.sum("n").alias("pop"))
    leaders = members.join(pop, "node").groupBy("bucket").agg(F.max(F.struct("pop", "node")).alias("l_")).select("bucket", "l_.pop", F.col("l_.node").alias("leader"))
    led = materialize(members.join(leaders, "bucket"), "led")
    drop_materialized(spark, members)

    involved = stand.join(led.select("node").distinct(), "node")
    texts = signed.select("k1_", "k2_", "z_").join(involved, ["k1_", "k2_"])
    texts = materialize(texts.select("node", "z_").dropDuplicates(["node"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        z = texts.select("node", "z_")
        put = pairs.join(z.select(F.col("node").alias("a"), F.col("z_").alias("za_")), "a").join(z.select(F.col("node").alias("b"), F.col("z_").alias("zb_")), "b")
        return materialize(arrow_map(put.select("a", "b", "za_", "zb_"), _verify(idf, settings), "a binary, b binary, wa double, wb double, both double, gap binary"), "verified")

    def labelled(pairs: DataFrame, *sides: str) -> DataFrame:
        for side in sides:
            pairs = pairs.join(comp.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}")), side)
        return pairs

    linked = F.expr(f"both >= {settings.threshold - 1e-9} * (wa + wb - both)")
    # The best leader of a node meets more than the node itself, so these links make no cycle.
    best = led.where("node != leader").groupBy("node").agg(F.max(F.struct("pop", "leader"))["leader"].alias("leader"))
    checked = verified(best.select(F.col("leader").alias("a"), F.col("node").alias("b")))
    up = roots(checked.where(linked).select(F.col("b").alias("node"), F.col("a").alias("up")))
    comp = materialize(texts.select("node").join(up, "node", "left").select("node", F.coalesce("up", "node").alias("comp")), "labels")

    def told(pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs in different components that have not been verified."""
        return labelled(pairs, "a", "b").where("comp_a != comp_b").select("a", "b").join(checked.select("a", "b"), ["a", "b"], "left_anti")

    more = verified(told(led.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()))
    comp, checked = join_labels(comp, more.where(linked)), checked.unionByName(more)

    # Buckets that still hold several components: the nodes outside the leader's are strays.
    most_pairs, facts = settings.first_pairs, None
    while True:
        known = labelled(led.where("n > 2"), "node", "leader")
        strays = known.groupBy("bucket").agg(F.count_if(F.col("comp_node") != F.col("comp_leader")).alias("n_strays")).where("n_strays > 0")
        open_ = materialize(known.join(strays, "bucket").select("bucket", "node", "leader", "n", "n_strays", F.col("comp_node").alias("comp"), (F.col("comp_node") != F.col("comp_leader")).alias("stray")), "open")
        if facts is None:
            if not open_.head(1):
                break
            # Bounds need every node's overlap with the leader of its bucket.
            pairs = open_.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
            missing = verified(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"))
            checked = checked.unionByName(missing)
            facts = checked.select(F.col("a").alias("leader"), F.col("b").alias("node"), F.col("wb").alias("w"), "both", F.col("wa").alias("wo"), "gap")
            own = checked.select(F.col("a").alias("leader"), F.col("a").alias("node"), F.col("wa").alias("w"), F.col("wa").alias("both"), F.col("wa").alias("wo"), F.lit(None).cast("binary").alias("gap")).dropDuplicates(["node"])
            facts = facts.unionByName(own)
        blocks, strata = (F.greatest(F.lit(1), F.ceil(F.col(c) / settings.block)).cast("int") for c in ("n", "n_strays"))
        i, j = (F.pmod(F.xxhash64("node", F.lit(k)), m).cast("int") for k, m in ((1, strata), (2, blocks)))
        # A stray goes to its own row of block pairs, every node to its own column.
        as_stray = F.when(F.col("stray"), F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(i.alias("i"), x.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
        as_other = F.transform(F.sequence(F.lit(0), strata - 1), lambda x: F.struct(x.alias("i"), j.alias("j")))
        dealt = open_.join(facts, ["leader", "node"]).withColumns({"i_": i, "j_": j, "at": F.explode(F.array_union(as_stray, as_other))})
        side = F.when(F.col("stray") & (F.col("at.i") == F.col("i_")), F.when(F.col("at.j") == F.col("j_"), 3).otherwise(1)).otherwise(2)
        dealt = dealt.select("bucket", "at.i", "at.j", side.alias("side"), "node", "comp", "w", "both", "wo", "gap").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        pairs = materialize(arrow_map(dealt, _compare_blocks(settings, most_pairs), "a binary, b binary").distinct(), "pairs")
        known_pairs = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        more = verified(pairs.where("a is not null").join(known_pairs, ["a", "b"], "left_anti"))
        comp, checked = join_labels(comp, more.where(linked)), checked.unionByName(more)
        if not pairs.where("a is null").head(1):
            break
        most_pairs *= 16

    named = signed.select("id_", "k1_", "k2_", F.col("node_").alias("node")).join(comp, "node", "left")
    alone = F.concat(F.lit(b""), F.encode(F.concat_ws(":", F.lit("row"), "k1_", "k2_"), "UTF-8"))
    return named.select("id_", "k1_", "k2_", "node", F.coalesce("comp", "node", alone).alias("class_"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: key, class_id (least key of its class), n_texts (distinct texts of the class), k1_, k2_ (its ``row_hash``).

    Classes are the components of the links at ``threshold`` or more.  Texts without a word
    are each a class of their own; a class without any key has a null id; repeated rows share
    a class; an empty table gives no rows.
    """
    named = _named(docs, key, text, settings)
    # Written, so that the join reads both sides from exchanges and Spark can split a large class.
    per_node = named.groupBy("class_", "node").agg(F.min("id_").alias("least"))
    classes = materialize(per_node.groupBy("class_").agg(F.min("least").alias("class_id"), F.count("node").alias("n_texts")), "classes")
    return named.join(classes, "class_").select(F.col("id_").alias(key), "class_id", "n_texts", "k1_", "k2_", "class_")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with their columns, that stand for their class: the least key, one row."""
    named = _named(docs, key, text, settings)
    first = named.groupBy("class_").agg(F.min(F.struct(F.col("id_").isNull().alias("none"), F.col("id_").alias("id"), "k1_", "k2_")).alias("f_")).select("f_.k1_", "f_.k2_")
    k1, k2 = row_hash(key, text)
    name1, name2 = "k1_", "k2_"
    while {name1, name2} & {c.lower() for c in docs.columns}:
        name1, name2 = "_" + name1, "_" + name2
    kept = docs.withColumns({name1: k1, name2: k2}).join(first.toDF(name1, name2), [name1, name2], "left_semi")
    return kept.dropDuplicates([name1, name2]).select(*docs.columns)
