"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes (A-Z in lower case) in both directions, labels every
position, and a document's probabilities are the mean over all its positions.  It is trained
in numpy by backpropagation through time on the driver, on a bounded sample of labelled
rows; prediction runs over all windows of all texts, many in step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .words import LOWER, buffers, chunks

LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


@dataclass
class Network:
    """Per direction, inputs by byte (256 x 3H) and recurrent weights (H x 3H); output weights (2H x languages)."""

    languages: list[str]
    hidden: int = 8
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, rng: np.random.Generator) -> None:
        h, n = self.hidden, len(self.languages)
        for d in "fb":
            self.p[f"E{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"U{d}"] = rng.normal(0, 0.4 / np.sqrt(h) * 2, (h, 3 * h)).astype(np.float32)
        self.p["O"] = rng.normal(0, 0.3, (2 * h, n)).astype(np.float32)
        self.p["o"] = np.zeros(n, dtype=np.float32)

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction over bytes (T, B)."""
        t_max, n = x.shape
        h_n = self.hidden
        table, u_w = self.p[f"E{d}"], self.p[f"U{d}"]
        out = np.empty((t_max, n, h_n), dtype=np.float32)
        h = np.zeros((n, h_n), dtype=np.float32)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            a = table.take(x[t], axis=0)
            u = h @ u_w
            gates = _sigmoid(a[:, : 2 * h_n] + u[:, : 2 * h_n])
            z, r = gates[:, :h_n], gates[:, h_n:]
            new = r * u[:, 2 * h_n :]
            new += a[:, 2 * h_n :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, h, z, r, new, u[:, 2 * h_n :]))
            state = out[t]
            np.subtract(h, new, out=state)
            state *= z
            state += new
            h = state
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, languages) of each position."""
        both = np.concatenate([self.run(x, "f"), self.run(x, "b")], axis=2)
        y = both.reshape(-1, 2 * self.hidden) @ self.p["O"]
        y += self.p["o"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        return y.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions of ``mask`` and its gradients."""
        kept = {d: [] for d in "fb"}
        both = np.concatenate([self.run(x, d, kept[d]) for d in "fb"], axis=2)
        flat = both.reshape(-1, 2 * self.hidden)
        y = flat @ self.p["O"] + self.p["o"]
        y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(axis=1, keepdims=True)
        want = np.broadcast_to(label, x.shape).ravel()
        m = mask.ravel().astype(np.float32)
        at = np.arange(len(want))
        loss = float(-(np.log(np.maximum(y[at, want], 1e-9)) * m).sum() / m.sum())
        y[at, want] -= 1
        y *= (m / m.sum())[:, None]
        g = {"O": flat.T @ y, "o": y.sum(axis=0)}
        back = (y @ self.p["O"].T).reshape(*x.shape, 2 * self.hidden)
        h_n = self.hidden
        for i, d in enumerate("fb"):
            u_w = self.p[f"U{d}"]
            g_u = np.zeros_like(u_w)
            g_in = np.empty((*x.shape, 3 * h_n), dtype=np.float32)
            carry = np.zeros((x.shape[1], h_n), dtype=np.float32)
            for t, h, z, r, new, un in reversed(kept[d]):
                dh = back[t, :, i * h_n : (i + 1) * h_n] + carry
                d_new = dh * (1 - z) * (1 - new * new)
                d_z = dh * (h - new) * z * (1 - z)
                d_r = d_new * un * r * (1 - r)
                g_in[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                du = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g_u += h.T @ du
                carry = dh * z + du @ u_w.T
            g[f"U{d}"] = g_u
            cols, byte = g_in.reshape(-1, 3 * h_n), x.ravel()
            g[f"E{d}"] = np.stack([np.bincount(byte, cols[:, c], minlength=256) for c in range(3 * h_n)], axis=1).astype(np.float32)
        return loss, g


def windows_of(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows over each text: bytes (windows, size; 0 past the text's end), lengths, and the text of each."""
    n = np.diff(at)
    per = -(-n // size)
    doc = np.repeat(np.arange(len(n)), per)
    start = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * size
    length = np.minimum(size, at[doc + 1] - start)
    place = np.minimum(start[:, None] + np.arange(size), len(data) - 1)
    x = data[place]
    short = np.flatnonzero(length < size)
    x[short] = np.where(np.arange(size) < length[short, None], x[short], 0)
    return x, length, doc


def train(rows: list[tuple[str, str]], window: int = 64, per_text: int = 3, epochs: int = 8, batch: int = 256, rate: float = 0.01, hidden: int = 8, seed: int = 3) -> Network:
    """Fit on (text, language) rows: some windows at random places of each text."""
    rng = np.random.default_rng(seed)
    net = Network(sorted({lang for _, lang in rows}), hidden)
    net.start(rng)
    x, n, y = [], [], []
    for text, lang in rows:
        data = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
        for _ in range(per_text if len(data) > window else 1):
            lo = int(rng.integers(0, max(1, len(data) - window + 1)))
            part = data[lo : lo + window]
            x.append(np.pad(part, (0, window - len(part))))
            n.append(len(part))
            y.append(net.languages.index(lang))
    if not x or len(net.languages) < 2:
        return net
    x, n, y = np.stack(x).astype(np.int64), np.array(n), np.array(y)
    # Languages with fewer windows are repeated, so that all weigh alike.
    of = [np.flatnonzero(y == c) for c in range(len(net.languages))]
    most = max(map(len, of))
    m1, m2 = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(np.concatenate([rng.permutation(np.resize(i, most)) for i in of]))
        for lo in range(0, len(order), batch):
            part = order[lo : lo + batch]
            mask = np.arange(window)[:, None] < n[part]
            _, g = net.gradients(np.ascontiguousarray(x[part].T), mask, y[part])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            lr = rate * (0.5 ** (epoch // 3)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, v in g.items():
                v = v / max(1.0, norm)
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                net.p[k] = (net.p[k] - lr * m1[k] / (np.sqrt(m2[k]) + 1e-8)).astype(np.float32)
    return net


def document_probabilities(net: Network, column: pa.Array, window: int = 64, at_once: int = 2048) -> np.ndarray:
    """Mean probabilities (texts, languages) over all positions; texts without bytes get zeros."""
    data, at = buffers(column)
    total = np.zeros((len(column), len(net.languages)))
    if len(data):
        x, length, doc = windows_of(LOWER[data], at, window)
        for lo in range(0, len(x), at_once):
            part = slice(lo, lo + at_once)
            y = net.positions(np.ascontiguousarray(x[part].T))
            if (length[part] < window).any():
                y *= (np.arange(window)[:, None] < length[part])[:, :, None]
            sums = y.sum(axis=0)
            for c in range(sums.shape[1]):
                total[:, c] += np.bincount(doc[part], sums[:, c], minlength=len(column))
    return total / np.maximum(np.diff(at), 1)[:, None]


def _predict(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        names = np.array([*net.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for lo, hi in chunks(batch.column("text_")):
                part = batch.slice(lo, hi - lo)
                text = part.column("text_")
                p = document_probabilities(net, text, window) if len(net.languages) > 1 else np.ones((len(part), len(net.languages)))
                letters = np.array([t is not None and LETTER.search(t) is not None for t in text.to_pylist()], dtype=bool)
                best = np.argmax(p, axis=1) if p.shape[1] else np.zeros(len(part), np.int64)
                score = np.clip(p[np.arange(len(p)), best], 0, 1) if p.shape[1] else np.zeros(len(part))
                best = np.where(letters, best, -1)
                yield pa.RecordBatch.from_arrays([part.column("id_"), part.column("held_"), pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0))], names=["id_", "held_", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held_mod: int = 4, held_at: int = 2, rows_per_language: int = 1500, window: int = 64) -> DataFrame:
    """One row per row of ``docs``: key, held_out, lang_pred, score (its mean probability).

    Learns from rows with a text and a language whose crc32 of the key (as text) modulo
    ``held_mod`` is not ``held_at`` (a null key is not held out): about
    ``rows_per_language`` rows of each language, drawn by a hash, twice that at most over
    all.  A null text, or one without a letter, is ``und`` with score 0, and so is every text
    if there is nothing to learn from.  Repeated rows are predicted alike.
    """
    spark = docs.sparkSession
    id_type = docs.schema[key].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % held_mod == held_at, F.lit(False))
    base = docs.select(F.col(key).alias("id_"), held.alias("held_"), F.col(text).alias("text_"), F.col(lang).cast("string").alias("lang_"))
    usable = base.where("not held_ and lang_ is not null and text_ is not null and length(text_) > 0")
    counts = {r["lang_"]: r["count"] for r in base.where("not held_ and lang_ is not null").groupBy("lang_").count().collect()}
    net = Network([])
    if counts:
        share = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 1.1 * rows_per_language / n)))))
        draw = F.pmod(F.xxhash64("id_", "text_"), F.lit(1 << 30)) / float(1 << 30)
        # Only the places that training may look at leave the executors: a long stretch of each text.
        place = (F.pmod(F.xxhash64("text_", "id_"), F.greatest(F.lit(1), F.length("text_") - 2000)) + 1).cast("int")
        sample = usable.where(draw < F.element_at(share, F.col("lang_"))).select(F.col("text_").substr(place, F.lit(2000)).alias("t"), "lang_", draw.alias("draw_"))
        rows = sample.orderBy("draw_", "lang_", "t").limit(2 * rows_per_language * len(counts)).collect()
        net = train([(r["t"], r["lang_"]) for r in rows], window=window)
    shared = spark.sparkContext.broadcast(net)
    out = arrow_map(base.select("id_", "held_", "text_"), _predict(shared, window), f"id_ {id_type}, held_ boolean, lang_pred string, score double")
    return out.select(F.col("id_").alias(key), F.col("held_").alias("held_out"), "lang_pred", "score")
