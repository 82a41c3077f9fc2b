"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text (A-Z in lower case) is a sequence of words and an end symbol.  A frequent word is a
path of binary decisions in a Huffman tree of words; any other word is an escape symbol and
its bytes, each a path in a Huffman tree of bytes.  Three predictors look at a decision: by
its tree node alone, by the node with the word before (within a spelled word: the two bytes
before), and by the node with the two words before (there: the word so far), the last two
hashed into tables of counts.  Their predictions (in the logistic domain) are summed by
weights that a gate chooses (how often the two contexts have been seen), and an adaptive map
corrects the sum by its size.

Training is online within each input partition: a stretch of text is predicted from what came
before it there, weights and map are updated by all its decisions (weights by gradient steps),
then the stretch is counted.  A context's counts for a node and the nodes up to two levels below
it share a block of eight slots.  Predictions are renewed from the counts whenever these have doubled
(past STEP decisions: every STEP), so that small partitions learn too.  Tables of all partitions
are added up, weights averaged by the decisions of their gate.  All counts cover all training texts.  Tables and word tree
grow with the counted words up to what each worker can hold (MOST_BITS, MOST_WORDS); past that
contexts share slots, and more words are spelled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, row_hash
from .words import BYTE_BASE, Words, buffers, chunks, inverse, mix, powers, words_of

END = 0xFF  # a byte that no UTF-8 text has; it ends a spelled word
#: log2 of the tables' sizes (the shorter context, the longer one) of a small corpus, and the most of either.
BITS = (19, 19)
MOST_BITS = 22
#: Words in the tree for a small corpus, and the most.
LEAST_WORDS, MOST_WORDS = 1 << 18, 1 << 19
GATES = 64
MAP_STEPS = 48
#: How sure a context is, by the number of binary digits of its count.
CONFIDENCE = np.array([0, 1, 2, 3, 4, 4, 5, 5, 6, 6] + [7] * 24, dtype=np.int16)
SEGMENT = 1 << 12
BLOCK = 1 << 15
#: Decisions before predictions are first made from the counts, and the most from one renewal to the next.
FIRST, STEP = 1 << 10, 1 << 23
#: Levels of a tree whose counts lie together.
LEVELS = 3


def _huffman(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the paths to each symbol, their nodes and bits one after the other, each node's weights on both sides, and its mark.

    A mark is eight times the node at the head of a node's block of LEVELS levels, and its place there (1 for the head).
    """
    n = len(weight)
    heap = [(w, s) for s, w in enumerate(weight.tolist())]
    heapq.heapify(heap)
    up, side, sides = np.zeros(2 * n - 1, np.int32), np.zeros(2 * n - 1, np.uint8), np.zeros((n - 1, 2))
    for i in range(n - 1):
        (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
        up[a] = up[b] = n + i
        side[b] = 1
        sides[i] = wa, wb
        heapq.heappush(heap, (wa + wb, n + i))
    depth = np.zeros(2 * n - 1, np.int32)
    mark = np.zeros(n - 1, np.int32)
    mark[n - 2] = (n - 2) * 8 + 1
    for i in range(n - 3, -1, -1):
        above = up[n + i]
        depth[n + i] = depth[above] + 1
        over = mark[above - n]
        mark[i] = over + (over & 7) + side[n + i] if depth[n + i] % LEVELS else i * 8 + 1
    length = depth[up[:n]] + 1
    stop = np.cumsum(length)
    node, bit = np.zeros(stop[-1], np.int32), np.zeros(stop[-1], np.uint8)
    at, live, put = np.arange(n), np.arange(n), stop - 1
    while len(live):
        node[put[live]], bit[put[live]] = up[at[live]] - n, side[at[live]]
        at[live], put[live] = up[at[live]], put[live] - 1
        live = live[at[live] < 2 * n - 2]
    return length, node, bit, sides, mark


class Lookup:
    """Places of hashes in a sorted array, by their first bits."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(8, len(hashes).bit_length() + 1)
        self.start = np.searchsorted(hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int32)
        if not len(self.hashes):
            return out
        first = (h >> np.uint64(64 - self.bits)).astype(np.intp)
        at, stop = self.start.take(first), self.start.take(first + 1)
        live = np.flatnonzero(at < stop)
        at, stop, h = at[live], stop[live], h[live]
        while len(live):
            hit = self.hashes.take(at) == h
            out[live[hit]] = at[hit]
            at += 1
            more = ~hit & (at < stop)
            live, at, stop, h = live[more], at[more], stop[more], h[more]
        return out


def pack(counts: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(part: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(part), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").reshape(-1)


@dataclass
class Code:
    """Symbols: frequent words (``symbol`` of a place in ``lookup``, -1 if spelled), escape, end of text, bytes.

    Symbol s is the entries offset[s] to offset[s] + length[s], each a node and a bit (its lowest).
    Words ``held_back`` (half of those seen once) are spelled in training, as words never seen are later.
    """

    lookup: Lookup
    symbol: np.ndarray
    log_count: np.ndarray
    length: np.ndarray
    offset: np.ndarray
    entry: np.ndarray
    stretch: np.ndarray
    mark: np.ndarray
    held_back: np.ndarray
    bits: tuple[int, int] = BITS

    @classmethod
    def of(cls, words: np.ndarray, counts: np.ndarray, in_tree: np.ndarray, rare: float, ends: float, bytes_: np.ndarray) -> "Code":
        order = np.argsort(words)
        words, counts, in_tree = words[order], counts[order], in_tree[order]
        held_back = in_tree & (counts == 1) & (words >> np.uint64(7) & np.uint64(1) == 1)
        rare += held_back.sum()
        n1, node1, bit1, sides1, mark1 = _huffman(np.concatenate([counts[in_tree], [rare + 1, ends + 1]]))
        n2, node2, bit2, sides2, mark2 = _huffman(bytes_ + 1)
        length = np.concatenate([n1, n2]).astype(np.int32)
        sides = np.concatenate([sides1, sides2]) + 0.5
        entry = np.concatenate([node1, node2 + len(sides1)]).astype(np.int32) * 2 + np.concatenate([bit1, bit2])
        symbol = np.where(in_tree, np.cumsum(in_tree) - 1, -1).astype(np.int32)
        return cls(Lookup(words), symbol, np.log10(counts + 1), length, (np.cumsum(length) - length).astype(np.int32), entry.astype(np.int32), np.log(sides[:, 1] / sides[:, 0]).astype(np.float32), np.concatenate([mark1, mark2 + len(sides1) * 8]).astype(np.int32), held_back)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"entry": pack(self.entry), "length": pack(self.length), "offset": None, "symbol": pack(self.symbol)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.entry, self.length, self.symbol = (unpack(state[k]).view(np.int32) for k in ("entry", "length", "symbol"))
        self.offset = (np.cumsum(self.length) - self.length).astype(np.int32)

    @property
    def escape(self) -> int:
        return len(self.length) - 258


@dataclass
class Symbols:
    """Symbols of some texts with their contexts; text i begins at first[i]."""

    symbol: np.ndarray
    contexts: tuple[np.ndarray, np.ndarray]
    first: np.ndarray


def symbols_of(words: Words, code: Code, found: np.ndarray, training: bool = False) -> Symbols:
    """``found``: the words' places in the code's lookup."""
    n, n_docs = len(words.hash), len(words)
    place = np.where(found >= 0, np.append(code.symbol, -1).take(found, mode="wrap"), -1)
    known = place >= 0
    if training:
        known &= ~np.append(code.held_back, False).take(found, mode="wrap")
    spelled = np.where(known, 0, words.end - words.start)
    doc = np.repeat(np.arange(n_docs), np.diff(words.first))
    unit = np.arange(n) + doc
    stop = words.first[1:] + np.arange(n_docs)
    size = np.ones(n + n_docs, dtype=np.int64)
    size[unit] += np.where(known, 0, spelled + 1)
    at = np.cumsum(size) - size
    # The words before, as hashes; zero before a text's first.
    last = np.zeros(n + n_docs + 2, dtype=np.uint64)
    last[unit + 2] = words.hash
    last[stop + 2] = 0
    one, two = last[1:-1], last[:-2]
    # Before a text's first word stands the end of the one before it, which is zero; the word before that must not count.
    two = np.where(one == 0, np.uint64(0), two)
    context = [np.zeros(int(size.sum()), dtype=np.uint32) for _ in range(2)]
    context[0][at] = (one >> np.uint64(32)).astype(np.uint32)
    context[1][at] = (mix(one + two * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    symbol = np.full(len(context[0]), code.escape, dtype=np.int32)
    symbol[at[unit[known]]] = place[known]
    symbol[at[stop]] = code.escape + 1
    rare = np.flatnonzero(~known)
    if len(rare):
        n_bytes = spelled[rare]
        which = np.repeat(np.arange(len(rare)), n_bytes + 1)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n_bytes + 1) - n_bytes - 1, n_bytes + 1)
        start = words.start[rare][which]
        to = at[unit[rare]][which] + 1 + step
        padded = np.append(words.data, np.uint8(END))
        value = np.where(step == n_bytes[which], END, padded[start + step]).astype(np.int32)
        symbol[to] = code.escape + 2 + value
        b1 = np.where(step > 0, padded[start + step - 1], 0).astype(np.uint32)
        b2 = np.where(step > 1, padded[start + step - 2], 0).astype(np.uint32)
        total = np.zeros(len(words.data) + 1, dtype=np.uint64)
        np.cumsum((words.data.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, len(words.data))[: len(words.data)], out=total[1:])
        so_far = (total[start + step] - total[start]) * powers(inverse(BYTE_BASE), len(words.data))[start]
        context[0][to] = (b1 | b2 << np.uint32(8)) * np.uint32(0x9E3779B1)
        context[1][to] = (mix(so_far) >> np.uint64(32)).astype(np.uint32)
    first = np.append(at, len(symbol))[words.first + np.arange(n_docs + 1)]
    return Symbols(symbol, (context[0], context[1]), first)


def decisions(s: Symbols, code: Code) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """Some symbols at a time: nodes, slots by predictor, bits, first decision of each text in it, those texts."""
    count_up = np.arange(32 * SEGMENT, dtype=np.int32)
    for lo in range(0, len(s.symbol), SEGMENT):
        part = s.symbol[lo : lo + SEGMENT]
        n = code.length[part]
        stop = np.cumsum(n, dtype=np.int32)
        at = np.repeat(code.offset[part] - stop + n, n)
        at += count_up[: len(at)] if len(at) <= len(count_up) else np.arange(len(at), dtype=np.int32)
        entry = code.entry.take(at)
        node, bit = entry >> 1, (entry & 1).astype(np.uint8)
        mark = code.mark.take(node)
        salt = (mark >> 3).astype(np.uint32) * np.uint32(0x27D4EB2F)
        mark &= 7
        place = mark.view(np.uint32)
        slots = []
        for c, b in zip(s.contexts, code.bits, strict=True):
            x = np.repeat(c[lo : lo + SEGMENT], n)
            x ^= salt
            x *= np.uint32(0x2C1B3C6D)
            x >>= np.uint32(32 - b)
            x ^= place
            slots.append(x.astype(np.intp))
        texts = np.arange(np.searchsorted(s.first, lo, side="right") - 1, np.searchsorted(s.first, min(lo + SEGMENT, len(s.symbol)), side="left"))
        yield node, slots, bit, (stop - n)[np.maximum(s.first[texts] - lo, 0)], texts


def sizes(n_words: int, n_kinds: int) -> tuple[int, int]:
    """log2 of the slots of a table and the words in the tree, from the words and kinds of words counted."""
    return min(MOST_BITS, max(BITS[0], (4 * n_words).bit_length())), min(MOST_WORDS, max(LEAST_WORDS, n_kinds))


class Model:
    """Counts per slot, gated weights and the adaptive map."""

    def __init__(self, code: Code):
        self.start(code.stretch, code.bits)

    def start(self, base: np.ndarray, bits: tuple[int, int]) -> None:
        self.base, self.bits = base, bits
        self.counts = [np.zeros((1 << b, 2), dtype=np.uint32) for b in bits]
        self.told = [np.zeros(1 << b, dtype=np.int16) for b in bits]
        # Slots counted since the last renewal, or None if too many to list.
        self.touched: list[list | None] = [None for _ in bits]
        self.weights = [np.full(GATES, w, dtype=np.float32) for w in (1.0, 0.1, 0.1)]
        self.map = np.zeros((MAP_STEPS, 2), dtype=np.float64)
        self.seen = np.zeros(GATES)
        self.refresh()

    def refresh(self) -> None:
        """Predictions and confidences from the counts."""
        # One number holds both, so that one look-up gets them: the prediction in steps of
        # 2**-8 (up to 15.9, past what ``cost`` lets count), its lowest three bits the confidence.
        for k, (c, told) in enumerate(zip(self.counts, self.told, strict=True)):
            if self.touched[k] is None:
                pieces = (slice(i, i + BLOCK) for i in range(0, len(c), BLOCK))
            else:
                fresh = np.zeros(len(c), dtype=bool)
                for i in self.touched[k]:
                    fresh[i] = True
                pieces = [np.flatnonzero(fresh)]
            self.touched[k] = []
            for some in pieces:
                n = c[some].astype(np.float32)
                stretch = np.log((n[:, 1] + np.float32(0.4)) / (n[:, 0] + np.float32(0.4)))
                # The exponent of a floating-point number is the logarithm sought.
                sure = CONFIDENCE.take(((n[:, 0] + n[:, 1] + np.float32(1)).view(np.int32) >> 23) - 127)
                told[some] = (np.clip(stretch, np.float32(-15.9), np.float32(15.9)) * np.float32(1 << 11)).astype(np.int16) & ~7 | sure
        middle = (np.arange(MAP_STEPS) + 0.5) * 0.375 - 9
        hits = self.map
        p = (hits[:, 1] + 20 / (1 + np.exp(-middle))) / (hits.sum(axis=1) + 20)
        self.corrected = (p - 1 / (1 + np.exp(-middle))).astype(np.float32) / 2

    def mix(self, slots: list[np.ndarray], node: np.ndarray):
        told = [t.take(i) for t, i in zip(self.told, slots, strict=True)]
        inputs = [self.base.take(node), *(t * np.float32(2.0**-11) for t in told)]
        gate = ((told[0] & 7) << 3 | told[1] & 7).astype(np.intp)
        dot = self.weights[0].take(gate)
        dot *= inputs[0]
        for w, x in zip(self.weights[1:], inputs[1:], strict=True):
            y = w.take(gate)
            y *= x
            dot += y
        return inputs, gate, dot

    @staticmethod
    def place(dot: np.ndarray) -> np.ndarray:
        at = (dot + np.float32(9)) * np.float32(1 / 0.375)
        return np.clip(at, 0, MAP_STEPS - 1, out=at).astype(np.int8)

    def cost(self, slots, node, bit) -> np.ndarray:
        """ln of the probability given to each decision."""
        _, _, dot = self.mix(slots, node)
        fix = self.corrected.take(self.place(dot))
        np.negative(dot, out=dot)
        np.exp(dot, out=dot)
        dot += np.float32(1)
        np.reciprocal(dot, out=dot)
        dot += fix  # the probability of a 1, kept off both ends so that those of 0 and 1 add up to 1
        np.clip(dot, np.float32(1e-6), np.float32(1 - 1e-6), out=dot)
        np.subtract(np.float32(1) - bit, dot, out=dot)
        np.abs(dot, out=dot)
        np.log(dot, out=dot)
        return dot

    def learn(self, slots, node, bit) -> None:
        """Steps of weights and map by all decisions given."""
        inputs, gate, dot = self.mix(slots, node)
        place = self.place(dot).astype(np.intp)
        place <<= 1
        place += bit
        self.map += np.bincount(place, minlength=2 * MAP_STEPS).reshape(-1, 2)
        np.negative(dot, out=dot)
        np.exp(dot, out=dot)
        dot += np.float32(1)
        np.reciprocal(dot, out=dot)
        error = np.subtract(bit, dot, out=dot)
        seen = np.bincount(gate, minlength=GATES)
        rate = 0.3 * np.minimum(1, seen / 50) / np.maximum(seen, 1) / (1 + self.seen.sum() / 8e7)
        for w, x in zip(self.weights, inputs, strict=True):
            x *= error
            w += (rate * np.bincount(gate, x, minlength=GATES)).astype(np.float32)
        self.seen += seen

    def count(self, slots, bit) -> None:
        for k, (c, i) in enumerate(zip(self.counts, slots, strict=True)):
            if self.touched[k] is not None:
                self.touched[k].append(i)
                if 8 * sum(map(len, self.touched[k])) > len(c):
                    self.touched[k] = None
            np.add.at(c.reshape(-1), 2 * i + bit, np.uint32(1))

    def parts(self) -> Iterator[tuple[int, bytes]]:
        """Blocks of numbers that add up over partitions: block -1 has the weights and the map, the others counts."""
        yield -1, np.concatenate([*(w * self.seen for w in self.weights), self.seen, self.map.ravel()]).astype("<f8").tobytes()
        first = 0
        for c in self.counts:
            flat = c.reshape(-1)
            for i in range(0, len(flat), BLOCK):
                if flat[i : i + BLOCK].any():
                    yield first + i // BLOCK, pack(flat[i : i + BLOCK])
            first += len(flat) // BLOCK

    @classmethod
    def join(cls, code: Code, blocks: Iterable[tuple[int, bytes]]) -> "Model":
        out = cls(code)
        out.fill(blocks)
        return out

    def fill(self, blocks: Iterable[tuple[int, bytes]]) -> None:
        """Take over sums of ``parts``."""
        for block, part in blocks:
            if block < 0:
                rest = np.frombuffer(part, dtype="<f8")
                sums, self.seen = rest[: 3 * GATES].reshape(3, GATES), rest[3 * GATES : 4 * GATES]
                for w, x in zip(self.weights, sums, strict=True):
                    np.divide(x, self.seen, out=w, where=self.seen > 0, casting="same_kind")
                self.map = rest[4 * GATES :].reshape(self.map.shape)
                continue
            for c in self.counts:
                if block < c.size // BLOCK:
                    c.reshape(-1)[block * BLOCK : (block + 1) * BLOCK] = unpack(part)
                    break
                block -= c.size // BLOCK
        self.touched = [None for _ in self.counts]
        self.refresh()

    # Counts are packed far smaller than the predictions made from them, which are all that a copy keeps.
    def __getstate__(self) -> tuple:
        return self.base, self.bits, list(self.parts())

    def __setstate__(self, state: tuple) -> None:
        base, bits, blocks = state
        self.start(base, bits)
        self.fill(blocks)
        self.counts = []


class Trainer:
    """Learns from decisions in their order, and counts them."""

    def __init__(self, code: Code):
        self.model = Model(code)
        self.since, self.due, self.counted = 0, FIRST, 0

    def add(self, node, slots, bit) -> None:
        at = 0
        while at < len(bit):
            part = slice(at, min(len(bit), at + self.due - self.since))
            mine = [s[part] for s in slots]
            self.model.learn(mine, node[part], bit[part])
            self.model.count(mine, bit[part])
            self.since += part.stop - at
            at = part.stop
            if self.since == self.due:
                self.model.refresh()
                self.counted += self.due
                self.since, self.due = 0, min(self.counted, STEP)

    def end(self) -> Model:
        return self.model


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words by hash (kind 0), and of bytes and end symbols (kind 1)."""
    held, n_held, bytes_, ends = [], 0, np.zeros(256, dtype=np.int64), 0

    def out():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        for i in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h[i : i + 100_000]), np.int8)), pa.array(h[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["kind", "h", "n"])

    for batch in batches:
        ends += len(batch)
        for lo, hi in chunks(batch.column(0)):
            part = batch.column(0).slice(lo, hi - lo)
            words = words_of(part, lower=True)
            bytes_ += np.bincount(words.data, minlength=256)
            held.append(words.hash)
            n_held += len(words.hash)
            if n_held > 8_000_000:
                yield from out()
                held, n_held = [], 0
    if n_held:
        yield from out()
    bytes_[END] += ends
    used = np.flatnonzero(bytes_)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int8)), pa.array(used), pa.array(bytes_[used])], names=["kind", "h", "n"])


def _train(code):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(code.value)
        for batch in batches:
            for lo, hi in chunks(batch.column(0), 1 << 20):
                words = words_of(batch.column(0).slice(lo, hi - lo), lower=True)
                s = symbols_of(words, code.value, code.value.lookup.find(words.hash), training=True)
                for node, slots, bit, _, _ in decisions(s, code.value):
                    trainer.add(node, slots, bit)
        model = trainer.end()
        if model.seen.any():
            keys, values = zip(*model.parts(), strict=True)
            for i in range(0, len(keys), 16):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 16], pa.int32()), pa.array(values[i : i + 16], pa.binary())], names=["block", "part"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(part, dtype="<f8") if block < 0 else unpack(part).astype(np.int64)
            total[block] = total[block] + x if block in total else x
    if total:
        # A slot's counts stop where 32 bits do.
        parts = [x.tobytes() if block < 0 else pack(np.minimum(x, (1 << 32) - 1)) for block, x in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(parts, pa.binary())], names=["block", "part"])


def _score(shared_code, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, model = shared_code.value, shared.value
        for batch in batches:
            for lo, hi in chunks(batch.column("text_"), 1 << 20):
                part = batch.slice(lo, hi - lo)
                text = part.column("text_")
                words = words_of(text, lower=True)
                found = code.lookup.find(words.hash)
                symbols = symbols_of(words, code, found)
                cost = np.zeros(len(part), dtype=np.float64)
                for node, slots, bit, first, texts in decisions(symbols, code):
                    if len(texts):
                        np.add.at(cost, texts, np.add.reduceat(model.cost(slots, node, bit), first, dtype=np.float64))
                n = np.diff(words.first)
                doc = np.repeat(np.arange(len(n)), n)
                hit = found >= 0
                known = np.bincount(doc[hit], minlength=len(n))
                logs = np.bincount(doc[hit], code.log_count[found[hit]], minlength=len(n)).astype(np.float64)
                rest = words.hash[~hit].view(np.int64)
                places = np.concatenate([[0], np.cumsum(np.bincount(doc[~hit], minlength=len(n)))]).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(places), pa.array(rest))
                yield pa.RecordBatch.from_arrays([part.column("id_"), part.column("k1_"), part.column("k2_"), part.column("held_"), pa.array(n + 1), pa.array(known), pa.array(logs), rare, pa.array(np.diff(buffers(text)[1])), pa.array(cost / np.log(10))], names=["id_", "k1_", "k2_", "held_", "n_tokens", "known_", "logs_", "rare_", "n_bytes", "score"])

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", held_mod: int = 7, held_at: int = 2, top_words: int | None = None, tree_words: int | None = None) -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Learns from rows whose crc32 of the key (as text) modulo ``held_mod`` is not ``held_at``;
    a null key is not held out.  ``score`` is the log10 probability of the text with its end.
    A null or empty text is its end alone; repeated rows score alike and are learned from as
    often; without training rows every decision is even.  Counts of the ``top_words`` most
    frequent words are broadcast, all others are joined; the ``tree_words`` most frequent are
    symbols of the tree.  Both follow from the counted words (``sizes``) unless given.
    """
    spark = docs.sparkSession
    id_type = docs.schema[key].dataType.simpleString()
    k1, k2 = row_hash(key, text)
    held = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % held_mod == held_at, F.lit(False))
    base = docs.select(F.col(key).alias("id_"), k1.alias("k1_"), k2.alias("k2_"), held.alias("held_"), F.coalesce(F.col(text), F.lit("")).alias("text_"))
    training = base.where("not held_").select("text_")

    gathered = arrow_map(training, _gather, "kind byte, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    gathered = materialize(gathered, "counts")
    bytes_ = np.zeros(256, dtype=np.int64)
    for r in gathered.where("kind = 1").collect():
        bytes_[r["h"]] = r["n"]
    words = gathered.where("kind = 0").select("h", F.col("n").alias("c"))
    n_words, n_kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_ends = int(bytes_[END])
    n_all, v_all = n_words + n_ends, n_kinds + (n_ends > 0)
    bits, most_words = sizes(n_words, n_kinds)
    top_words, tree_words = (most_words if w is None else w for w in (top_words, tree_words))
    top = words.orderBy(F.desc("c"), "h").limit(top_words).toArrow()
    top_h, top_c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy().astype(np.float64)
    in_tree = np.arange(len(top_c)) < tree_words
    code = Code.of(top_h, top_c, in_tree, float(n_words - top_c[in_tree].sum()), float(n_ends), bytes_.astype(np.float64))
    code.bits = (bits, bits)

    shared_code = spark.sparkContext.broadcast(code)
    parts = arrow_map(arrow_map(training, _train(shared_code), "block int, part binary").repartition(64, "block"), _add, "block int, part binary")
    model = Model.join(code, ((r["block"], r["part"]) for r in parts.toLocalIterator()))
    shared = spark.sparkContext.broadcast(model)
    del model

    scored = arrow_map(base, _score(shared_code, shared), f"id_ {id_type}, k1_ long, k2_ long, held_ boolean, n_tokens long, known_ long, logs_ double, rare_ array<long>, n_bytes long, score double")
    scored = materialize(scored, "scored")
    rare = scored.select("k1_", "k2_", "rare_").dropDuplicates(["k1_", "k2_"]).select("k1_", "k2_", F.explode("rare_").alias("h"))
    found = rare.join(words, "h").groupBy("k1_", "k2_").agg(F.count("*").alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_logs"))
    out = scored.drop("rare_").join(found, ["k1_", "k2_"], "left")
    end_log = float(np.log10(n_ends + 1.0))
    n_known = F.col("known_") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_ends > 0))
    base_score = F.col("logs_") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(float(np.log10(n_all + v_all + 1.0)))
    bits = -F.col("score") * F.lit(float(np.log2(10))) / F.greatest("n_bytes", F.lit(1))
    return out.select(F.col("id_").alias(key), F.col("held_").alias("held_out"), "n_tokens", n_known.cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"), base_score.alias("base_score"), "score", "n_bytes", bits.alias("bits_per_byte"))
