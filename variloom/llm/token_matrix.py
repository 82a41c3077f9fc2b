"""Token id matrices: documents packed into rows by best-fit decreasing.

Pieces are placed from the longest to the shortest, each in the open row whose room is the
least that holds it; a segment tree over room sizes finds that row in logarithmic time.
Documents longer than a row are split losslessly at multiples of it.  As with any packing
here, each input partition is packed by itself in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map
from .packing import PARTITION_STRIDE
from .tokens import ID_BYTES, default_vocabulary, encoder


class RoomTree:
    """Rows by the room left in them; the least sufficient room is found by descent."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least ``need``, removed; or None."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        row = self.rows[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of piece numbers; ties in length keep the given order."""
    rows: list[list[int]] = []
    tree = RoomTree(capacity)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        got = tree.take(n)
        if got is None:
            rows.append([i])
            room, row = capacity, len(rows) - 1
        else:
            room, row = got
            rows[row].append(i)
        if room > n:
            tree.put(room - n, row)
    return rows


def pack_matrix(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1, pad_id: int = 0, capacity: int = 2048, block_ids: int = 4_000_000) -> DataFrame:
    """Tokenize whole texts, append ``end_id`` and pack into rows of ``capacity`` ids.

    One result row per matrix row: sequence_id, n_tokens, input_ids (capacity little-endian
    uint32, padded with ``pad_id``), position_ids (likewise; they count from 0 anew at each
    segment, and padding has 0), cu_seqlens (cumulative segment lengths, from 0), keys and
    starts (of each segment's document and place in it).  A null or empty text is its end id
    alone; repeated rows are packed each; null keys stay null; an empty table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], dtype="<u4").tobytes()
    key_type = df.schema[key].dataType.simpleString()
    schema = f"sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, keys array<{key_type}>, starts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() * PARTITION_STRIDE
        held, pieces, kind = 0, [], pa.null()
        enc = encoder(vocabulary)
        count_up = np.arange(capacity, dtype="<u4").tobytes()

        def flush():
            nonlocal held, pieces, sequence
            out: list[list] = [[] for _ in range(7)]
            for members in best_fit_decreasing([len(p[2]) // ID_BYTES for p in pieces], capacity):
                row = [pieces[i] for i in members]
                lengths = [len(p[2]) // ID_BYTES for p in row]
                total = sum(lengths)
                ids = b"".join(p[2] for p in row) + np.full(capacity - total, pad_id, dtype="<u4").tobytes()
                places = b"".join(count_up[: n * ID_BYTES] for n in lengths) + bytes((capacity - total) * ID_BYTES)
                cu = [0]
                for n in lengths:
                    cu.append(cu[-1] + n)
                for col, value in zip(out, (sequence, total, ids, places, cu, [p[0] for p in row], [p[1] for p in row]), strict=True):
                    col.append(value)
                sequence += 1
                if len(out[0]) == 500:
                    yield batch_of(out)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield batch_of(out)
            held, pieces = 0, []

        def batch_of(out):
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(kind), pa.list_(pa.int64()))
            names = ["sequence_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "keys", "starts"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for k, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = enc.encode(value) + end
                step = capacity * ID_BYTES
                for at in range(0, len(ids), step):
                    pieces.append((k, at // ID_BYTES, ids[at : at + step]))
                    held += len(pieces[-1][2]) // ID_BYTES
                    if held >= block_ids:
                        yield from flush()
        yield from flush()

    return arrow_map(df.select(key, text), run, schema)


def write_matrix(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet with binary matrices, which any store that Spark writes can hold."""
    packed.write.mode("overwrite").parquet(path)


def as_matrix(column: list[bytes], capacity: int) -> np.ndarray:
    """The ids (or positions) of some rows as one matrix."""
    return np.frombuffer(b"".join(column), dtype="<u4").reshape(-1, capacity)
