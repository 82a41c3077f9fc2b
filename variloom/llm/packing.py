"""Vector bin packing: sequences under limits on tokens, segments and loss-bearing tokens.

A sequence is a bin with a residual in each of three dimensions.  Bins are filled one after
the other: of the pieces that fit, the one is placed whose demand has the largest dot product
with the bin's residual (both as shares of the limits); when none fits, the bin is closed.
Where cutting is allowed, a piece is first cut to fill what is left of the bin's tokens.

Every input partition is packed by itself in blocks of bounded size, so nothing is shuffled,
no task holds more than a block, and a lost task is redone from its own input alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .tokens import ID_BYTES, default_vocabulary, encoder

#: Sequence ids of one partition start at its number times this.
PARTITION_STRIDE = 1 << 40


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 128
    loss_tokens: int = 2048
    #: No cut leaves a piece shorter than this.
    least_piece: int = 16
    #: Pieces and ids packed together; they bound a task's memory.
    block_pieces: int = 4096
    block_ids: int = 4_000_000


@dataclass
class Piece:
    doc: int  # position in the block's list of documents
    start: int
    length: int
    loss: int


def pack_vectors(tokens: np.ndarray, loss: np.ndarray, limits: Limits, can_cut: bool) -> list[list[tuple[int, int, int]]]:
    """Pack pieces of the given sizes; returns bins of (piece, start within it, length).

    Each piece must fit an empty bin.  With ``can_cut`` a piece may lie in several bins, its
    loss-bearing tokens then being spread evenly over it (rounded up for the part cut off).
    Ties go to the piece that comes first.
    """
    scale = np.array([1.0 / limits.tokens, 1.0 / limits.segments, 1.0 / max(1, limits.loss_tokens)])
    left = np.arange(len(tokens))
    size = np.stack([tokens, np.ones_like(tokens), loss], axis=1).astype(np.float64)
    begin = np.zeros(len(tokens), dtype=np.int64)
    order = np.argsort(-tokens, kind="stable")
    left, size, begin = left[order], size[order], begin[order]
    limit = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
    alive = np.ones(len(left), dtype=bool)
    n_alive, bins = len(left), []
    while n_alive:
        if len(alive) > 64 and 2 * n_alive < len(alive):
            left, size, begin, alive = left[alive], size[alive], begin[alive], np.ones(n_alive, dtype=bool)
        room, members = limit.copy(), []
        while n_alive:
            value = size @ (room * scale * scale)
            fits = alive & (size <= room).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, value, -1.0)))
                members.append((int(left[i]), int(begin[i]), int(size[i, 0])))
                room -= size[i]
                alive[i] = False
                n_alive -= 1
                continue
            part = int(room[0])
            if not can_cut or part < limits.least_piece or room[1] < 1:
                break
            cut_loss = np.ceil(size[:, 2] * part / np.maximum(size[:, 0], 1))
            ok = alive & (size[:, 0] - part >= limits.least_piece) & (cut_loss <= room[2])
            if not ok.any():
                break
            i = int(np.argmax(np.where(ok, value, -1.0)))
            members.append((int(left[i]), int(begin[i]), part))
            begin[i] += part
            size[i, 2] -= cut_loss[i]
            size[i, 0] -= part
            break
        bins.append(members)
    return bins


def _pack_block(docs: list[tuple], pieces: list[Piece], limits: Limits, can_cut: bool, first_sequence: int) -> tuple[dict, int]:
    """docs: (key values, ids as bytes).  Returns the columns of the placed pieces and the number of bins."""
    out: dict[str, list] = {"key": [], "start": [], "length": [], "loss_tokens": [], "doc_tokens": [], "ids": [], "sequence_id": [], "offset": []}
    tokens = np.array([p.length for p in pieces], dtype=np.int64)
    loss = np.array([p.loss for p in pieces], dtype=np.int64)
    bins = pack_vectors(tokens, loss, limits, can_cut)
    for n, members in enumerate(bins):
        offset = 0
        for i, begin, length in members:
            p = pieces[i]
            key, ids = docs[p.doc]
            start = p.start + begin
            whole = length == p.length
            out["key"].append(key)
            out["start"].append(start)
            out["length"].append(length)
            out["loss_tokens"].append(p.loss if whole else min(p.loss, -(-p.loss * length // p.length)))
            out["doc_tokens"].append(len(ids) // ID_BYTES)
            out["ids"].append(ids[start * ID_BYTES : (start + length) * ID_BYTES])
            out["sequence_id"].append(first_sequence + n)
            out["offset"].append(offset)
            offset += length
    return out, len(bins)


def packed(df: DataFrame, key: str, limits: Limits, tokenize, can_cut: bool, text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """Pack the rows of ``df``; ``tokenize(row values)`` gives (ids as bytes, loss-bearing tokens).

    Rows longer than a bin are cut at multiples of what a bin can hold (also where
    ``can_cut`` is false: a cut is then the only way to keep them whole).
    """
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, start long, length long, loss_tokens long, doc_tokens long, ids binary, sequence_id long, offset long"

    fields = [pa.field(name, kind) for name, kind in ((key, pa.null()), ("start", pa.int64()), ("length", pa.int64()), ("loss_tokens", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_kind = pa.null()
        sequence = TaskContext.get().partitionId() * PARTITION_STRIDE
        docs: list[tuple] = []
        pieces: list[Piece] = []
        held = 0

        def flush():
            nonlocal docs, pieces, held, sequence
            if pieces:
                out, n = _pack_block(docs, pieces, limits, can_cut, sequence)
                sequence += n
                out[key] = pa.array(out.pop("key"), key_kind)
                whole = pa.table({f.name: out[f.name] if f.name == key else pa.array(out[f.name], f.type) for f in fields})
                yield from whole.to_batches(max_chunksize=2000)
            docs, pieces, held = [], [], 0

        for batch in batches:
            key_kind = batch.schema.field(0).type
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, n_loss = tokenize(*row)
                n = len(ids) // ID_BYTES
                if not n:
                    continue
                docs.append((k, ids))
                step = limits.tokens
                if n_loss > 0:
                    step = max(1, min(step, limits.loss_tokens * n // n_loss))
                for at in range(0, n, step):
                    length = min(step, n - at)
                    pieces.append(Piece(len(docs) - 1, at, length, min(length, limits.loss_tokens, -(-n_loss * length // n))))
                    held += length
                    if len(pieces) >= limits.block_pieces or held >= limits.block_ids:
                        last = docs[-1]
                        yield from flush()
                        docs.append(last)
        yield from flush()

    return arrow_map(df.select(key, text, *extra), run, schema)


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end_id: int = 1, limits: Limits = Limits()) -> DataFrame:
    """Tokenize whole texts, append ``end_id`` and pack all ids into sequences.

    Every id of a document is loss-bearing but the first of it, which nothing predicts.
    Result, per piece: the key, start, length, loss_tokens, doc_tokens, ids (little-endian
    uint32), sequence_id, offset.  A null or empty text is its end id alone.  Null keys,
    repeated rows and other columns are taken as they come (other columns are not returned);
    an empty table gives no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], dtype="<u4").tobytes()

    def tokenize(value):
        ids = encoder(vocabulary).encode(value) + end
        return ids, len(ids) // ID_BYTES - 1

    return packed(df, key, limits, tokenize, can_cut=True, text=text)


def pack_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", vocabulary: str | None = None, end_id: int = 1, loss_roles: tuple[str, ...] = ("assistant",), limits: Limits = Limits()) -> DataFrame:
    """Pack instruction data: a conversation's turns in order make one example.

    Tokens of the turns of ``loss_roles``, with their end ids, are loss-bearing.  Examples
    are not cut unless they exceed a sequence.  Null turns come first, null texts are empty;
    turns alike in number are ordered by role and text.  One conversation is one example and
    so is gathered into one row; its size is that of one training example.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], dtype="<u4").tobytes()
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    grouped = df.groupBy(F.col(conv).alias(conv)).agg(turns.alias("turns_"))
    grouped = grouped.select(conv, F.col("turns_.role").alias("roles_"), F.col("turns_.text").alias("texts_"))

    def tokenize(texts, roles):
        enc, ids, n_loss = encoder(vocabulary), [], 0
        for one, who in zip(texts, roles, strict=True):
            part = enc.encode(one) + end
            ids.append(part)
            n_loss += len(part) // ID_BYTES if who in loss_roles else 0
        return b"".join(ids), n_loss

    return packed(grouped, conv, limits, tokenize, can_cut=False, text="texts_", extra=("roles_",))


def piece_ids(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, dtype="<u4")
