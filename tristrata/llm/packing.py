"""Cost-balanced packing of token sequences.

A sequence of a transformer costs a linear part (its tokens) and a quadratic part (attention within each piece).
Every document is cut into pieces of a full sequence and one shorter rest; a full piece is a sequence of its own. The
rests are collected in blocks of a bounded number of pieces. A block with ``t`` tokens gets ``ceil(t / capacity)``
sequences; its rests are taken from the longest down, each goes to the sequence of lowest cost that still has room,
and a rest too long for that room is cut there, its other part waiting for its turn by length. So only the last
sequence of a block can have room left over, and no step sees more than one block.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tristrata.llm.common import batch, bounded_batches, text_or_empty
from tristrata.llm.tokens import encoder

#: Rests packed together. A block leaves at most one sequence with room, so larger blocks pad less.
BLOCK_PIECES = 8192

PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())),
])
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Pieces as (rest, start in the rest, length, sequence), of rests no longer than ``capacity``, in order of sequences."""
    total = sum(lengths)
    room = [capacity] * -(-total // capacity)
    if total % capacity:
        room[-1] = total % capacity
    open_sequences = [(0.0, s) for s in range(len(room))]
    waiting = [(-n, rest, 0) for rest, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    pieces = []
    while waiting:
        n, rest, start = heapq.heappop(waiting)
        cost, sequence = heapq.heappop(open_sequences)
        length = min(-n, room[sequence])
        pieces.append((rest, start, length, sequence))
        room[sequence] -= length
        if room[sequence]:
            heapq.heappush(open_sequences, (cost + linear * length + quadratic * length * length, sequence))
        if length < -n:
            heapq.heappush(waiting, (n + length, rest, start + length))
    return sorted(pieces, key=lambda p: p[3])


def _packer(path: str, capacity: int, end_id: int | None, linear: float, quadratic: float, with_ids: bool, block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        next_sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        out: list[tuple] = []
        rests: list[tuple] = []

        def put(doc, start, ids, tokens, sequence, offset):
            out.append((doc, start, len(ids), crc32(ids), tokens, sequence, offset, ids.tolist() if with_ids else None))

        def pack_rests() -> int:
            places = assign([len(r[2]) for r in rests], capacity, linear, quadratic)
            offset = last = 0
            for rest, start, length, sequence in places:
                doc, at, ids, tokens = rests[rest]
                offset = offset if sequence == last else 0
                put(doc, at + start, ids[start:start + length], tokens, next_sequence + sequence, offset)
                last, offset = sequence, offset + length
            rests.clear()
            return places[-1][3] + 1 if places else 0

        for rows in batches:
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                ids = encode(text)
                if end_id is not None:
                    ids = np.append(ids, np.array([end_id], ids.dtype))
                n = len(ids)
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    put(doc, start, ids[start:start + capacity], n, next_sequence, 0)
                    next_sequence += 1
                if whole < n:
                    rests.append((doc, whole, ids[whole:].copy(), n))
                if len(rests) >= block:
                    next_sequence += pack_rests()
                if len(out) >= 2000:
                    yield batch(PIECES, *zip(*out))
                    out.clear()
        next_sequence += pack_rests()
        for i in range(0, len(out), 2000):
            yield batch(PIECES, *zip(*out[i:i + 2000]))
    return pack


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int | None = 0, linear: float = 1.0,
    quadratic: float = 1 / 1024, with_ids: bool = True, block: int = BLOCK_PIECES, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per piece: document, its place in the document, its sequence and its offset there, and its ids.

    Sequences hold at most ``capacity`` tokens; ``end_id`` follows the ids of each document. Nothing is shuffled:
    every task packs the documents it reads, so the sequences depend on how the input is split, while ids and pieces
    cover every document exactly once. Sequence ids are unique, not dense.

    A null text is an empty one and gives the end id alone (nothing without ``end_id``). A null id stays null. Rows
    with equal ids are documents of their own. Texts of any length are cut into pieces. Empty tables give empty
    results. Other columns of ``docs`` are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(_packer(tokenizer, capacity, end_id, linear, quadratic, with_ids, block), SCHEMA)


def padding(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: tokens, sequences, and padding tokens when every sequence is filled up to ``capacity``, except those
    whose length is a power of two, which keep it."""
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return filled.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("sequences"),
        F.coalesce(F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))), F.lit(0)).alias("padding"),
    )
