"""Best-fit-decreasing packing of token ids into rows of one length.

Documents are cut losslessly into pieces of at most the row length. A task holds pieces up
to a bound of tokens, then packs them, longest first, each into the row with the least
room that is enough; a segment tree over the possible rooms finds it. What the bound holds
becomes one id matrix, so no shuffle is needed and a lost task is simply run again.

A row carries its ids as little-endian binary (two bytes each, or four for larger
vocabularies), the cumulative lengths of its segments, the places where positions start
again from zero, and for each segment the document and the place of its first token there.

Defined results: null or empty id lists make no segment; null document ids are carried as
null; repeated rows are packed as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

LENGTH, HELD_TOKENS = 2048, 1 << 20


class Rooms:
    """A segment tree over rooms 0..most with the number of open rows of each."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def change(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def least_from(self, room: int) -> int:
        """The least room of an open row that is at least ``room``, or -1."""
        count, at = self.count, room + self.size
        if count[at]:
            return room
        while at > 1:
            # Up to the first right-hand neighbour that holds a row, then down to its left.
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; every piece is in one row, no row is over ``length``."""
    rooms, rows = Rooms(length), []
    open_rows: list[list[int]] = [[] for _ in range(length + 1)]
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = rooms.least_from(sizes[piece])
        if room < 0:
            row, room = len(rows), length
            rows.append([])
        else:
            row = open_rows[room].pop()
            rooms.change(room, -1)
        rows[row].append(piece)
        if left := room - sizes[piece]:
            open_rows[left].append(row)
            rooms.change(left, 1)
    return rows


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


_PACKED = pa.schema([
    ("matrix", pa.int64()), ("row", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
])
_DDL = ("matrix long, row int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
        "doc_ids array<long>, starts array<long>")


def _matrix(number: int, held: list[tuple], length: int, kind: str, pad: int) -> pa.RecordBatch:
    """The rows that best fit makes of (document, first token, ids) pieces."""
    columns: list[list] = [[] for _ in _PACKED]
    for row, pieces in enumerate(best_fit([len(p[2]) for p in held], length)):
        parts = [held[i] for i in pieces]
        ends = np.cumsum([0] + [len(p[2]) for p in parts])
        ids = np.full(length, pad, kind)
        ids[:ends[-1]] = np.concatenate([p[2] for p in parts])
        values = (number, row, ids.tobytes(), ends.tolist(), ends[:-1].tolist(), [p[0] for p in parts], [p[1] for p in parts])
        for column, value in zip(columns, values):
            column.append(value)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


def packed(
    docs: DataFrame, vocabulary: int, pad: int, length: int = LENGTH, ids: str = "ids", doc_id: str = "doc_id",
    held_tokens: int = HELD_TOKENS,
) -> DataFrame:
    """Rows of ``length`` ids: ``matrix``, ``row``, ``ids``, ``cu_seqlens``,
    ``position_resets``, ``doc_ids`` and ``starts``."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        tokens = 0
        for batch in batches:
            for doc, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                if row.values is None:
                    continue
                values = row.values.to_numpy(zero_copy_only=False).astype(kind)
                for begin in range(0, len(values), length):
                    held.append((doc, begin, values[begin:begin + length]))
                    tokens += len(held[-1][2])
                    if tokens >= held_tokens:
                        yield _matrix(number, held, length, kind, pad)
                        number, held, tokens = number + 1, [], 0
        if held:
            yield _matrix(number, held, length, kind, pad)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{ids}`").alias("i")).mapInArrow(run, _DDL)


def unpacked(rows: DataFrame, vocabulary: int) -> DataFrame:
    """The segments of ``packed`` rows: ``doc_id``, ``start`` and ``ids``."""
    kind = id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for data, ends, docs, starts in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(data, kind)
                out += [(d, s, ids[x:y].tolist()) for d, s, x, y in zip(docs, starts, ends, ends[1:])]
            doc, start, ids = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                ["doc_id", "start", "ids"])

    return rows.select("ids", "cu_seqlens", "doc_ids", "starts").mapInArrow(run, "doc_id long, start long, ids array<int>")
