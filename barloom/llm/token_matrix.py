"""Packed token matrices: best-fit decreasing with a segment tree over capacities.

Documents are tokenised, cut losslessly into pieces of at most ``width`` ids, and packed as they are read:
a task fills a buffer of ``BUFFER`` pieces, packs it by falling length, each piece into the open row with
the least room that suffices, emits the rows that are full enough and takes the pieces of the others into
the next buffer. The least sufficient room is found in a segment tree that counts the open rows by room.

A row of the result is a row of the matrix: ids padded with ``PAD`` to ``width``, cumulative segment lengths,
positions that restart at 0 with each segment, and where each segment comes from: doc_id, piece, start, and a
number of the document's row (task, row), by which ``restore`` gives back every row's ids.

How it scales: one map over documents; nothing is shuffled, and a task holds one buffer, whatever the
partition's size. A task repeated after a loss reads the same rows and gives the same result.

Null texts count as empty: one id, ``tokens.END``. Repeated rows are packed as often as they occur.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import tokens as T
from barloom.llm.ship import by_value

by_value(__name__)

WIDTH = 2048
BUFFER = 4096
FULL = 0.99
PAD = 0

SCHEMA = (
    "sequence_id long, n_tokens int, ids array<int>, cu_seqlens array<int>, position_ids array<int>, "
    "doc_ids array<bigint>, pieces array<int>, starts array<bigint>, rows array<bigint>"
)


class Rooms:
    """Open rows by room, in a segment tree of counts: the least room that suffices in log steps."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int):
        """The (room, row) with the least room of at least ``size``; None if there is none."""
        node = size + self.leaves
        if not self.count[node]:
            # up to the first right neighbour that is not empty, then down its left side
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    rooms, rows = Rooms(width), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[item])
        room, row = found or (width, len(rows))
        if not found:
            rows.append([])
        rows[row].append(item)
        if room > lengths[item]:
            rooms.put(room - lengths[item], row)
    return rows


def matrix_row(number: int, held, width: int):
    ids = np.full(width, PAD, np.int32)
    positions = np.zeros(width, np.int32)
    at, edges = 0, [0]
    for *_, piece in held:
        ids[at : at + len(piece)] = piece
        positions[at : at + len(piece)] = np.arange(len(piece))
        at += len(piece)
        edges.append(at)
    return number, at, ids, edges, positions, *([h[k] for h in held] for k in range(4))


def matrices_of(vocabulary: str, width: int, buffer: int, full: float):
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        encode, partition = T.Encoder(vocabulary), TaskContext.get().partitionId()
        number, row, held = partition << 40, partition << 40, []

        def packed(last: bool):
            nonlocal number, held
            rows = [[held[i] for i in row] for row in best_fit_decreasing([len(h[-1]) for h in held], width)]
            ready = [r for r in rows if last or sum(len(h[-1]) for h in r) >= full * width]
            if not last and len(ready) < len(rows) // 2:  # pieces that fill no row must not pile up
                ready = rows
            out = {id(r) for r in ready}
            held = [h for r in rows if id(r) not in out for h in r]
            for at in range(0, len(ready), 256):
                lines = [matrix_row(number + at + k, r, width) for k, r in enumerate(ready[at : at + 256])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines), kinds)], names)
            number += len(ready)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(text)
                row += 1
                held += [(doc_id, n, start, row, ids[start : start + length]) for n, (start, length) in enumerate(T.cut(len(ids), width))]
                if len(held) >= buffer:
                    yield from packed(last=False)
        if held:
            yield from packed(last=True)

    return run


def token_matrix(docs: DataFrame, width: int = WIDTH, vocabulary: str = T.VOCABULARY, buffer: int = BUFFER, full: float = FULL) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(matrices_of(vocabulary, width, buffer, full), SCHEMA)


def write_matrix(docs: DataFrame, path: str, **options) -> None:
    """The matrix as Parquet files, a partition each."""
    token_matrix(docs, **options).write.parquet(path)


def restore(matrix: DataFrame) -> DataFrame:
    """(doc_id, ids): the ids of every document row again, without the END; rows that share an id come out apart."""
    pieces = matrix.select("ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "pieces", "rows")).alias("k", "p")).select(
        F.col("p.rows").alias("row"), F.col("p.doc_ids").alias("doc_id"), F.col("p.pieces").alias("piece"),
        F.slice("ids", F.col("cu_seqlens")[F.col("k")] + 1, F.col("cu_seqlens")[F.col("k") + 1] - F.col("cu_seqlens")[F.col("k")]).alias("part"),
    )
    whole = pieces.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["part"]))
    return whole.select("doc_id", ids.alias("ids")).select("doc_id", F.slice("ids", F.lit(1), F.size("ids") - 1).alias("ids"))
