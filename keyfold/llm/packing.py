"""Best-fit packing of token sequences with bounded space.

Each partition packs its own documents.  A fixed number of bins is open; which free spaces
occur among them is a bitset, so the fitting bin with the least room is one shift and one
lowest bit away.  With all bins open and none fitting, the fullest closes.  Pieces are placed
as they come; none is held back or placed anew.  Nothing is shuffled, and what a lost executor
had packed is packed again in the same way from the same input split.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._tables import texts
from ._text import lean
from .tokens import encoder, groups

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Bins:
    """Open bins, found by free space."""

    def __init__(self, capacity: int, most_open: int, first_id: int):
        self.capacity, self.most_open, self.next_id = capacity, most_open, first_id
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0

    def new(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) for a piece no longer than the capacity."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self.by_free[free].pop()
            if not self.by_free[free]:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            if self.open >= self.most_open:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.bits ^= 1 << fullest
                self.open -= 1
            free, at = self.capacity, self.new()
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - free


def pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full ones after a first remainder."""
    if total <= capacity:
        return [(0, total)]
    head = total % capacity or capacity
    return [(0, head), *((a, capacity) for a in range(head, total, capacity))]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, most_open: int = 1024, batch_rows: int = 8192) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone.  A null doc_id is kept as null; repeated rows
    are packed each.  Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        coder, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        bins = Bins(capacity, most_open, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows)) if rows else [[]] * 7
            rows.clear()
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, part in groups(batch.column(1)):
                for k, raw in enumerate(coder.encode(part)):
                    raw += end
                    for n, (a, size) in enumerate(pieces(len(raw) // 4, capacity)):
                        at = (bins.new(), 0) if size == capacity else bins.place(size)
                        rows.append((ids[first + k], n, a, size, zlib.crc32(raw[4 * a : 4 * (a + size)]), *at))
                    if len(rows) >= batch_rows:
                        yield flush()
        yield flush()

    return texts(docs).mapInArrow(lean(run), SCHEMA)
