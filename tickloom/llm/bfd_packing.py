"""Best-fit-decreasing packing of token ids into fixed-length rows.

Every worker packs the documents of its partition in windows: fragments go longest first into the row
with the least room that still holds them, which a segment tree over capacities finds. Overlong
documents are split without loss. A row comes out as one line of the packed id matrix, with cumulative
segment lengths and the positions that restart with each segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tokens import slices, word_encoder

PACKED = "doc_ids array<bigint>, starts array<bigint>, cu_seqlens array<int>, n_tokens int, ids_le binary, positions_le binary"


class RoomTree:
    """Which amounts of room occur among open rows: leaf c counts the rows with c tokens free."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int = 1) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int | None:
        """The smallest room of at least ``need``."""
        at = need + self.leaves
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each at most ``capacity``), longest first, equal lengths in order."""
    tree, rows, by_room = RoomTree(capacity), [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[i])
        if room is None:
            rows.append([])
            at, room = len(rows) - 1, capacity
        else:
            at = by_room[room].pop()
            tree.add(room, -1)
        rows[at].append(i)
        if left := room - lengths[i]:
            by_room.setdefault(left, []).append(at)
            tree.add(left)
    return rows


def _pack(path: str, end_id: int, capacity: int, pad_id: int, window: int):
    end = np.asarray([end_id], "<u4").tobytes()
    pad = np.asarray([pad_id], "<u4").tobytes()
    ramp = np.arange(capacity, dtype="<u4").tobytes()

    def emit(parts: list[tuple]) -> pa.RecordBatch:
        out = []
        for row in best_fit([len(p[2]) // 4 for p in parts], capacity):
            lengths = [len(parts[i][2]) // 4 for i in row]
            n = sum(lengths)
            positions = b"".join([ramp[: 4 * x] for x in lengths]) + bytes(4 * (capacity - n))
            ids = b"".join([parts[i][2] for i in row]) + pad * (capacity - n)
            out.append(([parts[i][0] for i in row], [parts[i][1] for i in row], [0, *accumulate(lengths)], n, ids, positions))
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_ids", "starts", "cu_seqlens", "n_tokens", "ids_le", "positions_le"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, parts, held = word_encoder(path), [], 0
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, texts in slices(b.column(1)):
                for id_, tokens in zip(ids[at:], encoder.encode(texts)):
                    tokens += end
                    parts += [(id_, i // 4, tokens[i : i + 4 * capacity]) for i in range(0, len(tokens), 4 * capacity)]
                    held += len(tokens) // 4
                    if held >= window:
                        yield emit(parts)
                        parts, held = [], 0
        if parts:
            yield emit(parts)

    return run


def bfd_packing(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, pad_id: int = 0, capacity: int = 2048, window: int = 2 << 20) -> DataFrame:
    """Packed rows: ``sequence_id``, the segments' ``doc_ids`` and ``starts`` in their documents,
    ``cu_seqlens``, ``n_tokens`` before padding, ``ids_le`` (``capacity`` little-endian unsigned 32-bit ids)
    and ``positions_le`` (likewise, from 0 in every segment; 0 in the padding).

    Ids are those of the whole text followed by ``end_id``; null is the empty text. A worker packs
    ``window`` tokens at a time, so memory does not grow with the partition. Rows that repeat and null
    ids are packed like others; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col))
    return rows.mapInArrow(_pack(vocabulary, end_id, capacity, pad_id, window), PACKED).select(F.monotonically_increasing_id().alias("sequence_id"), "*")


def write_matrix(packed: DataFrame, path: str) -> None:
    """One Parquet line per packed row: fixed-width id and position lines with their segment boundaries."""
    packed.write.mode("error").option("compression", "zstd").parquet(path)
