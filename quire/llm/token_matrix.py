"""Token ids as packed binary matrices.

Texts become ids with an end token; longer ones than a row are cut into pieces without loss. The task that reads them
packs its pieces, so many at once as its memory may hold, best fit, longest first; the tightest row with enough room is found in a segment tree over the rooms. A row of the
matrix has its ids in a fixed width, the cumulative lengths of its segments, and positions that start anew with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches
from quire.llm.packing import LIMIT, piece_rows

#: Tokens and pieces that are packed at once.
AT_ONCE, PIECES_AT_ONCE = 1 << 23, 1 << 17
SCHEMA = "sequence_id long, n_tokens int, doc_ids array<long>, pieces array<int>, starts array<long>, cu_seqlens array<int>, resets array<int>, ids binary"


class RoomTree:
    """How many open rows have each room, in a segment tree; finds the smallest room that is at least so much."""

    def __init__(self, limit: int):
        self.leaves = 1 << (limit + 1).bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.counts[at] += n
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of a tightest row, which is no longer open."""
        at = least + self.leaves
        while not self.counts[at]:  # up, to the first subtree on the right that has any
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            if at & (at - 1) == 0:
                return None
        while at < self.leaves:
            at = 2 * at if self.counts[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: list[int], limit: int) -> list[list[int]]:
    """Rows of the pieces' numbers."""
    rows: list[list[int]] = []
    tree = RoomTree(limit)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room, row = tree.take(lengths[i]) or (limit, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        tree.put(room - lengths[i], row)
    return rows


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position ids of a row: 0, 1, ... anew from each reset."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))


def token_matrix(docs: DataFrame, path: str, limit: int = LIMIT, width: int = 2, end: int = 1) -> DataFrame:
    """Rows of the packed matrix: sequence_id, n_tokens, the segments' doc_ids, pieces and starts in their documents, cu_seqlens (from 0 to n_tokens), resets (where positions start anew) and ids (little-endian unsigned integers of ``width`` bytes).

    Every token of every text is in one row, so the texts' ids can be put together again. Null and empty texts have the
    end token alone. Null and repeated doc_ids are packed like others; an empty table gives an empty result. Ids that
    ``width`` bytes don't hold are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, kind, held, tokens, number = TaskContext.get().partitionId() << 32, {2: "<u2", 4: "<u4"}[width], [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal number
            held.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            packed = best_fit_decreasing([r[3] for r in held], limit)
            for at in range(0, len(packed), 500):
                built = []
                for row in packed[at : at + 500]:
                    mine = [held[i] for i in sorted(row)]
                    ids = np.frombuffer(b"".join([r[5] for r in mine]), "<u4")
                    if len(ids) and int(ids.max()) >> (8 * width):
                        raise ValueError(f"ids don't fit {width} bytes")
                    ends = np.cumsum([0, *(r[3] for r in mine)]).tolist()
                    built.append((base + number, ends[-1], *([r[k] for r in mine] for k in range(3)), ends, ends[:-1], ids.astype(kind).tobytes()))
                    number += 1
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*built, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for rows in piece_rows(path, limit, end)(batches):
            held += rows
            tokens += sum([r[3] for r in rows])
            if tokens >= AT_ONCE or len(held) >= PIECES_AT_ONCE:
                yield from out()
                held, tokens = [], 0
        yield from out()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
