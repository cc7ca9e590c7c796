"""Exact de-duplication with a cuckoo-filter index of live digests.

The index is split by digest over the shuffle partitions. Each part holds a cuckoo filter (16-bit fingerprints, four
slots a bucket) and, bucketed by the digest's first 64 bits, the content that the filter stands for: whole SHA-256
digests with the row that stays and the group's size. A filter hit counts only if the bucketed content confirms it.
A full filter is doubled and refilled from the stored keys.

Equal rows of one task meet before the shuffle, so a text that a third of all rows share sends one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, partitions, released, spread_join, text_or_empty, written

SLOTS, KICKS, FULL = 4, 200, 0.9
#: Rows that a part of the index is for, at most on the mean; its entries lie in one worker's memory.
PART = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class CuckooFilter:
    """Partial-key cuckoo hashing over unsigned 64-bit keys; insert, contains and delete take arrays."""

    def __init__(self, capacity: int = 1024, seed: int = 7):
        n = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * FULL)))))
        self.table, self.size = np.zeros((n, SLOTS), np.uint16), 0
        self.random = np.random.default_rng(seed)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        marks = ((keys >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        first = (keys * MIX >> np.uint64(20)) & mask
        return marks, first, first ^ self._step(marks)

    def _step(self, marks: np.ndarray) -> np.ndarray:
        return (marks.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        marks, first, second = self._places(keys)
        return (self.table[first] == marks[:, None]).any(1) | (self.table[second] == marks[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter overflowed; it must then be made anew, larger."""
        marks, *places = self._places(keys)
        left = np.arange(len(keys))
        for place in (*places, *places):  # all at once where the buckets have room, one key a bucket and turn
            while len(left):
                _, one = np.unique(place[left], return_index=True)
                rows, slot = place[left[one]], (self.table[place[left[one]]] == 0)
                fits = slot.any(1)
                if not fits.any():
                    break
                self.table[rows[fits], slot[fits].argmax(1)] = marks[left[one[fits]]]
                self.size += int(fits.sum())
                left = np.delete(left, one[fits])
        return all(self._push(int(marks[i]), int(places[i & 1][i])) for i in left.tolist())

    def _push(self, mark: int, at: int) -> bool:
        for _ in range(KICKS):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                self.size += 1
                return True
            slot = int(self.random.integers(SLOTS))
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= (mark * 0x5BD1E995) & (len(self.table) - 1)
        return False

    def delete(self, key: int) -> bool:
        """Takes one copy of the key's mark out; only keys that are in may be deleted."""
        marks, *places = self._places(np.array([key], np.uint64))
        for at in (int(places[0][0]), int(places[1][0])):
            found = np.flatnonzero(self.table[at] == marks[0])
            if len(found):
                self.table[at, found[0]] = 0
                self.size -= 1
                return True
        return False


class DigestIndex:
    """Live digests: the filter in front, the bucketed content behind it."""

    def __init__(self, capacity: int = 1024):
        self.filter = CuckooFilter(capacity)
        self.content: dict[int, list[list]] = {}  # by key: [digest, id that stays, rows]
        self.resizes = 0

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[:8], "big")

    def __len__(self) -> int:
        return sum(map(len, self.content.values()))

    def find(self, digest: bytes) -> list | None:
        """The live entry, or None; a hit of the filter is verified against the content."""
        key = self.key(digest)
        if not self.filter.contains(np.array([key], np.uint64))[0]:
            return None
        return next((x for x in self.content.get(key, ()) if x[0] == digest), None)

    def _grow(self) -> None:
        keys = np.array([k for k, rows in self.content.items() for _ in rows], np.uint64)
        capacity = 2 * max(len(self.filter.table) * SLOTS, len(keys))
        while True:
            self.filter = CuckooFilter(capacity)
            self.resizes += 1
            if self.filter.insert(keys):
                return
            capacity *= 2

    def insert(self, entries: list[tuple[bytes, int | None, int]]) -> None:
        """Adds (digest, id, rows); of an entry that is there already, the larger id stays and the rows add up."""
        keys = np.array([self.key(d) for d, _, _ in entries], np.uint64)
        seen, fresh = self.filter.contains(keys), []
        batch: dict[bytes, list] = {}
        for key, hit, (digest, one, rows) in zip(keys.tolist(), seen.tolist(), entries, strict=True):
            entry = batch.get(digest) or (next((x for x in self.content.get(key, ()) if x[0] == digest), None) if hit else None)
            if entry is None:
                batch[digest] = entry = [digest, one, rows]
                self.content.setdefault(key, []).append(entry)
                fresh.append(key)
            else:
                entry[1] = max((x for x in (entry[1], one) if x is not None), default=None)
                entry[2] += rows
        if fresh and not self.filter.insert(np.array(fresh, np.uint64)):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Takes a digest out, as when its last row is withdrawn; False if it isn't live."""
        entry, key = self.find(digest), self.key(digest)
        if entry is None:
            return False
        self.content[key].remove(entry)
        if not self.content[key]:
            del self.content[key]
        return self.filter.delete(key)

    def entries(self) -> Iterator[list]:
        for rows in self.content.values():
            yield from rows


SCHEMA = "digest string, keep_id long, group_size long"


@released
def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest in hex, id, rows) -> the live entries of this part of the index."""
    index = DigestIndex()
    for batch in batches:
        digests, ids, rows = (c.to_pylist() for c in batch.columns)
        index.insert([(bytes.fromhex(d), i, n) for d, i, n in zip(digests, ids, rows, strict=True)])
    live = list(index.entries())
    for at in range(0, len(live), 20_000):
        part = live[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([x[0].hex() for x in part], pa.string()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.int64())], ["digest", "keep_id", "group_size"])


@released
def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal digests of one task become one row."""
    met: dict[str, list] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(met), pa.string()), pa.array([x[0] for x in met.values()], pa.int64()), pa.array([x[1] for x in met.values()], pa.int64())], ["digest", "keep_id", "group_size"])

    for batch in batches:
        for digest, one in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            entry = met.get(digest)
            if entry is None:
                met[digest] = [one, 1]
            else:
                entry[0] = max((x for x in (entry[0], one) if x is not None), default=None)
                entry[1] += 1
        if len(met) > 200_000:
            yield out()
            met = {}
    if met:
        yield out()


def text_digest() -> Column:
    return F.sha2(ascii_lower(text_or_empty()).cast("binary"), 256)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256, in hex, of the text in UTF-8 with A-Z lower-cased; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"))


def live_index(found: DataFrame, rows: int | None = None) -> DataFrame:
    """(digest, keep_id, group_size), one row for each distinct digest of (doc_id, digest), of which there are ``rows``."""
    met = found.select("digest", "doc_id").mapInArrow(_met, SCHEMA)
    parts = max(partitions(found.sparkSession), -(-(found.count() if rows is None else rows) // PART))
    return met.repartition(parts, "digest").mapInArrow(_indexed, SCHEMA)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal when they are after lower-casing A-Z. Null texts and empty ones are equal. Of a group, the largest
    doc_id stays; a null doc_id is smaller than any. Rows that repeat a doc_id and its text are kept or dropped
    together. An empty table gives an empty result, and other columns of ``docs`` are not looked at.
    """
    found = digests(docs)
    rows = docs.count()
    index = written(live_index(found, rows), "digests")
    groups = index.select(F.col("digest").alias("of"), "keep_id", "group_size", F.col("group_size").alias("rows"))
    joined = spread_join(found, "digest", groups, "of", "rows", rows)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
