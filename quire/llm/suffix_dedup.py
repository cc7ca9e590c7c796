"""Removal of repeated byte strings by distributed prefix doubling.

Positions get ranks for strings of 8, 16, 32 and 64 bytes: eight bytes are a number, and the rank of a string of 2h bytes
is a mix of the ranks of its halves, so equal strings have equal ranks in every task, and no table of ranks is needed
(naming after Karp, Miller and Rosenberg). (Rank, position) pairs are dealt out by rank over the tasks and sorted there, at growing lengths; after each
sort, positions whose rank is unique are done, and the others go on to the next length, until the threshold.

- 32 bytes: one position stands for all windows of the threshold's length that have it as their least rank. Equal
  windows choose the same position, so windows with a unique choice are unique; about one position in 35 is sorted.
- Runs: the windows that chose one position. Of equal runs (same bytes from the first window's start to the last one's end) the
  first stays, and every window of the others repeats an earlier one. Runs whose 32 bytes have other runs go on.
- 93 bytes: what eight neighbouring windows have in common, sorted in the same way.
- 100 bytes: single windows.

Pairs travel in blocks, one for each task and part of the ranks. What one task has found repeated is settled there,
and it sends at most two witnesses of a rank, so that a string in a third of all texts loads no single task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.llm.common import discard, partitions, released, small_batches, written

#: The threshold in bytes; the length of the first sort; of a window's choices; windows that share what the third sort takes.
LENGTH, GRAM, EIGHT = 100, 32, 8
WINDOW = LENGTH - GRAM + 1
HALF = 64
#: Bytes of a long text that are treated at once, and bytes of texts; ranks of so many stay in a core's cache.
SLICE, AT_ONCE = 1 << 17, 1 << 17
#: Pairs that a task gathers before it sends them.
GATHERED = 1 << 20
#: Documents in a block and their bytes, on the mean at most, and documents whose pairs make a part of the ranks, at least.
BLOCK, BLOCK_BYTES, PART = 256, 1 << 20, 500

U = np.uint64
A, B, C, D = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93)
PLACE = U((1 << 31) - 1)

CANDIDATE, WITNESS, REPEATED, SETTLED = range(4)
MESSAGE = "bucket int, kind int, rows int, block binary"
#: What a pair carries: the rank that makes rows meet; the name of all its bytes; document, row of equal ids, first window, windows, and where in it the chosen position is.
PAIR = np.dtype([("core", "<u8"), ("one", "<u8"), ("two", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("pos", "<u4"), ("n", "<u4"), ("off", "<u4"), ("block", "<u4")])
#: What a settled row carries: windows that repeat earlier ones.
DONE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("pos", "<u4"), ("n", "<u4"), ("block", "<u4")])
SHORT = np.dtype([("core", "<u8"), ("doc", "<i8"), ("pos", "<u4"), ("block", "<u4")])
NO_ID = -(1 << 63)
#: Bits of the map of documents that a step is about: eight a document, but within these bounds (0.5 and 32 MB). A map that is too full lets documents through that the step has nothing for.
FEWEST_BITS, MOST_BITS = 1 << 22, 1 << 28


def mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> U(29)
    x *= C
    x ^= x >> U(32)
    return x


def doubled(rank: np.ndarray, h: int) -> np.ndarray:
    """Ranks of 2h bytes from those of h bytes; the last h have none."""
    return mixed(rank[:-h] * A + rank[h:] * B) if len(rank) > h else rank[:0]


def ranked(data: np.ndarray, upto: int = HALF) -> list[np.ndarray]:
    """Ranks of 8, 16, ... and ``upto`` bytes at each position."""
    n = len(data) - 7
    if n <= 0:
        return [np.zeros(0, U)] * (upto.bit_length() - 3)
    ranks, h = [mixed(np.ndarray(n, "<u8", data, strides=(1,)) * D)], 8
    while h < upto:
        ranks.append(doubled(ranks[-1], h))
        h *= 2
    return ranks


def ranks_of_gram(data: np.ndarray) -> np.ndarray:
    return ranked(data, GRAM)[-1]


def named(rank: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of data[start:end], of 64 to 192 bytes each: from the ranks of 64 bytes that cover it."""
    first, middle, last = rank[start], rank[start + (end - start - HALF) // 2], rank[end - HALF]
    n = (end - start).astype(np.uint64)
    return mixed(first * A + middle * B + last * D + n), mixed(first * D + middle * A + last * C + n * B)


class Texts:
    """Texts end to end; long ones in slices that overlap, so that every window is in one slice whole."""

    def __init__(self, texts: list[bytes]):
        parts, self.first, self.owner, self.base, starts, at = [], [], [], [], [], 0
        for k, text in enumerate(texts):
            self.first.append(len(starts))
            for base in range(0, max(1, len(text) - LENGTH + 1), SLICE):
                part = text[base : base + SLICE + LENGTH - 1]
                parts.append(part)
                starts.append(at)
                self.owner.append(k)
                self.base.append(base)
                at += len(part)
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.starts, self.ends = np.array(starts, np.int64), np.array([*starts[1:], at], np.int64)
        self.first, self.owner, self.base = (np.array(x, np.int64) for x in (self.first, self.owner, self.base))

    def at(self, text: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Where a text's window is in the data."""
        return self.starts[self.first[text] + pos // SLICE] + pos % SLICE

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and position of a place in the data."""
        part = np.searchsorted(self.starts, at, "right") - 1
        return self.owner[part], at - self.starts[part] + self.base[part]

    def runs(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window, and the chosen position, of each run."""
        n = len(self.data) - LENGTH + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 3
        least = (rank & ~PLACE) | np.arange(len(rank), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        rest = WINDOW - width
        least = np.minimum(least[: len(least) - rest], least[rest:])[:n]
        chosen = (least & PLACE).astype(np.int64)
        edge = np.zeros(n + 1, np.int8)  # windows within one text
        some = self.ends - self.starts >= LENGTH
        edge[self.starts[some]] += 1
        edge[self.ends[some] - LENGTH + 1] -= 1
        whole = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (whole[1:] != whole[:-1])]
        new[self.starts[self.starts < n]] = True
        first = np.flatnonzero(new)
        last = np.r_[first[1:] - 1, n - 1]
        keep = whole[first]
        return first[keep], last[keep], chosen[first[keep]]


def packed(rows: np.ndarray) -> bytes:
    """Column by column and byte by byte, so that the high bytes of ids and positions compress."""
    return b"".join(np.ascontiguousarray(rows[f]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for f in rows.dtype.names)


def unpacked(blocks: list[bytes], kind: np.dtype) -> np.ndarray:
    out = np.empty(sum(len(b) // kind.itemsize for b in blocks), kind)
    at = 0
    for b in blocks:
        n, place = len(b) // kind.itemsize, 0
        for f in kind.names:
            size = n * kind[f].itemsize
            out[f][at : at + n] = np.ascontiguousarray(np.frombuffer(b, np.uint8, size, place).reshape(-1, n).T).view(kind[f]).reshape(-1)
            place += size
        at += n
    return out


def messages(found: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(kind, bucket of each row, rows) -> a message for each kind and bucket."""
    out: list[tuple[int, int, int, bytes]] = []
    for kind, bucket, rows in found:
        if len(rows):
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            out += [(int(bucket[a]), kind, int(b - a), packed(rows[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "kind", "rows", "block"])


def done(rows: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows), DONE)
    for f in DONE.names:
        out[f] = rows[f]
    return out


def _marks(ids: np.ndarray, size: int) -> np.ndarray:
    """Where documents are in a map of so many bits, a power of two."""
    return (mixed(ids.astype(np.int64).view(np.uint64) * A) & U(size - 1)).astype(np.int64)


def _in_map(ids: pa.Array, bits: np.ndarray, size: int) -> np.ndarray:
    at = _marks(np.array([NO_ID if i is None else i for i in ids.to_pylist()], np.int64), size)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def marked(found: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """The map of the documents in messages: maps of tasks, in parts of 4 kB, joined by a bitwise or."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[_marks(unpacked(batch.column(3).to_pylist(), kind)["doc"], size)] = True
        parts = np.packbits(bits, bitorder="little").reshape(-1, 4096)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "bits"])

    out = np.zeros((size // 8 // 4096, 4096), np.uint8)
    for r in found.mapInArrow(run, "part long, bits binary").groupBy("part").agg(F.bitmap_or_agg("bits").alias("bits")).collect():  # the map, 32 MB at most
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _passed(batch: pa.RecordBatch, which: np.ndarray) -> pa.RecordBatch:
    """The messages that go on as they are."""
    return pa.RecordBatch.from_arrays(batch.filter(pa.array(which)).columns, batch.schema.names)


def _part(core: np.ndarray, parts: int) -> np.ndarray:
    return (core % U(parts)).astype(np.int64)


def _back(rows: np.ndarray, parts: int) -> np.ndarray:
    """Where repeated rows go: to their documents' block, or, of rows that have none, anywhere."""
    return rows["block"].astype(np.int64) if "block" in rows.dtype.names else ((rows["core"] >> U(33)) % U(parts)).astype(np.int64)


def sifted(rows: np.ndarray, parts: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of one task by their core: what is there twice is repeated, with a witness for the other tasks; the rest are candidates."""
    rows = rows[np.argsort(rows["core"], kind="stable")]
    same = rows["core"][1:] == rows["core"][:-1] if len(rows) else np.zeros(0, bool)
    twice = np.zeros(len(rows), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = twice & ~np.r_[False, same] if len(rows) else twice
    many, once = rows[twice], rows[~twice]
    return [(REPEATED, _back(many, parts), many), (WITNESS, _part(rows["core"][first], parts), rows[first]), (CANDIDATE, _part(once["core"], parts), once)]


def firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each name, in the order of document, row and position; the others)."""
    rows = rows[np.lexsort((rows["pos"], rows["row"], rows["doc"], rows["two"], rows["one"]))]
    new = np.r_[True, (rows["one"][1:] != rows["one"][:-1]) | (rows["two"][1:] != rows["two"][:-1])] if len(rows) else np.zeros(0, bool)
    return rows[new], rows[~new]


def meet_by_core(kind: np.dtype, parts: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidates whose core has other rows are repeated; repeated rows pass through."""

    @released
    def by_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {CANDIDATE: [], WITNESS: []}
        for batch in batches:
            through = np.isin(batch.column(1).to_numpy(), (REPEATED, SETTLED))
            if through.any():
                yield _passed(batch, through)
            for k, b in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k in blocks:
                    blocks[k].append(b)
        mine, others = unpacked(blocks[CANDIDATE], kind), unpacked(blocks[WITNESS], kind)
        core = np.r_[mine["core"], others["core"]]
        _, which, times = np.unique(core, return_inverse=True, return_counts=True)
        again = mine[times[which[: len(mine)]] > 1]
        yield messages([(REPEATED, _back(again, parts), again)])

    return by_core


def meet_by_name(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows with the same name the first goes on, to meet by its core; the others are settled."""

    @released
    def by_name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            if (kinds == SETTLED).any():
                yield _passed(batch, kinds == SETTLED)
            blocks += [b for k, b in zip(kinds.tolist(), batch.column(3).to_pylist(), strict=True) if k == CANDIDATE]
        first, others = firsts(unpacked(blocks, PAIR))
        yield messages([(SETTLED, others["block"].astype(np.int64), done(others)), *sifted(first, parts)])

    return by_name


class Block:
    """The documents of a block in the order of their ids, and where the rows that came to it are."""

    def __init__(self, table: pa.Table, number: int):
        ids = [NO_ID if i is None else i for i in table.column("doc_id").to_pylist()]
        unzip = zstandard.ZstdDecompressor().decompress
        texts = [unzip(t) for t in table.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k])) if len(set(ids)) < len(ids) else np.argsort(ids).tolist()
        self.order = [int(k) for k in order]
        self.ids, self.texts = np.array(ids, np.int64)[order], [texts[k] for k in order]
        self.number, self.null = number, self.ids == NO_ID
        first = np.searchsorted(self.ids, self.ids)
        self.row = np.arange(len(ids)) - first + self.null * (np.int64(number) << 20)  # tells rows of one id apart

    def of(self, rows: np.ndarray) -> np.ndarray:
        """The document of each row."""
        at = np.searchsorted(self.ids, rows["doc"])
        return at + np.where(rows["doc"] == NO_ID, rows["row"] & ((1 << 20) - 1), rows["row"])

    def chunks(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, Texts]]:
        """(documents, their texts) of bounded size, of those that are wanted."""
        some: list[int] = []
        size = 0
        for k in wanted.tolist():
            some.append(k)
            size += len(self.texts[k])
            if size >= AT_ONCE:
                yield np.array(some), Texts([self.texts[j] for j in some])
                some, size = [], 0
        if some:
            yield np.array(some), Texts([self.texts[j] for j in some])

    def pairs(self, text: Texts, documents: np.ndarray, rank: np.ndarray, core: np.ndarray, first: np.ndarray, last: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows for windows ``first`` to ``last`` (places in the data)."""
        rows = np.empty(len(first), PAIR)
        rows["core"], rows["n"], rows["off"], rows["block"] = core, last - first + 1, off, self.number
        rows["one"], rows["two"] = named(rank, first, last + LENGTH) if len(first) else (0, 0)
        owner, pos = text.place(first)
        rows["doc"], rows["row"], rows["pos"] = self.ids[documents[owner]], self.row[documents[owner]], pos
        return rows


def _runs(block: Block, blocks: list[bytes]) -> Iterator[np.ndarray]:
    """Runs of the chosen positions that are repeated."""
    chosen = unpacked(blocks, SHORT)
    for documents, text in block.chunks(np.flatnonzero(np.isin(block.ids, chosen["doc"]))):
        *_, rank, rank64 = ranked(text.data)
        first, last, at = text.runs(rank)
        part = np.searchsorted(text.starts, first, "right") - 1  # the position may lie beyond its slice's windows
        owner, pos = text.owner[part], at - text.starts[part] + text.base[part]
        key = np.empty(len(at), [("doc", "<i8"), ("pos", "<u4")])
        key["doc"], key["pos"] = block.ids[documents[owner]], pos
        have = np.empty(len(chosen), key.dtype)
        have["doc"], have["pos"] = chosen["doc"], chosen["pos"]
        keep = _in(key, have)
        first, last, at = first[keep], last[keep], at[keep]
        yield block.pairs(text, documents, rank64, rank[at], first, last, at - first)


def _in(key: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Whether each (doc, pos) is among ``have``."""
    docs = np.unique(np.r_[key["doc"], have["doc"]])
    number = lambda x: np.searchsorted(docs, x["doc"]).astype(np.int64) << 32 | x["pos"].astype(np.int64)
    return np.isin(number(key), number(have))


def _rows_at(block: Block, blocks: list[bytes]) -> Iterator[tuple[np.ndarray, Texts, np.ndarray, np.ndarray, np.ndarray]]:
    """(documents, texts, ranks of 64 bytes, rows, first window's place) for the rows that came to a block."""
    rows = unpacked(blocks, PAIR)
    document = block.of(rows)
    for documents, text in block.chunks(np.unique(document)):
        mine = np.isin(document, documents)
        here = rows[mine]
        yield documents, text, ranked(text.data)[-1], here, text.at(np.searchsorted(documents, document[mine]), here["pos"].astype(np.int64))


def _eights(block: Block, blocks: list[bytes]) -> Iterator[np.ndarray]:
    """Runs cut where the distance to the chosen position passes a multiple of eight."""
    for documents, text, rank, rows, first in _rows_at(block, blocks):
        far, near = rows["off"].astype(np.int64), rows["off"].astype(np.int64) - rows["n"].astype(np.int64) + 1
        times = far // EIGHT - near // EIGHT + 1
        which = np.repeat(np.arange(len(rows)), times)
        step = near[which] // EIGHT + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        at = first[which] + far[which]
        a, b = at - np.minimum(far[which], EIGHT * step + EIGHT - 1), at - np.maximum(near[which], EIGHT * step)
        core = named(rank, at - EIGHT * step, at - EIGHT * step + LENGTH - EIGHT + 1)[0] + step.astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
        yield block.pairs(text, documents, rank, core, a, b, at - a)


def _windows(block: Block, blocks: list[bytes]) -> Iterator[np.ndarray]:
    """Single windows."""
    for documents, text, rank, rows, first in _rows_at(block, blocks):
        times = rows["n"].astype(np.int64)
        at = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        yield block.pairs(text, documents, rank, np.zeros(len(at), np.uint64), at, at, np.zeros(len(at), np.int64))


def _level(made: Callable[[Block, list[bytes]], Iterator[np.ndarray]], parts: int) -> Callable:
    """For cogroup: makes a block's rows; of those with the same name in the block the first goes on."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows or not found.num_rows:
            return pa.Table.from_batches([messages([])])
        block = Block(docs, docs.column("bucket")[0].as_py())
        rows = np.concatenate([np.empty(0, PAIR), *made(block, found.column("block").to_pylist())])
        first, others = firsts(rows)
        return pa.Table.from_batches([messages([(SETTLED, others["block"].astype(np.int64), done(others)), (CANDIDATE, _part(first["one"], parts), first)])])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def removed_runs(n: int, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    inside = np.diff(np.r_[0, (np.cumsum(edge)[:n] > 0).astype(np.int8), 0])
    return list(zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True))


def _cut(rest: pa.Schema | None) -> Callable:
    with_kept = rest is not None

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if docs.num_rows:
            block = Block(docs, docs.column("bucket")[0].as_py())
            rows = unpacked(found.column("block").to_pylist() if found.num_rows else [], DONE)
            document = block.of(rows)
            order = np.argsort(document, kind="stable")
            rows, document = rows[order], document[order]
            cuts = np.searchsorted(document, np.arange(len(block.ids) + 1))
            for k, text in enumerate(block.texts):
                mine = rows[cuts[k] : cuts[k + 1]]
                spans, kept = [], text
                if len(mine):
                    start = mine["pos"].astype(np.int64)
                    spans = removed_runs(len(text), start, start + mine["n"].astype(np.int64) - 1 + LENGTH)
                    kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(text)], strict=True))
                out.append((None if block.null[k] else int(block.ids[k]), len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), _whole(text, spans) if with_kept else None))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        if with_kept:
            kinds = [pa.field(f.name, f.type) for f in rest.field("rest").type]
            taken = docs.column("rest").combine_chunks().take(pa.array(block.order)) if out else None
            arrays.append(pa.StructArray.from_arrays([pa.array([], f.type) if taken is None else taken.field(k) for k, f in enumerate(kinds)], fields=kinds))
        return pa.table(arrays, names=[x.split()[0] for x in RESULT.split(", ")] + ["rest"] * with_kept)

    return run


def _whole(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """What is kept if a removed run gives back the parts of characters at its edges."""
    out, at = [], 0
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append(text[at:a])
        at = max(at, b)
    return b"".join([*out, text[at:]])


def rest_name(k: int) -> str:
    """The name within ``rest`` of the k-th column of ``docs`` that is neither doc_id nor text."""
    return f"c{k}"


def suffix_dedup(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of ``docs``, which needs doc_id and text; ``with_kept`` also kept and rest.

    A byte of the text in UTF-8 is removed if a string of LENGTH bytes that covers it also starts earlier: in a text
    with a smaller doc_id, or earlier in the same text. Strings may overlap, are judged on the input, and never cross
    texts. ``kept`` is what is left, whole characters only, and ``rest`` the row's other columns, named by :func:`rest_name`. Null texts are empty. Of rows
    with one doc_id the smaller text counts as earlier, and rows without a doc_id come before all others, in a fixed
    order. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, min(4 * partitions(spark), n // PART))
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    map_bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (8 * n).bit_length()))
    bucket = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), "text"), F.lit(""))), F.lit(blocks)).cast("int")
    rows = docs.select(bucket.alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    whole = docs.select(bucket.alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`").alias(rest_name(k)) for k, c in enumerate(others)), F.lit(None).cast("int").alias("none")).alias("rest")) if with_kept else rows

    def some(df: DataFrame, bits, rest: bool) -> DataFrame:
        """The documents that the map has, their texts packed, so that a shuffle moves little."""

        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            zip_ = zstandard.ZstdCompressor(level=1).compress
            for batch in batches:
                part = batch.filter(pa.array(_in_map(batch.column(1), bits.value, map_bits)))
                texts = pa.array([zip_(t) for t in part.column(2).cast(pa.binary()).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts, *part.columns[3:]], part.schema.names)

        extra = f", rest {whole.schema['rest'].dataType.simpleString()}" if rest else ""
        return df.mapInArrow(run, "bucket int, doc_id long, text binary" + extra)

    @released
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        for batch in batches:
            ids = np.array([NO_ID if i is None else i for i in batch.column(1).to_pylist()], np.int64)
            number = batch.column(0).to_numpy()
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= AT_ONCE):
                    size += len(texts[upto])
                    upto += 1
                text = Texts(texts[at:upto])
                rank = ranks_of_gram(text.data)
                first, _, place = text.runs(rank)
                part = np.searchsorted(text.starts, first, "right") - 1
                owner = text.owner[part] + at
                found = np.empty(len(place), SHORT)
                found["core"], found["doc"], found["block"] = rank[place], ids[owner], number[owner]
                found["pos"] = place - text.starts[part] + text.base[part]
                gathered.append(found)
                at = upto
            if sum(map(len, gathered)) > GATHERED:
                yield messages(sifted(np.concatenate(gathered), parts))
                gathered = []
        if gathered:
            yield messages(sifted(np.concatenate(gathered), parts))

    def about(found: DataFrame, kind: np.dtype):
        return spark.sparkContext.broadcast(marked(found, kind, map_bits))

    grams = written(rows.mapInArrow(chosen, MESSAGE).repartition("bucket").mapInArrow(meet_by_core(SHORT), MESSAGE), "grams")
    level, kind, settled = grams.filter(F.col("kind") == REPEATED), SHORT, []
    for label, made in (("runs", _runs), ("eights", _eights), ("windows", _windows)):
        texts = some(rows, about(level, kind), False)
        met = texts.groupBy("bucket").cogroup(level.groupBy("bucket")).applyInArrow(_level(made, parts), MESSAGE).repartition("bucket").mapInArrow(meet_by_name(parts), MESSAGE)
        named_ = written(met, f"{label}-named")
        discard(grams)
        if label != "windows":
            grams = written(named_.filter(F.col("kind") != SETTLED).repartition("bucket").mapInArrow(meet_by_core(PAIR), MESSAGE), label)
            level, kind = grams.filter(F.col("kind") == REPEATED), PAIR
        settled.append(named_.filter(F.col("kind") == SETTLED))
    found = settled[0].unionByName(settled[1]).unionByName(settled[2])
    bits = about(found, DONE)
    schema = RESULT + (f", rest {whole.schema['rest'].dataType.simpleString()}" if with_kept else "")
    cut = _cut(to_arrow_schema(whole.schema) if with_kept else None)

    @released
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of the documents that no settled row is about, straight from the scan."""
        for batch in batches:
            part = batch.filter(pa.array(~_in_map(batch.column(1), bits.value, map_bits)))
            if part.num_rows:
                texts = part.column(2).cast(pa.binary()).to_pylist()
                none = pa.array(np.zeros(len(texts), np.int64))
                arrays = [part.column(1), pa.array([len(t) for t in texts], pa.int64()), none, none, pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts if with_kept else [None] * len(texts), pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, *part.columns[3:]], [x.split()[0] for x in RESULT.split(", ")] + ["rest"] * with_kept)

    out = some(whole, bits, with_kept).groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(cut, schema)
    out = out.unionByName(whole.mapInArrow(untouched, schema))
    return out if with_kept else out.drop("kept")
