"""Best-fit packing with swap-based local search, and the tokenising that goes before it.

Pieces are packed in groups of bounded size, each in one task: best fit first, then a local search that exchanges one
for one, two for one or moves pieces between any two underfull bins whenever that raises the sum of squared fills, until
no such step is left. The bins that are left underfull in all groups are packed again, round by round, until one group
holds them or a round saves no sequence.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tiktoken._tiktoken import CoreBPE
from tokenizers import Tokenizer

from quire.llm.common import released, small_batches, written

LIMIT = 4096
#: Pieces that one task packs at once.
GROUP = 20_000

#: What this tokenizer's files split on and how they spell bytes; fixed values of the public format.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in PRINTED)}
#: Texts with these go whole to the tokenizer: its special tokens, characters whose lower case depends on their neighbours, separators that only Python takes for white space, and what lies beyond the first plane.
WHOLE = re.compile("<\\||[Σİͅ\x1c-\x1f\U00010000-\U0010ffff]")
#: The end of a word, as a byte that UTF-8 never has.
END = b"\xff"
#: Words in a generation of the cache; there are two.
CACHED = 250_000


class WordBpe:
    """Ids of word_bpe_49k.json word by word: equal words are encoded once and kept while they are in use.

    The file's normalizer lower-cases and its splitter drops white space, so no token crosses white space. Words are
    joined by the file's own merges in their order, given as ranks of byte strings. Words that a generation of the
    cache has met replace the one before, so that common words stay.
    """

    def __init__(self, path: str):
        self.whole, self.young, self.old = Tokenizer.from_file(path), {}, {}
        spelled = {c: b for b, c in SPELLED.items()}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        mark = model["end_of_word_suffix"]
        ranks = {bytes(spelled[c] for c in token.removesuffix(mark)) + END * token.endswith(mark): i for token, i in model["vocab"].items()}
        if len(ranks) < len(model["vocab"]) or any(model["vocab"][a + b] != 2 * 256 + k for k, (a, b) in enumerate(model["merges"])):
            raise ValueError("only vocabularies in the order of their merges, after the single bytes, are read")
        self._joined = CoreBPE(ranks, {}, ".+").encode_single_piece

    def _word(self, word: str) -> bytes:
        ids = self.young.get(word) or self.old.get(word)
        if ids is None:
            ids = array("I", self._joined(word.encode() + END)).tobytes()
        self.young[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self._word(chunk)
        ids = self.old.get(chunk)
        if ids is None:
            ids = b"".join([self.young.get(w) or self._word(w) for w in SPLIT.findall(chunk)])
        self.young[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without special tokens."""
        if WHOLE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        get, make = self.young.get, self._chunk
        return b"".join([get(c) or make(c) for c in text.lower().split()])


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def piece_rows(path: str, limit: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]]:
    """A function from batches of (doc_id, text) to lists of (doc_id, piece, start, length, ids_crc32, ids)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        encode, last = word_bpe(path).encode, np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = encode(text or "") + last
                for k, at in enumerate(range(0, len(whole), 4 * limit)):
                    part = whole[at : at + 4 * limit]
                    rows.append((one, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            yield rows

    return run


def tokenized(docs: DataFrame, path: str, limit: int = LIMIT, end: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's tokens and then ``end``, cut at every ``limit`` tokens."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in piece_rows(path, limit, end)(batches):
            columns = list(zip(*rows, strict=True))[:5] or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class _Bins:
    """Open bins by room: the tightest bin with enough room is found with a bit mask of the rooms in use."""

    def __init__(self, limit: int):
        self.by_room: list[list[int]] = [[] for _ in range(limit + 1)]
        self.mask = 0

    def put(self, room: int, bin_: int) -> None:
        self.by_room[room].append(bin_)
        self.mask |= 1 << room

    def take(self, least: int) -> tuple[int, int] | None:
        rest = self.mask >> least
        if not rest:
            return None
        room = least + (rest & -rest).bit_length() - 1
        bin_ = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return room, bin_


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Bins of the items' numbers: longest first, each into the bin that it leaves the least room."""
    bins: list[list[int]] = []
    open_ = _Bins(limit)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        if found := open_.take(lengths[i]):
            room, bin_ = found
            bins[bin_].append(i)
        else:
            room, bin_ = limit, len(bins)
            bins.append([i])
        open_.put(room - lengths[i], bin_)
    return bins


class _Partners:
    """Underfull bins by the lengths that they hold: ``reach[y]`` is the most that may take the place of a piece of length
    y in any of them, which is y and the bin's room; y = 0 is a move into the room alone."""

    def __init__(self, limit: int):
        self.reach = np.full(limit + 1, -1, np.int64)
        self._limit = limit
        self._heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(limit + 1)]  # (-room, bin, version)
        self._held: dict[int, tuple[int, ...]] = {}
        self._version: dict[int, int] = {}

    def put(self, bin_: int, held: set[int], fill: int) -> None:
        before = self._held.get(bin_, ())
        version = self._version[bin_] = self._version.get(bin_, 0) + 1
        self._held[bin_] = now = (0, *held) if fill < self._limit else ()
        for y in now:
            heapq.heappush(self._heaps[y], (fill - self._limit, bin_, version))
        for y in {*before, *now}:
            heap = self._heaps[y]
            while heap and heap[0][2] != self._version[heap[0][1]]:
                heapq.heappop(heap)
            self.reach[y] = y - heap[0][0] if heap else -1

    def drop(self, bin_: int) -> None:
        self.put(bin_, set(), self._limit)

    def roomiest(self, y: int) -> int:
        return self._heaps[y][0][1]


def local_search(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """Moves items from the emptiest underfull bins into fuller ones, alone or in exchange for a shorter item, one or
    two for one, whichever of all bins gains the most. Each step raises the sum of squared fills, so the search ends,
    when no step is left between any two bins; a bin that empties is gone."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    while _search(bins, lengths, fill, limit):
        pass
    return [b for b in bins if b]


def _search(bins: list[list[int]], lengths: list[int], fill: list[int], limit: int) -> bool:
    """One pass over the underfull bins from the emptiest on; each has all that are as full or fuller for partners."""
    under = [(f, k) for k, f in enumerate(fill) if 0 < f < limit]
    heapq.heapify(under)
    partners = _Partners(limit)
    for f, k in under:
        partners.put(k, {lengths[i] for i in bins[k]}, f)
    done = False
    while under:
        f, a = heapq.heappop(under)
        if f != fill[a]:  # filled since
            continue
        partners.drop(a)
        low = bins[a]
        while low:
            sizes = np.array([lengths[i] for i in low], np.int64)
            sizes, first = np.unique(sizes, return_index=True)
            twice = [(v, [k for k, i in enumerate(low) if lengths[i] == v][:2]) for v in sizes.tolist()] if len(sizes) < len(low) else []
            i, j = np.triu_indices(len(sizes), 1)
            same = [(2 * v, *ks) for v, ks in twice if len(ks) == 2]
            sums = np.concatenate([sizes, sizes[i] + sizes[j], np.array([x for x, _, _ in same], np.int64)])
            least = np.searchsorted(np.maximum.accumulate(partners.reach), sums)  # the shortest that each may replace
            best = int(np.argmax(sums - least))
            gain, y = int(sums[best] - least[best]), int(least[best])
            if gain <= 0:
                break
            if best < len(sizes):
                out = [low[first[best]]]
            elif (at := best - len(sizes)) < len(i):
                out = [low[first[i[at]]], low[first[j[at]]]]
            else:
                out = [low[k] for k in same[at - len(i)][1:]]
            b = partners.roomiest(y)
            for x in out:
                low.remove(x)
            if y:
                theirs = next(x for x in bins[b] if lengths[x] == y)
                bins[b].remove(theirs)
                low.append(theirs)
            bins[b].extend(out)
            fill[a] -= gain
            fill[b] += gain
            partners.put(b, {lengths[x] for x in bins[b]}, fill[b])
            if fill[b] < limit:
                heapq.heappush(under, (fill[b], b))
            done = True
    return done


def pack(lengths: list[int], limit: int = LIMIT) -> list[list[int]]:
    """Best fit, then the local search."""
    return local_search(best_fit(lengths, limit), lengths, limit)


PLACED = PIECES + ", sequence_id long, offset long, spare int"


def _packer(limit: int, base: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs what the task holds. sequence_id: the round, the task and the bin; spare: tokens without use in the bin."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if rows is None:
            return
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        task = TaskContext.get().partitionId()
        lengths = rows.column("length").to_pylist()
        sequence, offset, spare = (np.zeros(len(lengths), t) for t in (np.int64, np.int64, np.int32))
        for at in range(0, len(lengths), 4 * GROUP):
            part = lengths[at : at + 4 * GROUP]
            for n, bin_ in enumerate(pack(part, limit)):
                place = 0
                for i in sorted(bin_):
                    sequence[at + i], offset[at + i] = (base << 56) + (task << 32) + at + n, place
                    place += part[i]
                spare[[at + i for i in bin_]] = limit - place
        for k, c in (("sequence_id", sequence), ("offset", offset), ("spare", spare)):
            rows = rows.append_column(k, pa.array(c))
        yield from rows.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def best_fit_packing(pieces: DataFrame, limit: int = LIMIT, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each row of :func:`tokenized`.

    Full pieces have a sequence each. The rest are dealt at random into tasks of about ``group`` pieces and packed
    there; the bins that stay underfull are dealt anew and packed again, until a single task of bounded size has had
    what was left over, nothing is left or a round makes no fewer sequences of it than there were. Offsets follow doc_id and
    piece. Sequence ids have no gaps promised. Empty texts have one token, the end. Rows with a null or repeated
    doc_id are packed like any other; an empty table gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    columns = pieces.columns
    found = [*columns, "sequence_id", "offset"]
    full = pieces.filter(F.col("length") == limit).withColumns({"sequence_id": -F.lit(1) - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    left, kept, best, done, base = pieces.filter(F.col("length") < limit), None, None, [full.select(*found)], 0
    waste = F.col("spare") > 0
    while n := left.count():
        tasks = -(-n // group)
        packed = written(left.repartition(tasks, F.xxhash64("doc_id", "piece", F.lit(base))).mapInArrow(_packer(limit, base), PLACED), "packed")
        if kept is not None and packed.filter("offset = 0").count() >= best:  # nothing saved: the round before stays
            done.append(kept)
            break
        if tasks == 1 or base == 120:  # ids have seven bits for the round
            done.append(packed.select(*found))
            break
        done.append(packed.filter(~waste).select(*found))
        left, base, kept = packed.filter(waste).select(*columns), base + 1, packed.filter(waste).select(*found)
        best = kept.filter("offset = 0").count()
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
