"""SentencePiece encoding and decoding in numpy, many words at once, by Viterbi with stored backpointers.

A text is cut before each run of spaces, for no piece holds a space after another character. Words that are new are
grouped by length, and the words of a length advance together, end by end: the hashes of all substrings that end there are
probed in the sorted 64-bit hashes of the pieces, vectorised maxima over the starts pick the last piece, and its start is
the backpointer. A unigram model's maxima are over sums of scores. A BPE model joins its best pair first, so its
scores order joins and must not be summed; but of the pieces that may end at a place exactly one can follow the last
piece of the way to its start with no join missed, and the maxima are over these. Whether two pieces can follow each
other is found by undoing their joins, last one first: a join across the border that would have come earlier than the undone one
forbids the pair. Every word's pieces are compared with the word, so that a hash collision does no harm.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: Words up to this long are batched; longer ones are joined one by one with a heap.
LONGEST = 64
#: Words in a generation of the cache (there are two); words that advance together, if short; characters of texts whose new words are learnt at once.
CACHED, ROWS, AT_ONCE = 250_000, 20_000, 1 << 22
#: Bits of the index into the sorted keys, and of the table of pairs that have been judged.
INDEXED, JUDGED = 17, 20
FAR, NEVER = -1e30, np.iinfo(np.int64).max


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a serialized protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            value: int | bytes = number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class PieceModel:
    """A model file with the identity normalizer, that marks spaces, may prefix one, and falls back to bytes or to the unknown piece."""

    def __init__(self, data: bytes, kind: int | None = None):
        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.prefix = kind or UNIGRAM, True
        for key, value in _fields(data):
            if key == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif key == 2 and kind is None:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif key == 3:
                rules = dict(_fields(value))
                self.prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models with the identity normalizer that keep extra spaces are read")
        if any(SPACE in p.lstrip(SPACE) for p, t in zip(self.pieces, self.types, strict=True) if t in (NORMAL, USER)):
            raise ValueError("a piece holds a space after another character")
        used = [i for i, t in enumerate(self.types) if t in (NORMAL, USER)]
        reach = max(LONGEST, max(map(len, self.pieces), default=1))
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(reach, BASE)])
        self.unpower = np.cumprod(np.r_[np.uint64(1), np.full(reach, pow(int(BASE), -1, 1 << 64), np.uint64)])
        keys = np.array([self._key(self.pieces[i]) for i in used], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(used, np.int64)[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same hash")
        self.values = np.array(self.scores)[self.ids]
        self.index = np.searchsorted(self.keys >> np.uint64(64 - INDEXED), np.arange((1 << INDEXED) + 1, dtype=np.uint64))
        self.number = {self.pieces[i]: i for i in used}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.worst = min(self.values, default=0.0) - 10
        self.widest = max((len(self.pieces[i]) for i in used), default=1)
        self.raw = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() if t in (NORMAL, USER) else b" \xe2\x81\x87 " if t == UNKNOWN else b"" for p, t in zip(self.pieces, self.types, strict=True)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if self.kind == BPE:
            self._learn_halves()

    def _learn_halves(self) -> None:
        """Which two pieces each piece is joined from: those of its halves that can follow each other when it is left out. Pieces that no join gives are never used."""
        pieces = [self.pieces[i] for i in self.ids.tolist()]
        self.rank = np.argsort(np.argsort(-self.values, kind="stable"), kind="stable").astype(np.int64)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.left, self.right = np.full(len(pieces), -1), np.full(len(pieces), -1)
        self.made = self.size == 1
        self.order = np.where(self.size == 1, -1, self.rank)  # when it is joined
        self.letters = np.zeros((len(pieces) + 1, self.widest), np.uint32)  # the last row is no piece's
        for k, p in enumerate(pieces):
            self.letters[k, : len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.pair, self.follows = np.full(1 << JUDGED, -1, np.int64), np.zeros(1 << JUDGED, bool)
        plain = np.array([2 * SPACE not in p for p in pieces], bool)  # pieces of many spaces may share a score
        self.exact = len(np.unique(self.values[plain])) == plain.sum()
        for length in range(2, self.widest + 1):
            mine = np.flatnonzero(self.size == length)
            if not len(mine):
                continue
            codes = self._codes([pieces[k] for k in mine])
            hashes = np.concatenate([np.zeros((len(mine), 1), np.uint64), np.cumsum(codes * self.power[:length], axis=1, dtype=np.uint64)], 1)
            for cut in range(1, length):
                x, y = self._place(hashes[:, cut]), self._place((hashes[:, -1] - hashes[:, cut]) * self.unpower[cut])
                some = np.flatnonzero((x >= 0) & (y >= 0))
                some = some[self.made[x[some]] & self.made[y[some]]]
                some = some[self._can_follow(x[some], y[some], self.rank[mine[some]])]
                self.left[mine[some]], self.right[mine[some]], self.made[mine[some]] = x[some], y[some], True
        joined = (self.left >= 0) & plain
        self.exact &= bool((np.maximum(self.order[self.left[joined]], self.order[self.right[joined]]) < self.order[joined]).all())  # as any vocabulary made by joining

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        """One row of mixed code points for each word; all words are of one length."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(len(words), -1) + np.uint64(1)
        codes *= np.uint64(0xBF58476D1CE4E5B9)
        return codes ^ (codes >> np.uint64(29))

    def _key(self, piece: str) -> np.uint64:
        return (self._codes([piece])[0] * self.power[: len(piece)]).sum(dtype=np.uint64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        """The place among the sorted keys, or -1; a binary search that starts from an index of the keys' first bits."""
        first = (keys >> np.uint64(64 - INDEXED)).astype(np.int64)
        low, high = self.index[first], self.index[first + 1]
        found = np.full(keys.shape, -1, np.int64)
        live = np.flatnonzero(low < high)
        low, high, mine = low.reshape(-1)[live], high.reshape(-1)[live], keys.reshape(-1)[live]
        flat = found.reshape(-1)
        while len(live):
            hit = self.keys[low] == mine
            flat[live[hit]] = low[hit]
            low += 1
            more = ~hit & (low < high)
            live, low, high, mine = live[more], low[more], high[more], mine[more]
        return found

    def _probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, place among the sorted keys); FAR and -1 where there is no such piece."""
        at = self._place(keys)
        return np.where(at >= 0, self.values[at], FAR), at

    def _can_follow(self, x: np.ndarray, y: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
        """BPE: whether the texts of two pieces (places among the keys), one after the other, are joined to these two pieces.

        With ``whole``, the rank of the piece that both make, that join is left out and only earlier ones count.
        """
        good, rows = np.ones(len(x), bool), np.arange(len(x))
        limit = np.full(len(x), NEVER) if whole is None else whole
        first = whole is not None
        while len(rows):
            if not first:
                z = self._place(self.keys[x] + self.keys[y] * self.power[self.size[x]])
                bad = (z >= 0) & (self.rank[z] < limit)
                good[rows[bad]] = False
                x, y, limit, rows = x[~bad], y[~bad], limit[~bad], rows[~bad]
            first = False
            a, b = self.order[x], self.order[y]
            more = np.maximum(a, b) >= 0
            x, y, limit, rows, a, b = x[more], y[more], limit[more], rows[more], a[more], b[more]
            by_left = a > b  # of two equal joins the left one comes first, so the right one is undone first
            limit = np.where(by_left, a, b + 1)  # ... and a join across the border comes before an equal one on its right
            x, y = np.where(by_left, self.right[x], x), np.where(by_left, y, self.left[y])
        return good

    def _judged(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """_can_follow, with a table of the pairs that have been judged lately."""
        pair = x * len(self.keys) + y
        at = ((pair.astype(np.uint64) * BASE) >> np.uint64(64 - JUDGED)).astype(np.int64)
        new = np.flatnonzero(self.pair[at] != pair)
        out = self.follows[at]
        if len(new):
            _, first = np.unique(pair[new], return_index=True)
            new_ = new[first]
            good = self._can_follow(x[new_], y[new_])
            out[new] = good[np.searchsorted(pair[new_], pair[new])]
            self.pair[at[new_]], self.follows[at[new_]] = pair[new_], good
        return out

    def _followed(self, words: list[str]) -> list[bytes]:
        """BPE by Viterbi: the ids of each word, all of one length."""
        n, length = len(words), len(words[0])
        hashes = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(self._codes(words) * self.power[:length], axis=1, dtype=np.uint64)], 1)
        last, back = np.full((n, length + 1), -1), np.zeros((n, length + 1), np.int64)
        for end in range(1, length + 1):
            start = np.arange(max(0, end - self.widest), end)
            place = self._place((hashes[:, end, None] - hashes[:, start]) * self.unpower[start])
            row, column = np.nonzero(place >= 0)
            place, begin = place[row, column], start[column]
            before = last[row, begin]
            open_ = self.made[place]
            check = np.flatnonzero(open_ & (before >= 0))  # a word's start and unknown characters can be followed by any piece
            open_[check] = self._judged(before[check], place[check])
            back[:, end] = end - 1  # an unknown character stands alone
            row, begin, place = row[open_], begin[open_], place[open_]
            back[row, end], last[row, end] = begin, place
        ends, at, rows = np.zeros((n, length + 1), bool), np.full(n, length), np.arange(n)
        while len(rows):
            ends[rows, at] = True
            at = back[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        row, end = np.nonzero(ends)
        place, size = last[row, end], end - back[row, end]
        letter = np.arange(n * length) - np.repeat(np.cumsum(size) - size, size)
        same = self.letters[np.repeat(place, size), letter] == np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sure = same.reshape(n, length).all(1)  # no collision of hashes
        sure[row[place < 0]] = False  # and no unknown character
        data, cuts = self.ids[place].astype("<u4").tobytes(), (4 * np.r_[0, np.cumsum(ends.sum(1))]).tolist()
        out = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for k in np.flatnonzero(~sure).tolist():
            spans = _path(back[k].tolist())
            known = all(b - a == 1 or words[k][a:b] in self.number for a, b in spans)
            out[k] = self._numbers(words[k], spans if known else self._one_by_one(words[k]))
        return out

    def _best(self, words: list[str]) -> list[bytes]:
        """Unigram by Viterbi: the ids of each word, all of one length."""
        return [self._numbers(w, spans) for w, spans in zip(words, self._viterbi(words), strict=True)]

    def _viterbi(self, words: list[str]) -> list[list[tuple[int, int]]]:
        """Unigram: (start, end) of the best path's pieces of each word, all of one length; unknown characters stand alone."""
        n, length = len(words), len(words[0])
        terms = self._codes(words)
        best, back = np.full((n, length + 1), FAR), np.zeros((n, length + 1), np.int64)
        best[:, 0] = 0
        for end in range(1, length + 1):
            key, least = np.zeros(n, np.uint64), np.full(n, FAR)
            for start in range(end - 1, max(-1, end - 1 - self.widest), -1):
                key = key * BASE + terms[:, start]
                score, _ = self._probe(key)
                score = np.where(score > FAR, score, self.worst if end - start == 1 else FAR)
                total = np.where(score > FAR, best[:, start] + score, FAR)
                better = total > least
                least, back[better, end] = np.where(better, total, least), start
            best[:, end] = least
        return [_path(starts) for starts in back.tolist()]

    def _one_by_one(self, word: str) -> list[tuple[int, int]]:
        """BPE of a long word: the same joins, from a heap."""
        left, right, end = list(range(-1, len(word) - 1)), list(range(1, len(word) + 1)), list(range(1, len(word) + 1))
        live, heap = [True] * len(word), []

        def offer(a: int) -> None:
            if 0 <= a and (b := right[a]) < len(word) and (i := self.number.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, end[b]))

        for a in range(len(word)):
            offer(a)
        while heap:
            _, a, b, stop = heapq.heappop(heap)
            if live[a] and b < len(word) and live[b] and right[a] == b and end[b] == stop:
                live[b], end[a], right[a] = False, stop, right[b]
                if right[a] < len(word):
                    left[right[a]] = a
                offer(a)
                offer(left[a])
        return [(a, end[a]) for a in range(len(word)) if live[a]]

    def _numbers(self, word: str, spans: list[tuple[int, int]]) -> bytes:
        ids: list[int] = []
        for a, b in spans:
            if (i := self.number.get(word[a:b])) is not None:
                ids.append(i)
            elif b - a > 1:  # a collision of hashes: unigram models are read without
                raise ValueError(f"no piece is {word[a:b]!r}")
            elif self.bytes:
                ids += [self.bytes[c] for c in word[a:b].encode("utf-8", "surrogatepass")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return array("I", ids).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes words that the cache hasn't; equal lengths together."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        cut = self._followed if self.kind == BPE else self._best
        for length, group in sorted(by_length.items()):
            if self.kind == BPE:  # where joins may tie, and in long words, they are made one by one
                apart = [w for w in group if length > LONGEST or not self.exact or w.startswith(2 * SPACE)]
                for w in apart:
                    self.young[w] = self._numbers(w, self._one_by_one(w))
                group = [w for w in group if w not in self.young] if apart else group
            rows = max(1, ROWS * 16 // max(16, length))
            for at in range(0, len(group), rows):
                part = group[at : at + rows]
                self.young.update(zip(part, cut(part), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.young) > CACHED:
            self.old, self.young = self.young, {}
        cut = [WORD.findall(((SPACE if self.prefix else "") + t).replace(" ", SPACE)) if t else [] for t in texts]
        young, old, new = self.young, self.old, set()
        for words in cut:
            for w in {*words}.difference(young):
                if (ids := old.get(w)) is None:
                    new.add(w)
                else:
                    young[w] = ids
        self.learn(new)
        return [b"".join(map(young.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, and the prefixed space goes."""
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _path(back: list[int]) -> list[tuple[int, int]]:
    """(start, end) of a word's pieces, from its backpointers."""
    path, end = [], len(back) - 1
    while end:
        path.append((back[end], end))
        end = back[end]
    return path[::-1]


@cache
def piece_model(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return PieceModel(file.read())


def encoded(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip), with ``ids`` the ids too (binary, little-endian unsigned 32-bit), for each row.

    Whole texts are encoded and decoded again; round_trip says whether that gives the text, in which U+2581 counts as a
    space. Null and empty texts have no ids. Repeated rows are encoded each; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)

        def out(one: list, texts: list[str]) -> pa.RecordBatch:
            found = model.encode(texts)
            same = [model.decode(i) == t.replace(SPACE, " ") for i, t in zip(found, texts, strict=True)]
            arrays = [pa.array(one, pa.int64()), pa.array([len(i) // 4 for i in found], pa.int64()), pa.array([zlib.crc32(i) for i in found], pa.int64()), pa.array(same)]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(found, pa.binary())] * ids, ["doc_id", "n_ids", "ids_crc32", "round_trip"] + ["ids"] * ids)

        one, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one.append(i), texts.append(t or "")
                size += len(texts[-1])
                if size >= AT_ONCE:
                    yield out(one, texts)
                    one, texts, size = [], [], 0
        if one:
            yield out(one, texts)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids binary" * ids)


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else model.decode(i) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
