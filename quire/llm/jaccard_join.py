"""Exact Jaccard join of documents' word n-grams in metric space, and the groups that the links make.

Jaccard distance is a metric, but most pairs of documents are at distance 1, so the space is cut where documents
already share content: a document's n-grams are dealt into classes by hash, so many that two documents within the
threshold must have a class with the same n-grams among their largest ones (each n-gram that differs spoils one
class, and there are more classes than may differ). In short documents each n-gram is a class, the rarer ones of a sample first, so that a
common line brings no strangers together. All documents with an equal class make a region around its pivot,
the member with the least hash; a document that is near several pivots is in all their regions.

Inside a region more pivots make Voronoi cells: a member belongs to the cell of its nearest pivot, and by the triangle
inequality two members within the threshold are both in the cell of either's nearest pivot if members also go to the cells of
pivots that are farther by no more than two thresholds. Cells are cut again in the same way until they are small or
would hold more pairs than before; there, pairs are compared whose distances to all pivots so far differ by no more than the threshold
and that links do not connect yet. Regions too large for one task are split into parts that all have the
pivot, and members that their part does not link to it are then taken to all parts, so that no pair is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, partitions, released, small_batches, spread_join, written
from quire.llm.suffix_dedup import MESSAGE, REPEATED, meet_by_core, messages, mixed, sifted, unpacked

U = np.uint64
#: Words of a shingle; links are 100 * intersection >= PERCENT * union.
WORDS, PERCENT = 4, 85
#: Sizes from which n-grams are dealt into classes; below, each is its own class.
SMALL = 64
#: Members of a region, or of a part of it, that one task compares.
MEMBERS = 4096
#: Pivots that cut a region or a cell, members of a cell that are compared without a further cut, and shingles that are looked at together.
PIVOTS, CELL, LOAD = 8, 64, 1 << 19
#: Rows of (document, region) up to which they are handed to all tasks, some 60 bytes each, rather than the sets dealt out by document first.
HANDED = 250_000
#: Documents that the frequent n-grams are looked for in, and the share of these (one in so many) that makes an n-gram frequent.
SAMPLE, FREQUENT = 20_000, 200
#: Bits of the map of members that all tasks get (packed, 4 MB), whatever the number of documents.
BITS = 1 << 25
#: Bytes that are hashed at once, and pairs that a task gathers before it sends them.
AT_ONCE, GATHERED = 1 << 19, 1 << 19
INFO, SPOILT = 10, 11

_random = np.random.default_rng(91)
BYTES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTES[ord("A") : ord("Z") + 1] = BYTES[ord("a") : ord("z") + 1]
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
TURNS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
KEY = np.dtype([("core", "<u8"), ("doc", "<i8")])
ABOUT = np.dtype([("doc", "<i8"), ("n", "<i8"), ("same", "<i8"), ("id", "<i8")])


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct shingles, A-Z lower-cased."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~SPACE[data]
    edge = np.diff(np.r_[0, inside.astype(np.int8)])
    start = np.flatnonzero(edge == 1)
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(texts)
    at = np.flatnonzero(inside)
    size = np.diff(np.r_[np.searchsorted(at, start), len(at)])
    turn = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    factor = mixed((np.arange(int(size.max()) + 1, dtype=np.uint64) + U(1)) * TURNS[0]) | U(1)
    word = mixed(np.add.reduceat(BYTES[data[at]] * factor[turn], np.cumsum(size) - size) + size.astype(np.uint64) * TURNS[1])
    count = np.diff(np.r_[0, np.searchsorted(start, ends)])
    first = np.cumsum(count) - count
    n = len(word) - words + 1
    rolled = np.zeros(max(0, n), np.uint64)
    for k in range(words):
        rolled += word[k : k + len(rolled)] * TURNS[2 + k]
    rolled = mixed(rolled)
    out = []
    for a, c in zip(first.tolist(), count.tolist(), strict=True):
        if c >= words:
            out.append(np.unique(rolled[a : a + c - words + 1]))
        elif c:
            out.append(mixed((word[a : a + c] * TURNS[20 + np.arange(c)]).sum(dtype=np.uint64, keepdims=True) + U(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def packed_set(s: np.ndarray) -> bytes:
    """A sorted set's steps, byte by byte: the high bytes are mostly 0 and compress."""
    steps = np.diff(s, prepend=U(0)) if len(s) else s
    return np.ascontiguousarray(steps.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked_set(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8"), dtype=np.uint64)


def differ(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many shingles a set of n and one that links with it can differ by, at most."""
    return (100 - percent) * (100 * n // percent) // 100


def level(n: np.ndarray) -> np.ndarray:
    """Two levels for each doubling of the size, from SMALL on; -1 below."""
    return np.where(n < SMALL, -1, np.floor(2 * np.log2(np.maximum(n, SMALL) / SMALL) + 1e-9).astype(np.int64))


def classes(k: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Into how many classes a level deals: more than may differ, with room for classes that stay empty by chance."""
    full = 0.6 * percent / (100 - percent)
    return np.ceil(SMALL * 2.0 ** ((k + 1) / 2) / full).astype(np.int64) + 1


def keys(sets: list[np.ndarray], seed: int = 0, percent: int = PERCENT, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set's number, key) of all keys, and the sets whose classes are too few. Sets that link share a key.

    ``frequent``: n-grams, sorted, and how frequent each is; in short sets they come last.
    """
    n = np.array([len(s) for s in sets], np.int64)
    own, above = level(n), level(100 * n // percent)
    owners, found, spoilt = [], [], []
    for step in range(int((above - own).max(initial=0)) + 1):  # a partner's size may be of any level from own to above
        which, levels = np.flatnonzero((n > 0) & (own + step <= above)), own + step
        small = which[levels[which] < 0]
        for i in small.tolist():
            s = _rarest(sets[i], frequent)[: n[i] - -(-percent * int(n[i]) // 100) + 1]
            owners.append(np.full(len(s), i)), found.append(mixed(s * TURNS[40] + U(1)))
        big = which[levels[which] >= 0]
        if not len(big):
            continue
        k = levels[big]
        value = np.concatenate([sets[i] for i in big])
        owner = np.repeat(np.arange(len(big)), n[big])
        dealt = mixed(value * TURNS[41 + seed % 16] + U(seed))
        m = classes(k, percent)
        cell = owner * np.int64(m.max()) + (dealt % m[owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, dealt = cell[order], mixed(dealt[order])
        new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        total, size = np.add.reduceat(dealt, new), np.diff(np.r_[new, len(cell)])
        of = cell[new] // np.int64(m.max())
        sign = mixed(total * TURNS[60] + size.astype(np.uint64) * TURNS[61] + (cell[new] % np.int64(m.max())).astype(np.uint64) * TURNS[62] + (k[of] + 1).astype(np.uint64) * TURNS[63])
        order = np.lexsort((sign, -size, of))
        of, sign = of[order], sign[order]
        most = differ(n[big], percent)
        start = np.searchsorted(of, np.arange(len(big) + 1))
        spoilt.append(big[np.diff(start) <= most])
        keep = np.arange(len(of)) - start[of] <= most[of]
        owners.append(big[of[keep]]), found.append(sign[keep])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(owners, np.int64), join(found, np.uint64), join(spoilt, np.int64)


def _rarest(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """A set in an order that is the same for all sets: by how frequent its n-grams are, then by themselves."""
    if frequent is None or not len(frequent[0]):
        return s
    at = np.minimum(np.searchsorted(frequent[0], s), len(frequent[0]) - 1)
    return s[np.argsort(np.where(frequent[0][at] == s, frequent[1][at], 0), kind="stable")]


def linked(members: list[np.ndarray], ids: np.ndarray, percent: int = PERCENT, asking: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect what is connected among sets (the first is the pivot), and each one's group.

    With ``asking`` (a mask) only pairs of one that asks and one that doesn't are compared.
    """
    n = np.array([len(s) for s in members], np.int64)
    group, out = np.arange(len(members)), []
    near = (100 - percent) / 100 + 1e-9

    def loads(which: np.ndarray) -> Iterator[np.ndarray]:
        """Members whose shingles are so many together, so that memory does not follow the cell."""
        cuts = np.flatnonzero(np.diff((np.cumsum(n[which]) - 1) // LOAD)) + 1
        yield from np.split(which, cuts)

    def shared(i: int, others: np.ndarray) -> np.ndarray:
        """Shingles in common with each of the others."""
        found = []
        for load in loads(others):
            values = np.concatenate([members[j] for j in load.tolist()])
            place = np.searchsorted(members[i], values)
            np.minimum(place, n[i] - 1, out=place)
            found.append(np.add.reduceat(members[i][place] == values, np.cumsum(n[load]) - n[load], dtype=np.int64))
        return np.concatenate(found)

    def link(i: int, others: np.ndarray, common: np.ndarray) -> None:
        for j in others[100 * common >= percent * (n[others] + n[i] - common)].tolist():
            if group[j] != group[i] and (asking is None or asking[i] != asking[j]):
                out.append((int(ids[i]), int(ids[j])))
                group[group == group[j]] = group[i]

    def mixed_groups(which: np.ndarray) -> bool:
        return bool((group[which] != group[which[0]]).any()) and (asking is None or (asking[which].any() and not asking[which].all()))

    def meeting(which: np.ndarray) -> Callable[[int], np.ndarray]:
        """For a cell, the members (places in ``which``) that share one of a member's rarest shingles with it, so many that linked sets share one."""
        counted = [np.unique(np.concatenate([members[j] for j in load.tolist()]), return_counts=True) for load in loads(which)]
        name, at = np.unique(np.concatenate([v for v, _ in counted]), return_inverse=True)
        times = np.bincount(at, np.concatenate([c for _, c in counted]), len(name)).astype(np.int64)
        del counted, at
        rarest = []
        for i in which.tolist():
            mine = np.searchsorted(name, members[i])
            mine = mine[np.lexsort((mine, times[mine]))[: n[i] - -(-percent * n[i] // 100) + 1]]
            rarest.append(mine[times[mine] > 1])
        owner = np.repeat(np.arange(len(which)), [len(x) for x in rarest])
        every = np.concatenate(rarest)
        by_name = np.argsort(every, kind="stable")
        members_of, begin = owner[by_name], np.searchsorted(every[by_name], np.arange(len(name) + 1))

        def of(k: int) -> np.ndarray:
            return np.unique(np.concatenate([members_of[:0], *(members_of[begin[x] : begin[x + 1]] for x in rarest[k].tolist())]))

        return of

    def compare(which: np.ndarray, far: list[np.ndarray]) -> None:
        """All pairs of a cell that the pivots' distances (each for all members) don't part; none within its largest group."""
        _, of, size = np.unique(group[which], return_inverse=True, return_counts=True)
        outside = of != size.argmax()
        which, strays = np.r_[which[outside], which[~outside]], int(outside.sum())
        met = meeting(which) if len(which) > CELL else None
        for k, i in enumerate(which[:strays].tolist()):
            rest = which[k + 1 :] if met is None else which[(near_ones := met(k))[near_ones > k]]
            keep = (group[rest] != group[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
            if asking is not None:
                keep &= asking[rest] != asking[i]
            for d in far:
                keep &= np.abs(d[rest] - d[i]) <= near
            if len(rest := rest[keep]):
                link(i, rest, shared(i, rest))

    def cut(which: np.ndarray, far: list[np.ndarray]) -> None:
        if len(which) < 2 or not mixed_groups(which):
            return
        if len(which) <= CELL:
            return compare(which, far)
        own: list[np.ndarray] = []
        least, nearest, p = np.full(len(which), np.inf), np.zeros(len(which), np.int64), 0
        while len(own) < PIVOTS:  # the next pivot is the member that is farthest from those so far
            i = int(which[p])
            common = shared(i, which)
            link(i, which, common)
            if not mixed_groups(which):
                return
            d = np.full(len(members), np.nan)
            d[which] = 1 - common / (n[which] + n[i] - common)
            nearest[d[which] < least] = len(own)
            least = np.minimum(least, d[which])
            own.append(d)
            p = int(least.argmax())
            if least[p] <= 2 * near:  # all are near some pivot: more cells would be the same ones
                break
        cells = [which[d[which] <= least + 2 * near] for k, d in enumerate(own) if (nearest == k).any()]
        if sum(len(c) ** 2 for c in cells) >= len(which) ** 2:  # the cells do not shrink: their members are alike, or all strangers
            return compare(which, [*far, *own])
        for cell in cells:
            cut(cell, [*far, *own])

    cut(np.arange(len(members)), [])
    return out, group


def _ids(batch: pa.RecordBatch, k: int) -> list:
    return batch.column(k).to_pylist()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b): the least node that it is connected with.

    Large and small stars in turn, after Kiveris and others: each round joins nodes to the least of their neighbours,
    until nothing changes; rounds grow with the logarithm of the nodes. No group of neighbours is ever gathered.
    """
    spark = links.sparkSession
    now = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None

    def with_least(rows: DataFrame, least: Column) -> DataFrame:
        """rows (a, b) with m, the least of a's neighbours."""
        found = rows.groupBy("a").agg(least.alias("m"), F.count("*").alias("rows")).withColumnRenamed("a", "of")
        return spread_join(rows, "a", found, "of", "rows", rows.count())

    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, F.least(F.min("b"), F.first("a"))).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.filter("a != b"), "large")
        small = with_least(large, F.min("b")).select(F.explode(F.array(F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        discard(now)
        now = written(small, "small")
        discard(large)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def frequent_shingles(rows: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, sorted, how many documents of the sample have each) of those that are in more than one in FREQUENT of a sample of some SAMPLE documents, by the hashes of their ids; only short documents' n-grams count. They only set the order in which n-grams are looked at, which any choice keeps exact."""
    total = rows.count()
    share = min(1.0, SAMPLE / max(1, total))
    some = rows.filter("doc_id IS NOT NULL").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    @released
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist(), words) if len(s) < SMALL]
            found, times = np.unique(np.concatenate([np.zeros(0, U), *sets]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view("<i8")), pa.array(times)], ["gram", "n"])

    counts = some.mapInArrow(counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    often = counts.filter((F.col("n") * FREQUENT > min(total, SAMPLE)) & (F.col("n") > 1)).toPandas()  # SMALL * FREQUENT rows or so at most
    grams = often["gram"].to_numpy().astype(np.int64).view(U) if len(often) else np.zeros(0, U)
    order = np.argsort(grams)
    return grams[order], (often["n"].to_numpy().astype(np.int64)[order] if len(often) else np.zeros(0, np.int64))


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of ``docs``, which needs doc_id and text.

    A text's set are its distinct shingles of ``words`` words, A-Z lower-cased; a shorter text's whole sequence is its
    one shingle; null texts and those without words have none and link with nothing. Texts link when 100 * intersection
    >= percent * union, and component_id is the least doc_id that links lead to. Rows with one doc_id are one node. A
    null doc_id links with nothing and has no component. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = 4 * partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        texts, at = batch.column(1).cast(pa.binary()).to_pylist(), 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= AT_ONCE):
                size += len(texts[upto])
                upto += 1
            yield at, texts[at:upto]
            at = upto

    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, words))  # at most SMALL * FREQUENT n-grams

    def keyed(seed: int):
        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gathered, about, spoilt, seen = [], [], 0, {}

            def out() -> pa.RecordBatch:
                info = np.array(about, ABOUT)
                return messages([(INFO, np.arange(len(info)) // 4096 * 31 % parts, info), (SPOILT, np.zeros(spoilt, np.int64), info[:spoilt]), *sifted(np.concatenate([np.empty(0, KEY), *gathered]), parts)])

            for batch in batches:
                ids = _ids(batch, 0)
                for at, texts in texts_of(batch):
                    sets = shingle_sets(texts, words)
                    fresh = []
                    for k, s in enumerate(sets):
                        one = ids[at + k]
                        same = one
                        if one is not None and len(s):
                            same = seen.setdefault((len(s), s.tobytes() if len(s) < 3 else (int(s.sum(dtype=np.uint64)), int((s * s ^ s >> U(7)).sum(dtype=np.uint64)))), one)
                            if same == one:
                                fresh.append(k)
                        about.append((one or 0, len(s), same or 0, one is not None))
                    owner, key, bad = keys([sets[k] for k in fresh], seed, percent, frequent.value)
                    spoilt += len(bad)
                    found = np.empty(len(key), KEY)
                    mine = np.array([ids[at + k] for k in fresh], np.int64)
                    found["core"], found["doc"] = key, mine[owner]
                    gathered.append(found)
                if sum(map(len, gathered)) > GATHERED:
                    yield out()
                    gathered, about, spoilt = [], [], 0
                    if len(seen) > 1_000_000:
                        seen = {}
            yield out()

        return run

    @released
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hold() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                other = np.isin(batch.column(1).to_numpy(), (INFO, SPOILT))
                if other.any():
                    kept.append(pa.RecordBatch.from_arrays(batch.filter(pa.array(other)).columns, batch.schema.names))
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(~other)).columns, batch.schema.names)

        kept: list[pa.RecordBatch] = []
        yield from meet_by_core(KEY, parts)(hold())
        yield from kept

    seed = 0
    while True:
        met = written(rows.mapInArrow(keyed(seed), MESSAGE).repartition("bucket").mapInArrow(passing, MESSAGE), "keys")
        if not met.filter(F.col("kind") == SPOILT).limit(1).count():
            break
        seed += 1  # some set had too few classes under this hash

    def opened(kind: np.dtype, columns: list[str]):
        @released
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = unpacked(_ids(batch, 3), kind)
                yield pa.RecordBatch.from_arrays([pa.array(found[c].view("<i8") if found[c].dtype == np.uint64 else found[c].astype(np.int64)) for c in columns], columns)

        return run

    about = written(met.filter(F.col("kind") == INFO).mapInArrow(opened(ABOUT, ["doc", "n", "same", "id"]), "doc long, n long, same long, id long"), "about")
    repeated = met.filter(F.col("kind") == REPEATED)
    keyed_rows = repeated.mapInArrow(opened(KEY, ["core", "doc"]), "core long, doc long")
    order = F.struct(F.xxhash64("doc").alias("h"), F.col("doc").alias("pivot"))
    pivot = keyed_rows.groupBy("core").agg(F.min(order).getField("pivot").alias("pivot"), F.count("*").alias("rows")).withColumnRenamed("core", "of")
    region = spread_join(keyed_rows, "core", pivot, "of", "rows", repeated.agg(F.sum("rows")).first()[0] or 0).select("pivot", "doc").filter("pivot != doc")
    region = written(region.distinct(), "regions")

    discard(met)

    # how many parts a region has
    size = region.groupBy("pivot").agg(F.count("*").alias("members")).withColumnRenamed("pivot", "of")
    split = F.ceil(F.col("members") / MEMBERS).cast("int")
    parted = spread_join(region, "pivot", size.withColumn("rows", F.col("members")), "of", "rows", region.count())
    member = parted.select("pivot", "doc", split.alias("split"), F.pmod(F.xxhash64("doc", "pivot"), split.cast("long")).cast("int").alias("part"), F.lit(0).alias("pivotal"))
    itself = size.select(F.col("of").alias("pivot"), F.col("of").alias("doc"), split.alias("split"), F.explode(F.sequence(F.lit(0), split - 1)).alias("part"), F.lit(1).alias("pivotal"))
    placed = written(member.unionByName(itself), "members")
    discard(region)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [packed_set(s) for _, texts in texts_of(batch) for s in shingle_sets(texts, words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    # Members' sets come straight from the scan: a bitmap of fixed size tells which documents may be members, so texts
    # need no shuffle; the join below is exact and leaves out the few that the bitmap lets through.
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    marked = placed.select(place("doc").alias("at")).groupBy(F.expr("at div 32768").alias("part")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in marked.collect():  # BITS / 32768 rows at most
        bits[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    bitmap = spark.sparkContext.broadcast(bits)

    def members_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((bitmap.value[at >> 3] >> (at & 7)) & 1 == 1))

    near = rows.filter("doc_id IS NOT NULL").withColumn("at", place("doc_id"))
    sets = written(near.mapInArrow(released(lambda batches: sets_of(members_only(batches))), "id long, set binary"), "sets")

    @released
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted (pivot, part, pivotal, doc, split, set, query) -> links (a, b), and with b null the members of split regions that aren't linked to the pivot."""
        rows_, now = [], None

        def solved() -> pa.RecordBatch:
            ids = np.array([r[0] for r in rows_], np.int64)
            members = [unpacked_set(r[1]) for r in rows_]
            asking = np.array([r[3] for r in rows_], bool)
            if asking.any():
                links, _ = linked(members, ids, percent, asking)
                stray: list[int] = []
            else:
                links, group = linked(members, ids, percent)
                stray = ids[group != group[0]].tolist() if rows_[0][2] > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links] + stray, pa.int64()), pa.array([b for _, b in links] + [None] * len(stray), pa.int64()), pa.array([now[0]] * (len(links) + len(stray)), pa.int64())], ["a", "b", "pivot"])

        for batch in batches:
            for p, part, _, doc, parts_, found, query in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (p, part):
                    if len(rows_) > 1:
                        yield solved()
                    rows_, now = [], (p, part)
                rows_.append((doc, found, parts_, query))
        if len(rows_) > 1:
            yield solved()

    def compare(places: DataFrame) -> DataFrame:
        if places.count() <= HANDED:
            places = F.broadcast(places)  # else both sides are sorted by document
        full = places.join(sets, F.col("doc") == F.col("id")).select("pivot", "part", "pivotal", "doc", "split", "set", "query")
        full = full.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.desc("query"), F.desc("pivotal"), "doc")
        return full.mapInArrow(compared, "a long, b long, pivot long")

    first = written(compare(placed.withColumn("query", F.lit(False))), "near")
    links = first.filter("b IS NOT NULL").select("a", "b")
    if (stray := first.filter("b IS NULL")).limit(1).count():
        stray = stray.select("pivot", F.col("a").alias("doc")).distinct()
        turns = stray.groupBy("pivot").agg(F.ceil(F.count("*") / (MEMBERS // 4)).cast("int").alias("turns")).withColumnRenamed("pivot", "of")
        split = placed.filter("split > 1").join(turns, F.col("pivot") == F.col("of"))
        all_ = split.select("pivot", "doc", "split", "pivotal", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.col("part").alias("in"), F.lit(False).alias("query"))
        whole = placed.filter("pivotal = 1").groupBy("pivot").agg(F.max("split").alias("split")).withColumnRenamed("pivot", "p")
        asks = stray.join(turns, F.col("pivot") == F.col("of")).join(whole, F.col("pivot") == F.col("p"))
        asks = asks.select("pivot", "doc", "split", F.lit(0).alias("pivotal"), F.pmod(F.xxhash64("doc"), F.col("turns").cast("long")).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.col("split") - 1)).alias("in"), F.lit(True).alias("query"))
        again = all_.unionByName(asks).withColumn("part", F.col("turn").cast("long") * (1 << 32) + F.col("in"))
        links = links.unionByName(written(compare(again), "stray").filter("b IS NOT NULL").select("a", "b"))
    links = links.unionByName(about.filter("id = 1 AND same != doc").select(F.col("doc").alias("a"), F.col("same").alias("b")))
    found = components(links)
    named = about.join(found, F.col("doc") == F.col("node"), "left")
    return named.select(F.when(F.col("id") == 1, F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id") == 1, F.coalesce("component", "doc")).alias("component_id"))
