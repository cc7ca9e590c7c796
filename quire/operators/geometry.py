"""Boxes on pages: overlap, containment, neighbours, islands on an axis, tables, reading order.

Joins always have (doc_id, page) for a key, so that a page is the most that meets a page. What recurses or is greedy
(reading order, suppression) streams the pages in order through one pass (:func:`each_page`), a page at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
#: Rows that a batch of results has, at least.
BATCH = 8192


def each_page(df: DataFrame, columns: list[str], run: Callable[[list[tuple]], list[tuple]], result: str) -> DataFrame:
    """(doc_id, page, result): ``run`` gets the ``columns`` of a page's rows, sorted by them, and gives rows of ``result``.

    Pages are dealt out and sorted by Spark and then streamed; only one is held at a time.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = f"doc_id {types['doc_id']}, page {types['page']}, {result}"
    empty = df.sparkSession.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(empty.schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], arrow.names)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for rows in batches:
            for row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if row[:2] != now:
                    if held:
                        out += [(*now, *r) for r in run(held)]
                    now, held = row[:2], []
                    if len(out) >= BATCH:
                        yield batch(out)
                        out = []
                held.append(row[2:])
        if held:
            out += [(*now, *r) for r in run(held)]
        if out:
            yield batch(out)

    return df.select(*PAGE, *columns).repartition(*PAGE).sortWithinPartitions(*PAGE, *columns).mapInArrow(over, schema)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1"))


def area(b: tuple) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def shared_area(a: tuple, b: tuple) -> Column:
    return overlap(a[0], a[2], b[0], b[2]) * overlap(a[1], a[3], b[1], b[3])


def overlap_share(a: tuple, b: tuple) -> Column:
    """The share of the first box's area that the second covers."""
    return shared_area(a, b) / F.greatest(area(a), F.lit(1e-3))


def iou(a: tuple, b: tuple) -> Column:
    return shared_area(a, b) / (area(a) + area(b) - shared_area(a, b))


def contains(b: tuple, x: Column, y: Column) -> Column:
    """Half-open: the right and lower edges are outside."""
    return (x >= b[0]) & (x < b[2]) & (y >= b[1]) & (y < b[3])


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0.0) -> DataFrame:
    """(keys, start, end, n): intervals that touch or lie within ``gap`` merged; running maximum and a cumulative sum, no self-join."""
    df = df.groupBy(*keys, start, end).agg(F.count("*").alias("_n"))  # equal intervals are one
    by = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)).withColumn("_group", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_group").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("_n").alias("n")).drop("_group")


def gutters(df: DataFrame, keys: list[str], gap: float = 3.0) -> DataFrame:
    """(keys, left, right): empty stretches of the x axis between columns."""
    merged = merge_intervals(df, keys, "x0", "x1", gap)
    return merged.select(*keys, F.col("x1").alias("left"), F.lead("x0").over(W.partitionBy(*keys).orderBy("x0")).alias("right")).filter("right IS NOT NULL")


def coverage_gaps(df: DataFrame, keys: list[str], share: int = 5, least: int = 3) -> DataFrame:
    """(keys, cut): the middles of stretches, at least ``least`` points wide, that at most a ``share``-th of the rows cover: columns of a table. Each row's stretches are merged and
    their ends summed up along the axis; pages are dealt out once, and neither exploded into points nor gathered."""
    dealt = df.select(*keys, "row_ix", F.floor("x0").cast("int").alias("a"), F.greatest(F.floor("x0") + 1, F.ceil("x1")).cast("int").alias("b"), F.ceil("x1").cast("int").alias("c")).repartition(*keys)
    page = dealt.groupBy(*keys).agg(F.countDistinct("row_ix").alias("rows"), F.max("c").alias("c"))
    merged = merge_intervals(dealt, [*keys, "row_ix"], "a", "b").join(page, keys).withColumn("b", F.least("b", "c")).filter("a < b")
    ends = merged.select(*keys, "rows", F.inline(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("d")), F.struct(F.col("b").alias("x"), F.lit(-1).alias("d")))))
    by = W.partitionBy(*keys)
    along = by.orderBy("x")
    allowed = F.when(F.col("rows") >= 3, F.greatest(F.lit(1), F.floor(F.col("rows") / share))).otherwise(0)
    parts = ends.groupBy(*keys, "rows", "x").agg(F.sum("d").alias("d")).withColumns({"n": F.sum("d").over(along.rowsBetween(W.unboundedPreceding, 0)), "to": F.lead("x").over(along)}).filter("to IS NOT NULL").withColumn("full", F.col("n") > allowed)
    placed = parts.withColumns({"run": F.sum(F.col("full").cast("int")).over(along.rowsBetween(W.unboundedPreceding, 0)), "first": F.min(F.when(F.col("full"), F.col("x"))).over(by), "last": F.max(F.when(F.col("full"), F.col("to"))).over(by)})
    runs = placed.filter("NOT full AND x >= first AND to <= last").groupBy(*keys, "run").agg(F.min("x").alias("a"), F.max("to").alias("b"))
    return runs.filter(F.col("b") - F.col("a") >= least).select(*keys, ((F.col("a") + F.col("b")) / 2).alias("cut"))


def region_vote(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """(line columns, region): the region that shares the most area with a line; of equal ones the smallest number."""
    r = regions.select(*PAGE, F.col("region"), *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    hit = lines.join(r, PAGE).withColumn("a", shared_area(box(), box("r"))).filter("a > 0")
    return hit.groupBy(*PAGE, "line_ix").agg(F.max(F.struct("a", (-F.col("region")).alias("r"))).alias("m")).select(*PAGE, "line_ix", (-F.col("m.r")).alias("region"))


def first_link(points: DataFrame, links: DataFrame) -> DataFrame:
    """(point_ix, link): the first link whose box holds the point, or null."""
    r = links.select(*PAGE, "link_ix", *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    hit = points.join(r, PAGE).filter(contains(box("r"), F.col("x"), F.col("y"))).groupBy(*PAGE, "point_ix").agg(F.min("link_ix").alias("link"))
    return points.select(*PAGE, "point_ix").join(hit, [*PAGE, "point_ix"], "left")


def smallest_holder(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(line_ix, block): the block of the smallest area that holds the line's centre."""
    r = blocks.select(*PAGE, "block", *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    hit = lines.join(r, PAGE).filter(contains(box("r"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2))
    return hit.groupBy(*PAGE, "line_ix").agg(F.min(F.struct(area(box("r")).alias("a"), "block")).alias("m")).select(*PAGE, "line_ix", F.col("m.block").alias("block"))


def neighbours(lines: DataFrame) -> DataFrame:
    """(line_ix, direction, other, gap): the nearest line above, below, left and right that shares part of the other axis; of equal ones the smallest number."""
    o = lines.select(*PAGE, F.col("line_ix").alias("other"), *(F.col(c).alias("o" + c) for c in ("x0", "y0", "x1", "y1")))
    pair = lines.join(o, PAGE).filter("line_ix != other")
    across = overlap(F.col("x0"), F.col("x1"), F.col("ox0"), F.col("ox1")) > 0
    beside = overlap(F.col("y0"), F.col("y1"), F.col("oy0"), F.col("oy1")) > 0
    direction = F.when(across & (F.col("oy0") >= F.col("y1")), "below").when(across & (F.col("oy1") <= F.col("y0")), "above").when(beside & (F.col("ox0") >= F.col("x1")), "right").when(beside & (F.col("ox1") <= F.col("x0")), "left")
    gap = F.when(direction == "below", F.col("oy0") - F.col("y1")).when(direction == "above", F.col("y0") - F.col("oy1")).when(direction == "right", F.col("ox0") - F.col("x1")).otherwise(F.col("x0") - F.col("ox1"))
    found = pair.select(*PAGE, "line_ix", "other", direction.alias("direction"), gap.alias("gap")).filter("direction IS NOT NULL")
    return found.groupBy(*PAGE, "line_ix", "direction").agg(F.min(F.struct("gap", "other")).alias("m")).select(*PAGE, "line_ix", "direction", F.col("m.other").alias("other"), F.col("m.gap").alias("gap"))


def column_edges(lines: DataFrame) -> DataFrame:
    """(line_ix, first, last): whether no other line stands above or below it in its column."""
    near = neighbours(lines)
    sides = near.groupBy(*PAGE, "line_ix").agg(F.bool_or(F.col("direction") == "above").alias("a"), F.bool_or(F.col("direction") == "below").alias("b"))
    return lines.select(*PAGE, "line_ix").join(sides, [*PAGE, "line_ix"], "left").select(*PAGE, "line_ix", (~F.coalesce("a", F.lit(False))).alias("first"), (~F.coalesce("b", F.lit(False))).alias("last"))


def caption_gap(f: tuple, c: tuple) -> Column:
    """How far a figure is from a caption: above it counts once, below 1.2 times, beside 1.5 times; null elsewhere."""
    across = overlap(f[0], f[2], c[0], c[2]) > 0.3 * F.least(f[2] - f[0], c[2] - c[0])
    beside = overlap(f[1], f[3], c[1], c[3]) > 0.3 * F.least(f[3] - f[1], c[3] - c[1])
    vertical = F.when(f[3] <= c[1] + 2, c[1] - f[3]).when(f[1] >= c[3] - 2, (f[1] - c[3]) * 1.2)
    return F.when(across, vertical).when(beside, F.when(f[2] <= c[0], c[0] - f[2]).otherwise(F.greatest(f[0] - c[2], F.lit(0)) * 1.5))


def nearest_caption(figures: DataFrame, captions: DataFrame, height: float) -> DataFrame:
    """(caption, figure, gap): each caption's nearest figure within a fifth of the page."""
    c = captions.select(*PAGE, "caption", *(F.col(x).alias("c" + x) for x in ("x0", "y0", "x1", "y1")))
    pair = figures.join(c, PAGE).withColumn("gap", caption_gap(box(), box("c"))).filter(F.col("gap") < height * 0.2)
    return pair.groupBy(*PAGE, "caption").agg(F.min(F.struct("gap", "figure")).alias("m")).select(*PAGE, "caption", F.col("m.figure").alias("figure"), F.col("m.gap").alias("gap"))


def node_at(anchors: DataFrame, positions: DataFrame) -> DataFrame:
    """(doc_id, pos_ix, node): the first node at or after a position (page, y), 0 if there is none: an as-of join in one window over both sides, without a range join."""
    a = anchors.select("doc_id", "page", "y", F.lit(None).cast("long").alias("pos_ix"), F.col("node_ix").alias("node"))
    p = positions.select("doc_id", "page", (F.col("y") - 4).alias("y"), F.col("pos_ix").cast("long"), F.lit(None).cast("int").alias("node"))
    by = W.partitionBy("doc_id").orderBy("page", "y", F.col("pos_ix").isNull().cast("int")).rowsBetween(0, W.unboundedFollowing)
    return a.unionByName(p).withColumn("at", F.first("node", ignorenulls=True).over(by)).filter("pos_ix IS NOT NULL").select("doc_id", "pos_ix", F.coalesce("at", F.lit(0)).alias("node"))


def suppressed(rows: list[tuple], most: float = 0.4) -> list[tuple]:
    """Of a page's detections (box_ix, x0, y0, x1, y1, confidence), those that stay: by falling confidence, one that shares more
    than ``most`` of the smaller box with kept ones goes, unless it is the whole that all of these are parts of: as
    thick (within 1.3), larger (by 1.3) and holding seven tenths of each; then they go."""
    kept: list[tuple] = []
    area = lambda r: max((r[3] - r[1]) * (r[4] - r[2]), 1e-3)
    shared = lambda r, k: max(0.0, min(r[3], k[3]) - max(r[1], k[1])) * max(0.0, min(r[4], k[4]) - max(r[2], k[2]))
    for r in sorted(rows, key=lambda r: (-r[5], r[0])):
        over = [k for k in kept if shared(r, k) > most * min(area(r), area(k))]
        upright = r[4] - r[2] > r[3] - r[1]
        thick = lambda k: k[3] - k[1] if upright else k[4] - k[2]  # noqa: B023, E731
        if all(shared(r, k) > 0.7 * area(k) and thick(r) <= 1.3 * thick(k) and area(r) > 1.3 * area(k) for k in over):
            kept = [k for k in kept if k not in over] + [r]
    return kept


def suppress(df: DataFrame, most: float = 0.4) -> DataFrame:
    """(doc_id, page, box_ix, x0, y0, x1, y1, confidence) of the detections that :func:`suppressed` keeps."""
    kind = df.schema["box_ix"].dataType.simpleString()
    return each_page(df, ["box_ix", "x0", "y0", "x1", "y1", "confidence"], lambda rows: suppressed(rows, most), f"box_ix {kind}, x0 double, y0 double, x1 double, y1 double, confidence double")


def _cuts(rows: list[tuple], axis: int, gap: float) -> list[list[tuple]]:
    """Groups that an empty band wider than ``gap`` parts along an axis."""
    groups: list[list[tuple]] = []
    end = float("-inf")
    for r in sorted(rows, key=lambda r: (r[1 + axis], r[0])):
        if not groups or r[1 + axis] > end + gap:
            groups.append([])
        groups[-1].append(r)
        end = max(end, r[3 + axis])
    return groups


def xy_cut(rows: list[tuple], columns: float = 6.0, bands: float = 3.0, depth: int = 0) -> list[int]:
    """Reading order of boxes (id, x0, y0, x1, y1): columns first, then bands that don't part the same columns; overlapping ones by place."""
    if len(rows) <= 1 or depth > 64:
        return [r[0] for r in rows]
    groups = _cuts(rows, 0, columns)
    if len(groups) == 1:
        groups = []
        for band in _cuts(rows, 1, bands):
            if groups and _same_columns(groups[-1], band, columns):
                groups[-1] += band
            else:
                groups.append(band)
    if len(groups) == 1:
        return [r[0] for r in sorted(rows, key=lambda r: (r[2], r[1], r[0]))]
    return [i for g in groups for i in xy_cut(g, columns, bands, depth + 1)]


def _same_columns(above: list[tuple], below: list[tuple], gap: float) -> bool:
    def gaps(rows: list[tuple]) -> list[tuple[float, float]]:
        groups = _cuts(rows, 0, gap)
        return [(max(r[3] for r in a), min(r[1] for r in b)) for a, b in zip(groups, groups[1:], strict=False)]

    a, b = gaps(above), gaps(below)
    if not a:
        return False
    if not b:
        return all(r[3] <= g[1] or r[1] >= g[0] for r in below for g in a)
    return len(a) == len(b) and all(max(x[0], y[0]) < min(x[1], y[1]) for x, y in zip(a, b, strict=True))


def reading_order(units: DataFrame) -> DataFrame:
    """(doc_id, page, unit, position) by recursive cuts."""
    kind = units.schema["unit"].dataType.simpleString()
    return each_page(units, ["unit", "x0", "y0", "x1", "y1"], lambda rows: [(i, k) for k, i in enumerate(xy_cut(rows))], f"unit {kind}, position int")


class Union:
    """Sets that are joined."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.root(i)] = self.root(j)

    def groups(self) -> list[list[int]]:
        out: dict[int, list[int]] = {}
        for i in range(len(self.parent)):
            out.setdefault(self.root(i), []).append(i)
        return list(out.values())


def touching(rows: list[tuple], grow: float) -> list[list[int]]:
    """Groups of boxes (x0, y0, x1, y1; sorted) that touch when grown, by a sweep along x."""
    sets, live = Union(len(rows)), []
    for i, r in enumerate(rows):
        live = [j for j in live if rows[j][2] + 2 * grow >= r[0]]
        for j in live:
            if min(r[3], rows[j][3]) + 2 * grow >= max(r[1], rows[j][1]):
                sets.join(i, j)
        live.append(i)
    return sets.groups()


def around(rows: list[tuple]) -> tuple[float, float, float, float]:
    """The box around boxes."""
    return min(r[0] for r in rows), min(r[1] for r in rows), max(r[2] for r in rows), max(r[3] for r in rows)


def clusters(boxes: DataFrame, grow: float = 4.0, least: int = 5) -> DataFrame:
    """(doc_id, page, cluster, x0, y0, x1, y1, n): boxes that touch when grown, joined; groups of ``least`` and more."""

    def run(rows: list[tuple]) -> list[tuple]:
        found = sorted((*around([rows[i] for i in g]), len(g)) for g in touching(rows, grow) if len(g) >= least)
        return [(k, *r) for k, r in enumerate(found)]

    return each_page(boxes, ["x0", "y0", "x1", "y1"], run, "cluster int, x0 double, y0 double, x1 double, y1 double, n int")


def merged_pictures(boxes: DataFrame, least: float = 0.2) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, n): pictures whose intersection is more than ``least`` of their union, joined, and what joins them."""

    def run(rows: list[tuple]) -> list[tuple]:
        sets, live = Union(len(rows)), []
        area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        for i, r in enumerate(rows):
            live = [j for j in live if rows[j][2] > r[0]]
            for j in live:
                shared = max(0.0, min(r[2], rows[j][2]) - r[0]) * max(0.0, min(r[3], rows[j][3]) - max(r[1], rows[j][1]))
                if shared > least * (area(r) + area(rows[j]) - shared):
                    sets.join(i, j)
            live.append(i)
        return sorted((*around([rows[i] for i in g]), len(g)) for g in sets.groups())

    return each_page(boxes, ["x0", "y0", "x1", "y1"], run, "x0 double, y0 double, x1 double, y1 double, n int")


def merged_figures(figures: DataFrame, texts: DataFrame, body: float = 10.0) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, n): figures that overlap by half of either, or are stacked or side by side with
    no more than a narrow gap and no text between them, are one, until nothing changes."""
    both = figures.select(*PAGE, F.lit(0).alias("text"), "x0", "y0", "x1", "y1").unionByName(texts.select(*PAGE, F.lit(1).alias("text"), "x0", "y0", "x1", "y1"))

    def run(rows: list[tuple]) -> list[tuple]:
        words = [r[1:] for r in rows if r[0]]
        merged: list[tuple] = []
        for f in ((*r[1:], 1) for r in rows if not r[0]):
            while (j := next((j for j, o in enumerate(merged) if one_figure(f, o, words, body)), None)) is not None:
                o = merged.pop(j)
                f = (*around([f, o]), f[4] + o[4])
            merged.append(f)
        return sorted(merged)

    return each_page(both, ["text", "x0", "y0", "x1", "y1"], run, "x0 double, y0 double, x1 double, y1 double, n int")


def one_figure(a: tuple, b: tuple, texts: list[tuple], body: float) -> bool:
    """Whether two figures are parts of one."""
    length = lambda k: max(0.0, min(a[k + 2], b[k + 2]) - max(a[k], b[k]))
    area = lambda r: max((r[2] - r[0]) * (r[3] - r[1]), 1e-3)
    if length(0) * length(1) > 0.5 * min(area(a), area(b)):
        return True
    for along, across, most in ((1, 0, 1.5 * body), (0, 1, 0.8 * body)):  # stacked, then side by side
        first, second = sorted((a, b), key=lambda r: r[along])
        gap = second[along] - first[along + 2]
        if length(across) > 0.6 * min(a[across + 2] - a[across], b[across + 2] - b[across]) and gap < most:
            band = [0.0] * 4
            band[along], band[along + 2] = first[along + 2], second[along]
            band[across], band[across + 2] = max(a[across], b[across]), min(a[across + 2], b[across + 2])
            if not any(t[across] < band[across + 2] and t[across + 2] > band[across] and t[along] < band[along + 2] - 1 and t[along + 2] > band[along] + 1 for t in texts):
                return True
    return False


def absorbed_labels(figures: DataFrame, labels: DataFrame, body: float = 10.0, rounds: int = 4) -> DataFrame:
    """(doc_id, page, label, figure): labels that lie by four fifths in a figure grown by 2.5 sizes, the first that has
    them; a figure grows by its labels, so that chains follow, in so many rounds at most."""
    both = figures.select(*PAGE, F.lit(0).alias("kind"), F.col("figure").cast("int").alias("id"), "x0", "y0", "x1", "y1").unionByName(labels.select(*PAGE, F.lit(1).alias("kind"), F.col("label").cast("int").alias("id"), "x0", "y0", "x1", "y1"))

    def run(rows: list[tuple]) -> list[tuple]:
        boxes = {r[1]: r[2:] for r in rows if not r[0]}
        left, out, m = [r[1:] for r in rows if r[0]], [], 2.5 * body
        for _ in range(rounds):
            rest = []
            for one, *t in left:
                size = max((t[2] - t[0]) * (t[3] - t[1]), 1e-3)
                inside = lambda f: max(0.0, min(t[2], f[2] + m) - max(t[0], f[0] - m)) * max(0.0, min(t[3], f[3] + m) - max(t[1], f[1] - m))  # noqa: B023, E731
                for name, f in boxes.items():
                    if inside(f) > 0.8 * size:
                        boxes[name] = around([f, t])
                        out.append((one, name))
                        break
                else:
                    rest.append((one, *t))
            if len(rest) == len(left):
                break
            left = rest
        return sorted(out)

    return each_page(both, ["kind", "id", "x0", "y0", "x1", "y1"], run, "label int, figure int")


def open_captions(captions: DataFrame, figures: DataFrame, texts: DataFrame, body: float = 10.0, head: float = 24.0) -> DataFrame:
    """(doc_id, page, caption, x0, y0, x1, y1): the space above a caption that has no figure near it, up to the nearest text above
    or the page's head, where it is high enough to hold a figure. Two aggregations over joins by page."""
    c = captions.select(*PAGE, "caption", *(F.col(x).alias("c" + x) for x in ("x0", "y0", "x1", "y1")))
    across = overlap(F.col("x0"), F.col("x1"), F.col("cx0"), F.col("cx1")) > 0
    beside = overlap(F.col("y0"), F.col("y1"), F.col("cy0"), F.col("cy1")) > 0
    near = (across & (F.least(F.abs(F.col("cy0") - F.col("y1")), F.abs(F.col("y0") - F.col("cy1"))) < 4 * body)) | (beside & (F.least(F.abs(F.col("cx0") - F.col("x1")), F.abs(F.col("x0") - F.col("cx1"))) < 4 * body))
    taken = figures.select(*PAGE, "x0", "y0", "x1", "y1").join(c, PAGE).filter(near).select(*PAGE, "caption").distinct()
    open_ = c.join(taken, [*PAGE, "caption"], "left_anti")
    above = texts.select(*PAGE, "x0", "y0", "x1", "y1").join(c, PAGE).filter((F.col("y1") <= F.col("cy0") + 1) & (F.col("x0") < F.col("cx1")) & (F.col("x1") > F.col("cx0"))).groupBy(*PAGE, "caption").agg(F.max("y1").alias("top"))
    top = F.greatest(F.coalesce("top", F.lit(head)), F.lit(head)) + 2
    return open_.join(above, [*PAGE, "caption"], "left").select(*PAGE, "caption", F.col("cx0").alias("x0"), top.alias("y0"), F.col("cx1").alias("x1"), (F.col("cy0") - 2).alias("y1")).filter(F.col("y1") - F.col("y0") >= max(4 * body, 40.0))


def paired_captions(figures: DataFrame, captions: DataFrame, height: float) -> DataFrame:
    """(caption, figure, gap): captions in order, each with its nearest figure that no earlier one has, within a fifth of the page."""
    c = captions.select(*PAGE, F.col("caption").cast("int").alias("caption"), *(F.col(x).alias("c" + x) for x in ("x0", "y0", "x1", "y1")))
    pair = figures.withColumn("figure", F.col("figure").cast("int")).join(c, PAGE).withColumn("gap", caption_gap(box(), box("c")).cast("double")).filter(F.col("gap") < height * 0.2)

    def run(rows: list[tuple]) -> list[tuple]:
        taken, out = set(), {}
        for caption, gap, figure in rows:  # sorted so
            if caption not in out and figure not in taken:
                taken.add(figure)
                out[caption] = (caption, figure, gap)
        return list(out.values())

    return each_page(pair, ["caption", "gap", "figure"], run, "caption int, figure int, gap double")


def row_bands(rows: list[tuple]) -> list[int]:
    """Numbers of the rows that boxes (…, y0, y1; sorted by their middles) make: a box joins the band so far if it shares two fifths of the lower height."""
    number, top, bottom, out = -1, 0.0, 0.0, []
    for y0, y1 in rows:
        h = max(1.0, y1 - y0)
        if number >= 0 and min(bottom, y1) - max(top, y0) > min(h, bottom - top) * 0.4:
            top, bottom = min(top, y0), max(bottom, y1)
        else:
            number, top, bottom = number + 1, y0, y1
        out.append(number)
    return out


def table_rows(segments: DataFrame) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, text, row_ix): segments in rows."""
    placed = segments.withColumn("_c", (F.col("y0") + F.col("y1")) / 2)

    def run(rows: list[tuple]) -> list[tuple]:
        return [(*r[1:], k) for r, k in zip(rows, row_bands([(r[2], r[4]) for r in rows]), strict=True)]

    return each_page(placed, ["_c", "x0", "y0", "x1", "y1", "text"], run, "x0 double, y0 double, x1 double, y1 double, text string, row_ix int")


def ruled_columns(rulings: DataFrame, region: DataFrame) -> DataFrame:
    """(doc_id, page, cut): upright rulings, thinner than 2.5, that stand over more than half of the table's height, three points apart."""
    r = region.select(*PAGE, *(F.col(c).alias("r" + c) for c in ("x0", "y0", "x1", "y1")))
    x = (F.col("x0") + F.col("x1")) / 2
    upright = rulings.join(r, PAGE).filter((F.col("x1") - F.col("x0") < 2.5) & (F.col("y1") - F.col("y0") > 0.5 * (F.col("ry1") - F.col("ry0"))))
    inside = upright.select(*PAGE, x.alias("cut")).join(r, PAGE).filter((F.col("cut") > F.col("rx0") + 3) & (F.col("cut") < F.col("rx1") - 3))
    return merge_intervals(inside.select(*PAGE, F.col("cut").alias("a"), F.col("cut").alias("b")), PAGE, "a", "b", 2.999).select(*PAGE, F.col("a").alias("cut"))


def joined_cells(cells: Column) -> Column:
    """Texts of one cell with a space between them, but not beside Japanese."""
    return F.regexp_replace(F.array_join(cells, " "), r"(?<=[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}]) | (?=[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF00}-\x{FFEF}])", "")


def table_cells(segments: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, row_ix, col, text, spans): segments in rows and columns; columns by rulings where there are any, else
    where few rows have text; ``spans`` says whether one of a cell's segments reaches into another column. Rows that carry on the one above
    (first cell empty, fewer cells than the table's median row, close below) are that row's."""
    rows = table_rows(segments.filter("trim(text) != ''"))
    cuts = coverage_gaps(rows, PAGE)
    if rulings is not None:
        region = rows.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        ruled = ruled_columns(rulings, region)
        cuts = cuts.join(ruled.select(*PAGE).distinct(), PAGE, "left_anti").unionByName(ruled)
    cuts = cuts.groupBy(*PAGE).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    at = lambda x: F.size(F.filter("cuts", lambda c: x > c))
    placed = rows.join(cuts, PAGE, "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>")))
    placed = placed.withColumns({"col": at(F.col("x0") + 0.5), "to": at(F.col("x1") - 0.5), "last": F.size("cuts")})
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x0", F.trim("text").alias("text")))), lambda s: s["text"])
    cell = placed.groupBy(*PAGE, "row_ix", "col", "last").agg(joined_cells(ordered).alias("text"), F.sum((F.col("to") != F.col("col")).cast("int")).alias("spans"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    row = cell.groupBy(*PAGE, "row_ix", "last").agg(F.count("*").alias("filled"), F.min("col").alias("first"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    median = row.groupBy(*PAGE).agg(F.array_sort(F.collect_list("filled")).alias("f")).select(*PAGE, F.get("f", F.floor(F.size("f") / 2).cast("int")).alias("typical"))
    by = W.partitionBy(*PAGE).orderBy("row_ix")
    close = F.col("y0") - F.lag("y1").over(by) < 0.6 * F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))
    row = row.join(median, PAGE).withColumn("_on", F.coalesce((F.col("last") > 0) & (F.col("first") > 0) & (F.col("filled") < F.col("typical")) & close, F.lit(False)))
    row = row.withColumn("whole", F.sum((~F.col("_on")).cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)) - 1).select(*PAGE, "row_ix", F.greatest("whole", F.lit(0)).cast("int").alias("whole"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("row_ix", "text"))), lambda s: s["text"])
    return cell.join(row, [*PAGE, "row_ix"]).groupBy(*PAGE, F.col("whole").alias("row_ix"), "col", "last").agg(joined_cells(parts).alias("text"), F.sum("spans").cast("int").alias("spans"))


def build_table(segments: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, row_ix, cells): the rows of :func:`table_cells`, empty cells filled in."""
    by_row = table_cells(segments, rulings).groupBy(*PAGE, "row_ix", "last").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    return by_row.select(*PAGE, "row_ix", F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.element_at("m", i), F.lit(""))).alias("cells"))


def table_issues(segments: DataFrame, rulings: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, issue, n): what looks wrong with a page's table: too small, rows with fewer cells than the median row
    by more than one, texts that span columns, cells without a number in columns of numbers."""
    from quire.functions import text as rules
    from quire.functions.dialect import column

    cells = table_cells(segments, rulings)
    row = cells.groupBy(*PAGE, "row_ix", "last").agg(F.count("*").alias("filled"), F.sum("spans").alias("spans"))
    page = row.groupBy(*PAGE, "last").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list("filled")).alias("f"), F.sum("spans").alias("spans"))
    page = page.withColumn("typical", F.get("f", F.floor(F.size("f") / 2).cast("int"))).withColumn("odd", F.size(F.filter("f", lambda n: n + 1 < F.col("typical"))))
    numbers = cells.filter("row_ix > 0 AND text != ''").withColumn("num", column(rules.looks_numeric, "text").cast("int")).groupBy(*PAGE, "col").agg(F.count("*").alias("n"), F.sum("num").alias("num"))
    mixed = numbers.filter("n >= 4 AND num * 10 >= n * 7 AND num < n").groupBy(*PAGE).agg(F.sum(F.col("n") - F.col("num")).alias("mixed"))
    page = page.join(mixed, PAGE, "left")
    found = {"small": F.when((F.col("rows") < 2) | (F.col("last") < 1), F.col("rows")), "uneven": F.when((F.col("odd") > 0) & (F.col("rows") > 2), F.col("odd")), "spanning": F.when(F.col("spans") > 0, F.col("spans")), "mixed": F.col("mixed")}
    return page.select(*PAGE, F.inline(F.array(*(F.struct(F.lit(k).alias("issue"), v.cast("long").alias("n")) for k, v in found.items())))).filter("n IS NOT NULL")
