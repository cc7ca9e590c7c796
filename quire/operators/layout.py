"""Columns, regions and lists of a page: soft gutters, upright columns, regions put together, votes of groups, hanging lists, segments of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import column
from quire.operators.geometry import PAGE, Union, around, each_page
from quire.operators.sequence import islands

#: Lines of running text that must reach a soft gutter from each side. Fixed value.
COLUMN_LINES = 8


def gutter_of(lines: list[tuple], body: float) -> tuple[float, float] | None:
    """The valley in the projection of a page's lines (x0, x1) onto x that fewest lines cross, then the widest: covered by at
    most 15 % of the lines and a quarter of what covers either side on the mean, with lines of running text up to it on both sides."""
    x0, x1 = (np.array([r[k] for r in lines]) for k in (0, 1))
    left = x0.min()
    a, b = (x0 - left).astype(int), np.ceil(x1 - left).astype(int)
    edge = np.zeros(b.max() + 2, int)
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    cover = np.cumsum(edge)[:-1]

    def runs(low: np.ndarray, offset: int) -> list[tuple[int, int]]:
        turn = np.diff(np.r_[0, low.astype(np.int8), 0])
        return [(s + offset, e + offset) for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True)]

    def text_beside(near: np.ndarray) -> bool:
        long = int((near & (x1 - x0 >= 5 * body)).sum())
        return long >= COLUMN_LINES and 2 * long >= int(near.sum())

    last = int(np.flatnonzero(cover).max()) + 1
    mean = lambda part: part.mean() if len(part) else 0.0
    found = []
    for s, e in runs(cover[:last] <= 0.15 * len(lines), 0):
        limit = 0.25 * min(mean(cover[:s]), mean(cover[e:last]))
        for p, q in runs(cover[s:e] <= limit, s):
            l, r = left + p, left + q
            middle = (x0 + x1) / 2
            if text_beside((middle < l) & (x1 > l - 4 * body)) and text_beside((middle > r) & (x0 < r + 4 * body)):
                found.append((int(((x0 < l) & (x1 > r)).sum()), p - q, float(l), float(r)))
    return min(found)[2:] if found else None


def soft_gutters(lines: DataFrame, body: float = 10.0) -> DataFrame:
    """(doc_id, page, left, right): the soft gutter of pages that have one."""
    return each_page(lines, ["x0", "x1"], lambda rows: [g] if (g := gutter_of(rows, body)) else [], "left double, right double")


def soft_columns(units: DataFrame, lines: DataFrame, body: float = 10.0) -> DataFrame:
    """(doc_id, page, unit, band, side) of pages with a soft gutter: a unit that spans the gutter is a band of its own (side 2); between such units the left column (0) comes before the right one (1)."""
    rows = units.join(soft_gutters(lines, body), PAGE)
    side = F.when((F.col("x0") < F.col("left")) & (F.col("x1") > F.col("right")), 2).when((F.col("x0") + F.col("x1")) / 2 < (F.col("left") + F.col("right")) / 2, 0).otherwise(1)
    by = W.partitionBy(*PAGE).orderBy("y0", "unit")
    rows = rows.withColumn("side", side)
    band = F.coalesce(F.sum((F.col("side") == 2).cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select(*PAGE, "unit", band.alias("band"), "side")


def upright_columns(units: DataFrame, body: float = 10.0) -> DataFrame:
    """(doc_id, page, unit, position): upright units from right to left; narrow ones that share half of the lower width are one column, read from the top, side by side from the right."""

    def run(rows: list[tuple]) -> list[tuple]:
        sets = Union(len(rows))
        narrow = [k for k, r in enumerate(rows) if r[3] - r[1] <= 2 * body]
        for a, i in enumerate(narrow):
            for j in narrow[a + 1 :]:
                if rows[j][1] >= rows[i][3]:
                    break  # sorted by x0: nothing further overlaps
                if min(rows[i][3], rows[j][3]) - rows[j][1] > 0.5 * min(rows[i][3] - rows[i][1], rows[j][3] - rows[j][1]):
                    sets.join(i, j)
        place = {}
        for g in sets.groups():
            edge, first = max(rows[k][3] for k in g), min(rows[k][0] for k in g)
            for k in g:
                place[k] = (-edge, first, int(rows[k][2] // max(1.0, body / 2)), -rows[k][3], rows[k][0])
        return [(rows[k][4], n) for n, k in enumerate(sorted(place, key=place.get))]

    kind = units.schema["unit"].dataType.simpleString()
    rows = units.withColumn("_u", F.col("unit"))
    ordered = each_page(rows.select(*PAGE, F.col("x0").alias("_k"), "x0", "y0", "x1", "_u"), ["_k", "x0", "y0", "x1", "_u"], lambda found: run([(r[4], r[1], r[2], r[3], r[4]) for r in found]), f"unit {kind}, position int")
    return ordered


def merged_regions(units: DataFrame) -> DataFrame:
    """(doc_id, page, unit, into): a unit goes into the first earlier one of its region (region) with type of its size (15 %) in its column, if the two are no
    wider than the wider one and four sizes; others stand for themselves."""

    def run(rows: list[tuple]) -> list[tuple]:
        open_: dict[int, list[list]] = {}
        out = []
        for unit, region, x0, y0, x1, y1, size in rows:
            for o in open_.get(region, []) if region is not None else []:
                low, high = min(o[1], x0), max(o[3], x1)
                if o[1] < x1 and x0 < o[3] and abs(o[5] - size) <= 0.15 * max(o[5], size) and high - low <= max(o[3] - o[1], x1 - x0) + 4 * max(o[5], size):
                    o[1], o[2], o[3], o[4] = low, min(o[2], y0), high, max(o[4], y1)
                    out.append((unit, o[0]))
                    break
            else:
                open_.setdefault(region, []).append([unit, x0, y0, x1, y1, size])
                out.append((unit, unit))
        return out

    kind = units.schema["unit"].dataType.simpleString()
    return each_page(units.withColumn("region", F.col("region").cast("int")), ["unit", "region", "x0", "y0", "x1", "y1", "size"], run, f"unit {kind}, into {kind}")


def group_votes(nodes: DataFrame, links: DataFrame, priority: list[int]) -> DataFrame:
    """(doc_id, page, grp, class, x0, y0, x1, y1, n): nodes (node, class) that links (a, b) connect, the class most of them have
    (of equal ones the first of ``priority``), and the box around them. The group's number is its least node's."""
    both = nodes.select(*PAGE, F.lit(0).alias("kind"), F.col("node").cast("int").alias("a"), F.col("class").cast("int").alias("b"), "x0", "y0", "x1", "y1")
    none = [F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    both = both.unionByName(links.select(*PAGE, F.lit(1).alias("kind"), F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), *none))

    def run(rows: list[tuple]) -> list[tuple]:
        mine = [r for r in rows if not r[0]]
        at, sets = {r[1]: k for k, r in enumerate(mine)}, Union(len(mine))
        for _, a, b, *_ in (r for r in rows if r[0]):
            if a in at and b in at:
                sets.join(at[a], at[b])
        out = []
        for g in sets.groups():
            votes: dict[int, int] = {}
            for k in g:
                votes[mine[k][2]] = votes.get(mine[k][2], 0) + 1
            first = lambda c: priority.index(c) if c in priority else len(priority)
            best = min(votes, key=lambda c: (-votes[c], first(c), c))  # noqa: B023
            out.append((min(mine[k][1] for k in g), best, *around([mine[k][3:] for k in g]), len(g)))
        return sorted(out)

    return each_page(both, ["kind", "a", "b", "x0", "y0", "x1", "y1"], run, "grp int, class int, x0 double, y0 double, x1 double, y1 double, n int")


def opening_headings(lines: DataFrame, body: float = 10.0) -> DataFrame:
    """lines with peeled: the first lines of a unit (column unit) that are short, numbered and no sentence, each a heading of its own; the last line never is."""
    by = W.partitionBy(*PAGE, "unit").orderBy("line_ix")
    right = F.max("x1").over(by.rowsBetween(0, W.unboundedFollowing))
    plain = (F.col("x1") < right - 3 * body) & (F.length(F.trim("text")) <= 60) & column(rules.heading_number, "text").isNotNull() & ~F.trim("text").rlike("[。,、;.]$")
    more = F.lead("line_ix").over(by).isNotNull()
    rows = lines.withColumn("_h", F.coalesce(plain & more, F.lit(False)).cast("int"))
    return rows.withColumn("peeled", F.min("_h").over(by.rowsBetween(W.unboundedPreceding, 0)) == 1).drop("_h")


def hanging(rows: list[tuple], size: float, tolerance: float) -> list[str] | None:
    """The part that each row (x0, x1, opens, last letter), in order, plays in a hanging list: 'start' of an entry, 'indent' or 'other'; null if it is none.

    Rows start at an edge (the leftmost place with several rows) and at an indent within six sizes of it; most are at one of them; the row before one at the edge stops short
    of the right side, the row before an indented one seldom does; and rows at the edge open as entries do.
    """
    n = len(rows)
    if n < 4:
        return None
    places: list[list] = []
    for x in sorted(r[0] for r in rows):
        if places and x - places[-1][0] <= tolerance:
            places[-1][1] += 1
        else:
            places.append([x, 1])
    edge = next((x for x, k in places if k >= max(2, n * 12 // 100)), None)
    inner = [] if edge is None else [p for p in places if tolerance < p[0] - edge <= 6 * size]
    if not inner:
        return None
    indent = max(reversed(inner), key=lambda p: p[1])[0]
    where = ["off" if x < edge - tolerance or x > edge + 6 * size else "edge" if x < (edge + indent) / 2 else "indent" for x, *_ in rows]
    if min(where.count("edge"), where.count("indent")) < 2 or where.count("off") * 100 > n * 15:
        return None
    right = sorted(r[1] for r in rows)[n * 85 // 100]
    short = [r[1] < right - size for r in rows]
    rate = lambda p: (lambda ks: sum(short[k - 1] for k in ks) / max(1, len(ks)))([k for k in range(1, n) if where[k] == p])
    opening = [rows[k][2] for k in range(1, n) if where[k] == "edge"]
    if rate("edge") < 0.6 or rate("edge") - rate("indent") < 0.3 or sum(opening) * 4 < len(opening) * 3:
        return None
    starts = lambda k: where[k] == "edge" and rows[k][2] and (k == 0 or short[k - 1] or rows[k - 1][3] in "}]")
    return ["start" if starts(k) else "indent" if where[k] == "indent" else "other" for k in range(n)]


def hanging_lists(lines: DataFrame, size: float = 10.0, scan: bool = False) -> DataFrame:
    """(doc_id, page, line_ix, part) of pages that are a hanging list."""
    rows = lines.select(*PAGE, "line_ix", "x0", "x1", column(rules.opens_entry, "text").alias("opens"), F.right(F.rtrim("text"), F.lit(1)).alias("end"))

    def run(page: list[tuple]) -> list[tuple]:
        parts = hanging([r[1:] for r in page], size, (0.5 if scan else 0.3) * size)
        return [] if parts is None else [(r[0], p) for r, p in zip(page, parts, strict=True)]

    kind = lines.schema["line_ix"].dataType.simpleString()
    return each_page(rows, ["line_ix", "x0", "x1", "opens", "end"], run, f"line_ix {kind}, part string")


def segments(chars: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, segment, x0, y0, x1, y1, text): lines cut where characters are six tenths of the line's median size
    (4 at least) apart; white space only parts words, and "^" opens what is raised."""
    line = [*PAGE, "line_ix"]
    sizes = chars.groupBy(*line).agg(F.array_sort(F.collect_list("size")).alias("s"), ((F.min("y0") + F.max("y1")) / 2).alias("mid"))
    sizes = sizes.select(*line, "mid", F.get("s", F.floor(F.size("s") / 2).cast("int")).alias("med"))
    by = W.partitionBy(*line).orderBy("char_ix")
    rows = chars.join(sizes, line).withColumn("_space", F.coalesce(F.lag(F.trim("c") == "").over(by), F.lit(False))).filter("trim(c) != ''")
    rows = rows.withColumn("_sup", (F.col("size") < 0.8 * F.col("med")) & ((F.col("y0") + F.col("y1")) / 2 < F.col("mid") - 0.1 * F.col("med")))
    rows = rows.withColumns({"_opens": F.col("_sup") & ~F.coalesce(F.lag("_sup").over(by), F.lit(False)), "_far": F.col("x0") - F.lag("x1").over(by) >= 0.6 * F.greatest("med", F.lit(4.0))})
    cut = islands(rows, line, ["char_ix"], F.col("_far"), "segment").withColumn("_first", F.row_number().over(W.partitionBy(*line, "segment").orderBy("char_ix")) == 1)
    piece = F.concat(F.when(F.col("_space") & ~F.col("_first"), " ").otherwise(""), F.when(F.col("_opens"), "^").otherwise(""), F.col("c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_ix", piece.alias("p")))), lambda s: s["p"]), "")
    return cut.groupBy(*line, "segment").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), text.alias("text"))


def ink_boxes(chars: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, x0, y0, x1, y1): the box around a line's visible characters, or around all where none is."""
    seen = F.trim("c") != ""
    side = lambda f, c: F.coalesce(f(F.when(seen, F.col(c))), f(c)).alias(c)
    return chars.groupBy(*PAGE, "line_ix").agg(side(F.min, "x0"), side(F.min, "y0"), side(F.max, "x1"), side(F.max, "y1"))


def turned_pages(lines: DataFrame, least: int = 40) -> DataFrame:
    """(doc_id, page, turned): whether a page's text is set sideways: so many characters on turned lines, and three times as many as on upright ones."""
    count = lambda c: F.sum(F.when(c, F.length("text")).otherwise(0))
    return lines.groupBy(*PAGE).agg(((count(F.col("turned")) >= least) & (count(F.col("turned")) > 3 * count(~F.col("turned")))).alias("turned"))
