"""Lines and nodes in their order: recognised blocks, rows, runs, formulas, headings that were cut, swallowed or lost their number.

``lines``: doc_id, page, line_ix, text, x0, y0, x1, y1, size. ``nodes``: doc_id, node_ix, kind, level, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import CJK, column
from quire.operators.geometry import PAGE, each_page, merge_intervals
from quire.operators.sequence import islands


def distinct_boxes(lines: DataFrame) -> DataFrame:
    """Of lines on one box the first."""
    by = W.partitionBy(*PAGE, "x0", "y0", "x1", "y1").orderBy("line_ix")
    return lines.withColumn("_k", F.row_number().over(by)).filter("_k = 1").drop("_k")


def recognised_blocks(lines: DataFrame) -> DataFrame:
    """lines with run: neighbours of one block (column block) are together; a line without a block is alone."""
    by = W.partitionBy(*PAGE).orderBy("line_ix")
    return islands(lines, PAGE, ["line_ix"], F.coalesce(F.col("block") != F.lag("block").over(by), F.lit(True)), "run")


def recognised_paragraphs(lines: DataFrame) -> DataFrame:
    """lines with run and para: within a run a new paragraph where a line is indented by seven tenths of its height, follows one that
    ends 1.5 heights before the run's edge, or stands 1.5 heights below it; in upright runs the same along the other axis."""
    rows = recognised_blocks(lines)
    run, by = W.partitionBy(*PAGE, "run"), W.partitionBy(*PAGE, "run").orderBy("line_ix")
    rows = rows.withColumns({"_up": F.bool_and((F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0"))).over(run), "_l": F.min("x0").over(run), "_r": F.max("x1").over(run), "_t": F.min("y0").over(run), "_b": F.max("y1").over(run)})
    rows = rows.withColumns({"_px0": F.lag("x0").over(by), "_px1": F.lag("x1").over(by), "_py1": F.lag("y1").over(by)})
    h, w = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)), F.greatest(F.col("x1") - F.col("x0"), F.lit(1.0))
    level = (F.col("x0") - F.col("_l") > 0.7 * h) | (F.col("_px1") < F.col("_r") - 1.5 * h) | (F.col("y0") - F.col("_py1") > 1.5 * h)
    upright = (F.col("y0") - F.col("_t") > 0.6 * w) | (F.col("_py1") < F.col("_b") - 1.5 * w) | (F.col("_px0") - F.col("x1") > 1.5 * w)
    return islands(rows, [*PAGE, "run"], ["line_ix"], F.when(F.col("_up"), upright).otherwise(level), "para").drop("_up", "_l", "_r", "_t", "_b", "_px0", "_px1", "_py1")


def page_texts(lines: DataFrame) -> DataFrame:
    """(doc_id, page, text): a page's lines, a newline after each."""
    ordered = F.array_sort(F.collect_list(F.struct("line_ix", "text")))
    return lines.groupBy(*PAGE).agg(F.concat(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n"), F.lit("\n")).alias("text"))


def upright_area(lines: DataFrame, body: float = 10.0) -> DataFrame:
    """(doc_id, page, top, bottom): where upright lines of the body's size (within 15 %) stand; 0 and 0 without any."""
    some = ((F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0"))) & (F.abs(F.col("size") - body) <= 0.15 * body)
    return lines.groupBy(*PAGE).agg(F.coalesce(F.min(F.when(some, F.col("y0"))), F.lit(0.0)).alias("top"), F.coalesce(F.max(F.when(some, F.col("y1"))), F.lit(0.0)).alias("bottom"))


def units(lines: DataFrame, unit: str) -> DataFrame:
    """(doc_id, page, unit, first_text, x0, y0, x1, y1, lines): lines of one unit, the box around them and the first one's text."""
    return lines.groupBy(*PAGE, unit).agg(F.min_by("text", "line_ix").alias("first_text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("lines"))


def dump_pages(rows: DataFrame, mark: str = "=== p") -> DataFrame:
    """(doc_id, row_ix, page, line) of a dump (doc_id, row_ix, line) in which marks open pages; rows before the first go."""
    page = F.expr("try_cast(nullif(regexp_extract(line, '^" + mark + "([0-9]+)', 1), '') AS int)")
    by = W.partitionBy("doc_id").orderBy("row_ix").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_m", page).withColumn("page", F.last("_m", ignorenulls=True).over(by)).filter("_m IS NULL AND page IS NOT NULL").drop("_m")


def runs(lines: DataFrame, role: Column) -> DataFrame:
    """lines with run: a new one where the role changes or the type size by more than a quarter."""
    by = W.partitionBy(*PAGE).orderBy("line_ix")
    rows = lines.withColumn("_role", role)
    size = F.greatest("size", F.lag("size").over(by)) > 1.25 * F.least("size", F.lag("size").over(by))
    return islands(rows, PAGE, ["line_ix"], ~F.col("_role").eqNullSafe(F.lag("_role").over(by)) | size, "run").drop("_role")


def equation_parts(lines: DataFrame) -> DataFrame:
    """lines with part: lines that are equations with their number stand alone within their unit (column unit)."""
    by = W.partitionBy(*PAGE, "unit").orderBy("line_ix")
    rows = lines.withColumn("_e", column(rules.is_equation_line, "text"))
    return islands(rows, [*PAGE, "unit"], ["line_ix"], F.col("_e") | F.coalesce(F.lag("_e").over(by), F.lit(False)), "part").drop("_e")


def merged_formulas(pieces: DataFrame, body: float = 10.0) -> DataFrame:
    """(doc_id, page, unit, formula): consecutive mathematical pieces, each within 1.6 sizes below and 4 sizes beside what is
    joined so far, get the number of the first one; others their own."""
    rows = pieces.select(*PAGE, "unit", "x0", "y0", "x1", "y1", column(rules.is_mathish, "text").alias("math"))

    def run(page: list[tuple]) -> list[tuple]:
        out, last, before = [], None, False
        for unit, x0, y0, x1, y1, math in page:
            if math and before and y0 - last[4] < 1.6 * body and x0 < last[3] + 4 * body and x1 > last[1] - 4 * body:
                last = (last[0], min(last[1], x0), min(last[2], y0), max(last[3], x1), max(last[4], y1))
            else:
                last, before = (unit, x0, y0, x1, y1), bool(math)
            out.append((unit, last[0]))
        return out

    kind = pieces.schema["unit"].dataType.simpleString()
    return each_page(rows, ["unit", "x0", "y0", "x1", "y1", "math"], run, f"unit {kind}, formula {kind}")


def stitched_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, head): pieces of one row; from the left, a piece joins the first row that ends just left of it (1.3 sizes) on its baseline (a quarter) in its size (5 %)."""

    def run(page: list[tuple]) -> list[tuple]:
        rows: list[list] = []  # head, right edge, bottom, size
        out = []
        for _, line, x1, y1, size, x0 in page:
            for r in rows:
                if abs(r[3] - size) <= 0.05 * max(size, r[3]) and abs(r[2] - y1) < 0.25 * size and -1 < x0 - r[1] < 1.3 * size:
                    r[1], r[2] = max(r[1], x1), y1
                    out.append((line, r[0]))
                    break
            else:
                rows.append([line, x1, y1, size])
                out.append((line, line))
        return sorted(out)

    kind = lines.schema["line_ix"].dataType.simpleString()
    return each_page(lines.withColumn("_x", F.col("x0")), ["_x", "line_ix", "x1", "y1", "size", "x0"], run, f"line_ix {kind}, head {kind}")


def numbered_formulas(nodes: DataFrame) -> DataFrame:
    """nodes with number: a node that is a number in brackets alone, after a formula (pages between them aside), goes to the formula; a list item that is one is a paragraph otherwise."""
    by = W.partitionBy("doc_id").orderBy("node_ix")
    rows = nodes.filter("kind != 'page'").withColumn("_n", F.when(F.col("kind").isin("paragraph", "item"), column(rules.own_equation_number, "text")))
    rows = rows.withColumns({"_before": F.lag("kind").over(by), "_next": F.lead("_n").over(by)})
    given = (F.col("_before") == "formula") & F.col("_n").isNotNull()
    rows = rows.withColumn("number", F.when(F.col("kind") == "formula", F.col("_next"))).withColumn("kind", F.when((F.col("kind") == "item") & F.col("_n").isNotNull(), "paragraph").otherwise(F.col("kind")))
    return rows.filter(~F.coalesce(given, F.lit(False))).drop("_n", "_before", "_next")


def continued_headings(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_ix, text, lines): headings (lines with a level) on neighbouring lines of a page, of one size (5 %), close below (0.8
    sizes) and without a number of their own, are one; Japanese ones join without a space."""
    by = W.partitionBy(*PAGE).orderBy("line_ix")
    gap = F.col("y0") - F.lag("y1").over(by)
    same = (F.abs(F.col("size") - F.lag("size").over(by)) <= 0.05 * F.col("size")) & (gap >= -2) & (gap < 0.8 * F.col("size")) & (F.col("x0") < F.lag("x1").over(by)) & (F.col("x1") > F.lag("x0").over(by))
    next_to = F.col("line_ix") == F.lag("line_ix").over(by) + 1
    rows = lines.filter("level IS NOT NULL").withColumn("_on", F.coalesce(same & next_to & column(rules.heading_number, "text").isNull(), F.lit(False)))
    cut = islands(rows, PAGE, ["line_ix"], ~F.col("_on"), "_h")
    ordered = F.array_sort(F.collect_list(F.struct("line_ix", "text")))
    joined = F.regexp_replace(F.array_join(F.transform(ordered, lambda s: F.trim(s["text"])), "\n"), rf"(?<=[{CJK}])\n(?=[{CJK}])", "")
    return cut.groupBy(*PAGE, "_h").agg(F.min("line_ix").alias("line_ix"), F.regexp_replace(joined, "\n", " ").alias("text"), F.count("*").alias("lines")).drop("_h")


#: Roman numerals of sections.
ROMANS = "I II III IV V VI VII VIII IX X XI XII".split()


def repaired_romans(headings: DataFrame) -> DataFrame:
    """headings (doc_id, node_ix, text) whose Roman numeral was lost before its stop get the one after the last heading's, in documents where two have kept theirs."""
    found = F.regexp_extract("text", r"^\s*([IVX]+)[.．]", 1)
    number = F.array_position(F.array(*map(F.lit, ROMANS)), found)
    by = W.partitionBy("doc_id").orderBy("node_ix").rowsBetween(W.unboundedPreceding, 0)
    rows = headings.withColumn("_n", F.when(number > 0, number)).withColumns({"_kept": F.count("_n").over(W.partitionBy("doc_id")), "_last": F.last("_n", ignorenulls=True).over(by), "_since": F.count("_n").over(by)})
    lost = F.col("_n").isNull() & F.col("_last").isNotNull() & F.col("text").rlike(rf"^\s*[.．]\s*[{CJK}]") & (F.col("_kept") >= 2)
    rows = rows.withColumn("_lost", lost).withColumn("_k", F.sum(F.col("_lost").cast("int")).over(W.partitionBy("doc_id", "_since").orderBy("node_ix").rowsBetween(W.unboundedPreceding, 0)))
    new = F.get(F.array(*map(F.lit, ROMANS)), (F.col("_last") + F.col("_k") - 1).cast("int"))
    return rows.withColumn("text", F.when(F.col("_lost") & new.isNotNull(), F.concat(new, F.ltrim("text"))).otherwise(F.col("text"))).drop("_n", "_kept", "_last", "_since", "_lost", "_k")


def swallowed_headings(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_ix, part, kind, level, text) of nodes with spans (array of struct text, strong): a paragraph that is all strong and
    looks like a title is a heading where it has a number or stands in the body before another paragraph; strong words with a
    number at a paragraph's end are a heading of their own."""
    by = W.partitionBy("doc_id").orderBy("node_ix")
    blank = lambda s: F.trim(s["text"]) == ""
    text = lambda a: F.trim(F.array_join(F.transform(a, lambda s: s["text"]), ""))
    rows = nodes.withColumns({"_next": F.lead("kind").over(by), "_before": F.lag("kind").over(by), "_body": F.coalesce(F.max(((F.col("kind") == "heading") & (F.col("level") >= 2)).cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1})
    # how many spans at the end are strong: the place of the last one that is not
    weak = F.array_max(F.transform(F.sequence(F.lit(0), F.greatest(F.size("spans") - 1, F.lit(0))), lambda i: F.when(F.get("spans", i)["strong"] | blank(F.get("spans", i)), -1).otherwise(i)))
    rows = rows.withColumn("_weak", F.when(F.size("spans") > 0, weak).otherwise(-1)).withColumns({"text": text(F.col("spans")), "_head": text(F.slice("spans", F.col("_weak") + 2, F.size("spans"))), "_rest": text(F.slice("spans", F.lit(1), F.col("_weak") + 1))})
    depth = F.when(F.coalesce(F.col("_before") != "item", F.lit(True)), column(rules.numbered_heading_depth, "text"))
    plain = F.col("_body") & (F.length("text") <= 90) & ~F.col("text").rlike("[,，]") & F.col("text").rlike(r"^\p{Lu}") & (F.col("_next") == "paragraph")
    whole = (F.col("kind") == "paragraph") & (F.col("_weak") < 0) & (F.size("spans") > 0) & column(rules.title_like, "text") & (depth.isNotNull() | F.coalesce(plain, F.lit(False)))
    tail_depth = column(rules.numbered_heading_depth, "_head")
    tail = (F.col("kind") == "paragraph") & (F.col("_weak") >= 0) & (F.col("_head") != "") & tail_depth.isNotNull() & column(rules.title_like, "_head") & F.col("_rest").rlike("[.。．)）]$")
    part = lambda n, kind, level, t: F.struct(F.lit(n).alias("part"), kind.alias("kind"), level.cast("int").alias("level"), t.alias("text"))
    heading, paragraph = F.lit("heading"), F.lit("paragraph")
    parts = F.when(whole, F.array(part(0, heading, F.when(depth.isNotNull(), F.least(depth + 1, F.lit(6))).otherwise(4), F.col("text")))).when(tail, F.array(part(0, paragraph, F.lit(0), F.col("_rest")), part(1, heading, F.least(tail_depth + 1, F.lit(6)), F.col("_head")))).otherwise(F.array(part(0, F.col("kind"), F.col("level"), F.col("text"))))
    return rows.select("doc_id", "node_ix", F.inline(parts))


def without_line_numbers(lines: DataFrame, least: int = 8) -> DataFrame:
    """lines without columns of numbers in the margin: eight and more that end at one place (within three points), with nine tenths of the other lines on one side."""
    number = column(rules.bare_number, "text")
    numbers = lines.filter(number)
    spots = merge_intervals(numbers.select(*PAGE, F.col("x1").alias("a"), F.col("x1").alias("b")), PAGE, "a", "b", 2.999).filter(F.col("n") >= least)
    left = numbers.join(spots, PAGE).filter("x1 BETWEEN a AND b").groupBy(*PAGE, "a", "b").agg(F.min("x0").alias("left"))
    others = lines.filter(~number).select(*PAGE, F.col("x0").alias("ox0"), F.col("x1").alias("ox1"))
    sides = left.join(others, PAGE, "left").groupBy(*PAGE, "a", "b").agg(F.count("ox0").alias("all"), F.count(F.when(F.col("ox0") < F.col("a") - 1, 1)).alias("before"), F.count(F.when(F.col("ox1") > F.col("left") + 1, 1)).alias("after"))
    margins = sides.filter("before * 10 <= all OR after * 10 <= all").select(*PAGE, "a", "b")
    gone = numbers.join(margins, PAGE).filter("x1 BETWEEN a AND b").select(*PAGE, "line_ix").distinct()
    return lines.join(gone, [*PAGE, "line_ix"], "left_anti")


def attached_margins(columns: DataFrame) -> DataFrame:
    """(doc_id, page, col, to): for each column of nothing but numbers (is_margin) the nearest column of words that shares half of the lower height: one at its left, else one at its right; null without any."""
    m = columns.filter("is_margin").select(*PAGE, "col", *(F.col(c).alias("m" + c) for c in ("x0", "y0", "x1", "y1")))
    w = columns.filter("NOT is_margin").select(*PAGE, F.col("col").alias("to"), "x0", "y0", "x1", "y1")
    shared = F.least("y1", "my1") - F.greatest("y0", "my0")
    gap = F.greatest(F.col("mx0") - F.col("x1"), F.col("x0") - F.col("mx1"), F.lit(0.0))
    side = F.when(F.col("x0") < F.col("mx0"), 0).when(F.col("x1") > F.col("mx0"), 1)
    pair = m.join(w, PAGE).filter((shared >= 0.5 * F.least(F.col("my1") - F.col("my0"), F.col("y1") - F.col("y0"))) & side.isNotNull())
    best = pair.groupBy(*PAGE, "col").agg(F.min(F.struct(side.alias("side"), gap.alias("gap"), "to")).alias("b"))
    return m.select(*PAGE, "col").join(best, [*PAGE, "col"], "left").select(*PAGE, "col", F.col("b.to").alias("to"))


def selection_boxes(chars: DataFrame, first: Column, last: Column) -> DataFrame:
    """(doc_id, page, line_ix, x0, y0, x1, y1): the box on each line of the characters from ``first`` to ``last`` (structs of line_ix and char_ix)."""
    at = F.struct("line_ix", "char_ix")
    return chars.filter((at >= first) & (at <= last)).groupBy(*PAGE, "line_ix").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def reference_columns(lines: DataFrame, gap: float = 3.0) -> DataFrame:
    """lines with piece: lines of one row (vertical overlap of half the lower height) closer than ``gap`` sizes are one fragment of an entry; 8 sizes after a marker."""
    by = W.partitionBy(*PAGE).orderBy("y0", "x0")
    shared = F.least(F.col("y1"), F.lag("y1").over(by)) - F.greatest(F.col("y0"), F.lag("y0").over(by))
    same = shared >= 0.5 * F.least(F.col("y1") - F.col("y0"), F.lag("y1").over(by) - F.lag("y0").over(by))
    rows = lines.withColumns({"_m": F.lag(column(rules.marker_only, "text")).over(by), "_px1": F.lag("x1").over(by), "_same": same})
    near = F.col("x0") - F.col("_px1") <= F.col("size") * F.when(F.col("_m"), 8.0).otherwise(gap)
    return islands(rows, PAGE, ["y0", "x0"], ~F.coalesce(F.col("_same") & near, F.lit(False)), "piece").drop("_m", "_px1", "_same")
