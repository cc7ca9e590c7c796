"""Lines of pages to the units of a document: rows, paragraphs, titles, margins, notes, numbers that don't belong.

``lines``: doc_id, page, line_ix, text, x0, y0, x1, y1, size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import CJK, column
from quire.operators.geometry import PAGE, overlap
from quire.operators.sequence import islands


def margin_heads(lines: DataFrame, height: float, share: int = 4) -> DataFrame:
    """(doc_id, key, pages): texts in the upper and lower 15 % of pages that stand on max(2, a quarter of the pages) or more, digits masked, of three other characters at least."""
    band = lines.filter((F.col("y1") < height * 0.15) | (F.col("y0") > height * 0.85)).withColumn("key", column(rules.digits_key, "text")).filter(F.length(F.regexp_replace("key", "#", "")) >= 3)
    n = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("n"))
    counts = band.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages")).join(n, "doc_id")
    return counts.filter((F.col("n") > 1) & (F.col("pages") >= F.greatest(F.lit(2), F.ceil(F.col("n") / share)))).drop("n")


def running_heads(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Lines that repeat a title or an author (marks: doc_id, mark, is_author, compacted) as recognition reads them: contained in an author's name, or seven tenths of the pairs of characters shared."""
    rows = lines.withColumn("c", F.regexp_replace(column(rules.compact_text, "text"), "(ほか|他|etal)$", "")).filter("length(c) >= 3")
    pair = rows.join(marks, "doc_id").withColumns({"g": column(rules.bigrams, "c"), "h": column(rules.bigrams, "mark")})
    short, long = F.least(F.size("g"), F.size("h")), F.greatest(F.size("g"), F.size("h"))
    like = (short * 100 >= long * 70) & (F.size(F.array_intersect("g", "h")) * 10 >= long * 7)
    return pair.filter((F.col("is_author") & F.contains("mark", "c")) | like).select("doc_id", "page", "line_ix").distinct()


def join_rows(lines: DataFrame, em: float = 0.6) -> DataFrame:
    """(…, row_ix, text): pieces on one baseline whose gap is under ``em`` of the size are one row, a space between them unless one side is Japanese."""
    by = W.partitionBy(*PAGE).orderBy("y0", "x0")
    same = overlap(F.col("y0"), F.col("y1"), F.lag("y0").over(by), F.lag("y1").over(by)) >= 0.5 * F.least(F.col("y1") - F.col("y0"), F.lag("y1").over(by) - F.lag("y0").over(by))
    near = F.col("x0") - F.lag("x1").over(by) < F.col("size") * F.when(F.length(F.lag("text").over(by)) <= 3, 1.5).otherwise(em)
    cut = islands(lines, PAGE, ["y0", "x0"], ~(same & near), "row_ix")
    return cut.groupBy(*PAGE, "row_ix").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.max("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]), " ").alias("_t")).withColumn("text", F.regexp_replace("_t", rf"(?<=[{CJK}]) (?=[{CJK}])", "")).drop("_t")


def split_paragraphs(lines: DataFrame, body: float = 10.0) -> DataFrame:
    """lines with para: a new one where the line before is short and ends a sentence and this is indented by 0.6 to 4 sizes, or where the type size changes by a quarter."""
    by = W.partitionBy(*PAGE).orderBy("line_ix")
    left, right = F.min("x0").over(W.partitionBy(*PAGE)), F.max("x1").over(W.partitionBy(*PAGE))
    rows = lines.withColumns({"_left": left, "_right": right, "_prev": F.lag("text").over(by), "_px1": F.lag("x1").over(by), "_ps": F.lag("size").over(by)})
    indent = F.col("x0") - F.col("_left")
    ends = column(rules.ends_sentence, "_prev") & (F.col("_px1") < F.col("_right") - 2 * body)
    starts = (ends & indent.between(0.6 * body, 4 * body)) | (F.greatest("size", "_ps") > 1.25 * F.least("size", "_ps"))
    return islands(rows, PAGE, ["line_ix"], starts, "para").drop("_left", "_right", "_prev", "_px1", "_ps")


def document_title(lines: DataFrame) -> DataFrame:
    """(doc_id, title): on the first page, of the lines within four fifths of the best size times the root of the length (150 at most), the topmost."""
    score = F.col("size") * F.sqrt(F.least(F.length("text"), F.lit(150)))
    first = lines.filter("page = 0 AND length(text) >= 4").filter(~column(rules.is_kicker, "text") & ~column(rules.is_boilerplate, "text")).withColumn("_s", score)
    best = first.withColumn("_best", F.max("_s").over(W.partitionBy("doc_id"))).filter("_s >= 0.8 * _best")
    return best.groupBy("doc_id").agg(F.min_by("text", F.struct("y0", "x0", "line_ix")).alias("title"))


def page_numbers(lines: DataFrame) -> DataFrame:
    """First and last lines of pages that are nothing but a number."""
    up, down = W.partitionBy(*PAGE).orderBy("line_ix"), W.partitionBy(*PAGE).orderBy(F.desc("line_ix"))
    rows = lines.withColumns({"_a": F.row_number().over(up), "_b": F.row_number().over(down)})
    return rows.filter("(_a = 1 OR _b = 1) AND trim(text) rlike '^[-–— ]*[0-9]{1,4}[-–— ]*$'").select(*PAGE, "line_ix")


def line_number_columns(lines: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, page, x1): columns of right-aligned whole numbers, ``least`` and more, seven tenths of whose steps are 1, 2, 5 or 10."""
    numbers = lines.filter("trim(text) rlike '^[0-9]{1,4}$'").withColumns({"_n": F.trim("text").cast("int"), "_x": F.round("x1")})
    step = F.col("_n") - F.lag("_n").over(W.partitionBy(*PAGE, "_x").orderBy("y0"))
    counts = numbers.withColumn("_s", step).groupBy(*PAGE, "_x").agg(F.count("*").alias("n"), F.sum(F.col("_s").isin(1, 2, 5, 10).cast("int")).alias("ok"))
    return counts.filter((F.col("n") >= least) & (F.col("ok") * 10 >= (F.col("n") - 1) * 7)).select(*PAGE, F.col("_x").alias("x1"))


def drop_caps(lines: DataFrame) -> DataFrame:
    """(doc_id, page, cap, line_ix): a large single capital and the paragraph's line just right of it."""
    cap = lines.filter(r"text rlike '^\\p{Lu}$'").select(*PAGE, F.col("line_ix").alias("cap"), *(F.col(c).alias("c" + c) for c in ("x1", "y0", "y1", "size")))
    pair = lines.join(cap, PAGE).filter("line_ix != cap AND csize > 1.5 * size AND x0 >= cx1 - 1 AND x0 - cx1 < 2 * size AND y0 >= cy0 - size AND y0 < cy1")
    return pair.groupBy(*PAGE, "cap").agg(F.min(F.struct("y0", "line_ix")).alias("m")).select(*PAGE, "cap", F.col("m.line_ix").alias("line_ix"))


def section_numbers(lines: DataFrame, body: float = 10.0) -> DataFrame:
    """(doc_id, page, number, title): section numbers set apart and the title on their row, within four sizes."""
    n = lines.filter(r"text rlike '^([0-9]+\\.)*[0-9]+\\.?$'").select(*PAGE, F.col("line_ix").alias("number"), F.col("x1").alias("nx1"), F.col("y0").alias("ny0"), F.col("y1").alias("ny1"))
    pair = lines.filter(r"text rlike '\\p{L}'").join(n, PAGE).withColumn("_gap", F.col("x0") - F.col("nx1"))
    pair = pair.filter((F.col("_gap") >= 0) & (F.col("_gap") <= 4 * body) & (overlap(F.col("y0"), F.col("y1"), F.col("ny0"), F.col("ny1")) > 0))
    return pair.groupBy(*PAGE, "number").agg(F.min(F.struct("_gap", "line_ix")).alias("m")).select(*PAGE, "number", F.col("m.line_ix").alias("title"))


def notes(lines: DataFrame, body: float = 10.0) -> DataFrame:
    """Lines that are notes: they open as one, or are small and have nothing larger below them in their column."""
    o = lines.select(*PAGE, F.col("line_ix").alias("o"), F.col("x0").alias("ox0"), F.col("x1").alias("ox1"), F.col("y0").alias("oy0"), F.col("size").alias("os"))
    small = lines.filter(F.col("size") < 0.95 * body)
    below = small.join(o, PAGE).filter((F.col("oy0") >= F.col("y1")) & (F.col("os") >= 0.95 * body) & (overlap(F.col("x0"), F.col("x1"), F.col("ox0"), F.col("ox1")) > 0))
    foot = small.join(below.select(*PAGE, "line_ix").distinct(), [*PAGE, "line_ix"], "left_anti").select(*PAGE, "line_ix")
    return foot.unionByName(lines.filter(column(rules.note_opening, "text")).select(*PAGE, "line_ix")).distinct()


def heading_level(size: Column, body: float, bold: Column, text: str = "text") -> Column:
    """A heading's level, or null: by its number, else 2 for large type, 3 for capitals or bold short lines, 4 for front and closing matter."""
    number = column(rules.heading_number, text)
    short = F.length(text) <= 100
    return F.when(number.isNotNull() & short, F.least(number + 1, F.lit(5))).when((size >= 1.25 * body) & short, 2).when(short & (column(rules.caps_heading, text) | (bold & ~column(rules.ends_sentence, text))), 3).when(column(rules.is_front_heading, text) | column(rules.is_closing_heading, text) | column(rules.is_references_heading, text), 4)


def majority_class(votes: DataFrame, keys: list[str], weight: str = "chars") -> DataFrame:
    """(keys, class) with the most weight; of equal ones the smallest."""
    return votes.groupBy(*keys, "class").agg(F.sum(weight).alias("n")).groupBy(*keys).agg(F.max(F.struct("n", (-F.col("class")).alias("c"))).alias("m")).select(*keys, (-F.col("m.c")).alias("class"))


def filled_anchors(nodes: DataFrame) -> DataFrame:
    """Anchors (page, y) of every node, those without one taking the last."""
    by = W.partitionBy("doc_id").orderBy("node_ix").rowsBetween(W.unboundedPreceding, 0)
    return nodes.withColumn("anchor", F.last("anchor", ignorenulls=True).over(by))


def vertical(lines: DataFrame) -> DataFrame:
    """(doc_id, vertical): more characters stand in lines taller than wide."""
    up = (F.col("y1") - F.col("y0")) > (F.col("x1") - F.col("x0"))
    return lines.groupBy("doc_id").agg((F.sum(F.when(up, F.length("text")).otherwise(0)) > F.sum(F.when(up, 0).otherwise(F.length("text")))).alias("vertical"))


def flattened(tree: DataFrame) -> DataFrame:
    """An outline (doc_id, id, parent, title) as (doc_id, id, depth, path): level by level by joins, as many levels as the largest outline has entries at most."""
    most = tree.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    level = tree.filter("parent IS NULL").select("doc_id", "id", F.lit(0).alias("depth"), F.array("title").alias("path"))
    out = level
    for depth in range(1, most):
        level = tree.join(level.select("doc_id", F.col("id").alias("parent"), F.col("path").alias("above")), ["doc_id", "parent"]).select("doc_id", "id", F.lit(depth).alias("depth"), F.concat("above", F.array("title")).alias("path"))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def spread_pages(pages: DataFrame, most: int = 10) -> DataFrame:
    """At most ``most`` pages of a document, spread evenly, of (doc_id, page)."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("page")) - 1
    rows = pages.withColumns({"_n": n, "_k": k})
    return rows.filter((F.col("_n") <= most) | (F.floor(F.col("_k") * most / F.col("_n")) != F.floor((F.col("_k") - 1) * most / F.col("_n")))).drop("_n", "_k")
