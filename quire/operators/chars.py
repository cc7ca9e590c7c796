"""Characters with boxes: ligatures, accents, lookups for wrong glyphs, spaces by gaps, vertical stacks, type sizes.

``chars``: doc_id, page, line_ix, char_ix, c, x0, y0, x1, y1, size, font. Everything is windows and equi-joins on the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.dialect import CJK
from quire.functions.unicode import COMBINING

LINE = ["doc_id", "page", "line_ix"]
#: Ligatures and their letters; fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}


def _by() -> W:
    return W.partitionBy(*LINE).orderBy("char_ix")


def _mapped(c, table: dict):
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]


def split_ligatures(chars: DataFrame) -> DataFrame:
    """Each ligature becomes its letters, which share its box evenly; char_ix is renumbered."""
    parts = F.coalesce(_mapped(F.col("c"), LIGATURES), F.col("c"))
    wide = chars.withColumn("_p", F.when(F.length("c") == 1, F.split(parts, "")).otherwise(F.array("c"))).withColumn("_n", F.size("_p"))
    each = wide.select(*(x for x in wide.columns if x not in ("c", "_p")), F.posexplode("_p").alias("_k", "c"))
    step = (F.col("x1") - F.col("x0")) / F.col("_n")
    boxed = each.withColumn("_x0", F.col("x0") + step * F.col("_k")).withColumn("_x1", F.col("_x0") + step)
    return boxed.withColumns({"x0": F.col("_x0"), "x1": F.col("_x1"), "char_ix": F.row_number().over(W.partitionBy(*LINE).orderBy("char_ix", "_k")) - 1}).select(*chars.columns)


def attach_accents(chars: DataFrame) -> DataFrame:
    """A spacing accent that is a glyph of its own becomes a combining mark after the neighbouring letter that it overlaps most (the one before on a tie); a backquote only if it stands over its letter; a dotless i gets its dot."""
    by = _by()
    mark = _mapped(F.col("c"), COMBINING)
    rows = chars.withColumns({"_mark": mark, "_pc": F.lag("c").over(by), "_nc": F.lead("c").over(by), "_px0": F.lag("x0").over(by), "_px1": F.lag("x1").over(by), "_nx0": F.lead("x0").over(by), "_nx1": F.lead("x1").over(by)})
    letter = lambda c: F.coalesce(c.rlike(r"^\p{L}$"), F.lit(False))
    before = F.when(letter(F.col("_pc")), F.least("x1", "_px1") - F.greatest("x0", "_px0"))
    after = F.when(letter(F.col("_nc")), F.least("x1", "_nx1") - F.greatest("x0", "_nx0"))
    to = F.when(before.isNotNull() & (after.isNull() | (before >= after)), -1).when(after.isNotNull(), 1)
    enough = (F.col("c") != "`") | (F.greatest(before, after) > (F.col("x1") - F.col("x0")) * 0.25)
    moved = rows.withColumn("_to", F.when(F.col("_mark").isNotNull() & enough, to))
    moved = moved.withColumn("_gets", F.coalesce((F.lead("_to").over(by) == -1) | (F.lag("_to").over(by) == 1), F.lit(False)))
    key = F.when(F.col("_to") == 1, F.col("char_ix") + 1.5).when(F.col("_to") == -1, F.col("char_ix") - 0.5).otherwise(F.col("char_ix"))
    c = F.when(F.col("_to").isNotNull(), F.col("_mark")).when(F.col("_gets") & (F.col("c") == "ı"), "i").otherwise(F.col("c"))
    return moved.withColumns({"c": c, "_key": key}).withColumn("char_ix", F.row_number().over(W.partitionBy(*LINE).orderBy("_key")) - 1).select(*chars.columns)


def recoded(chars: DataFrame, table: DataFrame) -> DataFrame:
    """Wrong characters by (family, c) of ``table`` (family, c, text): right ones, or gone where the text is empty. The table is the reader's own; it is joined, and Spark broadcasts it if it is small."""
    family = F.regexp_replace(F.lower("font"), r"^[a-z]{6}\+|[-,].*$", "")
    joined = chars.withColumn("family", family).join(table.withColumnRenamed("text", "_right"), ["family", "c"], "left")
    return joined.filter("_right IS NULL OR _right != ''").withColumn("c", F.coalesce("_right", "c")).select(*chars.columns)


def named_glyphs(chars: DataFrame, second: DataFrame) -> DataFrame:
    """Characters that couldn't be decoded, filled in from a second extraction at the same place in the same font."""
    other = second.filter("c != '�'").select("doc_id", "page", "x0", "y0", "font", F.col("c").alias("_c")).dropDuplicates(["doc_id", "page", "x0", "y0", "font"])
    return chars.join(other, ["doc_id", "page", "x0", "y0", "font"], "left").withColumn("c", F.when(F.col("c") == "�", F.coalesce("_c", "c")).otherwise(F.col("c"))).select(*chars.columns)


def visible(chars: DataFrame) -> DataFrame:
    """Without characters set too small to see and without controls other than tabs."""
    return chars.filter((F.col("size") >= 1) & (~F.col("c").rlike(r"[\x00-\x1F\x7F-\x9F]") | (F.col("c") == "\t")))


def spaced_lines(chars: DataFrame, gap: float = 0.25) -> DataFrame:
    """(doc_id, page, line_ix, text): a space where a gap is wider than ``gap`` of the type size and both sides aren't Japanese; letter-spaced lines keep only gaps well beyond their median."""
    by = _by()
    rows = chars.withColumns({"_gap": F.col("x0") - F.lag("x1").over(by), "_prev": F.lag("c").over(by)})
    full, line = (F.col("c") != " ") & (F.col("_prev") != " "), W.partitionBy(*LINE)
    joined = rows.withColumns({"_median": F.percentile_approx(F.when(full, F.col("_gap")), 0.5, 10_000).over(line), "_share": F.avg(F.when(full & F.col("_gap").isNotNull(), (F.col("_gap") > F.col("size") * gap).cast("double"))).over(line)})
    wide = F.when(F.col("_share") > 0.6, (F.col("_gap") > 1.6 * F.col("_median")) & (F.col("_gap") > F.col("_median") + 0.12 * F.col("size"))).otherwise(F.col("_gap") > F.col("size") * gap)
    space = F.coalesce(wide & (F.col("c") != " ") & (F.col("_prev") != " ") & ~(F.col("c").rlike(f"[{CJK}]") & F.col("_prev").rlike(f"[{CJK}]")), F.lit(False))
    out = joined.withColumn("_t", F.concat(F.when(space, " ").otherwise(""), F.col("c")))
    return out.groupBy(*LINE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("char_ix", "_t"))), lambda x: x["_t"]), "").alias("text"))


def scripts(chars: DataFrame) -> DataFrame:
    """chars with script: 'sup' or 'sub' for those smaller than four fifths of the line's size and set off its middle, else null."""
    by = W.partitionBy(*LINE)
    rows = chars.withColumns({"_size": F.max("size").over(by), "_mid": F.avg((F.col("y0") + F.col("y1")) / 2).over(by)})
    middle = (F.col("y0") + F.col("y1")) / 2
    small = F.col("size") < 0.8 * F.col("_size")
    return rows.withColumn("script", F.when(small & (middle < F.col("_mid") - 0.1 * F.col("_size")), "sup").when(small & (middle > F.col("_mid") + 0.1 * F.col("_size")), "sub")).drop("_size", "_mid")


def ocr_superscripts(column: str = "text"):
    """Exponents that recognition sets on the line are raised: powers of ten and units of area and volume."""
    ten = F.regexp_replace(F.col(column), r"(×\s?10)([-−]?[0-9]{1,2})(?![0-9])", "$1^{$2}")
    return F.regexp_replace(ten, r"(?<=[0-9]\s?)(km|cm|mm|m)([23])(?![0-9A-Za-z])", "$1^{$2}")


#: Bytes of files whose lines one task gets: few enough for the sorts of their characters to stay in memory.
PER_TASK = 1 << 20


def dealt(lines: DataFrame, size: int) -> DataFrame:
    """lines (from files of ``size`` bytes) dealt out by line. Whatever goes along a line then finds its characters in one task: lines travel, their characters never do."""
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PER_TASK)
    return lines.repartition(parts, *LINE)


def char_boxes(lines: DataFrame) -> DataFrame:
    """chars of (doc_id, page, line_ix, text, x0, y0, x1, y1): evenly spaced along the line."""
    n = F.greatest(F.length("text"), F.lit(1))
    step = (F.col("x1") - F.col("x0")) / n
    each = lines.select(*LINE, "x0", "y0", "y1", step.alias("_s"), F.posexplode(F.split("text", "")).alias("char_ix", "c")).filter("c != ''")
    return each.select(*LINE, "char_ix", "c", (F.col("x0") + F.col("_s") * F.col("char_ix")).alias("x0"), "y0", (F.col("x0") + F.col("_s") * (F.col("char_ix") + 1)).alias("x1"), "y1")


def line_sizes(lines: DataFrame) -> DataFrame:
    """Recognized lines with size: 85 hundredths of their thickness (78 for Latin), drawn to the block's upper median where within 0.7 to 1.35 of it."""
    latin = F.regexp_count("text", F.lit("[A-Za-z]")) * 2 > F.length("text")
    rows = lines.withColumn("_own", (F.col("y1") - F.col("y0")) * F.when(latin, 0.78).otherwise(0.85))
    by = W.partitionBy("doc_id", "page", "block")
    sorted_ = F.array_sort(F.collect_list("_own").over(by))
    rows = rows.withColumn("_median", F.get(sorted_, F.floor(F.size(sorted_) / 2).cast("int")))
    near = F.col("_own").between(F.col("_median") * 0.7, F.col("_median") * 1.35)
    return rows.withColumn("size", F.when(near, F.col("_median")).otherwise(F.col("_own"))).drop("_own", "_median")


def stacked_columns(chars: DataFrame) -> DataFrame:
    """(doc_id, page, block, column, text): characters written one under another, in columns from right to left; a column's centres lie within half a type size, and a gap of two sizes parts it."""
    keys = ["doc_id", "page", "block"]
    x = (F.col("x0") + F.col("x1")) / 2
    by = W.partitionBy(*keys).orderBy(F.desc("_x"), "y0")
    rows = chars.withColumn("_x", x).withColumn("_new", F.coalesce((F.lag("_x").over(by) - F.col("_x") > F.col("size") * 0.5).cast("int"), F.lit(0)))
    rows = rows.withColumn("_col", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    down = W.partitionBy(*keys, "_col").orderBy("y0")
    rows = rows.withColumn("_cut", F.coalesce((F.col("y0") - F.lag("y1").over(down) > 2 * F.col("size")).cast("int"), F.lit(0))).withColumn("_part", F.sum("_cut").over(down.rowsBetween(W.unboundedPreceding, 0)))
    joined = rows.groupBy(*keys, "_col", "_part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "c"))), lambda s: s["c"]), "").alias("text"))
    return joined.select(*keys, (F.row_number().over(W.partitionBy(*keys).orderBy("_col", "_part")) - 1).alias("column"), "text")


def hit(chars: DataFrame, points: DataFrame) -> DataFrame:
    """(point_ix, line_ix, char_ix): the nearest line of a point's page, then its nearest character."""
    lines = chars.groupBy(*LINE).agg(F.min("x0").alias("a"), F.min("y0").alias("b"), F.max("x1").alias("c1"), F.max("y1").alias("d"))
    away = lambda lo, hi, v: F.greatest(lo - v, v - hi, F.lit(0.0))
    near = points.join(lines, ["doc_id", "page"]).withColumn("_d", F.pow(away(F.col("a"), F.col("c1"), F.col("x")), 2) + F.pow(away(F.col("b"), F.col("d"), F.col("y")), 2))
    line = near.groupBy("doc_id", "page", "point_ix", "x", "y").agg(F.min(F.struct("_d", "line_ix")).alias("m")).select("doc_id", "page", "point_ix", "x", "y", F.col("m.line_ix").alias("line_ix"))
    char = line.join(chars.select(*LINE, "char_ix", "x0", "x1"), LINE).withColumn("_d", away(F.col("x0"), F.col("x1"), F.col("x")))
    return char.groupBy("doc_id", "page", "point_ix", "line_ix").agg(F.min(F.struct("_d", "char_ix")).alias("m")).select("doc_id", "page", "point_ix", "line_ix", F.col("m.char_ix").alias("char_ix"))
