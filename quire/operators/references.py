"""Reference lists: where they start and end, and their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import column


def reference_lines(lines: DataFrame) -> DataFrame:
    """Lines with in_refs: from the line after a reference heading to the next heading that ends such a section; a sticky state, carried by a window."""
    by = W.partitionBy("doc_id").orderBy("line_ix").rowsBetween(W.unboundedPreceding, 0)
    opens = column(rules.is_refs_heading, "line")
    closes = (column(rules.section_word, "line") | column(rules.is_closing_heading, "line")) & (F.length("line") < 100) & ~opens
    state = F.last(F.when(opens, 1).when(closes, 0), ignorenulls=True).over(by)
    return lines.withColumn("in_refs", (F.coalesce(state, F.lit(0)) == 1) & ~opens)


def entries(lines: DataFrame) -> DataFrame:
    """(doc_id, entry_ix, number, first_line, n_lines, text) of the lines in reference lists: an entry starts at a marker, at an author, or after a line that firmly ends one."""
    by = W.partitionBy("doc_id").orderBy("line_ix")
    rows = reference_lines(lines).filter("in_refs AND trim(line) != ''").withColumns({"lead": column(rules.lead, "line"), "number": column(rules.marker, "line"), "before": F.lag("line").over(by)})
    ended = F.coalesce(column(rules.entry_end, "before"), F.lit(2))
    starts = F.col("number").isNotNull() | ((F.col("lead") == "strong") & (ended >= 1)) | ((F.col("lead") == "weak") & (ended >= 2))
    numbered = rows.withColumn("entry_ix", F.sum(starts.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("line_ix", "line", "number")))
    out = numbered.groupBy("doc_id", "entry_ix").agg(ordered.alias("o"))
    return out.select("doc_id", "entry_ix", F.col("o")[0]["number"].alias("number"), F.col("o")[0]["line_ix"].alias("first_line"), F.size("o").alias("n_lines"), F.array_join(F.transform("o", lambda x: x["line"]), " ").alias("text"))


def accepted(entries_: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, entries, dated, numbered, accepted): a list stands if it has entries enough and half of them have a year or numbers that go up by one."""
    by = W.partitionBy("doc_id").orderBy("entry_ix")
    rows = entries_.withColumns({"dated": column(rules.has_year, "text"), "next": (F.col("number") == F.lag("number").over(by) + 1)})
    out = rows.groupBy("doc_id").agg(F.count("*").alias("entries"), F.sum(F.col("dated").cast("long")).alias("dated"), F.sum(F.coalesce(F.col("next"), F.lit(False)).cast("long")).alias("numbered"))
    return out.withColumn("accepted", (F.col("entries") >= least) & ((F.col("dated") * 2 >= F.col("entries")) | (F.col("numbered") * 2 >= F.col("entries"))))


def contents_rows(lines: DataFrame) -> DataFrame:
    """(doc_id, line_ix, title, page): rows that end in page references, leaders taken out."""
    rows = lines.withColumn("row", F.regexp_replace("line", r"(\s*[.·…‧∙•_]){3,}\s*", " ")).withColumn("pages", column(rules.trailing_pages, "row"))
    return rows.filter("pages IS NOT NULL").select("doc_id", "line_ix", F.trim(F.substr("row", F.lit(1), F.length(F.regexp_replace("row", r"[,;\s]+$", "")) - F.length("pages"))).alias("title"), column(rules.first_page, "row").alias("page"))
