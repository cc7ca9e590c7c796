"""Ordered operators: islands, carried state, ranks, packing. Native windows; grouped maps only where state resets on itself."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import column


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows from 0: a row for which ``starts`` holds (it may use lag) opens a new one."""
    by = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_starts", F.coalesce(starts, F.lit(False))).withColumn(name, F.sum(F.when(F.row_number().over(by) == 1, 0).when(F.col("_starts"), 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0))).drop("_starts")


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, para_ix, first_line, n_lines, text_md5): a line belongs to the one before if that can't end a sentence or this carries it on."""
    by = W.partitionBy("doc_id").orderBy("line_ix")
    full = lines.filter("trim(line) != ''").withColumns({"prev": F.lag("line").over(by)})
    joined = column(rules.open_end, "prev") | (~column(rules.ends_sentence, "prev") & column(rules.starts_low, "line"))
    cut = islands(full.withColumn("joined", F.coalesce(joined, F.lit(False))), ["doc_id"], ["line_ix"], ~F.col("joined"), "para_ix")
    ordered = F.array_sort(F.collect_list(F.struct("line_ix", "line")))
    return cut.groupBy("doc_id", "para_ix").agg(F.min("line_ix").alias("first_line"), F.count("*").alias("n_lines"), F.md5(F.array_join(F.transform(ordered, lambda x: x["line"]), " ")).alias("text_md5"))


def continuations(lines: DataFrame) -> DataFrame:
    """(doc_id, line_ix, kind): lines that carry on the one before, 'strong' or 'weak'."""
    by = W.partitionBy("doc_id").orderBy("line_ix")
    rows = lines.withColumn("prev", F.lag("line").over(by)).filter("prev IS NOT NULL")
    ends = column(rules.ends_sentence, "prev")
    bracket = F.col("prev").rlike(r"\)\s*$")
    kind = F.when((~ends | bracket) & column(rules.starts_low, "line"), "strong").when(~ends & column(rules.starts_weakly, "line"), "weak")
    return rows.select("doc_id", "line_ix", kind.alias("kind")).filter("kind IS NOT NULL")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null, at each row: the section a line stands in, a level, a sticky flag."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def style_rank(df: DataFrame, key: str, *style: str) -> DataFrame:
    """Heading levels 2 to 5 by the rank of their style among the document's, most prominent first."""
    by = W.partitionBy(key).orderBy(*(F.desc(s) for s in style))
    return df.withColumn("level", F.least(F.dense_rank().over(by) + 1, F.lit(5)))


def numbering(df: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """(keys, steps, by_one): of the steps between neighbouring numbers, how many go up by one."""
    step = F.col(number) - F.lag(number).over(W.partitionBy(*keys).orderBy(*order))
    rows = df.filter(F.col(number).isNotNull()).withColumn("step", step).filter("step IS NOT NULL")
    return rows.groupBy(*keys).agg(F.count("*").alias("steps"), F.sum((F.col("step") == 1).cast("long")).alias("by_one"))


def ascending(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, n, ascending): six values at least, and four fifths of the steps don't go down."""
    prev = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    rows = df.filter(F.col(value).isNotNull()).withColumn("up", (F.col(value) >= prev).cast("int"))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum("up"), F.lit(0)).alias("ups")).select(*keys, "n", ((F.col("n") >= 6) & (F.col("ups") * 100 >= (F.col("n") - 1) * 80)).alias("ascending"))


def numbered_items(df: DataFrame, keys: list[str], order: list[str], text: str) -> DataFrame:
    """Items whose number is confirmed by the neighbour: one less before or one more after."""
    by = W.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("n", column(rules.item_number, text)).withColumns({"before": F.lag("n").over(by), "after": F.lead("n").over(by)})
    return rows.filter("(n >= 2 AND before = n - 1) OR after = n + 1")


def keep_hyphen(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """(a, b, keep) of (a, b): whether "a-" and "b" make a compound, by the corpus's own words: an equi-join for both words together, and one for the halves where that leaves it open."""
    w = words.select(F.col("word").alias("w")).distinct()
    forms = lambda c: F.array(c, *(F.concat(c, F.lit(e)) for e in ("s", "es", "ed", "d", "ing")), *(F.when(c.endswith(e) & (F.length(c) - len(e) >= 3), F.substr(c, F.lit(1), F.length(c) - len(e))) for e in ("s", "es")))

    def found(df: DataFrame, **forms: Column) -> DataFrame:
        """``df`` with a flag for each kind of forms, whether any of them is a word: one join for all."""
        named = lambda kind: lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("w"))
        made = F.flatten(F.array(*(F.transform(F.array_compact(x), named(kind)) for kind, x in forms.items())))
        tried = df.select("a", "b", F.inline(made)).join(w.withColumn("hit", F.lit(True)), "w", "left")
        return tried.groupBy("a", "b").agg(*(F.max(F.coalesce((F.col("kind") == kind) & F.col("hit"), F.lit(False))).alias(kind) for kind in forms))

    low = lambda df: df.withColumns({"la": F.lower("a"), "lb": F.lower("b")})
    capital = F.col("a").rlike(r"^[\p{Lu}0-9]*$") | F.col("b").rlike(r"^\p{Lu}") | F.col("la").isin(*"km m cm mm µm kg g mg s h hr yr ka ma ga kyr myr pa mpa gpa hz ppm".split())
    told = low(found(low(pairs.distinct()), compound=F.array(F.concat_ws("-", F.lower("a"), F.lower("b"))), whole=forms(F.concat(F.lower("a"), F.lower("b")))))
    told = told.withColumn("keep", F.when((F.col("a") == "") | (F.col("b") == ""), False).when(F.col("compound"), True).when(F.col("whole"), False).when(capital, True).when((F.length("a") < 3) | (F.length("b") < 3), False))
    # only what is still open looks its halves up
    halves = found(told.filter("keep IS NULL"), left_word=forms(F.col("la")), right_word=forms(F.col("lb")))
    return told.filter("keep IS NOT NULL").select("a", "b", "keep").unionByName(halves.select("a", "b", (F.col("left_word") & F.col("right_word")).alias("keep")))


def context_prefix(segments: DataFrame, keys: list[str], order: list[str], text: str, limit: int = 1500) -> DataFrame:
    """The first segments of a document, until their bytes (a newline after each) pass the limit."""
    before = F.sum(F.octet_length(text) + 1).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return segments.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= limit).drop("_before")


def pack_batches(segments: DataFrame, key: str, order: str, text: str, first: int, later: int, items: int = 80) -> DataFrame:
    """(key, order, batch): a document's segments in requests of at most so many bytes and items, one segment at least; the first request is smaller.

    The sum starts anew with each batch, which no window expresses, so rows stream in order through one pass that holds a counter; no document is gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, size, count = object(), 0, 0, 0
        for rows in batches:
            out = []
            for k, n in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
                if k != now:
                    now, batch, size, count = k, 0, 0, 0
                if count and (size + n > (first if batch == 0 else later) or count >= items):
                    batch, size, count = batch + 1, 0, 0
                size, count = size + n, count + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.int32())], [key, order, "batch"])

    types = {f.name: f.dataType.simpleString() for f in segments.schema}
    dealt = segments.select(key, order, F.octet_length(text).cast("int").alias("bytes")).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, f"{key} {types[key]}, {order} {types[order]}, batch int")
