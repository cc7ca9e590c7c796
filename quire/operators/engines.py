"""Seams for engines that are not ours (recognition, formulas, translation), and the planning, caching and batching around them."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from enum import Enum
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import column
from quire.operators.sequence import carry_forward


class Recognizer(Protocol):
    """An image to its lines."""

    def recognize(self, image: bytes) -> list[dict]: ...


class FormulaReader(Protocol):
    """An image to LaTeX."""

    def to_latex(self, image: bytes) -> str: ...


class Translator(Protocol):
    """Items (id, text) to translations; some may be missing."""

    def translate(self, items: list[tuple[int, str]]) -> list[tuple[int, str]]: ...


class Failure(Enum):
    RATE_LIMITED = "rate limited"
    DAILY_LIMIT = "daily limit"
    AUTH = "auth"
    TOO_LONG = "too long"
    BILLING = "billing"
    OTHER = "other"


def failure(status: Column, body: Column) -> Column:
    """The kind of a provider's error, from its HTTP status and its body."""
    low = F.lower(body)
    return (
        F.when(status.isin(401, 403), Failure.AUTH.value)
        .when((status == 402) | low.rlike("insufficient_quota|billing|credit balance"), Failure.BILLING.value)
        .when((status == 429) & low.rlike("per ?day|daily"), Failure.DAILY_LIMIT.value)
        .when(status.isin(429, 503, 529), Failure.RATE_LIMITED.value)
        .when((status == 413) | low.rlike("too long|context length|max.?tokens|token limit"), Failure.TOO_LONG.value)
        .otherwise(Failure.OTHER.value)
    )


def recognized(pages: DataFrame, engine: Recognizer, image: str = "image") -> DataFrame:
    """(keys, lines): lines of each page image by an engine that is shipped to the workers."""

    @F.pandas_udf("array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: engine.recognize(bytes(b)))

    return pages.withColumn("lines", run(image))


def latex(images: DataFrame, engine: FormulaReader, image: str = "image") -> DataFrame:
    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda b: engine.to_latex(bytes(b)))

    return images.withColumn("latex", run(image))


def plan(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_ix, text): what is worth translating: not in a reference list, not Japanese already, no symbols, no stray references. A list lasts to the next heading of its level or above."""
    flat = nodes.filter("kind IN ('heading', 'paragraph', 'item', 'footnote', 'figure', 'table')").withColumn("text", F.regexp_replace(F.trim("text"), r"\s+", " "))
    heading = F.col("kind") == "heading"
    marked = carry_forward(flat.withColumn("opens", heading & column(rules.is_references, "text")), ["doc_id"], ["node_ix"], F.when(heading, F.struct("opens", "level")), "h")
    opened = carry_forward(marked, ["doc_id"], ["node_ix"], F.when(F.col("opens"), F.struct("node_ix", "level")), "list")
    from pyspark.sql import Window as W

    by = W.partitionBy("doc_id", "list.node_ix").orderBy("node_ix").rowsBetween(W.unboundedPreceding, 0)
    closed = F.coalesce(F.max((heading & ~F.col("opens") & (F.col("level") <= F.col("list.level"))).cast("int")).over(by), F.lit(0)) == 1
    rows = opened.withColumn("skip", F.col("list").isNotNull() & ~closed)
    return rows.filter(~F.col("skip") & column(rules.translatable, "text")).select("doc_id", "node_ix", "text")


def misses(segments: DataFrame, store: DataFrame) -> DataFrame:
    """Segments whose hash the store lacks, each text once."""
    return segments.join(store.select("h"), segments["hash"] == F.col("h"), "left_anti").dropDuplicates(["hash"])


def with_cached(segments: DataFrame, store: DataFrame) -> DataFrame:
    """Segments with what the store has for them, or null."""
    return segments.join(store.select("h", F.col("t").alias("translated")), segments["hash"] == F.col("h"), "left").drop("h")


def user_prompt(title: str, context: str, items: list[tuple[int, str]]) -> str:
    return f"Title: {title}\n\nContext, not to be translated:\n{context}\n\nTranslate the items; answer with JSON like " + '{"items": [{"id": 1, "ja": "..."}]}:\n' + json.dumps({"items": [{"id": i, "text": t} for i, t in items]}, ensure_ascii=False)


def parse_answer(answer: Column) -> Column:
    """An array of (id, ja) of an engine's answer; a code fence around the JSON is tolerated, null if there is none."""
    body = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    return F.from_json(body, "struct<items:array<struct<id:int,ja:string>>>")["items"]


def translate(batches: DataFrame, engine: Translator, retries: int = 1) -> DataFrame:
    """(doc_id, node_ix, hash, translated, failed): each batch (doc_id, batch, items) by the engine; items that are missing are asked for once more, alone, and then count as failed."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            out = []
            for doc, items in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
                asked = [(i["node_ix"], i["text"]) for i in items]
                done = dict(engine.translate(asked))
                for _ in range(retries):
                    for one in [a for a in asked if a[0] not in done]:
                        done.update(engine.translate([one]))
                out += [(doc, i["node_ix"], i["hash"], done.get(i["node_ix"]), i["node_ix"] not in done) for i in items]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 5, kinds, strict=True)], ["doc_id", "node_ix", "hash", "translated", "failed"])

    return batches.select("doc_id", "batch", "items").mapInArrow(run, "doc_id long, node_ix int, hash string, translated string, failed boolean")


def estimated_usd(chars: Column, price_in: float, price_out: float) -> Column:
    """Cost of translating so many characters, prices for a million tokens; a fifth is added for what goes around the text."""
    return 1.2 * chars * (0.32 * price_in + 0.35 * price_out) / 1e6


def adaptive(limit: int, attempt: Callable[[int], bool], least: int = 200) -> int:
    """Halves a request's limit until the engine takes it."""
    while not attempt(limit) and limit > least:
        limit //= 2
    return limit


def ocr_wanted(scope: str, unusable: Column, scanned: Column) -> Column:
    """'take', 'force' or 'skip' for a page by scope: needed (unusable text layers), scans (those and other programs' layers), all."""
    if scope == "needed":
        return F.when(unusable, "take").otherwise("skip")
    if scope == "scans":
        return F.when(unusable, "take").when(scanned, "force").otherwise("skip")
    return F.when(unusable, "take").otherwise("force")


def needs_ocr(total: Column, bad: Column, image_share: Column) -> Column:
    """Why a page's text layer is of no use, or null: a scan without text, or mostly characters that can't be decoded."""
    return F.when((total < 20) & (image_share > 0.5), "scan").when((total >= 20) & (bad * 10 > total * 3), "codes")


def replaced_layer(pages: DataFrame, ocr: DataFrame) -> DataFrame:
    """Pages with the recognized text in place of their own where that was forced or theirs is of no use."""
    joined = pages.join(ocr.select("doc_id", "page", F.col("text").alias("ocr_text"), "forced"), ["doc_id", "page"], "left")
    use = F.col("ocr_text").isNotNull() & (F.coalesce("forced", F.lit(False)) | F.col("unusable"))
    return joined.withColumn("text", F.when(use, F.col("ocr_text")).otherwise(F.col("text"))).drop("ocr_text", "forced")


def fence(text: str) -> str:
    """The JSON in an answer, without a code fence."""
    return re.sub(r"^```(?:json)?|```$", "", text.strip()).strip()
