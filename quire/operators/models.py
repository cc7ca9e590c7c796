"""Seams for models that the library doesn't ship: classes of a page's boxes, readers of lines by length, step-by-step decoders, prices and manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.geometry import each_page


class PageModel(Protocol):
    """Gives each box (box_ix, x0, y0, x1, y1, text) of a page a class, and pairs of boxes that belong together."""

    def analyze(self, boxes: list[tuple]) -> tuple[list[int], list[tuple[int, int]]]: ...


class LineReader(Protocol):
    """Reads a line's image; ``most`` characters is all that it can give."""

    most: int

    def read(self, image: bytes) -> str: ...


BOX = ["box_ix", "x0", "y0", "x1", "y1", "text"]


def classified(boxes: DataFrame, model: PageModel) -> DataFrame:
    """(doc_id, page, box_ix, class): the model's classes, one page at a time."""
    return each_page(boxes, BOX, lambda rows: [(r[0], int(c)) for r, c in zip(rows, model.analyze(rows)[0], strict=True)], f"box_ix {boxes.schema['box_ix'].dataType.simpleString()}, class int")


def connected(boxes: DataFrame, model: PageModel) -> DataFrame:
    """(doc_id, page, a, b): the model's pairs."""
    return each_page(boxes, BOX, lambda rows: [(int(a), int(b)) for a, b in model.analyze(rows)[1]], "a int, b int")


def cascade(image: bytes, expected: int, readers: list[LineReader]) -> str:
    """The reading by the smallest reader that should hold the line; one that fills its reader is read again by the next larger."""
    fitting = [r for r in sorted(readers, key=lambda r: r.most) if r.most >= expected] or [max(readers, key=lambda r: r.most)]
    for reader in fitting:
        text = reader.read(image)
        if len(text) < reader.most:
            break
    return text


def read_lines(lines: DataFrame, readers: list[LineReader]) -> DataFrame:
    """(line_id, text) of (line_id, image, expected), in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if i is None else cascade(i, n or 0, readers) for i, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["line_id", "text"])

    return lines.select(F.col("line_id").cast("long").alias("line_id"), "image", F.col("expected").cast("int").alias("expected")).mapInArrow(run, "line_id long, text string")


def greedy(step: Callable[[list[int]], int], start: int, end: int, most: int = 400) -> list[int]:
    """Tokens one by one, each the step's choice after those so far, until the end token or so many."""
    tokens = [start]
    while len(tokens) <= most and (token := step(tokens)) != end:
        tokens.append(token)
    return tokens[1:]


def retry_after(header: Column) -> Column:
    """Seconds that a response asks to wait, or null."""
    return F.when(header.rlike(r"^\s*[0-9]+(\.[0-9]+)?\s*$"), F.trim(header).cast("double"))


def priced(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """requests (provider, model, chars) with usd: 0.32 tokens in and 0.35 out a character and a fifth more, at the model's prices a million (prices: provider, model, usd_in, usd_out); null without a price."""
    chars = 1.2 * F.col("chars")
    return requests.join(prices, ["provider", "model"], "left").withColumn("usd", (chars * 0.32 * F.col("usd_in") + chars * 0.35 * F.col("usd_out")) / 1e6).drop("usd_in", "usd_out")


def installed(files: DataFrame, found: DataFrame) -> DataFrame:
    """(model, size, complete) of a manifest's files (model, url, sha256, size): their size together, and whether all are there (found: sha256, size)."""
    have = found.select(F.col("sha256").alias("_s"), F.col("size").alias("_n")).distinct()
    return files.join(have, (F.col("sha256") == F.col("_s")) & (F.col("size") == F.col("_n")), "left").groupBy("model").agg(F.sum("size").alias("size"), F.bool_and(F.col("_s").isNotNull()).alias("complete"))


def key_service(key: Column, prefixes: dict[str, str]) -> Column:
    """The service that a key belongs to by how it starts, the longest start that fits; null if none does."""
    out = F.lit(None).cast("string")
    for start in sorted(prefixes, key=len):
        out = F.when(F.trim(key).startswith(start), prefixes[start]).otherwise(out)
    return out


def transformed(x: Column, y: Column, matrix: tuple[float, ...]) -> tuple[Column, Column]:
    """A point under the affine matrix (a, b, c, d, e, f)."""
    a, b, c, d, e, f = matrix
    return x * a + y * c + e, x * b + y * d + f


def utf16_hex(text: Column) -> Column:
    """A text's UTF-16 units, big end first, in hex."""
    return F.hex(F.encode(text, "UTF-16BE"))


def scaled(lines: DataFrame, dpi: float) -> DataFrame:
    """Recognised lines in pixels of a page drawn at ``dpi``, in points."""
    return lines.withColumns({c: F.col(c) * (72.0 / dpi) for c in ("x0", "y0", "x1", "y1")})


def target_paths(jobs: DataFrame) -> DataFrame:
    """(path, formats, clash) of (source, folder, stem, formats): each format once, in order, and whether another source writes to the same place."""
    out = jobs.withColumns({"formats": F.array_distinct("formats"), "path": F.concat_ws("/", "folder", "stem")})
    taken = out.groupBy("path").agg(F.countDistinct("source").alias("n")).filter("n > 1").select("path", F.lit(True).alias("clash"))
    return out.join(taken, "path", "left").select("source", "path", "formats", F.coalesce("clash", F.lit(False)).alias("clash"))
