"""Sources and sinks: text and Markdown files, JSON-lines stores, BibTeX, libraries of files, converted documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.unicode import decoded

OCR_LINE = "page int, forced boolean, engine string, vertical boolean, lines array<struct<bbox:array<double>,text:string,vertical:boolean,block:int,kind:string>>, regions array<struct<bbox:array<double>,kind:string>>"
TRANSLATION_LINE = "h string, t string"


def kind_of(path):
    """'markdown', 'text' or null by a path's extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(ext.isin("md", "markdown", "mdown", "mkd", "mkdn"), "markdown").when(ext.isin("txt", "text"), "text")


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, kind, text): text and Markdown files decoded by byte-order mark, UTF-8 or Shift_JIS; nested folders are read, a glob filters names."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return raw.select("path", kind_of(F.col("path")).alias("kind"), "content").filter("kind IS NOT NULL").select("path", "kind", decoded("content").alias("text"))


def last_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A JSON-lines store as a table: malformed lines are skipped and of a key's lines the last counts. Lines are ordered by file and by place in it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    rows = lines.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"})).filter(f"r.{key} IS NOT NULL")
    last = rows.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", F.struct("file", "block", "at")).alias("r"))
    return last.select("r.*")


def read_ocr_store(spark: SparkSession, path: str) -> DataFrame:
    return last_lines(spark, path, OCR_LINE, "page")


def read_translations(spark: SparkSession, path: str) -> DataFrame:
    return last_lines(spark, path, TRANSLATION_LINE, "h")


def append_lines(rows: DataFrame, path: str) -> None:
    """Adds rows to a JSON-lines store; the later ones win on reading."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def library(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime, is_pdf): a folder and those in it; PDF files are told by their first 1024 bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.contains(F.substring(F.col("content"), 1, 1024), F.lit(b"%PDF-")).alias("is_pdf"))


def stale(files: DataFrame, cache: DataFrame, version: int) -> DataFrame:
    """Files that must be read again: not in the cache with this size, time and version."""
    return files.join(cache.filter(F.col("v") == version).select("path", "size", "mtime"), ["path", "size", "mtime"], "left_anti")


def cache_key(path, size, mtime):
    return F.xxhash64(F.lower(path), size, mtime)


ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s]+)\s*,")
FIELD = re.compile(r"\s*([\w-]+)\s*=\s*")


def bib_entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of BibTeX text; of a field that is given twice the first counts."""
    out = []
    for m in ENTRY.finditer(text):
        kind, fields, at = m[1].lower(), {}, m.end()
        if kind in ("comment", "string", "preamble"):
            continue
        while f := FIELD.match(text, at):
            at, parts = f.end(), []
            while True:
                if text[at : at + 1] == "{":
                    depth, start = 1, at + 1
                    at += 1
                    while at < len(text) and depth:
                        depth += {"{": 1, "}": -1}.get(text[at], 0) if text[at - 1] != "\\" else 0
                        at += 1
                    parts.append(text[start : at - 1])
                elif text[at : at + 1] == '"':
                    end = at + 1
                    depth = 0
                    while end < len(text) and (text[end] != '"' or depth):
                        depth += {"{": 1, "}": -1}.get(text[end], 0)
                        end += 1
                    parts.append(text[at + 1 : end])
                    at = end + 1
                else:
                    word = re.match(r"[^\s,#}]*", text[at:])[0]
                    parts.append(word)
                    at += len(word)
                more = re.match(r"\s*#\s*", text[at:])
                if not more:
                    break
                at += more.end()
            fields.setdefault(f[1].lower(), " ".join("".join(parts).split()))
            comma = re.match(r"\s*,", text[at:])
            if not comma:
                break
            at += comma.end()
        out.append((kind, m[2], fields))
    return out


BIB = "type string, key string, title string, authors array<string>, year int, venue string, fields map<string,string>"


def read_bib(texts: DataFrame) -> DataFrame:
    """Bibliography entries of (text), one row each; years from 1500 to 2099."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                for kind, key, f in bib_entries(text or ""):
                    year = re.search(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)", f.get("year", "") or f.get("date", ""))
                    names = [a for a in re.split(r"\s+and\s+", f.get("author", "")) if a]
                    rows.append((kind, key, re.sub(r"[{}]", "", f["title"]) if "title" in f else None, names, int(year[0]) if year else None, f.get("journal") or f.get("booktitle"), list(f.items())))
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], ["type", "key", "title", "authors", "year", "venue", "fields"])

    return texts.select("text").mapInArrow(run, BIB)


FILE_NAME = r"^(?:(.*?)\s+)?((?:1[5-9]|20)\d\d)?\s*-\s+(.*?)(?:\.[A-Za-z0-9]{1,5})?$"


def parse_file_name(name):
    """(authors, year, title) of "<authors> <year> - <title>"."""
    return F.struct(F.nullif(F.regexp_extract(name, FILE_NAME, 1), F.lit("")).alias("authors"), F.nullif(F.regexp_extract(name, FILE_NAME, 2), F.lit("")).cast("int").alias("year"), F.nullif(F.regexp_extract(name, FILE_NAME, 3), F.lit("")).alias("title"))


def write_documents(docs: DataFrame, folder: str, name: str = "name", text: str = "markdown") -> DataFrame:
    """Writes one text file a document by Spark's text writer, partitioned by name, and returns (name, error): two documents for one target are an error and neither is written."""
    counted = docs.withColumn("_n", F.count("*").over(W.partitionBy(name)))
    counted.filter("_n = 1").select(name, F.col(text).alias("value")).write.mode("overwrite").partitionBy(name).text(folder)
    return counted.select(name, F.when(F.col("_n") > 1, "two documents have this target").alias("error")).distinct()


def sampled(rows: DataFrame, key: str, n: int, seed: int = 0, but: DataFrame | None = None) -> DataFrame:
    """``n`` rows in the order of a seeded hash of their key, without those of ``but``."""
    left = rows.join(but.select(key), key, "left_anti") if but is not None else rows
    return left.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)

