"""Documents as typed nodes: text and Markdown to nodes, nodes to Markdown, HTML and CSV.

``nodes``: doc_id, node_ix, kind (heading, paragraph, item, footnote, figure, table, formula, html, page), level, text,
number, rows. Block structure is parsed in Arrow batches; everything after that is native expressions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import CJK, column

NODES = "doc_id long, node_ix int, kind string, level int, text string, page int"
FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
ITEM = re.compile(r"^\s*(?:[-*+]|[0-9]{1,9}[.)])[ \t]+(.*)$")
RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")


def markdown_blocks(text: str) -> list[tuple[str, int, str, int]]:
    """(kind, level, text, offset) of a Markdown text's blocks; front matter is left out."""
    out: list[tuple[str, int, str, int]] = []
    lines = text.split("\n")
    at, i = 0, 0
    if lines and lines[0].strip() == "---":
        for k in range(1, len(lines)):
            if lines[k].strip() in ("---", "..."):
                at, i = sum(len(x) + 1 for x in lines[: k + 1]), k + 1
                break
    open_: list[str] = []
    start = at

    def flush(kind: str = "paragraph") -> None:
        if open_:
            out.append((kind, 0, " ".join(x.strip() for x in open_), start))
            open_.clear()

    while i < len(lines):
        line = lines[i]
        fence, heading, item = FENCE.match(line), HEADING.match(line), ITEM.match(line)
        if fence:
            flush()
            body, k = [], i + 1
            while k < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(fence[1])}", lines[k]):
                body.append(lines[k])
                k += 1
            out.append(("html", 0, "<pre><code>" + html.escape("\n".join(body)) + "</code></pre>", at))
            at += sum(len(x) + 1 for x in lines[i : k + 1])
            i = k + 1
            continue
        if heading:
            flush()
            out.append(("heading", len(heading[1]), (heading[2] or "").strip(), at))
        elif open_ and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line):
            title = " ".join(x.strip() for x in open_)
            open_.clear()
            out.append(("heading", 1 if "=" in line else 2, title, start))
        elif RULE.match(line):
            flush()
            out.append(("html", 0, "<hr>", at))
        elif item:
            flush()
            out.append(("item", 0, line.strip() if line.strip()[0].isdigit() else item[1].strip(), at))
        elif not line.strip():
            flush()
        elif line.lstrip().startswith("|") and not open_:
            k = i
            while k < len(lines) and lines[k].lstrip().startswith("|"):
                k += 1
            cells = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines[i:k]]
            out.append(("table", 0, "\n".join("\t".join(r) for r in cells if not all(re.fullmatch(r":?-+:?", c) for c in r)), at))
            at += sum(len(x) + 1 for x in lines[i:k])
            i = k
            continue
        else:
            if not open_:
                start = at
            open_.append(line)
        at += len(line) + 1
        i += 1
    flush()
    return out


JAPANESE = re.compile("[" + CJK.replace(r"\x{", "\\u").replace("}", "") + "]")


def text_blocks(text: str) -> list[tuple[str, int, str, int]]:
    """Paragraphs at blank lines; where more than a fifth is Japanese, one a line. Each with where its part of the text starts."""
    by_line = 5 * len(JAPANESE.findall(text)) > len("".join(text.split()))
    gap = "\n" if by_line else "\n\n"
    parts = text.split(gap)
    starts = accumulate((len(p) + len(gap) for p in parts[:-1]), initial=0)
    bodies = [p.rstrip().lstrip("　") if by_line else " ".join(filter(None, map(str.strip, p.split("\n")))) for p in parts]
    return [("paragraph", 0, body, at) for at, body in zip(starts, bodies, strict=True) if body.strip()]


def parse(docs: DataFrame, markdown: bool = True, pages: int = 1) -> DataFrame:
    """Nodes of (doc_id, text). The page is the block's place in the text, scaled to ``pages``."""
    blocks = markdown_blocks if markdown else text_blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (kind, level, body, at) in enumerate(blocks(text or "")):
                    rows.append((one, k, kind, level, body, min(pages - 1, int(at / max(1, len(text)) * pages))))
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], [x.split()[0] for x in NODES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, NODES)


TAG = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", re.S | re.I)
LEAVES = {"p": "paragraph", "li": "item", "blockquote": "paragraph", "figcaption": "paragraph", "td": "paragraph", "th": "paragraph"}


def html_blocks(source: str) -> list[tuple[str, int, str]]:
    """(kind, level, text) of headings, paragraphs and list items of a page, in order."""
    out: list[tuple[str, int, str]] = []
    kind, level, at, parts = "", 0, 0, []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if kind and text:
            out.append((kind, level, text))
        parts.clear()

    for m in TAG.finditer(source):
        parts.append(source[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if re.fullmatch("h[1-6]", tag) or tag in LEAVES or tag in ("ul", "ol", "div", "nav", "footer", "article", "section", "body", "table"):
            flush()
            kind, level = ("", 0) if m[2] else ("heading", int(tag[1])) if tag[0] == "h" and tag[1:].isdigit() else (LEAVES.get(tag, ""), 0)
        elif tag == "br":
            parts.append(" ")
    flush()
    return out


def html_nodes(pages: DataFrame) -> DataFrame:
    """Nodes of (page_id, html); doc_id is the page's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(one, k, kind, level, text, 0) for one, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, (kind, level, text) in enumerate(html_blocks(source or ""))]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], [x.split()[0] for x in NODES.split(", ")])

    return pages.select(F.col("page_id").cast("long").alias("doc_id"), "html").mapInArrow(run, NODES)


def titles(nodes: DataFrame) -> DataFrame:
    """(doc_id, title): the first heading's text."""
    return nodes.filter("kind = 'heading'").groupBy("doc_id").agg(F.min(F.struct("node_ix", "text")).alias("m")).select("doc_id", F.col("m.text").alias("title"))


def table_cells(rows: Column) -> Column:
    """Cells of tab-separated rows if seven in ten agree on the upper median of 2 to 12 columns, else null; surplus goes into the last cell, short rows are padded."""
    cells = F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, "­", ""), "\t"), lambda c: F.trim(c)))  # a bare F.trim would be given the index, too
    counts = F.array_sort(F.transform(cells, F.size))
    cols = F.get(counts, F.floor(F.size(counts) / 2).cast("int"))
    agree = F.size(F.filter(cells, lambda c: F.size(c) == cols)) * 10 >= F.size(cells) * 7
    fold = lambda c: F.when(F.size(c) > cols, F.concat(F.slice(c, F.lit(1), cols - 1), F.array(F.array_join(F.slice(c, cols, F.greatest(F.size(c) - cols + 1, F.lit(0))), " ")))).otherwise(F.concat(c, F.array_repeat(F.lit(""), F.greatest(cols - F.size(c), F.lit(0)))))
    return F.when((F.size(rows) >= 2) & (cols >= 2) & (cols <= 12) & agree, F.transform(cells, fold))


def pipe_table(cells: Column) -> Column:
    """A Markdown table of an array of rows."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.regexp_replace(c, r"([\\*_`])", r"\\$1"), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    head = F.get(cells, 0)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(head)))
    return F.array_join(F.concat(F.array(row(head), rule), F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), row)), "\n")


def delimited(cells: Column, separator: str = ",") -> Column:
    """Rows as RFC 4180 text with CRLF; short rows are padded to the widest."""
    width = F.array_max(F.transform(cells, F.size))
    quoted = lambda v: F.when(v.rlike(f'[{separator}"\\n\\r]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    full = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0))))
    return F.array_join(F.transform(cells, lambda r: F.concat(F.array_join(F.transform(full(r), quoted), separator), F.lit("\r\n"))), "")


def node_markdown() -> Column:
    """One node as Markdown, without the blank line after it."""
    text = column(rules.esc_md, "text")
    item = F.coalesce(F.concat(column(rules.list_number, "text").cast("string"), F.lit(". "), F.regexp_replace(text, r"^\s*\(?[0-9]+[.)]\s+", "")), F.concat(F.lit("- "), column(rules.strip_marker, "text")))
    cells = table_cells(F.split("text", "\n"))
    return (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.trim(text)))
        .when(F.col("kind") == "item", item)
        .when(F.col("kind") == "footnote", F.concat(F.lit("<small>"), F.trim(text), F.lit("</small>")))
        .when(F.col("kind") == "table", F.coalesce(pipe_table(cells), F.concat(F.lit("```text\n"), F.replace("text", F.lit("\t"), F.lit(" | ")), F.lit("\n```"))))
        .when(F.col("kind") == "formula", F.concat(F.lit("$$\n"), F.col("text"), F.lit("\n$$")))
        .when(F.col("kind") == "page", F.concat(F.lit("<!-- page "), F.col("page") + 1, F.lit(" -->")))
        .when(F.col("kind") == "html", F.col("text"))
        .otherwise(column(rules.guard_line, "md"))
    )


def to_markdown(nodes: DataFrame) -> DataFrame:
    """(doc_id, markdown): items of a list on neighbouring lines, a blank line after everything else."""
    by = W.partitionBy("doc_id").orderBy("node_ix")
    rows = nodes.withColumn("md", F.trim(column(rules.esc_md, "text"))).withColumns({"out": node_markdown(), "next": F.lead("kind").over(by)})
    rows = rows.withColumn("out", F.concat("out", F.when((F.col("kind") == "item") & (F.col("next") == "item"), "\n").otherwise("\n\n")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_ix", "out"))), lambda x: x["out"]), "").alias("markdown"))


def to_html(nodes: DataFrame, translations: DataFrame | None = None) -> DataFrame:
    """(doc_id, html): one page; with ``translations`` (doc_id, node_ix, translated) each node has its translation beside it."""
    text = column(rules.esc_html, "text")
    tag = F.when(F.col("kind") == "heading", F.concat(F.lit("h"), F.col("level"))).when(F.col("kind") == "item", "li").when(F.col("kind") == "footnote", "small").otherwise("p")
    body = F.when(F.col("kind") == "html", F.col("text")).otherwise(F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">")))
    rows = nodes.withColumn("out", body)
    if translations is not None:
        rows = rows.join(translations, ["doc_id", "node_ix"], "left").withColumn("out", F.concat(F.lit('<div class="row"><div>'), "out", F.lit('</div><div id="tr-'), F.col("node_ix"), F.lit('">'), F.coalesce(column(rules.esc_html, "translated"), F.lit("")), F.lit("</div></div>")))
    joined = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_ix", "out"))), lambda x: x["out"]), "\n").alias("body"))
    named = joined.join(titles(nodes), "doc_id", "left")
    return named.select("doc_id", F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"><title>'), F.coalesce(column(rules.esc_html, "title"), F.lit("")), F.lit("</title></head><body>\n"), "body", F.lit("\n</body></html>\n")).alias("html"))


STYLE = "struct<text:string,bold:boolean,italic:boolean,mono:boolean,sup:boolean,sub:boolean,link:string>"


def span_markdown(spans: Column) -> Column:
    """Styled spans as Markdown: emphasis around the words, punctuation that opens a run outside it, no empty emphasis."""

    def one(s: Column) -> Column:
        core = F.trim(s["text"])
        styled = (s["bold"] | s["italic"] | s["mono"]) & core.rlike(r"[\p{L}\p{N}]")
        opening = F.when(styled, F.regexp_extract(core, r"^[.,;:!?)\]}*†‡§\s]*", 0)).otherwise("")
        inner = F.substr(core, F.length(opening) + 1)
        md = F.regexp_replace(inner, r"([\\*_`])", r"\\$1")
        md = F.when(styled & s["mono"], F.concat(F.lit("`"), F.replace(inner, F.lit("`"), F.lit("'")), F.lit("`"))).otherwise(md)
        md = F.when(styled & s["italic"], F.concat(F.lit("*"), md, F.lit("*"))).otherwise(md)
        md = F.when(styled & s["bold"], F.concat(F.lit("**"), md, F.lit("**"))).otherwise(md)
        md = F.when(s["sup"], F.concat(F.lit("<sup>"), md, F.lit("</sup>"))).when(s["sub"], F.concat(F.lit("<sub>"), md, F.lit("</sub>"))).otherwise(md)
        target = F.regexp_replace(F.regexp_replace(F.regexp_replace(s["link"], " ", "%20"), r"\(", "%28"), r"\)", "%29")
        md = F.when(s["link"].isNotNull() & ~s["link"].startswith("#"), F.concat(F.lit("["), md, F.lit("]("), target, F.lit(")"))).otherwise(md)
        lead, trail = F.regexp_extract(s["text"], r"^\s*", 0), F.regexp_extract(s["text"], r"\s*$", 0)
        return F.when(core == "", s["text"]).otherwise(F.concat(lead, opening, md, trail))

    return F.replace(F.array_join(F.transform(spans, one), ""), F.lit("****"), F.lit(""))
