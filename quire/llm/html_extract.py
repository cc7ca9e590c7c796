"""Main text of web pages by equivalence classes of template tokens.

A page's tokens are its elements, each with its path of tags and classes and its number among those of that path, and
its texts, each with its path and its number among equal ones. Over all pages of a host, tokens with the same occurrence
vector (the pages that they are on) form an equivalence class; the vectors are compared by random projections, sums over
pages that partial aggregates can add up, so that no host's pages ever meet in one task. Classes that are large and on
enough pages are valid; nested by their paths they are the host's template. (The order of a class's tokens is not
looked at.) Texts of the template are left out, and so is what has a role that is not the article's: menus, headers,
footers, side bars, notices, adverts, forms, comments, by lists of tags and of words. All else is extracted, in page order.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import small_batches, written
from quire.llm.url_filter import host_and_path

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|select|button)\b[^>]*(?<!/)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+")

BLOCKS = set("html head title body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre section article main header footer nav aside form fieldset legend figure figcaption hr address details summary center hgroup menu dialog".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An element of these ends an open element of the second kind.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
#: Elements, and words of their class, id or role, that are not the article's.
OUT_TAGS = set("head title nav footer aside form menu dialog".split())
OUT_WORDS = set("nav navbar navigation menu breadcrumb breadcrumbs sidebar aside notice notices cookie cookies consent gdpr ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies respond disqus share sharing social related newsletter subscribe signup login search popup modal pagination pager".split())
#: The same, but around the article only: in it, and in a name that begins as the article's, they name its own parts.
PAGE_WORDS = set("header masthead topbar footer colophon banner alert overlay widget".split())
ARTICLE_WORDS = set("article post entry content story".split())
#: Names that begin so say what an element holds or lacks, and not what it is.
STATES = set("has have with without no is hide show".split())


class Page:
    """(path, left out by a tag, marks of left-out roles around it, text) of each block, in page order, and how often each path opens."""

    def __init__(self, source: str):
        self.blocks: list[tuple[str, bool, tuple[int, ...], str]] = []
        self.opened: dict[str, int] = {}
        self._marks, self._wrappers = 0, set()
        self._stack: list[tuple[str, str, bool, tuple[int, ...]]] = [("", "", False, ())]  # tag, path, left out, marks
        self._text: list[str] = []
        for m in TOKEN.finditer(source):
            if (text := m["text"]) is not None:
                self._text.append(html.unescape(text))
            elif tag := m["tag"]:
                tag = tag.lower()
                if m["end"]:
                    self._close(tag)
                else:
                    self._open(tag, m["attrs"])
            elif m["raw"]:
                self._text.append(" ")
        self._flush()
        if self._wrappers and not any(not out and not marks for _, out, marks, _ in self.blocks):  # else all of the page would go by its wrapper's name
            self.blocks = [(path, out, tuple(k for k in marks if k not in self._wrappers), text) for path, out, marks, text in self.blocks]

    def _flush(self) -> None:
        if text := " ".join("".join(self._text).split()):
            _, path, out, marks = self._stack[-1]
            self.blocks.append((path, out, marks, text))
        self._text = []

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._text.append(" ")
        if tag in BLOCKS:
            self._flush()
            ends = ENDS.get(tag, {"p"}) | {"p"}
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k][0] in ends:
                    del self._stack[k:]
                    break
                if self._stack[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "td") and tag != "p":
                    break
        if tag in VOID or attrs.endswith("/"):
            return
        _, path, out, marks = self._stack[-1]
        words, names, hidden = set(), "", False
        for key, *values in ATTRIBUTE.findall(attrs) if attrs else ():
            value, key = "".join(values).lower(), key.lower()
            if key == "class":
                names = "." + ".".join(sorted(re.sub(r"\d+", "0", value).split())) if value.strip() else ""
            hidden |= key == "hidden" or key == "aria-hidden" and value == "true"
            for name in value.split():
                found = WORDS.findall(name)
                if found and found[0] not in STATES:
                    words.update(OUT_WORDS.intersection(found) if found[0] in ARTICLE_WORDS else found)
        within = any(t[0] in ("article", "main") for t in self._stack)
        by_tag = hidden or tag in OUT_TAGS or tag == "header" and not within
        by_word = bool(words & (OUT_WORDS if within else OUT_WORDS | PAGE_WORDS)) and (tag not in ("html", "body", "article", "main") or tag == "article" and within)
        if marks and not out and (by_tag or by_word or tag in ("article", "main")):
            self._wrappers.add(marks[0])  # a left-out role, or the article, within another: the outermost is around the page
        out = out or by_tag
        if by_word:
            self._marks += 1
            marks = (*marks, self._marks)
        if tag in BLOCKS:
            path = f"{path}/{tag}{names}"
            self.opened[path] = self.opened.get(path, 0) + 1
        self._stack.append((tag, path, out, marks))

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                del self._stack[k:]
                break
            if self._stack[k][0] in BLOCKS and tag not in BLOCKS:  # an inline end tag does not end a block
                break

    def texts(self) -> Iterator[tuple[int, int, str]]:
        """(token, the parent's token, text) of the blocks that no role leaves out."""
        met: dict[tuple[str, str], int] = {}
        for path, out, marks, text in self.blocks:
            if not out and not marks:
                met[path, text] = n = met.get((path, text), -1) + 1
                yield token(f"{path}\0{n}\0{text}"), token(f"{path}\0000") if path else 0, text

    def elements(self) -> Iterator[tuple[int, int]]:
        """(token, the parent's token) of the elements."""
        for path, times in self.opened.items():
            above = path.rpartition("/")[0]
            parent = token(f"{above}\0000") if above else 0
            for n in range(times):
                yield token(f"{path}\000{n}"), parent

    def text(self, template: set[int]) -> str:
        """The blocks that neither their role nor the template leaves out, one a line; where none is left, those that no role leaves out."""
        found = list(self.texts())
        return "\n".join([t for k, _, t in found if k not in template] or [t for _, _, t in found])


def token(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def projection(page_id: int | None, url: str | None) -> int:
    """The page's coordinate, by which an occurrence vector is projected: 31 random bits that depend on the page alone."""
    return zlib.crc32(f"{page_id}|{url}".encode()) & 0x7FFFFFFF


COUNTS = "host string, token long, parent long, is_text boolean, pages long, vector long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page_id, url, html) -> the tokens of a task's pages, those of a host added up; token 0 is on each page."""
    met: dict[tuple[str, int], list] = {}

    def out() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in met.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in COUNTS.split(", ")])

    for batch in batches:
        for host, one, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page, weight = Page(source or ""), projection(one, url)
            if not page.blocks:
                continue
            tokens = [(0, None, False), *((k, p, False) for k, p in page.elements()), *((k, p, True) for k, p, _ in page.texts())]
            for k, parent, is_text in tokens:
                entry = met.setdefault((host, k), [parent, is_text, 0, 0])
                entry[2] += 1
                entry[3] += weight
        if len(met) > 200_000:
            yield out()
            met = {}
    if met:
        yield out()


#: A class is valid with so many tokens, on so many pages and on so many of ten of its host's.
SIZE, SUPPORT, OF_TEN = 3, 3, 9


def template_texts(tokens: list[tuple[int, int | None, bool, int, int]]) -> list[int]:
    """The texts in the template of a host's tokens (token, parent, is_text, pages, vector) that are on enough pages.

    Equal vectors make a class; of the tokens of large classes, those whose parents are of such classes too, up to the page, are the template.
    """
    classes: dict[tuple[int, int], int] = {}
    for t in tokens:
        classes[t[3], t[4]] = classes.get((t[3], t[4]), 0) + 1
    valid = {t[0]: t[1] for t in tokens if classes[t[3], t[4]] >= SIZE}
    nested: dict[int, bool] = {0: True}

    def within(k: int | None) -> bool:
        way = []
        while k is not None and k not in nested:
            way.append(k)
            k = valid.get(k)
        found = k is not None and nested[k]
        nested.update(dict.fromkeys(way, found))
        return found

    return [t[0] for t in tokens if t[2] and t[0] in valid and within(t[0])]


#: Template texts up to which the templates are handed to all tasks (8 bytes each, and the hosts); beyond, they are joined.
HANDED = 100_000


def templates(pages: DataFrame) -> DataFrame:
    """(host, texts) from (host, page_id, url, html), for hosts that have template texts."""
    counts = pages.select("host", "page_id", "url", "html").mapInArrow(_counted, COUNTS)
    counts = counts.groupBy("host", "token").agg(F.min("parent").alias("parent"), F.min("is_text").alias("is_text"), *(F.sum(c).alias(c) for c in ("pages", "vector")))
    often = written(counts.filter(F.col("pages") >= SUPPORT), "tokens")
    most = often.filter("token = 0").select(F.col("host").alias("of"), F.col("pages").alias("most"))
    often = often.join(most, F.col("host") == F.col("of")).filter(F.col("pages") * 10 >= F.col("most") * OF_TEN)  # hardly more tokens than a page has
    texts = F.udf(lambda rows: template_texts([tuple(r) for r in rows or ()]), T.ArrayType(T.LongType()))
    found = often.groupBy("host").agg(texts(F.collect_list(F.struct("token", "parent", "is_text", "pages", "vector"))).alias("texts"))
    return found.filter(F.size("texts") > 0)


def html_extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``, which needs page_id, url and html.

    Blocks are elements that a browser sets apart; white space in a block becomes one space. Of a
    host with fewer than SUPPORT pages, and of a page that is all template, only roles leave out blocks. Null and empty pages have an empty text; pages without a host
    share one. Repeated rows are extracted each; an empty table gives an empty result. Other columns are not looked at.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host, _ = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id"), "url", "html", host.alias("host"))
    found = written(templates(rows), "templates").withColumnRenamed("host", "of")
    if (found.agg(F.sum(F.size("texts") + 5)).first()[0] or 0) <= HANDED:
        found = F.broadcast(found)
    joined = rows.join(found, rows["host"] == F.col("of"), "left").select("page_id", "url", "html", "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source or "").text(set(template or ())) for source, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
