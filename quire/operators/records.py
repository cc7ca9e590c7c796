"""The corpus as records: what kind of document a file is, which pages to look at, which record it may belong to, overrides and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import column
from quire.operators.geometry import PAGE
from quire.operators.matching import author_component

#: Characters that no text has whose codes were decoded: for pages, and for the quick look that leaves C1 controls aside.
UNDECODED, LOST = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{00}-\x{1F}\x{80}-\x{9F}]", r"[\x{FFFD}\x{E000}-\x{F8FF}\x{00}-\x{1F}]"


def page_statistics(lines: DataFrame, images: DataFrame, width: float, height: float) -> DataFrame:
    """(doc_id, page, chars, total, bad, lost, cover, largest): characters that aren't white space, those outside the margins (5 %), those of these that are undecoded, and the shares of the page that all images and the largest one cover. One aggregation a side."""
    bare = column(rules.unspaced, "text")
    inner = (F.col("y0") > 0.05 * height) & (F.col("y1") < 0.95 * height)
    text = lines.groupBy(*PAGE).agg(
        F.sum(F.length(bare)).alias("chars"), F.sum(F.when(inner, F.length(bare)).otherwise(0)).alias("total"),
        F.sum(F.when(inner, F.regexp_count(bare, F.lit(UNDECODED))).otherwise(0)).alias("bad"), F.sum(F.regexp_count(bare, F.lit(LOST))).alias("lost"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / (width * height)
    image = images.groupBy(*PAGE).agg(F.sum(area).alias("cover"), F.max(area).alias("largest"))
    return text.join(image, PAGE, "full").fillna(0, ["chars", "total", "bad", "lost"]).fillna(0.0, ["cover", "largest"])


def page_flags(statistics: DataFrame) -> DataFrame:
    """(doc_id, page, reason, poor, scanned_text): why a page needs recognition ('scan', 'codes' or null), whether a quick look finds its text poor, and whether it is a scan with text over it."""
    reason = F.when((F.col("total") < 20) & (F.col("cover") > 0.5), "scan").when((F.col("total") >= 20) & (F.col("bad") * 10 > F.col("total") * 3), "codes")
    return statistics.select(*PAGE, reason.alias("reason"), ((F.col("chars") < 20) | (F.col("lost") * 10 > F.col("chars") * 3)).alias("poor"), ((F.col("largest") > 0.7) & (F.col("chars") > 100)).alias("scanned_text"))


def document_kinds(statistics: DataFrame, japanese: DataFrame) -> DataFrame:
    """(doc_id, scanned_guess, layer_guess, kind, lang, assessed): by characters and mean image cover of a document's pages; ``japanese``: (doc_id, cjk, letters). A text layer is assessed where at least half of the pages are scans with text."""
    d = statistics.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.avg("chars").alias("mean"), F.avg(F.least("cover", F.lit(1.0))).alias("cover"), F.count("*").alias("pages"), F.sum(((F.col("largest") > 0.7) & (F.col("chars") > 100)).cast("int")).alias("scans"))
    d = d.join(japanese, "doc_id", "left")
    kind = F.when(F.col("cover") > 0.7, F.when(F.col("mean") >= 100, "scan_ocr").otherwise("scan")).otherwise("digital")
    lang = F.when(F.coalesce("letters", F.lit(0)) < 300, "none").when(F.col("cjk") * 10 > F.col("letters") * 3, "ja").otherwise("en")
    return d.select("doc_id", ((F.col("chars") < 200) & (F.col("cover") > 0.5)).alias("scanned_guess"), ((F.col("chars") >= 200) & (F.col("cover") > 0.7)).alias("layer_guess"), kind.alias("kind"), lang.alias("lang"), ((F.col("scans") > 0) & (F.col("scans") * 2 >= F.col("pages"))).alias("assessed"))


def typewriter_reset(spans: DataFrame, scans: DataFrame) -> DataFrame:
    """(doc_id, page, mono): whether typewriter type on a page means anything: not where it is more than half of it, nor on scans (doc_id, page). spans: doc_id, page, chars, mono."""
    share = spans.groupBy(*PAGE).agg(F.sum("chars").alias("n"), F.sum(F.when(F.col("mono"), F.col("chars")).otherwise(0)).alias("m"))
    return share.join(scans.select(*PAGE, F.lit(True).alias("scan")).distinct(), PAGE, "left").select(*PAGE, ((F.col("m") > 0) & (F.col("m") * 2 <= F.col("n")) & F.col("scan").isNull()).alias("mono"))


def filled_sizes(pages: DataFrame) -> DataFrame:
    """pages with size: a page without one takes the last known before it, and those before the first known one take that."""
    by = W.partitionBy("doc_id").orderBy("page")
    return pages.withColumn("size", F.coalesce(F.last("size", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)), F.first("size", ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing))))


def font_numbers(lines: DataFrame, font: str) -> DataFrame:
    """lines with font_id: a number from 0 for each font of a document, in the order of names."""
    return lines.withColumn("font_id", F.dense_rank().over(W.partitionBy("doc_id").orderBy(font)) - 1)


def sample_pages(documents: DataFrame, front: int = 10, body: int = 12, end: int = 6, at: float = 0.4) -> DataFrame:
    """(doc_id, chunk, first, last), from 0, of (doc_id, pages): pages at the front, from two fifths on, and at the end; empty chunks are left out."""
    n = F.col("pages")
    start = F.least(F.greatest(F.lit(front), F.floor(n * at)), F.greatest(F.lit(0), n - body))
    chunk = lambda name, a, b: F.struct(F.lit(name).alias("chunk"), a.cast("long").alias("first"), b.cast("long").alias("last"))
    chunks = F.array(chunk("front", F.lit(0), F.least(n, F.lit(front)) - 1), chunk("body", start, F.least(n, start + body) - 1), chunk("end", F.greatest(F.lit(0), n - end), n - 1))
    return documents.select("doc_id", F.inline(chunks)).filter("last >= first")


def review_pages(documents: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, page), from 1, of (doc_id, pages, flagged, refs): the first page, the first flagged one that is another, and, while there is room, the middle one and the reference list's or else the last."""
    n = F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1))
    other = F.get(F.filter(F.coalesce("flagged", F.array().cast("array<int>")), lambda p: p != 1), 0)
    first = F.array_compact(F.array(F.lit(1), other))
    add = lambda have, p: F.when((F.size(have) < most) & ~F.array_contains(have, p), F.array_append(have, p)).otherwise(have)
    rows = documents.withColumn("_p", first).withColumn("_p", add(F.col("_p"), F.greatest(F.floor(n / 2), F.lit(1)).cast("int"))).withColumn("_p", add(F.col("_p"), F.coalesce("refs", n).cast("int")))
    return rows.select("doc_id", F.explode(F.array_distinct(F.filter("_p", lambda p: (p >= 1) & (p <= n)))).alias("page"))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, q, value): quantiles between the sorted values, interpolated linearly."""
    found = df.groupBy(*keys).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("_q"))
    return found.select(*keys, F.posexplode("_q").alias("_k", "value")).select(*keys, F.get(F.array(*map(F.lit, shares)), F.col("_k")).alias("q"), "value")


def method_name(title: Column, author: Column, year: Column, given: Column, found: Column) -> Column:
    """What kind of match it is, from its components and the two years."""
    base = F.when(title >= 0.999, "exact").otherwise("fuzzy")
    suffix = F.when(given.isNotNull() & found.isNotNull(), "_yr_pm1").otherwise("_yr_unknown")
    return F.when((author >= 1) & (year >= 1), base).when((author >= 1) & (year >= 0.7), F.concat(base, suffix)).when(title >= 0.999, "title_only").otherwise("fuzzy_title_only")


def same_capitals(given: Column, title: Column) -> Column:
    """The bonus for a title that opens as the given one, capitals and all: it tells copies apart that differ in nothing else."""
    return F.when(title.startswith(given), 0.002).otherwise(0.0)


def parents(files: DataFrame, records: DataFrame) -> DataFrame:
    """(file_id, title, keys): for files without a match, the records of the same year and author, and their title where they have but one. files: file_id, author, year; records: key, title, author, others, year."""
    r = records.select("key", F.col("title").alias("rt"), F.col("author").alias("ra"), "others", "year").filter("ra IS NOT NULL")
    pair = files.filter("year IS NOT NULL").join(r, "year").filter(author_component(F.col("author"), F.col("ra"), F.col("others")) >= 0.8)
    found = pair.groupBy("file_id").agg(F.countDistinct("rt").alias("n"), F.min("rt").alias("t"), F.array_sort(F.collect_list("key")).alias("k"))
    return found.select("file_id", F.when(F.col("n") == 1, F.col("t")).alias("title"), F.slice("k", 1, 3).alias("keys"))


def ledger(uses: DataFrame, least: int = 2) -> DataFrame:
    """(font, char, docs, n, shapes): characters of a font that so many documents use, and in how many shapes. uses: doc_id, font, char, shape."""
    return uses.groupBy("font", "char").agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"), F.countDistinct("shape").alias("shapes")).filter(F.col("docs") >= least)


def overridden(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``base`` with the rows of ``other`` in place of those with the same key, column by column where they are given, and its further rows."""
    o = other.select(*(F.col(c).alias(f"_{c}") for c in other.columns))
    both = base.join(o, F.col(key) == F.col(f"_{key}"), "full")
    return both.select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in other.columns else F.col(c) for c in base.columns))


def with_images(documents: DataFrame, images: DataFrame, mark: str) -> DataFrame:
    """(doc_id, text): ``mark`` and a number stand for an image's address (images: doc_id, image, address); unknown ones stay. The text is cut at the marks and put together again by one aggregation."""
    parts = documents.select("doc_id", F.posexplode(F.split("text", mark)).alias("k", "part"))
    parts = parts.withColumn("number", F.when(F.col("k") > 0, F.regexp_extract("part", "^[0-9]+", 0))).withColumn("image", F.expr("try_cast(nullif(number, '') AS int)"))
    found = parts.join(images, ["doc_id", "image"], "left")
    piece = F.when(F.col("k") == 0, F.col("part")).when(F.col("address").isNull(), F.concat(F.lit(mark), "part")).otherwise(F.concat("address", F.substr("part", F.length("number") + 1)))
    return found.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", piece.alias("p")))), lambda s: s["p"]), "").alias("text"))


def used_images(images: DataFrame, documents: DataFrame, mark: str) -> DataFrame:
    """The images (doc_id, image) that a document's text still names."""
    named = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(mark + "([0-9]+)"), F.lit(1))).alias("n")).select("doc_id", F.expr("try_cast(n AS int)").alias("image")).distinct()
    return images.join(named, ["doc_id", "image"], "left_semi")


def named_glyphs(glyphs: DataFrame, table: DataFrame) -> DataFrame:
    """glyphs (font, glyph) with text: by the font's family (table: family, glyph, text), by a name that any family gives it (family null), or by the code point in the name; null if nothing is known."""
    base = F.regexp_extract("glyph", r"^[^.]*", 0)
    rows = glyphs.withColumns({"_family": column(rules.font_family, "font"), "_base": base})
    own = table.filter("family IS NOT NULL").select(F.col("family").alias("_family"), "glyph", F.col("text").alias("_own"))
    any_ = table.filter("family IS NULL").select(F.col("glyph").alias("_base"), F.col("text").alias("_any"))
    digits = F.regexp_extract("_base", "^(?:uni([0-9A-F]{4})|u([0-9A-F]{4,6}))$", 1)
    more = F.regexp_extract("_base", "^u([0-9A-F]{4,6})$", 1)
    code = F.conv(F.when(digits != "", digits).when(more != "", more), 16, 10).cast("int")
    usable = (code >= 0x20) & ~code.between(0x7F, 0x9F) & ~code.between(0xD800, 0xF8FF) & (code <= 0x10FFFF)
    high = F.concat(F.hex(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)), F.hex(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)))
    char = F.decode(F.unhex(F.when(code > 0xFFFF, high).otherwise(F.lpad(F.hex(code), 4, "0"))), "UTF-16BE")
    return rows.join(own, ["_family", "glyph"], "left").join(any_, "_base", "left").withColumn("text", F.coalesce("_own", "_any", F.when(usable, char))).drop("_family", "_base", "_own", "_any")


#: What a symbol font's codes from 0x20 on stand for; fixed values of the public encoding.
SYMBOLS = " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"


def symbol_text(t: Column) -> Column:
    """Text whose characters are a symbol font's codes in the private area from U+F020 on."""
    private = "".join(chr(0xF020 + k) for k in range(len(SYMBOLS)))
    return F.translate(t, private, SYMBOLS)
