"""Queries over units, page flags, records and lookups, with SQL that tells them in its own way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import DUCK, column
from quire.functions.fixture import GLYPHS, HEADINGS, NODES, TITLES, VERSIONS
from quire.operators import geometry, records, units
from quire.plans.operators import LAYOUT, L, layout, table
from quire.plans.rules import lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
HEIGHT, WIDTH = 400.0, 600.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def values(rows: list[tuple], columns: str) -> str:
    """Made rows as SQL."""
    one = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") made({columns}))"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made images: every third page is covered by one, every fifth has a small one."""
    pages = layout(spark, sf_dir).select("doc_id", "page").distinct()
    big = pages.filter("(doc_id + page) % 3 = 0").select("doc_id", "page", *(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (0.0, 0.0, WIDTH, 320.0), strict=True)))
    small = pages.filter("(doc_id + page) % 5 = 0").select("doc_id", "page", *(F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), (10.0, 10.0, 110.0, 90.0), strict=True)))
    return big.unionByName(small)


IMAGES = f"""(SELECT doc_id, page, 0.0 AS x0, 0.0 AS y0, {WIDTH} AS x1, 320.0 AS y1 FROM (SELECT DISTINCT doc_id, page FROM {LAYOUT}) WHERE (doc_id + page) % 3 = 0
 UNION ALL SELECT doc_id, page, 10.0, 10.0, 110.0, 90.0 FROM (SELECT DISTINCT doc_id, page FROM {LAYOUT}) WHERE (doc_id + page) % 5 = 0)"""
BARE = rules.unspaced(DUCK, "text")
STATISTICS = f"""(WITH t AS (SELECT doc_id, page, sum(length({BARE})) AS chars, sum(CASE WHEN y0 > {HEIGHT} * 0.05 AND y1 < {HEIGHT} * 0.95 THEN length({BARE}) ELSE 0 END) AS total,
  sum(CASE WHEN y0 > {HEIGHT} * 0.05 AND y1 < {HEIGHT} * 0.95 THEN len(regexp_extract_all({BARE}, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}\\x{{00}}-\\x{{1F}}\\x{{80}}-\\x{{9F}}]')) ELSE 0 END) AS bad,
  sum(len(regexp_extract_all({BARE}, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}\\x{{00}}-\\x{{1F}}]'))) AS lost FROM {LAYOUT} GROUP BY ALL),
 i AS (SELECT doc_id, page, sum((x1 - x0) * (y1 - y0) / {WIDTH * HEIGHT}) AS cover, max((x1 - x0) * (y1 - y0) / {WIDTH * HEIGHT}) AS largest FROM {IMAGES} GROUP BY ALL)
 SELECT doc_id, page, chars, total, bad, lost, coalesce(cover, 0) AS cover, coalesce(largest, 0) AS largest FROM t LEFT JOIN i USING (doc_id, page))"""


def statistics(spark, sf_dir):
    return records.page_statistics(layout(spark, sf_dir), images(spark, sf_dir), WIDTH, HEIGHT)


@query(f"""SELECT doc_id, page, CASE WHEN total < 20 AND cover > 0.5 THEN 'scan' WHEN total >= 20 AND bad > 0.3 * total THEN 'codes' END AS reason, chars < 20 OR lost > 0.3 * chars AS poor, largest > 0.7 AND chars > 100 AS scanned_text FROM {STATISTICS}""")
def page_flags(spark, sf_dir):
    return records.page_flags(statistics(spark, sf_dir))


@query(f"SELECT doc_id, page FROM {STATISTICS} WHERE (total < 20 AND cover > 0.5) OR (total >= 20 AND bad > 0.3 * total)")
def unusable_layers(spark, sf_dir):
    return records.page_flags(statistics(spark, sf_dir)).filter("reason IS NOT NULL").select("doc_id", "page")


@query(f"""WITH d AS (SELECT doc_id, sum(chars) AS chars, avg(chars) AS mean, avg(least(cover, 1.0)) AS cover, count(*) AS pages, count(*) FILTER (WHERE largest > 0.7 AND chars > 100) AS scans FROM {STATISTICS} GROUP BY doc_id),
 j AS (SELECT doc_id, sum(len(regexp_extract_all(text, '[\\x{{3000}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}]'))) AS cjk, sum(length({BARE})) AS letters FROM {LAYOUT} GROUP BY doc_id)
 SELECT doc_id, chars < 200 AND d.cover > 0.5 AS scanned_guess, chars >= 200 AND d.cover > 0.7 AS layer_guess, CASE WHEN d.cover <= 0.7 THEN 'digital' WHEN mean < 100 THEN 'scan' ELSE 'scan_ocr' END AS kind,
 CASE WHEN letters < 300 THEN 'none' WHEN cjk > 0.3 * letters THEN 'ja' ELSE 'en' END AS lang, scans > 0 AND scans >= pages / 2 AS assessed FROM d JOIN j USING (doc_id)""")
def document_kinds(spark, sf_dir):
    japanese = layout(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[\x{3000}-\x{30FF}\x{3400}-\x{9FFF}]"))).alias("cjk"), F.sum(F.length(column(rules.unspaced, "text"))).alias("letters"))
    return records.document_kinds(statistics(spark, sf_dir), japanese)


@query(f"""WITH s AS (SELECT doc_id, page, sum(length(text)) AS n, sum(CASE WHEN line_ix % 3 = 0 OR length(text) < 20 THEN length(text) ELSE 0 END) AS m FROM {LAYOUT} GROUP BY ALL)
 SELECT doc_id, page, m > 0 AND m <= n / 2 AND (doc_id + page) % 3 <> 0 AS mono FROM s""")
def typewriter_reset(spark, sf_dir):
    rows = layout(spark, sf_dir)
    spans = rows.select("doc_id", "page", F.length("text").alias("chars"), ((F.col("line_ix") % 3 == 0) | (F.length("text") < 20)).alias("mono"))
    return records.typewriter_reset(spans, rows.filter("(doc_id + page) % 3 = 0").select("doc_id", "page"))


@query(f"""WITH p AS (SELECT doc_id, page, CASE WHEN count(*) >= 15 OR (doc_id + page) % 4 = 1 THEN max(x1) END AS size FROM {LAYOUT} GROUP BY doc_id, page),
 k AS (SELECT p.doc_id, p.page, max(CASE WHEN q.page <= p.page THEN q.page END) AS before, min(CASE WHEN q.page > p.page THEN q.page END) AS after FROM p LEFT JOIN p q ON p.doc_id = q.doc_id AND q.size IS NOT NULL GROUP BY ALL)
 SELECT k.doc_id, k.page, s.size FROM k LEFT JOIN p s ON k.doc_id = s.doc_id AND s.page = coalesce(k.before, k.after)""")
def filled_sizes(spark, sf_dir):
    pages = layout(spark, sf_dir).groupBy("doc_id", "page").agg(F.when((F.count("*") >= 15) | ((F.col("doc_id") + F.col("page")) % 4 == 1), F.max("x1")).alias("size"))
    return records.filled_sizes(pages)


@query(f"""WITH f AS (SELECT doc_id, line_ix, 'F' || (length(text) % 7) AS font FROM {LAYOUT}), d AS (SELECT DISTINCT doc_id, font FROM f)
 SELECT f.doc_id, f.line_ix, (SELECT count(*) FROM d WHERE d.doc_id = f.doc_id AND d.font < f.font) AS font_id FROM f""")
def font_numbers(spark, sf_dir):
    rows = layout(spark, sf_dir).select("doc_id", "line_ix", F.concat(F.lit("F"), F.length("text") % 7).alias("font"))
    return records.font_numbers(rows, "font").select("doc_id", "line_ix", F.col("font_id").cast("long").alias("font_id"))


COUNTS = f"(SELECT doc_id, max(page) + 1 AS pages FROM {LAYOUT} GROUP BY doc_id)"


@query(f"""WITH d AS (SELECT doc_id, pages AS n, least(greatest(2, cast(floor(pages * 0.4) AS INT)), greatest(0, pages - 3)) AS s FROM {COUNTS})
 SELECT doc_id, 'front' AS chunk, 0 AS first, least(n, 2) - 1 AS last FROM d UNION ALL SELECT doc_id, 'body', s, least(n, s + 3) - 1 FROM d WHERE n > s UNION ALL SELECT doc_id, 'end', greatest(0, n - 2), n - 1 FROM d""")
def sample_pages(spark, sf_dir):
    counts = layout(spark, sf_dir).groupBy("doc_id").agg((F.max("page") + 1).alias("pages"))
    return records.sample_pages(counts, front=2, body=3, end=2)


@query(f"""WITH d AS (SELECT doc_id, max(page) + 1 AS n, min(CASE WHEN length(text) > 90 AND page > 0 THEN page + 1 END) AS flagged, min(CASE WHEN {rules.is_refs_heading(DUCK, 'text')} THEN page + 1 END) AS refs FROM {LAYOUT} GROUP BY doc_id),
 p AS (SELECT doc_id, 1 AS page FROM d UNION SELECT doc_id, flagged FROM d WHERE flagged IS NOT NULL UNION SELECT doc_id, greatest(n // 2, 1) FROM d UNION SELECT doc_id, coalesce(refs, n) FROM d)
 SELECT doc_id, page FROM p""")
def review_pages(spark, sf_dir):
    flagged = F.array_distinct(F.array_sort(F.collect_list(F.when(F.length("text") > 90, F.col("page") + 1))))
    refs = F.min(F.when(column(rules.is_refs_heading, "text"), F.col("page") + 1))
    return records.review_pages(layout(spark, sf_dir).groupBy("doc_id").agg((F.max("page") + 1).alias("pages"), flagged.alias("flagged"), refs.alias("refs")))


@query("""SELECT source, unnest([0.1, 0.5, 0.9]) AS q, unnest([quantile_cont(n_chars, 0.1), quantile_cont(n_chars, 0.5), quantile_cont(n_chars, 0.9)]) AS value FROM documents GROUP BY source""")
def length_quantiles(spark, sf_dir):
    return records.quantiles(table(spark, sf_dir, "documents"), ["source"], "n_chars", [0.1, 0.5, 0.9])


@query(f"""WITH u AS (SELECT doc_id, source AS font, unnest(regexp_extract_all(text, '[^ -~\\n]')) AS char, length(text) % 3 AS shape FROM documents)
 SELECT font, char, count(DISTINCT doc_id) AS docs, count(*) AS n, count(DISTINCT shape) AS shapes FROM u GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2""")
def glyph_ledger(spark, sf_dir):
    uses = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("font"), F.explode(F.regexp_extract_all("text", F.lit(r"[^ -~\n]"), F.lit(0))).alias("char"), (F.length("text") % 3).alias("shape"))
    return records.ledger(uses)


@query("""WITH b AS (SELECT doc_id, lang, n_chars FROM documents), o AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'xx' END AS lang FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT -5, 'new')
 SELECT coalesce(o.doc_id, b.doc_id) AS doc_id, coalesce(o.lang, b.lang) AS lang, b.n_chars FROM b FULL JOIN o ON b.doc_id = o.doc_id""")
def overridden_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    other = docs.filter("doc_id % 7 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "xx").alias("lang")).unionByName(spark.createDataFrame([(-5, "new")], "doc_id long, lang string"))
    return records.overridden(docs, other, "doc_id")


TITLES_SQL = values(TITLES, "file_id, title, author, year")
BOOKS = "(SELECT item_id AS key, lower(text) AS title, substr(text, 1, 1) AS author, 1990 + item_id % 5 AS year FROM benchmark)"


@query(f"""WITH p AS (SELECT f.file_id, b.title, b.key FROM {TITLES_SQL} f JOIN {BOOKS} b ON f.year = b.year AND f.author = b.author)
 SELECT file_id, CASE WHEN count(DISTINCT title) = 1 THEN min(title) END AS title, list_sort(list(key))[1:3] AS keys FROM p GROUP BY file_id""")
def parent_records(spark, sf_dir):
    files = spark.createDataFrame(TITLES, "file_id long, title string, author string, year long")
    books = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.lower("text").alias("title"), F.substr("text", F.lit(1), F.lit(1)).alias("author"), F.array().cast("array<string>").alias("others"), (1990 + F.col("item_id") % 5).alias("year"))
    return records.parents(files, books)


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.9 END AS t, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.7 END AS a, CASE WHEN doc_id % 5 = 0 THEN 1.0 WHEN doc_id % 5 = 1 THEN 0.7 ELSE 0.0 END AS y, CASE WHEN doc_id % 7 <> 0 THEN 1999 END AS fy FROM documents)
 SELECT doc_id, CASE WHEN a < 1 OR y < 0.7 THEN CASE WHEN t > 0.99 THEN 'title_only' ELSE 'fuzzy_title_only' END ELSE CASE WHEN t > 0.99 THEN 'exact' ELSE 'fuzzy' END || CASE WHEN y = 1 THEN '' WHEN fy IS NULL THEN '_yr_unknown' ELSE '_yr_pm1' END END AS method FROM c""")
def match_methods(spark, sf_dir):
    d = F.col("doc_id")
    year = F.when(d % 5 == 0, 1.0).when(d % 5 == 1, 0.7).otherwise(0.0)
    return table(spark, sf_dir, "documents").select("doc_id", records.method_name(F.when(d % 3 == 0, 1.0).otherwise(0.9), F.when(d % 2 == 0, 1.0).otherwise(0.7), year, F.when(d % 7 != 0, 1999), F.lit(2000)).alias("method"))


@query(f"SELECT a.v AS latest, b.v AS current, {rules.version_key(DUCK, 'a.v')} > {rules.version_key(DUCK, 'b.v')} AS newer FROM {values([(v,) for v in VERSIONS], 'v')} a JOIN {values([(v,) for v in VERSIONS], 'v')} b ON a.v <> b.v")
def newer_versions(spark, sf_dir):
    a = spark.createDataFrame([(x, y) for x in VERSIONS for y in VERSIONS if x != y], "latest string, current string")
    return a.withColumn("newer", column(rules.version_key, "latest") > column(rules.version_key, "current"))


MARK = "image:"
IMAGE_TEXTS = "(SELECT doc_id, regexp_replace(text, ' de ', ' image:' || (doc_id % 4) || 'x ', 'g') AS text FROM documents)"


def image_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit(" de "), F.concat(F.lit(" image:"), F.col("doc_id") % 4, F.lit("x "))).alias("text"))


def image_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("image")).withColumn("address", F.concat(F.lit("media/"), "doc_id", F.lit("-"), "image", F.lit(".png")))


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN replace(text, 'image:' || (doc_id % 4), 'media/' || doc_id || '-' || (doc_id % 4) || '.png') ELSE text END AS text FROM {IMAGE_TEXTS}")
def texts_with_images(spark, sf_dir):
    return records.with_images(image_texts(spark, sf_dir), image_list(spark, sf_dir), MARK)


@query(f"SELECT doc_id, cast(doc_id % 4 AS INT) AS image FROM {IMAGE_TEXTS} WHERE doc_id % 4 < 3 AND contains(text, 'image:')")
def used_images(spark, sf_dir):
    return records.used_images(image_list(spark, sf_dir), image_texts(spark, sf_dir), MARK).select("doc_id", "image")


GLYPH_TABLE = [("caslon", "g1", "ff"), (None, "equals", "="), (None, "radical", "√")]


@query(f"""WITH g AS (SELECT *, lower(regexp_replace(font, '^[A-Z]{{6}}\\+', '')) AS fam, split_part(glyph, '.', 1) AS base FROM {values(GLYPHS, 'font, glyph')}),
 h AS (SELECT *, CASE WHEN regexp_matches(base, '^uni[0-9A-F]{{4}}$') THEN ('0x' || substr(base, 4))::INT WHEN regexp_matches(base, '^u[0-9A-F]{{4,6}}$') THEN ('0x' || substr(base, 2))::INT END AS code FROM g)
 SELECT font, glyph, CASE WHEN fam = 'caslon' AND glyph = 'g1' THEN 'ff' WHEN base = 'equals' THEN '=' WHEN base = 'radical' THEN '√' WHEN code >= 32 AND NOT code BETWEEN 127 AND 159 AND NOT code BETWEEN 55296 AND 63743 THEN chr(code) END AS text FROM h""")
def glyph_names(spark, sf_dir):
    return records.named_glyphs(spark.createDataFrame(GLYPHS, "font string, glyph string"), spark.createDataFrame(GLYPH_TABLE, "family string, glyph string, text string"))


# --- units


TWICE = f"(SELECT * FROM {LAYOUT} UNION ALL SELECT doc_id, page, line_ix + 100000, x0, y0, x1, y1, size, text || '!' FROM {LAYOUT} WHERE line_ix % 4 = 0)"


@query(f"SELECT doc_id, page, min(line_ix) AS line_ix FROM {TWICE} GROUP BY doc_id, page, x0, y0, x1, y1")
def distinct_boxes(spark, sf_dir):
    rows = layout(spark, sf_dir)
    twice = rows.unionByName(rows.filter("line_ix % 4 = 0").withColumns({"line_ix": F.col("line_ix") + 100000, "text": F.concat("text", F.lit("!"))}))
    return units.distinct_boxes(twice).select("doc_id", "page", "line_ix")


RUNS = f"""(WITH b AS (SELECT *, CASE WHEN length(text) % 6 > 0 THEN line_ix // 7 END AS block FROM {LAYOUT}), c AS (SELECT *, CASE WHEN block = lag(block) OVER (PARTITION BY doc_id, page ORDER BY line_ix) THEN 0 ELSE 1 END AS s FROM b)
 SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY line_ix) - 1 AS run FROM c)"""


def blocked(spark, sf_dir):
    return layout(spark, sf_dir).withColumn("block", F.when(F.length("text") % 6 > 0, F.floor(F.col("line_ix") / 7)))


@query(f"SELECT doc_id, page, line_ix, cast(run AS BIGINT) AS run FROM {RUNS}")
def recognised_blocks(spark, sf_dir):
    return units.recognised_blocks(blocked(spark, sf_dir)).select("doc_id", "page", "line_ix", "run")


@query(f"""WITH r AS (SELECT *, greatest(y1 - y0, 1) AS h, min(x0) OVER g AS l, max(x1) OVER g AS r, lag(x1) OVER o AS px1, lag(y1) OVER o AS py1 FROM {RUNS} WINDOW g AS (PARTITION BY doc_id, page, run), o AS (PARTITION BY doc_id, page, run ORDER BY line_ix)),
 s AS (SELECT *, CASE WHEN py1 IS NOT NULL AND (x0 - l > 0.7 * h OR px1 < r - 1.5 * h OR y0 - py1 > 1.5 * h) THEN 1 ELSE 0 END AS s2 FROM r WHERE true)
 SELECT doc_id, page, line_ix, cast(sum(s2) OVER (PARTITION BY doc_id, page, run ORDER BY line_ix) AS BIGINT) AS para FROM s""")
def recognised_paragraphs(spark, sf_dir):
    wide = blocked(spark, sf_dir).withColumn("x1", F.greatest("x1", F.col("x0") + 0))
    return units.recognised_paragraphs(wide).select("doc_id", "page", "line_ix", "para")


@query(f"SELECT doc_id, page, md5(string_agg(text, chr(10) ORDER BY line_ix) || chr(10)) AS text_md5 FROM {LAYOUT} GROUP BY ALL")
def page_texts(spark, sf_dir):
    return units.page_texts(layout(spark, sf_dir)).select("doc_id", "page", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, page, coalesce(min(y0) FILTER (WHERE y1 - y0 > x1 - x0 AND size BETWEEN 11.9 AND 16.1), 0) AS top, coalesce(max(y1) FILTER (WHERE y1 - y0 > x1 - x0 AND size BETWEEN 11.9 AND 16.1), 0) AS bottom FROM {LAYOUT} GROUP BY ALL")
def upright_area(spark, sf_dir):
    return units.upright_area(layout(spark, sf_dir), body=14.0)


@query(f"SELECT doc_id, page, line_ix // 3 AS unit, arg_min(text, line_ix) AS first_text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS lines FROM {LAYOUT} GROUP BY ALL")
def unit_boxes(spark, sf_dir):
    return units.units(layout(spark, sf_dir).withColumn("unit", F.floor(F.col("line_ix") / 3)), "unit")


@query(f"SELECT doc_id, cast(line_ix // 25 + 1 AS INT) AS page, count(*) AS lines FROM {L} WHERE line_ix >= 25 AND NOT regexp_matches(line, '^=== p[0-9]+') GROUP BY ALL")
def dump_pages(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", (F.col("line_ix") * 2 + 1).alias("row_ix"), "line")
    marks = lines(spark, sf_dir).filter("line_ix % 25 = 0 AND line_ix > 0").select("doc_id", (F.col("line_ix") * 2).alias("row_ix"), F.concat(F.lit("=== p"), F.floor(F.col("line_ix") / 25) + 1).alias("line"))
    return units.dump_pages(rows.unionByName(marks)).groupBy("doc_id", "page").agg(F.count("*").alias("lines"))


@query(f"""WITH r AS (SELECT *, CASE WHEN length(text) < 30 THEN 'a' ELSE 'b' END AS role FROM {LAYOUT}), p AS (SELECT *, lag(role) OVER o AS pr, lag(size) OVER o AS ps FROM r WINDOW o AS (PARTITION BY doc_id, page ORDER BY line_ix))
 SELECT doc_id, page, line_ix, cast(sum(CASE WHEN pr IS NOT NULL AND (pr <> role OR greatest(size, ps) > 1.25 * least(size, ps)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY line_ix) AS BIGINT) AS run FROM p""")
def unit_runs(spark, sf_dir):
    return units.runs(layout(spark, sf_dir), F.when(F.length("text") < 30, "a").otherwise("b")).select("doc_id", "page", "line_ix", "run")


@query(f"""WITH e AS (SELECT *, line_ix // 10 AS unit, {rules.is_equation_line(DUCK, 'text')} AS e FROM {LAYOUT}), p AS (SELECT *, lag(e) OVER (PARTITION BY doc_id, page, unit ORDER BY line_ix) AS pe FROM e)
 SELECT doc_id, page, line_ix, cast(sum(CASE WHEN pe IS NULL THEN 0 WHEN e OR pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, unit ORDER BY line_ix) AS BIGINT) AS part FROM p""")
def equation_parts(spark, sf_dir):
    return units.equation_parts(layout(spark, sf_dir).withColumn("unit", F.floor(F.col("line_ix") / 10))).select("doc_id", "page", "line_ix", "part")


@query()
def merged_formulas(spark, sf_dir):
    return units.merged_formulas(layout(spark, sf_dir).withColumnRenamed("line_ix", "unit")).filter("formula != unit")


@query()
def stitched_rows(spark, sf_dir):
    return units.stitched_rows(layout(spark, sf_dir))


NODES_SQL = values(NODES, "doc_id, node_ix, kind, level, text")


@query(f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY node_ix) AS k, CASE WHEN kind IN ('paragraph', 'item') THEN {rules.own_equation_number(DUCK, 'text')} END AS num FROM {NODES_SQL} WHERE kind <> 'page')
 SELECT a.doc_id, a.node_ix, CASE WHEN a.kind = 'item' AND a.num IS NOT NULL THEN 'paragraph' ELSE a.kind END AS kind, CASE WHEN a.kind = 'formula' THEN c.num END AS number FROM n a LEFT JOIN n b ON a.doc_id = b.doc_id AND b.k = a.k - 1 LEFT JOIN n c ON a.doc_id = c.doc_id AND c.k = a.k + 1
 WHERE NOT (a.num IS NOT NULL AND coalesce(b.kind, '') = 'formula')""")
def numbered_formulas(spark, sf_dir):
    return units.numbered_formulas(spark.createDataFrame(NODES, "doc_id long, node_ix int, kind string, level int, text string")).select("doc_id", "node_ix", "kind", "number")


@query(f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY node_ix) AS k, regexp_extract(text, '^\\s*([IVX]+)[.．]', 1) AS r, count(*) FILTER (WHERE regexp_matches(text, '^\\s*(I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII)[.．]')) OVER (PARTITION BY doc_id) AS kept FROM {values(HEADINGS, 'doc_id, node_ix, text')}),
 n AS (SELECT unnest(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII']) AS r, unnest(range(1, 13)) AS i),
 s AS (SELECT doc_id, node_ix, k, kept, h.r, text AS t0, text, coalesce(n.i, 0) AS last FROM h LEFT JOIN n USING (r) WHERE k = 1
  UNION ALL SELECT h.doc_id, h.node_ix, h.k, h.kept, h.r, h.text, CASE WHEN n.i IS NULL AND s.last > 0 AND s.last < 12 AND h.kept >= 2 AND regexp_matches(h.text, '^\\s*[.．]\\s*[\\x{{3000}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}]') THEN m.r || ltrim(h.text) ELSE h.text END,
   CASE WHEN n.i IS NOT NULL THEN n.i WHEN s.last > 0 AND s.last < 12 AND h.kept >= 2 AND regexp_matches(h.text, '^\\s*[.．]\\s*[\\x{{3000}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}]') THEN s.last + 1 ELSE s.last END
   FROM s JOIN h ON h.doc_id = s.doc_id AND h.k = s.k + 1 LEFT JOIN n ON n.r = h.r LEFT JOIN n m ON m.i = s.last + 1)
 SELECT doc_id, node_ix, text FROM s""")
def repaired_romans(spark, sf_dir):
    return units.repaired_romans(spark.createDataFrame(HEADINGS, "doc_id long, node_ix int, text string"))


@query(f"""WITH h AS (SELECT *, lag(line_ix) OVER w AS pl, lag(size) OVER w AS ps, lag(y1) OVER w AS py, lag(x1) OVER w AS px1, lag(x0) OVER w AS px0 FROM (SELECT * FROM {LAYOUT} WHERE length(text) < 40) WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_ix)),
 s AS (SELECT *, CASE WHEN pl = line_ix - 1 AND abs(size - ps) <= 0.05 * size AND y0 - py BETWEEN -2 AND 0.8 * size - 1e-9 AND x0 < px1 AND x1 > px0 AND {rules.heading_number(DUCK, 'text')} IS NULL THEN 0 ELSE 1 END AS s FROM h), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY line_ix) AS g FROM s)
 SELECT doc_id, page, min(line_ix) AS line_ix, count(*) AS lines FROM g GROUP BY doc_id, page, g""")
def continued_headings(spark, sf_dir):
    rows = layout(spark, sf_dir).withColumn("level", F.when(F.length("text") < 40, 2))
    return units.continued_headings(rows).select("doc_id", "page", "line_ix", "lines")


MARGIN = f"(SELECT * FROM {LAYOUT} UNION ALL SELECT doc_id, page, 200000 + line_ix, 10.0, y0, 25.0, y1, 8.0, (line_ix * 5)::VARCHAR FROM {LAYOUT} WHERE line_ix % 2 = 0 AND doc_id % 2 = 0)"


@query(f"""WITH n AS (SELECT *, {rules.bare_number(DUCK, 'text')} AS num FROM {MARGIN}), c AS (SELECT doc_id, page, x1 AS edge, min(x0) AS l FROM n WHERE num GROUP BY ALL HAVING count(*) >= 8),
 m AS (SELECT c.doc_id, c.page, c.edge FROM c LEFT JOIN n o ON o.doc_id = c.doc_id AND o.page = c.page AND NOT o.num GROUP BY c.doc_id, c.page, c.edge, c.l HAVING count(*) FILTER (WHERE o.x0 < edge - 1) * 10 <= count(o.x0) OR count(*) FILTER (WHERE o.x1 > c.l + 1) * 10 <= count(o.x0))
 SELECT doc_id, page, line_ix FROM n WHERE NOT (num AND EXISTS (SELECT 1 FROM m WHERE m.doc_id = n.doc_id AND m.page = n.page AND m.edge = n.x1))""")
def without_line_numbers(spark, sf_dir):
    rows = layout(spark, sf_dir)
    numbers = rows.filter("line_ix % 2 = 0 AND doc_id % 2 = 0").select("doc_id", "page", (F.col("line_ix") + 200000).alias("line_ix"), F.lit(10.0).alias("x0"), "y0", F.lit(25.0).alias("x1"), "y1", F.lit(8.0).alias("size"), (F.col("line_ix") * 5).cast("string").alias("text"))
    return units.without_line_numbers(rows.unionByName(numbers)).select("doc_id", "page", "line_ix")


COLUMNS = [(0, 10.0, 20.0, 30.0, 300.0, True), (1, 50.0, 20.0, 250.0, 280.0, False), (2, 300.0, 20.0, 320.0, 290.0, True), (3, 400.0, 300.0, 500.0, 390.0, False), (4, 520.0, 310.0, 540.0, 380.0, True), (5, 560.0, 10.0, 580.0, 30.0, True)]


@query(f"""WITH p AS (SELECT DISTINCT doc_id, page FROM {LAYOUT}), c AS (SELECT p.*, m.* FROM p CROSS JOIN {values(COLUMNS, 'col, x0, y0, x1, y1, is_margin')} m),
 d AS (SELECT a.doc_id, a.page, a.col, b.col AS "to", row_number() OVER (PARTITION BY a.doc_id, a.page, a.col ORDER BY CASE WHEN b.x0 < a.x0 THEN 0 ELSE 1 END, greatest(a.x0 - b.x1, b.x0 - a.x1, 0), b.col) AS k
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.page = b.page AND NOT b.is_margin AND least(a.y1, b.y1) - greatest(a.y0, b.y0) >= 0.5 * least(a.y1 - a.y0, b.y1 - b.y0) AND (b.x0 < a.x0 OR b.x1 > a.x0) WHERE a.is_margin)
 SELECT c.doc_id, c.page, c.col, d."to" FROM c LEFT JOIN d ON c.doc_id = d.doc_id AND c.page = d.page AND c.col = d.col AND d.k = 1 WHERE c.is_margin""")
def attached_margins(spark, sf_dir):
    made = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("col", "x0", "y0", "x1", "y1", "is_margin"), c, strict=True))) for c in COLUMNS))
    return units.attached_margins(layout(spark, sf_dir).select("doc_id", "page").distinct().select("doc_id", "page", F.inline(made)))


@query(f"""WITH s AS (SELECT doc_id, page, line_ix, unnest(range(length(text))) AS char_ix, x0, y0, y1, (x1 - x0) / length(text) AS w FROM {LAYOUT})
 SELECT doc_id, page, line_ix, min(x0 + char_ix * w) AS x0, min(y0) AS y0, max(x0 + (char_ix + 1) * w) AS x1, max(y1) AS y1 FROM s WHERE (line_ix > 3 OR (line_ix = 3 AND char_ix >= 2)) AND (line_ix < 9 OR (line_ix = 9 AND char_ix <= 4)) GROUP BY ALL""")
def selection_boxes(spark, sf_dir):
    rows = layout(spark, sf_dir).withColumn("w", (F.col("x1") - F.col("x0")) / F.length("text")).select("*", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("char_ix"))
    chars = rows.select("doc_id", "page", "line_ix", "char_ix", (F.col("x0") + F.col("char_ix") * F.col("w")).alias("x0"), "y0", (F.col("x0") + (F.col("char_ix") + 1) * F.col("w")).alias("x1"), "y1")
    at = lambda a, b: F.struct(F.lit(a).alias("line_ix"), F.lit(b).alias("char_ix"))
    return units.selection_boxes(chars, at(3, 2), at(9, 4))


# --- figures and tables


@query(f"""WITH c AS (SELECT doc_id, page, line_ix AS caption, x0, y0, x1, y1 FROM {LAYOUT} WHERE line_ix % 9 = 5), f AS (SELECT * FROM {LAYOUT} WHERE line_ix % 9 = 7), t AS (SELECT * FROM {LAYOUT} WHERE line_ix % 9 = 0),
 o AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = c.doc_id AND f.page = c.page AND ((least(f.x1, c.x1) > greatest(f.x0, c.x0) AND least(abs(c.y0 - f.y1), abs(f.y0 - c.y1)) < 40) OR (least(f.y1, c.y1) > greatest(f.y0, c.y0) AND least(abs(c.x0 - f.x1), abs(f.x0 - c.x1)) < 40)))),
 a AS (SELECT o.*, greatest(coalesce((SELECT max(t.y1) FROM t WHERE t.doc_id = o.doc_id AND t.page = o.page AND t.y1 <= o.y0 + 1 AND t.x0 < o.x1 AND t.x1 > o.x0), 24), 24) + 2 AS top FROM o)
 SELECT doc_id, page, caption, x0, top AS y0, x1, y0 - 2 AS y1 FROM a WHERE y0 - 2 - top >= 40""")
def open_captions(spark, sf_dir):
    rows = layout(spark, sf_dir)
    return geometry.open_captions(rows.filter("line_ix % 9 = 5").withColumnRenamed("line_ix", "caption"), rows.filter("line_ix % 9 = 7"), rows.filter("line_ix % 9 = 0"))


@query()
def absorbed_labels(spark, sf_dir):
    rows = layout(spark, sf_dir)
    return geometry.absorbed_labels(rows.filter("line_ix % 9 = 7").withColumnRenamed("line_ix", "figure"), rows.filter("length(text) < 30").withColumnRenamed("line_ix", "label"))


@query()
def greedy_captions(spark, sf_dir):
    rows = layout(spark, sf_dir)
    return geometry.paired_captions(rows.filter("line_ix % 5 = 4").withColumnRenamed("line_ix", "figure"), rows.filter("line_ix % 5 = 2").withColumnRenamed("line_ix", "caption"), 800.0)


@query()
def merged_figures(spark, sf_dir):
    rows = layout(spark, sf_dir)
    return geometry.merged_figures(rows.filter("length(text) < 40"), rows.filter("length(text) >= 40"))


@query()
def merged_pictures(spark, sf_dir):
    return geometry.merged_pictures(layout(spark, sf_dir).withColumn("y1", F.col("y1") + 20))


@query()
def table_issues(spark, sf_dir):
    return geometry.table_issues(layout(spark, sf_dir).select("doc_id", "page", "x0", "y0", "x1", "y1", "text"))
