"""Queries over characters, page structure and records, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions import unicode as uni
from quire.functions.dialect import CJK, DUCK, column
from quire.functions.fixture import CHARACTERS
from quire.operators import chars, matching, nodes, structure
from quire.plans.operators import LAYOUT, layout, lines, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def placed_chars(spark, sf_dir):
    """Characters of the lines of the made layout, and made ones."""
    made = spark.createDataFrame(CHARACTERS, "doc_id long, page int, line_ix int, char_ix int, c string, x0 double, y0 double, x1 double, y1 double, size double")
    size = int(table(spark, sf_dir, "documents")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    placed = chars.char_boxes(chars.dealt(layout(spark, sf_dir), size)).withColumn("size", F.lit(10.0))
    return tuple(x.withColumn("font", F.lit("ABCDEF+Times-Roman")) for x in (placed, made))


def made_chars(spark, sf_dir):
    placed, made = placed_chars(spark, sf_dir)
    return placed.unionByName(made)


def of_chars(spark, sf_dir, run):
    """What ``run`` makes of either part of the characters: their union would not be known to be dealt by line."""
    placed, made = placed_chars(spark, sf_dir)
    return run(placed).unionByName(run(made))


@query(f"""WITH b AS (SELECT doc_id, page, {rules.digits_key(DUCK, 'text')} AS key FROM {LAYOUT} WHERE y1 < 400 * 0.15 OR y0 > 400 * 0.85), n AS (SELECT doc_id, count(DISTINCT page) AS n FROM {LAYOUT} GROUP BY doc_id)
 SELECT doc_id, key, count(DISTINCT page) AS pages FROM b JOIN n USING (doc_id) WHERE length(replace(key, '#', '')) >= 3 GROUP BY doc_id, key, n HAVING n > 1 AND count(DISTINCT page) >= greatest(2, ceil(n / 4))""")
def margin_heads(spark, sf_dir):
    return structure.margin_heads(layout(spark, sf_dir), 400.0)


@query(f"""WITH f AS (SELECT *, size * sqrt(least(length(text), 150)) AS s FROM {LAYOUT} WHERE page = 0 AND length(text) >= 4 AND NOT ({rules.is_kicker(DUCK, 'text')}) AND NOT ({rules.is_boilerplate(DUCK, 'text')})),
 b AS (SELECT *, max(s) OVER (PARTITION BY doc_id) AS best FROM f)
 SELECT doc_id, text AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, line_ix) AS k FROM b WHERE s >= 0.8 * best) WHERE k = 1""")
def document_title(spark, sf_dir):
    return structure.document_title(layout(spark, sf_dir))


@query(f"SELECT doc_id, page, line_ix FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_ix) AS a, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_ix DESC) AS b FROM {LAYOUT}) WHERE (a = 1 OR b = 1) AND regexp_matches(trim(text), '^[-–— ]*[0-9]{{1,4}}[-–— ]*$')")
def page_number_residue(spark, sf_dir):
    return structure.page_numbers(layout(spark, sf_dir))


@query(f"SELECT doc_id, sum(CASE WHEN y1 - y0 > x1 - x0 THEN length(text) ELSE 0 END) > sum(CASE WHEN y1 - y0 > x1 - x0 THEN 0 ELSE length(text) END) AS vertical FROM {LAYOUT} GROUP BY doc_id")
def writing_direction(spark, sf_dir):
    return structure.vertical(layout(spark, sf_dir))


@query(f"SELECT doc_id, page, class FROM (SELECT doc_id, page, cast(length(text) % 3 AS INT) AS class, row_number() OVER (PARTITION BY doc_id, page ORDER BY sum(length(text)) DESC, length(text) % 3) AS k FROM {LAYOUT} GROUP BY doc_id, page, length(text) % 3) WHERE k = 1")
def majority_class(spark, sf_dir):
    votes = layout(spark, sf_dir).select("doc_id", "page", (F.length("text") % 3).alias("class"), F.length("text").alias("chars"))
    return structure.majority_class(votes, ["doc_id", "page"])


@query(f"SELECT doc_id, page, line_ix, CASE WHEN {rules.heading_number(DUCK, 'text')} IS NOT NULL AND length(text) <= 100 THEN least({rules.heading_number(DUCK, 'text')} + 1, 5) WHEN size >= 12.5 AND length(text) <= 100 THEN 2 WHEN length(text) <= 100 AND {rules.caps_heading(DUCK, 'text')} THEN 3 WHEN {rules.is_front_heading(DUCK, 'text')} OR {rules.is_closing_heading(DUCK, 'text')} OR {rules.is_references_heading(DUCK, 'text')} THEN 4 END AS level FROM {LAYOUT}")
def heading_levels(spark, sf_dir):
    return layout(spark, sf_dir).select("doc_id", "page", "line_ix", structure.heading_level(F.col("size"), 10.0, F.lit(False)).cast("long").alias("level"))


@query(f"SELECT doc_id, cast(count(*) AS BIGINT) AS lines, cast(sum(CASE WHEN regexp_matches(line, '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}]') THEN 1 ELSE 0 END) AS BIGINT) AS bad, {rules.cover_sheet(DUCK, 'any_value(t)')} AS cover FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, text AS t FROM documents) GROUP BY doc_id")
def cover_sheets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[\x{FFFD}\x{E000}-\x{F8FF}]"))).cast("long").alias("bad"), column(rules.cover_sheet, "text").alias("cover"))


@query(f"""WITH o AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(x1) OVER w AS px1, lag(text) OVER w AS pt, row_number() OVER w AS k FROM {LAYOUT} WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0)),
 s AS (SELECT *, CASE WHEN k = 1 OR (greatest(least(y1, py1) - greatest(y0, py0), 0) >= 0.5 * least(y1 - y0, py1 - py0) AND x0 - px1 < size * CASE WHEN length(pt) <= 3 THEN 1.5 ELSE 0.6 END) THEN 0 ELSE 1 END AS s FROM o), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS g FROM s)
 SELECT doc_id, page, cast(g AS BIGINT) AS row_ix, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(size) AS size, regexp_replace(regexp_replace(string_agg(text, ' ' ORDER BY x0, text), '([{CJK}]) ([{CJK}])', '\\1\\2', 'g'), '([{CJK}]) ([{CJK}])', '\\1\\2', 'g') AS text FROM g GROUP BY doc_id, page, g""")
def row_joins(spark, sf_dir):
    return structure.join_rows(layout(spark, sf_dir))


@query(f"""WITH o AS (SELECT *, min(x0) OVER (PARTITION BY doc_id, page) AS l, max(x1) OVER (PARTITION BY doc_id, page) AS r, lag(text) OVER w AS pt, lag(x1) OVER w AS px1, lag(size) OVER w AS ps FROM {LAYOUT} WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_ix)),
 s AS (SELECT *, CASE WHEN ps IS NOT NULL AND (coalesce({rules.ends_sentence(DUCK, 'pt')} AND px1 < r - 20 AND x0 - l BETWEEN 6 AND 40, false) OR greatest(size, ps) > 1.25 * least(size, ps)) THEN 1 ELSE 0 END AS s FROM o), g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY line_ix) AS g FROM s)
 SELECT doc_id, page, cast(g AS BIGINT) AS para, count(*) AS lines FROM g GROUP BY doc_id, page, g""")
def geometric_paragraphs(spark, sf_dir):
    return structure.split_paragraphs(layout(spark, sf_dir)).groupBy("doc_id", "page", "para").agg(F.count("*").alias("lines"))


@query(f"""SELECT doc_id, page, line_ix FROM {LAYOUT} l WHERE {rules.note_opening(DUCK, 'text')} OR (size < 9.5 AND NOT EXISTS (SELECT 1 FROM {LAYOUT} o WHERE o.doc_id = l.doc_id AND o.page = l.page AND o.y0 >= l.y1 AND o.size >= 9.5 AND least(o.x1, l.x1) > greatest(o.x0, l.x0)))""")
def foot_notes(spark, sf_dir):
    return structure.notes(layout(spark, sf_dir))


@query(f"""WITH n AS (SELECT doc_id, page, round(x1) AS x1, cast(trim(text) AS INT) - lag(cast(trim(text) AS INT)) OVER (PARTITION BY doc_id, page, round(x1) ORDER BY y0) AS s FROM {LAYOUT} WHERE regexp_matches(trim(text), '^[0-9]{{1,4}}$'))
 SELECT doc_id, page, x1 FROM n GROUP BY ALL HAVING count(*) >= 8 AND count(*) FILTER (WHERE s IN (1, 2, 5, 10)) * 10 >= (count(*) - 1) * 7""")
def line_number_columns(spark, sf_dir):
    return structure.line_number_columns(layout(spark, sf_dir))


@query(f"""WITH n AS (SELECT * FROM {LAYOUT} WHERE regexp_matches(text, '^([0-9]+\\.)*[0-9]+\\.?$')), p AS (SELECT n.doc_id, n.page, n.line_ix AS number, t.line_ix AS title, row_number() OVER (PARTITION BY n.doc_id, n.page, n.line_ix ORDER BY t.x0 - n.x1, t.line_ix) AS k
 FROM n JOIN {LAYOUT} t ON n.doc_id = t.doc_id AND n.page = t.page AND regexp_matches(t.text, '\\p{{L}}') AND t.x0 - n.x1 BETWEEN 0 AND 40 AND least(n.y1, t.y1) > greatest(n.y0, t.y0)) SELECT doc_id, page, number, title FROM p WHERE k = 1""")
def section_numbers(spark, sf_dir):
    return structure.section_numbers(layout(spark, sf_dir))


@query(f"""WITH c AS (SELECT * FROM {LAYOUT} WHERE regexp_matches(text, '^\\p{{Lu}}$')), p AS (SELECT c.doc_id, c.page, c.line_ix AS cap, t.line_ix, row_number() OVER (PARTITION BY c.doc_id, c.page, c.line_ix ORDER BY t.y0, t.line_ix) AS k
 FROM c JOIN {LAYOUT} t ON c.doc_id = t.doc_id AND c.page = t.page AND t.line_ix <> c.line_ix AND c.size > 1.5 * t.size AND t.x0 >= c.x1 - 1 AND t.x0 - c.x1 < 2 * t.size AND t.y0 >= c.y0 - t.size AND t.y0 < c.y1) SELECT doc_id, page, cap, line_ix FROM p WHERE k = 1""")
def drop_caps(spark, sf_dir):
    return structure.drop_caps(layout(spark, sf_dir))


@query()
def ligatures_and_accents(spark, sf_dir):
    return of_chars(spark, sf_dir, lambda c: chars.spaced_lines(chars.attach_accents(chars.split_ligatures(chars.visible(c)))))


@query(f"""WITH c AS (SELECT *, max(size) OVER l AS big, avg((y0 + y1) / 2) OVER l AS mid FROM (VALUES {", ".join(str(c) for c in CHARACTERS)}) c(doc_id, page, line_ix, char_ix, c, x0, y0, x1, y1, size) WINDOW l AS (PARTITION BY doc_id, page, line_ix))
 SELECT doc_id, page, line_ix, char_ix, CASE WHEN (y0 + y1) / 2 < mid THEN 'sup' ELSE 'sub' END AS script FROM c WHERE size < 0.8 * big AND abs((y0 + y1) / 2 - mid) > 0.1 * big""")
def scripts(spark, sf_dir):
    return of_chars(spark, sf_dir, chars.scripts).filter("script IS NOT NULL").select("doc_id", "page", "line_ix", "char_ix", "script")


@query(f"""WITH p AS (SELECT doc_id, page, line_ix AS point_ix, x0 + 7 AS x, y0 + 1 AS y FROM {LAYOUT}),
 l AS (SELECT doc_id, page, line_ix, x0, y0, x1, y1, length(text) AS n FROM {LAYOUT} UNION ALL SELECT doc_id, page, line_ix, min(x0), min(y0), max(x1), max(y1), count(*) FROM (VALUES {", ".join(str(c) for c in CHARACTERS)}) c(doc_id, page, line_ix, char_ix, c, x0, y0, x1, y1, size) GROUP BY ALL),
 d AS (SELECT p.*, l.line_ix, l.x0, l.x1, l.n, row_number() OVER (PARTITION BY p.doc_id, p.page, point_ix ORDER BY greatest(l.x0 - x, x - l.x1, 0) ** 2 + greatest(l.y0 - y, y - l.y1, 0) ** 2, l.line_ix) AS k FROM p JOIN l USING (doc_id, page)),
 c AS (SELECT *, unnest(range(n)) AS char_ix FROM d WHERE k = 1), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, point_ix ORDER BY greatest(x0 + (x1 - x0) / n * char_ix - x, x - (x0 + (x1 - x0) / n * (char_ix + 1)), 0), char_ix) AS j FROM c)
 SELECT doc_id, page, point_ix, line_ix, char_ix FROM e WHERE j = 1""")
def point_hits(spark, sf_dir):
    points = layout(spark, sf_dir).select("doc_id", "page", F.col("line_ix").alias("point_ix"), (F.col("x0") + 7).alias("x"), (F.col("y0") + 1).alias("y"))
    return of_chars(spark, sf_dir, lambda c: chars.hit(c, points))  # no page has characters of both parts


@query()
def known_words(spark, sf_dir):
    words = lines(spark, sf_dir).select(F.explode(column(rules.tokens, "line")).alias("word")).filter("word rlike '^[a-z]{3,}$'")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return matching.known_words(counts, counts.filter("n >= 20").select("word"))


@query()
def entity_match(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    title = uni.normalized(F.substring_index("text", "\n", 1))  # the first line, whole
    records = docs.select(F.col("doc_id").alias("key"), title.alias("title"), F.col("source").alias("author"), F.array().cast("array<string>").alias("others"), (2000 + F.col("n_chars") % 20).cast("int").alias("year"))
    files = docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("file_id"), title.alias("title"), F.col("source").alias("author"), (2000 + F.col("n_chars") % 20).cast("int").alias("year"))
    return matching.match(files, records)


@query()
def bilingual_html(spark, sf_dir):
    found = nodes.html_nodes(table(spark, sf_dir, "pages"))
    return nodes.to_html(found, found.filter("kind = 'paragraph'").select("doc_id", "node_ix", F.upper("text").alias("translated")))
