"""Queries over columns, lists, segments and inline text, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import markup
from quire.functions import text as rules
from quire.functions import unicode as uni
from quire.functions.dialect import DUCK
from quire.functions.fixture import CHARACTERS, FORMULAS, JAPANESE, STYLED
from quire.operators import chars, engines, models, structure, units
from quire.operators import layout as pages
from quire.plans import records as records_plan
from quire.plans.operators import LAYOUT, layout, table
from quire.plans.pages import made_chars, of_chars
from quire.plans.records import values
from quire.plans.rules import LINES_SQL, lines
from quire.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query()
def soft_gutters(spark, sf_dir):
    return pages.soft_gutters(layout(spark, sf_dir))


@query()
def soft_columns(spark, sf_dir):
    rows = layout(spark, sf_dir)
    return pages.soft_columns(rows.withColumnRenamed("line_ix", "unit").withColumn("x1", F.when(F.col("unit") % 11 == 0, 560.0).otherwise(F.col("x1"))), rows)


@query()
def upright_columns(spark, sf_dir):
    turned = layout(spark, sf_dir).select("doc_id", "page", F.col("line_ix").alias("unit"), F.col("y0").alias("x0"), F.col("x0").alias("y0"), F.col("y1").alias("x1"), F.col("x1").alias("y1"))
    return pages.upright_columns(turned)


@query()
def merged_regions(spark, sf_dir):
    return pages.merged_regions(layout(spark, sf_dir).withColumn("region", F.col("line_ix") % 4).withColumnRenamed("line_ix", "unit"))


@query(f"""WITH n AS (SELECT doc_id, page, line_ix, cast(length(text) % 3 AS INT) AS class, x0, y0, x1, y1, min(line_ix) OVER (PARTITION BY doc_id, page, line_ix // 4) AS grp FROM {LAYOUT}),
 v AS (SELECT doc_id, page, grp, class, count(*) AS k FROM n GROUP BY ALL), b AS (SELECT doc_id, page, grp, class, row_number() OVER (PARTITION BY doc_id, page, grp ORDER BY k DESC, CASE class WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS r FROM v)
 SELECT n.doc_id, n.page, n.grp, b.class, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n FROM n JOIN b ON n.doc_id = b.doc_id AND n.page = b.page AND n.grp = b.grp AND b.r = 1 GROUP BY ALL""")
def group_votes(spark, sf_dir):
    rows = layout(spark, sf_dir)
    nodes = rows.select("doc_id", "page", F.col("line_ix").alias("node"), (F.length("text") % 3).alias("class"), "x0", "y0", "x1", "y1")
    first = rows.groupBy("doc_id", "page", F.floor(F.col("line_ix") / 4).alias("g")).agg(F.min("line_ix").alias("a"))
    links = rows.withColumn("g", F.floor(F.col("line_ix") / 4)).join(first, ["doc_id", "page", "g"]).select("doc_id", "page", "a", F.col("line_ix").alias("b"))
    return pages.group_votes(nodes, links, [2, 0, 1])


@query(f"""WITH u AS (SELECT *, line_ix // 6 AS unit FROM {LAYOUT}), w AS (SELECT *, lead(line_ix) OVER o IS NOT NULL AND x1 < max(x1) OVER (PARTITION BY doc_id, page, unit ORDER BY line_ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 30 AND length(trim(text)) <= 60
  AND {rules.heading_number(DUCK, 'text')} IS NOT NULL AND NOT regexp_matches(trim(text), '[。,、;.]$') AS h FROM u WINDOW o AS (PARTITION BY doc_id, page, unit ORDER BY line_ix))
 SELECT doc_id, page, line_ix FROM (SELECT *, bool_and(h) OVER (PARTITION BY doc_id, page, unit ORDER BY line_ix ROWS UNBOUNDED PRECEDING) AS p FROM w) WHERE p""")
def opening_headings(spark, sf_dir):
    rows = layout(spark, sf_dir).withColumn("unit", F.floor(F.col("line_ix") / 6))
    return pages.opening_headings(rows).filter("peeled").select("doc_id", "page", "line_ix")


@query()
def hanging_lists(spark, sf_dir):
    """Every page's lines in one column, the lines that carry on a sentence indented."""
    rows = layout(spark, sf_dir).select("doc_id", "page", "line_ix", "text", F.when(F.col("line_ix") % 3 == 0, 50.0).otherwise(62.0).alias("x0"), F.when(F.col("line_ix") % 3 == 2, 180.0).otherwise(300.0).alias("x1"))
    return pages.hanging_lists(rows)


@query()
def segments(spark, sf_dir):
    return of_chars(spark, sf_dir, pages.segments)


@query(f"""WITH c AS (SELECT doc_id, page, line_ix, unnest(range(length(text))) AS k, text, x0, y0, y1, (x1 - x0) / length(text) AS w FROM {LAYOUT}), v AS (SELECT *, trim(substr(text, cast(k AS BIGINT) + 1, 1), ' ') <> '' AS ink FROM c)
 SELECT doc_id, page, line_ix, coalesce(min(x0 + k * w) FILTER (WHERE ink), min(x0 + k * w)) AS x0, min(y0) AS y0, coalesce(max(x0 + (k + 1) * w) FILTER (WHERE ink), max(x0 + (k + 1) * w)) AS x1, max(y1) AS y1 FROM v GROUP BY ALL
 UNION ALL SELECT doc_id, page, line_ix, min(x0), min(y0), max(x1), max(y1) FROM (VALUES {", ".join(str(c) for c in CHARACTERS)}) c(doc_id, page, line_ix, char_ix, c, x0, y0, x1, y1, size) WHERE c <> ' ' GROUP BY ALL""")
def ink_boxes(spark, sf_dir):
    return pages.ink_boxes(made_chars(spark, sf_dir))


@query(f"SELECT doc_id, page, sum(CASE WHEN (line_ix + page) % 5 > 0 THEN length(text) ELSE 0 END) >= 40 AND sum(CASE WHEN (line_ix + page) % 5 > 0 THEN length(text) ELSE 0 END) > 3 * sum(CASE WHEN (line_ix + page) % 5 > 0 THEN 0 ELSE length(text) END) AS turned FROM {LAYOUT} GROUP BY ALL")
def turned_pages(spark, sf_dir):
    return pages.turned_pages(layout(spark, sf_dir).withColumn("turned", (F.col("line_ix") + F.col("page")) % 5 > 0))


@query(f"""WITH o AS (SELECT *, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(x1) OVER w AS px1, lag({rules.marker_only(DUCK, 'text')}) OVER w AS pm, row_number() OVER w AS k FROM {LAYOUT} WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0)),
 s AS (SELECT *, CASE WHEN k = 1 OR (least(y1, py1) - greatest(y0, py0) >= 0.5 * least(y1 - y0, py1 - py0) AND x0 - px1 <= size * CASE WHEN pm THEN 8 ELSE 3 END) THEN 0 ELSE 1 END AS s FROM o)
 SELECT doc_id, page, line_ix, cast(sum(s) OVER (PARTITION BY doc_id, page ORDER BY y0, x0) AS BIGINT) AS piece FROM s""")
def entry_fragments(spark, sf_dir):
    return units.reference_columns(layout(spark, sf_dir)).select("doc_id", "page", "line_ix", "piece")


@query()
def swallowed_headings(spark, sf_dir):
    nodes = spark.createDataFrame([(d, k, kind, level, [{"text": t, "strong": s} for t, s in spans]) for d, k, kind, level, spans in STYLED], "doc_id long, node_ix int, kind string, level int, spans array<struct<text:string,strong:boolean>>")
    return units.swallowed_headings(nodes)


@query()
def inline_markdown(spark, sf_dir):
    rows = lines(spark, sf_dir).select("doc_id", "line_ix", markup.spans_column("line").alias("spans"))
    return rows.select("doc_id", "line_ix", F.posexplode("spans").alias("k", "s")).select("doc_id", "line_ix", "k", "s.*")


@query()
def formula_mathml(spark, sf_dir):
    return spark.createDataFrame(FORMULAS, "latex string").withColumn("mathml", markup.mathml("latex"))


@query()
def japanese_quality(spark, sf_dir):
    """Japanese characters and misreadings of each document and of made texts, and whether they are poor: more than one in a hundred, of a thousand at least."""
    made = spark.createDataFrame([(-10 - k, t * n) for k, (t, n) in enumerate(JAPANESE)], "doc_id long, text string")
    counts = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(made).select("doc_id", markup.japanese("text").alias("j"))
    return counts.select("doc_id", "j.chars", "j.bad", F.when(F.col("j.chars") >= 1000, F.col("j.bad") * 100 > F.col("j.chars")).alias("poor"))


@query()
def selected_words(spark, sf_dir):
    rows = lines(spark, sf_dir).filter("line != ''")
    return rows.select("doc_id", "line_ix", markup.selected_word("line", F.floor(F.length("line") / 2).cast("int")).alias("word"))


@query("WITH r AS (SELECT source AS provider, lang AS model, sum(n_chars) AS chars FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL) SELECT *, CASE model WHEN 'en' THEN 1.2 * chars * (0.32 * 0.75 + 0.35 * 3.75) / 1e6 WHEN 'de' THEN 1.2 * chars * (0.32 * 1.5 + 0.35 * 6.0) / 1e6 END AS usd FROM r")
def priced_requests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL AND source IS NOT NULL")
    prices = docs.select(F.col("source").alias("provider")).distinct().select("provider", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(a).alias("usd_in"), F.lit(b).alias("usd_out")) for m, a, b in (("en", 0.75, 3.75), ("de", 1.5, 6.0))))))
    return models.priced(docs.groupBy(F.col("source").alias("provider"), F.col("lang").alias("model")).agg(F.sum("n_chars").alias("chars")), prices)


@query("WITH f AS (SELECT source AS model, doc_id, n_chars FROM documents WHERE source IS NOT NULL) SELECT model, sum(n_chars) AS size, bool_and(doc_id % 9 <> 0) AS complete FROM f GROUP BY model")
def installed_models(spark, sf_dir):
    files = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.col("source").alias("model"), F.col("doc_id").cast("string").alias("sha256"), F.col("n_chars").alias("size"), "doc_id")
    return models.installed(files.drop("doc_id"), files.filter("doc_id % 9 != 0").select("sha256", "size"))


@query("SELECT doc_id AS source, 'out/' || lang || '/' || (length(text) % 50) AS path, ['md', 'html'] AS formats, count(*) OVER (PARTITION BY lang, length(text) % 50) > 1 AS clash FROM documents WHERE lang IS NOT NULL")
def target_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    jobs = docs.select(F.col("doc_id").alias("source"), F.concat(F.lit("out/"), "lang").alias("folder"), (F.length("text") % 50).cast("string").alias("stem"), F.array(F.lit("md"), F.lit("html"), F.lit("md")).alias("formats"))
    return models.target_paths(jobs)


@query(f"SELECT doc_id, line_ix, string_agg(printf('%04X', ord(c)), '' ORDER BY k) AS units FROM (SELECT doc_id, line_ix, unnest(string_split(line, '')) AS c, unnest(range(len(string_split(line, '')))) AS k FROM ({LINES_SQL}) WHERE line <> '') WHERE c <> '' GROUP BY ALL")
def utf16_lines(spark, sf_dir):
    return lines(spark, sf_dir).filter("line != ''").select("doc_id", "line_ix", models.utf16_hex(F.col("line")).alias("units"))


@query("""SELECT doc_id, n_chars AS chars, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) AS words, lang, source FROM documents""")
def document_info(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.col("n_chars").alias("chars"), F.size(F.split("text", "\n")).alias("lines"), F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")).alias("words"), "lang", "source")


TREE = [(1, 1, None, "Ships"), (1, 2, 1, "Sails"), (1, 3, 2, "Jib"), (1, 4, 1, "Masts"), (2, 1, None, "Bread"), (2, 5, 1, "Rye"), (2, 6, 5, "Crust"), (2, 7, 6, "Colour")]


@query(f"""WITH RECURSIVE t AS (SELECT * FROM {values(TREE, 'doc_id, id, parent, title')}), r AS (SELECT doc_id, id, 0 AS depth, [title] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.doc_id, t.id, r.depth + 1, list_append(r.path, t.title) FROM r JOIN t ON t.doc_id = r.doc_id AND t.parent = r.id)
 SELECT doc_id, id, depth, array_to_string(path, ' / ') AS path FROM r""")
def flat_outline(spark, sf_dir):
    tree = spark.createDataFrame(TREE, "doc_id long, id int, parent int, title string")
    return structure.flattened(tree).withColumn("path", F.array_join("path", " / "))


@query(f"""WITH p AS (SELECT DISTINCT doc_id, page FROM {LAYOUT}), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS k FROM p)
 SELECT doc_id, page FROM n WHERE n <= 3 OR (k * 3) // n <> CASE WHEN k = 0 THEN -1 ELSE ((k - 1) * 3) // n END""")
def spread_pages(spark, sf_dir):
    return structure.spread_pages(layout(spark, sf_dir).select("doc_id", "page").distinct(), most=3)


@query(f"SELECT doc_id, page, CASE WHEN reason IS NOT NULL THEN 'take' ELSE 'skip' END AS needed, CASE WHEN reason IS NOT NULL THEN 'take' WHEN scanned_text THEN 'force' ELSE 'skip' END AS scans, CASE WHEN reason IS NOT NULL THEN 'take' ELSE 'force' END AS everything FROM ({records_plan.ORACLE_SQL['page_flags']})")
def ocr_scopes(spark, sf_dir):
    flags = records_plan.page_flags(spark, sf_dir)
    wanted = lambda scope: engines.ocr_wanted(scope, F.col("reason").isNotNull(), F.col("scanned_text"))
    return flags.select("doc_id", "page", wanted("needed").alias("needed"), wanted("scans").alias("scans"), wanted("all").alias("everything"))


@query(f"""SELECT doc_id, line_ix, made FROM (SELECT doc_id, line_ix, line, regexp_replace(regexp_replace(line, '(×\\s?10)([-−]?[0-9]{{1,2}})($|[^0-9])', '\\1^{{\\2}}\\3', 'g'), '([0-9]\\s?)(km|cm|mm|m)([23])($|[^0-9A-Za-z])', '\\1\\2^{{\\3}}\\4', 'g') AS made FROM ({LINES_SQL})) WHERE made <> line""")
def raised_exponents(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_ix", "line", chars.ocr_superscripts("line").alias("made")).filter("made != line").select("doc_id", "line_ix", "made")


@query(f"""WITH o AS (SELECT *, (y1 - y0) * CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) * 2 > length(text) THEN 0.78 ELSE 0.85 END AS own FROM {LAYOUT}), m AS (SELECT doc_id, page, line_ix // 8 AS block, list_sort(list(own))[count(*) // 2 + 1] AS med FROM o GROUP BY ALL)
 SELECT o.doc_id, o.page, o.line_ix, CASE WHEN own BETWEEN med * 0.7 AND med * 1.35 THEN med ELSE own END AS size FROM o JOIN m ON o.doc_id = m.doc_id AND o.page = m.page AND o.line_ix // 8 = m.block""")
def recognised_sizes(spark, sf_dir):
    rows = layout(spark, sf_dir).drop("size").withColumn("block", F.floor(F.col("line_ix") / 8))
    return chars.line_sizes(rows).select("doc_id", "page", "line_ix", "size")


@query(f"""WITH p AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY line_ix) AS text, page % 2 = 1 AS unusable FROM {LAYOUT} GROUP BY ALL)
 SELECT doc_id, page, md5(CASE WHEN page % 3 < 2 AND (page % 3 = 0 OR unusable) THEN 'read: ' || text ELSE text END) AS text_md5 FROM p""")
def replaced_layers(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "text"))), lambda s: s["text"])
    own = layout(spark, sf_dir).groupBy("doc_id", "page").agg(F.array_join(ordered, " ").alias("text")).withColumn("unusable", F.col("page") % 2 == 1)
    read = own.filter("page % 3 < 2").select("doc_id", "page", F.concat(F.lit("read: "), "text").alias("text"), (F.col("page") % 3 == 0).alias("forced"))
    return engines.replaced_layer(own, read).select("doc_id", "page", F.md5("text").alias("text_md5"))


@query()
def tidied_latex(spark, sf_dir):
    return spark.createDataFrame(FORMULAS, "latex string").withColumn("tidy", uni.tidy_latex("latex"))


@query()
def bibliography(spark, sf_dir):
    """The benchmark's items as BibTeX, read again."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[{}@,=\"\\\\]", " ").alias("t"))
    entry = F.concat(F.lit("@misc{item"), "item_id", F.lit(", title = {"), F.trim("t"), F.lit("}, author = {Novak, C. and Ward, T.}, year = "), (1990 + F.col("item_id") % 30).cast("string"), F.lit("}"))
    return files.read_bib(items.select(entry.alias("text"))).select("key", "title", "authors", "year")
