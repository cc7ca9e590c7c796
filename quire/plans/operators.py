"""Queries for the operators over rows, groups and pages, with their SQL.

Geometry needs boxes, which the driver's tables lack: :func:`layout` sets each document's lines on made pages, 40 a page
in two columns with a fixed advance, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions import unicode as uni
from quire.functions.dialect import DUCK, column
from quire.operators import aggregates, engines, geometry, nodes, references, sequence, similarity
from quire.functions.fixture import PLACED
from quire.plans.rules import LINES_SQL, lines

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, line_ix, x0, y0, x1, y1, size, text)"""
    n, col = F.col("line_ix") % 40, F.col("line_ix") % 2
    x0 = F.lit(50.0) + 260 * col
    y0 = F.lit(40.0) + 15 * F.floor(n / 2)
    placed = spark.createDataFrame(PLACED, "doc_id long, page int, line_ix int, x0 double, y0 double, x1 double, y1 double, size double, text string")
    rows = lines(spark, sf_dir).filter("trim(line) != ''").select("doc_id", F.floor(F.col("line_ix") / 40).cast("int").alias("page"), "line_ix", x0.alias("x0"), y0.cast("double").alias("y0"), (x0 + 5 * F.least(F.length("line"), F.lit(48))).alias("x1"), (y0 + 10).cast("double").alias("y1"), F.when(F.length("line") < 40, 14.0).otherwise(10.0).alias("size"), F.col("line").alias("text"))
    return rows.unionByName(placed)


LAYOUT = f"""(SELECT doc_id, cast(line_ix // 40 AS INT) AS page, line_ix, 50.0 + 260 * (line_ix % 2) AS x0, cast(40 + 15 * ((line_ix % 40) // 2) AS DOUBLE) AS y0,
 50.0 + 260 * (line_ix % 2) + 5 * least(length(line), 48) AS x1, cast(50 + 15 * ((line_ix % 40) // 2) AS DOUBLE) AS y1, CASE WHEN length(line) < 40 THEN 14.0 ELSE 10.0 END AS size, line AS text
 FROM ({LINES_SQL}) WHERE trim(line) <> '' UNION ALL SELECT * FROM (VALUES {", ".join(map(str, PLACED))}))"""
L = f"({LINES_SQL})"


# --- aggregates


@query(f"SELECT key, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, {rules.digits_key(DUCK, 'line')} AS key FROM {L}) WHERE length(replace(key, '#', '')) >= 3 GROUP BY key HAVING count(DISTINCT doc_id) >= 2")
def repeated_lines(spark, sf_dir):
    return aggregates.repeated_lines(lines(spark, sf_dir))


@query(f"""WITH k AS (SELECT doc_id, line_ix, {rules.digits_key(DUCK, 'line')} AS key FROM {L}),
 r AS (SELECT key FROM k WHERE length(replace(key, '#', '')) >= 3 GROUP BY key HAVING count(DISTINCT doc_id) >= greatest(2, 4))
 SELECT doc_id, line_ix FROM k WHERE key IN (SELECT key FROM r)""")
def dropped_lines(spark, sf_dir):
    return aggregates.dropped_lines(lines(spark, sf_dir), pages=16)


@query(f"""WITH d AS (SELECT doc_id, line_ix, {rules.digits_key(DUCK, 'line')} AS key FROM {L}), r AS (SELECT key FROM d WHERE length(replace(key, '#', '')) >= 3 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
 SELECT l.quality, count(*) AS lines, count(r.key) AS repeated FROM d JOIN labels l USING (doc_id) LEFT JOIN r USING (key) GROUP BY l.quality""")
def repeat_share_by_quality(spark, sf_dir):
    keyed = lines(spark, sf_dir).withColumn("key", column(rules.digits_key, "line"))
    repeated = aggregates.repeated_lines(lines(spark, sf_dir)).select("key", F.lit(1).alias("r"))
    joined = keyed.join(table(spark, sf_dir, "labels"), "doc_id").join(repeated, "key", "left")
    return joined.groupBy("quality").agg(F.count("*").alias("lines"), F.count("r").alias("repeated"))


@query(f"SELECT doc_id, median FROM (SELECT doc_id, length(line) AS median, row_number() OVER (PARTITION BY doc_id ORDER BY length(line)) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM {L}) WHERE r = n // 2 + 1")
def line_length_upper_median(spark, sf_dir):
    return aggregates.upper_median(lines(spark, sf_dir).withColumn("n", F.length("line")), ["doc_id"], "n")


@query(f"SELECT doc_id, mode, weight FROM (SELECT doc_id, size AS mode, sum(length(text)) AS weight, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(text)) DESC, size DESC) AS r FROM {LAYOUT} GROUP BY doc_id, size) WHERE r = 1")
def body_size(spark, sf_dir):
    return aggregates.weighted_mode(layout(spark, sf_dir), ["doc_id"], "size", F.length("text"))


@query(f"""WITH m AS (SELECT doc_id, line_ix, {rules.words(DUCK, 'line')} AS w, regexp_matches(line, '[-‐‑]\\s*$') AS cut FROM {L}),
 o AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY line_ix), false) AS open FROM m),
 t AS (SELECT unnest(w[(CASE WHEN open THEN 2 ELSE 1 END):(len(w) - CASE WHEN cut THEN 1 ELSE 0 END)]) AS t FROM o),
 b AS (SELECT lower(regexp_replace(t, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS word FROM t),
 c AS (SELECT word FROM b WHERE len(regexp_extract_all(word, '\\p{{L}}')) >= 2)
 SELECT word, count(*) AS n FROM (SELECT word FROM c UNION ALL SELECT p FROM (SELECT unnest(regexp_split_to_array(word, '[-‐‑]')) AS p FROM c WHERE regexp_matches(word, '[-‐‑]')) WHERE length(p) >= 2) GROUP BY word""")
def word_lexicon(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.split("text", "\n").alias("ls"))
    pairs = docs.select(F.inline(F.arrays_zip(F.col("ls").alias("line"), F.concat(F.array(F.lit("")), F.col("ls")).alias("before")))).filter("line IS NOT NULL")
    made = lines(spark, sf_dir, docs=False).select("line", F.lag("line").over(W.partitionBy("doc_id").orderBy("line_ix")).alias("before"))
    return aggregates.lexicon(pairs.unionByName(made))


@query(f"""WITH k AS (SELECT DISTINCT lower(w) AS w FROM (SELECT doc_id, unnest({rules.words(DUCK, 'text')}) AS w FROM documents) GROUP BY lower(w) HAVING count(DISTINCT doc_id) >= 20),
 d AS (SELECT doc_id, {rules.dehyphenate(DUCK, 'text')} AS t FROM documents), w AS (SELECT doc_id, unnest({rules.quality_words(DUCK, 't')}) AS w FROM d),
 c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, lower(w)) AS uses FROM c),
 j AS (SELECT *, {rules.garbled(DUCK, 'w')} AS g FROM u)
 SELECT doc_id, cast(sum(n) AS BIGINT) AS en_words, cast(sum(CASE WHEN g OR (w NOT IN (SELECT w FROM k) AND (length(w) < 5 OR uses < 3)) THEN n ELSE 0 END) AS BIGINT) AS en_bad,
 CASE WHEN sum(n) >= 300 THEN sum(CASE WHEN g OR (w NOT IN (SELECT w FROM k) AND (length(w) < 5 OR uses < 3)) THEN n ELSE 0 END) / sum(n) END AS en_rate FROM j WHERE g OR regexp_matches(w, '^[a-z]+$') GROUP BY doc_id""")
def unknown_word_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.lower("text").alias("low")).select(F.explode(F.array_distinct(column(rules.words, "low"))).alias("word")).filter("word rlike '^[a-z]+$'")  # each document has a word once; others are not looked up
    known = words.groupBy("word").agg(F.count("*").alias("df")).filter("df >= 20")
    return aggregates.layer_quality(docs, known)


@query(f"""WITH j AS (SELECT doc_id, length({rules.unspaced(DUCK, 'line')}) AS n, {rules.prose_like(DUCK, 'line')} AS prose, {rules.words(DUCK, 'line')} AS w FROM {L}),
 k AS (SELECT *, prose OR (len(w) > 0 AND len(list_filter(w, lambda x: len(regexp_extract_all(x, '\\p{{L}}')) >= 3 AND len(regexp_extract_all(x, '\\p{{L}}')) * 10 >= length(x) * 7)) * 2 >= len(w)) AS ok FROM j WHERE n >= 4)
 SELECT doc_id, cast(sum(CASE WHEN ok THEN n ELSE 0 END) AS BIGINT) AS good, cast(sum(n) AS BIGINT) AS judged, CASE WHEN sum(n) < 200 THEN 1.0 ELSE sum(CASE WHEN ok THEN n ELSE 0 END) / sum(n) END AS quality FROM k GROUP BY doc_id""")
def text_layer_share(spark, sf_dir):
    return aggregates.text_layer_share(lines(spark, sf_dir))


@query(f"""WITH p AS (SELECT DISTINCT doc_id, unnest({rules.tokens(DUCK, 'text')}) AS token FROM documents)
 SELECT token, count(*) AS df, ln((SELECT count(*) FROM documents) / (1 + count(*))) AS idf FROM p GROUP BY token""")
def token_idf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    return aggregates.idf(docs.select("doc_id", F.explode(F.array_distinct(column(rules.tokens, "text"))).alias("token")), n, once=n == ids)


@query("""SELECT 'lang' AS kind, coalesce(lang, '-') AS bin, count(*) AS docs FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(source, '-'), count(*) FROM documents GROUP BY ALL
 UNION ALL SELECT 'size', cast(cast(floor(log10(greatest(n_chars, 1))) AS BIGINT) AS VARCHAR), count(*) FROM documents GROUP BY ALL""")
def corpus_summary(spark, sf_dir):
    return aggregates.corpus_summary(table(spark, sf_dir, "documents"))


AUDIT = f"""(WITH r AS (SELECT *, lead(line) OVER o AS nxt, lag(line) OVER o AS prv FROM {L} WHERE trim(line) <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY line_ix)),
 m AS (SELECT doc_id, count(*) AS paras, sum(len({rules.words(DUCK, 'line')})) AS words, sum(CASE WHEN NOT ({rules.ends_sentence(DUCK, 'line')}) AND coalesce(regexp_matches(nxt, '^\\p{{Ll}}'), false) THEN 1 ELSE 0 END) AS cut_lower,
  sum(len(regexp_extract_all(line, '\\p{{L}}- \\p{{Ll}}'))) AS hyphen_left, sum(len(list_filter({rules.words(DUCK, 'line')}, lambda x: length(x) > 30))) AS long_tokens, sum(CASE WHEN {rules.caption_kind(DUCK, 'line')} IS NOT NULL THEN 1 ELSE 0 END) AS caption_para,
  sum(CASE WHEN length(line) < 40 THEN 1 ELSE 0 END) AS short_paras, sum(CASE WHEN line = prv THEN len({rules.words(DUCK, 'line')}) ELSE 0 END) AS dup FROM r GROUP BY doc_id)
 SELECT doc_id, unnest(['dup_pct', 'cut_lower_100p', 'hyphen_10kw', 'glued_10kw', 'caption_para_100p', 'short_paras_pct']) AS measure,
  unnest([100 * dup / greatest(1, words), 100 * cut_lower / greatest(1, paras), 10000 * hyphen_left / greatest(1, words), 10000 * long_tokens / greatest(1, words), 100 * caption_para / greatest(1, paras), 100 * short_paras / greatest(1, paras)]) AS value,
  unnest([2.0, 0.0, 2.0, 5.0, 0.0, 25.0]) AS most FROM m)"""


@query(f"SELECT doc_id, measure, value, value > most AS flagged FROM {AUDIT}")
def audit_flags(spark, sf_dir):
    return aggregates.audit_rates(aggregates.audit_measures(lines(spark, sf_dir)))


@query(f"""WITH a AS (SELECT *, value > most AS flagged FROM {AUDIT}), t AS (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY abs(value) DESC, doc_id) AS k FROM a WHERE flagged)
 SELECT a.measure, count(*) AS n, avg(a.value) AS mean, cast(sum(CASE WHEN a.flagged THEN 1 ELSE 0 END) AS BIGINT) AS flagged, any_value(w.ids) AS worst_ids FROM a LEFT JOIN (SELECT measure, string_agg(cast(doc_id AS VARCHAR), ',' ORDER BY k) AS ids FROM t WHERE k <= 8 GROUP BY measure) w ON a.measure = w.measure GROUP BY a.measure""")
def audit_summary(spark, sf_dir):
    return aggregates.audit_summary(aggregates.audit_rates(aggregates.audit_measures(lines(spark, sf_dir))))


@query(f"""WITH b AS (SELECT doc_id, measure, value, value > most AS flagged FROM {AUDIT}), n AS (SELECT doc_id, measure, value / 2 AS value, value / 2 > most AS flagged FROM {AUDIT} WHERE doc_id % 3 <> 0)
 SELECT b.measure, count(*) AS docs, avg(b.value) AS mean_base, avg(n.value) AS mean_new, cast(sum(CASE WHEN NOT b.flagged AND n.flagged THEN 1 ELSE 0 END) AS BIGINT) AS worse, cast(sum(CASE WHEN b.flagged AND NOT n.flagged THEN 1 ELSE 0 END) AS BIGINT) AS better FROM b JOIN n USING (doc_id, measure) GROUP BY b.measure""")
def run_compare(spark, sf_dir):
    base = aggregates.audit_rates(aggregates.audit_measures(lines(spark, sf_dir)))
    most = F.create_map(*(x for k, v in aggregates.FLAGS.items() for x in (F.lit(k), F.lit(v))))
    new = base.filter("doc_id % 3 != 0").select("doc_id", "measure", (F.col("value") / 2).alias("value")).withColumn("flagged", F.col("value") > most[F.col("measure")])  # a second run that lacks documents and halves each rate
    return aggregates.compare_runs(base, new)


# --- sequences


@query(f"""WITH f AS (SELECT * FROM {L} WHERE trim(line) <> ''), p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_ix) AS prv FROM f),
 j AS (SELECT *, coalesce({rules.open_end(DUCK, 'prv')} OR (NOT ({rules.ends_sentence(DUCK, 'prv')}) AND {rules.starts_low(DUCK, 'line')}), false) AS joined FROM p),
 i AS (SELECT *, sum(CASE WHEN prv IS NULL OR joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_ix) AS para_ix FROM j)
 SELECT doc_id, cast(para_ix AS BIGINT) AS para_ix, min(line_ix) AS first_line, count(*) AS n_lines, md5(string_agg(line, ' ' ORDER BY line_ix)) AS text_md5 FROM i GROUP BY doc_id, para_ix""")
def paragraph_islands(spark, sf_dir):
    return sequence.paragraphs(lines(spark, sf_dir))


@query(f"""WITH p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_ix) AS prv FROM {L}),
 k AS (SELECT doc_id, line_ix, CASE WHEN (NOT ({rules.ends_sentence(DUCK, 'prv')}) OR regexp_matches(prv, '\\)\\s*$')) AND {rules.starts_low(DUCK, 'line')} THEN 'strong' WHEN NOT ({rules.ends_sentence(DUCK, 'prv')}) AND {rules.starts_weakly(DUCK, 'line')} THEN 'weak' END AS kind FROM p WHERE prv IS NOT NULL)
 SELECT * FROM k WHERE kind IS NOT NULL""")
def continuation_pairs(spark, sf_dir):
    return sequence.continuations(lines(spark, sf_dir))


@query(f"SELECT doc_id, line_ix, section FROM (SELECT doc_id, line_ix, last_value(CASE WHEN length(line) BETWEEN 1 AND 30 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_ix ROWS UNBOUNDED PRECEDING) AS section FROM {L}) WHERE section IS NOT NULL")
def section_carry_forward(spark, sf_dir):
    return sequence.carry_forward(lines(spark, sf_dir), ["doc_id"], ["line_ix"], F.when(F.length("line").between(1, 30), F.col("line")), "section").filter("section IS NOT NULL").select("doc_id", "line_ix", "section")


@query(f"SELECT doc_id, line_ix, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY caps DESC, n DESC) + 1, 5) AS level FROM (SELECT doc_id, line_ix, {rules.caps_heading(DUCK, 'line')} AS caps, length(line) // 10 AS n FROM {L} WHERE length(line) BETWEEN 1 AND 60)")
def heading_style_rank(spark, sf_dir):
    heads = lines(spark, sf_dir).filter("length(line) between 1 and 60").withColumns({"caps": column(rules.caps_heading, "line"), "n": F.floor(F.length("line") / 10)})
    return sequence.style_rank(heads, "doc_id", "caps", "n").select("doc_id", "line_ix", F.col("level").cast("long").alias("level"))


N = f"(SELECT doc_id, line_ix, try_cast(regexp_extract(line, '[0-9]+') AS BIGINT) AS n FROM {L})"


@query(f"SELECT doc_id, count(*) AS steps, cast(sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS BIGINT) AS by_one FROM (SELECT doc_id, n - lag(n) OVER (PARTITION BY doc_id ORDER BY line_ix) AS s FROM {N} WHERE n IS NOT NULL) WHERE s IS NOT NULL GROUP BY doc_id")
def marker_numbering(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("n", F.expr("try_cast(nullif(regexp_extract(line, '[0-9]+', 0), '') AS bigint)")).filter("n IS NOT NULL")
    return sequence.numbering(rows, ["doc_id"], ["line_ix"], "n")


@query(f"SELECT doc_id, n, n >= 6 AND ups * 100 >= (n - 1) * 80 AS ascending FROM (SELECT doc_id, count(*) AS n, coalesce(sum(up), 0) AS ups FROM (SELECT doc_id, CASE WHEN n >= lag(n) OVER (PARTITION BY doc_id ORDER BY line_ix) THEN 1 ELSE 0 END AS up FROM {N} WHERE n IS NOT NULL) GROUP BY doc_id)")
def ascending_numbers(spark, sf_dir):
    rows = lines(spark, sf_dir).withColumn("n", F.expr("try_cast(nullif(regexp_extract(line, '[0-9]+', 0), '') AS bigint)")).filter("n IS NOT NULL")
    return sequence.ascending(rows.withColumnRenamed("n", "v"), ["doc_id"], ["line_ix"], "v")


@query(f"SELECT doc_id, line_ix, n FROM (SELECT *, lag(n) OVER w AS b, lead(n) OVER w AS a FROM (SELECT doc_id, line_ix, {rules.item_number(DUCK, 'line')} AS n FROM {L}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_ix)) WHERE (n >= 2 AND b = n - 1) OR a = n + 1")
def numbered_items(spark, sf_dir):
    return sequence.numbered_items(lines(spark, sf_dir), ["doc_id"], ["line_ix"], "line").select("doc_id", "line_ix", "n")


@query("SELECT conv_id, turn, text FROM (SELECT conv_id, turn, text, coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM conversations) WHERE b <= 1500")
def context_prefix(spark, sf_dir):
    return sequence.context_prefix(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "text").select("conv_id", "turn", "text")


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, octet_length(encode(text)) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
 r AS (SELECT conv_id, turn, k, n AS size, 1 AS items, 0 AS batch FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.turn, t.k, CASE WHEN full_ THEN t.n ELSE r.size + t.n END, CASE WHEN full_ THEN 1 ELSE r.items + 1 END, CASE WHEN full_ THEN r.batch + 1 ELSE r.batch END
  FROM (SELECT r.*, t.n AS m, r.size + t.n > CASE WHEN r.batch = 0 THEN 300 ELSE 900 END OR r.items >= 80 AS full_ FROM r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1) r JOIN t ON t.conv_id = r.conv_id AND t.k = r.k + 1)
 SELECT conv_id, turn, batch FROM r""")
def batch_pack(spark, sf_dir):
    return sequence.pack_batches(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", first=300, later=900)


FORMS = lambda x: f"[{x}, {x} || 's', {x} || 'es', {x} || 'ed', {x} || 'd', {x} || 'ing'] || CASE WHEN {x} LIKE '%s' AND length({x}) >= 4 THEN [left({x}, -1)] ELSE [] END || CASE WHEN {x} LIKE '%es' AND length({x}) >= 5 THEN [left({x}, -2)] ELSE [] END"


@query(f"""WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)?')) AS w FROM documents)),
 k AS (SELECT * FROM w WHERE length(w) % 3 <> 0 OR contains(w, '-')),
 p AS (SELECT substr(w, 1, length(w) // 2) AS a, substr(w, length(w) // 2 + 1) AS b FROM w WHERE length(w) BETWEEN 6 AND 12 AND NOT contains(w, '-') UNION SELECT split_part(w, '-', 1), split_part(w, '-', 2) FROM w WHERE contains(w, '-')
  UNION SELECT upper(left(w, 2)), w FROM w WHERE length(w) = 5 UNION SELECT a, b FROM (SELECT regexp_extract(lower(line), '([a-z]+)[^a-z]*$', 1) AS a, regexp_extract(lower(lead(line) OVER (PARTITION BY doc_id ORDER BY line_ix)), '^[^a-z]*([a-z]+)', 1) AS b FROM {L}) WHERE a <> '' AND b <> ''),
 f AS (SELECT p.*, lower(a) AS la, lower(b) AS lb FROM p),
 c AS (SELECT a, b, 1 AS what FROM f JOIN k ON k.w = la || '-' || lb UNION SELECT a, b, 2 FROM (SELECT a, b, unnest({FORMS("(la || lb)")}) AS x FROM f) JOIN k ON k.w = x UNION SELECT a, b, 3 FROM (SELECT a, b, unnest({FORMS("la")}) AS x FROM f) JOIN k ON k.w = x UNION SELECT a, b, 4 FROM (SELECT a, b, unnest({FORMS("lb")}) AS x FROM f) JOIN k ON k.w = x),
 g AS (SELECT f.*, bool_or(what = 1) AS c1, bool_or(what = 2) AS c2, bool_or(what = 3) AS c3, bool_or(what = 4) AS c4 FROM f LEFT JOIN c USING (a, b) GROUP BY ALL)
 SELECT a, b, CASE WHEN a = '' OR b = '' THEN false WHEN coalesce(c1, false) THEN true WHEN coalesce(c2, false) THEN false WHEN regexp_matches(a, '^[A-Z0-9]*$') OR regexp_matches(b, '^[A-Z]') OR la IN ('km', 'm', 'cm', 'mm', 'kg', 'g', 'mg', 's', 'h', 'hr', 'yr', 'ka', 'ma', 'ga', 'kyr', 'myr', 'pa', 'mpa', 'gpa', 'hz', 'ppm') THEN true
  ELSE length(a) >= 3 AND length(b) >= 3 AND coalesce(c3, false) AND coalesce(c4, false) END AS keep FROM g""")
def keep_hyphen(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+(?:-[a-z]+)?"), F.lit(0))).alias("word")).distinct()
    known = words.filter("length(word) % 3 != 0 OR contains(word, '-')")  # a third of the words is left out, so that all four outcomes come up
    word, half, whole = F.col("word"), F.floor(F.length("word") / 2), ~F.contains("word", F.lit("-"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    split = F.when(F.length("word").between(6, 12) & whole, pair(F.substr("word", F.lit(1), half), F.substr("word", half + 1)))
    hyphened = F.when(~whole, pair(F.split_part("word", F.lit("-"), F.lit(1)), F.split_part("word", F.lit("-"), F.lit(2))))
    capital = F.when(F.length("word") == 5, pair(F.upper(F.substr("word", F.lit(1), F.lit(2))), word))
    made = words.select(F.inline(F.array_compact(F.array(split, hyphened, capital))))  # the words are gathered once for all three
    after = F.lead("line").over(W.partitionBy("doc_id").orderBy("line_ix"))  # a line's last word and the next line's first, as a hyphen would part them
    beside = lines(spark, sf_dir).select(F.regexp_extract(F.lower("line"), "([a-z]+)[^a-z]*$", 1).alias("a"), F.regexp_extract(F.lower(after), "^[^a-z]*([a-z]+)", 1).alias("b")).filter("a != '' AND b != ''")
    return sequence.keep_hyphen(made.unionByName(beside), known)


# --- similarity


HEADS = f"""(SELECT DISTINCT {rules.compact_text(DUCK, 'text')} AS key FROM (SELECT regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS text FROM pages UNION ALL SELECT line FROM {L} WHERE doc_id < 0))"""


@query(f"""WITH g AS (SELECT key, {rules.bigrams(DUCK, 'key')} AS g FROM {HEADS}), h AS (SELECT * FROM g WHERE len(g) >= 5)
 SELECT x.key AS a, y.key AS b FROM h x JOIN h y ON x.key < y.key AND least(len(x.g), len(y.g)) * 100 >= greatest(len(x.g), len(y.g)) * 85 WHERE len(list_intersect(x.g, y.g)) * 10 >= greatest(len(x.g), len(y.g)) * 8""")
def bigram_similar_lines(spark, sf_dir):
    """The headings of all pages, and the hand-made lines."""
    heads = table(spark, sf_dir, "pages").select(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("text")).unionByName(lines(spark, sf_dir).filter("doc_id < 0").select(F.col("line").alias("text")))
    return similarity.similar_lines(heads.select(column(rules.compact_text, "text").alias("key")).distinct())


GRAMS = lambda t, i: f"SELECT DISTINCT {i}, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS gram FROM (SELECT {i}, {rules.tokens(DUCK, 'text')} AS w FROM {t})"


@query(f"""WITH i AS ({GRAMS('benchmark', 'item_id')}), d AS ({GRAMS('documents', 'doc_id')}), t AS (SELECT item_id, count(*) AS grams FROM i GROUP BY item_id),
 f AS (SELECT item_id, doc_id, count(*) AS found, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS r FROM i JOIN d USING (gram) GROUP BY item_id, doc_id)
 SELECT t.item_id, t.grams, f.doc_id, coalesce(f.found, 0) AS found FROM t LEFT JOIN f ON t.item_id = f.item_id AND f.r = 1""")
def benchmark_trigram_coverage(spark, sf_dir):
    return similarity.ngram_coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


READINGS = "(SELECT key AS line, 'reading ' || unnest([text, text, text || ' ', replace(text, 'e', 'c'), replace(text, 'n', 'u') || 'x']) AS text FROM (SELECT item_id AS key, text FROM benchmark))"


@query(f"""WITH b AS (SELECT line, text, regexp_replace(text, '\\s+', '', 'g') AS bare, row_number() OVER (PARTITION BY line ORDER BY text) AS id FROM {READINGS}),
 c AS (SELECT b.line, b.text, b.bare, b.id, coalesce(sum(levenshtein(b.bare, o.bare)), 0) AS cost FROM b LEFT JOIN b o ON b.line = o.line AND b.id <> o.id GROUP BY ALL)
 SELECT line, text FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY cost, -length(bare), id) AS k FROM c) WHERE k = 1""")
def consensus_reading(spark, sf_dir):
    text = F.col("text")
    five = F.array(text, text, F.concat(text, F.lit(" ")), F.replace(text, F.lit("e"), F.lit("c")), F.concat(F.replace(text, F.lit("n"), F.lit("u")), F.lit("x")))  # five readings of each line, whole
    readings = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line"), F.explode(five).alias("text")).withColumn("text", F.concat(F.lit("reading "), "text"))
    return similarity.consensus(readings, "line", "text", F.lit(0))


@query(f"""WITH f AS (SELECT item_id AS file_id, unnest(list_distinct({rules.tokens(DUCK, 'text')})) AS token FROM benchmark), r AS (SELECT doc_id AS key, unnest(list_distinct({rules.tokens(DUCK, 'text')})) AS token FROM documents),
 n AS (SELECT count(DISTINCT key) AS n FROM r), d AS (SELECT token, ln((SELECT n FROM n) / (1 + count(*))) AS idf FROM r GROUP BY token HAVING count(*) <= 600),
 s AS (SELECT file_id, key, sum(idf) AS score FROM f JOIN d USING (token) JOIN r USING (token) GROUP BY file_id, key)
 SELECT file_id, key, score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY round(score, 6) DESC, key) AS k FROM s) WHERE k = 1""")
def record_candidates(spark, sf_dir):
    token = F.array_distinct(column(rules.tokens, "text"))
    files = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file_id"), F.explode(token).alias("token"))
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.explode(token).alias("token"))
    found = similarity.candidates(files, records)
    return found.withColumn("k", F.row_number().over(W.partitionBy("file_id").orderBy(F.desc(F.round("score", 6)), "key"))).filter("k = 1").drop("k")


@query(f"""WITH a AS (SELECT doc_id, unnest({rules.audit_tokens(DUCK, 'text')}) AS word FROM documents), b AS (SELECT doc_id, unnest({rules.audit_tokens(DUCK, rules.dehyphenate(DUCK, 'text'))}) AS word FROM documents),
 x AS (SELECT doc_id, word, count(*) AS x FROM a GROUP BY ALL), y AS (SELECT doc_id, word, count(*) AS y FROM b GROUP BY ALL)
 SELECT doc_id, cast(sum(greatest(coalesce(x, 0) - coalesce(y, 0), 0)) AS BIGINT) AS lost, cast(sum(greatest(coalesce(y, 0) - coalesce(x, 0), 0)) AS BIGINT) AS doubled FROM x FULL JOIN y USING (doc_id, word) GROUP BY doc_id""")
def lost_and_doubled_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("t", column(rules.dehyphenate, "text"))
    changed = docs.filter("text != t OR doc_id IS NULL")  # other texts lose nothing; of them it matters only whether they have a word
    before = changed.select("doc_id", F.explode(column(rules.audit_tokens, "text")).alias("word"))
    after = changed.select("doc_id", F.explode(column(rules.audit_tokens, "t")).alias("word"))
    worded = F.col("text").rlike("[A-Za-z]{2}") | (F.size(column(rules.audit_tokens, "text")) > 0)
    same = docs.filter("text = t AND doc_id IS NOT NULL").filter(worded).select("doc_id", F.lit(0).cast("long").alias("lost"), F.lit(0).cast("long").alias("doubled"))
    return similarity.lost_and_doubled(before, after).unionByName(same).groupBy("doc_id").agg(F.sum("lost").alias("lost"), F.sum("doubled").alias("doubled"))


@query("SELECT conv_id, turn, text FROM conversations c WHERE md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE conv_id % 2 = 0)")
def cache_miss(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("hash", F.md5("text"))
    store = turns.filter("conv_id % 2 = 0").select(F.col("hash").alias("h")).distinct()
    return turns.join(store, F.col("hash") == F.col("h"), "left_anti").select("conv_id", "turn", "text")


@query("SELECT conv_id, turn, s.t AS cached FROM conversations c LEFT JOIN (SELECT md5(text) AS h, min(role) AS t FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1) s ON md5(c.text) = s.h")
def cached_translations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("hash", F.md5("text"))
    store = turns.filter("conv_id % 2 = 0").groupBy(F.col("hash").alias("h")).agg(F.min("role").alias("t"))
    return engines.with_cached(turns, store).select("conv_id", "turn", F.col("translated").alias("cached"))


@query(f"SELECT doc_id, len(regexp_extract_all({rules.unspaced(DUCK, 'lower(text)')}, 'tion')) AS hits, (doc_id - 500 + 100000) % 100000 AS turn FROM documents WHERE len(regexp_extract_all({rules.unspaced(DUCK, 'lower(text)')}, 'tion')) > 0")
def search_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("t", F.lower("text")).select("doc_id", F.regexp_count(column(rules.unspaced, "t"), F.lit("tion")).alias("hits"))
    return docs.filter("hits > 0").withColumn("turn", F.pmod(F.col("doc_id") - 500, F.lit(100000)))  # wraps around from a start


# --- geometry


@query(f"""WITH e AS (SELECT doc_id, page, y0, y1, count(*) AS c FROM {LAYOUT} GROUP BY ALL), o AS (SELECT doc_id, page, y0, y1, c, max(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
 g AS (SELECT *, sum(CASE WHEN reach IS NULL OR y0 > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, y1 ROWS UNBOUNDED PRECEDING) AS k FROM o)
 SELECT doc_id, page, min(y0) AS y0, max(y1) AS y1, cast(sum(c) AS BIGINT) AS n FROM g GROUP BY doc_id, page, k""")
def interval_merge(spark, sf_dir):
    return geometry.merge_intervals(layout(spark, sf_dir), ["doc_id", "page"], "y0", "y1", 3.0)


@query(f"""WITH o AS (SELECT doc_id, page, x0, x1, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {LAYOUT})
 SELECT doc_id, page, max(reach) AS "left", min(x0) AS "right" FROM o WHERE reach IS NOT NULL AND x0 > reach + 3 GROUP BY doc_id, page, x0""")
def column_gaps(spark, sf_dir):
    return geometry.gutters(layout(spark, sf_dir), ["doc_id", "page"])


REGIONS = "(SELECT d.doc_id, d.page, r.region, r.x0, r.y0, r.x1, r.y1 FROM (SELECT DISTINCT doc_id, page FROM " + LAYOUT + ") d CROSS JOIN (VALUES (0, 40.0, 30.0, 300.0, 200.0), (1, 300.0, 30.0, 600.0, 150.0), (2, 40.0, 120.0, 600.0, 400.0)) r(region, x0, y0, x1, y1))"


def regions(spark, sf_dir):
    made = F.array(*(F.struct(F.lit(k).alias("region"), *(F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), b, strict=True))) for k, b in enumerate([(40.0, 30.0, 300.0, 200.0), (300.0, 30.0, 600.0, 150.0), (40.0, 120.0, 600.0, 400.0)])))
    return layout(spark, sf_dir).select("doc_id", "page").distinct().select("doc_id", "page", F.inline(made))


@query(f"""WITH h AS (SELECT l.doc_id, l.page, l.line_ix, r.region, greatest(least(l.x1, r.x1) - greatest(l.x0, r.x0), 0) * greatest(least(l.y1, r.y1) - greatest(l.y0, r.y0), 0) AS a FROM {LAYOUT} l JOIN {REGIONS} r USING (doc_id, page))
 SELECT doc_id, page, line_ix, region FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_ix ORDER BY a DESC, region) AS k FROM h WHERE a > 0) WHERE k = 1""")
def line_region_vote(spark, sf_dir):
    return geometry.region_vote(layout(spark, sf_dir), regions(spark, sf_dir))


@query(f"SELECT l.doc_id, l.page, l.line_ix AS point_ix, min(CASE WHEN l.x0 + 3 >= r.x0 AND l.x0 + 3 < r.x1 AND l.y0 + 3 >= r.y0 AND l.y0 + 3 < r.y1 THEN r.region END) AS link FROM {LAYOUT} l JOIN {REGIONS} r USING (doc_id, page) GROUP BY ALL")
def link_lookup(spark, sf_dir):
    points = layout(spark, sf_dir).select("doc_id", "page", F.col("line_ix").alias("point_ix"), (F.col("x0") + 3).alias("x"), (F.col("y0") + 3).alias("y"))
    return geometry.first_link(points, regions(spark, sf_dir).withColumnRenamed("region", "link_ix"))


@query(f"""WITH h AS (SELECT l.doc_id, l.page, l.line_ix, r.region, (r.x1 - r.x0) * (r.y1 - r.y0) AS a FROM {LAYOUT} l JOIN {REGIONS} r USING (doc_id, page) WHERE (l.x0 + l.x1) / 2 >= r.x0 AND (l.x0 + l.x1) / 2 < r.x1 AND (l.y0 + l.y1) / 2 >= r.y0 AND (l.y0 + l.y1) / 2 < r.y1)
 SELECT doc_id, page, line_ix, region AS block FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_ix ORDER BY a, region) AS k FROM h) WHERE k = 1""")
def smallest_holder(spark, sf_dir):
    return geometry.smallest_holder(layout(spark, sf_dir), regions(spark, sf_dir).withColumnRenamed("region", "block"))


NEAR = f"""(WITH p AS (SELECT l.doc_id, l.page, l.line_ix, o.line_ix AS other, least(l.x1, o.x1) > greatest(l.x0, o.x0) AS ac, least(l.y1, o.y1) > greatest(l.y0, o.y0) AS be, l.x0, l.y0, l.x1, l.y1, o.x0 AS ox0, o.y0 AS oy0, o.x1 AS ox1, o.y1 AS oy1 FROM {LAYOUT} l JOIN {LAYOUT} o ON l.doc_id = o.doc_id AND l.page = o.page AND l.line_ix <> o.line_ix),
 d AS (SELECT doc_id, page, line_ix, other, CASE WHEN ac AND oy0 >= y1 THEN 'below' WHEN ac AND oy1 <= y0 THEN 'above' WHEN be AND ox0 >= x1 THEN 'right' WHEN be AND ox1 <= x0 THEN 'left' END AS direction, CASE WHEN ac AND oy0 >= y1 THEN oy0 - y1 WHEN ac AND oy1 <= y0 THEN y0 - oy1 WHEN be AND ox0 >= x1 THEN ox0 - x1 ELSE x0 - ox1 END AS gap FROM p)
 SELECT doc_id, page, line_ix, direction, other, gap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, line_ix, direction ORDER BY gap, other) AS k FROM d WHERE direction IS NOT NULL) WHERE k = 1)"""


@query(f"SELECT * FROM {NEAR}")
def directional_neighbours(spark, sf_dir):
    return geometry.neighbours(layout(spark, sf_dir))


@query(f"SELECT l.doc_id, l.page, l.line_ix, NOT coalesce(bool_or(n.direction = 'above'), false) AS first, NOT coalesce(bool_or(n.direction = 'below'), false) AS last FROM {LAYOUT} l LEFT JOIN {NEAR} n ON l.doc_id = n.doc_id AND l.page = n.page AND l.line_ix = n.line_ix GROUP BY ALL")
def column_edges(spark, sf_dir):
    return geometry.column_edges(layout(spark, sf_dir))


@query(f"""WITH c AS (SELECT * FROM {LAYOUT} WHERE line_ix % 5 = 2), f AS (SELECT * FROM {LAYOUT} WHERE line_ix % 5 = 4),
 p AS (SELECT c.doc_id, c.page, c.line_ix AS caption, f.line_ix AS figure, CASE WHEN greatest(least(f.x1, c.x1) - greatest(f.x0, c.x0), 0) > 0.3 * least(f.x1 - f.x0, c.x1 - c.x0) THEN CASE WHEN f.y1 <= c.y0 + 2 THEN c.y0 - f.y1 WHEN f.y0 >= c.y1 - 2 THEN (f.y0 - c.y1) * 1.2 END
  WHEN greatest(least(f.y1, c.y1) - greatest(f.y0, c.y0), 0) > 0.3 * least(f.y1 - f.y0, c.y1 - c.y0) THEN CASE WHEN f.x1 <= c.x0 THEN c.x0 - f.x1 ELSE greatest(f.x0 - c.x1, 0) * 1.5 END END AS gap FROM c JOIN f USING (doc_id, page))
 SELECT doc_id, page, caption, figure, gap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, caption ORDER BY gap, figure) AS k FROM p WHERE gap < 800 * 0.2) WHERE k = 1""")
def caption_pairs(spark, sf_dir):
    rows = layout(spark, sf_dir)
    return geometry.nearest_caption(rows.filter("line_ix % 5 = 4").withColumnRenamed("line_ix", "figure"), rows.filter("line_ix % 5 = 2").withColumnRenamed("line_ix", "caption"), 800.0)


@query(f"""WITH a AS (SELECT doc_id, page, y0, line_ix FROM {LAYOUT} WHERE line_ix % 3 = 0), p AS (SELECT doc_id, page, y0 - 4 AS y, line_ix AS pos_ix FROM {LAYOUT}),
 j AS (SELECT p.doc_id, p.pos_ix, a.line_ix, row_number() OVER (PARTITION BY p.doc_id, p.pos_ix ORDER BY a.page, a.y0, a.line_ix) AS k FROM p JOIN a ON p.doc_id = a.doc_id AND (a.page > p.page OR (a.page = p.page AND a.y0 >= p.y)))
 SELECT p.doc_id, p.pos_ix, coalesce(j.line_ix, 0) AS node FROM p LEFT JOIN j ON p.doc_id = j.doc_id AND p.pos_ix = j.pos_ix AND j.k = 1""")
def node_at(spark, sf_dir):
    rows = layout(spark, sf_dir).withColumnRenamed("y0", "y")
    anchors = rows.filter("line_ix % 3 = 0").withColumnRenamed("line_ix", "node_ix")
    return geometry.node_at(anchors, rows.select("doc_id", "page", "y", F.col("line_ix").alias("pos_ix")))


@query(f"""WITH s AS (SELECT doc_id, page, line_ix // 2 AS row_ix, x0, x1 FROM {LAYOUT}), r AS (SELECT doc_id, page, count(DISTINCT row_ix) AS rows, min(floor(x0)) AS a, max(ceil(x1)) AS b FROM s GROUP BY ALL),
 p AS (SELECT DISTINCT doc_id, page, row_ix, unnest(range(cast(floor(x0) AS BIGINT), cast(ceil(x1) AS BIGINT))) AS x FROM s), c AS (SELECT doc_id, page, x, count(*) AS n FROM p GROUP BY ALL),
 e AS (SELECT doc_id, page, rows, unnest(range(cast(a AS BIGINT), cast(b AS BIGINT))) AS x FROM r),
 f AS (SELECT e.doc_id, e.page, e.x, coalesce(c.n, 0) > CASE WHEN rows >= 3 THEN greatest(1, rows // 5) ELSE 0 END AS occupied FROM e LEFT JOIN c USING (doc_id, page, x)),
 g AS (SELECT *, min(CASE WHEN occupied THEN x END) OVER w AS lo, max(CASE WHEN occupied THEN x END) OVER w AS hi FROM f WINDOW w AS (PARTITION BY doc_id, page)),
 h AS (SELECT doc_id, page, x, x - row_number() OVER (PARTITION BY doc_id, page ORDER BY x) AS k FROM g WHERE NOT occupied AND x > lo AND x < hi)
 SELECT doc_id, page, (min(x) + max(x) + 1) / 2 AS cut FROM h GROUP BY doc_id, page, k HAVING max(x) - min(x) + 1 >= 3""")
def table_columns(spark, sf_dir):
    return geometry.coverage_gaps(layout(spark, sf_dir).withColumn("row_ix", F.floor(F.col("line_ix") / 2)), ["doc_id", "page"])


@query()
def table_build(spark, sf_dir):
    return geometry.build_table(layout(spark, sf_dir).select("doc_id", "page", "x0", "y0", "x1", "y1", "text"))


@query()
def reading_order(spark, sf_dir):
    return geometry.reading_order(layout(spark, sf_dir).withColumnRenamed("line_ix", "unit").select("doc_id", "page", "unit", "x0", "y0", "x1", "y1"))


@query()
def figure_clusters(spark, sf_dir):
    return geometry.clusters(layout(spark, sf_dir).select("doc_id", "page", "x0", "y0", "x1", "y1"))


@query()
def detection_suppression(spark, sf_dir):
    boxes = regions(spark, sf_dir).select("doc_id", "page", F.col("region").alias("box_ix"), "x0", "y0", "x1", "y1", (F.lit(1.0) / (1 + F.pmod(F.col("doc_id") + F.col("region"), F.lit(3)))).alias("confidence"))
    return geometry.suppress(boxes)


# --- nodes


@query("""SELECT page_id AS doc_id, cast(len(regexp_extract_all(html, '<h[1-6][ >]')) AS BIGINT) AS headings, cast(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS items FROM pages""")
def html_node_counts(spark, sf_dir):
    found = nodes.html_nodes(table(spark, sf_dir, "pages"))
    counts = found.groupBy("doc_id").agg(F.sum((F.col("kind") == "heading").cast("long")).alias("headings"), F.sum((F.col("kind") == "item").cast("long")).alias("items"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id")).join(counts, "doc_id", "left").fillna(0)


@query()
def html_nodes(spark, sf_dir):
    return nodes.html_nodes(table(spark, sf_dir, "pages"))


@query()
def html_to_markdown(spark, sf_dir):
    return nodes.to_markdown(nodes.html_nodes(table(spark, sf_dir, "pages")))


@query()
def markdown_nodes(spark, sf_dir):
    return nodes.parse(table(spark, sf_dir, "documents"), markdown=True, pages=10)


@query("""WITH p AS (SELECT doc_id, text, unnest(string_split(text, chr(10) || chr(10))) AS part, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS k FROM documents),
 o AS (SELECT *, coalesce(sum(length(part) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p),
 b AS (SELECT *, array_to_string(list_filter(list_transform(string_split(part, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ') AS body FROM o)
 SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS node_ix, 'paragraph' AS kind, 0 AS level, body AS text, cast(least(9, floor(off / greatest(1, length(text)) * 10)) AS INT) AS page FROM b WHERE body <> ''""")
def text_nodes(spark, sf_dir):
    return nodes.parse(table(spark, sf_dir, "documents"), markdown=False, pages=10)


@query()
def documents_to_html(spark, sf_dir):
    return nodes.to_html(nodes.parse(table(spark, sf_dir, "documents")))


@query()
def translation_plan(spark, sf_dir):
    return engines.plan(nodes.html_nodes(table(spark, sf_dir, "pages"))).withColumn("hash", uni.fnv1a("text"))


CELLS = "(SELECT doc_id, [doc_id::VARCHAR, lang, source] AS head, [n_chars::VARCHAR, replace(text, chr(10), ' '), 'a\"b'] AS body FROM documents)"


@query(f"""SELECT doc_id, array_to_string(list_transform(head, lambda v: v), ',') || chr(13) || chr(10) || array_to_string(list_transform(body, lambda v: CASE WHEN regexp_matches(v, '[,"\\n\\r]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END), ',') || chr(13) || chr(10) AS csv FROM {CELLS}""")
def table_csv(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cells = F.array(F.array(F.col("doc_id").cast("string"), "lang", "source"), F.array(F.col("n_chars").cast("string"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit('a"b')))
    return docs.select("doc_id", nodes.delimited(cells).alias("csv"))


@query()
def table_cells(spark, sf_dir):
    rows = lines(spark, sf_dir).filter(F.contains("line", F.lit(" | "))).select("doc_id", "line_ix", F.replace("line", F.lit(" | "), F.lit("\t")).alias("row"))
    docs = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "row"))), lambda x: x["row"]).alias("rows"))
    return docs.select("doc_id", nodes.table_cells(F.col("rows")).alias("cells")).filter("cells IS NOT NULL").withColumn("markdown", nodes.pipe_table(F.col("cells")))


ENTRIES = f"""WITH l AS (SELECT *, {rules.is_refs_heading(DUCK, 'line')} AS opens, ({rules.section_word(DUCK, 'line')} OR {rules.is_closing_heading(DUCK, 'line')}) AND length(line) < 100 AS closes FROM {L}),
 i AS (SELECT *, last_value(CASE WHEN opens THEN 1 WHEN closes THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_ix ROWS UNBOUNDED PRECEDING) AS state FROM l),
 e AS (SELECT doc_id, line_ix, line, {rules.lead(DUCK, 'line')} AS lead, {rules.marker(DUCK, 'line')} AS number, lag(line) OVER (PARTITION BY doc_id ORDER BY line_ix) AS before FROM i WHERE state = 1 AND NOT opens AND trim(line) <> ''),
 s AS (SELECT *, coalesce({rules.entry_end(DUCK, 'before')}, 2) AS ended FROM e),
 n AS (SELECT *, sum(CASE WHEN number IS NOT NULL OR (lead = 'strong' AND ended >= 1) OR (lead = 'weak' AND ended >= 2) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_ix ROWS UNBOUNDED PRECEDING) AS entry_ix FROM s),
 g AS (SELECT doc_id, cast(entry_ix AS BIGINT) AS entry_ix, min(line_ix) AS first_line, count(*) AS n_lines, string_agg(line, ' ' ORDER BY line_ix) AS text, list(number ORDER BY line_ix)[1] AS number FROM n GROUP BY doc_id, entry_ix)"""


@query(f"""{ENTRIES} SELECT doc_id, entry_ix, number, first_line, n_lines, text FROM g""")
def reference_entries(spark, sf_dir):
    return references.entries(lines(spark, sf_dir))


@query(f"""{ENTRIES}, d AS (SELECT *, {rules.has_year(DUCK, 'text')} AS dated, number = lag(number) OVER (PARTITION BY doc_id ORDER BY entry_ix) + 1 AS nxt FROM g),
 a AS (SELECT doc_id, count(*) AS entries, count(*) FILTER (WHERE dated) AS dated, count(*) FILTER (WHERE nxt) AS numbered FROM d GROUP BY doc_id) SELECT *, entries >= 3 AND greatest(dated, numbered) * 2 >= entries AS accepted FROM a""")
def reference_lists(spark, sf_dir):
    return references.accepted(references.entries(lines(spark, sf_dir)))


@query(f"""WITH r AS (SELECT doc_id, line_ix, regexp_replace(line, '(\\s*[.·…‧∙•_]){{3,}}\\s*', ' ', 'g') AS row FROM {L}), p AS (SELECT *, {rules.trailing_pages(DUCK, 'row')} AS pages, {rules.first_page(DUCK, 'row')} AS page FROM r)
 SELECT doc_id, line_ix, trim(left(row, length(regexp_replace(row, '[,;\\s]+$', '')) - length(pages))) AS title, page FROM p WHERE pages IS NOT NULL""")
def contents_rows(spark, sf_dir):
    return references.contents_rows(lines(spark, sf_dir))


@query()
def unicode_forms(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return rows.select("doc_id", "line_ix", uni.fix_accents("line").alias("accents"), uni.normalized("line").alias("norm"), uni.fnv1a("line").alias("fnv"), uni.degeneracy("line").alias("stuck"), uni.vertical_html("line").alias("vertical"))
