"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import documents, table

#: (host and path, verdict) of the standing rules.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import best_fit_packing, tokenized

    return best_fit_packing(tokenized(documents(spark, sf_dir), tokenizer_path(WORD_BPE)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.quality import quality_rules

    return quality_rules(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.sentencepieces import encoded

    return encoded(documents(spark, sf_dir), tokenizer_path(PIECE_BPE))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.jaccard_join import jaccard_join

    return jaccard_join(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import fit, toxicity

    docs = documents(spark, sf_dir)
    return toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op9_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_matrix import token_matrix

    return token_matrix(documents(spark, sf_dir), tokenizer_path(WORD_BPE))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.html_extract import html_extract

    return html_extract(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filter": op2_url_filter,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_matrix": op9_token_matrix,
    "op10_html_extract": op10_html_extract,
}

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS k FROM d),
g AS (SELECT doc_id, k, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
c AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, x, y, z) AS n FROM g WHERE z IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT k + s.i) AS n_repeat_words FROM c CROSS JOIN (VALUES (0), (1), (2)) s(i) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS filled, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, host, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(filled, 0) AS filled
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * filled OR word_chars < 3 * n_words OR word_chars > 10 * n_words AS failed FROM b),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE failed) AS k FROM f GROUP BY host),
p AS (SELECT avg(k / n) AS mean, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS inverse, avg(n) AS size FROM h),
q AS (SELECT mean, CASE WHEN v - mean * (1 - mean) * inverse > 1e-9 THEN greatest(0, mean * (1 - mean) / (v - mean * (1 - mean) * inverse) - 1) ELSE size END AS strength FROM p),
s AS (SELECT host, (k + mean * strength) / (n + strength) AS rate, least(0.7, mean + 3 * sqrt(mean * (1 - mean) / (strength + 1))) AS most FROM h CROSS JOIN q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND rate <= most AS kept, f.host, round(rate, 6) AS shrunk_rate FROM f JOIN s ON f.host IS NOT DISTINCT FROM s.host""",
    "op4_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2)) AS pos FROM d)),
s AS (SELECT doc_id, pos, left(g, 2) AS b, length(g) = 200 AND row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1 AS again FROM p),
c AS (SELECT doc_id, pos, b, coalesce(pos - max(CASE WHEN again THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) < 100, false) AS gone FROM s),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS opens FROM c),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans, string_agg(b, '' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    # the articles of the driver's pages, by a plain reading of their markup
    "op10_html_extract": r"""
WITH a AS (SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>([\s\S]*?)</article>', 1), '</?(?:p|h1)>')) AS x, unnest(range(1000)) AS k FROM pages),
b AS (SELECT page_id, url, k, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&#x27;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a WHERE x IS NOT NULL)
SELECT page_id, url, coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE t <> ''), '') AS text, coalesce(length(string_agg(t, chr(10) ORDER BY k) FILTER (WHERE t <> '')), 0) AS n_chars FROM b GROUP BY page_id, url""",
    "op2_url_filter": f"""
WITH parts AS (
  SELECT page_id,
         translate(CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^/?#]*)', 1) ELSE '' END, {AZ}) AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
judged AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged""",
    "op8_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {AZ}) AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)""",
}
