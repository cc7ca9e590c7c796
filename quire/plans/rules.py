"""One query for each text rule, over every line of every document and the hand-made lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import DUCK, Rule, column
from quire.functions.fixture import LINES, REFERENCES, TABLE

Query = Callable[[SparkSession, str], DataFrame]
MADE = [(-1 - d, k, x) for d, texts in enumerate((LINES, REFERENCES, TABLE)) for k, x in enumerate(texts)]


def lines(spark: SparkSession, sf_dir: str, docs: bool = True) -> DataFrame:
    """(doc_id, line_ix, line): documents cut at newlines; the hand-made lines are documents -1 to -3, alone without ``docs``."""
    made = spark.createDataFrame(MADE, "doc_id long, line_ix int, line string")
    if not docs:
        return made
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ix", "line"))
    return found.unionByName(made)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINES_SQL = (
    "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_ix, unnest(string_split(text, chr(10))) AS line FROM documents "
    "UNION ALL SELECT doc, ix, line FROM (VALUES " + ", ".join(f"({d}, {k}, {_quoted(x)})" for d, k, x in MADE) + ") made(doc, ix, line)"
)


def _where(rule: Rule) -> Query:
    return lambda spark, sf_dir: lines(spark, sf_dir).filter(column(rule, "line")).select("doc_id", "line_ix")


def _changed(rule: Rule) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines(spark, sf_dir).select("doc_id", "line_ix", "line", column(rule, "line").alias("made")).filter("made != line").select("doc_id", "line_ix", F.md5("made").alias("made_md5"))

    return run


def _value(rule: Rule) -> Query:
    return lambda spark, sf_dir: lines(spark, sf_dir).select("doc_id", "line_ix", column(rule, "line").cast("string").alias("value")).filter("value IS NOT NULL")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, n): the corpus's words, counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")  # a text's words are its lines' words
    texts = docs.unionByName(spark.createDataFrame([(x,) for *_, x in MADE], "text string"))
    return texts.select(F.explode(column(rules.words, "text")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


WORDS_SQL = f"SELECT word, count(*) AS n FROM (SELECT unnest({rules.words(DUCK, 'line')}) AS word FROM ({LINES_SQL})) GROUP BY word"


def _words_where(rule: Rule) -> Query:
    return lambda spark, sf_dir: words(spark, sf_dir).filter(column(rule, "word"))


QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _name, _rule in rules.PREDICATES.items():
    QUERIES[f"line_{_name}"] = _where(_rule)
    ORACLE_SQL[f"line_{_name}"] = f"SELECT doc_id, line_ix FROM ({LINES_SQL}) WHERE {_rule(DUCK, 'line')}"
for _name, _rule in rules.CLEANERS.items():
    QUERIES[f"line_{_name}"] = _changed(_rule)
    ORACLE_SQL[f"line_{_name}"] = f"SELECT doc_id, line_ix, md5(made) AS made_md5 FROM (SELECT doc_id, line_ix, line, {_rule(DUCK, 'line')} AS made FROM ({LINES_SQL})) WHERE made <> line"
for _name, _rule in rules.VALUES.items():
    QUERIES[f"line_{_name}"] = _value(_rule)
    ORACLE_SQL[f"line_{_name}"] = f"SELECT * FROM (SELECT doc_id, line_ix, cast({_rule(DUCK, 'line')} AS VARCHAR) AS value FROM ({LINES_SQL})) WHERE value IS NOT NULL"
for _name, _rule in rules.WORD_PREDICATES.items():
    QUERIES[f"word_{_name}"] = _words_where(_rule)
    ORACLE_SQL[f"word_{_name}"] = f"SELECT word, n FROM ({WORDS_SQL}) WHERE {_rule(DUCK, 'word')}"
