"""From raw documents to packed sequences: toxic texts go, exact and near copies go, repeated passages are cut, the rest is packed.

Every stage treats null texts as empty, whatever columns ``docs`` has beside doc_id and text, and keeps them all. Rows
are told apart by doc_id; where an id is null or repeated they are numbered instead, in the order of their ids, null first, so that a row is
never dropped for another one's text. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import documents, table, written
from quire.llm.exact_dedup import exact_dedup
from quire.llm.jaccard_join import jaccard_join
from quire.llm.packing import best_fit_packing, tokenized
from quire.llm.queries import WORD_BPE, tokenizer_path
from quire.llm.suffix_dedup import rest_name, suffix_dedup
from quire.llm.toxicity import fit, without_toxic

#: Near copies share this share of their distinct shingles of so many words.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Ids of dropped rows up to which they are handed to all tasks, 8 bytes each; beyond, both sides are dealt by id.
HANDED = 1_000_000


def apart(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number that each row has for itself, and that column's name."""
    name, one = f"row_{uuid.uuid4().hex}", F.col("doc_id").cast("long")
    if docs.groupBy(one.alias("i")).agg(F.count("*").alias("n")).filter("n > 1 OR i IS NULL").isEmpty():
        return docs.withColumn(name, one), name
    return written(docs.orderBy(one.asc_nulls_first()).withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without(docs: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number isn't in ``gone``."""
    gone = written(gone.select(F.col("doc_id").alias(f"{row}_gone")), "gone")
    if gone.count() <= HANDED:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(row) == F.col(f"{row}_gone"), "left_anti").drop(row)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; each row is judged by its text alone, and empty texts aren't toxic."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null and empty ones alike) the document with the largest id; of rows that repeat an id and its text, one."""
    rows, row = apart(docs)
    return without(rows, row, exact_dedup(rows.select(F.col(row).alias("doc_id"), "text")).filter("NOT kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest id; texts without words are nobody's copies."""
    rows, row = apart(docs)
    return without(rows, row, jaccard_join(rows.select(F.col(row).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT).filter("component_id != doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat earlier ones; n_chars follows. A text may become empty, and a null one does; its document stays."""
    cut = suffix_dedup(docs, with_kept=True).withColumn("text", F.decode("kept", "UTF-8"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    made = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("text")}
    made |= {c: F.col("rest").getField(rest_name(k)) for k, c in enumerate(others)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.select(*(made[c].alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces are in the packed sequences; every row has pieces, an empty text one of one token."""
    return best_fit_packing(tokenized(docs, tokenizer_path(WORD_BPE)))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("jaccard_join", near_copies), ("suffix_dedup", repeated_passages), ("best_fit_packing", packing)]

#: No SQL expresses the classifier, the tokenizer and the packing; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written and read again."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
