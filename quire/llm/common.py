"""Helpers that the operators share: the shared folder, small Arrow batches, null-safe columns."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text that go to a Python worker at once; the worker's memory is this many of the longest texts.
TEXT_ROWS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quire-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where it is unset and there is one machine only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
    return (given or _own_folder()).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: the lineage ends here, and a lost executor costs no recomputation.

    Shuffle files of what led to it are let go, so that a chain of such steps does not keep the disk of all of them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._quire_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Let Arrow batches hold few rows, for texts are long: a worker's memory is bounded by rows times the longest text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


#: A key with more than one row in so many is taken to its rows; there are fewer such keys than this.
HOT = 1000


def spread_join(rows: DataFrame, key: str, table: DataFrame, of: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of the row of ``table`` whose ``of`` is their ``key``; rows without one go.

    ``table`` has one row for each key, whose ``size`` says how many of ``total`` rows have it. Rows of large keys get theirs from a
    broadcast of fewer than HOT rows; the other rows are dealt by key, and in that shuffle those of large keys by their content.
    """
    names = [c for c in table.columns if c not in (of, size)]
    hot = table.filter(F.col(size) * HOT > total).select(F.col(of).alias("hot_of"), *(F.col(c).alias(f"hot_{c}") for c in names))
    salt = F.when(F.col("hot_of").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)))
    spread = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_of"), "left").withColumn("spread_key", F.struct(F.col(key).alias("k"), salt.alias("s")))
    cold = table.select(F.struct(F.col(of).alias("k"), F.lit(-1).cast("long").alias("s")).alias("spread_of"), *(F.col(c).alias(f"cold_{c}") for c in names))
    joined = spread.join(cold, F.col("spread_key") == F.col("spread_of"), "left").filter("hot_of IS NOT NULL OR spread_of IS NOT NULL")
    return joined.select(*rows.columns, *(F.when(F.col("hot_of").isNull(), F.col(f"cold_{c}")).otherwise(F.col(f"hot_{c}")).alias(c) for c in names))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when a task is done, its worker, which other tasks use again, gives free memory back to the system."""

    @wraps(run)
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return over


def over_batches(each: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that treats each batch by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return run
