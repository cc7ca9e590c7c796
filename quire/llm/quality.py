"""Quality rules of texts and of the hosts that they come from.

Rules judge each text: too few words, too many repeated word triples (these two are ``base_failed``), too many symbols,
too many doubled lines, words too short or too long on average. Their failures are summed by host, each host's rate is
drawn towards a beta prior that is fitted to all hosts by the method of moments, and a host whose drawn rate is too high,
measured by that prior, is rejected with all its texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import small_batches, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
#: A host is rejected if the share of failing texts that its prior and its texts give is above this, or by more than
#: so many of the prior's standard deviations above its mean.
WORST, DEVIATIONS = 0.7, 3
#: A text fails with more than so many symbols for 100 words, so many doubled lines of 100 that have words, or with a
#: mean length of its words outside these bounds.
SYMBOLS, DOUBLED, SHORTEST, LONGEST = 10, 50, 3, 10


def filled_lines(text: str) -> int:
    """Lines that have words."""
    return sum(WORD.search(line) is not None for line in text.split("\n"))


def measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = WORD.findall(text)
    n = len(words)
    repeat = 0
    if n >= 3:
        numbers: dict[str, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
        k = np.int64(len(numbers))
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1].reshape(-1)  # so that three ids fit 64 bits
        _, which, times = np.unique(pairs[:-1] * k + ids[2:], return_inverse=True, return_counts=True)
        again = times[which.reshape(-1)] > 1
        if again.any():
            covered = np.zeros(n, bool)
            for shift in range(3):
                covered[shift : n - 2 + shift] |= again
            repeat = int(covered.sum())
    lines = text.split("\n")
    doubled = 0
    if len(lines) > 1:
        seen: set[str] = set()
        for line in lines:
            if WORD.search(line):
                doubled += line in seen
                seen.add(line)
    return n, sum(map(len, words)), len(SYMBOL.findall(text)), doubled, repeat


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, the five measures, base_failed, failed) for each row; ``failed`` is by any rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found = np.array([measures(t) for t in texts], np.int64).reshape(-1, 5)
            words, chars, symbols, doubled, again = found.T
            lines = np.fromiter((filled_lines(t) if n else 0 for t, n in zip(texts, doubled, strict=True)), np.int64, len(texts))
            base = (words < 50) | (100 * again > 50 * words)
            failed = base | (100 * symbols > SYMBOLS * words) | (100 * doubled > DOUBLED * lines) | (chars < SHORTEST * words) | (chars > LONGEST * words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(found[:, k]) for k in range(5)), pa.array(base), pa.array(failed)], ["doc_id", "host", *COLUMNS, "base_failed", "failed"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), "text")
    return rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, failed boolean")


def host_verdicts(judged: DataFrame, worst: float = WORST) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_kept) from (host, failed).

    The prior's mean is the mean of the hosts' rates and its strength follows from their variance beyond what their
    numbers of texts explain; with fewer than two hosts, or no such variance, the prior is worth all hosts' mean number of texts.
    A host goes at a drawn rate above DEVIATIONS standard deviations of the prior beyond its mean, and above ``worst`` in any case.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    one = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n_docs")).alias("inverse"), F.avg("n_docs").alias("size")).first()
    mean, strength = prior(one["m"] or 0.0, one["v"] or 0.0, one["inverse"] or 0.0, one["size"] or 0.0)
    limit = min(worst, mean + DEVIATIONS * (mean * (1 - mean) / (strength + 1)) ** 0.5)
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk <= limit).alias("host_kept"))


def prior(mean: float, variance: float, inverse: float, size: float) -> tuple[float, float]:
    """Mean and strength (alpha + beta) of the beta prior, from the hosts' mean rate, its variance, the mean of 1/n and of n."""
    own = variance - mean * (1 - mean) * inverse
    return mean, max(0.0, mean * (1 - mean) / own - 1) if own > 1e-9 else size


def quality_rules(docs: DataFrame, host: str = "source", worst: float = WORST) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, shrunk_rate), a row for each row of ``docs``.

    Null and empty texts have no words and fail. A null host is a host of its own. ``kept`` is false where the text
    fails by any rule or its host is rejected; ``shrunk_rate`` counts failures by any rule and is rounded to six places. Repeated rows count each; an empty table gives an empty result, and columns other
    than doc_id, text and ``host`` are not looked at.
    """
    judged = written(measured(docs, host), "quality")
    verdicts = host_verdicts(judged, worst).withColumnsRenamed({"host": "of"})
    joined = judged.join(verdicts, judged["host"].eqNullSafe(verdicts["of"]))
    return joined.select("doc_id", *COLUMNS, "base_failed", (~F.col("failed") & F.col("host_kept")).alias("kept"), "host", F.round("shrunk_rate", 6).alias("shrunk_rate"))
