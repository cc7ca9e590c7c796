"""URL filter over a sorted array of digests.

The rules' strings (host and path) become unsigned 64-bit xxhash keys, sorted, in a file that each worker maps into
memory; the strings lie in a second file in the same order. A url's candidates (those of its host and parent domains that
have as many labels as some rule, with each path length that the rules have) are probed by one binary search over all candidates of a batch, and a key that
is found counts only if the stored string is the candidate's, so that collisions do no harm.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower

BLOCK, ALLOW = "block", "allow"
#: (host and path, verdict)
Rules = list[tuple[str, str]]


@dataclass
class DigestArray:
    """Keys (sorted), each one's string as a span of ``text``, and its verdict."""

    keys: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    blocks: np.ndarray
    path_lengths: list[int]
    label_counts: list[int]

    @staticmethod
    def write(rules: Rules, folder: str, hashed=xxhash.xxh64_intdigest) -> None:
        """A string that is given twice keeps its first verdict."""
        first = {}
        for rule, verdict in rules:
            first.setdefault(rule, verdict)
        rows = sorted((hashed(r.encode()), r.encode(), v == BLOCK) for r, v in first.items())
        np.save(f"{folder}/keys.npy", np.array([k for k, _, _ in rows], np.uint64))
        np.save(f"{folder}/ends.npy", np.cumsum([0, *(len(r) for _, r, _ in rows)]).astype(np.int64))
        np.save(f"{folder}/text.npy", np.frombuffer(b"".join(r for _, r, _ in rows) or b"\0", np.uint8))
        np.save(f"{folder}/blocks.npy", np.array([b for _, _, b in rows], bool))
        np.save(f"{folder}/labels.npy", np.array(sorted({r.partition("/")[0].count(".") + 1 for r in first}), np.int64))
        np.save(f"{folder}/lengths.npy", np.array(sorted({len(r.partition("/")[1] + r.partition("/")[2]) for r in first}), np.int64))

    @staticmethod
    def map(prefix: str) -> DigestArray:
        """Maps the files ``<prefix>keys.npy`` and so on into memory."""
        keys, ends, text, blocks, lengths, labels = (np.load(f"{prefix}{n}.npy", mmap_mode="r") for n in PARTS)
        return DigestArray(keys, ends, text, blocks, lengths.tolist(), labels.tolist())

    def probe(self, candidates: list[bytes], hashed=xxhash.xxh64_intdigest) -> np.ndarray:
        """The rule's number for each candidate, or -1."""
        if not len(self.keys) or not candidates:
            return np.full(len(candidates), -1)
        keys = np.fromiter(map(hashed, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(candidates), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # equal keys of different strings lie side by side
                if self.string(j) == candidates[i]:
                    found[i] = j
                    break
                j += 1
        return found

    def string(self, j: int) -> bytes:
        return self.text[self.ends[j] : self.ends[j + 1]].tobytes()

    def judge(self, hosts: list[str], paths: list[str], default: str = ALLOW) -> tuple[list[str | None], list[str]]:
        """The longest rule that fits and the verdict, for each (host, path)."""
        candidates, owner = [], []
        for n, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            labels = host.rsplit(".", self.label_counts[-1] if self.label_counts else 0)
            domains = [".".join(labels[-k:]) for k in self.label_counts if k < len(labels)] + [host] * (len(labels) in self.label_counts)
            for length in self.path_lengths:
                if length <= len(path):
                    candidates += [(d + path[:length]).encode() for d in domains]
                    owner += [n] * len(domains)
        rules: list[str | None] = [None] * len(hosts)
        verdicts = [default] * len(hosts)
        found = self.probe(candidates)
        for i in np.flatnonzero(found >= 0).tolist():
            n, rule = owner[i], candidates[i].decode()
            if rules[n] is None or len(rule) > len(rules[n]):
                rules[n], verdicts[n] = rule, BLOCK if self.blocks[found[i]] else ALLOW
        return rules, verdicts


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host is what follows the first "://" up to "/", "?", "#" or the end, with A-Z lower-cased; the path follows it up to "?", "#" or the end. A url that is null or has no "://" has neither."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


PARTS = ("keys", "ends", "text", "blocks", "lengths", "labels")


def ship(spark: SparkSession, rules: Rules) -> str:
    """Writes the array, hands its files to all executors with Spark's own file server, and returns their common prefix there."""
    name, folder = f"quire-urls-{uuid.uuid4().hex}", tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors that come later fetch the files as well
    DigestArray.write(rules, folder)
    for part in PARTS:
        os.rename(f"{folder}/{part}.npy", f"{folder}/{name}-{part}.npy")
        spark.sparkContext.addFile(f"{folder}/{name}-{part}.npy")
    return name


def url_filter(pages: DataFrame, rules: Rules, default: str = ALLOW) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of ``pages``, which needs page_id and url.

    A rule is a host with an optional path ("net/", "example.net/en/"). It fits the host and all its subdomains if the
    url's path starts with the rule's. The longest rule that fits decides; where none does, ``rule`` is null and the
    verdict is ``default``. Null urls and those without "://" have empty parts and the default verdict; an empty host
    fits no rule. Repeated rows are judged each, and an empty table gives an empty result.
    """
    name = ship(pages.sparkSession, rules)
    host, path = host_and_path(F.col("u"))
    parts = pages.select("page_id", F.col("url").alias("u")).select("page_id", host.alias("host"), path.alias("path"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = None
        for batch in batches:
            array = array or DigestArray.map(SparkFiles.get(f"{name}-"))
            found, verdicts = array.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist(), default)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string")
