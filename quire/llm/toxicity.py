"""Toxic passages by maximum-scoring segments.

Each word gets a log-odds score under Dirichlet priors. A word's features are its leading 4, 6 and 8 characters and the
whole word; the longest that the fit knows decides, and each one's rate has its shorter neighbour's as prior mean, so
that rare words lean on their stem and unknown ones on the overall rate. A linear-time scan over a text's word scores
finds all maximal segments (Ruzzo and Tompa). A segment's chance under clean text follows the extreme-value law for
segment scores (Karlin and Altschul): about K * words * exp(-lambda * score) of them are expected, where lambda solves
the moment equation on clean words' scores, and K is the likeliest under the law for the best segments of clean texts.
The evidence of a text's significant segments is calibrated to a probability on labelled rows that the scores were not
fitted on.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import released, small_batches, written

WORD = re.compile(r"\w+")
STEMS = (4, 6, 8)
#: At most so many labelled rows are fitted on, those with the smallest hashes of their ids.
FIT_ROWS = 12_000
#: Texts that have a feature, at least; weight of the prior in counts; expected chance segments that make one significant.
LEAST, PRIOR, SIGNIFICANT = 5, 2.0, 0.02
#: The highest best segments of clean texts, which K is fitted to.
TAIL = 0.02
#: Scores are clipped here and shifted down, so that a segment must earn its words.
CLIP, SHIFT = 8.0, 0.3


def features(word: str) -> list[str]:
    """From general to special; a stem ends with a mark that no word has."""
    return [*(word[:n] + "-" for n in STEMS if len(word) > n), word]


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in linear time; ``end`` is exclusive."""
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    before: list[int] = []  # for each, the nearest earlier one with a smaller sum before, or -1
    total = 0.0
    for at, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        start, left, total = at, total, total + x
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = before[j]
            if j < 0 or found[j][3] >= total:
                found.append((start, at + 1, left, total))
                before.append(j)
                break
            start, left = found[j][0], found[j][2]
            del found[j:], before[j:]
    return [(a, b, r - left) for a, b, left, r in found]


@dataclass
class Model:
    rates: dict[str, float]
    base: float
    scale: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = -2.0

    def word(self, word: str) -> float:
        """The word's log-odds against the base rate, clipped and shifted."""
        rate = self.base
        for f in features(word):
            if (known := self.rates.get(f)) is None:
                break
            rate = known
        odds = math.log(rate / (1 - rate)) - math.log(self.base / (1 - self.base))
        return max(-CLIP, min(CLIP, odds)) - SHIFT

    def passages(self, text: str, cache: dict[str, float] | None = None) -> tuple[list[tuple[int, int, float]], float]:
        """Significant segments (start and end character, -log of the expected number by chance) and the text's evidence, their sum over what chance gives."""
        spans = [m.span() for m in WORD.finditer(text)]
        return self._found(spans, [self._cached(text[a:b].lower(), cache) for a, b in spans])

    def _cached(self, word: str, cache: dict[str, float] | None) -> float:
        if cache is None:
            return self.word(word)
        if (s := cache.get(word)) is None:
            s = cache[word] = self.word(word)
        return s

    def _found(self, spans: list | None, scores: list[float]) -> tuple[list, float]:
        if not scores or max(scores) <= 0:
            return [], 0.0
        chance, out, evidence = math.log(self.k * len(scores)), [], 0.0
        for a, b, s in segments(scores):
            bits = self.scale * s - chance
            if bits >= -math.log(SIGNIFICANT):
                evidence += bits
                out.append((spans[a][0], spans[b - 1][1], bits) if spans else (a, b, bits))
        return out, evidence

    def evidence(self, text: str, cache: dict[str, float] | None = None) -> float:
        return self._found(None, [self._cached(w, cache) for w in WORD.findall(text.lower())])[1]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * math.log1p(evidence) + self.offset))))


def scale_of(scores: Counter) -> float:
    """Lambda with sum p(s) exp(lambda s) = 1 over clean words' scores; 1 if they have no positive ones."""
    total = sum(scores.values())
    if not total or max(scores) <= 0:
        return 1.0
    excess = lambda x: sum(n * math.exp(min(600.0, x * s)) for s, n in scores.items()) / total - 1
    low, high = 1e-3, 5.0
    if excess(low) >= 0:
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return low


def k_of(best: list[tuple[float, int]], scale: float, share: float = TAIL) -> float:
    """The likeliest K for (best segment's score, words) of clean texts, if the score of a text of n words is at most x with chance
    exp(-K n exp(-lambda x)). The law is one of large scores, so of those below the highest ``share`` only that they are is known."""
    least = sorted(x for x, _ in best)[int(len(best) * (1 - share))] if best else 0.0
    known = sum(x >= least for x, _ in best)
    expected = sum(n * math.exp(-scale * max(x, least)) for x, n in best)
    return known / expected if expected > 0 else 0.1


def calibrated(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve over log(1 + evidence): by Newton's method with a small ridge, and then moved half the way to where the fewest labels are on the wrong side (the middle of the widest such gap), for a few wrong labels with much evidence pull the curve."""
    x, w = np.stack([np.log1p(evidence), np.ones(len(evidence))], 1), np.array([1.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (toxic - p) - 1e-2 * w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), np.clip(slope, -1e6, 1e6))
    values, at = np.unique(x[:, 0], return_inverse=True)
    if w[0] <= 0 or len(values) < 2:
        return float(w[0]), float(w[1])
    bad, good = np.bincount(at, toxic, len(values)), np.bincount(at, 1 - toxic, len(values))
    wrong = np.cumsum(bad)[:-1] + good.sum() - np.cumsum(good)[:-1]
    gap = np.where(wrong == wrong.min(), np.diff(values), -1.0)
    k = int(gap.argmax())
    return float(w[0]), float((w[1] - w[0] * (values[k] + values[k + 1]) / 2) / 2)


def fold_of(one: int) -> int:
    return zlib.crc32(str(one).encode()) % 5


def labelled(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(part, toxic, text) of at most ``rows`` labelled rows to learn from: crc32(doc_id as text) mod 5 is not 0, both label and id are there. part 1 to 3 is for the scores, 4 for the calibration."""
    few = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    few = few.withColumn("part", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).filter("part != 0").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(F.col("part").cast("int").alias("part"), "toxic", F.coalesce("text", F.lit("")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns from :func:`labelled`. Without labelled rows of both kinds the base rate is 1/2 and nothing is significant."""
    small_batches(docs.sparkSession)
    chosen = written(labelled(docs, labels, rows), "labelled")

    @released
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, hit = Counter(), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([hit[f] for f in seen], pa.int64())], ["feature", "n", "hits"])

        for batch in batches:
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = {f for word in set(WORD.findall(text.lower())) for f in features(word)}
                seen.update(mine)
                seen[""] += 1
                if toxic:
                    hit.update(mine)
                    hit[""] += 1
            if len(seen) > 300_000:
                yield out()
                seen.clear(), hit.clear()
        if seen:
            yield out()

    counts = chosen.filter("part != 4").select("toxic", "text").mapInArrow(counted, "feature string, n long, hits long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).filter((F.col("n") >= LEAST) | (F.col("feature") == ""))
    table = {f: (n, h) for f, n, h in counts.toPandas().itertuples(index=False)}
    n, h = table.pop("", (0, 0))
    model = Model({}, (h + 1) / (n + 2))
    if not 0 < h < n:
        return Model({}, 0.5, offset=-2.0)

    for f in sorted(table, key=lambda f: (not f.endswith("-"), len(f))):  # a prior mean comes before what it is for
        mean = model.base
        for k in STEMS:
            if k < len(f.removesuffix("-")):
                mean = model.rates.get(f[:k] + "-", mean)
        model.rates[f] = min(0.9999, (table[f][1] + PRIOR * mean) / (table[f][0] + PRIOR))
    held = chosen.filter("part = 4").select("toxic", "text")

    @released
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of clean texts: (score, how often, null) of words, and (best segment's score, words, 1) of each."""
        for batch in batches:
            words, best, cache = Counter(), [], {}
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                scores = [] if toxic else [model._cached(w, cache) for w in WORD.findall(text.lower())]
                words.update(round(s, 1) for s in scores)
                if scores:
                    best.append((max((s for _, _, s in segments(scores)), default=0.0), len(scores), 1))
            rows = [*((s, n, None) for s, n in words.items()), *best]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 3, (pa.float64(), pa.int64(), pa.int64()), strict=True)], ["x", "n", "text"])

    found = held.mapInArrow(clean, "x double, n long, text long").groupBy("x", F.when(F.col("text") == 1, F.col("n")).alias("words")).agg(F.sum("n").alias("n"), F.count("text").alias("texts")).collect()  # at most a row a labelled text, and one for each tenth from -CLIP to CLIP
    model.scale = scale_of(Counter({r.x: r.n for r in found if r.words is None}))
    model.k = k_of([(r.x, r.words) for r in found if r.words is not None for _ in range(r.texts)], model.scale)

    @released
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cache: dict[str, float] = {}
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.evidence(t, cache) for t in batch.column(1).to_pylist()], pa.float64())], ["toxic", "x"])

    evidence = held.mapInArrow(scored, "toxic int, x double").toPandas()
    if evidence["toxic"].nunique() == 2:
        model.slope, model.offset = calibrated(evidence["x"].to_numpy(), evidence["toxic"].to_numpy().astype(float))
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages), a row for each row of ``docs``.

    The whole text is scored, and nothing but the text: ``score`` (0 to 1) is the calibrated probability of the label,
    ``predicted`` whether it is at least 1/2, and ``passages`` the significant segments (first character, end, minus the
    log of the expected number by chance). Null and empty texts have no passage and the score of no evidence. held_out
    is whether crc32(doc_id as text) mod 5 is 0; a null doc_id is not. Repeated rows are scored each; an empty table
    gives an empty result, and other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)  # features that LEAST of FIT_ROWS texts have

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                if model.value._found(None, [model.value._cached(w, cache) for w in WORD.findall(text.lower())])[1] > 0:
                    found.append(model.value.passages(text, cache))
                else:
                    found.append(([], 0.0))
                if len(cache) > 200_000:
                    cache.clear()
            scores = [model.value.probability(e) for _, e in found]
            spans = pa.array([[{"start": a, "end": b, "bits": s} for a, b, s in p] for p, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), spans], ["doc_id", "held_out", "score", "predicted", "passages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<start:int,end:int,bits:double>>")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text isn't predicted toxic; as :func:`toxicity` judges, without a shuffle."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            clean = [model.value.probability(model.value.evidence(t, cache) if t else 0.0) < 0.5 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(clean, pa.bool_())).columns, batch.schema.names)
            if len(cache) > 200_000:
                cache.clear()

    return docs.mapInArrow(run, docs.schema)
