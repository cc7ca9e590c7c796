"""Similar texts: bigrams, n-gram coverage, consensus, record matching. Candidates come from equi-joins on shared tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import column


def bigram_similar(a: Column, b: Column) -> Column:
    """Of two bigram sets: sizes within 85 of 100, and 8 of 10 of the longer shared."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return (short * 100 >= long * 85) & (F.size(F.array_intersect(a, b)) * 10 >= long * 8)


#: Words of 64 bits that a set of bigrams is folded into.
FOLDS = 4


def folded(grams: Column, k: int) -> Column:
    """The k-th of the words of bits that stand for a set: sets differ by no fewer bigrams than their bits."""
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(64 * FOLDS))
    bit = lambda x: F.when(F.floor(place(x) / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (place(x) % 64).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(grams, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x)))


def similar_lines(keys: DataFrame) -> DataFrame:
    """(a, b): pairs of similar keys of (key), a < b. Sets that share four fifths of the longer one share a bigram among the rarest fifth (and one) of either, and their sizes are of one band or of neighbouring ones, so only those are joined on, which is exact; what the folded bits cannot tell apart is compared whole."""
    grams = keys.select("key", column(rules.bigrams, "key").alias("g")).filter("size(g) >= 5").withColumn("id", F.xxhash64("key"))
    bits = {f"f{k}": folded(F.col("g"), k) for k in range(FOLDS)}
    each = grams.select("id", "key", F.size("g").alias("n"), *(v.alias(k) for k, v in bits.items()), F.explode("g").alias("x"))
    df = each.groupBy("x").agg(F.count("*").alias("df"))  # as many as there are bigrams
    ranked = each.join(df, "x").withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("df", "x")))
    rare = ranked.filter("r <= n - (n * 8 + 9) div 10 + 1").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100 / 85))))
    names = ["id", "key", "n", *bits]
    left = rare.select("x", "band", *(F.col(c).alias("a_" + c) for c in names))
    right = rare.select("x", F.explode(F.array(F.col("band") - 1, "band", F.col("band") + 1)).alias("band"), *(F.col(c).alias("b_" + c) for c in names))
    apart = sum((F.bit_count(F.col(f"a_f{k}").bitwiseXOR(F.col(f"b_f{k}"))) for k in range(FOLDS)), F.lit(0))
    most = F.col("a_n") + F.col("b_n") - 2 * F.floor((F.greatest("a_n", "b_n") * 8 + 9) / 10)
    pairs = left.join(right, ["x", "band"]).filter("a_key < b_key AND least(a_n, b_n) * 100 >= greatest(a_n, b_n) * 85").filter(apart <= most).select("a_id", "b_id").distinct()
    ga, gb = grams.select(F.col("id").alias("a_id"), F.col("key").alias("a"), F.col("g").alias("ga")), grams.select(F.col("id").alias("b_id"), F.col("key").alias("b"), F.col("g").alias("gb"))
    return pairs.join(ga, "a_id").join(gb, "b_id").filter("a < b").filter(bigram_similar(F.col("ga"), F.col("gb"))).select("a", "b").distinct()


def ngrams(words: Column, n: int) -> Column:
    """The distinct n-grams of an array, as strings."""
    count = F.size(words) - n + 1
    return F.when(count >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def ngram_coverage(docs: DataFrame, items: DataFrame, n: int = 3) -> DataFrame:
    """(item_id, grams, doc_id, found): for each item the document that has most of its n-grams; of equal ones the smallest id. The items are the small side; only their grams are sought."""
    words = column(rules.tokens, "text").alias("w")  # a column of its own, worked out once
    want = items.select("item_id", words).select("item_id", F.explode(ngrams(F.col("w"), n)).alias("gram"))
    total = want.groupBy("item_id").agg(F.count("*").alias("grams"))
    have = docs.select("doc_id", words).select("doc_id", F.explode(ngrams(F.col("w"), n)).alias("gram")).join(want.select("gram").distinct(), "gram", "left_semi")
    found = want.join(have, "gram").groupBy("item_id", "doc_id").agg(F.count("*").alias("found"))
    best = found.groupBy("item_id").agg(F.max(F.struct("found", (-F.col("doc_id")).alias("d"))).alias("m"))
    return total.join(best, "item_id", "left").select("item_id", "grams", (-F.col("m.d")).alias("doc_id"), F.coalesce("m.found", F.lit(0)).alias("found"))


def consensus(readings: DataFrame, key: str, text: str, stuck: Column) -> DataFrame:
    """(key, text): of a line's readings the least stuck, then the one nearest to all others by edit distance, then the longest, then the first in order."""
    least = readings.withColumn("stuck", stuck).withColumn("least", F.min("stuck").over(W.partitionBy(key))).filter("stuck = least")
    bare = least.select(key, text, F.regexp_replace(text, r"\s+", "").alias("bare")).withColumn("id", F.row_number().over(W.partitionBy(key).orderBy(text)))
    other = bare.select(F.col(key).alias("_k"), F.col("bare").alias("other"), F.col("id").alias("_id"))
    cost = bare.join(other, (F.col(key) == F.col("_k")) & (F.col("id") != F.col("_id")), "left").groupBy(key, text, "bare", "id").agg(F.coalesce(F.sum(F.levenshtein("bare", "other")), F.lit(0)).alias("cost"))
    return cost.groupBy(key).agg(F.min(F.struct("cost", (-F.length("bare")).alias("n"), "id", F.col(text).alias("t"))).alias("m")).select(key, F.col("m.t").alias(text))


def candidates(files: DataFrame, records: DataFrame, top: int = 40, common: int = 600) -> DataFrame:
    """(file_id, key, score): of the records that share tokens with a file's name, the ``top`` by summed idf to six digits (sums of equal terms differ by the order they are added in), of equal ones the smallest keys; tokens of more than ``common`` records don't count. Inputs are (file_id, token) and (key, token)."""
    n = records.select("key").distinct().count()
    df = records.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df") <= common).withColumn("idf", F.log(F.lit(float(n)) / (1 + F.col("df"))))
    scored = files.join(df, "token").join(records, "token").groupBy("file_id", "key").agg(F.sum("idf").alias("score"))
    return scored.withColumn("r", F.row_number().over(W.partitionBy("file_id").orderBy(F.desc(F.round("score", 6)), "key"))).filter(F.col("r") <= top).drop("r")


def year_component(a: Column, b: Column) -> Column:
    """1 for equal years and for none at all, 0.7 for a year off and for one unknown, else 0."""
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.7).when(a == b, 1.0).when(F.abs(a - b) == 1, 0.7).otherwise(0.0)


def combine(title: Column, author: Column, year: Column) -> Column:
    return title * (0.5 + 0.25 * author + 0.25 * year)


def best_match(scored: DataFrame, key: str, score: str, threshold: float = 0.70, margin: float = 0.03) -> DataFrame:
    """The best of each key's scores above the threshold, and whether the second is within the margin."""
    by = W.partitionBy(key).orderBy(F.desc(score), "record")
    ranked = scored.withColumns({"r": F.row_number().over(by), "second": F.lead(score).over(by)})
    return ranked.filter((F.col("r") == 1) & (F.col(score) >= threshold)).withColumn("ambiguous", F.coalesce(F.col(score) - F.col("second") < margin, F.lit(False))).drop("r", "second")


def lost_and_doubled(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, lost, doubled): the multiset difference of words before and after a step."""
    a, b = (d.select("doc_id", "word", F.lit(x).alias("x"), F.lit(y).alias("y")) for d, x, y in ((before, 1, 0), (after, 0, 1)))
    both = a.unionByName(b).groupBy("doc_id", "word").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    met = lambda n: F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col(n))  # noqa: E731  (what has no document meets nothing)
    return both.groupBy("doc_id").agg(F.sum(F.greatest(F.col("x") - met("y"), F.lit(0))).alias("lost"), F.sum(F.greatest(F.col("y") - met("x"), F.lit(0))).alias("doubled"))
