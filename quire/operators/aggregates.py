"""Statistics of documents: modes, medians, repeated lines, lexicons, quality rates, audit flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import text as rules
from quire.functions.dialect import column


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """(keys, mode, weight): the value with the most weight; of equal ones the larger. Two partial aggregations, no window."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("weight"))
    return sums.groupBy(*keys).agg(F.max(F.struct("weight", value)).alias("m")).select(*keys, F.col(f"m.{value}").alias("mode"), F.col("m.weight").alias("weight"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the element at floor(n/2) of the sorted values, never an average. From counts of distinct values, so a long group is no long row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    by = W.partitionBy(*keys)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(by.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_n").over(by)})
    return ranked.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*keys).agg(F.min("_v").alias("median"))


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(key, docs): lines as keys with digits masked, and in how many documents each is; keys of three other characters at least, in two documents at least."""
    keyed = lines.select("doc_id", column(rules.digits_key, "line").alias("key")).filter(F.length(F.regexp_replace("key", "#", "")) >= 3)
    return keyed.groupBy("key").agg(F.countDistinct("doc_id").alias("docs")).filter("docs >= 2")


def dropped_lines(lines: DataFrame, pages: int, share: int = 4, least: int = 2) -> DataFrame:
    """The lines whose key is on max(least, ceil(pages / share)) documents or more: what a cleaned corpus leaves out."""
    keys = repeated_lines(lines).filter(F.col("docs") >= F.greatest(F.lit(least), F.ceil(F.lit(pages) / share))).select("key")
    return lines.withColumn("key", column(rules.digits_key, "line")).join(keys, "key", "left_semi").select("doc_id", "line_ix")


def lexicon(lines: DataFrame) -> DataFrame:
    """(word, n): words of two letters and more, without the halves of words broken at line ends, hyphenated words' parts counted too. ``lines`` may bring the line before each (``before``), else it is found by doc_id and line_ix."""
    ends = lambda c: F.col(c).rlike(r"[-‐‑][\s]*$")
    told = lines if "before" in lines.columns else lines.withColumn("before", F.lag("line").over(W.partitionBy("doc_id").orderBy("line_ix")))
    marked = told.withColumns({"w": column(rules.words, "line"), "cut": ends("line"), "open": F.coalesce(ends("before"), F.lit(False))})
    start = F.when(F.col("open"), 2).otherwise(1)
    inner = F.slice("w", start, F.greatest(F.lit(0), F.size("w") - (start - 1) - F.col("cut").cast("int")))
    forms = marked.select(F.explode(inner).alias("t")).groupBy("t").agg(F.count("*").alias("n"))  # each form is cleaned once
    bare = forms.select(F.lower(F.regexp_replace("t", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")).alias("word"), "n").filter(F.regexp_count("word", F.lit(r"\p{L}")) >= 2)
    parts = F.when(F.col("word").rlike("[-‐‑]"), F.filter(F.split("word", "[-‐‑]"), lambda p: F.length(p) >= 2)).otherwise(F.array().cast("array<string>"))
    return bare.select(F.explode(F.concat(F.array("word"), parts)).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def layer_quality(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, en_words, en_bad, en_rate): words that are garbled or that neither the dictionary ``known`` (word) has nor the document itself uses three times; the rate is null below 300 words."""
    words = pages.select("doc_id", F.explode(column(rules.quality_words, "dehyphenated")).alias("w")) if "dehyphenated" in pages.columns else pages.select("doc_id", column(rules.dehyphenate, "text").alias("t")).select("doc_id", F.explode(column(rules.quality_words, "t")).alias("w"))
    forms = words.groupBy("doc_id", "w").agg(F.count("*").alias("n"))  # each form is judged once
    told = forms.select("doc_id", F.lower("w").alias("low"), "n", F.when(column(rules.garbled, "w"), F.col("n")).otherwise(0).alias("garbled"), F.when(F.col("w").rlike("^[a-z]+$"), F.col("n")).otherwise(0).alias("plain"))  # no word is both
    counts = told.groupBy("doc_id", "low").agg(F.sum("n").alias("uses"), F.sum("garbled").alias("garbled"), F.sum("plain").alias("plain")).filter("garbled + plain > 0")
    judged = counts.join(known.filter("word rlike '^[a-z]+$'").select(F.col("word").alias("low")).distinct().withColumn("is_known", F.lit(True)), "low", "left")
    unknown = F.col("is_known").isNull() & ((F.length("low") < 5) | (F.col("uses") < 3))
    out = judged.groupBy("doc_id").agg(F.sum(F.col("garbled") + F.col("plain")).alias("en_words"), F.sum(F.col("garbled") + F.when(unknown, F.col("plain")).otherwise(0)).alias("en_bad"))
    return out.withColumn("en_rate", F.when(F.col("en_words") >= 300, F.col("en_bad") / F.col("en_words")))


def text_layer_share(lines: DataFrame) -> DataFrame:
    """(doc_id, good, judged, quality): characters on plausible lines of four characters and more; 1 below 200 characters."""
    n = F.length(column(lambda q, t: rules.unspaced(q, t), "line"))
    wordy = lambda w: F.size(F.filter(w, lambda x: (F.regexp_count(x, F.lit(r"\p{L}")) >= 3) & (F.regexp_count(x, F.lit(r"\p{L}")) * 10 >= F.length(x) * 7)))
    plausible = column(rules.prose_like, "line") | F.get(F.transform(F.array(column(rules.words, "line")), lambda w: (F.size(w) > 0) & (wordy(w) * 2 >= F.size(w))), F.lit(0))  # words are looked at one by one only where the line is no prose
    judged = lines.withColumn("n", n).filter("n >= 4").withColumn("ok", plausible)
    out = judged.groupBy("doc_id").agg(F.sum(F.when(F.col("ok"), F.col("n")).otherwise(0)).alias("good"), F.sum("n").alias("judged"))
    return out.withColumn("quality", F.when(F.col("judged") < 200, 1.0).otherwise(F.col("good") / F.col("judged")))


def idf(postings: DataFrame, n_docs: int, once: bool = False) -> DataFrame:
    """(token, df, idf) of (doc_id, token): ln(n / (1 + df)). With ``once`` each posting is there once, and only tokens and their counts are dealt out."""
    return postings.groupBy("token").agg((F.count("doc_id") if once else F.countDistinct("doc_id")).alias("df")).withColumn("idf", F.log(F.lit(float(n_docs)) / (1 + F.col("df"))))


#: Thresholds of the audit's measures; fixed values.
FLAGS = {"lost_pct": 3.0, "dup_pct": 2.0, "cut_lower_100p": 0.0, "hyphen_10kw": 2.0, "glued_10kw": 5.0, "caption_para_100p": 0.0, "short_paras_pct": 25.0}


def audit_measures(lines: DataFrame) -> DataFrame:
    """Rates of a document's paragraphs (here, its non-empty lines): cut ones, hyphens left, glued words, captions among them, short ones; and words lost or doubled by dropping repeated neighbours."""
    order = W.partitionBy("doc_id").orderBy("line_ix")
    rows = lines.filter("trim(line) != ''").withColumns({"next": F.lead("line").over(order), "prev": F.lag("line").over(order)})
    next_low = F.col("next").rlike(r"^\p{Ll}")
    # what is measured, a number a line, worked out once before anything is added up
    each = rows.select(
        "doc_id", F.length("line").alias("chars"), column(rules.words, "line").alias("w"), (F.col("line") == F.col("prev")).alias("again"),
        F.when(next_low, ~column(rules.ends_sentence, "line")).otherwise(F.lit(False)).alias("cut"),
        F.regexp_count("line", F.lit(r"\p{L}- \p{Ll}")).alias("hyphens"), column(rules.caption_kind, "line").isNotNull().alias("caption"))
    each = each.withColumns({"n": F.size("w"), "long": F.size(F.filter("w", lambda x: F.length(x) > 30))})
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return each.groupBy("doc_id").agg(
        F.count("*").alias("paras"), F.sum("n").alias("words"), count(F.col("cut")).alias("cut_lower"), F.sum("hyphens").alias("hyphen_left"), F.sum("long").alias("long_tokens"),
        count(F.col("caption")).alias("caption_para"), count(F.col("chars") < 40).alias("short_paras"), F.sum(F.when(F.col("again"), F.col("n")).otherwise(0)).alias("dup"))


def audit_rates(measures: DataFrame) -> DataFrame:
    """(doc_id, measure, value, flagged), a row for each measure."""
    paras, words = F.greatest(F.lit(1), F.col("paras")), F.greatest(F.lit(1), F.col("words"))
    values = {"dup_pct": 100 * F.col("dup") / words, "cut_lower_100p": 100 * F.col("cut_lower") / paras, "hyphen_10kw": 10000 * F.col("hyphen_left") / words, "glued_10kw": 10000 * F.col("long_tokens") / words, "caption_para_100p": 100 * F.col("caption_para") / paras, "short_paras_pct": 100 * F.col("short_paras") / paras}
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("value"), (v > FLAGS[k]).alias("flagged")) for k, v in values.items()))
    return measures.select("doc_id", F.inline(pairs))


def audit_summary(rates: DataFrame, worst: int = 8) -> DataFrame:
    """(measure, n, mean, flagged, worst_ids): the ids of the ``worst`` flagged values, largest first."""
    top = rates.filter("flagged").withColumn("k", F.row_number().over(W.partitionBy("measure").orderBy(F.desc(F.abs("value")), "doc_id"))).filter(F.col("k") <= worst)
    ids = top.groupBy("measure").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("worst_ids"))
    return rates.groupBy("measure").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.sum(F.col("flagged").cast("long")).alias("flagged")).join(ids, "measure", "left")


def compare_runs(base: DataFrame, new: DataFrame) -> DataFrame:
    """(measure, docs, mean_base, mean_new, worse, better) over the documents of both runs."""
    both = base.join(new.select("doc_id", "measure", F.col("value").alias("value_new"), F.col("flagged").alias("flagged_new")), ["doc_id", "measure"])
    return both.groupBy("measure").agg(
        F.count("*").alias("docs"), F.avg("value").alias("mean_base"), F.avg("value_new").alias("mean_new"),
        F.sum((~F.col("flagged") & F.col("flagged_new")).cast("long")).alias("worse"), F.sum((F.col("flagged") & ~F.col("flagged_new")).cast("long")).alias("better"))


def corpus_summary(docs: DataFrame) -> DataFrame:
    """(kind, bin, docs): one-way histograms of languages, sources and lengths, by grouping sets in one pass."""
    sized = docs.select(F.coalesce("lang", F.lit("-")).alias("lang"), F.coalesce("source", F.lit("-")).alias("source"), F.floor(F.log10(F.greatest(F.col("n_chars"), F.lit(1)))).cast("string").alias("size"))
    grouped = sized.groupingSets([[F.col("lang")], [F.col("source")], [F.col("size")]], "lang", "source", "size").agg(F.grouping_id().alias("g"), F.count("*").alias("docs"))
    kind = F.when(F.col("g") == 3, "lang").when(F.col("g") == 5, "source").otherwise("size")
    return grouped.select(kind.alias("kind"), F.coalesce("lang", "source", "size").alias("bin"), "docs")
