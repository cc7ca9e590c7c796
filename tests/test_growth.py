"""Steps that have to stay cheap on large tables, and give what plainer ones give."""

import random
import unicodedata

from quire.functions import unicode as uni


def test_unicode_functions_work_out_a_character_once(monkeypatch):
    calls, plain = [], unicodedata.normalize
    monkeypatch.setattr(unicodedata, "normalize", lambda form, t: calls.append(t) or plain(form, t))
    uni.BARE.clear()
    assert uni.strip_accents_text("éàﬁ一é" * 500) == "eaﬁ一e" * 500 and len(calls) <= 4
    random.seed(1)
    texts = ["".join(random.choices("aé一\0", k=random.choice((0, 1, 5, 300, 5000)))) for _ in range(200)]
    assert uni.fnv1a_texts(texts) == [uni.fnv1a_text(t) for t in texts] and uni.fnv1a_texts([]) == []
    assert [uni.degeneracy_text(t) for t in ("aaaa", "aaaaaaa", "一一一", "0000000", "-" * 50, "1,000000", "the the the the")] == [0, 3, 1, 1, 0, 3, 2]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_idf_of_single_postings_counts_tokens_alone(spark, tmp_path):
    from quire.operators import aggregates
    from quire.plans import operators

    postings = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "doc_id long, token string")
    assert {(r.token, r.df) for r in aggregates.idf(postings, 2, once=True).collect()} == {("a", 2), ("b", 1)}
    assert "distinct" not in plan(aggregates.idf(postings, 2, once=True))
    for ids, df in (((1, 2), 2), ((1, 1), 1)):  # a repeated id counts once
        spark.createDataFrame([(ids[0], "a a"), (ids[1], "A b")], "doc_id long, text string").write.parquet(f"{tmp_path}/{df}/documents.parquet")
        assert {(r.token, r.df) for r in operators.token_idf(spark, f"{tmp_path}/{df}").collect()} == {("a", df), ("b", 1)}


def test_lost_and_doubled_words_only_of_changed_texts(spark, tmp_path):
    from quire.plans import operators

    rows = [(1, "two words"), (2, "a bro-\nken word"), (3, ""), (4, None), (5, "1 2 3"), (6, "の"), (2, "broken"), (None, "two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = operators.lost_and_doubled_words(spark, str(tmp_path))
    assert {(r.doc_id, r.lost, r.doubled) for r in found.collect()} == {(1, 0, 0), (2, 2, 1), (6, 0, 0), (None, 1, 1)}
    assert "FullOuter" not in plan(found)


def test_lexicon_takes_the_line_before_as_given(spark):
    from quire.operators import aggregates

    rows = [("of time-", "scale", None), ("scale the", "x", "of time-"), ("(Time!)", "y", "scale the")]
    found = aggregates.lexicon(spark.createDataFrame(rows, "line string, other string, before string"))
    assert dict(found.collect()) == {"of": 1, "the": 1, "time": 1} and "Window" not in plan(found)


def test_words_are_judged_without_lists(spark, sf):
    from quire.plans import operators

    assert "collect_list" not in plan(operators.unknown_word_rate(spark, sf))


def test_words_of_texts_are_counted_without_lines(spark, sf):
    from quire.plans import rules

    assert "posexplode" not in plan(rules.words(spark, sf))


def test_keep_hyphen_joins_twice(spark):
    from quire.operators import sequence

    pairs = spark.createDataFrame([("sour", "dough"), ("sea", "floor"), ("sea", "xyz"), ("", "a")], "a string, b string")
    words = spark.createDataFrame([(w,) for w in ("sourdough", "sea", "floors", "floor")], "word string")
    found = sequence.keep_hyphen(pairs, words)
    assert {(r.a, r.b): r.keep for r in found.collect()} == {("sour", "dough"): False, ("sea", "floor"): True, ("sea", "xyz"): False, ("", "a"): False}
    assert "LeftSemi" not in plan(found)
