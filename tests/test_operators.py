"""Operators on small hand-made tables."""

from pyspark.sql import functions as F

from quire.functions import unicode as uni
from quire.operators import aggregates, engines, geometry, nodes, references, sequence, similarity
from quire.sources import files


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", 5), ("b", None)], "k string, v int")
    assert dict(aggregates.upper_median(df, ["k"], "v").collect()) == {"a": 3, "b": 5}


def test_weighted_mode_prefers_the_larger(spark):
    df = spark.createDataFrame([("a", 10.0, 5), ("a", 12.0, 5), ("a", 9.0, 1)], "k string, v double, w int")
    assert aggregates.weighted_mode(df, ["k"], "v", F.col("w")).first()["mode"] == 12.0


def test_lexicon_leaves_broken_halves_out(spark):
    df = spark.createDataFrame([(1, 0, "the harv-"), (1, 1, "est of time-scale")], "doc_id long, line_ix int, line string")
    assert dict(aggregates.lexicon(df).collect()) == {"the": 1, "of": 1, "time-scale": 1, "time": 1, "scale": 1}


def test_keep_hyphen(spark):
    words = spark.createDataFrame([("sourdough",), ("rye",), ("bread",), ("tall",)], "word string")
    pairs = spark.createDataFrame([("sour", "dough"), ("rye", "bread"), ("km", "tall"), ("mari", "time"), ("NW", "SE")], "a string, b string")
    assert {(r.a, r.keep) for r in sequence.keep_hyphen(pairs, words).collect()} == {("sour", False), ("rye", True), ("km", True), ("mari", False), ("NW", True)}


def test_pack_batches(spark):
    df = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([5, 5, 8, 30, 1])] + [(2, 0, "y")], "d long, i int, t string")
    got = {(r.d, r.i): r.batch for r in sequence.pack_batches(df, "d", "i", "t", first=9, later=14).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 0): 0}


def test_similar_lines_against_all_pairs(spark):
    keys = ["runninghead", "runninghaed", "runningheads", "other words", "otherwords!", "bakeries of", "bakerys of it", "abcdef", "abcdeg"]
    grams = {k: {k.replace(" ", "")[i : i + 2] for i in range(len(k.replace(" ", "")) - 1)} for k in keys}
    want = {(a, b) for a in keys for b in keys if a < b and min(len(grams[a]), len(grams[b])) >= 5 and min(len(grams[a]), len(grams[b])) * 100 >= max(len(grams[a]), len(grams[b])) * 85 and len(grams[a] & grams[b]) * 10 >= max(len(grams[a]), len(grams[b])) * 8}
    got = {tuple(r) for r in similarity.similar_lines(spark.createDataFrame([(k,) for k in keys], "key string")).collect()}
    assert got == want and got


def test_consensus(spark):
    df = spark.createDataFrame([(1, "crusty loaf"), (1, "crusty loaf"), (1, "crusty loaaaaaaaf"), (1, "cru5ty loaf")], "k int, t string")
    assert similarity.consensus(df, "k", "t", uni.degeneracy("t")).first()["t"] == "crusty loaf"


def test_best_match(spark):
    df = spark.createDataFrame([("f", "a", 0.9), ("f", "b", 0.88), ("g", "a", 0.6), ("h", "c", 0.8)], "file string, record string, s double")
    assert {(r.file, r.record, r.ambiguous) for r in similarity.best_match(df, "file", "s").collect()} == {("f", "a", True), ("h", "c", False)}


def test_reading_order_title_over_two_columns():
    rows = [(0, 50, 10, 500, 30), (1, 50, 40, 260, 60), (2, 50, 65, 260, 90), (3, 290, 40, 500, 62), (4, 290, 66, 500, 90)]
    assert geometry.xy_cut(rows) == [0, 1, 2, 3, 4]


def test_build_table(spark):
    segs = [(1, 0, 10.0, 0.0, 40.0, 10.0, "k"), (1, 0, 100.0, 0.0, 140.0, 10.0, "v"), (1, 0, 10.0, 15.0, 40.0, 25.0, "a"), (1, 0, 100.0, 15.0, 130.0, 25.0, "1")]
    df = spark.createDataFrame(segs, "doc_id long, page int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [r.cells for r in geometry.build_table(df).orderBy("row_ix").collect()]
    assert got == [["k", "v"], ["a", "1"]]
    csv = spark.createDataFrame([(got,)], "c array<array<string>>").select(nodes.delimited(F.col("c"))).first()[0]
    assert csv == "k,v\r\na,1\r\n"


def test_suppression_and_clusters(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 0, 1, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 0, 2, 50.0, 50.0, 60.0, 60.0, 0.1)], "doc_id long, page int, box_ix int, x0 double, y0 double, x1 double, y1 double, confidence double")
    assert sorted(r.box_ix for r in geometry.suppress(df).collect()) == [0, 2]
    assert geometry.clusters(df, least=2).count() == 1


def test_table_cells(spark):
    df = spark.createDataFrame([(["a\tb", "1\t2", "3\t4\t5", "6"],), (["a\tb", "1\t2", "3\t4", "5"],), (["x"],)], "r array<string>")
    got = [r[0] for r in df.select(nodes.table_cells(F.col("r"))).collect()]
    assert got == [None, [["a", "b"], ["1", "2"], ["3", "4"], ["5", ""]], None]


def test_markdown_round(spark):
    text = "---\nx: 1\n---\n# T\n\npara one\nstill one\n\n- a\n- b\n\n3. c\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\nTitle\n=====\n\n```\ncode # x\n```\n"
    found = nodes.parse(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    kinds = [(r.kind, r.level, r.text) for r in found.orderBy("node_ix").collect()]
    assert kinds[:5] == [("heading", 1, "T"), ("paragraph", 0, "para one still one"), ("item", 0, "a"), ("item", 0, "b"), ("item", 0, "3. c")]
    assert ("heading", 1, "Title") in kinds and kinds[5][0] == "table"
    md = nodes.to_markdown(found).first()["markdown"]
    assert md.startswith("# T\n\npara one still one\n\n- a\n- b\n3. c\n\n| h | k |\n| --- | --- |\n| 1 | 2 |\n\n")
    assert "<h1>T</h1>" in nodes.to_html(found).first()["html"]


def test_spans(spark):
    rows = [([(", Ann", True, False, False, False, False, None), ("", True, False, False, False, False, None), ("x", False, False, False, True, False, None)],)]
    assert spark.createDataFrame(rows, f"s array<{nodes.STYLE}>").select(nodes.span_markdown(F.col("s"))).first()[0] == ", **Ann**<sup>x</sup>"


def test_references(spark):
    text = ["Some text.", "References", "Smith, J., 2010. A title.", "continued here, 12, 45-67.", "Jones, K., 2011. Other, 1-2.", "[3] Brown, L., 2012. Third.", "Appendix", "after"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(text)], "doc_id long, line_ix int, line string")
    found = references.entries(df).orderBy("entry_ix").collect()
    assert [(r.first_line, r.n_lines) for r in found] == [(2, 2), (4, 1), (5, 1)]
    assert references.accepted(references.entries(df)).first()["accepted"]


def test_translation(spark):
    class Echo:  # in here, so that it is shipped to the workers by value
        def translate(self, items):
            return [(i, t.upper()) for i, t in items if "skip" not in t]

    html = "<h1>Intro to it</h1><p>Some words here.</p><h2>References</h2><p>Smith a thing in it.</p><h2>After words</h2><p>skip this one now</p>"
    found = nodes.html_nodes(spark.createDataFrame([(7, html)], "page_id long, html string"))
    plan = engines.plan(found)
    assert [(r.node_ix, r.text) for r in plan.orderBy("node_ix").collect()] == [(0, "Intro to it"), (1, "Some words here."), (4, "After words"), (5, "skip this one now")]
    batches = plan.withColumn("hash", uni.fnv1a("text")).groupBy("doc_id").agg(F.collect_list(F.struct("node_ix", "text", "hash")).alias("items")).withColumn("batch", F.lit(0))
    got = engines.translate(batches, Echo()).collect()
    assert sum(r.failed for r in got) == 1 and "SOME WORDS HERE." in {r.translated for r in got}


def test_answers_and_failures(spark):
    df = spark.createDataFrame([('```json\n{"items": [{"id": 3, "ja": "x"}]}\n```', 429, "quota per day"), ("none", 401, "")], "a string, s int, b string")
    got = df.select(engines.parse_answer(F.col("a")).alias("i"), engines.failure(F.col("s"), F.col("b")).alias("f")).collect()
    assert got[0].i[0].ja == "x" and got[0].f == "daily limit" and got[1].i is None and got[1].f == "auth"


def test_unicode():
    assert uni.fix_accents_text("Caf´e `x`") == "Café `x`"
    assert uni.fnv1a_text("") == "cbf29ce484222325" and uni.fnv1a_text("a") == "af63dc4c8601ec8c"
    assert uni.decode_bytes(b"\xef\xbb\xbfx\r\ny") == "x\ny" and uni.decode_bytes("港町".encode("cp932")) == "港町"
    assert uni.degeneracy_text("27,00000kg") > 0 and uni.degeneracy_text("鐘鐘鐘鐘") == 2 and uni.degeneracy_text("------") == 0 and uni.degeneracy_text("Oar Oar Oar") == 1
    assert uni.vertical_html_text("全34巻") == '全<span class="tcy">34</span>巻' and uni.vertical_html_text("5kg") == '<span class="tcy">5</span><span class="tcy">kg</span>'
    assert uni.split_equation_number_text("a+b\\quad(4)") == ("a+b", "4") and uni.text_pattern("A1")[:3] == [9.0, 17.0, 0.0]


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes(b"\xef\xbb\xbf# T\r\nx")
    (tmp_path / "in" / "b.bin").write_bytes(b"%PDF-1.7")
    got = files.read_texts(spark, str(tmp_path / "in")).collect()
    assert [(r.kind, r.text) for r in got] == [("markdown", "# T\nx")]
    assert {r.path.rsplit("/")[-1]: r.is_pdf for r in files.library(spark, str(tmp_path / "in")).collect()} == {"a.md": False, "b.bin": True}
    (tmp_path / "s.jsonl").write_text('{"h": "1", "t": "old"}\nnot json\n{"h": "2", "t": "b"}\n{"h": "1", "t": "new"}\n')
    assert {r.h: r.t for r in files.read_translations(spark, str(tmp_path / "s.jsonl")).collect()} == {"1": "new", "2": "b"}
    bib = '@article{k1, title = {A {Nice} Title}, author = "Smith, J. and Doe, K.", year = 1999, title = {second}}\n@comment{x}\n@book{k2, year = {c. 1850}}'
    rows = files.read_bib(spark.createDataFrame([(bib,)], "text string")).orderBy("key").collect()
    assert [(r.key, r.title, r.authors, r.year) for r in rows] == [("k1", "A Nice Title", ["Smith, J.", "Doe, K."], 1999), ("k2", None, [], 1850)]
    name = spark.createDataFrame([("Smith and Doe 1999 - A title.pdf",)], "n string").select(files.parse_file_name(F.col("n")).alias("p")).first().p
    assert (name.authors, name.year, name.title) == ("Smith and Doe", 1999, "A title")


def test_ingest(spark, tmp_path):
    from quire.streaming.ingest import counted, ingest

    spark.range(5).write.parquet(str(tmp_path / "in"))
    seen = []
    for _ in range(2):  # the second run finds nothing new
        ingest(spark, str(tmp_path / "in"), "id long", str(tmp_path / "c"), lambda df, k: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 5
    events = spark.sql("SELECT timestamp'2024-01-01 10:10:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 10:50:00', 'a'")
    assert counted(events, "ts", "k").first()["n"] == 2


def chars_of(spark, rows):
    return spark.createDataFrame([(1, 0, 0, k, c, float(a), 0.0, float(b), 10.0, 10.0, "F") for k, (c, a, b) in enumerate(rows)], "doc_id long, page int, line_ix int, char_ix int, c string, x0 double, y0 double, x1 double, y1 double, size double, font string")


def test_chars(spark):
    import unicodedata

    from quire.operators import chars

    text = lambda df: unicodedata.normalize("NFC", "".join(r.c for r in df.orderBy("char_ix").collect()))
    assert text(chars.attach_accents(chars_of(spark, [("c", 0, 6), ("a", 6, 12), ("´", 6, 12)]))) == "cá"
    assert text(chars.attach_accents(chars_of(spark, [("`", 0, 3), ("x", 3, 9)]))) == "`x"
    assert text(chars.split_ligatures(chars_of(spark, [("ﬁ", 0, 6), ("x", 6, 9)]))) == "fix"
    table = spark.createDataFrame([("f", "x", "y"), ("f", "z", "")], "family string, c string, text string")
    assert text(chars.recoded(chars_of(spark, [("x", 0, 1), ("z", 1, 2), ("q", 2, 3)]), table)) == "yq"
    assert chars.spaced_lines(chars_of(spark, [("a", 0, 5), ("b", 5, 10), ("c", 15, 20), ("d", 20, 25), ("e", 25, 30)])).first()["text"] == "ab cde"
    second = chars_of(spark, [("Q", 0, 5)])
    assert text(chars.named_glyphs(chars_of(spark, [("\ufffd", 0, 5)]), second)) == "Q"
    assert spark.createDataFrame([("7 × 1012 and 4 km3",)], "text string").select(chars.ocr_superscripts()).first()[0] == "7 × 10^{12} and 4 km^{3}"


def test_known_words(spark):
    from quire.operators.matching import known_words

    lexicon = spark.createDataFrame([(w,) for w in ["stop", "centre", "center", "color", "sea", "floor", "organize", "happy"]], "word string")
    words = spark.createDataFrame([(w,) for w in ["stopped", "stops", "colour", "colours", "seafloors", "organisation", "happily", "prestop", "zq", "xstop"]], "word string")
    assert {r.word for r in known_words(words, lexicon).collect()} == {"stopped", "stops", "colour", "colours", "seafloors", "organisation", "happily", "prestop"}


def test_structure(spark):
    from quire.operators import structure

    rows = [(1, 0, k, t, float(x), float(y), float(x + 5 * len(t)), float(y + 10), s) for k, (t, x, y, s) in enumerate([("D", 0, 0, 30.0), ("ay one went", 8, 0, 10.0), ("2.1", 0, 50, 10.0), ("Methods", 20, 50, 10.0), ("* a note", 0, 90, 8.0), ("12", 0, 100, 10.0)])]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_ix int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    assert [(r.cap, r.line_ix) for r in structure.drop_caps(df).collect()] == [(0, 1)]
    assert [(r.number, r.title) for r in structure.section_numbers(df).collect()] == [(2, 3)]
    assert [r.line_ix for r in structure.page_numbers(df).collect()] == [5]
    assert 4 in {r.line_ix for r in structure.notes(df).collect()}
    tree = spark.createDataFrame([(1, 1, None, "A"), (1, 2, 1, "B"), (1, 3, 2, "C")], "doc_id long, id int, parent int, title string")
    assert {(r.depth, tuple(r.path)) for r in structure.flattened(tree).collect()} == {(0, ("A",)), (1, ("A", "B")), (2, ("A", "B", "C"))}
    assert structure.spread_pages(spark.range(100).selectExpr("1L AS doc_id", "cast(id AS int) AS page")).count() == 10


def test_matching(spark):
    from quire.operators.matching import match, title_similarity

    assert title_similarity("a18", "a19") < 0.5 and title_similarity("on the flow of lava in deep channels", "on the flow of lava in deep channels and more") == 0.97
    records = spark.createDataFrame([("k1", "the flow of lava", "smith", [], 1999), ("k2", "the flow of water", "jones", ["smith"], 1999), ("k3", "other things", "brown", [], 2001)], "key string, title string, author string, others array<string>, year int")
    files_ = spark.createDataFrame([(1, "the flow of lava", "smith", 1999), (2, "nothing alike", "nobody", 1900)], "file_id long, title string, author string, year int")
    got = match(files_, records).collect()
    assert [(r.file_id, r.record, round(r.score, 2)) for r in got] == [(1, "k1", 1.0)]


def test_made_characters_are_whole(spark, tmp_path):
    from quire.plans import pages

    texts = ["short", "a line of more than forty characters, as prose has them all the time", "third"] * 5
    spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert pages.made_chars(spark, str(tmp_path)).filter("doc_id = 1").count() == sum(map(len, texts))
    found = {r.line_ix: r.text for r in pages.ligatures_and_accents(spark, str(tmp_path)).filter("doc_id = 1").collect()}
    assert [found[k] for k in sorted(found)] == texts
    hits = pages.point_hits(spark, str(tmp_path)).filter("doc_id = 1").collect()
    assert sorted((r.point_ix, r.line_ix) for r in hits) == [(k, k) for k in range(len(texts))]


def test_titles_are_whole_lines(spark, tmp_path):
    from quire.plans import pages

    opening = "the collected papers of the society for the study of old manuscripts"
    texts = [f"{opening} on their inks and bindings\nx", f"{opening} catalogue with seventy plates\ny", "something else altogether\nz"]
    spark.createDataFrame([(20 + k, t, "s", 10) for k, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    (found,) = pages.entity_match(spark, str(tmp_path)).collect()
    assert (found.file_id, found.record, found.ambiguous) == (20, 20, False)


def test_candidates_of_equal_scores_are_told_apart_by_key(spark):
    """ln(n / 2) + ln(n / 6) and ln(n / 3) + ln(n / 4) are equal, but not as floating-point sums."""
    import math

    sums = lambda n: (math.log(n / 2) + math.log(n / 6), math.log(n / 3) + math.log(n / 4))
    n = next(n for n in range(20, 200) if sums(n)[0] != sums(n)[1])
    low, high = (("c", "d"), ("a", "b")) if sums(n)[0] > sums(n)[1] else (("a", "b"), ("c", "d"))  # the smaller key has the smaller sum
    rows = [(1, t) for t in low] + [(2, t) for t in high] + [(k, t) for t, more in (("b", 4), ("c", 1), ("d", 2)) for k in range(3, 3 + more)] + [(k, f"t{k}") for k in range(3, n + 1)]
    files = spark.createDataFrame([(0, t) for t in "abcd"], "file_id long, token string")
    found = similarity.candidates(files, spark.createDataFrame(rows, "key long, token string"), top=40)
    scores = {r.key: r.score for r in found.collect()}
    assert scores[1] < scores[2] and round(scores[1], 6) == round(scores[2], 6) > 0
    best = [r.key for r in similarity.candidates(files.filter("token in ('a', 'b', 'c', 'd')"), spark.createDataFrame(rows, "key long, token string"), top=sum(s > scores[2] + 1e-6 for s in scores.values()) + 1).collect()]
    assert 1 in best and 2 not in best


def test_match_against_all_pairs(spark, monkeypatch):
    """As told by a plain comparison of all pairs, of which few are compared."""
    import random

    from pyspark.sql import functions as F

    from quire.operators import matching, similarity

    random.seed(5)
    syllables = "ther on ing an re tion ly sh ou ea".split()
    words = ["".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(60)]
    titles = [" ".join(random.choices(words, k=random.choice((1, 2, 3, 5, 9, 40)))) for _ in range(60)]
    def other(t):  # a letter or two put in, left out or changed, a space lost, an ending
        for _ in range(random.randint(0, 2)):
            k = random.randrange(len(t))
            t = random.choice((t[:k] + t[k + 1 :], t[:k] + "x" + t[k:], t[:k] + "é" + t[k + 1 :]))
        return random.choice((t, t, t.replace(" ", "", 1), t + " pdf", t + " and more of it", " ".join(t.split())))
    records = [(k, other(random.choice(titles)), random.choice(("smith", "jones", None)), ["jones"], random.choice((2000, 2001, 2002, None))) for k in range(500)]
    files_ = [(k, t, a, y) for k, t, a, _, y in records[::5]] + [(1000 + k, random.choice((other(t), t[:20] + " … " + t[-10:])), random.choice(("smith", "jones", None)), random.choice((2000, 2001, None))) for k, t in enumerate(titles)] + [(2000, None, "smith", 2000), (2001, "", "smith", 2000)]
    rf = spark.createDataFrame(records, "key long, title string, author string, others array<string>, year int")
    ff = spark.createDataFrame(files_, "file_id long, title string, author string, year int")
    compared = spark.sparkContext.accumulator(0)

    def counted(a, b, least):
        compared.add(len(a))
        return matching._pairwise(a, b, least)

    monkeypatch.setattr(matching, "title_score", F.pandas_udf(counted, "double"))
    got = {r.file_id: (r.record, round(r.score, 9), r.ambiguous) for r in matching.match(ff, rf).collect()}
    token = lambda df, k: df.select(k, F.explode(F.array_distinct(F.filter(F.split("title", " "), lambda w: F.length(w) >= 3))).alias("token"))
    pairs = {(r.file_id, r.key) for r in similarity.candidates(token(ff, "file_id"), token(rf, "key")).collect()}
    by_key, want, all_pairs = {r[0]: r for r in records}, {}, 0
    for i, t, a, y in files_:
        scores = []
        for k, rt, ra, _, ry in records:
            same = a is not None and a == ra and (y is None or ry is None or abs(y - ry) <= 1)
            all_pairs += same
            if not (same or (i, k) in pairs):
                continue
            fit = matching.title_similarity(t, rt)
            author = 0.6 if a is None or ra is None else 1.0 if a == ra else 0.7 if a == "jones" else 0.0
            year = 1.0 if y == ry else 0.7 if y is None or ry is None or abs(y - ry) == 1 else 0.0
            if fit >= 0.5:
                scores.append((-fit * (0.5 + 0.25 * author + 0.25 * year), k))
        scores.sort()
        if scores and -scores[0][0] >= 0.70:
            want[i] = (scores[0][1], round(-scores[0][0], 9), len(scores) > 1 and scores[1][0] - scores[0][0] < 0.03)
    assert len(by_key) == 500 and len(want) > 100 and {x[2] for x in want.values()} == {True, False}
    assert got == want
    whole = spark.createDataFrame([(k, t, "smith", [], 2000) for k, t in enumerate(f"{random.choice(words)} {random.choice(words)} {k} {random.choice(words)}" for k in range(600))], rf.schema)
    compared.value = 0
    assert matching.match(whole.select(F.col("key").alias("file_id"), "title", "author", "year"), whole).count() == 600
    assert compared.value < 60_000  # of 360,000
