"""Operators over pages, units, records and inline text on small hand-made tables, against plain Python where they are greedy or recurse."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import geometry, layout, models, records, units

LINE = "doc_id long, page int, line_ix int, text string, x0 double, y0 double, x1 double, y1 double, size double"


def lines(spark, rows):
    """(text, x0, y0, x1) on page 0 of document 1, ten high."""
    return spark.createDataFrame([(1, 0, k, t, float(x0), float(y0), float(x1), float(y0 + 10), 10.0) for k, (t, x0, y0, x1) in enumerate(rows)], LINE)


def boxes(spark, rows, name="box_ix", schema=None):
    return spark.createDataFrame([(1, 0, k, *map(float, r)) for k, r in enumerate(rows)], schema or f"doc_id long, page int, {name} int, x0 double, y0 double, x1 double, y1 double")


def test_pages_stream_whole(spark):
    df = spark.createDataFrame([(d, p, k, f"t{k}") for d in (None, 1, 2) for p in range(3) for k in range(5)], "doc_id long, page int, k int, t string").repartition(5)
    got = geometry.each_page(df, ["k", "t"], lambda rows: [(len(rows), rows[0][1], rows[-1][0])], "n int, first string, last int").collect()
    assert len(got) == 9 and {(r.n, r.first, r.last) for r in got} == {(5, "t0", 4)}
    assert geometry.each_page(df.filter("false"), ["k", "t"], lambda rows: [(1, "", 1)], "n int, first string, last int").count() == 0


def test_a_whole_line_replaces_its_parts():
    part, other, whole = (0, 0.0, 0.0, 40.0, 10.0, 0.9), (1, 45.0, 0.0, 80.0, 10.0, 0.8), (2, 0.0, 0.0, 82.0, 10.5, 0.5)
    assert geometry.suppressed([part, other, whole]) == [whole]
    thick = (3, 0.0, 0.0, 82.0, 30.0, 0.4)
    assert geometry.suppressed([part, other, thick]) == [part, other]


def plain_clusters(rows, grow):
    left, out = list(range(len(rows))), []
    while left:
        group, queue = [], [left.pop(0)]
        while queue:
            i = queue.pop()
            group.append(i)
            near = [j for j in left if min(rows[i][2], rows[j][2]) + 2 * grow >= max(rows[i][0], rows[j][0]) and min(rows[i][3], rows[j][3]) + 2 * grow >= max(rows[i][1], rows[j][1])]
            queue += near
            left = [j for j in left if j not in near]
        out.append(sorted(group))
    return sorted(out)


def test_touching_boxes():
    random.seed(3)
    for _ in range(40):
        rows = sorted((x, y, x + random.randint(1, 12), y + random.randint(1, 12)) for x, y in ((random.randint(0, 90), random.randint(0, 90)) for _ in range(30)))
        assert sorted(map(sorted, geometry.touching(rows, 2))) == plain_clusters(rows, 2)


def test_figures(spark):
    figures = boxes(spark, [(0, 0, 100, 50), (0, 60, 100, 100), (120, 0, 200, 100), (0, 300, 50, 340), (0, 350, 50, 390)], "figure")
    texts = boxes(spark, [(0, 343, 50, 348)])
    got = sorted((r.x0, r.y0, r.x1, r.y1, r.n) for r in geometry.merged_figures(figures, texts).collect())
    assert got == [(0.0, 0.0, 100.0, 100.0, 2), (0.0, 300.0, 50.0, 340.0, 1), (0.0, 350.0, 50.0, 390.0, 1), (120.0, 0.0, 200.0, 100.0, 1)]  # a text parts the lower two
    labels = boxes(spark, [(105, 10, 120, 20), (125, 10, 140, 20), (300, 300, 320, 310)], "label")
    assert [(r.label, r.figure) for r in geometry.absorbed_labels(boxes(spark, [(0, 0, 100, 50)], "figure"), labels).collect()] == [(0, 0), (1, 0)]  # the second follows the first
    pictures = geometry.merged_pictures(boxes(spark, [(0, 0, 10, 10), (2, 0, 12, 10), (30, 0, 40, 10)])).collect()
    assert sorted((r.x0, r.x1, r.n) for r in pictures) == [(0.0, 12.0, 2), (30.0, 40.0, 1)]
    captions = boxes(spark, [(0, 55, 100, 60), (0, 62, 100, 66)], "caption")
    assert [(r.caption, r.figure) for r in geometry.paired_captions(boxes(spark, [(0, 0, 100, 50)], "figure"), captions, 800.0).collect()] == [(0, 0)]
    alone = geometry.open_captions(boxes(spark, [(0, 200, 100, 210)], "caption"), boxes(spark, [(300, 0, 400, 50)]), boxes(spark, [(0, 40, 100, 60)])).collect()
    assert [(r.y0, r.y1) for r in alone] == [(62.0, 198.0)]


def test_tables(spark):
    rows = [("name", 0, 0, 40), ("hours", 100, 0, 140), ("rye", 0, 20, 30), ("12", 100, 20, 120), ("of the north", 110, 31, 160), ("oat", 0, 50, 30), ("3", 100, 50, 110), ("bun", 0, 70, 30), ("4", 100, 70, 110), ("pie", 0, 90, 30), ("x5", 100, 90, 110), ("cob", 0, 110, 30), ("6", 100, 110, 110)]
    df = lines(spark, rows)
    got = [r.cells for r in geometry.build_table(df).orderBy("row_ix").collect()]
    assert got == [["name", "hours"], ["rye", "12 of the north"], ["oat", "3"], ["bun", "4"], ["pie", "x5"], ["cob", "6"]]
    assert {(r.issue, r.n) for r in geometry.table_issues(df).collect()} == set()
    number = lines(spark, [r if r[0] != "of the north" else ("7", 110, 31, 120) for r in rows])
    assert {(r.issue, r.n) for r in geometry.table_issues(number).collect()} == {("mixed", 1)}
    ruled = geometry.build_table(lines(spark, [("a b", 0, 0, 60), ("c", 70, 0, 90)]), boxes(spark, [(29, -5, 30, 20)])).collect()
    assert [r.cells for r in ruled] == [["a b", "c"]] and {r.issue for r in geometry.table_issues(lines(spark, [("a b", 0, 0, 60), ("c", 70, 0, 90)]), boxes(spark, [(29, -5, 30, 20)])).collect()} == {"small", "spanning"}


def test_units(spark):
    df = lines(spark, [("p + q =", 0, 0, 60), ("r + s (4)", 0, 12, 60), ("plain words here", 0, 30, 60), ("= t", 0, 200, 60)])
    assert [(r.unit, r.formula) for r in units.merged_formulas(df.withColumnRenamed("line_ix", "unit")).orderBy("unit").collect()] == [(0, 0), (1, 0), (2, 2), (3, 3)]
    row = lines(spark, [("left", 0, 0, 40), ("more", 45, 0, 80), ("far", 130, 0, 150), ("below", 0, 40, 30)])
    assert [(r.line_ix, r.head) for r in units.stitched_rows(row).orderBy("line_ix").collect()] == [(0, 0), (1, 0), (2, 2), (3, 3)]
    heads = lines(spark, [("The Long Way", 0, 0, 100), ("Round the Cape", 0, 14, 100), ("2 Sails", 0, 28, 100), ("帆の", 0, 60, 100), ("歴史", 0, 74, 100)]).withColumn("level", F.lit(2))
    assert [r.text for r in units.continued_headings(heads).orderBy("line_ix").collect()] == ["The Long Way Round the Cape", "2 Sails", "帆の歴史"]
    numbers = lines(spark, [(str(5 * k), 10, 20 * k, 25) for k in range(9)] + [(f"text {k}", 50, 20 * k, 200) for k in range(9)] + [("7", 60, 300, 70)])
    assert units.without_line_numbers(numbers).count() == 10


def test_swallowed_headings(spark):
    from quire.plans import layouts

    got = {(r.node_ix, r.part): (r.kind, r.level, r.text) for r in layouts.swallowed_headings(spark, None).collect()}
    assert got[0, 0][0] == "paragraph" and got[2, 0] == ("heading", 4, "Old Fires and New") and got[4, 0] == ("heading", 3, "3.1 The Third Loaf")
    assert got[3, 0] == ("paragraph", 0, "Fires are lit at four. See Figure 2.") and got[3, 1] == ("heading", 3, "2.1 The Second Loaf")
    assert got[6, 0][0] == got[7, 0][0] == got[8, 0][0] == got[9, 0][0] == "paragraph" and len(got) == 11


def test_columns():
    left, right = [(0.0, 140.0)] * 20 + [(0.0, 100.0)] * 4, [(160.0, 300.0)] * 20
    assert layout.gutter_of(left + right + [(0.0, 300.0)], 10) == (140.0, 160.0)
    assert layout.gutter_of(left, 10) is None and layout.gutter_of([(0.0, 20.0), (100.0, 120.0)] * 20, 10) is None  # cells are no running text


def test_hanging_lists():
    entry = [(50.0, 300.0, True, "x"), (62.0, 300.0, False, "x"), (62.0, 180.0, False, ".")]
    assert layout.hanging(entry * 4, 10, 3) == ["start", "indent", "indent"] * 4
    assert layout.hanging([(50.0, 300.0, True, "x")] * 12, 10, 3) is None and layout.hanging(entry, 10, 3) is None
    assert layout.hanging([(x, 300.0, o, e) for x, _, o, e in entry * 4], 10, 3) is None  # no row stops short


def test_regions_and_votes(spark):
    df = spark.createDataFrame([(1, 0, 0, 1, 0.0, 0.0, 100.0, 10.0, 10.0), (1, 0, 1, 1, 0.0, 12.0, 100.0, 22.0, 10.5), (1, 0, 2, 1, 200.0, 0.0, 300.0, 10.0, 10.0), (1, 0, 3, 1, 0.0, 24.0, 100.0, 34.0, 16.0), (1, 0, 4, None, 0.0, 36.0, 100.0, 46.0, 10.0)], "doc_id long, page int, unit int, region int, x0 double, y0 double, x1 double, y1 double, size double")
    assert [(r.unit, r.into) for r in layout.merged_regions(df).orderBy("unit").collect()] == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]
    up = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 10.0), (1, 0, 1, 30.0, 0.0, 40.0), (1, 0, 2, 31.0, 50.0, 39.0)], "doc_id long, page int, unit int, x0 double, y0 double, x1 double")
    assert [r.unit for r in layout.upright_columns(up).orderBy("position").collect()] == [1, 2, 0]


def test_segments(spark):
    chars = [("a", 0, 5), ("b", 5, 10), (" ", 10, 14), ("c", 14, 19), ("d", 40, 45)]
    df = spark.createDataFrame([(1, 0, 0, k, c, float(a), 0.0, float(b), 10.0, 10.0) for k, (c, a, b) in enumerate(chars)] + [(1, 0, 0, 5, "2", 45.0, 0.0, 48.0, 5.0, 5.0)], "doc_id long, page int, line_ix int, char_ix int, c string, x0 double, y0 double, x1 double, y1 double, size double")
    assert [(r.text, r.x0, r.x1) for r in layout.segments(df).orderBy("segment").collect()] == [("ab c", 0.0, 19.0), ("d^2", 40.0, 48.0)]


def test_inline_markdown():
    style = {(False, False, False): "", (True, False, False): "b", (False, True, False): "i", (True, True, False): "bi", (False, False, True): "m"}
    short = lambda t: [(s[0], style[s[1:4]]) for s in markup.inline_spans(t)]
    assert short("a **b *c*** _d_ `e*` \\*f\\* g_h_i 2 * 3") == [("a ", ""), ("b ", "b"), ("c", "bi"), (" ", ""), ("d", "i"), (" ", ""), ("e*", "m"), (" *f* g_h_i 2 * 3", "")]
    assert short("one\ntwo 船\n港") == [("one two 船港", "")] and short("**open") == [("**open", "")] and markup.inline_spans("") == []
    assert [s[0::6] for s in markup.inline_spans("[a](http://b) x")] == [("a", "http://b"), (" x", None)] and markup.inline_spans("H<sub>2</sub>")[1][5]


def test_formulas_and_japanese():
    assert markup.mathml_text(r"x_i^2") == '<math xmlns="http://www.w3.org/1998/Math/MathML"><mrow><msubsup><mi>x</mi><mi>i</mi><mn>2</mn></msubsup></mrow></math>'
    assert markup.mathml_text(r"\oddity x") is None and markup.mathml_text("{a") is None and markup.mathml_text("a}") is None
    assert markup.japanese_counts("ヨッ卜の帆") == (5, 1) and markup.japanese_counts("データ一覧") == (5, 0) and markup.japanese_counts("風ヒ船") == (3, 1) and markup.japanese_counts("風ヒ力") == (3, 2) and markup.japanese_counts("海Il図") == (2, 1)
    assert markup.japanese_counts("港町", frozenset("港")) == (2, 1) and markup.japanese_counts("") == (0, 0)
    assert markup.word_at("rye パン x", 4) == "パン" and markup.word_at("rye", 9) == "rye" and markup.word_at("", 0) == "" and markup.byte_pieces(["Ġrye", "Ãł"]) == " ryeà"


def test_records(spark):
    df = spark.createDataFrame([(1, 30), (2, 4), (3, 1)], "doc_id long, pages int")
    got = {(r.doc_id, r.chunk): (r["first"], r["last"]) for r in records.sample_pages(df).collect()}
    assert got[1, "front"] == (0, 9) and got[1, "body"] == (12, 23) and got[1, "end"] == (24, 29) and got[3, "front"] == (0, 0) and got[2, "end"] == (0, 3)
    pages = spark.createDataFrame([(1, 30, [1, 7, 9], None), (2, 3, None, 2), (3, None, None, None)], "doc_id long, pages int, flagged array<int>, refs int")
    assert {(r.doc_id, r.page) for r in records.review_pages(pages).collect()} == {(1, 1), (1, 7), (1, 15), (1, 30), (2, 1), (2, 2), (3, 1)}
    assert spark.range(1).select(records.symbol_text(F.lit(""))).first()[0] == "α="
    bonus = spark.createDataFrame([("On Rye", "On Rye Bread"), ("On rye", "On Rye Bread")], "a string, b string").select(records.same_capitals(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in bonus] == [0.002, 0.0]


class Reader:
    def __init__(self, most):
        self.most = most

    def read(self, image):
        return image.decode()[: self.most]


def test_models(spark):
    assert models.cascade(b"a long line of text", 4, [Reader(30), Reader(5), Reader(100)]) == "a long line of text" and models.cascade(b"abc", 500, [Reader(5)]) == "abc"
    assert models.greedy(lambda t: len(t), 0, 5) == [1, 2, 3, 4] and len(models.greedy(lambda t: 1, 0, 5, most=7)) == 7
    rows = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 9.0, 9.0, "a"), (1, 0, 1, 60.0, 0.0, 69.0, 9.0, "b")], "doc_id long, page int, box_ix int, x0 double, y0 double, x1 double, y1 double, text string")

    class Local:  # in here, so that it is shipped to the workers by value
        def analyze(self, found):
            return [int(r[1] > 50) for r in found], [(a[0], b[0]) for a, b in zip(found, found[1:], strict=False)]

    assert [(r.box_ix, r["class"]) for r in models.classified(rows, Local()).orderBy("box_ix").collect()] == [(0, 0), (1, 1)]
    assert [(r.a, r.b) for r in models.connected(rows, Local()).collect()] == [(0, 1)]
    one = spark.createDataFrame([("12", "ab-x"), ("soon", "zz")], "h string, k string").select(models.retry_after(F.col("h")).alias("s"), models.key_service(F.col("k"), {"ab": "one", "ab-": "two"}).alias("v")).collect()
    assert [(r.s, r.v) for r in one] == [(12.0, "two"), (None, None)]
    x, y = models.transformed(F.lit(1.0), F.lit(2.0), (2, 0, 0, 3, 10, 20))
    assert tuple(spark.range(1).select(x, y).first()) == (12.0, 26.0)


def test_carried_sections(spark, tmp_path):
    from quire.streaming.state import Progress, carried_sections, run_until

    schema = "doc_id long, page int, line_ix long, line string"
    batches = [[(1, 0, 0, "# One"), (1, 0, 1, "a"), (2, 0, 0, "b")], [(1, 1, 0, "c"), (2, 1, 0, "# Two"), (2, 1, 1, "d")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, told = [], []
    listener = Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = carried_sections(stream, lambda t: t.startswith("# ")).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run_until(query, lambda: False)
    spark.streams.removeListener(listener)
    assert {(r.doc_id, r.line): r.section for r in seen} == {(1, "# One"): "# One", (1, "a"): "# One", (2, "b"): None, (1, "c"): "# One", (2, "# Two"): "# Two", (2, "d"): "# Two"}
    other = spark.readStream.format("rate").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).start()
    assert not run_until(other, lambda: True, 0.1) and not other.isActive


def test_normalized_titles():
    from quire.functions.unicode import norm_text
    from quire.operators.matching import coverage, similarity, title_fit, title_similarity

    assert norm_text("Brot &amp; Öl: &quot;Straße&quot; 2") == "brot ol strasse 2" and norm_text("Ab C", cased=True) == "Ab C"
    assert similarity("abcd", "abcd") == 1 and similarity("", "x") == 0 and similarity("abcd", "wxyz") == 0 and similarity("abcd", "axyz") == 0.125 and similarity("abcd", "abxy") == 0.5
    assert coverage("bread", "ryebreadbun") == 1
    long = "thecompletehistoryofsourdoughinportsandharbours"
    assert title_fit(long, long[:30], cut=True) == 1 and title_fit(long, long[:20], long[-15:]) == 1 and title_fit(long, "x" * 40, "y" * 20) == 0
    assert title_similarity("the complete history of … ports and harbours", "the complete history of sourdough in ports and harbours") == 1 and title_similarity("a18 pdf", "a18pdf") == 1


@pytest.mark.parametrize("name", ["soft_columns", "hanging_lists", "japanese_quality", "selected_words", "inline_markdown"])
def test_queries_find_something(spark, sf, name):
    from quire.plans import catalog

    found = catalog.QUERIES[name](spark, sf)
    assert found.count() > 0
    if name == "japanese_quality":
        assert {r.doc_id: r.poor for r in found.filter("doc_id < 0").collect()} == {-10: False, -11: True, -12: None}


def plain_gaps(rows, share, least):
    points = {(r, x) for r, x0, x1 in rows for x in range(math.floor(x0), max(math.floor(x0), math.ceil(x1) - 1) + 1)}
    n, low, high = len({r for r, *_ in rows}), min(math.floor(r[1]) for r in rows), max(math.ceil(r[2]) for r in rows)
    cover = [sum((r, x) in points for r in {r for r, *_ in rows}) for x in range(low, high)]
    full = [x for x, c in enumerate(cover, low) if c > (max(1, n // share) if n >= 3 else 0)]
    return [(a + b) / 2 for a, b in zip([x + 1 for x in full], full[1:], strict=False) if b - a >= least]


def test_gaps_against_points(spark):
    random.seed(7)
    pages = {p: [(random.randint(0, 6), x, x + random.choice((0, 0.5, 3, 8.25, 30))) for x in (random.choice((0, 0.5, 7, 20.75, 41, 60)) + random.randint(0, 3) for _ in range(random.randint(1, 14)))] for p in range(60)}
    df = spark.createDataFrame([(1, p, r, float(a), float(b)) for p, rows in pages.items() for r, a, b in rows], "doc_id long, page int, row_ix int, x0 double, x1 double")
    got = geometry.coverage_gaps(df, ["doc_id", "page"]).collect()
    want = [(p, c) for p, rows in pages.items() for c in plain_gaps(rows, 5, 3)]
    assert sorted((r.page, r.cut) for r in got) == sorted(want) and want


def test_gaps_of_wide_pages_are_not_exploded(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 9e8), (1, 0, 1, 9.5e8, 2e9)], "doc_id long, page int, row_ix int, x0 double, x1 double")
    assert [r.cut for r in geometry.coverage_gaps(df, ["doc_id", "page"]).collect()] == [9.25e8]


@pytest.mark.parametrize("name", ["scripts", "segments", "ligatures_and_accents", "point_hits"])
def test_characters_are_not_shuffled(spark, sf, name):
    """Above the step that makes characters of a line, the first that needs them together finds them so."""
    from quire.plans import catalog

    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    makers = [k for k, x in enumerate(plan) if re.search(r"Generate posexplode\(split\(text#\d+, , -1\)\)", x)]
    assert makers
    for k in makers:
        at = depth[k]
        for j in range(k - 1, -1, -1):
            if plan[j].strip() and 0 < depth[j] < at and "[" in plan[j]:
                at = depth[j]
                if re.search("Window|Aggregate|Join|Exchange", plan[j].partition("[")[0]):
                    assert "Exchange" not in plan[j].partition("[")[0].partition("(")[0]
                    break
