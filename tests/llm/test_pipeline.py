"""Each stage of the pipeline against plain Python, and on nulls, repeated ids, empty and long texts, ties, an empty table and clashing columns."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import LOW, made_texts, near_rows, plain_join, plain_repeats

pipeline = pytest.importorskip("corpus_pipeline")


def frame(spark, rows):
    """doc_id, text and columns whose names the stages might use themselves."""
    df = spark.createDataFrame([(i, t, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    clash = {c: F.lit(k) for k, c in enumerate("gone of _ rest kept bucket row key hot digest source component_id".split())}
    return df.withColumns(clash).withColumn("mark", F.monotonically_increasing_id()).repartition(3)


def texts(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def exact(rows):
    """The rows that stay, one a text: the one with the largest id."""
    stay = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        stay[(t or "").translate(LOW)] = (i, t)
    return sorted((str(i), t or "") for i, t in stay.values())


COPIES = [(1, "One text"), (2, "ONE text"), (2, "another text"), (None, "one TEXT"), (None, "no id"), (None, "no id"), (3, "same"), (3, "same"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "long " * 60_000), (9, "LONG " * 60_000)]


def test_exact_copies(spark):
    docs = frame(spark, COPIES)
    got = pipeline.exact_copies(spark, docs, None)
    assert got.columns == docs.columns and texts(got) == exact(COPIES)
    assert len({r.mark for r in got.collect()}) == got.count()
    unique = [(i, t) for i, t in dict((i, t) for i, t in COPIES if i is not None).items()]
    assert texts(pipeline.exact_copies(spark, frame(spark, unique), None)) == exact(unique)


def test_near_copies(spark):
    rows = [(i, t) for i, t in near_rows() if i % 2]
    want = plain_join(rows, 5, 80)
    docs = frame(spark, rows)
    got = pipeline.near_copies(spark, docs, None)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_copies_lose_no_other_text(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base), (2, base + " more"), (2, "quite another text that nobody else has"), (None, base + " and more"), (None, "a text without an id"), (3, ""), (3, None), (4, "x " * 100_000)]
    got = texts(pipeline.near_copies(spark, frame(spark, rows), None))
    assert sum(t.startswith("w0") for _, t in got) == 1
    assert [r for r in got if not r[1].startswith("w0")] == sorted((str(i), t or "") for i, t in rows if not (t or "").startswith("w0"))


def test_repeated_passages(spark):
    rows = [r for r in made_texts() if r[0] < 600]
    want = plain_repeats(rows)
    docs = frame(spark, rows)
    got = pipeline.repeated_passages(spark, docs, None)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    for r in got.collect():
        n, removed, spans, _ = want[r.doc_id]
        lost = n - len(r.text.encode())
        assert removed - 6 * spans <= lost <= removed and r.n_chars == len(r.text) and r.gone == 0 and r.source == 10  # parts of characters at the edges stay
    assert sorted(r.mark for r in got.collect()) == sorted(r.mark for r in docs.collect())


def test_repeated_passages_of_rows_alike(spark):
    text = " ".join(f"t{k}" for k in range(60))
    got = texts(pipeline.repeated_passages(spark, frame(spark, [(1, text), (1, text), (None, text), (None, None), (2, "short")]), None))
    assert [i for i, _ in got] == ["1", "1", "2", "None", "None"] and [t for _, t in got].count(text) == 1


@pytest.fixture(scope="module")
def labelled_dir(spark, tmp_path_factory):
    random.seed(31)
    plain = [f"wort{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = [random.choice(plain) for _ in range(random.randint(20, 60))]
        if i % 5 == 0:
            words[5:5] = random.choices(["schuft", "lump", "schurke"], k=4)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    # copies, near copies, a shared passage, empty texts
    rows += [(1000, rows[1][1].upper()), (1001, rows[2][1] + " end"), (1002, None), (1003, "")]
    passage = " ".join(f"shared{k}" for k in range(60))
    rows += [(1004, "left one " + passage), (1005, passage + " right two three four five six seven " + " ".join(f"more{k}" for k in range(60)))]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, labels


def test_toxic_texts_go(spark, labelled_dir):
    folder, rows, labels = labelled_dir
    docs = frame(spark, rows)
    got = pipeline.toxicity(spark, docs, folder)
    bad = {i for i, y in labels if y}
    assert got.columns == docs.columns
    assert len({i for i, _ in rows} - bad - {r.doc_id for r in got.collect()}) <= 4 and len({r.doc_id for r in got.collect()} & bad) <= 4


def test_packing(spark):
    pytest.importorskip("public_tokenizers")
    from quire.llm.packing import word_bpe
    from quire.llm.queries import WORD_BPE, tokenizer_path

    rows = [(1, "one two"), (1, "three"), (None, None), (2, ""), (3, "word " * 9000)]
    got = pipeline.packing(spark, frame(spark, rows), None).collect()
    want = []
    for i, t in rows:
        ids = np.r_[np.frombuffer(word_bpe(tokenizer_path(WORD_BPE)).encode(t or ""), "<u4"), 1]
        want += [(str(i), at // 4096, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].astype("<u4").tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted((str(r.doc_id), r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES if n != "toxicity"])
def test_empty_table(spark, name):
    docs = frame(spark, [(1, "x")]).filter("false")
    out = dict(pipeline.STAGES)[name](spark, docs, None)
    assert out.count() == 0 and (name == "best_fit_packing" or out.columns == docs.columns)


def test_whole_pipeline(spark, labelled_dir):
    """The stages one after the other, each brute force but for the classifier, give the pieces that the pipeline gives."""
    pytest.importorskip("public_tokenizers")
    from quire.llm.packing import word_bpe
    from quire.llm.queries import WORD_BPE, tokenizer_path

    folder, _, _ = labelled_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in pipeline.toxicity(spark, docs, folder).collect()]
    rows = [(int(i), t) for i, t in exact(rows)]
    near = plain_join(rows, 5, 80)
    rows = [(i, t) for i, t in rows if near[i][1] == i]
    encode, want, seen = word_bpe(tokenizer_path(WORD_BPE)).encode, {}, set()
    for i, t in sorted(rows):
        b, gone = t.encode(), set()
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone |= set(range(p, p + 100))
            seen.add(b[p : p + 100])
        text = bytes(x for p, x in enumerate(b) if p not in gone).decode()
        ids = np.r_[np.frombuffer(encode(text), "<u4"), 1].astype("<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pipeline.run(spark, folder).collect()}
    assert got == want and any(re.search("shared", t) for _, t in rows)
