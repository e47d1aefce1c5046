"""The pipeline's stages against brute force, and odd rows through all of them."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm_queries import ODD, base_measures, base_personal, brute_components, edit, shingles

import corpus_pipeline
from textmill.llm.decontamination import normal_words
from textmill.llm.queries import SQL

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with junk, near copies, benchmark passages and personal data; labels; a benchmark."""
    rng = random.Random(11)
    words = [f"w{i}x" for i in range(500)]
    items = [(k, " ".join(rng.choice(words) for _ in range(20))) for k in range(5)]
    rows = []
    for i in range(150):
        w = [rng.choice(words) for _ in range(rng.randint(55, 90))]
        if i % 10 == 3:
            w = rows[-1][1].split()
            w[5] = "changed"
        elif i % 10 == 5:
            w += items[i % 5][1].split()
        elif i % 10 == 7:
            w[10:10] = [f"me{i}@mail.example.org", "192.168.0.1"]
        elif i % 10 == 9:
            w = w[:30] if i % 20 == 9 else w[:3] * 30
        rows.append((i, " ".join(w), "en", f"s{i % 3}"))
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    docs.select(COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict((r[0], r[1]) for r in rows), items


def redacted(text):
    out, at = "", 0
    for s, _, e, kind in base_personal(text):
        if s >= at:
            out += text[at:s] + f"[{kind.upper()}]"
            at = e
    return out + text[at:]


def test_stages(spark, folder, tmp_path):
    path, want, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = {r.doc_id: r for r in docs.collect()}
        assert len(got) == docs.count()
        if name == "quality rules":
            # Too few labels for a cutoff: the base rules alone decide.
            measured = {i: base_measures(t) for i, t in want.items()}
            want = {i: t for i, t in want.items() if measured[i][0] >= 50 and 100 * measured[i][4] <= 50 * measured[i][0]}
        elif name == "near duplicates":
            label = brute_components({i: shingles(t) for i, t in want.items()})
            want = {i: t for i, t in want.items() if label[i] == i}
        elif name == "decontamination":
            want = {i: t for i, t in want.items() if all(edit(p := normal_words(x), normal_words(t)) > 0.2 * len(p) for _, x in items)}
        elif name == "personal data":
            want = {i: redacted(t) for i, t in want.items()}
            assert all(r.n_chars == len(r.text) for r in got.values())
        if name == "mixing":
            assert docs.columns == [*COLUMNS, "copies"]
            assert set(got) <= set(want) and all(r.copies >= 1 and r.text == want[i] for i, r in got.items())
            # The copies are those that SQL tells of what the stage before kept.
            con = duckdb.connect()
            con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{k - 1}/*.parquet')")
            told = {i: n for i, n in con.execute(f"SELECT doc_id, copies FROM ({SQL['op7_mixing']})").fetchall() if n}
            assert {i: r.copies for i, r in got.items()} == told
            total = sum(len(t.split()) for t in want.values())
            assert abs(sum(r.copies * len(r.text.split()) for r in got.values()) - total) <= 3 * 90
        else:
            assert docs.columns == COLUMNS
            assert {i: r.text for i, r in got.items()} == want
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, path).collect()) == sorted(got)


def test_near_duplicates_without_ids(spark, folder):
    """Rows with a null or repeated id are judged as all others: of a group one row stays, the one with the least id."""
    t, u, v, w = (" ".join(f"{x}{i}" for i in range(60)) for x in "tuvw")
    rows = [(1, t), (1, t), (None, t), (None, t), (2, t), (None, u), (None, u + " end"), (3, v), (3, w), (4, v), (None, None), (None, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, folder[0])
    assert kept.columns == COLUMNS
    got = sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text)
    assert [x for x in got if not x[1].startswith("u")] == [("1", t), ("3", v), ("3", w)]
    assert len([x for x in got if x[1].startswith("u")]) == 1
    assert sum(not r.text for r in kept.collect()) == 4


def test_rows_of_one_hash(spark, folder, monkeypatch):
    """Different rows that share a 64-bit hash all stay; rows that are alike are still one."""
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abcd"]
    rows = [(1, texts[0]), (2, texts[0]), (3, texts[1]), (4, texts[2]), (4, texts[2]), (5, texts[3]), (6, texts[3] + " end")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    # The rows 2 and 3 share a hash: one is a copy of row 1, the other is not.
    monkeypatch.setattr(corpus_pipeline, "_number", lambda: F.when(F.col("doc_id").isin(2, 3), F.lit(77)).otherwise(F.col("doc_id") * 1000))
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, folder[0]).collect())
    assert (3, texts[1]) in got and {(4, texts[2]), (5, texts[3])} <= set(got)
    assert len(got) == len(set(got)) and (6, texts[3] + " end") not in got


def test_decontamination_without_ids(spark, folder):
    path, _, items = folder
    rows = [(None, "x " + items[0][1]), (1, items[1][1] + " y"), (1, "clean text of its own"), (None, "clean too"), (2, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.text) for r in corpus_pipeline.decontamination_stage(spark, docs, path).collect()) == ["None", "clean text of its own", "clean too"]


def test_quality_stage_with_cutoffs(spark, tmp_path):
    """Enough labels for cutoffs: documents with many symbols go although the base rules keep them, and clean ones stay."""
    rng = random.Random(3)
    clean = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(60))
    junk = lambda: " ".join(f"w{rng.randrange(4000)}#*" for _ in range(60))
    rows = [(i, junk() if i % 10 == 0 else clean(), "en" if i % 2 else None, "s", 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in range(4000) if i % 10}


def test_odd_rows(spark, folder):
    path, _, _ = folder
    filler = " ".join(f"f{i}" for i in range(60))
    rows = [(*r, 0) for r in ODD] + [(50, filler, "en", None, 1), (None, filler + " me@x.org", None, "s", 1), (None, filler + " 1.2.3.4", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("copies", F.lit("x")).withColumn("component_id", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), path).count() == 0
        out = stage(spark, docs, path)
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = sorted((r.doc_id is None, r.text.split()[-1]) for r in docs.collect())
    assert set(kept) <= {(False, "f59"), (True, "[EMAIL]"), (True, "[IP]")}
