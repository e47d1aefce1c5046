"""Classifiers of averaged vectors: held-out quality, storage, scores against SQL over the stored weights."""

import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from textmill.operators import classify, models


def auc(rows):
    """The chance that a row of label 1 is above one of label 0, by ranks."""
    order = sorted(rows)
    ranks = {}
    for k, (s, _) in enumerate(order):
        ranks.setdefault(s, []).append(k + 1)
    mean = {s: sum(r) / len(r) for s, r in ranks.items()}
    pos = [mean[s] for s, y in rows if y]
    n, m = len(pos), len(rows) - len(pos)
    return (sum(pos) - n * (n + 1) / 2) / (n * m)


def corpus(n, seed):
    """Texts of two kinds that differ in a few words and in the order of two others."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = i % 2
        words = [f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randint(20, 60))]
        for _ in range(rng.randint(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice([["good", "fine", "clear"], ["bad", "poor", "noisy"]][y]) if rng.random() < 0.6 else ["left right", "right left"][y])
        rows.append((i, " ".join(words), str(y)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    df = spark.createDataFrame(corpus(1200, 1), "doc_id long, text string, label string")
    return models.train_bag(df, buckets=5000, dim=10, epochs=15, shards=2)


def score_of_one(spark, model, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = {r.doc_id: r.m_score if r.m_label == "1" else 1 - r.m_score for r in models.score_all(df, {"m": model}).collect()}
    return [(got[i], int(y)) for i, _, y in rows]


def test_held_out(spark, trained):
    """On other texts it ranks as well as logistic regression over the same features does, nearly."""
    test = corpus(400, 2)
    mine = auc(score_of_one(spark, trained, test))
    # A session in which something was observed still sends the other model to its tasks.
    spark.range(1).observe(Observation(), F.count("*").alias("n")).collect()
    train = spark.createDataFrame([(i, t, float(y)) for i, t, y in corpus(1200, 1)], "doc_id long, text string, label double")
    scored = classify.scores_of(classify.logistic_regression(train, buckets=5000), spark.createDataFrame(test, "doc_id long, text string, label string")).collect()
    other = {r.doc_id: r.score if r.label == "1" else 1 - r.score for r in scored}
    assert mine > 0.95 and mine > auc([(other[i], int(y)) for i, _, y in test]) - 0.02


def test_training_repeats(spark):
    df = spark.createDataFrame(corpus(80, 3), "doc_id long, text string, label string")
    a, b = (models.train_bag(d, buckets=300, dim=4, epochs=2, shards=3) for d in (df, df.repartition(5)))
    assert (a.inputs == b.inputs).all() and (a.outputs == b.outputs).all()
    assert models.train_bag(df.where("false"), buckets=8, dim=2).predict(np.array([1, 2])) == ("", 1.0)


def test_descent_is_the_gradient():
    """One row, one step: the change of the loss is that of numerical differentiation."""
    rng = np.random.default_rng(0)
    model = models.BagModel(["a", "b", "c"], rng.normal(size=(20, 4)).astype(np.float32), rng.normal(size=(3, 4)).astype(np.float32))
    row, before = np.array([1, 21, 5, 7, 7]), models.BagModel(model.labels, model.inputs.copy(), model.outputs.copy())
    assert models._descend(model, [(row, 2)], np.array([0.01])) == {1, 5, 7}
    for name in ("inputs", "outputs"):
        moved = (getattr(model, name) - getattr(before, name)) / 0.01
        for i, j in ((1, 0), (7 % len(moved), 3), (2, 1)):
            ends = []
            for d in (1e-3, -1e-3):
                m = models.BagModel(model.labels, before.inputs.astype(float), before.outputs.astype(float))
                getattr(m, name)[i, j] += d
                ends.append(np.log(m.scores(row)[2]))
            assert moved[i, j] == pytest.approx((ends[0] - ends[1]) / 2e-3, abs=2e-2)


SQL = """
WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(translate(coalesce(text, ''), chr(10) || chr(13), '  '), '\\s+'), lambda x: x <> ''), lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM d),
f AS (SELECT doc_id, unnest(list_concat(h, list_transform(range(1, len(h)), lambda i: h[i] * 116049371 + h[i + 1]))) % (SELECT count(*) FROM inputs) AS bucket FROM w),
m AS (SELECT doc_id, i, avg(x::DOUBLE) AS x FROM (SELECT doc_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM f JOIN inputs USING (bucket)) GROUP BY doc_id, i),
o AS (SELECT place, label, unnest(vector)::DOUBLE AS y, generate_subscripts(vector, 1) AS i FROM labels),
s AS (SELECT d.doc_id, l.place, l.label, exp(coalesce(z, 0)) AS e FROM d CROSS JOIN labels l LEFT JOIN (SELECT doc_id, place, sum(x * y) AS z FROM m JOIN o USING (i) GROUP BY doc_id, place) q ON q.doc_id = d.doc_id AND q.place = l.place)
SELECT doc_id, arg_max(label, (e, -place)) AS label, max(e) / sum(e) AS score FROM s GROUP BY doc_id
"""


def test_scores_by_sql(spark, trained, tmp_path):
    """DuckDB reads the stored weights and gives the same verdicts; a loaded model is the stored one."""
    models.save_model(spark, trained, str(tmp_path / "m"))
    again = models.load_model(spark, str(tmp_path / "m"))
    assert again.labels == trained.labels and (again.inputs == trained.inputs).all() and (again.outputs == trained.outputs).all()
    rows = [(i, t) for i, t, _ in corpus(60, 5)] + [(100, None), (101, ""), (102, "one"), (103, " good\nfine\r bad  ")]
    con = duckdb.connect()
    con.execute("CREATE TABLE d (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO d VALUES (?, ?)", rows)
    for name in ("inputs", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{next(Path(tmp_path / 'm' / name).glob('*.parquet'))}')")
    want = {i: (x, s) for i, x, s in con.execute(SQL).fetchall()}
    got = {r.doc_id: (r.m_label, r.m_score) for r in models.score_all(spark.createDataFrame(rows, "doc_id long, text string"), {"m": again, "n": trained}).collect()}
    assert set(got) == set(want)
    for i in got:
        assert got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1], abs=1e-5)
    one = models.score_all(spark.createDataFrame(rows, "doc_id long, text string").where(F.col("doc_id") > 99), {"m": again, "n": trained}).orderBy("doc_id").collect()
    assert [r.m_label for r in one] == [r.n_label for r in one] and one[0].m_score == 0.5
