"""Classifiers that share their passes over the texts, and heuristics without arrays of words."""

import random

import pytest
from pyspark.sql import functions as F

from textmill.functions import text as T
from textmill.operators import classify
from textmill.operators.word_bayes import word_bayes


@pytest.mark.parametrize("held, owners", [(1_600_000, 2_000_000), (40, 0)])
def test_models_together_say_what_each_says_alone(spark, held, owners):
    rng = random.Random(4)
    words = ["aa", "AAb", "aab", "bcde", "bcdf", "ÜBER", "überall", "x", "é e", "q.", "　"]
    rows = [(i, None if i == 7 else " ".join(rng.choices(words, k=rng.randrange(9))) + f" once{i}" * (i % 3), "xyz"[i % 3] if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    first = spark.createDataFrame([(i, "01"[i % 4 == 0]) for i in range(0, 70, 2)] + [(2, "1"), (4, None)], "doc_id long, label string")
    second = spark.createDataFrame([(i, i % 3) for i in range(0, 60, 3)], "doc_id long, label int")
    got = word_bayes(df, {"lang": ("lang", 3), "one": (first, None), "two": (second, None), "none": (first.where("false"), None)}, most_held=held, most_owners=owners).collect()
    assert sorted(r.doc_id for r in got) == list(range(60))
    for name, labels, features in (("lang", "lang", classify.word_starts), ("one", first.join(df, "doc_id", "left_semi"), classify.whole_words), ("two", second, classify.whole_words)):
        alone = {r.doc_id: (r.label, pytest.approx(r.score)) for r in classify.naive_bayes(labels, df, features).collect()}
        if name != "one":
            assert {r.doc_id: (r[f"{name}_label"], r[f"{name}_score"]) for r in got} == alone
        else:  # its labels of absent documents count in the prior
            assert {r.doc_id for r in got if r.one_label is not None} == set(alone)
    assert {(r.none_label, r.none_score) for r in got} == {(None, None)}


def test_curation_reads_each_text_three_times(spark, sf, monkeypatch):
    """Once for the heuristics, once to count and once to score, not for each model anew."""
    from textmill.plans import corpus, text

    seen, plain = spark.sparkContext.accumulator(0), corpus.table

    def told(x):
        seen.add(1)
        return x

    tell = F.udf(told, "string").asNondeterministic()

    def table(spark, sf_dir, name):
        df = plain(spark, sf_dir, name)
        return df.withColumn("text", tell("text")) if name == "documents" else df

    monkeypatch.setattr(corpus, "table", table)
    monkeypatch.setattr(text, "table", table)
    n = corpus.curation_funnel(spark, sf).where("source is null").first().total_records
    assert n and seen.value <= 3 * n


def test_heuristics_over_all_white_space(spark):
    white = [chr(c) for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]
    rng = random.Random(5)
    alphabet = [*white, "\r\n", "\n", " ", "...", "....", ".", "a", "é", "1", "$1", "\\", "中", "𐍈", "Ⅷ", "​", "℀"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randrange(12)))) for i in range(4000)] + [(-1, None), (-2, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    w, li = T.words(F.coalesce("text", F.lit(""))), T.lines(F.coalesce("text", F.lit("")))
    plain = {
        "n_words": F.size(w), "n_chars_in_words": F.length(F.array_join(w, "")), "n_lines": F.size(li),
        "n_ellipsis": F.size(F.filter(li, lambda x: T.strip(x).endswith("..."))), "n_alpha": F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))),
    }
    told = T.heuristics(F.col("text"))
    both = df.select("id", F.struct(*[told[k].alias(k) for k in plain]).alias("a"), F.struct(*[x.cast("long").alias(k) for k, x in plain.items()]).alias("b"))
    assert both.where("not a <=> b").take(3) == []
