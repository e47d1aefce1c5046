"""Classifiers: closed-form naive Bayes by joins, hashed logistic regression, and training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.text import one_line, strip, words
from textmill.session import settle


def word_starts(text: Column, n: int = 3) -> Column:
    """The first n characters of each word, in lower case: short character grams that tell languages apart."""
    return F.transform(words(F.lower(text)), lambda w: F.substring(w, 1, n))


def whole_words(text: Column) -> Column:
    return words(F.lower(text))


def counted(items: Column) -> Column:
    """``array<struct(f, k)>``: the distinct members of an array and how often each is in it."""

    def tell(w: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: (i > 0) & ((i == F.size(w)) | (F.get(w, i) != F.get(w, i - 1))))
        return F.transform(
            F.array(ends), lambda e: F.transform(e, lambda i, j: F.struct(F.get(w, i - 1).alias("f"), (i - F.when(j == 0, 0).otherwise(F.get(e, j - 1))).cast("long").alias("k")))
        )[0]

    return F.transform(F.array(F.sort_array(items)), tell)[0]


def naive_bayes(labelled: DataFrame | str, docs: DataFrame, features=word_starts, text_col: str = "text", most_labels: int = 1000, most_held: int = 400_000) -> DataFrame:
    """``doc_id, label, score``: the likeliest label of each document and its posterior.

    ``labelled`` has ``doc_id, label``, or is the name of the column of ``docs`` that holds
    the labels; of several labels of a document the least counts.
    Multinomial with add-one smoothing; features that no labelled document has are
    ignored. A labelled document is scored without itself: its own words and its place
    in the prior are taken out of the counts of its label, so no document is judged by
    what it taught. A document without known features gets the commonest label. Ties go to
    the lesser. Without any label the label is null.

    Features are counted within their row, and what a document gains is summed before a
    shuffle: the commonest features, ``most_held`` counts of them at most, are broadcast, and
    only occurrences of rarer ones travel to where their counts are. Rows that share an id are
    one document; only then all occurrences travel. To the driver come the labels and their totals,
    at most ``most_labels``, and what is broadcast.
    """

    def told(rows: DataFrame, id_col: str) -> DataFrame:
        return rows.select(id_col, F.explode(counted(features(F.col(text_col)))).alias("x")).select(id_col, "x.f", "x.k")

    once = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    within = isinstance(labelled, str)
    labels_of = docs.select("doc_id", F.col(labelled).alias("label")) if within else labelled
    owners = labels_of.where("label is not null").groupBy("doc_id").agg(F.min(F.col("label").cast("string")).alias("own"))
    if within and once:
        taught = docs.select(F.col(labelled).cast("string").alias("own"), text_col).where("own is not null")
    else:
        taught = docs.select("doc_id", text_col).join(owners, "doc_id")
    by_label = told(taught, "own").groupBy("own", "f").agg(F.sum("k").alias("n"))
    # A feature's row holds its counts; what it adds to a label over an unseen feature is told for each document.
    held = settle(by_label.groupBy("f").agg(F.collect_list(F.struct(F.col("own").alias("label"), "n")).alias("held"), F.sum("n").alias("all")))
    vocabulary = held.count()
    sums = held.select(F.explode("held").alias("x")).groupBy("x.label").agg(F.sum("x.n").alias("total"))
    totals = sums.join(owners.groupBy(F.col("own").alias("label")).agg(F.count("*").alias("docs")), "label").limit(most_labels + 1).collect()
    if len(totals) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    every = sum(r["docs"] for r in totals)
    if not totals:
        return docs.select("doc_id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"))
    counts = told(docs, "doc_id")
    if not once:
        counts = counts.groupBy("doc_id", "f").agg(F.sum("k").alias("k"))
    most = max(1, most_held // len(totals))
    if vocabulary <= most:
        hit = counts.join(F.broadcast(held.select("f", "held")), "f")
    else:
        common = settle(held.orderBy(F.desc("all"), "f").limit(most).select("f", "held"))
        rare = held.select("f", "held").join(F.broadcast(common.select("f")), "f", "left_anti")
        far = counts.join(F.broadcast(common.select("f")), "f", "left_anti").join(rare, "f")
        hit = counts.join(F.broadcast(common), "f").unionByName(far)
    seen = hit.select("doc_id", "k", F.posexplode("held").alias("at", "x"))
    gained = seen.groupBy("doc_id", F.col("x.label").alias("label")).agg(
        F.sum(F.col("k") * F.ln(F.col("x.n") + 1)).alias("all"),
        F.sum(F.col("k") * F.ln(F.greatest(F.col("x.n") - F.col("k"), F.lit(0)) + 1)).alias("others"),
        F.sum(F.when(F.col("at") == 0, F.col("k")).otherwise(0)).alias("known"),
    )
    gained = gained.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("all", "others")))).alias("gained"), F.sum("known").alias("known"))
    labels = F.array(*[F.struct(F.lit(r["label"]).alias("label"), F.lit(r["docs"]).alias("docs"), F.lit(r["total"]).alias("total")) for r in totals])
    rows = docs.select("doc_id").join(gained, "doc_id", "left").join(owners, "doc_id", "left").withColumn("known", F.coalesce("known", F.lit(0)))

    def score(m: Column) -> Column:
        mine = F.coalesce(F.col("own") == m["label"], F.lit(False))
        prior = F.ln(F.greatest(m["docs"] - mine.cast("int"), F.lit(0.5)) / F.greatest(F.lit(every) - F.col("own").isNotNull().cast("int"), F.lit(1)))
        none = -F.ln(m["total"] - F.when(mine, F.col("known")).otherwise(0) + vocabulary)
        got = F.col("gained")[m["label"]]
        gain = F.coalesce(F.when(mine, got["others"]).otherwise(got["all"]), F.lit(0.0))
        return F.struct((-(prior + F.col("known") * none + gain)).alias("s"), m["label"].alias("label"))

    best = rows.select("doc_id", F.transform(labels, score).alias("r"))
    if not once:
        best = best.groupBy("doc_id").agg(F.flatten(F.collect_list("r")).alias("r"))
    best = best.select("doc_id", F.array_sort("r").alias("r"))
    top = F.col("r")[0]
    spread = F.aggregate("r", F.lit(0.0), lambda a, x: a + F.exp(top["s"] - x["s"]))
    return best.select("doc_id", top["label"].alias("label"), (1 / spread).alias("score"))


def passes(scored: DataFrame, label: str, over: float) -> DataFrame:
    """``doc_id`` of what a classifier does not reject: rows that do not bear ``label`` with a score over ``over``.

    ``scored`` has ``doc_id, label, score`` from any model: a table of scores, ``naive_bayes``
    or ``scores_of`` a fitted pipeline. A null label or score rejects nothing.
    """
    return scored.where(~F.coalesce((F.col("label") == label) & (F.col("score") > over), F.lit(False))).select("doc_id")


def scores_of(model, docs: DataFrame) -> DataFrame:
    """``doc_id, label, score``: the prediction of a fitted pipeline and its probability."""
    from pyspark.ml.functions import vector_to_array

    rows = model.transform(docs)
    return rows.select("doc_id", F.col("prediction").cast("int").cast("string").alias("label"), F.array_max(vector_to_array("probability")).alias("score"))


def logistic_regression(labelled: DataFrame, text_col: str = "text", buckets: int = 200_000, iterations: int = 20):
    """Pipeline of hashed words and word pairs with logistic regression; ``labelled`` has the text and ``label`` (0 or 1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler

    stages = [
        RegexTokenizer(inputCol=text_col, outputCol="_words", pattern="\\s+"),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        HashingTF(numFeatures=buckets, inputCol="_words", outputCol="_one"),
        HashingTF(numFeatures=buckets, inputCol="_pairs", outputCol="_two"),
        VectorAssembler(inputCols=["_one", "_two"], outputCol="features"),
        LogisticRegression(maxIter=iterations, regParam=0.01, featuresCol="features", labelCol="label"),
    ]
    model = Pipeline(stages=stages).fit(labelled)
    # The summary of the training holds the session, which can't be sent to tasks once anything in it was observed.
    model.stages[-1]._java_obj.setSummary(labelled.sparkSession._jvm.scala.Option.empty())
    return model


def trainset(positive: DataFrame, negative: DataFrame, most: int = 5000, seed: int = 0) -> DataFrame:
    """``label, doc_id, text``: the first rows of each class by id, cleaned, in a repeatable shuffle.

    Both inputs have ``doc_id, text`` and are filtered already. The limit of each
    class is a top-k of its own, so no task sees a whole class.
    """

    def first(rows: DataFrame, label: str) -> DataFrame:
        clean = rows.select("doc_id", strip(one_line(F.col("text"))).alias("text")).where("text <> ''")
        return clean.orderBy("doc_id").limit(most).select(F.lit(label).alias("label"), "doc_id", "text")

    both = first(positive, "high").unionByName(first(negative, "low"))
    return both.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string"))))
