"""Text classifiers of averaged feature vectors: trained in shards, stored as tables, applied together in one pass.

A text's features are its words and pairs of neighbouring words, hashed to buckets. Each bucket has
a vector, the text's vector is their mean, and a linear layer with softmax gives the label.
Each epoch every shard of the training rows descends from the same model by itself, row by row; then
models are averaged, each bucket over the shards that changed it. Models are bounded: ``buckets * dim``
numbers, on the driver and in each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import one_line, words
from textmill.session import settle

# Buckets, length of vectors, epochs and first rate of the reference's classifier.
BUCKETS, DIM, EPOCHS, RATE = 200_000, 50, 5, 0.1
#: Joins the hashes of two words; words whose hashes are remembered; shards of the training rows.
PAIR, REMEMBERED, SHARDS = 116049371, 1_000_000, 8


@dataclass
class BagModel:
    """Vectors of buckets, ``[buckets, dim]``, and of labels, ``[labels, dim]``."""

    labels: list[str]
    inputs: np.ndarray
    outputs: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        """The probability of each label; without features all labels are alike."""
        x = self.outputs @ self.inputs[features % len(self.inputs)].mean(0) if len(features) else np.zeros(len(self.labels))
        e = np.exp((x - x.max()).astype(np.float64))
        return e / e.sum()

    def predict(self, features: np.ndarray) -> tuple[str, float]:
        p = self.scores(features)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


class Features:
    """Hashes of the words of a text and of its pairs of neighbours; a bucket is the remainder of a hash.

    A word's hash is the first 32 bits of its MD5, a pair's is ``first * PAIR + second``: SQL can say both.
    """

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, tokens: list[str] | None) -> np.ndarray:
        known, out = self.known, []
        for w in tokens or ():
            h = known.get(w)
            if h is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                h = known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
            out.append(h)
        one = np.array(out, np.int64)
        return np.concatenate([one, one[:-1] * PAIR + one[1:]])


def _tokens(text_col: str):
    return words(one_line(F.coalesce(F.col(text_col), F.lit(""))))


def _descend(model: BagModel, rows: list[tuple[np.ndarray, int]], rates: np.ndarray) -> set[int]:
    """One pass of gradient descent over rows of features and label; returns the buckets that changed."""
    changed: set[int] = set()
    for (features, label), rate in zip(rows, rates, strict=True):
        at, count = np.unique(features % len(model.inputs), return_counts=True)
        if not len(at):
            continue
        share = (count / len(features)).astype(np.float32)
        hidden = share @ model.inputs[at]
        x = model.outputs @ hidden
        x = np.exp(x - x.max())
        error = -x / x.sum()
        error[label] += 1
        step = (rate * error).astype(np.float32)
        model.inputs[at] += np.outer(share, step @ model.outputs)
        model.outputs += np.outer(step, hidden)
        changed.update(at.tolist())
    return changed


def train_bag(
    labelled: DataFrame, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, shards: int = SHARDS, passes: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", most_labels: int = 1000
) -> BagModel:
    """A model of ``labelled`` rows with an id, a text and ``label``; rows with a null label are left out.

    Rows are dealt to shards by a hash of id and text and worked on in its order, ``passes`` times an epoch, so the model
    is the same each time. The rate falls linearly to zero over all epochs. Without rows the model has one label, "".
    """
    spark = labelled.sparkSession
    key = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text_col)
    rows = labelled.where("label is not null").select(F.col("label").cast("string").alias("label"), _tokens(text_col).alias("tokens"), key.alias("key"))
    labels = [r[0] for r in rows.select("label").distinct().orderBy("label").limit(most_labels + 1).collect()]
    if len(labels) > most_labels:
        raise ValueError(f"more than {most_labels} labels")
    rng = np.random.default_rng(seed)
    model = BagModel(labels or [""], rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32), np.zeros((max(1, len(labels)), dim), np.float32))
    if not labels:
        return model

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, place = Features(), {x: i for i, x in enumerate(labels)}
        for batch in batches:
            found = pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([place[x] for x in batch.column(0).to_pylist()], pa.int32()), found, batch.column(2)], names=["label", "features", "key"])

    dealt = settle(rows.mapInArrow(hashed, "label int, features array<long>, key long").repartitionById(shards, F.pmod("key", F.lit(shards)).cast("int")).sortWithinPartitions("key", "features", "label"))
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast(model)

        def descend(batches: Iterator[pa.RecordBatch], epoch: int = epoch, sent=sent) -> Iterator[pa.RecordBatch]:
            rows = [(np.array(f, np.int64), x) for b in batches for x, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            if not rows:
                return
            own = BagModel(sent.value.labels, sent.value.inputs.copy(), sent.value.outputs.copy())
            rows = rows * passes
            part = (epoch + np.arange(len(rows)) / len(rows)) / epochs
            changed = np.array(sorted(_descend(own, rows, rate * (1 - part))), np.int64)
            for at, values in ((changed, own.inputs[changed]), (-1 - np.arange(len(own.outputs)), own.outputs)):
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), vectors], names=["at", "vector"])

        told = dealt.mapInArrow(descend, "at long, vector array<float>").withColumn("shard", F.spark_partition_id())
        every = F.transform(F.array_sort(F.collect_list(F.struct("shard", "vector"))), lambda x: x["vector"])  # a vector for each shard, at most
        zero = F.array_repeat(F.lit(0.0), dim)
        mean = F.aggregate(every, zero, lambda a, x: F.zip_with(a, x, lambda p, q: p + q), lambda a: F.transform(a, lambda p: (p / F.count("*")).cast("float")))
        got = told.groupBy("at").agg(mean.alias("vector")).toArrow()  # the model
        at = got.column(0).to_numpy()
        values = got.column(1).combine_chunks().flatten().to_numpy().reshape(-1, dim)
        model = BagModel(model.labels, model.inputs.copy(), model.outputs.copy())
        model.inputs[at[at >= 0]] = values[at >= 0]
        model.outputs[-1 - at[at < 0]] = values[at < 0]
        sent.unpersist()
    return model


def score_all(docs: DataFrame, models: dict[str, BagModel], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and for each model ``NAME_label, NAME_score``: the likeliest label and its probability, in one pass over the texts.

    Words are found once for all models, which are broadcast. A null or empty text has the first label with the
    probability of chance; ids may be null and repeat; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(models)
    names = sorted(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, held = Features(), sent.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [features(t) for t in part.column(1).to_pylist()]
                told = [list(zip(*(held[n].predict(f) for f in found), strict=True)) for n in names]
                columns = [pa.array(c, kind) for pair in told for c, kind in zip(pair, (pa.string(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *(f"{n}_{c}" for n in names for c in ("label", "score"))])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{n}_label string, {n}_score double" for n in names)])
    return docs.select(F.col(id_col).alias("doc_id"), _tokens(text_col).alias("tokens")).mapInArrow(run, schema)


def save_model(spark: SparkSession, model: BagModel, path: str) -> None:
    """A model as Parquet: ``labels`` (``place, label, vector``) and ``inputs`` (``bucket, vector``)."""
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(model.inputs) + 1, dtype=np.int32) * model.inputs.shape[1]), pa.array(model.inputs.ravel()))
    spark.createDataFrame(pa.table({"bucket": pa.array(np.arange(len(model.inputs)), pa.int32()), "vector": vectors})).coalesce(1).write.mode("overwrite").parquet(f"{path}/inputs")
    rows = [(i, x, v.tolist()) for i, (x, v) in enumerate(zip(model.labels, model.outputs, strict=True))]
    spark.createDataFrame(rows, "place int, label string, vector array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/labels")


def load_model(spark: SparkSession, path: str) -> BagModel:
    """A model that ``save_model`` wrote; an error if buckets are missing."""
    inputs = spark.read.parquet(f"{path}/inputs").orderBy("bucket").toArrow()
    labels = spark.read.parquet(f"{path}/labels").orderBy("place").collect()
    n = inputs.num_rows
    if not n or inputs.column(0).to_numpy().tolist() != list(range(n)):
        raise ValueError(f"{path} does not hold all buckets")
    values = inputs.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    return BagModel([r["label"] for r in labels], values.astype(np.float32), np.array([r["vector"] for r in labels], np.float32))
