"""Several naive Bayes classifiers over the words of the same texts, in two passes over them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.session import settle

#: Distinct features that a task counts before it hands them on.
COUNTED = 300_000
#: Features of documents that are scored at a time.
SCORED = 200_000
#: Buckets of frequencies that twice the frequency spans.
STEPS = 8


def word_bayes(docs: DataFrame, models: dict, text_col: str = "text", most_labels: int = 1000, most_held: int = 1_600_000, most_owners: int = 2_000_000) -> DataFrame:
    """``doc_id, <model>_label, <model>_score``: what ``naive_bayes`` says for each of some models; no two rows may share an id.

    ``models`` has for each name the labels, as ``naive_bayes`` takes them, and how many
    characters of each lower-case word are its feature, None for all. Texts are read once to count and
    once to score, whatever the number of models; Python cuts them into words in Arrow batches, since
    ``str.split`` knows the same white space, and a task adds up what it counts. Models with the
    same features share their table: of it the commonest features, ``most_held`` counts at most,
    go to all workers, and only occurrences of rarer ones travel to theirs and back. Labels
    of up to ``most_owners`` documents are broadcast; with more, the texts travel to them.
    """
    names, cuts = list(models), [n for _, n in models.values()]
    widths = list(dict.fromkeys(cuts))
    group = [widths.index(n) for n in cuts]
    rows = docs.select("doc_id", F.lower(text_col).alias("low"), *[F.col(x).cast("string").alias(f"l{m}") for m, (x, _) in enumerate(models.values()) if isinstance(x, str)])
    given = [(m, x) for m, (x, _) in enumerate(models.values()) if not isinstance(x, str)]
    if given:
        told = None
        for m, x in given:
            one = x.where("label is not null").select("doc_id", F.lit(m).alias("m"), F.col("label").cast("string").alias("label"))
            told = one if told is None else told.unionByName(one)
        owners = told.groupBy("doc_id").agg(*[F.min(F.when(F.col("m") == m, F.col("label"))).alias(f"l{m}") for m, _ in given])
    labels: list[list[str]] = []
    taught: list[list[int]] = []
    for m, (x, _) in enumerate(models.values()):
        got = (rows if isinstance(x, str) else owners).where(f"l{m} is not null").groupBy(f"l{m}").count().limit(most_labels + 1).collect()
        if len(got) > most_labels:
            raise ValueError(f"more than {most_labels} labels")
        labels.append(sorted(r[0] for r in got))
        taught.append([n for _, n in sorted((r[0], r[1]) for r in got)])

    def numbered(df: DataFrame, these: list[int]) -> DataFrame:
        """Labels as their places, which fit a few bytes."""
        return df.withColumns({f"l{m}": (F.array_position(F.array(*map(F.lit, labels[m])).cast("array<string>"), F.col(f"l{m}")) - 1).cast("int") for m in these})

    rows = numbered(rows, [m for m, (x, _) in enumerate(models.values()) if isinstance(x, str)])
    if given:
        owners = numbered(owners, [m for m, _ in given])
        rows = rows.join(F.broadcast(owners) if owners.count() <= most_owners else owners, "doc_id", "left")
    rows = rows.select("doc_id", "low", *[f"l{m}" for m in range(len(names))])

    # The labels of all models stand in one row, model by model; those of a group's models in a document are one number.
    first = np.cumsum([0, *map(len, labels)])
    of = [[m for m in range(len(names)) if group[m] == g] for g in range(len(widths))]
    base = [int(np.prod([len(labels[k]) + 1 for k in of[group[m]] if k < m], dtype=object)) for m in range(len(names))]
    if max(b * (len(labels[m]) + 1) for m, b in enumerate(base)) >= 2**63:
        raise ValueError("too many labels of models with the same features")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (g, c), n in found.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), g, np.int32)), pa.array(list(n), pa.string()), pa.array(np.full(len(n), c, np.int64)), pa.array(list(n.values()), pa.int64())], names=["g", "f", "c", "n"])

        for batch in batches:
            for text, *own in zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns)), strict=True):
                words = (text or "").split()
                for g, width in enumerate(widths):
                    if words and (c := sum((own[m] + 1) * base[m] for m in of[g] if own[m] is not None)):
                        found.setdefault((g, c), Counter()).update(words if width is None else [w[:width] for w in words])
                if sum(map(len, found.values())) > COUNTED:
                    yield from out()
                    found = {}
        yield from out()

    told = rows.where("doc_id is not null").mapInArrow(count, "g int, f string, c long, n long").repartition("g", "f")
    sums = [
        F.sum(F.when((F.col("g") == group[m]) & F.expr(f"c div {base[m]} % {len(labels[m]) + 1} = {j + 1}"), F.col("n")).otherwise(0)).alias(f"n{first[m] + j}")
        for m in range(len(names)) for j in range(len(labels[m]))
    ]
    each = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"n{j}").alias("n")) for j in range(first[-1])]).cast("array<struct<j:int,n:bigint>>")
    by_label = told.groupBy("g", "f").agg(F.sum("n").alias("all"), *sums)
    held = settle(by_label.select("g", "f", F.filter(each, lambda x: x["n"] > 0).alias("held"), F.floor(F.log2("all") * STEPS).cast("int").alias("rank")))

    totals = np.zeros(first[-1], np.int64)
    for r in held.select(F.explode("held").alias("x")).groupBy("x.j").agg(F.sum("x.n").alias("n")).collect():
        totals[r["j"]] = r["n"]
    has = [F.exists("held", _within(int(first[m]), int(first[m + 1]))) for m in range(len(names))]
    vocabulary = list(held.agg(*[F.count_if(x) for x in has]).first())
    most, least = max(1, most_held // max(1, *(sum(len(labels[m]) for m in ms) for ms in of))), 1 << 30
    for r in sorted(held.groupBy("rank").count().collect(), reverse=True):
        most -= r[1]
        if most < 0:
            break
        least = r[0]
    far = most < 0
    common = held.where(F.col("rank") >= least).select("g", "f", "held").toArrow()

    index: list[dict[str, int]] = []
    counts: list[np.ndarray] = []
    for g, ms in enumerate(of):
        own = common.filter(pc.equal(common["g"], g)).combine_chunks()
        index.append({f: i for i, f in enumerate(own["f"].to_pylist())})
        at = np.repeat(np.arange(len(own)), pc.list_value_length(own["held"]).to_numpy())
        flat = pc.list_flatten(own["held"]).combine_chunks()
        place = {int(j): k for k, j in enumerate(j for m in ms for j in range(first[m], first[m + 1]))}
        n = np.zeros((len(own) + 1, len(place)), np.int64)
        if len(at):
            n[at, [place[j] for j in flat.field("j").to_pylist()]] = flat.field("n").to_numpy()
        counts.append(n)
    shared = docs.sparkSession.sparkContext.broadcast((index, counts))
    every = [sum(t) for t in taught]

    def finish(own: np.ndarray, gain: np.ndarray, known: np.ndarray) -> list[pa.Array]:
        """Label and score of each model; ``own`` has the place of a document's label in each model, or -1."""
        out: list[pa.Array] = []
        for m in range(len(names)):
            js = [j for j in range(len(labels[m])) if totals[first[m] + j]]  # without words a label is none
            if not js:
                out += [pa.nulls(len(own), pa.string()), pa.nulls(len(own), pa.float64())]
                continue
            mine = own[:, m, None] == np.array(js)
            prior = np.log(np.maximum(np.array(taught[m], float)[js] - mine, 0.5) / np.maximum(every[m] - (own[:, m, None] >= 0), 1))
            none = -np.log(totals[first[m] + np.array(js)] - mine * known[:, m, None] + vocabulary[m])
            s = prior + known[:, m, None] * none + gain[:, first[m] + np.array(js)]
            best = s.argmax(1)
            score = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
            out += [pa.array([labels[m][js[b]] for b in best], pa.string()), pa.array(score)]
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts = shared.value
        logs = [np.log(n + 1.0) for n in counts]
        knows = [np.stack([n[:, lo : lo + len(labels[m])].any(1) for m, lo in _starts(ms, labels)], 1) for n, ms in zip(counts, of, strict=True)]

        def tell(ids: pa.Array, own: np.ndarray, found: list[tuple[list, list, list]]) -> Iterator[pa.RecordBatch]:
            size = len(ids)
            gain, known = np.zeros((size, first[-1])), np.zeros((size, len(names)), np.int64)
            rare: list[tuple] = []
            for g, ms in enumerate(of):
                features, times, sizes = found[g]
                doc, k = np.repeat(np.arange(size), sizes), np.array(times, np.int64)
                at = np.fromiter(map(index[g].get, features, repeat(-1)), np.int64, len(features))
                if far and (lost := np.flatnonzero(at < 0)).size:
                    rare.append((g, lost.size, [features[i] for i in lost], doc[lost], k[lost]))
                # A feature that is not held has the last row, of zeros.
                full = np.flatnonzero(sizes)
                begins = (np.cumsum(sizes) - sizes)[full]
                if not len(full):
                    continue
                table, knew = logs[g][at] * k[:, None], np.where(knows[g][at], k[:, None], 0)
                table, knew = np.add.reduceat(table, begins), np.add.reduceat(knew, begins)
                for i, (m, lo) in enumerate(_starts(ms, labels)):
                    n = len(labels[m])
                    known[full, m] = knew[:, i]
                    gain[full, first[m] : first[m + 1]] = table[:, lo : lo + n]
                    # Its own label counts without the document.
                    have = np.flatnonzero(own[doc, m] >= 0)
                    d, h, kk = doc[have], at[have], k[have]
                    j = own[d, m]
                    less = kk * (np.log(np.maximum(counts[g][h, lo + j] - kk, 0) + 1.0) - logs[g][h, lo + j])
                    gain[:, first[m] : first[m + 1]] += np.bincount(d * n + j, less, size * n).reshape(size, n)
            if not far:
                yield pa.RecordBatch.from_arrays([ids, *finish(own, gain, known)], names=told_names)
                return
            lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))
            # A blank is in no word, so that the keys of the documents themselves meet nothing and lie evenly.
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(size, -1, np.int32)), pa.array([f" {i}" for i in ids.to_pylist()]), pa.nulls(size, pa.int64()), lists(own, pa.int32()), lists(np.hstack([gain, known.astype(float)]), pa.float64())], names=sent)
            for g, n, fs, doc, k in rare:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(np.full(n, g, np.int32)), pa.array(fs, pa.string()), pa.array(k), lists(own[doc], pa.int32()), pa.nulls(n, pa.list_(pa.float64()))], names=sent)

        for batch in batches:
            owns = np.stack([c.fill_null(-1).to_numpy(zero_copy_only=False) for c in batch.columns[2:]], 1)
            texts, begun, size = batch.column(1).to_pylist(), 0, 0
            found = [([], [], []) for _ in widths]
            for i, text in enumerate(texts):
                words = (text or "").split()
                for g, width in enumerate(widths):
                    c = Counter(words if width is None else [w[:width] for w in words])
                    for kept, more in zip(found[g], (c, c.values(), [len(c)]), strict=True):
                        kept.extend(more)
                    size += len(c)
                if size > SCORED or i + 1 == len(texts):
                    yield from tell(batch.column(0).slice(begun, i + 1 - begun), owns[begun : i + 1], found)
                    begun, size, found = i + 1, 0, [([], [], []) for _ in widths]

    told_names = ["doc_id", *(f"{x}_{y}" for x in names for y in ("label", "score"))]
    sent = ["doc_id", "g", "f", "k", "own", "base"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {id_type}", *(f"{x}_label string, {x}_score double" for x in names)])
    if not far:
        return rows.mapInArrow(score, schema)

    model_of = np.repeat(np.arange(len(names)), np.diff(first))

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (size := batch.num_rows):
                continue
            own, values = (batch.column(c).flatten().to_numpy().reshape(size, -1) for c in (1, 2))
            # An entry is a rare feature of a document; its counts stand by label.
            entries = batch.column(3).flatten()
            doc, k, lists = np.repeat(np.arange(size), pc.list_value_length(batch.column(3)).to_numpy()), entries.field("k").to_numpy(), entries.field("held")
            entry = np.repeat(np.arange(len(k)), pc.list_value_length(lists).to_numpy())
            j, n = (lists.flatten().field(x).to_numpy() for x in ("j", "n"))
            doc, k, m = doc[entry], k[entry], model_of[j]
            gains = k * np.log(np.where(own[doc, m] == j - first[m], np.maximum(n - k, 0), n) + 1.0)
            opens = np.append(True, (entry[1:] != entry[:-1]) | (m[1:] != m[:-1]))[: len(m)]
            width = values.shape[1]
            values = values + np.bincount(doc * width + j, gains, size * width).reshape(size, width)
            values += np.bincount((doc * width + first[-1] + m)[opens], k[opens], size * width).reshape(size, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), *finish(own, values[:, : first[-1]], values[:, first[-1] :].round().astype(np.int64))], names=told_names)

    met = rows.mapInArrow(score, f"doc_id {id_type}, g int, f string, k long, own array<int>, base array<double>").join(held.where(F.col("rank") < least).select("g", "f", "held"), ["g", "f"], "left")
    met = met.where("base is not null or held is not null").repartition("doc_id")
    entries = F.collect_list(F.when(F.col("base").isNull(), F.struct("k", "held"))).alias("entries")
    return met.groupBy("doc_id").agg(F.first("own").alias("own"), F.first("base", ignorenulls=True).alias("base"), entries).mapInArrow(end, schema)


def _starts(ms: list[int], labels: list[list[str]]) -> Iterator[tuple[int, int]]:
    """Each model of a group and the place of its first label in the group's table."""
    lo = 0
    for m in ms:
        yield m, lo
        lo += len(labels[m])


def _within(lo: int, hi: int):
    return lambda x: (x["j"] >= lo) & (x["j"] < hi)
