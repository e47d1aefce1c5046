"""Exact line deduplication and MinHash near-duplicate detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.hashing import murmur3_family
from textmill.functions.text import ngrams, normalize
from textmill.operators.components import connected_components
from textmill.session import settle

#: The largest prime below 2**32: signatures are residues modulo it.
PRIME = 4294967291
#: N-grams that are hashed at a time.
CHUNK = 4096


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_no, line``: the content of lines, without their break."""
    parts = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    return docs.select(F.col(id_col).alias("doc_id"), parts.alias("line_no", "line"))


def exact_line_dedup(docs: DataFrame, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts without the lines that occur more than once in the whole table: ``doc_id, n_lines, text``.

    ``keep="none"`` removes every copy, ``"first"`` keeps the first by id and place.
    A line that occurs once has one place, so one aggregation by line finds the
    survivors and where they stand; there is no join, a line that fills a third of
    the table is one partial sum a task, and texts are rebuilt from the survivors.
    Documents that lose all lines have an empty text.
    """
    place = F.min(F.struct(F.col("doc_id"), F.col("line_no")))
    once = line_table(docs, id_col, text_col).groupBy("line").agg(F.count("*").alias("n"), place.alias("at"))
    once = once if keep == "first" else once.where("n = 1")
    built = once.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("at.line_no").alias("line_no"), "line"))).alias("kept"))
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    rebuilt = ids.join(built, "doc_id", "left")
    return rebuilt.select("doc_id", F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.array_join("kept.line", "\n"), F.lit("")).alias("text"))


def gram_sets(docs: DataFrame, n: int = 5) -> DataFrame:
    """``doc_id, grams``: the distinct n-grams of the normalised texts, in order."""
    return docs.select("doc_id", F.sort_array(ngrams(normalize(F.coalesce("text", F.lit(""))), n)).alias("grams"))


_SIGNATURE = "doc_id long, sig array<long>"


def _marked(sets: DataFrame) -> list[str]:
    return [c for c in sets.columns if c == "mark"]


def minhash(sets: DataFrame, hashes: int = 128) -> DataFrame:
    """``doc_id, sig``: the least hash of a document's n-grams for each of a family of hashes; empty sets have none. A column ``mark`` (binary) goes along.

    One digest of an n-gram gives two numbers a and b; the i-th hash is a + i*b
    modulo a prime. A set is one row, so nothing is shuffled: digests are made in the JVM, eight bytes
    of each go to numpy in Arrow batches, which has all hashes of an n-gram in one operation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(hashes, dtype=np.uint64)[:, None]
        for batch in batches:
            # Sets without members are left out here: a filter in the plan would make the n-grams twice.
            has = pc.greater(pc.binary_length(batch.column(1)), 0)
            ids, blobs = batch.column(0).filter(has), batch.column(1).filter(has).to_pylist()
            sigs = np.empty((len(blobs), hashes), np.int64)
            for k, blob in enumerate(blobs):
                pairs = np.frombuffer(blob, ">u4").astype(np.uint64).reshape(-1, 2)
                least = np.full(hashes, PRIME, np.uint64)
                for at in range(0, len(pairs), CHUNK):
                    a, b = pairs[at : at + CHUNK].T
                    least = np.minimum(least, ((a + step * b) % np.uint64(PRIME)).min(1))
                sigs[k] = least
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(blobs) + 1, dtype=np.int32) * hashes), pa.array(sigs.ravel()))
            yield pa.RecordBatch.from_arrays([ids, sig, *(batch.column(c).filter(has) for c in mark)], names=["doc_id", "sig", *mark])

    mark = _marked(sets)
    digests = F.unhex(F.array_join(F.transform("grams", lambda g: F.substring(F.md5(g), 1, 16)), ""))
    return sets.select(F.col("doc_id").cast("long"), digests.alias("digests"), *mark).mapInArrow(run, ", ".join([_SIGNATURE, *(f"{c} binary" for c in mark)]))


def murmur_minhash(sets: DataFrame, hashes: int = 128) -> DataFrame:
    """As ``minhash``, with seeded 32-bit Murmur3 for the family: the i-th hash of an n-gram has the seed i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                grams = batch.column(1).slice(k, 1).flatten()
                if not len(grams):
                    continue
                least = np.full(hashes, 0xFFFFFFFF, np.uint32)
                for at in range(0, len(grams), CHUNK):
                    least = np.minimum(least, murmur3_family(grams.slice(at, CHUNK), hashes).min(1))
                sig = pa.array([least.astype(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), sig, *(batch.column(c).slice(k, 1) for c in mark)], names=["doc_id", "sig", *mark])

    mark = _marked(sets)
    return sets.select(F.col("doc_id").cast("long"), "grams", *mark).mapInArrow(run, ", ".join([_SIGNATURE, *(f"{c} binary" for c in mark)]))


def lsh_buckets(signatures: DataFrame, bands: int = 16) -> DataFrame:
    """``doc_id, band, key``: a digest of each band of a signature; rows that fill no band are left out."""
    rows = F.expr(f"transform(sequence(0, {bands - 1}), i -> struct(i AS band, md5(array_join(slice(sig, i * (size(sig) div {bands}) + 1, size(sig) div {bands}), ',')) AS key))")
    return signatures.select("doc_id", F.explode(rows).alias("b")).select("doc_id", F.col("b.band").alias("band"), F.col("b.key").alias("key"))


def lsh_keys(signatures: DataFrame, bands: int = 16) -> DataFrame:
    """``doc_id, keys``: a 64-bit hash for each band of a signature. Enough where the members of a bucket are compared themselves, and a quarter of ``lsh_buckets``."""
    keys = F.expr(f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, slice(sig, i * (size(sig) div {bands}) + 1, size(sig) div {bands})))")
    return signatures.select("doc_id", *_marked(signatures), keys.alias("keys"))


def _mark() -> Column:
    return F.sha2(F.concat_ws("\n", F.size("grams"), "grams"), 256)


def classes_of(docs: DataFrame, n: int = 5) -> DataFrame:
    """``doc_id, class, grams``: documents with equal n-gram sets are one class, named by the least id; it carries the set."""
    sets = settle(gram_sets(docs, n).withColumn("mark", _mark()))
    named = sets.groupBy("mark").agg(F.min("doc_id").alias("class"))
    return sets.join(named, "mark").select("doc_id", "class", F.when(F.col("doc_id") == F.col("class"), F.col("grams")).alias("grams"))


def lsh_candidates(buckets: DataFrame) -> DataFrame:
    """``u, v``: distinct pairs of documents with u < v that share a bucket. Every pair is told: for components see ``bucket_links``."""
    left, right = buckets.select("band", "key", F.col("doc_id").alias("u")), buckets.select("band", "key", F.col("doc_id").alias("v"))
    return left.join(right, ["band", "key"]).where("u < v").select("u", "v").distinct()


def jaccard_pairs(pairs: DataFrame, sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Candidate pairs whose n-gram sets have a similarity over the threshold: ``u, v, jaccard``. Two empty sets are alike.

    The sets are compared as 64-bit hashes of their members: a third of the bytes of the strings.
    """
    return _alike(pairs, _members(sets), threshold)


def _members(sets: DataFrame) -> DataFrame:
    return sets.select("doc_id", F.transform("grams", lambda g: F.xxhash64(g)).alias("members"))


def _alike(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    both = pairs.join(members.select(F.col("doc_id").alias("u"), F.col("members").alias("a")), "u").join(members.select(F.col("doc_id").alias("v"), F.col("members").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    every = F.size("a") + F.size("b") - common
    return both.select("u", "v", F.when(every == 0, F.lit(1.0)).otherwise(common / every).alias("jaccard")).where(F.col("jaccard") > threshold)


def bucket_links(buckets: DataFrame, sets: DataFrame, threshold: float = 0.8, most_ids: int = 200_000) -> DataFrame:
    """``u, v``: verified links that connect what all verified pairs of the buckets connect, without telling all pairs.

    First every member of a bucket is compared with its least one, which settles groups
    of near copies. Then only members outside the largest component of their bucket are
    compared with the members of other components in it. Only sets of documents that
    share a bucket are made and stored, as 64-bit hashes; up to ``most_ids`` of their ids are
    broadcast, so that no text travels for the others.
    """
    many = buckets.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("doc_id").alias("u")).where("n > 1")
    held = settle(buckets.join(many, ["band", "key"]).select("band", "key", "u", F.col("doc_id").alias("v")))
    needed = settle(held.select(F.col("v").alias("doc_id")).distinct())
    needed = F.broadcast(needed) if needed.count() <= most_ids else needed
    members = settle(_members(sets.join(needed, "doc_id", "left_semi")))
    links = settle(_alike(held.where("u <> v").select("u", "v").distinct(), members, threshold).select("u", "v"))
    found = connected_components(links)
    state = held.join(found, held.v == found.vertex, "left").select("band", "key", "v", F.coalesce("label", "v").alias("label"))
    main = state.groupBy("band", "key", "label").agg(F.count("*").alias("n")).groupBy("band", "key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    state = settle(state.join(main, ["band", "key"]))
    apart = state.where("label <> main").select("band", "key", F.col("v").alias("x"), F.col("label").alias("other"))
    pairs = apart.join(state, ["band", "key"]).where("label <> other").select(F.least("x", "v").alias("u"), F.greatest("x", "v").alias("v")).distinct()
    return links.unionByName(_alike(pairs, members, threshold).select("u", "v"))


def minhash_components(docs: DataFrame, hashes: int = 128, bands: int = 16, n: int = 5, threshold: float = 0.8, family=minhash) -> DataFrame:
    """``doc_id, component``: the least id that is reached by verified links, for each document; ``family`` is ``minhash`` or ``murmur_minhash``.

    Documents with equal sets are linked first and only one of them goes on, so a
    large group of copies costs no pairs. Sets are made anew from the texts where they are
    needed, and only digests, keys of bands and ids are stored; where rows share an id,
    the sets are stored with them.
    """
    if docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        sets = gram_sets(docs, n)
        made = settle(lsh_keys(family(sets.withColumn("mark", F.unhex(_mark())), hashes), bands))
        # A document without a signature has no n-grams: all these are one class.
        marks = docs.select("doc_id").join(made.select("doc_id", "mark"), "doc_id", "left").withColumn("mark", F.coalesce("mark", F.expr("X''")))
        members = settle(marks.join(marks.groupBy("mark").agg(F.min("doc_id").alias("class")), "mark").select("doc_id", "class"))
        buckets = made.join(members.where("doc_id = class"), "doc_id", "left_semi")
    else:
        members = settle(classes_of(docs, n))
        sets = members.where("grams is not null").select("doc_id", "grams")
        buckets = settle(lsh_keys(family(sets, hashes), bands))
    buckets = buckets.select("doc_id", F.posexplode("keys").alias("band", "key"))
    found = connected_components(bucket_links(buckets, sets, threshold))
    return members.join(found, members["class"] == found.vertex, "left").select("doc_id", F.coalesce("label", "class").alias("component"))


def minhash_dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents that survive: of each component the one with the least id."""
    kept = minhash_components(docs, **options).where("doc_id = component").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")
