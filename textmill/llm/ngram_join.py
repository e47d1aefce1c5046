"""N-gram Jaccard join by a prefix tree over globally ordered n-gram sets.

1. Every text becomes a set of hashed word n-grams. Which n-grams two documents
   share is found by one exchange of compressed blobs: each batch of documents
   sends its distinct n-grams to the bucket of their hash, and gets back the
   shared ones with their document frequency. N-grams that are very common in a
   batch are sent as a count, their places stay with the batch, so a hot n-gram
   costs one entry a batch.
2. A set of n members can have a partner only if ceil(t*n) of its members are
   shared. What remains is put into the global order (rare first). Equal sets become
   one class, and classes of the same size with the same shared members one shape: their
   similarity to any other class is the same, so one of them is compared for all.
3. Linked sets agree in a prefix n-gram. The sets with a prefix n-gram are brought
   to the least set that has it: all sets around one least set are a neighbourhood. A
   set is in as many neighbourhoods as its prefix has different least sets, and chains
   of neighbourhoods stay apart.
4. In each neighbourhood the ordered sets form a trie (sorted sets and the depth
   to which each agrees with the last). A set walks the trie, keeps the partial
   overlap of the shared path, and leaves a subtree as soon as the members it has
   left cannot reach the overlap that is needed. Sets that are connected already
   are not compared again, so a large group of near copies costs about one
   comparison a member. Neighbourhoods over ``block`` sets, or with as many
   members as so many sets of 300, are dealt into blocks: the first block meets
   each block in a task of its own, and then only what is not in the largest
   component so far meets all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import Words, buckets_for, mix, pack, runs, settle, shuffle_partitions, slices, small_batches, table, unpack
from textmill.operators.components import connected_components

#: Bytes of text that are worked on at a time, and the count from which an n-gram's places stay with its batch.
SLICE, HOT = 2 << 20, 32
#: Mean members of a set in a block, from which a block holds fewer sets; members in a task of small neighbourhoods.
BLOCK_MEMBERS, TASK_MEMBERS = 300, 2 << 20
#: Hashes of 8 bytes that may be broadcast.
MOST_BROADCAST = 1_000_000
_NONE = np.zeros(0, np.uint64)
NEVER = 1 << 60


def _sets(texts: pa.Array, n: int, lower: bool) -> list[np.ndarray]:
    """The sorted set of hashed n-grams of each text; a text of fewer words is one n-gram."""
    words = Words(texts, lower)
    grams, inside = words.windows(n)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(mix(np.array([mix(words.hash[a:b] * np.arange(3, 2 * (b - a) + 3, 2, dtype=np.uint64)).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(_NONE)
    return out


def _mark(members: np.ndarray) -> np.ndarray:
    """128 bits that tell sets apart, whatever the order of the members."""
    return np.array([members.sum(dtype=np.uint64), mix(members ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)], np.uint64)


def _need(n: int | np.ndarray, percent: int):
    """Members that a set of n must share with a partner: the ceiling of t*n."""
    return (n * percent + 99) // 100


def _send(n: int, lower: bool, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count = TaskContext.get().partitionId(), 0
        for whole in batches:
            for part in slices(whole, "text", SLICE):
                batch, count = (task << 32) + count, count + 1
                sets = _sets(part.column("text"), n, lower)
                known = np.asarray(part.column("id").is_valid())
                ids = part.column("id").fill_null(0).to_numpy()
                sizes = np.array([len(s) for s in sets], np.int32)
                marks = np.array([_mark(s) for s in sets], np.uint64).reshape(-1, 2)
                sent = [s if k else _NONE for s, k in zip(sets, known, strict=True)]
                gram = np.concatenate([_NONE, *sent])
                doc = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sent])
                order = np.argsort(gram, kind="stable")
                gram, doc = gram[order], doc[order]
                first = runs(gram)
                each = np.diff(first)
                hot = np.repeat(each > HOT, each)
                rows = [(-1 - batch, batch, pack(gram[hot]), pack(doc[hot]), pack(sizes), pack(marks.ravel()), pack(ids), pack(known.astype(np.uint8)))]
                gram_of, where = gram[first[:-1]], ((gram[first[:-1]] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                edges = np.searchsorted(where, np.arange(buckets + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(edges)):
                    i, j = edges[b], edges[b + 1]
                    lo, hi = first[i], first[j]
                    rows.append((int(b), batch, pack(gram_of[i:j]), pack(doc[lo:hi][~hot[lo:hi]]), pack(each[i:j].astype(np.uint32)), None, None, None))
                yield _rows(rows)

    return run


_SENT = "bucket long, batch long, grams binary, docs binary, counts binary, marks binary, ids binary, known binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("grams", "docs", "counts", "marks", "ids", "known"))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _share(sent: pa.Table) -> pa.Table:
    """One bucket: the shared n-grams of each batch, as keys in the global order (logarithm of the frequency, hash)."""
    if sent.column("bucket")[0].as_py() < 0:
        return sent
    blobs = sent.select(["batch", "grams", "docs", "counts"]).to_pydict()
    grams = [unpack(x, np.uint64) for x in blobs["grams"]]
    counts = [unpack(x, np.uint32) for x in blobs["counts"]]
    every, back = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(back, np.concatenate(counts), len(every)).astype(np.int64)
    level = np.log2(np.maximum(total, 1)).astype(np.uint64)
    key = (level << np.uint64(58)) | (every >> np.uint64(6))
    rows, at = [], 0
    for batch, own, count, docs in zip(blobs["batch"], grams, counts, blobs["docs"], strict=True):
        of = back[at : at + len(own)]
        at += len(own)
        shared, hot = total[of] > 1, count > HOT
        doc = unpack(docs, np.uint32)
        each = np.where(hot, 0, count)
        stays = np.repeat(shared, each)
        if shared.any():
            rows.append((0, batch, pack(np.concatenate([np.repeat(key[of], each)[stays], key[of][shared & hot]])), pack(doc[stays]), pack(own[shared & hot]), None, None, None))
    return pa.Table.from_batches([_rows(rows)] if rows else [], _SCHEMA)


_SETS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("shape", pa.binary()), ("keys", pa.binary())])


def _gather(percent: int):
    def run(got: pa.Table) -> pa.Table:
        """One batch: each document's size and mark, and its shared n-grams in order if they are enough for a partner."""
        rows = got.to_pylist()
        own = next(r for r in rows if r["bucket"] < 0)
        sizes, marks, ids, known = unpack(own["counts"], np.int32), unpack(own["marks"], np.uint64).reshape(-1, 2), unpack(own["ids"], np.int64), unpack(own["known"], np.uint8)
        hot_gram, hot_doc = unpack(own["grams"], np.uint64), unpack(own["docs"], np.uint32)
        keys, docs, hot_own, hot_key = [_NONE], [np.zeros(0, np.uint32)], [_NONE], [_NONE]
        for r in rows:
            if r["bucket"] >= 0:
                key, doc, hot = unpack(r["grams"], np.uint64), unpack(r["docs"], np.uint32), unpack(r["counts"], np.uint64)
                keys.append(key[: len(doc)])
                docs.append(doc)
                hot_own.append(hot)
                hot_key.append(key[len(doc) :])
        hot_own, hot_key = np.concatenate(hot_own), np.concatenate(hot_key)
        order = np.argsort(hot_own)
        keys.append(hot_key[order][np.searchsorted(hot_own[order], hot_gram)])
        docs.append(hot_doc)
        key, doc = np.concatenate(keys), np.concatenate(docs)
        order = np.lexsort((key, doc))
        key, doc = key[order], doc[order]
        edge = np.searchsorted(doc, np.arange(len(sizes) + 1))
        out = []
        for i, n in enumerate(sizes.tolist()):
            enough = n and known[i] and edge[i + 1] - edge[i] >= _need(n, percent)
            own = key[edge[i] : edge[i + 1]]
            shape = _mark(own).tobytes() + n.to_bytes(4, "big") if enough else None
            out.append((int(ids[i]) if known[i] else None, n, marks[i].tobytes() + n.to_bytes(4, "big"), shape, own.astype(">u8").tobytes() if enough else None))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SETS, strict=True)], schema=_SETS)

    return run


def _prefixes(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, ids = [_NONE], []
            for i, n, keys in zip(b.column("id").to_pylist(), b.column("n").to_pylist(), b.column("keys").to_pylist(), strict=True):
                m = len(keys) // 8
                key.append(np.frombuffer(keys, ">u8", m - _need(n, percent) + 1).astype(np.uint64))
                ids += [i] * len(key[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key).view(np.int64)), pa.array(ids, pa.int64())], names=["gram", "id"])

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def trie_links(sets: list[np.ndarray], sizes: list[int], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what the similarity links of some ordered sets connect.

    ``sets`` are sorted arrays of shared members, ``sizes`` the full sizes. With
    ``sides`` only pairs from different sides are compared.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    depth = [0] * len(order)
    for k in range(1, len(order)):
        a, b = sets[order[k - 1]], sets[order[k]]
        m = min(len(a), len(b))
        differ = a[:m] != b[:m]
        depth[k] = int(differ.argmax()) if differ.any() else m
    # The next set that agrees less with the one before it than this one does: the end of this set's subtree.
    after, open_ = [len(order)] * len(order), []
    for k, d in enumerate(depth):
        while open_ and depth[open_[-1]] > d:
            after[open_.pop()] = k
        open_.append(k)
    forest, links = _Forest(len(sets)), []
    for i, x in enumerate(order):
        xs, n = sets[x], sizes[x]
        least, most = -(-n * percent // 100), n * 100 // percent
        need_any = _overlap(n, least, percent)
        agree = len(xs) if i + 1 < len(order) else 0  # depth to which the state below holds for the next set
        path = np.arange(1, len(xs) + 1)  # partial overlaps on the path of the last set that was walked
        cut, k = NEVER, i  # the depth of a subtree that is left
        while (k := k + 1) < len(order):
            while k < len(order) and depth[k] >= cut:
                k = after[k]
            if k == len(order):
                break
            agree, cut = min(agree, depth[k]), NEVER
            y = order[k]
            if not least <= sizes[y] <= most or (sides is not None and sides[x] == sides[y]) or forest.find(x) == forest.find(y):
                continue
            ys = sets[y]
            rest = ys[agree:]
            at = np.searchsorted(xs, rest)
            hit = at < len(xs)
            hit[hit] = xs[at[hit]] == rest[hit]
            base = int(path[agree - 1]) if agree else 0
            partial = base + np.cumsum(hit)
            need = _overlap(n, sizes[y], percent)
            path = np.concatenate([path[:agree], partial])
            total = int(path[-1]) if len(path) else 0
            if total >= need:
                forest.up[forest.find(y)] = forest.find(x)
                links.append((x, y))
            elif len(partial):
                bound = partial + (len(xs) - at - hit) < need_any
                if bound.any():
                    cut = agree + int(bound.argmax()) + 1
            agree = len(ys)
    return links


def _overlap(a: int, b: int, percent: int) -> int:
    """The least intersection c of sets of a and b with 100*c >= percent*(a+b-c)."""
    return -(-percent * (a + b) // (100 + percent))


_LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _walk(percent: int, two_sided: bool = False):
    def run(got: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        got = got.sort_by("area").combine_chunks()
        edge = runs(got.column("area").to_numpy())
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            if b - a < 2:
                continue
            part = got.slice(a, b - a)
            ids, sizes = part.column("id").to_pylist(), part.column("n").to_pylist()
            sets = [np.frombuffer(x, ">u8").astype(np.uint64) for x in part.column("keys").to_pylist()]
            apart = two_sided or part.column("j")[0].as_py() > 0
            links += [(ids[x], ids[y]) for x, y in trie_links(sets, sizes, percent, part.column("side").to_pylist() if apart else None)]
        return pa.Table.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], schema=_LINKS)

    return run


def _few(rows: DataFrame) -> DataFrame:
    """Rows of two numbers: few are broadcast, many are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= MOST_BROADCAST // 4 else rows


def _rest_of_wide(full: DataFrame, areas: DataFrame, found: DataFrame, percent: int, block: int) -> DataFrame:
    """Links of wide neighbourhoods that the comparison with their first block has not settled.

    Members of the largest component of a neighbourhood are connected, so no pair
    of them needs to be compared. Each of the others is compared with all members.
    """
    state = areas.join(found, areas.id == found.vertex, "left").select("area", "id", "blocks", "own", F.coalesce("label", "id").alias("label"))
    largest = state.groupBy("area", "label").agg(F.count("*").alias("size")).groupBy("area").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    state = settle(state.join(_few(settle(largest)), "area"))
    open_ = state.where("label <> main").groupBy("area").agg(F.ceil(F.count("*") / block).cast("int").alias("rests"))
    state = state.join(_few(settle(open_)), "area")
    asking = state.where("label <> main").withColumn("i", F.pmod(F.xxhash64("id", F.lit(11)), F.col("rests")).cast("int"))
    asking = asking.select("area", "id", F.lit(0).alias("side"), F.array("i").alias("i"), F.sequence(F.lit(0), F.col("blocks") - 1).alias("j"))
    asked = state.select("area", "id", F.lit(1).alias("side"), F.sequence(F.lit(0), F.col("rests") - 1).alias("i"), F.array("own").alias("j"))
    dealt = asking.union(asked).withColumn("i", F.explode("i")).withColumn("j", F.explode("j"))
    return full.join(dealt, "id").select("area", "id", "n", "keys", "side", "i", "j").groupBy("area", "i", "j").applyInArrow(_walk(percent, two_sided=True), "u long, v long")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", lower: bool = True, block: int = 512) -> DataFrame:
    """Components of documents whose n-gram sets have a Jaccard similarity of ``percent`` or more.

    Returns ``doc_id, n_shingles, component_id``, a row for each input row:
    the size of the set and the least id that links reach. Null and empty texts,
    and texts without a word, have an empty set and are linked with nothing; a
    text of fewer than n words is one n-gram. A row with a null id is linked with
    nothing and has a null component. Repeated rows and copies are one class. Rows
    that share an id are one vertex. Other columns are ignored; an empty table
    gives an empty result. Long texts are read whole.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    buckets, parts = buckets_for(docs), shuffle_partitions(docs.sparkSession)
    sent = docs.mapInArrow(_send(n, lower, buckets), _SENT)
    shared = sent.groupBy("bucket").applyInArrow(_share, _SENT)
    with small_batches(docs.sparkSession):
        sets = settle(shared.groupBy("batch").applyInArrow(_gather(percent), "id long, n long, mark binary, shape binary, keys binary"))

    classes = settle(sets.where("id is not null and n > 0").groupBy("mark", "n", "shape").agg(F.min("id").alias("rep")))
    shapes = classes.where("shape is not null").groupBy("shape").agg(F.min("rep").alias("id"), F.count("*").alias("classes"))
    full = _first_of(sets.where("shape is not null").select("id", "n", "shape", "keys"), shapes)

    grams = full.mapInArrow(_prefixes(percent), "gram long, id long")
    least = grams.groupBy("gram").agg(F.min("id").alias("area"), F.max("id").alias("last")).where("area < last").select("gram", "area")
    near = grams.join(least, "gram").select("area", "id").distinct()
    # A block is bounded in sets and in members, so that large sets do not make large tasks.
    near = settle(near.join(full.select("id", "n").dropDuplicates(["id"]), "id"))
    size = F.greatest(F.count("*") / block, F.sum("n") / (BLOCK_MEMBERS * block))
    wide = settle(near.groupBy("area").agg(F.ceil(size).cast("int").alias("blocks")).where("blocks > 1"))
    own = F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks"))).cast("int")
    # Wide neighbourhoods are few, at most one for each ``block`` rows; a hot one is not gathered for their sake.
    areas = near.join(_few(wide), "area", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    # Small neighbourhoods: several in a task, as many as have so many members. Wide ones: the first block against each block.
    tasks = max(2 * parts, (near.agg(F.sum("n")).first()[0] or 0) // TASK_MEMBERS)
    pack = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("area"), F.lit(tasks)))
    first = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    dealt = full.join(areas.drop("n"), "id").withColumn("j", F.explode(first)).select("area", "id", "n", "keys", F.col("own").alias("side"), F.lit(0).alias("i"), "j", pack.alias("pack"), F.when(F.col("blocks") > 1, F.col("area")).alias("wide"))
    links = settle(dealt.groupBy("pack", "wide", "i", "j").applyInArrow(_walk(percent), "u long, v long"))
    if not wide.isEmpty():
        links = settle(links.union(_rest_of_wide(full, areas.where("blocks > 1").drop("n"), connected_components(links), percent, block)))

    found = connected_components(links.union(_of_shapes(classes, shapes, links, full, percent)))
    label = classes.join(found, classes.rep == found.vertex, "left").select("mark", F.coalesce("label", "rep").alias("component"))
    return (
        sets.select("id", "n", "mark").join(label, "mark", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    )


def _first_of(sets: DataFrame, shapes: DataFrame) -> DataFrame:
    """``id, n, keys``: one set of each shape. Few shapes are broadcast, as hashes, so that the sets are not shuffled for them."""
    key, count = F.xxhash64("id", "shape").alias("key"), shapes.count()
    first = shapes.select(key)
    found = settle(sets.withColumn("key", key).join(F.broadcast(first) if count <= MOST_BROADCAST else first, "key", "left_semi").select("id", "n", "shape", "keys"))
    # More rows than shapes: some row is repeated, with its id.
    return (found if found.count() == count else settle(found.dropDuplicates(["id", "shape"]))).select("id", "n", "keys")


def _of_shapes(classes: DataFrame, shapes: DataFrame, links: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links of the classes that were not compared, since one of their shape was.

    Classes of one shape share the same members and no others. If these are enough for
    a link, all are linked with the first. If not, they are linked with what the first
    is linked with, if anything.
    """
    shared = F.length("keys") / 8
    alike = full.select(F.col("id").alias("first"), (100 * shared >= percent * (2 * F.col("n") - shared)).alias("alike"))
    partner = links.select("u", "v").union(links.select("v", "u")).groupBy("u").agg(F.min("v").alias("partner"))
    many = classes.join(shapes.where("classes > 1").select("shape", F.col("id").alias("first")), "shape").select("first", "rep")
    told = many.join(alike, "first").join(partner, F.col("first") == F.col("u"), "left")
    return told.select(F.when(F.col("alike"), F.col("first")).otherwise(F.col("partner")).alias("u"), F.col("rep").alias("v")).where("u is not null and u <> v")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS u, doc_id AS c FROM s UNION SELECT p.v, r.c FROM r JOIN p ON p.u = r.u)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, (SELECT min(c) FROM r WHERE r.u = s.doc_id) AS component_id FROM s
"""
