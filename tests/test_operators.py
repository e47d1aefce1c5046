"""Line and near-duplicate operators, components, tokenizer, scaling, classifiers, sources and streams on small tables."""

import gzip
import math
import random
from pathlib import Path

import pytest
from oracle import check
from pyspark.sql import functions as F

from textmill.functions.text import PRETOKEN
from textmill.operators import bpe, bpe_train, classify, dedup, scaling
from textmill.operators.components import connected_components
from textmill.plans.registry import QUERIES, SQL
from textmill.sources import files, warc
from textmill.streaming import curation


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_line_dedup(spark):
    df = docs(spark, "a\nb\na", "b\nc", None, "", "d\n")
    none = {r.doc_id: r.text for r in dedup.exact_line_dedup(df).collect()}
    first = {r.doc_id: r.text for r in dedup.exact_line_dedup(df, keep="first").collect()}
    assert none == {0: "", 1: "c", 2: "", 3: "", 4: "d"}
    assert first[0] == "a\nb" and first[1] == "c"
    assert {r.doc_id: r.text for r in dedup.exact_line_dedup(dedup.exact_line_dedup(df)).collect()} == none


@pytest.mark.parametrize("one_task", [0, 1_000_000])
@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed, one_task):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1), (5, 5)]
    label = {v: v for e in edges for v in e if v is not None}
    for _ in label:
        for u, v in edges:
            if u is not None:
                label[u] = label[v] = min(label[u], label[v])
    got = {r.vertex: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long"), one_task=one_task).collect()}
    assert got == {v: x for v, x in label.items() if v != x}


def test_long_paths():
    """A million edges of a path, in any order of ids, and of a star."""
    import numpy as np

    from textmill.operators.components import least_labels

    n = 1_000_000
    order = np.random.default_rng(0).permutation(n + 1)
    for u, v in ((order[:-1], order[1:]), (np.arange(n), np.arange(1, n + 1)), (np.full(n, n), np.arange(n))):
        assert not least_labels(u, v)[1].any()


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_bucket_links(spark):
    """Groups of near copies, strangers in their buckets, and buckets of strangers: the same components as from all pairs."""
    rng = random.Random(2)
    base = [[f"g{k}x{i}" for i in range(40)] for k in range(4)]
    rows = [(i, sorted({x if rng.random() > (0.4 if i % 4 == 0 else 0.04) else f"o{i}" for x in rng.choice(base)} | {f"own{i}"})) for i in range(80)]
    sets = spark.createDataFrame(rows, "doc_id long, grams array<string>")
    buckets = spark.createDataFrame([(i, band, f"{rng.randrange(3) if band else g[0][1]}") for i, g in rows for band in range(3)], "doc_id long, band int, key string")
    label = {i: i for i, _ in rows}
    every = dedup.jaccard_pairs(dedup.lsh_candidates(buckets), sets).collect()
    for _ in rows:
        for p in every:
            label[p.u] = label[p.v] = min(label[p.u], label[p.v])
    found = {r.vertex: r.label for r in connected_components(dedup.bucket_links(buckets, sets)).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == label
    assert len(set(label.values())) > 4


def test_minhash_stores_no_sets(spark):
    """What is stored does not grow with the texts; a repeated or null id goes the way that stores them, with the same components."""
    rng = random.Random(7)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(60)]
    df = docs(spark, *texts, texts[0], texts[1] + " more", "", None, "...")
    before = stored_bytes(spark)
    got = {r.doc_id: r.component for r in dedup.minhash_components(df).collect()}
    assert stored_bytes(spark) - before < 300_000
    assert got == {i: i for i in range(60)} | {60: 0, 61: 1, 62: 62, 63: 62, 64: 62}
    again = df.unionByName(df.where("doc_id = 5")).unionByName(spark.createDataFrame([(None, "alone here")], df.schema))
    assert {r.doc_id: r.component for r in dedup.minhash_components(again).collect() if r.doc_id is not None} == got


def test_minhash_recall(spark, sf):
    """Of all pairs of documents with different sets and an exact similarity over 0.8, nine in ten or more are found."""
    sets = dedup.classes_of(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")).where("size(grams) > 0").select("doc_id", "grams").cache()
    grams = sets.select("doc_id", F.explode("grams").alias("g"))
    share = grams.withColumnRenamed("doc_id", "u").join(grams.withColumnRenamed("doc_id", "v"), "g").where("u < v").groupBy("u", "v").count()
    size = {r.doc_id: len(r.grams) for r in sets.collect()}
    exact = {(r.u, r.v) for r in share.collect() if r["count"] > 0.8 * (size[r.u] + size[r.v] - r["count"])}
    found = dedup.jaccard_pairs(dedup.lsh_candidates(dedup.lsh_buckets(dedup.minhash(sets))), sets)
    got = {(r.u, r.v) for r in found.collect()}
    sets.unpersist()
    assert got <= exact and len(got) >= 0.9 * len(exact) > 0


def test_minhash_dedup(spark):
    base = [f"word{i}" for i in range(100)]
    near = base[:50] + ["other"] + base[51:]
    df = docs(spark, " ".join(base), " ".join(near), " ".join(base), "short text", "", None, " ".join(f"z{i}" for i in range(60)))
    got = {r.doc_id: r.component for r in dedup.minhash_components(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6}
    assert sorted(r.doc_id for r in dedup.minhash_dedup(df).collect()) == [0, 3, 4, 6]


def test_jaccard_is_strict(spark):
    sets = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "d", "e"]), (3, []), (4, [])], "doc_id long, grams array<string>")
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "u long, v long")
    assert [(r.u, r.jaccard) for r in dedup.jaccard_pairs(pairs, sets, 0.8).collect()] == [(3, 1.0)]


def counts(spark, **n):
    return spark.createDataFrame(list(n.items()), "token string, n long")


def test_bpe_ties_and_overlaps(spark):
    coder = bpe_train.train(counts(spark, low=5, lower=2, newest=6, widest=3), 256 + 1 + 6)
    # Of equal counts the greatest pair goes first.
    assert coder.merges[:3] == [(b"s", b"t"), (b"e", b"st"), (b"o", b"w")]
    assert bpe_train.train(counts(spark, aaa=4), 258).merges == [(b"a", b"a")]
    assert bpe_train.train(counts(spark, aaa=4), 258).encode_token(b"aaaa") == [257, 257]
    assert bpe_train.train(counts(spark, a=4), 300).merges == []


def joined(parts, pair):
    out = []
    for x in parts:
        out.append(x)
        while len(out) > 1 and (out[-2], out[-1]) == pair and (len(out) < 3 or x != pair[0] + pair[1]):
            out[-2:] = [pair[0] + pair[1]]
    return out


def test_bpe_against_recount(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))): rng.randint(1, 9) for _ in range(60)}
    parts, want = {w: [bytes([b]) for b in w.encode()] for w in words}, []
    for _ in range(20):
        total = {}
        for w, p in parts.items():
            for pair in zip(p, p[1:], strict=False):
                total[pair] = total.get(pair, 0) + words[w]
        if not total:
            break
        want.append(max(total, key=lambda p: (total[p], p)))
        parts = {w: joined(p, want[-1]) for w, p in parts.items()}
    for fragments in (3, 25, 1000):  # what one task may hold changes the rounds, never the merges
        assert bpe_train.train(counts(spark, **words).repartition(3), 256 + 1 + 20, fragments=fragments, block=7).merges == want


def test_bpe_against_one_task(spark, sf):
    """The merges of a whole table, in rounds over bounded fragments, are those of all words in one place."""
    rows = bpe.pretoken_counts(spark.read.parquet(f"{sf}/documents.parquet")).where("octet_length(token) > 1").cache()
    words, symbols, want = bpe_train.Words([list(r.token.encode()) for r in rows.collect()], [r.n for r in rows.collect()]), bpe_train.Symbols(), []
    while len(want) < 1500:
        want += bpe_train.greedy(words, symbols, 1, 1500 - len(want))
        # It ends where a symbol comes about in a second way; the pair is merged here.
        if len(want) < 1500:
            words.merge(want[-1], symbols.merged(want[-1]))
    got = bpe_train.train(rows, 256 + 1 + 1500, fragments=4000, block=1000)
    assert got.merges == [(symbols.bytes[a], symbols.bytes[b]) for a, b in want]


def test_symbols_of_two_ways(spark):
    """abc from ab + c and from a + bc is one symbol, and pairs with it are counted together."""
    words = {"xab": 50, "abc": 9, "ybc": 40, "zabc": 7, "abcd": 6, "bcq": 30, "aabcd": 5, "abq": 20}
    got = {f: bpe_train.train(counts(spark, **words), 300, fragments=f).merges for f in (4, 1000)}
    assert got[4] == got[1000] and len({a + b for a, b in got[4]}) <= len(got[4])


def test_encode_decode(spark):
    df = docs(spark, "Hello  world's <|endoftext|>\n\n12 x", "", None, "é 東京 <|endoftext|><|endoftext|>")
    coder = bpe_train.train(bpe.pretoken_counts(df), 270)
    rows = bpe.encode(df, coder, end=True)
    end = coder.ids[b"<|endoftext|>"]
    ids = {r.doc_id: r.ids for r in rows.collect()}
    assert ids[1] == ids[2] == [end] and ids[0].count(end) == 2 and ids[3].count(end) == 3
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, coder), coder).collect()}
    assert back == {0: "Hello  world's <|endoftext|>\n\n12 x", 1: "", 2: "", 3: "é 東京 <|endoftext|><|endoftext|>"}
    with pytest.raises(Exception, match="unknown token id"):
        bpe.decode(spark.createDataFrame([(1, [99999])], "doc_id long, ids array<int>"), coder).collect()


def test_pretokens(spark):
    import regex

    for text in ("I'll  go\t\tthere, isn't\n\n it? 42 x_y  ", "a\u00a0b \u00a0c\u2003\u2003d\u0085e\u3000!\x1cf é\u0301x", "東京 2\u2028\u2029 3"):
        got = [r.token for r in bpe.pretokens(docs(spark, text)).collect()]
        assert got == regex.findall(PRETOKEN, text)


def test_encoding_against_another_encoder(spark, sf):
    """The ids of all documents by an encoder that shares no code, after the vocabulary was stored and loaded."""
    import tiktoken

    df = spark.read.parquet(f"{sf}/documents.parquet")
    coder = bpe_train.train(bpe.pretoken_counts(df), 2000)
    other = tiktoken.Encoding("other", pat_str=PRETOKEN, mergeable_ranks={t: i for i, t in coder.vocab.items() if t != b"<|endoftext|>"}, special_tokens={"<|endoftext|>": coder.ids[b"<|endoftext|>"]})
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    got = {r.doc_id: r.ids for r in bpe.encode(df, coder).collect()}
    assert got == {i: other.encode(t, allowed_special="all") for i, t in texts.items()}
    assert list(coder.encode_iterable(texts.values())) == [x for t in texts.values() for x in other.encode(t, allowed_special="all")]


def test_stored_tokenizer(spark, tmp_path):
    import pickle

    coder = bpe_train.train(counts(spark, low=5, lower=2, newest=6, widest=3), 270, ["<|endoftext|>", "<x>"])
    bpe.save_tokenizer(spark, coder, str(tmp_path))
    again = bpe.load_tokenizer(spark, str(tmp_path))
    assert (again.vocab, again.merges, sorted(again.specials)) == (coder.vocab, coder.merges, sorted(coder.specials))
    assert bpe.unpickle_tokenizer(pickle.dumps(coder.vocab), pickle.dumps(coder.merges)).encode_token(b"lowest") == coder.encode_token(b"lowest")
    with pytest.raises(pickle.UnpicklingError):
        bpe.unpickle_tokenizer(pickle.dumps(random.Random), pickle.dumps([]))
    # A special token is added only where the vocabulary has none.
    assert bpe.Tokenizer([], ["<a>", "<b>"], {0: b"<a>", 1: b"x"}).vocab == {0: b"<a>", 1: b"x", 2: b"<b>"}
    assert bpe_train.train(counts(spark, low=5, yz=2), 300, min_count=3).merges == [(b"o", b"w"), (b"l", b"ow")]


def test_long_tokens():
    rng = random.Random(0)
    merges = [(b"a", b"b"), (b"ab", b"c"), (b"a", b"a"), (b"aa", b"ab"), (b"b", b"b"), (b"c", b"abc")]
    coder = bpe.Tokenizer(merges)
    for _ in range(200):
        token = bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 200)))
        parts = [coder.byte[b] for b in token]
        assert coder._long(list(parts)) == coder._short(list(parts))
    assert len(coder.encode_token(b"a" * 300_000)) == 150_000


def test_before_each(spark):
    rng = random.Random(1)
    rows = [(rng.choice([rng.randrange(50), rng.randrange(10**7), 10**12 + rng.randrange(99)]), rng.randint(0, 5)) for _ in range(300)]
    want, total = [], 0
    for i, n in sorted(rows):
        want.append((i, n, total))
        total += n
    assert sorted(map(tuple, bpe.before_each(spark.createDataFrame(rows, "id long, n long"), 8).select("id", "n", "before").collect())) == sorted(want)


def test_random_windows(spark):
    rows = spark.createDataFrame([(k, [10 * k + j for j in range(k % 4)]) for k in range(40)], "doc_id long, ids array<int>")
    flat = [10 * k + j for k in range(40) for j in range(k % 4)]
    got = bpe.random_windows(rows, 5, 50, seed=3).collect()
    assert sorted(r.draw for r in got) == list(range(50)) and len({r.start for r in got}) > 20
    assert all(r.x == flat[r.start : r.start + 5] and r.y == flat[r.start + 1 : r.start + 6] for r in got)
    assert max(bpe.random_windows(rows, len(flat) - 1, 3).collect()).start == 0
    assert bpe.random_windows(rows, len(flat), 3).count() == 0


def test_prefix(spark):
    df = spark.createDataFrame([(k, "x" * (k % 5)) for k in range(100, 0, -1)], "doc_id long, text string")
    got = sorted(map(tuple, bpe.prefix(df, 7).collect()))
    assert got == [(1, "x", 0), (2, "xx", 1), (3, "xxx", 3), (4, "xxxx", 6)]


def test_pack(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3]), (5000, [4]), (7, []), (9, [5, 6, 7])], "doc_id long, ids array<int>")
    got = sorted((r.win, r.x, r.y) for r in bpe.pack(rows, 3).collect())
    assert got == [(0, [1, 2, 3], [2, 3, 5]), (1, [5, 6, 7], [6, 7, 4])][: len(got)] and len(got) == 2


def test_power_law_is_found(spark):
    runs = [(n * 10**k, 6.0 * 100 * (n * 10**k) ** 2, 1.0 if n == 2 else 2.0) for k in range(3, 6) for n in (2,)]
    laws = {r.law: r for r in scaling.power_laws(scaling.isoflop_optima(spark.createDataFrame(runs, "parameters long, compute_budget double, final_loss double"))).collect()}
    assert laws["parameters"].exponent == pytest.approx(0.5) and laws["parameters"].exponent + laws["tokens"].exponent == pytest.approx(1)


def test_parametric_fit(spark):
    fit = (1.7, 400.0, 1500.0, 0.34, 0.29)
    rows = [(n, d, fit[0] + fit[1] / n ** fit[3] + fit[2] / d ** fit[4]) for n in (1e7, 1e8, 1e9, 1e10) for d in (1e9, 1e10, 1e11, 1e12)]
    got = scaling.fit_parametric(spark.createDataFrame(rows, "parameters double, tokens double, final_loss double"))
    assert got == pytest.approx(fit, rel=1e-3)


def test_budget_gate(spark):
    calls = [(1, 10.0, 1.0), (2, 50.0, None), (3, 80.0, 1.0), (4, 6.0, 1.0), (5, 1.0, 1.0)]
    got = scaling.budget_gate(spark.createDataFrame(calls, "seq int, cost double, final_loss double"), 100.0).collect()
    assert [(r.seq, r.spent) for r in got] == [(1, 10.0), (2, 10.0), (3, 90.0)]


def test_naive_bayes(spark):
    df = docs(spark, "the cat and the dog", "der hund und die katze", "the dog", "die katze", None)
    labels = spark.createDataFrame([(0, "en"), (1, "de"), (0, None)], "doc_id long, label string")
    got = {r.doc_id: (r.label, r.score) for r in classify.naive_bayes(labels, df).collect()}
    assert got[2][0] == "en" and got[3][0] == "de" and got[4] == ("de", 0.5)
    assert classify.naive_bayes(labels.where("false"), df).where("label is not null").count() == 0


def stored_bytes(spark):
    """What lies in the shared folder."""
    return sum(f.stat().st_size for f in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))


def test_naive_bayes_stores_features_not_occurrences(spark):
    text = " ".join(f"word{i}" for i in range(200))
    df, labels = docs(spark, *[text] * 300), spark.createDataFrame([(0, "x"), (1, "y")], "doc_id long, label string")
    before = stored_bytes(spark)
    assert classify.naive_bayes(labels, df, classify.whole_words).count() == 300
    assert stored_bytes(spark) - before < 300_000


def test_naive_bayes_rare_features_and_repeated_ids(spark, tmp_path):
    """What is not broadcast counts all the same; rows that share an id are one document."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(12)))) for i in [*range(30), 3, 4, 4, None]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(0, 30, 2)], "doc_id long, label string")
    for frame in (df, df.dropDuplicates(["doc_id"]).cache()):
        want, few = ({r.doc_id: (r.label, round(r.score, 9)) for r in classify.naive_bayes(labels, frame, classify.whole_words, most_held=n).collect()} for n in (400_000, 12))
        assert want == few
    spark.createDataFrame(rows[:-1], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(i, i % 3 % 2) for i in range(0, 30, 2)], "doc_id long, quality int").coalesce(1).write.parquet(str(tmp_path / "l"))
    (tables := tmp_path / "t").mkdir()
    for name, part in (("documents", "d"), ("labels", "l")):
        next((tmp_path / part).glob("part-*.parquet")).rename(tables / f"{name}.parquet")
    check(spark, str(tables), QUERIES["quality_nb"], SQL["quality_nb"])


def test_naive_bayes_leaves_the_document_out(spark):
    """The score of a labelled document is what a model trained on all others says."""
    texts = ["aa bb aa", "aa cc", "dd ee dd", "dd cc cc", "aa dd", "zz"]
    labels = [(0, "x"), (1, "x"), (2, "y"), (3, "y"), (4, "y")]
    df = docs(spark, *texts)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, label string")
    got = {r.doc_id: (r.label, r.score) for r in classify.naive_bayes(frame(labels), df, classify.whole_words).collect()}
    for i, _ in labels:
        rest = [(k, y) for k, y in labels if k != i]
        # A word that only the left-out document has stays in the vocabulary: give it to the others' vocabulary as a label of no document.
        words = {w for k, _ in labels for w in texts[k].split()}
        score = {}
        for y in "xy":
            have = [w for k, z in rest if z == y for w in texts[k].split()]
            score[y] = math.log(sum(z == y for _, z in rest) / len(rest)) + sum(math.log((have.count(w) + 1) / (len(have) + len(words))) for w in texts[i].split())
        best = min(score, key=lambda y: (-score[y], y))
        assert got[i][0] == best and got[i][1] == pytest.approx(1 / sum(math.exp(score[y] - score[best]) for y in "xy"))


def test_any_model_may_reject(spark):
    scored = spark.createDataFrame([(1, "1", 0.9), (2, "1", 0.8), (3, "0", 0.99), (4, None, None)], "doc_id long, label string, score double")
    assert sorted(r.doc_id for r in classify.passes(scored, "1", 0.8).collect()) == [2, 3, 4]


def test_adult_content_step(spark, sf):
    from textmill.plans import corpus

    every = corpus.verdicts(spark, sf).select("doc_id")
    adult = every.select("doc_id", F.lit("1").alias("label"), (F.col("doc_id") % 2).cast("double").alias("score"))
    told = corpus.verdicts(spark, sf, adult).where(F.expr(corpus.STEPS["nsfw_passed"]))
    assert told.where("doc_id % 2 = 1").count() == 0 and told.count() == every.where("doc_id % 2 = 0").count()


def _record(kind, body):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://x/\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_warc(spark, tmp_path, packed):
    parts = [_record("warcinfo", b"i"), _record("conversion", "é text\n".encode()), _record("conversion", b"bad \xff"), _record("response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n<p>hi</p>")]
    name = tmp_path / ("a.wet.gz" if packed else "a.wet")
    name.write_bytes(b"".join(map(gzip.compress, parts)) if packed else b"".join(parts))
    assert [r.rec_type for r in warc.read_warc(spark, str(name)).orderBy("rec_no").collect()] == ["warcinfo", "conversion", "conversion", "response"]
    assert [r.text for r in warc.wet_documents(spark, str(name)).orderBy("rec_no").collect()] == ["é text\n", "bad �"]
    assert [r.text for r in warc.wet_documents(spark, str(name), "strict").collect()] == ["é text\n"]
    assert warc.response_pages(spark, str(tmp_path / "*")).first().html == "<p>hi</p>"


@pytest.mark.parametrize("stream", [False, True])
def test_broken_archives(spark, tmp_path, stream):
    good = [_record("conversion", f"text {k}".encode() * 50) for k in range(6)]
    bad = [b"WARC/1.0\r\nWARC-Type: conversion\r\nContent-Length: no\r\n\r\nabc\r\n\r\n", b"WARC/1.0\r\nWARC-Type: conv", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n"]
    name = tmp_path / "a.wet"
    name.write_bytes(good[0] + bad[0] + good[1] + bad[1] + b"\r\n" + good[2] + bad[2] + good[3])
    want = [f"text {k}" * 50 for k in range(4)]
    assert [bytes(r.payload).decode() for r in warc.read_warc(spark, str(name), stream=stream).orderBy("rec_no").collect()] == want
    packed = [gzip.compress(x) for x in good]
    broken = bytearray(packed[1])
    broken[len(broken) // 2] ^= 0xFF
    name = tmp_path / "b.wet.gz"
    name.write_bytes(packed[0] + bytes(broken) + packed[2] + b"junk" + packed[3] + b"\0" * 10 + packed[4] + packed[5][:-9])
    got = [bytes(r.payload).decode() for r in warc.read_warc(spark, str(name), stream=stream).orderBy("rec_no").collect()]
    assert [x for x in got if x in {f"text {k}" * 50 for k in range(6)}][:4] == [f"text {k}" * 50 for k in (0, 2, 3, 4)]


def test_archives_are_linear():
    """Time follows the number of members, and the memory of a reader the size of a record."""
    import io
    import os
    import time
    import tracemalloc

    member = [gzip.compress(_record("conversion", os.urandom(2000) + b"%d" % k)) for k in range(100)]
    took = []
    for n in (200, 5_000, 20_000):
        raw = io.BytesIO(b"".join(member[k % 100] for k in range(n)))
        began = time.perf_counter()
        assert sum(1 for _ in warc.records(raw, ("conversion",))) == n
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[1]
    tracemalloc.start()
    assert sum(1 for _ in warc.records(io.BytesIO(b"".join(member * 50)), ("response",))) == 0
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20


def test_archive_in_ranges(spark, tmp_path):
    """A file is read by many tasks: each record once, in order; what is skipped is what was planted."""
    from pyspark.sql import Observation

    rng = random.Random(5)
    inner = gzip.compress(b"no record " * 50)  # a member's mark within a record
    bodies = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 10, 3000]))) + (inner if k % 7 == 0 else b"") + b"%d" % k for k in range(200)]
    packed = [gzip.compress(_record("conversion" if k % 3 else "response", x)) for k, x in enumerate(bodies)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(packed))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(packed[:50]))
    (tmp_path / "c.warc").write_bytes(b"".join(_record("conversion", x) for x in bodies[:9]))
    for size in (777, 20_000, 1 << 28):
        seen = Observation()
        got = sorted(warc.read_warc(spark, str(tmp_path / "*"), size=size, lost=seen).collect(), key=lambda r: (r.file, r.rec_no))
        assert [bytes(r.payload) for r in got] == bodies + bodies[:50] + bodies[:9]
        assert seen.get == {"records": 259, "lost": 0}
        assert len({(r.file, r.rec_no) for r in got}) == 259
    assert warc.read_warc(spark, str(tmp_path / "*"), size=777).rdd.getNumPartitions() > 100
    assert warc.read_warc(spark, str(tmp_path / "a.warc.gz"), ("response",), size=5000).count() == 67

    broken = [bytearray(x) for x in packed[:40]]
    for k in (4, 17, 30):
        broken[k][len(broken[k]) // 2] ^= 0xFF
    (tmp_path / "d.wet.gz").write_bytes(b"".join(map(bytes, broken)) + gzip.compress(b"WARC/1.0\r\nWARC-Type: conversion\r\nContent-Length: x\r\n\r\n") + gzip.compress(_record("conversion", b"good")) + gzip.compress(_record("conversion", b"bad \xff")))
    for size in (600, 1 << 28):
        seen, bad = Observation(), Observation()
        got = sorted(warc.read_warc(spark, str(tmp_path / "d.wet.gz"), size=size, lost=seen).collect(), key=lambda r: r.rec_no)
        assert [bytes(r.payload) for r in got] == [x for k, x in enumerate(bodies[:40]) if k not in (4, 17, 30)] + [b"good", b"bad \xff"]
        assert seen.get == {"records": 39, "lost": 4}
        assert warc.wet_documents(spark, str(tmp_path / "d.wet.gz"), "strict", bad=bad).where("text = 'good'").count() == 1
        assert bad.get["undecodable"] >= 1


def test_committed_files(spark, tmp_path):
    """All files of a write appear or none: a task that fails and runs again leaves no trace, an error leaves the folder as it was."""
    from textmill.sources.sink import write_files

    def names():
        return sorted(str(f.relative_to(tmp_path / "out")) for f in (tmp_path / "out").rglob("*") if f.is_file() and f.name != "_SUCCESS" and "_temporary" not in str(f))

    rows = spark.createDataFrame([(f"f{k % 7}", k, str(k)) for k in range(100)], "name string, k int, content string")
    write_files(rows.repartition(5, "name").sortWithinPartitions("name", "k"), str(tmp_path / "out"))
    assert names() == [f"f{k}" for k in range(7)]
    assert (tmp_path / "out" / "f3").read_text() == "".join(str(k) for k in range(100) if k % 7 == 3)
    # Fewer files, one of them in a folder: nothing of the first write is left.
    write_files(rows.where("k < 2").withColumn("name", F.concat(F.lit("x/"), "name")).coalesce(1), str(tmp_path / "out"))
    assert names() == ["x/f0", "x/f1"]
    failing = rows.repartition(5, "name").sortWithinPartitions("name", "k").withColumn("content", F.when(F.col("k") == 99, F.raise_error(F.lit("killed"))).otherwise(F.col("content")))
    for bad, match in ((failing, "killed"), (rows.coalesce(1), "lie together"), (rows.limit(1).withColumn("name", F.lit("../up")), "no name"), (rows.sortWithinPartitions("name").repartition(3), "together|same name")):
        with pytest.raises(Exception, match=match):
            write_files(bad, str(tmp_path / "out"))
        assert names() == ["x/f0", "x/f1"]
    # What tasks wrote after their job was given up is never seen, and the next write deletes it.
    write_files(rows.coalesce(1).sortWithinPartitions("name", "k"), str(tmp_path / "out"))
    assert names() == [f"f{k}" for k in range(7)] and not list((tmp_path / "out").glob("_temporary*"))


def test_attempts_leave_no_files(tmp_path):
    """An attempt that is run twice writes twice; only what is committed gets a name."""
    import pyarrow as pa

    from textmill.sources.sink import _Writer

    writer = _Writer(str(tmp_path / "out"), "run")
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", "b"]), pa.array([b"1", b"2", None], pa.binary())], names=["name", "content"])
    writer.write(iter([batch]))  # an attempt whose executor was lost
    writer.commit([writer.write(iter([batch])), None, writer.write(iter([]))])
    assert {f.name: f.read_bytes() for f in (tmp_path / "out").iterdir() if f.name != "_SUCCESS"} == {"a": b"12", "b": b""}


def test_one_output_for_each_input(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / f"{name}.wet").write_bytes(b"".join(_record("conversion", f" {name} {k}\n".encode()) for k in range(30)))
    files.write_by_file(warc.wet_documents(spark, str(tmp_path / "*.wet")).where("rec_no % 2 = 0"), str(tmp_path / "out"), (".wet", ".txt"))
    got = {f.name: f.read_text() for f in (tmp_path / "out").iterdir() if f.suffix == ".txt"}
    assert got == {f"{n}.txt": "".join(f"{n} {k}\n\n" for k in range(0, 30, 2)) for n in ("one", "two")}


def test_token_sink(spark, tmp_path):
    rows = spark.createDataFrame([(k, [k, 65535]) for k in range(50)] + [(99, [])], "doc_id long, ids array<int>").repartitionByRange(3, "doc_id")
    told = files.write_token_file(rows, str(tmp_path / "t")).collect()
    assert sum(r.n_tokens for r in told) == 100 and len(told) == 3
    back = files.read_token_files(spark, str(tmp_path / "t" / "tokens-*")).orderBy("file", "start").collect()
    assert [x for r in back for x in r.ids] == [x for k in range(50) for x in (k, 65535)]
    with pytest.raises(Exception, match="out of range"):
        files.write_token_file(spark.createDataFrame([(1, [65536])], "doc_id long, ids array<int>"), str(tmp_path / "t"))
    # The failed write left all as it was; one with fewer partitions leaves no old file.
    assert files.read_token_files(spark, str(tmp_path / "t" / "tokens-*")).agg(F.sum(F.size("ids"))).first()[0] == 100
    assert files.write_token_file(rows.coalesce(1), str(tmp_path / "t")).count() == 1
    assert files.read_token_files(spark, str(tmp_path / "t" / "tokens-*")).agg(F.sum(F.size("ids"))).first()[0] == 100


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", " a\nb "), (2, "t", "c")], "doc_id long, source string, text string")
    files.write_documents(df, str(tmp_path / "d"))
    assert sorted(r.text for r in files.read_files(spark, str(tmp_path / "d" / "*")).collect()) == ["a\nb\n\n", "c\n\n"]
    files.write_delimited(df, str(tmp_path / "e"))
    assert sorted(r.text for r in files.read_delimited(spark, str(tmp_path / "e")).collect()) == [" a\nb ", "c"]
    files.write_training_lines(df.select(F.lit("hq").alias("label"), F.lit("x").alias("text")).limit(1), str(tmp_path / "f"))
    assert files.read_lines(spark, str(tmp_path / "f")).first().line == "__label__hq x"
    files.write_tokens(spark.createDataFrame([(1, [65535])], "doc_id long, ids array<int>"), str(tmp_path / "g"))
    with pytest.raises(Exception, match="out of range"):
        files.write_tokens(spark.createDataFrame([(1, [65536])], "doc_id long, ids array<int>"), str(tmp_path / "h"))
    (tmp_path / "r.json").write_text('[{"parameters": 5, "compute_budget": 1e3, "final_loss": 2.5}]')
    assert files.read_runs(spark, str(tmp_path / "r.json")).first() == (5, 1000.0, 2.5)
    row = spark.range(1).select(files.base_name(F.lit("/a/b.wet")), files.with_suffix(F.lit("/a/b.wet"), ".wet", ".txt")).first()
    assert tuple(row) == ("b.wet", "/a/b.txt")


def test_token_files(spark, tmp_path):
    import numpy as np

    ids = np.arange(70_000, dtype="<u2")
    np.save(tmp_path / "a.npy", ids)
    (tmp_path / "b.bin").write_bytes(ids.tobytes())
    for name in ("a.npy", "b.bin"):
        rows = files.read_token_files(spark, str(tmp_path / name), chunk=30_000).orderBy("start").collect()
        assert [x for r in rows for x in r.ids] == ids.tolist() and [r.start for r in rows] == [0, 30_000, 60_000]
        many = files.read_token_files(spark, str(tmp_path / name), chunk=9_000, size=10_001)
        assert many.select(F.spark_partition_id()).distinct().count() >= 14
        rows = many.orderBy("start").collect()
        assert [x for r in rows for x in r.ids] == ids.tolist() and all(ids[r.start] == r.ids[0] for r in rows)


def test_streams(spark, tmp_path):
    good = "the quick brown fox jumps over lazy dogs " * 10
    rows = [(1, good, "2024-01-01 00:00:00"), (2, good, "2024-01-01 00:01:00"), (3, "too short", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id long, text string, at string").select("doc_id", "text", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = curation.curate_stream(spark.readStream.schema("doc_id long, text string, ts timestamp").parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("curated").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("curated").count() == 1


def test_registered_vocabulary_is_the_references(spark, tmp_path):
    from textmill.plans import tokens

    words = [" ".join(f"{a}{b}{c}" for c in "abcdefghij") for a in "klmnopqrst" for b in "uvwxyzabcd"]
    spark.createDataFrame(list(enumerate(words)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    # Every pair that is left is merged: each distinct word is one token in the end.
    assert tokens.VOCABULARY == 10_000
    assert tokens.bpe_merges(spark, str(tmp_path)).count() > 1000
    assert {r.n_tokens for r in tokens.bpe_encode(spark, str(tmp_path)).collect()} == {11}


def test_broken_records_are_skipped():
    import gzip

    from textmill.sources.warc import records

    def record(body, length=None):
        return b"WARC/1.0\r\nWARC-Type: x\r\n" + (f"Content-Length: {len(body)}".encode() if length is None else length) + b"\r\n\r\n" + body + b"\r\n\r\n"

    for bad in (record(b"bad", b"Content-Length: no"), record(b"bad", b"X: y"), record(b"bad", b"Content-Length: -9"), b"WARC/1.0\r\nWARC-Type: x\r\n"):
        assert [r[3] for r in records(bad + record(b"one") + bad + record(b"two"))] == [b"one", b"two"]
    members = [bytearray(gzip.compress(record(b * 200))) for b in (b"a", b"b", b"c")]
    for broken in range(2):
        data = [bytes(m) for m in members]
        data[broken] = data[broken][:-8] + b"\0" * 8
        assert [r[3][:1] for r in records(b"".join(data))] == [b for k, b in enumerate((b"a", b"b", b"c")) if k != broken]


def test_spread(spark, tmp_path):
    """A table of one row group is read by one task, and its rows are dealt over all cores then."""
    from textmill.session import spread

    path = str(tmp_path / "one")
    spark.range(400_000).selectExpr("id", "sha2(cast(id AS string), 256) AS text").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    rows = spread(df).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) == spark.sparkContext.defaultParallelism and min(r["count"] for r in rows) > 50_000
    assert spread(df, least=1 << 40) is df and spread(df, group=1 << 20) is df


def test_empty_sets_have_no_signature(spark):
    sets = spark.createDataFrame([(1, ["a b"]), (2, []), (3, None), (4, ["a b", "c"])], "doc_id long, grams array<string>")
    assert sorted(r.doc_id for r in dedup.minhash(sets, 16).collect()) == [1, 4]


def test_curation_with_an_adult_model(spark, sf, tmp_path):
    """The step for adult content takes a stored model: documents that it knows go, whatever else is said of them."""
    from textmill.operators import models
    from textmill.plans import corpus

    kept = {r.doc_id for r in corpus.curation(spark, sf).collect()}
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    some = sorted(kept)[::3]
    rows = docs_.select("doc_id", "text", F.col("doc_id").isin(some).cast("int").alias("label"))
    models.save_model(spark, models.train_bag(rows, buckets=20_000, dim=16, epochs=5, rate=1.0, shards=1, passes=20), str(tmp_path / "adult"))
    scored = corpus.stored_verdicts(spark, sf, str(tmp_path / "adult")).where("adult_label = '1' and adult_score > 0.8")
    gone = {r.doc_id for r in scored.collect()}
    left = {r.doc_id for r in corpus.curation(spark, sf, str(tmp_path / "adult")).collect()}
    assert len(gone & set(some)) > len(some) / 2 and not left & gone
