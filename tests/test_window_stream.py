"""Windows of a stream: the same as those of all documents at once, also after a restart from the checkpoint."""

import random

from pyspark.sql import functions as F

from textmill.operators import bpe
from textmill.streaming.windows import window_stream

SHARDS, LENGTH = 3, 7


def test_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "quick", "brown", "fox", "é"]) for _ in range(rng.randint(0, 12))) or None, f"2024-01-01 00:{i:02d}:00") for i in range(40)]
    coder = bpe.Tokenizer([(b"t", b"h"), (b"th", b"e"), (b"o", b"x")])
    df = spark.createDataFrame(rows, "doc_id long, text string, at string").select("doc_id", "text", F.to_timestamp("at").alias("ts"))

    def put(low, high):
        df.where(F.col("doc_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = window_stream(stream, coder, LENGTH, SHARDS).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    put(0, 9)
    run()
    put(9, 11)
    put(11, 40)
    run()
    got = {(r.shard, r.win): (r.x, r.y) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    shard = {r.doc_id: r.s for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int").alias("s")).collect()}
    want = {}
    for s in range(SHARDS):
        ids = [x for i, t, _ in rows if shard[i] == s for x in [*coder.encode_cut(coder.cut(t or "")), coder.ids[b"<|endoftext|>"]]]
        for k in range((len(ids) - 1) // LENGTH):
            want[s, k] = (ids[k * LENGTH : (k + 1) * LENGTH], ids[k * LENGTH + 1 : (k + 1) * LENGTH + 1])
    assert got == want and len(want) > 20
