"""Training windows of an unbounded input: encoded as it comes, what does not fill a window waits for the next batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.operators.bpe import Tokenizer, encode


def _step(length: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        """The windows that the rows of a batch fill, after what is left of the batches before."""
        done, left = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values(["ts", "doc_id"], na_position="first", kind="stable")
        ids = np.concatenate([np.array(left, np.int32), *(np.asarray(x, np.int32) for x in rows["ids"])])
        # A window has one id more than its inputs: the last target, which is the first input of the next.
        full = max(0, (len(ids) - 1) // length)
        state.update((done + full, ids[full * length :].tolist()))
        if full:
            parts = [ids[k * length : (k + 1) * length + 1] for k in range(full)]
            yield pd.DataFrame({"shard": key[0], "win": range(done, done + full), "x": [p[:-1] for p in parts], "y": [p[1:] for p in parts]})

    return run


def window_stream(docs: DataFrame, tokenizer: Tokenizer, length: int, shards: int = 8) -> DataFrame:
    """``shard, win, x, y``: windows of ``length`` ids over the documents of each shard, in the order in which they come; y is x shifted by one.

    ``docs`` is a stream (or a table) with ``doc_id, text, ts``; a batch is ordered by ``ts`` and id. Documents end
    with the end-of-text id and are dealt to ``shards`` by a hash of their id, so that no source is one task. Each shard keeps
    one window's ids at most between batches, in the state store: a query that is restarted from its checkpoint goes on where it was.
    """
    ids = encode(docs.select(F.struct("doc_id", "ts").alias("key"), "text"), tokenizer, id_col="key", end=True).withColumnRenamed("doc_id", "key")
    rows = ids.select(F.pmod(F.xxhash64("key.doc_id"), F.lit(shards)).cast("int").alias("shard"), "key.doc_id", "key.ts", "ids")
    return rows.groupBy("shard").applyInPandasWithState(_step(length), "shard int, win long, x array<int>, y array<int>", "done long, left array<int>", "append", "NoTimeout")
