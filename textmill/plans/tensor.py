"""Array and window algebra over ``embeddings``: what of a language model is relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.functions import vector as V
from textmill.session import table

QUERIES: dict = {}
SQL: dict = {}

#: Rows of a sequence: vectors with consecutive ids.
LENGTH = 16


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("x"))


_X = "(SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"


def _summary(x: Column) -> list[Column]:
    """A vector's check: its plain and its weighted sum, rounded."""
    weighted = F.aggregate(F.transform(x, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return [F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(weighted, 6).alias("weighted")]


_SUMMARY = "round(list_sum(y), 6) AS total, round(list_sum(list_transform(y, lambda v, i: v * i)), 6) AS weighted"


def _vector(name: str, fn, sql: str, doc: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return vectors(spark, sf_dir).select("vec_id", fn(F.col("x")).alias("y")).select("vec_id", *_summary(F.col("y")))

    query.__doc__ = doc
    QUERIES[name] = query
    SQL[name] = f"SELECT vec_id, {_SUMMARY} FROM (SELECT vec_id, {sql} AS y FROM {_X})"


_EXP = "list_transform(x, lambda v: exp(v - list_max(x)))"
_vector("softmax", V.softmax, f"list_transform({_EXP}, lambda e: e / list_sum({_EXP}))", "Softmax of each vector (WN3, NN6).")
_vector("rms_norm", V.rms_norm, "list_transform(x, lambda v: v / sqrt(list_sum(list_transform(x, lambda u: u * u)) / len(x) + 1e-5))", "Root-mean-square norm (NN3).")
_vector("swiglu", lambda x: V.swiglu(F.slice(x, 1, 32), F.slice(x, 33, 32)), "list_transform(range(1, 33), lambda i: x[i] / (1 + exp(-x[i])) * x[i + 32])", "Gated activation of two halves (NN4).")
_ANGLE = "((vec_id % 16) / pow(10000.0::DOUBLE, 2.0::DOUBLE * k / len(x)))"


def rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotary positions within each sequence (NN5, JN14)."""
    return vectors(spark, sf_dir).select("vec_id", V.rope(F.col("x"), F.col("vec_id") % LENGTH).alias("y")).select("vec_id", *_summary(F.col("y")))


QUERIES["rope"] = rope
SQL["rope"] = f"""SELECT vec_id, {_SUMMARY} FROM (SELECT vec_id, flatten(list_transform(range(0, len(x) // 2), lambda k:
  [x[2 * k + 1] * cos({_ANGLE}) - x[2 * k + 2] * sin({_ANGLE}), x[2 * k + 1] * sin({_ANGLE}) + x[2 * k + 2] * cos({_ANGLE})])) AS y FROM {_X})"""


def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss, perplexity and largest log-sum-exp by label (AG18, AG20, NN11, JN12)."""
    rows = vectors(spark, sf_dir).select("label", V.cross_entropy(F.col("x"), F.pmod("label", F.size("x"))).alias("loss"), V.log_sum_exp(F.col("x")).alias("lse"))
    return rows.groupBy("label").agg(F.round(F.avg("loss"), 6).alias("loss"), F.round(F.exp(F.avg("loss")), 4).alias("perplexity"), F.round(F.max("lse"), 6).alias("largest"))


_LSE = "(list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))))"
QUERIES["cross_entropy"] = cross_entropy
SQL["cross_entropy"] = f"SELECT label, round(avg(l), 6) AS loss, round(exp(avg(l)), 4) AS perplexity, round(max(lse), 6) AS largest FROM (SELECT label, {_LSE} AS lse, {_LSE} - x[label % len(x) + 1] AS l FROM {_X}) GROUP BY label"


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, token, p``: each vector as the logits of a vocabulary, softmaxed in long form."""
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(V.softmax(F.col("x"))).alias("token", "p"))


_LONG = f"(SELECT vec_id, unnest(range(0, len(y))) AS token, unnest(y) AS p FROM (SELECT vec_id, list_transform({_EXP}, lambda e: e / list_sum({_EXP})) AS y FROM {_X}))"


def top_p(tokens: DataFrame, p: float) -> DataFrame:
    """Nucleus: the likeliest tokens while the mass before them is at most p, renormalised."""
    order = Window.partitionBy("vec_id").orderBy(F.col("p").desc(), "token")
    before = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    kept = tokens.withColumn("before", before).where(F.col("before") <= p)
    return kept.withColumn("q", F.col("p") / F.sum("p").over(Window.partitionBy("vec_id")))


def top_p_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and weight of each nucleus, and the token a fixed draw takes from it (WN4, SO7, NN15)."""
    kept = top_p(_tokens(spark, sf_dir), 0.7)
    order = Window.partitionBy("vec_id").orderBy(F.col("p").desc(), "token").rowsBetween(Window.unboundedPreceding, 0)
    drawn = kept.withColumn("upto", F.sum("q").over(order))
    return drawn.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.sum("p"), 6).alias("mass"), F.min_by("token", F.when(F.col("upto") >= 0.37, F.col("upto"))).cast("long").alias("drawn"))


QUERIES["top_p_filter"] = top_p_filter
SQL["top_p_filter"] = f"""WITH b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {_LONG}),
  k AS (SELECT *, p / sum(p) OVER (PARTITION BY vec_id) AS q FROM b WHERE before <= 0.7), u AS (SELECT *, sum(q) OVER (PARTITION BY vec_id ORDER BY p DESC, token ROWS UNBOUNDED PRECEDING) AS upto FROM k)
  SELECT vec_id, count(*) AS n, round(sum(p), 6) AS mass, arg_min(token, upto) FILTER (WHERE upto >= 0.37)::BIGINT AS drawn FROM u GROUP BY vec_id"""


def top_k_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest tokens of each vector, renormalised (WN5; the cut takes effect)."""
    rank = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.col("p").desc(), "token"))
    kept = _tokens(spark, sf_dir).withColumn("rank", rank).where("rank <= 5")
    return kept.select("vec_id", F.col("token").cast("long").alias("token"), F.col("rank").cast("long").alias("rank"), F.round(F.col("p") / F.sum("p").over(Window.partitionBy("vec_id")), 6).alias("q"))


QUERIES["top_k_filter"] = top_k_filter
SQL["top_k_filter"] = f"SELECT vec_id, token::BIGINT AS token, rank, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS q FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, token) AS rank FROM {_LONG}) WHERE rank <= 5"


def causal_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled dot-product attention in sequences of 16 vectors, keys up to the query (NN7, JN13, D24).

    The causal mask is the inequality of a join within a sequence, so it is an
    equi-join on the sequence and its cost is fixed by the sequence's length.
    """
    rows = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / LENGTH).alias("seq"), (F.col("vec_id") % LENGTH).alias("pos"), "vec_id", "x")
    q, k = rows.select("seq", "vec_id", F.col("pos").alias("at"), F.col("x").alias("q")), rows.select("seq", "pos", F.col("x").alias("k"))
    scored = q.join(k, "seq").where("pos <= at").select("vec_id", "k", (V.dot(F.col("q"), F.col("k")) / F.sqrt(F.size("q"))).alias("s"))
    by = Window.partitionBy("vec_id")
    weight = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(by))).withColumn("a", F.col("e") / F.sum("e").over(by))
    out = weight.select("vec_id", F.posexplode(F.transform("k", lambda v: v * F.col("a"))).alias("i", "v"))
    return out.groupBy("vec_id").agg(F.round(F.sum("v"), 5).alias("total"), F.round(F.sum(F.col("v") * (F.col("i") + 1)), 5).alias("weighted"))


QUERIES["causal_attention"] = causal_attention
SQL["causal_attention"] = f"""WITH r AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, vec_id, x FROM {_X}),
  s AS (SELECT q.vec_id, k.x AS k, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * k.x[i])) / sqrt(len(q.x)) AS s FROM r q JOIN r k ON q.seq = k.seq AND k.pos <= q.pos),
  e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s), a AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS a FROM e)
  SELECT vec_id, round(sum(a * list_sum(k)), 5) AS total, round(sum(a * list_sum(list_transform(k, lambda v, i: v * i))), 5) AS weighted FROM a GROUP BY vec_id"""


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The learning rate of each vector, if it is the step of its id (NN13)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("step"), F.round(V.learning_rate(F.col("vec_id"), 1e-3, 1e-4, 20, 150), 12).alias("rate"))


QUERIES["lr_schedule"] = lr_schedule
SQL["lr_schedule"] = """SELECT step, round(CASE WHEN step < 20 THEN 0.001::DOUBLE * step / 20 WHEN step <= 150 THEN 0.0001::DOUBLE + 0.5::DOUBLE * (0.001::DOUBLE - 0.0001::DOUBLE) * (1 + cos((step - 20) / 130.0::DOUBLE * pi())) ELSE 0.0001::DOUBLE END, 12) AS rate
  FROM (SELECT vec_id AS step FROM embeddings)"""


def adamw_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One optimiser step on clipped gradients: the first vector components are weights, the next ones gradients (NN12, NN14, AG19)."""
    rows = vectors(spark, sf_dir).select("vec_id", F.get("x", F.lit(0)).alias("w"), F.get("x", F.lit(1)).alias("g"))
    norm = rows.agg(F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("norm")).first()["norm"]
    rows = rows.withColumn("g", F.col("g") * V.clip_scale(F.lit(norm).cast("double"), 1.0))
    new = V.adamw(F.col("w"), F.lit(0.0), F.lit(0.0), F.col("g"), F.lit(1.0), 1e-3)
    return rows.select("vec_id", *[F.round(c, 9).alias(k) for k, c in new.items()])


QUERIES["adamw_step"] = adamw_step
SQL["adamw_step"] = f"""WITH n AS (SELECT sqrt(sum(x[2] * x[2])) AS norm FROM {_X}), r AS (SELECT vec_id, x[1] AS w, x[2] * CASE WHEN norm > 1 THEN 1.0::DOUBLE / (norm + 1e-6) ELSE 1 END AS g FROM {_X}, n),
  s AS (SELECT *, (1 - 0.9::DOUBLE) * g AS m, (1 - 0.95::DOUBLE) * g * g AS v FROM r)
  SELECT vec_id, round((w - 0.001::DOUBLE * sqrt(1 - 0.95::DOUBLE) / (1 - 0.9::DOUBLE) * m / (sqrt(v) + 1e-8)) * (1 - 0.001::DOUBLE * 0.01::DOUBLE), 9) AS w, round(m, 9) AS m, round(v, 9) AS v FROM s"""


def linear_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector through a fixed matrix of four rows (NN1, NN2, JN11)."""
    def row(r: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: ((i * r) % 7).cast("double"))

    rows = F.array(*[row(r) for r in range(1, 5)])
    return vectors(spark, sf_dir).select("vec_id", V.matvec(rows, F.col("x")).alias("y")).select("vec_id", *_summary(F.col("y")))


QUERIES["linear_layer"] = linear_layer
SQL["linear_layer"] = f"SELECT vec_id, {_SUMMARY} FROM (SELECT vec_id, list_transform(range(1, 5), lambda r: list_sum(list_transform(x, lambda v, i: v * ((i * r) % 7)))) AS y FROM {_X})"


def timing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and median by event type, the shape of a benchmark report (AG16, AG17, CP19)."""
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("deviation"), F.round(F.median("value"), 6).alias("middle"), F.count("value").alias("n"))


QUERIES["timing_stats"] = timing_stats
SQL["timing_stats"] = "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, round(median(value), 6) AS middle, count(value) AS n FROM events GROUP BY event_type"


def parameter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters of models as wide as the vectors and with a layer for each label up to one, with a token for each vector (AG21)."""
    rows = table(spark, sf_dir, "embeddings").agg(F.max("label").alias("most"), F.max(F.size("embedding")).cast("long").alias("d"), F.count("*").alias("tokens"))
    shape = rows.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("most").cast("long") + 1)).alias("layers"), "d", "tokens")
    own = 12 * F.col("layers") * F.col("d") * F.col("d")
    return shape.select("layers", own.alias("without"), (own + 2 * F.col("tokens") * F.col("d")).alias("with_embeddings"))


QUERIES["parameter_count"] = parameter_count
SQL["parameter_count"] = "SELECT layers, 12 * layers * d * d AS without, 12 * layers * d * d + 2 * tokens * d AS with_embeddings FROM (SELECT unnest(range(1, max(label) + 2))::BIGINT AS layers, max(len(embedding))::BIGINT AS d, count(*) AS tokens FROM embeddings)"


def online_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-sum-exp of each vector by tiles (WN9)."""
    return vectors(spark, sf_dir).select("vec_id", F.round(V.online_lse(F.col("x")), 6).alias("lse"))


QUERIES["online_softmax"] = online_softmax
SQL["online_softmax"] = f"SELECT vec_id, round({_LSE}, 6) AS lse FROM {_X}"

HEADS = 4


def multi_head_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Causal attention of four heads with rotary queries and keys; heads are rows until they are joined again (NN8)."""
    size = 64 // HEADS
    rows = vectors(spark, sf_dir).select(F.floor(F.col("vec_id") / LENGTH).alias("seq"), (F.col("vec_id") % LENGTH).alias("pos"), "vec_id", F.posexplode(F.array(*[F.slice("x", h * size + 1, size) for h in range(HEADS)])).alias("head", "v"))
    rows = rows.withColumn("r", V.rope(F.col("v"), F.col("pos")))
    q, k = rows.select("seq", "head", "vec_id", F.col("pos").alias("at"), F.col("r").alias("q")), rows.select("seq", "head", "pos", F.col("r").alias("k"), "v")
    scored = q.join(k, ["seq", "head"]).where("pos <= at").select("vec_id", "head", "v", (V.dot(F.col("q"), F.col("k")) / F.sqrt(F.lit(float(size)))).alias("s"))
    by = Window.partitionBy("vec_id", "head")
    weight = scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(by))).withColumn("a", F.col("e") / F.sum("e").over(by))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return weight.groupBy("vec_id").agg(F.round(F.sum(F.col("a") * total), 5).alias("total"), F.round(F.sum(F.col("a") * total * (F.col("head") + 1)), 5).alias("by_head"))


_HEAD_ANGLE = "(pos / pow(10000.0::DOUBLE, 2.0::DOUBLE * k / 16))"
QUERIES["multi_head_attention"] = multi_head_attention
SQL["multi_head_attention"] = f"""WITH h AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, vec_id, head, x[head * 16 + 1 : head * 16 + 16] AS v FROM {_X}, (SELECT unnest(range(0, 4)) AS head)),
  r AS (SELECT *, flatten(list_transform(range(0, 8), lambda k: [v[2 * k + 1] * cos({_HEAD_ANGLE}) - v[2 * k + 2] * sin({_HEAD_ANGLE}), v[2 * k + 1] * sin({_HEAD_ANGLE}) + v[2 * k + 2] * cos({_HEAD_ANGLE})])) AS r FROM h),
  s AS (SELECT q.vec_id, q.head, k.v, list_sum(list_transform(range(1, 17), lambda i: q.r[i] * k.r[i])) / 4 AS s FROM r q JOIN r k ON q.seq = k.seq AND q.head = k.head AND k.pos <= q.pos),
  e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id, head)) AS e FROM s), a AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, head) AS a FROM e)
  SELECT vec_id, round(sum(a * list_sum(v)), 5) AS total, round(sum(a * list_sum(v) * (head + 1)), 5) AS by_head FROM a GROUP BY vec_id"""
