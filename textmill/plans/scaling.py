"""Queries over compute scaling, on runs that Spark makes of the documents.

A run is a model of word frequencies with a vocabulary of so many words, trained on a nested
share of the documents, with its loss on all of them: the loss falls with both, and a budget is their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.text import words
from textmill.operators import scaling as S
from textmill.plans.text import WORDS
from textmill.session import settle, table

QUERIES: dict = {}
SQL: dict = {}

#: The surface that runs are compared with; sizes of vocabularies; shares of the documents, halved so many times.
SURFACE = (1.7, 400.0, 1500.0, 0.34, 0.29)
SIZES, SHARES = tuple(1 << k for k in range(6, 14)), 6


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``parameters, compute_budget, final_loss`` of a run for each vocabulary and each share of the documents.

    The loss is in nats a word, with add-one smoothing; a word outside of the vocabulary is drawn evenly
    from all such. Words are counted once, for all shares at a time. The budget is that of the
    nominal share, so that runs of different sizes have the same.
    """
    mark = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    said = table(spark, sf_dir, "documents").select(mark.alias("h"), F.explode(words(F.col("text"))).alias("w"))
    counts = settle(said.groupBy("w").agg(*[F.count_if(F.col("h") < (1 << 32 - k)).alias(f"n{k}") for k in range(SHARES)]))
    every = counts.agg(F.array(*[F.sum(f"n{k}") for k in range(SHARES)]).alias("every"), F.count("*").alias("kinds"))
    top = counts.orderBy(F.desc("n0"), "w").limit(max(SIZES))
    # From here on there are as many rows as the largest vocabulary has, for all documents.
    ranked = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n0")).alias("o"), "w", F.array(*[f"n{k}" for k in range(SHARES)]).alias("n")))), lambda x: x["n"]).alias("top"))
    grid = spark.range(len(SIZES) * SHARES).select(F.element_at(F.array(*[F.lit(v) for v in SIZES]), (F.col("id") / SHARES).cast("int") + 1).cast("long").alias("v"), (F.col("id") % SHARES).cast("int").alias("k"))
    known = grid.join(F.broadcast(ranked)).join(F.broadcast(every)).withColumn("top", F.slice("top", F.lit(1), F.col("v").cast("int")))

    def total(term) -> F.Column:
        return F.aggregate("top", F.lit(0).cast("double"), lambda a, n: a + term(n))

    share = F.get("every", F.col("k"))
    size = (share + F.col("v") + 1).cast("double")
    told = total(lambda n: n[0] * F.ln((F.get(n, F.col("k")) + 1) / size))
    rest, rest_seen = F.get("every", F.lit(0)) - total(lambda n: n[0]), share - total(lambda n: F.get(n, F.col("k")))
    lost = rest * (F.ln((rest_seen + 1) / size) - F.ln(F.greatest(F.col("kinds") - F.col("v"), F.lit(1))))
    loss = F.round(-(told + lost) / F.get("every", F.lit(0)), 6)
    made = known.select(F.col("v").alias("parameters"), (6.0 * F.col("v") * F.get("every", F.lit(0)) / F.pow(F.lit(2.0), "k")).alias("compute_budget"), loss.alias("final_loss"))
    return settle(made.where("compute_budget is not null"))


_N = ", ".join(f"count(*) FILTER (WHERE h < {1 << 32 - k})" for k in range(SHARES))
_VALUES = f"""(WITH w AS (SELECT unnest({WORDS}) AS w, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents),
  c AS MATERIALIZED (SELECT w, [{_N}] AS n FROM w GROUP BY w),
  t AS (SELECT [{", ".join(f"sum(n[{k + 1}])::BIGINT" for k in range(SHARES))}] AS every_, count(*) AS kinds FROM c),
  r AS MATERIALIZED (SELECT n, row_number() OVER (ORDER BY n[1] DESC, w) AS r FROM c ORDER BY n[1] DESC, w LIMIT {max(SIZES)}),
  g AS (SELECT v, k FROM (SELECT unnest({list(SIZES)}) AS v), (SELECT unnest(range({SHARES})) AS k)),
  s AS (SELECT v, k, every_, kinds, (every_[k + 1] + v + 1)::DOUBLE AS size, sum(n[1]) AS n0, sum(n[k + 1]) AS nk, sum(n[1] * ln((n[k + 1] + 1) / (every_[k + 1] + v + 1)::DOUBLE)) AS told FROM g, t, r WHERE r <= v GROUP BY ALL)
  SELECT v::BIGINT AS parameters, 6.0::DOUBLE * v * every_[1] / pow(2.0::DOUBLE, k) AS compute_budget,
    round(-(told + (every_[1] - n0) * (ln((every_[k + 1] - nk + 1) / size) - ln(greatest(kinds - v, 1)))) / every_[1], 6) AS final_loss FROM s)"""


def training_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs, with the tokens of each (SC12)."""
    return runs(spark, sf_dir).withColumn("tokens", S.training_tokens(F.col("compute_budget"), F.col("parameters")))


QUERIES["training_runs"] = training_runs
SQL["training_runs"] = f"SELECT *, compute_budget / (6 * parameters) AS tokens FROM {_VALUES}"


def _rounded(name: str, digits: int = 6) -> F.Column:
    return F.round(name, digits).alias(name)


def isoflop_optima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best run of each budget (AG10, SC12, SO1)."""
    return S.isoflop_optima(runs(spark, sf_dir)).select("compute_budget", "parameters", "final_loss", F.round(F.ln("tokens"), 9).alias("log_tokens"))


_OPTIMA = f"SELECT compute_budget, arg_min(parameters, (final_loss, parameters)) AS parameters, min(final_loss) AS final_loss FROM {_VALUES} GROUP BY compute_budget"
QUERIES["isoflop_optima"] = isoflop_optima
SQL["isoflop_optima"] = f"SELECT *, round(ln(compute_budget / (6 * parameters)), 9) AS log_tokens FROM ({_OPTIMA})"


def scaling_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power laws of the optima and the sum of their exponents (AG11, CP12)."""
    laws = S.power_laws(S.isoflop_optima(runs(spark, sf_dir)))
    return laws.select("law", _rounded("factor"), _rounded("exponent", 9))


_LOGS = f"SELECT ln(compute_budget) AS c, ln(parameters) AS p, ln(compute_budget / (6 * parameters)) AS t FROM ({_OPTIMA})"
_LAWS = f"""SELECT 'parameters' AS law, exp(regr_intercept(p, c)) AS factor, regr_slope(p, c) AS exponent FROM ({_LOGS})
  UNION ALL SELECT 'tokens', exp(regr_intercept(t, c)), regr_slope(t, c) FROM ({_LOGS})"""
QUERIES["scaling_fit"] = scaling_fit
SQL["scaling_fit"] = f"SELECT law, round(factor, 6) AS factor, round(exponent, 9) AS exponent FROM ({_LAWS})"


def scaling_extrapolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optimal sizes at larger budgets (CP12, CP18); logarithms, so that rounding means the same everywhere."""
    out = S.extrapolate(S.power_laws(S.isoflop_optima(runs(spark, sf_dir))), (1e23, 1e24))
    return out.select("law", "compute_budget", F.round(F.ln("value"), 6).alias("log_value"))


QUERIES["scaling_extrapolate"] = scaling_extrapolate
SQL["scaling_extrapolate"] = f"SELECT law, c AS compute_budget, round(ln(factor * pow(c, exponent)), 6) AS log_value FROM ({_LAWS}), (SELECT unnest([1e23::DOUBLE, 1e24::DOUBLE]) AS c)"


def _loss_sql(n: str, d: str) -> str:
    e, a, b, alpha, beta = SURFACE
    return f"({e} + {a} / (pow({n}, {alpha}) + 1e-12) + {b} / (pow({d}, {beta}) + 1e-12))"


def log_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of a given surface on the runs (AG12)."""
    rows = runs(spark, sf_dir).withColumn("tokens", S.training_tokens(F.col("compute_budget"), F.col("parameters")))
    return S.log_error(rows, SURFACE).select(_rounded("error"))


QUERIES["log_error"] = log_error
SQL["log_error"] = f"SELECT round(avg(pow(ln({_loss_sql('parameters', 'compute_budget / (6 * parameters)')}) - ln(final_loss), 2)) , 6) AS error FROM {_VALUES}"


def parametric_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that the bounded fit finds from the published start (CP13)."""
    rows = runs(spark, sf_dir).withColumn("tokens", S.training_tokens(F.col("compute_budget"), F.col("parameters")))
    return spark.createDataFrame([S.fit_parametric(rows)], "e double, a double, b double, alpha double, beta double")


QUERIES["parametric_fit"] = parametric_fit


#: How much more than the largest run the budget of the grid is.
BEYOND = 1e8


def loss_grid_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best size of 50,000 for a budget beyond all runs (CP14, SO8)."""
    budget = runs(spark, sf_dir).agg(F.max("compute_budget")).first()[0] or 1.0
    return S.optimal_size(spark, BEYOND * budget, SURFACE).select(*[F.round(F.ln(c), 6).alias(f"log_{c}") for c in ("parameters", "tokens", "tokens_per_parameter")], F.round("loss", 9).alias("loss"))


_GRID = f"SELECT i, n, {BEYOND!r}::DOUBLE * (SELECT max(compute_budget) FROM {_VALUES}) / (6.0::DOUBLE * n) AS d FROM (SELECT i, pow(10.0::DOUBLE, {S.GRID_LOW} + i * {(S.GRID_HIGH - S.GRID_LOW) / (S.GRID_POINTS - 1)!r}::DOUBLE) AS n FROM (SELECT unnest(range(0, {S.GRID_POINTS})) AS i))"
QUERIES["loss_grid_argmin"] = loss_grid_argmin
SQL["loss_grid_argmin"] = f"""SELECT round(ln(n), 6) AS log_parameters, round(ln(d), 6) AS log_tokens, round(ln(d / n), 6) AS log_tokens_per_parameter, round(l, 9) AS loss
  FROM (SELECT *, {_loss_sql('n', 'd')} AS l FROM ({_GRID})) ORDER BY l, i LIMIT 1"""

_DRAW = "(('0x' || substr(md5('0|' || stratum || '|' || k || '|{}'), 1, 8))::BIGINT::DOUBLE / 4294967296::DOUBLE)"
SAMPLES = 15
_STRATA = f"SELECT row_number() OVER (ORDER BY compute_budget) - 1 AS stratum, compute_budget AS budget, {SAMPLES} AS samples FROM (SELECT DISTINCT compute_budget FROM {_VALUES})"
_GRIDDED = f"""SELECT stratum, k, budget, (2 + floor({_DRAW.format('layers')} * 23))::INTEGER AS num_layers, {list(S.WIDTHS)}[(floor({_DRAW.format('width')} * 5) + 1)::INTEGER]::INTEGER AS d_model,
  pow(10.0::DOUBLE, {_DRAW.format('rate')} - 4) AS learning_rate FROM (SELECT stratum::INTEGER AS stratum, budget, unnest(range(1, samples + 1))::INTEGER AS k FROM ({_STRATA}))"""


def _configs(spark: SparkSession, observed: DataFrame) -> DataFrame:
    """Configurations for the budgets of the runs; there are ``SHARES + len(SIZES) - 1`` of these at most."""
    budgets = sorted(r[0] for r in observed.select("compute_budget").distinct().collect())
    return S.config_grid(spark, strata=tuple((b, SAMPLES) for b in budgets))


def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled configurations for the budgets of the runs (CP16, CP17, JN15, SO10, FL10)."""
    return _configs(spark, runs(spark, sf_dir)).withColumn("learning_rate", F.round("learning_rate", 9))


_CONFIGS = f"""SELECT stratum, k, d_model, num_layers, least(16, greatest(2, d_model // 64))::INTEGER AS num_heads, 256 AS batch_size, learning_rate, budget::BIGINT AS train_flops
  FROM ({_GRIDDED}) WHERE budget >= 600.0 * 12 * num_layers * d_model * d_model"""
QUERIES["config_grid"] = config_grid
SQL["config_grid"] = f"SELECT * REPLACE (round(learning_rate, 9) AS learning_rate) FROM ({_CONFIGS})"


def budget_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations with the loss that was observed at their budget, as far as half of what all would cost allows; every fifth call failed (WN6, CP15, JN16, SC14, FL12)."""
    observed = runs(spark, sf_dir)
    grid = settle(_configs(spark, observed))
    failed = (F.col("stratum") + F.col("k")) % 5 == 0
    best = S.isoflop_optima(observed).select(F.col("compute_budget").cast("long").alias("train_flops"), "final_loss")
    calls = grid.join(F.broadcast(best), "train_flops").select((F.col("stratum") * 100 + F.col("k")).alias("seq"), F.col("train_flops").cast("double").alias("cost"), F.when(~failed, F.col("final_loss")).alias("final_loss"))
    return S.budget_gate(calls, (grid.agg(F.sum("train_flops")).first()[0] or 0) / 2)


QUERIES["budget_gate"] = budget_gate
SQL["budget_gate"] = f"""WITH a AS MATERIALIZED ({_CONFIGS}), o AS (SELECT compute_budget::BIGINT AS train_flops, final_loss FROM ({_OPTIMA})),
  c AS (SELECT (stratum * 100 + k)::INTEGER AS seq, train_flops::DOUBLE AS cost, CASE WHEN (stratum + k) % 5 <> 0 THEN final_loss END AS final_loss FROM a JOIN o USING (train_flops)),
  b AS (SELECT *, coalesce(sum(CASE WHEN final_loss IS NOT NULL THEN cost ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
  s AS (SELECT *, max((before + cost > 0.95 * ((SELECT sum(train_flops) FROM a)::DOUBLE / 2))::INTEGER) OVER (ORDER BY seq) AS shut FROM b)
  SELECT seq, cost, final_loss, before + CASE WHEN final_loss IS NOT NULL THEN cost ELSE 0 END AS spent FROM s WHERE shut = 0"""


def power_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted sizes along a logarithmic range of budgets (CP18)."""
    laws = S.power_laws(S.isoflop_optima(runs(spark, sf_dir)))
    return S.extrapolate(laws, tuple(10.0 ** (17 + k / 2) for k in range(15))).select("law", F.round(F.log10("compute_budget"), 3).alias("log_budget"), F.round(F.ln("value"), 6).alias("log_value"))


QUERIES["power_curve"] = power_curve
SQL["power_curve"] = f"SELECT law, round(17 + k / 2, 3) AS log_budget, round(ln(factor * pow(pow(10.0::DOUBLE, 17 + k / 2), exponent)), 6) AS log_value FROM ({_LAWS}), (SELECT unnest(range(0, 15)) AS k)"
