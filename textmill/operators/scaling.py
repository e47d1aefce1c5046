"""Compute-scaling analysis: iso-FLOP optima, power-law fits, parametric loss, grids and budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Start, bounds and the search range of the parametric fit; the strata of the sampling grid.
START = (1.5, 450.0, 2100.0, 0.35, 0.35)
BOUNDS = ((0.1, 5.0), (1.0, 10000.0), (1.0, 10000.0), (0.01, 1.0), (0.01, 1.0))
GRID_POINTS, GRID_LOW, GRID_HIGH = 50_000, 7, 10
STRATA = ((1e15, 15), (3e15, 15), (1e16, 15), (3e16, 15), (1e17, 8), (3e17, 1))
WIDTHS = (64, 128, 256, 512, 1024)


def non_embedding_parameters(layers: Column, width: Column) -> Column:
    return 12 * layers * width * width


def training_tokens(flops: Column, parameters: Column) -> Column:
    return flops / (6 * parameters)


def isoflop_optima(runs: DataFrame) -> DataFrame:
    """The run of least loss for each budget, with its tokens; of equal losses the smaller model."""
    best = F.min_by(F.struct("parameters", "final_loss"), F.struct("final_loss", "parameters")).alias("b")
    rows = runs.where("final_loss is not null").groupBy("compute_budget").agg(best)
    return rows.select("compute_budget", F.col("b.parameters").alias("parameters"), F.col("b.final_loss").alias("final_loss"), training_tokens(F.col("compute_budget"), F.col("b.parameters")).alias("tokens"))


def power_laws(optima: DataFrame) -> DataFrame:
    """``law, factor, exponent`` of parameters and tokens over the budget: least squares in log space."""
    logs = optima.select(F.ln("compute_budget").alias("c"), F.ln("parameters").alias("parameters"), F.ln("tokens").alias("tokens"))
    fits = logs.agg(*[f(y, "c").alias(f"{y}_{k}") for y in ("parameters", "tokens") for k, f in (("slope", F.regr_slope), ("icept", F.regr_intercept))])
    rows = F.array(*[F.struct(F.lit(y).alias("law"), F.exp(f"{y}_icept").alias("factor"), F.col(f"{y}_slope").alias("exponent")) for y in ("parameters", "tokens")])
    return fits.select(F.explode(rows).alias("r")).select("r.*")


def extrapolate(laws: DataFrame, budgets: tuple[float, ...]) -> DataFrame:
    targets = F.explode(F.array(*[F.lit(float(b)) for b in budgets]))
    return laws.withColumn("compute_budget", targets).select("law", "compute_budget", (F.col("factor") * F.pow("compute_budget", "exponent")).alias("value"))


def loss(parameters: Column, tokens: Column, fit: tuple[float, ...]) -> Column:
    e, a, b, alpha, beta = (F.lit(float(x)) for x in fit)
    return e + a / (F.pow(parameters, alpha) + 1e-12) + b / (F.pow(tokens, beta) + 1e-12)


def log_error(runs: DataFrame, fit: tuple[float, ...]) -> DataFrame:
    """Mean squared difference of the logarithms of predicted and observed losses."""
    return runs.agg(F.avg(F.pow(F.ln(loss(F.col("parameters"), F.col("tokens"), fit)) - F.ln("final_loss"), F.lit(2.0))).alias("error"))


def fit_parametric(runs: DataFrame, rounds: int = 400, start: tuple[float, ...] = START) -> tuple[float, ...]:
    """Bounded fit of E + A/N^alpha + B/D^beta to ``parameters, tokens, final_loss`` by the log error.

    Observations are aggregated to their distinct values on the cluster; the few
    numbers that remain are fitted on the driver by damped Gauss-Newton steps in
    (E, ln A, ln B, alpha, beta), clipped to the bounds.
    """
    import numpy as np

    rows = runs.where("final_loss is not null").groupBy("parameters", "tokens", "final_loss").count().collect()
    n, d, y, w = (np.array([float(r[k]) for r in rows]) for k in ("parameters", "tokens", "final_loss", "count"))
    low, high = (np.array([math.log(b[k]) if i in (1, 2) else b[k] for i, b in enumerate(BOUNDS)]) for k in (0, 1))
    x = np.array([start[0], math.log(start[1]), math.log(start[2]), start[3], start[4]])

    def parts(x):
        p, q = np.exp(x[1] - x[3] * np.log(n)), np.exp(x[2] - x[4] * np.log(d))
        total = x[0] + p + q
        return np.log(total) - np.log(y), np.stack([np.ones_like(n), p, q, -p * np.log(n), -q * np.log(d)], 1) / total[:, None]

    damping, (r, jac) = 1e-3, parts(x)
    for _ in range(rounds):
        h = jac.T @ (jac * w[:, None])
        step = np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-12), -jac.T @ (r * w))
        new = np.clip(x + step, low, high)
        r2, jac2 = parts(new)
        if (w * r2 * r2).sum() < (w * r * r).sum():
            done = np.abs(new - x).max() < 1e-12
            x, r, jac, damping = new, r2, jac2, max(damping / 3, 1e-12)
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    return (float(x[0]), math.exp(x[1]), math.exp(x[2]), float(x[3]), float(x[4]))


def optimal_size(spark: SparkSession, budget: float, fit: tuple[float, ...]) -> DataFrame:
    """The point of a logarithmic grid of sizes with the least predicted loss, the first of equals."""
    step = (GRID_HIGH - GRID_LOW) / (GRID_POINTS - 1)
    grid = spark.range(GRID_POINTS).select("id", F.pow(F.lit(10.0), F.lit(float(GRID_LOW)) + F.col("id") * F.lit(step)).alias("n"))
    grid = grid.withColumn("d", F.lit(float(budget)) / (6.0 * F.col("n"))).withColumn("l", loss(F.col("n"), F.col("d"), fit))
    best = grid.agg(F.min_by(F.struct("n", "d", "l"), F.struct("l", "id")).alias("b"))
    return best.select(F.col("b.n").alias("parameters"), F.col("b.d").alias("tokens"), F.col("b.l").alias("loss"), (F.col("b.d") / F.col("b.n")).alias("tokens_per_parameter"))


def draw(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def config_grid(spark: SparkSession, seed: int = 0, strata: tuple = STRATA) -> DataFrame:
    """Configurations sampled for each budget, without those that could not see 100 tokens."""
    plan = spark.createDataFrame([(k, float(b), n) for k, (b, n) in enumerate(strata)], "stratum int, budget double, samples int")
    rows = plan.select("stratum", "budget", F.explode(F.sequence(F.lit(1), F.col("samples"))).alias("k"))
    u = {name: draw(F.lit(seed), F.col("stratum"), F.col("k"), F.lit(name)) for name in ("layers", "width", "rate")}
    rows = rows.select(
        "stratum", "k", "budget", (2 + F.floor(u["layers"] * 23)).cast("int").alias("num_layers"),
        F.element_at(F.array(*[F.lit(w) for w in WIDTHS]), (F.floor(u["width"] * len(WIDTHS)) + 1).cast("int")).alias("d_model"), F.pow(F.lit(10.0), u["rate"] - 4).alias("learning_rate"),
    )
    size = non_embedding_parameters(F.col("num_layers").cast("long"), F.col("d_model").cast("long"))
    rows = rows.withColumn("num_heads", F.least(F.lit(16), F.greatest(F.lit(2), F.expr("cast(d_model div 64 AS int)")))).where(F.col("budget") >= 600 * size)
    return rows.select("stratum", "k", "d_model", "num_layers", "num_heads", F.lit(256).alias("batch_size"), "learning_rate", F.col("budget").cast("long").alias("train_flops"))


def budget_gate(calls: DataFrame, ceiling: float, share: float = 0.95) -> DataFrame:
    """Calls in order that are made before the spend would pass the gate: ``seq, cost, final_loss, spent``.

    ``calls`` has ``seq, cost, final_loss``; a call without a loss failed and costs
    nothing. A call is refused if the spend so far and its cost exceed the gate, and
    nothing is called after the first refusal. A missing cost counts as refused.
    """
    order = Window.orderBy("seq")
    before = F.coalesce(F.sum(F.when(F.col("final_loss").isNotNull(), F.col("cost")).otherwise(0.0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = calls.withColumn("before", before)
    refused = F.coalesce((F.col("before") + F.col("cost") > share * ceiling).cast("int"), F.lit(1))
    rows = rows.withColumn("shut", F.max(refused).over(order)).where("shut = 0")
    return rows.select("seq", "cost", "final_loss", (F.col("before") + F.when(F.col("final_loss").isNotNull(), F.col("cost")).otherwise(0.0)).alias("spent"))
