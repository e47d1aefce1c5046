"""Numeric functions over arrays of doubles: norms, activations, softmax, rotary positions, losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def let(value: Column, body) -> Column:
    """Bind a value that a body uses more than once."""
    return F.transform(F.array(value), body)[0]


def dot(x: Column, y: Column) -> Column:
    return _sum(F.zip_with(x, y, lambda a, b: a * b))


def matvec(rows: Column, x: Column) -> Column:
    """A linear layer: the dot product of each row of an array of arrays with x."""
    return F.transform(rows, lambda r: dot(r, x))


def softmax(x: Column, temperature: float = 1.0) -> Column:
    """Softmax, shifted by the largest value."""
    shifted = let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp((v - m) / temperature)))
    return let(shifted, lambda e: let(_sum(e), lambda s: F.transform(e, lambda v: v / s)))


def log_sum_exp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.ln(_sum(F.transform(x, lambda v: F.exp(v - m)))))


def online_lse(x: Column, tile: int = 16) -> Column:
    """Log-sum-exp in one pass over tiles: a running maximum and a running sum that is rescaled when the maximum grows."""
    start = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("l"))

    def step(a: Column, k: Column) -> Column:
        part = F.slice(x, k * tile + 1, F.lit(tile))
        top = F.greatest(a["m"], F.array_max(part))
        return let(top, lambda m: F.struct(m.alias("m"), (a["l"] * F.exp(a["m"] - m) + _sum(F.transform(part, lambda v: F.exp(v - m)))).alias("l")))

    tiles = F.sequence(F.lit(0), F.ceil(F.size(x) / tile).cast("int") - 1)
    return F.aggregate(tiles, start, step, lambda a: a["m"] + F.ln(a["l"]))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Negative log-probability of the target, which counts from 0; null if it is out of range."""
    return log_sum_exp(logits) - F.get(logits, target)


def rms_norm(x: Column, eps: float = 1e-5) -> Column:
    return let(F.sqrt(dot(x, x) / F.size(x) + eps), lambda r: F.transform(x, lambda v: v / r))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (1 + F.exp(-v)))


def swiglu(gate: Column, value: Column) -> Column:
    return F.zip_with(silu(gate), value, lambda a, b: a * b)


def rope(x: Column, position: Column, theta: float = 10000.0) -> Column:
    """Rotary embedding of neighbouring pairs; pair k turns by position / theta^(2k/d)."""
    pairs = F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1)

    def turned(k: Column) -> Column:
        angle = position / F.pow(F.lit(theta), 2.0 * k / F.size(x))
        a, b = F.get(x, 2 * k), F.get(x, 2 * k + 1)
        return F.array(a * F.cos(angle) - b * F.sin(angle), a * F.sin(angle) + b * F.cos(angle))

    return F.flatten(F.transform(pairs, turned))


def learning_rate(step: Column, high: float, low: float, warm: int, total: int) -> Column:
    """Linear warm-up, cosine decay, then the low rate."""
    decay = low + 0.5 * (high - low) * (1 + F.cos((step - warm) / float(total - warm) * F.pi()))
    return F.when(step < warm, high * step / warm).when(step <= total, decay).otherwise(F.lit(low))


def adamw(w: Column, m: Column, v: Column, g: Column, step: Column, rate: float, beta1=0.9, beta2=0.95, eps=1e-8, decay=0.01) -> dict[str, Column]:
    """New weight and moments of one AdamW step, decay after the update."""
    m2, v2 = beta1 * m + (1 - beta1) * g, beta2 * v + (1 - beta2) * g * g
    scaled = rate * F.sqrt(1 - F.pow(F.lit(beta2), step)) / (1 - F.pow(F.lit(beta1), step))
    return {"w": (w - scaled * m2 / (F.sqrt(v2) + eps)) * (1 - rate * decay), "m": m2, "v": v2}


def clip_scale(norm: Column, most: float, eps: float = 1e-6) -> Column:
    """Factor for gradients of a global norm: 1 up to the limit."""
    return F.when(norm > most, most / (norm + eps)).otherwise(F.lit(1.0))
