"""Small numeric expressions with the null rules that all operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.answers import exact_match


def r6(c: Column | str) -> Column:
    """Rounded to 6 places; the nudge puts values on a tie to one side whatever order a sum was made in."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + 1e-9, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is null or 0."""
    return F.when(b != 0, a.cast("double") / b)


def null_skipping_sum(a: Column, b: Column) -> Column:
    """The sum of what isn't null; null if both are."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def first_known(a: Column, b: Column) -> Column:
    """What was measured, else what stands in for it."""
    return F.coalesce(a, b)


def visual_evidence_margin(original: Column, intervened: Column) -> Column:
    """Log probability lost when the input is changed."""
    return original - intervened


def answer_flip(original: Column, intervened: Column) -> Column:
    """Whether another answer is given when the input is changed."""
    return ~exact_match(original, intervened)


def reliance_retention(vem: Column, dense_vem: Column, least: float = 1e-6) -> Column:
    """Part of the dense margin that is kept; null where that is unknown or too small to divide by."""
    return F.when(F.abs(dense_vem) >= least, vem / dense_vem)


def cost_from_latency(ms: Column, usd_per_1k_ms: float) -> Column:
    return ms / 1000.0 * usd_per_1k_ms


def budget_order(budget: Column, dense_tokens: Column | None = None) -> Column:
    """Where a budget stands among others: its tokens, ``full`` at the dense count or, where that is unknown, last."""
    full = F.coalesce(dense_tokens, F.lit(1_000_000_000)) if dense_tokens is not None else F.lit(1_000_000_000)
    return F.when(budget == "full", full).otherwise(budget.try_cast("int"))


def energy_budget_order(budget: Column) -> Column:
    """The same for energy tables: ``full`` last, what is no number just before it."""
    return F.when(budget == "full", 1_000_000_000).otherwise(F.coalesce(budget.try_cast("int"), F.lit(100_000_000)))


def clip(c: Column, low: float, high: float) -> Column:
    """Null stays null (``least`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def wilson_interval(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Two-sided Wilson bounds of k out of n, within 0 and 1; null for n = 0."""
    p, n = ratio(k, n), F.nullif(n, F.lit(0)).cast("double")
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def wilson_upper(k: Column, n: Column, z: float = 1.6448536269514722) -> Column:
    """One-sided upper Wilson bound, not clamped; 1 for n <= 0."""
    p, m = ratio(k, n), F.when(n > 0, n.cast("double"))
    bound = (p + z * z / (2 * m) + z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
    return F.coalesce(bound, F.lit(1.0))


def sigmoid(x: Column) -> Column:
    """The branch by sign keeps the exponential from overflowing."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def standardize(x: Column, means: Column, scales: Column) -> Column:
    """(x - mean) / scale, place by place."""
    centred = F.zip_with(x, means, lambda a, m: a - m)
    return F.zip_with(centred, scales, lambda a, s: a / s)
