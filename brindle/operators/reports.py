"""What is said about a comparison of policies: names, tables, differences and sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.numbers import r6

#: How methods are written; others are written as they are named.
METHOD_NAMES = {"fastv": "FastV", "scope": "SCOPE", "random": "Random", "center": "Center", "saliency": "Saliency"}
POLICY_NAMES = {"supported": "Cheapest supported budget", "online": "Online cascade", "dense_only": "Dense, all tokens"}
#: Measures of the comparison table: as they are, and as percentages.
PLAIN = ("mean_vem", "mean_rr", "mean_token_count", "mean_escalations", "cost_per_visually_supported_answer", "measured_energy_per_visually_supported_answer_joule", "mean_measured_energy_joule")
PERCENT = {"accuracy_pct": "accuracy", "visual_support_pct": "visually_supported_rate", "token_reduction_pct": "mean_token_reduction", "dense_avoidance_pct": "dense_avoidance_rate", "fallback_full_pct": "fallback_full_rate"}


def method_name(method: str) -> str:
    return METHOD_NAMES.get(method, method)


def policy_names(methods: list[str], schedule: list[str]) -> dict[str, str]:
    """Policy -> what it is called, in the order of a table."""
    names = dict(POLICY_NAMES)
    for m in methods:
        shown = method_name(m)
        names |= {
            f"{m}_supported": f"{shown} alone: cheapest supported budget",
            f"{m}_online": f"{shown} alone: online cascade",
            f"{m}_fixed_aggressive": f"{shown} fixed at {schedule[0]}",
            f"{m}_fixed_medium": f"{shown} fixed at {schedule[len(schedule) // 2]}",
            f"{m}_accuracy_only": f"{shown} by accuracy only",
            f"{m}_cost_only": f"{shown} by cost only",
        }
    return names


def comparison_table(comparison: DataFrame, names: dict[str, str]) -> DataFrame:
    """``comparison`` (a row per setting, of :func:`brindle.operators.summary.decision_summary`) as a table: place, policy, label, measures and percentages.

    Policies without a name come last and are written with spaces.
    """
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(names) for x in (k, i)])
    return comparison.select(
        F.coalesce(F.try_element_at(place, F.col("setting")), F.lit(len(names))).alias("place"),
        F.col("setting").alias("policy"),
        F.coalesce(F.try_element_at(label, F.col("setting")), F.translate("setting", "_", " ")).alias("label"),
        "n",
        *(r6(100 * F.col(c)).alias(n) for n, c in PERCENT.items()),
        *PLAIN,
        F.col("selected_budget_distribution").alias("selected_budgets"),
        F.col("selected_method_distribution").alias("selected_methods"),
    )


def _side(comparison: DataFrame, setting: str | None, prefix: str) -> DataFrame:
    """One row with a policy's measures; nulls if it isn't there."""
    wanted = ("accuracy", "visually_supported_rate", "mean_token_reduction", "dense_avoidance_rate", "cost_per_visually_supported_answer", "measured_energy_per_visually_supported_answer_joule", "mean_latency_ms")
    return comparison.where(F.col("setting") == setting).agg(*(F.first(c).alias(f"{prefix}_{c}") for c in wanted))


def _percent(c: Column) -> Column:
    return F.coalesce(F.format_string("%.1f%%", 100 * c), F.lit("n/a"))


def _points(c: Column) -> Column:
    return F.coalesce(F.format_string("%+.1f pp", 100 * c), F.lit("n/a"))


def claims(comparison: DataFrame, audit: DataFrame, aggressive: str | None, label: str) -> DataFrame:
    """One row: what the supported policy gains and loses against dense and a fixed small budget, and sentences that say so.

    ``audit``: the reliance audit, of which the ``_all`` row counts. Without a supported policy (a run of dense alone) differences are null or 0, and the
    sentences speak of dense only.
    """
    counts = audit.where("dataset = '_all'").agg(F.first("n_dense_reliant_queries").alias("kept"), F.first("n_test_queries").alias("asked"))
    row = counts
    for setting, prefix in (("supported", "s"), ("dense_only", "d"), (aggressive, "a")):
        row = row.crossJoin(F.broadcast(_side(comparison, setting, prefix)))  # one row each
    delta = lambda x, y, c: F.col(f"{x}_{c}") - F.col(f"{y}_{c}")
    alone = F.col("s_accuracy").isNull()
    zero = lambda c: F.when(alone, 0.0).otherwise(c)
    kept = F.format_string("Dense-reliant evaluation keeps %d of %d test queries, on which dense inference is itself supported.", F.coalesce("kept", F.lit(0)), F.coalesce("asked", F.lit(0)))
    policy = [
        kept,
        F.concat(F.lit("Compressed budgets are taken for "), _percent(F.col("s_dense_avoidance_rate")), F.lit(" of them, and "), _percent(F.col("s_visually_supported_rate")), F.lit(" stay supported.")),
        F.concat(F.lit("Against dense inference, tokens fall by "), _percent(F.col("s_mean_token_reduction")), F.lit(" on average.")),
        F.concat(F.lit(f"Against {label}, support changes by "), _points(delta("s", "a", "visually_supported_rate")), F.lit(" and accuracy by "), _points(delta("s", "a", "accuracy")), F.lit(".")),
        F.concat(F.lit("Against dense inference, accuracy changes by "), _points(delta("s", "d", "accuracy")), F.lit(".")),
    ]
    dense = [
        kept,
        F.concat(F.lit("Dense inference is supported on "), _percent(F.col("d_visually_supported_rate")), F.lit(" of them.")),
        F.concat(F.lit("A call takes "), F.coalesce(F.format_string("%.1f", "d_mean_latency_ms"), F.lit("n/a")), F.lit(" ms on average.")),
        F.lit("Nothing is said here of pruned tokens or avoided dense calls."),
    ]
    return row.select(
        r6(100 * F.col("s_mean_token_reduction")).alias("token_reduction_vs_dense_pct"),
        r6(100 * zero(F.col("s_dense_avoidance_rate"))).alias("dense_avoidance_pct"),
        r6(100 * delta("s", "a", "visually_supported_rate")).alias("visual_support_gain_vs_fixed_aggressive_pp"),
        r6(100 * delta("s", "a", "accuracy")).alias("accuracy_gain_vs_fixed_aggressive_pp"),
        r6(delta("s", "a", "cost_per_visually_supported_answer")).alias("cost_per_supported_delta_vs_fixed_aggressive"),
        r6(delta("s", "d", "cost_per_visually_supported_answer")).alias("cost_per_supported_delta_vs_dense"),
        r6(delta("s", "d", "measured_energy_per_visually_supported_answer_joule")).alias("measured_energy_per_supported_delta_vs_dense_joule"),
        r6(100 * zero(delta("s", "d", "visually_supported_rate"))).alias("visual_support_delta_vs_dense_pp"),
        r6(100 * zero(delta("s", "d", "accuracy"))).alias("accuracy_delta_vs_dense_pp"),
        F.when(alone, F.concat_ws("\n", *dense)).otherwise(F.concat_ws("\n", *policy)).alias("sentences"),
    )
