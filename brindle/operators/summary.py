"""Summaries of records and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import clip, r6, ratio, wilson_interval
from brindle.operators.stats import reduction_bootstrap
from brindle.sources.folders import written


def _rate(c: Column) -> Column:
    return r6(F.avg(c.cast("int")))


def record_summary(records: DataFrame) -> DataFrame:
    """Per method, budget (as text) and intervention; costs per right and per supported answer divide by 1 at least."""
    supported = F.count_if(F.col("vem") >= 0)
    return records.groupBy("method", "budget", "intervention").agg(
        F.count("*").alias("n"),
        _rate(F.col("is_correct")).alias("accuracy"),
        r6(F.avg("vem")).alias("mean_vem"),
        r6(F.avg("reliance_retention")).alias("mean_rr"),
        r6(F.avg("delta_vem")).alias("mean_delta_vem"),
        _rate(F.col("shortcut_persistence")).alias("shortcut_persistence_rate"),
        r6(F.avg("latency_ms")).alias("mean_latency_ms"),
        r6(F.avg("token_count")).alias("mean_token_count"),
        F.round(F.sum("cost"), 2).alias("total_cost"),
        r6(F.sum("cost") / F.greatest(F.count_if("is_correct"), F.lit(1))).alias("cost_per_accurate_answer"),
        r6(F.sum("cost") / F.greatest(supported, F.lit(1))).alias("cost_per_visually_supported_answer"),
    )


#: Budgets and methods whose choices are told apart in a distribution; others are counted together.
BUDGETS, METHODS = ("128", "256", "432", "64", "full"), ("cover", "dense", "topk")


def distribution(c: Column, values: tuple[str, ...]) -> Column:
    """How often each value occurs, as a JSON object by value; values that aren't listed count as ``other``."""
    counts = [F.count_if(c == v) for v in values] + [F.count_if(~F.coalesce(c.isin(*values), F.lit(False)))]
    names = F.array(*[F.lit(v) for v in (*values, "other")])
    return F.to_json(F.map_filter(F.map_from_arrays(names, F.array(*counts)), lambda _, n: n > 0))


def _measures(budgets: tuple[str, ...] = BUDGETS, methods: tuple[str, ...] = METHODS) -> dict[str, Column]:
    """Measure -> aggregate over decisions."""
    right, accepted = F.greatest(F.count_if("is_correct"), F.lit(1)), F.greatest(F.count_if("accepted"), F.lit(1))
    energy = F.sum("measured_energy_joule")
    return {
        "n": F.count("*"),
        "accepted_rate": _rate(F.col("accepted")),
        "accuracy": _rate(F.col("is_correct")),
        "visually_supported_rate": _rate(F.col("accepted")),
        "mean_vem": r6(F.avg("vem")),
        "mean_rr": r6(F.avg("reliance_retention")),
        "mean_clipped_rr": r6(F.avg(clip(F.col("reliance_retention"), 0.0, 2.0))),
        "mean_latency_ms": r6(F.avg("latency_ms")),
        "mean_token_count": r6(F.avg("token_count")),
        "mean_escalations": r6(F.avg("escalations")),
        "mean_speedup_vs_dense": r6(F.avg("speedup_vs_dense")),
        "mean_retained_token_ratio": r6(F.avg("retained_token_ratio")),
        "mean_token_reduction": r6(F.avg("token_reduction")),
        "total_cost": F.round(F.sum("cost"), 2),  # large sums differ in later digits by the order in which they are made
        "cost_per_accurate_answer": r6(F.sum("cost") / right),
        "cost_per_visually_supported_answer": r6(F.sum("cost") / accepted),
        "mean_measured_energy_joule": r6(F.avg("measured_energy_joule")),
        "total_measured_energy_joule": r6(energy),
        "measured_energy_per_accurate_answer_joule": r6(energy / right),
        "measured_energy_per_visually_supported_answer_joule": r6(energy / accepted),
        "mean_api_cost_usd": r6(F.avg("api_cost_usd")),
        "total_api_cost_usd": r6(F.sum("api_cost_usd")),
        "mean_proxy_energy_joule": r6(F.avg("proxy_energy_joule")),
        "total_proxy_energy_joule": r6(F.sum("proxy_energy_joule")),
        "proxy_energy_per_visually_supported_answer_joule": r6(F.sum("proxy_energy_joule") / accepted),
        "mean_online_cumulative_cost": r6(F.avg("online_cumulative_cost")),
        "mean_online_cumulative_latency_ms": r6(F.avg("online_cumulative_latency_ms")),
        "selected_budget_distribution": distribution(F.col("selected_budget"), budgets),
        "selected_method_distribution": distribution(F.col("selected_method"), methods),
        "dense_avoidance_rate": _rate((F.col("selected_method") != "dense") & (F.col("selected_budget") != "full")),
        "fallback_full_rate": _rate(F.col("reason") == "fallback_full"),
    }


def decision_summary(decisions: DataFrame, *by: str, budgets: tuple[str, ...] = BUDGETS, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """All measures of decisions, by the given columns; optional values skip nulls and are null without any."""
    return decisions.groupBy(*by).agg(*(c.alias(n) for n, c in _measures(budgets, methods).items()))


def selection_histogram(decisions: DataFrame, *by: str) -> DataFrame:
    """How often each method and budget was selected."""
    return decisions.groupBy(*by, "selected_method", "selected_budget").agg(F.count("*").alias("n"))


MACRO = (
    "accuracy",
    "visually_supported_rate",
    "mean_token_count",
    "mean_token_reduction",
    "dense_avoidance_rate",
    "cost_per_visually_supported_answer",
    "measured_energy_per_visually_supported_answer_joule",
    "mean_measured_energy_joule",
    "mean_latency_ms",
)


def macro_summary(decisions: DataFrame) -> DataFrame:
    """Per setting and measure the plain mean over datasets, where a dataset has it."""
    per = decision_summary(decisions, "setting", "dataset")
    long = per.unpivot(["setting", "dataset"], list(MACRO), "metric", "value").where("value is not null")
    return long.groupBy("setting", "metric").agg(r6(F.avg("value")).alias("macro_mean"), F.count("*").alias("n_datasets"))


def reliance_audit(eligible_rows: DataFrame) -> DataFrame:
    """Per dataset and over all (``_all``): queries with dense records, those with eligible interventions, and rates.

    ``eligible_rows``: records with ``eligible`` and the thresholds, of one setting.
    """
    dense = F.col("method") == "dense"
    bound = F.greatest("dense_vem_min", "tau")
    per = eligible_rows.groupBy("sample_id", "split").agg(
        F.count_if(dense).alias("dense"),
        F.min(F.when(dense, F.col("dataset"))).alias("dataset"),
        F.count_if(dense & F.col("is_correct")).alias("right"),
        F.count_if(dense & F.col("is_correct") & (F.col("vem") >= bound)).alias("supported"),
        F.size(F.first("eligible")).alias("eligible"),
    )
    total = per.where("dense > 0").rollup("dataset").agg(
        F.grouping("dataset").alias("all"),
        F.count("*").alias("n_test_queries"),
        F.count_if(F.col("eligible") > 0).alias("n_dense_reliant_queries"),
        *(F.sum(a).alias(b) for a, b in (("dense", "total_dense_interventions"), ("right", "total_dense_correct_interventions"), ("supported", "total_dense_supported_interventions"), ("eligible", "total_eligible_interventions"))),
    )
    queries, of = F.col("n_test_queries"), F.col("total_dense_interventions")
    return total.withColumn("dataset", F.when(F.col("all") == 1, "_all").otherwise(F.col("dataset"))).drop("all").withColumns(
        {
            "dense_reliant_query_rate": r6(ratio(F.col("n_dense_reliant_queries"), queries)),
            "mean_eligible_interventions_per_query": r6(ratio(F.col("total_eligible_interventions"), queries)),
            "eligible_intervention_rate": r6(ratio(F.col("total_eligible_interventions"), of)),
            "dense_correct_intervention_rate": r6(ratio(F.col("total_dense_correct_interventions"), of)),
            "dense_supported_intervention_rate": r6(ratio(F.col("total_dense_supported_interventions"), of)),
        }
    )


def qualitative_top(records: DataFrame, n: int = 12) -> DataFrame:
    """The n right, pruned records that lost most margin against dense; then the cheapest, then by key."""
    lost = records.where((F.col("method") != "dense") & F.col("is_correct") & (F.col("vem") < F.col("dense_vem")))
    order = [F.col("vem") - F.col("dense_vem"), "cost", "sample_id", "method", "budget", "intervention"]
    return lost.orderBy(*order).limit(n)


def split_leakage(rows: DataFrame, value: str, split: str = "split") -> DataFrame:
    """Values that occur in more than one split, with how many rows and splits."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.count_distinct(split).alias("splits"), F.min(split).alias("first_split")).where("splits > 1")


def first_calls(records: DataFrame) -> DataFrame:
    """One original call per sample, method and budget: that of the first intervention (a repeated call isn't counted twice)."""
    w = Window.partitionBy("sample_id", "method", "budget").orderBy("intervention")
    return records.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def cost_boundary(records: DataFrame, budgets: tuple[str, ...] = ("64", "128", "256", "432", "full")) -> DataFrame:
    """Per method, at each budget side by side: mean energy and latency of an original call, and how many calls have energy."""
    measures = {"mean_energy": r6(F.avg("energy_joule")), "mean_latency": r6(F.avg("latency_ms")), "calls_with_energy": F.count("energy_joule")}
    mean = first_calls(records).groupBy("method").pivot("budget", list(budgets)).agg(*(c.alias(n) for n, c in measures.items()))
    return mean.select("method", *(F.col(f"`{b}_{n}`").alias(f"{n}_{b}") for n in measures for b in budgets))


def reduction_against_dense(records: DataFrame) -> DataFrame:
    """Per method and budget: 1 - mean / dense mean of energy and latency over original calls."""
    mean = first_calls(records).groupBy("method", "budget").agg(F.count("*").alias("n"), F.avg("energy_joule").alias("e"), F.avg("latency_ms").alias("l"))
    dense = mean.where("method = 'dense'").agg(F.max("e").alias("de"), F.max("l").alias("dl"))
    rows = mean.where("method <> 'dense'").crossJoin(F.broadcast(dense))  # one row
    return rows.select("method", "budget", "n", r6(1 - ratio(F.col("e"), F.col("de"))).alias("energy_reduction"), r6(1 - ratio(F.col("l"), F.col("dl"))).alias("latency_reduction"))


JOULE_PER_KWH = 3_600_000
CHOICES = ("128", "256", "432", "448", "64", "dense")


def _bounds(rows: DataFrame, count: str, n: str, name: str) -> DataFrame:
    low, high = wilson_interval(F.col(count), F.col(n))
    return rows.withColumns({f"{name}_low": r6(low), f"{name}_high": r6(high)})


def controller_summary(outcomes: DataFrame, *by: str, risk: float = 0.05, draws: int = 5000, seed: int = 13, dense_tokens: int = 576, runs: DataFrame | None = None) -> DataFrame:
    """What a controller's actions cost and risked (:func:`brindle.operators.safety.outcomes`), by the given columns.

    Rates have 95 per cent Wilson bounds, the energy reduction a bootstrapped interval by sample. ``runs``: a row per group with what
    only a run knows (energy of the whole block a query, where it was resumed, the controller's own latency). The outcomes are written: sums and draws
    read them, and nothing before them is done twice.
    """
    taken = ("avoided", "selected_budget", "selected_tokens", "unsafe_acceptance", "task_correct", "supported_correct", "energy_joule", "dense_energy_joule", "latency_ms", "dense_latency_ms")
    outcomes = written(outcomes.select(*by, *(c for c in ("sample_id", *taken) if c not in by)), "outcomes")
    rate = lambda c: F.avg(F.col(c).cast("int"))
    got = outcomes.groupBy(*by).agg(
        F.count("*").alias("n"),
        r6(rate("avoided")).alias("dense_avoidance_rate"),
        distribution(F.col("selected_budget"), CHOICES).alias("selected_budget_distribution"),
        r6(F.avg("selected_tokens")).alias("mean_selected_visual_tokens"),
        r6(1 - F.avg("selected_tokens") / dense_tokens).alias("token_reduction_vs_dense"),
        F.count_if("unsafe_acceptance").alias("unsafe_acceptance_count"),
        F.count_if("task_correct").alias("_correct"),
        F.count_if("supported_correct").alias("_supported"),
        *(F.avg(a).alias(b) for a, b in (("energy_joule", "_energy"), ("dense_energy_joule", "_dense_energy"), ("latency_ms", "_latency"), ("dense_latency_ms", "_dense_latency"))),
    )
    n = F.col("n")
    got = got.withColumns(
        {
            "unsafe_acceptance_rate_full": r6(ratio(F.col("unsafe_acceptance_count"), n)),
            "unconditional_accuracy": r6(ratio(F.col("_correct"), n)),
            "supported_correct_rate_full": r6(ratio(F.col("_supported"), n)),
            "mean_call_window_gpu_energy_joule": r6("_energy"),
            "mean_dense_call_window_gpu_energy_joule": r6("_dense_energy"),
            "mean_model_latency_ms": r6("_latency"),
            "mean_dense_latency_ms": r6("_dense_latency"),
            "correct_answers_per_kwh": r6(ratio(F.col("_correct") / n * JOULE_PER_KWH, F.col("_energy"))),
            "supported_correct_answers_per_kwh": r6(ratio(F.col("_supported") / n * JOULE_PER_KWH, F.col("_energy"))),
        }
    )
    for count, name in (("unsafe_acceptance_count", "unsafe_acceptance"), ("_correct", "unconditional_accuracy"), ("_supported", "supported_correct")):
        got = _bounds(got, count, "n", name)
    got = got.withColumns(
        {
            "prospective_risk_limit_met_point_estimate": F.col("unsafe_acceptance_count") / n <= risk,
            "prospective_risk_limit_met_95pct_upper": F.col("unsafe_acceptance_high") <= risk,
        }
    ).drop("_correct", "_supported", "_energy", "_dense_energy", "_latency", "_dense_latency")
    saved = reduction_bootstrap(outcomes, "energy_joule", "dense_energy_joule", "sample_id", draws, seed, *by)
    saved = saved.select(*by, F.col("reduction").alias("energy_reduction_vs_dense"), F.col("ci_low").alias("energy_reduction_low"), F.col("ci_high").alias("energy_reduction_high"))
    got = got.join(saved, list(by))
    return got.join(runs, list(by), "left") if runs is not None else got


def deployable(summary: DataFrame, risk: float = 0.05) -> DataFrame:
    """``summary`` with deployable: the upper bound of unsafe choices is within ``risk`` and the lower bound of the energy reduction above 0."""
    return summary.withColumn("deployable", (F.col("unsafe_acceptance_high") <= risk) & (F.col("energy_reduction_low") > 0))


def fixed_budget_summary(labels: DataFrame, calls: DataFrame, *by: str) -> DataFrame:
    """Per group, method and budget: what always taking that budget would cost and keep. ``labels``: strict labels; ``calls``: one original call each."""
    call = calls.select("sample_id", "method", "budget", F.col("is_correct").alias("_right"), "energy_joule", "latency_ms")
    rows = labels.where("method <> 'dense'").join(call, ["sample_id", "method", "budget"])
    reliant = F.col("n_eligible") > 0
    supported = F.count_if(reliant & F.coalesce("gold_safe", F.lit(False)))
    return rows.groupBy(*by, "method", "budget").agg(
        F.count("*").alias("n"),
        r6(F.avg(F.col("_right").cast("int"))).alias("unconditional_accuracy"),
        F.count_if(reliant).alias("dense_reliant_n"),
        r6(F.avg(F.when(reliant, F.col("reference_safe").cast("int")))).alias("strict_reference_safe_rate_dense_reliant"),
        r6(supported / F.count("*")).alias("supported_correct_rate_full"),
        r6(F.avg("energy_joule")).alias("mean_call_window_gpu_energy_joule"),
        r6(F.avg("latency_ms")).alias("mean_latency_ms"),
        r6(ratio(supported / F.count("*") * JOULE_PER_KWH, F.avg("energy_joule"))).alias("supported_correct_answers_per_kwh"),
    )


def policy_outcomes(outcomes: DataFrame, *by: str) -> DataFrame:
    """The full summary of chosen actions, by policy or whatever is given: all rows, rows where dense is right, and those that also rely on the input."""
    rate = lambda c, where=None: r6(F.avg(F.when(where, F.col(c).cast("int")) if where is not None else F.col(c).cast("int")))
    right = F.col("dense_correct")
    reliant = right & (F.col("n_eligible") > 0)
    supported = F.count_if(reliant & F.col("task_correct") & F.col("intervention_pass"))
    return outcomes.groupBy(*by).agg(
        F.count("*").alias("n_full"),
        rate("task_correct").alias("unconditional_accuracy"),
        rate("reference_safe").alias("dense_behavior_safe_rate"),
        rate("unsafe_acceptance").alias("unsafe_acceptance_rate"),
        rate("avoided").alias("dense_avoidance_rate"),
        r6(F.avg("selected_tokens")).alias("mean_token_count"),
        r6(F.avg("latency_ms")).alias("mean_original_call_latency_ms"),
        r6(F.avg("energy_joule")).alias("mean_original_call_energy_joule"),
        F.count_if(right).alias("n_dense_correct"),
        rate("answer_fidelity", right).alias("dense_correct_answer_preservation"),
        F.count_if(reliant).alias("n_dense_correct_reliant"),
        rate("intervention_pass", reliant).alias("reliant_intervention_preservation"),
        rate("intervention_fidelity", reliant).alias("reliant_intervention_trajectory_fidelity"),
        r6(F.avg(F.when(reliant, F.coalesce("gold_safe", F.lit(False)).cast("int")))).alias("reliant_combined_safe_rate"),
        r6(ratio(supported, F.sum("energy_joule") / JOULE_PER_KWH)).alias("supported_correct_answers_per_kwh_full_denominator"),
        distribution(F.col("selected_budget"), CHOICES).alias("selected_budget_distribution"),
        F.lit("original model call only; evaluator-only interventions excluded").alias("accounting_boundary"),
    )


def strict_coverage(labels: DataFrame, *by: str) -> DataFrame:
    """Per group, method and budget: how many samples are reliant and right, safe rates over all and over reliant ones, with Wilson bounds."""
    reliant = F.col("n_eligible") > 0
    got = labels.where("method <> 'dense'").groupBy(*by, "method", "budget").agg(
        F.count("*").alias("n"),
        F.count_if(reliant).alias("n_reliant"),
        F.count_if("dense_correct").alias("n_dense_correct"),
        F.count_if("covers").alias("n_covered"),
        F.count_if("reference_safe").alias("n_safe"),
        F.count_if(reliant & F.col("reference_safe")).alias("n_safe_reliant"),
    )
    got = got.withColumns({"reliant_rate": r6(ratio(F.col("n_reliant"), F.col("n"))), "coverage_rate": r6(ratio(F.col("n_covered"), F.col("n"))), "safe_rate": r6(ratio(F.col("n_safe"), F.col("n"))), "safe_rate_reliant": r6(ratio(F.col("n_safe_reliant"), F.col("n_reliant")))})
    return _bounds(_bounds(got, "n_safe", "n", "safe"), "n_safe_reliant", "n_reliant", "safe_reliant")


def dense_audit(records: DataFrame, *by: str, expected: int | None = None) -> DataFrame:
    """Of dense records the first call of each sample: counts and means. ``expected``: so many samples must be there in each group."""
    got = first_calls(records.where("method = 'dense'")).groupBy(*by).agg(
        F.count("*").alias("n"), r6(F.avg(F.col("is_correct").cast("int"))).alias("accuracy"), r6(F.avg("energy_joule")).alias("mean_energy_joule"),
        r6(F.avg("latency_ms")).alias("mean_latency_ms"), r6(F.avg(F.col("token_count"))).alias("mean_token_count"),
    )
    if expected is None:
        return got
    wrong = F.raise_error(F.concat(F.lit(f"{expected} samples are expected, there are "), F.col("n").cast("string"))).cast("bigint")
    return got.withColumn("n", F.when(F.col("n") == expected, F.col("n")).otherwise(wrong))
