"""Evaluation records: what a pair of calls, on the original and on the changed input, says about one answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.answers import exact_match
from brindle.functions.numbers import answer_flip, cost_from_latency, first_known, null_skipping_sum, reliance_retention, visual_evidence_margin

#: Least margin of a dense record that counts as relying on the input at all.
DENSE_RELIES = 1e-9
ANSWER_ONLY = "answer_only"


def evaluate(calls: DataFrame, usd_per_1k_ms: float = 0.0, joule_per_ms: float = 0.0) -> DataFrame:
    """``calls`` with the measures of a record.

    Taken: gold_answer, score_type, and of both calls (``original_`` and ``intervened_``) answer, logprob, latency_ms, api_cost_usd,
    measured_energy_joule, api_prompt_tokens, api_completion_tokens, api_total_tokens. Given: is_correct, vem with support_metric and
    answer_flip_support (an answer-only scorer has no margin: its support is whether the answer flips), shortcut_persistence, latency_ms, token
    and cost sums that skip nulls, cost (the API's where there is one, else by latency), energy_joule (measured, else the proxy).
    """
    both = lambda c: null_skipping_sum(F.col(f"original_{c}"), F.col(f"intervened_{c}"))
    flips = answer_flip(F.col("original_answer"), F.col("intervened_answer"))
    only = F.coalesce(F.col("score_type") == ANSWER_ONLY, F.lit(False))
    latency = F.col("original_latency_ms") + F.col("intervened_latency_ms")
    rows = calls.withColumns(
        {
            "is_correct": exact_match(F.col("original_answer"), F.col("gold_answer")),
            "vem": F.when(only, F.when(flips, 1.0).otherwise(0.0)).otherwise(visual_evidence_margin(F.col("original_logprob"), F.col("intervened_logprob"))),
            "support_metric": F.when(only, "answer_flip_support").otherwise("score_vem"),
            "answer_flip_support": F.when(only, flips),
            "shortcut_persistence": ~flips,
            "latency_ms": latency,
            "api_cost_usd": both("api_cost_usd"),
            "measured_energy_joule": both("measured_energy_joule"),
            "proxy_energy_joule": latency * joule_per_ms,
            **{f"api_{t}_tokens": both(f"api_{t}_tokens").cast("bigint") for t in ("prompt", "completion", "total")},
        }
    )
    return rows.withColumns(
        {
            "cost": first_known(F.col("api_cost_usd"), cost_from_latency(F.col("latency_ms"), usd_per_1k_ms)),
            "energy_joule": first_known(F.col("measured_energy_joule"), F.col("proxy_energy_joule")),
        }
    )


def with_dense(records: DataFrame) -> DataFrame:
    """``records`` with dense_vem (that of the sample's dense record under the same intervention), reliance_retention and delta_vem (what was lost).

    A dense record has its own margin, retention 1 where it relies on the input, and loses nothing. One shuffle, no self-join; of several
    dense records of a sample and intervention the largest margin counts.
    """
    dense = F.col("method") == "dense"
    of = Window.partitionBy("sample_id", "intervention")
    rows = records.withColumn("dense_vem", F.when(dense, F.col("vem")).otherwise(F.max(F.when(dense, F.col("vem"))).over(of)))
    return rows.withColumns(
        {
            "reliance_retention": F.when(dense, F.when(F.abs("vem") > DENSE_RELIES, 1.0)).otherwise(reliance_retention(F.col("vem"), F.col("dense_vem"))),
            "delta_vem": F.when(dense, 0.0).otherwise(F.col("dense_vem") - F.col("vem")),
        }
    )


def cycled(rows: DataFrame, n: int, order: str, *within: str) -> DataFrame:
    """Rows with turn: their place by ``order`` within their group, modulo n, as warm-up calls go round a fixed list."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(order)) - 1
    return rows.withColumn("turn", place % n)


def chosen_intervention(samples: DataFrame, pool: tuple[str, ...], order: str, *within: str) -> DataFrame:
    """Samples with intervention: the counterfactual where they have one, else those of ``pool`` in turn."""
    turn = cycled(samples, len(pool), order, *within)
    of_pool = F.element_at(F.array(*[F.lit(p) for p in pool]), (F.col("turn") + 1).cast("int"))
    return turn.withColumn("intervention", F.when(F.col("counterfactual_image_path").isNotNull(), "counterfactual").otherwise(of_pool)).drop("turn")
