"""Strict safety labels: a budget is safe for a sample if answers and their changes under interventions are those of dense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.answers import alnum_key
from brindle.functions.numbers import r6

RELIANT = 1.0


def strict_labels(records: DataFrame, threshold: float = RELIANT, calls: tuple[str, ...] = ()) -> DataFrame:
    """Per sample, method and budget (dense itself included): covers, answer_fidelity, intervention_fidelity, intervention_pass, reference_safe, gold_safe.

    Eligible are interventions under which dense's margin reaches the threshold, right or not; without any, covering and
    fidelity hold trivially. gold_safe is null unless dense is right and something is eligible. Samples without
    dense records have no row. The first record of a sample is that of its first intervention. ``calls``: columns of the original call, that of the first
    intervention, which come as a struct ``call`` with the intervention before them.
    """
    dense = F.col("method") == "dense"
    here, sample = Window.partitionBy("sample_id", "intervention"), Window.partitionBy("sample_id")
    # one partitioning by sample serves dense's values, eligibility and the aggregates
    rows = records.withColumns(
        {
            "dense_margin": F.min(F.when(dense, F.col("vem"))).over(here),
            "dense_intervened": F.min(F.when(dense, F.col("answer"))).over(here),
            "_first": F.min(F.when(dense, F.struct("intervention", "answer", "is_correct"))).over(sample),
        }
    )
    eligible = F.coalesce(F.col("dense_margin") >= threshold, F.lit(False))
    rows = rows.where("_first is not null").withColumns({"eligible": eligible, "n_eligible": F.size(F.collect_set(F.when(dense & eligible, F.col("intervention"))).over(sample)).cast("bigint")})
    same = alnum_key(F.col("answer")) == alnum_key(F.col("dense_intervened"))
    eligible = F.col("eligible")
    actions = rows.groupBy("sample_id", "split", "dataset", "method", "budget", "budget_ord").agg(
        F.first("_first.answer").alias("dense_answer"),
        F.first("_first.is_correct").alias("dense_correct"),
        F.first("n_eligible").alias("n_eligible"),
        F.min_by("answer", "intervention").alias("answer"),
        F.min_by("is_correct", "intervention").alias("is_correct"),
        # a handful a sample: a distinct count would group the records by intervention again, in two more steps that each hold memory
        F.size(F.collect_set(F.when(eligible, F.col("intervention")))).cast("bigint").alias("n_covered"),
        F.coalesce(F.every(F.when(eligible, same)), F.lit(True)).alias("same_changes"),
        F.coalesce(F.every(F.when(eligible, F.col("vem") >= threshold)), F.lit(True)).alias("all_pass"),
        *([F.min_by(F.struct("intervention", *calls), "intervention").alias("call")] if calls else []),
    )
    actions = actions.withColumn("covers", F.col("n_covered") == F.col("n_eligible"))
    fidelity = F.col("covers") & F.col("same_changes")
    answer = alnum_key(F.col("answer")) == alnum_key(F.col("dense_answer"))
    return actions.select(
        "sample_id", "split", "dataset", "method", "budget", "budget_ord", "n_eligible", "covers", "dense_correct",
        answer.alias("answer_fidelity"), fidelity.alias("intervention_fidelity"), (F.col("covers") & F.col("all_pass")).alias("intervention_pass"),
        (answer & fidelity).alias("reference_safe"),
        F.when(F.col("dense_correct") & (F.col("n_eligible") > 0), F.col("is_correct") & fidelity).alias("gold_safe"),
        *(["call"] if calls else []),
    )


def patterns(labels: DataFrame, budgets: tuple[str, ...] = ("64", "128", "256", "432")) -> DataFrame:
    """Per sample and method: the pattern of safety over budgets (missing: 0), whether it is monotone, and the smallest safe budget (else full)."""
    safe = F.map_from_entries(F.collect_list(F.struct("budget", F.col("reference_safe").cast("int").cast("string"))))
    found = labels.where(F.col("method") != "dense").groupBy("sample_id", "method").agg(safe.alias("safe"))
    pattern = F.concat(*[F.coalesce(F.try_element_at("safe", F.lit(b)), F.lit("0")) for b in budgets])
    at = F.instr("pattern", "1")
    smallest = F.coalesce(F.try_element_at(F.array(*[F.lit(b) for b in budgets]), F.nullif(at, F.lit(0))), F.lit("full"))
    return found.select("sample_id", "method", pattern.alias("pattern")).select(
        "*", (~F.contains("pattern", F.lit("10"))).alias("monotonic"), smallest.alias("min_safe_budget")
    )


def pattern_counts(found: DataFrame) -> DataFrame:
    """Per method and pattern, how many samples."""
    return found.groupBy("method", "pattern", "monotonic").agg(F.count("*").alias("n"))


def populations(labels: DataFrame) -> DataFrame:
    """Per method and split, safe rates over all, over those where dense is right, and over those that also rely on the input."""
    right = F.col("dense_correct")
    reliant = right & (F.col("n_eligible") > 0)
    rate = lambda c: F.round(F.avg(F.when(c, F.col("reference_safe").cast("int"))) + 1e-9, 6)
    return labels.where(F.col("method") != "dense").groupBy("method", "split").agg(
        F.count("*").alias("n"), F.count_if(right).alias("n_dense_correct"), F.count_if(reliant).alias("n_dense_correct_reliant"),
        rate(F.lit(True)).alias("safe_full"), rate(right).alias("safe_dense_correct"), rate(reliant).alias("safe_dense_correct_reliant"),
    )


def constant_dense_answer(records: DataFrame) -> DataFrame:
    """Samples whose dense records give several answers; empty for sound data."""
    return records.where("method = 'dense'").groupBy("sample_id").agg(F.count_distinct("answer").alias("answers")).where("answers > 1")


def later_wins(sources: list[DataFrame], *key: str) -> DataFrame:
    """Rows of several tables, of which the last that has a key counts."""
    tagged = None
    for i, s in enumerate(sources):
        s = s.withColumn("_place", F.lit(i))
        tagged = s if tagged is None else tagged.unionByName(s)
    w = Window.partitionBy(*key).orderBy(F.desc("_place"))
    return tagged.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_place")


def label_map(labels: DataFrame, key: str, budget: Column, safe: Column) -> DataFrame:
    """Per key a map from budget to whether it is safe."""
    return labels.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(budget, safe)))).alias("safe"))


def first_wins(sources: list[DataFrame], *key: str) -> DataFrame:
    """Rows of several tables, of which the first that has a key counts."""
    return later_wins(sources[::-1], *key)


def dense_states(records: DataFrame, threshold: float = RELIANT) -> DataFrame:
    """Per sample with dense records: split, dataset, answer and is_correct of the first intervention, and the eligible interventions."""
    dense = records.where("method = 'dense'")
    return dense.groupBy("sample_id").agg(
        *(F.min_by(c, "intervention").alias(c) for c in ("split", "dataset", "answer", "is_correct")),
        F.array_sort(F.collect_set(F.when(F.col("vem") >= threshold, F.col("intervention")))).alias("eligible"),
    )


def dense_agreement(one: DataFrame, other: DataFrame) -> DataFrame:
    """Per sample of both (:func:`dense_states`): whether answers, rightness and eligible interventions agree, and whether both are right and rely on the input."""
    b = other.select("sample_id", *(F.col(c).alias(f"_{c}") for c in ("answer", "is_correct", "eligible")))
    both = one.join(b, "sample_id")
    return both.select(
        "sample_id", "split", "dataset",
        (alnum_key(F.col("answer")) == alnum_key(F.col("_answer"))).alias("answer_agree"),
        (F.col("is_correct") == F.col("_is_correct")).alias("correctness_agree"),
        (F.col("eligible") == F.col("_eligible")).alias("eligible_interventions_agree"),
        (F.col("is_correct") & F.col("_is_correct") & (F.size("eligible") > 0) & (F.size("_eligible") > 0)).alias("common_reliant"),
    )


def agreement_rates(agreement: DataFrame) -> DataFrame:
    """One row: shared samples, rates of agreement, disagreements of any kind, and common reliant samples of the test split."""
    agree = ("answer_agree", "correctness_agree", "eligible_interventions_agree")
    every = F.col(agree[0]) & F.col(agree[1]) & F.col(agree[2])
    return agreement.agg(
        F.count("*").alias("n_shared_samples"), *(r6(F.avg(F.col(c).cast("int"))).alias(f"{c}ment_rate") for c in agree),
        F.count_if(~every).alias("n_any_disagreement"), F.count_if(F.col("common_reliant") & (F.col("split") == "test")).alias("n_common_dense_correct_reliant_test"),
    )


#: What :func:`outcomes` takes of a label, and of an original call.
OF_LABEL = ("reference_safe", "gold_safe", "dense_correct", "n_eligible", "answer_fidelity", "intervention_fidelity", "intervention_pass")
OF_CALL = ("is_correct", "energy_joule", "latency_ms", "token_count")


def _judged(rows: DataFrame, dense_tokens: int) -> DataFrame:
    """``rows`` of actions, joined with calls and labels, with what follows for them."""
    avoided = F.col("selected_budget") != "dense"
    right_dense = F.col("dense_correct") & (F.col("n_eligible") > 0)
    return rows.withColumns(
        {
            "avoided": avoided,
            "unsafe_acceptance": avoided & ~F.col("reference_safe"),
            "supported_correct": F.when(avoided, F.coalesce("gold_safe", F.lit(False))).otherwise(right_dense),
            "selected_tokens": F.when(avoided, F.col("token_count")).otherwise(dense_tokens),
        }
    ).drop("_m", "_b", "token_count")


def chosen_outcomes(records: DataFrame, chosen: Column, threshold: float = RELIANT, dense_tokens: int = 576) -> DataFrame:
    """:func:`outcomes` of one action for every sample and method but dense of ``records``: the budget that ``chosen`` says of sample_id and method.

    Labels and calls come from one aggregate and meet within their sample (a handful of rows), so the records are read, shuffled and sorted once; the
    general form joins five times.
    """
    labels = strict_labels(records, threshold, OF_CALL)
    of = labels.groupBy("sample_id").agg(F.collect_list(F.struct("method", "budget", *OF_LABEL, "call")).alias("_rows"))
    methods = F.array_distinct(F.transform("_rows", lambda r: r["method"]))
    acts = of.select("sample_id", "_rows", F.explode(F.filter(methods, lambda m: m != "dense")).alias("method")).withColumn("selected_budget", chosen)
    avoided = F.col("selected_budget") != "dense"
    acts = acts.withColumns({"_m": F.when(avoided, F.col("method")).otherwise("dense"), "_b": F.when(avoided, F.col("selected_budget")).otherwise("full")})
    taken = F.filter("_rows", lambda r: (r["method"] == F.col("_m")) & (r["budget"] == F.col("_b")))
    first = lambda rows: F.array_min(F.transform(rows, lambda r: r["call"]))  # noqa: E731  of several that differ in split or dataset: the first intervention's
    acts = acts.select("sample_id", "method", "selected_budget", taken.alias("_taken"), F.filter("_rows", lambda r: r["method"] == "dense").alias("_dense"))
    acts = acts.select("sample_id", "method", "selected_budget", first(F.col("_taken")).alias("_call"), first(F.col("_dense")).alias("_full"), F.explode("_taken").alias("_label"))
    rows = acts.select(
        "sample_id", "method", "selected_budget", F.col("_call.is_correct").alias("task_correct"), "_call.energy_joule", "_call.latency_ms", "_call.token_count",
        F.col("_full.energy_joule").alias("dense_energy_joule"), F.col("_full.latency_ms").alias("dense_latency_ms"), *(f"_label.{c}" for c in OF_LABEL),
    )
    return _judged(rows, dense_tokens)


def outcomes(actions: DataFrame, calls: DataFrame, labels: DataFrame, dense_tokens: int = 576) -> DataFrame:
    """``actions`` (sample_id, method, selected_budget, ...) with what they cost and whether they were right to take.

    ``calls``: one original call per sample, method and budget; ``labels``: strict labels. ``dense`` as a budget stands for the full call. Given: task_correct,
    unsafe_acceptance (dense avoided though it wasn't safe), supported_correct, selected_tokens, energy_joule, latency_ms, dense_energy_joule, dense_latency_ms.
    """
    avoided = F.col("selected_budget") != "dense"
    keyed = actions.withColumns({"_m": F.when(avoided, F.col("method")).otherwise("dense"), "_b": F.when(avoided, F.col("selected_budget")).otherwise("full")})
    call = calls.select("sample_id", F.col("method").alias("_m"), F.col("budget").alias("_b"), F.col("is_correct").alias("task_correct"), "energy_joule", "latency_ms", "token_count")
    full = calls.where("method = 'dense'").select("sample_id", F.col("energy_joule").alias("dense_energy_joule"), F.col("latency_ms").alias("dense_latency_ms"))
    label = labels.select("sample_id", F.col("method").alias("_m"), F.col("budget").alias("_b"), *OF_LABEL)
    return _judged(keyed.join(call, ["sample_id", "_m", "_b"]).join(full, "sample_id").join(label, ["sample_id", "_m", "_b"]), dense_tokens)
