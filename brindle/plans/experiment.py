"""A whole run: samples, grid, scores, records, policies, and the artifacts that report it."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.answers import stable_seed
from brindle.functions.numbers import budget_order
from brindle.operators import policy, records, reports, safety, selection, stats, summary
from brindle.plans import resumable
from brindle.sources import readers, store, writers
from brindle.sources.folders import written

DRAWS = 500
#: What a run leaves, by name.
ARTIFACTS = {
    "records_jsonl": "records.jsonl", "summary_csv": "summary_by_method_budget.csv", "decisions_jsonl": "policy_decisions.jsonl", "decision_summary_json": "policy_summary.json",
    "decision_by_dataset_csv": "policy_by_dataset.csv", "dense_reliance_audit_csv": "dense_reliance_audit.csv", "budget_curve_csv": "budget_curve_dense_reliant.csv",
    "policy_macro_csv": "policy_macro_summary.csv", "bootstrap_ci_csv": "bootstrap_ci.csv", "paired_bootstrap_ci_csv": "paired_bootstrap_ci.csv", "ablation_summary_csv": "ablation_summary.csv",
    "resource_summary_json": "resource_summary.json", "resource_table_csv": "resource_table.csv", "claims_json": "claims.json", "main_table_csv": "main_table.csv", "report_md": "report.md",
    "qualitative_json": "qualitative_examples.json", "frontier_svg": "frontier_latency_rr.svg", "policy_comparison_csv": "policy_comparison.csv",
}


def _rows(df: DataFrame, most: int = 10_000) -> list[dict]:
    """A report's rows; more than ``most`` is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report")
    return [r.asDict(recursive=True) for r in rows]


def score_grid(spark: SparkSession, config: dict[str, Any], cell: resumable.Cell | None = None, known_dense: DataFrame | None = None) -> DataFrame:
    """Records of a run with the synthetic scorer: every sample, intervention, method and budget, on the original and the changed input.

    ``cell``: of this one alone; a pruned cell takes its dense margins from ``known_dense``, the records of the dense one.
    """
    spec, pruning, cost = config["dataset"], config["pruning"], config.get("cost", {})
    samples = readers.repair_options(readers.samples(spark, readers.resolve_path(config, spec["path"]), spec["name"], spec.get("limit")))
    if samples.isEmpty():
        raise ValueError(f"no samples in {spec['path']}")
    specs = selection.intervention_specs(config["interventions"])
    interventions = spark.createDataFrame([(s["name"], s["type"], s["applies_to"]) for s in specs], "intervention string, kind string, applies_to array<string>")
    dense = str(pruning.get("dense_budget", "full"))
    cells = [("dense", dense)] + [(m, str(b)) for m in pruning.get("methods", []) for b in pruning["budget_schedule"]]
    cells = [(cell.method, cell.budget)] if cell else cells
    grid = selection.run_grid(samples, interventions, spark.createDataFrame(cells, "method string, budget string"))
    grid = grid.where((F.col("kind") != "counterfactual") | F.col("counterfactual_image_path").isNotNull()).drop("kind")
    tokens, seed = int(cost.get("dense_token_count") or 64), int(config.get("seed", 0))
    signal = (stable_seed(F.lit(seed), F.col("sample_id")) % 100 / 400.0).cast("double")  # stands in for an image's saliency
    changed = grid.withColumn("signal", signal)
    on = lambda df, side: selection.synthetic_scores(df, seed, tokens).select(
        *[c for c in grid.columns], F.col("answer_given").alias(f"{side}_answer"), F.col("logprob").alias(f"{side}_logprob"), F.col("confidence").alias(f"{side}_confidence"), F.col("latency_ms").alias(f"{side}_latency_ms")
    )
    original = on(changed.withColumn("_i", F.col("intervention")).withColumn("intervention", F.lit("none")), "original").select("sample_id", "method", "budget", "original_answer", "original_logprob", "original_confidence", "original_latency_ms").distinct()
    pairs = on(changed, "intervened").drop("intervened_confidence").join(original, ["sample_id", "method", "budget"])
    unknown = {f"{s}_{c}": F.lit(None).cast("double") for s in ("original", "intervened") for c in ("api_cost_usd", "measured_energy_joule", "api_prompt_tokens", "api_completion_tokens", "api_total_tokens")}
    pairs = pairs.withColumns(unknown | {"gold_answer": F.col("answer"), "score_type": F.lit("score_vem"), "token_count": selection.kept(F.col("budget"), F.lit(tokens))})
    if cost.get("base_ms") is not None:  # a run may state what calls take
        ms = float(cost["base_ms"]) + float(cost.get("per_token_ms", 1.0)) * F.col("token_count")
        pairs = pairs.withColumns({"original_latency_ms": ms, "intervened_latency_ms": F.lit(0.0)})
    scored = records.evaluate(pairs, float(cost.get("dollar_per_1k_ms", 0.0)), float(cost.get("energy_joule_per_ms", 0.0)))
    if known_dense is not None:
        scored = scored.unionByName(known_dense.select("sample_id", "method", "budget", "intervention", "vem"), allowMissingColumns=True)
    made = records.with_dense(scored)
    made = made.where(F.col("method") == cell.method) if cell else made
    return made.select(
        "sample_id", "split", "dataset", "method", "budget", "intervention", F.col("original_answer").alias("answer"), "gold_answer", "is_correct", F.col("original_logprob").alias("logprob_original"),
        F.col("intervened_logprob").alias("logprob_intervened"), F.col("original_confidence").alias("confidence"), "vem", "dense_vem", "reliance_retention", "delta_vem", "shortcut_persistence", "latency_ms",
        "token_count", "cost", "energy_joule", "measured_energy_joule", "proxy_energy_joule", "api_cost_usd", "support_metric",
    )


def calibrated(recs: DataFrame, config: dict[str, Any]) -> dict[str, Any]:
    """The thresholds of the grid that serve the validation split best."""
    spec = config["policy"]
    low = float(spec.get("dense_vem_min", 0.0))
    rhos = [float(r) for r in spec.get("rho_grid", [])] if spec.get("prefer_rr", True) else []
    grid = [{"setting": f"{i:04d}", "tau": float(t), "rho": r, "dense_vem_min": low} for i, (t, r) in enumerate((t, r) for t in spec["tau_grid"] for r in (rhos or [None]))]
    best = policy.calibration(recs, policy.settings(recs.sparkSession, grid)).where("chosen").collect()
    return {k: v for k, v in grid[int(best[0]["setting"]) if best else 0].items() if k != "setting"}


def analyze(spark: SparkSession, config: dict[str, Any], recs: DataFrame, out_dir: str) -> dict[str, Any]:
    """Policies, summaries, intervals and reports over records; every artifact is written, and named in the result.

    Tables of a row per record or decision are written by Spark; reports have a row per policy, dataset or budget.
    """
    paths = {k: store.join(out_dir, v) for k, v in ARTIFACTS.items()}
    pruning, test_split = config["pruning"], config["dataset"].get("test_split", "test")
    methods, schedule = [str(m) for m in pruning.get("methods", [])], [str(b) for b in pruning.get("budget_schedule") or [pruning.get("dense_budget", "full")]]
    known = written(recs.withColumns({"budget_ord": budget_order(F.col("budget")), "split": F.when(F.col("split") == test_split, "test").otherwise(F.col("split"))}), "run-records")
    at = calibrated(known, config)
    test = known.where("split = 'test'")
    budgets, used = tuple(sorted({*schedule, "full"})), tuple(sorted({*methods, "dense"}))
    summed = lambda df, *by: summary.decision_summary(df, *by, budgets=budgets, methods=used)
    sets = policy.decision_sets(known, methods, schedule, **at)
    sets = written(sets if methods else sets.where("setting = 'dense_only'"), "run-decisions")
    main = "supported" if methods else "dense_only"
    decisions = sets.where(F.col("setting") == main)
    comparison = written(summed(sets, "setting"), "run-comparison")
    audit = summary.reliance_audit(policy.with_eligible(test, policy.settings(spark, [{"setting": main, **at}])))
    curve = [{"setting": "dense_full", **at, "fixed_method": "dense", "fixed_budget": str(pruning.get("dense_budget", "full"))}] + [{"setting": f"{m}_{b}", **at, "fixed_method": m, "fixed_budget": b} for m in methods for b in schedule]
    names = [r[0] for r in test.select("intervention").distinct().collect()]
    subsets = {**{f"only_{n}": [n] for n in names}, "all_non_counterfactual": [n for n in names if n != "counterfactual"], "all_available": names}
    ablations = [{"setting": f"tau={t},rho={r}", **at, "tau": t, "rho": r} for t in (0.1, 0.25, 0.5, 0.75, 1.0) for r in ((0.5, 0.7, 0.9) if at["rho"] is not None else (None,))]
    ablations += [{"setting": k, **at, "interventions": v} for k, v in subsets.items() if v] + [{"setting": "without_dense_reliance", **at, "require_reliance": False}]
    draws, seed = int(config.get("analysis", {}).get("bootstrap_iterations", DRAWS)), int(config.get("seed", 13))
    aggressive = f"{methods[0]}_fixed_aggressive" if methods else None
    policies = reports.policy_names(methods, schedule)
    by_cell = summary.record_summary(known)
    csv = {
        "summary_csv": by_cell,
        "decision_by_dataset_csv": summed(decisions, "dataset"),
        "dense_reliance_audit_csv": audit,
        "budget_curve_csv": summed(policy.fixed_budget(test, policy.settings(spark, curve)), "setting", "selected_method", "selected_budget"),
        "policy_macro_csv": summary.macro_summary(sets),
        "bootstrap_ci_csv": stats.decision_bootstrap(sets, draws, seed, "setting"),
        "paired_bootstrap_ci_csv": stats.paired_bootstrap(sets, [n for n in ("dense_only", aggressive, "supported") if n], draws, seed + 997),
        "ablation_summary_csv": summed(policy.cheapest_supported(test, policy.settings(spark, ablations)), "setting"),
        "resource_table_csv": comparison.select("setting", "n", "accuracy", "visually_supported_rate", "mean_token_count", "mean_token_reduction", "mean_retained_token_ratio", "mean_speedup_vs_dense", "cost_per_visually_supported_answer", "measured_energy_per_visually_supported_answer_joule", "mean_measured_energy_joule", "total_measured_energy_joule", "dense_avoidance_rate", "mean_escalations", "selected_budget_distribution"),
        "main_table_csv": reports.comparison_table(comparison, policies).orderBy("place", "policy"),
        "policy_comparison_csv": comparison,
    }
    for name, table in csv.items():
        writers.write_csv(table, paths[name], overwrite=True)
    writers.write_jsonl(recs, paths["records_jsonl"], overwrite=True)
    writers.write_jsonl(sets, paths["decisions_jsonl"], overwrite=True)
    compared = {r["setting"]: {k: v for k, v in r.items() if k != "setting"} for r in _rows(comparison)}
    (claimed,) = _rows(reports.claims(comparison, audit, aggressive, policies.get(aggressive, "")))
    sentences = claimed.pop("sentences").split("\n")
    writers.put_json(spark, {"run_name": config["run_name"], "thresholds": at, "policy": compared.get(main, {}), "baselines": compared}, paths["decision_summary_json"])
    writers.put_json(spark, {"policy": compared.get(main, {}), "dense_only": compared.get("dense_only", {}), "fixed_aggressive_reference_key": aggressive, "fixed_aggressive_reference": compared.get(aggressive, {}), "claim_deltas": claimed}, paths["resource_summary_json"])
    writers.put_json(spark, {"run_name": config["run_name"], "thresholds": at, "claim_deltas": claimed, "claim_sentences": sentences, "dense_reliance_audit": _rows(audit.where("dataset = '_all'"))}, paths["claims_json"])
    writers.put_json(spark, _rows(summary.qualitative_top(known)), paths["qualitative_json"])
    first = config["interventions"][0]["name"]
    store.write_bytes(spark, paths["frontier_svg"], writers.frontier_svg(_rows(by_cell.where(F.col("intervention") == first)), f"{config['run_name']}: latency and retention").encode())
    table = writers.markdown_table(reports.comparison_table(comparison, policies).orderBy("place", "policy"), ["label", "n", *reports.PERCENT, "mean_token_count"])
    store.write_bytes(spark, paths["report_md"], (f"# {config['run_name']}\n\n" + "\n".join(f"* {s}" for s in sentences) + f"\n\n{table}\n").encode())
    return {"n_decisions": decisions.count(), "thresholds": at, "decision_summary": compared.get(main, {}), "artifacts": paths}


def resumed_scores(spark: SparkSession, config: dict[str, Any], folder: str, at_most: int | None = None) -> resumable.Run:
    """Scores a run's grid cell by cell in a folder that says which cells are finished; after a stop it goes on where it was."""
    pruning = config["pruning"]
    planned = resumable.cells(pruning.get("methods", []), pruning.get("budget_schedule", []), str(pruning.get("dense_budget", "full")))
    plan = {k: v for k, v in config.items() if not k.startswith("_") and k not in ("analysis", "outputs", "policy")}
    return resumable.run_grid(spark, folder, plan, planned, lambda cell, dense: score_grid(spark, config, cell, dense), at_most)


def run(spark: SparkSession, config: dict[str, Any], resume: bool = False) -> dict[str, Any]:
    """Scores a run's grid and analyses its records. Only the synthetic scorer is built in; others make records of their own for :func:`analyze`.

    ``resume``: the grid is scored cell by cell beside the artifacts, and cells that are finished there are taken as they are.
    """
    if (name := config["backend"]["name"]) != "deterministic":
        raise ValueError(f"the scorer {name!r} isn't built in; write records with it and analyse those")
    out = readers.resolve_path(config, config["outputs"]["dir"])
    recs = resumed_scores(spark, config, store.join(out, "grid")).records() if resume else written(score_grid(spark, config), "run-scores")
    return {"run_name": config["run_name"], "output_dir": out, "n_records": recs.count(), **analyze(spark, config, recs, out)}


def analyze_existing(spark: SparkSession, config: dict[str, Any], path: str, out_dir: str, run_name: str | None = None) -> dict[str, Any]:
    """The artifacts of records that an earlier run wrote."""
    recs = readers.records(spark, path)
    return {"output_dir": out_dir, "n_records": recs.count(), **analyze(spark, config | ({"run_name": run_name} if run_name else {}), recs, out_dir)}


def strict_audit(recs: DataFrame, threshold: float = safety.RELIANT) -> dict[str, DataFrame]:
    """All that is said about strict safety: labels, patterns, populations, coverage, fixed budgets, costs at the boundary and leaked splits."""
    recs = recs.withColumn("budget_ord", budget_order(F.col("budget")))
    labels = written(safety.strict_labels(recs, threshold), "strict-labels")
    found = safety.patterns(labels)
    calls = summary.first_calls(recs)
    return {
        "labels": labels,
        "monotonicity": found,
        "pattern_counts": safety.pattern_counts(found),
        "populations": safety.populations(labels),
        "coverage": summary.strict_coverage(labels, "split"),
        "fixed_budgets": summary.fixed_budget_summary(labels, calls),
        "cost_boundary": summary.cost_boundary(recs),
        "dense_states": safety.dense_states(recs, threshold),
        "split_leakage": summary.split_leakage(recs.select("sample_id", "split").distinct(), "sample_id"),
    }
