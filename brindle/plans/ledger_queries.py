"""Queries over run ledgers, draws and replications."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.numbers import r6
from brindle.operators import ledger
from brindle.sources.adapters import view, with_views

_RUNS, _R = with_views("runs"), with_views("eval_records")
RULES = (("urgent", "urgent"), ("high", "high"), ("low", "low"), ("1-", "urgent_by_number"))
_FAMILY = "CASE " + " ".join(f"WHEN contains(lower(path), '{p}') THEN '{n}'" for p, n in RULES) + " ELSE 'other' END"
_KG = {n: f"energy_joule / 3.6e6::DOUBLE * {p} * {v}" for n, (p, v) in ledger.SCENARIOS.items()}


def _r(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


def _draws(s, sf):
    rows = view(s, sf, "eval_records").where("method <> 'dense'").withColumn("draw", F.col("sample_id") % 3)
    return ledger.draw_rows(rows, F.avg("delta_vem"), "method")


_DRAWS_SQL = f"{_R}, dr AS (SELECT method, sample_id % 3 AS draw, count(*) AS n, avg(delta_vem) AS value FROM eval_records WHERE method <> 'dense' GROUP BY ALL)"
_AGG_SQL = f"""ag AS (SELECT method, count(*) AS n_draws, {_r("avg(value)")} AS mean, {_r("stddev_samp(value)")} AS stdev, bool_and(value > 0) AS all_positive, {_r("sum(value * n) / sum(n)")} AS pooled FROM dr GROUP BY method)"""


def _two(s, sf):
    measures = {"n": F.count("*"), "accuracy": r6(F.avg(F.col("is_correct").cast("int"))), "mean_cost": r6(F.avg("cost"))}
    return ledger.two_dimensions(view(s, sf, "eval_records"), "dataset", "split", measures, "method")


def _efficiency(s, sf):
    cells = view(s, sf, "eval_records").groupBy("method", "budget").agg(
        F.avg(F.col("is_correct").cast("int")).alias("accuracy"), F.avg("latency_ms").alias("mean_latency_ms"), F.avg("energy_joule").alias("mean_energy_joule"), F.avg((F.col("vem") >= 0).cast("int")).alias("supported_rate")
    )
    rows = ledger.efficiency(cells.withColumn("parameters", F.lit(7e9)))
    return rows.select("method", "budget", *(r6(c).alias(c) for c in ("throughput_per_second", "accuracy_per_billion_parameters", "kg_per_query", "g_per_1000_queries", "usd_per_1000_queries")))


QUERIES = {
    "resource_efficiency": (
        _efficiency,
        f"""{_R}, c AS (SELECT method, budget, avg(is_correct::INT) AS a, avg(latency_ms) AS l, avg(energy_joule) AS e FROM eval_records GROUP BY ALL)
            SELECT method, budget, {_r("1000 / l")} AS throughput_per_second, {_r("a / 7")} AS accuracy_per_billion_parameters, {_r("e / 3.6e6::DOUBLE * 1.2 * 0.03283")} AS kg_per_query,
                   {_r("e / 3.6e6::DOUBLE * 1.2 * 0.03283 * 1e6")} AS g_per_1000_queries, {_r("l / 1000 / 3600 * 2.0 * 1000")} AS usd_per_1000_queries FROM c""",
    ),
    "carbon_ledger_rollup": (
        lambda s, sf: ledger.family_rollup(view(s, sf, "runs"), RULES),
        f"""{_RUNS}, f AS (SELECT *, {_FAMILY} AS fam FROM runs WHERE energy_joule IS NOT NULL)
            SELECT CASE WHEN grouping(fam) = 1 THEN '_all' ELSE fam END AS family, count(*) AS n_runs, {_r("sum(energy_joule / 3.6e6::DOUBLE)")} AS energy_kwh, {_r("sum(duration_s)")} AS duration_s,
                   {", ".join(f"{_r(f'sum({x})')} AS kg_{n}" for n, x in _KG.items())}, {_r("sum(duration_s / 3600 * 2.0)")} AS usd FROM f GROUP BY ROLLUP (fam)""",
    ),
    "carbon_per_run": (
        lambda s, sf: ledger.with_carbon(view(s, sf, "runs")).select("run_id", *(r6(c).alias(c) for c in ("energy_kwh", "kg_low", "kg_central", "kg_high", "usd"))),
        f"{_RUNS} SELECT run_id, {_r('energy_joule / 3.6e6::DOUBLE')} AS energy_kwh, {', '.join(f'{_r(x)} AS kg_{n}' for n, x in _KG.items())}, {_r('duration_s / 3600 * 2.0')} AS usd FROM runs",
    ),
    "attempts_total": (
        lambda s, sf: ledger.attempts_total(view(s, sf, "runs").withColumn("memory_mb", F.col("duration_s") * 2), "status"),
        f"{_RUNS} SELECT status, count(*) AS n_attempts, {_r('sum(energy_joule)')} AS energy_joule, {_r('sum(duration_s)')} AS duration_s, {_r('max(duration_s * 2)')} AS memory_mb FROM runs WHERE energy_joule IS NOT NULL GROUP BY status",
    ),
    "tracker_last_rows": (
        lambda s, sf: ledger.last_rows(view(s, sf, "runs").select("path", "run_id", "energy_joule"), "path", "run_id"),
        f"{_RUNS} SELECT path, max(run_id) AS run_id, arg_max(energy_joule, run_id) AS energy_joule FROM runs GROUP BY path",
    ),
    "provenance_grouping_sets": (
        _two,
        f"""{_R} SELECT method, CASE WHEN grouping(dataset) = 1 THEN 'split' ELSE 'dataset' END AS dimension, CASE WHEN grouping(dataset) = 1 THEN split ELSE dataset END AS value,
            count(*) AS n, {_r("avg(is_correct::INT)")} AS accuracy, {_r("avg(cost)")} AS mean_cost FROM eval_records GROUP BY GROUPING SETS ((method, dataset), (method, split))""",
    ),
    "draw_rows": (
        lambda s, sf: _draws(s, sf).withColumn("value", r6("value")),
        f"{_DRAWS_SQL} SELECT method, draw, n, {_r('value')} AS value FROM dr",
    ),
    "draw_aggregate": (lambda s, sf: ledger.draw_aggregate(_draws(s, sf), "method"), f"{_DRAWS_SQL}, {_AGG_SQL} SELECT * FROM ag"),
    "replication_gate": (
        lambda s, sf: ledger.replication_gate(ledger.draw_aggregate(_draws(s, sf), "method")),
        f"{_DRAWS_SQL}, {_AGG_SQL} SELECT *, CASE WHEN all_positive AND pooled > 0 THEN 'strong' WHEN pooled > 0 THEN 'mixed' ELSE 'failed' END AS gate FROM ag",
    ),
}
