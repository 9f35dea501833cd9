"""Queries over power telemetry and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import energy
from brindle.sources.adapters import view, with_views


def _r(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


def _both(s, sf):
    return view(s, sf, "calls"), view(s, sf, "power_samples")


_HEAD = with_views("calls", "power_samples")
_NEAR = """near AS (SELECT call_id, power_w, epoch FROM (SELECT c.call_id, p.power_w, p.epoch, row_number() OVER (PARTITION BY c.call_id
             ORDER BY abs(p.epoch - (c.start_epoch + c.end_epoch) / 2), p.epoch {tie}) AS rn FROM calls c CROSS JOIN power_samples p) WHERE rn = 1)"""
_ATTR = f"""{_HEAD}, {_NEAR.format(tie="DESC")},
   win AS (SELECT c.call_id, count(p.epoch) AS n_samples, avg(p.power_w) AS m FROM calls c LEFT JOIN power_samples p ON p.epoch >= c.start_epoch AND p.epoch <= c.end_epoch GROUP BY c.call_id),
   att AS (SELECT c.*, w.n_samples, CASE WHEN c.end_epoch > c.start_epoch THEN coalesce(w.m, n.power_w) END AS mean_power_w,
                  CASE WHEN c.end_epoch > c.start_epoch THEN coalesce(w.m, n.power_w) END * (c.end_epoch - c.start_epoch) AS energy_joule
           FROM calls c JOIN win w USING (call_id) JOIN near n USING (call_id))"""

QUERIES = {
    "energy_window_mean": (
        lambda s, sf: energy.attribute(*_both(s, sf)).select("call_id", "method", "budget", "n_samples", F.round(F.col("mean_power_w") + 1e-6, 4).alias("mean_power_w"), F.round(F.col("energy_joule") + 1e-5, 2).alias("energy_joule")),
        f"{_ATTR} SELECT call_id, method, budget, n_samples, round(mean_power_w + 1e-6, 4) AS mean_power_w, round(energy_joule + 1e-5, 2) AS energy_joule FROM att",
    ),
    "energy_nearest": (
        lambda s, sf: energy.nearest_sample(*_both(s, sf)).select("call_id", F.col("nearest.power_w").alias("power_w"), F.col("nearest.epoch").alias("epoch")),
        f"{_HEAD}, {_NEAR.format(tie='DESC')} SELECT call_id, power_w, epoch FROM near",
    ),
    "energy_nearest_earlier": (
        lambda s, sf: energy.nearest_sample(*_both(s, sf), later_on_tie=False).select("call_id", F.col("nearest.power_w").alias("power_w"), F.col("nearest.epoch").alias("epoch")),
        f"{_HEAD}, {_NEAR.format(tie='ASC')} SELECT call_id, power_w, epoch FROM near",
    ),
    "energy_by_method_budget": (
        lambda s, sf: energy.by_method_budget(energy.attribute(*_both(s, sf))).select("method", "budget", "n", "n_unique_calls", "n_measured_calls", *(F.round(c, 2).alias(c) for c in ("total_measured_energy_joule", "mean_measured_energy_per_record_joule", "mean_measured_energy_per_call_joule"))),
        f"""{_ATTR} SELECT method, budget, count(*) AS n, count(*) AS n_unique_calls, count(energy_joule) AS n_measured_calls, round(sum(energy_joule), 2) AS total_measured_energy_joule,
            round(sum(energy_joule) / count(*), 2) AS mean_measured_energy_per_record_joule, round(avg(energy_joule), 2) AS mean_measured_energy_per_call_joule FROM att GROUP BY ALL""",
    ),
    "energy_trapezoid": (
        lambda s, sf: energy.trapezoid(*_both(s, sf)).select("call_id", F.round(F.col("energy_joule") + 1e-5, 2).alias("energy_joule")),
        f"""{_HEAD}, pts AS (
              SELECT c.call_id, p.epoch AS t, p.power_w AS w, 1 AS k FROM calls c JOIN power_samples p ON p.epoch >= c.start_epoch AND p.epoch <= c.end_epoch
              UNION ALL SELECT c.call_id, c.start_epoch, arg_max(p.power_w, p.epoch), 0 FROM calls c JOIN power_samples p ON p.epoch < c.start_epoch GROUP BY c.call_id, c.start_epoch
              UNION ALL SELECT c.call_id, c.end_epoch, arg_min(p.power_w, p.epoch), 2 FROM calls c JOIN power_samples p ON p.epoch > c.end_epoch GROUP BY c.call_id, c.end_epoch),
            seg AS (SELECT call_id, (lead(t) OVER w - t) * (lead(w) OVER w + w) / 2 AS a, count(*) OVER (PARTITION BY call_id) AS n FROM pts WINDOW w AS (PARTITION BY call_id ORDER BY t, k))
            SELECT c.call_id, round(CASE WHEN max(n) >= 2 THEN sum(a) END + 1e-5, 2) AS energy_joule FROM calls c LEFT JOIN seg USING (call_id) GROUP BY c.call_id""",
    ),
    "telemetry_summary": (
        lambda s, sf: energy.telemetry_summary(view(s, sf, "power_samples").withColumn("day", F.floor(F.col("epoch") / 86400).cast("bigint")), "day"),
        f"""{_HEAD} SELECT floor(epoch / 86400)::BIGINT AS day, count(*) AS n, {_r("avg(power_w)")} AS mean_power_w, {_r("median(power_w)")} AS median_power_w, {_r("max(power_w)")} AS max_power_w,
            {_r("max(epoch) - min(epoch)")} AS duration_s, {_r("avg(power_w) * (max(epoch) - min(epoch))")} AS energy_joule FROM power_samples GROUP BY 1""",
    ),
    "energy_enriched_records": (
        lambda s, sf: energy.enrich(view(s, sf, "calls").select("sample_id", "method", "budget").distinct(), energy.attribute(*_both(s, sf))).groupBy("method").agg(F.count("*").alias("n"), F.sum("n_measured").alias("n_measured"), F.round(F.sum("measured_energy_joule"), 1).alias("energy_joule")),
        f"{_ATTR} SELECT method, count(DISTINCT (sample_id, budget)) AS n, count(energy_joule)::BIGINT AS n_measured, round(sum(energy_joule), 1) AS energy_joule FROM att GROUP BY method",
    ),
}
