"""Energy ledgers: emissions, cost, families of runs, grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.answers import family
from brindle.functions.numbers import r6

#: Scenarios of the site's overhead and the grid's kg CO2e per kWh, and USD per hour.
SCENARIOS = {"low": (1.1, 0.015), "central": (1.2, 0.03283), "high": (1.4, 0.08)}
USD_PER_HOUR = 2.0


def kwh(joule: Column) -> Column:
    return joule / 3.6e6


def emissions_kg(joule: Column, scenario: str = "central") -> Column:
    """kg CO2e of measured energy, with the site's overhead."""
    pue, intensity = SCENARIOS[scenario]
    return kwh(joule) * pue * intensity


def hourly_cost(seconds: Column, usd_per_hour: float = USD_PER_HOUR) -> Column:
    return seconds / 3600 * usd_per_hour


def with_carbon(runs: DataFrame) -> DataFrame:
    """``runs`` (energy_joule, duration_s) with energy_kwh, kg_low, kg_central, kg_high and usd."""
    e = F.col("energy_joule")
    kg = {f"kg_{n}": emissions_kg(e, n) for n in SCENARIOS}
    return runs.withColumns({"energy_kwh": kwh(e)} | kg | {"usd": hourly_cost(F.col("duration_s"))})


def family_rollup(runs: DataFrame, rules: tuple[tuple[str, str], ...], path: str = "path") -> DataFrame:
    """Per family and over all (``_all``): runs, energy, duration, emissions and cost. Runs without energy are left out."""
    rows = with_carbon(runs.where("energy_joule is not null")).withColumn("family", family(F.col(path), rules))
    sums = ["energy_kwh", "duration_s", *(f"kg_{n}" for n in SCENARIOS), "usd"]
    total = rows.rollup("family").agg(F.grouping("family").alias("_g"), F.count("*").alias("n_runs"), *(r6(F.sum(c)).alias(c) for c in sums))
    return total.withColumn("family", F.when(F.col("_g") == 1, "_all").otherwise(F.col("family"))).drop("_g")


def attempts_total(attempts: DataFrame, *by: str) -> DataFrame:
    """Energy and duration summed and memory's maximum over attempts that have energy."""
    return attempts.where("energy_joule is not null").groupBy(*by).agg(
        F.count("*").alias("n_attempts"), r6(F.sum("energy_joule")).alias("energy_joule"), r6(F.sum("duration_s")).alias("duration_s"), r6(F.max("memory_mb")).alias("memory_mb")
    )


def last_rows(rows: DataFrame, file: str, order: str) -> DataFrame:
    """The last row of each file by an explicit order: what a cumulative tracker file ends with."""
    return rows.groupBy(file).agg(F.max_by(F.struct(*[c for c in rows.columns if c != file]), order).alias("_last")).select(file, "_last.*")


def two_dimensions(rows: DataFrame, one: str, other: str, measures: dict[str, Column], *by: str) -> DataFrame:
    """Measures by each of two dimensions on its own, in one pass: (by, dimension, value, measures)."""
    grouped = rows.groupingSets([[*by, one], [*by, other]], *by, one, other).agg(
        F.grouping(one).alias("_g"), *(c.alias(n) for n, c in measures.items())
    )
    is_other = F.col("_g") == 1
    return grouped.select(*by, F.when(is_other, other).otherwise(one).alias("dimension"), F.when(is_other, F.col(other)).otherwise(F.col(one)).alias("value"), *measures)


def draw_rows(rows: DataFrame, measure: Column, *by: str) -> DataFrame:
    """One row per draw."""
    return rows.groupBy(*by, "draw").agg(F.count("*").alias("n"), measure.alias("value"))


def draw_aggregate(draws: DataFrame, *by: str) -> DataFrame:
    """Over draws: mean, sample deviation, whether all are above 0, and the pooled mean by their sizes."""
    return draws.groupBy(*by).agg(
        F.count("*").alias("n_draws"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("stdev"),
        F.every(F.col("value") > 0).alias("all_positive"), r6(F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("pooled"),
    )


def replication_gate(aggregate: DataFrame) -> DataFrame:
    """``strong``: positive in every draw and pooled; ``mixed``: pooled only; else ``failed``."""
    gate = F.when(F.col("all_positive") & (F.col("pooled") > 0), "strong").when(F.col("pooled") > 0, "mixed").otherwise("failed")
    return aggregate.withColumn("gate", gate)


def efficiency(points: DataFrame) -> DataFrame:
    """``points`` (accuracy, mean_latency_ms, mean_energy_joule, parameters, supported_rate) with rates per second, parameter, kWh, kg and USD."""
    energy, latency, accuracy = F.col("mean_energy_joule"), F.col("mean_latency_ms"), F.col("accuracy")
    return points.withColumns(
        {
            "throughput_per_second": 1000 / latency,
            "accuracy_per_billion_parameters": accuracy / (F.col("parameters") / 1e9),
            "correct_per_kwh": accuracy / kwh(energy),
            "correct_per_kg": accuracy / emissions_kg(energy),
            "supported_correct_per_kwh": F.col("supported_rate") / kwh(energy),
            "kg_per_query": emissions_kg(energy),
            "g_per_1000_queries": emissions_kg(energy) * 1e6,
            "usd_per_1000_queries": hourly_cost(latency / 1000) * 1000,
        }
    )
