"""Energy of calls from power samples: window means, nearest samples, integrals.

Plain range joins of calls and samples grow with the length of calls. Here samples and call bounds are put in one order within
buckets of time; running sums and the nearest samples on both sides come from windows over a bucket, and what came before a
bucket from a small table with a row per bucket. Each call then needs a fixed number of rows, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import r6

#: Seconds of a bucket: some thousand samples each at the rate of the telemetry.
BUCKET_SECONDS = 3600.0


def _bucket(c: Column) -> Column:
    return F.floor(c / BUCKET_SECONDS).cast("bigint")


def running_power(samples: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (id, at, inclusive) with what lies before each: n, sum (of power), area (of the trapezoids between
    samples), last and next (struct(epoch, power_w)).

    ``inclusive``: samples at the very time count as before. Samples of one time are taken in order of power.
    """
    s = samples.select(F.col("epoch").alias("at"), "power_w", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("id"))
    p = points.select("at", F.lit(None).cast("double").alias("power_w"), F.when(F.col("inclusive"), 2).otherwise(0).alias("kind"), "id")
    rows = s.unionByName(p).withColumn("bucket", _bucket(F.col("at")))
    order = Window.partitionBy("bucket").orderBy("at", "kind", "power_w")
    past = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what lies ahead comes from the reverse order: a frame that ends at the last row is worked out anew for each row
    ahead = Window.partitionBy("bucket").orderBy(F.desc("at"), F.desc("kind"), F.desc("power_w")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sample = F.when(F.col("kind") == 1, F.struct(F.col("at").alias("epoch"), "power_w"))
    before = F.last(sample, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("kind") == 1, (F.col("at") - before["epoch"]) * (F.col("power_w") + before["power_w"]) / 2)
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0.0)))
    inside = rows.select(
        "bucket", "id", "at", "kind",
        F.count("power_w").over(past).alias("n_"), F.coalesce(F.sum("power_w").over(past), F.lit(0.0)).alias("sum_"), F.sum("step").over(past).alias("area_"),
        F.last(sample, ignorenulls=True).over(past).alias("last_"), F.last(sample, ignorenulls=True).over(ahead).alias("next_"),
    )
    # a row per bucket: whole sums, first and last sample
    whole = rows.groupBy("bucket").agg(
        F.count("power_w").alias("n"), F.coalesce(F.sum("power_w"), F.lit(0.0)).alias("sum"), F.sum("step").alias("area"),
        F.min(sample).alias("first"), F.max(sample).alias("last"),
    )
    along = Window.orderBy("bucket")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.last("last", ignorenulls=True).over(earlier)
    tie = F.coalesce((F.col("first.epoch") - carried["epoch"]) * (F.col("first.power_w") + carried["power_w"]) / 2, F.lit(0.0))
    whole = whole.withColumn("tie", tie)  # the trapezoid that leads into a bucket
    none = F.lit(0.0)
    base = whole.select(
        "bucket", "tie",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_b"), F.coalesce(F.sum("sum").over(earlier), none).alias("sum_b"),
        F.coalesce(F.sum(F.col("area") + F.col("tie")).over(earlier), none).alias("area_b"), carried.alias("last_b"), F.last("first", ignorenulls=True).over(later).alias("next_b"),
    )
    got = inside.where("kind <> 1").join(base, "bucket")
    return got.select(
        "id", "at", (F.col("n_") + F.col("n_b")).alias("n"), (F.col("sum_") + F.col("sum_b")).alias("sum"),
        (F.col("area_") + F.col("area_b") + F.when(F.col("n_") > 0, F.col("tie")).otherwise(none)).alias("area"),
        F.coalesce("last_", "last_b").alias("last"), F.coalesce("next_", "next_b").alias("next"),
    )


def _both_ends(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Calls with what lies before their start and up to their end."""
    start = calls.select((F.col("call_id") * 2).alias("id"), F.col("start_epoch").alias("at"), F.lit(False).alias("inclusive"))
    end = calls.select((F.col("call_id") * 2 + 1).alias("id"), F.col("end_epoch").alias("at"), F.lit(True).alias("inclusive"))
    got = running_power(samples, start.unionByName(end))
    pick = lambda i: F.max(F.when(F.col("id") % 2 == i, F.struct("n", "sum", "area", "last", "next")))
    ends = got.groupBy(F.floor(F.col("id") / 2).cast("bigint").alias("call_id")).agg(pick(0).alias("a"), pick(1).alias("b"))
    return calls.join(ends, "call_id")


def nearest_sample(calls: DataFrame, samples: DataFrame, later_on_tie: bool = True) -> DataFrame:
    """Calls with nearest: the sample nearest to their midpoint; of two as near, the later (or the earlier) one."""
    mid = calls.select(F.col("call_id").alias("id"), ((F.col("start_epoch") + F.col("end_epoch")) / 2).alias("at"), F.lit(False).alias("inclusive"))
    got = running_power(samples, mid)
    before, after = F.col("at") - F.col("last.epoch"), F.col("next.epoch") - F.col("at")
    late = (after <= before) if later_on_tie else (after < before)
    nearest = F.when(F.col("last").isNull() | (F.col("next").isNotNull() & late), F.col("next")).otherwise(F.col("last"))
    return calls.join(got.select(F.col("id").alias("call_id"), nearest.alias("nearest")), "call_id")


def attribute(calls: DataFrame, samples: DataFrame, later_on_tie: bool = True) -> DataFrame:
    """Calls with n_samples, mean_power_w and energy_joule.

    Mean power of the samples from start to end, both included, or the nearest sample's if there are none, times
    the duration. Null for calls that don't end after they start, or without any sample.
    """
    ends = _both_ends(calls, samples)
    near = nearest_sample(calls.select("call_id", "start_epoch", "end_epoch"), samples, later_on_tie).select("call_id", "nearest")
    rows = ends.join(near, "call_id").withColumn("n_samples", F.col("b.n") - F.col("a.n"))
    mean = F.when(F.col("n_samples") > 0, (F.col("b.sum") - F.col("a.sum")) / F.col("n_samples")).otherwise(F.col("nearest.power_w"))
    valid = F.col("end_epoch") > F.col("start_epoch")
    rows = rows.withColumn("mean_power_w", F.when(valid, mean))
    return rows.withColumn("energy_joule", F.col("mean_power_w") * (F.col("end_epoch") - F.col("start_epoch"))).drop("a", "b", "nearest")


def trapezoid(calls: DataFrame, samples: DataFrame) -> DataFrame:
    """Calls with energy_joule: the integral of power over samples joined by lines; null with fewer than two points.

    At an edge within the telemetry the power is held at the nearest sample outside; before the first and after the last
    sample there is no area.
    """
    rows = _both_ends(calls, samples).withColumns({"n": F.col("b.n") - F.col("a.n"), "i": F.col("a.next"), "j": F.col("b.last")})
    before, after = F.col("a.last"), F.col("b.next")
    has = F.col("n") > 0
    # samples inside, then the pieces at the edges
    inner = F.when(has, F.col("b.area") - F.col("a.area") - F.coalesce((F.col("i.epoch") - before["epoch"]) * (F.col("i.power_w") + before["power_w"]) / 2, F.lit(0.0)))
    left = F.when(has & before.isNotNull(), (F.col("i.epoch") - F.col("start_epoch")) * (F.col("i.power_w") + before["power_w"]) / 2).otherwise(0.0)
    right = F.when(has & after.isNotNull(), (F.col("end_epoch") - F.col("j.epoch")) * (F.col("j.power_w") + after["power_w"]) / 2).otherwise(0.0)
    empty = F.when(before.isNotNull() & after.isNotNull(), (F.col("end_epoch") - F.col("start_epoch")) * (before["power_w"] + after["power_w"]) / 2)
    points = F.col("n") + before.isNotNull().cast("int") + after.isNotNull().cast("int")
    energy = F.when(points >= 2, F.when(has, inner + left + right).otherwise(empty))
    return rows.withColumn("energy_joule", energy).drop("a", "b", "i", "j", "n")


def telemetry_summary(samples: DataFrame, *by: str) -> DataFrame:
    """Samples, mean, median and largest power, duration, and mean power times duration."""
    seconds = F.max("epoch") - F.min("epoch")
    return samples.groupBy(*by).agg(
        F.count("*").alias("n"), r6(F.avg("power_w")).alias("mean_power_w"), r6(F.median("power_w")).alias("median_power_w"),
        r6(F.max("power_w")).alias("max_power_w"), r6(seconds).alias("duration_s"), r6(F.avg("power_w") * seconds).alias("energy_joule"),
    )


def by_method_budget(calls: DataFrame) -> DataFrame:
    """Per method and budget: records, distinct calls (the first of each key), those measured, and energies.

    ``calls``: attributed, with sample_id, method, budget, start_epoch, end_epoch.
    """
    key = ["sample_id", "method", "budget", F.round("start_epoch", 6), F.round("end_epoch", 6)]
    first = calls.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("call_id")))
    one = F.col("rn") == 1
    energy = F.when(one, F.col("energy_joule"))
    return first.groupBy("method", "budget").agg(
        F.count("*").alias("n"), F.count_if(one).alias("n_unique_calls"), F.count(energy).alias("n_measured_calls"),
        r6(F.sum(energy)).alias("total_measured_energy_joule"), r6(F.sum(energy) / F.count("*")).alias("mean_measured_energy_per_record_joule"),
        r6(F.avg(energy)).alias("mean_measured_energy_per_call_joule"),
    )


def enrich(records: DataFrame, calls: DataFrame) -> DataFrame:
    """Records with the energy of their calls (original and intervened), nulls skipped; joined by key, not by place."""
    total = calls.groupBy("sample_id", "method", "budget").agg(F.sum("energy_joule").alias("measured_energy_joule"), F.count("energy_joule").alias("n_measured"))
    return records.join(total, ["sample_id", "method", "budget"], "left")
