"""What stands before a row of its group: sums, counts and maxima over an order, without a task that holds a whole group.

Rows are dealt out by ranges of (group, order), so a group of any size lies over as many ranges as it needs. Each range is run through by itself; a row per range and
group carries what the ranges before hold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.folders import written

_KINDS = {"sum": F.sum, "max": F.max, "min": F.min}


def before(rows: DataFrame, by: list[str], order: list[Column], ranges: int | None = None, **columns: tuple[str, str]) -> DataFrame:
    """``rows`` with a column for each of ``columns`` (name: (kind, column)): the sum, max or min over the rows of the group that come before.

    Null where none comes before. ``order`` must tell the rows of a group apart, else equal ones may come in any order. ``ranges``: of how many parts.
    """
    keys = [F.col(b) for b in by]
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *keys, *order) if by or order else rows
    held = written(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    whole = held.groupBy("_range", *by).agg(*(_KINDS[kind](c).alias(f"_whole_{name}") for name, (kind, c) in columns.items()))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range of a group: a group that lies in one range has one
    bases = whole.select(F.col("_range").alias("_of"), *(F.col(b).alias(f"_of_{b}") for b in by), *(_KINDS[kind](f"_whole_{name}").over(earlier).alias(f"_base_{name}") for name, (kind, _) in columns.items()))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], F.col("_range") == F.col("_of"))
    here = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = held.join(bases, same)
    both = {"sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": F.greatest, "min": F.least}
    found = {name: both[kind](_KINDS[kind](c).over(here), F.col(f"_base_{name}")) for name, (kind, c) in columns.items()}
    return joined.withColumns(found).select(*rows.columns, *columns)


def exact_quantiles(rows: DataFrame, value: str, quantiles: dict[str, float], *by: str, lower: tuple[str, ...] = ()) -> DataFrame:
    """(by, a column for each quantile): interpolated between the two nearest places of a group's sorted values, or the lower one for names in ``lower``.

    Places come from counts of distinct values and what stands before them, so no task holds the distinct values of a group. Nulls are left out; groups
    without values have no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = before(counts, list(by), [F.col(value)], _first=("sum", "_n")).withColumn("_first", F.coalesce("_first", F.lit(0)))
    total = placed.groupBy(*by).agg(F.sum("_n").alias("_all"))
    same = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], F.lit(True))
    joined = placed.join(total.select("_all", *(F.col(b).alias(f"_of_{b}") for b in by)), same) if by else placed.crossJoin(total)  # one row
    at = lambda place: F.max(F.when((F.col("_first") <= place) & (place < F.col("_first") + F.col("_n")), F.col(value)))
    ends = []
    for name, q in quantiles.items():
        place = F.lit(float(q)) * (F.col("_all") - 1)
        ends += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}"), F.first(place - F.floor(place)).alias(f"_part_{name}")]
    found = joined.groupBy(*by).agg(*ends)
    between = lambda n: F.col(f"_low_{n}") if n in lower else F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")
    return found.select(*by, *(between(n).alias(n) for n in quantiles))
