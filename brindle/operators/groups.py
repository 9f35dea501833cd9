"""Source groups, isolation, folds and draws."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.answers import stable_hash
from brindle.operators.graph import SALTS, components, salted_totals
from brindle.operators.prefixes import before
from brindle.sources.folders import written


def connected_groups(rows: DataFrame, key: str, *shared: str) -> DataFrame:
    """(key, root): rows that share a value of any of the columns are one group, named by its smallest key.

    Each value ties its rows to its smallest key: as many edges as rows, never pairs. Nulls tie nothing.
    """
    edges = None
    for c in shared:
        known = rows.where(F.col(c).isNotNull()).select(F.col(key).alias("b"), F.col(c).alias("value"), F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("salt"))
        # the rows of a hot value are dealt to parts, which are added up before they meet and joined part by part
        least, n = [F.min("b").alias("a"), F.count("*").alias("n")], [F.min("a").alias("a"), F.sum("n").alias("n")]
        tied = known.join(salted_totals(known, ["value"], "salt", least, n).where("n > 1"), ["value", "salt"]).select("a", "b").where("a <> b")
        edges = tied if edges is None else edges.unionByName(tied)
    found = components(edges)
    named = rows.select(key).distinct().join(found.withColumnRenamed("node", key), key, "left")
    return named.select(key, F.coalesce("root", key).alias("root"))


def group_name(root: Column) -> Column:
    """A group's public name: SHA-256 of its root."""
    return F.sha2(root.cast("string"), 256)


def templates(one: DataFrame, other: DataFrame, value: str, least: int = 5) -> DataFrame:
    """Values that occur at least so often in either table: questions that are templates and tie nothing."""
    count = lambda d: d.groupBy(value).agg(F.count("*").alias("n"))
    return count(one).unionByName(count(other)).where(F.col("n") >= least).select(value).distinct()


def isolated(rows: DataFrame, against: DataFrame, *columns: str) -> DataFrame:
    """Rows that share none of the columns' values with ``against``."""
    for c in columns:
        rows = rows.join(against.select(c).where(F.col(c).isNotNull()).distinct(), c, "left_anti")
    return rows


def take_by_hash(rows: DataFrame, n: int, seed: int, key: str, *within: str) -> DataFrame:
    """The n rows (per group of ``within``) whose keys have the smallest hashes: the same in every run, in any order of rows."""
    ranked = rows.withColumn("hash", stable_hash(F.lit(seed), *(F.col(c) for c in within), F.col(key)))
    if not within:
        return ranked.orderBy("hash", key).limit(n).drop("hash")
    w = Window.partitionBy(*within).orderBy("hash", key)
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("rank", "hash")


def round_robin(rows: DataFrame, n: int, seed: int, key: str, stratum: str) -> DataFrame:
    """n rows, one of each stratum in turn, each stratum in hash order; strata that run out are passed over."""
    w = Window.partitionBy(stratum).orderBy(stable_hash(F.lit(seed), F.col(stratum), F.col(key)), key)
    turns = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)  # tasks keep n rows of a stratum at most
    return turns.orderBy("turn", stratum).limit(n)


def balanced_allocation(capacity: dict[str, int], target: int) -> dict[str, int]:
    """How many to take of each stratum so that all are as even as their capacities allow; remainders go in order of name."""
    if sum(capacity.values()) < target:
        raise ValueError(f"{target} rows are asked for, {sum(capacity.values())} are there")
    taken = dict.fromkeys(sorted(capacity), 0)
    while left := target - sum(taken.values()):
        open_ = [k for k in taken if taken[k] < capacity[k]]
        each, more = divmod(left, len(open_))
        for i, k in enumerate(open_):
            taken[k] = min(capacity[k], taken[k] + (each or (i < more)))
    return taken


def allocate(rows: DataFrame, stratum: str, target: int) -> DataFrame:
    """(stratum, n): :func:`balanced_allocation` over a table with any number of strata.

    A level is sought to which all strata are filled: by capacity in order, with the sum of those before, it is the first even share of what is left that the
    stratum exceeds. Two numbers come to the driver, no stratum does.
    """
    caps = written(rows.groupBy(stratum).agg(F.count("*").alias("cap")), "capacities")
    total, strata = caps.agg(F.coalesce(F.sum("cap"), F.lit(0)), F.count("*")).first()
    if total < target:
        raise ValueError(f"{target} rows are asked for, {total} are there")
    placed = before(caps.withColumn("one", F.lit(1)), [], [F.col("cap"), F.col(stratum)], smaller=("sum", "cap"), nth=("sum", "one"))
    share = F.floor((F.lit(target) - F.coalesce("smaller", F.lit(0))) / (F.lit(strata) - F.coalesce("nth", F.lit(0))))
    level = placed.withColumn("share", share).where(F.col("cap") > F.col("share")).agg(F.min_by("share", F.coalesce("nth", F.lit(0)))).first()[0]
    if level is None:  # all there is
        return caps.select(stratum, F.col("cap").alias("n"))
    filled = F.least(F.col("cap"), F.lit(level))
    rest = target - caps.agg(F.sum(filled)).first()[0]
    more = caps.where(F.col("cap") > level).orderBy(stratum).limit(rest).select(F.col(stratum).alias("_more"))
    return caps.join(more, F.col(stratum).eqNullSafe(F.col("_more")) & F.col("_more").isNotNull(), "left").select(stratum, (filled + F.col("_more").isNotNull().cast("int")).alias("n"))


def stratified_take(rows: DataFrame, quota: DataFrame, seed: int, key: str, stratum: str) -> DataFrame:
    """Of each stratum as many rows as its quota (stratum, n), in hash order."""
    w = Window.partitionBy(stratum).orderBy(stable_hash(F.lit(seed), F.col(stratum), F.col(key)), key)
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked.join(quota.select(stratum, F.col("n").alias("_quota")), stratum).where(F.col("rank") <= F.col("_quota")).drop("rank", "_quota")


def fold_packing(sizes: dict[str, int], folds: int = 5) -> dict[str, int]:
    """Group -> fold: the largest groups first (then by hash of their names), each to the least loaded fold."""
    loads, placed = [0] * folds, {}
    for group in sorted(sizes, key=lambda g: (-sizes[g], hashlib.sha256(g.encode()).hexdigest())):
        fold = min(range(folds), key=lambda i: (loads[i], i))
        placed[group] = fold
        loads[fold] += sizes[group]
    return placed


def fold_runs(counts: dict[int, int], folds: int = 5) -> list[tuple[int, int, list[int]]]:
    """(size, rank of the first group, folds in turn): where groups of each size go, as :func:`fold_packing` puts them, from counts by size alone.

    Of a size, the folds that are less than one group above the least loaded take turns until the next fold is as near; so there are at most
    as many runs of a size as folds, however many groups there are.
    """
    loads, runs = [0] * folds, []
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            low = min(loads)
            turn = sorted((i for i in range(folds) if loads[i] < low + size), key=lambda i: (loads[i], i))
            others = [loads[i] for i in range(folds) if i not in turn]
            rounds = (min(others) - low) // size if others else left
            taken = min(left, rounds * len(turn))
            runs.append((size, rank, turn))
            for k, i in enumerate(turn):
                loads[i] += size * (taken // len(turn) + (k < taken % len(turn)))
            rank, left = rank + taken, left - taken
    return runs


def assign_folds(sizes: DataFrame, group: str, n: str, folds: int = 5) -> DataFrame:
    """``sizes`` (a row per group) with fold: the largest groups first, then by hash of their names, each to the least loaded fold.

    Only counts by size come to the driver. A group finds its fold by its rank among groups of its size; ranks come from counts by
    hash range and prefix sums over the ranges, so groups of one size are many tasks' work.
    """
    named = sizes.withColumns({"_h": F.sha2(F.col(group).cast("string"), 256)}).withColumn("_part", F.substring("_h", 1, 3))
    named = written(named, "fold-groups")
    parts = named.groupBy(n, "_part").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(n).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(n, "_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    counts = {r[0]: r[1] for r in parts.groupBy(n).agg(F.sum("_c")).collect()}  # a row per size
    runs = named.sparkSession.createDataFrame(fold_runs(counts, folds) or [(0, 0, [0])], "_size long, _from long, _turn array<int>")
    ends = runs.withColumn("_to", F.lead("_from").over(Window.partitionBy("_size").orderBy("_from")))
    rank = F.row_number().over(Window.partitionBy(n, "_part").orderBy("_h", group)) - 1
    ranked = named.join(bases, [n, "_part"]).withColumn("_rank", rank + F.col("_base"))
    met = ranked.join(ends, (F.col(n) == F.col("_size")) & (F.col("_rank") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("_rank") < F.col("_to"))))
    return met.select(*sizes.columns, F.get("_turn", ((F.col("_rank") - F.col("_from")) % F.size("_turn")).cast("int")).alias("fold"))


def quota_draws(pool: DataFrame, quotas: dict[str, int], seeds: Iterable[int], key: str, stratum: str, group: str) -> DataFrame:
    """Draws that share no group: per seed and stratum so many rows of different groups, in hash order.

    Draws are made one after the other; the groups of those before are taken out by an anti-join.
    """
    out = None
    allowed = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    for seed in seeds:
        free = pool if out is None else pool.join(out.select(group).distinct(), group, "left_anti")
        hashed = free.where(F.col(stratum).isin(*quotas)).withColumn("hash", stable_hash(F.lit(seed), F.col(stratum), F.col(key)))
        # a group goes to its first stratum by name, and has one row there
        one = hashed.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(stratum, "hash", key))).where("rn = 1")
        w = Window.partitionBy(stratum).orderBy("hash", key)
        drawn = one.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= allowed[F.col(stratum)]).drop("rn", "hash").withColumn("seed", F.lit(seed))
        out = drawn if out is None else out.unionByName(drawn)
    return out


def draws_overlap(draws: DataFrame, group: str) -> DataFrame:
    """Groups in more than one draw; empty for sound draws."""
    return draws.groupBy(group).agg(F.count_distinct("seed").alias("draws")).where("draws > 1")


def purposive_sample(rows: DataFrame, per_category: int, key: str, category: str, dataset: str) -> DataFrame:
    """So many rows of each category, datasets taking turns; a key counts for its first category only."""
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(category))).where("rn = 1").drop("rn")
    turn = F.row_number().over(Window.partitionBy(category, dataset).orderBy(stable_hash(F.col(category), F.col(key)), key))
    place = F.row_number().over(Window.partitionBy(category).orderBy("turn", dataset))
    return first.withColumn("turn", turn).withColumn("place", place).where(F.col("place") <= per_category).drop("turn")
