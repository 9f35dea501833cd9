"""Completeness and consistency checks: tables of what is wrong, empty for sound data, and gates that raise."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class IntegrityError(ValueError):
    """A check found rows."""


def demand_empty(problems: DataFrame, what: str, shown: int = 5) -> None:
    """Raises with a few of the rows if there are any."""
    if rows := problems.limit(shown).collect():
        raise IntegrityError(f"{what}: {[r.asDict() for r in rows]}")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def grid_gaps(records: DataFrame, methods: dict[str, list[str]]) -> DataFrame:
    """Per sample, expected and present cells: its interventions times all (method, budget) of the grid, where they differ."""
    cells = sum(len(b) for b in methods.values())
    wanted = reduce(lambda a, b: a | b, [(F.col("method") == m) & F.col("budget").isin(*bs) for m, bs in methods.items()])
    per = records.where(wanted).groupBy("sample_id").agg(
        F.count_distinct("intervention").alias("interventions"), F.count_distinct("method", "budget", "intervention").alias("present")
    )
    return per.withColumn("expected", F.col("interventions") * cells).where("present <> expected")


def coverage(rows: DataFrame, *by: str) -> DataFrame:
    """Rows and distinct samples of every cell."""
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct("sample_id").alias("samples"))


def missing(expected: DataFrame, there: DataFrame, *key: str) -> DataFrame:
    """Keys of ``expected`` that aren't there: what a resumed run still has to do."""
    return expected.join(there, list(key), "left_anti")


def plan_mismatches(planned: DataFrame, executed: DataFrame, fields: tuple[str, ...], key: str = "sample_id") -> DataFrame:
    """Executed rows without a plan, executed twice, called other than once, or that differ from the plan in a field; (key, problem)."""
    p = planned.select(key, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_planned"))
    joined = executed.join(p, key, "left")
    differs = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(F.col(f"_{f}")) for f in fields])
    problem = F.when(F.col("_planned").isNull(), "unplanned").when(F.coalesce("backend_invocation_count", F.lit(1)) != 1, "invocations").when(differs, "differs")
    one = joined.withColumn("problem", problem).where("problem is not null").select(key, "problem")
    return one.unionByName(duplicates(executed, key).select(key, F.lit("duplicate").alias("problem")))


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, and which side."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, key, "full_outer")
    return both.where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("only_in"))


def gate(checks: dict[str, bool]) -> bool:
    """All checks hold; a failed one is named."""
    if failed := sorted(k for k, v in checks.items() if not v):
        raise IntegrityError(f"gate failed: {failed}")
    return True


def split_fields(rows: DataFrame, hidden: tuple[str, ...], key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """(what a run may see, what stays hidden); both have the key."""
    return rows.drop(*hidden), rows.select(key, *[h for h in hidden if h in rows.columns])


def reveal(frozen: DataFrame, labels: DataFrame, key: str = "sample_id", executions: DataFrame | None = None, needed: int = 6) -> DataFrame:
    """Frozen rows with their labels; both must have the same keys.

    ``executions``: (cell, key) of what has run; labels are shown only after ``needed`` cells have run all frozen keys.
    """
    if executions is not None:
        done = executions.join(frozen.select(key).distinct(), key).groupBy("cell").agg(F.count_distinct(key).alias("n"))
        whole = done.where(F.col("n") == frozen.select(key).distinct().count()).count()
        if whole < needed:
            raise IntegrityError(f"{whole} complete executions, {needed} are needed before labels are shown")
    demand_empty(set_difference(frozen, labels, key), "keys of one side only")
    return frozen.join(labels, key)


def position_mismatches(existing: DataFrame, recomputed: DataFrame, order: str, fields: tuple[str, ...]) -> DataFrame:
    """(position, field): where two plans differ, row by row in their own order; a plan that is shorter differs in ``length``.

    ``order``: the column that numbers a plan's rows; places are counted within ranges of it and added up.
    """

    def numbered(df: DataFrame, side: str) -> DataFrame:
        at = F.row_number().over(Window.orderBy(order)) - 1  # a plan is one run's rows, a few hundred to a few thousand
        return df.select(at.cast("bigint").alias("position"), F.lit(True).alias(side), *(F.col(f).alias(f"{side}_{f}") for f in fields))

    both = numbered(existing, "a").join(numbered(recomputed, "b"), "position", "full_outer")
    differs = [F.when(~F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")), F.lit(f)) for f in fields]
    wrong = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit("length"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select("position", F.explode(wrong).alias("field"))


def cell_audit(rows: DataFrame, expected: DataFrame, checks: dict[str, Column], *by: str) -> DataFrame:
    """Per expected cell: records, distinct samples, each check over all its rows, and complete: the numbers are those expected and all checks hold.

    ``expected``: by, expected_records, expected_samples. ``checks``: name -> flag of a row. A cell without rows is not complete.
    """
    there = rows.groupBy(*by).agg(F.count("*").alias("records"), F.count_distinct("sample_id").alias("samples"), *(F.every(c).alias(n) for n, c in checks.items()))
    got = expected.join(there, list(by), "left").fillna(0, ["records", "samples"]).fillna(False, list(checks))
    whole = (F.col("records") == F.col("expected_records")) & (F.col("samples") == F.col("expected_samples"))
    return got.withColumn("complete", reduce(lambda a, b: a & b, [F.col(n) for n in checks], whole))


def development_audit(records: DataFrame, grid: int, seed: int, budgets: tuple[str, ...], *by: str) -> DataFrame:
    """Cells of a development run: each must have all its samples' interventions times the ``grid`` of (method, budget) cells, one seed, and no other budget."""
    wanted = records.groupBy(*by, "sample_id").agg(F.count_distinct("intervention").alias("i")).groupBy(*by)
    expected = wanted.agg((F.sum("i") * grid).alias("expected_records"), F.count("*").alias("expected_samples"))
    return cell_audit(records, expected, {"controlled_seed": F.col("seed") == seed, "controlled_budgets": F.col("budget").isin(*budgets)}, *by)


def prospective_audit(actions: DataFrame, expected: DataFrame, *by: str) -> DataFrame:
    """Cells of a prospective run: so many actions, each of one call, with labels hidden while it ran."""
    return cell_audit(actions, expected, {"single_action": F.col("backend_invocation_count") == 1, "labels_hidden_during_execution": ~F.col("labels_visible")}, *by)


def replication_audit(actions: DataFrame, expected: DataFrame, group: str, *by: str) -> tuple[DataFrame, DataFrame]:
    """(cells, overlap): cells of replication draws (each action of one call), and source groups that occur in several draws, which must be none."""
    cells = cell_audit(actions, expected, {"single_invocation": F.col("backend_invocation_count") == 1}, *by)
    return cells, actions.groupBy(group).agg(F.count_distinct("draw").alias("draws")).where("draws > 1")


def all_complete(cells: DataFrame, n_cells: int) -> DataFrame:
    """One row: cells, complete ones, and whether all ``n_cells`` are there and complete."""
    done = F.count_if("complete")
    return cells.agg(F.count("*").alias("cells"), done.alias("complete_cells"), ((F.count("*") == n_cells) & (done == n_cells)).alias("all_complete"))


def development_gate(cells: DataFrame, labels: DataFrame, agreement: DataFrame, leakage: DataFrame, reduction: DataFrame, n_cells: int, least_agreement: float = 0.95) -> DataFrame:
    """One row of five checks and their conjunction: all cells complete; labels without duplicates; environments agree; no split leaks; every reduction's lower bound is above 0."""
    checks = {
        "cells_complete": all_complete(cells, n_cells).select(F.col("all_complete").alias("x")),
        "labels_unique": duplicates(labels, "sample_id", "method", "budget").agg((F.count("*") == 0).alias("x")),
        "environments_agree": agreement.agg((F.min("answer_agreement_rate") >= least_agreement).alias("x")),
        "splits_disjoint": leakage.agg((F.count("*") == 0).alias("x")),
        "energy_reduced": reduction.agg(F.coalesce(F.every(F.col("ci_low") > 0), F.lit(False)).alias("x")),
    }
    row = None
    for name, one in checks.items():
        one = one.select(F.coalesce("x", F.lit(False)).alias(name))
        row = one if row is None else row.crossJoin(F.broadcast(one))  # one row each
    return row.withColumn("gate_open", reduce(lambda a, b: a & b, [F.col(n) for n in checks]))


def approved(path: str, sha256: str) -> dict:
    """The approval of a run: a JSON file that must be there, say so, and name the plan's checksum."""
    file = Path(path)
    if not file.exists():
        raise IntegrityError(f"no approval at {path}")
    found = json.loads(file.read_text(encoding="utf-8"))
    gate({"approved": found.get("approved") is True, "sha256": found.get("sha256") == sha256})
    return found


def verify_constants(found: dict[str, object], published: dict[str, object], tolerance: float = 1e-9) -> bool:
    """Every published number is found again; what differs or is missing is named."""

    def same(a: object, b: object) -> bool:
        return abs(a - b) <= tolerance if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) else a == b

    return gate({name: name in found and same(found[name], value) for name, value in published.items()})


def dense_checkpoint(records: DataFrame, n: int) -> DataFrame:
    """The dense records from which a run may start: exactly ``n``, each key once."""
    dense = records.where("method = 'dense'")
    demand_empty(duplicates(dense, "sample_id", "intervention"), "dense keys that occur twice")
    if (there := dense.count()) != n:
        raise IntegrityError(f"{there} dense records, {n} are expected")
    return dense


def label_gaps(labels: DataFrame, budgets: tuple, *by: str) -> DataFrame:
    """(by, sample_id, labelled): samples that don't have exactly one label for each budget."""
    per = labels.groupBy(*by, "sample_id").agg(F.count("*").alias("labelled"), F.count_distinct(F.when(F.col("budget").isin(*budgets), F.col("budget"))).alias("_b"))
    return per.where((F.col("labelled") != len(budgets)) | (F.col("_b") != len(budgets))).drop("_b")


def with_provenance(sources: dict[str, DataFrame], key: str, n: int | None = None) -> DataFrame:
    """Rows of several tables with provenance, the name of theirs; a key of two tables, or another number of rows than ``n``, is an error."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("provenance", F.lit(name))
        out = df if out is None else out.unionByName(df)
    demand_empty(duplicates(out, key), "keys that occur twice")
    if n is not None and (there := out.count()) != n:
        raise IntegrityError(f"{there} rows, {n} are expected")
    return out
