"""Runs that survive a stop: a grid is evaluated cell by cell, and a log says which cells are finished.

A cell is a method, a budget and a shard of the samples. Its records are written to a folder of the attempt; then its entry in the log is
published by a rename, with the folder, the number of records and a checksum. Only folders that the log names are read, so a cell is
there whole or not at all. A run that starts again leaves the finished cells alone: it finds them by their names, reads no record of theirs, and what
a cell costs doesn't depend on what came before. Pruned cells read the dense records of their own shard alone.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.integrity import IntegrityError, dense_checkpoint, demand_empty, duplicates
from brindle.sources import store
from brindle.sources.readers import RECORD_KEY


@dataclass(frozen=True, order=True)
class Cell:
    method: str
    budget: str
    shard: int = 0

    @property
    def name(self) -> str:
        return f"{self.method}-{self.budget}-{self.shard:05d}"


Evaluate = Callable[[Cell, DataFrame | None], DataFrame]


def cells(methods: Iterable[str], schedule: Iterable[str], dense_budget: str = "full", shards: int = 1) -> list[Cell]:
    """All cells in the order of a run: dense first, as the others need it."""
    grid = [("dense", str(dense_budget)), *((m, str(b)) for m in methods for b in schedule)]
    return [Cell(m, b, s) for m, b in grid for s in range(shards)]


def shard_of(key: str = "sample_id", shards: int = 1):
    """The shard of a sample."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(shards)).cast("int")


class Run:
    """One run's folder. ``plan``: what decides the records (configuration, versions); a folder of another plan is refused.

    One driver writes to a run at a time.
    """

    def __init__(self, spark: SparkSession, root: str, plan: dict[str, Any]):
        self.spark, self.root = spark, root.rstrip("/")
        self.plan = hashlib.sha256(json.dumps(plan, sort_keys=True).encode()).hexdigest()
        at = store.join(self.root, "plan.json")
        if not store.publish(spark, at, json.dumps({"sha256": self.plan, "plan": plan}, sort_keys=True).encode()):
            if (there := json.loads(store.read_bytes(spark, at))["sha256"]) != self.plan:
                raise IntegrityError(f"{self.root} is a run of another plan ({there[:12]}, not {self.plan[:12]})")

    def log(self) -> dict[str, dict[str, Any]]:
        """The finished cells by name; a row of a few hundred bytes a cell."""
        folder = store.join(self.root, "log")
        if not any(n.endswith(".json") for n in store.names(self.spark, folder)):
            return {}
        rows = self.spark.read.schema("method string, budget string, shard int, folder string, n bigint, checksum string, started int").option("pathGlobFilter", "*.json").json(folder)
        return {Cell(r["method"], r["budget"], r["shard"]).name: r.asDict() for r in rows.collect()}

    def pending(self, planned: Iterable[Cell]) -> list[Cell]:
        done = self.log()
        return [c for c in planned if c.name not in done]

    def finish(self, cell: Cell, records: DataFrame, started: int = 0) -> dict[str, Any]:
        """Writes a cell's records and publishes it. A key that comes twice is an error, and the cell stays open."""
        folder = store.join(self.root, "cells", f"{cell.name}-{uuid.uuid4().hex[:12]}")
        records.write.parquet(folder)
        there = self.spark.read.schema(records.schema).parquet(folder)
        demand_empty(duplicates(there, *RECORD_KEY), f"keys that occur twice in {cell.name}")
        demand_empty(there.where((F.col("method") != cell.method) | (F.col("budget").cast("string") != cell.budget)), f"records of other cells in {cell.name}")
        entry = asdict(cell) | {"folder": folder, **_sums(there), "started": started}
        if not store.publish(self.spark, store.join(self.root, "log", f"{cell.name}.json"), json.dumps(entry, sort_keys=True).encode()):
            store.remove(self.spark, folder)
            raise IntegrityError(f"{cell.name} is finished already")
        return entry

    def records(self, method: str | None = None, shard: int | None = None) -> DataFrame | None:
        """The records of the finished cells, of one method or shard if asked; None if there are none."""
        folders = [e["folder"] for e in self.log().values() if method in (None, e["method"]) and shard in (None, e["shard"])]
        return self.spark.read.parquet(*folders) if folders else None

    def verify(self) -> None:
        """Reads every finished cell again: what was counted and summed when it was finished must still be there."""
        for name, e in self.log().items():
            if (now := _sums(self.spark.read.parquet(e["folder"]))) != {k: e[k] for k in now}:
                raise IntegrityError(f"{name} isn't what was finished: {now}")

    def tidy(self) -> list[str]:
        """Removes folders of attempts that no entry names; returns their names."""
        known = {e["folder"].rpartition("/")[2] for e in self.log().values()}
        left = [n for n in store.names(self.spark, store.join(self.root, "cells")) if n not in known]
        for n in left:
            store.remove(self.spark, store.join(self.root, "cells", n))
        return left

    def seed_dense(self, records: DataFrame, n: int, dense_budget: str = "full", shards: int = 1, key: str = "sample_id") -> None:
        """Takes the dense cells from records of another run: exactly ``n``, each key once."""
        dense = dense_checkpoint(records, n)
        for cell in self.pending(cells((), (), dense_budget, shards)):
            self.finish(cell, dense.where(shard_of(key, shards) == cell.shard))


def _sums(records: DataFrame) -> dict[str, Any]:
    """Number of records and an order-free checksum of all their columns."""
    total = F.sum(F.xxhash64(*sorted(records.columns)).cast("decimal(38,0)"))
    n, checksum = records.agg(F.count("*"), F.coalesce(total, F.lit(0)).cast("string")).first()
    return {"n": n, "checksum": checksum}


def run_grid(spark: SparkSession, root: str, plan: dict[str, Any], planned: list[Cell], evaluate: Evaluate, at_most: int | None = None) -> Run:
    """Evaluates the cells that aren't finished, in order; ``evaluate(cell, the dense records of its shard)`` gives the records.

    ``at_most``: stop after so many cells, as a run that has a time slot does; call again to go on.
    """
    run = Run(spark, root, plan)
    started = max((e["started"] for e in run.log().values()), default=0) + 1
    run.tidy()
    for k, cell in enumerate(run.pending(planned)):
        if at_most is not None and k >= at_most:
            break
        run.finish(cell, evaluate(cell, None if cell.method == "dense" else run.records("dense", cell.shard)), started)
    return run
