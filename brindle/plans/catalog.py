"""All registered queries of the analytics operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brindle.plans import answer_queries, audit_queries, controller_queries, energy_queries, integrity_queries, ledger_queries, policy_queries, sampling_queries

Query = Callable[[SparkSession, str], DataFrame]

_ALL: dict[str, tuple[Query, str | None]] = {}
for _module in (policy_queries, answer_queries, energy_queries, sampling_queries, controller_queries, ledger_queries, integrity_queries, audit_queries):
    if _twice := _ALL.keys() & _module.QUERIES.keys():
        raise ValueError(f"registered twice: {sorted(_twice)}")
    _ALL |= _module.QUERIES


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
