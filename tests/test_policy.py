"""Policies on small tables with known answers, and their invariants on driver tables."""

import pytest

from brindle.operators import policy, summary
from brindle.plans.policy_queries import _records

RECORD = (
    "sample_id string, split string, dataset string, method string, budget string, budget_ord int, intervention string, answer string, gold_answer string, is_correct boolean, "
    "vem double, dense_vem double, reliance_retention double, shortcut_persistence boolean, delta_vem double, cost double, latency_ms double, energy_joule double, measured_energy_joule double, token_count int"
)


def record(method, budget, intervention, vem, cost, right=True, sample="s1", retention=None):
    order = {"full": 576}.get(budget) or int(budget)
    return (sample, "test", "d", method, budget, order, intervention, "yes", "yes", right, vem, 0.9, retention, False, 0.0, cost, 10.0, 1.0, None, order)


def decide(spark, rows, cascade=False, **setting):
    table = policy.settings(spark, [{"setting": "t", "tau": 0.25, **setting}])
    return policy.cheapest_supported(spark.createDataFrame(rows, RECORD), table, cascade).collect()


DENSE = [record("dense", "full", "gray", 0.9, 5.0), record("dense", "full", "blur", 0.8, 5.0)]


def test_all_interventions_must_pass(spark):
    rows = [*DENSE, record("topk", "16", "gray", 0.9, 2.0), record("topk", "16", "blur", 0.1, 2.0), record("topk", "32", "gray", 0.9, 3.0), record("topk", "32", "blur", 0.6, 3.0)]
    (d,) = decide(spark, rows)
    assert (d.selected_budget, d.escalations, d.accepted, d.reason, d.cost) == ("32", 1, True, "accepted_after_escalation", 6.0)
    assert d.speedup_vs_dense == 1.0 and d.token_reduction == pytest.approx(1 - 32 / 576)


def test_cascade_pays_for_what_it_tried(spark):
    rows = [DENSE[0], record("topk", "16", "gray", 0.1, 2.0), record("topk", "32", "gray", 0.9, 3.0)]
    (d,) = decide(spark, rows, cascade=True)
    assert (d.cost, d.latency_ms, d.escalations) == (5.0, 20.0, 1)
    (d,) = decide(spark, rows[:2], cascade=True)
    assert (d.cost, d.reason, d.selected_method, d.escalations) == (7.0, "fallback_full", "dense", 1)


def test_missing_cover_retention_and_eligibility(spark):
    rows = [*DENSE, record("topk", "16", "gray", 0.9, 2.0)]  # blur is missing
    (d,) = decide(spark, rows)
    assert (d.selected_method, d.escalations, d.accepted) == ("dense", 0, True)
    (d,) = decide(spark, [DENSE[0], record("topk", "16", "gray", 0.9, 2.0, retention=0.4)], rho=0.5)
    assert (d.selected_method, d.accepted) == ("dense", False)  # dense has no retention either
    assert decide(spark, [record("dense", "full", "gray", 0.9, 5.0, right=False)]) == []  # nothing to support
    (d,) = decide(spark, [record("topk", "16", "gray", 0.9, 2.0)])  # no dense record at all
    assert d.selected_budget == "16" and d.dense_cost is None and d.speedup_vs_dense is None
    assert decide(spark, []) == []


def test_settings_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(policy, "MOST_SETTINGS", 1)
    with pytest.raises(ValueError):
        policy.settings(spark, [{"setting": "a", "tau": 1.0}, {"setting": "b", "tau": 1.0}])


def test_invariants_on_driver_tables(spark):
    records = _records(spark, "/root/testdata/sf0.001").cache()
    table = policy.settings(spark, [{"setting": "t", "tau": 0.25, "dense_vem_min": 0.1}])
    cheap = {r.sample_id: r for r in policy.cheapest_supported(records, table).collect()}
    online = {r.sample_id: r for r in policy.cheapest_supported(records, table, cascade=True).collect()}
    assert cheap.keys() == online.keys() and len(cheap) > 100
    for k, d in cheap.items():
        assert d.escalations >= 0 and online[k].cost >= d.cost - 1e-6 and online[k].selected_budget == d.selected_budget
    one = summary.decision_summary(policy.cheapest_supported(records, table), "setting").first()
    assert one.n == len(cheap) and one.dense_avoidance_rate + one.fallback_full_rate == pytest.approx(1)
    records.unpersist()


def test_plan_shuffles_records_once(spark):
    """Eligibility, aggregation and choice share one partitioning of the records."""
    records = spark.createDataFrame(DENSE, RECORD)
    table = policy.settings(spark, [{"setting": "t", "tau": 0.25}])
    plan = policy.cheapest_supported(records, table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_accuracy_only(spark):
    rows = [("a", "validation", "topk", "64", 64, True), ("a", "validation", "topk", "64", 64, False), ("a", "validation", "topk", "128", 128, True), ("b", "validation", "topk", "256", 256, True)]
    df = spark.createDataFrame(rows, "sample_id string, split string, method string, budget string, budget_ord int, is_correct boolean")
    assert [tuple(r) for r in policy.accuracy_only_budget(df).collect()] == [("topk", "128", 1.0)]
