"""Known answers of record evaluation, folds, resampling, replays, audits and guards."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import controller, graph, groups, integrity, records, safety, selection, stats, summary


# ---- records ----------------------------------------------------------------------------------

PAIR = (
    "sample_id string, method string, intervention string, gold_answer string, score_type string, original_answer string, intervened_answer string, original_logprob double, intervened_logprob double, "
    "original_latency_ms double, intervened_latency_ms double, original_api_cost_usd double, intervened_api_cost_usd double, original_measured_energy_joule double, intervened_measured_energy_joule double, "
    + ", ".join(f"{s}_api_{t}_tokens int" for t in ("prompt", "completion", "total") for s in ("original", "intervened"))
)


def pair(method="dense", kind=None, answers=("yes", "no"), logs=(-0.5, -2.0), api=(None, None), energy=(None, None)):
    return ("s", method, "gray", "Yes.", kind, *answers, *logs, 100.0, 300.0, *api, *energy, 3, None, None, None, None, None)


def evaluated(spark, *rows):
    return records.with_dense(records.evaluate(spark.createDataFrame(rows, PAIR), usd_per_1k_ms=2.0, joule_per_ms=0.5)).collect()


def test_margins_costs_and_energy(spark):
    (d,) = evaluated(spark, pair())
    assert (d.vem, d.dense_vem, d.reliance_retention, d.delta_vem, d.is_correct, d.shortcut_persistence) == (1.5, 1.5, 1.0, 0.0, True, False)
    assert (d.cost, d.energy_joule, d.api_cost_usd, d.measured_energy_joule, d.support_metric) == (0.8, 200.0, None, None, "score_vem")
    assert (d.api_prompt_tokens, d.api_total_tokens) == (3, None)
    (d,) = evaluated(spark, pair(api=(None, 0.25), energy=(7.0, None)))
    assert (d.cost, d.energy_joule, d.proxy_energy_joule) == (0.25, 7.0, 200.0)
    (d,) = evaluated(spark, pair(kind="answer_only"))
    assert (d.vem, d.answer_flip_support, d.support_metric) == (1.0, True, "answer_flip_support")
    (d,) = evaluated(spark, pair(kind="answer_only", answers=("yes", "TRUE;")))
    assert (d.vem, d.answer_flip_support, d.shortcut_persistence) == (0.0, False, True)


def test_what_pruning_loses_is_positive(spark):
    dense, pruned = sorted(evaluated(spark, pair(), pair("topk", logs=(-0.5, -1.0))), key=lambda r: r.method)
    assert (pruned.vem, pruned.dense_vem, pruned.delta_vem) == (0.5, 1.5, 1.0) and pruned.reliance_retention == pytest.approx(1 / 3)
    (none,) = evaluated(spark, pair("topk"))
    assert (none.dense_vem, none.delta_vem, none.reliance_retention) == (None, None, None)
    dense, pruned = sorted(evaluated(spark, pair(logs=(-1.0, -1.0)), pair("topk")), key=lambda r: r.method)
    assert dense.reliance_retention is None and pruned.reliance_retention is None  # too little to divide by


# ---- folds, groups ----------------------------------------------------------------------------


def test_folds_equal_the_greedy_steps(spark):
    rng = random.Random(3)
    for folds in (1, 3, 5):
        for _ in range(30):
            sizes = {f"g{i}": rng.choice([1, 1, 1, 2, 3, 50, 7]) for i in range(rng.randint(1, 80))}
            wanted = groups.fold_packing(sizes, folds)
            counts = {n: list(sizes.values()).count(n) for n in set(sizes.values())}
            import hashlib

            for size, rank, turn in groups.fold_runs(counts, folds):
                named = sorted((g for g in sizes if sizes[g] == size), key=lambda g: hashlib.sha256(g.encode()).hexdigest())
                later = [r for s, r, _ in groups.fold_runs(counts, folds) if s == size and r > rank]
                for i, g in enumerate(named[rank : min(later, default=len(named))]):
                    assert wanted[g] == turn[i % len(turn)]
    df = spark.createDataFrame(sorted(sizes.items()), "grp string, n long")
    assert {r.grp: r.fold for r in groups.assign_folds(df, "grp", "n").collect()} == wanted
    assert groups.assign_folds(df.limit(0), "grp", "n").count() == 0
    assert len(groups.fold_runs({1: 10**12, 3: 10**9})) <= 10  # steps don't depend on how many groups there are


def test_a_hub_and_a_hot_value_are_spread(spark):
    edges = spark.range(1, 3000).selectExpr("0L as a", "id as b")
    plan = graph._with_least(edges.selectExpr("b as v", "a as u"))._jdf.queryExecution().executedPlan().toString()
    assert "salt" in plan.split("Join")[1][:200]
    assert graph.components(edges).where("root <> 0").count() == 0
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('v', id)) as value")
    assert groups.connected_groups(rows, "id", "value").groupBy("root").count().agg(F.max("count")).first()[0] == 1000


# ---- resampling -------------------------------------------------------------------------------


def weights(ids, draws, seed):
    x = (ids[:, None] % 1_000_003 * 7_919 + np.arange(draws) * 104_729 + seed * 15_485_863) % 1_000_003
    u = (x * x + ids[:, None] % 999_983 + np.arange(draws) * 31) % 1_000_003 / 1_000_003.0
    return sum((u >= c).astype(int) for c in stats._POISSON)


def test_resampled_sums_equal_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, "ab"[i % 2], rng.random() if i % 5 else None, float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double").repartition(3)
    for block in (stats._WEIGHTS, 64):
        monkeypatch.setattr(stats, "_WEIGHTS", block)
        got = {(r.g, r.draw): (r.x, r.y) for r in stats.resampled_sums(df, {"x": F.col("x"), "y": F.col("y")}, "id", 20, 7, "g").collect()}
        for g in "ab":
            some = [r for r in rows if r[1] == g]
            w = weights(np.array([r[0] for r in some]), 20, 7)
            x, y = np.array([r[2] or 0.0 for r in some]), np.array([r[3] for r in some])
            assert got[g, -1] == pytest.approx((x.sum(), y.sum()))
            for d in range(20):
                assert got[g, d] == pytest.approx((w[:, d] @ x, w[:, d] @ y))
    assert weights(np.arange(5000), 50, 7).mean() == pytest.approx(1, abs=0.02)


def test_intervals_hold_the_point(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 4 = 0 as double) as spent", "1.0D as dense", "id % 4 = 0 as a", "id % 8 = 0 as b")
    r = stats.reduction_bootstrap(df, "spent", "dense", "id", 200, 1).first()
    assert (r.n_paired, r.reduction) == (400, 0.75) and r.ci_low < 0.75 < r.ci_high and r.ci_high - r.ci_low < 0.2
    r = stats.paired_flags(df, "a", "b", "id", 200, 1).first()
    assert (r.n_paired, r.difference, r.left_only, r.right_only) == (400, 0.125, 50, 0) and r.ci_low < 0.125 < r.ci_high


def test_lower_quantile_and_running_sums(spark):
    values = [3.0, 1.0, 1.0, 9.0, 4.0, 4.0, 4.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert stats.lower_quantile(df, "v", q).first().lower == sorted(values)[int(q * 6)]
    even = spark.createDataFrame([(float(i),) for i in range(1200)], "v double")
    assert even.agg(F.median("v")).first()[0] == (599 + 600) / 2  # the two middle places of 1,200
    got = stats.running_sums(spark.range(100).selectExpr("id", "1L as n").repartition(5), F.desc("id"), "id", ("n",)).collect()
    assert {r.id: r.n for r in got} == {i: 100 - i for i in range(100)}


# ---- thresholds and replays -------------------------------------------------------------------


def test_grid_threshold(spark):
    rng = random.Random(8)
    budgets = (64, 128)
    rows = [([rng.random(), rng.random()], [rng.random() < 0.7, rng.random() < 0.9], [1.0, 2.0, 5.0]) for _ in range(200)]
    df = spark.createDataFrame(rows, "scores array<double>, safe array<boolean>, energy array<double>")
    for risk in (0.0, 0.05, 0.1, 0.2):
        best = []
        for t in (i / 100.0 for i in range(5, 100, 5)):
            picks = [next((i for i, s in enumerate(sc) if s >= t), 2) for sc, _, _ in rows]
            unsafe = sum(p < 2 and not sf[p] for p, (_, sf, _) in zip(picks, rows, strict=True)) / len(rows)
            if unsafe <= risk:
                best.append((round(sum(e[p] for p, (_, _, e) in zip(picks, rows, strict=True)) / len(rows), 6), -t))
        assert stats.grid_threshold(df, risk, budgets=budgets).first().threshold == (-min(best)[1] if best else 1.0)


def fold_rows(spark, n=240):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        x = [float(rng.randint(0, 3)) for _ in range(17)]
        for b in (64, 128):
            rows.append((i, i % 3, b, x, rng.random() < (0.9 if x[0] > 1 else 0.2), b / 10.0, 60.0))
    return spark.createDataFrame(rows, "key long, fold int, budget int, features array<double>, safe boolean, energy_joule double, dense_energy_joule double"), rows


def test_cross_fit_replay_equals_steps_by_hand(spark):
    df, rows = fold_rows(spark)
    decisions, thresholds = controller.cross_fit_replay(df, (64, 128), (0.1,), steps=40)
    got = {r.key: r.selected_budget for r in decisions.collect()}
    at = {r.fold: r.threshold for r in thresholds.collect()}
    for fold in range(3):
        probs = {}
        for b in (64, 128):
            train = [r for r in rows if r[2] == b and r[1] != fold]
            x, y = np.array([r[3] for r in train]), np.array([float(r[4]) for r in train])
            mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0, ddof=1), 1e-8)
            w = controller.fit_logistic((x - mean) / scale, y, 40, penalty=0.02)
            probs |= {(r[0], b): 1 / (1 + np.exp(-(w[0] + (np.array(r[3]) - mean) / scale @ w[1:]))) for r in rows if r[2] == b}
        pick = lambda k, t: next((b for b in (64, 128) if probs[k, b] >= t), None)
        safe = {(r[0], r[2]): r[4] for r in rows}
        train = [i for i in range(240) if i % 3 != fold]
        best = []
        for t in (i / 100.0 for i in range(5, 100, 5)):
            chosen = {k: pick(k, t) for k in train}
            if sum(b is not None and not safe[k, b] for k, b in chosen.items()) / len(train) <= 0.1:
                best.append((round(sum(60.0 if b is None else b / 10 for b in chosen.values()) / len(train), 6), -t))
        assert at[fold] == (-min(best)[1] if best else 1.0)
        for k in (k for k in range(240) if k % 3 == fold):
            assert got[k] == str(pick(k, at[fold]) or "dense")


def test_ablation_has_every_cell_and_configuration(spark):
    df, _ = fold_rows(spark)
    rows = df.withColumn("cell", F.when(F.col("key") % 2 == 0, "one").otherwise("two"))
    got = {(r.configuration, r.cell, r.budget): r for r in controller.ablation(rows, steps=20).collect()}
    assert len(got) == 7 * 2 * 2
    # only the first feature tells
    assert got["A1_structure_only", "one", 64].auroc > 0.7 > got["A6_intercept_only", "one", 64].auroc


def test_fits_count_equal_rows(spark):
    df, rows = fold_rows(spark)
    twice = df.unionByName(df)
    one, two = (controller.fit_cells(d, "budget", steps=30).orderBy("budget").collect() for d in (df, twice))
    for a, b in zip(one, two, strict=True):
        assert b.n == 2 * a.n and b.means == pytest.approx(a.means) and b.weights == pytest.approx(a.weights, abs=0.01)


def test_controllers_refuse_every_hidden_column(spark):
    assert len(controller.FORBIDDEN) == 12
    artifact = {"models": {"64": {"weights": [0.0, 1.0], "means": [0.0], "scales": [1.0]}}, "global_threshold": 0.5}
    df = spark.createDataFrame([([1.0],)], "features array<double>")
    assert controller.decide(df, artifact).first().selected_budget == "64"
    for hidden in controller.FORBIDDEN:
        with pytest.raises(ValueError, match=hidden):
            controller.decide(df.withColumn(hidden, F.lit(1)), artifact)


# ---- audits -----------------------------------------------------------------------------------


def test_positions_labels_and_provenance(spark):
    plan = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "ordinal int, budget string")
    again = spark.createDataFrame([(5, "a"), (6, "x")], "ordinal int, budget string")
    assert sorted(map(tuple, integrity.position_mismatches(plan, again, "ordinal", ("budget",)).collect())) == [(1, "budget"), (2, "length")]
    assert integrity.position_mismatches(plan, plan, "ordinal", ("budget",)).count() == 0
    labels = spark.createDataFrame([("a", 64), ("a", 128), ("b", 64), ("c", 64), ("c", 64)], "sample_id string, budget int")
    assert {r.sample_id for r in integrity.label_gaps(labels, (64, 128)).collect()} == {"b", "c"}
    both = {"x": spark.createDataFrame([(1,)], "id int"), "y": spark.createDataFrame([(2,)], "id int")}
    assert sorted(map(tuple, integrity.with_provenance(both, "id", 2).collect())) == [(1, "x"), (2, "y")]
    with pytest.raises(integrity.IntegrityError):
        integrity.with_provenance(both, "id", 3)
    with pytest.raises(integrity.IntegrityError):
        integrity.with_provenance({"x": both["x"], "z": both["x"]}, "id")


def test_gates(spark, tmp_path):
    assert integrity.verify_constants({"n": 900, "rate": 0.25}, {"n": 900, "rate": 0.25 + 1e-12})
    with pytest.raises(integrity.IntegrityError, match="rate"):
        integrity.verify_constants({"n": 900, "rate": 0.3}, {"n": 900, "rate": 0.25})
    file = tmp_path / "approval.json"
    with pytest.raises(integrity.IntegrityError):
        integrity.approved(str(file), "abc")
    file.write_text('{"approved": true, "sha256": "abc"}')
    assert integrity.approved(str(file), "abc")["approved"]
    with pytest.raises(integrity.IntegrityError):
        integrity.approved(str(file), "other")
    frozen = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    labels = spark.createDataFrame([("a", 1), ("b", 0)], "sample_id string, gold int")
    runs = [(f"c{i}", s) for i in range(6) for s in "ab"]
    done = spark.createDataFrame(runs, "cell string, sample_id string")
    assert integrity.reveal(frozen, labels, executions=done).count() == 2
    with pytest.raises(integrity.IntegrityError):
        integrity.reveal(frozen, labels, executions=done.where("cell <> 'c5' or sample_id = 'a'"))


def test_dense_checkpoint(spark):
    rows = spark.createDataFrame([("a", "dense", "gray"), ("b", "dense", "gray"), ("a", "topk", "gray")], "sample_id string, method string, intervention string")
    assert integrity.dense_checkpoint(rows, 2).count() == 2
    for bad, n in ((rows, 3), (rows.unionByName(rows), 4)):
        with pytest.raises(integrity.IntegrityError):
            integrity.dense_checkpoint(bad, n)


def test_cells_without_rows_are_incomplete(spark):
    rows = spark.createDataFrame([("x", "s1", 1, False), ("x", "s2", 1, False), ("y", "s1", 2, False)], "cell string, sample_id string, backend_invocation_count int, labels_visible boolean")
    expected = spark.createDataFrame([("x", 2, 2), ("y", 1, 1), ("z", 1, 1)], "cell string, expected_records long, expected_samples long")
    got = integrity.prospective_audit(rows, expected, "cell")
    assert {r.cell: r.complete for r in got.collect()} == {"x": True, "y": False, "z": False}
    assert tuple(integrity.all_complete(got, 3).first()) == (3, 1, False)


def test_first_wins_and_agreement(spark):
    a = spark.createDataFrame([(1, "a")], "id int, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, safety.first_wins([a, b], "id").collect())) == [(1, "a"), (2, "b")]
    assert sorted(map(tuple, safety.later_wins([a, b], "id").collect())) == [(1, "b"), (2, "b")]


def test_dense_audit_counts(spark):
    rows = spark.createDataFrame([("a", "dense", "full", "x", True, 1.0, 2.0, 576)], "sample_id string, method string, budget string, intervention string, is_correct boolean, energy_joule double, latency_ms double, token_count int")
    assert summary.dense_audit(rows, expected=1).first().n == 1
    with pytest.raises(Exception, match="are expected"):
        summary.dense_audit(rows, expected=2).collect()


def test_configuration_is_bounded(spark, monkeypatch):
    assert selection.intervention_specs([{"name": "blur"}, {"name": "swap", "type": "counterfactual", "applies_to": ["d"]}]) == [
        {"type": "blur", "applies_to": None, "radius": 8.0, "name": "blur"}, {"type": "counterfactual", "applies_to": ["d"], "name": "swap"},
    ]
    monkeypatch.setattr(selection, "MOST_CELLS", 1)
    two = spark.createDataFrame([("a", None), ("b", None)], "intervention string, applies_to array<string>")
    with pytest.raises(ValueError):
        selection.run_grid(spark.range(1).withColumn("dataset", F.lit("d")), two, two)
