"""Known answers of scalars, energy, safety, statistics, groups, controllers, ledgers, checks and selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import answers as A
from brindle.functions import numbers as N
from brindle.operators import controller, energy, graph, groups, integrity, ledger, prefixes, safety, selection, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---- scalars ----------------------------------------------------------------------------------


@pytest.mark.parametrize(("raw", "normal"), [("Yes.", "yes"), (" TRUE ", "yes"), ("Nope;", "no"), ("a,  b c", "a b c"), ("", ""), (None, None)])
def test_normalize(spark, raw, normal):
    assert one(spark, A.normalize_answer(F.lit(raw).cast("string"))) == normal


def test_exact_match(spark):
    assert one(spark, A.exact_match(F.lit("Yes."), F.lit("true"))) and not one(spark, A.exact_match(F.lit("yes"), F.lit("no")))


def test_retention_and_sums(spark):
    assert one(spark, N.ratio(F.lit(0.9), F.lit(1.8))) == 0.5 and one(spark, N.ratio(F.lit(0.9), F.lit(0.0))) is None
    assert one(spark, N.null_skipping_sum(F.lit(None).cast("double"), F.lit(2.0))) == 2.0
    assert one(spark, N.clip(F.lit(None).cast("double"), 0.0, 2.0)) is None and one(spark, N.clip(F.lit(3.0), 0.0, 2.0)) == 2.0


def test_wilson(spark):
    low, high = N.wilson_interval(F.lit(5), F.lit(630))
    assert one(spark, low) == pytest.approx(0.0033946, abs=1e-6) and one(spark, high) == pytest.approx(0.0184428, abs=1e-6)
    assert one(spark, N.wilson_upper(F.lit(7), F.lit(1200))) == pytest.approx(0.0107240830, abs=1e-9)
    assert one(spark, N.wilson_upper(F.lit(0), F.lit(0))) == 1.0


def test_sigmoid_doesnt_overflow(spark):
    assert one(spark, N.sigmoid(F.lit(-1000.0))) == 0.0 and one(spark, N.sigmoid(F.lit(1000.0))) == 1.0 and one(spark, N.sigmoid(F.lit(0.0))) == 0.5


# ---- energy -----------------------------------------------------------------------------------


@pytest.fixture
def power(spark):
    return spark.createDataFrame([(1.0, 100.0), (1.2, 120.0), (1.4, 140.0)], "epoch double, power_w double")


def calls(spark, *windows):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(windows)], "call_id long, start_epoch double, end_epoch double")


def test_window_and_nearest(spark, power):
    got = {r.call_id: r for r in energy.attribute(calls(spark, (1.0, 1.4), (1.25, 1.27), (1.4, 1.4), (5.0, 6.0)), power).collect()}
    assert got[0].energy_joule == pytest.approx(48.0) and got[1].energy_joule == pytest.approx(2.4)
    assert got[2].energy_joule is None and got[3].energy_joule == pytest.approx(140.0)


def test_ties_of_nearest(spark):
    samples = spark.createDataFrame([(0.0, 1.0), (2.0, 3.0)], "epoch double, power_w double")
    c = calls(spark, (0.5, 1.5))
    assert energy.nearest_sample(c, samples).first().nearest.power_w == 3.0
    assert energy.nearest_sample(c, samples, later_on_tie=False).first().nearest.power_w == 1.0


def test_energy_over_many_buckets_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    t, w = np.sort(rng.uniform(0, 40_000, 300)), rng.uniform(50, 200, 300)
    samples = spark.createDataFrame(list(zip(t.tolist(), w.tolist(), strict=True)), "epoch double, power_w double")
    windows = [tuple(sorted(rng.uniform(-2000, 42_000, 2).tolist())) for _ in range(60)]
    att = {r.call_id: r.energy_joule for r in energy.attribute(calls(spark, *windows), samples).collect()}
    trap = {r.call_id: r.energy_joule for r in energy.trapezoid(calls(spark, *windows), samples).collect()}
    for i, (a, b) in enumerate(windows):
        inside = (t >= a) & (t <= b)
        mean = w[inside].mean() if inside.any() else w[np.abs(t - (a + b) / 2).argmin()]
        assert att[i] == pytest.approx(mean * (b - a))
        x, y = list(t[inside]), list(w[inside])
        if (t < a).any():
            x.insert(0, a), y.insert(0, w[t < a][-1])
        if (t > b).any():
            x.append(b), y.append(w[t > b][0])
        assert trap[i] == (None if len(x) < 2 else pytest.approx(np.trapezoid(y, x)))


def test_no_nested_loop_over_samples(spark, power):
    plan = energy.attribute(calls(spark, (1.0, 1.4)), power)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# ---- safety -----------------------------------------------------------------------------------


def test_strict_labels_and_patterns(spark):
    schema = "sample_id int, split string, dataset string, method string, budget string, budget_ord int, intervention string, answer string, is_correct boolean, vem double"
    rows = [(1, "t", "d", "dense", "full", 576, "gray", "A", True, 1.0), (1, "t", "d", "topk", "64", 64, "gray", "a!", True, 1.0), (1, "t", "d", "topk", "128", 128, "gray", "B", True, 1.0), (1, "t", "d", "topk", "256", 256, "gray", "A", False, 0.0)]
    labels = safety.strict_labels(spark.createDataFrame(rows, schema))
    got = {r.budget: r for r in labels.collect()}
    assert got["64"].reference_safe and not got["128"].reference_safe and got["256"].reference_safe
    assert got["64"].gold_safe is True and got["256"].gold_safe is False and not got["256"].intervention_pass
    (p,) = safety.patterns(labels).collect()
    assert (p.pattern, p.monotonic, p.min_safe_budget) == ("1010", False, "64")


# ---- statistics -------------------------------------------------------------------------------


def test_auroc_with_ties(spark):
    rows = [(0, 0.1), (1, 0.4), (0, 0.4), (1, 0.8)]
    got = stats.ranking_quality(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    assert got.auroc == pytest.approx(0.875) and got.brier == pytest.approx((0.01 + 0.36 + 0.16 + 0.04) / 4)
    one_class = stats.ranking_quality(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s").first()
    assert one_class.auroc is None


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert stats.cohen_kappa(df, "x", "y").first().kappa == pytest.approx(0.5)
    assert stats.cohen_kappa(df.limit(0), "x", "y").first().kappa is None
    assert stats.cohen_kappa(df.where("x = 'a' and y = 'a'"), "x", "y").first().kappa == 1.0


def test_threshold_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    budgets = (64, 128, 256, 432)
    for _ in range(6):
        n = int(rng.integers(20, 60))
        scores, safe = np.round(rng.random((n, 4)), 2), rng.random((n, 4)) < 0.7
        rows = spark.createDataFrame([(i, scores[i].tolist(), [bool(x) for x in safe[i]]) for i in range(n)], "key int, scores array<double>, safe array<boolean>")
        got = stats.risk_bounded_threshold(rows, budgets, risk=0.3).first()
        best = None
        for th in [1.000001, *sorted(set(scores.ravel()), reverse=True), 0.0]:
            pick = [next((j for j in range(4) if s[j] >= th), None) for s in scores]
            bad = sum(p is not None and not safe[i][p] for i, p in enumerate(pick))
            p, z = bad / n, 1.6448536269514722
            upper = (p + z * z / (2 * n) + z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if upper <= 0.3:
                tokens = sum(576 if x is None else budgets[x] for x in pick) / n
                key = (sum(x is not None for x in pick) / n, -tokens, th)
                best = max(best, key) if best else key
        assert (got.dense_avoidance_rate, -got.mean_selected_tokens, got.threshold) == pytest.approx(best, abs=1e-5)


def test_bootstrap_covers_the_mean(spark):
    rows = spark.range(2000).select(F.col("id"), (F.col("id") % 10).cast("double").alias("v"))
    got = stats.bootstrap(rows, {"m": (F.col("v"), F.lit(1.0))}, "id", 100, 1).first()
    assert got.point == 4.5 and got.ci_low < 4.5 < got.ci_high and got.ci_high - got.ci_low == pytest.approx(4 * 2.87 / 2000**0.5, rel=0.35)


def test_pareto(spark):
    df = spark.createDataFrame([("a", 0.9, 5.0), ("b", 0.8, 3.0), ("c", 0.7, 4.0), ("d", 0.8, 3.0)], "name string, gain double, cost double")
    assert {r.name for r in stats.pareto_front(df, "gain", "cost").where("efficient").collect()} == {"a", "b", "d"}


# ---- groups -----------------------------------------------------------------------------------


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_groups_folds_and_allocation(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "p"), (3, "y", "p"), (4, "z", None)], "id int, q string, image string")
    assert {tuple(r) for r in groups.connected_groups(df, "id", "q", "image").collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}
    assert groups.balanced_allocation({"a": 1, "b": 9, "c": 9}, 8) == {"a": 1, "b": 4, "c": 3}
    many = groups.balanced_allocation({f"c{i:02}": 100 for i in range(18)}, 400)
    assert sorted(set(many.values())) == [22, 23] and sum(many.values()) == 400
    with pytest.raises(ValueError):
        groups.balanced_allocation({"a": 1}, 2)
    folds = groups.fold_packing({"a": 5, "b": 4, "c": 3, "d": 3}, 2)
    assert sorted(sum(s for g, s in {"a": 5, "b": 4, "c": 3, "d": 3}.items() if folds[g] == f) for f in (0, 1)) in ([7, 8],)


def test_draws_share_no_group(spark):
    pool = spark.range(300).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("s"), (F.col("id") % 120).alias("g"))
    draws = groups.quota_draws(pool, {"a": 10, "b": 5}, (1, 2, 3), "sample_id", "s", "g")
    assert draws.count() == 45 and groups.draws_overlap(draws, "g").count() == 0


# ---- controllers ------------------------------------------------------------------------------


def artifact(bias, threshold=0.5):
    n = len(controller.FEATURE_NAMES)
    models = {str(b): {"weights": [bias if b == 64 else -10.0] + [0.0] * n, "means": [0.0] * n, "scales": [1.0] * n} for b in (64, 128)}
    return {"feature_names": list(controller.FEATURE_NAMES), "selection_rule": controller.RULE, "global_threshold": threshold, "models": models}


def test_decide_and_guards(spark):
    df = spark.createDataFrame([("what color is it?", "mmstar")], "question string, dataset string").withColumn("features", A.question_features(F.col("question"), F.array(F.lit("a")), F.col("dataset")))
    features = df.first().features
    assert len(features) == 17 == len(controller.FEATURE_NAMES) and features[:5] == [0.08, pytest.approx(17 / 300), 0.25, 1.0, 1.0]
    assert controller.decide(df, artifact(10.0)).first().selected_budget == "64"
    assert controller.decide(df, artifact(10.0, 2.0)).first().selected_budget == "dense"
    with pytest.raises(ValueError):
        controller.check_columns(df.withColumn("gold_answer", F.lit("x")))
    with pytest.raises(ValueError):
        controller.check_columns(df, required=("options",))
    with pytest.raises(ValueError):
        controller.check_artifact({**artifact(1.0), "feature_names": ["x"]})


def test_fit_equals_plain_descent(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 3)), rng.random(50) < 0.5
    rows = spark.createDataFrame([(i, "c", x[i].tolist(), bool(y[i])) for i in range(50)], "key int, cell string, features array<double>, safe boolean")
    got = controller.fit_cells(rows, "cell", steps=60).first()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(w[0] + z @ w[1:])))
        g = z.T @ (p - y) / 50 + controller.PENALTY * w[1:]
        w[0] -= controller.RATE * (p - y).mean()
        w[1:] -= controller.RATE * g
    assert np.allclose(got.weights, w, atol=1e-9)
    prior = controller.fit_cells(rows.withColumn("safe", F.lit(True)), "cell").first()
    assert prior.weights[0] == pytest.approx(np.log(51 / 1)) and not any(prior.weights[1:])


# ---- ledgers, checks, selection ---------------------------------------------------------------


def test_ledger(spark):
    assert one(spark, ledger.emissions_kg(F.lit(3.6e6))) == pytest.approx(1.2 * 0.03283)
    runs = spark.createDataFrame([("x/high/1", 3.6e6, 3600.0), ("low", None, 1.0), ("zzz", 7.2e6, 1800.0)], "path string, energy_joule double, duration_s double")
    got = {r.family: r for r in ledger.family_rollup(runs, (("high", "high"), ("low", "low"))).collect()}
    assert got.keys() == {"high", "other", "_all"} and got["_all"].energy_kwh == 3.0 and got["_all"].usd == 3.0
    draws = spark.createDataFrame([("m", 1, 10, 0.1), ("m", 2, 30, 0.3)], "m string, draw int, n int, value double")
    gate = ledger.replication_gate(ledger.draw_aggregate(draws, "m")).first()
    assert (gate.gate, gate.pooled, gate.mean) == ("strong", 0.25, 0.2)


def test_checks(spark):
    planned = spark.createDataFrame([("a", "64"), ("b", "128")], "sample_id string, budget string")
    executed = lambda *rows: spark.createDataFrame(list(rows), "sample_id string, budget string, backend_invocation_count int")
    problems = lambda e: {tuple(r) for r in integrity.plan_mismatches(planned, e, ("budget",)).collect()}
    assert problems(executed(("b", "128", 1), ("a", "64", 1))) == set()
    assert problems(executed(("a", "432", 1), ("b", "128", 2), ("c", "1", 1))) == {("a", "differs"), ("b", "invocations"), ("c", "unplanned")}
    assert problems(executed(("a", "64", 1), ("a", "64", 1))) == {("a", "duplicate")}
    with pytest.raises(integrity.IntegrityError):
        integrity.demand_empty(integrity.duplicates(executed(("a", "64", 1), ("a", "64", 1)), "sample_id"), "twice")
    with pytest.raises(integrity.IntegrityError):
        integrity.gate({"a": True, "b": False})
    assert integrity.gate({"a": True})
    seen, hidden = integrity.split_fields(spark.createDataFrame([("a", "x")], "sample_id string, answer string"), ("answer",))
    assert seen.columns == ["sample_id"] and integrity.reveal(seen, hidden).first().answer == "x"


def test_selection(spark):
    assert one(spark, selection.center_indices(F.lit(16), F.lit(4))) == [5, 6, 9, 10]
    assert one(spark, selection.center_indices(F.lit(10), F.lit(4))) == [3, 4, 5, 6]
    draw = selection.random_indices(F.lit(20), F.lit(5), F.lit("s1"))
    assert one(spark, draw) == one(spark, draw) and len(set(one(spark, draw))) == 5
    assert one(spark, selection.top_indices(F.array(F.lit(0.1), F.lit(0.9), F.lit(0.5)), F.lit(2))) == [1, 2]
    assert [one(spark, selection.kept(F.lit(b), F.lit(576))) for b in ("full", "64", "999")] == [576, 64, 576]


def test_generation_summary(spark):
    logits = [[1.0, 2.0, 0.0], [0.0, 0.0, 3.0]]
    got = one(spark, selection.generation_summary(F.array(*[F.array(*[F.lit(x) for x in r]) for r in logits]), F.array(F.lit(1), F.lit(2))))
    lp = [r - np.log(np.exp(r).sum()) for r in map(np.array, logits)]
    assert got.tokens == 2 and got.mean_logprob == pytest.approx((lp[0][1] + lp[1][2]) / 2) and got.last_logprob == pytest.approx(lp[1][2])
    assert got.first_margin == pytest.approx(1.0) and got.first_entropy == pytest.approx(-(np.exp(lp[0]) * lp[0]).sum())
    empty = one(spark, selection.generation_summary(F.array().cast("array<array<double>>"), F.array().cast("array<int>")))
    assert empty.tokens == 0 and empty.mean_logprob is None and empty.first_margin is None


def test_tasks_that_share_the_steps_fit_the_same_model(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cells = {"a": 60, "b": 50, "c": 4}
    rows = [(c, [float(v) for v in rng.integers(0, 9, 3)], bool(rng.random() < 0.6)) for c, n in cells.items() for _ in range(n)]
    rows += [("only", [float(i), 1.0, 0.0], True) for i in range(40)] + [(None, [float(i), 1.0, 2.0], i % 3 == 0) for i in range(40)] + rows[:7]
    df = spark.createDataFrame(rows, "cell string, features array<double>, safe boolean").repartition(5)
    want = {r.cell: r for r in controller.fit_cells(df, "cell", steps=12).collect()}
    monkeypatch.setattr(controller, "MOST_ROWS", 20)
    got = {r.cell: r for r in controller.fit_cells(df, "cell", steps=12).collect()}
    assert got.keys() == want.keys() == {"a", "b", "c", "only", None}
    for cell, r in want.items():
        assert got[cell].n == r.n
        for name in ("weights", "means", "scales"):
            assert got[cell][name] == pytest.approx(r[name], abs=1e-9), (cell, name)


def test_prefixes_are_carried_over_ranges(spark):
    rng = np.random.default_rng(3)
    # one group holds most rows, one is null, one has a single row
    given = [(g, float(v), int(w)) for g, n in (("hot", 400), (None, 30), ("one", 1)) for v, w in zip(rng.permutation(n), rng.integers(-5, 9, n), strict=True)]
    df = spark.createDataFrame(given, "g string, v double, w int")
    got = {(r.g, r.v): (r.total, r.most, r.least) for r in prefixes.before(df, ["g"], [F.col("v")], ranges=7, total=("sum", "w"), most=("max", "w"), least=("min", "w")).collect()}
    assert len(got) == len(given)
    for g in ("hot", None, "one"):
        mine = sorted((v, w) for x, v, w in given if x == g)
        for i, (v, _) in enumerate(mine):
            past = [w for _, w in mine[:i]]
            assert got[g, v] == ((sum(past), max(past), min(past)) if past else (None, None, None))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    groups_ = {"a": rng.integers(0, 20, 301).astype(float), "b": rng.random(50), "c": np.array([2.5])}
    rows = [(g, float(v)) for g, vs in groups_.items() for v in vs] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r for r in prefixes.exact_quantiles(df, "v", {"x": 0.9, "m": 0.5, "low": 0.9}, "g", lower=("low",)).collect()}
    assert got.keys() == groups_.keys()
    for g, vs in groups_.items():
        assert got[g].x == pytest.approx(np.quantile(vs, 0.9)) and got[g].m == pytest.approx(np.median(vs)) and got[g].low == np.sort(vs)[int(0.9 * (len(vs) - 1))]
    assert prefixes.exact_quantiles(df, "v", {"m": 0.5}).first().m == pytest.approx(np.median(np.concatenate(list(groups_.values()))))


@pytest.mark.parametrize("caps", [{"a": 1, "b": 9, "c": 9}, {f"c{i:02}": 10 for i in range(18)}, {"x": 5, "y": 2, "z": 30, "w": 2, "v": 7}])
def test_allocation_over_a_table_equals_the_plain_one(spark, caps):
    df = spark.createDataFrame([(k, i) for k, n in caps.items() for i in range(n)], "s string, id int")
    for target in {0, sum(caps.values()) // 2, sum(caps.values())}:
        assert {r.s: r.n for r in groups.allocate(df, "s", target).collect()} == groups.balanced_allocation(caps, target), target
    with pytest.raises(ValueError):
        groups.allocate(df, "s", sum(caps.values()) + 1)
    quota = groups.allocate(df, "s", 3)
    assert groups.stratified_take(df, quota, 1, "id", "s").count() == 3
