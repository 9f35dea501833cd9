"""Queries on odd or larger tables against their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import controller, energy, policy, safety, stats
from brindle.plans import audit_queries, catalog
from tests.test_audits import fold_rows
from tests.test_policy import DENSE, RECORD


def tables(spark, folder, **made):
    """A folder of parquet tables from DuckDB SELECTs."""
    con = duckdb.connect()
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
    return str(folder)


def same(spark, folder, name, only=None):
    """The rows of a query, which its SQL has to give, too."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in folder.iterdir():
        con.execute(f"CREATE VIEW {f.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{f}')")
    df = catalog.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    order = lambda rows: sorted(rows, key=repr)
    assert order(got) == order(want)
    return got


def test_decisions_on_the_threshold(spark, tmp_path):
    # sums that are 0 but for their last digits: their probability is one half, and the budget is taken
    text = "'size' || repeat(' x', w - 1) || repeat('x', c - 4 - 2 * (w - 1))"
    tables(spark, tmp_path, documents=f"SELECT row_number() OVER (ORDER BY w, c) AS doc_id, {text} AS text, 'en' AS lang, 's' AS source FROM range(1, 41) t(w), range(84, 500) u(c)")
    got = same(spark, tmp_path, "controller_decide")
    assert len(got) == 40 * 416 and any(r[1] == "128" and r[3] == 0.5 for r in got)


def test_no_frame_is_worked_out_anew_for_each_row(spark):
    # frames up to the last row cost the square of a bucket's rows (and of the number of buckets)
    samples = spark.createDataFrame([(1.0, 5.0)], "epoch double, power_w double")
    calls = spark.createDataFrame([(1, 0.0, 2.0)], "call_id long, start_epoch double, end_epoch double")
    for df in (energy.trapezoid(calls, samples), energy.attribute(calls, samples)):
        assert "unboundedfollowing" not in df._jdf.queryExecution().analyzed().toString().lower()


def test_energy_of_calls_with_equal_times_and_empty_buckets(spark, tmp_path):
    at = lambda s: f"TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * ({s})"
    views = f"SELECT i AS event_id, {at('CASE WHEN i % 3 = 0 THEN i * 40 ELSE i * 40 + 7200 * (i % 2) END')} AS ts, i % 90 AS user_id, 'view' AS event_type, (i * 7 % 50)::DOUBLE AS value FROM range(400) t(i)"
    buys = f"SELECT 1000 + i, {at('i * 120 - 3000')}, i % 90, 'purchase', CASE WHEN i % 5 = 0 THEN 0 WHEN i % 7 = 0 THEN 700 ELSE i % 13 END FROM range(200) t(i)"
    # of samples at one time one is kept: which of two the SQL takes isn't said
    tables(spark, tmp_path, events=f"SELECT event_id, ts, user_id, event_type, value::DOUBLE AS value, '' AS props FROM (SELECT DISTINCT ON (ts) * FROM ({views}) ORDER BY ts, event_id) UNION ALL SELECT *, '' FROM ({buys})")
    for name in ("energy_trapezoid", "energy_window_mean", "energy_nearest", "energy_nearest_earlier", "energy_by_method_budget", "energy_enriched_records"):
        same(spark, tmp_path, name)


def test_policies_read_and_shuffle_the_records_once(spark, tmp_path):
    # policies that judge records alike share their candidates, whatever they choose
    spark.createDataFrame(DENSE, RECORD).write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    sets = policy.decision_sets(rows, ("topk", "cover"), ["64", "128"], 0.25)
    paired = stats.paired_bootstrap(sets, ["dense_only", "supported"], 3, 5)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (sets, paired)]
    assert [p.count("FileScan") for p in plans] == [1, 1] and plans[0].count("Exchange hashpartitioning") == 1


def test_labels_group_the_records_once(spark):
    records = spark.createDataFrame(DENSE, RECORD)
    plan = safety.strict_labels(records)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Aggregate(keys=") == 2  # of partitions, then of all


def test_ablation_reads_the_rows_once_and_fits_all_configurations_together(spark, tmp_path, monkeypatch):
    fold_rows(spark)[0].withColumn("cell", F.when(F.col("key") % 2 == 0, "one").otherwise("two")).write.parquet(str(tmp_path / "r"))
    rows = spark.read.parquet(str(tmp_path / "r"))
    fits, fit = [], controller.fit_cells
    monkeypatch.setattr(controller, "fit_cells", lambda *a, **k: fits.append(a) or fit(*a, **k))
    got = controller.ablation(rows, steps=20)
    assert len(fits) == 1 and not any(str(tmp_path) in f for f in got.inputFiles())
    # the same as a configuration at a time
    for name in ("A0_full", "A3_keywords_only", "A6_intercept_only"):
        places = [p for g in controller.CONFIGURATIONS[name] for p in controller.FEATURE_GROUPS[g]]
        alone = stats.ranking_quality(controller.out_of_fold(rows, "cell", steps=20, places=places).withColumn("y", F.col("safe").cast("int")), "y", "score", "cell", "budget")
        assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, got.where(F.col("configuration") == name).select(alone.columns).collect()))


def test_ablation_query_takes_every_step_of_every_fit(spark, tmp_path):
    # the reference's descent, written out: 1,600 steps at a rate of 0.08, penalty 0.03
    words = "repeat('word ', i * 7 % 40) || CASE WHEN i % 5 = 0 THEN 'how many' WHEN i % 7 < 3 THEN 'left of the color' ELSE 'x' END"
    tables(spark, tmp_path, documents=f"SELECT i AS doc_id, {words} AS text, 'en' AS lang, 's' AS source FROM range(180) t(i)", labels="SELECT i AS doc_id, ((i * 7 % 40 > 18 OR i % 5 = 0) AND i % 11 > 1)::INT AS quality FROM range(180) t(i)")
    got = {(r.configuration, r.cell, r.budget): r for r in catalog.queries()["controller_ablation"](spark, str(tmp_path)).collect()}
    assert len(got) == 7 * 2 * 4
    rows = audit_queries._fold_rows(spark, str(tmp_path)).collect()
    for name in ("A0_full", "A3_keywords_only"):
        places = [p for g in controller.CONFIGURATIONS[name] for p in controller.FEATURE_GROUPS[g]]
        for cell, budget in ((c, b) for c in ("one", "two") for b in (64, 448)):
            mine = [r for r in rows if r.budget == budget and (r.key % 2 == 0) == (cell == "one")]
            x, y, fold = np.array([[r.features[p] for p in places] for r in mine]), np.array([float(r.safe) for r in mine]), np.array([r.fold for r in mine])
            score = np.zeros(len(mine))
            for f in set(fold):
                mean, scale = x[fold != f].mean(axis=0), np.maximum(x[fold != f].std(axis=0, ddof=1), 1e-8)
                z, w = (x - mean) / scale, np.zeros(len(places) + 1)
                train, known = z[fold != f], y[fold != f]
                for _ in range(1600):
                    error = 1 / (1 + np.exp(-(w[0] + train @ w[1:]))) - known
                    w -= 0.08 * np.concatenate(([error.mean()], train.T @ error / len(train) + 0.03 * w[1:]))
                score[fold == f] = 1 / (1 + np.exp(-(w[0] + z[fold == f] @ w[1:])))
            r = got[name, cell, budget]
            assert r.n == len(mine) and r.brier == pytest.approx(((score - y) ** 2).mean(), abs=2e-6)
            assert r.log_loss == pytest.approx(-(y * np.log(score) + (1 - y) * np.log(1 - score)).mean(), abs=2e-6)


def test_ranking_of_counted_rows_and_of_unknown_labels(spark):
    rows = spark.createDataFrame([("a", 1, 0.9, 3), ("a", 0, 0.9, 2), ("a", 0, 0.2, 4), ("a", None, 0.4, 2), (None, 1, 0.7, 1), (None, 0, 0.1, 2)], "g string, y int, s double, times long")
    counted = stats.ranking_quality(rows, "y", "s", "g", times="times").collect()
    repeated = stats.ranking_quality(rows.withColumn("i", F.explode(F.sequence(F.lit(1), "times"))), "y", "s", "g").collect()
    assert {r.g: r for r in counted} == {r.g: r for r in repeated} and {r.g: r.n for r in counted} == {"a": 11, None: 3}


def test_outcomes_read_the_tables_once_and_equal_their_sql(spark, tmp_path):
    # samples of one line and of many, without dense, with repeated records, a call without energy, keys below zero
    lines = """SELECT (i * 7919 % 97) - 20 AS l_orderkey, i AS l_linenumber, i * 31 % 101 AS l_partkey, i * 17 % 23 AS l_suppkey, DATE '1995-01-01' + (i % 50)::INT AS l_shipdate,
      CASE WHEN i % 37 <> 0 THEN (100 + i * 13 % 900)::DOUBLE END AS l_extendedprice, (1 + i % 50)::DOUBLE AS l_quantity, (i % 11) / 100.0::DOUBLE AS l_discount, (i % 9) / 100.0::DOUBLE AS l_tax,
      CASE WHEN i % 97 IN (3, 5) THEN 'A' ELSE (['N', 'A', 'R', 'N'])[1 + (i // 2 % 4)] END AS l_returnflag, CASE WHEN i % 5 < 3 THEN 'O' ELSE 'F' END AS l_linestatus FROM range(1500) t(i)"""
    orders = "SELECT i - 20 AS o_orderkey, 1 AS o_custkey, 'O' AS o_orderstatus, 10.0::DOUBLE AS o_totalprice, '1-URGENT' AS o_orderpriority FROM range(95) t(i)"
    tables(spark, tmp_path, lineitem=lines, orders=orders)
    for name in ("action_outcomes", "policy_outcomes", "controller_summary", "energy_reduction_bootstrap"):
        assert same(spark, tmp_path, name)
    plan = catalog.queries()["action_outcomes"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Exchange hashpartitioning") == 2
