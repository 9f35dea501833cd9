"""A whole run over the smoke data, its artifacts, and what it says."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from brindle import __main__ as cli
from brindle.operators import reports
from brindle.plans import experiment
from brindle.sources import readers

CONFIG = {
    "run_name": "painted", "seed": 29, "backend": {"name": "deterministic"},
    "dataset": {"name": "smoke", "path": "data/painted/samples.jsonl", "validation_split": "validation", "test_split": "test"},
    "interventions": [{"name": "black", "type": "black"}, {"name": "soft", "type": "blur", "radius": 3.0}, {"name": "gray", "type": "gray"}],
    "pruning": {"methods": ["topk", "cover"], "budget_schedule": [9, 25, 49], "dense_budget": "full"},
    "policy": {"tau_grid": [0.02, 0.07, 0.3], "rho_grid": [0.25, 0.6], "dense_vem_min": 0.01, "prefer_rr": True},
    "cost": {"base_ms": 7.5, "per_token_ms": 0.4, "dense_token_count": 81, "dollar_per_1k_ms": 0.0003, "energy_joule_per_ms": 0.02},
    "outputs": {"dir": "results/painted"}, "analysis": {"bootstrap_iterations": 12},
}


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    root = tmp_path_factory.mktemp("run")
    (root / "configs").mkdir()
    cli.main(["make-smoke-data", "--out", str(root / "data" / "painted")])
    (root / "configs" / "c.json").write_text(json.dumps(CONFIG))
    return root, readers.load_config(str(root / "configs" / "c.json"))


def test_a_run_writes_every_artifact(spark, made):
    root, config = made
    result = experiment.run(spark, config)
    # 12 samples, 3 interventions, dense and 3 budgets of 2 methods
    assert result["n_records"] == 12 * 3 * 7 and result["n_decisions"] > 0
    assert set(result["artifacts"]) == set(experiment.ARTIFACTS) and len(experiment.ARTIFACTS) == 19
    for path in result["artifacts"].values():
        assert Path(path).exists(), path
    claims = json.loads(Path(result["artifacts"]["claims_json"]).read_text())
    assert len(claims["claim_sentences"]) == 5 and claims["thresholds"]["tau"] in (0.02, 0.07, 0.3) and claims["thresholds"]["rho"] in (0.25, 0.6)
    assert "Cheapest supported budget" in Path(result["artifacts"]["report_md"]).read_text()
    again = experiment.analyze_existing(spark, config, result["artifacts"]["records_jsonl"], str(root / "again"), "renamed")
    assert again["n_records"] == result["n_records"] and again["decision_summary"] == result["decision_summary"]
    with pytest.raises(ValueError):
        experiment.run(spark, config | {"backend": {"name": "gpu"}})


def test_a_resumed_grid_equals_one_that_ran_through(spark, made):
    root, config = made
    folder = f"file://{root}/grid"
    experiment.resumed_scores(spark, config, folder, at_most=2)
    got = experiment.resumed_scores(spark, config, folder).records()
    want = experiment.score_grid(spark, config)
    assert got.columns == want.columns
    rows = lambda df: sorted(map(repr, df.select("sample_id", "method", "budget", "intervention", "vem", "dense_vem", "reliance_retention", "cost").collect()))
    assert rows(got) == rows(want)


def test_paths_of_a_configuration():
    config = {"_root_dir": "s3://bucket/run"}
    assert readers.resolve_path(config, "s3://other/x") == "s3://other/x" and readers.resolve_path(config, "data/x") == "s3://bucket/run/data/x" and readers.resolve_path(config, "/a/b") == "/a/b"


def test_dense_alone(spark, made):
    root, config = made
    alone = config | {"pruning": {"methods": [], "budget_schedule": [], "dense_budget": "full"}, "outputs": {"dir": "results/dense"}}
    result = experiment.run(spark, alone)
    claims = json.loads(Path(result["artifacts"]["claims_json"]).read_text())
    assert claims["claim_deltas"]["accuracy_delta_vs_dense_pp"] == 0.0 and claims["claim_deltas"]["token_reduction_vs_dense_pct"] is None
    assert claims["claim_sentences"][-1].startswith("Nothing is said")


def test_strict_audit(spark, made):
    _, config = made
    tables = experiment.strict_audit(experiment.score_grid(spark, config), 0.1)
    assert tables["labels"].count() == 12 * 7 and tables["split_leakage"].count() == 0
    assert tables["monotonicity"].count() == 12 * 2


def test_names():
    names = reports.policy_names(["scope", "other"], ["64", "128", "256"])
    assert names["scope_fixed_medium"] == "SCOPE fixed at 128" and names["other_cost_only"] == "other by cost only" and len(names) == 15


def test_registered_benchmarks(spark, tmp_path):
    spark.createDataFrame([("1", "is it?", "Yes", "i.png", {"b": "no", "a": "yes"})], "id string, question string, answer string, image_path string, options map<string,string>").write.parquet(str(tmp_path / "in" / "val"))
    path = readers.prepare_benchmark(spark, "mmstar", str(tmp_path / "in"), str(tmp_path / "out"))
    got = spark.read.json(path).first()
    assert got.sample_id == "mmstar-1" and got.options == ["yes", "no"]
    with pytest.raises(ValueError):
        readers.prepare_benchmark(spark, "unknown", "", "")


def test_samples_by_line(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    same = {"question": "q", "image_path": "images/a.png", "answer": "x"}
    path.write_text("\n".join([json.dumps(same), "", json.dumps(same), json.dumps({**same, "sample_id": "named", "image_path": "/abs.png", "options": ["o"]})]) + "\n")
    got = readers.samples(spark, str(path), "d").orderBy("sample_id").collect()
    assert [(r.sample_id, r.options) for r in got] == [("named", ["o"]), ("row-1", []), ("row-3", [])]
    assert [r.image_path for r in got] == ["/abs.png", f"{tmp_path}/images/a.png", f"{tmp_path}/images/a.png"]
    assert readers.samples(spark, str(path), "d", limit=2).count() == 2
    many = tmp_path / "many.jsonl"
    many.write_text("".join(json.dumps({"question": f"q{i}" * 20}) + "\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = {r.sample_id: r.question for r in readers.samples(spark, str(many), "d").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"row-{i + 1}": f"q{i}" * 20 for i in range(3000)}
    path.write_text(json.dumps(same) + "\n{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.samples(spark, str(path), "d").collect()


def test_label_free_scan_refuses_every_hidden_key(spark, tmp_path):
    good = {"sample_id": "a", "dataset": "d", "image_path": "i.png", "question": "q", "options": []}
    path = tmp_path / "p.jsonl"
    path.write_text(json.dumps(good))
    row = readers.label_free_samples(spark, str(path)).first()
    assert (row.split, row.image_path) == ("prospective", f"{tmp_path}/i.png")
    for hidden in readers.HIDDEN:
        path.write_text(json.dumps({**good, hidden: 1}))
        with pytest.raises(Exception, match="label-free"):
            readers.label_free_samples(spark, str(path)).collect()


def test_images_need_their_library():
    from brindle.operators import images

    with pytest.raises(ValueError):
        images.intervene(F.lit(None), "counterfactual")
    with pytest.raises(ValueError):
        images.from_pool([], F.lit(1))
