"""Readers, writers, streams and the registered queries."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.sources import readers, writers
from brindle.streaming import telemetry


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_samples_and_defaults(spark, tmp_path):
    path = lines(tmp_path / "s.jsonl", {"id": "b", "question": "q", "options": ["x"]}, "", {"sample_id": "a", "split": "val", "dataset": "d", "question": "é"})
    got = readers.samples(spark, path, "mine").orderBy("sample_id").collect()
    assert [(r.sample_id, r.split, r.dataset) for r in got] == [("a", "val", "d"), ("b", "test", "mine")]
    assert readers.samples(spark, path, "mine", limit=1).count() == 1


def test_option_repair(spark):
    rows = [
        ("mmstar", "Choices:\n(A) red\n(B) blue", "B", ["A", "B"]),
        ("mmstar", "Options: A: up, B: down", "a", []),
        ("mmstar", "no list", "A", ["one", "two"]),
        ("other", "Options: A: up, B: down", "A", ["A", "B"]),
    ]
    df = spark.createDataFrame(rows, "dataset string, question string, answer string, options array<string>")
    got = readers.repair_options(df).collect()
    assert [(r.answer, r.options) for r in got] == [("blue", ["red", "blue"]), ("up", ["up", "down"]), ("one", ["one", "two"]), ("A", ["A", "B"])]


def test_label_free_samples(spark, tmp_path):
    good = {"sample_id": "a", "dataset": "d", "image_path": "i", "question": "q", "options": []}
    assert readers.label_free_samples(spark, lines(tmp_path / "a.jsonl", good)).first().sample_id == "a"
    for bad in ({**good, "answer": "x"}, {k: v for k, v in good.items() if k != "options"}):
        with pytest.raises(Exception, match="label-free"):
            readers.label_free_samples(spark, lines(tmp_path / "b.jsonl", bad)).collect()


def test_benchmark_rows(spark):
    rows = [("1", "is it?", "Yes", None, None, "i.png"), ("2", "pick", "['red', 'x']", "red", "blue", "j.png"), ("3", None, "a", None, None, "k.png")]
    df = spark.createDataFrame(rows, "id string, question string, answer string, A string, B string, image_path string")
    got = {r.sample_id: r for r in readers.benchmark_rows(df, "d").collect()}
    assert got.keys() == {"d-1", "d-2"} and got["d-1"].options == ["yes", "no"] and got["d-2"].options == ["red", "blue"] and got["d-2"].answer == "red"
    assert {r.split for r in got.values()} <= {"validation", "test"}


def test_records_and_checkpoints(spark, tmp_path):
    row = {"sample_id": "a", "method": "dense", "budget": "full", "intervention": "gray", "vem": 0.5, "is_correct": True}
    path = lines(tmp_path / "r.jsonl", row, {**row, "intervention": "blur"})
    assert readers.checkpoint(spark, path).count() == 2
    with pytest.raises(ValueError):
        readers.checkpoint(spark, lines(tmp_path / "d.jsonl", row, row))
    (tmp_path / "e.jsonl").write_text("")
    with pytest.raises(ValueError):
        readers.records(spark, str(tmp_path / "e.jsonl"))


CSV = "epoch,timestamp,power_w,utilization_gpu_pct,memory_used_mb,memory_total_mb\n"


def test_power_samples(spark, tmp_path):
    for i, body in enumerate(("1.5, x, 100.0, 5, 10, 20\nbad, x, y, , ,\n", ",2024/01/01 00:00:01.500, 90, 1, 2, 3\n")):
        (tmp_path / f"attempt_{i}").mkdir()
        (tmp_path / f"attempt_{i}" / "p.csv").write_text(CSV + body)
    got = readers.power_samples(spark, f"{tmp_path}/attempt_*/p.csv").orderBy("epoch").collect()
    assert [(r.epoch, r.power_w) for r in got] == [(1.5, 100.0), (1704067201.5, 90.0)]
    with pytest.raises(Exception, match="telemetry"):
        readers.power_samples(spark, f"{tmp_path}/attempt_0/p.csv", strict=True).collect()


def test_ledger_files_and_logs(spark, tmp_path):
    for name, value in (("a", {"measured_energy_joule": 5.0, "duration_s": 2.0}), ("b", {"duration_s": 1.0}), ("skip", {"measured_energy_joule": 1.0, "duration_s": 1.0})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run_summary.json").write_text(json.dumps(value, indent=1))
    runs, left = readers.ledger_files(spark, str(tmp_path), excluded=("skip",))
    assert [r.energy_joule for r in runs.collect()] == [5.0] and left.count() == 2
    tracker = spark.createDataFrame([(f"file://{tmp_path}/emissions.csv", 1.0)], "path string, kwh double")
    assert readers.beside(runs.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")), tracker).first().tracker.kwh == 1.0
    (tmp_path / "run.log").write_text("started\nenergy: 12.5 J\n")
    assert readers.log_values(spark, f"{tmp_path}/run.log", {"joule": r"energy: ([0-9.]+)", "none": r"x=(\d+)"}).first()[1:] == (12.5, None)


def test_images_and_config(spark, tmp_path):
    (tmp_path / "b.png").write_bytes(b"xx")
    got = readers.source_groups(readers.images(spark, str(tmp_path)).withColumn("dataset", F.lit("d"))).first()
    assert got.source_group == f"d::{got.sha256}" and got.length == 2
    (tmp_path / "configs").mkdir()
    (tmp_path / "configs" / "c.json").write_text('{"seed": 1}')
    config = readers.load_config(str(tmp_path / "configs" / "c.json"))
    assert config["seed"] == 1 and readers.resolve_path(config, "x/y") == f"{tmp_path}/x/y" and readers.resolve_path(config, "/z") == "/z"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "é", ["a"], None)], "b int, a string, c array<string>, d string").coalesce(1)
    writers.write_jsonl(df, str(tmp_path / "j"))
    (part,) = (tmp_path / "j").glob("*.json")
    assert part.read_text(encoding="utf-8").strip() == '{"a":"é","b":2,"c":["a"],"d":null}'
    with pytest.raises(Exception, match="exist"):
        writers.write_jsonl(df, str(tmp_path / "j"))
    writers.write_csv(df, str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("*.csv")
    assert part.read_text(encoding="utf-8").splitlines()[0] == "a,b,c,d"
    digest = writers.write_json({"b": 1, "a": "é"}, str(tmp_path / "x.json"), sidecar=True)
    assert (tmp_path / "x.json").read_text(encoding="utf-8") == '{\n  "a": "é",\n  "b": 1\n}\n' and digest in (tmp_path / "x.json.sha256").read_text()
    assert writers.markdown_table(df.select("b", "a")) == "| b | a |\n|---|---|\n| 2 | é |\n"
    with pytest.raises(ValueError):
        writers.markdown_table(spark.range(3), most=2)
    svg = writers.frontier_svg([{"mean_latency_ms": 1.0, "mean_rr": 0.0, "method": "<m>"}, {"mean_latency_ms": None, "mean_rr": 1.0}], "t & u")
    assert svg.count("<circle") == 1 and "&lt;m&gt;" in svg and "t &amp; u" in svg and "no points" in writers.frontier_svg([], "t")
    assert writers.write_report(str(tmp_path / "r"), {"one": df.select("a")}, "T") == ["one", "report.md"]
    with pytest.raises(FileExistsError):
        writers.fresh_directory(str(tmp_path / "r"))
    assert (writers.percent(0.5), writers.points(-0.01), writers.percent(None)) == ("50.0%", "-1.0 pp", "n/a")


def test_power_stream(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "1.csv").write_text(CSV + "60.0,,100,,,\n61.0,,200,,,\n61.0,,200,,,\nbad,,1,,,\n")
    (landing / "2.csv").write_text(CSV + "125.0,,50,,,\n")
    got = telemetry.run_available(telemetry.windowed_power(telemetry.power_stream(spark, str(landing))), "power_windows").orderBy("start").collect()
    assert [(r.n, r.mean_power_w, r.max_power_w) for r in got] == [(2, 150.0, 200.0), (1, 50.0, 50.0)]


def test_append_once_survives_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    read = lambda: spark.readStream.schema("sample_id string, x int").json(str(source))
    for rows in ([("a", 1), ("b", 2)], [("b", 2), ("c", 3)]):
        (source / f"{len(list(source.iterdir()))}.json").write_text("\n".join(json.dumps({"sample_id": k, "x": v}) for k, v in rows))
        telemetry.append_once(read(), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r.sample_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_registered_queries_and_sql():
    import __spark_entry__ as entry

    assert len(entry.queries()) >= 90 and not set(entry.oracle_sql()) - set(entry.queries())


def test_queries_equal_their_sql(spark):
    """A cross-section on the smallest tables; the whole list is compared at a larger scale by the driver."""
    import duckdb

    from brindle.plans import catalog
    from brindle.sources.adapters import TABLES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    flat = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    for name in ("policy_cheapest_supported", "policy_online_cascade", "record_summary", "strict_labels", "energy_trapezoid", "quota_draws", "auroc_brier_logloss", "carbon_ledger_rollup"):
        df = catalog.queries()[name](spark, sf)
        cols = sorted(df.columns)
        got = sorted(tuple(flat(r[c]) for c in cols) for r in df.collect())
        found = con.execute(catalog.oracle_sql()[name])
        places = [[d[0] for d in found.description].index(c) for c in cols]
        assert got == sorted(tuple(flat(r[i]) for i in places) for r in found.fetchall()), name
