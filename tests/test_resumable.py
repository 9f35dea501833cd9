"""Runs that are stopped and go on; files that grow while they are read."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.operators.integrity import IntegrityError
from brindle.plans import resumable
from brindle.plans.resumable import Cell
from brindle.sources import store
from brindle.streaming import growing

PLANNED = resumable.cells(("topk", "cover"), ("64", "256"), shards=2)


def evaluator(spark, fail_at=None, asked=None):
    """Records of 40 samples; pruned cells take the margin of their dense record."""
    samples = spark.range(40).select(F.col("id").cast("string").alias("sample_id")).crossJoin(spark.createDataFrame([("gray",), ("blur",)], "intervention string"))

    def evaluate(cell, dense):
        if asked is not None:
            asked.append(cell)
        rows = samples.where(resumable.shard_of(shards=2) == cell.shard).withColumns({"method": F.lit(cell.method), "budget": F.lit(cell.budget)})
        margin = F.pmod(F.xxhash64("sample_id", "intervention"), F.lit(1000)) / 1000.0
        if cell.method == "dense":
            rows = rows.withColumns({"vem": margin, "dense_vem": margin})
        else:
            rows = rows.join(dense.select("sample_id", "intervention", F.col("vem").alias("dense_vem")), ["sample_id", "intervention"]).withColumn("vem", F.col("dense_vem") * F.lit(int(cell.budget)) / 576)
        rows = rows.select("sample_id", "method", "budget", "intervention", "vem", "dense_vem")
        if fail_at == cell:  # half of the records are written, then the job dies
            bad = F.when(F.col("sample_id") == rows.agg(F.max("sample_id")).first()[0], F.raise_error(F.lit("the machine is gone")).cast("double")).otherwise(F.col("vem"))
            rows = rows.withColumn("vem", bad)
        return rows

    return evaluate


def rows(run):
    return sorted(map(tuple, run.records().collect()))


def test_a_killed_run_goes_on_and_equals_an_unbroken_one(spark, tmp_path):
    whole = resumable.run_grid(spark, f"file://{tmp_path}/whole", {"seed": 1}, PLANNED, evaluator(spark))
    broken, killed = f"file://{tmp_path}/broken", Cell("topk", "64", 1)
    with pytest.raises(Exception, match="the machine is gone"):
        resumable.run_grid(spark, broken, {"seed": 1}, PLANNED, evaluator(spark, killed))
    run = resumable.Run(spark, broken, {"seed": 1})
    assert [c.name for c in run.pending(PLANNED)] == [c.name for c in PLANNED[3:]]
    before = run.log()
    asked = []
    run = resumable.run_grid(spark, broken, {"seed": 1}, PLANNED, evaluator(spark, asked=asked))
    assert asked == PLANNED[3:] and run.pending(PLANNED) == []
    assert rows(run) == rows(whole) and len(rows(run)) == 40 * 2 * 5
    log = run.log()
    assert {k: log[k] for k in before} == before and {k: e["checksum"] for k, e in log.items()} == {k: e["checksum"] for k, e in whole.log().items()}
    # the attempt that died left a folder, which the next start removed
    assert len(store.names(spark, f"{broken}/cells")) == len(PLANNED)
    run.verify()


def test_attempts_without_an_entry_are_not_read(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    run = resumable.run_grid(spark, root, {}, PLANNED, evaluator(spark), at_most=3)
    n = run.records().count()
    run.records().limit(5).write.parquet(f"{root}/cells/topk-64-00001-dead")
    store.write_bytes(spark, f"{root}/log/_topk-64-00001.json.tmp", b'{"method": "topk"')
    assert run.records().count() == n and len(run.log()) == 3
    assert run.tidy() == ["topk-64-00001-dead"]


def test_cells_are_checked(spark, tmp_path):
    run = resumable.Run(spark, f"file://{tmp_path}/r", {"seed": 1})
    one = evaluator(spark)(PLANNED[0], None)
    with pytest.raises(IntegrityError, match="twice"):
        run.finish(PLANNED[0], one.unionByName(one))
    with pytest.raises(IntegrityError, match="other cells"):
        run.finish(PLANNED[2], one)
    assert run.log() == {} and run.records() is None
    run.finish(PLANNED[0], one)
    with pytest.raises(IntegrityError, match="finished already"):
        run.finish(PLANNED[0], one)
    with pytest.raises(IntegrityError, match="another plan"):
        resumable.Run(spark, f"file://{tmp_path}/r", {"seed": 2})
    one.where("sample_id <> '0'").limit(3).write.mode("overwrite").parquet(run.log()[PLANNED[0].name]["folder"])
    with pytest.raises(IntegrityError, match="isn't what was finished"):
        run.verify()


def test_dense_records_of_another_run_are_taken_over(spark, tmp_path):
    first = resumable.run_grid(spark, f"file://{tmp_path}/a", {}, PLANNED, evaluator(spark), at_most=2)
    run = resumable.Run(spark, f"file://{tmp_path}/b", {"other": True})
    with pytest.raises(IntegrityError):
        run.seed_dense(first.records(), 79, shards=2)
    run.seed_dense(first.records(), 80, shards=2)
    asked = []
    resumable.run_grid(spark, f"file://{tmp_path}/b", {"other": True}, PLANNED, evaluator(spark, asked=asked))
    assert asked == PLANNED[2:]


def test_rows_added_to_a_file_are_read_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "RANGE", 40)  # rows lie across ranges
    folder = tmp_path / "power"
    folder.mkdir()
    line = lambda i: f"2026/01/01, {i}.5, {100 + i}\n"
    (folder / "a.csv").write_text("timestamp, epoch, power_w\n" + "".join(map(line, range(5))) + "2026/01/01, 5.")

    def read():
        query = growing.growing_power(spark, str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.epoch for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert read() == [i + 0.5 for i in range(5)]  # the line that is being written waits
    with (folder / "a.csv").open("a") as f:
        f.write("5, 105\n" + "bad, x, y\n" + "".join(map(line, range(6, 9))))
    (folder / "b.csv").write_text("power_w,epoch\n7,100\n\n8,101\n")
    assert read() == [i + 0.5 for i in range(9)] + [100.0, 101.0]
    assert read() == [i + 0.5 for i in range(9)] + [100.0, 101.0]
    (folder / "a.csv").write_text("timestamp, epoch, power_w\n")
    with pytest.raises(Exception, match="shorter"):
        read()


def test_paths_are_joined_as_text(spark, tmp_path):
    assert store.join("s3://b/x/", "y", "/z.json") == "s3://b/x/y/z.json"
    assert store.is_absolute("s3://b") and store.is_absolute("/a") and not store.is_absolute("a/b")
    path = f"file://{tmp_path}/f.json"
    assert store.publish(spark, path, json.dumps({"a": 1}).encode()) and not store.publish(spark, path, b"other")
    assert json.loads(store.read_bytes(spark, path)) == {"a": 1} and store.names(spark, f"file://{tmp_path}/none") == []
