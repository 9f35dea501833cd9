"""Streaming attribution against the batch operator on all that has landed."""

import random

import pytest

from brindle.operators import energy
from brindle.streaming import attribution

SAMPLE, CALL = "device string, epoch double, power_w double", "device string, call_id bigint, start_epoch double, end_epoch double"


def landed(seed):
    rng = random.Random(seed)
    samples, calls = [], []
    for device in ("gpu0", "gpu1", "gpu2"):
        t = 1000.0
        while t < 1300:
            t += rng.choice([0.2, 0.2, 0.5, 20.0])  # gaps without samples
            samples.append((device, round(t, 3), float(rng.randint(50, 300))))
        for _ in range(25):
            start = round(rng.uniform(1001, 1280), 2)
            calls.append((device, len(calls), start, round(start + rng.choice([0.05, 0.3, 2.0, 30.0]), 2)))
        samples.append((device, 4000.0, 99.0))  # moves the watermark past all calls
    calls.append(("gpu0", 900, 1100.0, 1100.0))
    return samples, calls


@pytest.mark.parametrize("later", [True, False])
def test_stream_equals_batch(spark, tmp_path, later):
    samples, calls = landed(3)
    for folder in ("samples", "calls"):
        (tmp_path / folder).mkdir()
    source = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    def land(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def go():
        out = attribution.attributed(source("samples", SAMPLE), source("calls", CALL), "10 seconds", 31.0, later)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    by_time = lambda rows, at, a, b: [r for r in rows if a <= r[at] < b]
    edges = [0, 1100, 1200, 5000]
    for a, b in zip(edges, edges[1:], strict=False):  # three starts of the stream, the state goes on
        for rows, at, name, schema in ((samples, 1, "samples", SAMPLE), (calls, 3, "calls", CALL)):
            if part := by_time(rows, at, a, b):
                random.Random(1).shuffle(part)
                land(name, part, schema)
        query = go()
    # one more batch, so that timers up to the last watermark ring
    land("samples", [(d, 4100.0, 1.0) for d in ("gpu0", "gpu1", "gpu2")], SAMPLE)
    query = go()
    got = {r.call_id: r for r in spark.read.schema(attribution.OUT).parquet(str(tmp_path / "out")).collect()}
    assert len(got) == len(calls)
    all_samples = [*samples, *((d, 4100.0, 1.0) for d in ("gpu0", "gpu1", "gpu2"))]
    for device in ("gpu0", "gpu1", "gpu2"):
        mine = spark.createDataFrame([c[1:] for c in calls if c[0] == device], CALL.split(", ", 1)[1])
        power = spark.createDataFrame([s[1:] for s in all_samples if s[0] == device], SAMPLE.split(", ", 1)[1])
        for want in energy.attribute(mine, power, later).collect():
            r = got[want.call_id]
            assert (r.device, r.n_samples) == (device, want.n_samples)
            assert r.mean_power_w == pytest.approx(want.mean_power_w) if want.mean_power_w is not None else r.mean_power_w is None
            assert r.energy_joule == pytest.approx(want.energy_joule) if want.energy_joule is not None else r.energy_joule is None
    progress = query.lastProgress or query.recentProgress[-1]
    assert progress["stateOperators"][0]["numRowsTotal"] == 3  # a row a device


def test_a_call_waits_until_nothing_can_change_it():
    samples = [(10.0, 5.0), (12.0, 7.0)]
    settled = lambda start, end, now, later=True: attribution._settled(start, end, samples, now, later)
    assert settled(9.0, 12.0, 12.0) == 12.0 and settled(9.0, 12.0, 12.1) == (2, 6.0)  # a sample at the end may still come
    assert settled(10.4, 10.6, 10.7) == 11.0 and settled(10.4, 10.6, 11.1) == (0, 5.0)
    assert settled(10.9, 11.1, 12.1) == (0, 7.0) and settled(10.9, 11.1, 12.1, False) == (0, 5.0)
    assert settled(20.0, 22.0, 23.0) == 30.0 and settled(20.0, 22.0, 30.5) == (0, 7.0)
    assert settled(12.0, 12.0, 0.0) == (1, None)
    assert attribution._settled(1.0, 2.0, [], 50.0, True) == float("inf")
