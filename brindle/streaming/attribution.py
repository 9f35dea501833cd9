"""Energy of calls as a stream: power samples and calls of a fleet, attributed once the watermark says that nothing more can come.

Each device is a key of its own. Its state holds the samples that an open or later call can still need and the calls that are open; a call leaves it when all
samples up to its end have come, or, if there are none in it, all samples that could be the nearest. Event-time timers wake devices of which
nothing new comes. What lies before the watermark and before every open call goes, but for the last sample, so the state is bounded by the
lateness, the longest call and the rate of sampling, not by how long the stream runs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "device string, call_id bigint, start_epoch double, end_epoch double, n_samples bigint, mean_power_w double, energy_joule double"
_STATE = "epochs array<double>, powers array<double>, call_ids array<bigint>, starts array<double>, ends array<double>"


def _settled(start: float, end: float, samples: list[tuple[float, float]], now: float, later_on_tie: bool) -> tuple[int, float | None] | float:
    """(samples, mean power) of a call if no sample that is still to come (at ``now`` or after) can change it, else the time until which it must wait."""
    if not end > start:
        return bisect_right(samples, (end, float("inf"))) - bisect_left(samples, (start, float("-inf"))), None
    if now <= end:
        return end
    a, b = bisect_left(samples, (start, float("-inf"))), bisect_right(samples, (end, float("inf")))
    if b > a:
        return b - a, sum(p for _, p in samples[a:b]) / (b - a)
    # none in it: the nearest to the middle
    middle = (start + end) / 2
    at = bisect_left(samples, (middle, float("-inf")))
    before, after = samples[at - 1] if at else None, samples[at] if at < len(samples) else None
    if before is None and after is None:
        return float("inf")
    reach = after[0] if before is None else middle + (middle - before[0])
    reach = reach if after is None else min(reach, after[0])
    if now <= reach:
        return reach
    if before is None:
        return 0, after[1]
    if after is None:
        return 0, before[1]
    ahead, behind = after[0] - middle, middle - before[0]
    return 0, after[1] if ahead < behind or (ahead == behind and later_on_tie) else before[1]


def attributed(samples: DataFrame, calls: DataFrame, late: str = "1 minute", longest: float = 600.0, later_on_tie: bool = True) -> DataFrame:
    """A stream of calls with n_samples, mean_power_w and energy_joule, as :func:`brindle.operators.energy.attribute` gives them.

    ``samples``: device, epoch, power_w; ``calls``: device, call_id, start_epoch, end_epoch; both streams. A row that comes more than
    ``late`` after later ones is dropped. Calls that don't end after they start have null power. Calls without any sample near wait for one.
    A call is a row of its end, so samples are kept for ``longest`` seconds behind the watermark; a call that takes longer is an error.
    """
    at = lambda c: F.timestamp_micros((F.col(c) * 1e6).cast("bigint")).alias("at")
    none = lambda kind: F.lit(None).cast(kind)
    s = samples.where("epoch is not null and power_w is not null").select("device", at("epoch"), "epoch", "power_w", none("bigint").alias("call_id"), none("double").alias("end_epoch"))
    c = calls.where("start_epoch is not null and end_epoch is not null").select("device", at("end_epoch"), F.col("start_epoch").alias("epoch"), none("double").alias("power_w"), "call_id", "end_epoch")
    rows = s.unionByName(c).withWatermark("at", late)

    def step(key: tuple[Any], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epochs, powers, ids, starts, ends = state.get if state.exists else ([], [], [], [], [])
        held, open_ = list(zip(epochs, powers, strict=True)), list(zip(ids, starts, ends, strict=True))
        for pdf in batches:
            is_call = pdf["end_epoch"].notna()
            held += list(zip(pdf["epoch"][~is_call], pdf["power_w"][~is_call], strict=True))
            if ((pdf["end_epoch"] - pdf["epoch"]) > longest).any():
                raise ValueError(f"a call on {key[0]} takes more than {longest} s: set longest")
            open_ += list(zip(pdf["call_id"][is_call].astype("int64"), pdf["epoch"][is_call], pdf["end_epoch"][is_call], strict=True))
        held.sort()
        now = state.getCurrentWatermarkMs() / 1000
        out, waiting, wake = [], [], []
        for call, start, end in open_:
            found = _settled(start, end, held, now, later_on_tie)
            if isinstance(found, tuple):
                n, mean = found
                out.append((key[0], call, start, end, n, mean, None if mean is None else mean * (end - start)))
            else:
                waiting.append((call, start, end))
                wake.append(found)
        # of what no open or later call reaches, the last sample stays: it may be the nearest
        needed = min([now - longest, *(start for _, start, _ in waiting)])
        held = held[max(0, bisect_left(held, (needed, float("-inf"))) - 1) :]
        state.update(tuple([list(map(float, x)) for x in zip(*held, strict=True)] or [[], []]) + ([int(c) for c, _, _ in waiting], [float(x) for _, x, _ in waiting], [float(x) for _, _, x in waiting]))
        if wake and (soon := min(wake)) != float("inf"):
            state.setTimeoutTimestamp(int(max(soon, now) * 1000) + 1)
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]).astype({"mean_power_w": "float64", "energy_joule": "float64"})

    return rows.groupBy("device").applyInPandasWithState(step, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
