"""Best-fit packing by large-item matching.

Lengths are whole numbers up to the capacity, so a packing needs only how many pieces there are of each
length: at most ``capacity`` counts go to the driver, whatever the corpus. There, pieces above a third
of the capacity, of which a sequence holds two at most, are matched greedily (the longest takes the
longest that still fits, which pairs as many as can be paired), and shorter pieces then go, longest
first, to the tightest gap. The result is a table of runs: pieces of a length with ranks from a to b go
to sequences from c on. Every piece finds its run by its rank among pieces of its length, and ranks come
from counts of tasks and prefix sums over tasks: no piece list is sorted, gathered or sent to the driver.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.byte_ids import END_ID, byte_ids, model_path
from brindle.llm.shared import bounded_batches, table, written

CAPACITY = 2048
#: Capacities stay below: a length and a rank (below 2**44) share 64 bits.
MOST_CAPACITY = 1 << 19

#: length, rank of the first piece, rank after the last, pieces side by side in a sequence, first sequence, offset.
Run = tuple[int, int, int, int, int, int]


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs for so many pieces of each length (1 to ``capacity``), and the number of sequences.

    Every step uses up a length or a range of sequences of one gap, so steps depend on ``capacity``
    and never on how many pieces there are.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    if any(not 1 <= s <= capacity for s in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    rank: dict[int, int] = defaultdict(int)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    open_gaps: list[int] = []  # sorted
    sequences = 0

    def place(s: int, n: int, side_by_side: int, first: int, offset: int) -> None:
        runs.append((s, rank[s], rank[s] + n, side_by_side, first, offset))
        rank[s] += n
        left[s] -= n
        if not left[s]:
            del left[s]

    def gap(g: int, first: int, n: int) -> None:
        if g and n:
            if not gaps[g]:
                insort(open_gaps, g)
            gaps[g].append((first, n))

    # matching: only these can be large, and two of them fill a sequence at most
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        n = left[a]
        i = bisect_right(large, capacity - a) - 1
        if i >= 0 and large[i] == a and n == 1:
            i -= 1
        if i < 0:
            place(a, n, 1, sequences, 0)
            gap(capacity - a, sequences, n)
        elif (b := large[i]) == a:
            n //= 2
            place(a, 2 * n, 2, sequences, 0)
            gap(capacity - 2 * a, sequences, n)
        else:
            n = min(n, left[b])
            place(a, n, 1, sequences, 0)
            place(b, n, 1, sequences, a)
            gap(capacity - a - b, sequences, n)
            if b not in left:
                large.pop(i)
        sequences += n
        if a not in left:
            large.pop()

    # best fit of the others, longest first
    for s in sorted(left, reverse=True):
        while n := left.get(s, 0):
            i = bisect_left(open_gaps, s)
            if i == len(open_gaps):
                new = -(-n // (capacity // s))
                gap(capacity, sequences, new)
                sequences += new
                continue
            g = open_gaps[i]
            first, there = gaps[g].pop()
            if not gaps[g]:
                open_gaps.pop(i)
            fit = min(g // s, n)
            taken = min(there, n // fit)
            place(s, taken * fit, fit, first, capacity - g)
            gap(g, first + taken, there - taken)
            gap(g - fit * s, first, taken)
    return runs, sequences


def pieces_of(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, model: str | None = None
) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, and its task and rank there among pieces of its length.

    A document is its ids and the end id. One longer than the capacity is cut into pieces of the
    capacity; what is over stands first, as a shorter piece.
    """
    path = model or model_path()
    if not 1 <= capacity < MOST_CAPACITY:
        raise ValueError(f"the capacity must be from 1 to {MOST_CAPACITY - 1}")
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = byte_ids(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            row: list[int] = []
            piece: list[int] = []
            start: list[int] = []
            length: list[int] = []
            crc: list[int] = []
            rank: list[int] = []
            for i, t in enumerate(batch.column(1)):
                ids = memoryview(encoder.encode(t.as_py()) + end)
                n = len(ids) // 4
                at = 0
                while at < n:
                    size = (n % capacity or capacity) if at == 0 else capacity
                    row.append(i)
                    piece.append(-(-at // capacity))
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    rank.append(int(seen[size]))
                    seen[size] += 1
                    at += size
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    pa.array([task] * len(row), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                ["key", "piece", "start", "length", "ids_crc32", "task", "rank"],
            )

    schema = f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    return bounded_batches(df).select(F.col(key), F.col(text)).mapInArrow(cut, schema)


def packed(
    df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, model: str | None = None
) -> DataFrame:
    """Every piece with sequence_id and offset, gapless from 0 in each sequence.

    The text is read once and never shuffled. Null and empty texts: one piece, the end id alone. Very long texts: as many pieces as they need. Null
    and repeated keys: each row is a document. Ties of length: by task and place in it. An empty table: no
    rows. Columns other than key and text are ignored.
    """
    pieces = written(pieces_of(df, key, text, capacity, model), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))).drop("n")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = pack(counts, capacity)
    of = np.array(sorted(runs), np.int64).reshape(-1, 6)
    # runs lie end to end in (length, rank)
    starts = (of[:, 0] << 44) + of[:, 1]
    sent = df.sparkSession.sparkContext.broadcast((starts, of))

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        starts, of = sent.value
        s, r = lengths.to_numpy(), ranks.to_numpy()
        run = of[np.searchsorted(starts, (s << 44) + r, "right") - 1]
        k = r - run[:, 1]
        return pa.StructArray.from_arrays(
            [pa.array(run[:, 4] + k // run[:, 3]), pa.array(run[:, 5] + k % run[:, 3] * s)], ["sequence_id", "offset"]
        )

    return (
        pieces.join(bases, ["length", "task"])
        .withColumn("at", place("length", F.col("base") + F.col("rank")))
        .select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))
