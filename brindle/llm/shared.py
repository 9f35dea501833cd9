"""What the training-data operators share: driver tables and the training fold."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.graph import salted_totals
from brindle.sources.folders import fresh_folder, shared_folder, written

__all__ = ["bounded_batches", "free_name", "fresh_folder", "held_out", "release", "remembers", "salted_totals", "shared_folder", "table", "working_on", "written"]

#: Bytes of an Arrow batch that goes to a Python worker, about; one row more than that is a batch of its own.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"

#: Rows whose crc32(doc_id as text) leaves this remainder modulo 4 are held out of every training set.
HELD_OUT_REMAINDER = 2


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, to be handed to Python in batches of a few megabytes: by rows alone a batch of long texts has no bound.

    A limit that the cluster's own configuration sets stays.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, BATCH_BYTES)
    return df


_remembered: dict[str, Callable[[], None]] = {}
_working_on = ""


def remembers(operator: str, forget: Callable[[], None]) -> None:
    """An operator keeps something in its worker process; ``forget`` drops it."""
    _remembered[operator] = forget


def working_on(operator: str) -> None:
    """A worker process serves one stage after the other: what another operator remembers there goes now."""
    global _working_on
    if operator != _working_on:
        _working_on = operator
        for other, forget in _remembered.items():
            if other != operator:
                forget()
        release()


def release() -> None:
    """Gives memory that is free back to the system, so that workers that live long stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries give it back by themselves
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark so that any store that Spark knows will do."""
    return bounded_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, in any case of its letters."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = "_" + name
    return name


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows kept out of training; a null id is never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER, F.lit(False))
