"""Telemetry as a stream: landing CSV files, windowed power with late samples, exactly-once appends of executed actions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.sources.readers import POWER


def power_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Power samples from CSV files as they land; bad rows are left out."""
    raw = spark.readStream.schema(POWER).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(folder)
    number = lambda c: F.trim(c).try_cast("double")
    rows = raw.select(number("epoch").alias("epoch"), number("power_w").alias("power_w")).where("epoch is not null and power_w is not null")
    return rows.withColumn("at", F.timestamp_micros((F.col("epoch") * 1e6).cast("bigint")))


def windowed_power(stream: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Samples, mean and largest power per window; state of windows older than the watermark is dropped. A sample that is resent counts once."""
    once = stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["epoch", "power_w"])
    per = once.groupBy(F.window("at", window)).agg(F.count("*").alias("n"), F.avg("power_w").alias("mean_power_w"), F.max("power_w").alias("max_power_w"))
    return per.select(F.col("window.start").alias("start"), "n", "mean_power_w", "max_power_w")


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str = "sample_id") -> StreamingQuery:
    """Appends rows to a folder of Parquet; a key is written once, whatever is sent again after a restart.

    What is there already is looked up in the folder (of which only the keys are read), so the stream keeps no state; a batch that is run
    again finds its own rows and adds none.
    """

    def append(batch: DataFrame, _: int) -> None:
        # of rows of one key in a batch the first by all its columns stays, whatever order they came in
        first = Window.partitionBy(key).orderBy(*(F.to_json(F.struct(c)) for c in sorted(batch.columns)))
        new = batch.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
        try:
            there = batch.sparkSession.read.parquet(path).select(key)
        except AnalysisException:  # nothing is there yet
            there = None
        (new if there is None else new.join(there, key, "left_anti").select(new.columns)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that has landed, through the stream, as a table in memory: for tests and small runs."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
