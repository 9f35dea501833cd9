"""Scans: samples, label-free samples, records, telemetry, ledgers, logs. Schemas are given, never inferred."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from brindle.functions.answers import first_text, hash_split, lettered_options, literal_first, option_letters, repaired_options
from brindle.operators.controller import FORBIDDEN
from brindle.operators.integrity import demand_empty, duplicates
from brindle.sources import store
from brindle.sources.writers import write_jsonl

SAMPLE = "sample_id string, id string, split string, dataset string, image_path string, question string, answer string, options array<string>, counterfactual_image_path string, metadata string"
RECORD = (
    "sample_id string, split string, dataset string, method string, budget string, intervention string, answer string, gold_answer string, is_correct boolean, "
    "logprob_original double, logprob_intervened double, confidence double, vem double, dense_vem double, reliance_retention double, delta_vem double, "
    "shortcut_persistence boolean, latency_ms double, token_count int, cost double, energy_joule double, measured_energy_joule double, proxy_energy_joule double, "
    "api_cost_usd double, support_metric string, metadata string"
)
POWER = "epoch string, timestamp string, power_w string, utilization_gpu_pct string, memory_used_mb string, memory_total_mb string"
RECORD_KEY = ("sample_id", "method", "budget", "intervention")

#: Fields that a label-free sample must have; those it must not have are those a controller must not see, and labels.
REQUIRED = ("sample_id", "dataset", "image_path", "question", "options")
HIDDEN = (*sorted(FORBIDDEN), "label", "labels")

#: Benchmarks that can be prepared: where they are published, their configuration and split.
REGISTRY = {
    "visual_counterfact": ("mgolov/Visual-Counterfact", "default", "color"),
    "visual_counterfact_size": ("mgolov/Visual-Counterfact", "default", "size"),
    "mmstar": ("Lin-Chen/MMStar", "val", "val"),
    "pope": ("lmms-lab/POPE", "Full", "adversarial"),
}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): text lines with their number in their file, from 1, blank ones counted.

    Splits of a file are counted apart, and the lines of those before are added.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return lines.join(splits, ["file", "_block"]).select("value", "file", (F.col("_id") - F.col("_first") + F.col("_base") + 1).alias("line"))


def _beside_file(image: str, file: str) -> Column:
    """A relative image path from the folder of the file that names it."""
    folder = F.regexp_replace(F.regexp_replace(file, "^file:/+", "/"), "/[^/]*$", "")
    return F.when(F.col(image).startswith("/") | F.contains(image, F.lit("://")), F.col(image)).otherwise(F.concat(folder, F.lit("/"), F.col(image)))


def samples(spark: SparkSession, path: str, dataset: str | None = None, limit: int | None = None) -> DataFrame:
    """Samples from JSON lines; blank lines don't count, a malformed one is an error.

    Defaults: sample_id from id, else ``row-`` and the number of the line in its file; split ``test``; the given dataset; no options. Image paths
    are from the file's folder. ``limit``: the first so many lines; the scan stops there.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    lines = lines.limit(limit) if limit is not None else lines
    parse = lambda df: df.withColumn("s", F.from_json("value", SAMPLE, {"mode": "FAILFAST"}))
    rows = parse(lines).withColumn("line", F.lit(None).cast("bigint"))
    nameless = F.coalesce("s.sample_id", "s.id").isNull()
    if not rows.where(nameless).isEmpty():  # only then lines have to be counted
        numbered = numbered_lines(spark, path).where(F.trim("value") != "")
        rows = parse(numbered.orderBy("file", "line").limit(limit) if limit is not None else numbered).select("value", "file", "s", "line")
    flat = rows.select("s.*", "file", "line")
    return flat.select(
        F.coalesce("sample_id", "id", F.concat(F.lit("row-"), F.col("line").cast("string"))).alias("sample_id"),
        F.coalesce("split", F.lit("test")).alias("split"),
        F.coalesce("dataset", F.lit(dataset or "default")).alias("dataset"),
        _beside_file("image_path", "file").alias("image_path"), "question", "answer",
        F.coalesce("options", F.array().cast("array<string>")).alias("options"),
        _beside_file("counterfactual_image_path", "file").alias("counterfactual_image_path"), "metadata",
    )


def repair_options(rows: DataFrame, dataset: str = "mmstar") -> DataFrame:
    """For one dataset: letters among options and answers become the texts that the question (or the options' order) gives them."""
    own = F.zip_with(F.slice(F.array(*[F.lit(c) for c in "ABCDE"]), F.lit(1), F.least(F.size("options"), F.lit(5))), F.slice("options", 1, 5), lambda a, b: F.struct(a.alias("letter"), b.alias("text")))
    letters = F.coalesce(lettered_options(F.col("question")), F.when(F.size("options") > 0, own))
    rows = rows.withColumn("_letters", F.when(F.lower("dataset") == dataset, letters))
    known = F.map_from_entries("_letters")
    all_letters = F.forall("options", lambda o: F.map_contains_key(known, o))
    options = F.when(F.size("options") > 0, F.when(all_letters, repaired_options(F.col("options"), F.col("_letters"))).otherwise(F.col("options"))).otherwise(F.transform("_letters", lambda x: x["text"]))
    answer = F.coalesce(F.try_element_at(known, F.upper(F.trim("answer"))), F.col("answer"))
    there = F.col("_letters").isNotNull()
    return rows.withColumns({"options": F.when(there, options).otherwise(F.col("options")), "answer": F.when(there, answer).otherwise(F.col("answer"))}).drop("_letters")


def label_free_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples that must not hold answers: a row with a hidden key, or without a required one, or malformed, stops the scan.

    The split is ``prospective`` unless stated; image paths are from the file's folder.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    wrong = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in HIDDEN]))
    short = F.size(F.array_except(F.array(*[F.lit(k) for k in REQUIRED]), keys)) > 0
    checked = F.when(wrong, F.raise_error(F.lit("a label-free sample holds a hidden field"))).when(short, F.raise_error(F.lit("a label-free sample lacks a required field"))).otherwise(F.col("value"))
    fields = "sample_id string, split string, dataset string, image_path string, question string, options array<string>, metadata string"
    parsed = lines.select(F.from_json(checked.cast("string"), fields, {"mode": "FAILFAST"}).alias("s"), "file").select("s.*", "file")
    return parsed.withColumns({"split": F.coalesce("split", F.lit("prospective")), "image_path": _beside_file("image_path", "file")}).drop("file")


def prepare_benchmark(spark: SparkSession, key: str, source: str, out: str, split: str | None = None, limit: int | None = None, validation: float = 0.2, seed: int = 13) -> str:
    """A registered benchmark's rows (Parquet that was downloaded before: ``source``/split) as samples in JSON lines; returns where they are."""
    if key not in REGISTRY:
        raise ValueError(f"unknown benchmark {key!r}; known: {sorted(REGISTRY)}")
    rows = spark.read.parquet(f"{source}/{split or REGISTRY[key][2]}")
    made = benchmark_rows(rows.limit(limit) if limit is not None else rows, key, validation, seed)
    write_jsonl(made, f"{out}/samples.jsonl")
    return f"{out}/samples.jsonl"


def benchmark_rows(rows: DataFrame, dataset: str, validation: float = 0.2, seed: int = 0) -> DataFrame:
    """Raw benchmark rows as samples. ``rows`` may have: id or question_id, question or query, answer or label, options (array), A to E, image_path, counterfactual_path.

    Options: the array (or the map's values in order of its keys), else the lettered columns, else yes and no for yes-or-no answers, else the letters of the question. Rows
    without question, answer or image are left out; splits are made by hash.
    """
    have = set(rows.columns)
    pick = lambda *names: first_text(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    question, answer = pick("question", "query", "text"), literal_first(pick("answer", "label", "correct_answer"))
    lettered = F.filter(F.array(*[F.col(c).cast("string") if c in have else F.lit(None).cast("string") for c in "ABCDE"]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    options = F.when(F.size(lettered) > 0, lettered)
    if "options" in have:
        listed = F.col("options")
        if isinstance(rows.schema["options"].dataType, MapType):  # by letter or number: in order of the keys
            listed = F.transform(F.array_sort(F.map_entries("options")), lambda e: e["value"].cast("string"))
        options = F.coalesce(F.when(F.size(listed) > 0, listed), options)
    options = F.coalesce(options, F.when(F.lower(answer).isin("yes", "no"), F.array(F.lit("yes"), F.lit("no"))), option_letters(question), none)
    key = F.coalesce(pick("id", "question_id", "index"), F.sha2(question, 256))
    out = rows.select(
        F.concat_ws("-", F.lit(dataset), key).alias("sample_id"), F.lit(dataset).alias("dataset"), pick("image_path", "image").alias("image_path"), question.alias("question"),
        answer.alias("answer"), options.alias("options"), pick("counterfactual_path", "counterfactual_image_path").alias("counterfactual_image_path"),
    )
    out = out.where("question is not null and answer is not null and image_path is not null")
    return out.withColumn("split", hash_split(validation, F.lit(seed), F.col("sample_id")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records from JSON lines; a malformed line or an empty table is an error."""
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"no records in {path}")
    return rows


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Records of a run that may be resumed; a key that comes twice is an error."""
    rows = records(spark, path)
    demand_empty(duplicates(rows, *RECORD_KEY), "keys that occur twice")
    return rows


def _number(c: str) -> Column:
    return F.trim(c).try_cast("double")


def power_samples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Power telemetry from CSV files (a glob will do): epoch, power_w, utilization, memory, file.

    Values may have spaces around them. Without an epoch the timestamp is read, as UTC. Bad rows are left out, or are errors if ``strict``.
    """
    raw = spark.read.schema(POWER).option("header", True).option("enforceSchema", False).option("ignoreLeadingWhiteSpace", True).csv(path)
    stamp = F.try_to_timestamp(F.trim("timestamp"), F.lit("yyyy/MM/dd HH:mm:ss.SSS"))
    epoch = F.coalesce(_number("epoch"), F.unix_micros(stamp) / 1e6)
    rows = raw.select(
        epoch.alias("epoch"), _number("power_w").alias("power_w"), _number("utilization_gpu_pct").alias("utilization"), _number("memory_used_mb").alias("memory_used_mb"),
        F.col("_metadata.file_path").alias("file"),
    )
    if strict:
        return rows.withColumn("power_w", F.when(F.col("epoch").isNull() | F.col("power_w").isNull(), F.raise_error(F.lit("a bad telemetry row")).cast("double")).otherwise(F.col("power_w")))
    return rows.where("epoch is not null and power_w is not null")


def ledger_files(spark: SparkSession, root: str, name: str = "*summary.json", excluded: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(runs, left out with reasons): run summaries anywhere below a folder; one JSON object a file."""
    schema = "measured_energy_joule double, duration_s double, mean_power_w double, max_power_w double, max_memory_used_mb double"
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("measured_energy_joule").alias("energy_joule"), "duration_s", "mean_power_w", "max_power_w", F.col("max_memory_used_mb").alias("memory_mb"))
    reason = F.when(F.col("energy_joule").isNull() | F.col("duration_s").isNull(), "missing energy or duration")
    for part in excluded:
        reason = F.when(F.contains("path", F.lit(part)), f"excluded: {part}").otherwise(reason)
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("path", "reason")


def beside(runs: DataFrame, trackers: DataFrame) -> DataFrame:
    """Runs with the tracker row of their folder, or else of the folder above; ``trackers`` has one row per file."""
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    t = trackers.withColumn("_dir", folder(F.col("path"))).groupBy("_dir").agg(F.min(F.struct(*[c for c in trackers.columns if c != "path"])).alias("tracker"))
    here = runs.withColumns({"_d1": folder(F.col("path"))}).withColumn("_d2", folder(F.col("_d1")))
    one = here.join(t.select(F.col("_dir").alias("_d1"), F.col("tracker").alias("_t1")), "_d1", "left")
    two = one.join(t.select(F.col("_dir").alias("_d2"), F.col("tracker").alias("_t2")), "_d2", "left")
    return two.withColumn("tracker", F.coalesce("_t1", "_t2")).drop("_d1", "_d2", "_t1", "_t2")


def log_values(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row per log file with what each pattern's first group finds, as numbers; null where it finds nothing."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), *(F.regexp_extract("value", p, 1).try_cast("double").alias(n) for n, p in patterns.items()))


def images(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """Image files below a folder, in order of path, with the hash of their content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def source_groups(rows: DataFrame, content: str = "sha256") -> DataFrame:
    """Rows with source_group: dataset and content hash."""
    return rows.withColumn("source_group", F.concat_ws("::", "dataset", content))


def load_config(path: str, spark: SparkSession | None = None) -> dict[str, Any]:
    """A run's configuration, with where it came from and the folder that its paths start at; from a store by its URI if ``spark`` is given."""
    if spark is not None and "://" in path:
        folder = path.rsplit("/", 2)[0]
        return json.loads(store.read_bytes(spark, path)) | {"_config_path": path, "_root_dir": folder}
    file = Path(path).resolve()
    return json.loads(file.read_text(encoding="utf-8")) | {"_config_path": str(file), "_root_dir": str(file.parent.parent)}


def resolve_path(config: dict[str, Any], path: str) -> str:
    """A path of a configuration: URIs and absolute ones as they are, others below its root, which may be a URI."""
    return path if store.is_absolute(path) else store.join(config["_root_dir"], path)
