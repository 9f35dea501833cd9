"""The corpus pipeline: language, quality, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before it kept; all but the last
return the columns that they were given, whatever their names. Stages don't depend on each other's columns. An empty table
gives an empty table; a repeated row is judged as often as it comes; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm import decontaminate, jaccard_join, language, packing, quality
from brindle.llm.shared import bounded_batches, free_name, table, written
from brindle.sources.folders import mark, remove_folders

#: A document stays if so much of its letters is in the language that it is labelled with.
LANGUAGE_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those that are null, empty or without letters, or of which no language has half, go.

    Where no row has a language to learn from, no document has one.
    """
    found, name = language.labeller(spark, language.learn(docs)), free_name(docs, "found")
    marked = bounded_batches(docs).withColumn(name, found)
    kept = (F.col(f"{name}.lang_pred") != language.UNDETERMINED) & (F.col(f"{name}.score") >= LANGUAGE_SHARE)
    return marked.where(kept).drop(name)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null, empty and blank texts go where label 0 is known."""
    model, name = quality.learn(docs, table(spark, sf_dir, "labels")), free_name(docs, "score")
    marked = bounded_batches(docs).withColumn(name, quality.scorer(spark, model))
    return marked.where(F.col(name) >= quality.ACCEPT).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of linked texts, of texts without words one of each; those with an id come first.

    Of rows of one id those stay whose texts are in no group with a smaller id; of equal rows one stays.
    """
    rows = jaccard_join.grouped(bounded_batches(docs))
    one = rows.where("root is not null").groupBy("root").agg(jaccard_join.least().alias("of")).select("of.none", "of.key", "of.at")
    stay = one.unionByName(rows.where("root is null").select(F.col("key").isNull().alias("none"), "key", "at").distinct())
    # a row's place: whether it has no id, the id, and its text
    place = {"none": F.col("doc_id").isNull(), "key": F.coalesce("doc_id", F.lit(0)), "at": jaccard_join.place("text")}
    named = {c: free_name(docs, c) for c in (*place, "first")}
    stay = stay.withColumn("key", F.coalesce("key", F.lit(0))).select(*(F.col(c).alias(named[c]) for c in place))
    by = [named[c] for c in place]
    first = F.row_number().over(Window.partitionBy(*by).orderBy("text"))
    kept = docs.withColumns({named[c]: v for c, v in place.items()}).join(stay, by, "left_semi").withColumn(named["first"], first)
    return kept.where(F.col(named["first"]) == 1).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in training sequences; a null or empty text is one piece, the end id."""
    return packing.packed(bounded_batches(docs))


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: SQL has neither the models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, what a stage needed goes then."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_folders(spark, (docs,), since)
    return STAGES[-1][1](spark, docs, sf_dir)
