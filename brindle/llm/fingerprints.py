"""Document fingerprints: Merkle trees over paragraphs and sections, in SQL functions only.

A text is cut at blank lines into sections and at line feeds into paragraphs; nothing is dropped, so the
tree stands for the whole text. The leaves are short hashes of phrases (a few words each). A paragraph's hash is the SHA-256 of its
leaves and its text, a section's that of its paragraphs' hashes, the root that of its sections': equal roots are equal
texts, and where trees differ, differing sections and then paragraphs locate the edit. The likeness of two documents is
the share of leaves in common.

    root ; section ; section ...      section: hash = paragraph , paragraph ...
                                      paragraph: hash ~ phrase . phrase ...

Section and paragraph hashes are listed by their first 16 digits, the root whole, phrases by 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.shared import table, written

#: Words of a phrase, counted from the start of its paragraph's sentence or clause.
PHRASE_WORDS = 4
#: A phrase ends after so many words or after a mark that ends a clause.
PHRASE = r"(?:[^\s.,;:!?|]+[\s|]*){1,%d}[.,;:!?]*\s*|[.,;:!?|]+\s*" % PHRASE_WORDS
NODE, LEAF = 16, 8


def _sha(c: Column) -> Column:
    return F.sha2(c, 256)


def _phrases(paragraph: Column) -> Column:
    # the word of a hash is 32 bits: a chance match of two phrases is far rarer than a real one
    return F.transform(F.regexp_extract_all(paragraph, F.lit(PHRASE), F.lit(0)), lambda p: F.substring(F.md5(p), 1, LEAF))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as empty."""

    def paragraph(p: Column) -> Column:
        leaves = F.transform(F.array(F.array_join(_phrases(p), ".")), lambda x: F.struct(_sha(F.concat(x, F.lit("~"), p)).alias("h"), x.alias("phrases")))
        return leaves[0]

    def section(s: Column) -> Column:
        tree = F.transform(F.split(s, "\n"), paragraph)
        return F.transform(
            F.array(tree),
            lambda t: F.struct(
                _sha(F.array_join(F.transform(t, lambda p: p["h"]), "")).alias("h"),
                F.array_join(F.transform(t, lambda p: F.concat(F.substring(p["h"], 1, NODE), F.lit("~"), p["phrases"])), ",").alias("paragraphs"),
            ),
        )[0]

    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), section)
    whole = F.transform(
        F.array(sections),
        lambda ss: F.concat(
            _sha(F.array_join(F.transform(ss, lambda s: s["h"]), "")),
            F.lit(";"),
            F.array_join(F.transform(ss, lambda s: F.concat(F.substring(s["h"], 1, NODE), F.lit("="), s["paragraphs"])), ";"),
        ),
    )
    return whole[0]


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def phrase_set(fp: Column) -> Column:
    """The distinct phrase hashes of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"(?<=[~.])[0-9a-f]{%d}" % LEAF), F.lit(0)))


def packed_phrases(fp: Column) -> Column:
    """The phrase set as binary, 4 bytes a phrase: half of what its text takes on the way to another task."""
    return F.unhex(F.array_join(phrase_set(fp), ""))


def unpacked_phrases(packed: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(packed)), F.lit(".{%d}" % LEAF), F.lit(0))


def set_likeness(root_a: Column, a: Column, root_b: Column, b: Column) -> Column:
    """Likeness of two fingerprints of which the roots and the phrase sets are at hand."""
    total = F.size(a) + F.size(b)
    share = F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(total, F.lit(1))).otherwise(F.lit(0.0))
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(share)


def likeness(a: Column, b: Column) -> Column:
    """Twice the phrases in common over all of both; 1 for equal roots, 0 if only one has phrases or neither has."""
    return set_likeness(root(a), phrase_set(a), root(b), phrase_set(b))


def edits(a: Column, b: Column) -> Column:
    """Where two documents differ: array of struct(section, paragraph), from 0, as placed in the first.

    Only sections whose hash the second doesn't have are looked into, and there only paragraphs whose hash it doesn't have.
    """
    node = r"(?:^|[;,=])([0-9a-f]{%d})%s"
    there_s = F.regexp_extract_all(b, F.lit(node % (NODE, "=")), F.lit(1))
    there_p = F.regexp_extract_all(b, F.lit(node % (NODE, "~")), F.lit(1))
    sections = F.slice(F.split(a, ";"), 2, F.lit(1 << 30))

    def inside(s: Column, i: Column) -> Column:
        paragraphs = F.split(F.substring_index(s, "=", -1), ",")
        marked = F.transform(paragraphs, lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), F.array_contains(there_p, F.substring(p, 1, NODE)).alias("same")))
        return F.when(F.array_contains(there_s, F.substring(s, 1, NODE)), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.transform(F.filter(marked, lambda m: ~m["same"]), lambda m: F.struct(m["section"], m["paragraph"]))
        )

    found = F.flatten(F.transform(sections, inside))
    return F.when(root(a) == root(b), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(found)


def changed(a: Column, b: Column) -> Column:
    """The distinct paragraphs of the first document that the second doesn't have, by hash; only differing sections are looked into. Linear in both."""
    of = lambda s: F.transform(F.split(F.substring_index(s, "=", -1), ","), lambda p: F.substring(p, 1, NODE))
    sections = lambda fp: F.slice(F.split(fp, ";"), 2, F.lit(1 << 30))
    differing = F.transform(F.array_except(sections(a), sections(b)), of)
    return F.array_except(F.flatten(differing), F.flatten(F.transform(sections(b), of)))


def next_in_order(ids: DataFrame) -> DataFrame:
    """(id, next): the next smaller id of distinct ``ids`` (id), after the smallest the largest.

    Ids are dealt out by ranges, so a window holds one range; the ends of ranges (one row each) are then tied together.
    """
    ranged = ids.repartitionByRange(F.desc("id")).withColumn("part", F.spark_partition_id())
    ranged = written(ranged, "ordered-ids")
    inside = ranged.withColumn("next", F.lead("id").over(Window.partitionBy("part").orderBy(F.desc("id"))))
    ends = ranged.groupBy("part").agg(F.max("id").alias("first"), F.min("id").alias("last"))
    after = F.lead("first").over(Window.orderBy("part"))
    top = F.lit(ranged.agg(F.max("id")).first()[0]).cast(ids.schema["id"].dataType)  # the one that follows the smallest
    ties = ends.select(F.col("last").alias("id"), F.coalesce(after, top).alias("tied"))
    return inside.where("next is not null").select("id", "next").unionByName(ties.select("id", F.col("tied").alias("next")))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, text, and of the next document next.start (its text, as much as half of this one's length), next.root, next.phrases.

    Two shuffles: whole texts by their key, once for both uses, and what the documents before them need of them.
    """
    whole = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = whole.where("key is not null")
    sizes = written(keyed.groupBy("key").agg(F.max(F.length("text")).alias("most")), "fingerprint-sizes")
    order = next_in_order(sizes.select(F.col("key").alias("id")))
    asked = order.join(sizes.withColumnRenamed("key", "id"), "id")
    asked = asked.select(F.col("id").alias("before"), F.col("next").alias("key"), F.floor(F.col("most") / 2).cast("int").alias("n"))
    given = keyed.join(asked.hint("merge"), "key").select("before", F.substring(F.col("text"), F.lit(1), F.col("n")).alias("start"), fingerprint(F.col("text")).alias("fp"))
    given = given.select(F.col("before").alias("key"), F.struct("start", root(F.col("fp")).alias("root"), packed_phrases(F.col("fp")).alias("phrases")).alias("next"))
    given = given.groupBy("key").agg(F.min("next").alias("next"))
    alone = whole.where("key is null").withColumn("next", F.lit(None).cast(given.schema["next"].dataType))
    return keyed.join(given.hint("merge"), "key").select("key", "text", "next").unionByName(alone)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_changed (paragraphs that the edit took).

    The edited text is the text with its last half (rounded down) replaced by the start of the next document's, by descending key.
    Null texts are empty. Rows of one key: each is edited with the same next document; where that key has several
    texts, with the one whose start is smallest. A null key has no next document: its half is cut off and
    near_next compares with an empty text. Very long texts: hashed whole. Ties don't arise. An empty table: no rows. Other columns are ignored.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (
        with_next(docs, key, text)
        .withColumn("n_chars", F.length("text").cast("bigint"))
        .withColumn(
            "edited",
            F.concat(
                F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
                F.coalesce(F.substring(F.col("next.start"), F.lit(1), half), F.lit("")),
            ),
        )
        .select("key", "n_chars", _sha(F.col("edited")).alias("edited_sha256"), fingerprint(F.col("text")).alias("a"), fingerprint(F.col("edited")).alias("b"), "next")
    )
    a, b = F.col("a"), F.col("b")
    rows = rows.withColumn("own", phrase_set(a))
    empty = root(fingerprint(F.lit("")))
    near_next = set_likeness(root(a), F.col("own"), F.coalesce("next.root", empty), F.coalesce(unpacked_phrases(F.col("next.phrases")), F.array().cast("array<string>")))
    return rows.select(
        F.col("key").alias(key), "n_chars", "edited_sha256", a.alias("fingerprint"), b.alias("edited_fingerprint"),
        set_likeness(root(a), F.col("own"), root(b), phrase_set(b)).alias("near_edited"), near_next.alias("near_next"),
        F.when(root(a) == root(b), F.lit(0)).otherwise(F.size(changed(a, b))).cast("bigint").alias("n_changed"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text of ``documents`` and of its edited text."""
    return fingerprints(table(spark, sf_dir, "documents"))
