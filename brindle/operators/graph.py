"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.folders import written

#: Edges of a file of a round's table, and parts to which the edges of one node are dealt.
FILE_EDGES, SALTS = 1_000_000, 64


def salted_totals(df: DataFrame, keys: list[str], salt: str, partial: list[Column], final: list[Column]) -> DataFrame:
    """Aggregates by ``keys``, a row for each (keys, salt) of ``df``: joined by both, the rows of a hot key don't meet in one task.

    ``partial``: aggregates by keys and salt; ``final``: of those, by keys. Salts must be few.
    """
    whole = df.groupBy(*keys, salt).agg(*partial).groupBy(*keys).agg(*final, F.collect_set(salt).alias("_salts"))
    return whole.withColumn(salt, F.explode("_salts")).drop("_salts")


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m, the smallest v of each u; a hub's edges are dealt to parts by v."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    return dealt.join(salted_totals(dealt, ["u"], "salt", [F.min("v").alias("m")], [F.min("m").alias("m")]), ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of undirected ``edges`` (a, b): root is the smallest node it reaches.

    Large star: every larger neighbour of a node is tied to the node's smallest neighbour. Small star: a node
    and its smaller neighbours are tied to the smallest. Rounds grow with the logarithm of the longest path; only
    edges move, each round is written, and a hub's edges are dealt to parts, so they never meet in one task. Loops and repeated
    edges don't matter; no edges: no rows.
    """
    rows = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v"), "edges")
    files = rows.count() // FILE_EDGES + 1
    now = written(rows.distinct(), "stars", files)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            tied = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return tied.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = written(large.where("u > v").distinct(), "stars", files)
        small = _with_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = written(small.where("u > v").distinct(), "stars", files)
