"""Exact n-gram Jaccard join by a token-group matrix.

A document is its set of distinct word shingles. Documents of equal sets are one class from the start. A link
needs three quarters of both sets in common, so a class can only be linked if so many of its tokens (shingle
hashes) occur in another class at all; counting that once over all tokens removes most of a corpus. What is
left is partitioned into groups of similar documents (min-hash buckets; a member is tied to a bucket's smallest
or largest class where the exact Jaccard says so). How many of a class's tokens occur in any other group, all
taken together, says whether a single group can hold a partner. For the classes left, the token-group matrix stores the
union of tokens of each of their groups; a class meets a group by one of its rarest tokens, its overlap with the group's
union bounds that with each member, and only groups that reach three quarters are opened: their members are met by rare
tokens, with length and positional filters, and compared exactly. Components come from links, never from pairs within a
group of copies.

Min-hashes only choose the groups. Wherever they err, the bounds still find each link between two groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.shared import bounded_batches, release, salted_totals, table, working_on
from brindle.llm.words import chunks, mix, shingle_sets
from brindle.operators.graph import components
from brindle.sources.folders import written

WORDS, THRESHOLD = 5, Fraction(3, 4)
BANDS, ROWS = 12, 3
#: Part of the token space in which the first count is made; more gives a tighter bound and a larger shuffle.
SAMPLED = Fraction(1, 2)
#: Tokens that a mapper gathers before it sends them, and that a reducer holds at once.
FLUSH_TOKENS, BUCKET_TOKENS = 2_000_000, 2_000_000
#: Members that are compared with one centre in one task, and parts to which the classes of one bucket or centre are dealt first.
SALT_ROWS, SALTS = 64, 64

_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def at_least(n: np.ndarray | int, t: Fraction = THRESHOLD):
    """ceil(t * n): tokens that a partner must share with a set of n."""
    return -(-n * t.numerator // t.denominator)


def linked(x: np.ndarray, y: np.ndarray, t: Fraction = THRESHOLD) -> bool:
    """Whether two sorted sets reach the Jaccard threshold; empty sets never do."""
    a, b = len(x), len(y)
    if not a or not b or t.denominator * min(a, b) < t.numerator * max(a, b):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return t.denominator * both >= t.numerator * (a + b - both)


def signature(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    with np.errstate(over="ignore"):
        one, two = mix(tokens).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _sets(batch: pa.RecordBatch, column: str, k: int) -> Iterator[tuple[int, np.ndarray]]:
    working_on("jaccard_join")
    texts = [(t or "").encode() for t in batch.column(column).to_pylist()]
    for s in chunks(texts):
        yield from enumerate(shingle_sets(texts[s], k), s.start)


def features(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """Per row: key, at (:func:`place` of its text), n (set size), sampled (tokens in the sampled part), s1 and s2 (signature), bands."""
    kind = df.schema[key].dataType.simpleString()
    limit = np.uint64(int((1 << 64) * SAMPLED) - 1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _SEEDS.reshape(-1, 1)
        for batch in batches:
            n, sampled, sigs, bands = [], [], [], []
            for _, tokens in _sets(batch, "text", k):
                n.append(len(tokens))
                sampled.append(int(np.searchsorted(tokens, limit, "right")))
                sigs.append(signature(tokens))
                if len(tokens):
                    least = (tokens * weights).min(axis=1) if len(tokens) < 50_000 else np.array([(tokens * w).min() for w in _SEEDS])
                    rows = mix(least).reshape(BANDS, ROWS)
                    bands.append(mix(rows.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64))
                else:
                    bands.append(np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(sampled, pa.int64()),
                    pa.array([s[0] for s in sigs], pa.int64()),
                    pa.array([s[1] for s in sigs], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                ["key", "at", "n", "sampled", "s1", "s2", "bands"],
            )

    schema = f"key {kind}, at bigint, n bigint, sampled bigint, s1 bigint, s2 bigint, bands array<bigint>"
    return df.select(F.col(key).alias("key"), place(text).alias("at"), F.col(text).alias("text")).mapInArrow(of, schema)


def place(text: str) -> Column:
    """64 bits of a text, by which it is found again among those of its key."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def least(key: str = "key") -> Column:
    """The smallest key of a group and a text of it; rows without a key come last."""
    return F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("at")))


def shared_tokens(rows: DataFrame, tokens: int, part: Fraction = Fraction(1), k: int = WORDS) -> DataFrame:
    """(owner, shared): tokens of each owner that some other group has too, in a part of the token space.

    ``rows`` has text and, where an owner isn't its own group, owner and grp; else an owner is named by
    the first half of its signature. ``tokens``: about how many there are; it sets bits and buckets. Tokens are cut
    to bits enough that few collide (a collision only raises a count). A mapper sends, in flushes and sorted, a
    posting for each token and owner, but one that it has seen in two groups it counts itself and sends once: so a
    token that many documents have costs a posting per flush. A reducer holds one bucket of the token space and
    answers each flush with counts, which are added up by flush. Owners that come in several flushes may be
    counted more than once: the result is an upper bound.
    """
    bits = min(64, max(40, ceil(log2(max(2, tokens))) + 13))
    buckets = max(1, ceil(tokens * part / BUCKET_TOKENS))
    top = int((1 << 64) * part)
    width = min(-(-top // buckets), (1 << 64) - 1)
    named = "owner" in rows.columns
    # bucket >= 0: postings (tokens, places of owners in the flush, groups of places); -1: the flush's owners and own counts
    sent = "flush bigint, bucket int, tokens binary, places binary, groups binary"
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = [x.split()[0] for x in sent.split(", ")]
    marked = np.uint32(0xFFFFFFFF)

    def batches_of(found: list[tuple], types: list, columns: list[str]) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(found), 500):
            cols = zip(*found[s : s + 500], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], columns)

    def flush(number: int, toks: list[np.ndarray], owners: list[int], groups: list[int]) -> Iterator[pa.RecordBatch]:
        if not toks:
            return
        own = np.repeat(np.arange(len(toks), dtype=np.uint32), [len(t) for t in toks])
        tok = np.concatenate(toks) >> np.uint64(64 - bits)
        order = np.argsort(tok, kind="stable")
        tok, own = tok[order], own[order]
        owner, grp = np.array(owners, np.int64), np.array(groups, np.int64)
        local, found = np.zeros(len(owner), np.int64), []
        if len(tok):
            first = np.concatenate(([True], tok[1:] != tok[:-1]))
            run = np.flatnonzero(first)
            g = grp[own]
            several = np.repeat(np.minimum.reduceat(g, run) != np.maximum.reduceat(g, run), np.diff(np.append(run, len(tok))))
            local = np.bincount(own[several], minlength=len(owner))
            keep = ~several | first
            own = np.where(several, marked, own)[keep]
            tok = tok[keep]
            of = np.minimum((tok << np.uint64(64 - bits)) // np.uint64(width), np.uint64(buckets - 1)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1], [True])))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                g = np.where(own[a:b] == marked, 0, grp[np.minimum(own[a:b], len(grp) - 1)])
                found.append((number, int(of[a]), tok[a:b].astype("<u8").tobytes(), own[a:b].astype("<u4").tobytes(), _packed(g)))
        found.append((number, -1, owner.tobytes(), local.astype("<i8").tobytes(), None))
        yield from batches_of(found, kinds, names)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        toks: list[np.ndarray] = []
        owners: list[int] = []
        groups: list[int] = []
        seen: set[int] = set()
        size = 0
        limit = np.uint64(top - 1)
        for batch in batches:
            ids = batch.column("owner").to_pylist() if named else None
            grp = batch.column("grp").to_pylist() if named else None
            for i, found in _sets(batch, "text", k):
                if not len(found):
                    continue
                o = ids[i] if ids else signature(found)[0]
                if o in seen:
                    continue
                seen.add(o)
                t = found[: np.searchsorted(found, limit, "right")]
                toks.append(t)
                owners.append(o)
                groups.append(grp[i] if grp else o)
                size += len(t)
                if size >= FLUSH_TOKENS:
                    yield from flush(number, toks, owners, groups)
                    number += 1
                    toks, owners, groups, seen, size = [], [], [], set(), 0
        yield from flush(number, toks, owners, groups)
        release()

    answer = "flush bigint, kind int, places binary, counts binary"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(blobs: list[dict]) -> Iterator[pa.RecordBatch]:
            if not blobs:
                return
            tok = np.concatenate([np.frombuffer(b["tokens"], "<u8") for b in blobs])
            own = np.concatenate([np.frombuffer(b["places"], "<u4") for b in blobs])
            grp = np.concatenate([_unpacked(b["groups"]) for b in blobs])
            of = np.repeat(np.arange(len(blobs)), [len(b["tokens"]) // 8 for b in blobs])
            order = np.argsort(tok, kind="stable")
            tok, own, grp, of = tok[order], own[order], grp[order], of[order]
            run = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
            known = own == marked
            low = np.where(known, np.iinfo(np.int64).max, grp)
            high = np.where(known, np.iinfo(np.int64).min, grp)
            several = np.logical_or.reduceat(known, run) | (np.minimum.reduceat(low, run) != np.maximum.reduceat(high, run))
            pick = np.repeat(several, np.diff(np.append(run, len(tok)))) & ~known
            found = []
            of, own = of[pick], own[pick]
            order = np.argsort(of, kind="stable")
            of, own = of[order], own[order]
            cuts = np.searchsorted(of, np.arange(len(blobs) + 1))
            for i, b in enumerate(blobs):
                place, n = np.unique(own[cuts[i] : cuts[i + 1]], return_counts=True)
                if len(place):
                    found.append((b["flush"], 1, place.astype("<u4").tobytes(), n.astype("<i8").tobytes()))
            yield from batches_of(found, [pa.int64(), pa.int32(), pa.binary(), pa.binary()], ["flush", "kind", "places", "counts"])

        blobs: list[dict] = []
        for batch in batches:
            for b in batch.to_pylist():
                if b["bucket"] < 0:
                    yield from batches_of([(b["flush"], 0, b["tokens"], b["places"])], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], ["flush", "kind", "places", "counts"])
                    continue
                if blobs and blobs[-1]["bucket"] != b["bucket"]:
                    yield from result(blobs)
                    blobs = []
                blobs.append(b)
        yield from result(blobs)
        release()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(owner, total) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(total, pa.int64())], ["owner", "shared"])

        now = owner = total = None
        for batch in batches:
            for b in batch.to_pylist():
                if b["kind"] == 0:  # a flush begins with its owners
                    if owner is not None:
                        yield result(owner, total)
                    now, owner, total = b["flush"], np.frombuffer(b["places"], np.int64), np.frombuffer(b["counts"], "<i8").copy()
                elif b["flush"] != now:
                    raise ValueError("counts of a flush without its owners")
                else:
                    total[np.frombuffer(b["places"], "<u4")] += np.frombuffer(b["counts"], "<i8")
        if owner is not None:
            yield result(owner, total)

    # a flush's owners go to any bucket, so that they don't all meet in one task
    spread = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("flush"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    # a partition for each bucket: hashed, several would land on one
    dealt = rows.mapInArrow(scatter, sent).withColumn("to", spread).repartitionById(buckets, F.col("to")).sortWithinPartitions("bucket").drop("to")
    answers = dealt.mapInArrow(gather, answer).repartition("flush").sortWithinPartitions("flush", "kind")
    counts = answers.mapInArrow(add_up, "owner bigint, shared bigint")
    return counts.groupBy("owner").agg(F.sum("shared").alias("shared"))


def _packed(groups: np.ndarray) -> bytes:
    """Groups of postings: the distinct ones, then each posting's place among them."""
    distinct, at = np.unique(groups, return_inverse=True)
    return np.array([len(distinct)], "<i8").tobytes() + distinct.astype("<i8").tobytes() + at.astype("<u2" if len(distinct) <= 1 << 16 else "<u4").tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    return np.frombuffer(raw, "<i8", n, 8)[np.frombuffer(raw, "<u2" if n <= 1 << 16 else "<u4", offset=8 + 8 * n)]


def verify(pairs: DataFrame, texts: DataFrame, k: int = WORDS, t: Fraction = THRESHOLD) -> DataFrame:
    """The linked ones of ``pairs`` (a, b); ``texts`` has (rep, text), each rep once.

    Each centre a meets its partners b in tasks of a few hundred; a task holds the centre's set and streams them. A centre's pairs
    are dealt to parts before they are counted, so that those of a hot one never meet.
    """
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    salted = pairs.groupBy("a", "part").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    numbered = lambda salt: (salt * SALTS + F.col("part")).alias("salt")
    partner = pairs.join(salted, ["a", "part"]).select(
        F.col("b").alias("rep"), F.col("a").alias("centre"), numbered(F.pmod(F.xxhash64("b", F.lit(1)), F.col("salts"))), F.lit(1).alias("role")
    )
    each = salted.withColumn("s", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    centre = each.select(F.col("a").alias("rep"), F.col("a").alias("centre"), numbered(F.col("s").cast("bigint")), F.lit(0).alias("role"))
    rows = texts.join(centre.unionByName(partner), "rep")
    met = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            cols = {c: batch.column(c).to_pylist() for c in ("rep", "centre", "salt", "role")}
            for i, tokens in _sets(batch, "text", k):
                if cols["role"][i] == 0:
                    now, held = (cols["centre"][i], cols["salt"][i]), tokens
                elif now == (cols["centre"][i], cols["salt"][i]) and linked(held, tokens, t):
                    found.append((now[0], cols["rep"][i]))
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in (0, 1)], ["a", "b"])

    return met.mapInArrow(compare, "a bigint, b bigint")


def centres(classes: DataFrame) -> DataFrame:
    """(a, b): for each class b of ``classes`` (rep, none, key, at, bands) the two centres a that share most min-hash buckets with it.

    A bucket's centres are the classes of its smallest and of its largest key: originals tend to come before their copies, so that
    many copies are near one centre.
    """
    in_bands = classes.select("rep", F.struct("none", "key", "at", "rep").alias("by"), F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("part"), F.explode("bands").alias("band"))
    ends = salted_totals(in_bands, ["band"], "part", [F.min("by").alias("lo"), F.max("by").alias("hi")], [F.min("lo").alias("lo"), F.max("hi").alias("hi")]).where("lo < hi")
    near = in_bands.join(ends, ["band", "part"])
    near = near.select("rep", F.explode(F.array("lo", "hi")).alias("centre")).where("rep != centre.rep")
    near = near.groupBy("rep", "centre").agg(F.count("*").alias("bands"))
    best = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("bands"), "centre"))
    return near.withColumn("best", best).where("best <= 2").select(F.col("centre.rep").alias("a"), F.col("rep").alias("b"))


def across_groups(open_: DataFrame, k: int = WORDS, t: Fraction = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of classes in different groups that may be linked; ``open_``: (rep, grp, n, text).

    The token-group matrix has a row for each token of a group's union, of tokens that several groups have. Tokens are ordered by
    the number of groups that have them. A class and a group whose union holds at least the threshold of it share one of the class's
    first n - ceil(t n) + 1 tokens, which is also among a linked member's first. At the first token that two share, neither has more left
    than its size less the token's place: groups and later members that can't reach the overlap that the threshold asks of
    their sizes are left out there. What is left is counted against the matrix, and groups that hold enough are opened for the class.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tokens in _sets(batch, "text", k):
                rows = batch.slice(i, 1).select(["rep", "grp", "n"]).take(pa.array(np.zeros(len(tokens), np.int64)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(tokens.astype(np.int64))], ["rep", "grp", "n", "token"])

    rows = written(open_.mapInArrow(explode, "rep bigint, grp bigint, n bigint, token bigint"), "open-tokens")
    # the matrix: each group's union, with the number of groups of a token; a token's groups are dealt to parts
    union = rows.select("token", "grp").distinct().withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(SALTS)))
    wide = salted_totals(union, ["token"], "part", [F.count("*").alias("groups")], [F.sum("groups").alias("groups")]).where("groups > 1")
    matrix = written(union.join(wide, ["token", "part"]).select("token", "grp", "groups"), "open-matrix")
    shared = rows.join(matrix, ["token", "grp"])
    order = Window.partitionBy("rep").orderBy("groups", "token")
    all_ = Window.partitionBy("rep")
    most = F.col("n") - F.ceil(F.col("n") * t.numerator / t.denominator) + 1
    ranked = shared.withColumn("rank", F.row_number().over(order)).withColumn("alone", F.col("n") - F.count("*").over(all_))
    left = (F.col("n") - F.col("alone") - F.col("rank") + 1).alias("left")
    ranked = written(ranked.select("token", "rep", "grp", "n", left, (F.col("rank") <= most - F.col("alone")).alias("first")), "open-ranked")
    prefix = ranked.where("first")
    x = prefix.select("token", "grp", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"))
    # of a group's members with the token among their first: the range of sizes, and the most that one has left there
    y = prefix.groupBy("token", F.col("grp").alias("of")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("left").alias("lb"))
    smallest = F.greatest(F.col("least") * t.denominator, F.col("na") * t.numerator)  # times the denominator, of members that na can be linked with
    met = x.join(y, "token").where("of != grp")
    met = met.where((F.col("least") * t.numerator <= F.col("na") * t.denominator) & (F.col("most") * t.denominator >= F.col("na") * t.numerator))
    met = met.where(F.least("la", "lb") * (t.numerator + t.denominator) * t.denominator >= (F.col("na") * t.denominator + smallest) * t.numerator)
    met = met.select(F.col("a").alias("rep"), "of").distinct()
    groups = matrix.select("token", F.col("grp").alias("of"))
    # the bound: what of a class a group's union holds
    held = ranked.join(met, "rep").join(groups, ["token", "of"]).groupBy("rep", "of", "n").agg(F.count("*").alias("held"))
    opened = written(held.where(F.col("held") >= F.ceil(F.col("n") * t.numerator / t.denominator)).select("rep", "of"), "open-groups")
    x = prefix.join(opened, "rep").select("token", F.col("of").alias("gb"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("left").alias("la"))
    y = prefix.select("token", F.col("grp").alias("gb"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    pairs = x.join(y, ["token", "gb"]).where("a < b")
    pairs = pairs.where(F.least("na", "nb") * t.denominator >= F.greatest("na", "nb") * t.numerator)
    pairs = pairs.where(F.least("la", "lb") * (t.numerator + t.denominator) >= (F.col("na") + F.col("nb")) * t.numerator)
    return pairs.select("a", "b").distinct()


def links(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, edges): per row its features; per (s1, s2) its rep, 64 bits of the set; links between reps."""
    docs = bounded_batches(df).select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = written(features(docs, "key", "text", k), "jaccard-rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    whole = rows.where("n > 0").groupBy("s1", "s2", "n", "sampled").agg(least().alias("of"), F.first("bands").alias("bands"))
    classes = whole.withColumn("rep", F.col("s1"))
    # 1. classes of which enough tokens occur elsewhere
    shared = shared_tokens(docs.select("text"), total, SAMPLED, k).withColumnRenamed("owner", "s1")
    slack = F.col("n") - at_least_sql("n")
    alive = classes.join(shared, "s1").where(F.col("shared") >= F.col("sampled") - slack).select("rep", "n", "bands", "of.none", "of.key", "of.at")
    alive = written(alive, "jaccard-alive")
    # one text of each class, by its smallest key and its place there
    found = docs.withColumn("at", place("text")).alias("d").join(alive.alias("c"), F.col("d.key").eqNullSafe(F.col("c.key")) & (F.col("d.at") == F.col("c.at")))
    texts = written(found.groupBy("rep").agg(F.first("text").alias("text")), "jaccard-texts")
    # 2. groups
    first = written(verify(centres(alive), texts, k), "jaccard-edges")
    groups = written(components(first), "jaccard-groups").withColumnRenamed("node", "rep").withColumnRenamed("root", "grp")
    placed = alive.select("rep", "n").join(groups, "rep", "left").select("rep", "n", F.coalesce("grp", "rep").alias("grp"))
    placed = written(texts.join(placed, "rep"), "jaccard-placed")
    # 3. the bound over all other groups, then the groups it leaves to open
    left = placed.agg(F.sum("n")).first()[0] or 0
    over = shared_tokens(placed.select(F.col("rep").alias("owner"), "grp", "text"), left, Fraction(1), k)
    open_ = placed.join(over.withColumnRenamed("owner", "rep"), "rep").where(F.col("shared") >= at_least_sql("n")).drop("shared")
    open_ = written(open_, "jaccard-open")
    second = verify(across_groups(open_, k), texts, k)
    return rows, classes, first.unionByName(second)


def at_least_sql(n: str):
    return F.ceil(F.col(n) * THRESHOLD.numerator / THRESHOLD.denominator)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """Per row of ``df``: key, n_shingles, component_id (the smallest key that links reach, its own included).

    Null and empty texts, and texts without words: 0, linked with nothing. Very long texts: their whole sets; a set is held once at
    a time. Ties: a pair at the threshold is linked; which class stands for a bucket decides no link. Rows of one key are one document: the
    links of all its texts are its own. A null key: its row is linked by its text, its component null if no
    row that it reaches has a key. An empty table: no rows. Columns other than key and text are ignored.
    """
    rows = grouped(df, key, text, k)
    # a key whose texts lie in several groups ties them
    ends = rows.where("root is not null and key is not null").groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    ties = rows.join(ends.select("key", "a"), "key").where("root != a").select("a", F.col("root").alias("b"))
    tied = components(ties).select(F.col("node").alias("root"), F.col("root").alias("whole"))
    names = rows.join(tied, "root").groupBy("whole").agg(F.min("name").alias("tied_name"))
    kept = rows.join(tied.join(names, "whole").select("root", "tied_name"), "root", "left")
    own = F.when(F.col("n") > 0, F.coalesce("tied_name", "name")).otherwise(F.col("key"))
    return kept.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), own.alias("component_id"))


def grouped(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WORDS) -> DataFrame:
    """Per row of ``df``: key, at (:func:`place` of its text), n (set size), and of the linked sets: root (one number), name (the smallest key).

    Rows without words are in no group: root and name are null.
    """
    rows, classes, edges = links(df, key, text, k)
    linked_ = components(edges).withColumnRenamed("node", "rep")
    of = written(classes.select("s1", "s2", "rep", "of.key").join(linked_, "rep", "left"), "jaccard-classes")
    names = of.where("root is not null").groupBy("root").agg(F.min("key").alias("name"))
    of = of.join(names, "root", "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"), F.coalesce("name", "key").alias("name"))
    return written(rows.join(of, ["s1", "s2"], "left").select("key", "at", "n", "root", "name"), "jaccard-grouped")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: 5-word shingles, Jaccard 0.75 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"))
