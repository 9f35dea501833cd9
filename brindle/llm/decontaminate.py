"""Benchmark decontamination by greedy string tiling.

Word runs that a document shares with a benchmark item are seeds. A pair can only reach the threshold with one of the
item's rarer seeds: those are joined with the runs of all documents, so a phrase that many items have joins
nothing. The seeds of a pair then bound how much of the item tiles can cover, so only pairs above the threshold are
tiled: again and again the longest match of unmarked words is marked, found by running Karp-Rabin, until none of the
least length is left. The share of the item's words that lies in tiles is the coverage; passages that were moved around
are covered like any other.

A benchmark up to :data:`BLOCK_BYTES` is sent to all tasks, and documents are only read. A larger one stays
partitioned: its seeds meet the documents' in a join by hash, behind a bitmap of fixed size that leaves out most runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.llm.shared import bounded_batches, free_name, salted_totals, table, working_on, written
from brindle.llm.words import chunks, hash_words, mix

#: Least words of a tile, first length that is searched for, and the coverage from which an item counts as leaked.
LEAST, FIRST, COVERAGE = 5, 20, 0.5
#: A benchmark of at most about so many bytes is sent to the tasks.
BLOCK_BYTES = 32 << 20
#: Pairs that are looked at at once; items that are held against a document in one task.
CELLS, SALT_ROWS = 1 << 20, 512
#: Bits of the map of a partitioned benchmark's seeds: 16 MB, however large the benchmark is.
MAP_BITS = 27

#: Words are runs of ASCII letters and digits and of all beyond ASCII; marks and spaces don't count.
WORD = np.zeros(256, bool)
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    WORD[ord(_a) : ord(_b) + 1] = True
WORD[128:] = True

MEASURES = "coverage double, words int, tiles int, longest int"
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def tile(item: np.ndarray, text: np.ndarray, least: int = LEAST, first: int = FIRST) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, words) of two arrays of word hashes, by greedy string tiling.

    A search length begins at ``first`` and is halved down to ``least``. Windows of so many unmarked words are hashed by a prefix
    sum (Karp-Rabin) and looked up; only those that no longer match holds are run on to their end, a bounded number at once, and
    of each place in the text the longest is kept. They are marked, longest first; where marked words are in the way, the search
    is made anew. Ties: the earliest in the item, then in the text.
    """
    n = len(item)
    if least < 1 or least > min(n, len(text)):
        return []
    # of the text only the words that some run shares with the item, with a break where others stood
    shared = np.flatnonzero(np.isin(runs(text, least), runs(item, least)))
    there = np.zeros(len(text) + 1, np.int64)
    np.add.at(there, shared, 1)
    np.add.at(there, shared + least, -1)
    kept = np.flatnonzero(np.cumsum(there)[:-1] > 0)
    if not len(kept):
        return []
    back = np.insert(kept, np.flatnonzero(np.diff(kept) > 1) + 1, -1)
    text = np.where(back >= 0, text[back], np.uint64(0))
    m = len(text)
    free_i, free_t = np.ones(n, bool), back >= 0
    power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, m), _B))))
    inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, m), _B_INV))))
    sums = [np.concatenate(([np.uint64(0)], np.cumsum(x * power[: len(x)]))) for x in (item, text)]

    def windows(which: int, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return at, hashed(which, at, size)

    def hashed(which: int, at: np.ndarray, size) -> np.ndarray:
        return (sums[which][at + size] - sums[which][at]) * inverse[at]

    def free_run(free: np.ndarray) -> np.ndarray:
        """Free words from each place on."""
        ends = np.where(free, len(free), np.arange(len(free)))
        return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(len(free))

    def longest(size: int) -> list[tuple[int, int, int]]:
        """(-words, start in item, start in text) of the longest match of at least ``size`` words at each place of the text that begins one."""
        at_i, h_i = windows(0, free_i, size)
        at_t, h_t = windows(1, free_t, size)
        if not len(at_i) or not len(at_t):
            return []
        # a match that runs on to the left belongs to one that begins before: pairs of equal words before them are passed over
        before_i = np.where((at_i > 0) & free_i[at_i - 1], item[at_i - 1], np.uint64(1))
        before_t = np.where((at_t > 0) & free_t[at_t - 1], text[at_t - 1], np.uint64(2))
        hashes, words = np.unique(h_i), np.unique(before_i)
        wide = len(words) + 1
        key_i = np.searchsorted(hashes, h_i) * wide + np.searchsorted(words, before_i)
        order = np.argsort(key_i, kind="stable")
        key_i, at_i = key_i[order], at_i[order]
        spot = np.minimum(np.searchsorted(hashes, h_t), len(hashes) - 1)
        met = hashes[spot] == h_t
        at_t, spot, before_t = at_t[met], spot[met], before_t[met]
        word = np.minimum(np.searchsorted(words, before_t), len(words) - 1)
        same = words[word] == before_t
        lo, hi = np.searchsorted(key_i, spot * wide), np.searchsorted(key_i, (spot + 1) * wide)
        a, b = np.searchsorted(key_i, spot * wide + word), np.searchsorted(key_i, spot * wide + word, "right")
        a, b = np.where(same, a, hi), np.where(same, b, hi)
        run_i, run_t = free_run(free_i), free_run(free_t)
        found: list[tuple[int, int, int]] = []
        many = np.concatenate(([0], np.cumsum(hi - lo - (b - a))))
        start = 0
        while start < len(at_t):
            end = max(start + 1, int(np.searchsorted(many, many[start] + CELLS, "right")) - 1)
            found += best_of(at_i, at_t[start:end], [(lo[start:end], a[start:end]), (b[start:end], hi[start:end])], run_i, run_t, size)
            start = end
        return found

    def best_of(at_i, at_t, ranges, run_i, run_t, size) -> list[tuple[int, int, int]]:
        of = np.concatenate([np.repeat(np.arange(len(at_t)), y - x) for x, y in ranges])
        pick = np.concatenate([np.repeat(x - np.concatenate(([0], np.cumsum(y - x)[:-1])), y - x) + np.arange((y - x).sum()) for x, y in ranges])
        if not len(of):
            return []
        i, t = at_i[pick], at_t[of]
        low, high = np.full(len(i), size), np.minimum(run_i[i], run_t[t])
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            equal = hashed(0, i, mid) == hashed(1, t, mid)
            low, high = np.where(open_ & equal, mid, low), np.where(open_ & ~equal, mid - 1, high)
        order = np.lexsort((i, -low, of))
        head = order[np.concatenate(([True], of[order][1:] != of[order][:-1]))]
        return list(zip((-low[head]).tolist(), i[head].tolist(), t[head].tolist(), strict=True))

    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(first, n, m))
    while True:
        again = False
        for k, a, b in sorted(longest(size)):
            k = -k
            if not (free_i[a : a + k].all() and free_t[b : b + k].all()):
                again = True
                break
            free_i[a : a + k] = free_t[b : b + k] = False
            tiles.append((a, int(back[b]), k))
        if again:
            continue
        if size == least:
            return tiles
        size = max(least, size // 2)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` words in a row."""
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        rolled = rolled * _B + words[j : j + len(rolled)]
    return mix(rolled)


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    got = hash_words(texts, WORD)
    return [got.hashes[a:b] for a, b in zip(got.at[:-1], got.at[1:], strict=True)]


def needed(words: int, coverage: float) -> int:
    return ceil(coverage * words - 1e-9)


def compare(item: np.ndarray, text: np.ndarray, coverage: float, known: dict[int, np.ndarray]) -> tuple[float, int, int, int] | None:
    """Coverage, words, tiles and longest tile of a pair, if it reaches ``coverage``; ``known``: the text's sorted runs by length, filled here."""
    size = min(LEAST, len(item))
    if size not in known:
        known[size] = np.unique(runs(text, size))
    need = needed(len(item), coverage)
    at = runs(item, size)
    spot = np.searchsorted(known[size], at)
    spot[spot == len(known[size])] = 0
    hit = np.flatnonzero(known[size][spot] == at) if len(known[size]) else np.zeros(0, np.int64)
    bound = np.zeros(len(item) + 1, np.int64)
    np.add.at(bound, hit, 1)
    np.add.at(bound, hit + size, -1)
    if (np.cumsum(bound)[:-1] > 0).sum() < need or not len(hit):
        return None
    tiles = tile(item, text, size)
    n = sum(t[2] for t in tiles)
    return (n / len(item), n, len(tiles), max(t[2] for t in tiles)) if n >= need and tiles else None


@dataclass
class Benchmark:
    """Distinct item texts as word hashes, the ids of each, and the seeds by which pairs are found: sorted hashes of each length with their items."""

    ids: list[list]
    words: list[np.ndarray]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]
    coverage: float

    @classmethod
    def of(cls, items: list[tuple], coverage: float = COVERAGE) -> Benchmark:
        """Items without words can't leak and are left out; shorter ones than a tile are one seed."""
        by_text: dict[str, list] = {}
        for i, t in sorted(((i, t) for i, t in items if t), key=lambda x: (x[0] is None, x[0] or 0, x[1])):
            by_text.setdefault(t, []).append(i)
        words = words_of([t.encode() for t in by_text]) if by_text else []
        kept = [(ids, w) for ids, w in zip(by_text.values(), words, strict=True) if len(w)]
        seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {min(LEAST, len(w)) for _, w in kept}:
            of = [n for n, (_, w) in enumerate(kept) if min(LEAST, len(w)) == size]
            found = [np.unique(runs(kept[n][1], size), return_counts=True) for n in of]
            every, many = np.unique(np.concatenate([h for h, _ in found]), return_counts=True)
            rare = [h[_rarer(many[np.searchsorted(every, h)], h, c * size, needed(len(kept[n][1]), coverage))] for n, (h, c) in zip(of, found, strict=True)]
            h, n = np.concatenate(rare), np.repeat(of, [len(r) for r in rare])
            order = np.argsort(h, kind="stable")
            seeds[size] = (h[order], n[order])
        return cls([ids for ids, _ in kept], [w for _, w in kept], seeds, coverage)

    def hits(self, texts: list[bytes]) -> list[list[tuple]]:
        """Per text: (id, coverage, words, tiles, longest) of the items of which it covers enough."""
        out: list[list[tuple]] = [[] for _ in texts]
        for s in chunks(texts):
            words = hash_words(texts[s], WORD)
            met: set[tuple[int, int]] = set()
            for size, (h, item) in self.seeds.items():
                lo, spots = lookup(h, runs(words.hashes, size))
                text = np.searchsorted(words.at, spots, "right") - 1
                inside = spots + size <= words.at[text + 1]
                lo, text = lo[inside], text[inside]
                # each run of a text once
                first = np.unique(text * (len(h) + 1) + lo, return_index=True)[1]
                lo, text = lo[first], text[first]
                hi = np.searchsorted(h, h[lo], "right")
                for a in range(0, len(lo), 4096):
                    n = hi[a : a + 4096] - lo[a : a + 4096]
                    at = np.repeat(lo[a : a + 4096] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    pairs = np.unique(np.stack((np.repeat(text[a : a + 4096], n), item[at])), axis=1)
                    met.update(zip(*pairs.tolist(), strict=True))
            now, known = -1, {}
            for d, i in sorted(met):
                if d != now:
                    now, known = d, {}
                if found := compare(self.words[i], words.hashes[words.at[d] : words.at[d + 1]], self.coverage, known):
                    out[s.start + d] += [(name, *found) for name in self.ids[i]]
        return out


def _rarer(many: np.ndarray, hashes: np.ndarray, cover: np.ndarray, need: int) -> np.ndarray:
    """Which of an item's seeds have to be looked up: the commonest, by ``many``, that can't cover ``need`` words together needn't."""
    order = np.lexsort((hashes, -many))
    return order[np.cumsum(cover[order]) >= need]


def lookup(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place in the sorted hashes, place in hashes) of those that are there; a bitmap passes over most."""
    if not len(sorted_hashes) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = np.uint64(min(24, max(16, int(len(sorted_hashes)).bit_length() + 6)))
    there = np.zeros(1 << int(bits), bool)
    there[(sorted_hashes >> (np.uint64(64) - bits)).astype(np.int64)] = True
    spots = np.flatnonzero(there[(hashes >> (np.uint64(64) - bits)).astype(np.int64)])
    lo = np.searchsorted(sorted_hashes, hashes[spots])
    same = (lo < len(sorted_hashes)) & (sorted_hashes[np.minimum(lo, len(sorted_hashes) - 1)] == hashes[spots])
    return lo[same], spots[same]


def items_of(benchmark: DataFrame, nameless: bool) -> tuple[DataFrame, bool]:
    """Distinct (item_id, text) with a text, and whether they are few enough to be sent to the tasks."""
    items = benchmark.select("item_id", "text").where("text is not null")
    items = (items if nameless else items.where("item_id is not null")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    return items, size <= BLOCK_BYTES


def leaks(spark: SparkSession, items: DataFrame, text: str = "text", coverage: float = COVERAGE) -> Column:
    """The array of leaked items of a column of whole texts; ``items``: distinct and of a checked size, sent to the tasks."""
    sent = spark.sparkContext.broadcast(Benchmark.of([tuple(r) for r in items.collect()], coverage))
    kind = items.schema["item_id"].dataType
    fields = [("item_id", to_arrow_type(kind)), ("coverage", pa.float64()), *((c, pa.int32()) for c in ("words", "tiles", "longest"))]
    hit = pa.list_(pa.struct(fields))

    @F.arrow_udf(f"array<struct<item_id: {kind.simpleString()}, {MEASURES}>>")
    def hits(texts: pa.Array) -> pa.Array:
        working_on("decontaminate")
        found = sent.value.hits([t.encode() for t in texts.to_pylist()])
        return pa.array([[dict(zip((f for f, _ in fields), x, strict=True)) for x in row] for row in found], hit)

    return hits(F.coalesce(F.col(text), F.lit("")))


# ---- a benchmark that stays partitioned ----------------------------------------------------------


def _name(text: str) -> list[Column]:
    """128 bits of a text, by which it is known; equal texts are compared once."""
    c = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(c), F.xxhash64(c, F.lit(1))]


def _seeds(items: DataFrame) -> DataFrame:
    """(i1, i2, n, size, seed, cover): the distinct seeds of each item; cover: words that its places can cover."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, w in enumerate(words_of([t.encode() for t in batch.column("text").to_pylist()])):
                if len(w):
                    size = min(LEAST, len(w))
                    h, c = np.unique(runs(w, size), return_counts=True)
                    row = batch.slice(i, 1).select(["i1", "i2"]).take(pa.array(np.zeros(len(h), np.int64)))
                    more = [pa.array(np.full(len(h), len(w))), pa.array(np.full(len(h), size, np.int32)), pa.array(h.astype(np.int64)), pa.array(c * size)]
                    yield pa.RecordBatch.from_arrays([*row.columns, *more], ["i1", "i2", "n", "size", "seed", "cover"])

    return items.mapInArrow(of, "i1 bigint, i2 bigint, n bigint, size int, seed bigint, cover bigint")


def _rare_seeds(seeds: DataFrame, coverage: float) -> DataFrame:
    """(seed, size, i1, i2): those that have to be looked up, by the rule of :func:`_rarer`."""
    dealt = seeds.withColumn("salt", F.pmod(F.xxhash64("i1"), F.lit(64)))
    many = salted_totals(dealt, ["size", "seed"], "salt", [F.count("*").alias("many")], [F.sum("many").alias("many")])
    commonest = Window.partitionBy("i1", "i2").orderBy(F.desc("many"), "seed")
    need = F.ceil(F.lit(coverage) * F.col("n") - 1e-9)
    return dealt.join(many, ["size", "seed", "salt"]).withColumn("so_far", F.sum("cover").over(commonest)).where(F.col("so_far") >= need).select("seed", "size", "i1", "i2")


def _map(rare: DataFrame) -> np.ndarray:
    """The bitmap of seeds: at most 2**(MAP_BITS - 15) rows of 4 kB come to the driver."""
    spot = F.shiftrightunsigned("seed", 64 - MAP_BITS)
    parts = rare.select(F.shiftright(spot, 15).alias("part"), F.pmod(spot, F.lit(1 << 15)).alias("bit"))
    there = np.zeros((1 << (MAP_BITS - 15), 4096), np.uint8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        there[r["part"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return there.reshape(-1)


def _runs(docs: DataFrame, sizes: list[int], there: np.ndarray) -> DataFrame:
    """(seed, size, t1, t2): the distinct runs of each text that the bitmap doesn't rule out."""
    sent = docs.sparkSession.sparkContext.broadcast(there)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("decontaminate")
        bits = sent.value
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for s in chunks(texts):
                words = hash_words(texts[s], WORD)
                for size in sizes:
                    h = runs(words.hashes, size)
                    spot = h >> np.uint64(64 - MAP_BITS)
                    at = np.flatnonzero(bits[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1)
                    d = np.searchsorted(words.at, at, "right") - 1
                    inside = at + size <= words.at[d + 1]
                    pairs = np.unique(np.stack((d[inside], h[at[inside]].astype(np.int64))), axis=1)
                    ids = batch.slice(s.start).select(["t1", "t2"]).take(pa.array(pairs[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[1]), pa.array(np.full(len(pairs[0]), size, np.int32)), *ids.columns], ["seed", "size", "t1", "t2"])

    return docs.select("t1", "t2", "text").mapInArrow(of, "seed bigint, size int, t1 bigint, t2 bigint")


def joined_hits(docs: DataFrame, items: DataFrame, text: str, coverage: float) -> DataFrame:
    """(t1, t2, i1, i2, measures) of texts of ``docs`` and of ``items`` (item_id, text), each named by 128 bits."""
    i1, i2 = _name("text")
    texts = written(items.select(i1.alias("i1"), i2.alias("i2"), "text").dropDuplicates(["i1", "i2"]), "benchmark-texts")
    rare = written(_rare_seeds(written(_seeds(texts), "benchmark-seeds"), coverage), "benchmark-rare-seeds")
    sizes = [r[0] for r in rare.select("size").distinct().collect()]  # five at most
    t1, t2 = _name(text)
    named = docs.select(t1.alias("t1"), t2.alias("t2"), F.col(text).alias("text"))
    pairs = written(_runs(named, sizes, _map(rare)).join(rare, ["seed", "size"]).select("t1", "t2", "i1", "i2").distinct(), "benchmark-pairs")
    # a text meets its items in tasks of a few hundred
    salts = pairs.groupBy("t1", "t2").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    ones = named.join(salts, ["t1", "t2"]).dropDuplicates(["t1", "t2"])
    left = ones.select("t1", "t2", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.lit(0).cast("bigint").alias("i1"), F.lit(0).cast("bigint").alias("i2"), "text")
    right = pairs.join(salts, ["t1", "t2"]).join(texts, ["i1", "i2"]).select("t1", "t2", F.pmod("i1", "salts").cast("int").alias("salt"), F.lit(1).alias("role"), "i1", "i2", "text")
    met = left.unionByName(right).repartition("t1", "t2", "salt").sortWithinPartitions("t1", "t2", "salt", "role")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = np.zeros(0, np.uint64), {}
        for batch in batches:
            found: list[tuple] = []
            for row in batch.to_pylist():
                (w,) = words_of([row["text"].encode()]) if row["text"] else (held[:0],)
                if row["role"] == 0:
                    held, known = w, {}
                elif hit := compare(w, held, coverage, known):
                    found.append((row["t1"], row["t2"], row["i1"], row["i2"], *hit))
            kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int32()] * 3
            columns = zip(*found, strict=True) if found else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["t1", "t2", "i1", "i2", "coverage", "words", "tiles", "longest"])

    return written(met.mapInArrow(tiled, f"t1 bigint, t2 bigint, i1 bigint, i2 bigint, {MEASURES}"), "benchmark-hits")


# ---- operators ----------------------------------------------------------------------------------


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE, nameless: bool = False
) -> DataFrame:
    """(key, item_id, coverage, words, tiles, longest): a row per document and item that it leaks.

    Null and empty texts leak nothing, null and wordless items can't be leaked. Items without an id are reported with a null item_id
    if ``nameless``, each text of them in a row of its own; else they are left out. Very long texts
    are compared whole, by the words that they share with an item. Repeated documents: each has its rows; repeated
    items count once, items of one id and several texts each. Ties of matches: see :func:`tile`. Empty tables: no rows. Ids may be of any
    type; other columns are ignored.
    """
    docs = bounded_batches(docs)
    items, few = items_of(benchmark, nameless)
    if few:
        found = docs.select(F.col(key), leaks(docs.sparkSession, items, text, coverage).alias("_hits"))
        return found.select(key, F.inline("_hits"))
    hits = joined_hits(docs, items, text, coverage)
    t1, t2 = _name(text)
    i1, i2 = _name("text")
    of = docs.select(F.col(key), t1.alias("t1"), t2.alias("t2")).join(hits, ["t1", "t2"])
    return of.join(items.select("item_id", i1.alias("i1"), i2.alias("i2")), ["i1", "i2"]).select(key, "item_id", "coverage", "words", "tiles", "longest")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without those that leak an item, one without an id too; all columns and repeated rows stay, whatever their names."""
    docs = bounded_batches(docs)
    items, few = items_of(benchmark, nameless=True)
    if few:
        name = free_name(docs, "leaked")
        return docs.withColumn(name, leaks(docs.sparkSession, items, text, coverage)).where(F.size(name) == 0).drop(name)
    hits = joined_hits(docs, items, text, coverage).select("t1", "t2").distinct()
    a, b = free_name(docs, "t1"), free_name(docs, "t2")
    marked = docs.withColumns(dict(zip((a, b), _name(text), strict=True)))
    return marked.join(hits.withColumnsRenamed({"t1": a, "t2": b}), [a, b], "left_anti").select(docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ``documents`` that leak an item of ``benchmark``, and which; items without an id as well."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), nameless=True)
