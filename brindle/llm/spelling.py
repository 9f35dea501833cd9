"""Spelling variants: words one edit apart, by two-dimensional range reporting with wavelet trees.

A word with an edit at place i is what has the first i letters before and the last letters behind: of the words of a length, in
alphabetical order, those with the prefix are an interval; in the order of the reversed words, those with the suffix are one. A wavelet tree over
the second ranks in the first order reports the words in both. Words of the query's length are replacements, of one letter more insertions.

Every edit leaves the first half or the second half of the longer word as it is, so words are dealt by length and half: one table by first
halves, for edits behind them, one by second halves, for edits before. A task builds a tree for each length of its halves. A half that
``GROUP_MOST`` words or more share is cut by words, and its queries go to all its cuts, so no task holds it whole. No word is left out at any place.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import bounded_batches, table, working_on, written

#: Code points of a word and occurrences of it, at least; a form has so many times the occurrences of its variant.
MIN_LENGTH, MIN_COUNT, FORM_RATIO = 5, 3, 2
#: One in so many (document, run) loses a code point: the test bed of variants.
NOISE = 97
#: Distinct words that a task counts before it passes them on; code points of a bin of words; words that make a half hot.
FLUSH, BIN_CHARS, GROUP_MOST = 400_000, 1_000_000, 20_000
#: Rectangles that are reported at once.
QUERIES = 1 << 18

RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % MIN_LENGTH)


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, with the noise of their document, and how often they occur.

    Null texts have none; a row without an id has no noise. Each of repeated rows counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("spelling")
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if not t.is_valid:
                    continue
                # bytes know capitals of ASCII only
                found = Counter(RUN.findall(t.as_py().lower().decode()))
                if doc is not None:
                    start = zlib.crc32(f"{doc}:".encode())
                    hit = [(w, h) for w in found if (h := zlib.crc32(w.encode(), start)) % noise == 0]
                    changed = [(w[: h % len(w)] + w[h % len(w) + 1 :], found.pop(w)) for w, h in hit]
                    for w, n in changed:
                        if len(w) >= MIN_LENGTH:
                            found[w] += n
                held.update(found)
                if len(held) >= FLUSH:
                    yield _counts(held)
                    held.clear()
        if held:
            yield _counts(held)

    rows = bounded_batches(docs).select(F.col(key).cast("string"), F.col(text)).mapInArrow(run, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _counts(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])


class WaveletTree:
    """Over a permutation: which values of a range stand in a range of places. One level a bit, zeros before ones in each."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        self.bits = max(1, int(self.size - 1).bit_length()) if self.size else 1
        self.zeros = []
        now = values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b) & 1 == 1
            self.zeros.append(np.concatenate(([0], np.cumsum(~one))))
            now = np.concatenate((now[~one], now[one]))

    def report(self, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for each value of [low, high) at a place of [first, last) of each query."""
        query = np.arange(len(first))
        left, right, prefix = first.astype(np.int64), last.astype(np.int64), np.zeros(len(first), np.int64)
        for level, zeros in enumerate(self.zeros):
            width = 1 << (self.bits - 1 - level)
            l0, r0 = zeros[left], zeros[right]
            l1, r1 = zeros[-1] + left - l0, zeros[-1] + right - r0
            zero = (r0 > l0) & (prefix < high) & (prefix + width > low)
            upper = prefix + width
            one = (r1 > l1) & (upper < high) & (upper + width > low)
            query = np.concatenate((query[zero], query[one]))
            left, right = np.concatenate((l0[zero], l1[one])), np.concatenate((r0[zero], r1[one]))
            prefix = np.concatenate((prefix[zero], upper[one]))
            low, high = np.concatenate((low[zero], low[one])), np.concatenate((high[zero], high[one]))
        return query, prefix


def _intervals(letters: np.ndarray, member: np.ndarray, depths: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rank of each row among the members in alphabetical order, and per depth the interval of members that begin as the row does.

    ``letters``: rows x places, 0 behind a word's end.
    """
    n, places = letters.shape
    order = np.argsort(np.ascontiguousarray(letters).view(f"S{places}").ravel(), kind="stable")
    rows = letters[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), places)
    before = np.concatenate(([0], np.cumsum(member[order])))
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    firsts, lasts = [], []
    for d in range(depths):
        begins = np.concatenate(([0], np.flatnonzero(common < d) + 1))
        block = np.zeros(n, np.int64)
        block[begins[1:]] = 1
        block = np.cumsum(block)
        ends = np.append(begins[1:], n)
        firsts.append(before[begins][block][back].astype(np.int32))
        lasts.append(before[ends][block][back].astype(np.int32))
    return before[back], firsts, lasts


def near_pairs(words: list[bytes], member: np.ndarray, longer: int, places: range) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b) of words that one edit makes of each other, at a place of ``places`` of the longer one, b a member.

    ``words``: Latin-1, distinct, of ``longer`` letters or one less; members have ``longer``. A replacement is found from either side that is asked,
    an insertion at the last of its equal places.
    """
    n = len(words)
    letters = np.frombuffer(b"".join(w.ljust(longer, b"\0") for w in words), np.uint8).reshape(n, longer)
    turned = np.frombuffer(b"".join(w[::-1].ljust(longer, b"\0") for w in words), np.uint8).reshape(n, longer)
    short = np.array([len(w) < longer for w in words])
    rank, first, last = _intervals(letters, member, places.stop)
    other, low, high = _intervals(turned, member, longer - places.start)
    spots = np.flatnonzero(member)
    by_rank, by_other = np.empty(len(spots), np.int64), np.empty(len(spots), np.int64)
    by_rank[rank[spots]] = spots
    by_other[other[spots]] = spots
    tree = WaveletTree(other[by_rank])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    own = member.astype(np.int32)
    for i in places:
        behind = longer - 1 - i
        ask = np.flatnonzero((last[i] - first[i] > own) & (high[behind] - low[behind] > own))
        for at in range(0, len(ask), QUERIES):
            q = ask[at : at + QUERIES]
            query, value = tree.report(first[i][q], last[i][q], low[behind][q], high[behind][q])
            a, b = q[query], by_other[value]
            # a word with an equal letter put beside one is found at each of the equal letters: the last counts
            keep = np.where(short[a], (letters[a, i] == 0) | (letters[a, i] != letters[b, i]), a != b)
            found.append((a[keep], b[keep]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in found)]) for k in (0, 1))  # type: ignore[return-value]


def _neighbours(group: pa.Table) -> pa.Table:
    """Per word of a bin: how many near words were found here, and the one of most occurrences, the first by code points of these."""
    working_on("spelling")
    rows = group.to_pandas()
    out: list[pa.Table] = []
    for (by_first, longer), part in rows.groupby(["by_first", "longer"], sort=False):
        # a word whose half is cut may be here as a query of several cuts
        part = part.sort_values("member", ascending=False).drop_duplicates("word")
        words = [w.encode("latin-1") for w in part["word"]]
        member, n = part["member"].to_numpy(bool), part["n"].to_numpy(np.int64)
        half = int(longer) // 2
        a, b = near_pairs(words, member, int(longer), range(half, int(longer)) if by_first else range(half))
        inserted = np.array([len(w) < longer for w in words])[a] if len(a) else np.zeros(0, bool)
        a, b = np.concatenate((a, b[inserted])), np.concatenate((b, a[inserted]))
        if not len(a):
            continue
        alphabetical = np.argsort(np.argsort(np.array(words)))
        order = np.lexsort((alphabetical[b], -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        spelled = part["word"].to_numpy()
        out.append(pa.table({"word": spelled[a[first]], "n_near": np.diff(np.append(first, len(a))), "near_n": n[b[first]], "near": spelled[b[first]]}, _NEAR))
    return pa.concat_tables(out) if out else _NEAR.empty_table()


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) for the words of a table (word, n) that have near ones: how many, the largest n and whose it is.

    ``words`` must be written: it is read three times. Shuffles: words by halves, four short rows a word.
    """
    size = F.length("word")
    queries = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer")).withColumn("member", F.col("longer") == size)
    half = F.floor(F.col("longer") / 2).cast("int")
    sides = queries.withColumn("by_first", F.explode(F.array(F.lit(True), F.lit(False))))
    sides = sides.withColumn("half", F.when(F.col("by_first"), F.substring(F.col("word"), F.lit(1), half)).otherwise(F.substring(F.col("word"), size - (F.col("longer") - half) + 1, F.col("longer") - half)))
    by = ["by_first", "longer", "half"]
    hot = written(sides.where("member").groupBy(*by).agg(F.count("*").alias("members")).where(F.col("members") >= GROUP_MOST), "hot-halves")
    cuts = F.lit(1)
    if not hot.isEmpty():
        sides, cuts = sides.join(hot, by, "left"), F.coalesce(F.ceil(F.col("members") / GROUP_MOST).cast("int"), F.lit(1))
    own = F.pmod(F.xxhash64("word"), cuts).cast("int")
    # a member stands in one cut of its half, its queries go to all
    dealt = sides.withColumn("cut", F.explode(F.sequence(F.lit(0), cuts - 1))).withColumn("member", F.col("member") & (F.col("cut") == own))
    chars = words.agg(F.sum(size.cast("bigint"))).first()[0] or 0
    bins = max(1, -(-4 * chars // BIN_CHARS))
    dealt = dealt.select("by_first", "longer", "member", "word", "n", F.pmod(F.xxhash64(*by, "cut"), F.lit(bins)).alias("bin"))
    found = dealt.groupBy("bin").applyInArrow(lambda g: _neighbours(g), "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): from word to form, and on to the last. Each round doubles the steps; a form has more occurrences, so there are no rings."""
    steps = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = written(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        if longer.where("moved").isEmpty():
            return steps
        steps = longer.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of at least ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences.

    Words are near if one inserted, deleted or replaced code point makes one of the other. form: the near word of most occurrences (ties:
    the first in the order of code points) if it has ``FORM_RATIO`` times the word's, else null; root: the last of the forms.
    Null and empty texts have no words. Very long texts and runs: whole; a bin holds a bounded number of code points or one word. A row
    without an id has no noise. Repeated rows count each. An empty table: no rows. Other columns are ignored, whatever their names.
    """
    words = written(counted_words(docs, key, text, noise), "words")
    formed = F.col("near_n") >= FORM_RATIO * F.col("n")
    near = words.join(near_words(words), "word", "left")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n"))
    near = written(near, "variants")
    tied = near.join(roots(near.where("form is not null")), "word", "left")
    return tied.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of all ``documents``."""
    return variants(table(spark, sf_dir, "documents"))
