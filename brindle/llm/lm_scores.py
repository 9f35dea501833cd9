"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting takes three shuffles of packed counts. Words first: tasks count the words of their texts, parts (ranges of word hashes) add
them up. Then pairs: a task packs its distinct pairs sorted by first word; a part adds up the pairs of its first words, writes their
sorted hashes and counts, and sends on what words need: for first words the total and how many followers occur once, twice, oftener
(the back-off mass), for second words how many distinct words they follow (the continuation count). Last, words again: parts add
that up and write sorted hashes with these columns. A first word of ``HOT`` occurrences or more is dealt by pairs, so that no part holds it alone.

Discounts are the modified ones, from the numbers of pairs (for words: of continuation counts) of 1 to 4. Scoring is one narrow pass:
workers map the arrays into memory and look each distinct hash of a batch up in ascending order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.hash_arrays import HashTable, counted, mixed, part_of, totals, write_arrays
from brindle.llm.shared import bounded_batches, free_name, fresh_folder, table, working_on, written
from brindle.llm.words import Words, chunks, hash_words

#: Rows whose crc32(doc_id as text) leaves this remainder modulo 7 are not learnt from.
FOLDS, HELD_OUT = 7, 2
#: Bytes of text for each part of the model, about; tokens that a task counts before it passes them on; occurrences that make a first word hot.
PART_BYTES, FLUSH, HOT = 12 << 20, 2_000_000, 500_000
#: Stand for the begin of a text (only ever before a token) and for its end (only ever after one).
BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Discounts of counts 1, 2 and more where too few counts occur to estimate them.
FALLBACK = (0.5, 1.0, 1.5)

_PACKED = "part bigint, kind string, keys binary, vals binary, stats array<bigint>, files array<string>"
_SCHEMA = pa.schema([("part", pa.int64()), ("kind", pa.string()), ("keys", pa.binary()), ("vals", pa.binary()), ("stats", pa.list_(pa.int64())), ("files", pa.list_(pa.string()))])


def not_learnt(key: str = "doc_id") -> Column:
    """True for rows that the model doesn't learn from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands before each token, each token, and where each text's tokens begin; a text's last token is END."""
    n = np.diff(words.at)
    start = np.concatenate(([0], np.cumsum(n + 1)))
    spot = np.arange(words.at[-1]) + np.repeat(np.arange(len(n)), n)
    before, token = np.full(start[-1], BEGIN), np.full(start[-1], END)
    used = words.hashes[: words.at[-1]]
    token[spot] = used
    before[spot + 1] = used
    return before, token, start


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    for s in chunks(texts):
        yield texts[s]


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _cut(kind: str, part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns in ascending order of ``part``, the first as keys, the others as values: a row for each part."""
    edges = np.flatnonzero(np.concatenate((np.ones(min(1, len(part)), bool), part[1:] != part[:-1], np.ones(min(1, len(part)), bool))))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield _packed([(int(part[a]), kind, columns[0][a:b].tobytes(), b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns[1:]), None, None)])


def _flat(group: pa.Table, kind: str, values: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys and ``values`` columns of all rows of a kind."""
    rows = [(k.as_py(), v.as_py()) for k, v, x in zip(group["keys"], group["vals"], group["kind"], strict=True) if x.as_py() == kind]
    keys = [np.frombuffer(k, "<u8") for k, _ in rows]
    vals = [np.frombuffer(v, "<u8").reshape(values, -1) for _, v in rows]
    return np.concatenate([np.zeros(0, np.uint64), *keys]), [np.concatenate([np.zeros(0, np.uint64), *(v[i] for v in vals)]) for i in range(values)]


def _bounded(docs: DataFrame, text: str, each) -> DataFrame:
    """``each(list of (before, token))`` over about ``FLUSH`` tokens at a time of the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("lm_scores")
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part in _texts(batch.column(0)):
                held.append(tokens(hash_words(part))[:2])
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield from each(held)
                    held.clear()
        if held:
            yield from each(held)

    return bounded_batches(docs).select(F.col(text)).mapInArrow(run, _PACKED)


def _count_words(train: DataFrame, text: str, parts: int) -> DataFrame:
    def each(held: list) -> Iterator[pa.RecordBatch]:
        keys, n = counted(np.concatenate([x[1] for x in held]))
        yield from _cut("c", part_of(keys, parts), keys, n.astype("<u8"))

    def add(group: pa.Table) -> pa.Table:
        keys, (n,) = totals_of(group, "c", 1)
        hot = keys[n >= HOT]
        row = (group["part"][0].as_py(), "c", keys.tobytes(), n.tobytes(), [len(keys), int(n.sum()), *hot.view("<i8").tolist()], None)
        return pa.Table.from_batches([_packed([row])])

    return written(_bounded(train, text, each).groupBy("part").applyInArrow(add, _PACKED), "lm-words")


def totals_of(group: pa.Table, kind: str, values: int) -> tuple[np.ndarray, list[np.ndarray]]:
    keys, columns = _flat(group, kind, values)
    keys, *columns = totals(keys, *columns)
    return keys, columns


def dealt_by(before: np.ndarray, key: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What deals pairs to parts: the first word's hash, or the whole pair's if the first word is hot."""
    if not len(hot):
        return before
    at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
    return np.where(hot[at] == before, key, before)


def _count_pairs(train: DataFrame, text: str, parts: int, hot: np.ndarray, folder: str) -> DataFrame:
    def each(held: list) -> Iterator[pa.RecordBatch]:
        before, token = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        by = dealt_by(before, mixed(before, token), hot)
        # by part, first word and second word; the upper halves of the hashes do, as parts add up whatever is still apart
        order = np.argsort((by & np.uint64(0xFFFFFFFF00000000)) | (token >> np.uint64(32)))
        before, token, part = before[order], token[order], part_of(by[order], parts)
        first = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (token[1:] != token[:-1]))))
        n = np.diff(np.append(first, len(token))).astype("<u8")
        yield from _cut("p", part[first], before[first], token[first], n)

    def add(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        before, (token, n) = _flat(group, "p", 2)
        key = mixed(before, token)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.add.reduceat(n[order], first)
        key, before, token = key[first], before[order[first]], token[order[first]]
        files = write_arrays(folder, f"pairs-{part:05d}", key, {"n": n})
        stats = [len(key), *(int((n == k).sum()) for k in (1, 2, 3, 4))]
        rows = [pa.Table.from_batches([_packed([(part, "p", None, None, stats, files)])])]
        of, *sums = totals(before, n, *((n == k).astype("<u8") for k in (1, 2)), (n > 2).astype("<u8"))
        followed = counted(token)
        for kind, keys, columns in (("x", of, sums), ("a", followed[0], [followed[1].astype("<u8")])):
            rows.append(pa.Table.from_batches(list(_cut(kind, part_of(keys, parts), keys, *columns)), _SCHEMA))
        return pa.concat_tables(rows)

    return written(_bounded(train, text, each).groupBy("part").applyInArrow(add, _PACKED), "lm-pairs")


def _join_words(words: DataFrame, pairs: DataFrame, folder: str) -> DataFrame:
    columns = ("c", "a", "total", "n1", "n2", "n3")

    def add(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        kinds = (_flat(group, "c", 1), _flat(group, "a", 1), _flat(group, "x", 4))
        keys = np.concatenate([k for k, _ in kinds])
        sums, at = [np.zeros(len(keys), np.uint64) for _ in columns], 0
        for start, (k, vals) in zip((0, 1, 2), kinds, strict=True):
            for i, v in enumerate(vals):
                sums[start + i][at : at + len(k)] = v
            at += len(k)
        keys, *sums = totals(keys, *sums)
        files = write_arrays(folder, f"words-{part:05d}", keys, dict(zip(columns, sums, strict=True)))
        a = sums[1]
        stats = [len(keys), *(int((a == k).sum()) for k in (1, 2, 3, 4)), int((a > 0).sum()), int(a.sum())]
        return pa.Table.from_batches([_packed([(part, "w", None, None, stats, files)])])

    rows = words.unionByName(pairs.where("kind <> 'p'"))
    return written(rows.groupBy("part").applyInArrow(add, _PACKED), "lm-model")


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from how many counts are 1, 2, 3 and 4.

    :data:`FALLBACK` where one of these is 0 or a discount would be below 0.
    """
    if not all(n):
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return found if min(found) >= 0 else FALLBACK


@dataclass
class Model:
    """What tasks need to score: where the arrays lie, and the numbers that hold for all words."""

    folder: str
    words: list[tuple[str, int, list[str]]]
    pairs: list[tuple[str, int, list[str]]]
    hot: np.ndarray
    n_tokens: int  # in training texts, ends included
    n_words: int  # distinct
    n_pairs: int  # distinct
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_classes: tuple[int, int, int]  # words of continuation count 1, 2, more

    def open(self) -> tuple[HashTable, HashTable]:
        return HashTable(self.folder, self.words), HashTable(self.folder, self.pairs)

    def unigram(self, a: np.ndarray) -> np.ndarray:
        """The probability of words of these continuation counts (0: unknown); the rest of the mass is even over words and one unknown."""
        if not self.n_pairs:
            return np.full(len(a), 1.0 / (self.n_words + 1))
        d = np.array([0.0, *self.word_discounts])[np.minimum(a, 3)]
        rest = sum(x * y for x, y in zip(self.word_discounts, self.word_classes, strict=True)) / self.n_pairs
        return np.maximum(a - d, 0) / self.n_pairs + rest / (self.n_words + 1)

    def score(self, before: np.ndarray, token: np.ndarray, start: np.ndarray, words: HashTable, pairs: HashTable) -> tuple[np.ndarray, np.ndarray]:
        """(training count, log10 probability) of each token; ``start``: where texts begin."""
        names = ["c", "a", "total", "n1", "n2", "n3"]
        there, back = np.unique(np.append(token, BEGIN), return_inverse=True)
        c, a, total, n1, n2, n3 = words.look_up(there, names) if self.words else [np.zeros(len(there), np.int64)] * len(names)
        second, first = back[:-1], np.roll(back, 1)[:-1]
        first[start[:-1]] = back[-1]
        low = self.unigram(a)[second]
        key = mixed(before, token)
        seen = total[first] > 0  # words that the model knows before others
        n = np.zeros(len(key), np.int64)
        if seen.any():
            (n[seen],) = pairs.look_up(key[seen], ["n"], part_of(dealt_by(before[seen], key[seen], self.hot), len(self.pairs)))
        d1, d2, d3 = self.pair_discounts
        rest = (d1 * n1 + d2 * n2 + d3 * n3) / np.maximum(total, 1)
        d = np.array([0.0, d1, d2, d3])[np.minimum(n, 3)]
        high = np.maximum(n - d, 0) / np.maximum(total[first], 1) + rest[first] * low
        return c[second], np.log10(np.where(seen, high, low))


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Counts the words and pairs of all rows that aren't held out, and writes the arrays to the shared folder.

    The driver gets a few numbers a part, and hot words: at most one for every ``HOT`` tokens.
    """
    spark, folder = docs.sparkSession, fresh_folder(docs.sparkSession, "lm-arrays")
    train = docs.where(~not_learnt(key)).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    size, rows = train.agg(F.sum(F.octet_length("text").cast("bigint")), F.count("*")).first()
    parts = max(1, -(-(size or 0) // PART_BYTES))
    if not rows:
        return Model(folder, [], [], np.zeros(0, np.uint64), 0, 0, 0, FALLBACK, FALLBACK, (0, 0, 0))
    words = _count_words(train, "text", parts)
    found = [r["stats"] for r in words.select("stats").collect()]
    hot = np.sort(np.array([h for s in found for h in s[2:]] + [np.int64(BEGIN.view("<i8"))] * (rows >= HOT), np.int64).view(np.uint64))
    pairs = _count_pairs(train, "text", parts, hot, folder)
    model = _join_words(words, pairs, folder)
    p = sorted(tuple(r) for r in pairs.where("kind = 'p'").select("part", "stats", "files").collect())
    w = sorted(tuple(r) for r in model.select("part", "stats", "files").collect())
    n = [sum(x[1][k] for x in w) for k in range(1, 7)]
    return Model(
        folder, _parts("words", w, parts), _parts("pairs", p, parts), hot, sum(s[1] for s in found), sum(s[0] for s in found), sum(x[1][0] for x in p),
        discounts([sum(x[1][k] for x in p) for k in range(1, 5)]), discounts(n[:4]), (n[0], n[1], n[4] - n[0] - n[1]),
    )


def _parts(kind: str, rows: list[tuple], parts: int) -> list[tuple[str, int, list[str]]]:
    there = {part: (f"{kind}-{part:05d}", stats[0], files) for part, stats, files in rows}
    return [there.get(p, ("", 0, [])) for p in range(parts)]


def scorer(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """struct(n_tokens, n_known, base_score, score) of a column of whole texts."""
    sent = spark.sparkContext.broadcast(model)
    kinds = [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]

    @F.arrow_udf("struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        working_on("lm_scores")
        m, found = sent.value, [[np.zeros(0)] for _ in kinds]
        words, pairs = m.open()
        for part in _texts(texts):
            before, token, start = tokens(hash_words(part))
            c, p = m.score(before, token, start, words, pairs)
            base = np.log10((c + 1) / (m.n_tokens + m.n_words + 1))
            for out, values in zip(found, (np.ones(len(c)), c > 0, base, p), strict=True):
                out.append(np.add.reduceat(values.astype(float), start[:-1]))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)).cast(t) for x, (_, t) in zip(found, kinds, strict=True)], [k for k, _ in kinds])

    return run(F.coalesce(F.col(text), F.lit("")))


def with_scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity (of a token, from the score).

    Tokens are words (runs without ASCII white space, A-Z in lower case) and one end. base_score: log10 probability by single words
    with add-one smoothing; score: by the model. Null, empty and blank texts: the end alone. Very long texts: whole; a batch holds at
    least one text. Repeated rows: each is learnt from and scored. A null id is never held out. Nothing to learn from (an empty table, all rows
    held out): every token has the probability 1. Equal rows score alike. Other columns stay; those of the named ones are replaced.
    """
    docs = bounded_batches(docs)
    model, name = learn(docs, key, text), free_name(docs, "lm")
    marked = docs.withColumns({"held_out": not_learnt(key), "train_tokens": F.lit(model.n_tokens).cast("bigint"), name: scorer(docs.sparkSession, model, text)})
    marked = marked.withColumns({c: F.col(f"{name}.{c}") for c in ("n_tokens", "n_known", "base_score", "score")})
    return marked.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).drop(name)


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``, to six decimal places: later ones depend on the order of a sum."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_scores(docs).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
