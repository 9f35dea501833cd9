"""Alignment of two tokenizers over whole texts, by relational operations on distinct stretches.

Both tokenizers cut a text before a space or a line feed that follows another character than white space, and what they make of the rest
doesn't depend on what stands before; both facts are proved from the vocabularies when they load. So a text is a row of stretches, and equal
stretches are aligned alike, wherever they stand: the corpus is counted by stretches, and each distinct one is aligned once, weighted by how often it occurs.

The alignment is relational: tokens are posexploded, their lengths are added up by windows into ends, and tokens of both sides that end at the same place meet
by grouping on (stretch, end), which is the equi-join of the two sides, the ends of one side alone included. A place where both end is a cut; running counts
of cuts are the numbers of groups. Between two neighbouring ends exactly one token of each side lies, and two tokens overlap in one such interval, so the rows of ends are
the links, named by the last token of each side at or behind the end: no join of a group with itself. One shuffle by stretch serves all these steps.

Counts of linked id pairs and the best count of each B id are two more groupings. Texts get their results from the rows of their stretches, which lie in
sorted hash arrays that workers map into memory: rows of all occurrences are never shuffled. Stretches are told apart by 64-bit hashes there.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.byte_ids import BYTE_CHARS
from brindle.llm.hash_arrays import HashTable, part_of, write_arrays, write_blob
from brindle.llm.shared import bounded_batches, free_name, fresh_folder, remembers, table, working_on, written
from brindle.llm.token_counts import proto_fields
from brindle.llm.words import chunks, hash_runs

A_MODEL, B_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
#: Stretches that a task counts before it passes them on; bytes of text for each part of the count; stretches of a task of the alignment; links of a part
#: of the arrays; pairs of one.
FLUSH, PART_BYTES, STRETCHES, PART_LINKS, PART_PAIRS = 1_000_000, 16 << 20, 100_000, 1_000_000, 4_000_000
#: Bytes of texts that are looked up at once.
LOOK_UP = 4 << 20

TOTALS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_RESULT = [*((c, pa.int64()) for c in TOTALS), ("groups_sha256", pa.string())]


def stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with a space before each, laid end to end; where their stretches begin, and which of these begins each text (and the end)."""
    data = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts]))).astype(np.int64)
    spots = np.flatnonzero((data == 0x20) | (data == 0x0A))
    p1, p2, p3 = (data[np.maximum(spots - k, 0)] for k in (1, 2, 3))
    # white space of more than one byte: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    wide = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0)) | (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80) | (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
    wide |= (p3 == 0xE2) & ((p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF)) | (p2 == 0x81) & (p1 == 0x9F))
    first = np.union1d(spots[(p1 > 0x20) & ~wide & (spots > 0)], starts[:-1])
    return data, first, np.searchsorted(first, starts)


@cache
def _models(a_path: str, b_path: str):
    """Both tokenizers, and the bytes of A's characters; refuses those whose texts can't be cut into stretches."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the threads
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    if a.normalizer is not None or type(a.pre_tokenizer).__name__ != "ByteLevel" or a.pre_tokenizer.add_prefix_space:
        raise ValueError("tokenizer A isn't plain byte-level: texts can't be cut before spaces")
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size()) if not (b.is_control(i) or b.is_unknown(i) or b.is_byte(i) or b.is_unused(i))]
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) or sum(map(b.is_byte, range(b.get_piece_size()))) != 256:
        raise ValueError("a piece of tokenizer B crosses a space or a line feed, or it has no pieces for single bytes")
    spec = dict(proto_fields(dict(proto_fields(b.serialized_model_proto())).get(3, b"")))
    if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
        raise ValueError("tokenizer B normalises texts")
    letters = {v: k for k, v in BYTE_CHARS.items()}
    a_sizes = np.zeros(a.get_vocab_size(with_added_tokens=True), np.int32)
    for piece, i in a.get_vocab(with_added_tokens=True).items():
        a_sizes[i] = len(piece) if all(c in letters for c in piece) else len(piece.encode())
    b_sizes = np.array([1 if b.is_byte(i) else len(b.id_to_piece(i).replace(SPACE, " ").encode()) for i in range(b.get_piece_size())], np.int32)
    remembers("alignment_tokens", _models.cache_clear)
    return a, b, a_sizes, b_sizes


def tokenized(texts: list[str], a_path: str, b_path: str) -> pa.Array:
    """Per stretch its tokens in order, first A's, then B's: side, id, size in bytes."""
    a, b, a_sizes, b_sizes = _models(a_path, b_path)
    of_a = [e.ids for e in a.encode_batch_fast(texts, add_special_tokens=False)]
    # B puts a space before what it is given, if that is anything; before a line feed the space is a token of its own
    lone = b.piece_to_id(SPACE)
    given = b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
    of_b = [[lone] if t == " " else ids if t[0] == " " else ids[1:] for t, ids in zip(texts, given, strict=True)]
    many = np.array([[len(x), len(y)] for x, y in zip(of_a, of_b, strict=True)], np.int64).reshape(-1, 2)
    ids = np.array([i for x, y in zip(of_a, of_b, strict=True) for i in (*x, *y)], np.int32)
    side = np.repeat(np.tile(np.array([0, 1], np.int32), len(texts)), many.ravel())
    sizes = np.where(side == 0, a_sizes[np.where(side == 0, ids, 0)], b_sizes[np.where(side == 1, ids, 0)])
    offsets = np.concatenate(([0], np.cumsum(many.sum(axis=1)))).astype(np.int32)
    whole = np.array([len(t.encode()) for t in texts])
    for s in (0, 1):
        sums = np.concatenate(([0], np.cumsum(np.where(side == s, sizes, 0))))
        if (sums[offsets[1:]] - sums[offsets[:-1]] != whole).any():
            raise ValueError("tokens don't add up to their text")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(side), pa.array(ids), pa.array(sizes.astype(np.int32))], ["side", "id", "size"]))


def usable(text: Column) -> Column:
    """Whether the joined tokens are the text: B writes U+2581 as a space; all other characters come back, by pieces or by bytes."""
    return F.coalesce((F.length(text) > 0) & ~F.contains(text, F.lit(SPACE)), F.lit(False))


_PACKED = pa.schema([("part", pa.int64()), ("h", pa.binary()), ("n", pa.binary()), ("size", pa.binary()), ("text", pa.binary())])


def distinct_stretches(docs: DataFrame, text: str = "text") -> DataFrame:
    """(sid, h, stretch, n): the distinct stretches of all usable texts, their hashes, and how often they occur; written.

    A task counts about ``FLUSH`` stretches at a time and packs the distinct ones by ranges of their hashes; a part adds its range up.
    """
    rows = bounded_batches(docs).where(usable(F.col(text))).select(F.col(text))
    parts = (rows.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0) // PART_BYTES + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("alignment")
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]] = []

        def out() -> Iterator[pa.RecordBatch]:
            h, n, size, at, whole = _added(held)
            part = part_of(h, parts).astype(np.int64)
            edges = np.searchsorted(part, np.unique(part)).tolist() + [len(h)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                shown = b"".join([whole[a : a + s] for a, s in zip(at[i:j].tolist(), size[i:j].tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((int(part[i]), h[i:j].tobytes(), n[i:j].tobytes(), size[i:j].tobytes(), shown), _PACKED, strict=True)], schema=_PACKED)
            held.clear()

        n_held = 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for s in chunks(texts):
                data, first, _ = stretches(texts[s])
                last = np.append(first[1:], len(data))
                keys, at, n = np.unique(hash_runs(data, first, last), return_index=True, return_counts=True)
                size, whole = (last - first)[at], data.tobytes()
                held.append((keys, n, size, b"".join([whole[a : a + z] for a, z in zip(first[at].tolist(), size.tolist(), strict=True)])))
                n_held += len(keys)
            if n_held >= FLUSH:
                yield from out()
                n_held = 0
        if held:
            yield from out()

    def add(group: pa.Table) -> pa.Table:
        flat = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in group[c]]
        h, n, size, at, whole = _added(list(zip(flat("h", "<u8"), flat("n", "<i8"), flat("size", "<i8"), [x.as_py() for x in group["text"]], strict=True)))
        shown = [whole[a : a + z] for a, z in zip(at.tolist(), size.tolist(), strict=True)]
        return pa.table({"h": pa.array(h.view("<i8")), "stretch": pa.array(shown, pa.binary()).cast(pa.string()), "n": pa.array(n)})

    packed = rows.mapInArrow(count, "part bigint, h binary, n binary, size binary, text binary")
    found = packed.groupBy("part").applyInArrow(add, "h bigint, stretch string, n bigint")
    return written(found.withColumn("sid", F.monotonically_increasing_id()), "stretches")


def _added(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Counts of the distinct hashes of all tables (hash, n, size, texts), with the size of each text and where one lies in all texts."""
    h, n, size = (np.concatenate([x[i] for x in held]) for i in range(3))
    at = np.cumsum(size) - size
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n[order], first), size[order[first]], at[order[first]], b"".join([x[3] for x in held])


def aligned(distinct: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(h, n, links) of :func:`distinct_stretches`: links in order from the last, each with both ids, whether each token ends there, and the number of its group."""

    @F.arrow_udf("array<struct<side: int, id: int, size: int>>")
    def tokens(texts: pa.Array) -> pa.Array:
        working_on("alignment_tokens")
        return tokenized(texts.to_pylist(), a_path, b_path)

    parts = max(distinct.sparkSession.sparkContext.defaultParallelism, distinct.count() // STRETCHES + 1)
    split = bounded_batches(distinct).withColumn("tokens", tokens("stretch")).select("sid", "h", "n", F.octet_length("stretch").alias("whole"), "tokens").repartition(parts, "sid")
    rows = split.select("sid", "h", "n", "whole", F.posexplode("tokens").alias("pos", "t")).select("sid", "h", "n", "whole", "pos", "t.side", "t.id", "t.size")
    # A's tokens come first and add up to the stretch
    end = F.sum("size").over(Window.partitionBy("sid").orderBy("pos")) - F.when(F.col("side") == 1, F.col("whole")).otherwise(0)
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("id")))
    met = rows.withColumn("end", end).groupBy("sid", "end").agg(of(0).alias("ends_a"), of(1).alias("ends_b"), F.first("h").alias("h"), F.first("n").alias("n"))
    back = Window.partitionBy("sid").orderBy(F.col("end").desc())
    a_ends, b_ends = F.col("ends_a").isNotNull(), F.col("ends_b").isNotNull()
    named = met.select(
        "sid", "h", "n", F.last("ends_a", ignorenulls=True).over(back).alias("a"), F.last("ends_b", ignorenulls=True).over(back).alias("b"),
        a_ends.alias("a_ends"), b_ends.alias("b_ends"), F.sum((a_ends & b_ends).cast("int")).over(back).cast("int").alias("group"),
    )
    return named.mapInArrow(_one_row_a_stretch, f"h bigint, n bigint, links {_LINKS}")


_LINKS = "array<struct<a: int, b: int, a_ends: boolean, b_ends: boolean, group: int>>"


def _one_row_a_stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a stretch, which come one after the other, as one row with a list."""
    kept: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        kept = now.combine_chunks()
        if not len(kept):
            continue
        sid = kept["sid"].to_numpy()
        at = int(np.searchsorted(sid[::-1] != sid[-1], True))  # rows of the last stretch, of which more may come
        if at < len(sid):
            yield _lists(kept.slice(0, len(sid) - at))
            kept = kept.slice(len(sid) - at)
    if kept is not None and len(kept):
        yield _lists(kept)


def _lists(rows: pa.Table) -> pa.RecordBatch:
    sid = rows["sid"].to_numpy()
    first = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1])))
    flat = [rows[c].combine_chunks() for c in ("a", "b", "a_ends", "b_ends", "group")]
    flat = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in flat]
    links = pa.ListArray.from_arrays(pa.array(np.append(first, len(sid)).astype(np.int32)), pa.StructArray.from_arrays(flat, ["a", "b", "a_ends", "b_ends", "group"]))
    return pa.RecordBatch.from_arrays([pa.array(rows["h"].to_numpy()[first]), pa.array(rows["n"].to_numpy()[first]), links], ["h", "n", "links"])


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links hold each pair of ids, over all stretches with their numbers, and whether no other pair of that b has more."""
    counted = links.select("n", F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.sum("n").alias("n"))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def _pair_part(a, b, parts: int):
    return (a * 31 + b) % parts


def _pair_arrays(pairs: DataFrame, folder: str) -> list[tuple[str, int, list[str]]]:
    parts = pairs.count() // PART_PAIRS + 1

    def write(group: pa.Table) -> pa.Table:
        a, b, n, best, part = (group[c].to_numpy() for c in ("a", "b", "n", "best", "part"))
        order = np.lexsort((b, a))
        name = f"pairs-{int(part[0]):05d}"
        files = write_arrays(folder, name, _pair_key(a, b)[order], {"n": n[order], "best": best[order].astype(np.int64)})
        return pa.table({"part": [int(part[0])], "name": [name], "size": [len(a)], "files": [files]}, _FILES)

    dealt = pairs.withColumn("part", _pair_part(F.col("a").cast("bigint"), F.col("b"), parts))
    return _in_order(dealt.groupBy("part").applyInArrow(write, _FILES_DDL), parts)


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)


_FILES_DDL = "part bigint, name string, size bigint, files array<string>"
_FILES = pa.schema([("part", pa.int64()), ("name", pa.string()), ("size", pa.int64()), ("files", pa.list_(pa.string()))])


def _in_order(made: DataFrame, parts: int) -> list[tuple[str, int, list[str]]]:
    found = {r["part"]: (r["name"], r["size"], list(r["files"])) for r in made.collect()}
    return [found.get(p, ("", 0, [])) for p in range(parts)]


def _stretch_arrays(links: DataFrame, folder: str, pairs: list[tuple[str, int, list[str]]]) -> list[tuple[str, int, list[str]]]:
    """Each stretch's totals and groups, sorted by its hash."""
    n_links = links.agg(F.sum(F.size("links").cast("bigint"))).first()[0] or 0
    parts = n_links // PART_LINKS + 1
    known = links.sparkSession.sparkContext.broadcast(pairs)

    def write(group: pa.Table) -> pa.Table:
        working_on("alignment")
        part = int(group["part"][0].as_py())
        h = group["h"].to_numpy().view(np.uint64)
        lists = group["links"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        offsets, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
        # the links of all stretches backwards are each stretch's forwards
        a, b, a_ends, b_ends, number = (flat.field(c).to_numpy(zero_copy_only=False)[::-1] for c in ("a", "b", "a_ends", "b_ends", "group"))
        h, offsets = h[::-1], len(flat) - offsets[::-1]
        n, best = HashTable(folder, known.value).look_up(_pair_key(a, b), ["n", "best"], _pair_part(a.astype(np.int64), b, len(known.value)))
        begin = offsets[:-1]
        sums = {c: np.add.reduceat(v.astype(np.int64), begin) for c, v in (("n_a", a_ends), ("n_b", b_ends), ("n_best", best), ("count_sum", n))}
        texts = group_texts(a, b, a_ends, b_ends, number, begin)
        size = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(h)
        order = order[np.concatenate(([True], h[order][1:] != h[order][:-1]))]
        columns = {c: v[order] for c, v in (sums | {"n_groups": number[begin].astype(np.int64), "n_links": np.diff(offsets).astype(np.int64)}).items()}
        name = f"stretches-{part:05d}"
        write_blob(folder, name, "text", b"".join(texts[i] for i in order))
        files = write_arrays(folder, name, h[order], columns | {"size": size[order], "at": np.cumsum(size[order]) - size[order]})
        return pa.table({"part": [part], "name": [name], "size": [len(order)], "files": [files]}, _FILES)

    by_hash = F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(parts).cast("bigint"), 32)
    return _in_order(links.select("h", "links", by_hash.alias("part")).groupBy("part").applyInArrow(write, _FILES_DDL), parts)


def group_texts(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, number: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """Each stretch's groups, 'a1,a2|b1;a3|b2': of each group the ids of the tokens that end in it."""
    last = np.ones(len(a), bool)  # of its group: the next link has another number or is of another stretch
    last[:-1] = number[1:] != number[:-1]
    last[begin[1:] - 1] = True
    found, left, right = [], [], []
    at = []
    for x, y, x_ends, y_ends, done in zip(a.tolist(), b.tolist(), a_ends.tolist(), b_ends.tolist(), last.tolist(), strict=True):
        if x_ends:
            left.append(x)
        if y_ends:
            right.append(y)
        if done:
            found.append(f"{','.join(map(str, left))}|{','.join(map(str, right))}")
            left, right = [], []
    at = np.concatenate(([0], np.cumsum(last)))[np.append(begin, len(a))].tolist()
    return [";".join(found[i:j]).encode() for i, j in zip(at[:-1], at[1:], strict=True)]


def with_alignment(docs: DataFrame, text: str = "text", a_model: str | None = None, b_model: str | None = None) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of A's tokens of a space and the text and B's of the text.

    Groups lie between neighbouring places where tokens of both end; links are pairs of occurrences whose bytes overlap; the count of an id pair
    is over the links of all rows. Null and empty texts, and those whose joined tokens differ from them (they hold U+2581), have no tokens:
    zeros and ''. Very long texts: whole; a batch holds at least one, a stretch is aligned as a whole. Ties of the best count: all. Repeated rows:
    each counts. An empty table: no rows. Other columns stay; those of the names are replaced.
    """
    spark = docs.sparkSession
    a_path, b_path = a_model or public_tokenizers.path(A_MODEL), b_model or public_tokenizers.path(B_MODEL)
    folder = fresh_folder(spark, "alignment-arrays")
    links = written(aligned(distinct_stretches(docs, text), a_path, b_path), "alignment-links")
    pairs = _pair_arrays(written(pair_counts(links), "alignment-pairs"), folder)
    sent = spark.sparkContext.broadcast(_stretch_arrays(links, folder, pairs))

    @F.arrow_udf("struct<" + ", ".join(f"{c}: {'string' if t == pa.string() else 'bigint'}" for c, t in _RESULT) + ">")
    def look_up(texts: pa.Array) -> pa.Array:
        working_on("alignment")
        known = HashTable(folder, sent.value)
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        out: list[list] = [[0] * len(raw) if t == pa.int64() else [""] * len(raw) for _, t in _RESULT]
        use = [i for i, t in enumerate(raw) if t]
        for s in chunks([raw[i] for i in use], LOOK_UP):
            rows = use[s]
            data, first, of = stretches([raw[i] for i in rows])
            keys, back = np.unique(hash_runs(data, first, np.append(first[1:], len(data))), return_inverse=True)
            values, shown = known.look_up_with(keys, list(TOTALS), "text")
            for c, v in enumerate(values):
                for i, total in zip(rows, np.add.reduceat(v[back], of[:-1]).tolist(), strict=True):
                    out[c][i] = total
            back = back.tolist()
            for i, a, b in zip(rows, of[:-1].tolist(), of[1:].tolist(), strict=True):
                out[-1][i] = hashlib.sha256(b";".join([shown[k] for k in back[a:b]])).hexdigest()
        return pa.StructArray.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, _RESULT, strict=True)], [c for c, _ in _RESULT])

    name = free_name(docs, "alignment")
    marked = bounded_batches(docs).withColumn(name, look_up(F.when(usable(F.col(text)), F.col(text)).otherwise("")))
    return marked.withColumns({c: F.col(f"{name}.{c}") for c, _ in _RESULT}).drop(name)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of two tokenizers over every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_alignment(docs).select("doc_id", *(c for c, _ in _RESULT))
