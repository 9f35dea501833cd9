"""Token counts, token files and packing against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brindle.llm import byte_ids, packing, token_counts, token_files
from brindle.llm.shared import fresh_folder

ODD = ["", " ", "  ", "\n", " \n", "\n ", "a", "a ", " a", "a  b", "a\nb", "a \nb", "\n\na", "▁", "a▁b", "<s>x</s>", "x<|endoftext|>y", "é😀 漢字", "a\tb\r\nc\r\n", "a b  c", " \x1c a", "it's we'll  can't"]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(" \n\tabC▁é.;\r漢'1") for _ in range(rng.randint(1, 40))) for _ in range(n)] + ["word " * 3000, "x" * 5000]


def docs(spark):
    rows = [(i, t, "lang", 1.0) for i, t in enumerate(texts())] + [(9999, None, None, None), (None, "no id", "x", 0.0), (7, "twice", "y", 2.0), (7, "twice", "y", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, part double"), rows


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_equal_the_library():
    counter = token_counts.WholeTokenCounter(public_tokenizers.path(token_counts.MODEL))
    ts = texts(3000)
    assert [counter.count(t) for t in ts] == [len(x) for x in counter.model.encode(ts)]
    assert counter.count(None) == 0
    assert len(counter.singles) > 10_000  # proved shortcuts


def test_normalisation_is_read_from_the_model():
    counter = token_counts.WholeTokenCounter(public_tokenizers.path(token_counts.MODEL))
    fields = dict(token_counts.proto_fields(counter.model.serialized_model_proto()))
    spec = dict(token_counts.proto_fields(fields[3]))
    assert not spec.get(2) and spec[4] == 0
    # as the specification says, each character stays as it is
    for c in range(0x20, 0x30000, 7):
        if not 0xD800 <= c <= 0xDFFF and chr(c) != token_counts.SPACE:
            assert counter.model.decode(counter.model.encode(f"a{chr(c)}b")) == f"a{chr(c)}b", hex(c)


def test_count_operator_keeps_rows_and_replaces_clashing_names(spark):
    df, rows = docs(spark)
    got = token_counts.with_token_counts(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "text", "n_tokens", "part", "n_bytes", "over_limit"}
    counter = token_counts.WholeTokenCounter(public_tokenizers.path(token_counts.MODEL))
    for r in got:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), counter.count(r.text))
        assert r.over_limit == (r.n_tokens > 4096)
    assert token_counts.with_token_counts(df.limit(0)).count() == 0


def test_ids_equal_the_library(tokenizer):
    encoder = byte_ids.ByteIds(byte_ids.model_path())
    ts = texts(3000)
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(ts, add_special_tokens=False)]
    assert [encoder.encode(t) for t in ts] == want
    assert encoder.encode(None) == b""


def test_token_files_round_trip(spark, tokenizer):
    df, rows = docs(spark)
    folder = fresh_folder(spark, "t")
    got = [tuple(r) for r in token_files.read_token_files(token_files.write_token_files(df, folder), folder).collect()]
    start, want = 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(got, key=key) == want
    named = token_files.read_token_files(token_files.write_token_files(df.withColumnRenamed("doc_id", "name"), again := fresh_folder(spark, "t"), key="name"), again, key="name")
    assert named.columns[0] == "name" and sorted(map(tuple, named.collect()), key=key) == want
    empty = fresh_folder(spark, "t")
    assert token_files.read_token_files(token_files.write_token_files(df.limit(0), empty), empty).count() == 0


def test_packing_is_gapless_whole_and_tight(spark, tokenizer):
    df, rows = docs(spark)
    got = packing.packed(df, capacity=64).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    for doc_id, text, *_ in rows:
        if doc_id == 7:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
        assert all(p.length == 64 for p in pieces[1:])
        for p in pieces:
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    total = sum(r.length for r in got)
    assert len(by_sequence) <= -(-total // 64) * 1.05 + 1
    assert packing.packed(df.limit(0)).count() == 0


def naive_pack(sizes, capacity):
    """Sequences that matching and best fit take, piece by piece."""
    gaps, large = [], sorted(s for s in sizes if 3 * s > capacity)
    while large:
        a = large.pop()
        fits = [i for i, s in enumerate(large) if s <= capacity - a]
        gaps.append(capacity - a - (large.pop(fits[-1]) if fits else 0))
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else capacity) - s)
    return len(gaps)


def test_pack_equals_the_steps_piece_by_piece():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.choice([7, 30, 100, 257])
        sizes = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, 1 + capacity // 4) for _ in range(rng.randint(0, 120))]
        counts = {s: sizes.count(s) for s in set(sizes)}
        assert packing.pack(counts, capacity)[1] == naive_pack(sizes, capacity)


def test_capacity_is_checked(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (0, packing.MOST_CAPACITY):
        with pytest.raises(ValueError):
            packing.packed(df, capacity=bad)


def test_pack_by_counts():
    rng = random.Random(3)
    for _ in range(60):
        capacity = rng.choice([7, 30, 100])
        counts = {s: rng.randint(0, 9) for s in rng.sample(range(1, capacity + 1), min(capacity, rng.randint(1, 25)))}
        runs, sequences = packing.pack(counts, capacity)
        bins: dict[int, list] = {}
        placed = dict.fromkeys(counts, 0)
        for s, lo, hi, side, first, offset in runs:
            assert lo == placed[s]
            placed[s] = hi
            for k in range(hi - lo):
                bins.setdefault(first + k // side, []).append((offset + k % side * s, s))
        assert placed == counts and set(bins) <= set(range(sequences)) and len(bins) == sequences
        for pieces in bins.values():
            end = 0
            for o, s in sorted(pieces):
                assert o == end
                end += s
            assert end <= capacity
    # two large pieces at most share a sequence, and as many are matched as can be
    assert packing.pack({60: 2, 40: 2, 55: 1, 45: 1}, 100)[1] == 3
    with pytest.raises(ValueError):
        packing.pack({101: 1}, 100)


def test_a_worker_forgets_what_other_operators_remember(spark):
    from brindle.llm import shared

    forgotten = []
    shared.remembers("test", lambda: forgotten.append(1))
    shared.working_on("test")
    assert not forgotten
    shared.working_on("another")
    shared.working_on("another")
    assert forgotten == [1]
    del shared._remembered["test"]
    spark.conf.unset(shared.BATCH)
    token_counts.with_token_counts(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert spark.conf.get(shared.BATCH) == shared.BATCH_BYTES  # operators bound their batches, whoever read the table


def test_words_of_letters_go_to_the_model_at_once(tokenizer):
    encoder = byte_ids.ByteIds(byte_ids.model_path())
    for word in ("hello", "Übermäßig", "naïve", "x", "straße" * 9):
        assert encoder.merge(" " + word) == np.array(tokenizer.encode(" " + word, add_special_tokens=False).ids, "<u4").tobytes()
    ts = ["a ßtraße Ⅷ ½x ª x² ʰa", "ɐ ɐb", "\x1fword  xª"]
    assert [encoder.encode(t) for t in ts] == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ts]
