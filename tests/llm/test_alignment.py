"""Alignment of two tokenizers against the libraries on whole texts."""

import hashlib
import random
import re
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brindle.llm import alignment
from brindle.llm.byte_ids import BYTE_CHARS


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def token_bytes(libraries, text):
    a, b = libraries
    back = {v: k for k, v in BYTE_CHARS.items()}
    e = a.encode(" " + text, add_special_tokens=False)
    of_a = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in e.ids]
    of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    return of_a, of_b


def spans(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(libraries, texts):
    """The result of each text, from all its tokens at once."""
    aligned = []
    for text in texts:
        if not text:
            aligned.append(None)
            continue
        of_a, of_b = token_bytes(libraries, text)
        if not b"".join(x for _, x in of_a) == b"".join(x for _, x in of_b) == (" " + text).encode():
            aligned.append(None)
            continue
        sa, sb = spans(of_a), spans(of_b)
        cuts = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups = [([], []) for _ in cuts]
        for side, tokens in ((0, sa), (1, sb)):
            for i, _, e in tokens:
                groups[bisect_left(cuts, e)][side].append(i)
        links, j = [], 0
        for i, s, e in sa:
            while sb[j][2] <= s:
                j += 1
            k = j
            while k < len(sb) and sb[k][1] < e:
                links.append((i, sb[k][0]))
                k += 1
        aligned.append((len(sa), len(sb), groups, links))
    counts = Counter(p for x in aligned if x for p in x[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for x in aligned:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = x
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


ODD = ["", " ", "  ", "\n", " \n", "\n ", "a", "a ", " a", "a  b", "a\nb", "a \nb", "\n\na", "▁", "a▁b c", "<s>x</s> <0x41>", "x<|endoftext|>y", "é😀 漢字", "a\tb\r\nc;\r\n", "a  b  c　 d  e\u0085 f’ g",
       " \x1c a,\x1cb \x00 \x07", "it's we'll  can't", "naïve 1234567 foo_bar()\n\n\n  def x():\r  pass", "x" * 3000, "-" * 500 + " " * 300 + "z", "word " * 800]


def texts(n, seed):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(" \n\tabC▁é.;\r漢'1 \xa0’") if rng.random() < 0.02 else rng.choice(" \n\tabCé.;\r漢'1 the \xa0’") for _ in range(rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_equals_whole_texts(spark, monkeypatch, libraries, small):
    if small:
        for name, value in (("FLUSH", 50), ("PART_BYTES", 5000), ("STRETCHES", 100), ("PART_LINKS", 300), ("PART_PAIRS", 100), ("LOOK_UP", 200)):
            monkeypatch.setattr(alignment, name, value)
    given = [*texts(300, 3), None, "twice the words", "twice the words"]
    df = spark.createDataFrame([(k, t, "n", 1) for k, t in enumerate(given)], "doc_id long, text string, n_a string, links int").repartition(3)
    got = {r.doc_id: r for r in alignment.with_alignment(df).collect()}
    assert len(got) == len(given)
    for k, want in enumerate(brute(libraries, given)):
        assert tuple(got[k][c] for c in (*alignment.TOTALS, "groups_sha256")) == want, repr(given[k])


def test_empty_tables_and_no_usable_text(spark):
    assert alignment.with_alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = alignment.with_alignment(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string")).collect()
    assert {(x.n_a, x.n_links, x.groups_sha256) for x in r} == {(0, 0, "")}


def test_only_one_shuffle_between_tokens_and_links(spark):
    df = spark.createDataFrame([(1, 7, " a b", 1)], "sid long, h long, stretch string, n long")
    plan = alignment.aligned(df, public_tokenizers.path(alignment.A_MODEL), public_tokenizers.path(alignment.B_MODEL))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan.split("== Initial Plan ==")[0])) == 1
