"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from brindle.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, noise):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            if doc is not None and (h := zlib.crc32(f"{doc}:{run}".encode())) % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if k >= 3 and len(w) >= 5}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    root = {}
    for w in words:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def rows(n, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abÉé", k=rng.randint(4, 8))) for _ in range(60)] + ["aaaaa", "aaaaaa", "baaaa", "aabaa", "ÿ×÷ÿÿ"]
    weights = [1 / (i + 1) for i in range(len(stems))]
    texts = [" ".join(rng.choices(stems, weights, k=30)).replace(" ", rng.choice([" ", "1", "\n", "-", "漢"])) for _ in range(n)]
    return [*enumerate(texts), (9000, None), (9001, ""), (None, texts[0]), (None, "chainz " * 3 + "chainy " * 6 + "Chaiyy " * 12), (0, texts[0]), (9002, "x" * 3000 + " " + "x" * 2999 + "y " * 2), (9003, ("x" * 3000 + " ") * 3 + ("x" * 2999 + " ") * 3)]


@pytest.mark.parametrize(("chars", "hot"), [(1_000_000, 20_000), (400, 3)])
def test_variants_equal_all_pairs(spark, monkeypatch, chars, hot):
    monkeypatch.setattr(spelling, "BIN_CHARS", chars)
    monkeypatch.setattr(spelling, "GROUP_MOST", hot)
    monkeypatch.setattr(spelling, "FLUSH", 20)
    given = rows(60, 4)
    df = spark.createDataFrame([(i, t, "other", 1) for i, t in given], "doc_id long, text string, word string, n int").repartition(3)
    got = [tuple(r) for r in spelling.variants(df, noise=7).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = brute(given, 7)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(r[1] is not None for r in want) > 10 and any(r[2] not in (r[0], r[1]) for r in want)


def test_empty_tables(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "few words here")], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 100])
def test_wavelet_tree_reports_rectangles(n):
    rng = np.random.default_rng(n)
    values = rng.permutation(n)
    tree = spelling.WaveletTree(values)
    edges = np.sort(rng.integers(0, n + 1, (200, 2)), axis=1)
    bounds = np.sort(rng.integers(0, n + 1, (200, 2)), axis=1)
    query, value = tree.report(edges[:, 0], edges[:, 1], bounds[:, 0], bounds[:, 1])
    got = sorted(zip(query.tolist(), value.tolist(), strict=True))
    want = sorted((q, int(v)) for q in range(200) for v in values[edges[q, 0] : edges[q, 1]] if bounds[q, 0] <= v < bounds[q, 1])
    assert got == want


def test_pairs_of_one_length_and_the_next():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("ab", k=rng.choice([5, 6]))) for _ in range(90)})
    member = np.array([len(w) == 6 for w in words])
    found = Counter()
    for places in (range(3, 6), range(3)):
        a, b = spelling.near_pairs([w.encode() for w in words], member, 6, places)
        found.update(zip(a.tolist(), b.tolist(), strict=True))
    want = {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if len(y) == 6 and one_edit(x, y)}
    assert set(found) == want and set(found.values()) <= {1}
