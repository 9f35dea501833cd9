"""Language-model scores against a plain count over all texts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from brindle.llm import hash_arrays, lm_scores
from brindle.llm.words import hash_words


def brute(rows):
    """(doc_id, text) -> held_out, n_tokens, n_known, train tokens, base score, score of each row."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    toks = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), "\n"] for _, t in rows]
    one, two = Counter(), Counter()
    for h, w in zip(held, toks, strict=True):
        if not h:
            one.update(w)
            two.update(zip([" ", *w], w, strict=False))
    after, follow = Counter(w for _, w in two), defaultdict(list)
    for (v, _), n in two.items():
        follow[v].append(n)

    def estimate(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        if not all(n):
            return (0.5, 1.0, 1.5)
        y = n[0] / (n[0] + 2 * n[1])
        d = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
        return d if min(d) >= 0 else (0.5, 1.0, 1.5)

    d1, d2 = estimate(list(after.values())), estimate(list(two.values()))
    less = lambda d, n: d[min(n, 3) - 1] if n else 0.0
    total = len(two)
    even = 1 / (len(one) + 1)

    def low(w):
        if not total:
            return even
        return max(after[w] - less(d1, after[w]), 0) / total + sum(less(d1, n) for n in after.values()) / total * even

    def p(v, w):
        if v not in follow:
            return low(w)
        t = sum(follow[v])
        return max(two[v, w] - less(d2, two[v, w]), 0) / t + sum(less(d2, n) for n in follow[v]) / t * low(w)

    n_train = sum(one.values())
    out = []
    for h, w in zip(held, toks, strict=True):
        base = sum(math.log10((one[x] + 1) / (n_train + len(one) + 1)) for x in w)
        out.append((h, len(w), sum(x in one for x in w), n_train, base, sum(math.log10(p(v, x)) for v, x in zip([" ", *w], w, strict=False))))
    return out, p, [*one]


def rows(n=120, seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "Éa", "éa", "x" * 300, "a\x1cb", "1", ",", "tail"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(len(vocabulary))], k=rng.randint(0, 40))) for _ in range(n)]
    return [*enumerate(texts), (500, None), (501, ""), (502, " \n\t "), (None, "no id the of"), (7, "twice the"), (7, "twice the"), (503, "the of " * 4000)]


@pytest.mark.parametrize(("part_bytes", "flush", "hot"), [(1 << 24, 3_000_000, 500_000), (700, 50, 30)])
def test_scores_equal_brute_force(spark, monkeypatch, part_bytes, flush, hot):
    monkeypatch.setattr(lm_scores, "PART_BYTES", part_bytes)
    monkeypatch.setattr(lm_scores, "FLUSH", flush)
    monkeypatch.setattr(lm_scores, "HOT", hot)
    given = rows()
    df = spark.createDataFrame([(i, t, k, "other") for k, (i, t) in enumerate(given)], "doc_id long, text string, k int, score string").repartition(3)
    got = {r.k: r for r in lm_scores.with_scores(df).collect()}
    want, _, _ = brute(given)
    assert len(got) == len(given)
    for k, (held, n, known, train, base, score) in enumerate(want):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-score / n), rel=1e-9)


def test_probabilities_of_all_words_sum_to_one(spark):
    given = rows(60, 3)
    model = lm_scores.learn(spark.createDataFrame(given, "doc_id long, text string"))
    words, pairs = model.open()
    _, p, vocabulary = brute(given)
    for before in ("the", "w3", "tail"):
        assert sum(p(before, w) for w in [*vocabulary, "never seen"]) == pytest.approx(1)
        some = [w for w in vocabulary if w != "\n"] + ["never-seen"]
        v = np.full(len(some) + 1, hash_words([before.encode()]).hashes[0])
        w = np.append(hash_words([" ".join(some).encode()]).hashes, lm_scores.END)
        # as texts of two words of which the second is asked: contexts are given by the token before
        token = np.stack((v, w), axis=1).ravel()
        first = np.stack((np.full(len(v), lm_scores.BEGIN), v), axis=1).ravel()
        _, logs = model.score(first, token, np.arange(0, len(token) + 1, 2), words, pairs)
        assert (10.0 ** logs[1::2]).sum() == pytest.approx(1)


def test_empty_tables_and_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm_scores.with_scores(none).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm_scores.with_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0.0, 0.0)


def test_text_in_a_column_of_another_name(spark):
    given = rows(20)
    df = spark.createDataFrame(given, "id long, body string")
    got = sorted(lm_scores.with_scores(df, "id", "body").select("score").toPandas()["score"])
    want = sorted(x[-1] for x in brute(given)[0])
    assert got == pytest.approx(want)


def test_blocks_of_a_store_that_cannot_be_mapped(tmp_path, monkeypatch):
    monkeypatch.setattr(hash_arrays, "STEP", 8)
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2))
    files = hash_arrays.write_arrays(f"file://{tmp_path}", "t", keys, {"n": np.arange(len(keys)), "m": np.arange(len(keys)) % 7})
    asked = rng.permutation(np.concatenate((keys[::3], keys[::5] + np.uint64(1))))
    for mapped in (True, False):
        if not mapped:
            monkeypatch.setattr(hash_arrays.Part, "_mapped", lambda self, column: None)
        n, m = hash_arrays.HashTable(f"file://{tmp_path}", [("t", len(keys), files)]).look_up(asked, ["n", "m"])
        there = {int(k): i for i, k in enumerate(keys)}
        assert n.tolist() == [there.get(int(k), 0) for k in asked]
        assert m.tolist() == [there.get(int(k), 0) % 7 for k in asked]


def test_discounts():
    assert lm_scores.discounts([10, 5, 0, 1]) == lm_scores.FALLBACK
    assert lm_scores.discounts([10, 1, 1, 1]) == lm_scores.FALLBACK
    assert lm_scores.discounts([100, 40, 20, 10]) == pytest.approx((1 - 0.8 * 100 / 180, 2 - 1.5 * 100 / 180, 3 - 2 * 100 / 180))
