"""The Jaccard join against brute force over all pairs."""

import random
import re

from brindle.llm import jaccard_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(k, len(sets[k]), find(k)) for k in keys}


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(30)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "É é x y z"), (8, "é é x y z")]
    hot = [word() for _ in range(60)]
    for i in range(100, 260):  # near copies of one text, from no edit to many
        t = list(hot)
        for _ in range(rng.randint(0, 7)):
            t[rng.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    for i in range(300, 340):  # exact copies
        rows.append((i, " ".join(passage)))
    for i in range(400, 460):  # a common passage among words of their own, short enough that it is most of the text
        rows.append((i, " ".join([*passage, *(word() for _ in range(rng.randint(0, 16)))])))
    for i in range(500, 530):  # chains
        rows.append((i, " ".join(hot[j] + str((i - 500) // 6 if j < 3 * ((i - 500) % 6) else "") for j in range(60))))
    rng.shuffle(rows)
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, n string, rep int").repartition(5)
    got = {tuple(r) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_small_flushes_and_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", 500)
    monkeypatch.setattr(jaccard_join, "SALT_ROWS", 3)
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard_join.near_duplicates(df).collect()} == brute(rows)


def test_edges_of_the_table(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "else"), (2, "q " * 50_000)]
    got = sorted(jaccard_join.near_duplicates(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 1, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (2, 1, 2)]


def test_all_texts_of_a_key_are_linked(spark):
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    near = [t + " end" for t in text]
    # the shorter text of 5 is near that of 3, the longer one near that of 9; without a key: near copies of 7 and of each other
    rows = [(5, text[0]), (5, text[1] + " and more"), (3, near[0]), (9, text[1]), (7, text[2]), (None, near[2]), (None, text[3]), (None, near[3])]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 7), (3, 3), (5, 3), (5, 3), (7, 7), (9, 3)]


def test_threshold_is_exact():
    import numpy as np

    x = np.arange(100, dtype=np.uint64)
    assert jaccard_join.linked(x, x[:75]) and not jaccard_join.linked(x, x[:74])
    assert not jaccard_join.linked(x[:0], x[:0])


def test_a_repeated_key_loses_no_link_of_others(spark):
    a, b = ([f"{c}{i}" for i in range(n)] for c, n in (("a", 300), ("b", 100)))
    near = " ".join([*b[:50], "x", "y", "z", *b[53:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(b)), (3, near)]
    for some in (rows, rows[2:], rows[1:], rows[:1] + rows[2:]):
        got = {(r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert got == {(k, 1 if (1, rows[1][1]) in some or k == 1 else 2) for k, _ in some}


def test_groups_are_opened_by_their_union(spark):
    # two groups that hold much of each other's words, and members that link them
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(i % 6):
            t[rng.randrange(60)] = f"v{rng.randrange(6)}"
        rows.append((i, " ".join(t[i % 7 :])))
    texts = spark.createDataFrame([(i, 1000 + i % 4, len(shingles(t)), t) for i, t in rows], "rep long, grp long, n long, text string")
    sets = {i: shingles(t) for i, t in rows}
    linked = {(a, b) for a in sets for b in sets if a < b and a % 4 != b % 4 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    got = {tuple(r) for r in jaccard_join.across_groups(texts).collect()}
    assert linked and linked <= got
    # no pair of a class with a group whose union holds less than three quarters of it
    union = {g: set().union(*(sets[i] for i in sets if i % 4 == g)) for g in range(4)}
    assert all(4 * len(sets[a] & union[b % 4]) >= 3 * len(sets[a]) for a, b in got)
