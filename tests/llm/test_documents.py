"""WARC, fingerprints, licenses, decontamination, language and quality on small tables."""

import base64
import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontaminate, fingerprints, language, licenses, quality, warc
from brindle.llm.shared import fresh_folder, held_out

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


# ---- WARC -------------------------------------------------------------------------------------


def archive(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, offset int")
    folder = fresh_folder(spark, "w")
    return warc.write_archives(df, folder, **options), folder


def test_warc_round_trip_and_revisits(spark):
    rows = [(3, "u3", "aé", 0), (1, "u1", "aé", 0), (2, None, None, 0), (5, "x", "", 0), (None, "n", "aé", 0), (7, "u", "zz", 0), (7, "u", "zz", 0), (7, "u", "yy", 0), (9, "a\r\nb", "q" * 200_000, 0)]
    index, folder = archive(spark, rows)
    got = warc.read_records(index, folder).collect()
    assert sorted((r.payload_bytes, r.payload_digest) for r in got) == sorted(
        (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for _, _, h, _ in rows
    )
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 1), (1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "revisit", 2), (7, "response", None), (7, "response", None), (7, "revisit", 7), (9, "response", None)]
    by = {r.page_id: r for r in got}
    assert by[1].payload.decode() == "aé" and by[3].payload is None and by[2].url is None
    # chosen records only
    some = warc.read_records(index.where("page_id in (1, 9)"), folder).collect()
    assert sorted(r.page_id for r in some) == [1, 9]


def test_warc_least_size_and_empty_table(spark):
    index, folder = archive(spark, [(1, "a", "x", 0), (2, "a", "x", 0), (3, "a", "long", 0), (4, "a", "long", 0)], min_bytes=2)
    assert sorted((r.page_id, r.record_type) for r in warc.read_records(index, folder).collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    index, folder = archive(spark, [])
    assert warc.read_records(index, folder).count() == 0


def test_pages_of_a_hot_payload_are_spread(spark):
    rows = spark.range(40_000).selectExpr("id as page_id", "if(id % 3 = 0, 'same', concat('p', id)) as html")
    got = warc.revisits(rows)
    assert got.count() == 13_334 and got.where("refers_to <> 0").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(?:Join|JoinExec) \[(.*?)\]", plan)
    assert joins and all("salt" in j for j in joins)  # never by the payload alone
    sizes = got.join(rows, "page_id").groupBy(F.pmod(F.xxhash64("page_id"), F.lit(warc.SALTS))).count().collect()
    assert len(sizes) == warc.SALTS and max(r["count"] for r in sizes) < 13_334 / 32


def test_ranges_are_coalesced():
    assert list(warc.coalesced([(0, 10), (10, 5), (100, 5), (105, 1)], gap=8, most=50)) == [[(0, 10), (10, 5)], [(100, 5), (105, 1)]]
    assert list(warc.coalesced([(0, 30), (30, 30)], gap=8, most=50)) == [[(0, 30)], [(30, 30)]]


def test_damaged_payload_is_found():
    raw = warc.build_record(1, "u", b"abc", warc.sha1_base32(b"abc"), None, False, 0)
    assert warc.parse_record(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"abc", b"abd"))


# ---- fingerprints -----------------------------------------------------------------------------


def test_fingerprints_and_edited_texts(spark):
    rng = random.Random(2)
    words = ["alpha", "béta", "gamma.", "delta,", "x\n", "\n\n", "éé", "q|", "zeta"]
    texts = [None, "", "a", "\n\n\n", "😀😀b", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, next string").repartition(4)
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    order = sorted(rows, reverse=True)
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_edited == 1.0 or t != edited
        assert r.near_next == like(r.fingerprint, got[order[(i + 1) % len(order)][0]].fingerprint)
        assert r.near_edited == like(r.fingerprint, r.edited_fingerprint)
    assert len({r.fingerprint for r in got.values()}) == len({t or "" for t in texts})


def like(a, b):
    """Likeness read off two fingerprints by hand."""
    x, y = (set(re.findall(r"(?<=[~.])[0-9a-f]{8}", f)) for f in (a, b))
    if a[:64] == b[:64]:
        return 1.0
    return 2.0 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def test_fingerprint_edge_cases(spark):
    schema = "doc_id long, text string"
    assert fingerprints.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = fingerprints.fingerprints(spark.createDataFrame([(5, "only one here")], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0  # it follows itself
    rows = [(1, "same text"), (1, "same text"), (None, "no id"), (2, "w " * 100_000)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "None"]


def test_edits_are_located(spark):
    from pyspark.sql import functions as F

    a = "one two\nthree four\n\nfive six\nseven\n\nlast"
    b = "one two\nthree FOUR\n\nfive six\nseven\n\nlast"
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(F.col("a")).alias("a"), fingerprint_b().alias("b"))
    got = row.select(fingerprints.edits(F.col("a"), F.col("b")).alias("e"), fingerprints.likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert [tuple(e) for e in got.e] == [(0, 1)] and 0.5 < got.l < 1


def fingerprint_b():
    from pyspark.sql import functions as F

    return fingerprints.fingerprint(F.col("b"))


def test_changed_paragraphs_are_counted(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["one ", "two. ", "three", "\n", "\n", "\n\n"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        half = len(t) // 2
        edited = t[: len(t) - half] + rows[(i - 1) % len(rows)][1][:half]
        there = {p for s in edited.split("\n\n") for p in s.split("\n")}
        expected = {p for s in t.split("\n\n") if s not in edited.split("\n\n") for p in s.split("\n")} - there
        assert got[i].n_changed == len(expected)


def test_leaves_are_under_their_paragraph(spark):
    from pyspark.sql import functions as F

    p = "one two three four five, six"
    fp = spark.range(1).select(fingerprints.fingerprint(F.lit(p)).alias("f")).first().f
    leaves = re.search("~(.*)$", fp)[1]
    assert fp.split(";")[1].split("=")[1][: fingerprints.NODE] == hashlib.sha256(f"{leaves}~{p}".encode()).hexdigest()[: fingerprints.NODE]


def test_fingerprints_run_no_python(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    plan = fingerprints.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- licenses ---------------------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    texts = [
        None, "", "...", "Released under the MIT License.", "under the mit license under the MIT-license", "apache\nlicense, version 2", "CC BY-NC 4.0 cc by nc",
        "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under GNU General Public License version 3", "the license of mit",
        "Licensed under CC BY 4.0.", "mit " * 30_000, "é under the mit license é", "x\n\nReleased under\nthe MIT License.\n\ny", "Licensed under the Apache License, Version 2.0.",
    ]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert [got[i].labels for i in (3, 7, 8, 9, 10, 13)] == ["mit", "gpl-3", "gpl-3", "", "cc-by", "mit"]
    assert licenses.license_scan(df.limit(0)).count() == 0


def brute_labels(text):
    """Labels and largest share by the definition: all windows, one for each last word, then best first by matched words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = []
    for k, (t, label) in enumerate(licenses.TEMPLATES):
        needed = re.findall(r"[0-9a-z]+", t.lower())
        size, window = len(set(needed)), math.ceil(licenses.WINDOW * len(needed))
        pairs = Counter(zip(needed, needed[1:], strict=False))
        if len(set(words) & set(needed)) < licenses.CONTAINMENT * size - 1e-9:
            continue
        for e, w in enumerate(words):
            if w not in needed:
                continue
            best = None
            for s in range(e, max(-1, e - window), -1):
                if words[s] not in needed:
                    continue
                hits = len(set(words[s : e + 1]) & set(needed))
                known = [w for w in words[s : e + 1] if w in needed]
                turns = sum(len(needed) - 1 - needed[::-1].index(y) <= needed.index(x) for x, y in zip(known, known[1:], strict=False))
                common = (Counter(known) & Counter(needed)).total() + 2 * (pairs & Counter(zip(words[s:e], words[s + 1 : e + 1], strict=True))).total()
                like = 2 * common / (3 * len(needed) - 2 + 3 * (e - s + 1 + licenses.TURN * turns) - 2)
                if hits / size >= licenses.CONTAINMENT - 1e-12 and (best is None or like > best[0]):
                    best = (like, hits / size, {i for i in range(s, e + 1) if words[i] in needed})
            if best:
                found.append(((-best[0], -size, k, e), label, best[1], best[2]))
    taken, labels, share = set(), set(), 0.0
    for _, label, mine, spots in sorted(found, key=lambda x: x[0]):
        if 2 * len(spots & taken) < len(spots):
            taken |= spots
            labels.add(label)
            share = max(share, mine)
    return labels, share


def test_license_join_equals_brute_force(monkeypatch):
    rng = random.Random(4)
    pool = ["licensed", "under", "the", "license", "mit", "apache", "version", "2", "0", "gnu", "public", "general", "cc", "by", "nc", "4", "zz", "yy"]
    blocks = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) for _ in range(700)]
    short = [t for t, _ in licenses.TEMPLATES if len(t) < 100]
    for _ in range(300):  # notices one after the other, some of their words changed, over lines and paragraphs
        text = rng.choice([" ", "\n", "\n\n"]).join(rng.choice(short) for _ in range(rng.randint(1, 4))).split(" ")
        blocks.append(" ".join(rng.choice(pool) if rng.random() < 0.06 else w for w in text))
    df = {int(w): rng.randint(0, 50) for b in pool for w in licenses.words_of(b)}
    wanted = [brute_labels(block) for block in blocks]
    for cells in (licenses.CELLS, 40):
        monkeypatch.setattr(licenses, "CELLS", cells)
        scan = licenses.LicenseScan(df)
        for block, found, (labels, share) in zip(blocks, scan.scan([b.encode() for b in blocks]), wanted, strict=True):
            assert set(found.labels) == labels | set(found.base_labels), block
            assert found.score == pytest.approx(1.0 if found.n_base else share), block


def test_whole_licenses_and_long_texts():
    scan = licenses.LicenseScan({})
    for text, label in licenses.TEMPLATES:
        (found,) = scan.scan([f"zz yy.\n\n{text}\n\nxx".encode()])
        assert label in found.labels and found.score == 1.0
    split = "Released\n\nunder the\n\nMIT License."
    began = time.time()
    (found,) = scan.scan([("some line of text\n" * 50 + f"{split} x x x x x {MPL}\n" + "mit license\n").encode() * 2000])
    assert found.labels == ["mit", "mpl-2"] and found.n_base == 2000
    assert time.time() - began < 10  # linear in the lines


GPL3, GPL2, LGPL3 = (f"This work is licensed under the GNU {n} Public License, version {v}." for n, v in (("General", 3), ("General", 2), ("Lesser General", 3)))
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
BY, SA = "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0."


def test_every_notice_of_a_block(spark):
    cases = [
        (f"{GPL3} {MPL}", "gpl-3,mpl-2"), (f"{MPL} {GPL3}", "gpl-3,mpl-2"), (f"{BY} {SA}", "cc-by,cc-by-sa"), (f"{SA} {BY} {SA}", "cc-by,cc-by-sa"),
        (f"{GPL2} {LGPL3}", "gpl-2,lgpl-3"), (f"{LGPL3}\n{GPL2}", "gpl-2,lgpl-3"), (f"{LGPL3} {GPL2}", "gpl-2,lgpl-3"),
        # one notice stays one: what it contains belongs to it
        (SA, "cc-by-sa"), (LGPL3, "lgpl-3"), (GPL2, "gpl-2"), ("Licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa"), (f"{SA} {SA}", "cc-by-sa"), ("zz " * 5000, ""), (None, ""),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.license_scan(df).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(cases)] == cases


def test_damaged_notices_side_by_side_keep_their_labels():
    rng = random.Random(6)
    short = [t for t, _ in licenses.TEMPLATES if len(t.split()) < 30]

    def damaged(t):
        w = t.split()
        del w[rng.randrange(len(w))]
        return " ".join(w)

    pairs = [(damaged(rng.choice(short)), damaged(rng.choice(short))) for _ in range(3000)]
    scan = licenses.LicenseScan({})
    of = lambda texts: [set(f.labels) for f in scan.scan([t.encode() for t in texts])]
    left, right, both = of([a for a, _ in pairs]), of([b for _, b in pairs]), of([f"{a} {b}" for a, b in pairs])
    lost = [(p, x | y, z) for p, x, y, z in zip(pairs, left, right, both, strict=True) if not x | y <= z]
    assert not lost, (len(lost), lost[:5])


def test_damaged_notices_over_a_blank_line():
    mit = "Permission hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    by = "This work is licensed under a Creative Attribution 4.0 International License."
    affero = "This work is licensed under the GNU Affero General Public License, 3."
    lesser = "This work licensed under the GNU Lesser General Public License, version 3."
    scan = licenses.LicenseScan({})
    for between in (" ", "\n", "\n\n", " other words "):
        a, b = scan.scan([f"{x}{between}{y}".encode() for x, y in ((mit, by), (affero, lesser))])
        assert a.labels == ["cc-by", "mit"] and b.labels == ["agpl-3", "lgpl-3"], between


# ---- decontamination --------------------------------------------------------------------------

ITEM = " ".join(f"word{i}" for i in range(20))


def test_leaks_whole_reordered_and_partial(spark):
    w = ITEM.split()
    texts = [f"some junk {ITEM.upper()}, more", " ".join(w[10:] + ["zz"] + w[:10]), " ".join(w[:9]), None, "", "q a B, c! r", " ".join(w[:12]) + " x " + " ".join(w[14:]), "z " * 50_000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(0, texts[0], 7), (None, texts[0], 7)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "a b c"), (3, None), (4, "..."), (None, "zz")], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.coverage) for r in got) == [("0", 1, 1.0), ("0", 1, 1.0), ("1", 1, 1.0), ("5", 2, 1.0), ("6", 1, 0.9), ("None", 1, 1.0)]
    kept = decontaminate.clean(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7] and kept.columns == docs.columns
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), bench).count() == 0


def test_items_without_an_id_are_cleaned(spark):
    docs = spark.createDataFrame([(1, f"x {ITEM} y"), (2, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, ITEM), (None, "other item"), (3, "a b c")], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [2]


def test_items_without_an_id_are_reported_on_request(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"x {ITEM} y other item"), (2, "nothing of it"), (3, f"a b c {ITEM}")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, ITEM), (None, ITEM), (None, "other item"), (3, "a b c"), (None, None)], "item_id long, text string")
    for limit in (decontaminate.BLOCK_BYTES, 10):  # sent to the tasks, and partitioned
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        got = decontaminate.contaminated(docs, bench, nameless=True)
        assert sorted((r.doc_id, str(r.item_id), r.words) for r in got.collect()) == [(1, "None", 2), (1, "None", 20), (3, "3", 3), (3, "None", 20)]
        assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(3, 3)]


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randint(0, 200)}" for _ in range(rng.randint(3, 30)))) for i in range(40)]
    docs = spark.createDataFrame([(i, "x " + items[i][1] + " y " + items[-i][1]) for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)
    assert sorted(tuple(r) for r in decontaminate.contaminated(docs, bench).collect()) == one and len(one) >= 39


def naive_tiles(a, b, least):
    """Greedy string tiling as it is defined: the longest match of unmarked words again and again, ties to the earliest."""
    fa, fb, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return tiles
        for x in range(k):
            fa[i + x] = fb[j + x] = False
        tiles.append((i, j, k))


def test_tiling_equals_the_definition(monkeypatch):
    rng = random.Random(8)
    for n in range(300):
        monkeypatch.setattr(decontaminate, "CELLS", 1 << 20 if n % 2 else 3)
        letters = rng.choice([1, 2, 4])
        a = np.array([rng.randint(10, 9 + letters) for _ in range(rng.randint(1, 25))], np.uint64)
        b = np.array([rng.randint(10, 9 + letters) for _ in range(rng.randint(1, 40))], np.uint64)
        assert decontaminate.tile(a, b, least=3, first=6) == naive_tiles(list(a), list(b), 3)


def test_repeated_words_are_tiled_in_little_memory():
    began = time.time()
    tracemalloc.start()
    assert decontaminate.tile(np.full(100, 7, np.uint64), np.full(16_000, 7, np.uint64)) == [(0, 0, 100)]
    phrase = np.arange(10, 30, dtype=np.uint64)
    assert sum(t[2] for t in decontaminate.tile(np.tile(phrase, 5), np.tile(phrase, 1000))) == 100
    assert tracemalloc.get_traced_memory()[1] < 64 << 20 and time.time() - began < 5
    tracemalloc.stop()


def leaking_corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    common = [word() for _ in range(9)]  # a phrase that all items have
    items = [(i, " ".join([*common, *(word() for _ in range(rng.randint(2, 30)))] if i % 3 else [word() for _ in range(rng.randint(1, 8))])) for i in range(60)]
    items += [(i + 100, items[i][1]) for i in range(5)] + [(None, "nameless item of words"), (7, "a second text of seven")]
    docs = []
    for i in range(80):
        parts = [word() for _ in range(rng.randint(0, 30))] + common * rng.randint(0, 2)
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            cut = rng.randint(0, len(w))
            parts += [*w[cut:], word(), *w[:cut]]  # moved around
        docs.append((i, " ".join(parts)))
    return docs + [(500, docs[3][1]), (501, None), (502, "")], items


def brute_leaks(docs, items):
    found = set()
    for i, t in docs:
        b = re.findall(r"\w+", (t or "").lower())
        for k, u in items:
            a = re.findall(r"\w+", u.lower())
            tiles = naive_tiles(a, b, min(decontaminate.LEAST, len(a)))
            n = sum(x[2] for x in tiles)
            if k is not None and n >= decontaminate.COVERAGE * len(a):
                found.add((i, k, n, len(tiles)))
    return found


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = leaking_corpus(3)
    expected = brute_leaks(docs, items)
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, t1 string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(expected) > 60
    for limit in (decontaminate.BLOCK_BYTES, 100):  # sent to the tasks, and partitioned
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        monkeypatch.setattr(decontaminate, "SALT_ROWS", 3)
        got = {(r.doc_id, r.item_id, r.words, r.tiles) for r in decontaminate.contaminated(df, bench).collect()}
        assert got == expected
        kept = decontaminate.clean(df, bench)
        assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {x[0] for x in expected} and kept.columns == df.columns
        text_ids = bench.withColumn("item_id", F.concat(F.lit("item "), "item_id"))
        assert {(r.doc_id, int(r.item_id[5:])) for r in decontaminate.contaminated(df, text_ids).collect()} == {x[:2] for x in expected}
        assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.clean(df.limit(0), bench).count() == 0


# ---- language and quality ---------------------------------------------------------------------

LANGS = {"xx": "the and of with that thing over house", "yy": "le la des avec eau maison être où", "zz": "это не так как все они было дом"}


def prose(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang].split()) for _ in range(n))


def test_language(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang := rng.choice(list(LANGS)), rng.randint(3, 60)), lang if rng.random() < 0.9 else None, "s", 1) for i in range(400)]
    extra = [(1000, None, None, "s", 0), (1001, "", "xx", "s", 0), (1002, "123 !? 😀", "xx", "s", 0), (1003, prose(rng, "xx", 60) + " " + prose(rng, "yy", 90), None, "s", 0), (None, prose(rng, "zz", 9), "zz", "s", 0), (1004, prose(rng, "yy", 20_000), None, "s", 0)]
    df = spark.createDataFrame(rows + extra, DOC).withColumn("score", held_out())
    got = language.with_language(df).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    test = [r for r in got if r.held_out and r.lang and r.doc_id < 1000]
    assert len(test) > 50 and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    spans = by[1003].spans
    assert [s.lang for s in spans] == ["xx", "yy"] and by[1003].lang_pred == "yy" and abs(spans[1].first_word - 60) <= 1
    assert by[None].lang_pred == "zz" and by[1004].lang_pred == "yy"
    empty = language.with_language(spark.createDataFrame([], DOC))
    assert empty.count() == 0
    untaught = language.with_language(spark.createDataFrame([(1, "text", None, "s", 1)], DOC)).first()
    assert (untaught.lang_pred, untaught.score) == ("und", 0.0)


def test_a_language_of_long_texts_only_is_learnt(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, "xx", 40), "xx", "s", 1) for i in range(30)] + [(100 + i, prose(rng, "zz", 30_000), "zz", "s", 1) for i in range(3)]
    rows += [(900, prose(rng, "zz", 30), None, "s", 1)]
    df = spark.createDataFrame(rows, DOC).withColumn("_language", F.lit("stays"))
    got = language.with_language(df)
    assert got.where("doc_id = 900").first().lang_pred == "zz" and got.where("_language = 'stays'").count() == len(rows)


def best_path(w, penalty):
    """The best total over all paths, word by word in plain Python."""
    v = list(w[0])
    for row in w[1:]:
        top = max(v)
        v = [max(x, top - penalty) + s for x, s in zip(v, row, strict=True)]
    return max(v)


def test_spans_are_a_best_path(monkeypatch):
    rng = random.Random(7)
    model = language.fit({k: [prose(rng, k, 400)] for k in LANGS})
    for n in range(60):
        monkeypatch.setattr(language, "STRETCH", (2048, 5, 1)[n % 3])
        parts = [(rng.choice(list(LANGS)), rng.randint(1, 12)) for _ in range(rng.randint(1, 5))]
        text = " ".join(prose(rng, k, n) for k, n in parts)
        w = model.word_scores(language.lettered([text.encode()])).astype(float)
        (_, _, spans), = model.label([text])
        langs = np.repeat([model.languages.index(s[0]) for s in spans], [s[2] for s in spans])
        total = w[np.arange(len(w)), langs].sum() - language.SWITCH_PENALTY * (len(spans) - 1)
        assert total == pytest.approx(best_path(w, language.SWITCH_PENALTY), abs=1e-3)


def test_many_texts_are_searched_at_once(monkeypatch):
    rng = random.Random(12)
    model = language.fit({k: [prose(rng, k, 400)] for k in LANGS})
    texts = [" ".join(prose(rng, rng.choice(list(LANGS)), rng.randint(1, 15)) for _ in range(rng.randint(1, 8))) for _ in range(80)]
    whole = model.label(texts)
    monkeypatch.setattr(language, "STRETCH", 4)
    assert model.label(texts) == whole
    began = time.time()
    model.label([prose(rng, "xx", 200_000) + " " + prose(rng, "yy", 200_000)])
    assert time.time() - began < 20


def test_many_languages_and_words_take_bounded_memory(monkeypatch):
    rng = random.Random(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    samples = {f"l{i:02}": [" ".join("".join(rng.choices(letters[i % 13 : i % 13 + 14], k=6)) for _ in range(200))] for i in range(60)}
    model = language.fit(samples)
    text = " ".join(w for i in range(300) for w in samples[f"l{i % 60:02}"][0].split())  # 60,000 words
    monkeypatch.setattr(language, "CELLS", 1 << 18)
    tracemalloc.start()
    (_, _, spans), = model.label([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) > 250 and peak < 40 << 20  # words x languages alone would be 29 MB of doubles, words x languages x languages 216 MB of bytes


def test_only_languages_of_the_scripts_are_scored():
    rng = random.Random(14)
    model = language.fit({k: [prose(rng, k, 400)] for k in LANGS})
    of = lambda text: model.narrowed(language.lettered([text.encode()]).scripts()).languages
    assert of("the avec") == ["xx", "yy"] and of("это дом") == ["zz"] and of("the дом") == ["xx", "yy", "zz"] and of("漢字") == ["xx", "yy", "zz"]


def test_quality(spark):
    rng = random.Random(3)
    good = lambda: ". ".join(prose(rng, "xx", 12).capitalize() for _ in range(rng.randint(1, 8)))
    bad = lambda: " ".join(w.upper() + rng.choice(["!!", "$$$", "###"]) for w in prose(rng, "xx", 50).split())
    rows, labels = [], []
    for i in range(400):
        q = int(rng.random() < 0.8)
        rows.append((i, good() if q else bad(), "l", "s", 1))
        if rng.random() < 0.8:
            labels += [(i, q, 0)] * rng.randint(1, 2)
    rows += [(900, None, None, None, None), (901, "", "l", "s", 0), (None, good(), "l", "s", 0), (902, bad() * 200, "l", "s", 0)]
    labels += [(5000, 1, 0), (None, 0, 0), (3, None, 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("predicted", held_out())
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.with_quality(df, lab).collect()
    truth = {i: q for i, q, _ in labels}
    test = [r for r in got if r.held_out and r.doc_id in truth and truth[r.doc_id] is not None]
    assert len(test) > 50 and sum(r.predicted == truth[r.doc_id] for r in test) / len(test) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == held(r.doc_id) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score and by[902].predicted == 0
    assert quality.with_quality(df.limit(0), lab).count() == 0
    none = quality.with_quality(df, lab.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    only = quality.with_quality(df, lab.where("quality = 1"))
    assert only.where("score < 0.99").count() == 0


def junk(rng, lang):
    return " ".join(w.upper() + rng.choice(["!!", "$$$", "| x"]) for w in prose(rng, lang, rng.randint(1, 30)).split())


def test_votes_equal_brute_force():
    rng = random.Random(11)
    known = [(junk(rng, rng.choice(list(LANGS))) if i % 3 == 0 else prose(rng, rng.choice(list(LANGS)), rng.randint(1, 40)), int(i % 3 > 0)) for i in range(160)]
    known += known[:20]  # ties
    counts = np.concatenate([quality.term_counts([t.encode()]) for t, _ in known])
    labels = np.array([x for _, x in known])
    model = quality.fit(counts, labels, 0.8)
    texts = [t for t, _ in known[:30]] + [prose(rng, "xx", 20), junk(rng, "yy"), "ß", "one", "!!", "a " * 3000]
    got = model.score([t.encode() for t in texts])
    for t, score in zip(texts, got, strict=True):
        v = model.vectorise(quality.term_counts([t.encode()]))[0]
        near = sorted(((round(float(np.float32(sum(float(a) * float(b) for a, b in zip(v, u, strict=True)))), quality.DIGITS), i) for i, u in enumerate(model.vectors)), reverse=True)
        voters = [(c, i) for c, i in near if c >= near[quality.NEIGHBOURS - 1][0] and c > 0]
        weights = [c**quality.SHARPNESS * model.votes[i] for c, i in voters]
        expected = sum(w * labels[i] for w, (_, i) in zip(weights, voters, strict=True)) / sum(weights) if voters else 0.8
        assert score == pytest.approx(expected, abs=0.02)  # a cosine may be rounded up or down
    assert [model.score([t.encode()])[0] for t in texts] == pytest.approx(list(got), abs=1e-3)  # whatever stands beside it


def test_axes_are_the_main_ones():
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((80, 6)) * [9, 7, 5, 3, 2, 1]) @ rng.standard_normal((6, 50))
    axes = quality.main_axes(x.astype(np.float32), 3)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    assert np.abs(np.linalg.det(v[:3] @ axes)) == pytest.approx(1, abs=1e-3)  # the same space


def test_many_tiny_texts_take_little_memory():
    model = quality.fit(quality.term_counts([b"a b", b"A!! B!!"] * 40), np.array([1, 0] * 40), 0.5)
    texts = [b"some short text"] * 10_000
    tracemalloc.start()
    assert len(model.score(texts)) == len(texts)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_blank_texts_are_refused_and_samples_are_one_row_an_id(spark):
    rows = [(i % 40, "A word, then more." if i % 40 % 2 else "JUNK!! $$$ ||", "l", "s", 1) for i in range(400)] + [(900, "  ", "l", "s", 0), (901, None, "l", "s", 0)]
    df = spark.createDataFrame(rows, DOC).repartition(7)
    lab = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert len(quality.learn(df, lab).labels) == len([i for i in range(40) if not held(i)])
    assert {r.score for r in quality.with_quality(df, lab).where("doc_id >= 900").collect()} == {0.0}


def test_held_out_labels_are_never_learnt(spark):
    rows = [(i, "a b c " * (i % 5 + 1), "l", "s", 1) for i in range(200)]
    df = spark.createDataFrame(rows, DOC)
    lab = spark.createDataFrame([(i, int(not held(i)), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    assert quality.with_quality(df, lab).where("score < 0.999").count() == 0
