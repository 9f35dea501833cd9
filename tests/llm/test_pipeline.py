"""The pipeline's stages keep columns, act on all rows, and drop what they should."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import queries
from brindle.llm.shared import fresh_folder, written
from brindle.sources import folders

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, docs, SF), name)
        assert kept.columns == columns and 0 < kept.count() <= n
        assert kept.join(docs, columns, "left_anti").count() == 0  # rows as they were
        docs, n = kept, kept.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n


def test_near_duplicates_keep_one_of_each_group(spark):
    rows = [(3, "a b c d e f g", "x", "s", 1), (1, "a b c d e f g", "x", "s", 1), (1, "a b c d e f g", "x", "s", 1), (2, "other words here", "x", "s", 1), (None, "no id", "x", "s", 1), (None, "no id", "x", "s", 1), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, df, SF)
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "4", "None"] and got.columns == df.columns


def kept_texts(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, df, SF).collect())


def long_text(c, end=""):
    return " ".join(f"{c}{i}" for i in range(40)) + end


def test_near_duplicates_keep_other_texts_of_an_id(spark):
    # two texts of 5, both without a copy; of 6 the longest goes to 2, the other stays
    rows = [(5, long_text("a")), (5, long_text("b")), (6, long_text("c", " and more")), (6, long_text("d")), (2, long_text("c"))]
    assert kept_texts(spark, rows) == sorted(r for r in rows if r[1] != long_text("c", " and more"))


def test_near_duplicates_without_an_id(spark):
    rows = [(7, long_text("a")), (None, long_text("a")), (None, long_text("a", " end")), (None, long_text("b")), (None, long_text("b", " end")), (None, long_text("c"))]
    got = kept_texts(spark, rows)
    assert [(i, t[:2]) for i, t in got] == [(0, "b0"), (0, "c0"), (7, "a0")]


def test_registered_queries(spark):
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert not set(queries.oracle_sql()) - set(names)


ODD = "doc_id long, text string, lang string, source string, n_chars long, _score double, Found string, first int, none boolean, key string, at long, t1 long, leaked int"
WORDS = {"xx": "the and of with that thing over house", "yy": "le la des avec eau maison être où"}


@pytest.fixture(scope="module")
def odd(spark):
    """Documents and tables with all that is odd: (docs, folder, texts by id)."""
    rng = random.Random(4)
    prose = lambda lang, n: " ".join(rng.choice(WORDS[lang].split()) + str(rng.randint(0, 9) if rng.random() < 0.2 else "") for _ in range(n)).capitalize() + "."
    junk = lambda: " ".join(f"{prose('xx', 1).upper()}!! $$$ ||" for _ in range(20))
    rows = [(i, junk() if i % 4 == 0 else prose(rng.choice(list(WORDS)), 40), rng.choice(list(WORDS))) for i in range(200)]
    rows = [(i, t, "xx" if set(t.lower().split()) & set(WORDS["xx"].split()) else "yy") for i, t, _ in rows]
    rows += [(300, None, None), (301, "", "xx"), (302, "  \n", None), (303, "123 !? 😀", "xx"), (None, prose("xx", 40), "xx"), (305, prose("yy", 30_000), "yy")]
    rows += [rows[1], rows[1], (1, prose("xx", 50), "xx"), (400, rows[2][1] + " end", "xx"), (401, "x y " + "item words one two three four five six seven. " + prose("xx", 30), "xx")]
    folder = fresh_folder(spark, "odd")
    extra = (0.5, "found", 1, True, "k", 7, 8, 0)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), *extra) for i, t, lang in rows], ODD)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(150)] + [(None, 1, 0), (2, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "item words one two three four five six seven"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), folder, rows


GONE = {
    "language": {300, 301, 302, 303},
    "quality": {300, 301, 302, *range(0, 200, 4)},
    "near_duplicates": {400},
    "decontamination": {401},
}


@pytest.mark.parametrize("name", GONE)
def test_stages_on_odd_rows(spark, odd, name):
    docs, folder, rows = odd
    stage = dict(corpus_pipeline.STAGES)[name]
    kept = written(stage(spark, docs, folder), name)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0  # rows as they were, with the columns of clashing names
    gone = {i for i, *_ in rows} - {r.doc_id for r in kept.collect()}
    assert gone == GONE[name]
    # rows that are repeated stay as often as they come, but near duplicates leave one
    times = {r.text: r["count"] for r in kept.where("doc_id = 1").groupBy("text").count().collect()}
    assert sorted(times.values()) == ([1, 1] if name == "near_duplicates" else [1, 3])
    empty = stage(spark, docs.limit(0), folder)
    assert empty.columns == docs.columns and empty.count() == 0


def test_packing_of_odd_rows(spark, odd):
    docs, folder, rows = odd
    packed = corpus_pipeline.pack_sequences(spark, docs, folder)
    got = packed.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n"), F.max("piece").alias("last"), F.sum("length").alias("tokens")).collect()
    assert {r.doc_id: r.n for r in got} == {i: sum(j == i for j, *_ in rows) for i, *_ in rows}
    by = {r.doc_id: r for r in got}
    assert (by[300].tokens, by[301].tokens) == (1, 1) and by[305].last > 5
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), folder).count() == 0


def test_run_leaves_only_what_its_result_reads(spark, odd):
    _, folder, rows = odd
    before = set(folders._made)
    result = corpus_pipeline.run(spark, folder)
    kept = {r.doc_id for r in result.select("doc_id").collect()}
    assert kept == {i for i, *_ in rows} - set.union(*GONE.values())
    made = sorted(f.split("brindle-")[-1].rsplit("-", 1)[0] for f in set(folders._made) - before)
    assert made == ["pieces", "stage-decontamination"]
