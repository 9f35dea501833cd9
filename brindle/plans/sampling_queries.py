"""Queries over samples: groups, isolation, draws, strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.answers import hash_split, question_key, stable_hash, stable_seed
from brindle.operators import groups, summary
from brindle.sources.adapters import view, with_views

_S = with_views("samples")
SEED, QUOTAS = 2026, {"en": 40, "fr": 20, "de": 20, "es": 10}


def _hash(*parts: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join(parts) + "))"


def _samples(s, sf):
    return view(s, sf, "samples")


def _components_sql(links: str, where: str = "true") -> str:
    return f"""l AS (SELECT {links} AS v, sample_id FROM samples WHERE {where}), m AS (SELECT v, min(sample_id) AS a FROM l GROUP BY v)"""


def _groups(s, sf):
    rows = _samples(s, sf).withColumns({"q": question_key(F.col("question")), "start": F.substring("question", 1, 40)})
    found = groups.connected_groups(rows, "sample_id", "q", "start")
    return found.select("sample_id", "root", groups.group_name(F.col("root")).alias("grp"))


def _draws(s, sf):
    pool = _samples(s, sf).withColumn("grp", F.sha2("question", 256))
    return groups.quota_draws(pool, QUOTAS, (2101, 2102), "sample_id", "dataset", "grp").select("seed", "dataset", "sample_id")


def _draw_sql(seed: int, free: str) -> str:
    h = _hash(f"'{seed}'", "dataset", "sample_id")
    quota = "CASE dataset " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items()) + " END"
    return f"""SELECT {seed} AS seed, dataset, sample_id, grp FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY h, sample_id) AS r2 FROM
        (SELECT *, {h} AS h, row_number() OVER (PARTITION BY grp ORDER BY dataset, {h}, sample_id) AS r1 FROM pool WHERE dataset IN ('en','fr','de','es') AND {free}) WHERE r1 = 1) WHERE r2 <= {quota}"""


def _alloc(s, sf):
    rows = _samples(s, sf)
    quota = groups.allocate(rows, "category", 300)
    return groups.stratified_take(rows, quota, SEED, "sample_id", "category").groupBy("category").agg(F.count("*").alias("n"))


def _folds(s, sf):
    return groups.assign_folds(_samples(s, sf).groupBy("category").agg(F.count("*").alias("n")), "category", "n").select("category", "fold")


def _group_folds(s, sf):
    sizes = _samples(s, sf).groupBy(F.substring(F.sha2("question", 256), 1, 2).alias("grp")).agg(F.count("*").alias("n"))
    return groups.assign_folds(sizes, "grp", "n")


def _folds_sql(sizes: str, name: str, more: str = "") -> str:
    """The greedy steps one after the other, by recursion."""
    least = "list_position(loads, list_min(loads))"
    return f"""{_S.replace("WITH ", "WITH RECURSIVE ", 1)}, z AS ({sizes}), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, sha256(name), name) AS i FROM z),
      r AS (SELECT 0::BIGINT AS i, '' AS name, 0::BIGINT AS n, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
            UNION ALL SELECT o.i, o.name, o.n, ({least} - 1)::INT, list_transform(range(1, 6), lambda k: loads[k] + CASE WHEN k = {least} THEN o.n ELSE 0 END) FROM r JOIN o ON o.i = r.i + 1)
      SELECT name AS {name}{more}, fold FROM r WHERE i > 0"""


QUERIES = {
    "stable_hash_topk": (
        lambda s, sf: groups.take_by_hash(_samples(s, sf), 25, SEED, "sample_id").select("sample_id", "dataset"),
        f"{_S} SELECT sample_id, dataset FROM samples ORDER BY {_hash(f'{SEED}', 'sample_id')}, sample_id LIMIT 25",
    ),
    "hash_take_per_stratum": (
        lambda s, sf: groups.take_by_hash(_samples(s, sf), 5, SEED, "sample_id", "dataset", "category").select("sample_id", "dataset", "category"),
        f"{_S} SELECT sample_id, dataset, category FROM (SELECT *, row_number() OVER (PARTITION BY dataset, category ORDER BY {_hash(f'{SEED}', 'dataset', 'category', 'sample_id')}, sample_id) AS r FROM samples) WHERE r <= 5",
    ),
    "split_by_hash": (
        lambda s, sf: _samples(s, sf).select("sample_id", stable_seed(F.lit(SEED), F.col("sample_id")).alias("seed")).withColumn("split", hash_split(0.2, F.lit(SEED), F.col("sample_id"))),
        f"{_S} SELECT sample_id, seed, CASE WHEN seed / 4294967295.0 < 0.2 THEN 'validation' ELSE 'test' END AS split FROM (SELECT sample_id, ('0x' || substr({_hash(f'{SEED}', 'sample_id')}, 1, 8))::BIGINT AS seed FROM samples)",
    ),
    "round_robin_strata": (
        lambda s, sf: groups.round_robin(_samples(s, sf), 100, SEED, "sample_id", "category").select("sample_id", "category", "turn"),
        f"{_S} SELECT sample_id, category, turn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_hash(f'{SEED}', 'category', 'sample_id')}, sample_id) AS turn FROM samples) ORDER BY turn, category LIMIT 100",
    ),
    "quota_draws": (
        _draws,
        f"""{_S}, pool AS (SELECT *, sha256(question) AS grp FROM samples), d1 AS ({_draw_sql(2101, "true")}), d2 AS ({_draw_sql(2102, "grp NOT IN (SELECT grp FROM d1)")})
            SELECT seed, dataset, sample_id FROM d1 UNION ALL SELECT seed, dataset, sample_id FROM d2""",
    ),
    "draws_overlap": (
        lambda s, sf: groups.draws_overlap(groups.quota_draws(_samples(s, sf).withColumn("grp", F.sha2("question", 256)), QUOTAS, (2101, 2102), "sample_id", "dataset", "grp"), "grp"),
        "SELECT '' AS grp, 0::BIGINT AS draws WHERE false",
    ),
    "connected_groups": (
        _groups,
        f"""{_S.replace("WITH ", "WITH RECURSIVE ", 1)}, k AS (SELECT sample_id, trim(regexp_replace(lower(question), '[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')) AS q, substr(question, 1, 40) AS st FROM samples),
            e0 AS (SELECT a, sample_id AS b FROM (SELECT min(sample_id) OVER (PARTITION BY q) AS a, sample_id FROM k UNION ALL SELECT min(sample_id) OVER (PARTITION BY st), sample_id FROM k) WHERE a <> sample_id),
            e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
            r AS (SELECT sample_id AS n, sample_id AS m FROM k UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n)
            SELECT n AS sample_id, min(m) AS root, sha256(CAST(min(m) AS VARCHAR)) AS grp FROM r GROUP BY n""",
    ),
    "anti_isolation": (
        lambda s, sf: groups.isolated(_samples(s, sf).where("sample_id % 2 = 0"), _samples(s, sf).where("sample_id % 2 = 1"), "question").select("sample_id"),
        f"{_S} SELECT sample_id FROM samples a WHERE sample_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM samples b WHERE b.sample_id % 2 = 1 AND b.question = a.question)",
    ),
    "template_questions": (
        lambda s, sf: groups.templates(_samples(s, sf).where("sample_id % 2 = 0").withColumn("opening", F.substring("question", 1, 20)), _samples(s, sf).where("sample_id % 2 = 1").withColumn("opening", F.substring("question", 1, 20)), "opening"),
        f"{_S} SELECT DISTINCT opening FROM (SELECT substr(question, 1, 20) AS opening, sample_id % 2 AS side, count(*) AS n FROM samples GROUP BY 1, 2) WHERE n >= 5",
    ),
    "split_leakage": (
        lambda s, sf: summary.split_leakage(_samples(s, sf).select(F.sha2("question", 256).alias("hash"), F.when(F.col("sample_id") % 5 == 0, "validation").otherwise("test").alias("split")), "hash"),
        f"{_S} SELECT sha256(question) AS hash, count(*) AS n, count(DISTINCT split) AS splits, min(split) AS first_split FROM (SELECT question, CASE WHEN sample_id % 5 = 0 THEN 'validation' ELSE 'test' END AS split FROM samples) GROUP BY question HAVING count(DISTINCT split) > 1",
    ),
    "balanced_allocation": (
        _alloc,
        f"""{_S}, c AS (SELECT category, count(*) AS cap FROM samples GROUP BY category), l AS (SELECT max(lv) AS lv FROM (SELECT lv, sum(least(cap, lv)) AS t FROM c CROSS JOIN range(0, 301) AS r(lv) GROUP BY lv) WHERE t <= 300),
            o AS (SELECT category, cap, lv, row_number() OVER (PARTITION BY cap > lv ORDER BY category) AS r, sum(least(cap, lv)) OVER () AS t FROM c CROSS JOIN l)
            SELECT category, least(cap, lv) + (cap > lv AND r <= 300 - t)::INT AS n FROM o""",
    ),
    "fold_packing": (_folds, _folds_sql("SELECT category AS name, count(*) AS n FROM samples GROUP BY category", "category")),
    "group_folds": (_group_folds, _folds_sql("SELECT substr(sha256(question), 1, 2) AS name, count(*) AS n FROM samples GROUP BY 1", "grp", ", n")),
    "purposive_sample": (
        lambda s, sf: groups.purposive_sample(_samples(s, sf), 4, "sample_id", "category", "dataset").select("sample_id", "category", "place"),
        f"""{_S}, t AS (SELECT *, row_number() OVER (PARTITION BY category, dataset ORDER BY {_hash('category', 'sample_id')}, sample_id) AS turn FROM samples)
            SELECT sample_id, category, place FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY turn, dataset) AS place FROM t) WHERE place <= 4""",
    ),
    "manifest_counts": (
        lambda s, sf: _samples(s, sf).groupBy("dataset").agg(F.count("*").alias("n")).select(F.lit("dataset").alias("dimension"), F.col("dataset").alias("value"), "n").unionByName(_samples(s, sf).groupBy("category").agg(F.count("*").alias("n")).select(F.lit("category").alias("dimension"), F.col("category").alias("value"), "n")),
        f"{_S} SELECT 'dataset' AS dimension, dataset AS value, count(*) AS n FROM samples GROUP BY dataset UNION ALL SELECT 'category', category, count(*) FROM samples GROUP BY category",
    ),
    "cross_dataset_unique": (
        lambda s, sf: groups.take_by_hash(groups.take_by_hash(_samples(s, sf).withColumn("image", F.sha2("question", 256)), 1, SEED, "sample_id", "image"), 50, SEED, "sample_id").select("sample_id"),
        f"{_S} SELECT sample_id FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY {_hash(f'{SEED}', 'sha256(question)', 'sample_id')}, sample_id) AS r FROM samples) WHERE r = 1 ORDER BY {_hash(f'{SEED}', 'sample_id')}, sample_id LIMIT 50",
    ),
}
