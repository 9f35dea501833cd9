"""Domain tables as views of the driver tables, each stated as SQL that Spark and DuckDB both run, some as an operator and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.operators.records import with_dense

#: Name of a time in seconds since 1970, per engine; times are read without a zone.
_EPOCH = {
    "spark": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c}) / 1000000.0D",
    "duckdb": "epoch_us({c}) / 1000000.0::DOUBLE",
}

#: View -> SQL over driver tables and views before it. ``@ts@`` stands for an event's time in seconds.
VIEWS: dict[str, str] = {
    "raw_records": """
        SELECT sample_id, split, dataset, method, budget, budget_ord, intervention, answer, gold_answer, is_correct, vem,
               shortcut_persistence, cost, latency_ms, energy_joule, measured_energy_joule, proxy_energy_joule, api_cost_usd, token_count
        FROM (
          SELECT *, row_number() OVER (PARTITION BY sample_id, method, budget, intervention
                                       ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rn
          FROM (
            SELECT /*+ MERGE(o) */ l_orderkey AS sample_id,
                   CASE WHEN l_orderkey % 5 = 0 THEN 'validation' ELSE 'test' END AS split,
                   o_orderpriority AS dataset,
                   CASE l_returnflag WHEN 'N' THEN 'dense' WHEN 'A' THEN 'topk' ELSE 'cover' END AS method,
                   CASE WHEN l_returnflag = 'N' THEN 'full' WHEN l_partkey % 4 = 0 THEN '64' WHEN l_partkey % 4 = 1 THEN '128'
                        WHEN l_partkey % 4 = 2 THEN '256' ELSE '432' END AS budget,
                   CASE WHEN l_returnflag = 'N' THEN 576 WHEN l_partkey % 4 = 0 THEN 64 WHEN l_partkey % 4 = 1 THEN 128
                        WHEN l_partkey % 4 = 2 THEN 256 ELSE 432 END AS budget_ord,
                   CASE WHEN l_suppkey % 2 = 0 THEN 'gray' ELSE 'blur' END AS intervention,
                   CASE WHEN l_partkey % 3 = 0 THEN 'A' WHEN l_partkey % 3 = 1 THEN 'B' ELSE 'C' END AS answer,
                   CASE WHEN l_orderkey % 3 = 0 THEN 'A' WHEN l_orderkey % 3 = 1 THEN 'B' ELSE 'C' END AS gold_answer,
                   l_linestatus = 'O' AS is_correct,
                   l_discount * 10 - 0.2D0 AS vem,
                   l_tax > 0.04D0 AS shortcut_persistence,
                   l_extendedprice AS cost, l_quantity AS latency_ms, l_extendedprice / 100 AS energy_joule,
                   CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_quantity * 3 END AS measured_energy_joule,
                   l_quantity * 0.2D0 AS proxy_energy_joule, CASE WHEN l_partkey % 6 = 0 THEN l_tax END AS api_cost_usd,
                   CASE WHEN l_returnflag = 'N' THEN 576 WHEN l_partkey % 4 = 0 THEN 64 WHEN l_partkey % 4 = 1 THEN 128
                        WHEN l_partkey % 4 = 2 THEN 256 ELSE 432 END AS token_count,
                   l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
            FROM {lineitem} JOIN {orders} AS o ON l_orderkey = o_orderkey
          ) AS x
        ) AS y WHERE rn = 1""",
    "eval_records": """
        SELECT r.*, d.vem AS dense_vem,
               CASE WHEN r.method = 'dense' THEN CASE WHEN abs(r.vem) > 1e-9 THEN 1.0D0 END
                    WHEN abs(d.vem) >= 1e-6 THEN r.vem / d.vem END AS reliance_retention,
               CASE WHEN r.method = 'dense' THEN 0.0D0 ELSE d.vem - r.vem END AS delta_vem
        FROM {raw_records} AS r
        LEFT JOIN (SELECT sample_id, intervention, vem FROM {raw_records} WHERE method = 'dense') AS d
          ON r.sample_id = d.sample_id AND r.intervention = d.intervention""",
    # calls on an original and a changed input; answers as models write them
    "call_pairs": """
        SELECT l_orderkey AS sample_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CASE l_returnflag WHEN 'N' THEN 'dense' WHEN 'A' THEN 'topk' ELSE 'cover' END AS method,
               CASE WHEN l_suppkey % 2 = 0 THEN 'gray' ELSE 'blur' END AS intervention,
               CASE l_partkey % 4 WHEN 0 THEN 'Yes.' WHEN 1 THEN ' true' WHEN 2 THEN 'a,  red; Car' ELSE 'NO' END AS original_answer,
               CASE l_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'A red car' ELSE 'false' END AS gold_answer,
               CASE l_suppkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'nope' WHEN 2 THEN 'a red car.' ELSE 'other' END AS intervened_answer,
               CASE WHEN l_suppkey % 4 = 0 THEN 'answer_only' WHEN l_suppkey % 4 = 1 THEN 'score_vem' END AS score_type,
               -l_tax * 10 AS original_logprob, -l_discount * 20 AS intervened_logprob, l_quantity AS original_latency_ms, l_quantity * 2 AS intervened_latency_ms,
               CASE WHEN l_partkey % 5 = 0 THEN l_tax END AS original_api_cost_usd, CASE WHEN l_partkey % 3 = 0 THEN l_discount END AS intervened_api_cost_usd,
               CASE WHEN l_partkey % 2 = 0 THEN l_quantity END AS original_measured_energy_joule, CASE WHEN l_suppkey % 3 = 0 THEN l_quantity * 3 END AS intervened_measured_energy_joule,
               CASE WHEN l_partkey % 5 = 0 THEN l_linenumber END AS original_api_prompt_tokens, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber * 2 END AS intervened_api_prompt_tokens,
               CASE WHEN l_partkey % 5 = 0 THEN 7 END AS original_api_completion_tokens, CAST(NULL AS INT) AS intervened_api_completion_tokens,
               CAST(NULL AS INT) AS original_api_total_tokens, CAST(NULL AS INT) AS intervened_api_total_tokens
        FROM {lineitem}""",
    "power_samples": "SELECT event_id, @ts@ AS epoch, value AS power_w FROM {events} WHERE event_type = 'view'",
    "calls": """
        SELECT event_id AS call_id, user_id % 50 AS sample_id,
               CASE WHEN user_id % 3 = 0 THEN 'dense' WHEN user_id % 3 = 1 THEN 'topk' ELSE 'cover' END AS method,
               CASE WHEN user_id % 3 = 0 THEN 'full' WHEN user_id % 2 = 0 THEN '64' ELSE '256' END AS budget,
               @ts@ AS start_epoch, @ts@ + value * 20 AS end_epoch
        FROM {events} WHERE event_type = 'purchase'""",
    "samples": "SELECT doc_id AS sample_id, lang AS dataset, source AS category, text AS question FROM {documents}",
    "labels_by_budget": """
        SELECT l.doc_id AS sample_id, d.lang AS dataset, b.budget, l.quality = 1 AND (l.doc_id + b.budget / 64) % 4 <> 0 AS reference_safe,
               CAST((l.doc_id * 37 + b.budget) % 1000 AS DOUBLE) / 1000 AS score
        FROM (SELECT doc_id, max(quality) AS quality FROM {labels} GROUP BY doc_id) AS l JOIN {documents} AS d ON l.doc_id = d.doc_id
        CROSS JOIN (SELECT 64 AS budget UNION ALL SELECT 128 UNION ALL SELECT 256 UNION ALL SELECT 448) AS b""",
    "answers": "SELECT conv_id, turn, role, text AS raw_answer FROM {conversations}",
    "runs": """
        SELECT o_orderkey AS run_id, o_orderpriority AS path, o_orderstatus AS status, o_totalprice AS energy_joule,
               CAST(o_custkey % 1000 AS DOUBLE) AS duration_s FROM {orders}""",
}

#: Views that Spark makes with operators; the SQL above says what they have to give.
OPERATORS = {"eval_records": lambda spark, sf_dir: with_dense(view(spark, sf_dir, "raw_records"))}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _needs(sql: str) -> list[str]:
    return [n for n in (*TABLES, *VIEWS) if "{" + n + "}" in sql]


def _sql(name: str, engine: str) -> str:
    sql = VIEWS[name].replace("@ts@", _EPOCH[engine].format(c="ts"))
    # a double is written 1.0D0 above; each engine has its own way
    return sql.replace("D0", "D") if engine == "spark" else sql.replace("D0", "::DOUBLE")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a domain view of them."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in OPERATORS:
        return OPERATORS[name](spark, sf_dir)
    sql = _sql(name, "spark")
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _needs(sql)})


def with_views(*names: str) -> str:
    """``WITH`` and the definitions of the views and of those they need, for DuckDB; ends without a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _needs(VIEWS[name]):
            if n in VIEWS:
                add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({_sql(n, 'duckdb').format(**{x: x for x in (*TABLES, *VIEWS)})})" for n in order)
