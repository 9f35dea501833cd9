"""Queries that check completeness and consistency, and queries over inference grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions.numbers import r6
from brindle.operators import integrity, selection
from brindle.plans import resumable
from brindle.sources import store
from brindle.sources.adapters import view, with_views
from brindle.sources.folders import fresh_folder, written
from brindle.sources.readers import RECORD_KEY

_R, _S, _C = with_views("eval_records"), with_views("samples"), with_views("calls")
GRID = {"dense": ["full"], "topk": ["64", "128"], "cover": ["64", "128"]}


def _plan(s, sf):
    planned = view(s, sf, "calls").select(F.col("call_id").alias("sample_id"), "method", "budget").where("sample_id % 10 <> 0")
    executed = view(s, sf, "calls").select(F.col("call_id").alias("sample_id"), "method", F.when(F.col("call_id") % 7 == 0, "432").otherwise(F.col("budget")).alias("budget"), F.when(F.col("call_id") % 11 == 0, 2).otherwise(1).alias("backend_invocation_count"))
    return integrity.plan_mismatches(planned, executed, ("method", "budget"))


def _grid(s, sf):
    samples = view(s, sf, "samples").select("sample_id", "dataset")
    interventions = s.createDataFrame([("gray", None), ("blur", None), ("swap", ["fr", "de"])], "intervention string, applies_to array<string>")
    cells = s.createDataFrame([(m, b) for m, bs in GRID.items() for b in bs], "method string, budget string")
    return selection.run_grid(samples, interventions, cells).groupBy("dataset", "intervention", "method").agg(F.count("*").alias("n"))


def _centers(s, sf):
    # of square grids and of rows of tokens, as many as a part's key says
    n = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") * F.col("p_size")).otherwise(F.col("p_size")).cast("int")
    rows = view(s, sf, "part").select(n.alias("n"), F.least(n, (1 + F.col("p_partkey") % 40).cast("int")).alias("keep")).distinct()
    return rows.select("n", "keep", F.array_join(F.transform(selection.center_indices(F.col("n"), F.col("keep")), lambda i: i.cast("string")), ",").alias("kept"))


_CENTERS_SQL = """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size * p_size ELSE p_size END::INT AS n FROM part), t AS (SELECT DISTINCT n, least(n, (1 + p_partkey % 40)::INT) AS keep FROM p),
  c AS (SELECT n, keep, i, round(sqrt(n))::INT AS g FROM t, unnest(range(n)) AS u(i)),
  r AS (SELECT *, row_number() OVER (PARTITION BY n, keep ORDER BY CASE WHEN g * g = n THEN pow(i // g - (g - 1) / 2, 2) + pow(i % g - (g - 1) / 2, 2)
        ELSE CASE WHEN i >= (n - keep) // 2 THEN i ELSE i + n END END, i) AS k FROM c)
  SELECT n, keep, string_agg(i, ',' ORDER BY i) AS kept FROM r WHERE k <= keep GROUP BY n, keep"""


def _resumed(s, sf):
    """A run that is stopped after three cells and goes on: its log, with what the cells hold."""
    records = written(view(s, sf, "eval_records").select(*RECORD_KEY, "vem"), "resumable-records")

    def evaluate(cell, dense):
        mine = records.where((F.col("method") == cell.method) & (F.col("budget") == cell.budget))
        if dense is None:
            return mine.withColumn("dense_vem", F.col("vem"))
        return mine.join(dense.select("sample_id", "intervention", F.col("vem").alias("dense_vem")), ["sample_id", "intervention"], "left")

    root, planned = store.join(fresh_folder(s, "resumable"), "run"), resumable.cells(*RESUMED)
    resumable.run_grid(s, root, {"cells": RESUMED}, planned, evaluate, at_most=3)
    run = resumable.run_grid(s, root, {"cells": RESUMED}, planned, evaluate)
    log = s.createDataFrame([(e["method"], e["budget"], e["started"], e["n"]) for e in run.log().values()], "method string, budget string, started int, n bigint")
    held = run.records().groupBy("method", "budget").agg(F.count_distinct("sample_id").alias("samples"), F.count("dense_vem").alias("n_dense"), r6(F.sum("vem")).alias("vem"), r6(F.sum("dense_vem")).alias("dense_vem"))
    return log.join(held, ["method", "budget"], "left")


RESUMED = (["topk", "cover"], ["64", "128"])
_RESUMED_SQL = f"""{with_views("eval_records")}, d AS (SELECT sample_id, intervention, vem AS dense_vem FROM eval_records WHERE method = 'dense')
  SELECT r.method, r.budget, CASE WHEN r.method IN ('dense', 'topk') THEN 1 ELSE 2 END::INT AS started, count(*) AS n, count(DISTINCT r.sample_id) AS samples, count(d.dense_vem) AS n_dense,
         round(sum(r.vem) + 1e-9, 6) AS vem, round(sum(d.dense_vem) + 1e-9, 6) AS dense_vem
  FROM (SELECT sample_id, method, budget, intervention, vem FROM eval_records WHERE method = 'dense' OR budget IN ('64', '128')) r LEFT JOIN d USING (sample_id, intervention) GROUP BY ALL"""


def _scores(s, sf):
    rows = view(s, sf, "samples").select("sample_id", F.array(F.lit("yes"), F.lit("no")).alias("options"), F.when(F.col("sample_id") % 2 == 0, "yes").otherwise("no").alias("answer"), F.lit("topk").alias("method"), F.lit("64").alias("budget"), F.lit("blur").alias("intervention"), (F.col("sample_id") % 10 / 40.0).alias("signal"))
    return selection.synthetic_scores(rows).select("sample_id", "answer_given", r6("logprob").alias("logprob"), r6("confidence").alias("confidence"), r6("latency_ms").alias("latency_ms"))


_SCORES_SQL = f"""{_S}, x AS (SELECT sample_id, o.i AS i, o.t AS t, CASE WHEN sample_id % 2 = 0 THEN 0 ELSE 1 END AS g, sample_id % 10 / 40.0::DOUBLE AS sg FROM samples CROSS JOIN (VALUES (0, 'yes'), (1, 'no')) AS o(i, t)),
  y AS (SELECT *, CASE WHEN i = g THEN 1.5::DOUBLE ELSE 0.2::DOUBLE + 0.55 * 0.9 + (1 - 64 / 576.0::DOUBLE) * 0.15 END + sg * 2.5 - (1 - least(sg * 4, 1)) * 0.8 - (1 - 64 / 576.0::DOUBLE) * 0.3 - 0.55
        + ((('0x' || substr(sha256(concat_ws('|', '0', sample_id, t, 'topk', '64')), 1, 8))::BIGINT % 1000) / 1000.0::DOUBLE - 0.5) * 0.08 AS s FROM x),
  z AS (SELECT sample_id, arg_max(t, s) AS answer_given, max(s) AS m FROM y GROUP BY sample_id), l AS (SELECT y.sample_id, any_value(answer_given) AS answer_given, -ln(sum(exp(s - m))) AS lp FROM y JOIN z USING (sample_id) GROUP BY y.sample_id)
  SELECT sample_id, answer_given, round(lp + 1e-9, 6) AS logprob, round(exp(lp) + 1e-9, 6) AS confidence, round(2.0 + 0.08 * 64 + 1e-9, 6) AS latency_ms FROM l"""

QUERIES = {
    "resumed_run": (_resumed, _RESUMED_SQL),
    "grid_completeness": (
        lambda s, sf: integrity.grid_gaps(view(s, sf, "eval_records"), GRID),
        f"""{_R} SELECT sample_id, count(DISTINCT intervention) AS interventions, count(DISTINCT (method, budget, intervention)) AS present, count(DISTINCT intervention) * 5 AS expected FROM eval_records
            WHERE (method = 'dense' AND budget = 'full') OR (method <> 'dense' AND budget IN ('64', '128')) GROUP BY sample_id HAVING count(DISTINCT (method, budget, intervention)) <> count(DISTINCT intervention) * 5""",
    ),
    "record_key_unique": (
        lambda s, sf: integrity.duplicates(view(s, sf, "eval_records"), "sample_id", "method", "budget", "intervention"),
        f"{_R} SELECT sample_id, method, budget, intervention, count(*) AS n FROM eval_records GROUP BY ALL HAVING count(*) > 1",
    ),
    "raw_key_duplicates": (
        lambda s, sf: integrity.duplicates(view(s, sf, "lineitem"), "l_orderkey", "l_linenumber"),
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    ),
    "repeated_record_keys": (
        lambda s, sf: integrity.duplicates(view(s, sf, "call_pairs"), "sample_id", "method", "intervention"),
        f"{with_views('call_pairs')} SELECT sample_id, method, intervention, count(*) AS n FROM call_pairs GROUP BY ALL HAVING count(*) > 1",
    ),
    "cell_coverage": (
        lambda s, sf: integrity.coverage(view(s, sf, "eval_records"), "method", "budget", "split"),
        f"{_R} SELECT method, budget, split, count(*) AS rows, count(DISTINCT sample_id) AS samples FROM eval_records GROUP BY ALL",
    ),
    "resume_missing": (
        lambda s, sf: integrity.missing(view(s, sf, "calls").select("call_id", "method"), view(s, sf, "calls").where("call_id % 3 = 0").select("call_id"), "call_id"),
        f"{_C} SELECT call_id, method FROM calls WHERE call_id % 3 <> 0",
    ),
    "plan_vs_executed_anti": (
        _plan,
        f"""{_C} SELECT call_id AS sample_id, CASE WHEN call_id % 10 = 0 THEN 'unplanned' WHEN call_id % 11 = 0 THEN 'invocations' ELSE 'differs' END AS problem FROM calls
            WHERE call_id % 10 = 0 OR call_id % 11 = 0 OR (call_id % 7 = 0 AND budget <> '432')""",
    ),
    "id_set_difference": (
        lambda s, sf: integrity.set_difference(view(s, sf, "documents").select("doc_id"), view(s, sf, "labels").select("doc_id"), "doc_id"),
        "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'second' ELSE 'first' END AS only_in FROM (SELECT DISTINCT doc_id FROM documents) d FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL",
    ),
    "run_grid": (
        _grid,
        f"""{_S} SELECT dataset, intervention, method, count(*) AS n FROM samples CROSS JOIN (VALUES ('gray'), ('blur'), ('swap')) AS i(intervention) CROSS JOIN (VALUES ('dense'), ('topk'), ('topk'), ('cover'), ('cover')) AS m(method)
            WHERE intervention <> 'swap' OR dataset IN ('fr', 'de') GROUP BY ALL""",
    ),
    "scorer_prompts": (
        lambda s, sf: view(s, sf, "part").select(
            "p_partkey",
            F.sha2(selection.prompt(F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_brand", "p_type"))), 256).alias("prompt"),
            selection.data_url(F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, ".JPG").otherwise(".dat")), F.encode("p_type", "UTF-8")).alias("url"),
        ),
        """SELECT p_partkey, sha256(CASE WHEN p_partkey % 3 = 0 THEN p_name || chr(10) || chr(10) || 'Answer with a short phrase and no explanation.'
             ELSE p_name || chr(10) || chr(10) || 'Choose the best answer from the options below. Return exactly one option text and nothing else.' || chr(10) || '- ' || p_brand || chr(10) || '- ' || p_type END) AS prompt,
             'data:image/' || CASE WHEN p_partkey % 2 = 0 THEN 'jpeg' ELSE 'png' END || ';base64,' || base64(encode(p_type)) AS url FROM part""",
    ),
    "generated_tokens": (
        lambda s, sf: view(s, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("seq")).withColumn(
            "g", selection.generated(F.col("seq"), F.when(F.col("l_orderkey") % 2 == 0, F.slice("seq", 1, 2)).otherwise(F.array(F.lit(9), F.lit(9))))
        ).select("l_orderkey", F.array_join(F.transform("g.ids", lambda x: x.cast("string")), ",").alias("ids"), F.col("g.kind").alias("kind")),
        """WITH q AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS seq FROM lineitem GROUP BY l_orderkey)
           SELECT l_orderkey, array_to_string(CASE WHEN l_orderkey % 2 = 0 THEN seq[3:] ELSE seq END, ',') AS ids, CASE WHEN l_orderkey % 2 = 0 THEN 'prompt_prefix_sliced' ELSE 'sequence_only' END AS kind FROM q""",
    ),
    "center_selection": (_centers, _CENTERS_SQL),
    "synthetic_scorer": (_scores, _SCORES_SQL),
}
