"""Queries over evaluation records: views, policies, summaries, ablations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import r6
from brindle.operators import policy, reports, summary
from brindle.sources.adapters import view, with_views

TAU, DENSE_MIN = 0.25, 0.1
METHODS, BUDGETS = ("topk", "cover"), ("64", "128", "256", "432")


def _records(spark: SparkSession, sf: str, split: str | None = "test") -> DataFrame:
    rows = view(spark, sf, "eval_records")
    return rows.where(F.col("split") == split) if split else rows


# ---- SQL of the policies, in relational form -------------------------------------------------

class _Sql(str):
    """A value that is an expression."""


_VALUES = {None: "NULL", True: "true", False: "false"}


def _literal(v: object) -> str:
    if isinstance(v, _Sql):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(_literal(x) for x in v) + "]"
    return _VALUES[v] if v is None or isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"


def _settings_sql(rows: list[dict]) -> str:
    names = [x.split()[0] for x in policy.SETTING.split(", ")]
    kinds = {"array<string>": "VARCHAR[]", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = [kinds[x.split()[1]] for x in policy.SETTING.split(", ")]
    full = [{"require_reliance": True, "dense_vem_min": 0.0, **r} for r in rows]
    return " UNION ALL ".join("SELECT " + ", ".join(f"CAST({_literal(r.get(n))} AS {t}) AS {n}" for n, t in zip(names, types, strict=True)) for r in full)


def _candidates_sql(rows: list[dict], where: str) -> str:
    """CTEs up to ``ag``: a row per setting, sample, method and budget over eligible interventions."""
    records = with_views("eval_records").replace("_records AS (", "_records AS MATERIALIZED (")
    return f"""{records}, settings AS ({_settings_sql(rows)}),
    e AS MATERIALIZED (SELECT s.*, r.* FROM eval_records r CROSS JOIN settings s
          WHERE ({where}) AND (s.interventions IS NULL OR list_contains(s.interventions, r.intervention))),
    hd AS (SELECT setting, sample_id, split, bool_or(method = 'dense') AS has_dense FROM e GROUP BY ALL),
    el AS MATERIALIZED (SELECT DISTINCT setting, sample_id, split, intervention FROM e JOIN hd USING (setting, sample_id, split)
           WHERE CASE WHEN has_dense THEN method = 'dense' AND (NOT require_reliance OR (is_correct AND vem >= greatest(dense_vem_min, tau)))
                      ELSE dense_vem IS NULL OR dense_vem >= greatest(dense_vem_min, tau) END),
    ne AS (SELECT setting, sample_id, split, count(*) AS n_eligible FROM el GROUP BY ALL),
    ag AS MATERIALIZED (SELECT setting, sample_id, split, method, budget, any_value(methods) AS methods, any_value(fixed_method) AS fixed_method,
                  any_value(fixed_budget) AS fixed_budget, min(dataset) AS dataset, min(budget_ord) AS budget_ord, min(n_eligible) AS n_eligible,
                  count(DISTINCT intervention) = min(n_eligible) AS covers,
                  bool_and(vem >= tau AND (rho IS NULL OR coalesce(reliance_retention >= rho, false))) AS passes,
                  bool_and(is_correct) AS is_correct, min(vem) AS vem, min(dense_vem) AS dense_vem, min(reliance_retention) AS reliance_retention,
                  {", ".join(f"sum({c}) AS {c}" for c in (*policy.SPENT, "api_cost_usd"))},
                  arg_min(answer, intervention) AS answer, arg_min(gold_answer, intervention) AS gold_answer, arg_min(token_count, intervention) AS token_count
           FROM e JOIN el USING (setting, sample_id, split, intervention) JOIN ne USING (setting, sample_id, split)
           GROUP BY setting, sample_id, split, method, budget),
    dn AS MATERIALIZED (SELECT * FROM ag WHERE method = 'dense'),
    cand AS MATERIALIZED (SELECT * FROM ag WHERE method <> 'dense' AND covers AND (methods IS NULL OR list_contains(methods, method)))"""


_SELECT_DECISION = """SELECT c.setting, c.sample_id, c.split, c.dataset, c.method AS selected_method, c.budget AS selected_budget, c.passes AS accepted,
        c.escalations, c.reason, c.answer, c.gold_answer, c.is_correct, c.vem, c.dense_vem, c.reliance_retention, c.cost, c.latency_ms, c.energy_joule,
        c.measured_energy_joule, c.proxy_energy_joule, c.api_cost_usd, {online}, 'score_vem' AS support_metric, c.token_count, c.n_eligible, CASE WHEN c.passes THEN 'supported' ELSE 'unsupported' END AS support_status,
        d.latency_ms AS dense_latency_ms, d.cost AS dense_cost, d.token_count AS dense_token_count,
        CASE WHEN d.latency_ms <> 0 AND c.latency_ms <> 0 THEN d.latency_ms / c.latency_ms END AS speedup_vs_dense,
        CASE WHEN d.token_count <> 0 THEN c.token_count::DOUBLE / d.token_count END AS retained_token_ratio,
        1 - CASE WHEN d.token_count <> 0 THEN c.token_count::DOUBLE / d.token_count END AS token_reduction
      FROM chosen c LEFT JOIN dn d USING (setting, sample_id, split)"""


def _decisions_sql(rows: list[dict], kind: str = "cheapest", where: str = "r.split = 'test'") -> str:
    """CTEs up to ``dec``, the decisions."""
    head = _candidates_sql(rows, where)
    names = "setting, sample_id, split, dataset, method, budget, passes, escalations, reason, answer, gold_answer, is_correct, vem, dense_vem, reliance_retention, cost, latency_ms, energy_joule, measured_energy_joule, proxy_energy_joule, api_cost_usd, token_count, n_eligible"
    ends = {c: f"c.{c}" if kind == "cascade" else "NULL::DOUBLE" for c in policy.ONLINE}
    decision = _SELECT_DECISION.format(online=", ".join(f"{x} AS {policy.ONLINE[c]}" for c, x in ends.items()))
    if kind == "fixed":
        chosen = f"SELECT {names} FROM (SELECT *, 0::BIGINT AS escalations, 'fixed_budget' AS reason FROM ag WHERE covers AND method = fixed_method AND budget = fixed_budget)"
        return f"{head}, chosen AS MATERIALIZED ({chosen}), dec AS ({decision})"
    key = "c.setting = o.setting AND c.sample_id = o.sample_id AND c.split = o.split"
    if kind == "cheapest":
        head += f""", acc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setting, sample_id, split ORDER BY budget_ord, cost, method) AS rn
                                      FROM cand WHERE passes) WHERE rn = 1),
        acc2 AS (SELECT c.*, (SELECT count(DISTINCT o.budget) FROM cand o WHERE {key} AND o.budget_ord < c.budget_ord) AS escalations FROM acc c),
        fall AS (SELECT c.*, (SELECT count(DISTINCT o.budget) FROM cand o WHERE {key}) AS escalations FROM dn c
                 WHERE NOT EXISTS (SELECT 1 FROM acc o WHERE {key}))"""
    else:
        spent = ", ".join(f"sum({c}) OVER w AS {c}" for c in policy.SPENT)
        total = ", ".join(f"sum({c}) AS {c}" for c in policy.SPENT)
        add = ", ".join(f"CASE WHEN t.{c} IS NULL THEN d.{c} ELSE t.{c} + coalesce(d.{c}, 0) END AS {c}" for c in policy.SPENT)
        head += f""", run AS (SELECT * EXCLUDE ({", ".join(policy.SPENT)}), {spent}, row_number() OVER w AS place
                   FROM cand WINDOW w AS (PARTITION BY setting, sample_id, split ORDER BY budget_ord, cost, method ROWS UNBOUNDED PRECEDING)),
        acc2 AS (SELECT *, place - 1 AS escalations FROM (SELECT *, row_number() OVER (PARTITION BY setting, sample_id, split ORDER BY place) AS rn
                                                          FROM run WHERE passes) WHERE rn = 1),
        tot AS (SELECT setting, sample_id, split, count(*) AS escalations, {total} FROM cand GROUP BY ALL),
        fall AS (SELECT d.* EXCLUDE ({", ".join(policy.SPENT)}), {add}, coalesce(t.escalations, 0) AS escalations
                 FROM dn d LEFT JOIN tot t USING (setting, sample_id, split) WHERE NOT EXISTS (SELECT 1 FROM acc2 o WHERE d.setting = o.setting AND d.sample_id = o.sample_id AND d.split = o.split))"""
    chosen = f"""SELECT {names} FROM (SELECT *, CASE WHEN escalations = 0 THEN 'accepted_visual_support' ELSE 'accepted_after_escalation' END AS reason FROM acc2)
                 UNION ALL SELECT {names} FROM (SELECT *, 'fallback_full' AS reason FROM fall)"""
    return f"{head}, chosen AS ({chosen}), dec AS ({decision})"


def _r(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


def _distribution(c: str, values: tuple[str, ...]) -> str:
    parts = ", ".join(f"CASE WHEN count(*) FILTER ({c} = '{v}') > 0 THEN '\"{v}\":' || count(*) FILTER ({c} = '{v}') END" for v in values)
    return "'{' || array_to_string(list_filter([" + parts + "], lambda x: x IS NOT NULL), ',') || '}'"


_RIGHT, _ACC = "greatest(count(*) FILTER (is_correct), 1)", "greatest(count(*) FILTER (accepted), 1)"
_MEASURES_SQL = {
    "n": "count(*)",
    "accepted_rate": _r("avg(accepted::INT)"),
    "accuracy": _r("avg(is_correct::INT)"),
    "visually_supported_rate": _r("avg(accepted::INT)"),
    **{f"mean_{c}": _r(f"avg({c})") for c in ("vem", "latency_ms", "token_count", "escalations", "speedup_vs_dense", "retained_token_ratio", "token_reduction", "measured_energy_joule")},
    "mean_rr": _r("avg(reliance_retention)"),
    "mean_clipped_rr": _r("avg(CASE WHEN reliance_retention IS NOT NULL THEN least(greatest(reliance_retention, 0), 2) END)"),
    "total_cost": "round(sum(cost), 2)",
    "cost_per_accurate_answer": _r(f"sum(cost) / {_RIGHT}"),
    "cost_per_visually_supported_answer": _r(f"sum(cost) / {_ACC}"),
    "total_measured_energy_joule": _r("sum(measured_energy_joule)"),
    "measured_energy_per_accurate_answer_joule": _r(f"sum(measured_energy_joule) / {_RIGHT}"),
    "measured_energy_per_visually_supported_answer_joule": _r(f"sum(measured_energy_joule) / {_ACC}"),
    "dense_avoidance_rate": _r("avg((selected_method <> 'dense' AND selected_budget <> 'full')::INT)"),
    "fallback_full_rate": _r("avg((reason = 'fallback_full')::INT)"),
    "mean_api_cost_usd": _r("avg(api_cost_usd)"),
    "total_api_cost_usd": _r("sum(api_cost_usd)"),
    "mean_proxy_energy_joule": _r("avg(proxy_energy_joule)"),
    "total_proxy_energy_joule": _r("sum(proxy_energy_joule)"),
    "proxy_energy_per_visually_supported_answer_joule": _r(f"sum(proxy_energy_joule) / {_ACC}"),
    "mean_online_cumulative_cost": _r("avg(online_cumulative_cost)"),
    "mean_online_cumulative_latency_ms": _r("avg(online_cumulative_latency_ms)"),
    "selected_budget_distribution": _distribution("selected_budget", ("128", "256", "432", "64", "full")),
    "selected_method_distribution": _distribution("selected_method", ("cover", "dense", "topk")),
}
_SUM_SQL = ", ".join(f"{x} AS {n}" for n, x in _MEASURES_SQL.items())


def _of(*rows: dict):
    return lambda spark: policy.settings(spark, rows)


_ONE = [{"setting": "supported", "tau": TAU, "dense_vem_min": DENSE_MIN}]
_RHO = [{"setting": "supported_rho", "tau": TAU, "rho": 0.5, "dense_vem_min": DENSE_MIN}]
_BY_METHOD = [{"setting": f"{m}_supported", "tau": TAU, "dense_vem_min": DENSE_MIN, "methods": [m]} for m in METHODS]
_FIXED = [{"setting": "dense_only", "tau": TAU, "dense_vem_min": DENSE_MIN, "fixed_method": "dense", "fixed_budget": "full"}] + [
    {"setting": f"{m}_fixed_{b}", "tau": TAU, "dense_vem_min": DENSE_MIN, "fixed_method": m, "fixed_budget": b} for m in METHODS for b in BUDGETS
]
_GRID = [{"setting": f"tau={t},rho={r}", "tau": t, "rho": r, "dense_vem_min": DENSE_MIN} for t in (0.1, 0.25, 0.5) for r in (None, 0.5, 0.9)]
_ABLATION = (
    [{"setting": f"tau={t}", "tau": t, "dense_vem_min": DENSE_MIN} for t in (0.1, 0.25, 0.5, 0.75, 1.0)]
    + [{"setting": f"only_{i}", "tau": TAU, "dense_vem_min": DENSE_MIN, "interventions": [i]} for i in ("blur", "gray")]
    + [{"setting": "all_available", "tau": TAU, "dense_vem_min": DENSE_MIN, "interventions": ["blur", "gray"]}]
    + [{"setting": "without_dense_reliance", "tau": TAU, "dense_vem_min": DENSE_MIN, "require_reliance": False}]
)


def _decide(rows: list[dict], kind: str = "cheapest"):
    run = {"cheapest": policy.cheapest_supported, "fixed": policy.fixed_budget, "cascade": lambda r, s: policy.cheapest_supported(r, s, cascade=True)}[kind]
    return lambda spark, sf: run(_records(spark, sf), policy.settings(spark, rows))


def _all_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Every policy's decisions over the test split, tagged by its name."""
    return policy.decision_sets(_records(spark, sf, None), METHODS, list(BUDGETS), TAU, dense_vem_min=DENSE_MIN)


_ACCURATE_SQL = """(SELECT arg_min(budget, budget_ord) FROM (SELECT budget, budget_ord, accuracy, max(accuracy) OVER () AS best FROM (SELECT budget, budget_ord, avg(ok::INT) AS accuracy FROM
    (SELECT budget, budget_ord, sample_id, bool_and(is_correct) AS ok FROM eval_records WHERE split = 'validation' AND method = '{m}' GROUP BY ALL) GROUP BY ALL)) WHERE accuracy >= best)"""


def _all_sql() -> str:
    """A subquery of all policies' decisions."""
    base = {"tau": TAU, "dense_vem_min": DENSE_MIN}
    of = lambda kind: [{**base, "setting": kind}] + [{**base, "setting": f"{m}_{kind}", "methods": [m]} for m in METHODS]
    fixed = [{**base, "setting": "dense_only", "fixed_method": "dense", "fixed_budget": "full"}]
    for m in METHODS:
        budgets = {"fixed_aggressive": "64", "fixed_medium": "256", "cost_only": "64", "accuracy_only": _Sql(_ACCURATE_SQL.format(m=m))}
        fixed += [{**base, "setting": f"{m}_{k}", "fixed_method": m, "fixed_budget": b} for k, b in budgets.items()]
    kinds = ((of("supported"), "cheapest"), (of("online"), "cascade"), (fixed, "fixed"))
    return " UNION ALL BY NAME ".join(f"SELECT * FROM ({_decisions_sql(rows, kind)} SELECT * FROM dec)" for rows, kind in kinds)


def _accuracy_only(spark: SparkSession, sf: str) -> DataFrame:
    return policy.accuracy_only_budget(_records(spark, sf, None)).withColumn("accuracy", r6("accuracy"))


def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    rows = policy.calibration(_records(spark, sf, None), policy.settings(spark, _GRID))
    return rows.select("setting", "n", "chosen", *(r6(c).alias(c) for c in ("coverage", "supported_rate", "accuracy", "mean_cost")))


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    rows = policy.eligible_interventions(_records(spark, sf), policy.settings(spark, _ONE))
    return rows.select("setting", "sample_id", "split", F.array_join("eligible", "|").alias("eligible"))


def _audit(spark: SparkSession, sf: str) -> DataFrame:
    return summary.reliance_audit(policy.with_eligible(_records(spark, sf), policy.settings(spark, _ONE)))


_AUDIT_RATES = """{a} AS dense_reliant_query_rate, {b} AS mean_eligible_interventions_per_query, {c} AS eligible_intervention_rate,
      {d} AS dense_correct_intervention_rate, {e} AS dense_supported_intervention_rate""".format(
    a=_r("n_dense_reliant_queries / n_test_queries"), b=_r("total_eligible_interventions / n_test_queries"), c=_r("total_eligible_interventions / total_dense_interventions"),
    d=_r("total_dense_correct_interventions / total_dense_interventions"), e=_r("total_dense_supported_interventions / total_dense_interventions"),
)

_RECORDS_SQL = f"""{with_views("eval_records")} SELECT sample_id, split, dataset, method, budget, budget_ord, intervention, is_correct, vem, dense_vem,
   reliance_retention, delta_vem, cost, latency_ms, token_count FROM eval_records"""


def _view(spark: SparkSession, sf: str) -> DataFrame:
    cols = "sample_id, split, dataset, method, budget, budget_ord, intervention, is_correct, vem, dense_vem, reliance_retention, delta_vem, cost, latency_ms, token_count"
    return _records(spark, sf, None).select(*cols.split(", "))


def _paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between two policies over the samples that both decide."""
    both = _all_decisions(spark, sf).where(F.col("setting").isin("supported", "dense_only"))
    a, b = both.where("setting = 'supported'").alias("a"), both.where("setting = 'dense_only'").alias("b")
    joined = a.join(b, ["sample_id", "split"])
    d = lambda c: r6(F.avg(F.col(f"a.{c}").cast("double")) - F.avg(F.col(f"b.{c}").cast("double")))
    return joined.agg(F.count("*").alias("n_common"), d("cost").alias("delta_cost"), d("latency_ms").alias("delta_latency_ms"), d("token_count").alias("delta_tokens"), r6(F.avg(F.col("a.is_correct").cast("int")) - F.avg(F.col("b.is_correct").cast("int"))).alias("delta_accuracy"))


def _dense_first(spark: SparkSession, sf: str) -> DataFrame:
    """Execution order: dense calls first, then by sample and budget; ranked within a dataset, so no global sort is needed."""
    calls = summary.first_calls(_records(spark, sf))
    w = Window.partitionBy("dataset").orderBy(F.col("method") != "dense", "sample_id", "budget_ord", "method")
    return calls.select("dataset", "sample_id", "method", "budget", F.row_number().over(w).alias("ordinal"))


_NAMES = {
    "supported": "Cheapest supported budget", "online": "Online cascade", "dense_only": "Dense, all tokens",
    **{f"{m}_{k}": f"{m} {v}" for m in METHODS for k, v in (("supported", "alone: cheapest supported budget"), ("online", "alone: online cascade"), ("fixed_aggressive", "fixed at 64"), ("fixed_medium", "fixed at 256"), ("accuracy_only", "by accuracy only"), ("cost_only", "by cost only"))},
}


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return reports.claims(summary.decision_summary(_all_decisions(spark, sf), "setting"), _audit(spark, sf), "topk_fixed_aggressive", "topk fixed at 64")


def _claims_sql() -> str:
    side = lambda setting, p: f"{p} AS (SELECT * FROM c WHERE setting = '{setting}')"
    pct, pp = lambda x: f"printf('%.1f%%', 100 * {x})", lambda x: f"printf('%+.1f pp', 100 * ({x}))"
    return f"""WITH every AS ({_all_sql()}), c AS (SELECT setting, {_SUM_SQL} FROM every GROUP BY setting), {side("supported", "su")}, {side("dense_only", "de")}, {side("topk_fixed_aggressive", "ag")},
      au AS (SELECT count(*) AS asked, count(*) FILTER (n > 0) AS kept FROM (SELECT sample_id, split, count(*) FILTER (is_correct AND vem >= {max(TAU, DENSE_MIN)}) AS n FROM ({with_views("eval_records")} SELECT * FROM eval_records)
             WHERE method = 'dense' AND split = 'test' GROUP BY ALL))
      SELECT {_r("100 * su.mean_token_reduction")} AS token_reduction_vs_dense_pct, {_r("100 * su.dense_avoidance_rate")} AS dense_avoidance_pct,
        {_r("100 * (su.visually_supported_rate - ag.visually_supported_rate)")} AS visual_support_gain_vs_fixed_aggressive_pp, {_r("100 * (su.accuracy - ag.accuracy)")} AS accuracy_gain_vs_fixed_aggressive_pp,
        {_r("su.cost_per_visually_supported_answer - ag.cost_per_visually_supported_answer")} AS cost_per_supported_delta_vs_fixed_aggressive,
        {_r("su.cost_per_visually_supported_answer - de.cost_per_visually_supported_answer")} AS cost_per_supported_delta_vs_dense,
        {_r("su.measured_energy_per_visually_supported_answer_joule - de.measured_energy_per_visually_supported_answer_joule")} AS measured_energy_per_supported_delta_vs_dense_joule,
        {_r("100 * (su.visually_supported_rate - de.visually_supported_rate)")} AS visual_support_delta_vs_dense_pp, {_r("100 * (su.accuracy - de.accuracy)")} AS accuracy_delta_vs_dense_pp,
        'Dense-reliant evaluation keeps ' || kept || ' of ' || asked || ' test queries, on which dense inference is itself supported.' || chr(10) || 'Compressed budgets are taken for ' || {pct("su.dense_avoidance_rate")} || ' of them, and '
        || {pct("su.visually_supported_rate")} || ' stay supported.' || chr(10) || 'Against dense inference, tokens fall by ' || {pct("su.mean_token_reduction")} || ' on average.' || chr(10) || 'Against topk fixed at 64, support changes by '
        || {pp("su.visually_supported_rate - ag.visually_supported_rate")} || ' and accuracy by ' || {pp("su.accuracy - ag.accuracy")} || '.' || chr(10) || 'Against dense inference, accuracy changes by ' || {pp("su.accuracy - de.accuracy")} || '.' AS sentences
      FROM su, de, ag, au"""


_CALLS_SQL = f"""{with_views("eval_records")}, calls1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, method, budget ORDER BY intervention) AS rn
    FROM eval_records WHERE split = 'test') WHERE rn = 1)"""

QUERIES = {
    "eval_records_view": (_view, _RECORDS_SQL),
    "budget_order": (
        lambda s, sf: _records(s, sf, None).groupBy("budget").agg(F.min("budget_ord").alias("budget_ord"), F.count("*").alias("n")),
        f"{with_views('eval_records')} SELECT budget, min(budget_ord) AS budget_ord, count(*) AS n FROM eval_records GROUP BY budget",
    ),
    "dense_vem_join": (
        lambda s, sf: _records(s, sf, None).where("method <> 'dense'").groupBy("method").agg(F.count("*").alias("n"), F.count("dense_vem").alias("with_dense"), F.count("reliance_retention").alias("with_retention"), r6(F.avg("delta_vem")).alias("mean_delta_vem")),
        f"{with_views('eval_records')} SELECT method, count(*) AS n, count(dense_vem) AS with_dense, count(reliance_retention) AS with_retention, {_r('avg(delta_vem)')} AS mean_delta_vem FROM eval_records WHERE method <> 'dense' GROUP BY method",
    ),
    "eligible_interventions": (
        _eligible,
        _candidates_sql(_ONE, "r.split = 'test'")
        + " SELECT k.setting, k.sample_id, k.split, coalesce(string_agg(el.intervention, '|' ORDER BY el.intervention), '') AS eligible FROM (SELECT DISTINCT setting, sample_id, split FROM e) k LEFT JOIN el USING (setting, sample_id, split) GROUP BY ALL",
    ),
    "policy_cheapest_supported": (
        lambda s, sf: summary.decision_summary(_decide(_ONE)(s, sf), "setting", "dataset"),
        f"{_decisions_sql(_ONE)} SELECT setting, dataset, {_SUM_SQL} FROM dec GROUP BY ALL",
    ),
    "policy_decisions": (_decide(_ONE + _RHO + _BY_METHOD), f"{_decisions_sql(_ONE + _RHO + _BY_METHOD)} SELECT * FROM dec"),
    "policy_online_cascade": (_decide(_ONE + _RHO, "cascade"), f"{_decisions_sql(_ONE + _RHO, 'cascade')} SELECT * FROM dec"),
    "policy_fixed_budget": (_decide(_FIXED, "fixed"), f"{_decisions_sql(_FIXED, 'fixed')} SELECT * FROM dec"),
    "policy_accuracy_only": (
        _accuracy_only,
        f"""{with_views("eval_records")}, x AS (SELECT method, budget, budget_ord, avg(ok::INT) AS accuracy FROM (SELECT method, budget, budget_ord, sample_id, bool_and(is_correct) AS ok
            FROM eval_records WHERE split = 'validation' AND method <> 'dense' GROUP BY ALL) GROUP BY ALL),
            y AS (SELECT *, max(accuracy) OVER (PARTITION BY method) AS best FROM x)
            SELECT method, arg_min(budget, budget_ord) AS budget, {_r("arg_min(accuracy, budget_ord)")} AS accuracy FROM y WHERE accuracy >= best GROUP BY method""",
    ),
    "threshold_calibration": (
        _calibration,
        f"""{_decisions_sql(_GRID, where="r.split = 'validation'")}, n AS (SELECT count(DISTINCT sample_id) AS n FROM eval_records WHERE split = 'validation' AND method = 'dense'),
            sc AS (SELECT setting, count(*) AS n, count(*) / (SELECT n FROM n) AS coverage, avg(accepted::INT) AS supported_rate, avg(is_correct::INT) AS accuracy, avg(cost) AS mean_cost FROM dec GROUP BY setting)
            SELECT setting, n, {_r("coverage")} AS coverage, {_r("supported_rate")} AS supported_rate, {_r("accuracy")} AS accuracy, {_r("mean_cost")} AS mean_cost,
                   row_number() OVER (ORDER BY coverage DESC, supported_rate DESC, accuracy DESC, round(mean_cost, 6), setting) = 1 AS chosen FROM sc""",
    ),
    "decision_summary": (
        lambda s, sf: summary.decision_summary(_decide(_FIXED, "fixed")(s, sf), "setting"),
        f"{_decisions_sql(_FIXED, 'fixed')} SELECT setting, {_SUM_SQL} FROM dec GROUP BY setting",
    ),
    "decision_by_dataset": (
        lambda s, sf: summary.decision_summary(_decide(_BY_METHOD)(s, sf), "setting", "dataset"),
        f"{_decisions_sql(_BY_METHOD)} SELECT setting, dataset, {_SUM_SQL} FROM dec GROUP BY ALL",
    ),
    "budget_curve": (
        lambda s, sf: summary.decision_summary(_decide(_FIXED, "fixed")(s, sf), "setting", "selected_method", "selected_budget"),
        f"{_decisions_sql(_FIXED, 'fixed')} SELECT setting, selected_method, selected_budget, {_SUM_SQL} FROM dec GROUP BY ALL",
    ),
    "selection_histogram": (
        lambda s, sf: summary.selection_histogram(_decide(_ONE + _BY_METHOD)(s, sf), "setting"),
        f"{_decisions_sql(_ONE + _BY_METHOD)} SELECT setting, selected_method, selected_budget, count(*) AS n FROM dec GROUP BY ALL",
    ),
    "policy_comparison": (lambda s, sf: summary.decision_summary(_all_decisions(s, sf), "setting"), f"WITH every AS ({_all_sql()}) SELECT setting, {_SUM_SQL} FROM every GROUP BY setting"),
    "policy_table": (
        lambda s, sf: reports.comparison_table(summary.decision_summary(_all_decisions(s, sf), "setting"), reports.policy_names(list(METHODS), list(BUDGETS))),
        f"""WITH every AS ({_all_sql()}), c AS (SELECT setting, {_SUM_SQL} FROM every GROUP BY setting), l AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(_NAMES.items()))}) AS t(place, setting, label))
            SELECT place, c.setting AS policy, label, n, {", ".join(f"{_r(f'100 * {c}')} AS {n}" for n, c in reports.PERCENT.items())}, {", ".join(reports.PLAIN)}, selected_budget_distribution AS selected_budgets,
                   selected_method_distribution AS selected_methods FROM c JOIN l ON l.setting = c.setting""",
    ),
    "policy_claims": (_claims, _claims_sql()),
    "record_summary": (
        lambda s, sf: summary.record_summary(_records(s, sf, None)),
        f"""{with_views("eval_records")} SELECT method, budget, intervention, count(*) AS n, {_r("avg(is_correct::INT)")} AS accuracy, {_r("avg(vem)")} AS mean_vem,
            {_r("avg(reliance_retention)")} AS mean_rr, {_r("avg(delta_vem)")} AS mean_delta_vem, {_r("avg(shortcut_persistence::INT)")} AS shortcut_persistence_rate,
            {_r("avg(latency_ms)")} AS mean_latency_ms, {_r("avg(token_count)")} AS mean_token_count, round(sum(cost), 2) AS total_cost,
            {_r("sum(cost) / greatest(count(*) FILTER (is_correct), 1)")} AS cost_per_accurate_answer,
            {_r("sum(cost) / greatest(count(*) FILTER (vem >= 0), 1)")} AS cost_per_visually_supported_answer FROM eval_records GROUP BY ALL""",
    ),
    "macro_summary": (
        lambda s, sf: summary.macro_summary(_decide(_ONE + _BY_METHOD)(s, sf)),
        f"""{_decisions_sql(_ONE + _BY_METHOD)}, per AS (SELECT setting, dataset, {_SUM_SQL} FROM dec GROUP BY ALL),
            long AS ({" UNION ALL ".join(f"SELECT setting, dataset, '{m}' AS metric, {m} AS value FROM per" for m in summary.MACRO)})
            SELECT setting, metric, {_r("avg(value)")} AS macro_mean, count(*) AS n_datasets FROM long WHERE value IS NOT NULL GROUP BY ALL""",
    ),
    "reliance_audit_rollup": (
        _audit,
        f"""{_candidates_sql(_ONE, "r.split = 'test'")},
            per AS (SELECT sample_id, split, min(dataset) FILTER (method = 'dense') AS dataset, count(*) FILTER (method = 'dense') AS d, count(*) FILTER (method = 'dense' AND is_correct) AS r,
                    count(*) FILTER (method = 'dense' AND is_correct AND vem >= greatest(dense_vem_min, tau)) AS s FROM e GROUP BY sample_id, split),
            p2 AS (SELECT per.*, coalesce(ne.n_eligible, 0) AS el FROM per LEFT JOIN ne USING (sample_id, split) WHERE d > 0),
            t AS (SELECT CASE WHEN grouping(dataset) = 1 THEN '_all' ELSE dataset END AS dataset, count(*) AS n_test_queries, count(*) FILTER (el > 0) AS n_dense_reliant_queries,
                  sum(d)::BIGINT AS total_dense_interventions, sum(r)::BIGINT AS total_dense_correct_interventions, sum(s)::BIGINT AS total_dense_supported_interventions,
                  sum(el)::BIGINT AS total_eligible_interventions FROM p2 GROUP BY ROLLUP (dataset))
            SELECT *, {_AUDIT_RATES} FROM t""",
    ),
    "policy_ablation": (
        lambda s, sf: summary.decision_summary(_decide(_ABLATION)(s, sf), "setting"),
        f"{_decisions_sql(_ABLATION)} SELECT setting, {_SUM_SQL} FROM dec GROUP BY setting",
    ),
    "qualitative_topk": (
        lambda s, sf: summary.qualitative_top(_records(s, sf)).select("sample_id", "method", "budget", "intervention", "vem", "dense_vem", "cost"),
        f"""{with_views("eval_records")} SELECT sample_id, method, budget, intervention, vem, dense_vem, cost FROM eval_records WHERE split = 'test' AND method <> 'dense' AND is_correct AND vem < dense_vem
            ORDER BY vem - dense_vem, cost, sample_id, method, budget, intervention LIMIT 12""",
    ),
    "paired_delta": (
        _paired_delta,
        f"""{_decisions_sql(_ONE)}, fx AS (SELECT * FROM ag WHERE covers AND method = 'dense' AND budget = 'full')
            SELECT count(*) AS n_common, {_r("avg(a.cost) - avg(b.cost)")} AS delta_cost, {_r("avg(a.latency_ms) - avg(b.latency_ms)")} AS delta_latency_ms,
                   {_r("avg(a.token_count) - avg(b.token_count)")} AS delta_tokens, {_r("avg(a.is_correct::INT) - avg(b.is_correct::INT)")} AS delta_accuracy
            FROM dec a JOIN fx b USING (sample_id, split)""",
    ),
    "dense_first_order": (
        _dense_first,
        f"{_CALLS_SQL} SELECT dataset, sample_id, method, budget, row_number() OVER (PARTITION BY dataset ORDER BY method <> 'dense', sample_id, budget_ord, method) AS ordinal FROM calls1",
    ),
    "cost_boundary_pivot": (
        lambda s, sf: summary.cost_boundary(_records(s, sf)),
        f"{_CALLS_SQL} SELECT method, " + ", ".join(f"{_r(f'avg(energy_joule) FILTER (budget = {b!r})')} AS mean_energy_{b}, {_r(f'avg(latency_ms) FILTER (budget = {b!r})')} AS mean_latency_{b}, nullif(count(energy_joule) FILTER (budget = {b!r}), 0) AS calls_with_energy_{b}" for b in (*BUDGETS, "full")) + " FROM calls1 GROUP BY method",
    ),
    "reduction_against_dense": (
        lambda s, sf: summary.reduction_against_dense(_records(s, sf)),
        f"""{_CALLS_SQL}, m AS (SELECT method, budget, count(*) AS n, avg(energy_joule) AS e, avg(latency_ms) AS l FROM calls1 GROUP BY ALL), d AS (SELECT e AS de, l AS dl FROM m WHERE method = 'dense')
            SELECT method, budget, n, {_r("1 - e / de")} AS energy_reduction, {_r("1 - l / dl")} AS latency_reduction FROM m CROSS JOIN d WHERE method <> 'dense'""",
    ),
}
