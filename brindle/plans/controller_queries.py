"""Queries over safety labels, controllers and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import answers as A
from brindle.functions.numbers import r6, wilson_interval, wilson_upper
from brindle.operators import controller, safety, stats
from brindle.operators.prefixes import exact_quantiles
from brindle.sources.adapters import view, with_views

_R, _L, _S = with_views("eval_records"), with_views("labels_by_budget"), with_views("samples")
RELIANT = 0.25
BUDGETS = (64, 128, 256, 448)


def _r(x: str) -> str:
    return f"round({x} + 1e-9, 6)"


def _labels(s, sf):
    return safety.strict_labels(view(s, sf, "eval_records"), RELIANT)


_LABELS_SQL = f"""{_R}, d AS (SELECT sample_id, intervention, vem >= {RELIANT} AS el, answer AS da, is_correct AS dr FROM eval_records WHERE method = 'dense'),
  f AS (SELECT sample_id, arg_min(da, intervention) AS dense_answer, arg_min(dr, intervention) AS dense_correct, count(*) FILTER (el) AS n_eligible FROM d GROUP BY sample_id),
  a AS (SELECT r.sample_id, r.split, r.dataset, r.method, r.budget, r.budget_ord, arg_min(r.answer, r.intervention) AS answer, arg_min(r.is_correct, r.intervention) AS is_correct,
        count(DISTINCT r.intervention) FILTER (coalesce(d.el, false)) AS cov, coalesce(bool_and(r.answer = d.da) FILTER (d.el), true) AS sc, coalesce(bool_and(r.vem >= {RELIANT}) FILTER (d.el), true) AS ap
        FROM eval_records r LEFT JOIN d ON r.sample_id = d.sample_id AND r.intervention = d.intervention GROUP BY ALL),
  lab AS (SELECT sample_id, split, dataset, method, budget, budget_ord, n_eligible, cov = n_eligible AS covers, dense_correct, answer = dense_answer AS answer_fidelity,
          cov = n_eligible AND sc AS intervention_fidelity, cov = n_eligible AND ap AS intervention_pass, answer = dense_answer AND cov = n_eligible AND sc AS reference_safe,
          CASE WHEN dense_correct AND n_eligible > 0 THEN is_correct AND cov = n_eligible AND sc END AS gold_safe FROM a JOIN f USING (sample_id))"""
_PATTERN_SQL = f"""{_LABELS_SQL}, p AS (SELECT sample_id, method, """ + " || ".join(f"coalesce(max(reference_safe::INT::VARCHAR) FILTER (budget = '{b}'), '0')" for b in ("64", "128", "256", "432")) + """ AS pattern
  FROM lab WHERE method <> 'dense' GROUP BY sample_id, method), pat AS (SELECT sample_id, method, pattern, NOT contains(pattern, '10') AS monotonic,
  coalesce(list_extract(['64', '128', '256', '432'], nullif(instr(pattern, '1'), 0)), 'full') AS min_safe_budget FROM p)"""


def _wilson(s, sf):
    g = view(s, sf, "labels_by_budget").groupBy("dataset", "budget").agg(F.count_if("reference_safe").alias("k"), F.count("*").alias("n"))
    low, high = wilson_interval(F.col("k"), F.col("n"))
    return g.select("dataset", "budget", "k", "n", r6(low).alias("low"), r6(high).alias("high"))


def _wilson_upper(s, sf):
    g = view(s, sf, "labels_by_budget").groupBy("dataset", "budget").agg(F.count_if(~F.col("reference_safe")).alias("k"), F.count("*").alias("n"))
    return g.select("dataset", "budget", "k", "n", r6(wilson_upper(F.col("k"), F.col("n"))).alias("upper"))


_Z2, _Z1 = 1.959963984540054, 1.6448536269514722

#: A small artifact: a model per budget over the 17 features.
_ARTIFACT = {
    "feature_names": list(controller.FEATURE_NAMES),
    "selection_rule": controller.RULE,
    "global_threshold": 0.5,
    "models": {
        str(b): {"weights": [0.2 * i - 0.5, *[0.1 * ((j + i) % 3) for j in range(17)]], "means": [0.1 * (j % 4) for j in range(17)], "scales": [0.5 + 0.1 * (j % 3) for j in range(17)]}
        for i, b in enumerate((64, 128, 256, 432))
    },
}


def _featured(s, sf):
    rows = view(s, sf, "samples")
    return rows.withColumn("features", A.question_features(F.col("question"), F.array(F.lit("a"), F.lit("b")), F.col("dataset")))


def _decide(s, sf):
    got = controller.decide(_featured(s, sf), _ARTIFACT)
    return got.select("sample_id", "selected_budget", *(r6(F.col("probabilities")[str(b)]).alias(f"p{b}") for b in (64, 128, 256, 432)))


def _decide_sql() -> str:
    q = "question"
    space = "[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
    words = f"len(list_filter(string_split(trim(regexp_replace({q}, '{space}', ' ', 'g')), ' '), lambda w: w <> ''))"
    f = [f"least({words} / 50.0::DOUBLE, 2)", f"least(length({q}) / 300.0::DOUBLE, 2)", "0.5::DOUBLE", "1::DOUBLE", *[f"(dataset = '{d}')::INT::DOUBLE" for d in A.DATASETS]]
    f += ["(" + " OR ".join(f"contains(lower({q}), '{w}')" for w in ws) + ")::INT::DOUBLE" for ws in A.KEYWORDS.values()]
    probs = []
    for b, m in _ARTIFACT["models"].items():
        z = " + ".join([repr(m["weights"][0]), *(f"(x{j} - {m['means'][j]!r}) / {m['scales'][j]!r} * {m['weights'][j + 1]!r}" for j in range(17))])
        probs.append(f"1 / (1 + exp(-({z}::DOUBLE))) AS p{b}")
    pick = "CASE " + " ".join(f"WHEN p{b} >= 0.5 THEN '{b}'" for b in _ARTIFACT["models"]) + " ELSE 'dense' END"
    return f"""{_S}, f AS (SELECT sample_id, {", ".join(f"{x} AS x{i}" for i, x in enumerate(f))} FROM samples), p AS (SELECT sample_id, {", ".join(probs)} FROM f)
      SELECT sample_id, {pick} AS selected_budget, {", ".join(f"{_r(f'p{b}')} AS p{b}" for b in _ARTIFACT["models"])} FROM p"""


def _fit(s, sf):
    rows = _featured(s, sf).join(view(s, sf, "labels_by_budget").select("sample_id", "budget", F.col("reference_safe").alias("safe")), "sample_id").withColumn("key", F.col("sample_id"))
    fold = rows.withColumn("fold", (F.col("sample_id") % 2).cast("int"))
    models = controller.fit_cells(fold, "budget", "fold", steps=200)
    return models.select("budget", "fold", "n", *(r6(F.element_at("weights", i)).alias(f"w{i}") for i in (1, 2, 3)))


def _folds(s, sf):
    labels = view(s, sf, "labels_by_budget").select("sample_id", "budget", F.col("reference_safe").alias("safe"))
    rows = _featured(s, sf).join(labels, "sample_id").select(F.col("sample_id").alias("key"), (F.col("sample_id") % 5).cast("int").alias("fold"), "budget", "features", "safe")
    return controller.scored_rows(controller.out_of_fold(rows, steps=100, places=[0, 1, 10, 11, 12]))


def _cross_fit(s, sf):
    """Out-of-fold scores and what the policy of one threshold does with them, per fold."""
    got = controller.replay(_folds(s, sf), 0.6, BUDGETS)
    return got.select("fold", "n", "unsafe", "avoided", "oracle_avoided", r6("mean_tokens").alias("mean_tokens"), r6("oracle_tokens").alias("oracle_tokens"))


def _cross_fit_threshold(s, sf):
    return stats.risk_bounded_threshold(_folds(s, sf), BUDGETS, risk=0.35)


def _standardizer(s, sf):
    rows = _featured(s, sf).select("sample_id", F.posexplode("features").alias("place", "value"))
    scale = F.greatest(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), F.lit(1e-8))
    return rows.where("place in (0, 1)").groupBy("place").agg(r6(F.avg("value")).alias("mean"), r6(scale).alias("scale"))


def _threshold(s, sf):
    rows = view(s, sf, "labels_by_budget").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("budget", "score", "reference_safe"))).alias("x"))
    rows = rows.select(F.col("sample_id").alias("key"), F.transform("x", lambda e: e["score"]).alias("scores"), F.transform("x", lambda e: e["reference_safe"]).alias("safe"))
    return stats.risk_bounded_threshold(rows, BUDGETS, risk=0.2)


_THRESHOLD_SQL = f"""{_L}, c AS (SELECT DISTINCT score AS th FROM labels_by_budget UNION SELECT 1.000001 UNION SELECT 0.0),
  ch AS (SELECT th, sample_id, arg_min(budget, budget) FILTER (score >= th) AS b, arg_min(reference_safe, budget) FILTER (score >= th) AS safe FROM c CROSS JOIN labels_by_budget GROUP BY th, sample_id),
  g AS (SELECT th, count(*) AS n, count(*) FILTER (b IS NOT NULL AND NOT safe) AS k, count(b) AS av, sum(coalesce(b, 576)) AS tok FROM ch GROUP BY th),
  w AS (SELECT *, (k / n + {_Z1 * _Z1} / (2 * n) + {_Z1} * sqrt(k / n * (1 - k / n) / n + {_Z1 * _Z1} / (4.0 * n * n))) / (1 + {_Z1 * _Z1} / n) AS u FROM g)
  SELECT {_r("th")} AS threshold, k AS unsafe_acceptance_count, {_r("u")} AS wilson_upper, {_r("av / n")} AS dense_avoidance_rate, {_r("tok / n")} AS mean_selected_tokens
  FROM w WHERE u <= 0.2 ORDER BY av DESC, tok, th DESC LIMIT 1"""


def _ranking(s, sf):
    return stats.ranking_quality(view(s, sf, "labels_by_budget").withColumn("y", F.col("reference_safe").cast("int")), "y", "score", "budget")


_RANKING_SQL = f"""{_L}, x AS (SELECT budget, reference_safe::INT AS y, score, least(greatest(score, 1e-15), 1 - 1e-15) AS p, rank() OVER (PARTITION BY budget ORDER BY score) + (count(*) OVER (PARTITION BY budget, score) - 1) / 2 AS rk FROM labels_by_budget)
  SELECT budget, count(*) AS n, {_r("avg((score - y) * (score - y))")} AS brier, {_r("-avg(y * ln(p) + (1 - y) * ln(1 - p))")} AS log_loss,
         {_r("(sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0)")} AS auroc FROM x GROUP BY budget"""


def _kappa(s, sf):
    rows = view(s, sf, "labels_by_budget").groupBy("sample_id").agg(F.max_by("reference_safe", "budget").alias("a"), F.min_by("reference_safe", "budget").alias("b"))
    return stats.cohen_kappa(rows, "a", "b")


def _bootstrap(s, sf):
    rows = view(s, sf, "eval_records").where("split = 'test'").withColumn("row", F.col("sample_id") * 31 + F.col("budget_ord"))
    one = F.lit(1.0)
    metrics = {"accuracy": (F.col("is_correct").cast("double"), one), "mean_cost": (F.col("cost"), one), "energy": (F.col("measured_energy_joule"), one)}
    return stats.bootstrap(rows, metrics, "row", 50, 7, "method")


def _bootstrap_sql() -> str:
    x = "(((row % 1000003) * 7919 + draw * 104729 + 7 * 15485863) % 1000003)"
    u = f"(({x} * {x} + row % 999983 + draw * 31) % 1000003) / 1000003.0::DOUBLE"
    w = " + ".join(f"(u >= {c})::INT" for c in stats._POISSON)
    values = {"accuracy": ("is_correct::INT", "true"), "mean_cost": ("cost", "true"), "energy": ("measured_energy_joule", "measured_energy_joule IS NOT NULL")}
    long = " UNION ALL ".join(f"SELECT method, draw, '{n}' AS metric, sum(w * {a}) / nullif(sum(w) FILTER ({c}), 0) AS value FROM ww GROUP BY method, draw" for n, (a, c) in values.items())
    return f"""{_R}, t AS (SELECT *, sample_id * 31 + budget_ord AS row FROM eval_records WHERE split = 'test'), dr AS (SELECT t.*, draw::BIGINT AS draw FROM t CROSS JOIN range(-1, 50) AS g(draw)),
      ww AS (SELECT *, CASE WHEN draw < 0 THEN 1 ELSE {w} END AS w FROM (SELECT *, {u} AS u FROM dr)), long AS ({long})
      SELECT method, metric, {_r("max(value) FILTER (draw < 0)")} AS point, {_r("quantile_cont(value, 0.025) FILTER (draw >= 0)")} AS ci_low, {_r("quantile_cont(value, 0.975) FILTER (draw >= 0)")} AS ci_high FROM long GROUP BY ALL"""


def _pareto(s, sf):
    rows = view(s, sf, "eval_records").groupBy("dataset", "method", "budget").agg(r6(F.avg(F.col("is_correct").cast("int"))).alias("accuracy"), r6(F.avg("latency_ms")).alias("latency"))
    return stats.pareto_front(rows, "accuracy", "latency", "dataset")


def _quantiles(s, sf):
    found = exact_quantiles(view(s, sf, "eval_records"), "cost", {"linear": 0.9, "lower": 0.9, "middle": 0.5}, "method", "budget", lower=("lower",))
    return found.select("method", "budget", *(r6(c).alias(c) for c in ("linear", "lower", "middle")))


QUERIES = {
    "strict_labels": (_labels, f"{_LABELS_SQL} SELECT * FROM lab"),
    "safety_patterns": (lambda s, sf: safety.pattern_counts(safety.patterns(_labels(s, sf))), f"{_PATTERN_SQL} SELECT method, pattern, monotonic, count(*) AS n FROM pat GROUP BY ALL"),
    "min_safe_budget": (lambda s, sf: safety.patterns(_labels(s, sf)), f"{_PATTERN_SQL} SELECT * FROM pat"),
    "safety_populations": (
        lambda s, sf: safety.populations(_labels(s, sf)),
        f"""{_LABELS_SQL} SELECT method, split, count(*) AS n, count(*) FILTER (dense_correct) AS n_dense_correct, count(*) FILTER (dense_correct AND n_eligible > 0) AS n_dense_correct_reliant,
            {_r("avg(reference_safe::INT)")} AS safe_full, {_r("avg(reference_safe::INT) FILTER (dense_correct)")} AS safe_dense_correct,
            {_r("avg(reference_safe::INT) FILTER (dense_correct AND n_eligible > 0)")} AS safe_dense_correct_reliant FROM lab WHERE method <> 'dense' GROUP BY method, split""",
    ),
    "dense_answer_constant": (
        lambda s, sf: safety.constant_dense_answer(view(s, sf, "eval_records")),
        f"{_R} SELECT sample_id, count(DISTINCT answer) AS answers FROM eval_records WHERE method = 'dense' GROUP BY sample_id HAVING count(DISTINCT answer) > 1",
    ),
    "labels_later_wins": (
        lambda s, sf: safety.later_wins([view(s, sf, "labels_by_budget"), view(s, sf, "labels_by_budget").where("sample_id % 3 = 0").withColumn("reference_safe", ~F.col("reference_safe"))], "sample_id", "budget").groupBy("budget").agg(F.count_if("reference_safe").alias("safe"), F.count("*").alias("n")),
        f"{_L} SELECT budget, count(*) FILTER (CASE WHEN sample_id % 3 = 0 THEN NOT reference_safe ELSE reference_safe END) AS safe, count(*) AS n FROM labels_by_budget GROUP BY budget",
    ),
    "labels_map": (
        lambda s, sf: safety.label_map(view(s, sf, "labels_by_budget"), "sample_id", F.col("budget"), F.col("reference_safe")).select("sample_id", F.size("safe").cast("long").alias("n"), F.size(F.map_filter("safe", lambda k, v: v)).cast("long").alias("n_safe")),
        f"{_L} SELECT sample_id, count(*) AS n, count(*) FILTER (reference_safe) AS n_safe FROM labels_by_budget GROUP BY sample_id",
    ),
    "wilson_two_sided": (
        _wilson,
        f"""{_L}, g AS (SELECT dataset, budget, count(*) FILTER (reference_safe) AS k, count(*) AS n FROM labels_by_budget GROUP BY ALL),
            h AS (SELECT *, k / n AS p, 1 + {_Z2 * _Z2} / n AS sc FROM g), c AS (SELECT *, (p + {_Z2 * _Z2} / (2 * n)) / sc AS m, {_Z2} * sqrt(p * (1 - p) / n + {_Z2 * _Z2} / (4.0 * n * n)) / sc AS r FROM h)
            SELECT dataset, budget, k, n, {_r("greatest(m - r, 0)")} AS low, {_r("least(m + r, 1)")} AS high FROM c""",
    ),
    "wilson_one_sided": (
        _wilson_upper,
        f"""{_L}, g AS (SELECT dataset, budget, count(*) FILTER (NOT reference_safe) AS k, count(*) AS n FROM labels_by_budget GROUP BY ALL)
            SELECT dataset, budget, k, n, {_r(f"(k / n + {_Z1 * _Z1} / (2 * n) + {_Z1} * sqrt(k / n * (1 - k / n) / n + {_Z1 * _Z1} / (4.0 * n * n))) / (1 + {_Z1 * _Z1} / n)")} AS upper FROM g""",
    ),
    "controller_decide": (_decide, _decide_sql()),
    "controller_dense_control": (
        lambda s, sf: controller.decide(_featured(s, sf), {**_ARTIFACT, "global_threshold": 2.0}).groupBy("selected_budget").agg(F.count("*").alias("n")),
        f"{_S} SELECT 'dense' AS selected_budget, count(*) AS n FROM samples",
    ),
    "controller_fit": (_fit, None),
    "controller_cross_fit": (_cross_fit, None),
    "controller_cross_fit_threshold": (_cross_fit_threshold, None),
    "standardizer_fit": (
        _standardizer,
        _decide_sql().split(", p AS (")[0] + f" SELECT 0 AS place, {_r('avg(x0)')} AS mean, {_r('greatest(stddev_samp(x0), 1e-8)')} AS scale FROM f UNION ALL SELECT 1, {_r('avg(x1)')}, {_r('greatest(stddev_samp(x1), 1e-8)')} FROM f",
    ),
    "risk_bounded_threshold": (_threshold, _THRESHOLD_SQL),
    "auroc_brier_logloss": (_ranking, _RANKING_SQL),
    "cohen_kappa": (
        _kappa,
        f"""{_L}, p AS (SELECT sample_id, arg_max(reference_safe, budget) AS a, arg_min(reference_safe, budget) AS b FROM labels_by_budget GROUP BY sample_id),
            o AS (SELECT count(*) AS n, avg((a = b)::INT) AS o, avg(a::INT) * avg(b::INT) + (1 - avg(a::INT)) * (1 - avg(b::INT)) AS e, count(*) FILTER (a) AS a1, count(*) FILTER (NOT a) AS a0, count(*) FILTER (b) AS b1, count(*) FILTER (NOT b) AS b0 FROM p)
            SELECT n, {_r("o")} AS agreement, {_r("(o - e) / (1 - e)")} AS kappa, '{{"false":' || a0 || ',"true":' || a1 || '}}' AS a_distribution, '{{"false":' || b0 || ',"true":' || b1 || '}}' AS b_distribution FROM o""",
    ),
    "bootstrap_ci": (_bootstrap, _bootstrap_sql()),
    "pareto_front": (
        _pareto,
        f"""{_R}, p AS (SELECT dataset, method, budget, {_r("avg(is_correct::INT)")} AS accuracy, {_r("avg(latency_ms)")} AS latency FROM eval_records GROUP BY ALL)
            SELECT *, NOT EXISTS (SELECT 1 FROM p q WHERE q.dataset = p.dataset AND q.accuracy >= p.accuracy AND q.latency <= p.latency AND (q.accuracy > p.accuracy OR q.latency < p.latency)) AS efficient FROM p""",
    ),
    "quantile_rules": (
        _quantiles,
        f"""{_R} SELECT method, budget, {_r("quantile_cont(cost, 0.9)")} AS linear, {_r("list_sort(list(cost))[1 + floor(0.9::DOUBLE * (count(*) - 1))::INT]")} AS lower, {_r("median(cost)")} AS middle FROM eval_records GROUP BY ALL""",
    ),
}
