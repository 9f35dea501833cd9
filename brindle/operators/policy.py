"""Budget policies: the cheapest accepted budget, cascades, fixed budgets, threshold calibration.

Policies take a small table of settings, so a grid of thresholds, methods or intervention sets is one query over the
records and never a loop of jobs. Everything about a sample is decided in its own partition: one shuffle by
(sample, split) serves eligibility, aggregation, ordering and choice. Settings that differ only in what they choose share their candidates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.numbers import ratio

KEY = ("setting", "sample_id", "split")
SETTING = (
    "setting string, tau double, rho double, dense_vem_min double, require_reliance boolean, methods array<string>, "
    "interventions array<string>, fixed_method string, fixed_budget string"
)
#: What a budget spends, and columns that records need not have.
SPENT = ("cost", "latency_ms", "energy_joule", "measured_energy_joule", "proxy_energy_joule")
OPTIONAL = {"measured_energy_joule": "double", "proxy_energy_joule": "double", "api_cost_usd": "double", "support_metric": "string"}
ONLINE = {"cost": "online_cumulative_cost", "latency_ms": "online_cumulative_latency_ms", "energy_joule": "online_cumulative_energy_joule"}
#: Most rows of a table of settings: it is sent to all tasks.
MOST_SETTINGS = 10_000


def settings(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """A table of settings; what a row leaves out is null, but reliance is required unless it says otherwise."""
    names = [x.split()[0] for x in SETTING.split(", ")]
    data = [tuple({"require_reliance": True, "dense_vem_min": 0.0, **r}.get(n) for n in names) for r in rows]
    if len(data) > MOST_SETTINGS:
        raise ValueError(f"{len(data)} settings; at most {MOST_SETTINGS} can be run at once")
    return spark.createDataFrame(data, SETTING)


def passes(vem: Column, retention: Column, tau: Column, rho: Column) -> Column:
    """A record's support: vem reaches tau and, where rho is set, retention is there and reaches rho."""
    return (vem >= tau) & (rho.isNull() | F.coalesce(retention >= rho, F.lit(False)))


def with_eligible(records: DataFrame, table: DataFrame) -> DataFrame:
    """Records times settings, with ``eligible``: the sample's interventions that a budget has to pass.

    With dense records: those where dense is right and reaches the larger threshold, or all dense ones if reliance isn't
    required. Without: those whose dense margin is unknown or reaches it. What a sample's records say is collected before they meet the
    settings, so that nothing is sorted once a setting.
    """
    w = Window.partitionBy("sample_id", "split")
    dense = F.col("method") == "dense"
    of = lambda here, *names: F.collect_list(F.when(here, F.struct("intervention", *names))).over(w)  # noqa: E731  a sample has a handful of records
    rows = records.withColumns({"_dense": of(dense, "is_correct", "vem"), "_rest": of(~F.coalesce(dense, F.lit(False)), "dense_vem")})
    rows = rows.crossJoin(F.broadcast(table))  # the table's size is checked where it is made
    rows = rows.where(F.col("interventions").isNull() | F.array_contains("interventions", F.col("intervention")))
    bound = F.greatest("dense_vem_min", "tau")
    allowed = lambda e: F.col("interventions").isNull() | F.array_contains("interventions", e["intervention"])
    from_dense = F.filter("_dense", lambda e: allowed(e) & (~F.col("require_reliance") | (e["is_correct"] & (e["vem"] >= bound))))
    from_all = F.filter("_rest", lambda e: allowed(e) & (e["dense_vem"].isNull() | (e["dense_vem"] >= bound)))
    names = lambda found: F.filter(F.array_sort(F.array_distinct(F.transform(found, lambda e: e["intervention"]))), lambda i: i.isNotNull())
    return rows.withColumn("eligible", F.when(F.exists("_dense", allowed), names(from_dense)).otherwise(names(from_all))).drop("_dense", "_rest")


def eligible_interventions(records: DataFrame, table: DataFrame) -> DataFrame:
    """(setting, sample_id, split, eligible); empty arrays for samples that have none."""
    return with_eligible(records, table).groupBy(*KEY).agg(F.first("eligible").alias("eligible"))


#: Settings that judge records alike, once; ``of``: what is chosen from the same candidates. A fixed choice has a method and a budget, others the methods that they
#: allow; ``named``: the settings that choose so, and whether they pay for what they tried.
GROUP = (
    "setting string, tau double, rho double, dense_vem_min double, require_reliance boolean, interventions array<string>, "
    "of array<struct<choice: string, fixed: boolean, methods: array<string>, method: string, budget: string, named: array<struct<setting: string, cascade: boolean>>>>"
)


def grouped(spark: SparkSession, **tables: DataFrame | None) -> DataFrame:
    """A row (``GROUP``) for all settings of the same thresholds and interventions. ``tables``: settings by kind (cheapest, cascade, fixed)."""
    found: dict[tuple, dict[tuple, list]] = {}
    for kind, table in tables.items():
        for r in table.collect() if table is not None else ():  # the table's size is checked where it is made
            alike = (r["tau"], r["rho"], r["dense_vem_min"], r["require_reliance"], tuple(r["interventions"]) if r["interventions"] is not None else None)
            chosen = (True, None, r["fixed_method"], r["fixed_budget"]) if kind == "fixed" else (False, tuple(r["methods"]) if r["methods"] is not None else None, None, None)
            found.setdefault(alike, {}).setdefault(chosen, []).append((r["setting"], kind == "cascade"))
    some = lambda x: list(x) if x is not None else None
    data = [
        (str(i), *alike[:4], some(alike[4]), [(f"{i}.{j}", c[0], some(c[1]), c[2], c[3], named) for j, (c, named) in enumerate(of.items())])
        for i, (alike, of) in enumerate(found.items())
    ]
    return spark.createDataFrame(data, GROUP)


def candidates(records: DataFrame, groups: DataFrame) -> DataFrame:
    """A row per group of settings (:func:`grouped`), sample, method and budget over its eligible interventions; covers: it has all of them."""
    for c, kind in OPTIONAL.items():
        records = records if c in records.columns else records.withColumn(c, F.lit(None).cast(kind))
    rows = with_eligible(records, groups.drop("of")).where(F.array_contains("eligible", F.col("intervention")))
    first = lambda c: F.min_by(c, "intervention").alias(c)  # noqa: E731  the order is by intervention
    return rows.groupBy(*KEY, "method", "budget").agg(
        *(F.first(c).alias(c) for c in ("eligible", "dataset", "budget_ord")),
        (F.size(F.collect_set("intervention")) == F.size(F.first("eligible"))).alias("covers"),
        F.every(passes(F.col("vem"), F.col("reliance_retention"), F.col("tau"), F.col("rho"))).alias("passes"),
        F.every("is_correct").alias("is_correct"),
        *(F.min(c).alias(c) for c in ("vem", "dense_vem", "reliance_retention")),
        *(F.sum(c).alias(c) for c in SPENT),
        F.sum("api_cost_usd").alias("api_cost_usd"),
        first("support_metric"),
        first("answer"),
        first("gold_answer"),
        first("token_count"),
    )


def _with_dense(rows: DataFrame) -> DataFrame:
    """Each row with what its sample's dense row has."""
    w = Window.partitionBy(*KEY)
    dense = F.col("method") == "dense"
    return rows.withColumns({f"dense_{c}": F.max(F.when(dense, F.col(c))).over(w) for c in ("latency_ms", "cost", "token_count")})


def _decisions(rows: DataFrame) -> DataFrame:
    speed = F.when((F.col("dense_latency_ms") != 0) & (F.col("latency_ms") != 0), F.col("dense_latency_ms") / F.col("latency_ms"))
    kept = ratio(F.col("token_count"), F.col("dense_token_count"))
    return rows.select(
        *KEY,
        "dataset",
        F.col("method").alias("selected_method"),
        F.col("budget").alias("selected_budget"),
        F.col("passes").alias("accepted"),
        F.col("escalations").cast("long").alias("escalations"),
        "reason",
        "answer",
        "gold_answer",
        "is_correct",
        "vem",
        "dense_vem",
        "reliance_retention",
        "cost",
        "latency_ms",
        "energy_joule",
        "measured_energy_joule",
        "proxy_energy_joule",
        "api_cost_usd",
        *ONLINE.values(),
        F.coalesce("support_metric", F.lit("score_vem")).alias("support_metric"),
        "token_count",
        F.size("eligible").cast("long").alias("n_eligible"),
        F.when(F.col("passes"), "supported").otherwise("unsupported").alias("support_status"),
        "dense_latency_ms",
        "dense_cost",
        "dense_token_count",
        speed.alias("speedup_vs_dense"),
        kept.alias("retained_token_ratio"),
        (1 - kept).alias("token_reduction"),
    )


def _chosen(records: DataFrame, **tables: DataFrame | None) -> DataFrame:
    """The decisions of all settings (by kind, as :func:`grouped` takes them) in one pass over the records.

    Candidates are made once for all settings that judge records alike, and tried once for all that also allow the same methods; of these only the
    decisions, one a sample, are repeated by setting. Rows that no choice can take or fall back on are left out before anything is sorted.
    """
    groups = grouped(records.sparkSession, **tables)
    dense = F.col("method") == "dense"
    fits = lambda c: F.coalesce(~dense & F.col("covers") & (c["methods"].isNull() | F.array_contains(c["methods"], F.col("method"))), F.lit(False))
    fixed = lambda c: F.col("covers") & (F.col("method") == c["method"]) & (F.col("budget") == c["budget"])
    rows = _with_dense(candidates(records, groups)).join(F.broadcast(groups.select("setting", "of")), "setting")  # a row per group
    rows = rows.withColumn("c", F.explode(F.filter("of", lambda c: F.when(c["fixed"], fixed(c)).otherwise(fits(c) | dense)))).drop("of", "setting")
    rows = rows.withColumns({"candidate": ~F.col("c.fixed") & fits(F.col("c")), "choice": F.col("c.choice")})
    chosen, fallback = F.lit(False), F.lit(False)
    if tables.get("cheapest") is not None or tables.get("cascade") is not None:
        rows = _tried(rows, tables.get("cascade") is not None)
        chosen, fallback = F.col("place") == F.col("first"), F.col("first").isNull() & dense
    rows = rows.where(F.col("c.fixed") | chosen | fallback).withColumn("n", F.explode("c.named"))
    steps, spent, cascade = F.lit(0), {}, F.col("n.cascade")
    if "place" in rows.columns:
        plain = F.when(chosen, F.col("smaller")).otherwise(F.col("n_budgets"))
        steps = F.when(F.col("c.fixed"), 0).when(cascade, F.when(chosen, F.col("place") - 1).otherwise(F.col("n_candidates"))).otherwise(plain)
    reason = F.when(F.col("c.fixed"), "fixed_budget").when(fallback, "fallback_full").when(steps == 0, "accepted_visual_support").otherwise("accepted_after_escalation")
    if tables.get("cascade") is not None:
        for c in SPENT:
            fallen = F.when(F.col(f"all_{c}").isNull(), F.col(c)).otherwise(F.col(f"all_{c}") + F.coalesce(F.col(c), F.lit(0.0)))
            spent[c] = F.when(cascade, F.when(chosen, F.col(f"run_{c}")).otherwise(fallen)).otherwise(F.col(c))
    rows = rows.withColumns({"setting": F.col("n.setting"), "escalations": steps, "reason": reason})
    # what a cascade has spent stands in columns of its own, too; null for other policies
    rows = rows.withColumns({**spent, **{name: F.when(cascade, spent[c]) if c in spent else F.lit(None).cast("double") for c, name in ONLINE.items()}})
    return _decisions(rows)


def _tried(rows: DataFrame, cascade: bool) -> DataFrame:
    """``rows`` (of one choice and sample: candidates and dense) with their place in the order of trying and the first place that is accepted."""
    of = ("choice", "sample_id", "split")
    tried = Window.partitionBy(*of).orderBy(F.desc("candidate"), "budget_ord", "cost", "method")
    whole = Window.partitionBy(*of)
    candidate = F.col("candidate")
    so_far = tried.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = {c: F.sum(F.when(candidate, F.col(c))) for c in (SPENT if cascade else ())}
    rows = rows.withColumns(
        {
            "place": F.row_number().over(tried),
            "smaller": F.dense_rank().over(Window.partitionBy(*of).orderBy(F.desc("candidate"), "budget_ord")) - 1,
            "n_candidates": F.count_if(candidate).over(whole),
            "n_budgets": F.size(F.collect_set(F.when(candidate, F.col("budget"))).over(whole)),
        }
        | {f"run_{c}": s.over(so_far) for c, s in total.items()}
        | {f"all_{c}": s.over(whole) for c, s in total.items()}
    )
    return rows.withColumn("first", F.min(F.when(candidate & F.col("passes"), F.col("place"))).over(whole))


def cheapest_supported(records: DataFrame, table: DataFrame, cascade: bool = False) -> DataFrame:
    """One decision per sample: of the candidates that pass, the first by (budget, cost, method); else dense, if it is there.

    ``cascade``: candidates are tried in that order, and cost, latency and energy add up over those tried, dense
    included where it is fallen back on; escalations count tries instead of smaller budgets.
    """
    return _chosen(records, **{"cascade" if cascade else "cheapest": table})


def decision_sets(records: DataFrame, methods: Iterable[str], schedule: list[str], tau: float, rho: float | None = None, dense_vem_min: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """Every policy that is compared over the test split, by name in ``setting``.

    All methods together and each alone, plain (``supported``) and as a cascade (``online``); dense alone; and of each method the fixed smallest budget
    (``fixed_aggressive``, which ``cost_only`` also takes), the middle one (``fixed_medium``), and the smallest that is as accurate as the best on
    the validation split (``accuracy_only``; a row per method comes to the driver for it).
    """
    spark, methods = records.sparkSession, list(methods)
    base = {"tau": tau, "rho": rho, "dense_vem_min": dense_vem_min}
    accurate = {r["method"]: r["budget"] for r in accuracy_only_budget(records, tolerance).collect()}
    fixed = [{**base, "setting": "dense_only", "fixed_method": "dense", "fixed_budget": "full"}]
    for m in methods:
        kinds = {"fixed_aggressive": schedule[0], "fixed_medium": schedule[len(schedule) // 2], "cost_only": schedule[0], "accuracy_only": accurate.get(m)}
        fixed += [{**base, "setting": f"{m}_{k}", "fixed_method": m, "fixed_budget": b} for k, b in kinds.items() if b]
    of = lambda kind: [{**base, "setting": kind}] + [{**base, "setting": f"{m}_{kind}", "methods": [m]} for m in methods]
    test = records.where(F.col("split") == "test")
    return _chosen(test, cheapest=settings(spark, of("supported")), cascade=settings(spark, of("online")), fixed=settings(spark, fixed))


def fixed_budget(records: DataFrame, table: DataFrame) -> DataFrame:
    """One decision per sample that the setting's method and budget cover, passed or not; no other budget is tried."""
    return _chosen(records, fixed=table)


def by_sample(records: DataFrame) -> DataFrame:
    """(sample_id, split, cells, dense_cells): the records of a sample as arrays, one entry a method and budget, with one entry an intervention.

    A sample has a handful of cells. One shuffle by sample at most (none if the records lie by sample), whatever is asked of the arrays afterwards.
    """
    names = ("method", "budget", "budget_ord", "intervention", "vem", "dense_vem", "reliance_retention", "is_correct", "cost")
    rows = records.groupBy("sample_id", "split").agg(F.collect_list(F.struct(*names)).alias("entries"))
    kinds = F.array_distinct(F.transform("entries", lambda e: F.struct(e["budget_ord"].alias("budget_ord"), e["method"].alias("method"), e["budget"].alias("budget"))))
    of = lambda k: F.filter("entries", lambda e: (e["method"] == k["method"]) & (e["budget"] == k["budget"]))
    rows = rows.withColumn("all", F.transform(kinds, lambda k: F.struct(k["budget_ord"].alias("budget_ord"), k["method"].alias("method"), of(k).alias("entries"))))
    dense = lambda c: c["method"] == "dense"
    return rows.select("sample_id", "split", F.filter("all", lambda c: ~dense(c)).alias("cells"), F.filter("all", dense).alias("dense_cells"))


def _decided(tau: Column, rho: Column, dense_vem_min: Column, reliance: Column, methods: Column, interventions: Column) -> Column:
    """struct(accepted, is_correct, cost) of the decision of one setting over the arrays of :func:`by_sample`; null if there is none."""
    bound = F.greatest(dense_vem_min, tau)
    allowed = lambda e: interventions.isNull() | F.array_contains(interventions, e["intervention"])
    entries = lambda cells: F.filter(F.flatten(F.transform(cells, lambda c: c["entries"])), allowed)
    reaches = lambda e: ~reliance | (e["is_correct"] & (e["vem"] >= bound))
    of_dense = entries(F.col("dense_cells"))
    from_dense = F.transform(F.filter(of_dense, lambda e: F.coalesce(reaches(e), F.lit(False))), lambda e: e["intervention"])
    from_all = F.transform(F.filter(entries(F.col("cells")), lambda e: e["dense_vem"].isNull() | (e["dense_vem"] >= bound)), lambda e: e["intervention"])
    eligible = F.array_distinct(F.when(F.size(of_dense) > 0, from_dense).otherwise(from_all))

    def summed(cell: Column, eligible: Column) -> Column:
        mine = F.filter(cell["entries"], lambda e: F.array_contains(eligible, e["intervention"]))
        return F.struct(
            cell["budget_ord"].alias("budget_ord"), F.aggregate(mine, F.lit(0.0).cast("double"), lambda x, e: x + e["cost"]).alias("cost"), cell["method"].alias("method"),
            F.forall(mine, lambda e: passes(e["vem"], e["reliance_retention"], tau, rho)).alias("passes"), F.forall(mine, lambda e: e["is_correct"]).alias("is_correct"),
            F.size(F.array_distinct(F.transform(mine, lambda e: e["intervention"]))).alias("n"),
        )

    def chosen(eligible: Column) -> Column:
        there = lambda cells: F.filter(F.transform(cells, lambda c: summed(c, eligible)), lambda c: c["n"] > 0)
        fits = lambda c: (c["n"] == F.size(eligible)) & c["passes"] & (methods.isNull() | F.array_contains(methods, c["method"]))
        best = F.array_min(F.filter(there(F.col("cells")), fits))
        return F.coalesce(best, F.array_min(there(F.col("dense_cells"))))

    # the eligible interventions are worked out once: as the one element of an array they are a variable
    found = F.element_at(F.transform(F.array(eligible), chosen), 1)
    return F.when(found.isNotNull(), F.struct(found["passes"].alias("accepted"), found["is_correct"].alias("is_correct"), found["cost"].alias("cost")))


def calibration(records: DataFrame, table: DataFrame) -> DataFrame:
    """Per setting over the validation split: coverage, supported rate, accuracy, mean cost; and chosen for the best setting.

    Best: largest coverage, then supported rate, then accuracy, then smallest cost; ties go to the first name. Records are shuffled once, by sample, and
    every setting is decided on a sample's arrays; what is shuffled per setting are sums of tasks. So a larger grid moves no more records.
    """
    validation = records.where(F.col("split") == "validation")
    samples = by_sample(validation)
    rows = samples.crossJoin(F.broadcast(table))  # the table's size is checked where it is made
    rows = rows.withColumn("decision", _decided(*(F.col(c) for c in ("tau", "rho", "dense_vem_min", "require_reliance", "methods", "interventions"))))
    has_dense = F.size("dense_cells") > 0
    sums = rows.groupBy("setting").agg(
        F.count("decision").alias("n"), F.avg(F.col("decision.accepted").cast("int")).alias("supported_rate"), F.avg(F.col("decision.is_correct").cast("int")).alias("accuracy"),
        F.avg("decision.cost").alias("mean_cost"), F.coalesce(F.nullif(F.count_if(has_dense), F.lit(0)), F.count("*")).alias("samples"),
    )
    scores = sums.where("n > 0").withColumn("coverage", F.col("n") / F.greatest("samples", F.lit(1)))
    # the mean is rounded, so that the order doesn't hang on how a sum was added up
    best = Window.orderBy(F.desc("coverage"), F.desc("supported_rate"), F.desc("accuracy"), F.round("mean_cost", 6), "setting")
    return scores.drop("samples").withColumn("chosen", F.row_number().over(best) == 1)


def accuracy_only_budget(records: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per method over the validation split: the smallest budget whose accuracy is within ``tolerance`` of the best.

    A sample counts as right only if all its records are.
    """
    rows = records.where((F.col("split") == "validation") & (F.col("method") != "dense"))
    by_sample = rows.groupBy("method", "budget", "budget_ord", "sample_id").agg(F.every("is_correct").alias("right"))
    accuracy = by_sample.groupBy("method", "budget", "budget_ord").agg(F.avg(F.col("right").cast("int")).alias("accuracy"))
    best = accuracy.withColumn("best", F.max("accuracy").over(Window.partitionBy("method")))
    return best.where(F.col("accuracy") >= F.col("best") - tolerance).groupBy("method").agg(
        F.min_by("budget", "budget_ord").alias("budget"), F.min_by("accuracy", "budget_ord").alias("accuracy")
    )
