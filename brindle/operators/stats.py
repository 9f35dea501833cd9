"""Agreement, ranking quality, resampling, and risk-bounded thresholds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from brindle.functions.numbers import r6, ratio, wilson_upper
from brindle.operators.prefixes import before, exact_quantiles
from brindle.sources.folders import written


def cohen_kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, raw agreement, kappa (1 if chance alone agrees always, null without pairs), and how often each side gives each label.

    Labels are counted, never listed; the distributions are JSON objects by label.
    """
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("agree"))
    xs = cells.groupBy(F.col("x").alias("label")).agg(F.sum("n").alias("nx"))
    ys = cells.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("ny"))
    chance = xs.join(ys, "label").agg(F.coalesce(F.sum(F.col("nx").cast("double") * F.col("ny")), F.lit(0.0)).alias("p"))
    one = total.crossJoin(F.broadcast(chance))  # one row each
    observed, expected = ratio(F.col("agree"), F.col("n")), ratio(F.col("p"), F.col("n") * F.col("n"))
    kappa = F.when(expected == 1, 1.0).otherwise((observed - expected) / F.nullif(1 - expected, F.lit(0.0)))
    shown = lambda d, n, name: d.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("label").cast("string"), n))))).alias(name))  # noqa: E731  a row per label
    one = one.crossJoin(F.broadcast(shown(xs, "nx", f"{a}_distribution"))).crossJoin(F.broadcast(shown(ys, "ny", f"{b}_distribution")))  # one row each
    return one.select(F.coalesce("n", F.lit(0)).alias("n"), r6(observed).alias("agreement"), r6(kappa).alias("kappa"), f"{a}_distribution", f"{b}_distribution")


def ranking_quality(rows: DataFrame, label: str, score: str, *by: str, times: str | None = None) -> DataFrame:
    """AUROC with average ranks for ties (null for one class), Brier score, log loss (clipped at 1e-15).

    Rows are summed up per score first, in one pass that serves all measures; ranks come from sums over the distinct scores before; those of a group lie over
    as many ranges as they need. ``times``: a column that says how often a row occurs.
    """
    y, p, often = F.col(label).cast("double"), F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15)), F.col(times) if times else F.lit(1)
    errors = {"brier": (F.col(score) - y) * (F.col(score) - y), "log_loss": -(y * F.log(p) + (1 - y) * F.log(1 - p))}
    sums = [x for name, c in errors.items() for x in (F.sum(c * often).alias(f"_{name}"), F.sum(F.when(c.isNotNull(), often)).alias(f"_{name}_n"))]
    ties = rows.groupBy(*by, score).agg(F.sum(often).alias("t"), F.sum(y * often).alias("k"), *sums)
    placed = before(ties, list(by), [F.col(score)], lower=("sum", "t"))
    rank = F.coalesce("lower", F.lit(0)) + (F.col("t") + 1) / 2
    both = placed.groupBy(*by).agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n"), F.sum("k").alias("ones"), F.sum(rank * F.col("k")).alias("ranks"),
        *(r6(ratio(F.sum(f"_{name}"), F.sum(f"_{name}_n"))).alias(name) for name in errors),
    )
    k, m = F.col("ones"), F.col("n") - F.col("ones")
    return both.withColumn("auroc", r6(ratio(F.col("ranks") - k * (k + 1) / 2, k * m))).drop("ranks", "ones")


def _uniform(row: Column, draw: Column, seed: int) -> Column:
    """A number in [0, 1) from a row's id and a draw's number, by arithmetic that any engine repeats."""
    x = (row % 1_000_003) * 7_919 + draw * 104_729 + F.lit(seed) * 15_485_863
    x = (x % 1_000_003) * (x % 1_000_003) + row % 999_983 + draw * 31
    return F.pmod(x, F.lit(1_000_003)) / F.lit(1_000_003.0)


#: The Poisson distribution of mean 1 up to 7.
_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998980)


def resample_weight(row: Column, draw: Column, seed: int) -> Column:
    """How often a row is drawn: Poisson with mean 1, which is resampling with replacement for large tables."""
    u = _uniform(row, draw, seed)
    return sum((F.when(u >= F.lit(c), 1).otherwise(0) for c in _POISSON), F.lit(0))


#: Rows times draws whose weights are made at once.
_WEIGHTS = 1 << 22


def resampled_sums(rows: DataFrame, sums: dict[str, Column], key: str, draws: int, seed: int, *by: str) -> DataFrame:
    """(by, draw, sums): weighted sums of every draw by :func:`resample_weight`; draw -1 counts each row once. Nulls add nothing.

    A task keeps an array of draws times sums for each of its groups and multiplies blocks of weights into it, so no row is repeated
    and only groups times draws rows move, whatever the table's size.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    names = list(sums)
    number = F.pmod(F.xxhash64(key), F.lit(1 << 40)) if kinds[key].simpleString() == "string" else F.col(key).cast("bigint")
    taken = rows.select(*by, number.alias("_key"), *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{n}") for n, c in sums.items()))
    steps = np.array(_POISSON)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        draw = np.arange(draws, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros(batch.num_rows, np.int64)
            for c in batch.columns[: len(by)]:
                coded = c.dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
            places_of = np.split(np.argsort(code, kind="stable"), np.cumsum(np.bincount(code))[:-1])
            of = {tuple(c[int(places[0])].as_py() for c in batch.columns[: len(by)]): places for places in places_of}
            ids = batch.column(len(by)).to_numpy(zero_copy_only=False)
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[len(by) + 1 :]])
            for g, places in of.items():
                total = totals.setdefault(g, np.zeros((draws + 1, len(names))))
                for start in range(0, len(places), max(1, _WEIGHTS // max(draws, 1))):
                    some = places[start : start + max(1, _WEIGHTS // max(draws, 1))]
                    row = ids[some].astype(np.int64)[:, None]
                    x = (np.fmod(row, 1_000_003) * 7_919 + draw * 104_729 + seed * 15_485_863) % 1_000_003
                    u = (x * x + np.fmod(row, 999_983) + draw * 31) % 1_000_003 / 1_000_003.0
                    total[1:] += np.searchsorted(steps, u, "right").astype(float).T @ values[some]
                    total[0] += values[some].sum(axis=0)
        for g, total in totals.items():
            columns = [pa.array([v] * (draws + 1), f.type) for v, f in zip(g, keys, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(-1, draws), pa.int64()), *(pa.array(total[:, j]) for j in range(len(names)))], [*by, "draw", *names])

    keys = [pa.field(b, to_arrow_type(kinds[b])) for b in by]
    schema = ", ".join([*(f"`{b}` {kinds[b].simpleString()}" for b in by), "draw bigint", *(f"`{n}` double" for n in names)])
    return taken.mapInArrow(add_up, schema).groupBy(*by, "draw").agg(*(F.sum(n).alias(n) for n in names))


def intervals(drawn: DataFrame, values: dict[str, Column], *by: str) -> DataFrame:
    """(by, metric, point, ci_low, ci_high): 2.5 and 97.5 per cent of each value over the draws, interpolated; values without a point are left out."""
    long = drawn.select(*by, "draw", *(c.alias(n) for n, c in values.items())).unpivot([*by, "draw"], list(values), "metric", "value")
    drew = F.when(F.col("draw") >= 0, F.col("value"))
    return long.groupBy(*by, "metric").agg(
        r6(F.max(F.when(F.col("draw") < 0, F.col("value")))).alias("point"), r6(F.percentile(drew, 0.025)).alias("ci_low"), r6(F.percentile(drew, 0.975)).alias("ci_high")
    )


def bootstrap(rows: DataFrame, metrics: dict[str, tuple[Column, Column]], key: str, draws: int, seed: int, *by: str) -> DataFrame:
    """Per group and metric: point, ci_low and ci_high. ``metrics``: name -> (numerator, denominator), of which the weighted sums' ratio is the value."""
    sums = {x: c for n, (a, b) in metrics.items() for x, c in ((f"{n}_a", a), (f"{n}_b", F.when(a.isNotNull(), b)))}
    return intervals(resampled_sums(rows, sums, key, draws, seed, *by), {n: ratio(F.col(f"{n}_a"), F.col(f"{n}_b")) for n in metrics}, *by)


#: What a summary of decisions divides: numerator, denominator, and the least denominator.
DECISION_RATIOS: dict[str, tuple[str, str, int]] = {
    "accuracy": ("is_correct", "one", 0),
    "visually_supported_rate": ("accepted", "one", 0),
    "mean_token_count": ("token_count", "one", 0),
    "mean_token_reduction": ("token_reduction", "token_reduction?", 0),
    "dense_avoidance_rate": ("avoided", "one", 0),
    "cost_per_visually_supported_answer": ("cost", "accepted", 1),
    "measured_energy_per_visually_supported_answer_joule": ("measured_energy_joule", "accepted", 1),
    "mean_measured_energy_joule": ("measured_energy_joule", "measured_energy_joule?", 0),
    "mean_latency_ms": ("latency_ms", "one", 0),
}
#: The measures of which policies are compared in pairs.
PAIRED = ("accuracy", "visually_supported_rate", "cost_per_visually_supported_answer", "measured_energy_per_visually_supported_answer_joule", "mean_measured_energy_joule", "mean_token_count", "mean_latency_ms")


def _terms(metrics: Iterable[str], prefix: str = "") -> dict[str, Column]:
    """The columns of decisions of which sums are needed; ``x?`` counts known values of x."""
    names = sorted({t for m in metrics for t in DECISION_RATIOS[m][:2]} | {f"{DECISION_RATIOS[m][0]}?" for m in metrics})
    made = {"one": F.lit(1.0), "avoided": ((F.col(f"{prefix}selected_method") != "dense") & (F.col(f"{prefix}selected_budget") != "full")).cast("double")}
    col = lambda t: made[t] if t in made else F.col(f"{prefix}{t}").cast("double")
    return {f"{prefix}{t}": F.when(col(t[:-1]).isNotNull(), 1.0).otherwise(0.0) if t.endswith("?") else col(t) for t in names}


def _ratio_of(metric: str, prefix: str = "") -> Column:
    """A measure from sums; null where nothing of its numerator is known."""
    a, b, least = DECISION_RATIOS[metric]
    den = F.col(f"`{prefix}{b}`")
    return F.when(F.col(f"`{prefix}{a}?`") > 0, ratio(F.col(f"`{prefix}{a}`"), F.greatest(den, F.lit(float(least))) if least else den))


def decision_bootstrap(decisions: DataFrame, draws: int, seed: int, *by: str, key: str = "sample_id", metrics: Iterable[str] = tuple(DECISION_RATIOS)) -> DataFrame:
    """Per group and measure of decisions: point and interval."""
    metrics = list(metrics)
    return intervals(resampled_sums(decisions, _terms(metrics), key, draws, seed, *by), {m: _ratio_of(m) for m in metrics}, *by).where("point is not null")


def paired_bootstrap(decisions: DataFrame, references: Iterable[str], draws: int, seed: int, policy: str = "setting", key: str = "sample_id", metrics: Iterable[str] = PAIRED) -> DataFrame:
    """(policy, reference, metric, delta_point, ci_low, ci_high): differences to each reference over the samples that both decide.

    Both sides are drawn together, by sample.
    """
    metrics, references = list(metrics), list(references)
    terms = {t.removesuffix("?") for m in metrics for t in DECISION_RATIOS[m][:2]}
    columns = [policy, *sorted(terms - {"one", "avoided"}), *(("selected_method", "selected_budget") if "avoided" in terms else ())]
    # a key's references (a handful) go to its rows in one partitioning by key: the decisions are made once, not once a side
    of = F.collect_list(F.when(F.col(policy).isin(*references), F.struct(*columns))).over(Window.partitionBy(key))
    both = decisions.where(F.col(key).isNotNull()).select(key, *columns).withColumn("_of", of)
    both = both.select(key, *(F.col(c).alias(f"l_{c}") for c in columns), F.explode("_of").alias("_r"))
    both = both.select(key, *(f"l_{c}" for c in columns), *(F.col(f"_r.{c}").alias(f"r_{c}") for c in columns))
    both = both.where(F.col(f"l_{policy}") != F.col(f"r_{policy}")).withColumnsRenamed({f"l_{policy}": "policy", f"r_{policy}": "reference"})
    drawn = resampled_sums(both, _terms(metrics, "l_") | _terms(metrics, "r_"), key, draws, seed, "policy", "reference")
    found = intervals(drawn, {m: _ratio_of(m, "l_") - _ratio_of(m, "r_") for m in metrics}, "policy", "reference")
    return found.where("point is not null").withColumnRenamed("point", "delta_point")


def paired_flags(pairs: DataFrame, left: str, right: str, key: str, draws: int, seed: int, *by: str) -> DataFrame:
    """Per group: n_paired, difference of two flags with its interval, and how many have only one of them."""
    a, b = F.col(left).cast("double"), F.col(right).cast("double")
    found = bootstrap(pairs, {"difference": (a - b, F.lit(1.0))}, key, draws, seed, *by)
    counts = pairs.groupBy(*by).agg(F.count("*").alias("n_paired"), F.count_if(F.col(left) & ~F.col(right)).alias("left_only"), F.count_if(F.col(right) & ~F.col(left)).alias("right_only"))
    found = found.select(*by, F.col("point").alias("difference"), "ci_low", "ci_high")
    return counts.join(found, list(by)) if by else counts.crossJoin(F.broadcast(found))  # one row each


def reduction_bootstrap(pairs: DataFrame, spent: str, reference: str, key: str, draws: int, seed: int, *by: str) -> DataFrame:
    """Per group: n_paired and the reduction 1 - mean / mean of the reference, with its interval."""
    sums = resampled_sums(pairs, {"a": F.col(spent), "b": F.col(reference), "n": F.lit(1.0)}, key, draws, seed, *by)
    found = intervals(sums, {"reduction": 1 - ratio(F.col("a"), F.col("b"))}, *by)
    n = sums.where("draw < 0").select(*by, F.col("n").cast("bigint").alias("n_paired"))
    found = found.select(*by, F.col("point").alias("reduction"), "ci_low", "ci_high")
    return n.join(found, list(by)) if by else n.crossJoin(F.broadcast(found))  # one row each


def lower_quantile(values: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """(by, lower): the entry at place int(q (n - 1)) of a group's sorted values, from counts of distinct values and running sums."""
    return exact_quantiles(values, value, {"lower": q}, *by, lower=("lower",))


def running_sums(rows: DataFrame, order: Column, value: str, columns: tuple[str, ...]) -> DataFrame:
    """(value, columns): sums of all rows up to each, in order; ranges of rows are summed apart, and the totals of those before are added.

    Rows are dealt out by ranges, so no task holds more than one; the only window without a key is over one row a range.
    """
    ranged = written(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    total = ranged.groupBy("_part").agg(*(F.sum(c).alias(f"_b_{c}") for c in columns))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = total.select("_part", *(F.coalesce(F.sum(f"_b_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns))
    here = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.join(F.broadcast(bases), "_part").select(value, *((F.sum(c).over(here) + F.col(f"_b_{c}")).alias(c) for c in columns))  # a row per range


def risk_bounded_threshold(rows: DataFrame, budgets: tuple[int, ...], dense_tokens: int = 576, risk: float = 0.05) -> DataFrame:
    """One row: the threshold on scores whose policy avoids dense most while the upper Wilson bound of unsafe choices stays within ``risk``.

    ``rows``: key, scores (array, one per budget) and safe (array). A policy takes the smallest budget whose score reaches the
    threshold, else dense. Walking down the thresholds a row's choice changes only where a smaller budget's score enters:
    at most one event per budget and row; running sums over the events of equal thresholds give every policy at once.
    Ties: more avoidance, fewer tokens, then the higher threshold.
    """
    none = 1.000001
    events = rows.select(
        F.explode(
            F.filter(
                F.transform(
                    F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(budgets)]),
                    lambda x: F.struct(
                        F.get("scores", x["i"]).alias("at"),
                        # in force before this event: of the larger budgets the smallest whose score is above all below it
                        x["i"].alias("i"),
                        x["b"].alias("tokens"),
                        F.get("safe", x["i"]).alias("safe"),
                        F.array_max(F.slice(F.concat(F.array(F.lit(-1.0)), "scores"), 1, x["i"] + 1)).alias("below"),
                    ),
                ),
                lambda e: e["at"] > e["below"],  # else a smaller budget is there already
            )
        ).alias("e"),
        "key",
    ).select("key", "e.*")
    prior = Window.partitionBy("key").orderBy(F.desc("i"))
    events = events.withColumns({"t0": F.lag("tokens").over(prior), "s0": F.lag("safe").over(prior)})
    unsafe = lambda s: F.when(s, 0).otherwise(1)
    steps = events.select(
        F.col("at").alias("threshold"),
        (unsafe(F.col("safe")) - F.when(F.col("t0").isNull(), 0).otherwise(unsafe(F.col("s0")))).alias("unsafe"),
        F.when(F.col("t0").isNull(), 1).otherwise(0).alias("avoid"),
        (F.col("tokens") - F.coalesce("t0", F.lit(dense_tokens))).alias("tokens"),
    )
    per = steps.groupBy("threshold").agg(*(F.sum(c).alias(c) for c in ("unsafe", "avoid", "tokens")))
    start = rows.sparkSession.createDataFrame([(none, 0, 0, 0)], "threshold double, unsafe long, avoid long, tokens long")
    run = running_sums(per.unionByName(start), F.desc("threshold"), "threshold", ("unsafe", "avoid", "tokens"))
    n = rows.agg(F.count("*").alias("n"))
    scored = run.crossJoin(F.broadcast(n)).withColumn("wilson_upper", wilson_upper(F.col("unsafe"), F.col("n"))).where(F.col("wilson_upper") <= risk)  # one row
    best = scored.orderBy(F.desc("avoid"), "tokens", F.desc("threshold")).limit(1)
    return best.select(
        r6("threshold").alias("threshold"), F.col("unsafe").alias("unsafe_acceptance_count"), r6("wilson_upper").alias("wilson_upper"),
        r6(F.col("avoid") / F.col("n")).alias("dense_avoidance_rate"), r6(dense_tokens + F.col("tokens") / F.col("n")).alias("mean_selected_tokens"),
    )


def pareto_front(points: DataFrame, gain: str, cost: str, *by: str) -> DataFrame:
    """Points with ``efficient``: no other has at least the gain for at most the cost and is better in one.

    By order of cost with the maximum before, carried from range to range, instead of a join of all with all.
    """
    # a row per distinct cost of a group, whatever the table's size
    best = points.groupBy(*by, cost).agg(F.max(gain).alias("_best"))
    best = before(best, list(by), [F.col(cost)], _before=("max", "_best"))
    joined = points.join(best, [*by, cost])
    return joined.withColumn("efficient", (F.col(gain) == F.col("_best")) & (F.col("_before").isNull() | (F.col(gain) > F.col("_before")))).drop("_best", "_before")


def pareto_flags(points: DataFrame, pairs: dict[str, tuple[str, str]], *by: str) -> DataFrame:
    """``points`` with a flag for each pair of a gain and a cost: whether the point is efficient in it."""
    for name, (gain, cost) in pairs.items():
        points = pareto_front(points, gain, cost, *by).withColumnRenamed("efficient", name)
    return points


def grid_threshold(rows: DataFrame, risk: float, *by: str, budgets: tuple[int, ...], steps: Iterable[int] = range(5, 100, 5)) -> DataFrame:
    """(by, threshold): of the thresholds in hundredths whose unsafe choices stay within ``risk``, the one that spends least, the higher one of equals; else 1.

    ``rows``: scores, safe and energy (arrays, one entry a budget; energy has dense as one more). A policy takes the smallest budget whose score
    reaches the threshold, else dense.
    """
    tried = rows.withColumn("threshold", F.explode(F.array(*[F.lit(s / 100.0) for s in steps])))
    pick = F.array_position(F.transform("scores", lambda x: x >= F.col("threshold")), F.lit(True)).cast("int")
    tried = tried.withColumns({"_pick": pick, "_spent": F.get("energy", F.when(pick == 0, len(budgets)).otherwise(pick - 1))})
    unsafe = ((F.col("_pick") > 0) & ~F.get("safe", F.col("_pick") - 1)).cast("double")
    per = tried.groupBy(*by, "threshold").agg(F.avg(unsafe).alias("unsafe"), F.avg("_spent").alias("spent"))
    fits = F.col("unsafe") <= risk
    best = F.min(F.when(fits, F.struct(F.coalesce(F.round("spent", 6), F.lit(float("inf"))).alias("spent"), (-F.col("threshold")).alias("less"))))
    return per.groupBy(*by).agg(best.alias("_best")).select(*by, F.coalesce(-F.col("_best.less"), F.lit(1.0)).alias("threshold"))
