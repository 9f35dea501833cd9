"""Budget controllers: logistic models per budget over question features, and their decisions."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.answers import DATASETS, KEYWORDS
from brindle.functions.numbers import dot, sigmoid, standardize
from brindle.operators.stats import grid_threshold, ranking_quality
from brindle.sources.folders import written

#: Names of the features, in order, and the rule of choice.
FEATURE_NAMES = (
    "question_word_count", "question_character_count", "option_count", "multiple_choice",
    *(f"dataset={d}" for d in DATASETS), *(f"keyword={k}" for k in KEYWORDS),
)
RULE = "smallest_budget_above_global_threshold_else_dense"
#: Columns that a controller must never see.
FORBIDDEN = frozenset(
    {
        "answer", "gold_answer", "dense_answer", "dense_correct", "dense_vem", "dense_reliant", "eligible_interventions", "intervention_pass", "intervention_answer_fidelity",
        "reference_safe", "combined_gold_safe", "minimum_observed_safe_budget",
    }
)
STEPS, RATE, PENALTY, FLOOR = 1600, 0.08, 0.03, 1e-8
#: Distinct training rows up to which a cell is fitted in one task; tasks share the steps of larger ones.
MOST_ROWS = 500_000


def check_artifact(artifact: dict) -> dict:
    """The artifact, if its features and its rule are ours."""
    if list(artifact["feature_names"]) != list(FEATURE_NAMES):
        raise ValueError("the controller's features differ from those computed here")
    if artifact["selection_rule"] != RULE:
        raise ValueError(f"unknown selection rule {artifact['selection_rule']!r}")
    return artifact


def load_artifact(path: str, sha256: str | None = None) -> dict:
    """An artifact from a JSON file; its SHA-256 is checked where given."""
    import hashlib

    raw = Path(path).read_bytes()
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256.split()[0]:
        raise ValueError(f"{path} doesn't have the checksum {sha256.split()[0]}")
    return check_artifact(json.loads(raw))


def check_columns(df: DataFrame, required: tuple[str, ...] = (), forbidden: frozenset[str] = FORBIDDEN) -> DataFrame:
    """``df``, if it has what is required and nothing that is forbidden; known before anything runs."""
    if wrong := sorted(forbidden & set(df.columns)):
        raise ValueError(f"forbidden columns: {wrong}")
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df


def probability(features: Column, model: dict) -> Column:
    """The logistic of a model (weights with the intercept first, means, scales) over standardised features."""
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    parts = F.zip_with(standardize(features, lit(model["means"]), lit(model["scales"])), lit(model["weights"][1:]), lambda x, w: x * w)
    # summed from the intercept on, in one form for both signs, as the SQL does: a sum that is 0 but for its last digit gives the same side of a threshold
    z = F.aggregate(parts, F.lit(float(model["weights"][0])), lambda s, x: s + x)
    return 1 / (1 + F.exp(-z))


def decide(df: DataFrame, artifact: dict, features: str = "features") -> DataFrame:
    """``df`` with probabilities (map by budget) and selected_budget: the smallest whose probability reaches the global threshold, else dense.

    A table with a column that a controller must not see is refused before anything runs.
    """
    check_columns(df, (features,))
    budgets = sorted(artifact["models"], key=int)
    rows = df.withColumn("_p", F.array(*[probability(F.col(features), artifact["models"][b]) for b in budgets]))
    names = F.array(*[F.lit(b) for b in budgets])
    fits = F.filter(F.arrays_zip(names.alias("b"), F.col("_p").alias("p")), lambda x: x["p"] >= float(artifact["global_threshold"]))
    return rows.withColumns(
        {"probabilities": F.map_from_arrays(names, "_p"), "selected_budget": F.coalesce(F.try_element_at(fits, F.lit(1))["b"], F.lit("dense"))}
    ).drop("_p")


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY, times: np.ndarray | None = None) -> np.ndarray:
    """Weights, the intercept first, after so many steps of full-batch descent from zero; the intercept isn't penalised.

    ``times``: how often each row occurs.
    """
    w = np.zeros(x.shape[1] + 1)
    times = np.full(len(x), 1 / len(x)) if times is None else times / times.sum()
    for _ in range(steps):
        z = w[0] + x @ w[1:]
        e = np.exp(-np.abs(z))
        error = (np.where(z >= 0, 1 / (1 + e), e / (1 + e)) - y) * times
        gradient = np.concatenate(([error.sum()], x.T @ error + penalty * w[1:]))
        w -= rate * gradient
    return w


def fit_cells(rows: DataFrame, *by: str, steps: int = STEPS, penalty: float = PENALTY, times: str | None = None) -> DataFrame:
    """Per cell: weights, means, scales (sample deviation, at least 1e-8) of a logistic model of ``safe`` by ``features``; written, so that nothing is fitted twice.

    One label alone gives the smoothed prior as the intercept. Rows of equal features and label are counted before they move: features are counts and
    flags, of which there are few. A cell of up to ``MOST_ROWS`` distinct rows is fitted in one task; of larger ones each task works out
    the gradient over its own rows in every step, for all these cells at once, and the sums come to the driver (:func:`shared_descent`). The result is the same.
    ``times``: a column that says how often a row occurs, for rows that are counted already.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, times = np.array([list(f) for f in pdf["features"]], float).reshape(len(pdf), -1), pdf["safe"].to_numpy().astype(float), pdf["times"].to_numpy().astype(float)
        # the order of rows must not decide the last digits
        order = np.lexsort((y, *x.T))
        x, y, times = x[order], y[order], times[order]
        n = times.sum()
        means = (x * times[:, None]).sum(axis=0) / n
        scales = np.maximum(np.sqrt(((x - means) ** 2 * times[:, None]).sum(axis=0) / max(1.0, n - 1)), FLOOR)
        if y.min() == y.max():
            prior = ((y * times).sum() + 1) / (n + 2)
            w = np.concatenate(([np.log(prior / (1 - prior))], np.zeros(x.shape[1])))
        else:
            w = fit_logistic((x - means) / scales, y, steps, penalty=penalty, times=times)
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, "n": [int(n)], "weights": [w], "means": [means], "scales": [scales]})

    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", n bigint, weights array<double>, means array<double>, scales array<double>"
    counted = written(rows.groupBy(*by, "features", F.col("safe").cast("int").alias("safe")).agg((F.sum(times) if times else F.count("*")).alias("times")), "descent-rows")
    sizes = counted.groupBy(*by).agg(F.count("*").alias("distinct"))
    large = [tuple(r[b] for b in by) for r in sizes.where(F.col("distinct") > MOST_ROWS).collect()]  # cells are few, large ones fewer
    if not large:
        return written(counted.groupBy(*by).applyInPandas(fit, schema), "models")
    of = F.lit(None).cast("int")
    for i, key in enumerate(large):
        here = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.lit(v)) for b, v in zip(by, key, strict=True)], F.lit(True))
        of = F.when(here, i).otherwise(of)
    marked = counted.withColumn("_large", of)
    small = marked.where("_large is null").drop("_large").groupBy(*by).applyInPandas(fit, schema)
    fitted = shared_descent(marked.where("_large is not null").select(F.col("_large").alias("cell"), "features", "safe", "times"), len(large), steps, penalty=penalty)
    made = [(*key, int(n), *(v.tolist() for v in vectors)) for key, (n, *vectors) in zip(large, fitted, strict=True)]
    return written(small.unionByName(rows.sparkSession.createDataFrame(made, schema)), "models")


def shared_descent(rows: DataFrame, cells: int, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, weights, means, scales) of cells 0 to ``cells`` - 1 of a table (cell, features, safe, times), by as many steps as :func:`fit_logistic` takes.

    A step is one narrow pass over the cached rows: a task sends a vector of sums for each cell that it holds rows of, these are added up, and the driver gets
    one vector a cell. A lost executor's rows are read again from their table.
    """
    width = rows.select(F.size("features")).first()[0]
    held = rows.persist()

    def total(vectors) -> np.ndarray:
        """The sum over rows, by cell, of ``vectors(cell, features, safe, times)``: an array rows x any width."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell, safe, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, width)
                for c in np.unique(cell):
                    mine = cell == c
                    sums[int(c)] = sums.get(int(c), 0.0) + vectors(int(c), x[mine], safe[mine].astype(float), times[mine].astype(float)).sum(axis=0)
            for c, v in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v, pa.float64())], ["cell", "place", "value"])

        found = held.mapInArrow(run, "cell int, place int, value double").groupBy("cell", "place").agg(F.sum("value").alias("value")).collect()
        out = np.zeros((cells, max(r["place"] for r in found) + 1))
        for r in found:
            out[r["cell"], r["place"]] = r["value"]
        return out

    one = total(lambda c, x, y, t: np.column_stack((t, y * t, x * t[:, None])))
    n, positive, means = one[:, 0], one[:, 1], one[:, 2:] / one[:, [0]]
    scales = np.maximum(np.sqrt(total(lambda c, x, y, t: np.column_stack((t, (x - means[c]) ** 2 * t[:, None])))[:, 1:] / np.maximum(1.0, n - 1)[:, None]), FLOOR)
    w = np.zeros((cells, width + 1))

    def gradient(c: int, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
        x = (x - means[c]) / scales[c]
        z = w[c, 0] + x @ w[c, 1:]
        e = np.exp(-np.abs(z))
        error = (np.where(z >= 0, 1 / (1 + e), e / (1 + e)) - y) * t / n[c]
        return np.column_stack((error, error[:, None] * x))

    for _ in range(steps):
        w = w - rate * (total(gradient) + penalty * np.concatenate((np.zeros((cells, 1)), w[:, 1:]), axis=1))
    held.unpersist()
    prior = (positive + 1) / (n + 2)
    alone = (positive == 0) | (positive == n)  # one label: the prior
    w[alone] = 0.0
    w[alone, 0] = np.log(prior[alone] / (1 - prior[alone]))
    return [(n[c], w[c], means[c], scales[c]) for c in range(cells)]


def models_to_artifact(rows: Iterator, threshold: float) -> dict:
    """An artifact from fitted rows (budget, weights, means, scales)."""
    models = {str(r["budget"]): {k: [float(v) for v in r[k]] for k in ("weights", "means", "scales")} for r in rows}
    return {"feature_names": list(FEATURE_NAMES), "selection_rule": RULE, "global_threshold": threshold, "models": models}


def select_features(features: Column, places: list[int]) -> Column:
    """Some of the features, by place from 0."""
    return F.transform(F.array(*[F.lit(p) for p in places]), lambda i: F.get(features, i))


def models_without(rows: DataFrame, *by: str, steps: int = STEPS, penalty: float = PENALTY, times: str | None = None) -> DataFrame:
    """(by, budget, without, weights, means, scales): the model of each group and budget that was fitted without each fold."""
    folds = [r[0] for r in rows.select("fold").distinct().collect()]  # a handful by definition
    train = rows.withColumn("without", F.explode(F.array(*[F.lit(f) for f in folds]))).where("without <> fold")
    return fit_cells(train, *by, "budget", "without", steps=steps, penalty=penalty, times=times).drop("n")


def with_scores(rows: DataFrame, models: DataFrame, *on: str) -> DataFrame:
    """``rows`` with score, the probability by their model."""
    scored = rows.join(F.broadcast(models), list(on))  # a model a cell; a shuffle by cell would put the rows into as many tasks as there are cells
    z = dot(standardize(F.col("features"), F.col("means"), F.col("scales")), F.slice("weights", F.lit(2), F.size("weights") - 1))
    return scored.withColumn("score", sigmoid(F.element_at("weights", 1) + z)).drop("weights", "means", "scales")


def out_of_fold(rows: DataFrame, *by: str, steps: int = STEPS, penalty: float = PENALTY, places: list[int] | None = None) -> DataFrame:
    """(by, key, fold, budget, safe, score): each row scored by the model of its group and budget that was fitted without its fold.

    ``rows``: key, fold, budget, features, safe. ``places``: the features to use, by place. The rows are written: their texts are read for features once.
    """
    features = F.col("features") if places is None else select_features(F.col("features"), places)
    rows = written(rows.select(*by, "key", "fold", "budget", features.alias("features"), "safe"), "fold-rows")
    models = models_without(rows, *by, steps=steps, penalty=penalty).withColumnRenamed("without", "fold")
    return with_scores(rows, models, *by, "budget", "fold").select(*by, "key", "fold", "budget", "safe", "score")


def scored_rows(scores: DataFrame) -> DataFrame:
    """(key, fold, scores, safe): arrays over budgets in order, as threshold searches take them."""
    got = scores.groupBy("key", "fold").agg(F.array_sort(F.collect_list(F.struct("budget", "score", "safe"))).alias("x"))
    return got.select("key", "fold", F.transform("x", lambda e: e["score"]).alias("scores"), F.transform("x", lambda e: e["safe"].cast("boolean")).alias("safe"))


def replay(rows: DataFrame, threshold: float, budgets: tuple[int, ...], dense_tokens: int = 576) -> DataFrame:
    """Per fold what a threshold's policy does: rows, unsafe choices, avoidance of dense, tokens; and what the oracle could do."""
    names = F.array(*[F.lit(b) for b in budgets])
    pick = F.try_element_at(F.filter(F.arrays_zip(names.alias("b"), F.col("scores"), F.col("safe")), lambda e: e["scores"] >= threshold), F.lit(1))
    best = F.try_element_at(F.filter(F.arrays_zip(names.alias("b"), F.col("safe")), lambda e: e["safe"]), F.lit(1))
    rows = rows.withColumns({"_pick": pick, "_best": best})
    return rows.groupBy("fold").agg(
        F.count("*").alias("n"), F.count_if(F.col("_pick").isNotNull() & ~F.col("_pick.safe")).alias("unsafe"), F.count("_pick").alias("avoided"),
        F.avg(F.coalesce("_pick.b", F.lit(dense_tokens))).alias("mean_tokens"), F.count("_best").alias("oracle_avoided"), F.avg(F.coalesce("_best.b", F.lit(dense_tokens))).alias("oracle_tokens"),
    )


#: The groups of features, by place, and the configurations of an ablation.
FEATURE_GROUPS = {"question_structure": tuple(range(4)), "task_source": tuple(range(4, 10)), "semantic_keywords": tuple(range(10, 17))}
CONFIGURATIONS = {
    "A0_full": ("question_structure", "task_source", "semantic_keywords"),
    "A1_structure_only": ("question_structure",),
    "A2_task_only": ("task_source",),
    "A3_keywords_only": ("semantic_keywords",),
    "A4_full_minus_task": ("question_structure", "semantic_keywords"),
    "A5_full_minus_keywords": ("question_structure", "task_source"),
    "A6_intercept_only": (),
}


def ablation(rows: DataFrame, cell: str = "cell", steps: int = STEPS, configurations: dict[str, tuple[str, ...]] = CONFIGURATIONS) -> DataFrame:
    """(configuration, cell, budget, n, brier, log_loss, auroc): every configuration of feature groups in every cell, scored out of fold.

    A score depends on nothing but cell, fold, budget and features, so rows that are alike in these and their label are counted, once for all configurations;
    these are fitted, scored and ranked together on the counts.
    """
    known = (cell, "fold", "budget", "features")
    counted = written(rows.groupBy(*known, F.col("safe").cast("int").alias("safe")).agg(F.count("*").alias("times")), "fold-counts")
    places = {name: [p for g in groups for p in FEATURE_GROUPS[g]] for name, groups in configurations.items()}
    every = F.array(*[F.struct(F.lit(name).alias("configuration"), select_features(F.col("features"), some).alias("features")) for name, some in places.items()])
    each = counted.select(cell, "fold", "budget", "safe", "times", F.explode(every).alias("_of")).select("_of.*", cell, "fold", "budget", "safe", "times")
    # of equal features of a configuration, too
    each = written(each.groupBy("configuration", *known, "safe").agg(F.sum("times").alias("times")), "fold-counts")
    models = models_without(each, "configuration", cell, steps=steps, times="times").withColumnRenamed("without", "fold")
    scored = with_scores(each, models, "configuration", cell, "budget", "fold")
    got = ranking_quality(scored, "safe", "score", "configuration", cell, "budget", times="times")
    return got.select(cell, "budget", "n", "brier", "log_loss", "auroc", "configuration")


def _arrays(scored: DataFrame, budgets: tuple[int, ...], *by: str) -> DataFrame:
    """(by, scores, safe, energy): arrays over the budgets; energy has dense's as one more."""
    got = scored.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("budget", F.struct("score", F.col("safe").cast("boolean").alias("safe"), "energy_joule")))).alias("_m"), F.max("dense_energy_joule").alias("_d"))
    at = lambda name: [F.try_element_at("_m", F.lit(b))[name] for b in budgets]  # noqa: E731  a handful of budgets a row
    missing = lambda xs, v: F.array(*[F.coalesce(x, F.lit(v)) for x in xs])
    return got.select(*by, missing(at("score"), -1.0).alias("scores"), missing(at("safe"), False).alias("safe"), F.array(*at("energy_joule"), "_d").alias("energy"))


def picked(scores: Column, threshold: Column, budgets: tuple[int, ...]) -> Column:
    """The smallest budget whose score reaches the threshold, as text, else dense."""
    names = F.array(*[F.lit(str(b)) for b in budgets])
    place = F.array_position(F.transform(scores, lambda x: x >= threshold), F.lit(True)).cast("int")
    return F.coalesce(F.get(names, place - 1), F.lit("dense"))


def replay_policies(scored: DataFrame, budgets: tuple[int, ...], risks: tuple[float, ...], *by: str) -> DataFrame:
    """(by, policy, key, selected_budget) over the test split of ``scored`` (by, key, split, budget, score, safe, energy_joule, dense_energy_joule).

    Policies: dense; each fixed budget; the offline oracle (the smallest safe budget, else dense); for each risk the smallest fixed budget whose unsafe rate on
    the validation split is within it, else dense; and for each risk the scores' threshold that spends least on the validation split within it.
    """
    rows = _arrays(scored, budgets, *by, "key", "split")
    test = rows.where("split = 'test'")
    validation = rows.where("split = 'validation'")
    named = lambda df, policy, chosen: df.select(*by, F.lit(policy).alias("policy"), "key", chosen.alias("selected_budget"))
    out = [named(test, "dense", F.lit("dense"))]
    out += [named(test, f"fixed_{b}", F.lit(str(b))) for b in budgets]
    out.append(named(test, "offline_oracle", picked(F.transform("safe", lambda s: s.cast("double")), F.lit(1.0), budgets)))
    known = scored.where("split = 'validation'").groupBy(*by, "budget").agg(F.avg((~F.col("safe").cast("boolean")).cast("int")).alias("unsafe"))
    for risk in risks:
        fixed = known.where(F.col("unsafe") <= risk).groupBy(*by).agg(F.min("budget").cast("string").alias("_b"))
        out.append(named(test.join(fixed, list(by), "left") if by else test.crossJoin(F.broadcast(fixed)), f"validation_fixed_risk_{risk:.2f}", F.coalesce("_b", F.lit("dense"))))
        threshold = grid_threshold(validation, risk, *by, budgets=budgets)
        joined = test.join(threshold, list(by)) if by else test.crossJoin(F.broadcast(threshold))  # a row per group
        out.append(named(joined, f"metadata_logistic_risk_{risk:.2f}", picked(F.col("scores"), F.col("threshold"), budgets)))
    all_ = out[0]
    for df in out[1:]:
        all_ = all_.unionByName(df)
    return all_


def cross_fit_replay(rows: DataFrame, budgets: tuple[int, ...], risks: tuple[float, ...], steps: int = 500, penalty: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(decisions (risk, key, fold, selected_budget), thresholds (risk, fold, threshold)): for each fold and risk a threshold from the other folds alone.

    ``rows``: key, fold, budget, features, safe, energy_joule, dense_energy_joule. The models of a fold are fitted without it and score the other folds, on
    which the threshold is chosen, and the fold itself, which it decides.
    """
    # texts are read for features once, and nothing is scored once a risk
    rows = written(rows.select("key", "fold", "budget", "features", "safe", "energy_joule", "dense_energy_joule"), "fold-rows")
    models = models_without(rows, steps=steps, penalty=penalty)
    every = with_scores(rows, models, "budget")  # a row for each model of its budget
    scored = written(_arrays(every, budgets, "key", "fold", "without"), "fold-scores")
    decisions = thresholds = None
    for risk in risks:
        at = grid_threshold(scored.where("without <> fold"), risk, "without", budgets=budgets).select(F.lit(risk).alias("risk"), F.col("without").alias("fold"), "threshold")
        held = scored.where("without = fold").join(at, "fold")
        chosen = held.select("risk", "key", "fold", picked(F.col("scores"), F.col("threshold"), budgets).alias("selected_budget"))
        decisions = chosen if decisions is None else decisions.unionByName(chosen)
        thresholds = at if thresholds is None else thresholds.unionByName(at)
    return decisions, thresholds
