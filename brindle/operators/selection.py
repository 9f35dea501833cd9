"""Token selection and a synthetic scorer: the parts of inference that need no model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.answers import stable_seed


def dense_indices(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def center_indices(n: Column, keep: Column) -> Column:
    """The ``keep`` cells nearest to the centre of a square grid (ties by index), in order; a centred span if n isn't square."""
    side = F.round(F.sqrt(n)).cast("int")
    middle = (side - 1) / 2.0
    cells = F.transform(
        dense_indices(n),
        lambda i: F.struct((F.pow(F.floor(i / side) - middle, F.lit(2)) + F.pow(i % side - middle, F.lit(2))).alias("d"), i.alias("i")),
    )
    near = F.array_sort(F.transform(F.slice(F.array_sort(cells), F.lit(1), keep), lambda c: c["i"]))
    start = F.greatest(F.floor((n - keep) / 2), F.lit(0)).cast("int")
    return F.when(side * side == n, near).otherwise(F.sequence(start, start + keep - 1))


def random_indices(n: Column, keep: Column, *parts: Column) -> Column:
    """``keep`` indices by the order of their hashes with the parts: the same for the same parts, uniform over them."""
    ranked = F.array_sort(F.transform(dense_indices(n), lambda i: F.struct(F.xxhash64(*parts, i).alias("h"), i.alias("i"))))
    return F.array_sort(F.transform(F.slice(ranked, F.lit(1), keep), lambda c: c["i"]))


def top_indices(scores: Column, keep: Column) -> Column:
    """The ``keep`` places of the largest scores, in order; ties go to the larger place."""
    n = F.size(scores)
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), (-i).alias("i"))))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.array_sort(F.transform(F.slice(ranked, F.lit(1), keep), lambda c: -c["i"])))


def gather(values: Column, indices: Column) -> Column:
    return F.transform(indices, lambda i: F.get(values, i))


def kept(budget: Column, dense: Column) -> Column:
    """Tokens that a budget keeps: all for ``full``, else at most all."""
    return F.when(budget == "full", dense).otherwise(F.least(budget.try_cast("int"), dense))


def generation_summary(logits: Column, token_ids: Column) -> Column:
    """struct of tokens scored, mean, least and last log probability, first margin, mean and first entropy.

    ``logits``: array of arrays, a row per step; steps beyond the shorter of both aren't used; nulls for none.
    """

    def log_softmax(row: Column) -> Column:
        top = F.array_max(row)
        total = F.aggregate(row, F.lit(0.0), lambda s, x: s + F.exp(x - top))
        return F.transform(row, lambda x: x - top - F.log(total))

    n = F.least(F.size(logits), F.size(token_ids))
    steps = F.transform(
        F.filter(F.arrays_zip(F.slice(logits, F.lit(1), n).alias("row"), F.slice(token_ids, F.lit(1), n).alias("id")), lambda s: s["row"].isNotNull()),
        lambda s: F.struct(F.get(log_softmax(s["row"]), s["id"]).alias("lp"), F.aggregate(log_softmax(s["row"]), F.lit(0.0), lambda a, x: a - F.exp(x) * x).alias("h")),
    )
    lps, hs = F.transform(steps, lambda s: s["lp"]), F.transform(steps, lambda s: s["h"])
    mean = lambda xs: F.when(n > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n)
    first = F.reverse(F.array_sort(F.try_element_at(logits, F.lit(1))))
    return F.struct(
        n.alias("tokens"), mean(lps).alias("mean_logprob"), F.array_min(lps).alias("min_logprob"), F.try_element_at(lps, F.lit(-1)).alias("last_logprob"),
        F.when(n > 0, F.get(first, 0) - F.get(first, 1)).alias("first_margin"), mean(hs).alias("mean_entropy"), F.try_element_at(hs, F.lit(1)).alias("first_entropy"),
    )


def noise(seed: Column, *parts: Column) -> Column:
    """Between -0.04 and 0.04, from a hash."""
    return (stable_seed(seed, *parts) % 1000 / 1000.0 - 0.5) * 0.08


#: Penalties of the synthetic scorer by intervention.
PENALTIES = {"gray": 1.25, "black": 1.25, "irrelevant": 1.05, "blur": 0.55}


def synthetic_scores(df: DataFrame, seed: int = 0, dense: int = 576) -> DataFrame:
    """``df`` (sample_id, options, answer, method, budget, intervention, signal) with answer_given, logprob, confidence, latency_ms.

    Deterministic stand-in for a model: the right option has a head start that pruning and interventions wear down.
    """
    keep = kept(F.col("budget"), F.lit(dense))
    pruned = 1 - keep / F.lit(float(dense))
    blind = 1 - F.least(F.col("signal") * 4, F.lit(1.0))
    penalties = F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])
    penalty = F.coalesce(F.try_element_at(penalties, F.col("intervention")), F.lit(0.0))
    gold = F.greatest(F.array_position(F.transform("options", lambda o: F.lower(F.trim(o))), F.lower(F.trim("answer"))) - 1, F.lit(0))

    def score(option: Column, i: Column) -> Column:
        base = F.when(i == gold, 1.5).otherwise(0.2 + penalty * 0.9 + pruned * 0.15)
        return base + F.col("signal") * 2.5 - blind * 0.8 - pruned * 0.3 - penalty + noise(F.lit(seed), F.col("sample_id"), option, F.col("method"), F.col("budget"))

    rows = df.withColumn("_scores", F.transform("options", score))
    top = F.array_max("_scores")
    log_total = F.log(F.aggregate("_scores", F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    return rows.withColumns(
        {"answer_given": F.get("options", (F.array_position("_scores", top) - 1).cast("int")), "logprob": -log_total, "confidence": F.exp(-log_total), "latency_ms": 2.0 + 0.08 * keep}
    ).drop("_scores")


#: Most interventions and most cells of a run.
MOST_CELLS = 10_000


def intervention_specs(config: list[dict]) -> list[dict]:
    """A run's interventions in full: kind by default the name, a blur's radius by default 8, no restriction to datasets unless it is stated."""
    return [{"type": s["name"], "applies_to": None, **({"radius": 8.0} if s.get("type", s["name"]) == "blur" else {}), **s} for s in config]


def prompt(question: Column, options: Column) -> Column:
    """What a scorer is asked: the question, and its options one a line where there are any."""
    lines = F.array_join(F.transform(options, lambda o: F.concat(F.lit("- "), o)), "\n")
    choose = "\n\nChoose the best answer from the options below. Return exactly one option text and nothing else.\n"
    return F.when(F.size(options) > 0, F.concat(question, F.lit(choose), lines)).otherwise(F.concat(question, F.lit("\n\nAnswer with a short phrase and no explanation.")))


#: Media types by the end of a file's name; others count as PNG.
MEDIA = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "png": "image/png"}


def data_url(path: Column, content: Column) -> Column:
    """An image's bytes as a data URL."""
    known = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    media = F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))), F.lit("image/png"))
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.base64(content))


def generated(sequence: Column, prompt_ids: Column) -> Column:
    """struct(ids, kind): a model's output without the prompt where it begins with it, else as it is."""
    n = F.size(prompt_ids)
    same = (F.size(sequence) >= n) & (F.slice(sequence, F.lit(1), n) == prompt_ids)
    cut = F.slice(sequence, n + 1, F.greatest(F.size(sequence) - n, F.lit(0)))
    return F.struct(F.when(same, cut).otherwise(sequence).alias("ids"), F.when(same, "prompt_prefix_sliced").otherwise("sequence_only").alias("kind"))


def run_grid(samples: DataFrame, interventions: DataFrame, cells: DataFrame) -> DataFrame:
    """Samples times applicable interventions times (method, budget) cells; the two small tables are a run's configuration.

    An intervention with ``applies_to`` (array of datasets) is left out for others; null applies to all. Tables of more than
    ``MOST_CELLS`` rows are an error: they are sent to all tasks.
    """
    for small in (interventions, cells):
        if small.limit(MOST_CELLS + 1).count() > MOST_CELLS:
            raise ValueError(f"a run's configuration has at most {MOST_CELLS} interventions and cells")
    grid = samples.crossJoin(F.broadcast(interventions)).where(F.col("applies_to").isNull() | F.array_contains("applies_to", F.col("dataset")))
    return grid.drop("applies_to").crossJoin(F.broadcast(cells))


def score_with(df: DataFrame, scorer, schema: str) -> DataFrame:
    """The extension point: ``scorer`` takes and gives an iterator of pandas frames, once per task, so a model is loaded once."""
    return df.mapInPandas(scorer, schema)
