"""Queries over answers, options, questions and records' scalar measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import answers as A
from brindle.functions.numbers import budget_order, clip, energy_budget_order, null_skipping_sum, r6
from brindle.operators import records
from brindle.sources import readers
from brindle.sources.adapters import view, with_views

#: Fixed values for DuckDB: the white space that Unicode knows.
_SPACE = "[\\s\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _squash(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


def _normal(x: str) -> str:
    bare = _squash(f"translate(lower({x}), '.,;', '')")
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.ALIASES.items())
    return f"CASE {bare} {cases} ELSE {bare} END"


_A, _S, _R, _P = with_views("answers"), with_views("samples"), with_views("eval_records"), with_views("call_pairs")


def _evaluated(s, sf):
    rows = records.with_dense(records.evaluate(view(s, sf, "call_pairs"), usd_per_1k_ms=0.5, joule_per_ms=0.2))
    numbers = ("vem", "dense_vem", "reliance_retention", "delta_vem", "latency_ms", "cost", "energy_joule", "api_cost_usd", "measured_energy_joule", "proxy_energy_joule")
    rest = ("is_correct", "support_metric", "answer_flip_support", "shortcut_persistence", "api_prompt_tokens", "api_completion_tokens", "api_total_tokens")
    return rows.select("sample_id", "line", "part", "supp", "method", "intervention", *(r6(c).alias(c) for c in numbers), *rest)


_both = lambda c: f"CASE WHEN original_{c} IS NOT NULL OR intervened_{c} IS NOT NULL THEN coalesce(original_{c}, 0) + coalesce(intervened_{c}, 0) END"
_six = lambda n, x=None: f"round({x or n}::DOUBLE + 1e-9, 6) AS {n}"
_EVALUATED_SQL = f"""{_P}, n AS (SELECT *, {_normal("original_answer")} AS o, {_normal("intervened_answer")} AS i, {_normal("gold_answer")} AS g, coalesce(score_type = 'answer_only', false) AS only_answers FROM call_pairs),
  m AS (SELECT *, CASE WHEN only_answers THEN (o <> i)::INT::DOUBLE ELSE original_logprob - intervened_logprob END AS vem, {_both("api_cost_usd")} AS api, {_both("measured_energy_joule")} AS measured,
        original_latency_ms + intervened_latency_ms AS ms FROM n),
  d AS (SELECT sample_id, intervention, max(vem) AS dv FROM m WHERE method = 'dense' GROUP BY ALL),
  j AS (SELECT m.*, CASE WHEN method = 'dense' THEN vem ELSE dv END AS dense FROM m LEFT JOIN d ON m.sample_id = d.sample_id AND m.intervention = d.intervention)
  SELECT sample_id, line, part, supp, method, intervention, {_six("vem")}, {_six("dense_vem", "dense")},
    {_six("reliance_retention", "(CASE WHEN method = 'dense' THEN CASE WHEN abs(vem) > 1e-9 THEN 1 END WHEN abs(dense) >= 1e-6 THEN vem / dense END)")},
    {_six("delta_vem", "(CASE WHEN method = 'dense' THEN 0 ELSE dense - vem END)")}, {_six("latency_ms", "ms")}, {_six("cost", "coalesce(api, ms / 1000 * 0.5)")}, {_six("energy_joule", "coalesce(measured, ms * 0.2)")},
    {_six("api_cost_usd", "api")}, {_six("measured_energy_joule", "measured")}, {_six("proxy_energy_joule", "ms * 0.2")}, o = g AS is_correct,
    CASE WHEN only_answers THEN 'answer_flip_support' ELSE 'score_vem' END AS support_metric, CASE WHEN only_answers THEN o <> i END AS answer_flip_support, o = i AS shortcut_persistence,
    {", ".join(f"({_both(f'api_{t}_tokens')})::BIGINT AS api_{t}_tokens" for t in ("prompt", "completion", "total"))} FROM j"""

#: How an answer is written around a part's brand, by the part's number, in both engines.
_WRITTEN = ("A", "a: {b}", "The answer is B.", "{b} it is", "I think it is {b}", "{b} or {t}", "Yes, it is", "No.", "yes and no", "  maybe ", "choice: b", "B {b}", "option is A", "answers b")


def _answers_sql(engine: str) -> str:
    parts = {"spark": "concat({})", "duckdb": "concat({})"}[engine]
    cases = []
    for i, w in enumerate(_WRITTEN):
        pieces = [x for x in w.replace("{b}", "|p_brand|").replace("{t}", "|p_type|").split("|") if x]
        cases.append(f"WHEN {i} THEN " + parts.format(", ".join(x if x in ("p_brand", "p_type") else f"'{x}'" for x in pieces)))
    return f"CASE p_partkey % {len(_WRITTEN)} {' '.join(cases)} END"


def _canonical(s, sf):
    rows = view(s, sf, "part").select(F.col("p_partkey").alias("id"), F.expr(_answers_sql("spark")).alias("answer"), F.array("p_brand", "p_type").alias("o"))
    letters = F.zip_with(F.array(F.lit("A"), F.lit("B")), "o", lambda a, b: F.struct(a.alias("letter"), b.alias("text")))
    return rows.withColumn("l", letters).select("id", A.canonicalize_answer(F.col("answer"), F.col("o"), F.col("l")).alias("canonical"))


def _canonical_sql() -> str:
    n = _normal("answer")
    letter = "lower(chr(64 + i::INT))"
    tokens, word = "regexp_split_to_array(n, '[\\s:\\-]+')", lambda i: f"regexp_extract(coalesce({tokens}[{i}], ''), '^\\w+')"
    named = f"""len(list_filter(range(1, len({tokens}) + 1), lambda k: regexp_extract({tokens}[k], '\\w+$') IN ('answer', 'option', 'choice')
        AND ({word('k + 1')} = {letter} OR ({tokens}[k + 1] = 'is' AND {word('k + 2')} = {letter})))) > 0"""
    return f"""WITH c AS (SELECT *, {n} AS n FROM (SELECT p_partkey AS id, {_answers_sql('duckdb')} AS answer, [p_brand, p_type] AS o FROM part)),
      x AS (SELECT c.*, i, o[i] AS opt, {_normal("o[i]")} AS m FROM c, unnest(range(1, len(o) + 1)) AS u(i)),
      p AS (SELECT id, any_value(answer) AS answer, any_value(n) AS n,
            arg_min(opt, i) FILTER (n = {letter} OR starts_with(n, {letter} || ':') OR starts_with(n, {letter} || ' ') OR {named}) AS s1,
            arg_min(opt, i) FILTER (starts_with(n, m)) AS s2, CASE WHEN count(*) FILTER (contains(n, m)) = 1 THEN arg_min(opt, i) FILTER (contains(n, m)) END AS s3 FROM x GROUP BY id)
      SELECT id, coalesce(s1, s2, s3, CASE WHEN contains(' ' || n || ' ', ' yes ') AND NOT contains(' ' || n || ' ', ' no ') THEN 'yes'
             WHEN contains(' ' || n || ' ', ' no ') AND NOT contains(' ' || n || ' ', ' yes ') THEN 'no' END, trim(answer)) AS canonical FROM p"""


def _questions(s, sf):
    """Questions with two or three lettered options each: (A) text lines or A: text, ...; every seventh has none."""
    lines = F.concat(F.lit("(A) "), "p_brand", F.lit(",\n(B) "), "p_type", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(",\n(C) size  "), F.col("p_size").cast("string"))).otherwise(""))
    colons = F.concat(F.lit("A: "), "p_brand", F.lit(", B: "), "p_type", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(", C: size  "), F.col("p_size").cast("string"))).otherwise(""))
    listed = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Choices:\n"), lines)).otherwise(F.concat(F.lit("Options: "), colons))
    asked = F.concat(F.lit("Which part (C) or (A)?\n"), F.when(F.col("p_partkey") % 7 == 0, "").otherwise(listed))
    return view(s, sf, "part").select(F.col("p_partkey").alias("id"), asked.alias("question"), "p_brand", "p_type")


def _options(s, sf):
    found = A.lettered_options(F.col("question"))
    shown = F.array_join(F.transform(found, lambda o: F.concat(o["letter"], F.lit("="), o["text"])), "|")
    return _questions(s, sf).select("id", shown.alias("options"), F.array_join(A.option_letters(F.col("question")), "").alias("letters"))


_LISTED = "'A=' || p_brand || '|B=' || p_type || CASE WHEN p_partkey % 2 = 0 THEN '|C=size ' || p_size ELSE '' END"
_OPTIONS_SQL = f"""SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN {_LISTED} END AS options,
  CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 = 0 THEN 'CAB' ELSE 'CA' END AS letters FROM part"""


def _repaired(s, sf):
    """Letters among one benchmark's options and answers become the texts that its questions give them."""
    rows = _questions(s, sf).select(
        "id", "question", F.when(F.col("id") % 5 == 0, "other").otherwise("mmstar").alias("dataset"),
        F.when(F.col("id") % 4 == 0, F.array(F.lit("A"), F.lit("B"))).when(F.col("id") % 4 == 1, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")).alias("options"),
        F.when(F.col("id") % 3 == 0, " b ").otherwise(F.col("p_brand")).alias("answer"),
    )
    return readers.repair_options(rows).select("id", F.array_join("options", "|").alias("options"), "answer")


_REPAIRED_SQL = """WITH q AS (SELECT *, p_partkey AS id, p_partkey % 5 <> 0 AS ours, p_partkey % 7 <> 0 AS listed,
    CASE p_partkey % 4 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN [p_brand, p_type] ELSE []::VARCHAR[] END AS o, CASE WHEN p_partkey % 3 = 0 THEN ' b ' ELSE p_brand END AS a,
    CASE WHEN p_partkey % 2 = 0 THEN [p_brand, p_type, 'size ' || p_size] ELSE [p_brand, p_type] END AS texts FROM part),
  k AS (SELECT *, CASE WHEN NOT ours THEN NULL WHEN listed THEN texts WHEN len(o) > 0 THEN o END AS known FROM q)
  SELECT id, array_to_string(CASE WHEN known IS NULL THEN o WHEN len(o) = 0 THEN known WHEN o = ['A', 'B'] THEN list_transform(o, lambda x: known[ascii(x) - 64]) ELSE o END, '|') AS options,
         CASE WHEN known IS NOT NULL AND a = ' b ' THEN known[2] ELSE a END AS answer FROM k"""


def _features(s, sf):
    rows = view(s, sf, "samples")
    f = A.question_features(F.col("question"), F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit("mmstar"))
    return rows.withColumn("f", f).select("sample_id", *(r6(F.element_at("f", i)).alias(f"f{i}") for i in range(1, 18)))


def _features_sql() -> str:
    q = "question"
    words = f"len(list_filter(string_split({_squash(q)}, ' '), lambda w: w <> ''))"
    base = [f"least({words} / 50.0::DOUBLE, 2)", f"least(length({q}) / 300.0::DOUBLE, 2)", "0.75::DOUBLE", "1::DOUBLE", "1::DOUBLE", *["0::DOUBLE"] * 5]
    keys = ["(" + " OR ".join(f"contains(lower({q}), '{w}')" for w in ws) + ")::INT::DOUBLE" for ws in A.KEYWORDS.values()]
    return f"{_S} SELECT sample_id, " + ", ".join(f"round({x} + 1e-9, 6) AS f{i}" for i, x in enumerate(base + keys, 1)) + " FROM samples"


def _lit(s, sf):
    """Answers that come as a literal list of texts, a quoted text, or bare."""
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, F.concat(F.lit("['"), "p_brand", F.lit("', '"), "p_type", F.lit("']"))).when(k == 1, F.concat(F.lit('"'), "p_brand", F.lit('"')))
    raw = raw.when(k == 2, F.concat(F.lit('["'), "p_type", F.lit('"]'))).when(k == 3, F.concat(F.lit(" '"), "p_brand", F.lit("' "))).otherwise(F.col("p_name"))
    return view(s, sf, "part").select(F.col("p_partkey").alias("id"), A.literal_first(raw).alias("value"))


_LIT_SQL = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 2 THEN p_type WHEN 4 THEN p_name ELSE p_brand END AS value FROM part"


QUERIES = {
    "answer_normalize": (
        lambda s, sf: view(s, sf, "answers").select("conv_id", "turn", F.sha2(A.normalize_answer(F.col("raw_answer")), 256).alias("normal")),
        f"{_A} SELECT conv_id, turn, sha256({_normal('raw_answer')}) AS normal FROM answers",
    ),
    "answer_keys": (
        lambda s, sf: view(s, sf, "answers").select("conv_id", "turn", F.sha2(A.alnum_key(F.col("raw_answer")), 256).alias("alnum"), F.sha2(A.question_key(F.col("raw_answer")), 256).alias("question")),
        f"{_A} SELECT conv_id, turn, sha256(trim(regexp_replace(lower(raw_answer), '[^a-z0-9]+', ' ', 'g'))) AS alnum, sha256({_squash('lower(raw_answer)')}) AS question FROM answers",
    ),
    "answer_canonicalize": (_canonical, _canonical_sql()),
    "exact_match_rate": (
        lambda s, sf: view(s, sf, "call_pairs").groupBy("method", "intervention").agg(F.count("*").alias("n"), r6(F.avg(A.exact_match(F.col("original_answer"), F.col("gold_answer")).cast("int"))).alias("rate")),
        f"{_P} SELECT method, intervention, count(*) AS n, round(avg(({_normal('original_answer')} = {_normal('gold_answer')})::INT) + 1e-9, 6) AS rate FROM call_pairs GROUP BY ALL",
    ),
    "record_evaluation": (_evaluated, _EVALUATED_SQL),
    "intervention_choice": (
        lambda s, sf: records.chosen_intervention(view(s, sf, "samples").withColumn("counterfactual_image_path", F.when(F.col("sample_id") % 4 == 0, "image.png")), ("gray", "blur", "irrelevant"), "sample_id", "dataset").select("sample_id", "dataset", "intervention"),
        f"""{_S} SELECT sample_id, dataset, CASE WHEN sample_id % 4 = 0 THEN 'counterfactual' ELSE ['gray', 'blur', 'irrelevant'][1 + (row_number() OVER (PARTITION BY dataset ORDER BY sample_id) - 1) % 3] END AS intervention FROM samples""",
    ),
    "warmup_cycle": (
        lambda s, sf: records.cycled(view(s, sf, "calls"), 5, "call_id", "method").groupBy("method", "turn").agg(F.count("*").alias("n"), F.min("call_id").alias("first_call")).withColumn("turn", F.col("turn").cast("bigint")),
        f"{with_views('calls')} SELECT method, turn, count(*) AS n, min(call_id) AS first_call FROM (SELECT *, (row_number() OVER (PARTITION BY method ORDER BY call_id) - 1) % 5 AS turn FROM calls) GROUP BY ALL",
    ),
    "budget_sort_keys": (
        lambda s, sf: view(s, sf, "eval_records").select("budget", "token_count").withColumn("odd", F.when(F.col("token_count") == 64, "api").otherwise(F.col("budget"))).groupBy("budget", "odd").agg(
            F.min(budget_order(F.col("budget"), F.when(F.col("token_count") > 500, F.col("token_count")))).alias("with_dense"), F.min(budget_order(F.col("budget"))).alias("without"), F.min(energy_budget_order(F.col("odd"))).alias("energy")
        ),
        f"""{_R}, x AS (SELECT budget, token_count, CASE WHEN token_count = 64 THEN 'api' ELSE budget END AS odd FROM eval_records)
            SELECT budget, odd, min(CASE WHEN budget = 'full' THEN CASE WHEN token_count > 500 THEN token_count ELSE 1000000000 END ELSE budget::INT END) AS with_dense,
                   min(CASE WHEN budget = 'full' THEN 1000000000 ELSE budget::INT END) AS without, min(CASE WHEN odd = 'full' THEN 1000000000 ELSE coalesce(try_cast(odd AS INT), 100000000) END) AS energy FROM x GROUP BY budget, odd""",
    ),
    "option_extract": (_options, _OPTIONS_SQL),
    "option_repair": (_repaired, _REPAIRED_SQL),
    "literal_answer": (_lit, _LIT_SQL),
    "controller_features": (_features, _features_sql()),
    "evidence_and_cost": (
        lambda s, sf: view(s, sf, "eval_records").groupBy("method").agg(
            r6(F.sum(null_skipping_sum(F.col("measured_energy_joule"), F.col("energy_joule")))).alias("energy"),
            r6(F.avg(clip(F.col("reliance_retention"), 0.0, 2.0))).alias("clipped"),
            r6(F.sum(F.col("latency_ms") / 1000 * 0.5)).alias("latency_cost"),
            r6(F.avg(F.when(F.col("answer") != F.col("gold_answer"), 1.0).otherwise(0.0))).alias("flip_support"),
            r6(F.sum(F.coalesce(F.col("measured_energy_joule"), F.col("latency_ms") * 0.2))).alias("measured_or_proxy"),
        ),
        f"""{_R} SELECT method, round(sum(coalesce(measured_energy_joule, 0) + energy_joule) + 1e-9, 6) AS energy,
            round(avg(CASE WHEN reliance_retention IS NOT NULL THEN least(greatest(reliance_retention, 0), 2) END) + 1e-9, 6) AS clipped, round(sum(latency_ms / 1000 * 0.5) + 1e-9, 6) AS latency_cost,
            round(avg((answer <> gold_answer)::INT) + 1e-9, 6) AS flip_support, round(sum(coalesce(measured_energy_joule, latency_ms * 0.2)) + 1e-9, 6) AS measured_or_proxy FROM eval_records GROUP BY method""",
    ),
}
