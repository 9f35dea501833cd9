"""DuckDB SQL for the training-data queries that SQL can express.

The others need a tokenizer, a model or an order-dependent match, which SQL has not; they are tested against brute force.
"""

from __future__ import annotations

from brindle.llm import fingerprints, licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text with A-Z in lower case, other letters as they are.
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
  t AS (SELECT doc_id, unnest(s) AS x FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS n, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n),
  c AS (SELECT n, min(m) AS root FROM r GROUP BY n)
  SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.root AS component_id FROM s JOIN c ON c.n = s.doc_id"""

#: CRC-32 of a list of bytes: to each byte its bits are shifted out one by one.
_CRC32 = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform({bytes}, lambda b: [b::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
    "lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END), 4294967295)"
)
_CRC_OF_ID = _CRC32.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))")


def _discounts(table: str, n: str) -> str:
    """d1, d2 and d3 from the numbers of counts 1 to 4."""
    terms = [f"{k} - {k + 1} * (n1::DOUBLE / (n1 + 2 * n2)) * n{k + 1} / n{k}" for k in (1, 2, 3)]
    counts = ", ".join(f"count(*) FILTER ({n} = {k}) AS n{k}" for k in (1, 2, 3, 4))
    inner = f"SELECT *, n1 > 0 AND n2 > 0 AND n3 > 0 AND n4 > 0 AND least({', '.join(terms)}) >= 0 AS usable FROM (SELECT {counts} FROM {table})"
    return "SELECT " + ", ".join(f"CASE WHEN usable THEN {t} ELSE {f} END AS d{k}" for k, t, f in zip((1, 2, 3), terms, (0.5, 1.0, 1.5), strict=True)) + f" FROM ({inner})"


LM = f"""WITH d AS (SELECT doc_id, coalesce({_CRC_OF_ID} % 7 = 2, false) AS held, list_append(regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+'), chr(10)) AS w FROM documents),
  t AS (SELECT doc_id, held, w[i] AS w, CASE WHEN i = 1 THEN ' ' ELSE w[i - 1] END AS v FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
  u AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w),
  s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM u),
  b AS (SELECT v, w, count(*) AS n FROM t WHERE NOT held GROUP BY v, w),
  a AS (SELECT w, count(*) AS a FROM b GROUP BY w),
  x AS (SELECT v, sum(n) AS t, count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n > 2) AS n3 FROM b GROUP BY v),
  db AS ({_discounts("b", "n")}),
  da AS ({_discounts("a", "a")}),
  r AS (SELECT count(*) FILTER (a = 1) * any_value(d1) + count(*) FILTER (a = 2) * any_value(d2) + count(*) FILTER (a > 2) * any_value(d3) AS r, sum(a) AS pairs FROM a, da),
  p AS (SELECT t.doc_id, t.held, t.w, t.v, s.n AS train, coalesce(u.c, 0) AS c, s.v AS vocabulary, x.t, b.n,
          greatest(coalesce(a.a, 0) - CASE coalesce(a.a, 0) WHEN 0 THEN 0 WHEN 1 THEN da.d1 WHEN 2 THEN da.d2 ELSE da.d3 END, 0) / r.pairs + r.r / r.pairs / (s.v + 1) AS low,
          greatest(coalesce(b.n, 0) - CASE coalesce(b.n, 0) WHEN 0 THEN 0 WHEN 1 THEN db.d1 WHEN 2 THEN db.d2 ELSE db.d3 END, 0) AS high,
          db.d1 * x.n1 + db.d2 * x.n2 + db.d3 * x.n3 AS rest
        FROM t CROSS JOIN s CROSS JOIN da CROSS JOIN db CROSS JOIN r LEFT JOIN u ON u.w = t.w LEFT JOIN a ON a.w = t.w LEFT JOIN x ON x.v = t.v LEFT JOIN b ON b.v = t.v AND b.w = t.w)
  SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(train) AS train_tokens,
         round(sum(log10((c + 1) / (train + vocabulary + 1))), 6) AS base_score,
         round(sum(log10(CASE WHEN t IS NULL THEN low ELSE high / t + rest / t * low END)), 6) AS score FROM p GROUP BY doc_id, held"""

_CRC_OF_RUN = _CRC32.format(
    bytes="flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))"
)

SPELLING = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_FOLDED}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
  g AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
  h AS MATERIALIZED (SELECT run, n, {_CRC_OF_RUN} AS h FROM g),
  x AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
  v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM x WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
  e AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
  p AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM e a JOIN e b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT v.word, e.word, e.n FROM e JOIN v ON v.word = e.rest
    UNION SELECT e.word, v.word, v.n FROM e JOIN v ON v.word = e.rest),
  f AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': near}}) AS best FROM p GROUP BY word),
  o AS MATERIALIZED (SELECT v.word, v.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * v.n THEN best.near END AS form, CASE WHEN -best.less >= 2 * v.n THEN -best.less END AS form_n
        FROM v LEFT JOIN f USING (word)),
  c AS (SELECT word, word AS at FROM o UNION ALL SELECT c.word, o.form FROM c JOIN o ON o.word = c.at WHERE o.form IS NOT NULL)
  SELECT o.word, o.form, c.at AS root, o.n, o.n_near, o.form_n FROM o JOIN c ON c.word = o.word JOIN o AS l ON l.word = c.at WHERE l.form IS NULL"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: 160 bits as 32 characters of 5: from every 5 hexadecimal digits 4 characters.
_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda i: substr('"
    + _ALPHABET
    + "', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '')"
)

WARC = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
  q AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
         CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


def _fingerprint(text: str) -> str:
    phrases = f"array_to_string(list_transform(regexp_extract_all(p, '{fingerprints.PHRASE}'), lambda x: substr(md5(x), 1, {fingerprints.LEAF})), '.')"
    node = fingerprints.NODE
    paragraph_hash = f"sha256({phrases} || '~' || p)"
    hashes = f"list_transform(string_split(s, chr(10)), lambda p: {paragraph_hash})"
    section_hash = f"sha256(array_to_string({hashes}, ''))"
    shown = f"array_to_string(list_transform(string_split(s, chr(10)), lambda p: substr({paragraph_hash}, 1, {node}) || '~' || {phrases}), ',')"
    sections = f"string_split({text}, chr(10) || chr(10))"
    return (
        f"sha256(array_to_string(list_transform({sections}, lambda s: {section_hash}), '')) || ';' || "
        f"array_to_string(list_transform({sections}, lambda s: substr({section_hash}, 1, {node}) || '=' || {shown}), ';')"
    )


def _set(text: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{fingerprints.PHRASE}'), "
        f"lambda x: substr(md5(x), 1, {fingerprints.LEAF})))))"
    )


def _changed() -> str:
    """From fingerprints ft and fe."""
    sections = "string_split({x}, ';')[2:]"
    of = "list_transform(string_split(split_part(s, '=', 2), ','), lambda p: substr(p, 1, %d))" % fingerprints.NODE
    there = f"flatten(list_transform({sections.format(x='fe')}, lambda s: {of}))"
    differing = f"list_filter({sections.format(x='ft')}, lambda s: NOT list_contains({sections.format(x='fe')}, s))"
    return f"len(list_distinct(list_filter(flatten(list_transform({differing}, lambda s: {of})), lambda q: NOT list_contains({there}, q))))::BIGINT"


def _like(a: str, b: str, same: str) -> str:
    return f"CASE WHEN {same} THEN 1.0::DOUBLE WHEN len({a}) + len({b}) > 0 THEN 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) ELSE 0.0::DOUBLE END"


FINGERPRINTS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  o AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS x FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  e AS (SELECT doc_id, t, n, x, substr(t, 1, n - n // 2) || substr(x, 1, n // 2) AS e FROM o),
  f AS (SELECT doc_id, n, t, e, x, {_fingerprint("t")} AS ft, {_fingerprint("e")} AS fe, {_set("t")} AS st, {_set("e")} AS se, {_set("x")} AS sx FROM e)
  SELECT doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256, ft AS fingerprint, fe AS edited_fingerprint,
         {_like("st", "se", "t = e")} AS near_edited, {_like("st", "sx", "t = x")} AS near_next, {_changed()} AS n_changed FROM f"""


_WORDS = "regexp_extract_all({x}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _templates() -> str:
    import re
    from math import ceil

    rows = []
    for i, (text, label) in enumerate(licenses.TEMPLATES):
        words = re.findall("[0-9a-z]+", text.lower())
        distinct = sorted(set(words))
        rows.append(f"({i}, '{label}', {_list(distinct)}, {ceil(licenses.CONTAINMENT * len(distinct) - 1e-9)}, {ceil(licenses.WINDOW * len(words))}, {len(words)})")
    return ", ".join(rows)


def _spans() -> str:
    """Where each word of a template stands first and last in it, and how often."""
    import re

    texts = [re.findall("[0-9a-z]+", text.lower()) for text, _ in licenses.TEMPLATES]
    return ", ".join(f"({i}, '{x}', {w.index(x)}, {len(w) - 1 - w[::-1].index(x)}, {w.count(x)})" for i, w in enumerate(texts) for x in sorted(set(w)))


def _steps() -> str:
    import re
    from collections import Counter

    texts = [re.findall("[0-9a-z]+", text.lower()) for text, _ in licenses.TEMPLATES]
    return ", ".join(f"({i}, '{x}', '{y}', {n})" for i, w in enumerate(texts) for (x, y), n in sorted(Counter(zip(w[:-1], w[1:], strict=True)).items()))


def _spans() -> str:
    """Where each word of a template stands first and last in it, and how often."""
    import re

    texts = [re.findall("[0-9a-z]+", text.lower()) for text, _ in licenses.TEMPLATES]
    return ", ".join(f"({i}, '{x}', {w.index(x)}, {len(w) - 1 - w[::-1].index(x)}, {w.count(x)})" for i, w in enumerate(texts) for x in sorted(set(w)))


LICENSES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_FOLDED} AS t FROM documents), w AS (SELECT doc_id, t, {_WORDS.format(x="t")} AS w FROM d),
  ph AS (SELECT * FROM (VALUES {", ".join(f"({_list(p.split())}, '{label}')" for p, label in licenses.PHRASES)}) AS v(p, label)),
  b AS (SELECT doc_id, label, i - 1 AS place FROM w, ph, unnest(range(1, len(w) + 1)) AS u(i) WHERE list_contains(w, p[2]) AND w[i:i + len(p) - 1] = p),
  bs AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM b GROUP BY doc_id),
  te AS (SELECT * FROM (VALUES {_templates()}) AS v(k, label, ws, need, win, n)),
  tw AS (SELECT k, need, unnest(ws) AS word FROM te),
  ts AS (SELECT * FROM (VALUES {_steps()}) AS v(k, word, after, times)),
  dw AS (SELECT doc_id, unnest(w) AS word, unnest(list_append(w[2:], NULL)) AS after, unnest(range(0, len(w))) AS pos FROM w),
  oc AS (SELECT doc_id, k, need, word, after, pos FROM dw JOIN tw USING (word)),
  en AS MATERIALIZED (SELECT * FROM oc JOIN (SELECT doc_id, k FROM oc GROUP BY doc_id, k, need HAVING count(DISTINCT word) >= need) USING (doc_id, k)),
  sp AS (SELECT * FROM (VALUES {_spans()}) AS v(k, word, first_place, last_place, times)),
  fo AS (SELECT doc_id, k, pos, times FROM en JOIN ts USING (k, word, after)),
  tu AS (SELECT doc_id, k, pos, times, coalesce(last_place <= lag(first_place) OVER (PARTITION BY doc_id, k ORDER BY pos), false)::INT AS turn FROM en JOIN sp USING (k, word)),
  pr AS (SELECT x.doc_id, x.k, x.pos AS e, y.pos AS p, row_number() OVER (PARTITION BY x.doc_id, x.k, x.pos, y.word ORDER BY y.pos DESC) AS nth_word, tu.times AS word_times, y.pos < x.pos AND fo.pos IS NOT NULL AS steps,
           row_number() OVER (PARTITION BY x.doc_id, x.k, x.pos, y.word, y.after, y.pos < x.pos AND fo.pos IS NOT NULL ORDER BY y.pos DESC) AS nth_step, fo.times AS step_times, tu.turn
         FROM en x JOIN te USING (k) JOIN en y ON y.doc_id = x.doc_id AND y.k = x.k AND y.pos BETWEEN x.pos - win + 1 AND x.pos LEFT JOIN fo ON fo.doc_id = y.doc_id AND fo.k = y.k AND fo.pos = y.pos
         JOIN tu ON tu.doc_id = y.doc_id AND tu.k = y.k AND tu.pos = y.pos),
  wi AS (SELECT doc_id, k, e, p AS s, sum((nth_word = 1)::INT) OVER back AS h, sum((nth_word <= word_times)::INT + 2 * (steps AND nth_step <= step_times)::INT) OVER back AS c, sum(turn) OVER back - turn AS turns
         FROM pr WINDOW back AS (PARTITION BY doc_id, k, e ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  li AS (SELECT doc_id, k, label, e, s, h::DOUBLE / len(ws) AS share, len(ws) AS size, (2 * c)::DOUBLE / (3 * n - 2 + 3 * (e - s + 1 + {licenses.TURN} * turns) - 2) AS q FROM wi JOIN te USING (k) WHERE h >= need),
  be AS (SELECT * FROM li QUALIFY row_number() OVER (PARTITION BY doc_id, k, e ORDER BY q DESC, s DESC) = 1),
  pl AS MATERIALIZED (SELECT be.doc_id, be.label, be.share, row_number() OVER (PARTITION BY be.doc_id ORDER BY q DESC, size DESC, be.k, e) AS nth, ps
         FROM be JOIN (SELECT be.doc_id, be.k, be.e, list(en.pos) AS ps FROM be JOIN en ON en.doc_id = be.doc_id AND en.k = be.k AND en.pos BETWEEN be.s AND be.e GROUP BY ALL) USING (doc_id, k, e)),
  gr AS (SELECT DISTINCT doc_id, 0::BIGINT AS nth, []::BIGINT[] AS taken, []::VARCHAR[] AS ls, 0.0::DOUBLE AS share FROM pl
         UNION ALL SELECT doc_id, nth, CASE WHEN stands THEN list_concat(taken, ps) ELSE taken END, CASE WHEN stands THEN list_append(ls, label) ELSE ls END, CASE WHEN stands THEN greatest(share, own) ELSE share END
         FROM (SELECT gr.doc_id, pl.nth, gr.taken, gr.ls, gr.share, pl.share AS own, pl.label, pl.ps, 2 * len(list_filter(pl.ps, lambda x: list_contains(gr.taken, x))) < len(pl.ps) AS stands
               FROM gr JOIN pl ON pl.doc_id = gr.doc_id AND pl.nth = gr.nth + 1)),
  ms AS (SELECT doc_id, ls, share FROM gr QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY nth DESC) = 1)
  SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(bs.n_base, 0) AS n_base, bs.first_word, bs.last_word, coalesce(bs.base_labels, '') AS base_labels,
         array_to_string(list_sort(list_distinct(list_concat(coalesce(ms.ls, []), CASE WHEN bs.base_labels IS NULL THEN [] ELSE string_split(bs.base_labels, ',') END))), ',') AS labels,
         CASE WHEN bs.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(ms.share, 0.0::DOUBLE) END AS score
  FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN ms USING (doc_id)"""

SQL = {"op4_jaccard_join": JACCARD, "op5_fingerprints": FINGERPRINTS, "op6_licenses": LICENSES, "op9_warc": WARC, "op11_lm_scores": LM, "op12_spelling_variants": SPELLING}
