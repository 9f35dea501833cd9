"""Language identification: script ranges, then Viterbi over the scores of words.

The scripts of a text's words leave as candidates the languages that were learnt with one of them; no other is scored. A word's score under a
language is the log probability of its letter trigrams. A text's words are then labelled by the best path over the candidates, where
each switch costs a penalty, so foreign passages become spans and single odd words don't. Texts in which
no passage can gain more than half a penalty need no path search (see :func:`LanguageModel.label`).

A switch costs the same between any two languages, so a step needs the best total per language, the best of these and a bit per language: whether the path
stays. Scores are held for a bounded number of words at a time, so a text of any length takes one bit a word and candidate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import bounded_batches, free_name, held_out, release, table, working_on
from brindle.llm.words import chunks

#: Labelled rows of each language that the model may learn from, about; and the characters of a row that it learns from.
PER_LANGUAGE, SAMPLE_CHARS = 1500, 100_000
SWITCH_PENALTY = 12.0
#: Words of one text that are scored at once, at most; words times candidates that are held at once; bytes that are cut into words at once.
STRETCH, CELLS, PIECE = 1 << 16, 1 << 21, 1 << 20
TABLE_BITS = 16
#: A script counts as a language's if so much of its letters are of it.
SCRIPT_SHARE = 0.05
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (not a numeral that words may hold)."""
    found = LETTER.search(text)
    return bool(found) and (found[0].isalpha() or any(map(str.isalpha, text)))



#: First and last code point of common scripts; what is in none of them counts as Latin.
SCRIPT_RANGES = (
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x3FFFF),
)
SCRIPTS = ("latin", *dict.fromkeys(r[0] for r in SCRIPT_RANGES))
_EDGES = np.array([e for _, a, b in SCRIPT_RANGES for e in (a, b + 1)])
_OF_EDGE = np.array([s for n, _, _ in SCRIPT_RANGES for s in (SCRIPTS.index(n), 0)])

#: Byte -> lower-case letter byte; all else in ASCII ends a word.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class Lettered:
    """Words of texts laid end to end: where they begin and end in ``data``, their trigram codes and texts."""

    data: np.ndarray
    codes: np.ndarray  # of the trigram around each byte
    first: np.ndarray
    last: np.ndarray
    at: np.ndarray  # words of text i: at[i] to at[i + 1]
    _scripts: np.ndarray | None = None

    def scripts(self) -> np.ndarray:
        """The script of each word's first letter."""
        if self._scripts is None:
            self._scripts = self._read_scripts()
        return self._scripts

    def _read_scripts(self) -> np.ndarray:
        d = np.concatenate((self.data, np.zeros(3, np.uint8))).astype(np.int64)
        a = d[self.first]
        b, c, e = (d[self.first + i] & 0x3F for i in (1, 2, 3))
        point = np.where(a < 0x80, a, np.where(a < 0xE0, (a & 0x1F) << 6 | b, np.where(a < 0xF0, (a & 0xF) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | e)))
        edge = np.searchsorted(_EDGES, point, "right") - 1
        return np.where(edge >= 0, _OF_EDGE[edge], 0)


def lettered(texts: list[bytes]) -> Lettered:
    data = _FOLD[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    # capitals of Latin-1 are two bytes of which the second is 0x80 to 0x9E
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    data[upper] += 0x20
    inside = data != 0x20
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    wide = data.astype(np.uint32)
    codes = np.zeros(len(data), np.uint32)
    codes[1:-1] = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
    starts = np.concatenate(([1], 1 + np.cumsum([len(t) + 1 for t in texts])))
    return Lettered(data, codes, turns[::2], turns[1::2], np.searchsorted(turns[::2], starts))


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # trigram codes x languages
    scripts: np.ndarray  # scripts x languages: learnt together

    def __post_init__(self):
        self._narrowed: dict[bytes, LanguageModel] = {}

    def narrowed(self, scripts: np.ndarray) -> LanguageModel:
        """The model of the languages that have one of these scripts, or of all if none has."""
        there = self.scripts[np.unique(scripts)].any(axis=0)
        if there.all() or not there.any():
            return self
        key = there.tobytes()
        if key not in self._narrowed:
            if len(self._narrowed) * there.sum() > 4 * len(self.languages):
                self._narrowed.clear()
            self._narrowed[key] = LanguageModel([x for x, y in zip(self.languages, there, strict=True) if y], np.ascontiguousarray(self.log_p[:, there]), self.scripts[:, there])
        return self._narrowed[key]

    def word_scores(self, x: Lettered, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Words x languages; languages that a word's script excludes are far below, a word of an unknown script is the same to all."""
        first, last = x.first[start:stop], x.last[start:stop]
        if not len(first):
            return np.zeros((0, len(self.languages)), np.float32)
        begin = np.concatenate(([0], np.cumsum(last - first)[:-1]))
        scores = np.zeros((len(first), len(self.languages)), np.float32)
        spots = np.repeat(first - begin, last - first) + np.arange((last - first).sum())
        # a long word's trigrams are many: they are added up for so many at a time
        for w in _runs(last - first, max(1, CELLS // len(self.languages))):
            lo, hi = begin[w.start], begin[w.stop - 1] + (last - first)[w.stop - 1]
            if hi - lo <= max(1, CELLS // len(self.languages)):
                scores[w] = np.add.reduceat(self.log_p[x.codes[spots[lo:hi]]], begin[w] - lo, axis=0)
            else:
                codes, times = np.unique(x.codes[spots[lo:hi]], return_counts=True)
                scores[w] = times.astype(np.float32) @ self.log_p[codes]
        script = x.scripts()[start:stop]
        if (script > 0).any() or not self.scripts[0].all():
            can = self.scripts[script]
            scores = np.where(can.any(axis=1, keepdims=True), np.where(can, scores, scores.min(axis=1, keepdims=True) - 50), np.float32(0))
        return scores

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """Per text: language, score, and spans (language, first word, words).

        The path that stays in the language of the highest total loses to none with m stretches in other
        languages if no stretch gains more than half a penalty: such a path gains at most m halves and
        has m switches, or m - 1 if it never comes to that language (for m = 1 it gains nothing). Other texts are searched.
        """
        out: list = [(UNDETERMINED, 0.0, [])] * len(texts)
        k = len(self.languages)
        use = [i for i, t in enumerate(texts) if t and has_letter(t)] if k else []
        coded = [texts[i].encode() for i in use]
        later: dict[bytes, tuple[LanguageModel, list]] = {}
        for s in chunks(coded, min(PIECE, max(1, 2 * CELLS // max(k, 1)))):
            if len(coded[s]) == 1 and len(coded[s][0]) > min(PIECE, 2 * CELLS // k):
                out[use[s.start]] = self._whole(coded[s][0])
                continue
            x = lettered(coded[s])
            n = np.diff(x.at)
            script = x.scripts()
            groups: dict[bytes, tuple[LanguageModel, list[int]]] = {}
            for j in range(len(n)):
                if n[j] > STRETCH:
                    out[use[s.start + j]] = self._whole(coded[s][j])
                elif not n[j]:  # letters that no word of ours has
                    out[use[s.start + j]] = (self.languages[0], 1.0 / k, [])
                else:
                    m = self.narrowed(script[x.at[j] : x.at[j + 1]])
                    groups.setdefault("\0".join(m.languages).encode(), (m, []))[1].append(j)
            for key, (m, js) in groups.items():
                if len(js) == len(n):
                    own, w = x, m.word_scores(x).astype(np.float64)
                else:
                    own = lettered([coded[s][j] for j in js])
                    w = m.word_scores(own).astype(np.float64)
                held = later.setdefault(key, (m, []))[1]
                for j, found in zip(js, m._stay(own, w), strict=True):
                    if isinstance(found, tuple):
                        out[use[s.start + j]] = found
                    else:
                        held.append((use[s.start + j], *found))
                if sum(x[1].size for x in held) > CELLS:
                    m._search(held, out)
                    held.clear()
        for m, held in later.values():
            m._search(held, out)
        return out

    def _stay(self, x: Lettered, w: np.ndarray) -> list:
        """Per text the result if it stays in one language, else [its scores, letters of its words] for the search."""
        n, k = np.diff(x.at), len(self.languages)
        of = np.repeat(np.arange(len(n)), n)
        sums = np.concatenate((np.zeros((1, k)), np.cumsum(w, axis=0)))
        total = sums[x.at[1:]] - sums[x.at[:-1]]
        best = total.argmax(axis=1)
        gain = np.zeros(len(n))
        own = w[np.arange(len(w)), best[of]]
        for b in range(k):
            c = np.cumsum(w[:, b] - own)
            drop = of * (float(np.abs(c).max()) * 2 + 1.0)  # below all of the texts before
            low = np.minimum.accumulate(np.concatenate(([0.0], c[:-1])) - drop) + drop
            gain = np.maximum(gain, np.maximum.reduceat(c - low, x.at[:-1]))
        letters = x.last - x.first
        out: list = []
        for j, (a, b) in enumerate(zip(x.at[:-1], x.at[1:], strict=True)):
            if gain[j] > SWITCH_PENALTY / 2:
                out.append([w[a:b].astype(np.float32), letters[a:b]])
            else:
                out.append(self._result(w[a:b].sum(axis=0), np.array([best[j]]), np.array([0]), np.array([n[j]]), letters[a:b]))
        return out

    def _result(self, total: np.ndarray, langs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, letters: np.ndarray):
        sums = np.concatenate(([0], np.cumsum(letters)))
        share = np.bincount(langs, sums[starts + sizes] - sums[starts], len(self.languages))
        lang = int(share.argmax())
        odds = np.exp(np.minimum(total - total[lang], 50.0))
        part = share[lang] / max(share.sum(), 1)
        score = float(part * (1.0 if len(langs) > 1 else 1.0 / odds.sum()))
        return self.languages[lang], min(max(score, 0.0), 1.0), [(self.languages[a], int(b), int(c)) for a, b, c in zip(langs, starts, sizes, strict=True)]

    def _spans(self, total: np.ndarray, path: np.ndarray, letters: np.ndarray):
        starts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        return self._result(total, path[starts], starts, np.diff(np.append(starts, len(path))), letters)

    def _search(self, todo: list[tuple[int, np.ndarray, np.ndarray]], out: list) -> None:
        """Best paths of many texts, word by word over all texts that are as long: a step serves them all."""
        if not todo:
            return
        size = np.array([len(x[1]) for x in todo])
        order = np.argsort(-size, kind="stable")
        begin, long = (np.cumsum(size) - size)[order], size[order]
        w = np.concatenate([x[1] for x in todo])
        v = w[begin].astype(np.float64)
        stays, top = np.ones(w.shape, bool), np.zeros(len(w), np.int16)
        for t in range(1, int(long[0])):
            m = int(np.searchsorted(-long, -t, "left"))
            now, at = v[:m], begin[:m] + t
            best = now.argmax(axis=1)
            switch = now[np.arange(m), best][:, None] - SWITCH_PENALTY
            stays[at], top[at] = now >= switch, best
            v[:m] = np.maximum(now, switch) + w[at]
        path, lang = np.empty(len(w), np.int16), v.argmax(axis=1)
        for t in range(int(long[0]) - 1, -1, -1):
            m = int(np.searchsorted(-long, -t, "left"))
            at = begin[:m] + t
            path[at] = lang[:m]
            lang[:m] = np.where(stays[at, lang[:m]], lang[:m], top[at])
        for (i, scores, letters), a, n in zip(todo, np.cumsum(size) - size, size, strict=True):
            out[i] = self._spans(scores.sum(axis=0, dtype=np.float64), path[a : a + n], letters)

    def _whole(self, raw: bytes):
        """The result of one long text, whose scores are never held for more than a stretch: totals, gains, then the path."""
        pieces = list(_pieces(raw))
        seen = np.unique(np.concatenate([np.unique(lettered([raw[a:b]]).scripts()) for a, b in pieces]))
        m = self.narrowed(seen)
        k = len(m.languages)
        block = max(1, min(1 << 14, CELLS // k))

        def scored():
            for a, b in pieces:
                x = lettered([raw[a:b]])
                for at in range(0, len(x.first), block):
                    w, long = m.word_scores(x, at, at + block).astype(np.float64), (x.last - x.first)[at : at + block]
                    yield from ((w[i : i + STRETCH], long[i : i + STRETCH]) for i in range(0, len(w), STRETCH))

        total, letters = np.zeros(k), []
        for w, long in scored():
            total += w.sum(axis=0)
            letters.append(long)
        best, letters = int(total.argmax()), np.concatenate(letters) if letters else np.zeros(0, np.int64)
        if not len(letters):
            return self.languages[0], 1.0 / len(self.languages), []
        reached, low, gain = np.zeros(k), np.zeros(k), 0.0
        for w, _ in scored():
            c = reached + np.cumsum(w - w[:, [best]], axis=0)
            lowest = np.minimum(low, np.minimum.accumulate(np.concatenate((reached[None], c[:-1])), axis=0))
            gain = max(gain, float((c - lowest).max()))
            reached, low = c[-1], np.minimum(lowest[-1], c[-1])
        if gain <= SWITCH_PENALTY / 2:
            return m._result(total, np.array([best]), np.array([0]), np.array([len(letters)]), letters)
        v, bits, top, first = np.zeros(k), [], [], True
        for w, _ in scored():
            stays, tops = np.ones(w.shape, bool), np.zeros(len(w), np.int16)
            for t, row in enumerate(w):
                if first:
                    v, first = row.copy(), False
                    continue
                tops[t] = best = v.argmax()
                switch = v[best] - SWITCH_PENALTY
                np.greater_equal(v, switch, out=stays[t])
                v = np.maximum(v, switch) + row
            bits.append((len(w), np.packbits(stays, axis=1)))
            top.append(tops)
        lang, path = int(v.argmax()), []
        for (n, packed), tops in zip(reversed(bits), reversed(top), strict=True):
            stays, tops, here = np.unpackbits(packed, axis=1, count=k), tops.tolist(), np.empty(n, np.int16)
            for t in range(n - 1, -1, -1):
                here[t] = lang
                if not stays[t, lang]:
                    lang = tops[t]
            path.append(here)
        return m._spans(total, np.concatenate(path[::-1]), letters)


def _runs(sizes: np.ndarray, most: int) -> list[slice]:
    """Slices of as many sizes as add up to ``most``, one at least."""
    ends, out, a = np.cumsum(sizes), [], 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        out.append(slice(a, b))
        a = b
    return out


def _pieces(raw: bytes):
    """(first, last) of pieces of about ``PIECE`` bytes that end between words."""
    a = 0
    while a < len(raw):
        b = min(a + PIECE, len(raw))
        while b < len(raw):
            ends = np.flatnonzero(_FOLD[np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - b), b)] == 0x20)
            if len(ends):
                b += int(ends[0]) + 1
                break
            b = min(b + PIECE, len(raw))
        yield a, b
        a = b


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How often each trigram code stands in texts, and how many letters of each script their words have."""
    counts, scripts = np.zeros(1 << TABLE_BITS, np.int64), np.zeros(len(SCRIPTS))
    for s in chunks(texts, 1 << 20):
        x = lettered(texts[s])
        counts += np.bincount(x.codes[x.data != 0x20], minlength=1 << TABLE_BITS)
        scripts += np.bincount(x.scripts(), x.last - x.first, len(SCRIPTS)) if len(x.first) else 0
    return counts, scripts


def _model(counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """A model from the counts of each language."""
    languages = sorted(counted)
    log_p, can = np.zeros((1 << TABLE_BITS, len(languages)), np.float32), np.zeros((len(SCRIPTS), len(languages)), bool)
    for i, lang in enumerate(languages):
        counts, scripts = counted[lang]
        log_p[:, i] = np.log(counts + 0.5) - np.log((counts + 0.5).sum())
        can[:, i] = scripts >= SCRIPT_SHARE * max(scripts.sum(), 1)
    return LanguageModel(languages, log_p, can)


def fit(samples: dict[str, list[str]]) -> LanguageModel:
    """A model from texts of each language."""
    return _model({lang: _counts([t.encode() for t in texts]) for lang, texts in samples.items()})


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """A model from text and language of rows that aren't held out.

    The sample is bounded: of each language about ``PER_LANGUAGE`` rows, chosen by hash, and of a longer text ``SAMPLE_CHARS`` characters
    from a place chosen by hash. Tasks count trigrams; the driver gets the sums of each language, no text.
    """
    usable = F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)
    over = F.greatest(F.length(text) - SAMPLE_CHARS, F.lit(0)) + 1
    some = F.substring(F.col(text), (F.pmod(F.xxhash64(text), over) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    known = docs.where(usable).select(F.col(key).alias("key"), some.alias("text"), F.col(lang).alias("lang"))
    there = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not there:
        return fit({})
    share = F.create_map(*[F.lit(v) for k, n in there.items() for v in (k, min(1.0, PER_LANGUAGE / n))])
    # hashed with the text, so that rows of one id don't all come or stay away
    place = F.xxhash64("key", "text")
    chosen = F.pmod(place, F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)
    # a row that is repeated counts once, so that copies don't crowd the sample; texts are counted where they are
    rows = bounded_batches(known.where(chosen).distinct().select("lang", "text"))

    def count(batches):
        working_on("language")
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                got = _counts([t.encode() for x, t in zip(langs, batch.column(1).to_pylist(), strict=True) if x == lang])
                old = found.setdefault(lang, [np.zeros(1 << TABLE_BITS, np.int64), np.zeros(len(SCRIPTS))])
                found[lang] = [a + b for a, b in zip(old, got, strict=True)]
        for lang, (counts, scripts) in found.items():
            yield packed(lang, counts, scripts)

    def packed(lang, counts, scripts):
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([counts.astype("<i8").tobytes()], pa.binary()), pa.array([scripts.astype("<f8").tobytes()], pa.binary())], ["lang", "counts", "scripts"])

    def add(group: pa.Table) -> pa.Table:
        counts = sum(np.frombuffer(x.as_py(), "<i8") for x in group["counts"])
        scripts = sum(np.frombuffer(x.as_py(), "<f8") for x in group["scripts"])
        return pa.Table.from_batches([packed(group["lang"][0].as_py(), counts, scripts)])

    table_ = "lang string, counts binary, scripts binary"
    added = rows.mapInArrow(count, table_).groupBy("lang").applyInArrow(add, table_).collect()  # a table of half a megabyte a language
    model = _model({r["lang"]: (np.frombuffer(r["counts"], "<i8"), np.frombuffer(r["scripts"], "<f8")) for r in added})
    release()  # the driver goes on with other work
    return model


def labeller(spark: SparkSession, model: LanguageModel, text: str = "text") -> Column:
    """struct(lang_pred, score, spans) of a column of whole texts."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, spans: array<struct<lang: string, first_word: int, words: int>>>")
    def label(texts: pa.Array) -> pa.Array:
        working_on("language")
        found = sent.value.label(texts.to_pylist())
        span = pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())])
        spans = pa.array([[dict(zip(("lang", "first_word", "words"), s, strict=True)) for s in f[2]] for f in found], pa.list_(span))
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], ["lang_pred", "score", "spans"]
        )

    return label(F.coalesce(F.col(text), F.lit("")))


def with_language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred, score (0 to 1) and spans.

    Narrow: one pass, no shuffle. ``und`` and 0 if a text is null, empty or has no letter, or if
    nothing was learnt. Very long texts: labelled whole, in stretches. Null ids: not held out. Ties: the language first by name. Repeated rows: each on its
    own. An empty table: no rows. Other columns stay; those of the four names are replaced.
    """
    docs = bounded_batches(docs)
    name = free_name(docs, "language")
    marked = docs.withColumns({"held_out": held_out(key), name: labeller(docs.sparkSession, learn(docs, key, text, lang), text)})
    return marked.withColumns({c: F.col(f"{name}.{c}") for c in ("lang_pred", "score", "spans")}).drop(name)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return with_language(docs).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))
