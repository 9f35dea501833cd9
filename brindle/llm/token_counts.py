"""Token counts by whole-token shortcut.

A SentencePiece BPE model sees a text as one string with ``▁`` for spaces, yet no merge can cross from
a non-space to a space unless some vocabulary piece holds ``▁`` after another character, and none can
touch a line feed unless a piece holds one. Both facts are proved from the vocabulary when the model
loads (:class:`WholeTokenCounter` refuses other models), so a text falls into pre-tokens that are
counted one by one. The vocabulary strings that encode alone as one token are proved then, too: they
count as 1 by a look-up, and only the other pre-tokens are merged by the library. Merged counts
are remembered up to a fixed number of entries.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.shared import bounded_batches, remembers, table, working_on

MODEL = "piece_bpe_32k.model"
OVER_LIMIT = 4096
#: Most merged pre-tokens that a worker remembers, and the longest it remembers.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
SPACE = "▁"


class _Counts(dict):
    """Pre-token -> tokens. A key has an implied space before it, unless it begins with a line feed."""

    def __init__(self, encode, known):
        super().__init__(known)
        self.encode, self.room = encode, len(known) + MEMO_ENTRIES

    def __missing__(self, key: str) -> int:
        # the library puts a space before what it is given; before a line feed it is a token of its own
        n = len(self.encode(key)) - (key[:1] == "\n")
        if len(key) <= MEMO_CHARS and len(self) < self.room:
            self[key] = n
        return n


def proto_fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(raw):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, raw[at : at + size]
        at += size


class WholeTokenCounter:
    """Counts tokens of whole texts exactly as the library does."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.singles = self.prove()
        self.counts = _Counts(self.model.encode, self.singles)

    def prove(self) -> dict[str, int]:
        """Checks that texts may be cut at spaces and line feeds; returns the pre-tokens that are one token."""
        m = self.model
        pieces = [
            m.id_to_piece(i)
            for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))
        ]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a space or a line feed: texts can't be cut there")
        # normalisation must leave texts alone and only put the one space before them: no map of characters, no spaces removed
        spec = dict(proto_fields(dict(proto_fields(m.serialized_model_proto())).get(3, b"")))
        if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1) or not spec.get(5, 1):
            raise ValueError("the model normalises texts: pre-tokens can't be looked up as they stand")
        known = {"": 1}  # a lone space: encode("") has no space to put first, a text's end has
        for p in pieces:
            body = p[1:]
            if p[0] == SPACE and body and SPACE not in body:
                if m.encode(body, out_type=str) == [p]:
                    known[body] = 1
            elif SPACE not in p and m.encode("\n" + p, out_type=str) == [SPACE, "<0x0A>", p]:
                known["\n" + p] = 2
        return known

    #: What the quick cut can't take: a space at the start, or one after white space of the same kind.
    odd = re.compile(r"^ |[ \n] ")
    piece = re.compile(r" +[^ \n]*|\n[^ \n]*")

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty have none."""
        if not text:
            return 0
        if SPACE in text:
            text = text.replace(SPACE, " ")
        if self.odd.search(text):
            keys = [k[1:] if k[0] == " " else k for k in self.piece.findall(" " + text)]
        else:
            keys = text.replace("\n", " \n").split(" ")
        return sum(map(self.counts.__getitem__, keys))


_loaded: dict[str, WholeTokenCounter] = {}


def counter(model_file: str) -> WholeTokenCounter:
    """The worker's counter of this model."""
    working_on("token_counts")
    if model_file not in _loaded:
        _loaded[model_file] = WholeTokenCounter(model_file)
        remembers("token_counts", _loaded.clear)
    return _loaded[model_file]


def with_token_counts(
    df: DataFrame, text: str = "text", model_file: str | None = None, over: int = OVER_LIMIT
) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens and over_limit of every whole text.

    Narrow: no shuffle, one pass, and a worker holds one batch and a memo of fixed size.
    Null and empty texts: 0 and 0, not over the limit. Very long texts: counted whole. Repeated rows and ties: each row on its own.
    An empty table: no rows. Other columns stay; those named n_bytes, n_tokens or over_limit are replaced.
    """
    path = model_file or public_tokenizers.path(MODEL)

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        return pa.array(map(counter(path).count, texts.to_pylist()), pa.int64())

    whole = F.coalesce(F.col(text), F.lit(""))
    return bounded_batches(df).withColumns(
        {"n_bytes": F.octet_length(whole).cast("bigint"), "n_tokens": tokens(whole)}
    ).withColumn("over_limit", F.col("n_tokens") > over)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
