"""Token ids of a byte-level BPE, by the tokenizers library, with a memo of pre-token groups.

The pre-tokenizer of such a model always cuts between a character that isn't white space and white
space, and what it does after a cut doesn't depend on what stands before. So texts are cut there, each
piece is encoded by the library, and the ids of pieces met before come from a memo of fixed size. A piece
of one space and Latin letters is one pre-token as it stands and goes to the library's model at once.
Texts with odd white space or with an added token's string go another way with the same result.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers

from brindle.llm.shared import remembers, working_on

MODEL = "byte_bpe_50k.json"
#: Most pieces that a worker remembers, and the longest it remembers.
MEMO_ENTRIES, MEMO_CHARS = 600_000, 40
#: Appended to every document.
END_ID = 0
#: Letters before this are the same to all Unicode versions.
LATIN_END = "\u0250"


def _byte_chars() -> dict[int, str]:
    """How byte-level models write a byte: printable Latin-1 as itself, the others as the characters from 256 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}


BYTE_CHARS = _byte_chars()


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers. A key has an implied space before it,
    unless it begins with a line feed."""

    def __init__(self, encode, merge):
        super().__init__()
        self.encode, self.merge = encode, merge

    def __missing__(self, key: str) -> bytes:
        if key.isalpha() and max(key) < LATIN_END:
            ids = self.merge(" " + key)
        else:
            ids = self.encode(key if key[:1] == "\n" else " " + key)
        if len(key) <= MEMO_CHARS and len(self) < MEMO_ENTRIES:
            self[key] = ids
        return ids


class ByteIds:
    """``encode(text)``: the ids that the library gives for the whole text, as little-endian uint32 bytes."""

    twofold = re.compile(r"\s\s")
    run = re.compile(r"\s*\S+|\s+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        self.pieces = _Pieces(self.whole, self.merge)

    def merge(self, pre_token: str) -> bytes:
        """Ids of what is known to be one pre-token."""
        shown = pre_token.encode().decode("latin-1").translate(BYTE_CHARS)
        return np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Null and empty texts have no ids."""
        if not text:
            return b""
        if any(a in text for a in self.added):
            return self.whole(text)
        if self.twofold.search(text):
            got = self.pieces
            # a piece that begins with one space or one line feed can be remembered
            return b"".join(
                got[p[1:]] if p[0] == " " and p[1:2] != "\n" else got[p] if p[0] == "\n" else self.whole(p)
                for p in self.run.findall(text)
            )
        first, *rest = text.replace("\n", " \n").split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.pieces.__getitem__, rest))


_loaded: dict[str, ByteIds] = {}


def byte_ids(path: str) -> ByteIds:
    """The worker's encoder for this tokenizer file."""
    working_on("byte_ids")
    if path not in _loaded:
        _loaded[path] = ByteIds(path)
        remembers("byte_ids", _loaded.clear)
    return _loaded[path]


def model_path() -> str:
    return public_tokenizers.path(MODEL)
