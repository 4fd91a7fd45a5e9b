"""Byte-level BPE ids of whole texts by the tokenizers library, with a bounded memory of frequent units.

A space after a character that is not white space always begins a new word of the byte-level
pattern, so a text may be cut there and its parts encoded apart. Parts repeat, and a worker
remembers the latest of them. The vocabulary's added tokens are cut out first: each is one id.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

LIMIT = 600_000
_CUT, _PLAIN = re.compile(r"(?<=\S) "), re.compile(r"\s ")
_ENDED = re.compile(r"([^\W\d_]+)([^\w\s].*)?", re.DOTALL)


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Units(dict):
    """Unit -> its ids as little-endian unsigned 32-bit integers; ``older`` holds what was used before."""

    def __init__(self, tokenizer, lead: str, older: Units | None = None):
        super().__init__()
        self.tokenizer, self.lead, self.older = tokenizer, lead, older
        self.model, self.table = tokenizer.model, byte_characters()
        if older is not None:
            older.older = None

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, text: str) -> bytes:
        """Of letters after at most one space: one word of the pattern, so the model alone does it."""
        return array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.table))]).tobytes()

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit) if self.older is not None else None
        if found is None:
            # letters end where a mark begins, so a word and the marks after it are encoded apart
            parts = _ENDED.fullmatch(unit)
            if parts and parts[2]:
                found = self[parts[1]] + self.tail(parts[2])
            else:
                found = self.word(self.lead + unit) if unit.isalpha() else self.ids(self.lead + unit)
        if len(unit) < 64:
            self[unit] = found
        return found

    @lru_cache(maxsize=20_000)  # noqa: B019  the encoder lives as long as its worker
    def tail(self, marks: str) -> bytes:
        return self.ids(marks)

    __hash__ = object.__hash__


class Encoder:
    """Remembers two generations of up to ``LIMIT`` units; when the newer is full it becomes the older."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the unit of parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokens = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}
        self.added = {text: array("I", [k]).tobytes() for text, k in tokens.items()}
        self.cut = re.compile(f"({'|'.join(map(re.escape, sorted(tokens, key=len, reverse=True)))})") if tokens else None
        tokenizer.encode_special_tokens = True  # no unit holds one of them any more
        self.first, self.rest = Units(tokenizer, ""), Units(tokenizer, " ")

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            return b"".join(self.added[part] if k % 2 else self(part) for k, part in enumerate(self.cut.split(text)))
        if len(self.rest) > LIMIT:
            self.rest = Units(self.rest.tokenizer, " ", self.rest)
        if len(self.first) > LIMIT // 10:
            self.first = Units(self.first.tokenizer, "")
        units = _CUT.split(text) if _PLAIN.search(text) else text.split(" ")
        return self.first[units[0]] + b"".join(map(self.rest.__getitem__, units[1:]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary file."""
    return Encoder(path)
