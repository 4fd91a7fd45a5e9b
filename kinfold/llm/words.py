"""Words and word shingles of a text."""

from __future__ import annotations


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    if size == 1:
        return words
    return list(map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False)))
