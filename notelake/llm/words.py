"""Words of lower-cased ASCII letters, digits and all non-ASCII characters, found in UTF-8 bytes a stretch at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
STRETCH = 1 << 20


def stretches(text: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """``text`` cut between words into pieces of about ``size`` bytes, so a very long text takes no more memory than
    a piece and its words need."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + size) if at + size < len(text) else None
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end


def words(text: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of ``text``, in order, a list a stretch; A-Z alone is lower-cased."""
    for piece in stretches(text, size):
        yield WORD.findall(piece.lower())
