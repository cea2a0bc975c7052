"""Texts cut into pieces that tokenizers handle independently, and values of pieces that a worker computes only once.

The cut is at a space that follows a character which isn't white space. The patterns used here never match across such a
place, so a text's tokens are those of its pieces, one after another.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc

#: Marks a text's first piece, which has no space before it; no valid text holds it.
FIRST = "\ud800"
_BEFORE = [c + " " for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
_BEFORE_ASCII = [c for c in _BEFORE if c.isascii()]
#: Text that is handled at once, pieces that a worker remembers, and the longest of them: these bound its memory.
SLICE, MOST, LONGEST = 1 << 20, 400_000, 64


def cut(text: str) -> list[str]:
    """The pieces of a text: the first with FIRST before it, the others without the space before them."""
    parts = text.split(" ")
    if any(c in text for c in (_BEFORE_ASCII if text.isascii() else _BEFORE)):
        glued, open_ = [parts[0]], not parts[0] or parts[0][-1].isspace()
        for i, p in enumerate(parts[1:], 1):
            if open_ and (i > 1 or parts[0]):
                glued[-1] += " " + p
            else:
                glued.append(p)
            open_ = not p or p[-1].isspace()
        parts = glued
    parts[0] = FIRST + parts[0]
    return parts


def plain(piece: str) -> str:
    """The characters that a piece stands for."""
    return piece[1:] if piece[:1] == FIRST else " " + piece


class Memo:
    """Values of pieces; `compute` gets a list of pieces and gives a list of values, none of them None."""

    def __init__(self, compute: Callable[[list[str]], list[Any]], most: int = MOST):
        self.compute, self.most, self.known = compute, most, {}

    def __call__(self, texts: list[list[str]]) -> list[list[Any]]:
        if len(self.known) > self.most:
            self.known.clear()
        get = self.known.get
        found = [list(map(get, p)) for p in texts]
        lacking = [k for k, f in enumerate(found) if None in f]
        if lacking:
            new = list(dict.fromkeys(chain.from_iterable((x for x, v in zip(texts[k], found[k], strict=True) if v is None) for k in lacking)))
            values = dict(zip(new, self.compute(new), strict=True))
            for k in lacking:
                found[k] = [values[x] if v is None else v for x, v in zip(texts[k], found[k], strict=True)]
            self.known.update((x, v) for x, v in values.items() if len(x) <= LONGEST)
        return found


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of a batch's rows of about `most` bytes of text, or one longer text."""
    sizes = [0 if x is None else x for x in pc.binary_length(batch.column(text_col)).to_pylist()]
    at = size = 0
    for i, n in enumerate([*sizes, most]):
        if i > at and (size + n > most or i == len(sizes)):
            part = batch.slice(at, i - at)
            yield part, [t or "" for t in part.column(text_col).to_pylist()]
            at, size = i, 0
        size += n
