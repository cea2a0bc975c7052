"""Token counts by a word-end BPE vocabulary, by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a slice of text stand one after another in one array of symbols. A round looks at the lowest rank
among each sequence's neighbouring pairs and applies that pair, in all sequences at once, wherever it stands (from the left,
without overlaps); sequences without a pair are done, and their surviving symbols are counted. That gives what merging one
pair at a time gives, since every merge that takes a symbol has a higher rank than the merge that makes it; `Counter` checks
this of the vocabulary.

Texts are read in one narrow pass without a shuffle; a worker counts each distinct piece of text once while it remembers it.

Cases: a null or empty text has 0 tokens, as has one of white space. A special token's string inside a text is one token, as
the library takes it. Texts and words of any length are counted whole; equal pairs of a sequence merge from the left. Null or equal ids make no
difference, repeated rows give repeated rows, and only id and text are read, whatever other columns are called. An empty table gives none.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import whole_text
from leadmill.llm.pieces import FIRST, Memo, cut, slices

_NONE = np.int64(1) << 60
#: Bytes of pre-tokens that are merged at once.
ROUND = 1 << 18


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Counter:
    """Counts of tokens by a vocabulary file of the library `tokenizers` with a byte-level BPE model and word ends."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        ids, end, merges = model["vocab"], model["end_of_word_suffix"] or "", model["merges"]
        splitter = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        white = lambda s: s.replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(white(splitter["pattern"]["Regex"])).findall
        kinds = [n["type"] for n in file["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or splitter["behavior"] != "Removed" or not splitter["invert"]:
            raise ValueError("another kind of normaliser or pre-tokeniser")
        special = [t["content"] for t in file["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        symbols = _byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + end] for s in symbols], np.int64)
        self.base = max(ids.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        a, b, made = (np.array([ids[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], lambda p: p[0] + p[1]))
        rank_of = np.full(self.base, -1, np.int64)
        rank_of[made] = np.arange(len(made))
        if len(np.unique(made)) != len(made) or (np.maximum(rank_of[a], rank_of[b]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before the one that makes its part; pairs can't be applied simultaneously")
        key = a * self.base + b
        order = np.argsort(key)
        self.key, self.rank, self.made = np.r_[key[order], _NONE], np.r_[order, 0], made

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.rank[at], _NONE)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """How many symbols of each non-empty pre-token survive all merges."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        token, first = self.inner[raw], np.r_[0, np.cumsum(size)[:-1]]
        token[first + size - 1] = self.last[raw[first + size - 1]]
        count = size.copy()
        word = np.arange(len(words))  # of each sequence that is still at work
        rank = self._ranks(token, np.r_[token[1:], 0])
        rank[first + size - 1] = _NONE
        while len(word):
            least = np.minimum.reduceat(rank, first)
            busy = least < _NONE
            if not busy.all():
                keep = np.repeat(busy, size)
                token, rank = token[keep], rank[keep]
                word, size, least = word[busy], size[busy], least[busy]
                first = np.r_[0, np.cumsum(size)[:-1]]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            # In a run of places that overlap, every other one from the left.
            new = np.r_[True, np.diff(at) > 1]
            begin = np.maximum.accumulate(np.where(new, at, 0))
            at = at[(at - begin) % 2 == 0]
            token[at] = self.made[rank[at]]
            alive = np.ones(len(token), bool)
            alive[at + 1] = False
            size = size - np.bincount(np.searchsorted(first, at, "right") - 1, minlength=len(size))
            rank[at] = -2  # to be found again, as is the one before
            before = at[~np.isin(at, first)] - 1
            rank[before] = -2
            token, rank = token[alive], rank[alive]
            first = np.r_[0, np.cumsum(size)[:-1]]
            todo = np.flatnonzero(rank == -2)
            ends = first + size - 1
            rank[todo] = self._ranks(token[todo], token[np.minimum(todo + 1, len(token) - 1)])
            rank[ends] = _NONE
            count[word] = size
        return count

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        total, owner, words = np.zeros(len(texts), np.int64), [], []
        for i, t in enumerate(texts):
            parts = [t]
            if self.special and self.special.search(t):
                parts = self.special.split(t)
                total[i] += len(parts) - 1
            for p in parts:
                found = self.words(_lower(unicodedata.normalize("NFC", p)))
                words += found
                owner += [i] * len(found)
        at = 0
        while at < len(words):
            to, size = at, 0
            part = []
            while to < len(words) and (size < ROUND or to == at):
                part.append(words[to].encode())
                size += len(part[-1])
                to += 1
            np.add.at(total, owner[at:to], self.symbols(part))
            at = to
        return total.tolist()


def _lower(text: str) -> str:
    """Lower case of each character by itself (a final sigma isn't special)."""
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    own = Counter(path)
    # White space never counts, so a first piece is like any other.
    return Memo(lambda pieces: own.count([p.removeprefix(FIRST) for p in pieces]))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path)
        for batch in batches:
            for part, texts in slices(batch, "t"):
                n = np.fromiter((sum(v) for v in memo([cut(t) for t in texts])), np.int64, len(texts))
                size = pc.cast(pc.binary_length(part.column("t")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
