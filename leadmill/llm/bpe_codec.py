"""Byte-level BPE encoding and decoding by ranks, with a segment tree over byte positions.

A pre-token's leaves are its byte positions; the leaf of a live token holds the rank of its merge with the next live one.
The tree keeps the leftmost minimum at its root. A merge takes the root, joins two live neighbours, and updates three leaves:
its own, that of the token which is gone, and that of the live token before. Each is a logarithmic point update. Short
pre-tokens, nearly all, are encoded many at once: their trees are rows of one array, and a round does one merge in each.

Texts are read in one narrow pass without a shuffle; a worker encodes each distinct piece of text once while it remembers it.

Cases: a null or empty text has no ids. Strings of special tokens are ordinary text. Texts and pre-tokens of any length are
encoded whole; of pairs with equal ranks the leftmost merges first. Null or equal ids make no difference, repeated rows give repeated rows, and
only id and text are read, whatever other columns are called. An empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import whole_text
from leadmill.llm.pieces import Memo, cut, plain, slices

#: Bytes of the longest pre-tokens that are encoded in rows; longer ones have a tree of their own.
ROW = 64
_NONE = np.int64(1) << 60


class Codec:
    """Ranks of byte strings; every single byte has one. Ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks, self.tokens = ranks, {i: t for t, i in ranks.items()}
        self.bytes_ = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # White space as the pattern's \s means it: by the Unicode property.
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.base = max(ranks.values()) + 2
        key = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.merged = np.r_[key[order], _NONE], np.r_[np.array(merged, np.int64)[order], -1]
        self.pair = dict(zip(key.tolist(), merged, strict=True))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of merges of the tokens a and b; -1 where there's none. Token base - 1 stands for no token."""
        key = a * self.base + b
        at = np.searchsorted(self.key, key)
        return np.where(self.key[at] == key, self.merged[at], -1)

    def rows(self, texts: list[bytes], width: int) -> list[list[int]]:
        """Ids of pre-tokens of at most `width` bytes, a power of two up to ROW."""
        n, none = len(texts), self.base - 1
        size = np.fromiter(map(len, texts), np.int64, n)
        raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(n, width)
        place = np.arange(width)
        token = np.full((n, width + 1), none, np.int64)
        token[:, :width] = np.where(place < size[:, None], self.bytes_[raw], none)
        after, before = np.tile(np.minimum(place + 1, width), (n, 1)), np.tile(np.r_[place - 1, width - 1], (n, 1))
        after = np.concatenate([after, np.full((n, 1), width)], axis=1)
        before[:, 0] = width
        after = np.where(after < size[:, None], after, width)
        tree = np.full((n, 2 * width), _NONE)
        rank = self._rank(token[:, :-1], np.take_along_axis(token, after[:, :width], 1))
        tree[:, width:] = np.where(rank >= 0, rank * ROW + place, _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            top = tree[live, 1]
            at, new = top % ROW, top // ROW
            gone = after[live, at]
            nxt, prv = after[live, gone], before[live, at]
            token[live, at], token[live, gone] = new, none
            after[live, at] = nxt
            before[live, nxt] = at
            token[live, width] = none
            mine, theirs = self._rank(new, token[live, nxt]), self._rank(token[live, prv], new)
            tree[live, width + gone] = _NONE
            tree[live, width + at] = np.where(mine >= 0, mine * ROW + at, _NONE)
            has = prv < width
            tree[live[has], width + prv[has]] = np.where(theirs[has] >= 0, theirs[has] * ROW + prv[has], _NONE)
            for leaf in (gone, at, np.where(has, prv, at)):
                node = (width + leaf) // 2
                for _ in range(width.bit_length() - 1):
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
                    node //= 2
            live = live[tree[live, 1] < _NONE]
        keep = token[:, :width] != none
        ids, ends = token[:, :width][keep].tolist(), np.cumsum(keep.sum(axis=1)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def long(self, text: bytes) -> list[int]:
        """Ids of one pre-token of any length."""
        n, pair, base = len(text), self.pair, self.base
        width = 1 << max(0, n - 1).bit_length()
        token = self.bytes_[np.frombuffer(text, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        none = 1 << 62
        tree = [none] * (2 * width)

        def value(i: int) -> int:
            j = after[i]
            r = pair.get(token[i] * base + token[j]) if j < n else None
            return none if r is None else r << 32 | i

        tree[width : width + n] = [value(i) for i in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, v: int) -> None:
            k = width + i
            tree[k] = v
            k >>= 1
            while k:
                tree[k] = min(tree[2 * k], tree[2 * k + 1])
                k >>= 1

        alive = [True] * n
        while tree[1] < none:
            i, token_ = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            j = after[i]
            token[i], after[i], alive[j] = token_, after[j], False
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, value(i))
            if before[i] >= 0:
                put(before[i], value(before[i]))
        return [t for t, a in zip(token, alive, strict=True) if a]

    def words(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of each pre-token."""
        out: list[list[int]] = [[]] * len(texts)
        by_width: dict[int, list[int]] = {}
        for i, t in enumerate(texts):
            if len(t) > ROW:
                out[i] = self.long(t)
            elif t:
                by_width.setdefault(max(2, 1 << (len(t) - 1).bit_length()), []).append(i)
        for width, own in by_width.items():
            for k in range(0, len(own), 8192):
                part = own[k : k + 8192]
                for i, ids in zip(part, self.rows([texts[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts."""
        pre = [[m.encode() for m in self.split(t)] for t in texts]
        distinct = list(dict.fromkeys(w for p in pre for w in p))
        ids = dict(zip(distinct, self.words(distinct), strict=True))
        return [[i for w in p for i in ids[w]] for p in pre]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


@lru_cache(maxsize=2)
def _memo(path: str, pattern: str) -> Memo:
    """Of each piece: its ids in decimal, each with a comma behind it, and the bytes that they decode to."""
    own = codec(path, pattern)

    def compute(pieces: list[str]) -> list[tuple[bytes, bytes]]:
        return [("".join(f"{i}," for i in ids).encode(), own.decode(ids)) for ids in own.encode([plain(p) for p in pieces])]

    return Memo(compute)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: a row per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part, texts in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own.encode(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded (bytes): a row per row; null ids are none."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            out = [own.decode(x.as_py()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return rows.mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what `encode_texts` and `decode_ids` give, in one pass."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _memo(path, pattern)
        for batch in batches:
            for part, texts in slices(batch, "t"):
                out: tuple[list, list, list] = ([], [], [])
                for values in memo([cut(t) for t in texts]):
                    ids = b"".join([v[0] for v in values])
                    out[0].append(ids.count(b","))
                    out[1].append(hashlib.sha256(ids[:-1]).hexdigest())
                    out[2].append(hashlib.sha256(b"".join([v[1] for v in values])).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
