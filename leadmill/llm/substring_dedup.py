"""Substring dedup by fixed-block anchors: words of windows that occur earlier are removed.

Texts are dealt once into batches by ranges of their order, so that an earlier batch holds earlier texts; that exchange serves all three
passes. Hashes leave a batch as sorted distinct arrays, one packed row for each batch and hash range, so a passage that a third of
all texts share costs one entry a batch.

1. Index and probes. A text's non-overlapping blocks of `block` words are its entries in the index, and nothing else is. Every rolling window
   of `block` words is a probe. Per hash range each probe learns whether an earlier block has its words (a hit), and each block
   whether a later probe hit it (it's live). A window of `window` >= 2 * block - 1 words holds a whole block of its text, so each
   repeat of that length hits a block of its first occurrence, whatever the shift between the two.
2. Extension. Each hit, and each live block on the side of the reference, is extended to both sides, in all the ways in which it can lie within
   `window` words. Extensions are compared by 96-bit hashes, sent the same way: one that an earlier batch has too comes back
   marked. Linear in the hits: no pair of a hot block's texts is made. It's exact but for collisions of 96 bits (about
   1e-4 are to be expected in 100 TB of text); the hashes of step 1, 32 bits within a range, only choose what is extended.
3. Removal. Marked extensions, and those that came earlier in their own batch, follow each other along a maximal exact repeat; its
   words go.

Batches and hash ranges grow with the square root of the input once packed rows would get less than FILL hashes on average: the number
of rows, at most words * words / (batch * range), stays proportional to the words. See README.md for the sizes.

Cases: null and empty texts have no words. Texts shorter than a window stay. A very long text is a batch of its own, hashed PIECE bytes at
a time. Null ids come last; rows with the same id, or none, count in the order of their texts' hashes, then their texts, and a
repeated row is a repeat of the first (rows equal in id and text are the only ones that can't be parted over batches). An empty table
gives an empty result. Other columns of the input come back in the struct `row`, whatever their names are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill.llm.common import as_bytes, parts, text_volume
from leadmill.llm.dealing import cuts, order_hash, text_keys

WINDOW, BLOCK = 20, 10
#: Bytes of text in a batch, and in a piece that is hashed at once; both bound a task's memory. A batch is at least a text.
BATCH, PIECE = 8 << 20, 1 << 20
#: Hashes in a hash range, about; and the least number in a packed row, on average.
RANGE, FILL = 1 << 21, 256
#: Bytes of a word with its separator, about.
WORD = 6
LEAST_PARTS = 32
LONG_WORD = 64

_BITS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 1024, dtype=np.uint64)
_BYTE = (_BITS[:256] << np.uint64(1) | np.uint64(1), _BITS[256:512] << np.uint64(1) | np.uint64(1))
_WORD_BYTE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_P = tuple(int(x) | 1 for x in _BITS[512:514])
_Q = tuple(int(x) | 1 for x in _BITS[514:516])
_ALL = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** k and base ** -k modulo 2 ** 64, for k < n."""
    made = []
    for b in (base, pow(base, -1, 1 << 64)):
        out = np.ones(n, np.uint64)
        size = 1
        while size < n:
            more = min(size, n - size)
            out[size : size + more] = out[:more] * np.uint64(pow(b, size, 1 << 64))
            size += more
        made.append(out)
    return made[0], made[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    total = np.r_[0, np.cumsum(lengths)]
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PIECE, "right")) - 1)
        yield at, to
        at = to


class Words:
    """Hashes of all words of a batch of texts (two independent ones), and the first word of each text."""

    def __init__(self, texts: pa.Array, hashes: int = 2):
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        per_text, per_hash = [np.zeros(1, np.int64)], [[] for _ in range(hashes)]
        for a, b in _pieces(np.diff(offsets)):
            piece, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            count, made = self._piece(piece, bounds, hashes)
            per_text.append(count)
            for out, h in zip(per_hash, made, strict=True):
                out.append(h)
        self.first = np.cumsum(np.concatenate(per_text))
        self.hashes = [np.concatenate(h) if h else np.empty(0, np.uint64) for h in per_hash]

    @staticmethod
    def _piece(data: np.ndarray, bounds: np.ndarray, hashes: int) -> tuple[np.ndarray, list[np.ndarray]]:
        n = len(data)
        word = _WORD_BYTE[data]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        before = np.r_[False, word[:-1]] if n else word.copy()
        before[inner] = False
        after = np.r_[word[1:], False] if n else word.copy()
        after[inner - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        made = []
        for k in range(hashes):
            power, inverse = _powers(_P[k], max(PIECE, 1 << max(0, n - 1).bit_length()))
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[k][data] * power[:n], out=total[1:])
            made.append(_mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)))
        for i in np.flatnonzero(end - start > LONG_WORD):  # polynomials modulo 2 ** 64 are safe for short words only
            digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
            for k in range(hashes):
                made[k][i] = int.from_bytes(digest[8 * k : 8 * k + 8], "little")
        return np.diff(np.searchsorted(start, bounds)), made

    def room(self, n: int) -> np.ndarray:
        """Where a window of n words fits into its text."""
        size = np.diff(self.first)
        left = np.repeat(self.first[1:], size) - np.arange(int(self.first[-1]))
        return left >= n

    def grams(self, n: int, k: int) -> np.ndarray:
        """A hash of the n words from each position on (nonsense where they don't fit)."""
        h, q, have, out, done = self.hashes[k], _Q[k], 1, None, 0
        while True:
            if n & have:
                out = h.copy() if out is None else _add(out, h, done, pow(q, done, 1 << 64))
                done += have
            if have * 2 > n:
                return _mix(out)
            h = _add(h, h, have, pow(q, have, 1 << 64))
            have *= 2


def _add(a: np.ndarray, b: np.ndarray, shift: int, factor: int) -> np.ndarray:
    out = a.copy()
    if shift < len(b):
        out[: len(b) - shift] += b[shift:] * np.uint64(factor)
    return out


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x, bitorder="little").tobytes()


def _unbits(x: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little").view(bool)


class _Batch:
    """A batch's rolling windows of a block's length, and what they learn from the index."""

    def __init__(self, texts: pa.Array, window: int, block: int, range_bits: int):
        self.words, self.window, self.block = Words(texts), window, block
        self.fits = np.flatnonzero(self.words.room(block))
        size = np.diff(self.words.first)
        self.anchor = (self.fits - np.repeat(self.words.first[:-1], size)[self.fits]) % block == 0
        h = self.words.grams(block, 0)[self.fits] >> np.uint64(32 - range_bits)  # the range, and 32 bits within it
        self.order = np.argsort(h, kind="stable")
        self.h = h[self.order]
        self.new = np.r_[True, self.h[1:] != self.h[:-1]] if len(h) else np.empty(0, bool)
        self.head = np.flatnonzero(self.new)
        self.key = self.h[self.head]

    def indexed(self) -> np.ndarray:
        """Of each distinct hash whether a block has it."""
        return np.logical_or.reduceat(self.anchor[self.order], self.head) if len(self.head) else np.empty(0, bool)

    def extensions(self, answers: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
        """Where windows start that hold a hit or a live block."""
        hit, live = np.zeros(len(self.key), bool), np.zeros(len(self.key), bool)
        for r, a, b in _runs((self.key >> np.uint64(32)).astype(np.int64)):
            hit[a:b], live[a:b] = (_unbits(x, b - a) for x in answers[r])
        group = np.cumsum(self.new) - 1
        anchor = self.anchor[self.order]
        at = np.arange(len(group))
        first = np.minimum.reduceat(np.where(anchor, at, len(at)), self.head) if len(self.head) else at
        last = np.r_[self.head[1:], len(at)] - 1
        on = hit[group] | (at > first[group]) | anchor & (live[group] | (at < last[group]))
        n, span = int(self.words.first[-1]), self.window - self.block + 1
        total = np.zeros(n + 1, np.int64)
        total[self.fits[self.order[on]] + 1] = 1
        total = np.cumsum(total)
        where = np.flatnonzero(self.words.room(self.window))
        return where[total[where + span] > total[where]]

    def exact(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of windows in order (64 and 32 bits), and for each window its place among them."""
        a, b = self.words.grams(self.window, 0)[where], (self.words.grams(self.window, 1)[where] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
        place = np.empty(len(a), np.int64)
        place[order] = np.cumsum(new) - 1
        return a[new], b[new], place


def _runs(area: np.ndarray) -> list[tuple[int, int, int]]:
    head = np.flatnonzero(np.r_[True, area[1:] != area[:-1]]) if len(area) else np.empty(0, np.int64)
    return list(zip(area[head].tolist(), head.tolist(), np.r_[head[1:], len(area)].tolist(), strict=True)) if len(area) else []


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _in_order(table: pa.Table) -> pa.Table:
    """By id, nulls last, then by the text's hash, then by text."""
    keys = ["__id", "__h", "__text"]
    return table.take(pc.sort_indices(table.select(keys), sort_keys=[(k, "ascending") for k in keys]))


_PROBES = "area int, batch int, n int, low binary, anchor binary"
_EXACT = "area int, batch int, n int, a binary, b binary"
_ANSWER = "batch int, step int, area int, x binary, y binary"


def sizes(volume: int) -> tuple[int, int]:
    """Bytes of a batch and hashes of a range for so many bytes of text."""
    growth = max(1.0, math.sqrt(FILL * (volume / WORD) / (BATCH / WORD * RANGE)))
    return int(BATCH * growth), int(RANGE * growth)


def batches(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """`docs` as (row, __id, __h, __text, __batch), batches in the order of rows; and the bits of the number of hash ranges."""
    volume = text_volume(docs, text_col)[1]
    batch, area = sizes(volume)
    n = parts(volume, batch, LEAST_PARTS)
    cut = cuts(text_keys(docs, id_col, text_col), n, max(1, volume // n))
    range_bits = max(5, (parts(volume // WORD, area) - 1).bit_length())
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("__id"), order_hash(text_col).alias("__h"), as_bytes(text_col).alias("__text")
    )
    return packed.withColumn("__batch", cut.batch(F.col("__id"), F.col("__h"))), range_bits


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK, texts: bool = False) -> DataFrame:
    """row, n_words, n_removed, kept_sha256, and with `texts` kept: the text without the removed words.

    row: a struct of the input's columns but its text. kept is the text itself where nothing is removed; else each removed
    word goes with the separators after it.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    dealt, range_bits = batches(docs, id_col, text_col)
    row_type = dealt.schema["row"].dataType

    def split(key: np.ndarray, head: int) -> list[tuple[int, int, int]]:
        return _runs((key >> np.uint64(head)).astype(np.int64))

    def probe(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        batch, made = table.column("__batch")[0].as_py(), _Batch(_one(table, "__text"), window, block, range_bits)
        indexed = made.indexed()
        rows = [{"area": r, "batch": batch, "n": b - a, "low": made.key[a:b].astype(np.uint32).tobytes(), "anchor": _bits(indexed[a:b])} for r, a, b in split(made.key, 32)]
        return pa.Table.from_pylist(rows, pa.schema([("area", pa.int32()), ("batch", pa.int32()), ("n", pa.int32()), ("low", pa.binary()), ("anchor", pa.binary())]))

    answer = pa.schema([("batch", pa.int32()), ("step", pa.int32()), ("area", pa.int32()), ("x", pa.binary()), ("y", pa.binary())])

    def match(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
        low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
        anchor = np.concatenate([_unbits(r["anchor"], r["n"]) for r in rows])
        order = np.argsort(low, kind="stable")  # equal hashes in the order of their batches, one of each
        low, anchor, at = low[order], anchor[order], np.arange(len(order))
        head = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
        size = np.diff(np.r_[head, len(low)])
        first = np.repeat(np.minimum.reduceat(np.where(anchor, at, len(at)), head), size)
        last = np.repeat(head + size - 1, size)
        hit, live = np.zeros(len(at), bool), np.zeros(len(at), bool)
        hit[order], live[order] = at > first, anchor & (at < last)
        out, done = [], 0
        for r in rows:
            a, b = done, done + r["n"]
            out.append({"batch": r["batch"], "step": 1, "area": r["area"], "x": _bits(hit[a:b]), "y": _bits(live[a:b])})
            done = b
        return pa.Table.from_pylist(out, answer)

    def read(answers: pa.Table, step: int) -> dict[int, tuple[bytes, bytes]]:
        return {r["area"]: (r["x"], r["y"]) for r in answers.to_pylist() if r["step"] == step}

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("area", pa.int32()), ("batch", pa.int32()), ("n", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
        if not table.num_rows:
            return pa.Table.from_pylist([], schema)
        table = _in_order(table)
        batch, made = table.column("__batch")[0].as_py(), _Batch(_one(table, "__text"), window, block, range_bits)
        a, b, _ = made.exact(made.extensions(read(answers, 1)))
        rows = [{"area": r, "batch": batch, "n": y - x, "a": a[x:y].tobytes(), "b": b[x:y].tobytes()} for r, x, y in split(a, 64 - range_bits)]
        return pa.Table.from_pylist(rows, schema)

    def earliest(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
        a = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
        b = np.concatenate([np.frombuffer(r["b"], np.uint32) for r in rows])
        order = np.lexsort((b, a))  # stable: batches stay in order
        x, y = a[order], b[order]
        later = np.zeros(len(a), bool)
        later[order[1:]] = (x[1:] == x[:-1]) & (y[1:] == y[:-1])
        out, done = [], 0
        for r in rows:
            out.append({"batch": r["batch"], "step": 2, "area": r["area"], "x": _bits(later[done : done + r["n"]]), "y": b""})
            done += r["n"]
        return pa.Table.from_pylist(out, answer)

    fields = [*([T.StructField("kept", T.BinaryType())] if texts else []), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            empty = {"kept": pa.array([], pa.binary()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())}
            return pa.table({"row": _one(table, "row"), **{f.name: empty[f.name] for f in fields}})
        table = _in_order(table)
        text = _one(table, "__text")
        made = _Batch(text, window, block, range_bits)
        bounds, where = made.words.first, made.extensions(read(answers, 1))
        a, _, place = made.exact(where)
        earlier, back = np.zeros(len(a), bool), read(answers, 2)
        for r, x, y in split(a, 64 - range_bits):
            earlier[x:y] = _unbits(back[r][0], y - x)
        first = np.full(len(a), len(where), np.int64)
        np.minimum.at(first, place, np.arange(len(where)))
        gone = where[earlier[place] | (first[place] < np.arange(len(where)))]
        n = int(bounds[-1])
        change = np.zeros(n + 1, np.int64)
        change[gone] += 1
        change[gone + window] -= 1
        keep = np.cumsum(change[:n]) == 0
        n_words = np.diff(bounds)
        n_removed = n_words - np.diff(np.r_[0, np.cumsum(keep)][bounds])
        kept, digests = [], []
        for i, t in enumerate(text):
            t = t.as_py()
            words = t.split()
            if n_removed[i]:
                stay = keep[bounds[i] : bounds[i + 1]].tolist()
                if texts:
                    t = _cut(t, words, stay)
                words = compress(words, stay)
            kept.append(t)
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        out = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        if texts:
            out = {"kept": pa.array(kept, pa.binary())} | out
        return pa.table({"row": _one(table, "row"), **out})

    by_batch = dealt.groupBy("__batch")
    one = by_batch.applyInArrow(probe, _PROBES).groupBy("area").applyInArrow(match, _ANSWER)
    two = by_batch.cogroup(one.groupBy("batch")).applyInArrow(extend, _EXACT).groupBy("area").applyInArrow(earliest, _ANSWER)
    out = by_batch.cogroup(one.union(two).groupBy("batch")).applyInArrow(remove, T.StructType([T.StructField("row", row_type), *fields]))
    return out.withColumn("kept", F.col("kept").cast("string")) if texts else out


def _cut(text: bytes, words: list[bytes], keep: list[bool]) -> bytes:
    """The text without the words that aren't kept, and without the separators after them."""
    out, at = [], 0
    ends = []
    for w in words:
        at = text.index(w, at)
        ends.append((at, at + len(w)))
        at += len(w)
    starts = [a for a, _ in ends] + [len(text)]
    if keep and starts[0]:
        out.append(text[: starts[0]])
    out.extend(text[starts[i] : starts[i + 1]] for i, k in enumerate(keep) if k)
    return b"".join(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, length_col: str | None = None) -> DataFrame:
    """`docs` without the repeated words; length_col, if named, gets the new text's characters where the text changed."""
    out = repeats(docs, id_col, text_col, window, texts=True)
    changed = {text_col: F.col("kept")}
    if length_col:
        changed[length_col] = F.when(F.col("n_removed") > 0, F.char_length("kept").cast(docs.schema[length_col].dataType)).otherwise(F.col("row")[length_col])
    return out.select(*[(changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])
