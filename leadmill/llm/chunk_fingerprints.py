"""Document fingerprints by content-defined chunking.

A gear hash rolls over the bytes: h = (h << 1) + G[byte] modulo 2 ** 32, so it depends on the last 32 bytes only. Chunks end
where its upper bits are 0, with normalised sizes: two bits more are asked for below NORMAL bytes and two fewer above, none
below LEAST, and a chunk ends at MOST at the latest. An insertion moves only the chunks around it. A fingerprint is the set
of chunk digests with the chunks' lengths; likeness is containment weighted by length: the share of a text's distinct chunks,
in bytes, that the other text has too.

`fingerprint_pairs` also compares each text with the next one by descending id. Texts go through one shuffle, dealt into
batches by ranges of their order; the first row of each batch is sent to the batch before it as well, since it follows its last row.

Cases: a null or empty text has the empty fingerprint; two empty ones are alike by 1, an empty and another one by 0. A very long text is
chunked as a whole, and a batch's texts SLICE bytes at a time. Rows with the same id follow each other by descending hash of their texts, then by
text; so do rows without an id, which come after all others. Such rows are dealt over batches like any others, but for rows equal in
both id and text. Repeated rows give repeated rows. One row alone is its own next. Columns of the input may have any names: only id and text are read. An empty
table gives no row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import parts, text_volume, whole_text
from leadmill.llm.dealing import cuts, order_hash, text_keys

LEAST, NORMAL, MOST, BITS = 32, 128, 512, 7
BATCH, SLICE = 8 << 20, 1 << 20
#: Batches: at least so many, for their number in parallel, and at most, so that their first rows' keys stay small (16 bytes each).
LEAST_PARTS, MOST_PARTS = 32, 1 << 20
_GEAR = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, 256, dtype=np.uint32)
_EASY = np.uint32(((1 << (BITS - 2)) - 1) << (32 - BITS + 2))
_HARD = np.uint32(((1 << (BITS + 2)) - 1) << (32 - BITS - 2))


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the span that it covers."""
    h = _GEAR[data]
    span = 1
    while span < 32:
        more = h[:-span] << np.uint32(span)
        h[span:] += more
        span *= 2
    return h


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """Where the chunks of each text end."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gear(data)
    easy = np.flatnonzero((h & _EASY) == 0) + 1
    hard = easy[(h[easy - 1] & _HARD) == 0].tolist()
    easy = easy.tolist()
    out, at = [], 0
    for t in texts:
        end, own, start = at + len(t), [], at
        while start < end:
            stop = min(end, start + MOST)
            k = bisect_left(hard, start + LEAST)
            if k < len(hard) and hard[k] < start + NORMAL:
                stop = min(stop, hard[k])
            else:
                k = bisect_left(easy, start + NORMAL)
                if k < len(easy):
                    stop = min(stop, easy[k])
            own.append(stop - at)
            start = stop
        out.append(own)
        at = end
    return out


def fingerprints(texts: list[bytes]) -> list[dict[int, int]]:
    """For each text: chunk digest to length. Chunks are found for about SLICE bytes at a time."""
    import xxhash

    digest, out, at = xxhash.xxh3_64_intdigest, [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        for t, ends in zip(texts[at:to], chunk_ends(texts[at:to]), strict=True):
            out.append({digest(t[a:b]): b - a for a, b in zip([0, *ends], ends, strict=False)})
        at = to
    return out


def contained(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's distinct chunks, weighted by length, that b has too."""
    if not a:
        return float(not b)
    return sum(n for k, n in a.items() if k in b) / sum(a.values())


def written(print_: dict[int, int]) -> str:
    """digest:length of each chunk by digest, joined by spaces."""
    return " ".join([f"{k:016x}:{n}" for k, n in sorted(print_.items())])


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many of the first code points of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row per row."""
    volume = text_volume(docs, text_col)[1]
    n = min(parts(volume, BATCH, LEAST_PARTS), MOST_PARTS)
    cut = cuts(text_keys(docs, id_col, text_col), n, max(1, volume // n))
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), order_hash(text_col).alias("h"), whole_text(text_col).alias("t"))
    rows = base.withColumn("batch", cut.batch(F.col("doc_id"), F.col("h")))
    # One key a batch, its first row's, and the batch before it in descending order; the very first follows the very last.
    heads = rows.groupBy("batch").agg(F.max(F.struct("doc_id", "h")).alias("m")).select("batch", F.coalesce("m.doc_id", F.lit(0)).alias("i"), "m.h").toArrow()
    at, size = heads.column("batch").to_numpy(), cut.n
    order = at[np.argsort(np.where(at < cut.first_null, -at, size - at), kind="stable")]
    head_id, head_h, before = (np.zeros(size, np.int64) for _ in range(3))
    head_id[at], head_h[at], before[order] = heads.column("i").to_numpy(), heads.column("h").to_numpy(), np.roll(order, 1)

    @F.pandas_udf("int")
    def sent(batch, id_, h):
        import pandas as pd

        b = batch.to_numpy()
        first = (head_id[b] == id_.fillna(0).to_numpy().astype(np.int64)) & (head_h[b] == h.to_numpy())
        return pd.Series(np.where(first, before[b], -1).astype(np.int32))

    own = F.struct("batch", F.lit(False).alias("halo"))
    both = F.array(own, F.struct(F.col("to").alias("batch"), F.lit(True).alias("halo")))
    dealt = rows.withColumn("to", sent("batch", "doc_id", "h")).select("doc_id", "h", "t", F.explode(F.when(F.col("to") >= 0, both).otherwise(F.array(own))).alias("at")).select("doc_id", "h", "t", "at.batch", "at.halo")

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("halo", "ascending"), ("doc_id", "descending"), ("h", "descending"), ("t", "ascending")]))
        count = pc.sum(pc.invert(table.column("halo"))).as_py() or 0
        texts = table.column("t").slice(0, count + 1).to_pylist()  # of the rows sent here the first in order
        columns: list[list] = [[] for _ in range(6)]
        at = 0
        while at < count:
            to_, size = at, 0
            while to_ < count and (to_ == at or size + len(texts[to_]) <= SLICE):
                size += len(texts[to_])
                to_ += 1
            own, after = texts[at:to_], texts[at + 1 : to_ + 1]
            new = [edited(t, f) for t, f in zip(own, after, strict=True)]
            prints = fingerprints([t.encode() for t in texts[at : to_ + 1]])
            changed = fingerprints([t.encode() for t in new])
            for k, t in enumerate(own):
                for column, value in zip(
                    columns,
                    (len(t), hashlib.sha256(new[k].encode()).hexdigest(), written(prints[k]), written(changed[k]), contained(prints[k], changed[k]), contained(prints[k], prints[k + 1])),
                    strict=True,
                ):
                    column.append(value)
            at = to_
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        return pa.table({"doc_id": table.column("doc_id").slice(0, count), **{k: pa.array(c, t) for k, c, t in zip(names, columns, kinds, strict=True)}})

    return dealt.groupBy("batch").applyInArrow(run, _OUT)
