"""Rows dealt into batches by ranges of their order, so that the order of batches is the order of rows.

The order is: id (nulls last), hash of the text. So rows that share one id, or have none, are dealt over many batches like any others; only
rows equal in both can't be parted. Cuts are found by Spark's range partitioning: each partition, sorted, cuts itself at every `each`
bytes of text. The driver gets two numbers per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import parts

#: Batches that a partition of the keys' sort cuts, about.
_CUTS = 32


def order_hash(text_col: str) -> Column:
    """The second part of the order: a hash of the text."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


class Cuts:
    """Where batches begin, in order: ids with hashes, and hashes of rows without an id."""

    def __init__(self, found: list[tuple[int | None, int]]):
        known = sorted(x for x in found if x[0] is not None)[1:]
        self.id, self.h = (np.array([x[k] for x in known], np.int64) for k in (0, 1))
        self.null = np.array(sorted(h for i, h in found if i is None)[1:], np.int64)
        self.n = len(found) or 1
        self.first_null = len(known) + any(i is not None for i, _ in found)

    def place(self, ids: np.ndarray, known: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.id, ids, "left"), np.searchsorted(self.id, ids, "right")
        out = low.copy()
        for a in np.unique(low[(low < high) & known]).tolist():  # ids that stand at a cut
            own = (low == a) & (low < high) & known
            out[own] += np.searchsorted(self.h[a : int(high[own][0])], h[own], "right")
        out[~known] = self.first_null + np.searchsorted(self.null, h[~known], "right")
        return out.astype(np.int32)

    def batch(self, id_: Column, h: Column) -> Column:
        """The number of a row's batch, from 0 on."""

        @F.pandas_udf("int")
        def place(ids, hashes):
            import pandas as pd

            known = ids.notna().to_numpy()
            return pd.Series(self.place(ids.fillna(0).to_numpy().astype(np.int64), known, hashes.to_numpy().astype(np.int64)))

        return place(id_, h)


def text_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows' keys for `cuts`: id, h and n, the bytes of the text."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), order_hash(text_col).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n"))


def cuts(key: DataFrame, batches: int, each: int) -> Cuts:
    """Cuts of rows with keys id, h and size n into about `batches` batches of about the size `each`."""
    ranged = key.repartitionByRange(parts(batches, _CUTS), F.col("id").asc_nulls_last(), "h").sortWithinPartitions(F.col("id").asc_nulls_last(), "h")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = each, None  # a partition's first row is a cut, and so is its first one without an id
        for b in rows:
            ids, hashes, sizes = (b.column(k).to_pylist() for k in range(3))
            found = []
            for i, h, n in zip(ids, hashes, sizes, strict=True):
                if held >= each and (i, h) != last or i is None and last is not None and last[0] is not None:
                    found.append((i, h))
                    held = 0
                held, last = held + n, (i, h)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([h for _, h in found], pa.int64())], ["id", "h"])

    return Cuts(list({(r["id"], r["h"]) for r in ranged.mapInArrow(run, "id long, h long").collect()}))
