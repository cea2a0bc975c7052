"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

1. One narrow pass turns each text into STATISTICS numbers (no label, language, source or id among them); they're checkpointed,
   a few hundred bytes a text.
2. Rows for learning are those with a label whose crc32 of the id as text, modulo 4, isn't 2: remainders 0 and 1 fit the
   model, 3 the calibration; 2 is held out. Means and deviations of the statistics come from one aggregation.
3. cos(W x + b) with Gaussian W approximates a Gaussian kernel. Each partition of learning rows adds up its part of the normal
   equations; the parts are summed by Spark, and the driver solves one system of FEATURES + 1 unknowns, whatever the corpus.
4. Raw scores of the calibration rows are counted in BINS bins; pooling adjacent violators over these counts gives the
   probability of label 1 as a rising function of the raw score.

Cases: null and empty texts have statistics (zeros) and a score like others. Null labels and null ids aren't learned from; a
null id isn't held out. If there are no rows of both labels to learn from, every score is 0.5. Repeated rows are scored
alike, and count as often as they stand there in learning; of ties in the raw score one bin has all. A very long text is read whole, one
text at a time. Columns may have any names: only ids, texts and labels are read. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import as_bytes, parts, reliable

FEATURES, GAMMA, RIDGE, BINS, CUT = 256, 0.03, 1.0, 400, 0.7
#: Learning rows whose normal equations one partition adds up.
PART_ROWS = 50_000
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "distinct_words", "longest_word", "log_lines", "distinct_lines", "words_per_line",
    "capitals", "lower", "digits", "sentence_ends", "commas", "exclamations", "symbols", "bars_and_slashes", "brackets", "quotes", "controls",
    "high_bytes", "spaces", "short_words", "endings", "entropy",
)
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".?:;", ",", "!", "#*$%&<>@^~_=+", "|/\\", "()[]{}", "'\"`")


def _class_table() -> np.ndarray:
    table = np.zeros((256, len(_CLASSES) + 3))
    for k, chars in enumerate(_CLASSES):
        table[[ord(c) for c in chars], k] = 1
    table[:32, -3] = 1
    table[[9, 10, 13], -3] = 0
    table[128:, -2] = 1
    table[[9, 10, 11, 12, 13, 32], -1] = 1
    return table


_TABLE = _class_table()


def statistics(text: bytes) -> np.ndarray:
    """STATISTICS of one text: sizes on a log scale, shares of kinds of characters, words and lines."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, n_words, n_lines = max(1, len(text)), max(1, len(words)), max(1, len(lines))
    size = np.fromiter(map(len, words), np.int64, len(words))
    share = count[count > 0] / n
    kinds = count @ _TABLE / n
    ends = sum(w[-1] in b".!?" for w in words)
    return np.array([
        np.log1p(len(text)), np.log1p(len(words)), size.sum() / n_words, len(set(words)) / n_words, np.log1p(size.max(initial=0)),
        np.log1p(len(lines)), len(set(lines)) / n_lines, np.log1p(len(words) / n_lines), *kinds, (size <= 3).sum() / n_words, ends / n_words, -(share * np.log(share)).sum(),
    ])


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, x (array of doubles): a row per row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat = pa.array(np.concatenate([statistics(t.as_py()) for t in b.column("t")]))
                x = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(STATISTICS)), flat)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), x], ["doc_id", "x"])

    return rows.mapInArrow(run, "doc_id long, x array<double>")


def remainder(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4))


class Model:
    """Scores of statistics. Small: FEATURES x (STATISTICS + 2) numbers."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11, features: int = FEATURES, gamma: float = GAMMA):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(0, np.sqrt(2 * gamma), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta = np.zeros(features + 1)
        self.low, self.knots, self.levels = -0.5, np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.interp(self.raw(x), self.knots, self.levels), 6)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def pool_adjacent(at: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and levels of the rising step function nearest to ones / n with weights n, each level at its bins' mean place."""
    blocks: list[list[float]] = []
    for p, c, o in zip(at, n, ones, strict=True):
        blocks.append([p * c, c, o])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    place = np.array([b[0] / b[1] for b in blocks])
    return place, np.array([b[2] / b[1] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model | None:
    """A model from the rows of `stats` that `labels` marks, without those held out; None if a label is missing."""
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = stats.join(own, "doc_id").withColumn("r", remainder(F.col("doc_id"))).where("r != 2")
    rows = reliable(rows)
    k = len(STATISTICS)
    cols = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones"), *cols).first()
    if not total["n"] or total["ones"] in (0, total["n"]):
        return None
    scale = np.array([total[f"s{i}"] for i in range(k)])
    model = Model(np.array([total[f"m{i}"] for i in range(k)]), np.where(scale > 1e-9, scale, 1.0))
    size = len(model.beta)
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, seen = np.zeros((size, size)), np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                z, seen = model.lift(_matrix(batch)), True
                a += z.T @ z
                b += z.T @ batch.column("y").to_numpy()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]) + size)), pa.array(np.r_[a[upper], b])], ["k", "v"])

    learn = rows.where("r != 3").select("x", "y").repartition(parts(total["n"], PART_ROWS))
    got = np.array(sorted(learn.mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v")).collect()))
    if not len(got):
        return None
    a, b = np.zeros((size, size)), got[len(upper[0]) :, 1]
    a[upper] = got[: len(upper[0]), 1]
    a = a + a.T - np.diag(a.diagonal())
    model.beta = np.linalg.solve(a + RIDGE * np.diag(np.r_[np.ones(size - 1), 1e-9]), b)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.floor(np.clip(model.raw(_matrix(batch)), -0.5, 1.5) * BINS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], ["bin", "y"])

    counted = rows.where("r = 3").select("x", "y").mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.count(F.lit(1)), F.sum("y")).collect()
    if counted:
        at, n, ones = np.array(sorted(counted), float).T
        place, level = pool_adjacent((at + 0.5) / BINS, n, ones)
        # Levels stay off 0 and 1, and rise a little with the raw score, so that equal levels keep their order.
        model.knots, model.levels = np.r_[-1.0, place, 2.0], 0.01 + 0.97 * np.r_[level[0], level, level[-1]] + 0.02 * (np.r_[-1.0, place, 2.0] + 1) / 3
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of `docs`."""
    stats = reliable(text_statistics(docs, id_col, text_col))
    model = fit(stats, labels, id_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = model.scores(_matrix(b)) if model else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = stats.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
