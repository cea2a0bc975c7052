"""SimHash near-duplicates: fingerprints, exact search within a radius by bit-sliced comparison, components.

1. Each text's 64-bit fingerprint is made in one narrow pass (no shuffle of texts).
2. Only distinct fingerprints are compared. Two that differ in at most `radius` bits agree on at least blocks - radius of
   `blocks` bit ranges, so each goes into one bucket for every such choice of ranges: no link is lost, whatever `blocks` is. More blocks mean
   more and smaller buckets; unless told otherwise their number follows from that of the fingerprints.
3. A bucket larger than CHUNK is cut into chunks, and every pair of chunks is a unit of its own, so that no task gets an
   unbounded group. A unit stores its fingerprints as vertical bit planes, 64 fingerprints to a machine word; distances are
   counted for 64 at a time by carry-save counters, and a block is given up once all its distances exceed the radius.
4. A unit gives back one edge per fingerprint (to the least one that it reaches there), and components are found by
   alternating large-star and small-star steps, each checkpointed in the shared folder. Joins on buckets and on nodes are salted, so a hot
   bucket or a star's hub is SALTS keys.

Cases: null and empty texts have fingerprint zero and link like any other. A very long text is hashed whole, 65,536 shingles at a time. Equal texts
have equal fingerprints. A component's id is the least one, so ties don't arise; `keep_one` breaks those of ids by text hash. A null id is
never a component's id unless all its members' ids are null. Repeated rows give repeated rows. An empty table gives none. Columns of the
input may have any names: `near_duplicates` reads id and text only, `keep_one` packs the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import as_bytes, reliable

SHINGLE, SEED, BITS = 3, 42, 64
#: Fingerprints of one bucket that are compared in one unit.
CHUNK = 4096
#: (query, block) pairs that are compared at once; bounds a task's memory.
SLAB = 1 << 15
#: Keys that a hot bucket or node is split into, and fingerprints in a bucket on average, at most.
SALTS, BUCKET = 16, 1 << 14


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half the shingles' hashes; 0 for a text without words."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only; space and 09-0D only
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist()
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(first), 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)], strict=True)], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(first)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), and h, the long column `carry` if it's named: one row per row."""
    more = [F.col(carry).alias("h")] if carry else []
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("t"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("t")], np.uint64).view(np.int64)
            own = {"doc_id": b.column("doc_id"), "fp": pa.array(fp)} | ({"h": b.column("h")} if carry else {})
            yield pa.RecordBatch.from_pydict(own)

    return kept.mapInArrow(run, "doc_id long, fp long" + (", h long" if carry else ""))


def _masks(blocks: int, radius: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(ranges, blocks - radius)]


def _above(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counters, bit by bit from the highest, exceed the radius."""
    more, equal = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return more


def connected(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the least place that it reaches over links within `radius` bits in its group, by bit-sliced comparison.

    group: ascending; side: 0 for the queries' chunk, 1 for the other (in a group with one chunk all are 0 and each is
    compared with each). Links are joined slab by slab, and what is joined already isn't compared again, so a group of near copies
    costs little more than its first queries, and no list of its pairs is ever held.
    """
    n = len(fps)
    label = np.arange(n)
    two = np.zeros(int(group[-1]) + 1 if n else 0, bool)
    np.logical_or.at(two, group, side == 1)
    lanes = np.flatnonzero(side == two[group])  # the fingerprints that stand in the planes
    queries = np.flatnonzero(side == 0)
    if not len(lanes) or not len(queries):
        return label
    # Blocks of 64 lanes; a block holds lanes of one group.
    g = group[lanes]
    start = np.r_[True, g[1:] != g[:-1]]
    rank = np.arange(len(lanes)) - np.maximum.accumulate(np.where(start, np.arange(len(lanes)), 0))
    block = np.cumsum(rank % 64 == 0) - 1
    bit = (rank % 64).astype(np.uint64)
    n_blocks = int(block[-1]) + 1
    head = np.flatnonzero(rank % 64 == 0)
    valid = np.bitwise_or.reduceat(np.uint64(1) << bit, head)
    planes = np.empty((BITS, n_blocks), np.uint64)
    value = fps[lanes]
    for p in range(BITS):
        planes[p] = np.bitwise_or.reduceat(((value >> np.uint64(p)) & np.uint64(1)) << bit, head)
    slot = np.repeat(lanes[head][:, None], 64, axis=1)  # what isn't filled repeats the first lane
    slot[block, bit.astype(np.int64)] = lanes
    block_group = g[head]
    first_block = np.searchsorted(block_group, group[queries], "left")
    count = np.searchsorted(block_group, group[queries], "right") - first_block
    total = np.r_[0, np.cumsum(count)]
    one, zero = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    of_slot = label[slot]
    joined = np.full(n_blocks, -1)  # the label of a block whose lanes all have it
    at = 0
    while at < len(queries):
        to = max(at + 1, int(np.searchsorted(total, total[at] + SLAB, "right")) - 1)
        q = np.repeat(np.arange(at, to), count[at:to])
        b = np.arange(len(q)) - np.repeat(total[at:to] - total[at], count[at:to]) + np.repeat(first_block[at:to], count[at:to])
        at = to
        new = joined[b] != label[queries[q]]
        q, b = q[new], b[new]
        f = fps[queries[q]]
        counters = [np.zeros(len(q), np.uint64) for _ in range(radius.bit_length())]  # distances so far in binary, for 64 lanes each
        over = np.zeros(len(q), np.uint64)  # or more than the counters hold
        for p in range(BITS):
            carry = planes[p][b] ^ np.where((f >> np.uint64(p)) & np.uint64(1), one, zero)
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over |= carry
            if p % 8 == 7:
                alive = ~_above(counters, over, radius) & valid[b]
                on = alive != 0
                if not on.all():
                    q, b, f, over, alive = (v[on] for v in (q, b, f, over, alive))
                    counters = [c[on] for c in counters]
                if not len(q):
                    break
        if len(q):
            bits = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(bool)
            hit, lane = np.nonzero(bits & (of_slot[b] != label[queries[q]][:, None]))
            if len(hit):
                label = least_reached(n, np.r_[queries[q[hit]], np.arange(n)], np.r_[slot[b[hit], lane], label])
                of_slot = label[slot]
                joined = np.where((of_slot == of_slot[:, :1]).all(axis=1), of_slot[:, 0], -1)
    return label


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    return label


def blocks_for(n: int, radius: int) -> int:
    """The least number of blocks, at least two more than the radius, with at most BUCKET of n even fingerprints in a bucket."""
    return next(b for b in range(radius + 2, BITS + 1) if b == BITS or n <= BUCKET << (BITS * (b - radius) // b))


def links(fps: DataFrame, radius: int = 2, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """a, b: edges that connect all distinct fingerprints `fp` within `radius` bits (b < a as signed longs)."""
    if not 0 <= radius <= 15 or blocks is not None and blocks <= radius:
        raise ValueError("radius is 0 to 15, and there are more blocks than that")
    blocks = blocks or blocks_for(fps.count(), radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in _masks(blocks, radius)]
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)])
    rows = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "k", F.ceil(F.col("n") / chunk).cast("int").alias("c"))
    rows = rows.withColumn("s", _salt("fp")).join(_salted(sizes), ["t", "k", "s"]).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    units = rows.select("t", "k", "fp", "i", F.explode(pairs).alias("u")).select(
        "t", "k", "u.lo", "u.hi", (F.col("i") != F.col("u.lo")).cast("int").alias("side"), "fp"
    )
    unit = ["t", "k", "lo", "hi"]
    # A unit holds two chunks at most, so no key is hot here.
    units = units.repartition(*unit).sortWithinPartitions(*unit, "side", "fp")

    def flush(table: pa.Table) -> pa.RecordBatch | None:
        cols = {c: table.column(c).to_numpy() for c in (*unit, "side", "fp")}
        new = np.zeros(table.num_rows, bool)
        for c in unit:
            new[1:] |= cols[c][1:] != cols[c][:-1]
        label = connected(cols["fp"].view(np.uint64), np.cumsum(new), cols["side"], radius)
        fp, at = np.unique(cols["fp"], return_inverse=True)
        i = np.flatnonzero(label != np.arange(len(label)))
        root = least_reached(len(fp), at[i], at[label[i]])
        moved = root != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < 2 * chunk:
                continue
            # The last unit may go on in the next batch.
            table = pa.Table.from_batches(held)
            last = [table.column(c)[-1].as_py() for c in unit]
            same = np.ones(table.num_rows, bool)
            for c, v in zip(unit, last, strict=True):
                same &= table.column(c).to_numpy() == v
            cut = int(np.argmax(same))
            if cut:
                yield flush(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return units.mapInArrow(run, "a long, b long").distinct()


def _salt(c: str) -> Column:
    return F.pmod(F.xxhash64(F.col(c), F.lit(7)), F.lit(SALTS)).cast("int")


def _salted(df: DataFrame) -> DataFrame:
    """Rows, one for each salt, for joins with rows of hot keys. Spark doesn't see how explode makes them more, so they aren't broadcast."""
    return df.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """a, b: each node `a` that isn't its component's least node, with that node `b`. `edges` has a, b with b < a."""
    edges = reliable(edges)
    before = None
    for _ in range(most_rounds):
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return edges
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.withColumn("s", _salt("b")).join(_salted(least), ["a", "s"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.withColumn("s", _salt("b")).join(_salted(low), ["a", "s"])
        small = pairs.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = reliable(small.distinct())
    raise RuntimeError(f"components didn't settle in {most_rounds} rounds")


def _grouped(prints: DataFrame, radius: int, blocks: int | None) -> DataFrame:
    """fp, root: each distinct fingerprint of `prints` with its component's least fingerprint."""
    fps = reliable(prints.select("fp").distinct())
    roots = components(links(fps, radius, blocks)).select(F.col("a").alias("fp"), F.col("b").alias("r"))
    return fps.join(roots, "fp", "left").select("fp", F.coalesce("r", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, blocks: int | None = None) -> DataFrame:
    """doc_id, fp, component_id (least id of the texts reachable over fingerprints within `radius` bits): a row per row."""
    prints = reliable(fingerprints(docs, id_col, text_col))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(_grouped(prints, radius, blocks), "fp")
    named = nodes.join(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, blocks: int | None = None) -> DataFrame:
    """`docs` with one row of each component: that with the least id, null ids last, and of these that with the least text hash.

    Rows are told apart by id and text, so that rows of several components stay though they share an id or have none.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = [F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(text).alias("h")]
    prints = reliable(fingerprints(docs.select(*keys, text.alias("t")), "i", "t", carry="h"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    nodes = prints.groupBy("fp").agg(F.min(first).alias("least")).join(_grouped(prints, radius, blocks), "fp")
    chosen = nodes.groupBy("root").agg(F.min("least").alias("m")).select(F.col("m.doc_id").alias("id_"), F.col("m.h").alias("of_"))
    rows = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(chosen, F.col("i").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("of_")), "left_semi")
    return rows.dropDuplicates(["i", "h"]).select("row.*")
