"""Merkle manifest of a dataset: a hash tree over the rows of each group, a tree over the groups' roots, proofs and their checks.

Digests are lowercase hex SHA-256, a parent's that of its children's digests as text, joined. Within a tree every `fanout` consecutive nodes of a level are a
run with one parent; a level's last run may be shorter, down to one node, and is hashed as it is, without padding, until one node remains.

1. Leaves are hashed by Spark's own functions in one narrow pass; the texts go no further. Leaves are sorted by range partitioning, and each
   partition is an indexed range of leaves: the first index comes from the partitions' counts.
2. A task walks its range with a mountain-range stack (`Range`): of each level it holds the nodes of the run that isn't complete. A node that
   completes a run carries: the run becomes a node of the next level. What remains are peaks: nodes whose run begins before the range
   (its unaligned left edge), and those of runs that go on after it. A range has at most 2 * (fanout - 1) peaks a level.
3. Peaks are merged by the same stack, MERGED ranges at a time, until one task has those of a whole tree (at most MERGED ranges' peaks) and
   closes its short last runs. Nodes made so are records too.
4. For proofs, each range asks for the nodes beside its edges and above it, a few per level, by one join with the records. Then a second walk over the range knows the
   siblings of all its leaves. Folding a leaf to the root is a native expression over them.

Range partitions hold about LEAVES leaves, more where there would be over MOST_RANGES of them: the driver holds one number per range.

Cases: a null field is written `-`, so null and empty text differ; a null group is a group of its own, the first. Rows with a null id come first in their group.
Ties of ids go by leaf; rows equal in all fields are interchangeable and are dealt to several ranges. Very long texts are hashed whole.
An empty table gives no row. `proofs` carries any columns along under `row`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.llm.common import parts, reliable

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEAVES, MOST_RANGES, MERGED = 1 << 16, 1 << 16, 64


def digest(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: of each field its byte count, a colon and its value, or `-` for null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


class Range:
    """The stack over consecutive nodes of one tree: `push` them in order, `records` and `peaks` collect (level, index, digest)."""

    def __init__(self, fanout: int, keep: bool = True):
        self.fanout, self.keep, self.open = fanout, keep, {}
        self.records: list[tuple[int, int, bytes]] = []
        self.peaks: list[tuple[int, int, bytes]] = []

    def push(self, level: int, index: int, node: bytes) -> None:
        while True:
            first, nodes = self.open.setdefault(level, (index, []))
            nodes.append(node)
            if (index + 1) % self.fanout:
                return
            del self.open[level]
            if first % self.fanout:  # the run begins before this range
                self.peaks += [(level, first + k, d) for k, d in enumerate(nodes)]
                return
            level, index, node = level + 1, index // self.fanout, digest(nodes)
            if self.keep:
                self.records.append((level, index, node))

    def end(self) -> None:
        """The range ends and the tree goes on, or isn't known to end: open runs are peaks."""
        self.peaks += [(level, first + k, d) for level, (first, nodes) in self.open.items() for k, d in enumerate(nodes)]
        self.open = {}

    def close(self, leaves: int) -> bytes:
        """The tree ends here and all of it has been pushed: short runs are hashed as they are. The root."""
        level, count = 0, leaves
        while count > 1:
            if level in self.open:
                _, nodes = self.open.pop(level)
                node = digest(nodes)
                count = -(-count // self.fanout)
                self.records.append((level + 1, count - 1, node))
                self.push(level + 1, count - 1, node)
            else:
                count //= self.fanout
            level += 1
        return self.open[level][1][0]


@dataclass(frozen=True)
class Grown:
    """segments: pid, tree, start, n, total (leaves of the tree); peaks and records: tree, level, idx, digest; roots: tree, root, total."""

    segments: DataFrame
    peaks: DataFrame
    records: DataFrame
    roots: DataFrame
    starts: dict[int, int]


_NODE = "pid int, tree string, level int, idx long, digest string, kind int"


def ranged(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """`leaves` (tree, digest, row, and what `order` reads) as written partitions, sorted by tree and order, with pid, the partition's number."""
    least = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_RANGES, parts(leaves.count(), LEAVES, least))
    keys = [F.col("tree"), *order, F.col("digest")]
    # Rows equal in all keys are interchangeable, so a number parts them.
    dealt = leaves.withColumn("deal", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(n, *keys, "deal")
    return reliable(dealt.sortWithinPartitions(*keys).select(F.spark_partition_id().alias("pid"), "tree", "digest", "row"))


def _walk(leaves: DataFrame, fanout: int, starts: dict[int, int], records: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, index = None, None, 0
        for b in batches:
            for pid, tree, node in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                if tree != now:
                    if stack:
                        stack.end()
                        yield _nodes(last, now, stack)
                    index = starts.get(pid, 0) if now is None else 0  # only a range's first tree can have begun before it
                    now, stack, last = tree, Range(fanout, records), pid
                stack.push(0, index, node.encode())
                index += 1
            if stack and len(stack.records) > 1 << 14:
                yield _nodes(last, now, stack)
                stack.records, stack.peaks = [], []
        if stack:
            stack.end()
            yield _nodes(last, now, stack)

    return leaves.select("pid", "tree", "digest").mapInArrow(run, _NODE)


def _nodes(pid: int, tree: str, stack: Range, root: tuple[int, bytes] | None = None) -> pa.RecordBatch:
    """kind: 0 a peak, 1 a record, 2 a root, whose idx is the number of the tree's leaves."""
    rows = [(*x, 0) for x in stack.peaks] + [(*x, 1) for x in stack.records] + ([(0, root[0], root[1], 2)] if root else [])
    n = len(rows)
    level, idx, node, kind = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array([pid] * n, pa.int32()), pa.array([tree] * n, pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array([x.decode() for x in node], pa.string()), pa.array(kind, pa.int32())],
        ["pid", "tree", "level", "idx", "digest", "kind"],
    )


def _merge(peaks: DataFrame, fanout: int, ranges: int) -> DataFrame:
    """One stack over the peaks of `ranges` ranges of each tree; where these are all the ranges there are, trees are closed."""
    whole = ranges == 0
    at = (F.col("idx") * F.pow(F.lit(float(fanout)), "level").cast("long")).alias("at")
    rows = peaks.select((F.lit(0) if whole else F.floor(F.col("pid") / ranges)).cast("int").alias("pid"), "tree", "level", "idx", "digest", at)
    rows = rows.repartition("tree", "pid").sortWithinPartitions("tree", "pid", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, end = None, None, 0

        def done() -> pa.RecordBatch:
            if whole:
                return _nodes(*now, stack, (end, stack.close(end)))
            stack.end()
            return _nodes(*now, stack)

        for b in batches:
            for pid, tree, level, idx, node in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
                if (pid, tree) != now:
                    if stack:
                        yield done()
                    now, stack = (pid, tree), Range(fanout)
                stack.push(level, idx, node.encode())
                end = (idx + 1) * fanout**level
        if stack:
            yield done()

    return rows.mapInArrow(run, _NODE)


def grow(leaves: DataFrame, fanout: int, records: bool = False) -> Grown:
    """The trees over `leaves`, which come from `ranged`. With `records` the nodes inside ranges are records, too, not only those that merging makes."""
    counts = leaves.groupBy("pid", "tree").agg(F.count(F.lit(1)).alias("n"))
    # A tree has at most one row a range here.
    before = Window.partitionBy("tree").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    segments = reliable(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("tree"))))
    # One number per range at most, of MOST_RANGES ranges: where the range's first tree goes on.
    starts = {r["pid"]: r["start"] for r in segments.where("start > 0").select("pid", "start").collect()}
    nodes = reliable(_walk(leaves, fanout, starts, records))
    first = nodes.where("kind = 0").drop("kind")
    made = [nodes.where("kind = 1")]
    n, peaks = parts(leaves.rdd.getNumPartitions(), MERGED), first
    while True:
        merged = reliable(_merge(peaks, fanout, 0 if n == 1 else MERGED))
        made.append(merged.where("kind > 0"))
        if n == 1:
            break
        n, peaks = parts(n, MERGED), merged.where("kind = 0").drop("kind")
    every = made[0]
    for more in made[1:]:
        every = every.unionByName(more)
    roots = every.where("kind = 2").select("tree", F.col("digest").alias("root"), F.col("idx").alias("total"))
    return Grown(segments, first.drop("pid"), every.where("kind = 1").select("tree", "level", "idx", "digest"), roots, starts)


def spans(start: int, end: int, total: int, fanout: int) -> list[tuple[int, int, int, int, int]]:
    """(level, a, b, c, d) of each level below the root: leaves start to end make the nodes b to c by themselves; their proofs need a to d."""
    out, level, width, count = [], 0, 1, total
    while count > 1:
        b, c = -(-start // width), count if end == total else end // width
        low, high = start // width, (end - 1) // width
        a, d = low - low % fanout, min(high - high % fanout + fanout, count)
        out.append((level, a, b, max(b, c), d))
        level, width, count = level + 1, width * fanout, -(-count // fanout)
    return out


def _asked(segments: DataFrame, fanout: int) -> DataFrame:
    """pid, tree, level, idx of the nodes that a range's proofs need and that it doesn't make itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, int, int]] = []
            for pid, tree, start, n, total in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                for level, a, b, c, d in spans(start, start + n, total, fanout):
                    out += [(pid, tree, level, k) for k in (*range(a, b), *range(c, d))]
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["pid", "tree", "level", "idx"])

    return segments.select("pid", "tree", "start", "n", "total").mapInArrow(run, "pid int, tree string, level int, idx long")


_STEPS = "array<struct<left:string,right:string>>"


def paths(leaves: DataFrame, grown: Grown, fanout: int, row_type: str, more: DataFrame | None = None) -> DataFrame:
    """tree, digest, row, root, steps (left and right siblings of each level, joined): one row per leaf.

    more: tree, top, steps of the tree above, whose steps come after the tree's own; `root` is `top` then.
    """
    nodes = grown.peaks.unionByName(grown.records)
    known = _asked(grown.segments, fanout).join(nodes, ["tree", "level", "idx"]).groupBy("pid", "tree").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("known"))
    edges = grown.segments.join(known, ["pid", "tree"], "left").join(grown.roots.select("tree", "root"), "tree")
    above = more if more is not None else grown.roots.select("tree", F.col("root").alias("top"), F.array().cast(_STEPS).alias("steps"))
    edges = edges.join(above, "tree").select("pid", "tree", F.struct("start", "n", "total", "known", "root", "top", "steps").alias("edge"))
    # Each range's edge nodes come first, then its leaves in their order, by the key that the walk before numbered them in.
    both = leaves.select("pid", "tree", F.col("digest"), "row", F.monotonically_increasing_id().alias("at")).unionByName(edges.withColumn("at", F.lit(-1).cast("long")), allowMissingColumns=True)
    both = both.repartitionByRange(max(1, leaves.rdd.getNumPartitions()), "pid", "tree").sortWithinPartitions("pid", "tree", "at").select("tree", "digest", "row", "edge")
    out = f"tree string, digest string, row {row_type}, subroot string, root string, steps {_STEPS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        edge = None
        for b in batches:
            new = b.column("edge").is_valid().to_numpy(zero_copy_only=False).nonzero()[0].tolist()
            edges_at = set(new)
            for begin, end in zip([0, *new], [*new, b.num_rows], strict=True):
                if begin in edges_at and end > begin:
                    if held:
                        yield from _proved(held, edge, fanout)
                    held, edge = [], b.column("edge")[begin].as_py()
                    begin += 1
                if end > begin:
                    held.append(b.slice(begin, end - begin))
        if held:
            yield from _proved(held, edge, fanout)

    return both.mapInArrow(run, out)


def _proved(held: list[pa.RecordBatch], edge: dict, fanout: int) -> Iterator[pa.RecordBatch]:
    start, end, total = edge["start"], edge["start"] + edge["n"], edge["total"]
    below = [d.encode() for b in held for d in b.column("digest").to_pylist()]
    outside: dict[int, dict[int, bytes]] = {}
    for x in edge["known"] or []:
        outside.setdefault(x["level"], {})[x["idx"]] = x["digest"].encode()
    levels = []  # of each level the first index, and the nodes from there on
    at = start
    for level, a, b, c, d in spans(start, end, total, fanout):
        if level:  # the nodes b to c from those of the level below
            below = [digest(below[k * fanout - at : (k + 1) * fanout - at]) for k in range(b, c)]
            at = b
        beside = outside.get(level, {})
        levels.append((a, [beside[k] for k in range(a, b)] + below[b - at : c - at] + [beside[k] for k in range(c, d)]))
    upper = [(s["left"], s["right"]) for s in edge["steps"]]
    index = start
    for b in held:
        steps = []
        for _ in range(b.num_rows):
            own, k = [], index
            for a, nodes in levels:
                first = k - k % fanout
                own.append({"left": b"".join(nodes[first - a : k - a]).decode(), "right": b"".join(nodes[k + 1 - a : first + fanout - a]).decode()})
                k //= fanout
            steps.append(own + [{"left": x, "right": y} for x, y in upper])
            index += 1
        n = b.num_rows
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("digest"), b.column("row"), pa.array([edge["root"]] * n), pa.array([edge["top"]] * n), pa.array(steps, kind)], ["tree", "digest", "row", "subroot", "root", "steps"])


def folded(node: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _leaves(docs: DataFrame, fields: list[str], group: str, order: str, row: Column) -> DataFrame:
    """tree: `=` and the group, or empty for null, so that null comes first and joins are plain."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col(f"`{order}`").alias("ord"), leaf([F.col(f"`{f}`") for f in fields]).alias("digest"), row.alias("row"))


def _upper(grown: Grown, fanout: int) -> tuple[DataFrame, Grown]:
    """The tree over the roots of trees in the order of their names: its leaves, and itself."""
    roots = grown.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"), F.struct(F.col("tree").alias("name")).alias("row"))
    leaves = ranged(roots, [F.col("name")])
    return leaves, grow(leaves, fanout)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", order_col: str = "doc_id", fanout: int = 2) -> DataFrame:
    """tree, level, idx, digest of every node above the leaves: the groups' trees (`=` and the group, empty for null) and the tree over them (`*`)."""
    leaves = ranged(_leaves(docs, list(fields), group_col, order_col, F.struct(F.lit(1).alias("one"))), [F.col("ord")])
    grown = grow(leaves, fanout, records=True)
    _, top = _upper(grown, fanout)
    return grown.records.unionByName(top.records.withColumn("tree", F.lit("*")))


def proofs(docs: DataFrame, row: list[Column], row_type: str, fields: tuple[str, ...] = FIELDS, group_col: str = "lang", order_col: str = "doc_id", fanout: int = 2) -> DataFrame:
    """row (the struct of the columns `row`), digest (the leaf), subroot (the group's root), root, steps (siblings): one row per row.

    `folded(digest, steps)` is `root` for an unchanged row.
    """
    leaves = ranged(_leaves(docs, list(fields), group_col, order_col, F.struct(*row)), [F.col("ord")])
    grown = grow(leaves, fanout)
    above, top = _upper(grown, fanout)
    more = reliable(paths(above, top, fanout, "struct<name:string>").select(F.col("row.name").alias("tree"), F.col("root").alias("top"), "steps"))
    return paths(leaves, grown, fanout, row_type, more).drop("tree")


def verified(docs: DataFrame, fanout: int = 2, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: each row's proof, checked after one is added to n_chars where `every` divides crc32(doc_id)."""
    fields = {f: F.col(f) for f in FIELDS}
    altered = leaf(list((fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}).values()))
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    row = [F.col("doc_id").cast("long").alias("doc_id"), F.when(hit, altered).alias("altered")]
    out = proofs(docs, row, "struct<doc_id:long,altered:string>", fanout=fanout)
    out = out.select("row.doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), folded(F.coalesce("row.altered", "digest"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_CRC = """
crc(b, c) AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM (SELECT unnest(range(256)) AS i)),
crcs AS (SELECT list(c ORDER BY b) AS t FROM crc)"""


def oracle() -> str:
    """The query in DuckDB's SQL: levels by a recursive table of nodes, proofs by joins with the sibling of each level (fanout 2), folds by recursion."""
    part = lambda c, v: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END"
    row = lambda n: "sha256(" + " || ".join([part("doc_id", "doc_id::VARCHAR"), part("source", "source"), part("lang", "lang"), part("n_chars", f"({n})::VARCHAR"), part("text", "text")]) + ")"
    return f"""
WITH RECURSIVE {_CRC},
d AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {row("n_chars")} AS leaf,
    CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 7 = 0 THEN {row("n_chars + 1")} END AS altered
  FROM documents, crcs),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS total FROM d),
n AS (
  SELECT tree, 0 AS level, i, leaf AS h, total AS n FROM l UNION ALL
  SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM n WHERE n > 1 GROUP BY tree, level, i // 2),
r AS MATERIALIZED (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS total FROM n WHERE n.n = 1),
u AS (
  SELECT 0 AS level, i, subroot AS h, total AS n FROM r UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY level, i // 2),
e AS MATERIALIZED (
  SELECT l.tree, l.i, n.level, n.h, (l.i >> n.level) & 1 AS odd FROM l JOIN n ON n.tree = l.tree AND n.i = xor(l.i >> n.level, 1) AND n.n > 1 UNION ALL
  SELECT l.tree, l.i, 100 + u.level, u.h, (r.i >> u.level) & 1 FROM l JOIN r USING (tree) JOIN u ON u.i = xor(r.i >> u.level, 1) AND u.n > 1),
levels AS (SELECT tree, level FROM n WHERE n.n > 1 GROUP BY ALL UNION ALL SELECT tree, 100 + level FROM r, (SELECT DISTINCT level FROM u WHERE n > 1)),
steps AS MATERIALIZED (
  SELECT l.tree, l.i, list(CASE WHEN odd = 1 THEN h ELSE '' END ORDER BY v.level) AS lefts, list(CASE WHEN odd = 0 THEN h ELSE '' END ORDER BY v.level) AS rights
  FROM l JOIN levels v ON l.tree = v.tree LEFT JOIN e ON e.tree = l.tree AND e.i = l.i AND e.level = v.level GROUP BY l.tree, l.i),
f AS (
  SELECT l.tree, l.i, 1 AS k, coalesce(altered, leaf) AS acc FROM l UNION ALL
  SELECT f.tree, f.i, k + 1, sha256(lefts[k] || acc || rights[k]) FROM f JOIN steps s ON f.tree = s.tree AND f.i = s.i WHERE k <= len(lefts)),
g AS (SELECT tree, i, arg_max(acc, k) AS folded_root FROM f GROUP BY tree, i),
top AS (SELECT h AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, r.subroot, root, sha256(coalesce(list_reduce(list_prepend('', list_transform(list_zip(lefts, rights), lambda z: z[1] || z[2])), lambda a, b: a || b), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM l JOIN r ON l.tree = r.tree JOIN g ON g.tree = l.tree AND g.i = l.i CROSS JOIN top LEFT JOIN steps s ON s.tree = l.tree AND s.i = l.i
"""
