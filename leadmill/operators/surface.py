"""Attack surface of code partitions: token hits per file, count vectors, scores, and allocation under a budget.

files: run_id, partition_id, stack, path, content (null where unreadable), skip_reason (missing or out_of_scope). content is the files' bytes, or their text;
a column digest, if there's one, is the digest of the bytes that the text came from, else it's that of the text.
tokens: stack, sources, sinks, sanitizers, auth_markers (arrays of strings): one small row per stack.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill.functions import paths
from leadmill.functions.numbering import numbered
from leadmill.functions.text import decoded

KINDS = ("sources", "sinks", "sanitizers", "auth_markers")
#: Bytes of tokens up to which the tasks get them as automata; more are joined as rows.
AUTOMATA = 1 << 25
BUDGET, DENSITY_CAP, LEAD_CAP = 12, 10, 10
#: Reasons of what isn't assessed.
UNREADABLE = "all files unreadable (missing/escape) — surface not assessed"
UNREADABLE_N = " files unreadable (missing/escape) — surface not assessed"
DEPRIORITIZED = "deprioritized: analyzer budget exhausted; lower predicted attack surface"
UNSUPPORTED = '" — surface not assessed; not covered by this audit'


def scanned_files(files: DataFrame) -> DataFrame:
    """Without vendored, built and generated files."""
    return files.where(~paths.excluded(F.col("path")))


def detected_stacks(files: DataFrame) -> DataFrame:
    """run_id, stack, n_files: a run can have several stacks."""
    return files.select("run_id", F.explode(paths.stacks(F.col("path"))).alias("stack")).groupBy("run_id", "stack").agg(F.count(F.lit(1)).alias("n_files"))


def has_any(text: Column, tokens: Column) -> Column:
    return F.coalesce(F.exists(tokens, lambda t: (t != "") & F.contains(text, t)), F.lit(False))


def hits(text: Column, tokens: Column) -> Column:
    """Occurrences without overlaps, summed over the tokens."""
    of = lambda t: F.when(F.coalesce(t, F.lit("")) == "", 0).otherwise((F.octet_length(text) - F.octet_length(F.replace(text, t, F.lit("")))) / F.octet_length(t)).cast("long")
    return F.coalesce(F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a + of(t)), F.lit(0).cast("long"))


def has_marker(text: Column, tokens: Column) -> Column:
    """A token stands by itself: no word character before it, and none after it if it ends in one."""
    quoted = lambda t: F.regexp_replace(t, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    pattern = lambda t: F.concat(F.lit("(?:^|[^A-Za-z0-9_])"), quoted(t), F.when(t.rlike("[A-Za-z0-9_]$"), F.lit("(?:$|[^A-Za-z0-9_])")).otherwise(F.lit("")))
    return F.coalesce(F.exists(tokens, lambda t: (t != "") & F.contains(text, t) & F.rlike(text, F.concat(F.lit("(?s)"), pattern(t)))), F.lit(False))


_FOUND = ("has_source", "has_sink", "has_sanitizer", "has_auth", "source_hits", "sink_hits", "auth_hits")


class Scanner:
    """All tokens of a stack in one automaton: one pass over a text, however many they are."""

    def __init__(self, tokens: dict[str, list[str | None]]):
        import ahocorasick

        self.counts = [Counter(t for t in tokens[k] or () if t) for k in KINDS]
        self.words = sorted(set().union(*self.counts))
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(self.words):
            self.automaton.add_word(w, i)
        if self.words:
            self.automaton.make_automaton()
        self.open_end = [not re.search("[A-Za-z0-9_]$", w) for w in self.words]
        self.marks = {i for i, w in enumerate(self.words) if w in self.counts[3]}

    def found(self, text: str | None) -> tuple:
        """Values of _FOUND: presence and hits, without overlaps of a token with itself. A marker's occurrence counts as such where it stands by itself."""
        seen: Counter[int] = Counter()
        free: dict[int, int] = {}
        marked = False
        if text and self.words:
            for end, i in self.automaton.iter(text):
                start = end + 1 - len(self.words[i])
                if start < free.get(i, 0):
                    continue
                free[i] = end + 1
                seen[i] += 1
                if not marked and i in self.marks:
                    marked = not (start and _WORD(text[start - 1])) and (self.open_end[i] or end + 1 == len(text) or not _WORD(text[end + 1]))
        total = [sum(n * kind[self.words[i]] for i, n in seen.items()) for kind in self.counts]
        return (total[0] > 0, total[1] > 0, total[2] > 0, marked, total[0], total[1], total[3])


_WORD = re.compile("[A-Za-z0-9_]").match


def _scanned(rows: DataFrame, tokens: dict[str, dict]) -> DataFrame:
    """rows: x (a struct that goes on as it is), stack, text. Adds _FOUND; the text goes no further."""
    kinds = rows.schema["x"].dataType.simpleString()
    out = ", ".join([f"x {kinds}", *[f"{c} boolean" for c in _FOUND[:4]], *[f"{c} long" for c in _FOUND[4:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanners, nothing = {}, Scanner({k: [] for k in KINDS})
        for b in batches:
            found = []
            for stack, text in zip(b.column("stack").to_pylist(), b.column("text"), strict=True):
                if stack in tokens and stack not in scanners:
                    scanners[stack] = Scanner(tokens[stack])
                found.append(scanners.get(stack, nothing).found(text.as_py()))
            columns = zip(*found, strict=True) if found else [()] * len(_FOUND)
            kind = [pa.bool_()] * 4 + [pa.int64()] * 3
            yield pa.RecordBatch.from_arrays([b.column("x"), *[pa.array(c, t) for c, t in zip(columns, kind, strict=True)]], ["x", *_FOUND])

    return rows.mapInArrow(run, out)


def file_hits(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """Per file: presence and hits of each kind, and the content's digest; the content itself goes no further.

    Tokens come to the tasks as one automaton per stack if they're small enough, else by a join; null and empty ones count nothing.
    """
    raw = isinstance(files.schema["content"].dataType, T.BinaryType)
    digest = F.col("digest") if "digest" in files.columns else F.sha2(F.col("content") if raw else F.col("content").cast("binary"), 256)
    text = decoded(F.col("content")) if raw else F.col("content")
    own = ["run_id", "partition_id", "stack", "path"]
    skipped = F.when(F.col("content").isNull(), F.coalesce("skip_reason", F.lit("missing"))).alias("skip_reason")
    size = F.sum(reduce(Column.__add__, [F.octet_length(F.array_join(k, "")) for k in KINDS]))
    if int(tokens.agg(size.alias("n")).first()["n"] or 0) <= AUTOMATA:
        known = {r["stack"]: r.asDict() for r in tokens.select("stack", *[F.coalesce(k, F.array().cast("array<string>")).alias(k) for k in KINDS]).collect()}
        supported = F.coalesce(F.col("stack").isin(*known), F.lit(False)) if known else F.lit(False)
        rows = files.select(F.struct(*own, supported.alias("supported"), skipped, digest.alias("digest")).alias("x"), "stack", text.alias("text"))
        return _scanned(rows, known).select(*[f"x.{c}" for c in (*own, "supported", "skip_reason")], *_FOUND, "x.digest")
    x = files.select(*own, skipped, digest.alias("digest"), text.alias("text")).join(tokens.select("stack", *KINDS, F.lit(True).alias("supported")), "stack", "left")
    found = [has_any(F.col("text"), F.col(k)) for k in KINDS[:3]] + [has_marker(F.col("text"), F.col(KINDS[3]))] + [hits(F.col("text"), F.col(k)) for k in ("sources", "sinks", "auth_markers")]
    return x.select(*own, F.coalesce("supported", F.lit(False)).alias("supported"), "skip_reason", *[c.alias(n) for c, n in zip(found, _FOUND, strict=True)], "digest")


def partition_digests(hit: DataFrame) -> DataFrame:
    """run_id, partition_id, content_key, file_content_digest: digests of a partition's paths and of its files.

    content_key is the digest of the sorted paths, joined by line breaks, never of contents; file_content_digest that of each readable file's raw digest and a
    zero byte, in the order of paths. Each is one hash over all of a partition, so one task walks its sorted rows; it holds two hash states and no rows.
    """
    rows = hit.select("run_id", "partition_id", "path", F.when(F.col("skip_reason").isNull(), F.col("digest")).alias("digest")).where("path is not null")
    rows = rows.repartition("run_id", "partition_id").sortWithinPartitions("run_id", "partition_id", "path", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, paths_, contents, rows_out = None, None, None, []

        def batch() -> pa.RecordBatch:
            run_id, partition_id, *digests = zip(*rows_out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (run_id, partition_id, *digests)], ["run_id", "partition_id", "content_key", "file_content_digest"])

        for b in batches:
            for *key, path, digest in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                if key != now:
                    if now:
                        rows_out.append((*now, paths_.hexdigest(), contents.hexdigest()))
                    now, paths_, contents = key, hashlib.sha256(path.encode()), hashlib.sha256()
                else:
                    paths_.update(b"\n" + path.encode())
                if digest is not None:
                    contents.update(bytes.fromhex(digest) + b"\0")
            if rows_out:
                yield batch()
                rows_out = []
        if now:
            rows_out.append((*now, paths_.hexdigest(), contents.hexdigest()))
            yield batch()

    return rows.mapInArrow(run, "run_id string, partition_id string, content_key string, file_content_digest string")


def surface_vectors(hit: DataFrame) -> DataFrame:
    """One row per partition: counts of files, hits, skips, keys, and whether it's scannable. `hit` is read twice."""
    n = lambda c: F.count_if(c).cast("long")
    total = lambda c, where: F.sum(F.when(F.col(where), F.col(c)).otherwise(0)).cast("long")
    v = hit.groupBy("run_id", "partition_id").agg(
        F.min("stack").alias("stack"), F.max("supported").alias("supported"), F.count(F.lit(1)).alias("files"), n(F.col("has_source")).alias("sources"), n(F.col("has_sink")).alias("sinks"), n(F.col("has_sanitizer")).alias("sanitizers"),
        n(F.col("has_auth")).alias("auth_markers"), n(F.col("has_source") & F.col("has_auth")).alias("source_and_auth_files"), total("source_hits", "has_source").alias("source_hits"), total("sink_hits", "has_sink").alias("sink_hits"),
        total("auth_hits", "has_auth").alias("auth_hits"), n(F.col("skip_reason") == "missing").alias("skipped_missing"), n(F.col("skip_reason") == "out_of_scope").alias("skipped_out_of_scope"),
    )
    digests = partition_digests(hit).withColumnsRenamed({"run_id": "__run", "partition_id": "__part"})
    v = v.join(digests, F.col("run_id").eqNullSafe(F.col("__run")) & F.col("partition_id").eqNullSafe(F.col("__part")), "left")
    all_skipped = F.col("skipped_missing") + F.col("skipped_out_of_scope") == F.col("files")
    ok = F.col("supported") & ~all_skipped
    counts = ("sources", "sinks", "sanitizers", "auth_markers", "source_and_auth_files", "source_hits", "sink_hits", "auth_hits", "content_key", "file_content_digest")
    return v.select(
        "run_id", "partition_id", "stack", ok.alias("scannable"), "files", *[F.when(ok, F.col(c)).alias(c) for c in counts], *[F.when(F.col("supported"), F.col(c)).alias(c) for c in ("skipped_missing", "skipped_out_of_scope")],
        F.when(F.col("supported") & all_skipped, UNREADABLE).alias("reason"),
    )


def score() -> Column:
    """Structure, capped density and leads; size and sanitizers don't count."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    source, sink = n("sources") > 0, n("sinks") > 0
    points = lambda cond, p: F.when(cond, p).otherwise(0)
    return (
        points(source, 1) + points(sink, 2) + points(source & sink, 3) + points(source & sink & (n("source_and_auth_files") < n("sources")), 4)
        + F.least(n("sink_hits"), F.lit(DENSITY_CAP)) + 2 * F.least(n("leads"), F.lit(LEAD_CAP))
    ).cast("long")


def scored(vectors: DataFrame, leads: DataFrame | None = None) -> DataFrame:
    """Vectors with leads and score. leads: run_id, partition_id, leads."""
    v = vectors.withColumn("leads", F.lit(0).cast("long")) if leads is None else vectors.join(leads.select("run_id", "partition_id", "leads"), ["run_id", "partition_id"], "left")
    return v.withColumn("score", score())


def allocate(vectors: DataFrame, leads: DataFrame | None = None, budget: int = BUDGET) -> DataFrame:
    """Vectors with score, place and allocation: analyze, deprioritized, unreadable-partition or unsupported-stack."""
    if isinstance(budget, bool) or not isinstance(budget, int) or budget < 1:
        raise ValueError("budget must be a positive integer")
    v = scored(vectors, leads).withColumn("__able", F.coalesce("scannable", F.lit(True)))
    v = numbered(v, ["run_id", "__able"], [-F.col("score"), F.col("content_key"), F.col("partition_id")], "place")
    v = v.withColumn("place", F.when(F.col("__able"), F.col("place"))).drop("__able")
    unread = F.col("skipped_missing").isNotNull() | F.col("skipped_out_of_scope").isNotNull()
    kind = F.when(F.col("place") <= budget, "analyze").when(F.col("place").isNotNull(), "deprioritized").when(unread, "unreadable-partition").otherwise("unsupported-stack")
    return v.withColumn("allocation", kind)


def coverage_gaps(allocated: DataFrame) -> DataFrame:
    """run_id, gap_class, target, score, counts (a struct), reason of each partition that isn't analyzed."""
    stack = F.coalesce("stack", F.lit("unknown"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    deprioritized = F.col("allocation") == "deprioritized"
    reason = (
        F.when(deprioritized, DEPRIORITIZED)
        .when(F.col("allocation") == "unreadable-partition", F.coalesce("reason", F.concat(F.lit("all "), n("files").cast("string"), F.lit(UNREADABLE_N))))
        .otherwise(F.concat(F.lit('unsupported stack "'), stack, F.lit(UNSUPPORTED)))
    )
    counts = F.struct(*[n(c) for c in ("sources", "sinks", "sanitizers", "auth_markers", "source_and_auth_files", "sink_hits", "skipped_missing", "skipped_out_of_scope")])
    gaps = allocated.where("allocation != 'analyze'")
    return gaps.select("run_id", F.col("allocation").alias("gap_class"), F.col("partition_id").alias("target"), F.when(deprioritized, F.col("score")).alias("score"), counts.alias("counts"), reason.alias("reason"))
