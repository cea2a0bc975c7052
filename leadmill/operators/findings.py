"""Findings of many runs: duplicate ids, merging by location, numbering, stable fingerprints.

A finding is a row with run_id, finding_id, partition_id, title, vuln_class, source and sink (structs file, line, symbol, kind),
auth, provisional_severity, confidence, origin, direct_flow, and arrays of objects or strings (ARRAYS).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.numbering import numbered
from leadmill.functions.ranks import AUTH, CONFIDENCE, SEVERITY, first_by_bits, rank_bit
from leadmill.functions.text import digest16, distinct_by_text

LOCATION = ("file", "line", "symbol", "kind")
ARRAYS = ("evidence", "transformations", "sanitizers", "prerequisites")
DEFAULT_ORIGIN = "llm-discovered"
#: What names a merged finding within all runs.
KEY = ("run_id", "vuln_class", "source", "sink")


def duplicate_ids(raw: DataFrame, position: str = "pos") -> DataFrame:
    """run_id, finding_id: of each run that has an id twice, the one whose second use comes first in its input."""
    second = raw.groupBy("run_id", "finding_id").agg(F.array_sort(F.collect_list(position)).alias("at")).where(F.size("at") > 1)
    return second.groupBy("run_id").agg(F.min_by("finding_id", F.get("at", F.lit(1))).alias("finding_id"))


def without_failed_runs(raw: DataFrame, position: str = "pos") -> DataFrame:
    """Runs with a duplicate id give no findings; others go on."""
    return raw.join(duplicate_ids(raw, position).select("run_id"), "run_id", "left_anti")


def merged_origin(origins: Column) -> Column:
    """Of a set of origins: the one; `both` for two of different kinds, or if it's there; else the least."""
    has = lambda x: F.array_contains(origins, x)
    return F.when(F.size(origins) == 1, F.get(origins, F.lit(0))).when(has("llm-discovered") & has("sast-lead"), "both").when(has("both"), "both").otherwise(F.array_min(origins))


#: Of each ranked value of a finding: its list, its first bit in a merged finding's bits, and whether the list's last value wins.
_RANKED = {"auth": (AUTH, 0, False), "provisional_severity": (SEVERITY, 3, True), "confidence": (CONFIDENCE, 8, False)}
_DIRECT = 1 << 11


def merge(raw: DataFrame, columns: Sequence[str] | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """One row per (run, class, source, sink): worst severity, least confidence, most exposed access, united arrays. columns: those that are wanted; all if None.

    key: other columns that tell the same locations apart; the result has them in place of KEY, and less is shuffled if they're narrower.

    Scalars and array sets are combined before the shuffle; a hot location costs one row per task. Ranked values go as bits of one integer.
    """
    wanted = lambda c: columns is None or c in columns
    arrays = [c for c in (*ARRAYS, "source_lead_ids") if c in raw.columns]
    first = F.struct("finding_id", "title", *(["partition_id"] if wanted("partition_id") else []))  # the last is no part of the order of titles
    bits = F.when(F.col("direct_flow"), _DIRECT).otherwise(0) if wanted("direct_flow") else F.lit(0)
    for c, (order, at, _) in _RANKED.items():
        bits = bits.bitwiseOR(rank_bit(F.col(c), order, at)) if wanted(c) else bits
    grouped = raw.groupBy(*key).agg(
        F.min(first).alias("__rep"),
        F.bit_or(bits).alias("__bits"),
        F.collect_set(F.coalesce("origin", F.lit(DEFAULT_ORIGIN))).alias("__origins"),
        F.array_sort(F.collect_set("partition_id")).alias("partitions"),
        F.array_sort(F.collect_set("finding_id")).alias("source_finding_ids"),
        *[F.flatten(F.collect_set(c)).alias(f"__{c}") for c in arrays],
    )
    united = {c: distinct_by_text(F.col(f"__{c}"), raw.schema[c].dataType.elementType) for c in arrays}
    if "source_lead_ids" in united:
        united["source_lead_ids"] = F.when(F.size("__source_lead_ids") > 0, united["source_lead_ids"])
    best = {c: first_by_bits(F.col("__bits"), *at).alias(c) for c, at in _RANKED.items()}
    out = grouped.select(
        *key,
        *([F.col("__rep.partition_id").alias("partition_id")] if wanted("partition_id") else []),
        F.col("__rep.title").alias("title"),
        best["auth"],
        F.when(F.col("__bits").bitwiseAND(F.lit(_DIRECT)) != 0, True).alias("direct_flow"),
        best["provisional_severity"],
        best["confidence"],
        F.lit("not-requested").alias("verification_status"),
        "partitions",
        "source_finding_ids",
        merged_origin(F.col("__origins")).alias("origin"),
        *[v.alias(c) for c, v in united.items()],
    )
    return out if columns is None else out.select(*key, *[c for c in columns if c not in KEY])


def number(merged: DataFrame, prefix: str = "F-") -> DataFrame:
    """Adds number (1, 2, ... within a run, in a total order of locations) and finding_id."""
    order = ["source.file", "source.line", "sink.file", "sink.line", "vuln_class", "sink.kind", "sink.symbol", "source.kind", "source.symbol"]
    return numbered(merged, ["run_id"], [F.col(c) for c in order], "number").withColumn("finding_id", F.concat(F.lit(prefix), F.col("number").cast("string")))


def canonical_findings(raw: DataFrame, prefix: str = "F-", columns: Sequence[str] | None = None) -> DataFrame:
    """Merged and numbered findings: KEY, number, finding_id, and all or the named columns. Only what's named is aggregated, shuffled and written."""
    return number(merge(raw, columns), prefix)


def finding_fingerprint() -> Column:
    """16 hex digits that depend on class and lines only."""
    line = lambda c: F.concat(F.col(f"{c}.file"), F.lit(":"), F.col(f"{c}.line").cast("string"))
    return digest16(F.concat_ws("|", F.col("vuln_class"), line("source"), line("sink")))


def chain_fingerprints(chains: DataFrame, findings: DataFrame) -> DataFrame:
    """run_id, chain_id, fingerprint; members that the run doesn't have are left out."""
    prints = findings.select("run_id", "finding_id", finding_fingerprint().alias("fp"))
    members = chains.select("run_id", "chain_id", F.explode("finding_ids").alias("finding_id")).join(prints, ["run_id", "finding_id"])
    members = members.groupBy("run_id", "chain_id").agg(F.array_join(F.array_sort(F.collect_list("fp")), ",").alias("fps"))
    entry = F.concat(F.col("entry_point.file"), F.lit(":"), F.col("entry_point.line").cast("string"))
    key = F.concat_ws("|", entry, F.col("final_impact"), F.coalesce("fps", F.lit("")))
    return chains.join(members, ["run_id", "chain_id"], "left").select("run_id", "chain_id", digest16(key).alias("fingerprint"))
