"""SARIF documents to leads: explode, resolve locations against a manifest, map rules to classes, number, count, assign.

docs: run_id, doc (place of the document in its run), text. manifest: run_id, file (root-relative), and optionally real_file.
Documents are exploded at once; their text goes no further. A document that can't be used is a row of `document_errors`.

Results are read as variants, and each value only where it has its type: a line is a whole number however it's written (3, 3.0, 3e0; up to a long), a rule id,
a uri and a message are strings; anything else there is as if it were absent. A result that isn't an object counts and is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions import paths
from leadmill.functions.lineage import settled
from leadmill.functions.numbering import numbered as numbered_rows
from leadmill.functions.text import padded, truncated
from leadmill.functions.variants import at, integer_at, list_at, text_at

#: Lengths that leads keep to, steps of a code flow, and other names of tools.
MAX = {"tool": 64, "rule_id": 256, "vuln_class_hint": 64, "file": 1024, "message": 512}
MAX_STEPS = 64
ALIASES = {"semgrep-oss": "semgrep"}
VERSION = "2.1.0"
#: Why a result is dropped, and why a lead isn't analyzed.
DROPS = ("out_of_scope", "missing", "bad_uri", "bad_location")
NOT_ANALYZED = "lead not analyzed"

def _unusable(doc: Column) -> Column:
    no_runs, other = list_at(doc, "$.runs").isNull(), ~F.coalesce(text_at(doc, "$.version") == VERSION, F.lit(False))
    return F.when(doc.isNull(), "malformed SARIF: not JSON").when(no_runs, "malformed SARIF: missing runs[]").when(other, "unsupported SARIF version")


def _parsed(text: Column, value: Callable[[Column], Column]) -> Column:
    """`value` of the parsed text, which is parsed once however often it reads it."""
    return F.get(F.transform(F.array(F.try_parse_json(text)), value), F.lit(0))


def document_error(text: Column) -> Column:
    """Why a document can't be used: it isn't JSON, has no runs, or another version; else null."""
    return _parsed(text, _unusable)


def document_errors(docs: DataFrame) -> DataFrame:
    """run_id, doc, error of documents that can't be used."""
    return docs.select("run_id", "doc", document_error(F.col("text")).alias("error")).where("error is not null")


def normalized_tool(name: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = F.when(name.isNull() | (F.trim(name) == ""), "unknown")
    for other, own in ALIASES.items():
        out = out.when(plain == other, own)
    return out.when(plain == "", "unknown").otherwise(plain)


def exploded(docs: DataFrame) -> DataFrame:
    """One row per result in document order: run_id, doc, run, pos, tool, rules, bases, result. One narrow pass over the texts."""
    runs = _parsed(F.col("text"), lambda d: F.when(_unusable(d).isNull(), list_at(d, "$.runs")))
    r = docs.select("run_id", "doc", F.posexplode(runs).alias("run", "r"))
    bases = F.try_variant_get("r", "$.originalUriBaseIds", "map<string,variant>")
    return r.select("run_id", "doc", "run", normalized_tool(text_at(F.col("r"), "$.tool.driver.name")).alias("tool"), list_at(F.col("r"), "$.tool.driver.rules").alias("rules"), bases.alias("bases"), F.posexplode(list_at(F.col("r"), "$.results")).alias("pos", "result"))


def rule_id() -> Column:
    """The result's ruleId, its rule's id, or that of the tool's rule by index; `unknown` where that's empty."""
    result = F.col("result")
    index = integer_at(result, "$.rule.index")
    by_index = text_at(F.get(F.col("rules"), F.when(index.between(0, 2**31 - 1), index).cast("int")), "$.id")
    return F.coalesce(F.nullif(F.coalesce(text_at(result, "$.ruleId"), text_at(result, "$.rule.id"), by_index), F.lit("")), F.lit("unknown"))


def located(rows: DataFrame, location: Column, root: str) -> DataFrame:
    """Adds line and abs (the folded path), or drop: bad_location or bad_uri. location: a variant."""
    artifact = lambda name: text_at(location, f"$.physicalLocation.artifactLocation.{name}")
    base = text_at(F.try_element_at("bases", artifact("uriBaseId")), "$.uri")
    x = rows.select("*", integer_at(location, "$.physicalLocation.region.startLine").alias("line"), artifact("uri").alias("__uri"), base.alias("__base"))
    x = x.select(*rows.columns, "line", paths.resolved_uri(F.col("__uri"), F.col("__base"), F.lit(root)).alias("abs"))
    return x.withColumn("drop", F.when(F.coalesce(F.col("line") < 1, F.lit(True)), "bad_location").when(F.col("abs").isNull(), "bad_uri"))


def confined(rows: DataFrame, manifest: DataFrame, path: str, root: str) -> DataFrame:
    """Adds file (root-relative) or drop: out_of_scope for a path outside the root, missing for one that isn't in the manifest.

    `rows` may have a drop already, which stays. Paths are resolved by text; a manifest's real_file stands for links.
    """
    p = F.col(path)
    full = paths.folded(F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root + "/"), p)))
    old = F.col("drop") if "drop" in rows.columns else F.lit(None).cast("string")
    kept = [c for c in rows.columns if c != "drop"]
    x = rows.select(*kept, full.alias("__full"), old.alias("__old")).withColumn("__in", paths.inside(F.col("__full"), F.lit(root))).withColumn("__file", F.when(F.col("__in"), paths.relative(F.col("__full"), F.lit(root))))
    real = F.coalesce("real_file", "file") if "real_file" in manifest.columns else F.col("file")
    m = manifest.select("run_id", F.col("file").alias("__file"), real.alias("__real")).distinct()
    x = x.join(m, ["run_id", "__file"], "left")
    drop = F.coalesce("__old", F.when(~F.coalesce("__in", F.lit(False)), "out_of_scope").when(F.col("__real").isNull(), "missing"))
    x = x.select(*kept, drop.alias("drop"), "__real")
    return x.select(*kept, F.when(F.col("drop").isNull(), truncated(F.col("__real"), MAX["file"])).alias("file"), "drop")


def rule_index(rule_map: DataFrame) -> DataFrame:
    """tool, key, pos, vuln_class: `=` and a rule's id, or `^` and a prefix; of entries with one key the first."""
    keys = F.array_compact(F.array(F.concat(F.lit("="), "rule"), F.concat(F.lit("^"), "prefix")))
    return rule_map.select("tool", "pos", "vuln_class", F.explode(keys).alias("key")).groupBy("tool", "key").agg(F.min("pos").alias("pos"), F.min_by("vuln_class", "pos").alias("vuln_class"))


def mapped_class(rows: DataFrame, rule_map: DataFrame) -> DataFrame:
    """Adds vuln_class: of the tool's entries in order the first whose rule is the id or whose prefix starts it, else unknown.

    rule_map: tool, pos, rule, prefix, vuln_class. Distinct ids look up themselves and their beginnings, of the lengths that the tool's prefixes have, by
    equality: an id costs as many lookups as there are lengths, however many entries there are. `rows` are read twice.
    """
    index = rule_index(rule_map)
    lengths = rule_map.where("prefix is not null").groupBy("tool").agg(F.collect_set(F.char_length("prefix")).alias("lengths"))
    ids = rows.select("tool", "rule_id").distinct().join(lengths, "tool", "left")
    fitting = F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: n <= F.char_length("rule_id"))
    keys = F.concat(F.array(F.concat(F.lit("="), "rule_id")), F.transform(fitting, lambda n: F.concat(F.lit("^"), F.substr("rule_id", F.lit(1), n))))
    found = ids.select("tool", "rule_id", F.explode(keys).alias("key")).join(index, ["tool", "key"]).groupBy("tool", "rule_id").agg(F.min_by("vuln_class", "pos").alias("__class"))
    return rows.join(found, ["tool", "rule_id"], "left").select(*rows.columns, F.coalesce("__class", F.lit("unknown")).alias("vuln_class"))


def resolved(rows: DataFrame, manifest: DataFrame, rule_map: DataFrame, root: str) -> DataFrame:
    """`rows` of `exploded`, or of large_sarif.exploded_pieces, with rule_id, vuln_class, file and line, or the reason why a result is dropped."""
    rows = settled(located(rows.withColumn("rule_id", rule_id()), at(F.col("result"), "$.locations[0]"), root))  # read twice below, parsed once
    return mapped_class(confined(rows, manifest, "abs", root), rule_map)


def resolved_results(docs: DataFrame, manifest: DataFrame, rule_map: DataFrame, root: str) -> DataFrame:
    return resolved(exploded(docs), manifest, rule_map, root)


def codeflows(results: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """run_id, doc, run, pos, codeflow: the first MAX_STEPS steps of the first thread flow that resolve."""
    key = ["run_id", "doc", "run", "pos"]
    flow = list_at(F.col("result"), "$.codeFlows[0].threadFlows[0].locations")
    steps = results.where("drop is null").select(*key, "bases", F.posexplode(flow).alias("at", "step"))
    steps = confined(located(steps, at(F.col("step"), "$.location"), root), manifest, "abs", root).where("drop is null")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    steps = steps.withColumn("nth", nth).where(F.col("nth") <= MAX_STEPS)
    steps = steps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "file", "line"))).alias("s"))
    return steps.select(*key, F.transform("s", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"))).alias("codeflow"))


def invalid_documents(results: DataFrame) -> DataFrame:
    """Documents with a location that is the root itself: such a lead is invalid, and so is its document."""
    return results.where("drop is null and file = ''").select("run_id", "doc").distinct()


def lead_rows(results: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """run_id, doc, run, pos, tool, rule_id, vuln_class_hint, file, line, message, codeflow of kept results, without a number yet."""
    kept = results.where("drop is null").join(invalid_documents(results), ["run_id", "doc"], "left_anti")
    if flows is not None:
        kept = kept.join(flows, ["run_id", "doc", "run", "pos"], "left")
    flow = F.col("codeflow") if flows is not None else F.lit(None).cast("array<struct<file:string,line:bigint>>")
    return kept.select(
        "run_id", "doc", "run", "pos", truncated(F.col("tool"), MAX["tool"]).alias("tool"), truncated(F.col("rule_id"), MAX["rule_id"]).alias("rule_id"), truncated(F.col("vuln_class"), MAX["vuln_class_hint"]).alias("vuln_class_hint"),
        "file", "line", truncated(text_at(F.col("result"), "$.message.text"), MAX["message"]).alias("message"), flow.alias("codeflow"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """Leads with lead_id: a run's leads counted in the order of (doc, run, pos), so a lead_id names one lead of its run."""
    n = numbered_rows(rows, ["run_id"], [F.col("doc"), F.col("run"), F.col("pos")], "__n")
    return n.select("run_id", "doc", F.concat(F.lit("L"), padded(F.col("__n"), 3)).alias("lead_id"), *[c for c in rows.columns if c not in ("run_id", "doc", "run", "pos")])


def leads(results: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """run_id, doc, lead_id, tool, rule_id, vuln_class_hint, file, line, message, codeflow of kept results."""
    return numbered(lead_rows(results, flows))


def ingest_stats(results: DataFrame) -> DataFrame:
    """run_id, total, kept, dropped_*, unmapped_rules: a row per run."""
    n = lambda c: F.count_if(c).cast("long")
    dropped = [n(F.col("drop") == d).alias(f"dropped_{d}") for d in DROPS]
    return results.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"), n(F.col("drop").isNull()).alias("kept"), *dropped, n(F.col("drop").isNull() & (F.col("vuln_class") == "unknown")).alias("unmapped_rules"))


def assigned(leads_: DataFrame, partitions: DataFrame, allocation: DataFrame) -> DataFrame:
    """Leads with partition_id and gap: null, `lead not analyzed`, or `lead not analyzed (deprioritized)`.

    partitions: run_id, partition_id, file. allocation: run_id, partition_id, allocation.
    """
    owner = partitions.groupBy("run_id", "file").agg(F.min("partition_id").alias("partition_id"))
    x = leads_.join(owner, ["run_id", "file"], "left").join(allocation.select("run_id", "partition_id", "allocation"), ["run_id", "partition_id"], "left")
    gap = F.when(F.col("partition_id").isNull(), NOT_ANALYZED).when(F.coalesce(F.col("allocation") != "analyze", F.lit(True)), NOT_ANALYZED + " (deprioritized)")
    return x.select(*leads_.columns, "partition_id", gap.alias("gap"))


def leads_per_partition(assigned_: DataFrame) -> DataFrame:
    return assigned_.where("partition_id is not null").groupBy("run_id", "partition_id").agg(F.count(F.lit(1)).alias("leads"))
