"""Readers of the data format's files, all by Spark's own readers, so that any store that Spark reads will do.

Readers that take a path have a twin that takes a frame of texts, for tables that hold the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions.text import decoded

STACK = "^[a-z0-9_-]+$"
#: Fixed value: the fenced block of a stack's page.
_BLOCK = r"(?s)```surface\s*\n(.*?)\n```"
TOKEN_SCHEMA = "struct<sources:array<string>,sinks:array<string>,sanitizers:array<string>,auth_markers:array<string>>"

_FILELINE = "struct<file:string,line:int>"
_LOC = "struct<file:string,line:int,symbol:string,kind:string>"
FINDING = (
    f"struct<finding_id:string,partition_id:string,title:string,vuln_class:string,source:{_LOC},sink:{_LOC},auth:string,transformations:array<struct<file:string,line:int,desc:string>>,direct_flow:boolean,"
    f"sanitizers:array<struct<file:string,line:int,what:string,why_insufficient:string>>,prerequisites:array<string>,evidence:array<{_FILELINE}>,provisional_severity:string,confidence:string,verification_status:string,"
    "partitions:array<string>,source_finding_ids:array<string>,final_severity:string,final_confidence:string,origin:string,source_lead_ids:array<string>>"
)
VERDICT = (
    "struct<target_type:string,target_id:string,verdict:string,new_severity:string,new_confidence:string,justification:string,counterexamples:array<struct<hypothesis:string,checked:boolean,refuted:boolean>>,"
    "transition_verdicts:array<struct<`from`:string,`to`:string,verdict:string>>>"
)
CHAIN = f"struct<chain_id:string,entry_point:struct<file:string,line:int,route:string,auth:string>,finding_ids:array<string>,transitions:array<struct<`from`:string,`to`:string,how:string,evidence:array<{_FILELINE}>>>,final_impact:string,severity:string,confidence:string,verification_status:string>"
_SKIPPED = "array<struct<path:string,reason:string>>"
_LEAD_OUTCOME = f"struct<lead_id:string,outcome:string,finding_id:string,reason:string,test_id:string,location:{_FILELINE}>"
RESPONSES = {
    "analyzer": f"partition_id string, status string, findings array<{FINDING}>, coverage struct<analyzed:array<string>,skipped:{_SKIPPED}>, adjudicated_leads array<{_LEAD_OUTCOME}>",
    "verifier": f"status string, verdicts array<{VERDICT}>",
}
REPORT = (
    "run struct<run_id:string,generated:string,scope:array<string>,benchmark_test_ids:array<string>,path_map:map<string,string>>, "
    f"coverage struct<analyzed:array<string>,skipped:{_SKIPPED},benchmark_cases:array<struct<test_id:string,status:string,reason:string>>>, findings array<{FINDING}>, chains array<{CHAIN}>, verdicts array<{VERDICT}>, lead_adjudications array<{_LEAD_OUTCOME}>"
)


def _folder() -> Column:
    return F.element_at(F.split("_metadata.file_path", "/"), -2)


def read_sarif(spark: SparkSession, path: str, run_id: Column | None = None) -> DataFrame:
    """run_id, doc, text of SARIF files: the run is the file's folder unless told otherwise, the document its name."""
    return spark.read.text(path, wholetext=True).select((_folder() if run_id is None else run_id).alias("run_id"), F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))


def parse_truth(files: DataFrame) -> DataFrame:
    """run_id, test_id, category, is_real, cwe from texts of truth files (run_id, file, text); of a run the last row of an id stays."""
    lines = files.select("run_id", "file", F.posexplode(F.split("text", "\r?\n")).alias("at", "line")).withColumn("line", F.trim("line"))
    lines = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    parts = F.transform(F.split("line", ","), lambda x: F.trim(x))
    rows = lines.select("run_id", "file", "at", parts.alias("p")).where((F.size("p") >= 4) & F.get("p", F.lit(0)).rlike(r"^BenchmarkTest\d{5}$"))
    value = F.struct(F.get("p", F.lit(1)).alias("category"), (F.lower(F.get("p", F.lit(2))) == "true").alias("is_real"), F.nullif(F.regexp_extract(F.get("p", F.lit(3)), r"^([+-]?\d+)", 1), F.lit("")).cast("int").alias("cwe"))
    last = rows.groupBy("run_id", F.get("p", F.lit(0)).alias("test_id")).agg(F.max_by(value, F.struct("file", "at")).alias("v"))
    return last.select("run_id", "test_id", "v.category", "v.is_real", "v.cwe")


def read_truth(spark: SparkSession, path: str, run_id: Column | None = None) -> DataFrame:
    """Truth files: the run is the file's folder unless told otherwise."""
    return parse_truth(spark.read.text(path, wholetext=True).select((_folder() if run_id is None else run_id).alias("run_id"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical reports; report_ord is the file's name, by which "the last report" is meant, run_id its folder."""
    return spark.read.schema(REPORT).json(folder, multiLine=True, pathGlobFilter="*.json").withColumns({"report_ord": F.col("_metadata.file_name"), "run_id": _folder()})


def parse_reports(texts: DataFrame) -> DataFrame:
    """The same from texts: run_id, report_ord, text."""
    return texts.select("run_id", "report_ord", F.from_json("text", REPORT).alias("r")).select("run_id", "report_ord", "r.*")


def report_cases(reports: DataFrame) -> DataFrame:
    """Reports in the shape that the scoring operators take."""
    finding = lambda f: F.struct(f["finding_id"].alias("finding_id"), f["source"]["file"].alias("file"), f["vuln_class"].alias("vuln_class"), f["origin"].alias("origin"), f["verification_status"].alias("verification_status"), f["final_severity"].alias("final_severity"), f["source_finding_ids"].alias("source_finding_ids"), f["transformations"].alias("transformations"), f["direct_flow"].alias("direct_flow"))
    chain = lambda c: F.struct(c["entry_point"]["file"].alias("file"), c["final_impact"].alias("final_impact"), c["verification_status"].alias("verification_status"), c["severity"].alias("severity"), c["finding_ids"].alias("finding_ids"))
    lead = lambda a: F.struct(a["test_id"].alias("test_id"), a["location"]["file"].alias("file"), a["outcome"].alias("outcome"), a["finding_id"].alias("finding_id"))
    return reports.select(
        "run_id", "report_ord", F.col("run.path_map").alias("path_map"), F.col("coverage.benchmark_cases").alias("benchmark_cases"), F.transform("findings", finding).alias("findings"), "verdicts", F.transform("chains", chain).alias("chains"),
        F.transform("lead_adjudications", lead).alias("lead_adjudications"),
    )


def read_responses(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Response envelopes of analyzers or verifiers, one file each, with the file's name."""
    return spark.read.schema(RESPONSES[kind]).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))


def parse_responses(texts: DataFrame, kind: str) -> DataFrame:
    """The same from texts: file, text."""
    return texts.select("file", F.from_json("text", RESPONSES[kind]).alias("r")).select("r.*", "file")


def read_source_tree(spark: SparkSession, root: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """path (below the root), content and digest of source files, whatever their encoding; a row per file.

    content is the bytes' text as UTF-8, bad sequences replaced by U+FFFD; digest is the SHA-256 of the bytes themselves. Both are null for files
    beyond `most_bytes`, if given, whose bytes aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = F.lit(root.split("://")[-1].split(":")[-1].rstrip("/") + "/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), F.concat(F.lit("^.*?"), F.regexp_replace(base, r"([\\.\[\]{}()*+?^$|])", r"\\$1")), "").alias("path")
    read = lambda x: x.select(below, decoded(F.col("content")).alias("content"), F.sha2("content", 256).alias("digest"))
    if most_bytes is None:
        return read(files)
    null = F.lit(None).cast("string")
    return read(files.where(F.col("length") <= most_bytes)).union(files.where(F.col("length") > most_bytes).select(below, null, null))


def parse_surface_tokens(pages: DataFrame) -> DataFrame:
    """stack, sources, sinks, sanitizers, auth_markers, error from pages (stack, text).

    Only stacks with a valid name and a block are supported; a block that isn't such JSON gives error and null tokens.
    """
    block = F.nullif(F.regexp_extract("text", _BLOCK, 1), F.lit(""))
    x = pages.where(F.col("stack").rlike(STACK)).select("stack", block.alias("block")).where("block is not null")
    t = F.from_json("block", TOKEN_SCHEMA)
    empty = F.array().cast("array<string>")
    bad = F.try_parse_json("block").isNull()
    return x.select("stack", *[F.when(~bad, F.coalesce(t[c], empty)).alias(c) for c in ("sources", "sinks", "sanitizers", "auth_markers")], F.when(bad, "malformed surface block").alias("error"))


def read_surface_tokens(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("stack"), F.col("value").alias("text"))
    return parse_surface_tokens(pages)


def parse_rule_map(texts: DataFrame) -> DataFrame:
    """tool, pos, rule, prefix, vuln_class from texts that hold the map of tools to ordered entries."""
    maps = texts.select(F.explode(F.from_json("text", "map<string,array<struct<rule:string,prefix:string,vuln_class:string>>>")).alias("tool", "entries"))
    return maps.select("tool", F.posexplode("entries").alias("pos", "e")).select("tool", "pos", "e.rule", "e.prefix", "e.vuln_class")


def read_rule_map(spark: SparkSession, path: str) -> DataFrame:
    return parse_rule_map(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))
