"""Queries over SARIF documents: errors, resolved results, leads, statistics and assignment to partitions.

A page gives a document with one run and up to three results, written as JSON text by the same rule in every engine; a run has 40 pages.
Lines, rule ids and messages come in several JSON types, not all of them the right one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions.lineage import settled
from leadmill.jobs.tables import ctes, table
from leadmill.operators import leads as op

ROOT = "/work/app"
RULES = (("semgrep", 0, None, "java.sqli", "sqli"), ("semgrep", 1, "java.xss", None, "xss"), ("semgrep", 2, None, "java.", "java-other"), ("code-tool-2", 0, "idx.rule", None, "weak-hashing"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sarif_rows")
    place = lambda uri, line: F.concat(F.lit('{"physicalLocation":{"artifactLocation":{"uri":"'), uri, F.lit('"},"region":{"startLine":'), line.cast("string"), F.lit("}}}"))
    # Every second relative location names its folder by a base id.
    uri = F.when(F.col("doc_pos") % 14 == 0, F.concat(F.regexp_replace("uri", "^src/", ""), F.lit('","uriBaseId":"SRC'))).otherwise(F.col("uri"))
    form = lambda name, texts, other: reduce(lambda a, x: a.when(F.col(name) == x[0], x[1]), texts.items(), F.when(F.lit(False), "")).otherwise(other)
    rule = F.when(F.col("rule_id").isNotNull(), F.concat(F.lit('"ruleId":"'), "rule_id", F.lit('",'))).otherwise(F.lit('"rule":{"index":0},'))
    rule = form("rule_form", {2: '"ruleId":7,"rule":{"id":"java.xss"},', 7: '"ruleId":["x"],"rule":{"id":true,"index":0.0},', 13: '"ruleId":null,"rule":5,'}, rule)
    message = form("message_form", {4: '"message":{"text":41},', 7: '"message":"plain",'}, F.concat(F.lit('"message":{"text":"'), "message", F.lit('"},')))

    def written(n: Column) -> Column:
        """A line number in several forms, some of which aren't whole numbers."""
        digits = n.cast("string")
        forms = {1: F.concat(digits, F.lit(".0")), 3: F.concat(digits, F.lit("e1")), 5: (n + 9999999990).cast("string"), 7: F.concat(digits, F.lit(".5")), 9: F.concat(F.lit('"'), digits, F.lit('"')), 11: F.lit("true"), 13: F.lit("null")}
        return F.when(F.col("line") == 0, "0").otherwise(form("line_form", forms, digits))

    step = lambda uri, line: F.concat(F.lit('{"location":'), place(uri, line), F.lit("}"))
    flow = F.when(
        F.col("doc_pos") % 5 == 0,
        F.concat(F.lit('"codeFlows":[{"threadFlows":[{"locations":['), step(F.lit("src/f1.java"), F.lit(1)), F.lit(","), step(F.lit("src/gone.java"), F.lit(2)), F.lit(","), step(F.lit("src/f2.java"), F.lit(3)), F.lit("]}]}],")),
    ).otherwise("")
    one = lambda k: F.concat(F.lit("{"), rule, flow, message, F.lit('"locations":['), place(uri, written(F.col("line") + k)), F.lit("]}"))
    results = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_more").cast("int")), one), ",")
    version = F.when(F.col("doc_pos") % 13 == 5, "2.0.0").otherwise("2.1.0")
    whole = F.concat(F.lit('{"version":"'), version, F.lit('","runs":[{"tool":{"driver":{"name":"'), "tool", F.lit('","rules":[{"id":"idx.rule"}]}},"originalUriBaseIds":{"SRC":{"uri":"src/"}},"results":['), results, F.lit("]}]}"))
    text = F.when(F.col("doc_pos") % 17 == 6, "not json {").when(F.col("doc_pos") % 19 == 7, '{"version":"2.1.0"}').otherwise(whole)
    return rows.select("run_id", F.col("doc_pos").alias("doc"), text.alias("text"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src/f0.java to src/f8.java in each run."""
    names = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.concat(F.lit("src/f"), i.cast("string"), F.lit(".java")))
    return table(spark, sf_dir, "sarif_rows").select("run_id").distinct().select("run_id", F.explode(names).alias("file"))


def rule_map(spark: SparkSession) -> DataFrame:
    rows = [F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in zip(("tool", "pos", "rule", "prefix", "vuln_class"), r, ("string", "int", "string", "string", "string"), strict=True)]) for r in RULES]
    return spark.range(1).select(F.inline(F.array(*rows)))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(op.resolved_results(documents(spark, sf_dir), manifest(spark, sf_dir), rule_map(spark), ROOT))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results(spark, sf_dir)
    return op.leads(r, op.codeflows(r, manifest(spark, sf_dir), ROOT))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files f0 to f5 are in two partitions, of which the second isn't analyzed."""
    n = F.regexp_extract("file", r"f(\d)", 1).cast("int")
    parts = manifest(spark, sf_dir).where(n < 6).select("run_id", F.concat(F.lit("part-"), (n % 2).cast("string")).alias("partition_id"), "file")
    allocation = parts.select("run_id", "partition_id").distinct().withColumn("allocation", F.when(F.col("partition_id") == "part-0", "analyze").otherwise("deprioritized"))
    return op.assigned(leads(spark, sf_dir), parts, allocation)


def sarif_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.document_errors(documents(spark, sf_dir))


def sarif_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("run_id", "doc", F.col("pos").cast("long").alias("pos"), "tool", "rule_id", "vuln_class", "file", F.col("line").cast("long").alias("line"), "drop")


def sarif_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = F.array_join(F.transform("codeflow", lambda s: F.concat_ws(":", s["file"], s["line"])), ",")
    return leads(spark, sf_dir).select("run_id", "doc", "lead_id", "tool", "rule_id", "vuln_class_hint", "file", F.col("line").cast("long").alias("line"), "message", flow.alias("codeflow"))


def sarif_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.ingest_stats(results(spark, sf_dir))


def lead_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned(spark, sf_dir).select("run_id", "doc", "lead_id", "partition_id", "gap")


def lead_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.leads_per_partition(assigned(spark, sf_dir))


QUERIES = {f.__name__: f for f in (sarif_errors, sarif_locations, sarif_leads, sarif_stats, lead_assignment, lead_counts)}

_LEADS = """
good AS (SELECT * FROM sarif_rows WHERE doc_pos % 13 <> 5 AND doc_pos % 17 <> 6 AND doc_pos % 19 <> 7),
res AS (SELECT run_id, doc_pos AS doc, unnest(range(0, n_more + 1)) AS pos, CASE tool WHEN 'Semgrep OSS' THEN 'semgrep' WHEN 'Code Tool 2' THEN 'code-tool-2' ELSE 'unknown' END AS tool, CASE rule_form WHEN 2 THEN 'java.xss' WHEN 7 THEN 'idx.rule' WHEN 13 THEN 'unknown' ELSE coalesce(rule_id, 'idx.rule') END AS rule_id, line AS l0, line_form, CASE WHEN message_form IN (4, 7) THEN '' ELSE message END AS message, 'src/f' || (doc_pos % 10) || '.java' AS own FROM good),
loc AS (SELECT *, CASE WHEN l0 = 0 THEN 0 WHEN line_form IN (7, 9, 11, 13) THEN NULL ELSE (l0 + pos) * CASE line_form WHEN 3 THEN 10 ELSE 1 END + CASE line_form WHEN 5 THEN 9999999990 ELSE 0 END END AS line, CASE WHEN l0 = 0 OR line_form IN (7, 9, 11, 13) THEN 'bad_location' WHEN doc % 7 IN (1, 5) THEN 'bad_uri' WHEN doc % 7 = 3 THEN 'out_of_scope' WHEN doc % 7 = 4 OR doc % 10 = 9 THEN 'missing' END AS drop_,
  CASE WHEN tool = 'semgrep' AND rule_id LIKE 'java.sqli%' THEN 'sqli' WHEN tool = 'semgrep' AND rule_id = 'java.xss' THEN 'xss' WHEN tool = 'semgrep' AND rule_id LIKE 'java.%' THEN 'java-other' WHEN tool = 'code-tool-2' AND rule_id = 'idx.rule' THEN 'weak-hashing' ELSE 'unknown' END AS vuln_class FROM res),
lead_ AS (SELECT *, printf('L%03d', row_number() OVER (PARTITION BY run_id ORDER BY doc, pos)) AS lead_id, own AS file, CASE WHEN doc % 5 = 0 THEN 'src/f1.java:1,src/f2.java:3' END AS codeflow, doc % 10 AS f FROM loc WHERE drop_ IS NULL),
asg AS (SELECT *, CASE WHEN f < 6 THEN 'part-' || (f % 2) END AS partition_id, CASE WHEN f >= 6 THEN 'lead not analyzed' WHEN f % 2 = 1 THEN 'lead not analyzed (deprioritized)' END AS gap FROM lead_)
"""


def _leads(select: str) -> str:
    return ctes("sarif_rows") + _LEADS.strip() + " " + select


ORACLE_SQL = {
    "sarif_errors": _leads("""SELECT run_id, doc_pos AS doc, CASE WHEN doc_pos % 17 = 6 THEN 'malformed SARIF: not JSON' WHEN doc_pos % 19 = 7 THEN 'malformed SARIF: missing runs[]' ELSE 'unsupported SARIF version' END AS error FROM sarif_rows
        WHERE doc_pos % 13 = 5 OR doc_pos % 17 = 6 OR doc_pos % 19 = 7"""),
    "sarif_locations": _leads('SELECT run_id, doc, pos, tool, rule_id, vuln_class, CASE WHEN drop_ IS NULL THEN own END AS file, line::BIGINT AS line, drop_ AS "drop" FROM loc'),
    "sarif_leads": _leads("SELECT run_id, doc, lead_id, tool, rule_id, vuln_class AS vuln_class_hint, file, line::BIGINT AS line, message, codeflow FROM lead_"),
    "sarif_stats": _leads("""SELECT run_id, count(*) AS total, count(*) FILTER (drop_ IS NULL) AS kept, count(*) FILTER (drop_ = 'out_of_scope') AS dropped_out_of_scope, count(*) FILTER (drop_ = 'missing') AS dropped_missing, count(*) FILTER (drop_ = 'bad_uri') AS dropped_bad_uri,
        count(*) FILTER (drop_ = 'bad_location') AS dropped_bad_location, count(*) FILTER (drop_ IS NULL AND vuln_class = 'unknown') AS unmapped_rules FROM loc GROUP BY ALL"""),
    "lead_assignment": _leads("SELECT run_id, doc, lead_id, partition_id, gap FROM asg"),
    "lead_counts": _leads("SELECT run_id, partition_id, count(*) AS leads FROM asg WHERE partition_id IS NOT NULL GROUP BY ALL"),
}
