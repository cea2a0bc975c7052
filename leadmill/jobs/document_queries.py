"""Queries over documents that are read and written: truth files, reports, SARIF and JUnit texts, and the round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadmill.functions.lineage import stored
from leadmill.jobs.tables import ctes, table
from leadmill.jobs.verdict_queries import _review, reviewed
from leadmill.operators import leads as lead_ops
from leadmill.operators import marts, sinks
from leadmill.operators import verdicts as vop
from leadmill.sources import files


def truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth texts, one per set and category, with comments, blanks, short lines, odd cases and repeated ids."""
    t = table(spark, sf_dir, "truth_rows")
    i = F.col("doc_id")
    line = F.concat(
        F.when(i % 9 == 0, F.lit("# ")).otherwise(F.lit("")), F.when(i % 7 == 0, F.lit("  ")).otherwise(F.lit("")), F.when(i % 11 == 0, F.lit("Other1")).otherwise(F.col("test_id")), F.lit(", "), "category", F.lit(","),
        F.when(F.col("is_real"), F.when(i % 2 == 0, F.lit("TRUE")).otherwise(F.lit("true"))).otherwise(F.lit("false")), F.when(i % 13 == 0, F.lit("")).otherwise(F.concat(F.lit(" , "), F.col("cwe").cast("string"))),
    )
    again = F.when(i % 5 == 0, F.concat(F.col("test_id"), F.lit(","), "category", F.lit(",false,1\r\n\n"))).otherwise("")
    both = F.concat(again, line)
    return t.groupBy("run_id", F.col("category").alias("file")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", both.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def parsed_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parse_truth(truth_files(spark, sf_dir))


def junit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviewed(spark, sf_dir, "title")
    return sinks.junit_documents(marts.junit_cases(r.final, r.resolved, r.outcomes, "Medium"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviewed(spark, sf_dir, "title")
    return stored(marts.sarif_results(r.final, r.resolved, r.outcomes))


def sarif_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported documents, whole."""
    results = _results(spark, sf_dir)
    return sinks.sarif_documents(results, marts.sarif_rules(results))


def sarif_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents as rows, as they're written to files: part, place in it, and text."""
    results = _results(spark, sf_dir)
    rows = sinks.sarif_pieces(results, marts.sarif_rules(results))
    at = F.when(F.col("part") == 1, F.row_number().over(Window.partitionBy("run_id", "part").orderBy("place"))).otherwise(0)
    return rows.select("run_id", F.col("part").cast("long").alias("part"), at.cast("long").alias("i"), "value")


def summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all runs: whether they meet their contract, and what's in them."""
    r = reviewed(spark, sf_dir, "partitions")
    runs = r.findings.select("run_id").distinct().select("run_id", F.col("run_id").alias("target"), F.lit("java").alias("stack"), F.lit("2024-01-01").alias("date"), F.lit(None).cast("string").alias("proof_level"))
    parts = r.findings.select("run_id", F.explode("partitions").alias("p")).distinct()
    docs = sinks.summary_documents(
        runs, marts.run_verdict(r.final, r.resolved), marts.severity_counts(r.final, r.resolved), marts.status_counts(r.final), marts.coverage_counts(parts, parts.where("p = 'p1'")), marts.chain_graph(r.resolved, vop.chain_steps(r.batches))
    )
    get = lambda path: F.get_json_object("text", path)
    n = lambda path: F.size(F.from_json(get(path), "array<string>")).cast("long")
    whole = {"critical": "severity_counts.Critical", "low": "severity_counts.Low", "not_requested": "finding_status_counts['not-requested']", "analyzed": "coverage.analyzed", "skipped": "coverage.skipped"}
    return docs.select("run_id", "valid", F.array_join("errors", ",").alias("errors"), get("$.meta.verdict").alias("verdict"), *[get(f"$.{p}").cast("long").alias(k) for k, p in whole.items()], n("$.chains").alias("n_chains"))


def sarif_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported documents read as leads again: run_id, file, line, rule_id and how often, as they went out."""
    results = _results(spark, sf_dir)
    docs = sinks.sarif_documents(results, marts.sarif_rules(results)).select("run_id", F.lit("export").alias("doc"), "text")
    manifest = results.where("file is not null").select("run_id", "file").distinct()
    none = spark.range(0).select(F.lit("").alias("tool"), F.lit(0).alias("pos"), F.lit("").alias("rule"), F.lit("").alias("prefix"), F.lit("").alias("vuln_class"))
    back = lead_ops.lead_rows(lead_ops.resolved_results(docs, manifest, none, "/work/app"))  # no number is asked for
    return back.groupBy("run_id", "file", F.col("line").cast("long").alias("line"), "rule_id").agg(F.count(F.lit(1)).alias("n"))


FINAL_FIELDS = (
    "finding_id", "partition_id", "title", "vuln_class", "source", "sink", "auth", "transformations", "direct_flow", "evidence", "provisional_severity", "confidence", "verification_status", "partitions", "source_finding_ids", "final_severity", "final_confidence",
    "origin", "source_lead_ids",
)

#: Those of them that a review doesn't touch.
MERGED_FIELDS = ("partition_id", "title", "transformations", "direct_flow", "evidence", "partitions", "source_finding_ids", "origin", "source_lead_ids")


def report_chains(resolved: DataFrame) -> DataFrame:
    """Chains with all fields of a report."""
    evidence = F.array(F.struct(F.lit("src/a.java").alias("file"), F.lit(1).alias("line")))
    steps = F.transform("transitions", lambda t: F.struct(t["from"].alias("from"), t["to"].alias("to"), F.lit("calls").alias("how"), evidence.alias("evidence")))
    return resolved.select("run_id", "pos", "chain_id", F.struct("entry_point.file", "entry_point.line", F.lit("/").alias("route"), "entry_point.auth").alias("entry_point"), "finding_ids", steps.alias("transitions"), "final_impact", "severity", "confidence", "verification_status")


def report_verdicts(batches: DataFrame) -> DataFrame:
    """Verdicts with all fields of a report."""
    v = F.col("v")
    ces = F.transform(v["counterexamples"], lambda x: F.struct(F.lit("guarded").alias("hypothesis"), x["checked"].alias("checked"), x["refuted"].alias("refuted")))
    tvs = F.transform(v["transition_verdicts"], lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"), x["verdict"].alias("verdict"), F.lit("seen").alias("justification")))
    rows = batches.select("run_id", F.col("pos").alias("p"), F.posexplode("verdicts").alias("at", "v"))
    return rows.select("run_id", F.struct("p", "at").alias("pos"), *[v[k].alias(k) for k in ("target_type", "target_id", "verdict", "new_severity", "new_confidence", "justification")], ces.alias("counterexamples"), tvs.alias("transition_verdicts"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reviewed(spark, sf_dir)
    f, c, verdicts = r.whole(*MERGED_FIELDS).select("run_id", "number", *FINAL_FIELDS), report_chains(r.resolved), report_verdicts(r.batches)
    runs = r.findings.select("run_id").distinct().select("run_id", F.lit("2024-01-01").alias("generated"), F.array(F.lit("src")).alias("scope"))
    coverage = r.raw.select("run_id", F.col("partition_id").alias("p")).groupBy("run_id").agg(F.array_sort(F.collect_set("p")).alias("analyzed")).withColumn("skipped", F.array().cast("array<struct<path:string,reason:string>>"))
    return sinks.report_documents(runs, coverage, f, c, verdicts)


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all runs: whether they meet their contract, and what's in them."""
    docs = _reports(spark, sf_dir)
    n = lambda path: F.size(F.from_json(F.get_json_object("text", path), "array<string>")).cast("long")
    return docs.select("run_id", "valid", F.array_join("errors", ",").alias("errors"), n("$.findings").alias("n_findings"), n("$.chains").alias("n_chains"), n("$.verdicts").alias("n_verdicts"), n("$.coverage.analyzed").alias("n_analyzed"))


def parsed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a reader finds in reports: one per truth set, with a finding for each labelled document."""
    t = table(spark, sf_dir, "truth_rows")
    i = F.col("doc_id")
    place = F.struct(F.concat(F.lit("src/"), "test_id", F.lit(".java")).alias("file"), i.cast("int").alias("line"))
    finding = F.struct(F.concat(F.lit("F-"), i.cast("string")).alias("finding_id"), place.alias("source"), F.when(i % 3 == 0, "sast-lead").alias("origin"), F.lit("accepted").alias("verification_status"), F.when(i % 2 == 0, True).alias("direct_flow"))
    case = F.struct("test_id", F.lit("analyzed").alias("status"))
    by = t.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(finding))).alias("f"), F.to_json(F.array_sort(F.collect_list(case))).alias("c"))
    text = F.concat(F.lit('{"run":{"run_id":"x","path_map":{"a":"b"}},"coverage":{"benchmark_cases":'), "c", F.lit('},"findings":'), "f", F.lit(',"chains":[],"unknown":1}'))
    cases = files.report_cases(files.parse_reports(by.select("run_id", F.lit("1.json").alias("report_ord"), text.alias("text"))))
    seen = cases.select("run_id", F.size("benchmark_cases").cast("long").alias("n_cases"), F.explode("findings").alias("f"))
    return seen.select("run_id", "n_cases", "f.finding_id", "f.file", "f.origin", "f.direct_flow")


def parsed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts that a reader finds in a verifier's response, one per event; some responses aren't JSON."""
    e = table(spark, sf_dir, "work_rows")
    good = F.concat(F.lit('{"status":"'), F.when(F.col("pos") % 4 == 0, "partial").otherwise("ok"), F.lit('","verdicts":[{"target_type":"finding","target_id":"'), "target_id", F.lit('","verdict":"accepted","counterexamples":[{"checked":true}]}]}'))
    texts = e.select(F.col("pos").cast("string").alias("file"), F.when(F.col("pos") % 7 == 3, F.lit("{oops")).otherwise(good).alias("text"))
    v = files.parse_responses(texts, "verifier")
    first = F.get("verdicts", F.lit(0))
    return v.select("file", "status", first["target_id"].alias("target_id"), first["verdict"].alias("verdict"), F.get(first["counterexamples"], F.lit(0))["checked"].alias("checked"))


def parsed_rule_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of rule maps, a map per part."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit('{"tool-'), (F.col("p_partkey") % 5).cast("string"), F.lit('":[{"rule":"r'), F.col("p_partkey").cast("string"), F.lit('","vuln_class":"a"},{"prefix":"q.","vuln_class":"'), "p_brand", F.lit('"}]}'))
    return files.parse_rule_map(p.select(text.alias("text"))).withColumn("pos", F.col("pos").cast("long"))


def parsed_surface_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token blocks of pages, a stack per web page: some have no block, a broken one, or a name that isn't allowed."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    stack = F.concat(F.when(i % 5 == 0, "Bad ").otherwise("s-"), i.cast("string"))
    block = F.when(i % 7 == 1, "{oops").otherwise(F.concat(F.lit('{"sources": ["t'), i.cast("string"), F.lit('", "b"], "auth_markers": []}')))
    text = F.when(i % 3 == 0, F.lit("no block")).otherwise(F.concat(F.lit("# page\n```surface\n"), block, F.lit("\n```\nmore\n")))
    t = files.parse_surface_tokens(p.select(stack.alias("stack"), text.alias("text")))
    return t.select("stack", F.array_join("sources", ",").alias("sources"), F.size("sinks").cast("long").alias("n_sinks"), F.size("auth_markers").cast("long").alias("n_auth"), "error")


QUERIES = {f.__name__: f for f in (parsed_truth, junit_documents, sarif_documents, sarif_pieces, summary_documents, sarif_round_trip, report_documents, parsed_reports, parsed_responses, parsed_rule_maps, parsed_surface_tokens)}

_SARIF = r""", loc AS (SELECT *, '"physicalLocation":{"artifactLocation":{"uri":"' || file || '"},"region":{"startLine":' || line || '}}' AS here, '"physicalLocation":{"artifactLocation":{"uri":"' || sink_file || '"},"region":{"startLine":' || sink_line || '}}' AS sink FROM results),
        one AS (SELECT run_id, section, key, '{"ruleId":"' || rule_id || '","level":"' || level || '","message":{"text":' || to_json(message)::VARCHAR || '}' || coalesce(',"locations":[{' || here || '}]', '') || coalesce(',"relatedLocations":[{' || sink || ',"message":{"text":"sink"}}]', '')
          || CASE WHEN section = 2 THEN ',"codeFlows":[{"threadFlows":[{"locations":[' || array_to_string(list_transform(string_split(flow, ','), lambda s: '{"location":{"physicalLocation":{"artifactLocation":{"uri":"' || split_part(s, ':', 1) || '"},"region":{"startLine":' || split_part(s, ':', 2) || '}}}}'), ',') || ']}]}]' ELSE '' END
          || coalesce(',"partialFingerprints":{"audit/v1":"' || fingerprint || '"}', '') || CASE WHEN suppressed THEN ',"suppressions":[{"kind":"external","justification":' || to_json(reason)::VARCHAR || '}]' ELSE '' END || coalesce(',"properties":{"lane":"' || lane || '"}', '') || '}' AS j FROM loc),
        head AS (SELECT run_id, string_agg('{"id":"' || rule_id || '","name":"' || rule_id || '","shortDescription":{"text":"' || rule_id || '"},"defaultConfiguration":{"level":"' || level || '"}' || coalesce(',"properties":{"cwe":"' || cwe || '"}', '') || '}', ',' ORDER BY place) AS rules FROM ruled GROUP BY run_id),"""

ORACLE_SQL = {
    "parsed_truth": ctes("truth_rows") + """rows AS (SELECT *, doc_id % 9 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS own, doc_id % 5 = 0 AS again FROM truth_rows)
        SELECT run_id, test_id, category, CASE WHEN own THEN is_real ELSE false END AS is_real, CASE WHEN own THEN cwe ELSE 1 END AS cwe FROM rows WHERE own OR again""",
    "junit_documents": _review(r""", x AS (SELECT *, replace(replace(replace(replace(replace(message, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;') AS m FROM cases)
        SELECT run_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<testsuite name="audit" tests="' || count(*) || '" failures="' || count_if(outcome = 'failure') || '" skipped="' || count_if(outcome = 'skipped') || '">' || chr(10)
        || string_agg('  <testcase classname="' || classname || '" name="' || name || '"' || CASE outcome WHEN 'failure' THEN '>' || chr(10) || '    <failure message="' || m || '">' || body || '</failure>' || chr(10) || '  </testcase>'
          WHEN 'skipped' THEN '>' || chr(10) || '    <skipped message="' || m || '"/>' || chr(10) || '  </testcase>' ELSE '/>' END || chr(10), '' ORDER BY section, length(key), key) || '</testsuite>' || chr(10) AS text FROM x GROUP BY run_id"""),
    "sarif_documents": _review(_SARIF + """ doc AS (SELECT run_id, string_agg(j, ',' ORDER BY section, length(key), key) AS body FROM one GROUP BY run_id)
        SELECT run_id, '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"audit","rules":[' || rules || ']}},"results":[' || body || ']}]}' AS text FROM doc JOIN head USING (run_id)"""),
    "sarif_pieces": _review(_SARIF + """ n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY section, length(key), key) AS i FROM one)
        SELECT run_id, 0::BIGINT AS part, 0::BIGINT AS i, '{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":{"name":"audit","rules":[' || rules || ']}' AS value FROM head
        UNION ALL SELECT run_id, 1, i, CASE WHEN i = 1 THEN ',"results":[' ELSE ',' END || left(j, length(j) - 1) FROM n UNION ALL SELECT run_id, 2, 0, ']}]' FROM head"""),
    "summary_documents": _review(""", c AS (SELECT run_id, count_if(status = 'accepted' AND severity = 'Critical') AS critical, count_if(v IS NOT NULL AND (status <> 'not-requested' OR impact <> 'unauth-rce')) AS n FROM resolved GROUP BY run_id),
        p AS (SELECT run_id, count(DISTINCT partition_id) AS np, max(CASE WHEN partition_id = 'p1' THEN 1 ELSE 0 END) AS p1 FROM flat_findings GROUP BY run_id)
        SELECT run_id, true AS valid, '' AS errors, CASE WHEN coalesce(any_value(critical), 0) > 0 THEN 'unauth-rce' ELSE 'no-critique' END AS verdict, coalesce(any_value(critical), 0)::BIGINT AS critical, count_if(es = 'Low' AND status <> 'rejected')::BIGINT AS low,
        count_if(status = 'not-requested')::BIGINT AS not_requested, any_value(np)::BIGINT AS analyzed, any_value(p1)::BIGINT AS skipped, coalesce(any_value(c.n), 0)::BIGINT AS n_chains FROM shown LEFT JOIN c USING (run_id) LEFT JOIN p USING (run_id) GROUP BY run_id"""),
    "sarif_round_trip": _review("SELECT run_id, file, line::BIGINT AS line, rule_id, count(*) AS n FROM results WHERE file IS NOT NULL GROUP BY ALL"),
    "parsed_reports": ctes("truth_rows") + """n AS (SELECT run_id, count(*) AS n_cases FROM truth_rows GROUP BY run_id)
        SELECT run_id, n_cases, 'F-' || doc_id AS finding_id, 'src/' || test_id || '.java' AS file, CASE WHEN doc_id % 3 = 0 THEN 'sast-lead' END AS origin, CASE WHEN doc_id % 2 = 0 THEN true END AS direct_flow FROM truth_rows JOIN n USING (run_id)""",
    "parsed_responses": ctes("work_rows") + """w AS (SELECT *, pos % 7 <> 3 AS good FROM work_rows) SELECT pos::VARCHAR AS file, CASE WHEN good THEN CASE WHEN pos % 4 = 0 THEN 'partial' ELSE 'ok' END END AS status, CASE WHEN good THEN target_id END AS target_id,
        CASE WHEN good THEN 'accepted' END AS verdict, CASE WHEN good THEN true END AS checked FROM w""",
    "parsed_rule_maps": """SELECT 'tool-' || (p_partkey % 5) AS tool, 0::BIGINT AS pos, 'r' || p_partkey AS rule, NULL AS prefix, 'a' AS vuln_class FROM part UNION ALL SELECT 'tool-' || (p_partkey % 5), 1, NULL, 'q.', p_brand FROM part""",
    "parsed_surface_tokens": """SELECT 's-' || page_id AS stack, CASE WHEN page_id % 7 <> 1 THEN 't' || page_id || ',b' END AS sources, CASE WHEN page_id % 7 <> 1 THEN 0::BIGINT END AS n_sinks, CASE WHEN page_id % 7 <> 1 THEN 0::BIGINT END AS n_auth,
        CASE WHEN page_id % 7 = 1 THEN 'malformed surface block' END AS error FROM pages WHERE page_id % 5 <> 0 AND page_id % 3 <> 0""",
    "report_documents": _review("""SELECT run_id, true AS valid, '' AS errors, count(*) AS n_findings, coalesce(any_value(nc), 0)::BIGINT AS n_chains, coalesce(any_value(nv), 0)::BIGINT AS n_verdicts, any_value(np)::BIGINT AS n_analyzed FROM canon
        LEFT JOIN (SELECT run_id, count(*) AS nc FROM chain GROUP BY run_id) USING (run_id) LEFT JOIN (SELECT run_id, count(v) AS nv FROM verdict GROUP BY run_id) USING (run_id)
        LEFT JOIN (SELECT run_id, count(DISTINCT partition_id) AS np FROM flat_findings GROUP BY run_id) USING (run_id) GROUP BY run_id"""),
}
