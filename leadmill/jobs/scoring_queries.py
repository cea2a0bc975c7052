"""Queries that score tools and reviews against labelled truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions.lineage import settled
from leadmill.jobs.tables import ctes, table
from leadmill.jobs.verdict_queries import _review, reviewed
from leadmill.operators import scoring as op


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "truth_rows")


def tool_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARIF texts of a made-up tool, two per truth set: a result for each labelled document that it flags, and a second run that doesn't count."""
    rows = truth(spark, sf_dir).where("doc_id % 3 <> 1")
    i = F.col("doc_id")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    rule_id = F.concat(F.lit("rule-"), "category", F.lit("-"), (i % 10).cast("string"))
    tag = F.when(i % 5 == 0, F.lit("security")).otherwise(F.concat(F.lit("CWE-"), F.when(i % 2 == 0, F.col("cwe")).otherwise(F.lit(327)).cast("string"), F.lit(": text")))
    uri = F.concat(F.lit("src/"), F.when(i % 10 == 9, F.lit("other")).otherwise(F.col("test_id")), F.lit(".java"))
    result = text('{"ruleId":"', rule_id, '","locations":[{"physicalLocation":{"artifactLocation":{"uri":"', uri, '"}}}]}')
    doc = (i % 2).cast("string")
    tags = rows.groupBy("run_id", doc.alias("doc"), rule_id.alias("rule_id")).agg(F.array_sort(F.collect_set(tag)).alias("t"))
    rule = text('{"id":"', F.col("rule_id"), '","properties":{"tags":', F.to_json("t"), "}}")
    rules = tags.groupBy("run_id", "doc").agg(F.array_join(F.array_sort(F.collect_list(rule)), ",").alias("rules"))
    results = rows.groupBy("run_id", doc.alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(result)), ",").alias("results"))
    run = lambda rules, results: text('{"tool":{"driver":{"name":"t","rules":[', rules, ']}},"results":[', results, "]}")
    late = run('{"id":"late","properties":{"tags":["CWE-1"]}}', '{"ruleId":"late","locations":[{"physicalLocation":{"artifactLocation":{"uri":"BenchmarkTest00001.java"}}}]}')
    both = results.join(rules, ["run_id", "doc"])
    return both.select("run_id", "doc", text('{"version":"2.1.0","runs":[', run(F.col("rules"), F.col("results")), ",", late, "]}").alias("text"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = settled(tool_documents(spark, sf_dir))
    return op.flagged_by_case(op.tool_results(docs), op.rule_cwes(op.tool_rules(docs)))


def rule_cwes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rule_cwes(op.tool_rules(tool_documents(spark, sf_dir))).select("run_id", "doc", "rule_id", F.array_join("cwes", ",").alias("cwes"))


def flagged_by_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).select("run_id", "test_id", F.array_join("cwes", ",").alias("cwes"))


def flagged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases of the truth, and whether they're in the subset of four of each kind."""
    t = truth(spark, sf_dir)
    flagged = settled(_flagged(spark, sf_dir))
    own = op.flagged_cases(t, flagged, op.stratified_subset(t)).select("run_id", "test_id", F.lit(True).alias("in_subset"))
    return op.flagged_cases(t, flagged).join(own, ["run_id", "test_id"], "left").select("run_id", "test_id", "flagged", "cwe", F.coalesce("in_subset", F.lit(False)).alias("in_subset"))


def stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stratified_subset(truth(spark, sf_dir))


def staged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = op.staged_results(op.tool_results(tool_documents(spark, sf_dir)), op.stratified_subset(truth(spark, sf_dir)), "stage/src")
    return staged.select("run_id", "doc", "test_id", "uri", "rule_id")


def raw_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = truth(spark, sf_dir)
    cases = op.flagged_cases(t, _flagged(spark, sf_dir))
    return op.confusion(cases.join(t.select("run_id", "test_id", "is_real"), ["run_id", "test_id"]), "flagged", "is_real")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.joined(table(spark, sf_dir, "ledger_rows"), truth(spark, sf_dir))


def three_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.three_matrices(_rows(spark, sf_dir))


def matrices_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.matrices_by_category(_rows(spark, sf_dir))


def exclusions_and_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exclusions_and_deltas(_rows(spark, sf_dir))


def cwe_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cwe_mismatches(_rows(spark, sf_dir))


def quality_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.quality_rates(_rows(spark, sf_dir))


def attempted_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.attempted_per_category(_rows(spark, sf_dir))


def least_attempted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.least_attempted(_rows(spark, sf_dir))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per truth set, language and half of its labelled documents, made from their numbers."""
    t = truth(spark, sf_dir)
    i = F.col("doc_id")
    fid = F.concat(F.lit("F-"), i.cast("string"))
    path = F.when(i % 4 == 0, F.concat(F.lit("app/f"), i.cast("string"), F.lit(".java"))).otherwise(F.concat(F.lit("src/"), "test_id", F.lit(".java")))
    status = F.when(i % 7 == 0, "rejected").otherwise("accepted")
    ces = F.when(i % 6 == 0, F.array().cast("array<struct<checked:boolean,refuted:boolean>>")).otherwise(F.array(F.struct(F.lit(True).alias("checked"), (i % 8 != 0).alias("refuted"))))
    finding = F.struct(
        fid.alias("finding_id"), path.alias("file"), F.when(i % 9 == 0, "trust-boundary").otherwise("sqli").alias("vuln_class"), F.when(i % 5 == 0, "llm-discovered").otherwise("sast-lead").alias("origin"), status.alias("verification_status"),
        F.when(i % 3 == 0, "High").otherwise("Low").alias("final_severity"), F.array(F.concat(F.lit("p1-"), fid)).alias("source_finding_ids"), F.when(i % 2 == 0, F.array(F.lit("step"))).otherwise(F.array().cast("array<string>")).alias("transformations"), F.when(i % 10 == 1, True).alias("direct_flow"),
    )
    chain = F.struct(path.alias("file"), F.when(i % 2 == 0, "unauth-rce").otherwise("other").alias("final_impact"), status.alias("verification_status"), F.when(i % 4 < 2, "Critical").otherwise("High").alias("severity"), F.array(fid).alias("finding_ids"))
    adjudication = F.struct(F.when(i % 5 == 1, F.col("test_id")).alias("test_id"), path.alias("file"), F.when(i % 3 == 0, "refuted").when(i % 3 == 1, "promoted").otherwise("inconclusive").alias("outcome"), F.when(i % 2 == 0, fid).otherwise(F.concat(F.lit("p1-"), fid)).alias("finding_id"))
    verdict = F.struct(F.lit("finding").alias("target_type"), fid.alias("target_id"), ces.alias("counterexamples"))
    case = F.struct("test_id", F.when(i % 13 == 0, "skipped").otherwise("analyzed").alias("status"))
    listed = lambda c, cond=None: F.transform(F.array_sort(F.collect_list(F.when(F.lit(True) if cond is None else cond, F.struct(i.alias("o"), c.alias("x"))))), lambda s: s["x"])
    key = F.concat_ws("-", "category", (i % 2).cast("string"))
    return t.groupBy("run_id", key.alias("report_ord")).agg(
        F.map_from_entries(F.collect_list(F.when(i % 4 == 0, F.struct(path, F.col("test_id"))))).alias("path_map"), listed(case, i % 3 != 2).alias("benchmark_cases"), listed(finding).alias("findings"),
        listed(verdict).alias("verdicts"), listed(chain, i % 5 == 0).alias("chains"), listed(adjudication, i % 4 != 3).alias("lead_adjudications"),
    )


def case_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.case_coverage(reports(spark, sf_dir))


def case_finding_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.case_finding_counters(reports(spark, sf_dir))


def case_chain_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.case_chain_counters(reports(spark, sf_dir))


def case_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.case_adjudication(reports(spark, sf_dir))


def adjudication_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.adjudication_map(reports(spark, sf_dir))


def built_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = op.flagged_cases(truth(spark, sf_dir), _flagged(spark, sf_dir))
    return op.build_ledger(cases, op.adjudication_map(reports(spark, sf_dir)))


def ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "ledger_rows")
    i = F.col("doc_id")
    rows = rows.withColumn("adjudication", F.when(i % 40 == 1, "odd").when(i % 40 == 2, "no-lead").otherwise(F.col("adjudication"))).withColumn("test_id", F.when(i % 50 == 3, "Test").otherwise(F.col("test_id")))
    rows = rows.withColumn("covered", F.when(i % 60 == 4, ~F.col("covered")).otherwise(F.col("covered")))
    return op.ledger_violations(rows.withColumn("pos", i), truth(spark, sf_dir)).select("run_id", "pos", "test_id", F.col("step").cast("long").alias("step"), "violation")


def real_app_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical findings against documented ones: every finding with n % 3 = 0, some under another class or file."""
    r = reviewed(spark, sf_dir)
    n = F.col("number")
    documented = r.findings.where("number % 3 = 0").select("run_id", F.concat(F.lit("V-"), n.cast("string")).alias("id"), F.when(n % 2 == 0, "injection").otherwise(F.col("vuln_class")).alias("vuln_class"), F.when(n % 9 == 0, "src/none.java").otherwise(F.col("source.file")).alias("file"))
    analyzed = r.findings.select("run_id", F.col("source.file").alias("file")).distinct()
    same = spark.range(1).select(F.explode(F.array(F.lit("sqli"), F.lit("command-injection"))).alias("vuln_class"), F.lit("injection").alias("documented_class"))
    return op.score_real_app(r.final, r.chains, analyzed, documented, same)


QUERIES = {
    f.__name__: f
    for f in (
        rule_cwes, flagged_by_case, flagged_cases, stratified_subset, staged_results, raw_confusion, three_matrices, matrices_by_category, exclusions_and_deltas, cwe_mismatches, quality_rates, attempted_per_category,
        least_attempted, case_coverage, case_finding_counters, case_chain_counters, case_adjudication, adjudication_map, built_ledger, ledger_violations, real_app_score,
    )
}

_TOOL = """
res AS (SELECT run_id, (doc_id % 2)::VARCHAR AS doc, 'src/' || CASE WHEN doc_id % 10 = 9 THEN 'other' ELSE test_id END || '.java' AS uri, 'rule-' || category || '-' || (doc_id % 10) AS rule_id,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN cwe ELSE 327 END AS cwe FROM truth_rows WHERE doc_id % 3 <> 1),
rules AS (SELECT run_id, doc, rule_id, coalesce(list_sort(list(DISTINCT cwe) FILTER (cwe IS NOT NULL)), []) AS cwes FROM res GROUP BY ALL),
hits AS (SELECT run_id, doc, regexp_extract(uri, 'BenchmarkTest\\d{5}') AS test_id, rule_id, cwes FROM res JOIN rules USING (run_id, doc, rule_id) WHERE uri LIKE '%BenchmarkTest%'),
flagged AS (SELECT run_id, test_id, list_sort(list_distinct(flatten(list(cwes)))) AS cwes FROM hits GROUP BY run_id, test_id),
sub AS (SELECT run_id, test_id, category, is_real, row_number() OVER (PARTITION BY run_id, category, is_real ORDER BY test_id) AS nth FROM truth_rows),
cases AS (SELECT run_id, test_id, t.is_real, cwe, nth <= 4 AS in_subset, coalesce(CASE WHEN cwe IN (326, 327) THEN list_has_any(cwes, [326, 327]) ELSE list_contains(cwes, cwe) END, false) AS flagged
  FROM truth_rows t JOIN sub USING (run_id, test_id) LEFT JOIN flagged USING (run_id, test_id))
"""

_MATRIX = """count_if(w AND p AND r)::BIGINT AS tp, count_if(w AND p AND NOT r)::BIGINT AS fp, count_if(w AND NOT p AND r)::BIGINT AS fn, count_if(w AND NOT p AND NOT r)::BIGINT AS tn"""
_RATIOS = """tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall, coalesce(fp / nullif(fp + tn, 0), 0)::DOUBLE AS fpr,
  (coalesce(tp / nullif(tp + fn, 0), 0) - coalesce(fp / nullif(fp + tn, 0), 0))::DOUBLE AS youden"""
_LONG = """
lr AS (SELECT l.*, t.cwe AS true_cwe, l.flagged AND adjudication IN ('promoted', 'refuted') AS settled, NOT flagged AND covered AS alone FROM ledger_rows l JOIN truth_rows t USING (run_id, test_id)),
long AS (SELECT run_id, category, is_real AS r, 'raw' AS matrix, true AS w, flagged AS p FROM lr UNION ALL SELECT run_id, category, is_real, 'adjudicated', settled, adjudication = 'promoted' FROM lr
  UNION ALL SELECT run_id, category, is_real, 'hybrid', settled OR alone, CASE WHEN flagged THEN adjudication = 'promoted' ELSE independent END FROM lr)
"""

#: What the reports say, straight from the labelled documents. Each is in one report only, so "the last wins" is no choice here.
_REPORTS = """
rep AS (SELECT *, doc_id % 7 = 0 AS rejected, doc_id % 2 = 0 OR doc_id % 10 = 1 AS proof FROM truth_rows),
cov AS (SELECT run_id, test_id, doc_id % 13 <> 0 AS ok FROM rep WHERE doc_id % 3 <> 2),
fc AS (SELECT run_id, test_id, doc_id % 5 = 0 AS independent, (NOT rejected AND doc_id % 3 = 0)::BIGINT AS h, (NOT rejected AND doc_id % 3 = 0 AND proof)::BIGINT AS ph, (NOT rejected AND doc_id % 3 = 0 AND doc_id % 6 <> 0 AND doc_id % 8 <> 0)::BIGINT AS ch, (NOT rejected AND doc_id % 9 = 0)::BIGINT AS hy FROM rep),
cc AS (SELECT run_id, test_id, NOT rejected AND doc_id % 2 = 0 AS rce, (NOT rejected AND doc_id % 4 < 2)::BIGINT AS c, (NOT rejected AND doc_id % 4 < 2 AND proof)::BIGINT AS pc FROM rep WHERE doc_id % 5 = 0),
ad AS (SELECT run_id, test_id, CASE WHEN doc_id % 3 = 0 THEN 'refuted' WHEN doc_id % 3 = 1 THEN CASE WHEN rejected THEN 'refuted' ELSE 'promoted' END ELSE 'inconclusive' END AS adjudication FROM rep WHERE doc_id % 4 <> 3),
amap AS (SELECT run_id, test_id, coalesce(ok, false) AS attempted, coalesce(ok, false) AS covered, independent, coalesce(rce, false) AS chain_reached_rce, h AS accepted_high_findings, ph AS proof_complete_high_findings, ch AS ce_resolved_high_findings,
  coalesce(c, 0) AS accepted_critical_chains, coalesce(pc, 0) AS proof_complete_critical_chains, hy AS hygiene_findings, adjudication FROM rep LEFT JOIN cov USING (run_id, test_id) LEFT JOIN fc USING (run_id, test_id) LEFT JOIN cc USING (run_id, test_id) LEFT JOIN ad USING (run_id, test_id))
"""

_SPOILT = """
lv AS (SELECT run_id, doc_id AS pos, CASE WHEN doc_id % 50 = 3 THEN 'Test' ELSE test_id END AS test_id, flagged AS f, CASE WHEN doc_id % 60 = 4 THEN NOT covered ELSE covered END AS c,
  CASE WHEN doc_id % 40 = 1 THEN 'odd' WHEN doc_id % 40 = 2 THEN 'no-lead' ELSE adjudication END AS a FROM ledger_rows),
lw AS (SELECT *, row_number() OVER (PARTITION BY run_id, test_id ORDER BY pos) AS nth, (run_id, test_id) IN (SELECT (run_id, test_id) FROM truth_rows) AS known FROM lv)
"""


def _tool(select: str) -> str:
    return ctes("truth_rows") + _TOOL.strip() + " " + select


def _long(select: str) -> str:
    return ctes("ledger_rows") + _LONG.strip() + " " + select


def _reports(select: str) -> str:
    return ctes("truth_rows") + _REPORTS.strip() + " " + select


ORACLE_SQL = {
    "rule_cwes": _tool("SELECT run_id, doc, rule_id, array_to_string(cwes, ',') AS cwes FROM rules"),
    "flagged_by_case": _tool("SELECT run_id, test_id, array_to_string(cwes, ',') AS cwes FROM flagged"),
    "flagged_cases": _tool("SELECT run_id, test_id, flagged, cwe, in_subset FROM cases"),
    "stratified_subset": _tool("SELECT run_id, test_id, category, is_real FROM sub WHERE nth <= 4"),
    "staged_results": _tool("SELECT run_id, doc, test_id, 'stage/src/' || test_id || '.java' AS uri, rule_id FROM hits JOIN sub USING (run_id, test_id) WHERE nth <= 4"),
    "raw_confusion": _tool(f", n AS (SELECT run_id, {_MATRIX} FROM (SELECT run_id, true AS w, flagged AS p, is_real AS r FROM cases) GROUP BY run_id), x AS (SELECT run_id, {_RATIOS} FROM n) SELECT run_id, tp, fp, fn, tn, round(precision, 3) AS precision, round(recall, 3) AS recall, round(fpr, 3) AS fpr, round(youden, 3) AS youden FROM x"),
    "three_matrices": _long(f", n AS (SELECT run_id, matrix, {_MATRIX} FROM long GROUP BY run_id, matrix) SELECT run_id, matrix, {_RATIOS} FROM n"),
    "matrices_by_category": _long(f", n AS (SELECT run_id, category, matrix, {_MATRIX} FROM long GROUP BY GROUPING SETS ((run_id, category, matrix), (run_id, matrix))) SELECT run_id, category, matrix, {_RATIOS} FROM n"),
    "exclusions_and_deltas": _long("""SELECT run_id, count_if(flagged AND adjudication = 'inconclusive')::BIGINT AS excluded_inconclusive, count_if(flagged AND adjudication NOT IN ('promoted', 'refuted', 'inconclusive'))::BIGINT AS excluded_not_analyzed,
        count_if(NOT flagged AND NOT covered)::BIGINT AS excluded_not_covered, count_if(settled AND adjudication = 'refuted' AND NOT is_real)::BIGINT AS fp_refuted, count_if(settled AND adjudication = 'refuted' AND is_real)::BIGINT AS recall_cost, count_if(alone AND is_real AND independent)::BIGINT AS fn_recovered FROM lr GROUP BY run_id"""),
    "cwe_mismatches": _long("SELECT run_id, count_if(is_real AND cwe <> true_cwe)::BIGINT AS cwe_mismatches FROM lr GROUP BY run_id"),
    "quality_rates": _long(""", q AS (SELECT *, is_real AND attempted AND NOT CASE WHEN flagged THEN adjudication = 'promoted' ELSE independent END AS lost FROM lr)
        SELECT run_id, (sum(proof_complete_high_findings) / nullif(sum(accepted_high_findings), 0))::DOUBLE AS finding_proof_complete_rate, (sum(proof_complete_critical_chains) / nullif(sum(accepted_critical_chains), 0))::DOUBLE AS chain_proof_complete_rate,
        (sum(ce_resolved_high_findings) / nullif(sum(accepted_high_findings), 0))::DOUBLE AS ce_resolved_rate, (count_if(is_real AND independent) / nullif(count_if(is_real), 0))::DOUBLE AS independent_discovery_rate,
        (count_if(is_real AND attempted) / nullif(count_if(is_real), 0))::DOUBLE AS attempted_real_share, count_if(lost)::BIGINT AS real_not_found, count_if(lost AND covered)::BIGINT AS covered_fn, count_if(lost AND NOT covered)::BIGINT AS structural_fn,
        (count_if(lost AND NOT covered) / nullif(count_if(lost), 0))::DOUBLE AS structural_fn_share, sum(hygiene_findings)::BIGINT AS hygiene_findings FROM q GROUP BY run_id"""),
    "attempted_per_category": _long("SELECT run_id, category, count_if(attempted)::BIGINT AS attempted FROM lr WHERE is_real GROUP BY run_id, category"),
    "least_attempted": _long("SELECT run_id, min(n)::BIGINT AS min_attempted_per_category FROM (SELECT run_id, category, count_if(attempted) AS n FROM lr WHERE is_real GROUP BY run_id, category) GROUP BY run_id"),
    "case_coverage": _reports("SELECT run_id, test_id, ok AS attempted, ok AS covered FROM cov"),
    "case_finding_counters": _reports("SELECT run_id, test_id, independent, h AS accepted_high_findings, ph AS proof_complete_high_findings, ch AS ce_resolved_high_findings, hy AS hygiene_findings FROM fc"),
    "case_chain_counters": _reports("SELECT run_id, test_id, rce AS chain_reached_rce, c AS accepted_critical_chains, pc AS proof_complete_critical_chains FROM cc"),
    "case_adjudication": _reports("SELECT run_id, test_id, adjudication FROM ad"),
    "adjudication_map": _reports("SELECT * FROM amap"),
    "built_ledger": ctes("truth_rows") + _TOOL.strip() + "," + _REPORTS.strip() + """, b AS (SELECT cases.*, amap.* EXCLUDE (run_id, test_id), coalesce(adjudication IN ('promoted', 'refuted', 'inconclusive'), false) AND covered AS settled FROM cases JOIN amap USING (run_id, test_id))
        SELECT run_id, test_id, flagged, CASE WHEN flagged THEN settled ELSE covered END AS covered, CASE WHEN NOT flagged THEN 'no-lead' WHEN settled THEN adjudication ELSE 'not-analyzed' END AS adjudication,
        NOT flagged AND covered AND independent AS independent, cwe, attempted AS attempted, accepted_high_findings, proof_complete_high_findings, ce_resolved_high_findings, accepted_critical_chains, proof_complete_critical_chains, hygiene_findings, chain_reached_rce FROM b""",
    "ledger_violations": ctes("ledger_rows") + _SPOILT.strip() + """ SELECT run_id, pos, test_id, unnest(s).step::BIGINT AS step, unnest(s).v AS violation FROM (SELECT run_id, pos, test_id, list_filter([
        CASE WHEN NOT regexp_matches(test_id, '^BenchmarkTest\\d{5}$') THEN {'step': 0, 'v': 'bad test_id'} END, CASE WHEN nth > 1 THEN {'step': 1, 'v': 'duplicate test_id'} END,
        CASE WHEN a = 'odd' THEN {'step': 3, 'v': 'bad adjudication'} END, CASE WHEN f AND a = 'no-lead' THEN {'step': 4, 'v': 'flagged without a lead'} END, CASE WHEN f AND (a = 'not-analyzed') <> (NOT c) THEN {'step': 5, 'v': 'not-analyzed and covered disagree'} END,
        CASE WHEN NOT f AND a <> 'no-lead' THEN {'step': 6, 'v': 'lead without a flag'} END, CASE WHEN NOT known THEN {'step': 7, 'v': 'absent from truth'} END], lambda x: x IS NOT NULL) AS s FROM lw)""",
    "real_app_score": _review(""", doc AS (SELECT run_id, number AS id, CASE WHEN number % 2 = 0 THEN 'injection' ELSE vuln_class END AS vc, CASE WHEN number % 9 = 0 THEN 'src/none.java' ELSE source_file END AS file FROM canon WHERE number % 3 = 0),
        fits AS (SELECT d.run_id, d.id, f.finding_id FROM doc d JOIN final f ON f.run_id = d.run_id AND f.source_file = d.file AND f.status = 'accepted' AND (f.vuln_class = d.vc OR d.vc = 'injection' AND f.vuln_class IN ('sqli', 'command-injection'))),
        t AS (SELECT d.run_id, count(*) AS documented, count_if(id IN (SELECT id FROM fits x WHERE x.run_id = d.run_id)) AS found, count_if(id NOT IN (SELECT id FROM fits x WHERE x.run_id = d.run_id) AND file NOT IN (SELECT source_file FROM canon c WHERE c.run_id = d.run_id)) AS ms FROM doc d GROUP BY d.run_id),
        e AS (SELECT f.run_id, count(*) AS extra FROM final f WHERE status = 'accepted' AND NOT EXISTS (SELECT 1 FROM fits x WHERE x.run_id = f.run_id AND x.finding_id = f.finding_id) GROUP BY f.run_id),
        mc AS (SELECT c.run_id, count(*) AS chains, count_if(a.source_file <> b.source_file) AS wide FROM chain c JOIN canon a ON a.run_id = c.run_id AND a.finding_id = m1 JOIN canon b ON b.run_id = c.run_id AND b.finding_id = m2 GROUP BY c.run_id)
        SELECT run_id, documented, found::BIGINT AS found, ms::BIGINT AS missed_structural, (documented - found - ms)::BIGINT AS missed_reasoning, coalesce(extra, 0)::BIGINT AS extra, (found / documented)::DOUBLE AS recall, coalesce(chains, 0)::BIGINT AS chains, coalesce(wide, 0)::BIGINT AS multi_file_chains
        FROM t LEFT JOIN e USING (run_id) LEFT JOIN mc USING (run_id)"""),
}
