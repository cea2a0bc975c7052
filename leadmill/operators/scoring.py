"""Scoring against labelled truth: raw tool flags, ledgers, confusion matrices and quality rates.

Every table has a run_id: one truth set with what was made of it. Case ids are unique within it.
truth: run_id, test_id, category, is_real, cwe. Ledger rows carry run_id, test_id, flagged, covered, adjudication,
independent, cwe, attempted, chain_reached_rce and COUNTERS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.ranks import OUTCOME, rank, unrank

COUNTERS = ("accepted_high_findings", "proof_complete_high_findings", "ce_resolved_high_findings", "accepted_critical_chains", "proof_complete_critical_chains", "hygiene_findings")
#: CWE numbers that count as one family, and the pattern of case ids.
FAMILIES = ((326, 327),)
CASE_ID = r"^BenchmarkTest\d{5}$"
_CASE_IN = r"BenchmarkTest(\d{5})"
KEY = ["run_id", "test_id"]
ADJUDICATIONS = ("promoted", "refuted", "inconclusive", "not-analyzed", "no-lead")


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")


# Raw flags of a tool. Only the first run of a document counts.

_TOOL_RUN = "struct<tool:struct<driver:struct<rules:array<struct<id:string,properties:struct<tags:array<string>>>>>>,results:array<struct<ruleId:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>>>"


def _first_run(docs: DataFrame) -> DataFrame:
    return docs.select("run_id", "doc", F.get(F.from_json("text", f"struct<runs:array<{_TOOL_RUN}>>")["runs"], F.lit(0)).alias("r"))


def tool_rules(docs: DataFrame) -> DataFrame:
    """run_id, doc, rule_id, tags of the rules that the first runs of SARIF documents (run_id, doc, text) declare; of equal ids the last one."""
    rules = _first_run(docs).select("run_id", "doc", F.posexplode("r.tool.driver.rules").alias("at", "x"))
    last = rules.groupBy("run_id", "doc", F.col("x.id").alias("rule_id")).agg(F.max_by("x.properties.tags", "at").alias("tags"))
    return last.select("run_id", "doc", "rule_id", "tags")


def tool_results(docs: DataFrame) -> DataFrame:
    """run_id, doc, pos, rule_id, uri (of the first location) of the results in the first runs."""
    results = _first_run(docs).select("run_id", "doc", F.posexplode("r.results").alias("pos", "x"))
    return results.select("run_id", "doc", "pos", F.col("x.ruleId").alias("rule_id"), F.get("x.locations", F.lit(0))["physicalLocation"]["artifactLocation"]["uri"].alias("uri"))


def rule_cwes(results: DataFrame) -> DataFrame:
    """run_id, doc, rule_id, cwes (set of numbers from tags like CWE-79). results: those, and tags."""
    tags = results.select("run_id", "doc", "rule_id", F.explode_outer("tags").alias("tag")).select("run_id", "doc", "rule_id", F.nullif(F.regexp_extract("tag", r"^CWE-(\d+)", 1), F.lit("")).cast("int").alias("cwe"))
    return tags.groupBy("run_id", "doc", "rule_id").agg(F.array_sort(F.collect_set("cwe")).alias("cwes"))


def flagged_by_case(results: DataFrame, rules: DataFrame) -> DataFrame:
    """run_id, test_id, cwes: the union over the results whose first location names the case; empty where rules have none."""
    digits = F.regexp_extract("uri", _CASE_IN, 1)
    hits = results.where(digits != "").select("run_id", "doc", F.concat(F.lit("BenchmarkTest"), digits).alias("test_id"), "rule_id")
    hits = hits.join(rules, ["run_id", "doc", "rule_id"], "left").select(*KEY, F.explode_outer("cwes").alias("cwe"))
    return hits.groupBy(*KEY).agg(F.array_sort(F.collect_set("cwe")).alias("cwes"))


def family(cwe: Column) -> Column:
    """The CWE numbers that count as this one."""
    out = F.when(F.lit(False), F.array().cast("array<int>"))
    for members in FAMILIES:
        out = out.when(cwe.isin(*members), F.array(*[F.lit(m) for m in members]))
    return out.otherwise(F.array(cwe.cast("int")))


def flagged_cases(truth: DataFrame, flagged: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """run_id, test_id, flagged, cwe of all cases of the truth, or of those in the subset."""
    cases = truth if subset is None else truth.join(subset.select(*KEY).distinct(), KEY, "left_semi")
    out = cases.join(flagged.select(*KEY, "cwes"), KEY, "left")
    return out.select(*KEY, F.coalesce(F.arrays_overlap(family(F.col("cwe")), F.col("cwes")), F.lit(False)).alias("flagged"), "cwe")


def stratified_subset(truth: DataFrame, per: int = 4) -> DataFrame:
    """run_id, test_id of the first `per` real and `per` other cases of each category."""
    w = Window.partitionBy("run_id", "category", "is_real").orderBy("test_id")
    return truth.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per).select(*KEY, "category", "is_real")


def staged_results(results: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """Results of wanted cases, with their uri in the stage folder."""
    digits = F.regexp_extract("uri", _CASE_IN, 1)
    own = results.where(digits != "").withColumn("test_id", F.concat(F.lit("BenchmarkTest"), digits))
    return own.join(ids.select(*KEY).distinct(), KEY, "left_semi").withColumn("uri", F.concat(F.lit(folder + "/"), "test_id", F.lit(".java")))


# Matrices


def matrix(pred: Column, real: Column, where: Column, name: str, digits: int | None = None) -> Column:
    """A struct of tp, fp, fn, tn and the ratios over the rows that `where` selects; a zero denominator gives 0."""
    p, r = F.coalesce(pred, F.lit(False)), F.coalesce(real, F.lit(False))
    tp, fp, fn, tn = (count_if(where & x) for x in (p & r, p & ~r, ~p & r, ~p & ~r))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall, fpr = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(fp, fp + tn)
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    values = {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": cut(precision), "recall": cut(recall), "fpr": cut(fpr), "youden": cut(recall - fpr)}
    return F.struct(F.lit(name).alias("matrix"), *[v.alias(k) for k, v in values.items()])


def confusion(cases: DataFrame, pred: str, real: str, digits: int | None = 3) -> DataFrame:
    return cases.groupBy("run_id").agg(matrix(F.col(pred), F.col(real), F.lit(True), "raw", digits).alias("m")).select("run_id", "m.*").drop("matrix")


def _matrices() -> list[Column]:
    flagged, adj, real = F.col("flagged"), F.col("adjudication"), F.col("is_real")
    settled = flagged & adj.isin("promoted", "refuted")
    alone = ~flagged & F.col("covered")
    pred = F.when(flagged, adj == "promoted").otherwise(F.col("independent"))
    return [matrix(flagged, real, F.lit(True), "raw"), matrix(pred, real, settled, "adjudicated"), matrix(pred, real, settled | alone, "hybrid")]


def joined(ledger: DataFrame, truth: DataFrame) -> DataFrame:
    """Ledger rows with is_real, category and the truth's cwe."""
    kept = [c for c in ledger.columns if c not in ("is_real", "category")]
    return ledger.select(*kept).join(truth.select(*KEY, "is_real", "category", F.col("cwe").alias("true_cwe")), KEY)


def three_matrices(rows: DataFrame) -> DataFrame:
    """raw, adjudicated and hybrid matrices of each run, from one pass."""
    return rows.groupBy("run_id").agg(*[m.alias(f"m{i}") for i, m in enumerate(_matrices())]).select("run_id", F.inline(F.array("m0", "m1", "m2")))


def matrices_by_category(rows: DataFrame) -> DataFrame:
    """The same by category, and over all (category null)."""
    run, category = F.col("run_id"), F.col("category")
    out = rows.groupingSets([[run, category], [run]], run, category).agg(*[m.alias(f"m{i}") for i, m in enumerate(_matrices())])
    return out.select("run_id", "category", F.inline(F.array("m0", "m1", "m2")))


def exclusions_and_deltas(rows: DataFrame) -> DataFrame:
    f, adj, real = F.col("flagged"), F.col("adjudication"), F.col("is_real")
    alone = ~f & F.col("covered")
    return rows.groupBy("run_id").agg(
        count_if(f & (adj == "inconclusive")).alias("excluded_inconclusive"), count_if(f & ~adj.isin("promoted", "refuted", "inconclusive")).alias("excluded_not_analyzed"), count_if(~f & ~F.col("covered")).alias("excluded_not_covered"),
        count_if(f & (adj == "refuted") & ~real).alias("fp_refuted"), count_if(f & (adj == "refuted") & real).alias("recall_cost"), count_if(alone & real & F.col("independent")).alias("fn_recovered"),
    )


def cwe_mismatches(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_id").agg(count_if(F.col("is_real") & F.col("cwe").isNotNull() & (F.col("cwe") != F.col("true_cwe"))).alias("cwe_mismatches"))


def quality_rates(rows: DataFrame) -> DataFrame:
    """Rates of proof and coverage; a zero denominator gives null."""
    real, attempted = F.col("is_real"), F.coalesce("attempted", F.lit(False))
    found = F.when(F.col("flagged"), F.col("adjudication") == "promoted").otherwise(F.col("independent"))
    lost = real & attempted & ~found
    total = {c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)) for c in COUNTERS}
    reals, missed, structural = count_if(real), count_if(lost), count_if(lost & ~F.col("covered"))
    return rows.groupBy("run_id").agg(
        F.try_divide(total["proof_complete_high_findings"], total["accepted_high_findings"]).alias("finding_proof_complete_rate"),
        F.try_divide(total["proof_complete_critical_chains"], total["accepted_critical_chains"]).alias("chain_proof_complete_rate"),
        F.try_divide(total["ce_resolved_high_findings"], total["accepted_high_findings"]).alias("ce_resolved_rate"),
        F.try_divide(count_if(real & F.col("independent")), reals).alias("independent_discovery_rate"), F.try_divide(count_if(real & attempted), reals).alias("attempted_real_share"), missed.alias("real_not_found"),
        count_if(lost & F.col("covered")).alias("covered_fn"), structural.alias("structural_fn"), F.try_divide(structural, missed).alias("structural_fn_share"), total["hygiene_findings"].alias("hygiene_findings"),
    )


def attempted_per_category(rows: DataFrame) -> DataFrame:
    """run_id, category, attempted: attempted real cases of each category with a real case, 0 included."""
    return rows.where(F.col("is_real") & F.col("category").isNotNull()).groupBy("run_id", "category").agg(count_if(F.coalesce("attempted", F.lit(False))).alias("attempted"))


def least_attempted(rows: DataFrame) -> DataFrame:
    return attempted_per_category(rows).groupBy("run_id").agg(F.coalesce(F.min("attempted"), F.lit(0)).alias("min_attempted_per_category"))


# Adjudications from reports. A report is one row: run_id, report_ord, path_map, benchmark_cases, findings, verdicts, chains, lead_adjudications.


def case_id(file: Column, path_map: Column) -> Column:
    digits = F.regexp_extract(file, _CASE_IN, 1)
    return F.when(digits != "", F.concat(F.lit("BenchmarkTest"), digits)).otherwise(F.try_element_at(path_map, file))


def case_coverage(reports: DataFrame) -> DataFrame:
    """run_id, test_id, attempted, covered: by the last report that names the case."""
    rows = reports.select("run_id", "report_ord", F.posexplode("benchmark_cases").alias("at", "b"))
    last = rows.groupBy("run_id", F.col("b.test_id").alias("test_id")).agg(F.max_by("b.status", F.struct("report_ord", "at")).alias("s"))
    return last.select(*KEY, (F.col("s") == "analyzed").alias("attempted"), (F.col("s") == "analyzed").alias("covered"))


def report_findings(reports: DataFrame) -> DataFrame:
    """One row per finding: run_id, report_ord, test_id, finding fields, proof."""
    f = reports.select("run_id", "report_ord", "path_map", F.posexplode("findings").alias("at", "f")).select("run_id", "report_ord", "path_map", "at", "f.*")
    proof = F.coalesce(F.size("transformations") > 0, F.lit(False)) | F.coalesce("direct_flow", F.lit(False))
    return f.select("run_id", "report_ord", "at", case_id(F.col("file"), F.col("path_map")).alias("test_id"), "finding_id", "vuln_class", "origin", "verification_status", "final_severity", "source_finding_ids", proof.alias("proof"))


def case_finding_counters(reports: DataFrame) -> DataFrame:
    v = reports.select("run_id", "report_ord", F.posexplode("verdicts").alias("at", "v")).where("v.target_type = 'finding'")
    v = v.groupBy("run_id", "report_ord", F.col("v.target_id").alias("finding_id")).agg(F.max_by(F.col("v.counterexamples"), "at").alias("ces"))
    f = report_findings(reports).where("test_id is not null").join(v, ["run_id", "report_ord", "finding_id"], "left")
    settled = F.coalesce((F.size("ces") > 0) & F.forall("ces", lambda c: F.coalesce(c["checked"] & c["refuted"], F.lit(False))), F.lit(False))
    accepted = F.coalesce(F.col("verification_status") == "accepted", F.lit(False))
    high = accepted & F.coalesce(F.col("final_severity") == "High", F.lit(False))
    return f.groupBy(*KEY).agg(
        F.max(F.coalesce(F.col("origin") == "llm-discovered", F.lit(False))).alias("independent"), count_if(high).alias("accepted_high_findings"), count_if(high & F.col("proof")).alias("proof_complete_high_findings"),
        count_if(high & settled).alias("ce_resolved_high_findings"), count_if(accepted & (F.col("vuln_class") == "trust-boundary")).alias("hygiene_findings"),
    )


def case_chain_counters(reports: DataFrame) -> DataFrame:
    c = reports.select("run_id", "report_ord", "path_map", F.posexplode("chains").alias("at", "c")).select("run_id", "report_ord", "path_map", "at", "c.*")
    c = c.withColumn("test_id", case_id(F.col("file"), F.col("path_map"))).where("test_id is not null")
    last = report_findings(reports).groupBy("run_id", "report_ord", "finding_id").agg(F.max_by("proof", "at").alias("proof"))
    m = c.select("run_id", "report_ord", "at", F.explode("finding_ids").alias("finding_id")).join(last, ["run_id", "report_ord", "finding_id"], "left")
    m = m.groupBy("run_id", "report_ord", "at").agg(F.min(F.coalesce("proof", F.lit(False))).alias("all_proof"))
    c = c.join(m, ["run_id", "report_ord", "at"], "left")
    accepted = F.coalesce(F.col("verification_status") == "accepted", F.lit(False))
    critical = accepted & F.coalesce(F.col("severity") == "Critical", F.lit(False))
    return c.groupBy(*KEY).agg(
        F.max(accepted & (F.col("final_impact") == "unauth-rce")).alias("chain_reached_rce"), count_if(critical).alias("accepted_critical_chains"), count_if(critical & F.coalesce("all_proof", F.lit(True))).alias("proof_complete_critical_chains")
    )


def case_adjudication(reports: DataFrame) -> DataFrame:
    """run_id, test_id, adjudication: the highest outcome; a promoted lead whose finding was rejected counts as refuted."""
    a = reports.select("run_id", "report_ord", "path_map", F.explode("lead_adjudications").alias("a")).select("run_id", "report_ord", "path_map", "a.*")
    a = a.withColumn("case", F.coalesce(F.nullif("test_id", F.lit("")), case_id(F.col("file"), F.col("path_map")))).where("case is not null")
    f = report_findings(reports)
    own = f.groupBy("run_id", "report_ord", "finding_id").agg(F.max_by("verification_status", "at").alias("s1"))
    raw = f.select("run_id", "report_ord", "at", "verification_status", F.explode("source_finding_ids").alias("finding_id")).groupBy("run_id", "report_ord", "finding_id").agg(F.max_by("verification_status", "at").alias("s2"))
    a = a.join(own, ["run_id", "report_ord", "finding_id"], "left").join(raw, ["run_id", "report_ord", "finding_id"], "left")
    dismissed = (F.col("outcome") == "promoted") & F.coalesce(F.coalesce("s1", "s2") == "rejected", F.lit(False))
    outcome = rank(F.when(dismissed, "refuted").otherwise(F.col("outcome")), OUTCOME, 0)
    return a.groupBy("run_id", F.col("case").alias("test_id")).agg(unrank(F.max(outcome), OUTCOME).alias("adjudication"))


def adjudication_map(reports: DataFrame) -> DataFrame:
    """One row per case that a report touches, with defaults for what isn't there."""
    parts = [case_coverage(reports), case_finding_counters(reports), case_chain_counters(reports), case_adjudication(reports)]
    out = reduce(lambda a, b: a.join(b, KEY, "full_outer"), parts)
    falses, zeros = ("attempted", "covered", "independent", "chain_reached_rce"), COUNTERS
    return out.select(*KEY, *[F.coalesce(c, F.lit(False)).alias(c) for c in falses], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zeros], "adjudication")


def build_ledger(cases: DataFrame, found: DataFrame) -> DataFrame:
    """Ledger rows of cases (test_id, flagged, cwe) with what `adjudication_map` found."""
    x = cases.join(found, KEY, "left")
    flagged, covered = F.col("flagged"), F.coalesce("covered", F.lit(False))
    settled = F.coalesce(F.col("adjudication").isin(*OUTCOME), F.lit(False)) & covered
    return x.select(
        *KEY, "flagged", F.when(flagged, settled).otherwise(covered).alias("covered"),
        F.when(~flagged, "no-lead").when(settled, F.col("adjudication")).otherwise("not-analyzed").alias("adjudication"),
        (~flagged & covered & F.coalesce("independent", F.lit(False))).alias("independent"), "cwe", F.coalesce("attempted", F.lit(False)).alias("attempted"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTERS], F.coalesce("chain_reached_rce", F.lit(False)).alias("chain_reached_rce"),
    )


def ledger_violations(ledger: DataFrame, truth: DataFrame, position: str = "pos") -> DataFrame:
    """run_id, pos, test_id, step, violation: all violations of entries, steps in the order of checking."""
    twice = F.row_number().over(Window.partitionBy(*KEY).orderBy(position)) > 1
    x = ledger.withColumn("__twice", twice).join(truth.select(*KEY, F.lit(True).alias("__known")).distinct(), KEY, "left")
    flagged, adj, covered = F.col("flagged"), F.col("adjudication"), F.col("covered")
    rules = [
        (~F.coalesce(F.col("test_id").rlike(CASE_ID), F.lit(False)), "bad test_id"),
        (F.col("__twice"), "duplicate test_id"),
        (flagged.isNull() | covered.isNull() | F.col("independent").isNull(), "not boolean"),
        (~F.coalesce(adj.isin(*ADJUDICATIONS), F.lit(False)), "bad adjudication"),
        (flagged & (adj == "no-lead"), "flagged without a lead"),
        (flagged & ((adj == "not-analyzed") != ~covered), "not-analyzed and covered disagree"),
        (~flagged & (adj != "no-lead"), "lead without a flag"),
        (F.col("__known").isNull(), "absent from truth"),
    ]
    found = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("step"), F.lit(t).alias("violation"))) for i, (c, t) in enumerate(rules)]), lambda v: v.isNotNull())
    return x.select("run_id", F.col(position).alias("pos"), "test_id", F.explode(found).alias("v")).select("run_id", "pos", "test_id", "v.step", "v.violation")


def first_ledger_violation(ledger: DataFrame, truth: DataFrame, position: str = "pos") -> DataFrame:
    found = ledger_violations(ledger, truth, position).groupBy("run_id").agg(F.min(F.struct("pos", "step", "violation", "test_id")).alias("m"))
    return found.select("run_id", "m.test_id", "m.violation")


def score_real_app(findings: DataFrame, chains: DataFrame, analyzed: DataFrame, truth: DataFrame, same_class: DataFrame) -> DataFrame:
    """One row per run: documented, found, missed_structural, missed_reasoning, extra, recall, chains, multi_file_chains.

    truth: run_id, id, vuln_class, file. analyzed: run_id, file. same_class: vuln_class, documented_class (compatible pairs).
    """
    ok = findings.where("verification_status = 'accepted'").select("run_id", "finding_id", "vuln_class", F.col("source.file").alias("file"))
    pairs = same_class.select("vuln_class", "documented_class").union(truth.select("vuln_class", F.col("vuln_class").alias("documented_class"))).distinct()
    wide = ok.join(pairs, "vuln_class").select("run_id", "finding_id", "file", "documented_class")
    wanted = truth.select("run_id", "id", "file", F.col("vuln_class").alias("documented_class"))
    hit = wanted.join(wide.select("run_id", "file", "documented_class").distinct(), ["run_id", "file", "documented_class"], "left_semi").select("run_id", "id", F.lit(True).alias("found"))
    seen = analyzed.select("run_id", "file", F.lit(True).alias("seen")).distinct()
    t = truth.join(hit, ["run_id", "id"], "left").join(seen, ["run_id", "file"], "left")
    found = F.col("found").isNotNull()
    t = t.groupBy("run_id").agg(F.count(F.lit(1)).alias("documented"), count_if(found).alias("found"), count_if(~found & F.col("seen").isNull()).alias("missed_structural"), count_if(~found & F.col("seen").isNotNull()).alias("missed_reasoning"))
    known = wide.join(wanted.select("run_id", "file", "documented_class").distinct(), ["run_id", "file", "documented_class"], "left_semi").select("run_id", "finding_id").distinct()
    extra = ok.join(known, ["run_id", "finding_id"], "left_anti").groupBy("run_id").agg(F.count(F.lit(1)).alias("extra"))
    files = chains.select("run_id", "chain_id", F.explode("finding_ids").alias("finding_id")).join(findings.select("run_id", "finding_id", F.col("source.file").alias("file")), ["run_id", "finding_id"])
    per_chain = files.groupBy("run_id", "chain_id").agg((F.count_distinct("file") > 1).alias("wide")).groupBy("run_id").agg(F.count(F.lit(1)).alias("chains"), count_if(F.col("wide")).alias("multi_file_chains"))
    out = t.join(extra, "run_id", "left").join(per_chain, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("run_id", "documented", "found", "missed_structural", "missed_reasoning", zero("extra"), F.try_divide("found", "documented").alias("recall"), zero("chains"), zero("multi_file_chains"))
