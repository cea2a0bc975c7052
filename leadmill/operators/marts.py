"""Report tables: counts by severity, status and origin, run verdicts, chain graphs, annexes, and export rows.

Findings here are canonical ones with verification_status and final values, chains with severity, confidence and status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.ranks import SEVERITY, rank
from leadmill.operators.findings import chain_fingerprints, finding_fingerprint

STATUSES = ("accepted", "downgraded", "rejected", "not-requested")
HYGIENE = "trust-boundary"


def provisional_counts(findings: DataFrame) -> DataFrame:
    """run_id, severity, n_findings, n_classes, before any review."""
    by = findings.groupBy("run_id", F.col("provisional_severity").alias("severity"))
    return by.agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("vuln_class").alias("n_classes"))


def origin_breakdown(findings: DataFrame) -> DataFrame:
    """run_id, origin, n_findings of runs that have leads."""
    by = findings.groupBy("run_id", "origin").agg(F.count(F.lit(1)).alias("n_findings"), F.max(F.coalesce(F.size("source_lead_ids") > 0, F.lit(False))).alias("leads"))
    some = F.max("leads").over(Window.partitionBy("run_id"))
    return by.withColumn("some", some).where("some").select("run_id", "origin", "n_findings")


def effective_severity() -> Column:
    """Final severity of a settled finding, else the provisional one."""
    return F.when(F.col("verification_status").isin("accepted", "downgraded"), F.col("final_severity")).otherwise(F.col("provisional_severity"))


def severity_counts(findings: DataFrame, chains: DataFrame) -> DataFrame:
    """A row per run: Critical counts accepted Critical chains, the others findings that aren't rejected."""
    of_findings = findings.where("verification_status != 'rejected'").select("run_id", effective_severity().alias("severity"))
    of_chains = chains.where("verification_status = 'accepted' and severity = 'Critical'").select("run_id", F.lit("Critical").alias("severity"))
    runs = findings.select("run_id", F.lit(None).cast("string").alias("severity")).union(chains.select("run_id", F.lit(None).cast("string").alias("severity")))
    # Findings never are Critical, so one aggregation serves both.
    both = of_findings.where("severity != 'Critical'").union(of_chains).union(runs)
    return both.groupBy("run_id").agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITY[::-1]])


def status_counts(findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("run_id").pivot("verification_status", list(STATUSES)).count().fillna(0)
    return counts.select("run_id", *[F.col(f"`{s}`").alias(s.replace("-", "_")) for s in STATUSES])


def coverage_counts(analyzed: DataFrame, gaps: DataFrame) -> DataFrame:
    """run_id, analyzed, gaps: how many partitions of each kind."""
    rows = analyzed.select("run_id", F.lit(1).alias("a"), F.lit(0).alias("g")).union(gaps.select("run_id", F.lit(0), F.lit(1)))
    return rows.groupBy("run_id").agg(F.sum("a").alias("analyzed"), F.sum("g").alias("gaps"))


def run_verdict(findings: DataFrame, chains: DataFrame) -> DataFrame:
    """run_id, verdict: `unauth-rce` where an accepted chain is Critical."""
    hit = (F.col("verification_status") == "accepted") & (F.col("severity") == "Critical")
    rows = chains.select("run_id", hit.alias("hit")).union(findings.select("run_id", F.lit(False)).distinct())
    return rows.groupBy("run_id").agg(F.when(F.max("hit"), "unauth-rce").otherwise("no-critique").alias("verdict"))


def chain_graph(chains: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """run_id, chain_id, severity, entry_auth, impact, nodes, edges (from, to, verdict), coherent: every end of an edge is a node.

    Nodes are `entry`, the members and, where the impact is `unauth-rce`, `RCE`. An edge has the verdict of its own transition (of a downgraded
    chain's accepted one: downgraded), else that of the chain, which is null where there's none. steps: run_id, chain_id, transition_verdicts.
    """
    rce = F.col("final_impact") == "unauth-rce"
    none = F.array().cast("array<struct<from:string,to:string>>")
    given = chains.join(steps, ["run_id", "chain_id"], "left") if steps is not None else chains.withColumn("transition_verdicts", F.lit(None).cast("array<struct<from:string,to:string,verdict:string>>"))
    nodes = F.concat(F.array(F.lit("entry")), F.col("finding_ids"), F.when(rce, F.array(F.lit("RCE"))).otherwise(F.array().cast("array<string>")))
    path = F.concat(F.transform("transitions", lambda t: F.struct(t["from"].alias("from"), t["to"].alias("to"))), F.when(rce, F.array(F.struct(F.element_at("finding_ids", -1).alias("from"), F.lit("RCE").alias("to")))).otherwise(none))
    status = F.col("verification_status")
    own = F.when(status.isin("accepted", "downgraded", "rejected"), status)
    of = lambda e: F.get(F.filter("transition_verdicts", lambda t: (t["from"] == e["from"]) & (t["to"] == e["to"])), F.lit(0))["verdict"]
    verdict = lambda e: F.when(of(e) == "rejected", "rejected").when(of(e) == "accepted", F.when(status == "downgraded", "downgraded").otherwise("accepted")).otherwise(own)
    edges = F.transform(path, lambda e: F.struct(e["from"].alias("from"), e["to"].alias("to"), verdict(e).alias("verdict")))
    out = given.select("run_id", "chain_id", "severity", F.col("entry_point.auth").alias("entry_auth"), F.when(rce, "unauth-rce").otherwise("other").alias("impact"), nodes.alias("nodes"), edges.alias("edges"))
    ends = F.flatten(F.transform("edges", lambda e: F.array(e["from"], e["to"])))
    return out.withColumn("coherent", F.size(F.array_except(ends, F.col("nodes"))) == 0)


def dismissed(decisions: DataFrame) -> DataFrame:
    return decisions.where("outcome = 'rejected'").select("run_id", "target_type", "target_id", "reason")


def hygiene_lane(findings: DataFrame) -> DataFrame:
    return findings.where((F.col("vuln_class") == HYGIENE) & (F.col("verification_status") == "accepted"))


def refuted_leads(adjudications: DataFrame, leads: DataFrame) -> DataFrame:
    """Refuted leads with the place and rule that they came from."""
    kept = leads.select("run_id", "lead_id", "rule_id", "file", "line")
    return adjudications.where("outcome = 'refuted'").select("run_id", "lead_id", "reason").join(kept, ["run_id", "lead_id"], "left")


#: SARIF levels of severities.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def level(severity: Column) -> Column:
    low = F.lower(severity)
    out = F.when(F.lit(False), "")
    for k, v in LEVELS.items():
        out = out.when(low == k, v)
    return out.otherwise("warning")


#: Rule ids of exported results that aren't a finding's own class.
CHAIN_RULE, REFUTED_RULE, OPEN_RULE = "exploit-chain", "sast-lead-refuted", "sast-lead-inconclusive"
_FLOW = "array<struct<file:string,line:bigint>>"


def _steps(chains: DataFrame) -> Column:
    """A chain's code flow: its entry, then the first evidence of each transition that has one."""
    entry = F.array(F.struct(F.col("entry_point.file").alias("file"), F.col("entry_point.line").cast("long").alias("line")))
    if "evidence" not in chains.schema["transitions"].dataType.elementType.fieldNames():
        return entry
    first = F.transform("transitions", lambda t: F.get(t["evidence"], F.lit(0)))
    seen = F.filter(first, lambda e: e.isNotNull())
    return F.concat(entry, F.transform(seen, lambda e: F.struct(e["file"].alias("file"), e["line"].cast("long").alias("line"))))


def sarif_results(findings: DataFrame, chains: DataFrame, adjudications: DataFrame | None = None, tool: str = "audit") -> DataFrame:
    """One row per exported result: run_id, section, key, rule_id, level, message, file, line, sink_file, sink_line, flow, fingerprint, lane, suppressed, reason.

    Sections in order: findings that aren't rejected (related location: the sink), all chains (with their code flow), refuted leads (suppressed, for a
    reason), inconclusive leads. adjudications: run_id, lead_id, outcome, reason, file, line; other outcomes give nothing.
    """
    null = lambda kind: F.lit(None).cast(kind)
    f = findings.where("verification_status != 'rejected'").select(
        "run_id", F.lit(1).alias("section"), F.col("finding_id").alias("key"), F.col("vuln_class").alias("rule_id"), level(F.coalesce("final_severity", "provisional_severity")).alias("level"), F.col("title").alias("message"),
        F.col("source.file").alias("file"), F.col("source.line").cast("long").alias("line"), F.col("sink.file").alias("sink_file"), F.col("sink.line").cast("long").alias("sink_line"), null(_FLOW).alias("flow"),
        finding_fingerprint().alias("fingerprint"), F.when(F.col("vuln_class") == HYGIENE, "hygiene").alias("lane"), F.lit(False).alias("suppressed"), null("string").alias("reason"),
    )
    c = chains.join(chain_fingerprints(chains, findings), ["run_id", "chain_id"]).select(
        "run_id", F.lit(2), F.col("chain_id"), F.lit(CHAIN_RULE), level(F.col("severity")), F.concat("final_impact", F.lit(" via "), "chain_id"), F.col("entry_point.file"), F.col("entry_point.line").cast("long"), null("string"), null("long"),
        _steps(chains), "fingerprint", null("string"), F.lit(False), null("string"),
    )
    out = f.union(c)
    if adjudications is not None:
        refuted, given = F.col("outcome") == "refuted", F.nullif("reason", F.lit(""))
        # The texts that stand for a missing reason.
        out = out.union(adjudications.where("outcome in ('refuted', 'inconclusive')").select(
            "run_id", F.when(refuted, 3).otherwise(4), "lead_id", F.when(refuted, REFUTED_RULE).otherwise(OPEN_RULE), F.lit("note"), F.coalesce(given, F.when(refuted, f"refuted by {tool}").otherwise("inconclusive")), "file",
            F.col("line").cast("long"), null("string"), null("long"), null(_FLOW), null("string"), null("string"), refuted, F.when(refuted, F.coalesce(given, F.lit(f"{tool} assessed not exploitable"))),
        ))
    return out


def sarif_rules(results: DataFrame) -> DataFrame:
    """run_id, rule_id, level of its first emission, cwe for the hygiene rule, and the rule's place in order of emission."""
    order = F.struct("section", F.char_length("key"), "key")
    rules = results.groupBy("run_id", "rule_id").agg(F.min(F.struct(order.alias("o"), "level")).alias("m"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("m.o", "rule_id"))
    return rules.select("run_id", "rule_id", F.col("m.level").alias("level"), F.when(F.col("rule_id") == HYGIENE, "CWE-501").alias("cwe"), place.cast("long").alias("place"))


def junit_cases(findings: DataFrame, chains: DataFrame, adjudications: DataFrame | None = None, fail_on: str = "High", tool: str = "audit") -> DataFrame:
    """run_id, section, key, classname, name, outcome (failure, passed or skipped), message, body. An unknown threshold fails nothing."""
    least = {s: i for i, s in enumerate(SEVERITY)}.get(fail_on.capitalize())
    none = F.lit(None).cast("string")

    def fails(severity: Column) -> Column:
        settled = F.col("verification_status").isin("accepted", "downgraded")
        return F.lit(False) if least is None else settled & (rank(severity, SEVERITY, -1) >= least)

    def case(section: int, key: str, classname: Column, bad: Column, message: Column, body: Column) -> list[Column]:
        columns = {"section": F.lit(section), "key": F.col(key), "classname": classname, "name": F.col("fingerprint"), "outcome": F.when(bad, "failure").otherwise("passed"), "message": F.when(bad, message), "body": F.when(bad, body)}
        return [F.col("run_id"), *[v.alias(k) for k, v in columns.items()]]

    place = lambda c: F.concat_ws(":", c["file"], c["line"])
    severity = F.coalesce("final_severity", "provisional_severity")
    f = findings.where("verification_status != 'rejected'").withColumn("fingerprint", finding_fingerprint()).select(case(
        1, "finding_id", F.col("vuln_class"), fails(severity), F.concat(severity, F.lit(" "), "vuln_class", F.lit(": "), "title"),
        F.concat(F.lit("finding_id="), "finding_id", F.lit(" source="), place(F.col("source")), F.lit(" sink="), place(F.col("sink"))),
    ))
    c = chains.join(chain_fingerprints(chains, findings), ["run_id", "chain_id"]).select(case(
        2, "chain_id", F.lit(CHAIN_RULE), fails(F.col("severity")), F.concat("severity", F.lit(f" {CHAIN_RULE}: "), "final_impact", F.lit(" via "), "chain_id"),
        F.concat(F.lit("chain_id="), "chain_id", F.lit(" entry="), place(F.col("entry_point")), F.lit(" impact="), "final_impact"),
    ))
    out = f.union(c)
    if adjudications is not None:
        reason = F.coalesce(F.nullif("reason", F.lit("")), F.lit(f"refuted by {tool}"))
        out = out.union(adjudications.where("outcome = 'refuted'").select("run_id", F.lit(3), "lead_id", F.lit(REFUTED_RULE), "lead_id", F.lit("skipped"), reason, none))
    return out


def junit_counts(cases: DataFrame) -> DataFrame:
    n = lambda o: F.count_if(F.col("outcome") == o)
    return cases.groupBy("run_id").agg(F.count(F.lit(1)).alias("tests"), n("failure").alias("failures"), n("skipped").alias("skipped"))


def inconclusive_leads(adjudications: DataFrame) -> DataFrame:
    """Leads that a review left open, as gaps."""
    return adjudications.where("outcome = 'inconclusive'").select("run_id", F.lit("inconclusive-lead").alias("gap_class"), F.col("lead_id").alias("target"), F.coalesce(F.nullif("reason", F.lit("")), F.lit("inconclusive")).alias("reason"))


def neutralized_gaps(batches: DataFrame, invalid: DataFrame) -> DataFrame:
    """The targets of batches that were made errors, each with the batch and its first violation: the neutralized batch doesn't tell these any more.

    batches: as they were before; invalid: run_id, pos, batch_id, error.
    """
    lost = batches.select("run_id", "pos", F.explode("expected_targets").alias("t")).join(invalid.select("run_id", "pos", "batch_id", "error"), ["run_id", "pos"])
    return lost.select("run_id", F.lit("neutralized-batch").alias("gap_class"), F.concat_ws(":", "t.target_type", "t.target_id").alias("target"), F.concat(F.lit("batch "), "batch_id", F.lit(" neutralized: "), "error").alias("reason"))


def coverage_ledger(*gaps: DataFrame) -> DataFrame:
    """Union of gap tables with run_id, gap_class, target, reason and score (null where there's none)."""
    out = None
    for g in gaps:
        score = F.col("score").cast("long") if "score" in g.columns else F.lit(None).cast("long")
        part = g.select("run_id", "gap_class", "target", "reason", score.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out
