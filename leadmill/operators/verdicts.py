"""Review verdicts of many runs: targets, batches, validation, application to findings and chains.

findings: run_id, number, finding_id, vuln_class, provisional_severity, confidence, ...
chains: run_id, pos, chain_id, entry_point (file, line, auth), finding_ids, transitions (from, to), final_impact, severity, confidence.
batches: run_id, pos, batch_id, expected_targets (target_type, target_id), status, verdicts (target_type, target_id, verdict,
new_severity, new_confidence, justification, counterexamples (checked, refuted), transition_verdicts (from, to, verdict)).

Nothing is raised: a violation is a row. "First" means least place in the input.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadmill.functions.numbering import numbered
from leadmill.functions.ranks import CONFIDENCE, SEVERITY, rank, unrank

HYGIENE = "trust-boundary"
BATCH_FINDINGS = 5
#: Who has to mend a violation.
OURS, THEIRS = "orchestrator-input", "verifier-output"
#: Fixed value: the reason of what has no verdict.
UNVERIFIED = "no verifier verdict (unverified)"


def targets(findings: DataFrame, chains: DataFrame) -> DataFrame:
    """run_id, target_type, target_id: chains, their members, and findings of High severity; each once."""
    of_chains = chains.select("run_id", F.lit("chain").alias("target_type"), F.col("chain_id").alias("target_id"))
    members = chains.select("run_id", F.lit("finding"), F.explode("finding_ids"))
    high = findings.where("provisional_severity = 'High'").select("run_id", F.lit("finding"), "finding_id")
    return of_chains.union(members).union(high).distinct()


def plan_batches(required: DataFrame, numbers: DataFrame) -> DataFrame:
    """Adds batch_id: five findings in the order of their numbers, or one chain. numbers: run_id, target_id, number."""
    rows = numbered(required.join(numbers, ["run_id", "target_id"]), ["run_id", "target_type"], [F.col("number")], "__at")
    at = F.col("__at") - 1
    is_chain = F.col("target_type") == "chain"
    batch = F.when(is_chain, F.concat(F.lit("C"), (at + 1).cast("string"))).otherwise(F.concat(F.lit("B"), (F.floor(at / BATCH_FINDINGS) + 1).cast("string")))
    return rows.select("run_id", "target_type", "target_id", "number", batch.alias("batch_id"))


def _at_most(severity: Column, confidence: Column, new_severity: Column, new_confidence: Column) -> Column:
    """Neither rank is raised; unknown or missing new values raise."""
    return F.coalesce((rank(new_severity, SEVERITY) <= rank(severity, SEVERITY)) & (rank(new_confidence, CONFIDENCE) <= rank(confidence, CONFIDENCE)), F.lit(False))


def topology_valid(ids: Column, transitions: Column) -> Column:
    """Transitions are the exact path entry, first finding, ..., last finding."""
    before = F.concat(F.array(F.lit("entry")), F.slice(ids, F.lit(1), F.size(ids) - 1))
    wanted = F.zip_with(before, ids, lambda a, b: F.concat(a, F.lit("->"), b))
    return F.coalesce((F.size(transitions) == F.size(ids)) & (F.when(F.size(ids) > 0, wanted).otherwise(F.array().cast("array<string>")) == _arrows(transitions)), F.lit(False))


def _arrows(transitions: Column) -> Column:
    return F.transform(transitions, lambda t: F.concat(t["from"], F.lit("->"), t["to"]))


def chain_topology(chains: DataFrame) -> DataFrame:
    return chains.select("run_id", "pos", "chain_id", topology_valid(F.col("finding_ids"), F.col("transitions")).alias("valid"))


def _known(findings: DataFrame, chains: DataFrame) -> DataFrame:
    f = findings.select("run_id", F.lit("finding").alias("target_type"), F.col("finding_id").alias("target_id"), F.col("provisional_severity").alias("severity"), "confidence", F.lit(None).cast("array<string>").alias("arrows"), F.lit(True).alias("known"))
    c = chains.select("run_id", F.lit("chain"), "chain_id", "severity", "confidence", _arrows(F.col("transitions")), F.lit(True))
    return f.union(c)


def batch_violations(batches: DataFrame, findings: DataFrame, chains: DataFrame) -> DataFrame:
    """run_id, pos, batch_id, step, at, error, kind: all violations of single batches, steps in the order of checking.

    A batch becomes one array: its violations as a whole, its expected targets and its verdicts. That is exploded once and joined once with what is known.
    """
    b = batches.select("run_id", F.col("pos").cast("long").alias("pos"), "batch_id", "expected_targets", "status", "verdicts")
    key = lambda t: F.concat_ws(":", t["target_type"], t["target_id"])
    text, verdict_type = "string", b.schema["verdicts"].dataType.elementType
    of_verdict = {f: verdict_type[f].dataType for f in ("verdict", "new_severity", "new_confidence", "counterexamples", "transition_verdicts")}

    def item(part: str, step: int, at: Column, error: Column | None, kind: str, target: Column | None = None, first: Column | None = None, expected: Column | None = None, verdict: Column | None = None) -> Column:
        null = lambda t: F.lit(None).cast(t)
        return F.struct(
            F.lit(part).alias("part"), F.lit(step).alias("step"), at.cast("int").alias("at"), (null(text) if error is None else error).alias("given"), F.lit(kind).alias("kind"), *[(null(text) if target is None else target[c]).alias(c) for c in ("target_type", "target_id")],
            (null("boolean") if first is None else first).alias("first"), (null("boolean") if expected is None else expected).alias("expected"), *[(null(t) if verdict is None else verdict[f]).alias(f) for f, t in of_verdict.items()],
        )

    whole = lambda step, bad, error, kind: F.when(F.coalesce(bad, F.lit(True)), item("w", step, F.lit(0), F.lit(error), kind))
    n_chains = F.size(F.filter("expected_targets", lambda t: t["target_type"] == "chain"))
    n_findings = F.size("expected_targets") - n_chains
    targets_, verdicts_ = F.transform("expected_targets", key), F.transform("verdicts", key)
    covered, n, status = F.size(F.array_distinct(verdicts_)), F.size(F.array_distinct(targets_)), F.col("status")
    rules = F.array_compact(F.array(
        whole(1, F.col("batch_id").isNull() | (F.col("batch_id") == ""), "no batch_id", OURS),
        whole(2, F.col("expected_targets").isNull() | (F.size("expected_targets") == 0), "no expected targets", OURS),
        whole(3, F.col("verdicts").isNull(), "no verdicts array", OURS),
        whole(4, ~status.isin("ok", "partial", "error"), "unknown status", THEIRS),
        whole(5, F.exists("expected_targets", lambda t: t.isNull() | t["target_id"].isNull() | ~F.coalesce(t["target_type"].isin("finding", "chain"), F.lit(False))), "malformed expected target", OURS),
        whole(6, ~(((n_chains == 1) & (n_findings == 0)) | ((n_chains == 0) & n_findings.between(1, BATCH_FINDINGS))), "composition", OURS),
        whole(9, F.when(status == "error", covered != 0).when(status == "ok", covered != n).otherwise((covered == 0) | (covered == n)), "coverage doesn't fit the status", THEIRS),
    ))
    asked = F.transform("expected_targets", lambda t, i: item("e", 7, i, None, OURS, t, F.array_position(targets_, key(t)) == i + 1))
    given = F.transform("verdicts", lambda v, i: item("v", 8, i, None, THEIRS, v, F.array_position(verdicts_, key(v)) == i + 1, F.coalesce(F.array_contains(targets_, key(v)), F.lit(False)), v))
    none = F.slice(F.array(item("w", 0, F.lit(0), None, OURS)), 1, 0)
    x = b.select("run_id", "pos", "batch_id", F.explode(F.concat(rules, F.coalesce(asked, none), F.coalesce(given, none))).alias("x")).select("run_id", "pos", "batch_id", "x.*")
    x = x.join(_known(findings, chains), ["run_id", "target_type", "target_id"], "left")

    name, verdict = F.concat_ws(":", "target_type", "target_id"), F.col("verdict")
    is_finding, is_chain = F.col("target_type") == "finding", F.col("target_type") == "chain"
    ces = F.coalesce("counterexamples", F.array().cast(of_verdict["counterexamples"]))
    all_refuted = F.forall(ces, lambda c: F.coalesce(c["checked"] & c["refuted"], F.lit(False)))
    one_holds = F.exists(ces, lambda c: F.coalesce(c["checked"] & ~c["refuted"], F.lit(False)))
    tv = F.coalesce("transition_verdicts", F.array().cast(of_verdict["transition_verdicts"]))
    steps = _arrows(tv)
    exact = (F.size(steps) == F.size("arrows")) & (F.size(F.array_distinct(steps)) == F.size(steps)) & (F.size(F.array_except(steps, F.col("arrows"))) == 0) & (F.size(F.array_except(F.col("arrows"), steps)) == 0)
    of_target = F.when(~F.col("first"), F.concat(F.lit("target twice: "), name)).when(F.col("known").isNull(), F.concat(F.lit("unknown target: "), name))
    of_verdict_ = (
        F.when(F.coalesce(~F.col("target_type").isin("finding", "chain"), F.lit(True)) | F.col("target_id").isNull(), "malformed verdict")
        .when(~F.col("expected"), F.concat(F.lit("unexpected verdict: "), name))
        .when(~F.col("first"), F.concat(F.lit("second verdict: "), name))
        .when(is_finding & (verdict == "downgraded") & ~_at_most(F.col("severity"), F.col("confidence"), F.col("new_severity"), F.col("new_confidence")), F.concat(F.lit("raised: "), name))
        .when(is_finding & verdict.isin("accepted", "downgraded") & (F.size(ces) == 0), F.concat(F.lit("no counterexamples: "), name))
        .when(is_finding & (F.size(ces) > 0) & (verdict == "accepted") & ~all_refuted, F.concat(F.lit("unrefuted counterexample: "), name))
        .when(is_finding & (F.size(ces) > 0) & verdict.isin("rejected", "downgraded") & ~one_holds, F.concat(F.lit("no counterexample holds: "), name))
        .when(is_chain & ~F.coalesce(exact, F.lit(False)), F.concat(F.lit("transitions differ: "), name))
        .when(is_chain & (verdict != "rejected") & ~F.forall(tv, lambda t: F.coalesce(t["verdict"] == "accepted", F.lit(False))), F.concat(F.lit("rejected transition: "), name))
    )
    error = F.when(F.col("part") == "e", of_target).when(F.col("part") == "v", of_verdict_).otherwise(F.col("given"))
    return x.select("run_id", "pos", "batch_id", "step", "at", error.alias("error"), "kind").where("error is not null")


def first_batch_violations(batches: DataFrame, findings: DataFrame, chains: DataFrame) -> DataFrame:
    """run_id, batch_id, pos, error, kind: the first violation of each invalid batch."""
    found = batch_violations(batches, findings, chains).groupBy("run_id", "pos").agg(F.min(F.struct("step", "at", "error", "kind", "batch_id")).alias("m"))
    return found.select("run_id", "m.batch_id", "pos", "m.error", "m.kind")


def neutralized(batches: DataFrame, invalid: DataFrame) -> DataFrame:
    """Invalid batches keep id and targets, but are errors without verdicts."""
    bad = invalid.select("run_id", "pos", F.lit(True).alias("__bad"))
    none = F.array().cast(batches.schema["verdicts"].dataType)
    out = batches.join(bad, ["run_id", "pos"], "left")
    fixed = {"status": F.when(F.col("__bad"), "error").otherwise(F.col("status")), "verdicts": F.when(F.col("__bad"), none).otherwise(F.col("verdicts"))}
    return out.select(*[fixed[c].alias(c) if c in fixed else F.col(c) for c in batches.columns])


def _expected(batches: DataFrame) -> DataFrame:
    return batches.select("run_id", F.col("pos").cast("long").alias("pos"), "batch_id", F.posexplode("expected_targets").alias("at", "t")).select("run_id", "pos", "batch_id", "at", "t.target_type", "t.target_id")


def verdict_rows(batches: DataFrame, kind: str | None = None) -> DataFrame:
    """One row per target with its verdict; of several the last one. kind: targets of this type only, dealt by run and target, so that a join by these needs no further shuffle."""
    rows = batches.select("run_id", F.col("pos").cast("long").alias("pos"), "batch_id", F.posexplode("verdicts").alias("at", "v"))
    own = ("batch_id", "verdict", "new_severity", "new_confidence", "justification")
    target = F.col("v.target_type").alias("target_type")
    if kind is not None:
        rows, target = rows.where(F.col("v.target_type") == kind), F.lit(kind).alias("target_type")
    m = F.max_by(F.struct("batch_id", *[F.col(f"v.{c}").alias(c) for c in own[1:]]), F.struct("pos", "at")).alias("m")
    last = rows.groupBy("run_id", F.col("v.target_id").alias("target_id"), *([] if kind else [target])).agg(m)
    return last.select("run_id", target if kind else "target_type", "target_id", *[f"m.{c}" for c in own])


def chain_steps(batches: DataFrame) -> DataFrame:
    """run_id, chain_id, transition_verdicts: by the last verdict on each chain."""
    rows = batches.select("run_id", F.col("pos").cast("long").alias("pos"), F.posexplode("verdicts").alias("at", "v")).where("v.target_type = 'chain'")
    return rows.groupBy("run_id", F.col("v.target_id").alias("chain_id")).agg(F.max_by("v.transition_verdicts", F.struct("pos", "at")).alias("transition_verdicts"))


def run_violations(batches: DataFrame, findings: DataFrame, chains: DataFrame) -> DataFrame:
    """run_id, stage, a, b, error, kind, batch_id: all violations of whole runs, ordered by (stage, a, b)."""
    none = F.lit(None).cast("string")
    pick = ["run_id", "stage", "a", "b", "error", "kind", "batch_id"]
    shape = lambda df, stage, a, b, error, kind, batch=none: df.select("run_id", F.lit(stage).alias("stage"), a.cast("long").alias("a"), b.cast("long").alias("b"), error.alias("error"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), batch.alias("batch_id"))
    zero = F.lit(0)
    twice = lambda df, c: df.groupBy("run_id", c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = [
        shape(twice(findings, "finding_id"), 1, zero, zero, F.lit("duplicate finding id"), OURS),
        shape(twice(chains, "chain_id"), 1, F.lit(1), zero, F.lit("duplicate chain id"), OURS),
    ]
    own = first_batch_violations(batches, findings, chains)
    found.append(shape(own, 2, F.col("pos") * 2, zero, F.col("error"), F.col("kind"), F.when(F.col("kind") == THEIRS, F.col("batch_id"))))
    again = batches.withColumn("nth", F.row_number().over(Window.partitionBy("run_id", "batch_id").orderBy("pos"))).where("nth > 1")
    found.append(shape(again, 2, F.col("pos") * 2 + 1, F.lit(-1), F.concat(F.lit("duplicate batch id: "), "batch_id"), OURS))
    expected = _expected(batches)
    shared = expected.withColumn("first", F.min("pos").over(Window.partitionBy("run_id", "target_type", "target_id"))).where("pos > first")
    name = F.concat_ws(":", "target_type", "target_id")
    found.append(shape(shared, 2, F.col("pos") * 2 + 1, F.col("at"), F.concat(F.lit("target in two batches: "), name), OURS))
    members = chains.select("run_id", "pos", "chain_id", F.posexplode("finding_ids").alias("at", "finding_id"))
    classes = findings.groupBy("run_id", "finding_id").agg(F.min("vuln_class").alias("vuln_class"))
    joined = members.join(classes, ["run_id", "finding_id"], "left")
    bad = joined.where(F.col("vuln_class").isNull() | (F.col("vuln_class") == HYGIENE))
    found.append(shape(bad, 3, F.col("pos"), F.col("at"), F.when(F.col("vuln_class").isNull(), F.concat(F.lit("unknown member: "), "finding_id")).otherwise(F.concat(F.lit("hygiene member: "), "finding_id")), OURS))
    required = chains.select("run_id", F.lit("chain").alias("target_type"), F.col("chain_id").alias("target_id"), F.col("pos").cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    required = required.union(members.select("run_id", F.lit("finding"), "finding_id", F.col("pos").cast("long"), F.col("at").cast("long")))
    required = required.union(findings.where("provisional_severity = 'High'").select("run_id", F.lit("finding"), "finding_id", F.lit(1 << 60).cast("long"), F.col("number").cast("long")))
    missing = required.join(expected.select("run_id", "target_type", "target_id").distinct(), ["run_id", "target_type", "target_id"], "left_anti")
    found.append(shape(missing, 4, F.col("a"), F.col("b"), F.concat(F.lit("not dispatched: "), name), OURS))
    found.append(shape(chain_topology(chains).where("not valid"), 5, F.col("pos") * 2, zero, F.concat(F.lit("topology: "), "chain_id"), OURS))
    high = resolve_chains(findings, chains, batches).where("raises")
    found.append(shape(high, 5, F.col("pos") * 2 + 1, zero, F.concat(F.lit("raises above its ceiling: "), "chain_id"), THEIRS, F.col("batch_id")))
    return reduce(DataFrame.unionByName, found).select(*pick)


def run_errors(batches: DataFrame, findings: DataFrame, chains: DataFrame) -> DataFrame:
    """run_id, error, kind, batch_id: the first violation of each invalid run."""
    found = run_violations(batches, findings, chains).groupBy("run_id").agg(F.min(F.struct("stage", "a", "b", "error", "kind", "batch_id")).alias("m"))
    return found.select("run_id", "m.error", "m.kind", "m.batch_id")


def apply_to_findings(findings: DataFrame, batches: DataFrame) -> DataFrame:
    """Findings with verification_status, final_severity, final_confidence and the verdict's justification as reason."""
    v = verdict_rows(batches, "finding").select("run_id", F.col("target_id").alias("finding_id"), F.col("verdict").alias("__v"), "new_severity", "new_confidence", F.col("justification").alias("__j"))
    kept = [c for c in findings.columns if c not in ("verification_status", "final_severity", "final_confidence", "reason")]
    out = findings.select(*kept).join(v, ["run_id", "finding_id"], "left")
    verdict = F.col("__v")
    final = lambda own, new: F.when(verdict.isNull() | (verdict == "accepted"), F.col(own)).when(verdict == "downgraded", F.col(new))
    return out.select(
        *kept, F.coalesce(verdict, F.lit("not-requested")).alias("verification_status"), final("provisional_severity", "new_severity").alias("final_severity"), final("confidence", "new_confidence").alias("final_confidence"),
        F.when(verdict.isNull(), UNVERIFIED).otherwise(F.col("__j")).alias("reason"),
    )


def resolve_chains(findings: DataFrame, chains: DataFrame, batches: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """Chains with severity, confidence and verification_status after review, reason, unverified (a gap), raises, batch_id.

    Members are joined by (run, finding) and summed up per chain; one chain's members are few. judged: the result of apply_to_findings, where it's stored already.
    """
    f = (apply_to_findings(findings, batches) if judged is None else judged).select("run_id", "finding_id", F.col("verification_status").alias("s"), rank(F.col("final_severity"), SEVERITY, 0).alias("fs"), rank(F.col("final_confidence"), CONFIDENCE, 0).alias("fc"))
    m = chains.select("run_id", "chain_id", F.posexplode("finding_ids").alias("at", "finding_id")).join(f, ["run_id", "finding_id"], "left")
    ids = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("s") == s, F.struct("at", "finding_id")))), lambda x: x["finding_id"]), ", ")
    m = m.groupBy("run_id", "chain_id").agg(
        F.min(F.coalesce(F.col("s") == "accepted", F.lit(False))).alias("all_ok"), ids("rejected").alias("bad"), ids("not-requested").alias("open"), F.max(F.coalesce("fs", F.lit(0))).alias("ms"), F.min(F.coalesce("fc", F.lit(0))).alias("mc")
    )
    v = verdict_rows(batches, "chain").select("run_id", F.col("target_id").alias("chain_id"), "verdict", F.col("new_severity").alias("ns"), F.col("new_confidence").alias("nc"), "justification", "batch_id")
    kept = [c for c in chains.columns if c not in ("severity", "confidence", "verification_status", "reason", "batch_id", "verdict")]
    x = chains.join(m, ["run_id", "chain_id"], "left").join(v, ["run_id", "chain_id"], "left")
    critical = F.col("all_ok") & (F.col("mc") == 2) & (F.col("entry_point.auth") == "unauthenticated") & (F.col("final_impact") == "unauth-rce")
    natural_s, natural_c = F.when(critical, 4).otherwise(F.col("ms")), F.when(critical, 2).otherwise(F.col("mc"))
    verdict = F.col("verdict")
    status = (
        F.when(verdict.isNull(), "not-requested").when(verdict == "rejected", "rejected").when(F.col("bad") != "", "rejected").when(F.col("open") != "", "not-requested").otherwise(verdict)
    )
    x = x.withColumn("__st", status)
    own_s, own_c = rank(F.col("severity"), SEVERITY, 0), rank(F.col("confidence"), CONFIDENCE, 0)
    severity = F.when(F.col("__st") == "rejected", unrank(F.least(own_s, F.lit(2)), SEVERITY)).when(F.col("__st") == "downgraded", F.col("ns")).when(F.col("__st") == "accepted", unrank(natural_s, SEVERITY)).otherwise(F.col("severity"))
    confidence = F.when(F.col("__st") == "rejected", "to verify").when(F.col("__st") == "downgraded", F.col("nc")).when(F.col("__st") == "accepted", unrank(natural_c, CONFIDENCE)).otherwise(F.col("confidence"))
    reason = (
        F.when(verdict.isNull(), UNVERIFIED).when(verdict == "rejected", F.col("justification")).when(F.col("bad") != "", F.concat(F.lit("member finding(s) rejected: "), "bad"))
        .when(F.col("open") != "", F.concat(F.lit("member finding(s) unverified: "), "open")).otherwise(F.col("justification"))
    )
    low_s, low_c = unrank(F.least(own_s, natural_s), SEVERITY), unrank(F.least(own_c, natural_c), CONFIDENCE)
    raises = (F.col("__st") == "downgraded") & ~_at_most(low_s, low_c, F.col("ns"), F.col("nc"))
    return x.select(
        *kept, severity.alias("severity"), confidence.alias("confidence"), F.col("__st").alias("verification_status"), reason.alias("reason"),
        F.coalesce((F.col("__st") == "not-requested") & verdict.isNotNull(), F.lit(False)).alias("unverified"), F.coalesce(raises, F.lit(False)).alias("raises"), "batch_id",
    )


def verification_gaps(batches: DataFrame, resolved: DataFrame) -> DataFrame:
    """run_id, target_type, target_id, reason: targets without a verdict, and chains with unverified members."""
    seen = verdict_rows(batches).select("run_id", "target_type", "target_id")
    silent = _expected(batches).join(seen, ["run_id", "target_type", "target_id"], "left_anti")
    silent = silent.select("run_id", "target_type", "target_id", F.concat(F.lit("no verdict (batch "), "batch_id", F.lit(")")).alias("reason"))
    return silent.union(resolved.where("unverified").select("run_id", F.lit("chain"), "chain_id", "reason"))


def decision_log(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """run_id, target_type, target_id, outcome, reason of every finding and chain."""
    f = findings.select("run_id", F.lit("finding").alias("target_type"), F.col("finding_id").alias("target_id"), F.col("verification_status").alias("outcome"), "reason")
    return f.union(resolved.select("run_id", F.lit("chain"), "chain_id", "verification_status", "reason"))
