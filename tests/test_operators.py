"""Operators on small literal frames."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from leadmill.functions import paths, ranks
from leadmill.functions.text import padded, truncated
from leadmill.operators import findings, gates, incremental, leads, marts, scoring, sinks, surface, verdicts
from leadmill.sources import files

LOC = "struct<file:string,line:int,symbol:string,kind:string>"
RAW = f"run_id string, pos long, finding_id string, partition_id string, title string, vuln_class string, source {LOC}, sink {LOC}, auth string, provisional_severity string, confidence string, origin string, direct_flow boolean, evidence array<struct<file:string,line:int>>, prerequisites array<string>, source_lead_ids array<string>"


def raw(spark, rows):
    base = {"vuln_class": "sqli", "source": ("a.java", 1, "q", "p"), "sink": ("b.java", 2, "s", "c"), "auth": "admin", "severity": "Low", "confidence": "likely", "origin": None, "direct": None, "evidence": [], "pre": [], "leads": [], "run": "r"}
    out = []
    for i, (fid, part, over) in enumerate(rows):
        x = base | over
        out.append((x["run"], i, fid, part, "t " + fid, x["vuln_class"], x["source"], x["sink"], x["auth"], x["severity"], x["confidence"], x["origin"], x["direct"], x["evidence"], x["pre"], x["leads"]))
    return spark.createDataFrame(out, RAW)


ROWS = [
    ("p2-F001", "p2", {"severity": "High", "confidence": "strong static proof", "auth": "authenticated", "origin": "sast-lead", "evidence": [("f", 100), ("f", 20)], "pre": ["b"], "leads": ["L002"]}),
    ("p1-F001", "p1", {"confidence": "to verify", "direct": True, "evidence": [("f", 20)], "pre": ["a", "b"]}),
    ("p1-F002", "p1", {"sink": ("b.java", 2, "other", "c")}),
    ("p1-F003", "p1", {"source": ("a.java", 10, "q", "p")}),
    ("p1-F001", "p1", {"run": "r2"}),
]


def test_merge_takes_worst_severity_and_least_confidence(spark):
    df = raw(spark, ROWS)
    got = {(r.run_id, r.number): r for r in findings.canonical_findings(df).collect()}
    assert len(got) == 4
    a = got["r", 2]  # symbols other, s: the same lines, so the symbol decides
    assert (a.finding_id, a.provisional_severity, a.confidence, a.auth, a.origin, a.direct_flow) == ("F-2", "High", "to verify", "authenticated", "both", True)
    assert (a.title, a.partition_id, a.partitions, a.source_finding_ids, a.prerequisites, a.source_lead_ids) == ("t p1-F001", "p1", ["p1", "p2"], ["p1-F001", "p2-F001"], ["a", "b"], ["L002"])
    assert [e.line for e in a.evidence] == [100, 20]  # in the order of their text
    assert got["r", 1].direct_flow is None and got["r", 1].source_lead_ids is None and got["r", 1].origin == "llm-discovered"
    assert got["r", 3].source.line == 10
    again = {(r.run_id, r.number): r for r in findings.canonical_findings(df.orderBy(F.desc("pos")).repartition(7)).collect()}
    assert got == again
    alone = [r for r in findings.canonical_findings(df.where("run_id = 'r2'")).collect()]
    assert alone == [got["r2", 1]]


def test_duplicate_ids_fail_their_run_only(spark):
    df = raw(spark, [("b", "p", {}), ("a", "p", {}), ("a", "p", {}), ("b", "p", {}), ("a", "p", {"run": "other"})])
    assert [tuple(r) for r in findings.duplicate_ids(df).collect()] == [("r", "a")]
    assert {r.run_id for r in findings.without_failed_runs(df).collect()} == {"other"}


def test_paths(spark):
    rows = [("a/./b//c/../d", "/a/b/d"), ("../../x", "/x"), ("/work/apps/x", "/work/apps/x"), ("", "/")]
    got = {r.p: r.f for r in spark.createDataFrame([(a,) for a, _ in rows], "p string").select("p", paths.folded(F.col("p")).alias("f")).collect()}
    assert got == dict(rows)
    cases = [
        ("src/a%20b.java", None, "/work/app/src/a b.java"), ("src/a+b", None, "/work/app/src/a+b"), ("src/%zz", None, None), ("http://h/x", None, None), ("file://localhost/work/app/x", None, "/work/app/x"), ("file://host/x", None, None),
        ("file:///x/y", None, "/x/y"), ("x", "sub/", "/work/app/sub/x"), ("x", "file:///abs/", "/abs/x"), ("", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, u, b) for i, (u, b, _) in enumerate(cases)], "i int, u string, b string")
    assert [r.p for r in df.select("i", paths.resolved_uri(F.col("u"), F.col("b"), F.lit("/work/app")).alias("p")).orderBy("i").collect()] == [w for _, _, w in cases]
    assert [r.x for r in spark.createDataFrame([("src/build/a.java",), ("build",), ("a.min.js",), ("src/a.java",)], "p string").select(paths.excluded(F.col("p")).alias("x")).collect()] == [True, False, True, False]


def test_text_helpers(spark):
    df = spark.createDataFrame([("ab𝒳d", 7), ("abcdef", 1234), (None, 12)], "s string, n int")
    assert [tuple(r) for r in df.select(truncated(F.col("s"), 4), padded(F.col("n"), 3)).collect()] == [("ab𝒳d", "007"), ("abc…", "1234"), ("", "012")]


def sarif(**over):
    place = lambda uri, line: {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}}
    result = {"ruleId": "java.sqli.a", "message": {"text": "m" * 600}, "locations": [place("src/a.java", 3)], "codeFlows": [{"threadFlows": [{"locations": [{"location": place("src/a.java" if i % 2 else "gone", i + 1)} for i in range(150)]}]}]}
    more = [{"rule": {"id": "x"}, "locations": [place("../out", 1)]}, {"rule": {"index": 0}, "message": {}, "locations": [place("src/a.java", 1)]}, {"locations": []}]
    return {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "Semgrep OSS", "rules": [{"id": "by.index"}]}}, "results": [result, *more]}, {"results": [result]}]} | over


def test_leads(spark):
    docs = spark.createDataFrame([("r", "a", json.dumps(sarif())), ("r", "b", "nope"), ("r", "c", json.dumps(sarif(version="2.0.0"))), ("r", "d", '{"version":"2.1.0","runs":5}'), ("q", "a", json.dumps(sarif()))], "run_id string, doc string, text string")
    manifest = spark.createDataFrame([("r", "src/a.java"), ("q", "src/a.java")], "run_id string, file string")
    rules = spark.createDataFrame([("semgrep", 0, None, "java.sqli", "sqli"), ("semgrep", 1, "java.sqli.a", None, "later")], "tool string, pos int, rule string, prefix string, vuln_class string")
    assert {(r.doc, r.error) for r in leads.document_errors(docs).where("run_id = 'r'").collect()} == {("b", "malformed SARIF: not JSON"), ("c", "unsupported SARIF version"), ("d", "malformed SARIF: missing runs[]")}
    results = leads.resolved_results(docs, manifest, rules, "/work/app")
    got = leads.leads(results, leads.codeflows(results, manifest, "/work/app")).where("run_id = 'r'").orderBy("lead_id").collect()
    assert [(r.lead_id, r.tool, r.rule_id, r.vuln_class_hint, r.file, r.line) for r in got] == [
        ("L001", "semgrep", "java.sqli.a", "sqli", "src/a.java", 3), ("L002", "semgrep", "by.index", "unknown", "src/a.java", 1), ("L003", "unknown", "java.sqli.a", "unknown", "src/a.java", 3),
    ]
    assert len(got[0].message) == 512 and got[0].message.endswith("…") and got[1].message == "" and got[1].codeflow is None
    assert [s.line for s in got[0].codeflow] == list(range(2, 130, 2))  # the first 64 that resolve
    stats = leads.ingest_stats(results).where("run_id = 'r'").first()
    assert (stats.total, stats.kept, stats.dropped_out_of_scope, stats.dropped_bad_location, stats.unmapped_rules) == (5, 3, 1, 1, 2)
    root = spark.createDataFrame([("r", ""), ("r", "src/a.java")], "run_id string, file string")
    bad = sarif()
    bad["runs"][0]["results"][2]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] = "."
    broken = leads.resolved_results(spark.createDataFrame([("r", "a", json.dumps(bad))], docs.schema), root, rules, "/work/app")
    # Another document of the run goes on counting, so that a lead's id is its own.
    more = leads.resolved_results(docs.unionByName(spark.createDataFrame([("r", "a2", json.dumps(sarif()))], docs.schema)), manifest, rules, "/work/app")
    assert [(x.doc, x.lead_id) for x in leads.leads(more).where("run_id = 'r'").orderBy("lead_id").collect()] == [("a", f"L00{k}") for k in (1, 2, 3)] + [("a2", f"L00{k}") for k in (4, 5, 6)]
    assert leads.ingest_stats(more).where("run_id = 'r'").first().total == 10
    outcome = spark.createDataFrame([("r", "L001", "refuted", "no"), ("r", "L004", "inconclusive", ""), ("r", "L005", "promoted", None)], "run_id string, lead_id string, outcome string, reason string")
    assert [tuple(x) for x in marts.refuted_leads(outcome, leads.leads(more)).collect()] == [("r", "L001", "no", "java.sqli.a", "src/a.java", 3)]
    assert [tuple(x) for x in marts.inconclusive_leads(outcome).collect()] == [("r", "inconclusive-lead", "L004", "inconclusive")]
    assert leads.leads(broken).count() == 0 and leads.invalid_documents(broken).count() == 1


def test_surface(spark):
    tokens = spark.createDataFrame([("java", ["getParameter", ""], ["exec("], ["escape"], ["@Auth", "login"])], "stack string, sources array<string>, sinks array<string>, sanitizers array<string>, auth_markers array<string>")
    f = [
        ("r", "p", "java", "b", "getParameter getParameter exec(exec( xlogin login1 my_login", None), ("r", "p", "java", "a", "getParameter\n@Authx login.", None), ("r", "p", "java", "c", None, "missing"),
        ("r", "dead", "java", "d", None, "out_of_scope"), ("r", "odd", "cobol", "e", "getParameter", None),
    ]
    df = spark.createDataFrame(f, "run_id string, partition_id string, stack string, path string, content string, skip_reason string")
    v = {r.partition_id: r for r in surface.surface_vectors(surface.file_hits(df, tokens)).collect()}
    p = v["p"]
    assert (p.sources, p.sinks, p.source_hits, p.sink_hits, p.auth_markers, p.auth_hits, p.source_and_auth_files, p.skipped_missing) == (2, 1, 3, 2, 1, 2, 1, 1)
    assert p.content_key == hashlib.sha256(b"a\nb\nc").hexdigest()
    raw_ = b"".join(hashlib.sha256(x.encode()).digest() + b"\0" for x in (f[1][4], f[0][4]))
    assert p.file_content_digest == hashlib.sha256(raw_).hexdigest()
    assert (v["dead"].scannable, v["dead"].sources, v["odd"].scannable, v["odd"].skipped_missing) == (False, None, False, None)
    a = {r.partition_id: (r.allocation, r.score) for r in surface.allocate(spark.createDataFrame(list(v.values()))).collect()}
    assert a == {"p": ("analyze", 1 + 2 + 3 + 4 + 2), "dead": ("unreadable-partition", 0), "odd": ("unsupported-stack", 0)}
    with pytest.raises(ValueError):
        surface.allocate(df, budget=0)


V = "struct<target_type:string,target_id:string,verdict:string,new_severity:string,new_confidence:string,justification:string,counterexamples:array<struct<checked:boolean,refuted:boolean>>,transition_verdicts:array<struct<`from`:string,`to`:string,verdict:string>>>"


def review(spark, *cases):
    """Findings, chains and batches of one run per case; a case is (batches, changes of its chain)."""
    f, chains, b = [], [], []
    for k, (batches, chain) in enumerate(cases):
        run = f"r{k}"
        f += [(run, 1, "F-1", "sqli", "High", "strong static proof"), (run, 2, "F-2", "rce", "Medium", "strong static proof"), (run, 3, "F-3", "trust-boundary", "Low", "likely")]
        c = {"ids": ["F-1", "F-2"], "steps": [("entry", "F-1"), ("F-1", "F-2")], "impact": "unauth-rce", "auth": "unauthenticated"} | (chain or {})
        chains.append((run, 1, "CHAIN-1", ("a", 1, c["auth"]), c["ids"], c["steps"], c["impact"], "High", "likely"))
        b += [(run, i, *x) for i, x in enumerate(batches)]
    return (
        spark.createDataFrame(f, "run_id string, number long, finding_id string, vuln_class string, provisional_severity string, confidence string"),
        spark.createDataFrame(chains, "run_id string, pos long, chain_id string, entry_point struct<file:string,line:int,auth:string>, finding_ids array<string>, transitions array<struct<`from`:string,`to`:string>>, final_impact string, severity string, confidence string"),
        spark.createDataFrame(b, f"run_id string, pos long, batch_id string, expected_targets array<struct<target_type:string,target_id:string>>, status string, verdicts array<{V}>"),
    )


def fv(i, verdict="accepted", sev=None, conf=None, ces=((True, True),)):
    return ("finding", i, verdict, sev, conf, "why " + i, list(ces), None)


def cv(verdict="accepted", sev=None, conf=None, steps=(("entry", "F-1", "accepted"), ("F-1", "F-2", "accepted"))):
    return ("chain", "CHAIN-1", verdict, sev, conf, "why", None, list(steps))


TF = [("finding", "F-1"), ("finding", "F-2")]
TC = [("chain", "CHAIN-1")]
GOOD = [("B1", TF, "ok", [fv("F-1"), fv("F-2")]), ("C1", TC, "ok", [cv()])]


def test_accepted_chain_becomes_critical(spark):
    f, c, b = review(spark, (GOOD, None))
    assert verdicts.run_errors(b, f, c).count() == 0
    r = verdicts.resolve_chains(f, c, b).first()
    assert (r.severity, r.confidence, r.verification_status) == ("Critical", "strong static proof", "accepted")
    final = verdicts.apply_to_findings(f, b)
    assert {x.finding_id: (x.verification_status, x.final_severity) for x in final.collect()} == {"F-1": ("accepted", "High"), "F-2": ("accepted", "Medium"), "F-3": ("not-requested", "Low")}
    counts = marts.severity_counts(final, verdicts.resolve_chains(f, c, b)).first()
    assert (counts.critical, counts.high, counts.medium, counts.low) == (1, 1, 1, 1)


def test_chain_outcomes(spark):
    cases = [
        ([("B1", TF, "ok", [fv("F-1"), fv("F-2", "rejected", ces=((True, False),))]), ("C1", TC, "ok", [cv()])], None, "rejected", "Medium"),
        ([("B1", TF, "partial", [fv("F-1")]), ("C1", TC, "ok", [cv()])], None, "not-requested", "High"),
        ([("B1", TF, "ok", [fv("F-1"), fv("F-2", "downgraded", "Low", "likely", ((True, False),))]), ("C1", TC, "ok", [cv()])], None, "accepted", "High"),
        ([("B1", TF, "ok", [fv("F-1"), fv("F-2")]), ("C1", TC, "ok", [cv()])], {"auth": "admin"}, "accepted", "High"),
        ([("B1", TF, "ok", [fv("F-1"), fv("F-2")]), ("C1", TC, "ok", [cv("downgraded", "Low", "to verify")])], None, "downgraded", "Low"),
        ([("B1", TF, "ok", [fv("F-1"), fv("F-2")]), ("C1", TC, "error", [])], None, "not-requested", "High"),
    ]
    f, c, b = review(spark, *[x[:2] for x in cases])
    got = {r.run_id: (r.verification_status, r.severity) for r in verdicts.resolve_chains(f, c, b).collect()}
    assert got == {f"r{k}": x[2:] for k, x in enumerate(cases)}




def test_first_error_of_a_run(spark):
    cases = [
        ([("", TF, "ok", [])], None, "no batch_id"), ([("B1", [], "ok", [])], None, "no expected targets"), ([("B1", TF, "ok", None)], None, "no verdicts array"), ([("B1", TF, "done", [])], None, "unknown status"),
        ([("B1", [*TF, *TC], "ok", [])], None, "composition"), ([("B1", [TF[0], TF[0]], "ok", [])], None, "target twice: finding:F-1"), ([("B1", [("finding", "F-9")], "ok", [])], None, "unknown target: finding:F-9"),
        ([("B1", TF, "ok", [fv("F-3")])], None, "unexpected verdict: finding:F-3"), ([("B1", TF, "ok", [fv("F-1"), fv("F-1")])], None, "second verdict: finding:F-1"), ([("B1", TF, "ok", [fv("F-2", "downgraded", "High", "likely")])], None, "raised: finding:F-2"),
        ([("B1", TF, "ok", [fv("F-1", ces=())])], None, "no counterexamples: finding:F-1"), ([("B1", TF, "ok", [fv("F-1", ces=((True, False),))])], None, "unrefuted counterexample: finding:F-1"),
        ([("B1", TF, "ok", [fv("F-1", "rejected")])], None, "no counterexample holds: finding:F-1"), ([("C1", TC, "ok", [cv(steps=(("entry", "F-1", "accepted"),))])], None, "transitions differ: chain:CHAIN-1"),
        ([("C1", TC, "ok", [cv(steps=(("entry", "F-1", "rejected"), ("F-1", "F-2", "accepted")))])], None, "rejected transition: chain:CHAIN-1"), ([("B1", TF, "ok", [fv("F-1")])], None, "coverage doesn't fit the status"),
        ([*GOOD, ("B1", [("finding", "F-3")], "error", [])], None, "duplicate batch id: B1"), ([*GOOD, ("B2", [TF[1]], "error", [])], None, "target in two batches: finding:F-2"), (GOOD, {"ids": ["F-1", "F-9"]}, "unknown member: F-9"),
        (GOOD, {"ids": ["F-1", "F-3"]}, "hygiene member: F-3"), ([GOOD[0]], None, "not dispatched: chain:CHAIN-1"), ([GOOD[1]], None, "not dispatched: finding:F-1"),
        ([GOOD[0], ("C1", TC, "error", [])], {"steps": [("entry", "F-2"), ("F-2", "F-1")]}, "topology: CHAIN-1"),
        ([("B1", TF, "ok", [fv("F-1"), fv("F-2")]), ("C1", TC, "ok", [cv("downgraded", "Critical", "likely")])], None, "raises above its ceiling: CHAIN-1"),
    ]
    f, c, b = review(spark, (GOOD, None), *[x[:2] for x in cases])
    got = {r.run_id: r.error for r in verdicts.run_errors(b, f, c).collect()}
    assert got == {f"r{k}": x[2] for k, x in enumerate(cases, 1)}


def test_exports_and_graph(spark):
    loc = lambda f, n: (f, n, "s", "k")
    f = spark.createDataFrame(
        [
            ("r", 1, "F-1", "one", "sqli", loc("a.java", 1), loc("b.java", 2), "High", "accepted", "High"), ("r", 2, "F-2", "two", "trust-boundary", loc("c.java", 3), loc("d.java", 4), "Low", "not-requested", "Low"),
            ("r", 3, "F-3", "three", "xss", loc("a.java", 9), loc("b.java", 9), "Medium", "rejected", None), ("r", 4, "F-4", "four", "xss", loc("a.java", 7), loc("b.java", 8), "High", "downgraded", "Info"),
        ],
        f"run_id string, number int, finding_id string, title string, vuln_class string, source {LOC}, sink {LOC}, provisional_severity string, verification_status string, final_severity string",
    )
    step = "array<struct<`from`:string,`to`:string,evidence:array<struct<file:string,line:int>>>>"
    c = spark.createDataFrame(
        [("r", "CHAIN-1", ("e.java", 5, "unauthenticated"), ["F-1", "F-4"], [("entry", "F-1", [("a.java", 6), ("x", 1)]), ("F-1", "F-4", [])], "unauth-rce", "Critical", "downgraded"), ("r", "CHAIN-2", ("e.java", 8, "admin"), ["F-1"], [("entry", "F-1", None)], "leak", "Low", "not-requested")],
        f"run_id string, chain_id string, entry_point struct<file:string,line:int,auth:string>, finding_ids array<string>, transitions {step}, final_impact string, severity string, verification_status string",
    )
    leads_ = spark.createDataFrame(
        [("r", "L001", "refuted", "safe", "q.java", 1), ("r", "L002", "refuted", None, None, None), ("r", "L003", "inconclusive", "", "q.java", 2), ("r", "L004", "promoted", None, "q.java", 3), ("r", "L005", "what", None, None, None)],
        "run_id string, lead_id string, outcome string, reason string, file string, line int",
    )
    results = marts.sarif_results(f, c, leads_)
    doc = json.loads(sinks.sarif_documents(results, marts.sarif_rules(results)).first().text)
    out, rules = doc["runs"][0]["results"], doc["runs"][0]["tool"]["driver"]["rules"]
    place = lambda file, line: {"physicalLocation": {"artifactLocation": {"uri": file}, "region": {"startLine": line}}}
    assert [(x["ruleId"], x["level"], x["message"]["text"]) for x in out] == [
        ("sqli", "error", "one"), ("trust-boundary", "note", "two"), ("xss", "note", "four"), ("exploit-chain", "error", "unauth-rce via CHAIN-1"), ("exploit-chain", "note", "leak via CHAIN-2"), ("sast-lead-refuted", "note", "safe"),
        ("sast-lead-refuted", "note", "refuted by audit"), ("sast-lead-inconclusive", "note", "inconclusive"),
    ]
    assert out[0]["locations"] == [place("a.java", 1)] and out[0]["relatedLocations"] == [place("b.java", 2) | {"message": {"text": "sink"}}] and out[1]["properties"] == {"lane": "hygiene"} and "properties" not in out[0]
    assert out[3]["codeFlows"] == [{"threadFlows": [{"locations": [{"location": place("e.java", 5)}, {"location": place("a.java", 6)}]}]}] and out[4]["codeFlows"][0]["threadFlows"][0]["locations"] == [{"location": place("e.java", 8)}]
    assert [x.get("suppressions") for x in out[5:]] == [[{"kind": "external", "justification": "safe"}], [{"kind": "external", "justification": "audit assessed not exploitable"}], None] and [("locations" in x) for x in out[5:]] == [True, False, True]
    assert [(x["id"], x["defaultConfiguration"]["level"], x.get("properties")) for x in rules] == [
        ("sqli", "error", None), ("trust-boundary", "note", {"cwe": "CWE-501"}), ("xss", "note", None), ("exploit-chain", "error", None), ("sast-lead-refuted", "note", None), ("sast-lead-inconclusive", "note", None),
    ]
    cases = marts.junit_cases(f, c, leads_, "low").orderBy("section", "key").collect()
    assert [(x.classname, x.outcome, x.message, x.body) for x in cases] == [
        ("sqli", "failure", "High sqli: one", "finding_id=F-1 source=a.java:1 sink=b.java:2"), ("trust-boundary", "passed", None, None), ("xss", "passed", None, None),
        ("exploit-chain", "failure", "Critical exploit-chain: unauth-rce via CHAIN-1", "chain_id=CHAIN-1 entry=e.java:5 impact=unauth-rce"), ("exploit-chain", "passed", None, None), ("sast-lead-refuted", "skipped", "safe", None), ("sast-lead-refuted", "skipped", "refuted by audit", None),
    ]
    assert {x.outcome for x in marts.junit_cases(f, c, leads_, "no such level").collect()} == {"passed", "skipped"}
    steps = spark.createDataFrame([("r", "CHAIN-1", [("entry", "F-1", "accepted"), ("F-1", "F-4", "rejected")])], "run_id string, chain_id string, transition_verdicts array<struct<`from`:string,`to`:string,verdict:string>>")
    g = {x.chain_id: x for x in marts.chain_graph(c, steps).collect()}
    assert g["CHAIN-1"].nodes == ["entry", "F-1", "F-4", "RCE"] and [tuple(e) for e in g["CHAIN-1"].edges] == [("entry", "F-1", "downgraded"), ("F-1", "F-4", "rejected"), ("F-4", "RCE", "downgraded")]
    assert g["CHAIN-2"].nodes == ["entry", "F-1"] and [tuple(e) for e in g["CHAIN-2"].edges] == [("entry", "F-1", None)] and g["CHAIN-2"].coherent
    runs = spark.createDataFrame([("r", "t", "java", "d", None)], "run_id string, target string, stack string, date string, proof_level string")
    chains = c.withColumn("confidence", F.lit("likely"))
    parts = spark.createDataFrame([("r",)], "run_id string")
    s = sinks.summary_documents(runs, marts.run_verdict(f, chains), marts.severity_counts(f, chains), marts.status_counts(f), marts.coverage_counts(parts, parts), marts.chain_graph(chains, steps)).first()
    assert s.valid, s.errors
    assert json.loads(s.text)["severity_counts"] == {"Critical": 0, "High": 1, "Medium": 0, "Low": 1, "Info": 1} and [x["id"] for x in json.loads(s.text)["chains"]] == ["CHAIN-1"]


def test_first_run_of_a_document(spark):
    one = {"tool": {"driver": {"rules": [{"id": "a", "properties": {"tags": ["CWE-1"]}}, {"id": "a", "properties": {"tags": ["CWE-327: x", "CWE-89", "other"]}}, {"id": "b"}]}}, "results": [{"ruleId": r, "locations": [{"physicalLocation": {"artifactLocation": {"uri": u}}}]} for r, u in (("a", "x/BenchmarkTest00001.java"), ("b", "BenchmarkTest00002"), ("c", "BenchmarkTest00003"), ("a", "other"))] + [{"ruleId": "a"}]}
    late = {"tool": {"driver": {"rules": []}}, "results": [{"ruleId": "a", "locations": [{"physicalLocation": {"artifactLocation": {"uri": "BenchmarkTest00009"}}}]}]}
    docs = spark.createDataFrame([("r", "d", json.dumps({"runs": [one, late]})), ("r", "e", '{"runs": []}'), ("r", "f", "no")], "run_id string, doc string, text string")
    rules, results = scoring.rule_cwes(scoring.tool_rules(docs)), scoring.tool_results(docs)
    assert {r.rule_id: r.cwes for r in rules.collect()} == {"a": [89, 327], "b": []} and results.count() == 5
    flagged = scoring.flagged_by_case(results, rules)
    assert {r.test_id: r.cwes for r in flagged.collect()} == {"BenchmarkTest00001": [89, 327], "BenchmarkTest00002": [], "BenchmarkTest00003": []}
    truth = spark.createDataFrame([("r", "BenchmarkTest00001", "c", True, 326), ("r", "BenchmarkTest00002", "c", True, 89), ("q", "BenchmarkTest00001", "c", True, 89)], "run_id string, test_id string, category string, is_real boolean, cwe int")
    assert {(r.run_id, r.test_id): r.flagged for r in scoring.flagged_cases(truth, flagged).collect()} == {("r", "BenchmarkTest00001"): True, ("r", "BenchmarkTest00002"): False, ("q", "BenchmarkTest00001"): False}
    staged = scoring.staged_results(results, truth.where("run_id = 'r'"), "s").orderBy("pos").collect()
    assert [(r.pos, r.uri) for r in staged] == [(0, "s/BenchmarkTest00001.java"), (1, "s/BenchmarkTest00002.java")]


def golden(spark):
    """The published 88 cases by their counts."""
    kinds = [(40, True, True, "promoted", False), (1, True, True, "refuted", False), (15, True, False, "refuted", False), (1, False, True, "no-lead", True), (2, False, True, "no-lead", False), (29, False, False, "no-lead", False)]
    rows, n = [], 0
    for count, flagged, real, adjudication, alone in kinds:
        for _ in range(count):
            n += 1
            rows.append(("r", f"BenchmarkTest{n:05}", flagged, True, adjudication, alone, 89, True, real, "sqli"))
    df = spark.createDataFrame(rows, "run_id string, test_id string, flagged boolean, covered boolean, adjudication string, independent boolean, cwe int, attempted boolean, is_real boolean, category string")
    return df, df.select("run_id", "test_id", "category", "is_real", "cwe")


def test_published_matrices(spark):
    ledger, truth = golden(spark)
    rows = scoring.joined(ledger, truth)
    m = {r.matrix: r for r in scoring.three_matrices(rows).collect()}
    cells = lambda r: (r.tp, r.fp, r.fn, r.tn)
    assert cells(m["raw"]) == (41, 15, 3, 29) and cells(m["adjudicated"]) == (40, 0, 1, 15) and cells(m["hybrid"]) == (41, 0, 3, 44)
    assert [round(x, 3) for x in (m["raw"].precision, m["raw"].recall, m["raw"].fpr, m["raw"].youden)] == [0.732, 0.932, 0.341, 0.591]
    assert [round(m["adjudicated"][k], 3) for k in ("precision", "recall", "fpr", "youden")] == [1.0, 0.976, 0.0, 0.976]
    d = scoring.exclusions_and_deltas(rows).first()
    assert (d.fp_refuted, d.recall_cost, d.fn_recovered) == (15, 1, 1)
    assert scoring.first_ledger_violation(ledger.withColumn("pos", F.col("test_id")), truth).count() == 0
    none = scoring.three_matrices(rows.where("test_id > 'BenchmarkTest00086'")).where("matrix = 'adjudicated'").first()
    assert cells(none) == (0, 0, 0, 0) and none.precision == 0.0
    # Two runs don't mix, though they share case ids.
    other = lambda df: df.withColumn("run_id", F.lit("other"))
    both = scoring.joined(ledger.union(other(ledger).where("flagged")), truth.union(other(truth)))
    assert {(x.run_id, *cells(x)) for x in scoring.three_matrices(both).where("matrix = 'raw'").collect()} == {("r", 41, 15, 3, 29), ("other", 41, 15, 0, 0)}


def test_last_report_wins_and_rejected_leads(spark, tmp_path):
    a = {"run": {"run_id": "r", "generated": "d", "scope": [], "path_map": {"app/x.java": "BenchmarkTest00002"}}, "coverage": {"analyzed": [], "skipped": [], "benchmark_cases": [{"test_id": "BenchmarkTest00001", "status": "analyzed"}]}, "findings": [], "chains": [], "verdicts": []}
    f = {"finding_id": "F-1", "source": {"file": "app/x.java", "line": 1}, "origin": "llm-discovered", "verification_status": "rejected", "source_finding_ids": ["p-F001"]}
    leads_ = [{"lead_id": "L001", "outcome": "promoted", "finding_id": "p-F001", "location": {"file": "app/x.java", "line": 1}}, {"lead_id": "L002", "outcome": "inconclusive", "test_id": "BenchmarkTest00003"}]
    b = a | {"coverage": a["coverage"] | {"benchmark_cases": [{"test_id": "BenchmarkTest00001", "status": "gap"}]}, "findings": [f], "lead_adjudications": leads_}
    for name, doc in (("1.json", a), ("2.json", b)):
        (tmp_path / name).write_text(json.dumps(doc))
    found = {r.test_id: r for r in scoring.adjudication_map(files.report_cases(files.read_reports(spark, str(tmp_path)))).collect()}
    assert not found["BenchmarkTest00001"].covered and found["BenchmarkTest00002"].independent and found["BenchmarkTest00002"].adjudication == "refuted" and found["BenchmarkTest00003"].adjudication == "inconclusive"


def test_contracts(spark):
    loc = {"file": "a", "line": 1, "symbol": "s", "kind": "k"}
    finding = {"finding_id": "p-F001", "partition_id": "p", "title": "t", "vuln_class": "sqli", "source": loc, "sink": loc, "auth": "admin", "provisional_severity": "High", "confidence": "likely", "verification_status": "not-requested"}
    final = finding | {"finding_id": "F-1", "partitions": ["p"], "source_finding_ids": ["p-F001"], "final_severity": "Low", "final_confidence": "likely", "verification_status": "accepted"}
    verdict = {"target_type": "finding", "target_id": "F-1", "verdict": "accepted", "justification": "j", "counterexamples": [{"hypothesis": "h", "checked": True, "refuted": True}]}
    chain = {"chain_id": "CHAIN-1", "entry_point": {"file": "a", "line": 0, "route": "/", "auth": "admin"}, "finding_ids": ["F-1"], "transitions": [{"from": "entry", "to": "F-1", "how": "h", "evidence": [{"file": "a", "line": 1}]}], "final_impact": "x", "severity": "High", "confidence": "likely", "verification_status": "accepted"}
    response = {"partition_id": "p", "status": "ok", "findings": [finding], "coverage": {"analyzed": ["a"], "skipped": [{"path": "x", "reason": "r"}]}, "adjudicated_leads": [{"lead_id": "L001", "outcome": "promoted", "finding_id": "p-F001"}]}
    report = {"run": {"run_id": "r", "generated": "g", "scope": ["s"], "path_map": {}}, "coverage": {"analyzed": [], "skipped": []}, "findings": [final], "chains": [chain], "verdicts": [verdict]}
    counts = {"Critical": 0, "High": 1, "Medium": 0, "Low": 0, "Info": 0}
    summary = {"meta": {"target": "t", "stack": "s", "date": "d", "verdict": "no-critique", "proof_level": None}, "severity_counts": counts, "finding_status_counts": {"accepted": 1, "downgraded": 0, "rejected": 0, "not-requested": 0}, "coverage": {"analyzed": 1, "skipped": 0},
               "chains": [{"id": "CHAIN-1", "severity": "High", "entry_auth": "admin", "final_impact": "other", "nodes": ["entry", "F-1"], "edges": [{"from": "entry", "to": "F-1", "verdict": "accepted"}]}]}
    lead = {"lead_id": "L001", "tool": "t", "rule_id": "r", "vuln_class_hint": "v", "location": {"file": "a", "line": 1}, "message": ""}
    cases = [
        ("finding", finding, ""), ("finding", finding | {"vuln_class": "trust-boundary"}, "$: hygiene severity"), ("finding", finding | {"sink": loc | {"line": -1}}, "$.sink.line: too small"), ("finding", finding | {"source_lead_ids": ["L1"]}, "$.source_lead_ids[]: pattern"),
        ("final-finding", final, ""), ("final-finding", final | {"verification_status": "rejected"}, "$: final values of a rejected one"), ("final-finding", final | {"final_severity": "High"}, "$: high without proof"), ("final-finding", final | {"final_severity": "High", "direct_flow": True}, ""),
        ("final-finding", final | {"partitions": ["p", "p"]}, "$.partitions: not unique"), ("final-finding", finding | {"finding_id": "F-1", "partitions": ["p"], "source_finding_ids": ["x"]}, "$: no final values"),
        ("final-finding", final | {"vuln_class": "trust-boundary", "provisional_severity": "Low", "final_severity": "Medium"}, "$: final hygiene severity"),
        ("analyzer-response", response, ""), ("analyzer-response", response | {"findings": [finding | {"origin": "both"}]}, "$.findings[]: derived origin"), ("analyzer-response", response | {"findings": [finding | {"partitions": []}]}, "$.findings[]: field of a later stage"),
        ("analyzer-response", response | {"adjudicated_leads": [{"lead_id": "L001", "outcome": "refuted"}]}, "$.adjudicated_leads[]: outcome without reason"),
        ("chain", chain, ""), ("chain", chain | {"severity": "Critical"}, "$: critical without its conditions"), ("chain", chain | {"transitions": []}, "$.transitions: too few"),
        ("verdict", verdict, ""), ("verdict", verdict | {"counterexamples": []}, "$: finding without counterexamples"), ("verdict", verdict | {"verdict": "downgraded"}, "$: downgrade without values"), ("verdict", verdict | {"target_type": "chain"}, "$: chain without transitions"),
        ("verifier-response", {"status": "ok", "verdicts": [verdict]}, ""), ("verifier-response", {"status": "ok"}, "$.verdicts: missing"),
        ("report", report, ""), ("report", report | {"more": 1}, "$: unknown field"), ("report-summary", summary, ""), ("report-summary", summary | {"severity_counts": counts | {"Low": "1"}}, "$.severity_counts.Low: not an integer"),
        ("sarif-lead", lead, ""), ("sarif-lead", lead | {"location": {"file": "a", "line": 0}}, "$.location.line: too small"), ("sarif-lead", lead | {"message": "x" * 513}, "$.message: too long"),
    ]
    for kind in dict.fromkeys(k for k, _, _ in cases):
        own = [(i, json.dumps(d)) for i, (k, d, _) in enumerate(cases) if k == kind]
        for r in gates.validate(kind, spark.createDataFrame(own, "i int, text string")).collect():
            assert ",".join(r.errors) == cases[r.i][2], cases[r.i]
            assert r.valid == (not cases[r.i][2])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "truth.csv").write_text("# c\n\nBenchmarkTest00001, sqli , TRUE, 89\nBenchmarkTest1,x,true,1\nBenchmarkTest00002,xss,false\nBenchmarkTest00001,sqli,false,90\n")
    assert [tuple(r) for r in files.read_truth(spark, str(tmp_path / "t")).collect()] == [("t", "BenchmarkTest00001", "sqli", False, 90)]
    (tmp_path / "refs").mkdir()
    (tmp_path / "refs" / "java.md").write_text('x\n```surface\n{"sources": ["a"], "sinks": []}\n```\n')
    (tmp_path / "refs" / "bad.md").write_text("```surface\n{oops\n```\n")
    (tmp_path / "refs" / "NO.md").write_text("nothing")
    got = {r.stack: (r.sources, r.auth_markers, r.error) for r in files.read_surface_tokens(spark, str(tmp_path / "refs")).collect()}
    assert got == {"java": (["a"], [], None), "bad": (None, None, "malformed surface block")}
    (tmp_path / "map.json").write_text('{"t": [{"prefix": "a.", "vuln_class": "x"}, {"rule": "b", "vuln_class": "y"}]}')
    assert [tuple(r) for r in files.read_rule_map(spark, str(tmp_path / "map.json")).orderBy("pos").collect()] == [("t", 0, None, "a.", "x"), ("t", 1, "b", None, "y")]
    (tmp_path / "tree" / "d").mkdir(parents=True)
    (tmp_path / "tree" / "d" / "a.java").write_text("é")
    (tmp_path / "tree" / "latin.java").write_bytes("é»x".encode("latin-1"))
    (tmp_path / "tree" / "wide.java").write_bytes("é = x".encode("utf-16"))
    (tmp_path / "tree" / "cut.java").write_bytes("ab𝒳".encode()[:-1])
    got = {r.path: (r.content, r.digest) for r in files.read_source_tree(spark, str(tmp_path / "tree")).collect()}
    raw_ = {str(x.relative_to(tmp_path / "tree")): x.read_bytes() for x in (tmp_path / "tree").rglob("*.java")}
    assert got == {k: (v.decode("utf-8", "replace"), hashlib.sha256(v).hexdigest()) for k, v in raw_.items()} and len(got) == 4
    some = {r.path: r.content for r in files.read_source_tree(spark, str(tmp_path / "tree"), most_bytes=5).collect()}
    assert some == {k: v.decode("utf-8", "replace") if len(v) <= 5 else None for k, v in raw_.items()}
    (tmp_path / "sarif" / "r1").mkdir(parents=True)
    (tmp_path / "sarif" / "r1" / "x.sarif").write_text("{}")
    assert [tuple(r) for r in files.read_sarif(spark, str(tmp_path / "sarif" / "*")).collect()] == [("r1", "x.sarif", "{}")]
    (tmp_path / "resp.json").write_text('{"status": "ok", "verdicts": [{"target_id": "F-1"}]}')
    assert files.read_responses(spark, str(tmp_path / "resp.json"), "verifier").first().verdicts[0].target_id == "F-1"
    cases = spark.createDataFrame(
        [("r", 2, "CHAIN-1", "exploit-chain", "fp", "passed", None, None), ("r", 1, "F-10", "x", "n", "passed", None, None), ("r", 1, "F-9", "a<b", "n\"'&", "failure", "High <x>", "b & c"), ("r", 3, "L001", "z", "L001", "skipped", "no \"way\"", None)],
        "run_id string, section int, key string, classname string, name string, outcome string, message string, body string",
    )
    docs = sinks.junit_documents(cases)
    text = docs.first().text
    assert text == (
        '<?xml version="1.0" encoding="UTF-8"?>\n<testsuite name="audit" tests="4" failures="1" skipped="1">\n  <testcase classname="a&lt;b" name="n&quot;&apos;&amp;">\n    <failure message="High &lt;x&gt;">b &amp; c</failure>\n  </testcase>\n'
        '  <testcase classname="x" name="n"/>\n  <testcase classname="exploit-chain" name="fp"/>\n  <testcase classname="z" name="L001">\n    <skipped message="no &quot;way&quot;"/>\n  </testcase>\n</testsuite>\n'
    )
    sinks.write_documents(docs, str(tmp_path / "out"))
    assert "\n".join(x.value for x in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()).rstrip("\n") == text.rstrip("\n")
    sinks.write_pieces(sinks.junit_pieces(cases), str(tmp_path / "pieces"), sinks.XML_END)
    assert written(tmp_path / "pieces") == {"r": text}


def written(folder):
    """The one file of each run below a folder."""
    out = {}
    for d in folder.glob("run_id=*"):
        (file,) = d.glob("part-*")
        out[d.name.split("=", 1)[1]] = file.read_bytes().decode()
    return out


def test_pieces_have_the_bytes_of_whole_documents(spark, sf_dir, tmp_path):
    from leadmill.jobs import document_queries as dq
    from leadmill.jobs.verdict_queries import Reviewed

    results = dq._results(spark, sf_dir)
    rules = marts.sarif_rules(results)
    sinks.write_pieces(sinks.sarif_pieces(results, rules), str(tmp_path / "sarif"), sinks.JSON_END)
    assert written(tmp_path / "sarif") == {r.run_id: r.text for r in sinks.sarif_documents(results, rules).collect()}
    r = Reviewed(spark, sf_dir)
    f, c, v = r.final.select("run_id", "number", *dq.FINAL_FIELDS), dq.report_chains(r.resolved), dq.report_verdicts(r.batches)
    runs = r.findings.select("run_id").distinct().select("run_id", F.lit("2024-01-01").alias("generated"), F.array(F.lit("src")).alias("scope"))
    coverage = runs.select("run_id", F.array(F.lit("a")).alias("analyzed"), F.array().cast("array<struct<path:string,reason:string>>").alias("skipped"))
    leads_ = f.where("number = 1 and run_id < 'run-2'").select("run_id", "number", F.lit("L001").alias("lead_id"), F.lit("promoted").alias("outcome"), "finding_id")
    # Runs without chains, verdicts or lead outcomes.
    c, v = c.where("run_id > 'run-3'"), v.where("run_id > 'run-5'")
    sinks.write_pieces(sinks.report_pieces(runs, coverage, f, c, v, leads_), str(tmp_path / "reports"), sinks.JSON_END)
    got = written(tmp_path / "reports")
    assert got == {x.run_id: x.text for x in sinks.report_documents(runs, coverage, f, c, v, leads_).collect()} and len(got) > 5
    assert {"lead_adjudications" in json.loads(x) for x in got.values()} == {True, False}


def test_a_large_run_is_written_row_by_row(spark, tmp_path):
    n = 200_000
    results = spark.range(n).select(F.lit("hot").alias("run_id"), F.lit(1).alias("section"), F.concat(F.lit("F-"), "id").alias("key"), F.lit("sqli").alias("rule_id"), F.lit("error").alias("level"), F.lit("m").alias("message"), F.lit("a.java").alias("file"), F.col("id").alias("line"),
        F.lit(None).cast("string").alias("sink_file"), F.lit(None).cast("long").alias("sink_line"), F.lit(None).cast("array<struct<file:string,line:bigint>>").alias("flow"), F.lit("x").alias("fingerprint"), F.lit(None).cast("string").alias("lane"), F.lit(False).alias("suppressed"), F.lit(None).cast("string").alias("reason"))
    rules = marts.sarif_rules(results)
    rows = sinks.sarif_pieces(results, rules)
    sinks.write_pieces(rows, str(tmp_path / "x"), sinks.JSON_END)
    (text,) = written(tmp_path / "x").values()
    lines = [x["locations"][0]["physicalLocation"]["region"]["startLine"] for x in json.loads(text)["runs"][0]["results"]]
    assert lines == list(range(n)) and rows.select(F.max(F.octet_length("value"))).first()[0] < 400


def test_incremental(spark):
    store = spark.createDataFrame([("k", "a", "d1", '{"status":"ok","verdicts":[]}', 1), ("k", "b", "d1", "broken", 1), ("k", "a", "d1", '{"status":"error","verdicts":[]}', 2)], "kind string, target_id string, input_digest string, response string, stored_at long")
    work = spark.createDataFrame([("k", "a", "d1"), ("k", "a", "d2"), ("k", "b", "d1"), ("x", "a", "d1")], "kind string, target_id string, input_digest string")
    reuse, rest = incremental.split_reusable(work, incremental.usable_store(store, "verifier-response"))
    assert [r.response for r in reuse.collect()] == ['{"status":"error","verdicts":[]}'] and rest.count() == 3
    texts = spark.createDataFrame([('{"b": [2, 1], "a": {"d": null, "c": "é"}}',), ('{"a":{"c":"é","d":null},"b":[2,1]}',), ('{"a":{"c":"é","d":null},"b":[1,2]}',), ("no",)], "t string")
    a, b, c, d = (r.x for r in texts.select(incremental.json_digest(F.col("t")).alias("x")).collect())
    assert a == b != c and d is None
    odd = {r'{"a":"\u0001\n\"\\/é😀"}': r'{"a":"\u0001\n\"\\/é😀"}', '{"z":1.0,"a":1.50,"n":-0,"m":12345678901234567890}': '{"a":1.5,"m":12345678901234567000,"n":0,"z":1}', '{"10":[true,{"c":1,"b":[]}],"9":2,"1":"x y"}': '{"1":"x y","10":[true,{"b":[],"c":1}],"9":2}', '{"😀":1,"￮":2}': '{"😀":1,"￮":2}', "[]": "[]"}
    got = spark.createDataFrame(list(odd.items()), "t string, plain string").select(incremental.json_digest(F.col("t")).alias("x"), F.sha2("plain", 256).alias("y")).collect()
    assert all(r.x == r.y for r in got) and len(got) == len(odd)


def test_canonical_json():
    from leadmill.functions.canonical import canonical_json, number_text

    numbers = {"1e2": "100", "1e400": "null", "-1e400": "null", "1.5e-7": "1.5e-7", "-0": "0", "-0.0": "0", "0.000001": "0.000001", "0.0000001": "1e-7", "1e21": "1e+21", "1e20": "100000000000000000000", "123456789012345680000": "123456789012345680000",
        "9007199254740993": "9007199254740992", "12345678901234567890": "12345678901234567000", "5e-324": "5e-324", "1.7976931348623157e308": "1.7976931348623157e+308", "0.1": "0.1", "100": "100", "1.0": "1", "-2.50": "-2.5", "1" * 5000: "null", "4.35": "4.35", "1e-6": "0.000001"}
    assert {k: canonical_json(k) for k in numbers} == numbers
    assert number_text(123.0) == "123" and number_text(1e23) == "1e+23"
    assert canonical_json('{"b":1,"a":{"y":[],"x":{}},"b":[2,{"z":null,"é":true}]}') == '{"a":{"x":{},"y":[]},"b":[2,{"z":null,"é":true}]}'
    assert canonical_json(r'"\ud800\udc00\udfff\u2028\t\u007f\u001f"') == '"\U00010000\\udfff\u2028\\t\x7f\\u001f"'
    assert canonical_json('{"\U00010000":1,"\uffff":2,"10":3,"9":4}') == '{"10":3,"9":4,"\U00010000":1,"\uffff":2}'  # by UTF-16 units
    assert [canonical_json(t) for t in (None, "", "NaN", "[Infinity]", "{'a':1}", "[1,]", '"\n"', "01", "\ufeff1", '{"a":1} x')] == [None] * 10


def test_store_on_disk(spark, tmp_path):
    path = str(tmp_path / "store")
    assert incremental.read_store(spark, path) is None
    kind = "kind string, target_id string, input_digest string, response string, stored_at long, passed boolean"
    first = spark.createDataFrame([("k", f"t{i}", "d", f"r{i}", 1, i % 3 != 0) for i in range(40)] + [("other", "t", "d", "x", 1, True)], kind)
    incremental.write_store(first, path, buckets=4)
    rows = lambda: sorted(tuple(r)[:5] for r in incremental.read_store(spark, path).collect())
    want = sorted([("k", f"t{i}", "d", f"r{i}", 1) for i in range(40) if i % 3] + [("other", "t", "d", "x", 1)])
    assert rows() == want
    incremental.write_store(first, path, buckets=4)
    assert rows() == want
    files_ = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    before = files_()
    later = spark.createDataFrame([("k", "t1", "d", "new", 2, True), ("k", "t1", "d", "old", 0, True), ("k", "t2", "d", "refused", 9, False)], kind)
    incremental.write_store(later, path, buckets=4)
    assert rows() == sorted([w for w in want if w[1] != "t1"] + [("k", "t1", "d", "new", 2)])
    changed = {f.rsplit("/", 1)[0] for f in before.items() ^ files_().items() for f in [f[0]]}
    assert len(changed) == 1 and not any("other" in f for f in changed)


def test_numbering_spreads_a_hot_group(spark):
    from leadmill.functions.numbering import numbered

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("k"), "id")
    got = numbered(rows, ["g"], [F.col("k")], "n")
    want = {}
    for r in sorted(rows.collect(), key=lambda r: (str(r.g), r.k)):
        want.setdefault(r.g, []).append(r.id)
    found = got.collect()
    assert {(r.g, r.id): r.n for r in found} == {(g, i): k for g, ids in want.items() for k, i in enumerate(ids, 1)} and len(found) == 3000
    assert got.columns == ["g", "k", "id", "n"]


def test_values_of_other_json_types(spark):
    lines = {"3.0": 3, "1e1": 10, "99999999999": 99999999999, "2.5": None, '"3"': None, "true": None, "null": None, "0": None, "-1": None, "1e300": None, "{}": None}
    one = lambda line, more="": '{"locations":[{"physicalLocation":{"artifactLocation":{"uri":"src/a.java"},"region":{"startLine":%s}}}]%s}' % (line, more)  # noqa: E731, UP031
    more = [',"ruleId":7,"rule":{"id":"r"}', ',"ruleId":"","rule":{"id":"r"}', ',"ruleId":[],"rule":{"id":2,"index":1.0}', ',"rule":{"index":-1}', ',"message":"m"', ',"message":{"text":5}', ',"codeFlows":{},"message":{"text":"ok"}']
    odd = ["5", "null", '"x"', '{"locations":{}}', '{"locations":[{"physicalLocation":3}]}', '{"locations":[{"physicalLocation":{"region":{"startLine":1},"artifactLocation":{"uri":7}}}]}']
    results = [one(x) for x in lines] + [one(1, x) for x in more] + odd
    text = '{"version":"2.1.0","runs":[7,{"tool":{"driver":{"name":5,"rules":[{"id":"a"},{"id":"b"}]}},"results":[%s]},{"results":{}},null]}' % ",".join(results)  # noqa: UP031
    docs = spark.createDataFrame([("r", "d", text)], "run_id string, doc string, text string")
    manifest = spark.createDataFrame([("r", "src/a.java")], "run_id string, file string")
    rules = spark.createDataFrame([("unknown", 0, None, "", "any")], "tool string, pos int, rule string, prefix string, vuln_class string")
    got = leads.resolved_results(docs, manifest, rules, "/work/app").orderBy("pos").collect()
    assert [r.line if r.drop is None else None for r in got[: len(lines)]] == list(lines.values())
    at = len(lines)
    assert [r.rule_id for r in got[at : at + 4]] == ["r", "unknown", "b", "unknown"] and {r.vuln_class for r in got} == {"any"} and {r.tool for r in got} == {"unknown"}
    assert [r.drop for r in got[at + 7 :]] == ["bad_location"] * 5 + ["bad_uri"]
    found = leads.leads(leads.resolved_results(docs, manifest, rules, "/work/app")).orderBy("lead_id").collect()
    assert [r.message for r in found[-3:]] == ["", "", "ok"] and found[2].line == 99999999999


def test_walk_agrees_with_a_json_parser():
    import random

    from leadmill.sources.large_sarif import NOT_JSON, Walk

    r = random.Random(9)
    whole = sarif()
    whole["runs"][0]["results"][0]["message"]["text"] = 'a } " \\ \u20ac ] { é\n'
    whole["x"] = [[], {}, [1, -2.5e3, None, True, {"results": [1]}]]
    texts = [json.dumps(whole), json.dumps(whole, indent=2, ensure_ascii=False), '{"version":"2.1.0","runs":[]}', '{"runs":[{"results":[5,"x",[1,{}],null]},7],"version":"2.1.0"} ', "5", "", "[]", '{"version":"2.1.0"}', '{"version":"2","runs":[]}', '{"version":"2.1.0","runs":{}}']
    texts += [t[:k] + c + t[k + (c == ""):] for t in texts[:4] for k, c in ((r.randrange(len(t)), r.choice(["", "}", ",", '"', "x", "\\", "[", "\n\x01", " "])) for _ in range(150))]
    for text in texts:
        try:
            doc = json.loads(text, parse_constant=lambda _: 1 / 0)
            good = True
        except (ValueError, ZeroDivisionError):
            good = False
        walk, out, at = Walk(), [], 0
        while at < len(text):
            n = r.randint(1, 40)
            out += walk.feed(text[at : at + n])
            at += n
        out += walk.close()
        assert (walk.error == NOT_JSON) == (not good), text
        if not walk.error:
            want = [(i, k, x) for i, run in enumerate(doc["runs"]) if isinstance(run, dict) and isinstance(run.get("results"), list) for k, x in enumerate(run["results"])]
            assert [(i, k, json.loads(x)) for kind, i, k, x in out if kind == "result"] == want
            assert [json.loads(x) for kind, i, k, x in out if kind == "tool"] == [run["tool"] for run in doc["runs"] if isinstance(run, dict) and "tool" in run]


def test_large_files_are_read_in_pieces(spark, tmp_path):
    from leadmill.functions.lineage import settled
    from leadmill.sources import large_sarif

    (tmp_path / "in" / "r").mkdir(parents=True)
    texts = {"a": json.dumps(sarif()), "b": "nope", "c": json.dumps(sarif(version="2.0.0")), "d": '{"version":"2.1.0","runs":5}', "e": json.dumps(sarif())[:-1], "f": json.dumps(sarif(), indent=1) + "\n\n", "g": json.dumps(sarif()) + "}"}
    for name, text in texts.items():
        (tmp_path / "in" / "r" / name).write_text(text)
    manifest = spark.createDataFrame([("r", "src/a.java")], "run_id string, file string")
    rules = spark.createDataFrame([("semgrep", 0, None, "java.sqli", "sqli")], "tool string, pos int, rule string, prefix string, vuln_class string")
    docs = spark.createDataFrame([("r", n, t) for n, t in texts.items() if n != "g"], "run_id string, doc string, text string")  # text after a document's end is let pass there
    pieces = settled(large_sarif.read_pieces(spark, str(tmp_path / "in" / "*")))
    found = {r.doc: r.error for r in large_sarif.piece_errors(pieces).collect()}
    assert found == {r.doc: r.error for r in leads.document_errors(docs).collect()} | {"g": large_sarif.NOT_JSON}
    as_rows = lambda results: sorted(map(str, leads.leads(results, leads.codeflows(results, manifest, "/work/app")).collect()))
    assert as_rows(leads.resolved(large_sarif.exploded_pieces(pieces), manifest, rules, "/work/app")) == as_rows(leads.resolved_results(docs, manifest, rules, "/work/app"))
    # A file of many blocks: no row holds more than a result.
    (tmp_path / "big" / "r").mkdir(parents=True)
    one, n = json.dumps(sarif()["runs"][0]["results"][1]), 60_000
    with (tmp_path / "big" / "r" / "x").open("w") as f:
        f.write('{"runs":[{"results":[' + one + ("," + one) * (n - 1) + '],"tool":{"driver":{"name":"late"}}}],"version":"2.1.0"}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        big = settled(large_sarif.read_pieces(spark, str(tmp_path / "big" / "*")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = large_sarif.exploded_pieces(big)
    assert rows.where("tool = 'late'").select(F.countDistinct("pos"), F.max("pos")).first()[:] == (n, n - 1) and big.select(F.max(F.length("text"))).first()[0] <= len(one) and large_sarif.piece_errors(big).count() == 0


def test_rule_index_with_many_entries(spark):
    n = 100_000
    entry = F.col("id")
    rules = spark.range(n).select(F.lit("t").alias("tool"), entry.cast("int").alias("pos"), F.when(entry % 2 == 0, F.concat(F.lit("rule."), entry)).alias("rule"), F.when(entry % 2 == 1, F.concat(F.lit("p"), (entry % 977).cast("string"), F.lit("."))).alias("prefix"), F.concat(F.lit("c"), entry).alias("vuln_class"))
    ids = ["rule.8", "rule.80", "p5.x", "p5", "q", "p976.", "rule.99998", ""]
    rows = spark.createDataFrame([("t", i) for i in ids] + [("other", "rule.8")], "tool string, rule_id string")
    got = {(r.tool, r.rule_id): r.vuln_class for r in leads.mapped_class(rows, rules).collect()}
    assert got == {("t", "rule.8"): "c8", ("t", "rule.80"): "c80", ("t", "p5.x"): "c5", ("t", "p5"): "unknown", ("t", "q"): "unknown", ("t", "p976."): "c1953", ("t", "rule.99998"): "c99998", ("t", ""): "unknown", ("other", "rule.8"): "unknown"}


def test_automata_count_as_the_join_does(spark, monkeypatch):
    import random

    r = random.Random(4)
    words = lambda n: [r.choice(["ab", "aba", "b", "ba_", "@ab", "é", "a.b", "xx"]) + r.choice(["", "a", "1"]) for _ in range(n)]
    tokens = spark.createDataFrame([("s", [*words(400), "", None], words(9), words(3), [*words(6), "aba"]), ("t", None, [], ["a"], [])], "stack string, sources array<string>, sinks array<string>, sanitizers array<string>, auth_markers array<string>")
    texts = ["".join(r.choice(["ab", "a", "b", "_", "@", "é", ".", " ", "x", "1", "\n"]) for _ in range(r.randrange(60))) for _ in range(150)] + [None, ""]
    files_ = spark.createDataFrame([("r", "p", r.choice(["s", "t", "u"]), str(i), x, None) for i, x in enumerate(texts)], "run_id string, partition_id string, stack string, path string, content string, skip_reason string")
    plain = lambda: sorted(map(tuple, surface.file_hits(files_, tokens).collect()))
    fast = plain()
    monkeypatch.setattr(surface, "AUTOMATA", -1)
    assert fast == plain() and any(x[10] for x in fast)


def test_real_app_score(spark):
    f = spark.createDataFrame([("r", "F-1", "sqli", ("a", 1), "accepted"), ("r", "F-2", "xss", ("b", 1), "accepted"), ("r", "F-3", "sqli", ("c", 1), "rejected")], "run_id string, finding_id string, vuln_class string, source struct<file:string,line:int>, verification_status string")
    c = spark.createDataFrame([("r", "CHAIN-1", ["F-1", "F-2"])], "run_id string, chain_id string, finding_ids array<string>")
    seen = spark.createDataFrame([("r", "a"), ("r", "c")], "run_id string, file string")
    truth = spark.createDataFrame([("r", "1", "injection", "a"), ("r", "2", "sqli", "c"), ("r", "3", "xss", "d")], "run_id string, id string, vuln_class string, file string")
    same = spark.createDataFrame([("sqli", "injection")], "vuln_class string, documented_class string")
    r = scoring.score_real_app(f, c, seen, truth, same).first()
    assert (r.documented, r.found, r.missed_structural, r.missed_reasoning, r.extra, r.chains, r.multi_file_chains) == (3, 1, 1, 1, 1, 1, 1)


def test_sarif_stream(spark, tmp_path):
    from leadmill.streaming import drops

    (tmp_path / "in" / "r1").mkdir(parents=True)
    (tmp_path / "in" / "r1" / "a.sarif").write_text(json.dumps(sarif()))
    manifest = spark.createDataFrame([("r1", "src/a.java"), ("r2", "src/a.java")], "run_id string, file string")
    rules = spark.createDataFrame([], "tool string, pos int, rule string, prefix string, vuln_class string")
    go = lambda: drops.write_leads(drops.sarif_stream(spark, str(tmp_path / "in")), manifest, rules, "/work/app", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    (tmp_path / "in" / "r2").mkdir()
    (tmp_path / "in" / "r2" / "b.sarif").write_text(json.dumps(sarif()))
    go()
    assert {(r.run_id, r.lead_id) for r in drops.read_leads(spark, str(tmp_path / "out")).collect()} == {(a, b) for a in ("r1", "r2") for b in ("L001", "L002", "L003")}
    (tmp_path / "in" / "r1" / "b.sarif").write_text(json.dumps(sarif()))
    go()
    late = [(r.doc, r.lead_id) for r in drops.read_leads(spark, str(tmp_path / "out")).where("run_id = 'r1'").orderBy("lead_id").collect()]
    assert late == [("a.sarif", f"L00{k}") for k in (1, 2, 3)] + [("b.sarif", f"L00{k}") for k in (4, 5, 6)]


def test_only_named_columns_are_numbered_and_written(spark):
    df = raw(spark, ROWS)
    whole = {(r.run_id, r.source.line, r.sink.symbol): (r.number, r.finding_id, r.auth) for r in findings.canonical_findings(df).collect()}
    some = findings.canonical_findings(df, columns=["auth", "source"])
    assert some.columns == ["run_id", "vuln_class", "source", "sink", "auth", "number", "finding_id"]
    assert {(r.run_id, r.source.line, r.sink.symbol): (r.number, r.finding_id, r.auth) for r in some.collect()} == whole
    assert some.inputFiles() and all("/stored-" in f and f.endswith(".parquet") for f in some.inputFiles())


def test_lineitem_is_dealt_once_for_row_numbers_and_orders(spark, sf_dir):
    from leadmill.jobs.tables import table

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = table(spark, sf_dir, "flat_findings")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # By orders once and by parts once, where there were three; and those of orders and parts.
    assert plan.count("Exchange hashpartitioning") == 4


def test_reports_have_wide_columns_of_all_final_findings(spark, sf_dir):
    from leadmill.jobs import document_queries as dq
    from leadmill.jobs.verdict_queries import Reviewed, reviewed

    narrow = reviewed(spark, sf_dir)
    assert "evidence" not in narrow.findings.columns
    pick = ["run_id", "number", *dq.FINAL_FIELDS]
    text = F.to_json(F.struct(*pick)).alias("text")
    got, want = narrow.whole(*dq.MERGED_FIELDS).select(text).collect(), Reviewed(spark, sf_dir).final.select(text).collect()
    assert sorted(r.text for r in got) == sorted(r.text for r in want)


def test_errors_of_arrays_and_objects_walk_no_schema(spark):
    node = gates.Obj({"a": gates.Arr(gates.AnyObject(), 1), "b": gates.Arr(gates.Arr(gates.Obj({})))})
    found = gates.errors(F.col("v"), node)
    docs = ['{"a":[{}],"b":[[{}]]}', '{"a":[],"b":[[]]}', '{"a":"[]","b":{}}', '{"a":[[],null,{"x":1}],"b":[[7,"{}",null],3]}', "[]", "null", '"{}"']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string").select("i", F.try_parse_json("d").alias("v")).select("i", found.alias("e"))
    assert [r.e for r in df.orderBy("i").collect()] == [
        [], ["$.a: too few"], ["$.a: not an array", "$.b: not an array"],
        ["$.a[]: not an object", "$.a[]: not an object", "$.b[][]: not an object", "$.b[][]: not an object", "$.b[][]: not an object", "$.b[]: not an array"],
        ["$: not an object"], ["$: not an object"], ["$: not an object"],
    ]
    assert "schema_of_variant" not in df._jdf.queryExecution().analyzed().toString().lower().replace("schemaofvariant", "schema_of_variant")


def test_merge_aggregates_only_what_is_wanted(spark):
    df = raw(spark, ROWS)
    some = findings.merge(df, ["title", "auth"])
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [x for x in plan.splitlines() if "Aggregate [" in x]
    assert len(aggregates) == 1 and "partition_id" not in aggregates[0] and "confidence" not in aggregates[0]
    key = [*findings.KEY, "title", "auth"]
    assert sorted(map(str, some.select(key).collect())) == sorted(map(str, findings.merge(df).select(key).collect()))


def test_ranked_values_are_merged_as_bits(spark):
    rows = [("a", "Low"), ("a", None), ("a", "High"), ("a", "odd"), ("b", None), ("b", "odd"), ("c", "Info"), ("c", "Critical")]
    df = spark.createDataFrame(rows, "k string, v string").groupBy("k").agg(F.bit_or(ranks.rank_bit(F.col("v"), ranks.SEVERITY, 3)).alias("b"))
    got = {r.k: (r.lo, r.hi) for r in df.select("k", ranks.first_by_bits(F.col("b"), ranks.SEVERITY, 3).alias("lo"), ranks.first_by_bits(F.col("b"), ranks.SEVERITY, 3, True).alias("hi")).collect()}
    assert got == {"a": ("Low", "High"), "b": (None, None), "c": ("Info", "Critical")}


def test_verdicts_are_dealt_once_and_read_once(spark):
    f, c, b = review(spark, (GOOD, None), ([("B1", TF, "ok", [fv("F-1"), fv("F-2", "rejected", ces=((True, False),))]), ("C1", TC, "ok", [cv()]), ("B2", TF, "ok", [fv("F-2"), fv("F-1")])], None))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    final = verdicts.apply_to_findings(f, b)
    assert exchanges(final) == 2  # findings and verdicts, each by run and finding
    whole, judged = verdicts.resolve_chains(f, c, b), verdicts.resolve_chains(f, c, b, final.localCheckpoint())
    assert exchanges(judged) < exchanges(whole)
    assert sorted(map(str, judged.collect())) == sorted(map(str, whole.collect()))
    assert {(r.run_id, r.finding_id): r.verification_status for r in final.collect()}["r1", "F-2"] == "accepted"  # the last verdict counts


def odd_lines(spark, folder):
    """lineitem, orders and part with absent, missing, negative and repeated keys, repeated lines, and a quantity that's missing."""
    lines = [(o, p, s, n, q, 1.0 * i, 0.0 if i % 3 else 0.1, 0.0, "ANR"[i % 3], "OF"[i % 2], None) for i, (o, p, s, n, q) in enumerate(
        (o, p, s, n, q) for o in (1, 2, 9) for p in (-17, -5, 1, 13, 60, 61, 72, 120, 121, 404, None) for s in (1, 2, None) for n in (1, 2) for q in (3.0, 4.5, 7.0, None)
    )]
    lines += [(1, 60, 1, 1, 3.0, 5.0 + i, 0.1 * (i % 2), 0.0, "NR"[i % 2], "FO"[i % 2], None) for i in range(12)]  # equal in all that orders them but the price
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    tables = {
        "lineitem": spark.createDataFrame(lines, kinds), "orders": spark.createDataFrame([(1, "1-URGENT", "F"), (2, "5-LOW", "O"), (3, "2-HIGH", "P")], "o_orderkey long, o_orderpriority string, o_orderstatus string"),
        "part": spark.createDataFrame([(p, f"B{p % 7}") for p in (-17, -5, 1, 13, 60, 61, 72, 120, 121, 500)] + [(60, "A"), (61, None)], "p_partkey long, p_brand string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_keyed_findings_merge_as_whole_ones(spark, tmp_path):
    from leadmill.jobs import finding_queries as fq
    from leadmill.jobs.tables import keyed_findings, raw_findings, table

    at = odd_lines(spark, tmp_path)
    want, flat = findings.merge(raw_findings(spark, at)), keyed_findings(spark, at)
    text = lambda df: sorted(r.t for r in df.select(F.to_json(F.struct(*want.columns)).alias("t")).collect())
    got = fq.merged(spark, at, flat)
    assert text(got) == text(want) and want.count() > 40
    outcomes = [sorted(map(str, df.collect())) for df in (table(spark, at, "lead_outcomes"), table(spark, at, "lead_outcomes", flat_findings=flat))]
    assert outcomes[0] == outcomes[1] and outcomes[0]


def test_reviews_deal_no_lines_by_parts_and_merge_by_narrow_keys(spark, sf_dir):
    from leadmill.jobs import finding_queries as fq
    from leadmill.jobs.tables import keyed_findings

    def plan(*c):
        lines = fq.merged(spark, sf_dir, keyed_findings(spark, sf_dir), c)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return "\n".join(x for x in lines if "Relation [" not in x)

    untitled, titled = plan("auth"), plan("auth", "title")
    assert "p_partkey" not in untitled and "Aggregate [place_run" in untitled
    # Titles come after the merge (whose plan is further down), and no line goes with what orders equal ones.
    assert titled.index("p_brand") > titled.index("Join Inner") and "l_extendedprice" not in titled
    joins = [x for x in titled.splitlines() if "Join " in x]
    assert len(joins) == 3 and sum("LeftAnti" in x for x in joins) == 1


def test_stored_tables_of_many_rows_are_not_broadcast_for_their_small_files(spark):
    from leadmill.functions.lineage import FEW, stored

    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    many, few = [stored(spark.range(n).selectExpr("id", "array('a', 'b') AS x")) for n in (FEW + 1, FEW)]
    left = spark.range(10_000_000)
    assert "BroadcastHashJoin" not in plan(left.join(many, "id")) and "BroadcastHashJoin" in plan(left.join(few, "id"))
    assert "BroadcastHashJoin" not in plan(left.join(many.selectExpr("id", "explode(x) AS x").groupBy("id").count(), "id", "left"))
    assert "BroadcastHashJoin" in plan(many.join(F.broadcast(few), "id")) and "BroadcastHashJoin" in plan(left.join(F.broadcast(many), "id"))
    assert left.join(many, "id").count() == FEW + 1


def test_errors_of_typed_values_are_those_of_the_contract(spark, monkeypatch):
    """Texts that come out as the same JSON, with whatever is wrong in their values, don't go through the interpreted checks."""
    loc = {"file": "a", "line": 1, "symbol": "s", "kind": "k"}
    finding = {"finding_id": "p-F001", "partition_id": "p", "title": "t", "vuln_class": "sqli", "source": loc, "sink": loc, "auth": "admin", "prerequisites": ["x"], "provisional_severity": "High", "confidence": "likely", "verification_status": "not-requested"}
    response = lambda *f, **more: {"partition_id": "p", "status": "ok", "findings": list(f), "coverage": {"analyzed": ["a"], "skipped": []}} | more
    docs = [
        ("analyzer-response", response(finding, finding | {"verification_status": "accepted", "origin": "both"})), ("analyzer-response", response(finding | {"prerequisites": [None]}, finding | {"auth": "x", "source": loc | {"line": -1}})),
        ("analyzer-response", response(finding | {"title": "", "vuln_class": "trust-boundary"}, None)), ("analyzer-response", response(adjudicated_leads=[{"lead_id": "L1", "outcome": "refuted"}])),
        ("analyzer-response", {k: v for k, v in response(finding).items() if k != "status"}), ("final-finding", finding | {"finding_id": "F-1", "partitions": ["p", "p"], "source_finding_ids": []}),
    ]
    for kind in dict.fromkeys(k for k, _ in docs):
        texts = [json.dumps(d, separators=(",", ":")) for k, d in docs if k == kind]
        rows = spark.createDataFrame([(i, form) for i, t in enumerate(texts) for form in (t, t.replace(",", ", "))], "i int, text string")
        node, v = gates.contracts()[kind], F.try_parse_json("text")
        want = sorted((r.i, r.e) for r in rows.select("i", F.array_distinct(gates.errors(v, node)).alias("e")).collect())
        with monkeypatch.context() as m:
            m.setattr(gates, "errors", lambda *_: F.array(F.lit("interpreted")))
            gates._compiled.cache_clear()
            assert sorted((r.i, r.errors) for r in gates.validate(kind, rows).collect()) == want and any(e for _, e in want)
        gates._compiled.cache_clear()
    values = spark.sql("SELECT explode(array('5', '{}')) AS t").select(F.parse_json("t").alias("v"))
    fits = values.select(gates.fits(F.col("v"), gates.AnyObject()).alias("fits"), (F.size(gates.typed_errors(F.col("v"), gates.AnyObject())) == 0).alias("none"))
    assert [tuple(r) for r in fits.collect()] == [(False, False), (True, True)]
