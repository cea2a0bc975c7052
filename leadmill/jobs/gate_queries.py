"""Queries over gates, reuse of responses, and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions.lineage import settled, stored
from leadmill.jobs import document_queries as documents
from leadmill.jobs import lead_queries, surface_queries
from leadmill.jobs.finding_queries import canon_ctes, canonical
from leadmill.jobs.tables import ctes, raw_findings, table
from leadmill.jobs.verdict_queries import _review, reviewed, spoiled
from leadmill.operators import gates as op
from leadmill.operators import incremental, marts
from leadmill.operators import verdicts as vop


def _changed(text: Column, n: Column, rules: list[tuple[int, str, str]]) -> Column:
    """Every so many-th text with a replacement, so that a known rule breaks."""
    out = F.when(F.lit(False), text)
    for i, a, b in rules:
        out = out.when(n % 20 == i, F.replace(text, F.lit(a), F.lit(b)))
    return out.when(n % 20 == 19, F.lit("{")).otherwise(text)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["finding_id", "partition_id", "title", "vuln_class", "source", "sink", "auth", "transformations", "direct_flow", "sanitizers", "prerequisites", "evidence", "provisional_severity", "confidence", "verification_status", "origin", "source_lead_ids"]
    f = canonical(spark, sf_dir, *[c for c in fields if c != "finding_id"])
    return f.select("run_id", "number", F.to_json(F.struct(*fields)).alias("text"))


#: Which rule breaks on which texts (number % 20), with the error that must come.
_BREAKS = [
    (0, '"title":"', '"titel":"', "$: unknown field,$.title: missing"), (1, '"symbol":"q"', '"symbol":5', "$.source.symbol: not a string"), (2, '"auth":"', '"auth":"x', "$.auth: not one of its values"), (3, '"finding_id":"F-', '"finding_id":"G-', "$.finding_id: pattern"),
    (4, '"what":"escape"', '"what":"escape","more":1', "$.sanitizers[]: unknown field"), (5, '"evidence":[', '"evidence":[7,', "$.evidence[]: not an object"), (6, '"prerequisites":[', '"prerequisites":[true,', "$.prerequisites[]: not a string"),
]


def finding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    texts = texts.withColumn("text", _changed(F.col("text"), F.col("number"), [(i, a, b) for i, a, b, _ in _BREAKS]))
    return op.validate("finding", texts).select("run_id", "number", "valid", F.array_join("errors", ",").alias("errors"))


def _contract_texts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """run_id, id, n and text of documents of five kinds. By n some get the change of _KIND_BREAKS."""
    r = reviewed(spark, sf_dir)
    v = F.col("v")
    n = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("int").alias("n")
    text = lambda *c: F.to_json(F.struct(*c)).alias("text")
    final = r.whole(*documents.MERGED_FIELDS).select("run_id", F.col("finding_id").alias("id"), n("finding_id"), text(*documents.FINAL_FIELDS))
    chains = documents.report_chains(r.resolved)
    chains = chains.select("run_id", F.col("chain_id").alias("id"), n("chain_id"), text(*[c for c in chains.columns if c not in ("run_id", "pos")]))
    verdicts = documents.report_verdicts(r.batches)
    verdicts = verdicts.select("run_id", F.concat_ws(":", "target_type", "target_id").alias("id"), n("target_id"), text(*[c for c in verdicts.columns if c not in ("run_id", "pos")]))
    place = F.struct("file", "line").alias("location")
    leads = lead_queries.leads(spark, sf_dir).select("run_id", F.col("lead_id").alias("id"), n("lead_id"), text("lead_id", "tool", "rule_id", "vuln_class_hint", place, "codeflow", "message"))
    f = raw_findings(spark, sf_dir).drop("run_id", "pos").columns
    raw = raw_findings(spark, sf_dir).groupBy("run_id", "partition_id").agg(F.array_sort(F.collect_list(F.struct("finding_id", *[c for c in f if c != "finding_id"]))).alias("findings"))
    none = F.array().cast("array<struct<path:string,reason:string>>")
    answers = raw.select("run_id", F.col("partition_id").alias("id"), n("run_id"), text("partition_id", F.lit("ok").alias("status"), "findings", F.struct(F.array("partition_id").alias("analyzed"), none.alias("skipped")).alias("coverage")))
    return {"final-finding": final, "chain": chains, "verdict": verdicts, "sarif-lead": leads, "analyzer-response": answers}


#: Kind, every so many-th text, what is changed in it, and the errors that must come.
_KIND_BREAKS = (
    ("final-finding", 4, '"partitions":[', '"partitions":["p1","p1",', "$.partitions: not unique"), ("chain", 3, '"route":"/"', '"route":1', "$.entry_point.route: not a string"), ("verdict", 4, '"target_type":', '"target_kind":', "$: unknown field,$.target_type: missing"),
    ("sarif-lead", 5, '"message":"', '"message":5,"note":"', "$: unknown field,$.message: not a string"), ("analyzer-response", 3, '"verification_status":"not-requested"', '"verification_status":"accepted"', "$.findings[]: reviewed already"),
)


def contract_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, out = _contract_texts(spark, sf_dir), None
    for kind, each, a, b, _ in _KIND_BREAKS:
        docs = texts[kind].withColumn("text", F.when(F.col("n") % each == 0, F.replace("text", F.lit(a), F.lit(b))).otherwise(F.col("text")))
        part = op.validate(kind, docs).select("run_id", F.lit(kind).alias("kind"), "id", "valid", F.array_join("errors", ",").alias("errors"))
        out = part if out is None else out.union(part)
    return out


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response per run and partition, made of its raw findings; some are wrong in a known way."""
    raw = raw_findings(spark, sf_dir)
    n = F.col("n")
    f = F.struct("finding_id", F.col("partition_id").alias("partition_id"), F.coalesce("origin", F.lit("llm-discovered")).alias("origin"), "source_lead_ids")
    by = raw.groupBy("run_id", "partition_id").agg(F.array_sort(F.collect_list(f)).alias("findings"), F.min("finding_id").alias("first"), F.max(F.when(F.col("origin") == "sast-lead", F.col("finding_id"))).alias("lead_finding"), F.max(F.get("source_lead_ids", F.lit(0))).alias("lead"))
    by = by.withColumn("n", F.substring_index("run_id", "-", -1).cast("int") * 7 + F.substring("partition_id", 2, 1).cast("int"))
    one = lambda lead, outcome, fid: F.struct(lead.alias("lead_id"), outcome.alias("outcome"), fid.alias("finding_id"))
    none = F.lit(None).cast("string")
    promoted = one(F.col("lead"), F.lit("promoted"), F.when(n % 9 == 1, F.lit("gone")).otherwise(F.col("lead_finding")))
    adjudicated = F.when(F.col("lead").isNull(), F.array().cast("array<struct<lead_id:string,outcome:string,finding_id:string>>")).when(n % 9 == 2, F.array(promoted, one(F.col("lead"), F.lit("refuted"), none))).when(n % 9 == 3, F.array(one(F.lit("L999"), F.lit("refuted"), none))).otherwise(F.array(promoted))
    wrong = F.transform("findings", lambda x: F.struct(F.concat(F.lit("x"), x["finding_id"]).alias("finding_id"), x["partition_id"].alias("partition_id"), x["origin"].alias("origin"), x["source_lead_ids"].alias("source_lead_ids")))
    return by.select(
        "run_id", "partition_id", F.when(n % 8 == 1, F.lit("p0")).otherwise(F.col("partition_id")).alias("response_partition"), F.when(n % 10 == 4, "error").when(n % 10 == 5, "partial").otherwise("ok").alias("status"),
        F.when(n % 8 == 2, wrong).when(n % 8 == 3, F.concat("findings", F.slice("findings", 1, 1))).otherwise(F.col("findings")).alias("findings"), adjudicated.alias("adjudicated"), F.array(F.struct(F.lit("src/skip.java").alias("path"), F.lit("too large").alias("reason"))).alias("skipped"),
    )


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_findings(spark, sf_dir).select("run_id", "partition_id", F.explode("source_lead_ids").alias("lead_id")).distinct()


def partition_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.binding_violations(responses(spark, sf_dir))


def lead_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lead_coverage_violations(responses(spark, sf_dir), _assigned(spark, sf_dir))


def _accepted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    r = settled(responses(spark, sf_dir))
    bad = op.binding_violations(r).select("run_id", "partition_id").union(op.lead_coverage_violations(r, _assigned(spark, sf_dir)).select("run_id", "partition_id"))
    return op.accepted_responses(r, bad)


def accepted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir)[0].groupBy("run_id", "partition_id").agg(F.count(F.lit(1)).alias("n_findings"))


def response_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir)[1]


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses(spark, sf_dir)
    gaps = _accepted(spark, sf_dir)[1].where("gap_class = 'response-failed'")
    return marts.coverage_counts(r.join(gaps.select("run_id", "partition_id"), ["run_id", "partition_id"], "left_anti"), gaps)


def refuted_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second lead is refuted; with the place that it came from."""
    leads = settled(lead_queries.leads(spark, sf_dir))
    adjudications = leads.where("doc % 2 = 0").select("run_id", "lead_id", F.lit("refuted").alias("outcome"), F.concat(F.lit("not reachable in "), "file").alias("reason"))
    return marts.refuted_leads(adjudications, leads).select("run_id", "lead_id", "reason", "rule_id", "file", F.col("line").cast("long").alias("line"))


def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of all stages in one table, each with its target and reason: neutralized batches, what they leave unverified, and leads left open, too."""
    r = reviewed(spark, sf_dir)
    bad = spoiled(r.batches)
    invalid = stored(vop.first_batch_violations(bad, r.findings, r.chains))
    kept = stored(vop.neutralized(bad, invalid))
    lost = marts.neutralized_gaps(bad, invalid)  # their targets are listed here, with the cause
    valid = kept.join(invalid.select("run_id", "pos"), ["run_id", "pos"], "left_anti")
    left_open = marts.inconclusive_leads(r.outcomes)
    surface = surface_queries.surface_gaps(spark, sf_dir)
    answers = response_gaps(spark, sf_dir)
    leads = lead_queries.assigned(spark, sf_dir).where("gap is not null").select("run_id", F.lit("lead").alias("gap_class"), F.col("lead_id").alias("target"), F.col("gap").alias("reason"))
    review = vop.verification_gaps(valid, vop.resolve_chains(r.findings, r.chains, kept)).select("run_id", F.concat(F.lit("unverified-"), "target_type").alias("gap_class"), F.col("target_id").alias("target"), "reason")
    return marts.coverage_ledger(surface, answers, leads, review, lost, left_open)


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "work_rows")
    digest = F.sha2(F.to_json(F.struct(F.col("input").alias("a"), (F.col("pos") % 3).alias("b"))), 256)
    good = F.concat(F.lit('{"status":"ok","verdicts":[]'), F.when(F.col("pos") % 5 == 0, F.lit(',"more":1')).otherwise(F.lit("")), F.lit("}"))
    rows = rows.select("kind", "target_id", digest.alias("input_digest"), good.alias("response"), F.col("pos").alias("stored_at"), "is_new", "pos")
    return rows.where("not is_new"), rows.where("is_new")


#: Numbers and strings as they may stand in JSON, and as they stand in its canonical text.
WRITTEN = (
    ("1e2", "100"), ("1e400", "null"), ("1.5e-7", "1.5e-7"), ("-0", "0"), ("12345678901234567890", "12345678901234567000"), ("0.000001", "0.000001"), ("1E21", "1e+21"), ("123456789012345680000", "123456789012345680000"), ("2.50", "2.5"), ("-1.0e-10", "-1e-10"),
    (r'"\u00e9\/"', '"é/"'), (r'"\ud800"', r'"\ud800"'), (r'"\u0001\n"', r'"\u0001\n"'),
)


def input_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of typed inputs, and of the same as JSON text in another order of keys: they're equal. `odd` is that of a text with a repeated key and odd values."""
    rows = table(spark, sf_dir, "work_rows")
    typed = rows.select("pos", F.struct(F.col("input").alias("z"), F.struct((F.col("pos") % 3).alias("y"), F.array("input").alias("x")).alias("a")).alias("v"))
    free = F.concat(F.lit('{"z": "'), F.col("v.z"), F.lit('", "a": {"y": '), F.col("v.a.y").cast("string"), F.lit(', "x": ["'), F.col("v.z"), F.lit('"]}}'))
    value = F.get(F.array(*[F.lit(w) for w, _ in WRITTEN]), (F.col("pos") % len(WRITTEN)).cast("int"))
    odd = F.concat(F.lit('{"b": 0, "😀": {}, "k": ['), value, F.lit(', {"y": true, "x": ['), value, F.lit(']}], "\ufb01": null, "b": "'), F.col("v.z"), F.lit('"}'))
    return typed.select("pos", incremental.typed_digest(F.col("v"), typed.schema["v"].dataType).alias("typed"), incremental.json_digest(free).alias("free"), incremental.json_digest(odd).alias("odd"))


def reusable_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _store(spark, sf_dir)
    work = new.select(*incremental.KEY).distinct()
    reuse, rest = incremental.split_reusable(work, incremental.usable_store(old.select(*incremental.KEY, "response", "stored_at"), "verifier-response"))
    return reuse.select("target_id", "input_digest", F.lit("reuse").alias("plan")).union(rest.select("target_id", "input_digest", F.lit("compute")))


def stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _store(spark, sf_dir)
    fresh = new.withColumn("passed", F.col("pos") % 5 != 0)
    return incremental.stored(old, fresh).select("target_id", "input_digest", "stored_at")


QUERIES = {
    f.__name__: f for f in (finding_gate, contract_gate, partition_binding, lead_coverage, accepted_findings, response_gaps, coverage_counts, refuted_leads, coverage_ledger, input_digests, reusable_work, stored_responses)
}

_GATE = " ".join(f"WHEN {i} THEN '{e}'" for i, _, _, e in _BREAKS)

_RESPONSES = """
resp AS (SELECT run_id, partition_id, CAST(split_part(run_id, '-', 2) AS INT) * 7 + CAST(substr(partition_id, 2, 1) AS INT) AS n, count(*) AS k, max(CASE WHEN origin = 'sast-lead' THEN finding_id END) AS lead_finding, max(lead_id) AS lead FROM flat_findings GROUP BY ALL),
bind AS (SELECT run_id, partition_id, CASE n % 8 WHEN 1 THEN 'response of another partition' WHEN 2 THEN 'id of another partition' WHEN 3 THEN 'duplicate id' END AS violation FROM resp WHERE n % 8 IN (1, 2, 3)),
cover AS (SELECT run_id, partition_id, lead AS lead_id, 'lead without outcome' AS violation FROM resp WHERE lead IS NOT NULL AND n % 9 = 3 UNION ALL SELECT run_id, partition_id, 'L999', 'unknown lead' FROM resp WHERE lead IS NOT NULL AND n % 9 = 3
  UNION ALL SELECT run_id, partition_id, lead, 'lead with several outcomes' FROM resp WHERE lead IS NOT NULL AND n % 9 = 2
  UNION ALL SELECT run_id, partition_id, lead, 'promoted to no finding' FROM resp WHERE lead IS NOT NULL AND n % 9 <> 3 AND (n % 9 = 1 OR n % 8 = 2)),
failed AS (SELECT run_id, partition_id FROM bind UNION SELECT run_id, partition_id FROM cover),
usable AS (SELECT r.*, f.run_id IS NULL AND n % 10 <> 4 AS ok, f.run_id IS NOT NULL AS bad FROM resp r LEFT JOIN failed f ON r.run_id = f.run_id AND r.partition_id = f.partition_id),
rgap AS (SELECT run_id, partition_id, 'skipped-path' AS gap_class, 'src/skip.java' AS target, 'too large' AS reason FROM usable WHERE ok AND n % 10 = 5
  UNION ALL SELECT run_id, partition_id, 'response-failed', partition_id, CASE WHEN bad THEN 'response failed its gates' ELSE 'response is an error' END FROM usable WHERE NOT ok)
"""


def _resp(select: str) -> str:
    return ctes("flat_findings") + _RESPONSES.strip() + " " + select


_WORK = """
w AS (SELECT *, sha256('{"a":"' || input || '","b":' || (pos % 3) || '}') AS d, pos % 5 <> 0 AS good FROM work_rows),
new AS (SELECT DISTINCT target_id, d FROM w WHERE is_new)
"""


def _work(select: str) -> str:
    return ctes("work_rows") + _WORK.strip() + " " + select


def _kinds() -> str:
    """Which documents there are, by their numbers."""
    tables = {
        "final-finding": "SELECT run_id, finding_id AS id, number AS n FROM canon", "chain": "SELECT run_id, chain_id, number FROM chain", "verdict": "SELECT run_id, target_type || ':' || target_id, number FROM verdict WHERE v IS NOT NULL",
        "sarif-lead": "SELECT run_id, lead_id, CAST(substr(lead_id, 2) AS INT) FROM lead_", "analyzer-response": "SELECT DISTINCT run_id, partition_id, CAST(split_part(run_id, '-', 2) AS INT) FROM flat_findings",
    }
    parts = [f"SELECT run_id, '{kind}' AS kind, id, n % {each} <> 0 AS valid, CASE WHEN n % {each} = 0 THEN '{error}' ELSE '' END AS errors FROM ({tables[kind]}) t(run_id, id, n)" for kind, each, _, _, error in _KIND_BREAKS]
    return _review("").rstrip() + ",\n" + ctes("sarif_rows")[len("WITH ") :] + lead_queries._LEADS.strip() + " " + " UNION ALL ".join(parts)


_GONE = """
gone AS (SELECT d.run_id, d.pos, d.batch_id AS bid, error, s.batch_id, first_target FROM defect d JOIN spoilt s ON s.run_id = d.run_id AND s.pos = d.pos WHERE error IS NOT NULL),
silent AS (SELECT p.run_id, p.target_type, p.target_id, pos, bid, error FROM plan p JOIN gone g ON g.run_id = p.run_id AND g.batch_id = p.batch_id),
cut AS (SELECT j.run_id, j.chain_id, m1, m2, v, CASE WHEN a.target_id IS NULL THEN s1 ELSE 'not-requested' END AS s1, CASE WHEN b.target_id IS NULL THEN s2 ELSE 'not-requested' END AS s2 FROM joined j
  LEFT JOIN silent a ON a.run_id = j.run_id AND a.target_type = 'finding' AND a.target_id = m1 LEFT JOIN silent b ON b.run_id = j.run_id AND b.target_type = 'finding' AND b.target_id = m2
  ANTI JOIN silent c ON c.run_id = j.run_id AND c.target_id = j.chain_id)
"""


def _ledger() -> str:
    leads, none = lead_queries._LEADS.strip(), "NULL::BIGINT AS score"
    return (
        _review("").rstrip() + ",\n" + ctes("source_rows", "sarif_rows")[len("WITH ") :] + surface_queries._SURFACE.strip() + ",\n" + leads + ",\n" + _RESPONSES.strip() + ",\n" + _GONE.strip()
        + f""" SELECT run_id, gap_class, target, reason, score FROM ({surface_queries._GAPS}) g UNION ALL SELECT run_id, gap_class, target, reason, {none} FROM rgap
            UNION ALL SELECT run_id, 'lead', lead_id, gap, {none} FROM asg WHERE gap IS NOT NULL
            UNION ALL SELECT run_id, 'unverified-' || target_type, target_id, 'no verdict (batch ' || batch_id || ')', {none} FROM verdict x WHERE v IS NULL AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.run_id = x.run_id AND g.batch_id = x.batch_id)
            UNION ALL SELECT run_id, 'unverified-chain', chain_id, 'member finding(s) unverified: ' || concat_ws(', ', CASE WHEN s1 = 'not-requested' THEN m1 END, CASE WHEN s2 = 'not-requested' THEN m2 END), {none}
              FROM cut WHERE v <> 'rejected' AND s1 <> 'rejected' AND s2 <> 'rejected' AND (s1 = 'not-requested' OR s2 = 'not-requested')
            UNION ALL SELECT run_id, 'neutralized-batch', target, 'batch ' || bid || ' neutralized: ' || error, {none} FROM (
              SELECT run_id, bid, error, target_type || ':' || target_id AS target FROM silent WHERE pos % 11 <> 6 UNION ALL SELECT run_id, bid, error, 'finding:nobody' FROM gone WHERE pos % 11 = 5
              UNION ALL SELECT run_id, bid, error, unnest([first_target, first_target]) FROM gone WHERE pos % 11 = 6) l
            UNION ALL SELECT run_id, 'inconclusive-lead', lead_id, coalesce(nullif(reason, ''), 'inconclusive'), {none} FROM lead_outcomes WHERE outcome = 'inconclusive'"""
    )


ORACLE_SQL = {
    "finding_gate": canon_ctes() + f", x AS (SELECT run_id, number, CASE number % 20 {_GATE} WHEN 19 THEN '$: not JSON' ELSE '' END AS errors FROM canon) SELECT run_id, number, errors = '' AS valid, errors FROM x",
    "contract_gate": _kinds(),
    "partition_binding": _resp("SELECT run_id, partition_id, violation FROM bind"),
    "lead_coverage": _resp("SELECT run_id, partition_id, lead_id, violation FROM cover"),
    "accepted_findings": _resp("SELECT run_id, partition_id, k AS n_findings FROM usable WHERE ok"),
    "response_gaps": _resp("SELECT run_id, partition_id, gap_class, target, reason FROM rgap"),
    "coverage_counts": _resp("SELECT run_id, count_if(ok)::BIGINT AS analyzed, count_if(NOT ok)::BIGINT AS gaps FROM usable GROUP BY run_id"),
    "refuted_leads": ctes("sarif_rows") + lead_queries._LEADS.strip() + " SELECT run_id, lead_id, 'not reachable in ' || file AS reason, rule_id, file, line::BIGINT AS line FROM lead_ WHERE doc % 2 = 0",
    "coverage_ledger": _ledger(),
    "input_digests": _work("""SELECT pos, sha256('{"a":{"x":["' || input || '"],"y":' || (pos % 3) || '},"z":"' || input || '"}') AS typed, sha256('{"a":{"x":["' || input || '"],"y":' || (pos % 3) || '},"z":"' || input || '"}') AS free,
        sha256('{"b":"' || input || '","k":[' || v || ',{"x":[' || v || '],"y":true}],"😀":{},"\ufb01":null}') AS odd FROM (SELECT *, [""" + ", ".join(f"'{c}'" for _, c in WRITTEN) + f"][pos % {len(WRITTEN)} + 1] AS v FROM w)"),
    "reusable_work": _work("SELECT target_id, d AS input_digest, CASE WHEN EXISTS (SELECT 1 FROM w o WHERE NOT o.is_new AND o.good AND o.target_id = new.target_id AND o.d = new.d) THEN 'reuse' ELSE 'compute' END AS plan FROM new"),
    "stored_responses": _work("SELECT target_id, d AS input_digest, max(pos) AS stored_at FROM w WHERE NOT is_new OR good GROUP BY ALL"),
}
