"""Registered queries against their SQL in DuckDB, and the driver's contract."""

import os

import duckdb
import pytest

import __spark_entry__
from leadmill.jobs.registry import ORACLE_SQL, QUERIES

#: One of each area; the driver compares all of them.
SOME = ("finding_merge", "finding_arrays", "resolved_chains", "batch_validation", "sarif_results", "matrices_by_category", "built_ledger", "surface_vectors", "budget_allocation", "sarif_leads", "lead_coverage", "parsed_truth", "stored_responses",
        "sarif_documents", "junit_documents", "run_validation", "contract_gate", "refuted_leads", "coverage_ledger", "summary_documents", "flagged_cases", "input_digests", "sarif_pieces", "surface_byte_files")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, sf_dir, base, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = base.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(names) == columns and got == want


def test_every_sql_has_its_query():
    assert ORACLE_SQL.keys() == QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_the_coverage_ledger_tells_each_gap(spark, sf_dir):
    ledger = QUERIES["coverage_ledger"](spark, sf_dir).cache()
    assert set(ledger.columns) == {"run_id", "gap_class", "target", "reason", "score"}
    assert ledger.where("target is null or reason is null or reason = ''").count() == 0
    assert {"neutralized-batch", "unverified-finding", "unverified-chain", "response-failed", "lead", "inconclusive-lead"} <= {r[0] for r in ledger.select("gap_class").distinct().collect()}
    # A chain has its own batch, and counts as open if a member's batch was neutralized.
    lost = ledger.where("gap_class = 'neutralized-batch'").selectExpr("run_id", "split_part(target, ':', 2) AS member")
    open_ = ledger.where("reason like 'member finding(s) unverified: %'").selectExpr("run_id", "explode(split(substring(reason, 31), ', ')) AS member")
    assert open_.join(lost, ["run_id", "member"]).count() > 0
    assert ledger.where("gap_class = 'unverified-finding'").selectExpr("run_id", "target AS member").join(lost, ["run_id", "member"]).count() == 0
    ledger.unpersist()
