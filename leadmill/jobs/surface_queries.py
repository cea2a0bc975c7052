"""Queries over source files: the token scan, count vectors, budget allocation and coverage gaps.

`documents` stand for source files: a run per language, a partition per source. Spanish files have no token page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.functions import paths
from leadmill.functions.lineage import settled
from leadmill.functions.text import decoded
from leadmill.jobs.tables import ctes, table
from leadmill.operators import surface as op

#: Tokens by stack, made for the words of the documents: sources, sinks, sanitizers, authentication markers.
TOKENS = {
    "en": (["token", "the "], ["License", "password", "&&&"], ["$$$"], ["of", "license", ""]),
    "de": (["und", "die "], ["Lizenz", "###", "der"], ["***"], ["nicht", "token ="]),
    "fr": (["une ", "@"], ["***", "est"], ["%%%"], ["pour", "@"]),
}


def tokens(spark: SparkSession) -> DataFrame:
    arrays = lambda t: F.array(*[F.lit(x) for x in t]).cast("array<string>")
    rows = [F.struct(F.lit(s).alias("stack"), *[arrays(t).alias(k) for k, t in zip(op.KINDS, v, strict=True)]) for s, v in TOKENS.items()]
    return spark.range(1).select(F.inline(F.array(*rows)))


def file_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.file_hits(table(spark, sf_dir, "source_rows"), tokens(spark))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.surface_vectors(settled(file_hits(spark, sf_dir)))


def leads_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_rows").where("content like '%token = %'")
    return rows.groupBy("run_id", "partition_id").agg(F.count(F.lit(1)).alias("leads"))


def surface_file_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_hits(spark, sf_dir).select("run_id", "path", "has_source", "has_sink", "has_sanitizer", "has_auth", "source_hits", "sink_hits", "auth_hits", "skip_reason")


def byte_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files as bytes: in Latin-1, as UTF-8 that is cut in its middle, or as UTF-8."""
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    latin = F.encode(F.regexp_replace(text, r"[^\x{0}-\x{FF}]", "?"), "ISO-8859-1")
    whole = text.cast("binary")
    content = F.when(i % 3 == 0, latin).when(i % 3 == 1, F.substring(whole, F.lit(1), F.floor(F.octet_length(whole) / 2).cast("int"))).otherwise(whole)
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("run_id"), F.col("source").alias("partition_id"), F.col("lang").alias("stack"), i.cast("string").alias("path"), content.alias("content"), F.lit(None).cast("string").alias("skip_reason"))


def surface_byte_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whatever their bytes: digests are those of the bytes, and the scan reads what decodes."""
    files = byte_files(spark, sf_dir)
    seen = files.select("path", F.char_length(decoded(F.col("content"))).cast("long").alias("n_chars"))
    return op.file_hits(files, tokens(spark)).select("path", "digest", "has_source", "sink_hits").join(seen, "path")


def surface_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir)


def budget_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.scored(vectors(spark, sf_dir), leads_by_partition(spark, sf_dir)).select("run_id", "partition_id", "leads", "score")


def budget_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.allocate(vectors(spark, sf_dir), leads_by_partition(spark, sf_dir)).select("run_id", "partition_id", "score", "place", "allocation")


def surface_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = op.coverage_gaps(op.allocate(vectors(spark, sf_dir), leads_by_partition(spark, sf_dir)))
    return gaps.select("run_id", "gap_class", "target", "score", "reason", *[F.col(f"counts.{c}") for c in ("sources", "sinks", "skipped_missing", "skipped_out_of_scope")])


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of page numbers, some in folders that scans leave out."""
    i = F.col("page_id")
    folder = F.element_at(F.array(*[F.lit(x) for x in ("src", "src/build", "node_modules/x", "lib", "builds", "app/obj", "src/out/y")]), (i % 7 + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("A.java", "b.min.js", "c.py", "package.json", "d.cs", "e.PHP", "pom.xml", "f.txt", "g.ts", "h_pb2.py", "i")]), (i % 11 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("run-"), (i % 5).cast("string")).alias("run_id"), "page_id", F.concat(folder, F.lit("/"), i.cast("string"), F.lit("/"), name).alias("path"))


def excluded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.scanned_files(_page_files(spark, sf_dir)).select("run_id", "path")


def detected_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.detected_stacks(_page_files(spark, sf_dir))


def confined_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages against a root and a manifest of the even pages."""
    i = F.col("page_id")
    raw = F.element_at(F.array(F.concat(F.lit("src/./"), i.cast("string")), F.concat(F.lit("a/../src//"), i.cast("string")), F.concat(F.lit("../../etc/"), i.cast("string")), F.concat(F.lit("/work/apps/src/"), i.cast("string")), F.lit("/work/app"), F.concat(F.lit("/work/app/src/x/../"), i.cast("string"))), (i % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", raw.alias("path"))
    manifest = table(spark, sf_dir, "pages").where("page_id % 2 = 0").select(F.lit("run").alias("run_id"), F.concat(F.lit("src/"), i.cast("string")).alias("file"))
    from leadmill.operators.leads import confined

    return confined(rows.withColumn("run_id", F.lit("run")), manifest, "path", "/work/app").select("page_id", "file", "drop")


QUERIES = {f.__name__: f for f in (surface_file_hits, surface_byte_files, surface_vectors, budget_scores, budget_allocation, surface_gaps, excluded_paths, detected_stacks, confined_paths)}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(tokens_: list[str]) -> str:
    return "[" + ", ".join(map(_q, tokens_)) + "]"


_TOKENS = "tok(stack, s, k, n, a) AS (VALUES " + ", ".join(f"({_q(x)}, {', '.join(_list(t) for t in v)})" for x, v in TOKENS.items()) + ")"
_HITS = lambda c: f"coalesce(list_sum(list_transform(list_filter({c}, lambda t: t <> ''), lambda t: ((strlen(content) - strlen(replace(content, t, ''))) // strlen(t)))), 0)::BIGINT"
_ANY = lambda c: f"coalesce(len(list_filter({c}, lambda t: t <> '' AND contains(content, t))) > 0, false)"
_MARK = r"""coalesce(len(list_filter(a, lambda t: t <> '' AND regexp_matches(content, '(^|[^A-Za-z0-9_])' || regexp_escape(t) || CASE WHEN regexp_matches(t, '[A-Za-z0-9_]$') THEN '($|[^A-Za-z0-9_])' ELSE '' END))) > 0, false)"""

_SURFACE = f"""
{_TOKENS},
fh AS (SELECT run_id, partition_id, f.stack, path, tok.stack IS NOT NULL AS supported, content, CASE WHEN content IS NULL THEN skip_reason END AS skip_reason, {_ANY("s")} AS has_source, {_ANY("k")} AS has_sink, {_ANY("n")} AS has_sanitizer, {_MARK} AS has_auth,
  {_HITS("s")} AS source_hits, {_HITS("k")} AS sink_hits, {_HITS("a")} AS auth_hits FROM source_rows f LEFT JOIN tok ON f.stack = tok.stack),
g AS (SELECT run_id, partition_id, min(stack) AS stack, bool_or(supported) AS supported, count(*) AS files, count(*) FILTER (has_source) AS sources, count(*) FILTER (has_sink) AS sinks, count(*) FILTER (has_sanitizer) AS sanitizers, count(*) FILTER (has_auth) AS auth_markers,
  count(*) FILTER (has_source AND has_auth) AS source_and_auth_files, sum(CASE WHEN has_source THEN source_hits ELSE 0 END)::BIGINT AS source_hits, sum(CASE WHEN has_sink THEN sink_hits ELSE 0 END)::BIGINT AS sink_hits, sum(CASE WHEN has_auth THEN auth_hits ELSE 0 END)::BIGINT AS auth_hits,
  count(*) FILTER (skip_reason = 'missing') AS skipped_missing, count(*) FILTER (skip_reason = 'out_of_scope') AS skipped_out_of_scope, sha256(string_agg(path, chr(10) ORDER BY path)) AS content_key,
  sha256(unhex(coalesce(string_agg(CASE WHEN content IS NOT NULL THEN sha256(content) || '00' END, '' ORDER BY path), ''))) AS file_content_digest FROM fh GROUP BY ALL),
v AS (SELECT *, supported AND skipped_missing + skipped_out_of_scope <> files AS ok FROM g),
ld AS (SELECT run_id, partition_id, count(*) AS leads FROM source_rows WHERE content LIKE '%token = %' GROUP BY ALL),
sc AS (SELECT v.*, leads, CASE WHEN ok THEN (sources > 0)::INT + 2 * (sinks > 0)::INT + 3 * (sources > 0 AND sinks > 0)::INT + 4 * (sources > 0 AND sinks > 0 AND source_and_auth_files < sources)::INT + least(sink_hits, 10) ELSE 0 END + 2 * least(coalesce(leads, 0), 10) AS score FROM v LEFT JOIN ld USING (run_id, partition_id)),
al AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY run_id, ok ORDER BY score DESC, content_key, partition_id) END AS place FROM sc),
an AS (SELECT *, CASE WHEN place <= 12 THEN 'analyze' WHEN ok THEN 'deprioritized' WHEN supported THEN 'unreadable-partition' ELSE 'unsupported-stack' END AS allocation FROM al)
"""


def _surface(select: str) -> str:
    return ctes("source_rows") + _SURFACE.strip() + " " + select


_COUNTS = ("sources", "sinks", "sanitizers", "auth_markers", "source_and_auth_files", "source_hits", "sink_hits", "auth_hits", "content_key", "file_content_digest")
_FOLDERS, _NAMES = "['src', 'src/build', 'node_modules/x', 'lib', 'builds', 'app/obj', 'src/out/y']", "['A.java', 'b.min.js', 'c.py', 'package.json', 'd.cs', 'e.PHP', 'pom.xml', 'f.txt', 'g.ts', 'h_pb2.py', 'i']"
_PF = f"WITH pf AS (SELECT 'run-' || (page_id % 5) AS run_id, page_id, {_FOLDERS}[page_id % 7 + 1] AS folder, {_NAMES}[page_id % 11 + 1] AS name FROM pages)"

# Latin-1 text as a UTF-8 decoder reads its bytes: well-formed sequences, and the longest beginnings of such that end too early (Unicode, table 3-7).
_UTF8 = (
    r"[\x{0}-\x{7F}]|[\x{C2}-\x{DF}][\x{80}-\x{BF}]|\x{E0}[\x{A0}-\x{BF}][\x{80}-\x{BF}]|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]{2}|\x{ED}[\x{80}-\x{9F}][\x{80}-\x{BF}]|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]{2}|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{3}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]{2}"
    r"|\x{E0}[\x{A0}-\x{BF}]|[\x{E1}-\x{EC}\x{EE}\x{EF}][\x{80}-\x{BF}]|\x{ED}[\x{80}-\x{9F}]|\x{F0}[\x{90}-\x{BF}][\x{80}-\x{BF}]?|[\x{F1}-\x{F3}][\x{80}-\x{BF}]{1,2}|\x{F4}[\x{80}-\x{8F}][\x{80}-\x{BF}]?|[\x{80}-\x{FF}]"
)
_BYTES = f"""WITH {_TOKENS},
d AS (SELECT doc_id, doc_id % 3 AS form, lang, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[^\\x{{0}}-\\x{{FF}}]', '?', 'g') AS l, strlen(coalesce(text, '')) // 2 AS half FROM documents),
x AS (SELECT *, CASE form WHEN 0 THEN array_to_string(list_transform(string_split(l, ''), lambda c: printf('%02X', unicode(c))), '') WHEN 1 THEN substr(hex(encode(t)), 1, 2 * half) ELSE hex(encode(t)) END AS h FROM d),
y AS (SELECT *, CASE form WHEN 0 THEN len(regexp_extract_all(l, '{_UTF8}')) WHEN 1 THEN len(regexp_extract_all(regexp_replace(h, '(..)', '\\1 ', 'g'), '[0-7C-F][0-9A-F] ')) ELSE length(t) END AS n_chars FROM x),
z AS (SELECT *, CASE form WHEN 0 THEN l WHEN 1 THEN left(t, n_chars - CASE WHEN strlen(left(t, n_chars)) > half THEN 1 ELSE 0 END) ELSE t END AS content FROM y)
SELECT doc_id::VARCHAR AS path, sha256(unhex(h)) AS digest, {_ANY("s")} AS has_source, {_HITS("k")} AS sink_hits, n_chars::BIGINT AS n_chars FROM z LEFT JOIN tok ON lang = tok.stack"""

_GAPS = """SELECT run_id, allocation AS gap_class, partition_id AS target, CASE WHEN allocation = 'deprioritized' THEN score END::BIGINT AS score, CASE allocation WHEN 'deprioritized' THEN 'deprioritized: analyzer budget exhausted; lower predicted attack surface'
        WHEN 'unreadable-partition' THEN 'all files unreadable (missing/escape) — surface not assessed' ELSE 'unsupported stack "' || stack || '" — surface not assessed; not covered by this audit' END AS reason,
        CASE WHEN ok THEN sources ELSE 0 END AS sources, CASE WHEN ok THEN sinks ELSE 0 END AS sinks, CASE WHEN supported THEN skipped_missing ELSE 0 END AS skipped_missing, CASE WHEN supported THEN skipped_out_of_scope ELSE 0 END AS skipped_out_of_scope FROM an WHERE allocation <> 'analyze'"""

ORACLE_SQL = {
    "surface_byte_files": _BYTES,
    "surface_file_hits": _surface("SELECT run_id, path, has_source, has_sink, has_sanitizer, has_auth, source_hits, sink_hits, auth_hits, skip_reason FROM fh"),
    "surface_vectors": _surface(
        "SELECT run_id, partition_id, stack, ok AS scannable, files, " + ", ".join(f"CASE WHEN ok THEN {c} END AS {c}" for c in _COUNTS)
        + ", CASE WHEN supported THEN skipped_missing END AS skipped_missing, CASE WHEN supported THEN skipped_out_of_scope END AS skipped_out_of_scope, CASE WHEN supported AND NOT ok THEN 'all files unreadable (missing/escape) — surface not assessed' END AS reason FROM v"
    ),
    "budget_scores": _surface("SELECT run_id, partition_id, leads, score::BIGINT AS score FROM sc"),
    "budget_allocation": _surface("SELECT run_id, partition_id, score::BIGINT AS score, place, allocation FROM an"),
    "surface_gaps": _surface(_GAPS),
    "excluded_paths": _PF + " SELECT run_id, folder || '/' || page_id || '/' || name AS path FROM pf WHERE folder NOT IN ('src/build', 'node_modules/x', 'app/obj', 'src/out/y') AND name NOT IN ('b.min.js', 'h_pb2.py')",
    "detected_stacks": _PF + """, s AS (SELECT run_id, CASE WHEN name = 'A.java' OR name = 'pom.xml' THEN 'java' WHEN name IN ('b.min.js', 'package.json', 'g.ts') THEN 'node' WHEN name IN ('c.py', 'h_pb2.py') THEN 'python' WHEN name = 'd.cs' THEN 'dotnet' WHEN name = 'e.PHP' THEN 'php' END AS stack FROM pf)
        SELECT run_id, stack, count(*) AS n_files FROM s WHERE stack IS NOT NULL GROUP BY ALL""",
    "confined_paths": """SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id % 6 <> 2 AND page_id % 6 <> 4 THEN 'src/' || page_id END AS file,
        CASE WHEN page_id % 6 IN (2, 3) THEN 'out_of_scope' WHEN page_id % 6 = 4 OR page_id % 2 = 1 THEN 'missing' END AS "drop" FROM pages""",
}
