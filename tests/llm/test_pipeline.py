"""Each stage of the pipeline against plain Python on the whole small table and on odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadmill.llm import quality_rules, secret_scan
from tests.llm import brute
from tests.llm.test_models_and_tokens import check_pieces, plain_base

STAGES = dict(corpus_pipeline.STAGES)


def good(text):
    text = text or ""
    w = brute.words(text)
    n_words, word_chars, n_symbols, n_dup_lines, _, failed = brute.rules(text)
    m = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_lines": sum(bool(brute.words(x)) for x in text.split("\n")),
        "n_capitals": len(re.findall("[A-Z]", text)), "n_exclaims": text.count("!"), "n_stop_words": sum(x.lower() in quality_rules.STOP_WORDS for x in w), "n_letter_words": sum(any(c.isalpha() for c in x) for x in w),
    }
    return not failed and all(n_words < r.from_words or not m[r.denominator] or r.least <= m[r.numerator] / m[r.denominator] <= r.most for r in quality_rules.RULES)


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def hidden(text, spans):
    """The text with a mark in place of each run of overlapping secrets."""
    runs = []
    for a, b in sorted(spans):
        if runs and a < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    for a, b in reversed(runs):
        text = text[:a] + secret_scan.MARK + text[b:]
    return text


def check(spark, docs, sf_dir):
    columns, before = docs.columns, texts(docs)
    docs = STAGES["quality_rules"](spark, docs, sf_dir)
    after = texts(docs)
    assert docs.columns == columns and after == {i: t for i, t in before.items() if good(t)}

    docs = corpus_pipeline.reliable(STAGES["simhash_near_dedup"](spark, docs, sf_dir))
    first = {c for _, c in brute.near(list(after.items()), corpus_pipeline.RADIUS).values()}
    before, after = after, texts(docs)
    assert docs.columns == columns and after == {i: t for i, t in before.items() if i in first}

    docs = corpus_pipeline.reliable(STAGES["substring_dedup"](spark, docs, sf_dir))
    want = brute.removed(list(after.items()))
    before, after = after, texts(docs)
    assert docs.columns == columns and after.keys() == want.keys()
    for i, (_, n, digest) in want.items():
        assert hashlib.sha256(" ".join(brute.words(after[i])).encode()).hexdigest() == digest and (n or after[i] == before[i])

    found = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    docs = corpus_pipeline.reliable(STAGES["secret_scan"](spark, docs, sf_dir))
    before, after = after, texts(docs)
    assert docs.columns == columns and after.keys() == before.keys()
    for i, t in before.items():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in found[i].base] == plain_base(t)
        assert after[i] == hidden(t, [(s.value, s.end) for s in found[i].spans]) and not [x for x in plain_base(after[i]) if not x.startswith("assign")]
    if "n_chars" in columns:
        assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
    check_pieces(STAGES["packing"](spark, docs, sf_dir).collect(), after)
    return after


def test_stages_on_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    left = check(spark, docs, sf_dir)
    assert 0 < len(left) < docs.count()
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == left.keys()


@pytest.mark.parametrize("rows", ["odd", "repeated", "none"])
def test_stages_on_odd_rows(spark, sf_dir, rows):
    plain = "the people of this town go to the market and talk of bread, rain and the price of salt"
    extra = [(100, plain + " password = 'hunter2hunter2' for it"), (101, plain.upper()), (102, None), (103, plain + " one two three")]
    docs = brute.odd_frame(spark, [*brute.ODD, *extra])
    if rows == "none":
        for stage in STAGES.values():
            assert stage(spark, docs.where("false"), sf_dir).count() == 0
    elif rows == "repeated":
        once = texts(STAGES["simhash_near_dedup"](spark, docs, sf_dir))
        twice = STAGES["simhash_near_dedup"](spark, docs.union(docs), sf_dir)
        assert texts(twice) == once and twice.count() == len(once)
        for name, stage in STAGES.items():
            out = stage(spark, docs.union(docs.withColumn("doc_id", F.lit(None).cast("long"))), sf_dir)
            assert out.count() > 0, name
    else:
        assert 100 in check(spark, docs, sf_dir)
