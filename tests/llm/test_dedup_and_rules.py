import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadmill.llm import dealing, queries, quality_rules, simhash, substring_dedup
from tests.llm import brute


def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_substring_dedup_whole_table(spark, sf_dir):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op2_substring_dedup(spark, sf_dir).collect()}
    want = brute.removed(texts(spark, sf_dir))
    assert got == want and any(n for _, n, _ in want.values())


def test_substring_dedup_odd_rows(spark):
    docs = brute.odd_frame(spark)
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeats(docs).collect()}
    assert got == brute.removed(brute.ODD)
    assert substring_dedup.repeats(docs.where("false")).count() == 0
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r for r in out.collect()}
    assert kept[8].text == dict(brute.ODD)[8] and kept[10].text == "" and kept[9].text == "before after" and kept[9].n_words == "l"
    assert kept[2].text == "" and kept[4].text == " \t\r\n"


def extended(texts, block=10, window=20, anchors=True):
    """Which windows of one batch are extended: (text, start)."""
    made = substring_dedup._Batch(pa.array([t.encode() for t in texts], pa.binary()), window, block, 5)
    if not anchors:
        made.anchor[:] = False
    size = np.diff(made.words.first)
    text, start = np.repeat(np.arange(len(texts)), size), np.arange(size.sum()) - np.repeat(made.words.first[:-1], size)
    areas = substring_dedup._runs((made.key >> np.uint64(32)).astype(np.int64))
    none = {r: (substring_dedup._bits(np.zeros(b - a, bool)),) * 2 for r, a, b in areas}
    where = made.extensions(none)
    return set(zip(text[where].tolist(), start[where].tolist(), strict=True))


def test_only_hits_of_anchors_are_extended():
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    shared = words("s", 27)
    for shift in range(10):  # whatever the passage's shift against the blocks of its first occurrence
        texts = [" ".join(words("a", 20 + shift) + shared + words("b", 30)), " ".join(words("c", 33) + shared + words("d", 30))]
        found = extended(texts)
        assert {(0, s) for s in range(20 + shift, 28 + shift)} | {(1, s) for s in range(33, 41)} <= found
        assert all(s + 20 > 20 + shift and s < 47 + shift for k, s in found if k == 0) and all(s + 20 > 33 and s < 60 for k, s in found if k == 1)
        assert not extended(texts, anchors=False)
    # Blocks longer than half a window miss repeats that hold no whole block of the first occurrence: such are refused.
    texts = [" ".join(words("a", 25) + words("s", 20) + words("b", 30)), " ".join(words("c", 40) + words("s", 20))]
    assert (1, 40) in extended(texts) and (1, 40) not in extended(texts, block=16)
    with pytest.raises(ValueError):
        substring_dedup.repeats(None, window=20, block=11)


def test_rows_of_packed_hashes_stay_in_proportion():
    per_hash = []
    for volume in (1 << 30, 1 << 40, 100 << 40):
        batch, area = substring_dedup.sizes(volume)
        per_hash.append(batch / substring_dedup.WORD / (volume / substring_dedup.WORD / area))
    assert all(x > substring_dedup.FILL * 0.99 for x in per_hash) and substring_dedup.sizes(30 << 30)[0] < 2 * substring_dedup.BATCH


def test_substring_dedup_random(spark):
    rng = random.Random(7)
    base = [[rng.choice("abcdef") * rng.randint(1, 3) for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, 20)
            w += b[a : a + rng.randint(5, 40)] + [f"u{rng.randint(0, 99999)}"] * rng.randint(0, 2)
        rows.append((i * 3 % 151, " ".join(w)))
    got = {r.row.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.removed(rows)


def test_substring_dedup_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.repeats(docs).collect()) == [0, 30, 30]


def test_rows_with_one_id_or_none_are_parted(spark):
    rng = random.Random(2)
    text = lambda: " ".join(str(rng.randint(0, 10**6)) for _ in range(100))
    rows = [(i, text()) for i in range(40)] + [(7, text()) for _ in range(200)] + [(None, text()) for _ in range(200)] + [(3, None), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cut = dealing.cuts(dealing.text_keys(frame, "doc_id", "text"), 40, 7000)
    dealt = frame.withColumn("h", dealing.order_hash("text")).withColumn("batch", cut.batch(F.col("doc_id"), F.col("h"))).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.h)
    dealt.sort(key=key)
    assert [r.batch for r in dealt] == sorted(r.batch for r in dealt) and len(dealt) == len(rows)
    sizes = Counter(r.batch for r in dealt)
    assert len(sizes) > 30 and max(sizes.values()) < 30 and not {r.batch for r in dealt if r.doc_id is None} & {r.batch for r in dealt if r.doc_id is not None}
    assert set(sizes) == set(range(cut.n))
    twice = frame.unionByName(frame.where("doc_id is null"))
    order = sorted(twice.withColumn("h", dealing.order_hash("text")).collect(), key=lambda r: (*key(r), r.text or ""))
    want = brute.removed([(k, r.text) for k, r in enumerate(order)])
    got = substring_dedup.repeats(twice).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter((order[k].doc_id, *x) for k, x in want.items()) and sum(n > 0 for _, n, _ in want.values()) == 200


def test_simhash_whole_table(spark, sf_dir):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, sf_dir).collect()}
    assert got == brute.near(texts(spark, sf_dir))


def test_simhash_odd_rows(spark):
    docs = brute.odd_frame(spark)
    got = {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.near(brute.ODD) and got[2] == got[3] == got[4] == ("0" * 16, 2)
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    kept = simhash.keep_one(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()})
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.near_duplicates(nulls).count() == docs.count()
    # Without ids, and with one id for all, a row of each component stays.
    same = docs.withColumn("doc_id", F.lit(7).cast("long"))
    for frame in (nulls, same, nulls.union(nulls), same.union(nulls)):
        assert simhash.keep_one(frame).count() == len({c for _, c in got.values()})
    assert {r.doc_id for r in simhash.keep_one(nulls.union(same)).collect()} == {7}


def test_keep_one_keeps_columns_of_any_name(spark):
    names = ["i", "h", "row", "t", "__hash", "__id", "id_", "of_", "fp", "least", "m", "root"]
    docs = brute.odd_frame(spark).select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    kept = simhash.keep_one(docs.union(docs))
    assert kept.columns == docs.columns and [kept.first()[n] for n in names] == list(range(len(names)))
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute.near(brute.ODD).values()}


def test_near_copies_are_caught(spark):
    """Texts of which 1 word in 100 is another have nine of ten five-word shingles in common; the pipeline's radius links nine of ten of them."""
    import corpus_pipeline

    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(2000)]
    rows = []
    for g in range(100):
        own = [rng.choice(words) for _ in range(300)]
        rows += [(10 * g + k, " ".join(rng.choice(words) if k and rng.random() < 0.01 else w for w in own)) for k in range(2)]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), radius=corpus_pipeline.RADIUS).collect()}
    assert {10 * g for g in range(100)} <= kept and len(kept) <= 110


def test_more_blocks_for_more_fingerprints():
    assert simhash.blocks_for(10**6, 2) == 4 and simhash.blocks_for(15 * 10**6, 8) == 10 and simhash.blocks_for(5 * 10**8, 8) == 11
    for n in (0, 1, 10**6, 10**9, 10**12):
        b = simhash.blocks_for(n, 8)
        assert b >= 10 and n <= simhash.BUCKET << (64 * (b - 8) // b)


@pytest.mark.parametrize(("radius", "blocks", "chunk"), [(2, None, 3), (2, 4, 4096), (0, 2, 4096), (8, None, 4096), (8, 11, 7), (5, 8, 4096)])
def test_links_find_every_pair(spark, radius, blocks, chunk):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 5)]
    for _ in range(300):
        x = fps[rng.integers(0, len(fps))]
        for b in rng.integers(0, 64, rng.integers(0, 4 + 2 * radius)):
            x ^= 1 << int(b)
        fps.append(x)
    fps = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in fps})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.a: r.b for r in simhash.components(simhash.links(frame, radius, blocks, chunk)).collect()}
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= radius:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    assert {x: got.get(x, x) for x in fps} == {x: find(x) for x in fps}


def test_rules_whole_table_and_odd_rows(spark, sf_dir):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = dict(texts(spark, sf_dir))
    for r in queries.op10_quality_rules(spark, sf_dir).collect():
        assert tuple(r[n] for n in names) == brute.rules(rows[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)
    docs = brute.odd_frame(spark)
    for r in quality_rules.judge(docs, ["doc_id", "n_words"]).collect():
        assert tuple(r.m[n] for n in names[:-1]) + (r["__base_failed"],) == brute.rules(dict(brute.ODD)[r.doc_id]), r.doc_id
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.judge(docs.where("false"), ["doc_id"]).count() == 0


def test_tables_of_ids_beyond_a_few_mb_are_not_broadcast(spark):
    from leadmill.llm.chosen_paths import _small

    plan = lambda n: spark.range(1 << 20).join(_small(spark.range(n)), "id")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan(40_000) and "BroadcastHashJoin" in plan(20_000)
