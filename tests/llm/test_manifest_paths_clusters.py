import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadmill.llm import centroid_clusters, chosen_paths, merkle_manifest, queries
from tests.llm import brute

# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climbed(leaves, fanout):
    """The root, and of each leaf its (left, right) siblings level by level."""
    level, at, steps = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i - i % fanout
            steps[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
        level, at = [sha(*level[i : i + fanout]) for i in range(0, len(level), fanout)], [i // fanout for i in at]
    return level[0], steps


def manifest_rows(rows, fanout=2):
    """Rows (doc_id, source, lang, n_chars, text) -> sorted results of the query, by plain loops."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([x[2] for x in sorted(groups[g], key=lambda x: x[:3])], fanout) for g in names}
    root, above = climbed([trees[g][0] for g in names], fanout)
    out = []
    for g, up in zip(names, above, strict=True):
        for x, own in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            doc_id, source, lang, n_chars, text = x[3]
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
            node = leaf(doc_id, source, lang, n_chars + 1, text) if hit else x[2]
            for left, right in own + up:
                node = sha(left, node, right)
            out.append((doc_id, x[2], trees[g][0], root, sha(*[a + b for a, b in own + up]), node, node == root))
    return sorted(out, key=str)


KIND = "doc_id long, source string, lang string, n_chars long, text string"


def many(n, langs=("en", "de", "", None, "é"), seed=5):
    r = random.Random(seed)
    return [(i, r.choice(["web", None, "x" * 50]), langs[0] if r.random() < 0.6 else r.choice(langs), r.choice([None, 0, i]), r.choice([None, "", f"text {i}"])) for i in range(n)]


def test_manifest_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in queries.op11_merkle_manifest(spark, sf_dir).collect()]
    assert sorted(got, key=str) == manifest_rows(rows) and {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("fanout,n", [(2, 333), (3, 500), (5, 64), (2, 1), (2, 2), (4, 17)])
def test_manifest_of_any_fanout_over_unaligned_ranges(spark, fanout, n):
    rows = many(n) + [(7, "s", "en", 1, "t")] * 9 + [(None, "s", "en", 1, "t"), (3, None, None, None, None)]
    out = merkle_manifest.verified(spark.createDataFrame(rows, KIND).withColumn("row", F.lit("x")).withColumn("digest", F.lit(1)), fanout)
    assert sorted((tuple(r) for r in out.collect()), key=str) == manifest_rows(rows, fanout)


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], KIND)
    assert merkle_manifest.verified(empty).count() == 0 and merkle_manifest.manifest(empty).count() == 0


def test_manifest_records_are_the_trees_nodes(spark):
    rows, fanout = many(200), 3
    got = {(r.tree, r.level, r.idx): r.digest for r in merkle_manifest.manifest(spark.createDataFrame(rows, KIND), fanout=fanout).collect()}
    want, roots = {}, []
    for g in sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode())):
        level, nodes = 0, [leaf(*r) for r in rows if r[2] == g]
        while len(nodes) > 1:
            nodes, level = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], level + 1
            want |= {("" if g is None else "=" + g, level, i): d for i, d in enumerate(nodes)}
        roots += nodes
    level = 0
    while len(roots) > 1:
        roots, level = [sha(*roots[i : i + fanout]) for i in range(0, len(roots), fanout)], level + 1
        want |= {("*", level, i): d for i, d in enumerate(roots)}
    assert got == want


def test_stack_over_any_cuts_gives_the_same_root():
    r = random.Random(1)
    for n in (1, 2, 3, 7, 8, 9, 64, 100):
        for fanout in (2, 3, 4):
            leaves = [sha(str(i)) for i in range(n)]
            cuts = sorted({0, n, *(r.randrange(n + 1) for _ in range(4))})
            peaks = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = merkle_manifest.Range(fanout)
                for i in range(a, b):
                    part.push(0, i, leaves[i].encode())
                part.end()
                peaks += part.peaks
            whole = merkle_manifest.Range(fanout)
            for level, index, node in sorted(peaks, key=lambda p: p[1] * fanout ** p[0]):
                whole.push(level, index, node)
            assert whole.close(n).decode() == climbed(leaves, fanout)[0]


# Chosen-path join


def sets(rows):
    out = []
    for i, t in rows:
        w = brute.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append((i, frozenset(" ".join(w[k : k + 2]) for k in range(len(w) - 1)) or frozenset([" ".join(w)] if w else [])))
    return out


def similar(rows, percent=80):
    """(id, set size, component, kept) by comparing all pairs, and the links between different sets."""
    found = sets(rows)
    root = list(range(len(found)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = []
    for a in range(len(found)):
        for b in range(a):
            x, y = found[a][1], found[b][1]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
                if x != y:
                    links.append((a, b))
    least = {}
    for k, (i, _) in enumerate(found):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(found)), links


def edited(r, words, share):
    return " ".join(w if r.random() > share else f"e{r.randrange(10**9)}" for w in words)


def test_chosen_paths_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want, links = similar(rows)
    assert sorted(tuple(r) for r in queries.op12_chosen_paths(spark, sf_dir).collect()) == want and links


def test_chosen_paths_odd_rows(spark):
    got = sorted(tuple(r) for r in chosen_paths.near_duplicates(brute.odd_frame(spark)).collect())
    assert got == similar(brute.ODD)[0]
    assert chosen_paths.near_duplicates(brute.odd_frame(spark).where("false")).count() == 0
    # Repeated rows stay, and ids may be null: a component's id is its least one.
    frame = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "A b c d"), (None, "q r s"), (None, None), (5, None)], "doc_id long, text string")
    out = sorted((tuple(r) for r in chosen_paths.near_duplicates(frame).collect()), key=str)
    assert out == sorted([(4, 3, 4, True), (4, 3, 4, True), (None, 3, 4, False), (None, 2, None, True), (None, 0, None, True), (5, 0, 5, True)], key=str)


def test_chosen_paths_large_nodes_and_chains(spark, monkeypatch):
    """A large group of near copies, whose copies are linked with about half of each other, chains, and pairs just at and below the bound."""
    r = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    texts = [edited(r, base, 0.045) for _ in range(260)]
    chain = [f"c{k}" for k in range(100)]
    for k in range(12):
        texts.append(" ".join(chain[k * 5 :] + [f"n{k}x{j}" for j in range(k * 5)]))
    for k in range(40):
        words = [f"p{k}y{j}" for j in range(181)]
        # 180 shingles; n replaced at the end: (180 - n) / (180 + n) is 0.8 at n = 20.
        texts += [" ".join(words), " ".join(words[: 181 - (20 + k % 2)] + [f"z{k}{j}" for j in range(20 + k % 2)])]
    texts += [" ".join(f"u{i}w{j}" for j in range(50)) for i in range(60)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    want, links = similar(rows)
    monkeypatch.setattr(chosen_paths, "DEALT", 40)
    monkeypatch.setattr(chosen_paths, "SMALL", 30)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in chosen_paths.near_duplicates(frame).collect()) == want and len(links) > 1000


def test_chosen_paths_recall_of_links_at_the_bound(spark):
    """Of 400 pairs at 0.8 to 0.81, the trees and tokens bring all to one cluster."""
    rows = []
    for k in range(400):
        words = [f"p{k}y{j}" for j in range(181)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:161] + [f"z{k}{j}" for j in range(20 - k % 2)]))]
    out = chosen_paths.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("component_id = doc_id - doc_id % 2").count() >= 2 * 400 - 1


@pytest.mark.parametrize("each", [7, 50, 1 << 18])
def test_connected_finds_the_least_node_at_any_number_of_links_in_a_task(spark, each):
    rng = np.random.default_rng(each)
    pairs = {(int(max(p)), int(min(p))) for p in rng.integers(0, 300, (220, 2)).tolist() if p[0] != p[1]} | {(k + 1, k) for k in range(400, 460)}
    root = {n: n for p in pairs for n in p}
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    named = [(b"%03d" % a, b"%03d" % b) for a, b in sorted(pairs) * 2]  # links may repeat
    got = chosen_paths.connected(spark.createDataFrame(named, "a binary, b binary").repartition(5), each).collect()
    assert sorted((int(bytes(r["a"])), int(bytes(r["b"]))) for r in got) == sorted((n, r) for n, r in root.items() if n != r)
    assert chosen_paths.connected(spark.createDataFrame([], "a binary, b binary"), each).count() == 0


def test_joined_is_exact_for_dissimilar_groups(spark, monkeypatch):
    """Groups of many components and few links, far more members than pivots."""
    monkeypatch.setattr(chosen_paths, "DEALT", 20)
    r = random.Random(8)
    rows = []
    for g in range(3):
        pool = [[r.randrange(40) + 1000 * c for _ in range(12)] for c in range(25)]
        for i in range(90):
            v = set(r.choice(pool)) ^ {r.randrange(40) for _ in range(r.randrange(3))}
            rows.append((f"g{g}", f"{g}-{i}", sorted(v)))
    got = chosen_paths.joined(spark.createDataFrame(rows, "g string, id string, v array<long>"), 80).collect()
    by = {i: (g, set(v)) for g, i, v in rows}
    true = [(a, b) for a in by for b in by if a > b and by[a][0] == by[b][0] and 100 * len(by[a][1] & by[b][1]) >= 80 * len(by[a][1] | by[b][1])]

    def parts(links):
        root = {i: i for i in by}
        for _ in range(len(by)):
            before = dict(root)
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                break
        return root

    assert {tuple(x) for x in got} <= set(true) and parts(got) == parts(true) and len(true) > 50


# Centroid clusters


def clustered(rows, k=8, rounds=10, seed=3, size=64):
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    centres = [v for _, v in sorted((hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)][:k]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centres)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == n]
            if mine:
                centres[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = [sum(d for _, c, d in out if c == n) for n in range(len(centres))]
    return sorted(((i, c, d, total[c], sum(total), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in out), key=str)


def test_clusters_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op13_centroid_clusters(spark, sf_dir).collect()), key=str) == clustered(rows)


def test_clusters_odd_vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(20)] + [(3, [0.5] * 64)] * 30 + [(None, [-1.5] * 64), (None, [2.0] * 64)]
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 63 + [None]), (104, [1.0] * 63 + [float("nan")]), (105, [float("inf")] * 64), (106, [1.0] * 65), (None, None)]
    frame = lambda x: spark.createDataFrame([(*v, "v", 1) for v in x], "vec_id long, embedding array<double>, v string, cluster int")
    run = lambda x: sorted((tuple(v) for v in centroid_clusters.cluster(frame(x)).collect()), key=str)
    plain = lambda found: [(a, b, c, int(d), int(e), f) for a, b, c, d, e, f in found]
    assert plain(run(rows + odd)) == clustered(rows + odd)
    assert plain(run(rows[:3])) == clustered(rows[:3]) and run(odd) == [] and run([]) == []
    assert plain(run([(i, [1.0] * 64) for i in range(12)])) == clustered([(i, [1.0] * 64) for i in range(12)])
    assert run([(1, [1e300] * 64)]) == []


def test_screening_measures_less_and_decides_alike():
    g = np.random.default_rng(4)
    centres = g.integers(-3000, 3000, (8, 64))
    v = (centres[g.integers(0, 8, 2000)] * g.choice([1, 1, 1, 0], (2000, 1)) + g.integers(-300, 300, (2000, 64))).astype(np.int32)
    cluster, best, measured = centroid_clusters.nearest(v, centroid_clusters.norms(v), centres)
    every = ((v[:, None, :].astype(np.int64) - centres[None]) ** 2).sum(axis=2)
    assert (every.argmin(axis=1) == cluster).all() and (every.min(axis=1) == best).all() and measured < 0.7 * every.size
