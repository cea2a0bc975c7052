"""Plain single-process versions of the contracts, and awkward documents."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")

ODD = [
    (1, "the quick brown fox " * 9 + "Jumps é über\tthe\x0blazy dog\n\n"),
    (2, None),
    (3, ""),
    (4, " \t\r\n"),
    (5, "the quick brown fox " * 9 + "jumps é über the lazy dog"),
    (6, "one two"),
    (7, "x" * 5000 + " " + "ab " * 3000),
    (8, " ".join(f"w{i}" for i in range(60))),
    (9, "before " + " ".join(f"w{i}" for i in range(5, 45)) + " after"),
    (10, " ".join(f"w{i}" for i in range(60))),
    (11, "a b c 𝒳 # * $ % & | < >\nsame line\nsame line\n\n\n"),
    (12, "One two"),
]


def odd_frame(spark, rows=ODD):
    """Rows with an extra column that has the name of a result, and other names that operators might use."""
    return spark.createDataFrame([(i, t, "l", float(i), "b") for i, t in rows], "doc_id long, text string, n_words string, score double, row string")


def words(text):
    return WORD.findall(text or "")


def removed(rows, window=20):
    first, out = {}, {}
    for i, t in sorted(rows):
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if first.setdefault(k, (i, s)) != (i, s):
                gone.update(range(s, s + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows, radius=2):
    fp = {i: fingerprint(t) for i, t in rows}
    distinct = sorted(set(fp.values()))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(distinct):
        for y in distinct[:a]:
            if (x ^ y).bit_count() <= radius:
                root[find(x)] = find(y)
    least = {}
    for i, x in fp.items():
        least[find(x)] = min(i, least.get(find(x), i))
    return {i: (f"{x:016x}", least[find(x)]) for i, x in fp.items()}


def rules(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    inside = {k for i, g in enumerate(grams) if count[g] > 1 for k in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w))
