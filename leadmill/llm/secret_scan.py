"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its surroundings.

1. Candidates are all runs of LEAST or more token characters, words too; the parts of a run between `:`, `=` and `@`, so that a key beside another one or a
   password within an address is a candidate of its own; and what is assigned to any name (after `:` or `=`), from VALUE characters on. A dot, comma or
   colon at a candidate's end isn't part of it. Each is read with its surroundings, one longer than INSIDE in
   windows that overlap by half, of which the highest score counts. Candidates that base patterns match are scored like any other.
2. The network is trained in numpy on labelled findings that are made, not on what the base patterns say: SAMPLE secrets of many
   forms (label 1: hexadecimal, base 62 and 64, vendors' prefixes, signed tokens, passwords, phrases; under many names, within addresses, or
   bare) and SAMPLE things that are none (label 0: words of the texts, card and phone numbers, mail addresses, numbers, dates, versions, paths, names,
   UUIDs, placeholders). They stand between pieces of the table's own texts, and their words are the table's: SNIPPETS pieces of PIECE_SIZE characters, those with
   the least hash of id and text. An empty table gives none, and fixed words stand for them. Candidates of these pieces that have no digit are taken for words, label 0;
   MINED of them that the network takes most for secrets are added to the findings each time, and the fit goes on, MINING times.
3. A quarter of the findings of each label is held out. On these, scores are calibrated by a logistic fit, and the thresholds are the highest at which
   at least RECALL of the secrets and EACH_FORM of each form are found, one for short assigned values, one for other short candidates, and one for long ones. A
   finding's score is the best of the candidates that the scan itself proposes in its text and that cover most of it: what isn't proposed isn't found.
4. One narrow pass over whole texts finds base matches and scores candidates. Those from the threshold up become spans of kind
   `net`; of spans within each other the inner ones stand.

Cases: a null or empty text has no spans. A very long text or run is read to its end, PIECE windows at a time. Ties: spans that start
together are in the order of KINDS, then of their ends; equal scores are equally in or out. Null or equal ids and repeated rows are
rows of their own, each with its own spans. An empty table gives none. Columns of the input may have any names: `scan` returns its own,
`redact` packs them. Spans count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill.llm.common import whole_text
from leadmill.llm.pieces import slices
from leadmill.llm.planted_secrets import FALLBACK, Finding, findings

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "net")
MARK = "[SECRET]"

LEAST, VALUE, LONG = 8, 4, 20
_RUN = re.compile(rf"[A-Za-z0-9+/_.=@:!#$%&*?~^-]{{{LEAST},}}")
_PART = re.compile("(?:[^:=@]|=+$|=(?==+$))+")
_ASSIGNED = re.compile(rf"""[\w)\]]["'`]?[ \t]*(?::=|=>|[:=])[ \t]*["'`]?([^\s"'`,;<>()\[\]{{}}|\\:=]{{{VALUE},}}=*)""")
_END = ".:,"
_DIGIT = re.compile("[0-9]")
BEFORE, INSIDE, AFTER = 16, 40, 8
WIDTH = BEFORE + INSIDE + AFTER
#: Training: findings of each label, pieces of the table's texts and their characters, held-out share, and recall that the thresholds keep, of all secrets and of each form.
SAMPLE, SNIPPETS, PIECE_SIZE, HELD_OUT, RECALL, EACH_FORM = 4000, 4000, 512, 4, 0.98, 0.9
MINED, MINING, FEW = 4000, 3, 20
EMBED, TAPS, FILTERS, EPOCHS, MORE, STEP, RATE = 8, 5, 24, 8, 3, 128, 0.005
#: Windows that are scored at once; bounds a task's memory.
PIECE = 1 << 13

_SPAN = "struct<kind:string,start:int,end:int,value:int>"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: int  # where the secret itself begins


def base_spans(text: str) -> list[Span]:
    found = [Span("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    found += [Span("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [Span("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


class Candidate(NamedTuple):
    start: int
    end: int
    kind: int  # 0: a short assigned value, 1: another short one, 2: a long one


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text by their start, outer ones first."""
    found, assigned = set(), set()
    for m in _RUN.finditer(text):
        a, run = m.start(), m[0].rstrip(_END)
        if len(run) >= LEAST:
            found.add((a, a + len(run)))
        if ":" in run or "=" in run or "@" in run:
            found.update((a + x.start(), a + x.end()) for x in _PART.finditer(run) if LEAST <= x.end() - x.start())
    if ":" in text or "=" in text:
        for m in _ASSIGNED.finditer(text):
            size = len(m[1].rstrip(_END))
            if size >= VALUE:
                assigned.add((m.start(1), m.start(1) + size))
    return [Candidate(a, b, 2 if b - a >= LONG else 0 if (a, b) in assigned else 1) for a, b in sorted(found | assigned, key=lambda x: (x[0], -x[1]))]


def windows(text: str, a: int, b: int) -> Iterator[str]:
    """INSIDE characters of a to b with those around, `\1` where there is none; overlapping by half, to the end."""
    last = max(a, b - INSIDE)
    for c in [*range(a, last, INSIDE // 2), last]:
        d = min(c + INSIDE, b)
        yield text[max(0, c - BEFORE) : c].rjust(BEFORE, "\1") + text[c:d].ljust(INSIDE, "\1") + text[d : d + AFTER].ljust(AFTER, "\1")


# The network: embedding, one convolution, maximum and mean over places, logistic output.


def _codes(windows: list[str]) -> np.ndarray:
    """Characters as numbers below 128; all that aren't ASCII are 2."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(windows), WIDTH)
    return np.where(raw < 128, raw, 2).astype(np.int64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Net:
    """Parameters in float32; `scores` gives logits."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (128, EMBED)).astype(np.float32),
            "w": rng.normal(0, 1 / np.sqrt(TAPS * (EMBED + 1)), (TAPS * (EMBED + 1), FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "v": rng.normal(0, 0.3, 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.a, self.shift = 1.0, 0.0  # calibration: probability = sigmoid(a * logit + shift)
        self.thresholds = (0.5, 0.5, 0.5)  # of each kind of candidate

    def _columns(self, x: np.ndarray) -> np.ndarray:
        inside = np.zeros((WIDTH, 1), np.float32)
        inside[BEFORE : BEFORE + INSIDE] = 1
        e = np.concatenate([self.p["e"][x], np.broadcast_to(inside, (len(x), WIDTH, 1))], axis=2)
        view = np.lib.stride_tricks.sliding_window_view(e, TAPS, axis=1)  # n, places, channels, taps
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), WIDTH - TAPS + 1, -1)

    def forward(self, x: np.ndarray) -> tuple:
        col = self._columns(x)
        h = np.maximum(col @ self.p["w"] + self.p["b"], 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None, :], 1)[:, 0], h.mean(axis=1)], axis=1)
        return col, h, top, pooled, pooled @ self.p["v"] + self.p["c"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        """The output of `forward`, by tables: a convolution over embedded characters is a sum of TAPS rows, one for each character and tap."""
        w, places = self.p["w"].reshape(TAPS, EMBED + 1, FILTERS), WIDTH - TAPS + 1
        table = self.p["e"] @ w[:, :EMBED]  # tap, character, filter
        inside = np.zeros(WIDTH, np.float32)
        inside[BEFORE : BEFORE + INSIDE] = 1
        bias = self.p["b"] + sum(inside[t : t + places, None] * w[t, EMBED] for t in range(TAPS))
        out = [np.empty(0, np.float32)]
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            h = np.repeat(bias[None].astype(np.float32), len(part), axis=0)
            for t in range(TAPS):
                h += table[t][part[:, t : t + places]]
            np.maximum(h, 0, out=h)
            out.append(np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1) @ self.p["v"] + self.p["c"])
        return np.concatenate(out)

    def best(self, texts: Iterable[str], spans: Iterable[tuple[int, int]]) -> np.ndarray:
        """The highest logit of the windows of each span of its text."""
        found, held, of, n = [], [], [], 0

        def flush() -> None:
            if held:
                z, first = self.logits(_codes(held)), np.flatnonzero(np.r_[True, np.diff(of) > 0])
                for k, top in zip(np.array(of)[first].tolist(), np.maximum.reduceat(z, first).tolist(), strict=True):
                    found[k] = max(found[k], top)
                held.clear()
                of.clear()

        for text, (a, b) in zip(texts, spans, strict=True):
            found.append(-np.inf)
            for w in windows(text, a, b):
                held.append(w)
                of.append(n)
                if len(held) == PIECE:
                    flush()
            n += 1
        flush()
        return np.array(found)

    def good(self, texts: list[str], found: list[Candidate]) -> np.ndarray:
        """Whether each candidate's probability reaches the threshold of its kind."""
        p = _sigmoid(self.a * self.best(texts, [(c.start, c.end) for c in found]) + self.shift)
        return p >= np.array(self.thresholds)[[c.kind for c in found]]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        col, h, top, pooled, z = self.forward(x)
        dz = (_sigmoid(z) - y).astype(np.float32) / len(y)
        dp = dz[:, None] * self.p["v"]
        dh = np.repeat(dp[:, None, FILTERS:] / h.shape[1], h.shape[1], axis=1)
        np.put_along_axis(dh, top[:, None, :], np.take_along_axis(dh, top[:, None, :], 1) + dp[:, None, :FILTERS], 1)
        dh *= h > 0
        dcol = (dh @ self.p["w"].T).reshape(len(x), -1, TAPS, EMBED + 1)
        de = np.zeros((len(x), WIDTH, EMBED), np.float32)
        for t in range(TAPS):
            de[:, t : t + dcol.shape[1]] += dcol[:, :, t, :EMBED]
        table = np.zeros_like(self.p["e"])
        np.add.at(table, x, de)
        return {"e": table, "w": np.tensordot(col, dh, ((0, 1), (0, 1))), "b": dh.sum(axis=(0, 1)), "v": pooled.T @ dz, "c": dz.sum(keepdims=True)}

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        n = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), STEP):
                own = order[i : i + STEP]
                xb = x[own]
                n += 1
                for k, g in self.gradients(xb, y[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= RATE * (m[k] / (1 - 0.9**n)) / (np.sqrt(s[k] / (1 - 0.999**n)) + 1e-8)

    def calibrate(self, z: np.ndarray, y: np.ndarray, kind: np.ndarray, form: np.ndarray | None = None, recall: float = RECALL) -> None:
        """Slope and shift by the logits z of held-out candidates with labels y, and the threshold of each kind; 0.5 for one without secrets.

        A threshold finds `recall` of its kind's secrets and EACH_FORM of those of each form that has FEW of them or more.
        """
        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps of a logistic fit with a weak prior for a = 1
            p = _sigmoid(a * z + b)
            w = p * (1 - p)
            g = np.array([((p - y) * z).sum() + 0.1 * (a - 1), (p - y).sum() + 0.1 * b])
            h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
            step = np.linalg.solve(h, g)
            a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
        self.a, self.shift = max(float(a), 1e-3), float(b)
        p = _sigmoid(self.a * z + self.shift)
        point = lambda x, share: float(np.sort(x)[int((1 - share) * len(x) + 1e-9)]) if len(x) else 0.5
        form = np.zeros(len(y)) if form is None else form

        def threshold(mine: np.ndarray) -> float:
            return min([point(p[mine], recall), *(point(p[mine & (form == f)], EACH_FORM) for f in np.unique(form[mine]) if (mine & (form == f)).sum() >= FEW)])

        self.thresholds = tuple(threshold((y == 1) & (kind == k)) for k in range(3))


def snippets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SNIPPETS) -> list[str]:
    """A piece of each of the n texts with the least hash of id and text. Only hashes below 4 n / rows are sorted, about 4 n."""
    h, size = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")), PIECE_SIZE
    at = F.pmod("h", F.greatest(F.char_length("t") - size, F.lit(1))).cast("int") + 1
    below = min((1 << 63) - 1, -(1 << 63) + (1 << 66) * n // max(1, docs.count()))
    rows = docs.select(h.alias("h"), F.col(f"`{text_col}`").alias("t")).where((F.col("t") != "") & (F.col("h") <= below)).select("h", F.substring("t", at, F.lit(size)).alias("s"))
    return [r["s"] for r in rows.orderBy("h", "s").limit(n).collect()]


def proposed(f: Finding) -> list[Candidate]:
    """The candidates in a finding's text that cover most of it, and not much else."""
    size = f.end - f.start
    covered = lambda c: min(c.end, f.end) - max(c.start, f.start)
    return [c for c in candidates(f.text) if covered(c) >= 0.75 * size and covered(c) >= 0.5 * (c.end - c.start)]


def words_of(text: str) -> list[Candidate]:
    """Candidates without a digit, where no base pattern matches: words, as good as all of them."""
    base = base_spans(text)
    return [c for c in candidates(text) if not _DIGIT.search(text, c.start, c.end) and all(c.end <= s.start or c.start >= s.end for s in base)]


def train(pieces: list[str], sample: int = SAMPLE, left_out: tuple[str, ...] = ()) -> Net:
    """A network fitted to made findings among `pieces` of texts, calibrated on a held-out quarter of them; without secrets of the forms left out."""
    made = findings(pieces or FALLBACK, sample, left_out=left_out)
    held = np.arange(len(made)) // 4 % HELD_OUT == 0  # four in a row: both labels, short and long
    net = Net()
    each = [(w, f.label) for f, h in zip(made, held, strict=True) if not h for c in proposed(f) for w in windows(f.text, c.start, c.end)]
    x, y = _codes([w for w, _ in each]), np.array([y for _, y in each], np.float32)
    net.fit(x, y)
    words = _codes([w for t in pieces for c in words_of(t) for w in windows(t, c.start, c.end)] or [" " * WIDTH])
    for k in range(MINING):
        hard = words[np.argsort(net.logits(words), kind="stable")[-MINED:]]
        x, y = np.concatenate([x, hard]), np.concatenate([y, np.zeros(len(hard), np.float32)])
        net.fit(x, y, MORE, seed=7 + k)
    rest = [(f, c) for f, h in zip(made, held, strict=True) if h for c in proposed(f)[-1:] or [Candidate(f.start, f.start, 2 if f.end - f.start >= LONG else 1)]]
    z = net.best([f.text for f, _ in rest], [(c.start, c.end) for _, c in rest])
    z[[c.start == c.end for _, c in rest]] = -30  # not proposed
    net.calibrate(z, np.array([f.label for f, _ in rest]), np.array([c.kind for _, c in rest]), np.array([f.form for f, _ in rest]))
    return net


def net_spans(net: Net, texts: list[str]) -> list[list[Span]]:
    """For each text the candidates that the network takes for secrets, without those that hold another one."""
    each = [candidates(t) for t in texts]
    flat = [(t, c) for t, found in zip(texts, each, strict=True) for c in found]
    good = net.good([t for t, _ in flat], [c for _, c in flat]) if flat else np.empty(0, bool)
    out, at = [], 0
    for found in each:
        own = [c for c, g in zip(found, good[at : at + len(found)].tolist(), strict=True) if g]
        at += len(found)
        # In this order what a candidate holds follows it.
        out.append([Span("net", c.start, c.end, c.start) for c, d in zip(own, [*own[1:], None], strict=False) if d is None or d.start >= c.end or d.end > c.end])
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, base, spans: the base spans, and all with those that the network adds, in order: a row per row."""
    net = train(snippets(docs, id_col, text_col), sample)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("t"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "t"):
                base = [base_spans(t) for t in texts]
                every = [in_order(b + n) for b, n in zip(base, net_spans(net, texts), strict=True)]
                columns = [pa.array([[s._asdict() for s in x] for x in c], kind) for c in (base, every)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "base", "spans"])

    return rows.mapInArrow(run, f"doc_id long, base array<{_SPAN}>, spans array<{_SPAN}>")


def hide(text: str, spans: list[Span]) -> str:
    """The text with each secret (for an assignment its value) replaced by a mark; overlapping ones by one mark."""
    out, at = [], 0
    for a, b in sorted((s.value, s.end) for s in spans):
        if a >= at:
            out += [text[at:a], MARK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """`docs` with secrets replaced; length_col, if named, gets the new text's characters where the text changed."""
    net = train(snippets(docs, id_col, text_col), sample)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("t"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("t", T.StringType()), T.StructField("changed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, "t"):
                spans = [base_spans(t) + n for t, n in zip(texts, net_spans(net, texts), strict=True)]
                old = part.column("t").to_pylist()
                new = pa.array([hide(t, s) if s else t for t, s in zip(old, spans, strict=True)], part.column("t").type)
                same = pc.fill_null(pc.equal(new, part.column("t")), True)
                yield pa.RecordBatch.from_arrays([part.column("row"), new, pc.invert(same)], ["row", "t", "changed"])

    out = rows.mapInArrow(run, schema)
    put = {text_col: F.col("t")}
    if length_col:
        put[length_col] = F.when(F.col("changed"), F.char_length("t").cast(docs.schema[length_col].dataType)).otherwise(F.col("row")[length_col])
    return out.select(*[(put[c] if c in put else F.col("row")[c]).alias(c) for c in docs.columns])
