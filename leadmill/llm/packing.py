"""Lexical retrieval packing: documents that share rare tokens go into one window of the training sequence.

1. Texts become token ids in one narrow pass, by a file of ranks (the ids are those that the library `tokenizers` gives by the
   same vocabulary's .json file; tests compare them); each document ends with the id 0. The same pass gives each row its lexical key and counts the
   documents of each term (a token id): a packed row per task, summed over the corpus to at most a row per id of the vocabulary.
   Ids are checkpointed, as 16-bit numbers where the vocabulary allows it.
2. A lexical key is a weighted min-hash of a document's terms: the two that come first in an exponential race, whose rates are the squared
   logarithms of their ranks, since a vocabulary gives rarer terms higher ranks. So documents with the same rare terms, above all near copies,
   get the same key, whatever else is in the corpus.
3. Documents are dealt by ranges of keys with equal numbers of ids; the driver holds two numbers for each range. A task walks its range in order and cuts a shard
   at every SHARD bytes of text, about (half to one and a half of that), so that it holds one shard at a time however long the range is. A key ends with a hash of the
   document's id, and equal keys are parted by the hash of the ids, so a hot group of copies is cut too. A table that fits one shard is one.
4. Each shard holds a BM25 inverted index over its documents, with the whole corpus's counts. A document that doesn't fill its
   window is the seed of a query with all its terms; the unused documents that score best follow it, in order, till the
   window is full. The one that doesn't fit is cut, and what is left of it seeds the next window. Where no unused document
   shares a term, the next unused one in order of ids follows.
5. What is left at a shard's end is cut into sequences whose lengths are powers of two, so that nothing is padded.

Retrieval sees one shard (about SHARD bytes of text): a bound on memory and time per query at every size of the corpus.
Neighbours whose keys differ are missed; README.md has the measured recall.

Cases: a null or empty text is the id 0 alone. A very long text is encoded whole and cut into as many windows as it fills. Null or equal ids and repeated
rows are packed as documents of their own; equal scores go to the document that comes first by id, then by ids of tokens. Only id and text are
read, whatever other columns are called. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm.bpe_codec import read_ranks
from leadmill.llm.common import parts, reliable, text_volume, whole_text
from leadmill.llm.dealing import cuts
from leadmill.llm.pieces import slices

WINDOW, END = 1024, 0
#: Bytes of text in a shard, about.
SHARD = 12 << 20
#: Ranges of keys, a task each: one for each shard up to TASKS, then at most IN_TASK shards each.
TASKS, IN_TASK = 1 << 12, 1 << 8
#: The special token that texts may hold as such, as the vocabulary's library takes it.
SPECIAL = (("<|endoftext|>", 50256),)
#: Terms of a query (None: all, so that none is lost), and documents that one query gives.
QUERY_TERMS, NEIGHBOURS = None, 16
DENSE = 8
#: Bits of a key: two terms, and the hash that cuts groups with equal terms.
TERM_BITS, TAIL_BITS = 18, 27
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def _encoder(ranks: str, special: tuple[tuple[str, int], ...]) -> tuple[Callable[[str], np.ndarray], np.dtype, int]:
    """A worker's encoder, the narrowest type that holds its ids, and one more than the highest of them."""
    import public_tokenizers
    import tiktoken

    known = read_ranks(ranks)
    own = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=dict(special))
    kind = np.dtype("<u2" if own.max_token_value < 1 << 16 else "<u4")
    return lambda text: own.encode_to_numpy(text, allowed_special="all"), kind, own.max_token_value + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers as even 64-bit hashes (splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=2)
def race(size: int) -> np.ndarray:
    """Each id's time in the race: exponential by its hash, with the squared logarithm of its rank as rate."""
    even = (_mixed(np.arange(size)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return -np.log1p(-even) / np.log(np.arange(size) + 2.0) ** 2


def lexical_key(doc: np.ndarray, times: np.ndarray) -> int:
    """The terms that come first and second, as one number."""
    t = times[doc]
    first = int(doc[t.argmin()])
    rest = doc[doc != first]
    second = int(rest[times[rest].argmin()]) if len(rest) else first
    return first << TERM_BITS | second


def encoded(docs: DataFrame, ranks: str, special: tuple[tuple[str, int], ...], id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids (with the end id, in the narrowest unsigned type that holds the vocabulary), key; and a row per task with key -1, whose ids
    are the number of its documents, of their ids, and of documents with each id."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(f"`{text_col}`").alias("t"))
    names = ["doc_id", "ids", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind, size = _encoder(ranks, special)
        end, times, counts = np.array([END], kind), race(size), np.zeros(size + 2, np.int64)
        for batch in batches:
            for part, texts in slices(batch, "t"):
                ids = [np.concatenate([encode(t).astype(kind), end]) for t in texts]
                tail = _mixed(np.array([i or 0 for i in part.column("doc_id").to_pylist()], np.int64)) >> np.uint64(64 - TAIL_BITS)
                key = [lexical_key(doc, times) << TAIL_BITS | low for doc, low in zip(ids, tail.tolist(), strict=True)]
                for doc in ids:
                    counts[:2] += (1, len(doc))
                    counts[2 + np.unique(doc).astype(np.int64)] += 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([doc.tobytes() for doc in ids], pa.binary()), pa.array(key, pa.int64())], names)
        if counts[0]:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([counts.tobytes()], pa.binary()), pa.array([-1], pa.int64())], names)

    return rows.mapInArrow(run, "doc_id long, ids binary, key long")


class Corpus(NamedTuple):
    """Documents of each term, documents, and mean length, all of the whole corpus."""

    in_docs: np.ndarray
    n: int
    mean: float

    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.in_docs + 0.5) / (self.in_docs + 0.5))


def counted(rows: DataFrame) -> Corpus:
    """What the counting rows of `encoded` sum up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("ids"):
                counts = np.frombuffer(x.as_buffer(), np.int64)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["term", "n"])

    got = {r["term"]: r["n"] for r in rows.where("key = -1").select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, tokens = got.pop(0, 0), got.pop(1, 0)
    in_docs = np.zeros(max(got, default=1) - 1, np.int64)
    in_docs[np.array(list(got), np.int64) - 2] = list(got.values())
    return Corpus(in_docs, n, tokens / max(n, 1))


class Index:
    """BM25 over documents that are arrays of terms: postings by term, and each document's own terms."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        n = len(docs)
        size = np.fromiter(map(len, docs), np.int64, n)
        key = np.repeat(np.arange(n, dtype=np.int64), size) << 32 | np.concatenate(docs).astype(np.int64)
        key.sort()
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[head, len(key)])
        key = key[head]
        doc, term = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int64)
        in_docs = np.bincount(term)
        corpus = corpus or Corpus(in_docs, n, size.mean())
        weight = (corpus.idf()[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * size[doc] / corpus.mean))).astype(np.float32)
        # A document's own terms, heaviest first; terms of one document find nothing.
        shared = in_docs[term] > 1
        own_doc, own_term, own_weight = doc[shared], term[shared], weight[shared]
        order = np.lexsort((own_term, -own_weight, own_doc))
        self.own = own_term[order]
        self.own_first = np.searchsorted(own_doc[order], np.arange(n + 1))
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.r_[0, np.cumsum(in_docs)]
        self.n = n
        # Terms of many documents as rows of a dense matrix, whose sums are faster: at most DENSE numbers for each posting.
        hot = np.flatnonzero(in_docs * DENSE > n)
        self.row = np.full(len(in_docs), -1, np.int64)
        self.row[hot] = np.arange(len(hot))
        self.dense = np.zeros((len(hot), n), np.float32)
        at = self.row[term] >= 0
        self.dense[self.row[term[at]], doc[at]] = weight[at]
        self.live = np.arange(n)

    def keep(self, unused: np.ndarray) -> None:
        """Forgets the postings of used documents, which no later query can find."""
        stay = unused[self.live]
        number = np.cumsum(stay, dtype=np.int32) - 1
        at = stay[self.doc]
        self.first = np.r_[0, np.cumsum(at)][self.first]
        self.doc, self.weight = number[self.doc[at]], self.weight[at]
        self.dense = np.ascontiguousarray(self.dense[:, stay])
        self.live, self.n = self.live[stay], int(stay.sum())

    def neighbours(self, seed: int, unused: np.ndarray, terms: int | None = QUERY_TERMS, most: int = NEIGHBOURS) -> list[int]:
        """Unused documents with the highest scores for the seed's terms (the `terms` heaviest), best first; ties by number."""
        query = self.own[self.own_first[seed] : self.own_first[seed + 1]][:terms]
        if not len(query) or not self.n:
            return []
        hot = self.row[query]
        rare = query[hot < 0]
        begin, count = self.first[rare], self.first[rare + 1] - self.first[rare]
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())  # the places of all postings of these terms
        doc = self.doc[at]
        score = np.bincount(doc, self.weight[at], self.n)
        score = (score + self.dense[hot[hot >= 0]].sum(axis=0)) * unused[self.live]
        if len(doc) < 4 * most and (hot < 0).all():
            best = np.unique(doc)
        else:
            best = np.argpartition(-score, min(most, self.n - 1))[:most]
        best = best[np.lexsort((best, -score[best]))][:most]
        return self.live[best[score[best] > 0]].tolist()


def pack(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None, terms: int | None = QUERY_TERMS) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. docs: each one's ids, in order."""
    n = len(docs)
    size = np.fromiter(map(len, docs), np.int64, n)
    left = int(size.sum())
    index, unused, following = Index(docs, corpus), np.ones(n, bool), 0
    sequence = offset = 0
    room = _room(left, window)
    doc, start, ranked = -1, 0, []
    while left:
        if doc < 0 or start == size[doc]:
            if doc >= 0 and offset:
                if not ranked:
                    if unused.sum() < 0.8 * index.n:
                        index.keep(unused)
                    ranked = [d for d in index.neighbours(seed, unused, terms) if unused[d]][::-1]
                while ranked and not unused[ranked[-1]]:
                    ranked.pop()
            if doc >= 0 and offset and ranked:
                doc = ranked.pop()
            else:
                while not unused[following]:
                    following += 1
                doc = following
            start, unused[doc] = 0, False
        if not offset:
            seed, ranked = doc, []
        length = int(min(size[doc] - start, room - offset))
        yield doc, int(start), length, sequence, offset
        start, offset, left = start + length, offset + length, left - length
        if offset == room:
            sequence, offset, room = sequence + 1, 0, _room(left, window)


def _room(left: int, window: int) -> int:
    return window if left >= window else 1 << (left.bit_length() - 1) if left else 0


def packed(
    docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_bytes: int = SHARD, special: tuple[tuple[str, int], ...] = SPECIAL, terms: int | None = QUERY_TERMS
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. terms: a query's heaviest ones, None for all."""
    shards = parts(text_volume(docs, text_col)[1], shard_bytes)
    both = reliable(encoded(docs, ranks, special, id_col, text_col))
    corpus, rows = counted(both), both.where("key >= 0")
    tokens = round(corpus.n * corpus.mean)
    each = max(1, tokens // shards)
    ranges = max(min(shards, TASKS), parts(shards, IN_TASK))
    width, h = _encoder(ranks, special)[1].itemsize, F.xxhash64("ids")
    cut = cuts(rows.select(F.col("key").alias("id"), h.alias("h"), F.octet_length("ids").cast("long").alias("n")), ranges, max(1, tokens * width // ranges))
    n = cut.n
    ranged = rows.select(cut.batch(F.col("key"), h).alias("range"), "key", h.alias("h"), "doc_id", "ids").repartitionById(n, "range").sortWithinPartitions("key", "h", "doc_id").select("range", "doc_id", "ids")

    def shard(table: pa.Table, done: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of one shard, whose sequences are numbered from `done` on, and the next number."""
        kind = _encoder(ranks, special)[1]
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(x.as_buffer(), kind) for x in table.column("ids")]
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pack(ids, window, corpus, terms), strict=True))
        crc = [zlib.crc32(ids[d][a : a + k].astype("<u4").tobytes()) for d, a, k in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
        tokens = np.fromiter(map(len, ids), np.int64, len(ids))[doc]
        number = (sequence + done) * n + table.column("range")[0].as_py()
        columns = {"start": start, "length": length, "ids_crc32": np.array(crc, np.int64), "doc_tokens": tokens, "sequence_id": number, "offset": offset}
        out = pa.table({"doc_id": table.column("doc_id").take(pa.array(doc)), **{k: pa.array(v) for k, v in columns.items()}})
        return out.combine_chunks().to_batches()[0], done + int(sequence[-1]) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = [], 0
        for batch in batches:
            held.append(batch)
            while sum(pc.sum(pc.binary_length(b.column("ids"))).as_py() or 0 for b in held) >= 1.5 * each * width:
                table = pa.Table.from_batches(held)
                ends = np.cumsum(pc.binary_length(table.column("ids")).to_numpy().astype(np.int64))
                first = int(np.searchsorted(ends, each * width)) + 1
                out, done = shard(table.slice(0, first), done)
                yield out
                held = table.slice(first).to_batches()
        if sum(b.num_rows for b in held):
            yield shard(pa.Table.from_batches(held), done)[0]

    return ranged.mapInArrow(run, SCHEMA)
