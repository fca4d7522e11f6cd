"""Byte-level BPE encoding and decoding by two tiers: a minimal perfect hash over the vocabulary, and merges on a heap.

A text is cut into pre-tokens by the tokenizer's pattern. Tier one: the vocabulary's byte strings are hashed without
collision onto 0 .. n-1 (buckets, each with the displacement that sends its keys to free places; buckets of one key name
the place itself), so a pre-token is in the vocabulary if the string stored at its place is its own. Tier two, for the
others: the bytes are linked parts, the pairs of neighbours wait on a heap by rank and place, and the cheapest pair is
joined until none is in the vocabulary. The rank of a joined pair comes from the same hash.

The hash is built once on the driver and broadcast; its size is that of the vocabulary, which is checked (VOCABULARY_MOST).
A worker process keeps what it found for distinct pre-tokens in a table, from task to task of one query. The table has
two halves of `table_size` entries: when the newer one is full it becomes the older one, whose entries were dropped, and
what is met again moves on to the newer one. That bounds memory and changes no result; longer pre-tokens than LONG
characters aren't kept. There is no shuffle, so no hot word or source; texts are taken whole.

Cases: null text counts as empty; an empty text has no ids and decodes to nothing; repeated rows each get their row; an
empty table gives an empty result; other columns of the input are not looked at. A rank file that lacks a single byte
raises where it is read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .sentencepiece_codec import model_file

TABLE_SIZE, PAIRS_SIZE, LONG = 300_000, 1_000_000, 256
DOCS_AT_ONCE = 64
VOCABULARY_MOST = 4_000_000
#: Keys of a bucket on average; displacements tried at once.
BUCKET, TRIES = 4, 64
_SEED = 42
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_ALL = (1 << 64) - 1


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    ranks = {}
    with open(model_file(path), "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if len(ranks) > VOCABULARY_MOST:
        raise ValueError("a vocabulary of this size can't be sent to the tasks")
    if sorted(ranks) != list(range(len(ranks))) or len(set(ranks.values())) != len(ranks):
        raise ValueError("ranks have to run from 0 without a gap, each with a string of its own")
    tokens = [ranks[i] for i in range(len(ranks))]
    if len({t for t in tokens if len(t) == 1}) < 256:
        raise ValueError("a single byte has no rank: there are texts that can't be encoded")
    return tokens


def _hashes(keys: Iterable[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k, _SEED) for k in keys], np.uint64)


def _places(h: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    x = h ^ (displacement.astype(np.uint64) * _STEP)
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return ((x ^ (x >> np.uint64(27))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct keys: key -> its number in the list, -1 for what is no key."""

    def __init__(self, keys: list[bytes]):
        n, h = len(keys), _hashes(keys)
        if len(np.unique(h)) < n:
            raise ValueError("equal hashes in the vocabulary")
        self.n, self.buckets = n, max(1, n // BUCKET)
        bucket = self.bucket_of(h)
        by_bucket = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        #: a displacement, or -1 - place for a bucket of one key
        self.shift = np.zeros(self.buckets, np.int64)
        self.number = np.full(n, -1, np.int64)
        free, at = np.ones(n, bool), 0
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = by_bucket[starts[b] : starts[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                while not free[at]:
                    at += 1
                self.shift[b], place = -1 - at, np.array([at])
            else:
                self.shift[b], place = self._fit(h[own], free)
            free[place] = False
            self.number[place] = own
        self.keys = [keys[i] for i in self.number.tolist()]
        self.shifts, self.numbers = self.shift.tolist(), self.number.tolist()  # for single keys

    def _fit(self, h: np.ndarray, free: np.ndarray) -> tuple[int, np.ndarray]:
        """The first displacement that sends the keys of a bucket to different free places."""
        d = 0
        while True:
            tried = np.arange(d, d + TRIES)
            places = np.sort(_places(h[None, :], tried[:, None], self.n), axis=1)
            good = free[places].all(axis=1) & (places[:, 1:] != places[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                return d + k, _places(h, np.full(len(h), d + k), self.n)
            d += TRIES

    def bucket_of(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        if not keys:
            return []
        h = _hashes(keys)
        shift = self.shift[self.bucket_of(h)]
        place = np.where(shift < 0, -1 - shift, _places(h, np.maximum(shift, 0), self.n))
        return [number if stored == k else -1 for k, stored, number in zip(keys, map(self.keys.__getitem__, place.tolist()), self.number[place].tolist(), strict=True)]


    def find_one(self, key: bytes) -> int:
        """find() of one key, in plain numbers."""
        h = xxhash.xxh64_intdigest(key, _SEED)
        place = self.shifts[(h >> 32) % self.buckets]
        if place < 0:
            place = -1 - place
        else:
            x = h ^ (place * int(_STEP) & _ALL)
            x = (x ^ x >> 30) * int(_MIX) & _ALL
            place = (x ^ x >> 27) % self.n
        return self.numbers[place] if self.keys[place] == key else -1


class Ranks(dict):
    """(id, id) -> the id of the two joined, or -1: looked up in the vocabulary's hash when first asked for, forgotten when there are many."""

    def __init__(self, tokens: PerfectHash, vocabulary: list[bytes]):
        super().__init__()
        self.tokens, self.vocabulary = tokens, vocabulary

    def __missing__(self, pair: tuple[int, int]) -> int:
        if len(self) >= PAIRS_SIZE:
            self.clear()
        found = self[pair] = self.tokens.find_one(self.vocabulary[pair[0]] + self.vocabulary[pair[1]])
        return found


def merged(ids: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Tier two: the pair of neighbours with the lowest rank, the first of equals, is joined until there is none.

    ids: those of the single bytes, which are overwritten. ranks gives the id of two joined parts, or -1. An entry of the
    heap (rank and place in one number) that a join has overtaken is told by the rank of what stands there now.
    """
    n = len(ids)
    after, before, shift = list(range(1, n + 1)), list(range(-1, n - 1)), 10 if n < 1024 else n.bit_length()
    place, now = (1 << shift) - 1, list(map(ranks.__getitem__, zip(ids, ids[1:])))  # noqa: B905
    heap = [r << shift | i for i, r in enumerate(now) if r >= 0]
    now.append(-1)
    heapify(heap)
    while heap:
        x = heappop(heap)
        r, i = x >> shift, x & place
        if now[i] != r:
            continue
        j = after[i]
        ids[i], ids[j], now[j] = r, -1, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            q = now[i] = ranks[r, ids[k]]
            if q >= 0:
                heappush(heap, q << shift | i)
        else:
            now[i] = -1
        k = before[i]
        if k >= 0:
            q = now[k] = ranks[ids[k], r]
            if q >= 0:
                heappush(heap, q << shift | k)
    return [x for x in ids if x >= 0]


class PreTokenTable:
    """pre-token -> (number of ids, ids joined by one space, decoded bytes).

    `table` has the newest, `older` those before them: one is used again only by way of `table`, so what stays is what is met often.
    """

    def __init__(self, tokens: PerfectHash, vocabulary: list[bytes], pattern: str, table_size: int = TABLE_SIZE):
        self.hash, self.vocabulary, self.table_size = tokens, vocabulary, table_size
        self.find_all = regex.compile(pattern).findall
        self.single = tokens.find([bytes([b]) for b in range(256)])
        self.names = list(map(str, range(len(vocabulary))))
        self.table: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.ranks = Ranks(tokens, vocabulary)

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        single = self.single.__getitem__
        return [[x] if x >= 0 else merged(list(map(single, p)), self.ranks) for p, x in zip(pieces, self.hash.find(pieces), strict=True)]

    def learn(self, pieces: set[str]) -> Callable[[str], tuple[int, str, bytes]]:
        """What gives the row of each of the pieces, kept or not."""
        new = pieces.difference(self.table)
        if len(self.table) + len(new) > self.table_size:
            self.older, self.table, new = self.table, {}, pieces
        if self.older:
            self.table.update((p, self.older[p]) for p in new if p in self.older)
            new = new.difference(self.older)
        new = list(new)
        own, name, part = {}, self.names.__getitem__, self.vocabulary.__getitem__
        for p, x in zip(new, self.ids_of([p.encode() for p in new]), strict=True):
            row = (len(x), " ".join(map(name, x)), b"".join(map(part, x)))
            (self.table if len(p) <= LONG else own)[p] = row
        return (lambda p: own[p] if p in own else self.table[p]) if own else self.table.__getitem__

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """(number of ids, ids joined by one space, decoded bytes) of each text."""
        for at in range(0, len(texts), DOCS_AT_ONCE):
            cut = [self.find_all(t) for t in texts[at : at + DOCS_AT_ONCE]]
            get = self.learn(set().union(*cut))
            for pieces in cut:
                if pieces:
                    n, ids, decoded = zip(*map(get, pieces), strict=True)
                    yield sum(n), " ".join(ids), b"".join(decoded)
                else:
                    yield 0, "", b""


@lru_cache(maxsize=4)
def _built(path: str) -> tuple[PerfectHash, list[bytes]]:
    tokens = read_ranks(path)
    return PerfectHash(tokens), tokens


def _batches(docs: DataFrame, ranks: str, pattern: str, table_size: int, digest: bool):
    # of the vocabulary's size, which is checked; the list is filled by each worker process, which keeps it as long as the broadcast
    shared = docs.sparkSession.sparkContext.broadcast((*_built(ranks), []))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, vocabulary, kept = shared.value
        if not kept:
            kept.append(PreTokenTable(tokens, vocabulary, pattern, table_size))
        table = kept[0]
        for b in batches:
            texts = b.column(1)
            for k in range(0, b.num_rows, DOCS_AT_ONCE):
                part = [t or "" for t in texts.slice(k, DOCS_AT_ONCE).to_pylist()]
                rows = list(table.encode(part))
                of = b.column(0).slice(k, len(rows))
                if digest:
                    yield pa.record_batch([of, pa.array([r[0] for r in rows], pa.int64()), pa.array([sha(r[1].encode()) for r in rows], pa.string()), pa.array([sha(r[2]) for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    ids = [list(map(int, r[1].split())) for r in rows]
                    yield pa.record_batch([of, pa.array(ids, pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.binary())], ["doc_id", "ids", "decoded"])

    return run


def encode_documents(docs: DataFrame, ranks: str, pattern: str, table_size: int = TABLE_SIZE) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the bytes they stand for). ranks: a path, or the name of a public tokenizer's file."""
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(_batches(docs, ranks, pattern, table_size, False), "doc_id long, ids array<int>, decoded binary")


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """(doc_id, ids) -> doc_id, text: bytes that are no UTF-8 come back as replacement characters; null ids as null."""
    shared = encoded.sparkSession.sparkContext.broadcast(_built(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value[1].__getitem__
        for b in batches:
            texts = [None if ids is None else b"".join(map(get, ids)).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded["doc_id"].cast("long"), encoded["ids"].cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def op12(docs: DataFrame, ranks: str, pattern: str, table_size: int = TABLE_SIZE) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(_batches(docs, ranks, pattern, table_size, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
