"""Alignment of two tokenizers by products of sparse matrices, with the links counted over the whole corpus.

A is a byte-level BPE, B a SentencePiece model. Each token covers a range of bytes of its text: the tokens of A and of B
are the rows of two incidence matrices over bytes, in CSR made by hand. Row by row (Gustavson) the product of A with the
transpose of B gives the overlap links, with the number of bytes that two tokens share; those whose ranges end together
are the links that are counted. Offsets where tokens of both end cut the text into groups; the product of the incidence
matrices of tokens and groups gives the shared-group links, whose number comes from the symbolic part alone (a group of
many tokens has the square of their number; shared_links() makes them in blocks).

A task aligns texts of AT_ONCE characters together (or one longer text) and leaves a row for each document with its
distinct linked pairs of ids, in the shared folder; so every text is encoded once. Spark sums the pairs over the corpus
(folded in each task before the shuffle), and each document looks up its own: the counted pairs are broadcast if there
are at most `sent_most` (24 bytes each); beyond that documents' pairs are joined with them, hot pairs dealt by salt.
Counts grow with the corpus; the number of pairs is bounded by the vocabularies.

A's merges are done by rank over joined bytes, which is the same as by its list of merges if every token is what its own
bytes merge to; that is proved for the given file before any text is read (a file for which it isn't so is refused).

Cases: null and empty texts have no tokens, nor has a text whose bytes one of the tokenizers doesn't give back: zeros and
an empty string. Strings of special tokens are plain text. Repeated rows each count and get their row; null ids are kept;
an empty table gives an empty result; other columns of the input are not looked at; texts are taken whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import merged
from .common import hot_values, keep, spread_join
from .sentencepiece_codec import MARK, model_file

DOCS_AT_ONCE = 64
#: Characters of texts that are aligned in one product; entries of a product that are expanded at once.
AT_ONCE, EXPANDED = 1 << 18, 1 << 20
SENT_MOST = 1_000_000


# --- sparse matrices


@dataclass(frozen=True)
class Csr:
    """Rows of (column, value): row i has the entries starts[i] to starts[i + 1]."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        return Csr(np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))]), rows[order], self.values[order], len(self.starts) - 1)


def over_bytes(lengths: np.ndarray) -> Csr:
    """Tokens by bytes: token i covers the lengths[i] bytes after those of the tokens before it."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def over_groups(group: np.ndarray, n_groups: int) -> Csr:
    """Tokens by groups: one entry a row."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), n_groups)


def row_sizes(a: Csr, b: Csr) -> np.ndarray:
    """The symbolic part of a product: for each row of a, how many entries of b its own entries meet."""
    met = np.concatenate([[0], np.cumsum(np.diff(b.starts)[a.columns])])
    return met[a.starts[1:]] - met[a.starts[:-1]]


def product(a: Csr, b: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Gustavson's product: each row of a adds up the rows of b that its entries name. Blocks of (row, column, value), in order.

    Whole rows are expanded, at most EXPANDED entries at once (or a single row).
    """
    met = np.concatenate([[0], np.cumsum(row_sizes(a, b))])
    first, n = 0, len(a.starts) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(met, met[first] + EXPANDED, "right")) - 1)
        own = slice(a.starts[first], a.starts[last])
        size = np.diff(b.starts)[a.columns[own]]
        begin = np.cumsum(size) - size
        at = np.arange(int(size.sum())) + np.repeat(b.starts[a.columns[own]] - begin, size)
        row = np.repeat(np.repeat(np.arange(first, last), np.diff(a.starts[first : last + 1])), size)
        key, value = row * b.width + b.columns[at], np.repeat(a.values[own], size) * b.values[at]
        if len(key):
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, value = key[new], np.add.reduceat(value, new)
            yield key // b.width, key % b.width, value
        first = last


# --- the two tokenizers


def _signs() -> dict[str, int]:
    """Byte-level BPE writes a byte as the sign of its number where that can be seen, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def _bpe(a_file: str) -> tuple[list[bytes], list[tuple[int, int]]]:
    """The bytes of each id of A, and the merges as pairs of ids: the k-th makes id 256 + k."""
    with open(model_file(a_file), encoding="utf-8") as f:
        model = json.load(f)["model"]
    signs, vocabulary = _signs(), model["vocab"]
    special = len(vocabulary) - len(model["merges"]) - 256
    tokens = sorted(vocabulary, key=vocabulary.get)[: len(vocabulary) - special]
    merges = [tuple(vocabulary[x] for x in (m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return [bytes(signs[c] for c in t) for t in tokens], merges


class _Listed(dict):
    def __missing__(self, pair: tuple[int, int]) -> int:
        return -1


@lru_cache(maxsize=4)
def check_merges(a_file: str) -> None:
    """Raises unless merging by rank over joined bytes is the same as merging by the list.

    Up to the first join that the list lacks, both ways do the same inside the bytes of the joined token; so its bytes,
    merged by the list, would end in the two parts. If all tokens merge to themselves, there is no such join.
    """
    tokens, merges = _bpe(a_file)
    made = _Listed((pair, 256 + k) for k, pair in enumerate(merges))
    single = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
    wrong = len(made) != len(merges) or len(single) != 256 or any(tokens[x] + tokens[y] != tokens[i] for (x, y), i in made.items())
    if wrong or any(merged([single[b] for b in t], made) != [i] for i, t in enumerate(tokens)):
        raise ValueError("the merges of this file are not those of ranks")


class Pair:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, a_file: str, b_file: str, pattern: str):
        import sentencepiece
        import tiktoken

        self.a_bytes, _ = _bpe(a_file)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(self.a_bytes)}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_file(b_file))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        texts = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        #: ids as text, with what follows inside a group and at its end
        self.a_texts, self.b_texts = ((texts(len(of), ","), texts(len(of), end)) for of, end in ((self.a_bytes, "|"), (self.b_bytes, ";")))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and of B of each text (which is not empty), None where their bytes aren't those of the text after a space."""
        out = []
        for t, b in zip(texts, self.b.encode(texts, num_threads=1) if texts else [], strict=True):
            t = " " + t
            own, a = t.encode(), self.a.encode_ordinary(t)
            fits = b"".join(map(self.b_bytes.__getitem__, b)) == own and b"".join(map(self.a_bytes.__getitem__, a)) == own
            out.append((np.array(a, np.int64), np.array(b, np.int64)) if fits else None)
        return out


@lru_cache(maxsize=2)
def _pair(a_file: str, b_file: str, pattern: str) -> Pair:
    """A worker's own, kept from task to task."""
    return Pair(a_file, b_file, pattern)


class Alignment:
    """Texts in a row, each given by ids of A and B with the same bytes, aligned together."""

    def __init__(self, pair: Pair, texts: list[tuple[np.ndarray, np.ndarray]]):
        self.pair = pair
        none = [np.zeros(0, np.int64)]
        self.a_ids, self.b_ids = (np.concatenate([t[k] for t in texts] + none) for k in (0, 1))
        self.a_from, self.b_from = (np.concatenate([[0], np.cumsum([len(t[k]) for t in texts])]).astype(np.int64) for k in (0, 1))
        self.a, self.b = over_bytes(pair.a_sizes[self.a_ids]), over_bytes(pair.b_sizes[self.b_ids])
        self.a_ends, self.b_ends = self.a.starts[1:], self.b.starts[1:]
        self.ends = np.intersect1d(self.a_ends, self.b_ends)
        # a group ends where tokens of both do
        self.a_group, self.b_group = (np.searchsorted(self.ends, e) for e in (self.a_ends, self.b_ends))

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (A token, B token, bytes that they share)."""
        return product(self.a, self.b.transposed())

    def _groups(self) -> tuple[Csr, Csr]:
        return over_groups(self.a_group, len(self.ends)), over_groups(self.b_group, len(self.ends)).transposed()

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (A token, B token, 1) of tokens of one group."""
        return product(*self._groups())

    def group_texts(self) -> list[str]:
        """The groups of each text: ids of A, ids of B."""
        n = len(self.ends)
        a_before, b_before = (np.searchsorted(g, np.arange(n + 1)) for g in (self.a_group, self.b_group))
        out = np.empty(len(self.a_ids) + len(self.b_ids), object)
        for ids, group, texts, ends, others in ((self.a_ids, self.a_group, self.pair.a_texts, self.a_ends, b_before[:-1]), (self.b_ids, self.b_group, self.pair.b_texts, self.b_ends, a_before[1:])):
            out[np.arange(len(ids)) + others[group]] = np.where(ends == self.ends[group], texts[1][ids], texts[0][ids])
        cut = (self.a_from + self.b_from).tolist()
        out = out.tolist()
        return ["".join(out[p:q])[:-1] for p, q in zip(cut, cut[1:], strict=False)]

    def per_text(self) -> Iterator[tuple[int, int, int, int, int, int, str, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups, n_links, n_overlaps, n_shared, groups as text, distinct linked pairs of ids, how often) of each text."""
        n_overlaps, at, pairs = np.zeros(len(self.a_ids), np.int64), [], []
        for i, j, _ in self.overlaps():
            n_overlaps += np.bincount(i, minlength=len(self.a_ids))
            together = self.a_ends[i] == self.b_ends[j]
            at.append(i[together])
            pairs.append(self.a_ids[i[together]] << 32 | self.b_ids[j[together]])
        at, pairs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, pairs))
        summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[self.a_from])
        links, groups = np.searchsorted(at, self.a_from), np.append(self.a_group, len(self.ends))[self.a_from]
        numbers = [np.diff(self.a_from), np.diff(self.b_from), np.diff(groups), np.diff(links), summed(n_overlaps), summed(row_sizes(*self._groups()))]
        links = links.tolist()
        for k, (row, text) in enumerate(zip(zip(*(x.tolist() for x in numbers), strict=True), self.group_texts(), strict=True)):
            yield (*row, text, *np.unique(pairs[links[k] : links[k + 1]], return_counts=True))


# --- the corpus


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")


def _in_parts(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, at most DOCS_AT_ONCE and AT_ONCE characters together."""
    first, size, texts = 0, 0, []
    for k, t in enumerate(b.column(1)):
        t = t.as_py()
        if texts and (len(texts) == DOCS_AT_ONCE or size + len(t or "") > AT_ONCE):
            yield b.column(0).slice(first, len(texts)), texts
            first, size, texts = k, 0, []
        texts.append(t)
        size += len(t or "")
    if texts:
        yield b.column(0).slice(first, len(texts)), texts


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_overlaps", "n_shared")
_ALIGNED = "doc_id long, " + ", ".join(f"{n} long" for n in NUMBERS) + ", groups_sha256 string, pairs array<bigint>, times array<int>"


def aligned(docs: DataFrame, a_file: str, b_file: str, pattern: str) -> DataFrame:
    """A row for each document: doc_id, the numbers, groups_sha256, its distinct linked pairs (A id * 2**32 + B id) and how often it links each."""
    check_merges(a_file)
    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    nothing = ((0,) * len(NUMBERS), "", [], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_file, b_file, pattern)
        for b in batches:
            for ids, texts in _in_parts(b):
                encoded = iter(pair.encode([t for t in texts if t]))
                of = [next(encoded) if t else None for t in texts]
                found = Alignment(pair, [x for x in of if x]).per_text()
                rows = [(r[:6], hashlib.sha256(r[6].encode()).hexdigest(), r[7], r[8]) if x else nothing for x in of for r in ([next(found)] if x else [None])]
                numbers = zip(*(r[0] for r in rows), strict=True)
                yield pa.record_batch([ids, *[pa.array(c, pa.int64()) for c in numbers], pa.array([r[1] for r in rows], pa.string()),
                                       pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))], names)

    return _documents(docs).mapInArrow(run, _ALIGNED)


def _each(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(*more, F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """aligned() -> pair, n: how many links of the corpus hold it, and top: the most links that any pair of its B id has."""
    counts = keep(_each(rows).groupBy("pair").agg(F.sum("times").alias("n")), "pairs").withColumn("b_id", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    tops = counts.groupBy("b_id").agg(F.max("n").alias("top"))
    return keep(counts.join(tops, "b_id").select("pair", "n", "top"), "pair_counts")


def align(docs: DataFrame, a_file: str, b_file: str, pattern: str, sent_most: int = SENT_MOST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_overlaps, n_shared, groups_sha256, n_best, count_sum."""
    rows = keep(aligned(docs, a_file, b_file, pattern).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    first = ["doc_id", *NUMBERS, "groups_sha256"]
    if counts.limit(sent_most + 1).count() <= sent_most:
        t = counts.orderBy("pair").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(tuple(t.column(c).to_numpy() for c in ("pair", "n", "top")))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n, top = shared.value
            for b in batches:
                pairs, times = (b.column(c) for c in ("pairs", "times"))
                at = np.searchsorted(pair, pairs.flatten().to_numpy())
                times, cut = times.flatten().to_numpy().astype(np.int64), pairs.value_lengths().to_numpy().cumsum()
                sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], cut])]) for x in (times * (n[at] == top[at]), times * n[at])]
                yield pa.record_batch([*[b.column(c) for c in first], *map(pa.array, sums)], [*first, "n_best", "count_sum"])

        kinds = dict(rows.dtypes)
        return rows.mapInArrow(look_up, ", ".join(f"{c} {kinds[c]}" for c in first) + ", n_best long, count_sum long")
    each = _each(rows, "rid")
    hot = hot_values(each.groupBy("pair").count(), "pair", "count", each.count())
    times, best = F.col("times"), F.col("n") == F.col("top")
    sums = spread_join(each, counts, ["pair"], hot, by=F.col("rid")).groupBy("rid").agg(F.sum(F.when(best, times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(sums, "rid", "left").select(*first, zero("n_best"), zero("count_sum"))


def _links(docs: DataFrame, a_file: str, b_file: str, pattern: str, kind: str) -> DataFrame:
    check_merges(a_file)
    names = ["doc_id", "a_at", "b_at", "a_id", "b_id", "shared_bytes" if kind == "overlaps" else "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(a_file, b_file, pattern)
        for b in batches:
            for k, text in enumerate(b.column(1)):
                ids = pair.encode([text.as_py()])[0] if text.as_py() else None
                if ids is not None:
                    one = Alignment(pair, [ids])
                    for i, j, v in getattr(one, kind)():
                        yield pa.record_batch([b.column(0).take(pa.array(np.full(len(i), k))), *map(pa.array, (i, j, one.a_ids[i], one.b_ids[j], v))], names)

    return _documents(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def overlap_links(docs: DataFrame, a_file: str, b_file: str, pattern: str) -> DataFrame:
    """doc_id, a_at and b_at (places among the tokens), a_id, b_id, shared_bytes of each two tokens that share bytes."""
    return _links(docs, a_file, b_file, pattern, "overlaps")


def shared_links(docs: DataFrame, a_file: str, b_file: str, pattern: str) -> DataFrame:
    """doc_id, a_at, b_at, a_id, b_id of each two tokens in one group; a group of many tokens has as many as their product."""
    return _links(docs, a_file, b_file, pattern, "shared").drop("value")


def op13(docs: DataFrame, a_file: str, b_file: str, pattern: str, sent_most: int = SENT_MOST) -> DataFrame:
    return align(docs, a_file, b_file, pattern, sent_most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared")
