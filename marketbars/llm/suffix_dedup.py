"""Removal of every byte under a string of `least` bytes that also starts anywhere else in the corpus.

The strings of `least` bytes are dealt out by content: the window of `least` bytes starting at a place has a leftmost
smallest hash of `gram` bytes, its anchor. Neighbouring places with the same anchor make a segment; equal windows have
equal anchor hashes, so all repeats of a window lie in segments of one key, and two places of one segment never
repeat each other. Keys met once are unique. Where all segments of a key are the same, all their places repeat.
For the other keys, the distinct segments are indexed:

A task takes the segments of many keys, up to `chunk` bytes, sorts their suffixes and forms the Burrows-Wheeler
transform. Breadth-first backward extension of the intervals of all strings of length 0, 1, 2 ... derives the common
prefixes of neighbouring suffixes by increasing value, and stops at `least`: boundaries that have got no value by
then have a common prefix of at least `least` bytes, so the places on their sides repeat. The segments of a key never
part company; a key of over `crowd` bytes of distinct segments (a passage with very many surroundings) has each of its
windows hashed (128 bits) and counted instead, which is exact, linear and free of large groups.

Spans come back to the texts by a hash of the text (128 bits), so exact copies share one list of spans. Keys, segments and
texts that very many rows have (over 1/HOT of them) are dealt over many tasks in each join.

Cases: null text is empty; texts under `least` bytes keep everything; matches never cross documents; overlaps count and
strings are judged on the input; repeated rows repeat each other and each get a row; null ids are kept; an empty table
gives an empty result; other columns of the input are not looked at; texts are taken whole, in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_values, keep, spread_join

LEAST, GRAM = 200, 32
CHUNK, CROWD = 1 << 19, 3 << 18
BLOCK = 1 << 20
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SHIFT = np.uint64(29)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` (a power of two) bytes from each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * ODD[0]
    size = 1
    while size < gram:
        h = h[:-size] * ODD[1] + (h[size:] ^ (h[size:] >> SHIFT)) * ODD[0]
        size *= 2
    return h ^ (h >> SHIFT)


def window_minima(h: np.ndarray, size: int) -> np.ndarray:
    m, have = h, 1
    while have < size:
        step = min(have, size - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def segments(data: bytes, least: int = LEAST, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, number of places, key) arrays of the segments of a text, block by block."""
    places = len(data) - least + 1
    for at in range(0, places, BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK, places - at) + least - 1, at)
        h = gram_hashes(block, gram)
        m = window_minima(h, least - gram + 1)
        # the anchor changes where a smaller hash comes in or where the anchor itself goes out
        cut = np.flatnonzero((m[1:] < m[:-1]) | (h[: len(m) - 1] == m[:-1])) + 1
        starts = np.concatenate([[0], cut])
        yield starts + at, np.diff(np.concatenate([starts, [len(m)]])), m[starts].view(np.int64)


def text_id(data: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(data)
    return int(np.uint64(d >> 64).astype(np.int64)), int(np.uint64(d & (2**64 - 1)).astype(np.int64))


def _bytes(col: pa.Array, r: int) -> bytes:
    t = col[r].as_py()
    return t.encode() if t else b""


SEGMENT = "key long, sh long, c1 long, c2 long, pr long"


def _cut(least: int):
    """text -> rows of SEGMENT; sh hashes the segment's bytes, pr is place * 256 + number of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            out, rows = [], 0
            for r in range(b.num_rows):
                data = _bytes(b.column(0), r)
                if len(data) < least:
                    continue
                c1, c2 = text_id(data)
                for s, n, key in segments(data, least):
                    sh = np.fromiter((digest(data[x:y]) for x, y in zip(s.tolist(), (s + n + least - 1).tolist(), strict=True)), np.uint64, len(s)).view(np.int64)
                    out.append((key, sh, np.full(len(s), c1), np.full(len(s), c2), s * 256 + n))
                    rows += len(s)
                if rows > 200_000 or r == b.num_rows - 1 and out:
                    yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "sh", "c1", "c2", "pr"])
                    out, rows = [], 0
            if out:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["key", "sh", "c1", "c2", "pr"])

    return run


def sort_suffixes(sym: np.ndarray) -> np.ndarray:
    """Suffix array of sym, where each 0 ends a string and is a symbol of its own, smaller than all others, in order of place."""
    n = len(sym)
    ends = sym == 0
    pad = np.concatenate([sym.astype(np.int64), np.zeros(7, np.int64)])
    key, live = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(7):
        x = pad[k : k + n] * live
        key = key << 9 | x
        live &= x > 0
    # a prefix that holds an end is told apart by which end it is
    which = np.where(live, 0, np.cumsum(ends) - ends + 1)
    order = np.lexsort((which, key))
    new = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (which[order][1:] != which[order][:-1])])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size = 7
    while True:
        lone = new & np.concatenate([new[1:], [True]])
        rows = np.flatnonzero(~lone)
        if not len(rows):
            return order
        sub = order[rows]
        k2 = rank[sub] * (n + 1) + rank[np.minimum(sub + size, n - 1)]
        o = np.argsort(k2)
        sub, k2 = sub[o], k2[o]
        order[rows] = sub
        fresh = np.concatenate([[True], k2[1:] != k2[:-1]])
        new[rows] = fresh
        rank[sub] = np.maximum.accumulate(np.where(fresh, rows, 0))
        size *= 2


def long_prefixes(sym: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each suffix in order, whether its common prefix with the one before is `least` symbols or more.

    Intervals of rows that start with the same string w are extended backward by each symbol c before them to those of
    cw, all strings of one length at a time. An interval whose right boundary gets its value for the first time is
    extended further; one whose boundary has a value is not.
    """
    n = len(sym)
    n_ends = int((sym == 0).sum())
    bwt = sym[order - 1]  # what stands before each suffix; before the first stands the last end
    rows = np.argsort(bwt, kind="stable")  # LF, inverted
    lf = np.empty(n, np.int64)
    lf[rows] = np.arange(n)
    same = bwt[rows][1:] == bwt[rows][:-1]
    after, before = np.full(n, n), np.full(n, -1)
    after[rows[:-1][same]] = rows[1:][same]
    before[rows[1:][same]] = rows[:-1][same]
    has = np.zeros(n + 1, bool)
    has[: n_ends + 1] = True
    has[n] = True
    counts = np.bincount(sym)
    hi = np.cumsum(counts)
    lo = hi - counts
    there = np.flatnonzero(counts[1:]) + 1
    has[hi[there]] = True
    left = np.concatenate([np.arange(n_ends), lo[there]])
    right = np.concatenate([np.arange(1, n_ends + 1), hi[there]])
    for _ in range(1, least):
        if not len(left):
            break
        sizes = right - left
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(left - (ends - sizes), sizes)
        real = bwt[at] > 0
        at, l_at, r_at = at[real], np.repeat(left, sizes)[real], np.repeat(right, sizes)[real]
        # the first and last row of each symbol in an interval are the ends of the extended interval
        new_left = np.sort(lf[at[before[at] < l_at]])
        new_right = np.sort(lf[at[after[at] >= r_at]]) + 1
        fresh = ~has[new_right]
        left, right = new_left[fresh], new_right[fresh]
        has[right] = True
    return ~has[:n]


def repeated_places(parts: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """For each segment, which of its places start a string of `least` bytes that starts at another place too."""
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    sym = np.zeros(int((sizes + 1).sum()), np.int16)
    for s, p in zip(starts, parts, strict=True):
        sym[s : s + len(p)] = np.frombuffer(p, np.uint8)
        sym[s : s + len(p)] += 1
    order = sort_suffixes(sym)
    linked = long_prefixes(sym, order, least)
    both = linked | np.concatenate([linked[1:], [False]])
    found = np.zeros(len(sym), bool)
    found[order] = both
    return [found[s : s + n - least + 1] for s, n in zip(starts, sizes, strict=True)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


FOUND = "key long, sh long, spans array<struct<s:int,e:int>>"


def _index(least: int, chunk: int):
    """Rows (key, sh, n, data) sorted by key -> FOUND: the repeated places of each distinct segment."""
    span = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_places([r[3] for r in rows], least)
        spans = [[{"s": 0, "e": len(f)}] if r[2] > 1 else [{"s": s, "e": e} for s, e in runs(f)] for r, f in zip(rows, flags, strict=True)]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(spans, span)], ["key", "sh", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, group, size, group_size = [], [], 0, 0  # whole keys, and the key that may go on
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[0] != group[0][0]:
                    if whole and size + group_size > chunk:
                        yield solve(whole)
                        whole, size = [], 0
                    whole += group
                    size += group_size
                    group, group_size = [], 0
                group.append(row)
                group_size += len(row[3])
        if whole and size + group_size > chunk:
            yield solve(whole)
            whole = []
        if whole or group:
            yield solve(whole + group)

    return run


def _fetch(least: int):
    """(text, wanted) -> key, sh, n, crowd, data: the bytes of the wanted segments."""
    names = ["key", "sh", "n", "crowd", "data"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                data = _bytes(b.column(0), r)
                for w in b.column(1)[r].as_py():
                    p, n = divmod(w["pr"], 256)
                    out.append((w["key"], w["sh"], w["n"], w["crowd"], data[p : p + n + least - 1]))
            for k in range(0, len(out), 8192):
                yield pa.record_batch([pa.array([x[i] for x in out[k : k + 8192]], t) for i, t in enumerate(types)], names)

    return run


def _count_windows(least: int):
    """(key, sh, n, data) -> a row for each place: key, sh, n, place, and the window's hash (h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, sh, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = [text_id(data[p : p + least]) for p in range(len(data) - least + 1)]
                k = len(h)
                yield pa.record_batch([pa.repeat(pa.scalar(x, pa.int64()), k) for x in (key, sh, n)] + [pa.array(range(k), pa.int32()), pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64())], ["key", "sh", "n", "place", "h1", "h2"])

    return run


def repeats(texts: DataFrame, least: int = LEAST, chunk: int = CHUNK, crowd: int = CROWD) -> DataFrame:
    """(text) -> c1, c2 (the text's id) and places (start, end): where strings of `least` bytes start that start elsewhere too.

    A segment has at most least - GRAM + 1 places, whose number is kept in 8 bits.
    """
    if least - GRAM + 1 > 255:
        raise ValueError(f"strings of more than {254 + GRAM} bytes do not fit the places")
    segs = keep(texts.select("text").mapInArrow(_cut(least), SEGMENT), "segments")
    keys = keep(segs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("sh") != F.max("sh")).alias("mixed")).where("n > 1"), "keys")
    n_segs = segs.count()
    known = keep(spread_join(segs, keys.select("key", "mixed"), ["key"], hot_values(keys, "key", "n", n_segs), by=F.col("c1")), "known")
    mixed = known.where("mixed")
    distinct = keep(mixed.groupBy("key", "sh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("c1", "c2", "pr")).alias("at")).select("key", "sh", "n", "at.*"), "distinct")
    sizes = distinct.groupBy("key").agg(F.sum(F.pmod("pr", F.lit(256)) + least - 1).alias("size"))
    crowds = keep(sizes.where(F.col("size") > crowd).select("key", F.lit(True).alias("crowd")), "crowds")
    wanted = distinct.join(crowds, "key", "left").select("c1", "c2", F.struct("key", "sh", "n", F.coalesce("crowd", F.lit(False)).alias("crowd"), "pr").alias("w"))
    wanted = wanted.groupBy("c1", "c2").agg(F.collect_list("w").alias("wanted"))
    parts = keep(_with_id(texts, least, once=True).join(wanted, ["c1", "c2"]).dropDuplicates(["c1", "c2"]).select("text", "wanted").mapInArrow(_fetch(least), "key long, sh long, n long, crowd boolean, data binary"), "parts")
    usual = parts.where("NOT crowd").select("key", "sh", "n", "data").repartition("key").sortWithinPartitions("key", "sh")
    found = usual.mapInArrow(_index(least, chunk), FOUND)
    if crowds.limit(1).count():
        each = keep(parts.where("crowd").select("key", "sh", "n", "data").mapInArrow(_count_windows(least), "key long, sh long, n long, place int, h1 long, h2 long"), "windows")
        often = keep(each.groupBy("h1", "h2").agg(F.sum("n").alias("total")).where("total > 1").select("h1", "h2"), "often")
        many = each.join(often, ["h1", "h2"]).groupBy("key", "sh").agg(F.collect_list(F.struct(F.col("place").alias("s"), (F.col("place") + 1).alias("e"))).alias("spans"))
        found = found.union(many.select("key", "sh", "spans"))
    found = keep(found, "found").where(F.size("spans") > 0)
    place, count = F.floor(F.col("pr") / 256).cast("long"), F.pmod(F.col("pr"), F.lit(256))
    hot = hot_values(distinct, "sh", "n", n_segs)
    spread = spread_join(mixed, found, ["sh", "key"], hot, by=F.col("c1")).select("c1", "c2", place.alias("p"), F.explode("spans").alias("x")).select("c1", "c2", (F.col("p") + F.col("x.s")).alias("start"), (F.col("p") + F.col("x.e")).alias("end"))
    return spread.union(known.where("NOT mixed").select("c1", "c2", place.alias("start"), (place + count).alias("end")))


#: Text ids that a task remembers, to send copies once.
REMEMBERED = 1_000_000


def _with_id(texts: DataFrame, least: int = 0, once: bool = False) -> DataFrame:
    """The columns of texts (text last) with c1 and c2; texts under `least` bytes are left out. once: most copies that a task meets, too."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            data = [_bytes(b.column(b.num_columns - 1), r) for r in range(b.num_rows)]
            ids = [text_id(d) if len(d) >= least else None for d in data]
            if least or once:
                rows = []
                for r, x in enumerate(ids):
                    if x is not None and x not in seen:
                        rows.append(r)
                        if once:
                            seen.add(x)
                if len(seen) > REMEMBERED:
                    seen.clear()
                b, ids = b.take(pa.array(rows, pa.int64())), [ids[r] for r in rows]
            yield pa.record_batch([*b.columns, pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64())], [*b.schema.names, "c1", "c2"])

    return texts.mapInArrow(run, f"{schema}, c1 long, c2 long")


def removed(places: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under the strings that start at the places."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(places):
        e += least - 1
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _strip(least: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                data, at, kept = _bytes(b.column(1), r), 0, []
                spans = removed([(x["start"], x["end"]) for x in b.column(2)[r].as_py() or []], least)
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest() if digest else kept))
            yield pa.record_batch([b.column(0), *(pa.array([x[i] for x in rows], pa.int64()) for i in range(3)), pa.array([x[3] for x in rows], pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


def strip_repeats(docs: DataFrame, least: int = LEAST, chunk: int = CHUNK, crowd: int = CROWD, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) or, with digest, kept_sha256."""
    texts = docs.select("text")
    places = keep(repeats(texts, least, chunk, crowd).groupBy("c1", "c2").agg(F.collect_set(F.struct("start", "end")).alias("places"), F.count(F.lit(1)).alias("n")), "places")
    # a text of very many copies gets each of its places from each of them
    hot = hot_values(places, "c1", "n", places.agg(F.sum("n")).first()[0] or 0)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    long = F.coalesce(F.octet_length("text") >= least, F.lit(False))  # shorter texts have no places and take no part in the join
    joined = spread_join(_with_id(rows.where(long)), places.drop("n"), ["c1", "c2"], hot, "left").select("doc_id", "text", "places")
    rows = joined.unionByName(rows.where(~long).withColumn("places", F.lit(None).cast(places.schema["places"].dataType)))
    return rows.mapInArrow(_strip(least, digest), "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))


def op5(docs: DataFrame) -> DataFrame:
    return strip_repeats(docs, digest=True)
