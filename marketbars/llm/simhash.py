"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: words of the text (A-Z lower-cased) in shingles of `width`, joined by single blanks; a bit is 1 if it is
set in over half of the shingles' XXH64 (seed 42). Two fingerprints link at `radius` or fewer differing bits.

Covering: bit i of the fingerprint gets the (radius+1)-bit vector c(i); table v (each of the 2^(radius+1)-1 non-zero
vectors) keeps the bits with <c(i), v> odd. The at most `radius` vectors of the differing bits span no whole space, so
some v is orthogonal to them all: each linked pair agrees in the kept bits of some table. In a bucket of up to `bucket`
fingerprints, components are found by comparing and only links to their smallest member leave the task. Members of
larger buckets take an exact way without pairs: each lists the fingerprints at distance radius/2 around itself, and
all that list the same one (a number bounded by the size of that ball) are linked to the smallest of them.

Equal fingerprints are folded first, so exact copies cost one row each; the components run over distinct fingerprints.

Cases: a text of fewer than `width` words is one shingle; null text and text without words have the fingerprint zero,
linked like any other; rows with a null id keep their fingerprint and component but name none (a component of such
rows only has a null id); repeated rows each get a row; an empty table gives an empty result; other columns of the
input are not looked at; texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_dir, hot_values, keep, new_dir, spread_join

WIDTH, RADIUS, SEED = 4, 4, 42
BUCKET = 4096
#: For deduplicate(): fingerprints of a text; texts and words of a block of candidates.
SEEDS, BLOCK_ROWS, BLOCK_WORDS = 4, 1024, 4_000_000
#: Of the exact candidates: one text in SAMPLE is counted for shingles to put last, those seen HOT_LEAST times there, HOT_MOST of them at most.
SAMPLE, HOT_LEAST, HOT_MOST = 16, 4, 200_000
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The keys (as longs) and fp (the fingerprint as a signed long)."""
    names = [*keys, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(len(keys))], np.uint64).view(np.int64)
            yield pa.record_batch([*b.columns[:-1], pa.array(fp, pa.int64())], names)

    return docs.select(*[docs[k].cast("long") for k in keys], "text").mapInArrow(run, ", ".join(f"{k} long" for k in names))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The kept bits of each table, as signed longs: c(i) cycles through the non-zero vectors, so each table keeps about half."""
    dims = radius + 1
    out = []
    for v in range(1, 2**dims):
        m = sum(1 << i for i in range(64) if ((i % (2**dims - 1) + 1) & v).bit_count() % 2)
        out.append(m - 2**64 if m >= 2**63 else m)
    return out


def ball_masks(radius: int) -> list[int]:
    """All masks of up to `radius` bits, as signed longs."""
    from itertools import combinations

    return [m - 2**64 if (m := sum(1 << i for i in c)) >= 2**63 else m for k in range(radius + 1) for c in combinations(range(64), k)]


def _stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) for the components of a bucket, found breadth first."""
    left, out = np.sort(fps), []
    bits = left.view(np.uint64)
    while len(left):
        root, todo = int(left[0]), [bits[0]]
        left, bits = left[1:], bits[1:]
        while todo and len(left):
            near = np.bitwise_count(bits ^ todo.pop()) <= radius
            if near.any():
                out += [(int(x), root) for x in left[near]]
                todo += list(bits[near])
                left, bits = left[~near], bits[~near]
    return out


def _link_buckets(radius: int, bucket: int):
    """Rows (t, key, fp) sorted by bucket -> (a, b) links, and (a, null) for members of a bucket beyond the bound."""

    def send(a: list, b: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = k = f = np.zeros(0, np.int64)
        large = None
        for b in _with_end(batches):
            if b is not None:
                t, k, f = (np.concatenate([old, new.to_numpy(zero_copy_only=False).astype(np.int64)]) for old, new in zip((t, k, f), b.columns, strict=True))
            if not len(t):
                continue
            cut = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [len(t)]])
            if b is not None:  # the last bucket may go on
                starts, ends = starts[:-1], ends[:-1]
            out_a, out_b = [], []
            if len(starts) and large == (t[0], k[0]):  # the rest of a bucket that is beyond the bound
                out_a += f[: ends[0]].tolist()
                out_b += [None] * int(ends[0])
                starts, ends = starts[1:], ends[1:]
            sizes = ends - starts
            two = starts[sizes == 2]
            near = two[np.bitwise_count(f[two].view(np.uint64) ^ f[two + 1].view(np.uint64)) <= radius] if len(two) else two
            out_a += f[near + 1].tolist()
            out_b += f[near].tolist()
            for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
                if e - s > bucket:
                    out_a += f[s:e].tolist()
                    out_b += [None] * int(e - s)
                else:
                    for x, y in _stars(f[s:e], radius):
                        out_a.append(x)
                        out_b.append(y)
            if b is not None:
                last = int(cut[-1]) if len(cut) else 0
                t, k, f = t[last:], k[last:], f[last:]
                if len(t) > bucket or large == (t[0], k[0]):
                    large = (t[0], k[0])
                    out_a += f.tolist()
                    out_b += [None] * len(f)
                    t, k, f = t[:1], k[:1], f[:1]  # one row stays to carry the bucket's name
            if out_a:
                yield send(out_a, out_b)

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, reach: int | None = None) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp) whose components are those of all links within the radius.

    With a column seed, only fingerprints of one seed meet. With `reach`, links of up to so many bits are taken where a
    bucket shows them, besides all those within the radius.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    tables = 2 ** (radius + 1) - 1
    t = F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))
    first = F.col("seed") * tables if "seed" in fps.columns else F.lit(0)
    key = F.col("fp").bitwiseAND(F.element_at(masks, F.pmod("t", F.lit(tables)) + 1))
    # dealt by the kept bits, which are not sent: they follow from t and fp
    rows = fps.select("fp", first.alias("first"), t.alias("t")).select((F.col("first") + F.col("t")).alias("t"), "fp").repartition("t", key)
    rows = rows.select("t", key.alias("key"), "fp").sortWithinPartitions("t", "key", "fp")
    found = keep(rows.mapInArrow(_link_buckets(reach or radius, bucket), "a long, b long").distinct(), "links")
    crowd = found.where("b IS NULL").select(F.col("a").alias("fp"))
    if crowd.limit(1).count() == 0:
        return found
    half = radius // 2
    if radius % 2:
        raise ValueError("buckets beyond the bound need an even radius")
    near = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m).cast("long")) for m in ball_masks(half)])).alias("mid"))
    # at most as many fingerprints name one `mid` as its ball holds
    groups = near.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    more = groups.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()
    return found.where("b IS NOT NULL").union(more)


def group(fp: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Rows (doc_id, fp) -> doc_id, fp, component_id. fp is read several times: pass a written table. A fingerprint of very many rows is dealt over many tasks."""
    nodes = keep(fp.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    hot = hot_values(nodes, "fp", "n", fp.count())
    labels = components(links(nodes.select("fp"), radius, bucket)).select(F.col("node").alias("fp"), "label")
    named = keep(nodes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "named")
    ids = named.groupBy("label").agg(F.min("first").alias("component_id"))
    table = keep(named.join(ids, "label").select("fp", "component_id"), "ids")
    return spread_join(fp, table, ["fp"], hot).select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach."""
    rows = group(keep(fingerprints(docs, width), "fingerprints"), radius)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def word_marks(text: str | None, seeds: int) -> tuple[bytes, int, list[int]]:
    """Digest of the word sequence, number of words, and one fingerprint of the distinct words for each seed."""
    words = (text or "").encode().lower().split()
    distinct = set(words)
    out = []
    for seed in range(seeds):
        h = np.fromiter((xxhash.xxh64_intdigest(w, SEED + seed) for w in distinct), np.uint64, len(distinct))
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(distinct), bitorder="little").view(np.int64)[0]))
    return xxhash.xxh3_128_digest(b" ".join(words)), len(words), out


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles as sorted hashes; fewer than `width` words are one shingle, no word is the empty one."""
    words = (text or "").encode().lower().split()
    k = min(width, len(words))
    n = len(words) - k + 1
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(n)), np.uint64, n))


def similar(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """(id, smallest id) for the components of all pairs of sets with a Jaccard similarity of `similarity` or more.

    Breadth first: a visited set meets only those not visited yet, through the lists of sets that hold each element.
    """
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    ids, sets = [ids[i] for i in order], [sets[i] for i in order]
    size = np.array([len(x) for x in sets], np.int64)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), size)
    by = np.argsort(element, kind="stable")
    lists, holders = np.concatenate([[0], np.cumsum(np.bincount(element))]), holder[by]
    begin = np.concatenate([[0], np.cumsum(size)])
    left, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        todo = [root] if left[root] else []
        left[root] = False
        while todo and left.any():
            x = todo.pop()
            mine = element[begin[x] : begin[x + 1]]
            start, n = lists[mine], lists[mine + 1] - lists[mine]
            at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(holders[at], minlength=len(sets))
            near = np.flatnonzero(left & (both >= similarity * (size[x] + size - both)))
            left[near] = False
            out += [(ids[y], ids[root]) for y in near]
            todo += near.tolist()
    return out


def candidate_groups(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Rows (row, fps) -> row, label for those whose fingerprints link to others under some seed, directly or through others."""
    at = keep(nodes.select("row", F.posexplode("fps").alias("seed", "fp")), "seeds")
    # a bucket also tells pairs beyond the radius: what lies within twice of it is taken along
    found = keep(links(at.select("seed", "fp").distinct(), radius, bucket, 2 * radius), "near")
    shared = at.groupBy("seed", "fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    known = found.select(F.explode(F.array("a", "b")).alias("fp")).union(shared).distinct()
    active = keep(at.join(known, "fp", "left_semi").select("row", "fp"), "active")
    hubs = active.groupBy("row").agg(F.min("fp").alias("hub"))
    own = active.join(hubs, "row").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    labels = components(found.union(own))
    return hubs.join(labels.withColumnRenamed("node", "hub"), "hub").select("row", "label")


_SETS = "row long, label long, blocks int, shingles binary"


def _shingle_sets(width: int):
    """Rows (row, label, blocks, text) -> the same with the sorted hashes of the text's distinct shingles."""
    names = ["row", "label", "blocks", "shingles"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):  # a batch for each text: sets of long texts do not pile up
                found = shingle_set(b.column(3)[i].as_py(), width).tobytes()
                yield pa.record_batch([*(c.slice(i, 1) for c in b.columns[:3]), pa.array([found], pa.binary())], names)

    return cut


def _links_of(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _verified(members: DataFrame, width: int, similarity: float) -> DataFrame:
    """Rows (row, label, blocks, text) -> links (a, b) of rows whose shingle sets are similar, all those that components need.

    A label of one block is compared in one task. Of a label of more, every block is compared with one text first, that
    with the smallest row: the rows linked to it are one component already and need no comparison with each other. The
    rows that are left, dealt in blocks of their own, are compared with all rows, by pairs of blocks. So one huge group
    of copies of a text costs one comparison a row, and what is quadratic is the part that isn't like it.
    """

    def check(t: pa.Table) -> pa.Table:
        found = dict(zip(t.column("row").to_pylist(), t.column("shingles").to_pylist(), strict=True))  # a row can be on both sides
        return _links_of(similar(list(found), [np.frombuffer(x, np.uint64) for x in found.values()], similarity))

    def near_first(t: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        rows, k = t.column("row").to_pylist(), t.column("first").to_pylist().index(True)
        first, pairs = sets[k], []
        for row, x in zip(rows, sets, strict=True):
            if row != rows[k]:
                both = len(np.intersect1d(first, x, assume_unique=True))
                if both >= similarity * (len(first) + len(x) - both):
                    pairs.append((row, rows[k]))
        return _links_of(pairs)

    cut = _shingle_sets(width)
    rows = members.select("row", "label", "blocks", "text")
    small = rows.where("blocks = 1").mapInArrow(cut, _SETS).groupBy("label").applyInArrow(check, "a long, b long")
    sets = keep(rows.where("blocks > 1").mapInArrow(cut, _SETS), "sets")
    sets = sets.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    firsts = keep(sets.groupBy("label").agg(F.min("row").alias("row")), "firsts")
    first = sets.join(firsts, ["label", "row"]).select("label", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "row", "shingles", F.lit(True).alias("first"))
    each = sets.select("label", "block", "row", "shingles", F.lit(False).alias("first")).unionByName(first)
    linked = keep(each.groupBy("label", "block").applyInArrow(near_first, "a long, b long"), "linked")
    left = sets.join(linked.select(F.col("a").alias("row")).hint("merge"), "row", "left_anti").join(firsts.select("row", F.lit(True).alias("first")).hint("merge"), "row", "left").where("first IS NULL").drop("first")
    left = keep(left, "left")
    words = F.octet_length("shingles") / 8
    n = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(words) / BLOCK_WORDS)).cast("int")
    more = keep(left.groupBy("label").agg(n.alias("parts")), "parts")
    mine = left.join(more, "label").select("label", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "row", "shingles")
    all_ = sets.join(more, "label").select("label", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "block", "row", "shingles")
    rest = mine.unionByName(all_).groupBy("label", "part", "block").applyInArrow(check, "a long, b long")
    return small.union(linked).union(rest)


def hot_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles (sorted) and about how many texts hold them, by a sample: they set the cost, no pair depends on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 64):
                yield pa.record_batch([pa.array(np.concatenate([shingle_set(t.as_py(), width) for t in b.column(0)[at : at + 64]]).view(np.int64))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").count().where(F.col("count") >= HOT_LEAST).orderBy(F.desc("count"), "h").limit(HOT_MOST).collect()
    found = sorted((r[0] % 2**64, r[1] * SAMPLE) for r in top)
    return np.array([x for x, _ in found], np.uint64), np.array([n for _, n in found], np.int64)


def _prefix_size(size, similarity: float):
    return size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1


def prefixes(texts: DataFrame, width: int, similarity: float, hot: np.ndarray, counts: np.ndarray, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows (row, label, text) -> key, row, label, size, side: the first shingles of each text in the order (hot, hash).

    Two sets with a Jaccard of `similarity` share one of their first size - ceil(similarity * size) + 1 elements in any
    common order. A hot shingle's texts are dealt in blocks, and each pair of blocks has a key; side tells the block.
    """
    shared = texts.sparkSession.sparkContext.broadcast((hot, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = shared.value
        for b in batches:
            out, n = [], 0
            for i in range(len(b)):
                row, label = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                h = shingle_set(b.column(2)[i].as_py(), width)
                size = len(h)
                times = np.ones(size, np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    is_hot = hot[at] == h
                    h = np.concatenate([h[~is_hot], h[is_hot]])
                    times = np.concatenate([times[~is_hot], counts[at[is_hot]] // block + 1])
                k = int(_prefix_size(size, similarity))
                h, times = h[:k], times[:k]
                keys, sides = [h[times == 1]], [np.full(int((times == 1).sum()), 2, np.int8)]
                for x, blocks in zip(h[times > 1], times[times > 1], strict=True):
                    own = np.uint64(xxhash.xxh64_intdigest(row.to_bytes(8, "little", signed=True), SEED) % int(blocks))
                    other = np.arange(int(blocks), dtype=np.uint64)
                    low, high = np.minimum(other, own), np.maximum(other, own)
                    keys.append(x ^ (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)))
                    sides.append(np.where(low == high, 2, own == high).astype(np.int8))
                key = np.concatenate(keys).view(np.int64)
                out.append((key, np.full(len(key), row), np.full(len(key), ~row if label is None else label), np.full(len(key), size, np.int32), np.concatenate(sides)))
                n += len(key)
                if n > SHINGLES_AT_ONCE or i + 1 == len(b):
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "row", "label", "size", "side"])
                    out, n = [], 0

    return texts.select("row", "label", "text").mapInArrow(run, "key long, row long, label long, size int, side byte")


def _pairs(similarity: float):
    """Rows of prefixes() sorted by key -> a, b, need: pairs of a key with other labels and fitting sizes; `need` shared prefix shingles are due."""

    def found(row: np.ndarray, label: np.ndarray, size: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
        out = []
        step = max(1, (1 << 22) // len(row))
        for s in range(0, len(row), step):
            x = slice(s, s + step)
            ok = (label[x, None] != label) & (row[x, None] < row) & ((side[x, None] != side) | (side == 2))
            ok &= np.minimum(size[x, None], size) >= similarity * np.maximum(size[x, None], size) - 1e-9
            i, j = np.nonzero(ok)
            i = i + s
            rest = np.maximum(size[i] - _prefix_size(size[i], similarity), size[j] - _prefix_size(size[j], similarity))
            need = np.ceil(similarity * (size[i] + size[j]) / (1 + similarity) - 1e-9).astype(np.int64) - rest
            out.append(np.stack([row[i], row[j], np.maximum(need, 1)]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        for b in _with_end(batches):
            if b is not None:
                held = [np.concatenate([old, new.to_numpy(zero_copy_only=False).astype(np.int64)]) for old, new in zip(held, b.columns, strict=True)]
            key = held[0]
            if not len(key):
                continue
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            if b is not None:  # the last key may go on
                starts, ends = starts[:-1], ends[:-1]
            out = []
            if len(starts):
                label = held[2][: ends[-1]]
                mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
                for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
                    out += found(*[c[s:e] for c in held[1:]])
            if b is not None and len(cut):
                held = [c[cut[-1] :] for c in held]
            for part in out:
                for k in range(0, part.shape[1], 1 << 16):
                    yield pa.record_batch([pa.array(c[k : k + (1 << 16)]) for c in part], ["a", "b", "need"])

    return run


def prefix_pairs(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Rows (row, label, text) -> (a, b): all pairs of different labels (null is like no other) that can have a Jaccard of `similarity`.

    Beyond sharing one prefix shingle: all they share lies in both prefixes, or in the rest of that whose prefix ends first.
    """
    rows = prefixes(texts, width, similarity, *hot_shingles(texts, width))
    rows = rows.repartition("key").sortWithinPartitions("key")
    pairs = rows.mapInArrow(_pairs(similarity), "a long, b long, need long")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b")


def _members(groups: DataFrame) -> DataFrame:
    """Rows (row, label, words) -> row, label, blocks for the labels of more than one row."""
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("words") / BLOCK_WORDS)).cast("int").alias("blocks")
    sizes = groups.groupBy("label").agg(F.count("*").alias("n"), blocks).where("n > 1")
    return groups.join(sizes, "label").select("row", "label", "blocks")


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, seeds: int = SEEDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """docs with one document of each group: the smallest doc_id stays, ids that are null only if there is no other.

    Copies with equal words are folded first. Candidates come from covering tables over `seeds` fingerprints of the
    distinct words (an edit that spoils `width` shingles spoils one word), which group large sets of copies cheaply but
    guarantee bits, not a Jaccard; so pairs of different groups come from a prefix join on shingles, which misses none.
    The check is exact: a link is a Jaccard similarity of distinct shingles of `similarity` or more.
    It goes by groups of candidates; groups beyond BLOCK_ROWS texts or BLOCK_WORDS words are cut in blocks, which are
    compared with one text of the group first and in pairs where that does not do, so that no task holds a whole group.

    A copy of docs with a row number is written first, so that rows are told apart even where ids repeat or are null.
    Texts without words and null texts are copies of each other; a text of fewer than `width` words is one shingle.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # names of its own can't clash with these
    doc_id, text = inner[names.index("doc_id")], inner[names.index("text")]
    rows_at = new_dir(docs.sparkSession, "rows")
    rows = keep(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()), "rows", rows_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [word_marks(t.as_py(), seeds) for t in b.column(2)]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), (pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)] if found else []
            if columns:
                yield pa.record_batch([b.column(0), b.column(1), *columns], ["row", "id", "digest", "words", "fps"])

    marks = rows.select("row", F.col(doc_id).cast("long").alias("id"), text).mapInArrow(run, "row long, id long, digest binary, words long, fps array<long>")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = marks.groupBy("digest").agg(first, F.min("words").alias("words"), F.min("fps").alias("fps"))
    nodes = keep(nodes.select(F.col("first.row").alias("row"), "first", "words", "fps"), "nodes")

    groups = keep(candidate_groups(nodes, radius, bucket).join(nodes.select("row", "words"), "row"), "groups")
    members = _members(groups)
    tags = keep(nodes.select("row").join(members, "row", "left"), "tags")
    # the same joins at every size, so that small tables tell what large ones need; texts are exchanged once
    tagged = keep(rows.join(tags.hint("merge"), "row"), "tagged")
    drop_dir(docs.sparkSession, rows_at)  # all that is read from here on is written anew
    grouped = tagged.where("label IS NOT NULL")
    similar_rows = lambda rows: _verified(rows.select("row", "label", "blocks", F.col(text).alias("text")), width, similarity)
    first_links = keep(similar_rows(grouped), "similar")
    # all pairs inside a label have been checked; what is similar across labels is found by shingles
    pairs = keep(prefix_pairs(tagged.select("row", "label", F.col(text).alias("text")), width, similarity), "pairs")
    across = components(pairs).withColumnRenamed("node", "row").join(nodes.select("row", "words"), "row")
    across = keep(_members(keep(across, "across")), "across_members")
    more = keep(similar_rows(tagged.drop("label", "blocks").join(across, "row")), "similar")
    same = components(first_links.union(more))
    named = keep(same.withColumnRenamed("node", "row").join(nodes.select("row", "first"), "row"), "named")
    best = named.groupBy("label").agg(F.min("first").alias("best"))
    gone = keep(named.join(best, "label").where("first <> best").select("row"), "gone")
    alone = keep(gone.join(members.select("row").hint("merge"), "row", "left_anti"), "alone")
    out = tagged.where("label IS NULL").join(alone, "row", "left_anti").select(*inner).union(grouped.join(gone.hint("merge"), "row", "left_anti").select(*inner))
    return out.toDF(*names)


def op8(docs: DataFrame) -> DataFrame:
    return simhash_groups(docs)
