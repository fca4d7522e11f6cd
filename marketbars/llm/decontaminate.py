"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (title-case words inside a sentence; a run of them is one) and units turn into
typed placeholders, other words are lower-cased, punctuation goes. A title-case word that begins a sentence can be a
word (or unit) or a name of its own: both readings are indexed. Units are units in capitals, too. Scripts without blanks give a token for each character. Windows of
`width` template tokens are hashed and joined with the benchmark's windows; those with words in less than half of the
places, where a template can't decide, by their values, so that they match exact copies only. A document leaks an item
when the matched windows cover `share` of the item or a run of `run` of its tokens, and their slots are consistent: over
all of them the values of the item and those of the document stand for each other one to one, without any tolerance. So a
question asked again with other numbers and names is caught, a chance likeness of templates isn't; a window that
contradicts itself counts against its occurrence like any other. This is asked of each occurrence: the windows at one offset of document and
item, those at neighbouring offsets (words were put in or left out), and all of the document (pieces of an item far
apart); so a copy and its variants don't hide each other.

The benchmark's distinct window hashes are sent to the tasks as a filter if there are at most `known_most` of them
(8 bytes each, so the bound is proven); beyond that the join itself does all the work. The benchmark's windows are
broadcast if there are at most `sent_most`; beyond that both sides are dealt by hash and salt, so a window that very
many documents share is no task of its own. An item of fewer than `width` tokens is one window of its own length; one
of fewer than three matches by its values, and only where it stands as a sentence or line of its own.

Cases: null and empty texts match nothing; repeated rows each count as a document of their own, and equal (doc_id,
item_id) pairs are then folded to their best; null ids are kept; an empty table on either side gives an empty result;
other columns of the inputs are not looked at; texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import keep

WIDTH, LEAST, SHARE, RUN, STEP = 8, 3, 0.5, 13, 8
KNOWN_MOST, SENT_MOST, SALTS = 2_000_000, 100_000, 16
CACHE = 300_000
#: Tokens that are hashed at once, of many short texts or one long one.
AT_ONCE = 1 << 17

#: Scripts without blanks between words: Thai to Burmese, Khmer, kana and Chinese characters.
UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
#: Signs after which a sentence, clause or quotation may begin.
SEPARATORS = ".!?\n。！？:;\"“”«»("
TOKEN = re.compile(rf"[^\W\d_{UNSPACED}]+|[{SEPARATORS}]+|[0-9]+(?:[.,][0-9]+)*|(?=[{UNSPACED}])[^\W\d_]|[%$€£¥°]")
#: Words and signs that follow or precede amounts.
UNITS = frozenset("% $ € £ ¥ ° mm cm m km in ft mi mg g kg lb oz ml l s sec min h hr mph kmh usd eur gbp dollars euros pounds cents meters metres kilometers kilometres miles inches feet grams kilograms seconds minutes hours days weeks months years".split())
NUM, NAME, UNIT, SEP = 2, 4, 6, 0  # even codes under 8, words above; one more for title case


def _word(low: str) -> int:
    return (xxhash.xxh64_intdigest(low.encode(), 1) >> 4 | 8) << 1


class _Codes(dict):
    """token -> code * 2 + (title case)."""

    def __missing__(self, t: str) -> int:
        low = t.lower()
        if t[0] in SEPARATORS:
            c = SEP
        elif t[0].isdecimal():
            c = NUM
        else:
            c = (UNIT if low in UNITS else _word(low)) | (t[0].isupper() and t != t.upper())
        if len(self) > CACHE:
            self.clear()
        self[t] = c
        return c


class Tokens:
    """The tokens of some texts in a row, with a separator after each text, and their template codes.

    codes and at hold, for each reading, the template codes and their places in the token list: with title-case words
    that begin a sentence taken as words and, if there are any, with those taken as names (of one word each).
    """

    def __init__(self, texts: list[str], known: _Codes):
        self.tokens, sizes = [], []
        for t in texts:
            self.tokens += TOKEN.findall(t)
            self.tokens.append("\n")
            sizes.append(len(self.tokens))
        n = len(self.tokens)
        self.text = np.repeat(np.arange(len(texts)), np.diff(sizes, prepend=0))
        c = np.fromiter(map(known.__getitem__, self.tokens), np.int64, n)
        title, plain, sep = c & 1 == 1, c & ~1, c == SEP
        first = np.concatenate([[True], sep[:-1]])
        self.sentence, self.begins = np.cumsum(sep), title & first
        self.codes, self.at = [], []
        for names in (title & ~first, title) if self.begins.any() else (title,):
            r = np.where(names, NAME, plain)
            stay = ~sep
            stay[1:] &= ~((r[1:] == NAME) & (r[:-1] == NAME) & ~first[:-1])
            at = np.flatnonzero(stay)
            self.codes.append(r[at])
            self.at.append(at)

    def starts(self, reading: int) -> np.ndarray:
        """For each text, the number of codes before it."""
        return np.searchsorted(self.text[self.at[reading]], np.arange(self.text[-1] + 1))


def _mixed(c: np.ndarray, starts: np.ndarray | None, width: int, seed: int) -> np.ndarray:
    """Hashes of the windows at the starts, of all if there are none given."""
    u = c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n = len(c) - width + 1
    h = np.full(n if starts is None else len(starts), seed, np.uint64)
    for k in range(width):
        h = (h ^ (u[k : k + n] if starts is None else u[starts + k])) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def window_hashes(some: Tokens, reading: int, width: int) -> np.ndarray:
    """The hash of each window: of its template, or of its values if less than half are words; 0 if it can't match."""
    c, at, tokens, sentence = some.codes[reading], some.at[reading], some.tokens, some.sentence
    n = len(c) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if width < LEAST:
        s = sentence[at]
        own = s[: n] == s[width - 1 :]
        own[1:] &= s[: n - 1] != s[1:n]
        own[:-1] &= s[width - 1 : -1] != s[width:]
        h, weak = np.zeros(n, np.int64), np.flatnonzero(own)
    else:
        h = _mixed(c, None, width, width)
        words = np.concatenate([[0], np.cumsum(c > 8)])
        weak = np.flatnonzero(2 * (words[width:] - words[:-width]) < width)
    if len(weak):
        lit, used = c.copy(), np.zeros(len(c) + 1, np.int64)
        np.add.at(used, weak, 1)
        np.add.at(used, weak + width, -1)
        for i in np.flatnonzero((np.cumsum(used)[:-1] > 0) & (c < 8)).tolist():
            lit[i] = _word(_value(c, at, tokens, i))
        h[weak] = _mixed(lit, weak, width, width | 256)
    of = some.text[at]
    h[of[:n] != of[width - 1 :]] = 0
    return h


def _value(c: np.ndarray, at: np.ndarray, tokens: list[str], i: int) -> str:
    if c[i] != NAME:
        return tokens[at[i]].lower()
    end = at[i + 1] if i + 1 < len(at) else len(tokens)
    return " ".join(t for t in tokens[at[i] : end] if t[0] not in SEPARATORS).lower()


def _slots(c: np.ndarray, at: np.ndarray, tokens: list[str], start: int, width: int) -> list[str]:
    return [_value(c, at, tokens, i) for i in range(start, start + width) if c[i] < 8]


class _Known:
    """Which hashes are among some: by a table of bits first, then by a search."""

    def __init__(self, hashes: np.ndarray):
        self.sorted, self.mask = hashes, np.int64((1 << max(16, min(25, (16 * len(hashes)).bit_length()))) - 1)
        self.may = np.zeros(int(self.mask) + 1, bool)
        self.may[hashes & self.mask] = True

    def among(self, h: np.ndarray) -> np.ndarray:
        """Places of the known ones."""
        at = np.flatnonzero(self.may[h & self.mask])
        x = h[at]
        return at[self.sorted[np.minimum(np.searchsorted(self.sorted, x), len(self.sorted) - 1)] == x] if len(x) and len(self.sorted) else at[:0]


WINDOW = "h long, reading int, pos int, place int, width int, n_tokens int, slots array<string>"


def _windows_of(texts: list[str], codes: _Codes, widths: list[int], known: _Known | None, own_width: bool) -> Iterator[tuple]:
    """(text number, h, reading, pos, place, width, n_tokens, slots) of the windows in the texts."""
    some = Tokens(texts, codes)
    begin = [some.starts(k) for k in range(len(some.at))]
    sizes = [np.diff(b, append=len(at)) for b, at in zip(begin, some.at, strict=True)]
    last = len(some.at) - 1
    for reading, at in enumerate(some.at):
        for w in [min(max(widths), len(at))] if own_width else widths:
            if w < 1:
                continue
            h = window_hashes(some, reading, w)
            pos = np.flatnonzero(h) if known is None else known.among(h)
            pos = pos[h[pos] != 0]
            if reading and not own_width and len(pos):  # only where this reading differs
                changed = np.concatenate([[0], np.cumsum(some.begins[at])])
                pos = pos[changed[pos + w] > changed[pos]]
            if not len(pos):
                continue
            text = some.text[at[pos]]
            own = pos - begin[reading][text]
            first = own if own_width else np.searchsorted(some.at[0], at[pos], "right") - 1 - begin[0][text]
            named = np.searchsorted(some.at[last], at[pos], "right") - 1 - begin[last][text]
            for x, p, r, f, g, n in zip(h[pos].tolist(), pos.tolist(), text.tolist(), first.tolist(), named.tolist(), sizes[reading][text].tolist(), strict=True):
                yield r, x, reading, f, g, w, n, _slots(some.codes[reading], at, some.tokens, p, w)


def windows(rows: DataFrame, widths: list[int], known: np.ndarray | None = None, own_width: bool = False) -> DataFrame:
    """(rid, id, text) -> rid, id and WINDOW: the windows of the widths, or of known hashes only.

    own_width: each reading of the text is listed in full, and is one window where it is shorter than the largest width.
    Otherwise a window is listed in the reading with names only if that changes it. pos counts in the first reading,
    place in the one with names; with own_width pos counts in the row's reading.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(known) if known is not None else None
    names, kinds = ["rid", "id", "h", "reading", "pos", "place", "width", "n_tokens", "slots"], (pa.int64(), *[pa.int32()] * 5, pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, known = _Codes(), _Known(shared.value) if shared else None
        for b in batches:
            part, numbers, size = [], [], 0
            for r in range(b.num_rows):
                text = b.column(2)[r].as_py()
                if text:
                    part.append(text)
                    numbers.append(r)
                    size += len(text) // 4
                if part and (size > AT_ONCE or own_width or r == b.num_rows - 1):
                    found = list(_windows_of(part, codes, widths, known, own_width))
                    for k in range(0, len(found), 4096):
                        x = list(zip(*found[k : k + 4096], strict=True))
                        of = pa.array([numbers[i] for i in x[0]], pa.int64())
                        yield pa.record_batch([b.column(0).take(of), b.column(1).take(of), *map(pa.array, x[1:], kinds)], names)
                    part, numbers, size = [], [], 0

    return rows.mapInArrow(run, f"rid long, id long, {WINDOW}")


def _covered(starts: Column, width: Column) -> Column:
    """Tokens under sorted windows, and the longest run of them."""
    zero = F.struct(F.lit(-1_000_000).alias("end"), F.lit(0).alias("n"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, p: Column) -> Column:
        new = p + width - F.greatest(p, s["end"])
        run = F.when(p <= s["end"], s["run"] + new).otherwise(width)
        return F.struct((p + width).alias("end"), (s["n"] + new).alias("n"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(starts, zero, step)


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, run: int = RUN, known_most: int = KNOWN_MOST, sent_most: int = SENT_MOST) -> DataFrame:
    """Rows (rid, id, text) of both sides -> rid, doc_id, item_id, n_windows, coverage, longest_run, n_slots, verbatim: a row for each occurrence."""
    bench = keep(windows(items, [width], own_width=True).dropDuplicates(["rid", "reading", "h", "pos"]), "bench_windows")
    widths = sorted(r[0] for r in bench.select("width").distinct().collect())  # at most `width` of them
    hashes = bench.select("h").distinct()
    known = None
    if hashes.limit(known_most + 1).count() <= known_most:
        known = np.array(sorted(r[0] for r in hashes.collect()), np.int64)
    schema = "rid long, doc_id long, item_id long, n_windows long, coverage double, longest_run int, n_slots int, verbatim boolean"
    if not widths:
        return docs.sparkSession.createDataFrame([], schema)
    ours = windows(docs, widths, known).select("rid", F.col("id").alias("doc_id"), "h", F.col("pos").alias("first"), F.col("place").alias("named"), F.col("slots").alias("theirs"))
    theirs = bench.select("h", F.col("rid").alias("item_rid"), F.col("id").alias("item_id"), "reading", "pos", "width", "n_tokens", "slots")
    if bench.limit(sent_most + 1).count() <= sent_most:
        hits = ours.join(F.broadcast(theirs), "h")
    else:
        salted = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = ours.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"]).drop("salt")
    one_to_one = lambda p: (F.size(F.array_distinct(F.transform(p, lambda x: x["a"]))) == F.size(p)) & (F.size(F.array_distinct(F.transform(p, lambda x: x["b"]))) == F.size(p))
    pairs = F.array_distinct(F.zip_with("slots", "theirs", lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    # a window that contradicts itself counts, too: against its occurrence
    hits = hits.where(F.size("slots") == F.size("theirs")).withColumn("pairs", pairs)
    # occurrences: one offset, offsets with no wider step than a fraction of the item, the whole document
    key = ["rid", "doc_id", "item_rid", "item_id", "reading"]
    order = W.partitionBy(*key).orderBy("offset")
    hits = hits.withColumn("offset", F.when(F.col("reading") == 0, F.col("first")).otherwise(F.col("named")) - F.col("pos"))
    hits = hits.withColumn("step", (F.col("offset") - F.lag("offset").over(order) > F.greatest(F.lit(2), F.col("n_tokens") / STEP)).cast("int"))
    hits = hits.withColumn("band", F.coalesce(F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    occurrence = F.array(F.struct(F.lit(0).alias("kind"), F.col("offset").cast("long").alias("n")), F.struct(F.lit(1).alias("kind"), F.col("band").cast("long").alias("n")), F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("n")))
    hits = hits.withColumn("occurrence", F.explode(occurrence))
    by = hits.groupBy(*key, "occurrence").agg(F.array_sort(F.collect_set("pos")).alias("at"), F.max("width").alias("width"), F.max("n_tokens").alias("n_tokens"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    by = by.withColumn("c", _covered(F.col("at"), F.col("width")))
    by = by.where(one_to_one("pairs")).select("rid", "doc_id", "item_id", F.size("at").cast("long").alias("n_windows"), F.round(F.col("c.n") / F.col("n_tokens"), 4).alias("coverage"), F.col("c.best").alias("longest_run"),
                   F.size("pairs").alias("n_slots"), (F.size(F.filter("pairs", lambda p: p["a"] != p["b"])) == 0).alias("verbatim"))
    return by.where((F.col("coverage") >= share) | (F.col("longest_run") >= run))


def _rows(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.monotonically_increasing_id().alias("rid"), F.col(name).cast("long").alias("id"), "text")


def op9(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item it leaks, with the figures of the best copy."""
    found = leaks(_rows(docs, "doc_id"), _rows(items, "item_id"))
    best = F.max(F.struct("coverage", "longest_run", "n_windows", "verbatim")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.coverage", "b.longest_run", "b.n_windows", "b.verbatim")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that leak an item. A copy with a row number is written first, so rows with null or repeated ids are told apart."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # names of its own can't clash with the row number
    rows = keep(docs.toDF(*inner).withColumn("rid", F.monotonically_increasing_id()), "rows")
    texts = rows.select("rid", F.col(inner[names.index("doc_id")]).cast("long").alias("id"), F.col(inner[names.index("text")]).alias("text"))
    bad = keep(leaks(texts, _rows(items, "item_id")).select("rid").distinct(), "leaks")
    return rows.join(bad, "rid", "left_anti").select(*inner).toDF(*names)
