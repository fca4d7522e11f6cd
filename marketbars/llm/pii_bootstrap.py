"""Personal data: four base kinds by pattern, and more by bootstrapped contextual extraction.

Base spans are seeds. Every text is also searched for loose mentions, which look like a kind but fail its rule (a number
without its plus, a card number with a wrong check digit, an address without a dot), and for secrets (keys and tokens),
a kind without base spans whose seeds are strings of a well-known shape. Mentions and the lexical patterns around them
make a bipartite graph; a pattern is made of whole words with the signs between: the word before, the two before, the
word before and the one after, the word after. What else holds a digit or an at sign and stands in a pattern counts as a
wrong instance, as do mentions of other kinds; a loose mention of the kind that isn't trusted (yet) counts `doubt` of one.

In each round Spark scores every pattern and kind by the Wilson lower bound of the share of its distinct values that are
trusted: patterns of at least `support` trusted values that reach `bar` are accepted, and the score of a value is that of
its best accepted pattern. Values with a score are trusted in the next round; it ends when a round finds none, after
`rounds` at most. Every mention of such a value, wherever it stands, is a span of its kind. Base spans always stay; a
string that only has the shape of a secret is no span unless a pattern vouches for its value.

Hot patterns and values: patterns are counted after map-side folding of their distinct values; base values, which are
trusted from the start, take no part in the joins by value, and those that do are salted.

Cases: null text is empty and has no spans; repeated rows and repeated ids each get their row; ties in start are
ordered by kind as listed; an empty table gives an empty result; other columns of the input are kept by redact() and
not looked at; texts are searched whole, in time linear in their length. A context of over `LONGEST` characters (a word
without blanks) is known by its hash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep

#: The base kinds as listed in the contract, then the kind that only contexts can tell.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
ROUNDS, SUPPORT, BAR, DOUBT, Z = 4, 5, 0.7, 0.25, 1.64
SALTS = 16
LONGEST = 64

#: The base patterns. A dotted number can only begin where a run of digits begins, so the look-behind changes no match.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
DIGITS_RUN = re.compile(r"[0-9]+")

#: What looks like a kind. None starts or ends inside a longer run of letters and digits.
LOOSE = {
    "email": re.compile(r"(?<![^\s<(\[\"'])[A-Za-z0-9._%+-]{1,64}(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}){0,8}"),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w.])"),
    "card": re.compile(r"(?<!\w)[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{2,7}(?!\w)"),
    "phone": re.compile(r"(?<!\w)(?=(?:[^0-9]?[0-9]){7})(?:[0-9]{1,3}[ .-])?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)"),
    "secret": re.compile(r"(?<![\w+/=-])(?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])[A-Za-z0-9_+/=-]{8,}(?![\w+/-])"),
}
#: Shapes of keys and tokens, the seeds of secrets: long hexadecimal digests and well-known prefixes.
SECRET = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{20,}")
AT, DOT = re.compile(r"[\[(]at[\])]"), re.compile(r"[\[(]dot[\])]")
WORD = re.compile(r"\w+")
BLANK = re.compile(r"\s+")
#: Anything else that a pattern may hold in place of a mention.
_PART = r"\s\"'<>()\[\]{},;:=|"
OTHER = re.compile(rf"(?<![^{_PART}])[^{_PART}0-9@]*+[0-9@][^{_PART}]*+")

SPAN = "struct<kind:int,start:int,end:int>"
_INT, _LONG = T.IntegerType(), T.LongType()
MENTION = T.ArrayType(T.StructType([*(T.StructField(k, _INT) for k in ("kind", "start", "end")), *(T.StructField(k, T.BooleanType()) for k in ("base", "seed")), T.StructField("value", _LONG), T.StructField("patterns", T.ArrayType(T.StringType()))]))
WRONG = T.ArrayType(T.StructType([T.StructField("value", _LONG), T.StructField("patterns", T.ArrayType(_LONG))]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in order of start, then kind."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1  # no match can hold this sign
            at = text.find("@", free)
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGITS.sub("", m[0])) <= 15]
    return sorted(out, key=lambda x: (x[1], x[0], x[2]))


def _hash(x: str) -> int:
    """As F.xxhash64 has it."""
    h = xxhash.xxh64_intdigest(x.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def _norm(x: str) -> str:
    x = DIGITS_RUN.sub("0", BLANK.sub("", x).lower())
    return x if len(x) <= LONGEST else f"~{_hash(x):x}"


class _Context:
    """The words of a text, for the patterns around its mentions."""

    def __init__(self, text: str):
        self.text, at = text, [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in at], [b for _, b in at]

    def patterns(self, start: int, end: int) -> list[str]:
        """A side without a word gives none."""
        i = bisect_right(self.ends, start) - 1
        j = bisect_right(self.starts, end - 1)
        left = _norm(self.text[self.starts[i] : start]) if i >= 0 else ""
        right = _norm(self.text[end : self.ends[j]]) if j < len(self.ends) else ""
        out = [f"{_norm(self.text[self.starts[i - 1] : self.starts[i]])} {left} _"] if i > 0 else []
        out += [f"{left} _"] if left else []
        out += [f"{left} _ {right}"] if left and right else []
        return out + ([f"_ {right}"] if right else [])


def _value(kind: int, text: str) -> int:
    """Mentions of one value have one hash: numbers by their digits, addresses with their signs, all in lower case without blanks."""
    if KINDS[kind] in ("card", "phone"):
        return _hash(f"{kind}:{DIGITS.sub('', text)}")
    low = BLANK.sub("", text).lower()
    return _hash(f"{kind}:{DOT.sub('.', AT.sub('@', low)) if KINDS[kind] == 'email' else low}")


def mentions(text: str) -> tuple[list[tuple], list[tuple]]:
    """Tuples like MENTION (base spans, and loose mentions that overlap none of them) and like WRONG (what else may stand in a pattern)."""
    rows = [(k, s, e, True) for k, s, e in base_spans(text)]
    taken = sorted((s, e) for _, s, e, _ in rows)

    def free(pattern: re.Pattern) -> list[tuple[int, int]]:
        nonlocal taken
        out, i = [], 0
        for m in pattern.finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if i == len(taken) or taken[i][0] >= m.end():
                out.append(m.span())
        taken = sorted(taken + out)
        return out

    for k, kind in enumerate(KINDS):
        if kind != "email" or "@" in text or "at]" in text or "at)" in text:
            rows += [(k, s, e, False) for s, e in free(LOOSE[kind])]
    others = free(OTHER)
    if not rows and not others:
        return [], []
    around = _Context(text)
    named = [(k, s, e, b, b or KINDS[k] == "secret" and SECRET.fullmatch(text, s, e) is not None, _value(k, text[s:e]), around.patterns(s, e)) for k, s, e, b in rows]
    return named, [(_hash(text[s:e].lower()), [_hash(p) for p in around.patterns(s, e)]) for s, e in others]


MENTIONS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("seed", pa.bool_()), ("value", pa.int64()), ("patterns", pa.list_(pa.string()))]))
WRONGS = pa.list_(pa.struct([("value", pa.int64()), ("patterns", pa.list_(pa.int64()))]))
MAY_HOLD = re.compile(r"[0-9@]|[\[(]at[\])]")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs, mentions (array of MENTION) and wrong (array of WRONG)."""
    names = [f.name for f in MENTION.elementType.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, wrong = [], []
            for t in b.column(b.schema.get_field_index(text)):
                s = t.as_py()
                some, others = mentions(s) if s and MAY_HOLD.search(s) else ([], [])
                found.append([dict(zip(names, m, strict=True)) for m in some])
                wrong.append([{"value": v, "patterns": p} for v, p in others])
            yield pa.record_batch([*b.columns, pa.array(found, MENTIONS), pa.array(wrong, WRONGS)], [*b.schema.names, "mentions", "wrong"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("mentions", MENTION), T.StructField("wrong", WRONG)]))


def _wilson(pos: Column, n: Column, z: float = Z) -> Column:
    p = pos / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


class Graph:
    """Patterns and values of the mentions of all documents (columns mentions and wrong), written once.

    edges: pattern, kind, value, seed - each once; seeds: for each pattern that may ever be accepted (it has `support`
    values of one kind) and kind the distinct seeds, values of the kind, and wrong instances; twins: loose values equal to
    a base value.
    """

    def __init__(self, found: DataFrame, support: int):
        m = found.select(F.explode("mentions").alias("m")).select("m.kind", "m.value", "m.seed", F.explode("m.patterns").alias("pattern"))
        edges = keep(m.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed")), "pii_edges")
        counts = edges.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("seed").alias("seeds"))
        likely = counts.groupBy("pattern").agg(F.max("n").alias("most"), F.sum("n").alias("known")).where(F.col("most") >= support).select("pattern", "known", F.xxhash64("pattern").alias("p"))
        likely = keep(likely, "pii_likely")
        w = found.select(F.explode("wrong").alias("w")).select("w.value", F.explode("w.patterns").alias("p"))
        wrong = w.join(likely.select("p"), "p", "left_semi").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("wrong"))
        totals = likely.join(wrong, "p", "left").select("pattern", (F.col("known") + F.coalesce("wrong", F.lit(0))).alias("total"))
        each = m.select("kind", "value", "seed").distinct()
        self.twins = keep(each.where("NOT seed").join(each.where(F.col("seed") & (F.col("kind") < len(BASE))), ["kind", "value"], "left_semi").select("kind", "value", F.lit(1.0).alias("score")), "pii_twins")
        self.edges = keep(edges.join(likely.select("pattern"), "pattern", "left_semi"), "pii_edges")
        self.seeds = keep(counts.join(totals, "pattern").select("pattern", "kind", "seeds", "n", (F.col("total") - F.col("n")).alias("wrong")), "pii_patterns")


def bootstrap(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, bar: float = BAR, doubt: float = DOUBT) -> tuple[DataFrame, DataFrame]:
    """Accepted patterns (kind, pattern, trusted, wrong, score) and the values they vouch for (kind, value, score), but for base values."""
    graph = Graph(found, support)
    loose = graph.edges.where("NOT seed").select("pattern", "kind", "value")
    values, known = graph.twins, graph.twins.count()
    for _ in range(rounds):
        more = loose.join(values, ["kind", "value"], "left_semi").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("more"))
        pos = graph.seeds.join(more, ["pattern", "kind"], "left").withColumn("trusted", F.col("seeds") + F.coalesce("more", F.lit(0)))
        judged = F.col("trusted") + F.col("wrong") + doubt * (F.col("n") - F.col("trusted"))
        scored = pos.where(F.col("trusted") >= support).withColumn("score", _wilson(F.col("trusted"), judged))
        good = keep(scored.where(F.col("score") >= bar).select("kind", "pattern", "trusted", "wrong", "score"), "pii_patterns")
        vouched = graph.edges.where(~F.col("seed") | (F.col("kind") >= len(BASE))).join(good.select("kind", "pattern", "score"), ["kind", "pattern"])
        values = keep(vouched.select("kind", "value", "score").union(graph.twins).groupBy("kind", "value").agg(F.max("score").alias("score")), "pii_values")
        was, known = known, values.count()
        if known == was:
            break
    return good, values


def discovered(found: DataFrame, values: DataFrame) -> DataFrame:
    """rid and extra (array of SPAN): the mentions of the values. A value of very many mentions is dealt over SALTS tasks."""
    loose = found.select("rid", F.explode(F.filter("mentions", lambda m: ~m["base"])).alias("m")).select("rid", "m.kind", "m.start", "m.end", "m.value", F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt"))
    salted = values.select("kind", "value", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = loose.join(salted, ["kind", "value", "salt"], "left_semi").select("rid", F.struct("kind", "start", "end").alias("s"))
    return hits.groupBy("rid").agg(F.collect_set("s").alias("extra"))


def _ordered(a: Column) -> Column:
    """Spans by start, then kind."""
    sorted_ = F.array_sort(F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.transform(sorted_, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_entities(docs: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The columns of docs, then base and spans (arrays of SPAN, in order). A copy of docs with its mentions is written on the way."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]  # names of its own can't clash with these
    found = keep(scan(docs.toDF(*inner), inner[names.index(text)]).withColumn("rid", F.monotonically_increasing_id()), "pii_found")
    extra = discovered(found, bootstrap(found, **settings)[1])
    base = F.filter("mentions", lambda m: m["base"])
    more = F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))
    base = F.transform(base, lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    # only texts with a loose mention can get a span by the method; the others take no part in the join
    loose = F.exists("mentions", lambda m: ~m["base"])
    plain = found.where(~loose).withColumn("extra", F.lit(None).cast(f"array<{SPAN}>"))
    return plain.unionByName(found.where(loose).join(extra, "rid", "left")).select(*inner, _ordered(base).alias("base"), _ordered(F.concat(base, more)).alias("spans")).toDF(*names, "base", "spans")


def mask(text: str, spans: list[dict]) -> str:
    """text with each span (in order) replaced by its kind; overlapping spans go as one."""
    parts, done = [], 0
    for x in spans:
        if x["start"] >= done:
            parts += [text[done : x["start"]], f"<{KINDS[x['kind']].upper()}>"]
        done = max(done, x["end"])
    return "".join(parts) + text[done:]


def redact(docs: DataFrame, **settings) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; n_chars follows where there is such a column."""
    names, k = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns[:-1])
            cols[k] = pa.array([t.as_py() and mask(t.as_py(), s.as_py() or []) for t, s in zip(b.column(k), b.column(len(cols)), strict=True)], pa.string())
            yield pa.record_batch(cols, names)

    marked = find_entities(docs, **settings)
    inner = [f"c{i}" for i in range(len(names))]
    out = marked.toDF(*inner, "base", "spans").select(*inner, "spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if names.count("n_chars") == 1 else out


def _joined(c: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def op4(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = keep(scan(rows).drop("text").withColumn("rid", F.monotonically_increasing_id()), "pii_found")
    extra = discovered(found, bootstrap(found)[1])
    base = F.transform(F.filter("mentions", lambda m: m["base"]), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    more = F.coalesce("extra", F.array().cast(f"array<{SPAN}>"))
    both = found.join(extra, "rid", "left").select("doc_id", _ordered(base).alias("base"), _ordered(F.concat(base, more)).alias("spans"))
    kinds = F.transform("base", lambda s: s["kind"])
    number = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return both.select("doc_id", *number, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
