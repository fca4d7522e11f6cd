"""The numbered operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketbars.llm import chat_rotation, decontaminate, language_id, license_scan, pii_bootstrap, quality_rules, sentencepiece_codec, simhash, suffix_dedup, warc_zstd

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randint(1, 4)))
    prose = lambda n: " ".join(["the", "and", "of"][rnd.randrange(3)] if rnd.random() < 0.3 else word() for _ in range(n))
    base = [prose(n) for n in (5, 30, 60, 90, 120, 200, 300)]
    texts = [*base, base[3], base[4] + " tail", base[5].replace("the", "then", 1), base[2] + "\n" + base[2], None, "", " \t\n", "x", "###", base[6][:300] + prose(40), "a\nb\na\nb\na\n" + base[1], "l " * 500, prose(8000), base[1].upper(), "é ü ñ " * 20]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base[3], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), DOCS)
    return df.withColumns({k: df["doc_id"] for k in ("words", "t", "rid", "mentions", "spans", "row", "fp", "key", "w", "u", "lines", "base", "c0")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def same(got: list, expected: list) -> None:
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_quality_rules_base(docs, empty):
    out = []
    for i, t, *_ in corpus():
        t = t or ""
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        at = {p for k, x in enumerate(windows) if n[x] > 1 for p in range(k, k + 5)}
        out.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(at), len(w) < 10 or 100 * len(at) > 20 * len(w)))
    rows = quality_rules.op7(docs).collect()
    same([tuple(r)[:7] for r in rows], out)
    assert all(not r.kept for r in rows if r.base_failed)
    assert quality_rules.op7(empty).collect() == []
    assert quality_rules.passing(empty).collect() == []


def test_quality_rules_verdict_takes_effect(docs):
    verdict = {(r.doc_id, r.n_words, r.word_chars) for r in quality_rules.op7(docs).where("kept").collect()}
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, len(WORDS.findall(r.text)), sum(map(len, WORDS.findall(r.text)))) for r in kept.collect()} == verdict
    assert 5 in {v[0] for v in verdict} and 15 not in {v[0] for v in verdict}


def test_sentencepiece_equals_library(spark, docs, empty):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    odd = ["▁x", "x ▁ y", " ", "  a  b ", "a\x00b", "a　b", "①", "end ", "▁", "𝔘 ▁▁ z", "\n\n x"]
    rows = corpus() + [(100 + i, t, None, None, None) for i, t in enumerate(odd)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = [(i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for i, t, *_ in rows for ids in [sp.encode(t or "")]]
    df = spark.createDataFrame(rows, DOCS)
    for size in (3, 300_000):  # a table that is emptied again and again changes nothing
        same([tuple(r) for r in sentencepiece_codec.op6(df, model, size).collect()], expected)
    full = sentencepiece_codec.encode_documents(df, model).collect()
    same([(r.doc_id, r.ids, r.decoded) for r in full], [(i, sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t, *_ in rows])
    assert sentencepiece_codec.op6(empty, model).collect() == []


def brute_fingerprint(text: str | None, width: int = 4) -> int:
    import xxhash

    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]).encode(), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: list[int], radius: int = 4) -> list[int]:
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= radius) for a in fps]
        if new == label:
            return label
        label = new


def test_simhash_groups(spark, docs, empty):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    label = components(fps)
    least = {}
    for (i, *_), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    expected = [(i, f"{f:016x}", least.get(x)) for (i, *_), f, x in zip(rows, fps, label, strict=True)]
    same([tuple(r) for r in simhash.op8(docs).collect()], expected)
    assert simhash.op8(empty).collect() == []


@pytest.mark.parametrize("bucket", [4096, 3])
def test_simhash_links_are_complete(spark, bucket):
    """Chains of near fingerprints: all links are found, also where buckets are beyond their bound."""
    rnd = random.Random(1)
    fps = set()
    for _ in range(40):
        f = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 12)):
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.group(df, 4, bucket).collect()}
    assert [got[i] for i in range(len(fps))] == components(fps)


def test_covering_masks_guarantee():
    masks = simhash.covering_masks(4)
    rnd = random.Random(2)
    for _ in range(2000):
        diff = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4)))
        assert any(not diff & (m % 2**64) for m in masks)


def brute_similar(texts: list[str | None]) -> list[int]:
    """Component labels: texts link at a Jaccard similarity of 0.8 or more of their distinct five-word shingles."""
    sets = []
    for t in texts:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and 10 * len(x & sets[j]) >= 8 * len(x | sets[j]):
                label = [label[j] if v == label[i] else v for v in label]
    return label


def edited(seed: int) -> list[tuple]:
    """Families of texts with few and many edited words, and a chain in which neighbours alone are similar."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9)))
    texts = []
    for family in range(12):
        base = [word() for _ in range(rnd.choice([40, 80, 200]))]
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 6, 15):
            new = list(base)
            for at in rnd.sample(range(len(new)), edits):
                new[at] = word()
            texts.append(" ".join(new))
            if family == 0:
                base = new
    return [(1000 + i, t, None, None, None) for i, t in enumerate(texts)]


def test_deduplicate_keeps_one_of_each_group(spark, docs, empty, monkeypatch):
    def expected(rows: list[tuple]) -> list[tuple]:
        best = {}
        for k, ((i, *_), x) in enumerate(zip(rows, brute_similar([r[1] for r in rows]), strict=True)):
            best[x] = min(best.get(x, (True, 0, k)), (i is None, i or 0, k))
        return [rows[k][:2] for *_, k in best.values()]

    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text) for r in kept.collect()], expected(corpus()))
    assert simhash.deduplicate(empty).collect() == []
    rows = edited(1) + edited(2)
    df = spark.createDataFrame(rows, DOCS)
    same([(r.doc_id, r.text) for r in simhash.deduplicate(df).collect()], expected(rows))
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 2)  # groups over several blocks
    same([(r.doc_id, r.text) for r in simhash.deduplicate(df).collect()], expected(rows))


def block_edited() -> list[tuple]:
    """Pairs at a Jaccard of 0.79 to 0.95: a tail added, a tail cut, a block in the middle replaced."""
    rnd = random.Random(11)
    words = lambda n: ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(n)]
    texts = []
    for j in (0.79, 0.8, 0.81, 0.82, 0.84, 0.87, 0.91, 0.95):
        for n in (60, 150, 400):
            a, b, c = words(n), words(n), words(n)
            added, cut, middle = round(n * (1 / j - 1)), round(n * (1 - j)), round(n * (1 - j) / (1 + j))
            texts += [a, a + words(added), b, b[: n - cut], c, c[: n // 3] + words(middle) + c[n // 3 + middle :]]
    return [(1000 + i, " ".join(t), None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("bucket", [2, 4096])
def test_deduplicate_finds_block_edits(spark, bucket, monkeypatch):
    rows = block_edited()
    label = brute_similar([r[1] for r in rows])
    assert len(rows) // 2 < len(set(label)) < 3 * len(rows) // 4  # most pairs, not all
    df = spark.createDataFrame(rows, DOCS)
    expected = sorted(rows[label.index(x)][0] for x in set(label))
    assert sorted(r.doc_id for r in simhash.deduplicate(df, bucket=bucket).collect()) == expected
    monkeypatch.setattr(simhash, "SAMPLE", 1)  # shingles of two texts are hot, each in several blocks
    monkeypatch.setattr(simhash, "HOT_LEAST", 2)
    pairs = simhash.prefixes
    monkeypatch.setattr(simhash, "prefixes", lambda *args: pairs(*args, block=1))
    assert sorted(r.doc_id for r in simhash.deduplicate(df, bucket=bucket).collect()) == expected


def brute_strip(texts: list[str | None], least: int) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    n = Counter(d[i : i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if n[d[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [3 << 18, 250])
def test_suffix_dedup(spark, docs, empty, crowd):
    rows = corpus() + [(200 + i, f"start {i} " + "shared passage " * 3 + "of some words that many documents hold, " * 4 + f"and its own end {i * 7919}", None, None, None) for i in range(40)]
    expected = [(r[0], *x) for r, x in zip(rows, brute_strip([r[1] for r in rows], 200), strict=True)]
    df = spark.createDataFrame(rows, DOCS)
    same([tuple(r) for r in suffix_dedup.strip_repeats(df, crowd=crowd, chunk=2000, digest=True).collect()], expected)
    if crowd > 1000:
        same([tuple(r)[0] for r in suffix_dedup.op5(docs).collect()], [r[0] for r in corpus()])
        assert suffix_dedup.op5(empty).collect() == []


def test_index_equals_counting():
    rng = np.random.default_rng(0)
    for least in (4, 9, 20):
        for _ in range(25):
            parts = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(least, 70)).astype(np.uint8)) for _ in range(rng.integers(1, 10))]
            n = Counter(p[i : i + least] for p in parts for i in range(len(p) - least + 1))
            assert [x.tolist() for x in suffix_dedup.repeated_places(parts, least)] == [[n[p[i : i + least]] > 1 for i in range(len(p) - least + 1)] for p in parts]


def test_blocks_of_long_texts(monkeypatch):
    """A text cut in blocks has all its places in segments, once each."""
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    data = bytes(np.random.default_rng(1).integers(97, 110, 3000).astype(np.uint8))
    places = [p for s, n, _ in suffix_dedup.segments(data) for a, b in zip(s, n, strict=True) for p in range(a, a + b)]
    assert places == list(range(3000 - 199))


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([ -]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][ ().0-9-]+[0-9]"),
}


def brute_spans(t: str) -> list[tuple]:
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    fine = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda m: 14 <= len(digits(m)) <= 19 and pii_bootstrap.luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(BASE.items()) for m in p.finditer(t) if fine[kind](m))


ODD = ["a@b@c.de x.y+z@q-r.co.uk. @ @@a.b", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.003.0004 ..1.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 12", "+1 (017) 555-7713 +1+2 +12345678901234567 +4 4 4 4 4 4 4 4 4 4 4", "é+1 212 555 0100@a.bc", "9" * 5000, "a" * 3000 + "@x.y", "+1" * 500]


def test_pii_base(spark, docs, empty):
    assert pii_bootstrap.luhn("4111111111111111") and not pii_bootstrap.luhn("4111111111111112")
    rnd = random.Random(3)
    noise = ["".join(rnd.choice("a1.2@-+ 3(4)5,x") for _ in range(200)) for _ in range(60)]
    rows = corpus() + [(300 + i, t, None, None, None) for i, t in enumerate(ODD + noise)]
    expected = []
    for i, t, *_ in rows:
        spans = brute_spans(t or "")
        n = Counter(k for _, k, _ in spans)
        text = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in spans)
        expected.append((i, n[0], n[1], n[2], n[3], hashlib.sha256(text.encode()).hexdigest()))
    got = pii_bootstrap.op4(spark.createDataFrame(rows, DOCS)).collect()
    same([tuple(r)[:6] for r in got], expected)
    assert pii_bootstrap.op4(empty).collect() == []


def test_pii_bootstrap_finds_unseen_identifiers(spark):
    """`call me at:` is learned from true phone numbers and then finds one without its plus; a context of no use finds none."""
    rows = [(i, f"text {i} please call me at: +1 212 555 {1000 + i} today", None, None, None) for i in range(20)]
    rows += [(50 + i, f"item {i} order number was 555 {1000 + i} {2000 + i} here", None, None, None) for i in range(20)]
    rows.append((99, "so call me at: 212 555 7788 now", None, None, None))
    df = spark.createDataFrame(rows, DOCS)
    spans = {r.doc_id: r.spans for r in pii_bootstrap.op4(df).collect()}
    assert spans[99] == "phone:15:27"
    assert all(spans[50 + i] == "" for i in range(20))
    clean = {r.doc_id: r for r in pii_bootstrap.redact(df).collect()}
    assert clean[99].text == "so call me at: <PHONE> now" and clean[99].n_chars == len(clean[99].text)
    assert clean[0].text == "text 0 please call me at: <PHONE> today"


def brute_bootstrap(texts: list[str], rounds: int = 4, support: int = 5, bar: float = 0.7, doubt: float = 0.25, z: float = 1.64) -> set[tuple]:
    """(kind, value) of what the patterns vouch for, by plain loops over sets."""
    found = [pii_bootstrap.mentions(t or "") for t in texts]
    fill, seeds, loose, base = {}, {}, {}, set()
    for named, others in found:
        for k, _, _, b, seed, v, patterns in named:
            base |= {(k, v)} if b else set()
            for p in patterns:
                fill.setdefault(p, set()).add((k, v))
                seeds.setdefault((p, k), set()).update([v] if seed else [])
        for v, patterns in others:
            for h in patterns:
                fill.setdefault(h, set()).add(("other", v))
    for named, _ in found:
        for k, _, _, b, seed, v, patterns in named:
            if not b:
                loose.setdefault((k, v), set()).update(patterns)
    trusted = twins = {x for x in loose if x in base}
    for _ in range(rounds):
        good = set()
        for p, k in seeds:
            pos = len(seeds[p, k] | {v for kk, v in trusted if kk == k and (k, v) in fill[p]})
            own = sum(kk == k for kk, _ in fill[p])
            n = pos + len(fill[p]) - own + len(fill.get(pii_bootstrap._hash(p), ())) + doubt * (own - pos)
            low = (pos / n + z * z / (2 * n) - z * ((pos / n) * (1 - pos / n) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            good |= {(p, k)} if pos >= support and low >= bar else set()
        new = twins | {(k, v) for (k, v), patterns in loose.items() if any((p, k) in good for p in patterns)}
        if new == trusted:
            break
        trusted = new
    return trusted


def planted() -> tuple[list[str], dict[int, tuple[int, int]]]:
    """Texts with true identifiers in telling contexts, and others that lack what their kind demands (with their places); no noise that helps."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    phone = lambda: f"{rnd.randint(200, 989)} 555 {rnd.randint(1000, 9999)}"
    key = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    cues = {"phone": [("call me at:", "+1 "), ("my mobile number is", "+1 ")], "secret": [('api_key = "', ""), ("password:", "")]}
    texts, hidden = [], {}
    for kind, some in cues.items():
        for cue, plus in some:
            for i in range(30):
                unseen = i % 3 == 2
                value = (phone() if kind == "phone" else "Zq7-" + key(12)) if unseen else plus + phone() if kind == "phone" else "a1" + key(38)
                head = f"{word()} {word()} {cue} "
                if unseen:
                    hidden[len(texts)] = (len(head), len(head) + len(value))
                texts.append(f"{head}{value} {word()}")
    return texts, hidden


def test_pii_bootstrap_recall_and_false_spans(spark):
    texts, hidden = planted()
    clean = [f"the order {i} of 2019-03-{10 + i} had {i * 37} parts, lot A{i}77B{i}9, see page {300 + i}" for i in range(40)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts + clean)], DOCS)
    rows = pii_bootstrap.op4(df).collect()
    found = {(r.doc_id, tuple(map(int, x.split(":")[1:]))) for r in rows for x in r.spans.split(",") if x}
    caught = [i for i, x in hidden.items() if (i, x) in found]
    assert len(hidden) == 40 and len(caught) >= 0.9 * len(hidden)
    assert not [r for r in rows if r.doc_id >= len(texts) and r.spans]


def test_pii_bootstrap_equals_loops(spark):
    texts, _ = planted()
    rnd = random.Random(9)
    mixed = ["".join(rnd.choice(["call me at: ", "the ", "+1 212 555 7788", "212 555 7788", "555 123 4567", "17 ", "password: ", "b" * 3 + "0123456789abcdef" * 2, "x9y8z7w6", " and ", "a@b.co", "a [at] b [dot] co", "1.2.3.4 "]) for _ in range(12)) for _ in range(120)]
    everything = [*texts, *mixed, *ODD, None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(everything)], "doc_id long, text string")
    found = pii_bootstrap.keep(pii_bootstrap.scan(df).drop("text"), "found")
    for settings in ({}, {"support": 2, "bar": 0.4}, {"support": 1, "bar": 0.2, "rounds": 6}):
        expected = brute_bootstrap(everything, **settings)
        got = {(r.kind, r.value) for r in pii_bootstrap.bootstrap(found, **settings)[1].collect()}
        assert got == expected and expected
    assert pii_bootstrap.bootstrap(found.limit(0))[0].collect() == []


def test_pii_trusted_value_is_found_wherever_it_stands(spark):
    rows = [(i, f"text {i} please call me at: +1 212 555 {1000 + i} today") for i in range(20)]
    rows += [(99, "so call me at: 212 555 7788 now"), (100, "it was 212-555-7788, they said"), (101, "order 212 555 9999 of them"), (102, "known as (212) 555 1003"), (103, "1 212 555 1003 again")]
    spans = {r.doc_id: r.spans for r in pii_bootstrap.op4(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[99] == "phone:15:27" and spans[100] == "phone:7:19" and spans[101] == ""
    assert spans[103] == "phone:0:14"  # the digits of a base value


def test_redact_keeps_rows_and_columns(docs, empty):
    out = pii_bootstrap.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    same([(r.doc_id, r.text) for r in out.collect()], [x[:2] for x in corpus()])
    assert pii_bootstrap.redact(empty).collect() == []


PASSAGE = "If Anna buys 3 apples and 5 pears for 8 dollars in the small shop near the old station then how many fruits does Anna carry home today"


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "two words"), (5, "One short question of seven plain words"), (1, PASSAGE)], "item_id long, text string")
    again = PASSAGE.replace("Anna", "Bertram").replace("3 apples", "7 apples").replace("5 pears", "9 pears").replace("8 dollars", "16 dollars")
    mixed = PASSAGE.replace("does Anna carry", "does Bertram carry").replace("If Anna", "If Zoe")
    rows = [*corpus(), (400, "Some words. " + PASSAGE + " and more.", None, None, None), (401, "They ask: " + again + ".", None, None, None), (402, "In short. One short question of seven plain words, and so on", None, None, None),
            (403, " ".join(PASSAGE.split()[:9]) + " is another thing altogether that nobody asks here", None, None, None), (404, mixed, None, None, None)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.op9(spark.createDataFrame(rows, DOCS), items).collect()}
    assert set(got) >= {(400, 1), (401, 1), (402, 5)} and not {k for k in got if k[0] not in (400, 401, 402)}
    assert got[400, 1].verbatim and not got[401, 1].verbatim
    assert decontaminate.op9(empty, items).collect() == [] and decontaminate.op9(docs, items.limit(0)).collect() == []
    left = decontaminate.decontaminate(spark.createDataFrame(rows, DOCS), items)
    assert not {400, 401, 402} & {r.doc_id for r in left.collect()} and left.count() == len(corpus()) + 2


def test_decontamination_by_occurrence(spark):
    """A copy and variants of it in one text, or variants alone, don't hide each other; nor does a stray window."""
    again = lambda a, b, c, d: PASSAGE.replace("Anna", a).replace("3 apples", f"{b} apples").replace("5 pears", f"{c} pears").replace("8 dollars", f"{d} dollars")
    variants = [again("Bertram", 7, 9, 16), again("Carla", 11, 4, 23), again("Dora", 2, 6, 31)]
    filler = " Then other things were said by the people who had come along. "
    stray = " ".join(again("Emil", 40, 41, 42).split()[:12])
    texts = [filler.join([PASSAGE, variants[0]]), filler.join(variants), filler.join([variants[0], stray]), filler.join([stray, PASSAGE, variants[1], variants[2]]), " ".join(variants), filler * 3]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.op9(rows, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert got[0].verbatim and got[3].verbatim and not got[1].verbatim


DENSE = ["What is 348 + 129 - 57?", "Compute 12 + 7 * 3 - 4 / 2 and 18 - 6 * 2.", "Tom has 5 apples. Tom gives 2 apples to Ann. Ann eats 1 apple. How many apples are left?", "3, 1, 4, 1, 5, 9, 2, 6, 5, 3", "Boiling point?", "東京タワーの高さは何メートルですか。"]


def test_decontamination_of_dense_named_and_short_items(spark):
    items = spark.createDataFrame(list(enumerate(DENSE)), "item_id long, text string")
    exact = [(i, f"Some words came before it.\n{t}\nOthers came after it.") for i, t in enumerate(DENSE)]
    named = [(20, "They ask: Ruth has 7 apples. Ruth gives 3 apples to Bob. Bob eats 2 apple. How many apples are left? Nobody knew.")]
    other = [(30, "What is 349 + 129 - 57?"), (31, "Compute 12 + 8 * 3 - 4 / 2 and 19 - 6 * 2."), (32, "The boiling point of it is known."), (33, "京都の天気は今日もとても良いです。"), (34, "3, 1, 4, 7, 5, 9, 2, 8, 5, 3")]
    rows = spark.createDataFrame(exact + named + other, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.op9(rows, items).collect()}
    assert got == {(i, i) for i in range(len(DENSE))} | {(20, 2)}


def brute_views(text: str) -> list[list[tuple]]:
    """Both readings of a text as lists of (template, value, sentence, place of the first token)."""
    D = decontaminate
    tokens = [(m[0], m.start()) for m in re.finditer(D.TOKEN, text)]
    out = []
    for names_begin in (False, True):
        view, sentence, first, after_name = [], 0, True, False
        for i, (x, _) in enumerate(tokens):
            low = x.lower()
            if x[0] in D.SEPARATORS:
                sentence, first, after_name = sentence + 1, True, False
                continue
            title = x[0].isupper() and x != x.upper()
            if title and (names_begin or not first):
                kind = "<name>"
            elif x[0].isdecimal():
                kind = "<num>"
            else:
                kind = "<unit>" if low in D.UNITS else low
            if kind == "<name>" and after_name:
                view[-1][1] += " " + low
            else:
                view.append([kind, low, sentence, i])
            after_name = kind == "<name>" and not first
            first = False
        out.append([tuple(v) for v in view])
    starts = {i for i, (x, _) in enumerate(tokens) if x[0].isupper() and x != x.upper() and (i == 0 or tokens[i - 1][0][0] in D.SEPARATORS)}
    return out if starts else out[:1]


def brute_windows(view: list[tuple], w: int) -> dict[int, tuple]:
    """Place of a window -> what must be equal."""
    out = {}
    for i in range(len(view) - w + 1):
        part = view[i : i + w]
        slots = sum(v[0].startswith("<") for v in part)
        if w < 3:
            own = part[0][2] == part[-1][2] and (i == 0 or view[i - 1][2] != part[0][2]) and (i + w == len(view) or view[i + w][2] != part[0][2])
            if own:
                out[i] = ("values", *(v[1] for v in part))
        else:
            out[i] = ("values", *(v[1] for v in part)) if 2 * (w - slots) < w else ("template", *(v[0] for v in part))
    return out


def brute_leaks(docs: list[str], items: list[str], width: int = 8, share: float = 0.5, run: int = 13, step: int = 8) -> set[tuple]:
    found = set()
    for n, item in enumerate(items):
        for reading, view in enumerate(brute_views(item or "")):
            w = min(width, len(view))
            ours = brute_windows(view, w) if w else {}
            for d, text in enumerate(docs):
                hits = []
                views = brute_views(text or "")
                for k, theirs in enumerate(views):
                    for i, x in brute_windows(theirs, w).items() if w else ():
                        if k and theirs[i : i + w] == [v for v in views[0] if theirs[i][3] <= v[3] <= theirs[i + w - 1][3]]:
                            continue  # listed in the first reading
                        base = views[0] if reading == 0 else views[-1]
                        place = max(j for j, v in enumerate(base) if v[3] <= theirs[i][3])
                        for j, y in ours.items():
                            pairs = {(a[1], b[1]) for a, b in zip(view[j : j + w], theirs[i : i + w], strict=True) if a[0].startswith("<")}
                            if x == y and sum(v[0].startswith("<") for v in view[j : j + w]) == sum(v[0].startswith("<") for v in theirs[i : i + w]):
                                hits.append((place - j, j, pairs))
                one = lambda p: len({a for a, _ in p}) == len({b for _, b in p}) == len(p)
                hits.sort(key=lambda h: h[:2])
                groups, band, last = {}, 0, None
                for o, j, pairs in hits:
                    band += last is not None and o - last > max(2, len(view) / step)
                    last = o
                    for key in (("offset", o), ("band", band), ("all",)):
                        groups.setdefault(key, []).append((j, pairs))
                for members in groups.values():
                    covered = {p for j, _ in members for p in range(j, j + w)}
                    longest = max(len(list(g)) for _, g in itertools.groupby(sorted(covered), key=lambda p, c=itertools.count(): p - next(c)))
                    if one(set().union(*(p for _, p in members))) and (round(len(covered) / len(view), 4) >= share or longest >= run):
                        found.add((d, n))
    return found


def test_decontamination_equals_loops(spark):
    """Items, exact and re-parameterised copies, broken ones, pieces, and mixtures of them, by plain loops over windows."""
    rnd = random.Random(21)
    names, plain = ["Anna", "Bert", "Carla", "Dora Lee", "Emil"], "the shop sells old red apples to people near station and they carry them home every day while it rains".split()

    def sentence(form: list, fill: dict) -> str:
        return " ".join(fill.get(x, x) for x in form)

    forms, items, docs = [], [], []
    for _ in range(6):
        form = [rnd.choice([*plain, *plain, "{n0}", "{n1}", "{a0}", "{a1}", "kg"]) for _ in range(rnd.randint(2, 30))]
        form[rnd.randrange(len(form))] = rnd.choice(["The", "Anna", "12"])
        forms.append(form)
        items.append(sentence(form, {"{n0}": "Anna", "{n1}": "Bert", "{a0}": "12", "{a1}": "7"}) + rnd.choice([".", "?", ". How many are left?"]))
    items += DENSE[:4] + [PASSAGE, None, ""]
    for i in range(90):
        bits = []
        for _ in range(rnd.randint(1, 3)):
            fill = {"{n0}": rnd.choice(names), "{n1}": rnd.choice(names), "{a0}": str(rnd.randint(1, 9)), "{a1}": str(rnd.randint(1, 9))}
            bit = rnd.choice([sentence(rnd.choice(forms), fill), rnd.choice(items) or "", PASSAGE.replace("Anna", rnd.choice(names)), " ".join(rnd.choice(plain) for _ in range(9))])
            words = bit.split(" ")
            for _ in range(rnd.choice([0, 0, 1, 2])):
                words.insert(rnd.randrange(len(words) + 1), rnd.choice([*plain, *names, "5", "."]))
            bits.append(" ".join(words[: rnd.choice([None, None, 12])]))
        docs.append(rnd.choice([". ", " ", "\n"]).join(bits))
    docs += [None, ""]
    expected = brute_leaks(docs, items)
    rows, table = (spark.createDataFrame(list(enumerate(x)), f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))
    assert {(r.doc_id, r.item_id) for r in decontaminate.op9(rows, table).collect()} == expected
    assert 20 < len(expected) < 0.9 * len(docs) * len(items)
    args = decontaminate._rows(rows, "doc_id"), decontaminate._rows(table, "item_id")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(*args, known_most=0, sent_most=0).collect()} == expected


def test_decontamination_slots_are_one_to_one(spark):
    """One value of the item stands for one of the document, and the other way round; nothing less is let through."""
    form = "When {} met the old man by the river {} gave {} coins to the boy and kept {} coins in a small box for the next day"
    item = form.format("Anna", "she", 12, 5).replace("she", "Anna")
    make = lambda a, b, c, d: form.format(a, b, c, d)
    texts = [make("Zoe", "Zoe", 3, 4), make("Zoe", "Bertram", 12, 5), make("Zoe", "Zoe", 4, 4), make("Anna", "Anna", 12, 5), make("Anna", "Anna", 12, 12)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.verbatim for r in decontaminate.op9(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {0: False, 3: True}


def test_contradictions_count_wherever_they_stand(spark):
    """A value that stands for two, near or far from each other, is never let through; capitals hide neither units nor contradictions."""
    trip = "the train from the old town goes {} {} in {} {} and stops at every village on the way so how fast does the train go"
    bags = "If {} carries three bags and {} drops one bag on the way to the market how many bags does {} carry at the end of the day"
    two = "the first road is {} {} long and the other road by the river is {} {} long so how much longer is the way by the river"
    items = [trip.format(120, "km", 2, "hours"), bags.format("Anna", "Anna", "Anna"), two.format(12, "km", 30, "km")]
    texts = [
        (trip.format(120, "km", 120, "hours"), None), (bags.format("Zoe", "Bert", "Bert"), None), (bags.format("Zoe", "Zoe", "Bert"), None), (two.format(12, "km", 30, "miles"), None), (two.format(9, "km", 9, "km"), None),
        (trip.format(300, "miles", 5, "days"), 0), (trip.format(300, "km", 5, "hours").upper(), 0), (bags.format("Zoe", "Zoe", "Zoe"), 1), (two.format(40, "miles", 7, "miles"), 2), (two.format(40, "KM", 7, "KM"), 2), (two.format(40, "KM", 40, "KM"), None),
        ("Miles " + trip.format(300, "km", 5, "hours"), 0),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.op9(rows, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert found == {(i, x) for i, (_, x) in enumerate(texts) if x is not None} == brute_leaks([t for t, _ in texts], items)


def test_decontaminate_drops_rows_not_ids(spark):
    """A leaking row goes even with a null id; a clean row stays even if a leaking one has its id."""
    clean = "a row that says nothing of the kind and may stay"
    rows = spark.createDataFrame([(None, PASSAGE, 1), (None, clean, 2), (5, PASSAGE, 3), (5, clean, 4), (6, None, 5)], "doc_id long, text string, rid long")
    left = decontaminate.decontaminate(rows, spark.createDataFrame([(1, PASSAGE)], "item_id long, text string"))
    assert left.columns == rows.columns and sorted(r.rid for r in left.collect()) == [2, 4, 5]


def test_decontamination_without_the_filter(spark):
    """Beyond the bound of the broadcast filter the join gives the same."""
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    rows = spark.createDataFrame([(1, PASSAGE), (2, "nothing of the kind " * 9)], "doc_id long, text string")
    args = decontaminate._rows(rows, "doc_id"), decontaminate._rows(items, "item_id")
    same(decontaminate.leaks(*args).drop("rid").collect(), decontaminate.leaks(*args, known_most=0).drop("rid").collect())


def brute_licenses(text: str | None) -> dict[str, float]:
    """The best Dice of each licence over all windows of its length, wherever they begin."""
    w = re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()
    g, out = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)], {}
    for k, t in license_scan.TEMPLATES.items():
        x = license_scan.template_words(t)
        b = {f"{p} {q}" for p, q in zip(x, x[1:], strict=False)}
        dice = [2 * len(set(g[i : i + len(x) - 1]) & b) / (len(set(g[i : i + len(x) - 1])) + len(b)) for i in range(len(g))]
        if dice and max(dice) >= 0.8:
            out[k] = max(dice)
    return out


def test_license_scan(spark, docs, empty):
    mit, apache = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["Apache-2.0"]
    code = "\n".join(f"x{i} = call({i})  # step {i}" for i in range(80))
    wrapped = lambda t, mark, n=9: "\n".join(f"{mark} {' '.join(t.split()[i : i + n])}" for i in range(0, len(t.split()), n))
    paragraphs = mit.replace("conditions: ", "conditions:\n\n").replace("Software. THE", "Software.\n\nTHE")
    texts = [mit, "Words before.\nReleased under the MIT License.\nafter", "x\n\n" + mit.replace(". ", ".\n") + "\n\ny", "Licensed under some other licence", None,
             f"Copyright 2020 A. Body\n\n{paragraphs}\n\n{code}", f"/*\n{wrapped(apache, ' *')}\n */\n{code}", f"{code}\n{wrapped(license_scan.TEMPLATES['GPL-3.0'], '#', 7)}\n{code}",
             "This code. Released under the MIT License. Enjoy it.", "Copyright 2020 Foo Bar. Released under the MIT License.", mit.replace("Software", "Program") + code, " ".join(mit.split()[:60]) + code,
             "They released it under a license of the MIT kind, and the license says that the software is provided as is.", license_scan.TEMPLATES["BSD-3-Clause"], license_scan.TEMPLATES["LGPL-2.1"], license_scan.TEMPLATES["CC0-1.0"] + code,
             f"{mit} {apache} {mit}", license_scan.TEMPLATES["EPL-2.0"].replace("materials", "stuff") + " " + code]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(1, "Released   UNDER the (MIT) license", None, None, None)]
    got = {(r.doc_id, r.license_id): r for r in license_scan.op1(spark.createDataFrame(rows, DOCS)).collect()}
    expected = {(i, k): d for i, t in enumerate(texts) for k, d in brute_licenses(t).items()}
    assert set(got) == set(expected) and all(abs(got[k].dice - expected[k]) < 1e-6 for k in got)
    assert {(0, "MIT"), (1, "MIT-line"), (2, "MIT"), (5, "MIT"), (6, "Apache-2.0"), (7, "GPL-3.0"), (8, "MIT-line"), (9, "MIT-line"), (13, "BSD-3-Clause"), (14, "LGPL-2.1"), (15, "CC0-1.0"), (16, "MIT"), (16, "Apache-2.0"), (17, "EPL-2.0")} <= set(got)
    assert not {i for i, _ in got} & {3, 4, 11, 12}
    assert got[5, "MIT"].dice == 1.0 and got[1, "MIT-line"].n_windows == 3 and got[16, "MIT"].n_windows >= 2  # windows may overlap, and are shorter at the end of a text
    hit = license_scan.license_hits(spark.createDataFrame([rows[8]], DOCS)).collect()
    assert [(h.license_id, h.first_word, h.n_words) for h in hit] == [("MIT-line", 2, 5)]
    assert license_scan.op1(docs).collect() == [] and license_scan.op1(empty).collect() == []
    for n in range(1, 60):  # the bounds prune nothing that could match
        lo, hi = license_scan.bounds(n, 0.8)
        assert all((2 * min(n, m) / (n + m) >= 0.8) == (lo <= m <= hi) for m in range(1, 200))


def test_license_scan_of_noisy_notices_is_complete(spark):
    """Words put in, left out, changed and repeated, at both ends, too: every window that reaches the threshold, with its score, as by brute force."""
    rnd = random.Random(31)
    kinds, texts = list(license_scan.TEMPLATES.values()), []
    for i in range(70):
        words = kinds[i % len(kinds)].split()
        share = rnd.choice([0.02, 0.05, 0.08])
        for _ in range(max(1, round(share * len(words)))):
            k = rnd.randrange(len(words) + 1)
            words[k : k + rnd.choice([0, 1, 1, 2])] = [rnd.choice(["foo", "bar", "the", "of", "software", "foo bar foo bar"])] * rnd.choice([0, 1, 1, 2])
        cut = rnd.choice([0, 0, 3, 9])
        texts.append(" ".join(["x y"] * rnd.randrange(4) + words[cut : len(words) - rnd.choice([0, 0, 4])] + ["x y"] * rnd.randrange(4)))
    want = {}
    for i, t in enumerate(texts):
        w = re.sub(r"[^a-z0-9]+", " ", t.lower()).split()
        g = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        for k, x in license_scan.TEMPLATES.items():
            x = license_scan.template_words(x)
            b = {f"{p} {q}" for p, q in zip(x, x[1:], strict=False)}
            for at in range(len(g)):
                d = set(g[at : at + len(x) - 1])
                if (dice := 2 * len(d & b) / (len(d) + len(b))) >= 0.8:
                    want[i, k, at] = round(dice, 9)
    got = license_scan.license_hits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(h.doc_id, h.license_id, h.first_word): round(h.dice, 9) for h in got} == want and len(got) == len(want) > 500


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hello <|assistant|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 70, "ann", "late"), (2, 0, "system", "alone"), (None, None, None, "x"), (3, 0, "ann", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumns({k: df["turn"] for k in ("part", "speaker", "m", "said")})
    got = {(r.conv_id, r.speaker, r.part): r for r in chat_rotation.rotate(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "ann", 1), (1, "bob", 0), (1, "bob", 1), (None, "unknown", None), (3, "ann", 0)}
    r = got[1, "ann", 0]
    assert r.dialogue == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhello < |assistant|><|end|>\n" + "<|user name=bob|>\n<|end|>\n" * 2
    assert [r.dialogue[s.start : s.end] for s in r.mask_spans] == ["hello < |assistant|><|end|>\n"]
    assert got[1, "bob", 0].n_assistant_turns == 2 and got[1, "bob", 0].n_turns == 4
    assert chat_rotation.op3(df.limit(0)).collect() == []


def brute_dialogues(rows: list[tuple]) -> dict:
    """(conv_id, speaker) -> the whole dialogue and what the assistant says in it."""
    plain = lambda x: x.replace("<|", "< |")
    turns, out = {}, {}
    for c, n, role, text in rows:
        turns.setdefault(c, []).append((n is not None, n or 0, plain(role or "unknown"), plain(text or "")))
    for c, said in turns.items():
        for speaker in {r for *_, r, _ in said if r != "system"}:
            whole, mask = "", []
            for *_, role, text in sorted(said):
                whole += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                mask += [(len(whole), len(whole) + len(text) + 8)] if role == speaker else []
                whole += text + "<|end|>\n"
            out[c, speaker] = (whole, mask)
    return out


def test_chat_rotation_is_the_same_at_every_size_of_parts(spark):
    """The parts in order are the whole dialogue, and at makes their masks its mask: long ones, many equal turns, negative and null turns."""
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([None, -70, -1, 0, 1, 5, 64, 65, 130, 7, 7, 7]), rnd.choice(["ann", "bob", "system", None, "<|x|>"]), rnd.choice(["hi", "", None, "é <|end|>", "long " * 9])) for _ in range(300)]
    rows += [(3, 4, "ann", f"same {i % 2}") for i in range(150)] + [(4, 0, "system", "alone")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "piece": F.lit(2), "length": F.lit(3)})
    expected = brute_dialogues(rows)
    for size in (1, 7, 64, 100_000):
        got = {}
        for r in sorted(chat_rotation.rotate(df, size).collect(), key=lambda r: (r.at, r.part is not None, r.part or 0, r.piece)):
            whole, mask = got.get((r.conv_id, r.speaker), ("", []))
            assert r.at == len(whole) and r.n_turns <= size
            got[r.conv_id, r.speaker] = (whole + r.dialogue, mask + [(r.at + s.start, r.at + s.end) for s in r.mask_spans])
        assert got == expected


def test_language_id(spark, docs, empty):
    vowels = {"xx": "aeo", "yy": "iuy"}
    rnd = random.Random(4)
    rows = [(i, " ".join("".join(rnd.choice("bcdfg") + rnd.choice(vowels[k]) for _ in range(3)) for _ in range(30)), k, "s", 1) for i in range(240) for k in [("xx", "yy")[i % 2]]]
    rows += [(900, None, "xx", "s", 0), (901, "123 !!", "yy", "s", 0), (902, rows[0][1], None, "s", 0), (None, rows[1][1], "yy", "s", 0)]
    got = {r.doc_id: r for r in language_id.op2(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].lang_pred == k and 0.5 < got[i].score <= 1 for i, _, k, *_ in rows[:240])
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and not got[900].accepted
    assert got[902].lang_pred == "xx" and got[None].lang_pred == "yy" and not got[None].held_out
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(240))
    assert language_id.op2(empty).collect() == []
    assert {r.lang_pred for r in language_id.op2(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).collect()} == {"und"}


def test_language_model_rejects_what_it_has_not_learned():
    rows = [("baba beba " * 20, "xx"), ("didu yidi " * 20, "yy")] * 40
    model = language_id.fit(rows)
    assert language_id.predict(model, "baba beba baba")[0] == "xx"
    assert language_id.predict(model, "zzqzk wrtp")[1] < language_id.predict(model, "baba beba")[1]


def pages_of() -> list[tuple]:
    page = "<html>" + "body " * 50 + "</html>"
    return [(5, "http://a/5", page), (3, "http://a/3", page), (7, None, page), (1, "u", "short"), (2, "u", "short"), (9, "u", None), (10, "u", ""), (None, "n", page), (3, "again", page), (11, "u\r\nInjected: 1", "é" * 60 + "\r\n\r\nx"), *[(20 + i, "u", f"<p>{i}</p>" * 40) for i in range(300)]]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(pages_of(), "page_id long, url string, html string").repartition(3)
    df = df.withColumns({k: df["url"] for k in ("digest", "key", "payload", "first", "n")})
    first = {}
    for i, _, h in pages_of():
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    expected = []
    for i, _, h in pages_of():
        b = (h or "").encode()
        ref = first.get(h) if h in first and first[h] != i else None
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if ref is None else "revisit", ref, None))
    same([tuple(r) for r in warc_zstd.op10(df).collect()], expected)
    assert warc_zstd.op10(df.limit(0)).collect() == []


def test_warc_archives_are_bounded_and_damage_is_told(spark, tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(warc_zstd, "DICT_SAMPLES", 8)
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame(pages_of(), "page_id long, url string, html string").coalesce(1)
    warc_zstd.write_archives(warc_zstd.plan_records(df), path)
    name = next((tmp_path / "w").glob("*.warc.zst"))
    data = name.read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    records = list(warc_zstd._frames(memoryview(data)))
    assert len(records) == len(pages_of()) and all(warc_zstd.parse_record(r)[-1] is None for r in records)
    name.write_bytes(data[:-20])
    rows = warc_zstd.read_archives(spark, path).collect()
    assert len(rows) == len(pages_of()) and "cut off" in rows[-1].error
    plain = zstandard.ZstdCompressor().compress(warc_zstd.record(1, "u", hashlib.sha256(b"x").hexdigest(), 1, None, b"x"))
    assert [warc_zstd.parse_record(r)[0] for r in warc_zstd._frames(memoryview(plain))] == [1]
    bad = warc_zstd.record(1, "u", "0" * 64, 2, None, b"x").replace(b"WARC-Date", b"WARC-Day")
    assert warc_zstd.parse_record(bad)[-1] == "no warc-date; wrong payload length; wrong digest"
    assert "wrong length" in warc_zstd.parse_record(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")[-1]


def test_warc_reads_only_what_the_job_committed(spark, tmp_path, monkeypatch):
    """A partition that runs twice, its rows in another order and in archives of other sizes, gives each record once."""
    path = f"file://{tmp_path}/w"
    df = warc_zstd.plan_records(spark.createDataFrame(pages_of(), "page_id long, url string, html string")).select("page_id", "url", "digest", "n_bytes", "refers_to", "payload")
    monkeypatch.setattr(warc_zstd, "ARCHIVE_BYTES", 2000)
    first = df.orderBy("digest").coalesce(1).mapInArrow(warc_zstd._write(path), "name string, n_records long").collect()  # an attempt that Spark gave up
    monkeypatch.setattr(warc_zstd, "ARCHIVE_BYTES", 8 << 20)
    done = warc_zstd.write_archives(df.orderBy(df["digest"].desc()).coalesce(1), path).collect()
    assert not {r.name for r in first} & {r.name for r in done} and sum(r.n_records for r in done) == len(pages_of())
    assert len(list((tmp_path / "w").glob("*.warc.zst"))) == len(first) + len(done)
    rows = warc_zstd.read_archives(spark, path).collect()
    same([r.page_id for r in rows], [p[0] for p in pages_of()])
    assert all(r.error is None for r in rows)
    (tmp_path / "other").mkdir()
    for r in done:  # a folder without a list is read whole
        (tmp_path / "other" / r.name).write_bytes((tmp_path / "w" / r.name).read_bytes())
    assert warc_zstd.read_archives(spark, f"file://{tmp_path}/other").count() == len(pages_of())


def test_hot_keys_change_nothing(spark, monkeypatch):
    """With a bound that makes most values hot, salted joins give what plain ones give."""
    from marketbars.llm import common

    monkeypatch.setattr(common, "HOT", 100_000)
    rnd = random.Random(13)
    passage = "a passage that very many texts hold, word for word, " * 6
    rows = [(i, rnd.choice([passage, "", None, f"begin {rnd.randrange(5)} " + passage + f" end {rnd.randrange(9)}", f"text {i} " * 30]), None, None, None) for i in range(200)]
    df = spark.createDataFrame(rows, DOCS)
    same([tuple(r) for r in suffix_dedup.strip_repeats(df, chunk=2000, digest=True).collect()], [(r[0], *x) for r, x in zip(rows, brute_strip([r[1] for r in rows], 200), strict=True)])
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    got = {r.doc_id: r.component_id for r in simhash.op8(df).collect()}
    label = components(fps)
    assert all((got[i] == got[j]) == (label[i] == label[j]) for i in range(200) for j in range(200))
    stars = [(0, k) for k in range(1, 60)] + [(k, k + 1000) for k in range(1, 60)] + [(5000, 5001)]
    found = {r.node: r.label for r in common.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert found == {k: 0 for k in [0, *range(1, 60), *range(1001, 1060)]} | {5000: 5000, 5001: 5000}
    left, right = spark.createDataFrame([(i % 3, i) for i in range(50)], "k long, x long"), spark.createDataFrame([(0, "a"), (1, "b")], "k long, y string")
    for how in ("inner", "left"):
        same([tuple(r) for r in common.spread_join(left, right, ["k"], [0, 1], how).collect()], [tuple(r) for r in left.join(right, "k", how).collect()])


def test_temporary_folders_go(spark):
    from marketbars.llm import common

    stays = common.new_dir(spark, "stays")
    with common.temporary(spark):
        inner = common.keep(spark.range(5), "inner")
        name = inner.inputFiles()[0]
        common.keep(inner, "out", stays)
    import os

    assert not os.path.exists(name.removeprefix("file://")) and spark.read.parquet(stays).count() == 5


def test_components_of_random_graphs(spark):
    """Paths, stars, cycles and random graphs, with self-links, repeats and nulls, against a plain search."""
    from marketbars.llm import common

    rnd = random.Random(17)
    path = list(range(10_000, 10_120))
    rnd.shuffle(path)
    links = list(zip(path, path[1:], strict=False)) + [(0, -k) for k in range(1, 50)] + [(500 + k, 500 + (k + 1) % 9) for k in range(9)]
    links += [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(150)] + [(7777, 7777), (None, 4), (4, None)] + links[:5]
    parent = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.label for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_language_id_of_long_texts_and_clashing_columns(spark, monkeypatch):
    """Texts beyond max_chars are not learned from but predicted whole, block by block; other columns do no harm."""
    rnd = random.Random(6)
    say = lambda k, n: " ".join("".join(rnd.choice("bcdfg") + rnd.choice({"xx": "aeo", "yy": "iuy"}[k]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(k, 30), k) for i in range(200) for k in [("xx", "yy")[i % 2]]]
    rows += [(900, say("xx", 4000), "yy"), (901, say("yy", 4000) + " " + say("xx", 9), "xx")]  # wrong labels, which must not be learned
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({k: F.lit("zz") for k in ("r", "n", "score", "held_out", "lang_pred", "source")})
    settings = language_id.Settings(max_chars=2000)
    whole = {r.doc_id: r for r in language_id.op2(df, settings).collect()}
    assert whole[900].lang_pred == "xx" and whole[901].lang_pred == "yy"
    monkeypatch.setattr(language_id, "BLOCK", 64)
    model = language_id.train(df, settings)
    assert sorted(model.langs) == ["xx", "yy"]
    for i in (900, 901, 5):
        lang, score, _ = language_id.predict(model, dict((r[0], r[1]) for r in rows)[i])
        assert lang == whole[i].lang_pred and abs(score - whole[i].score) < 1e-6
    assert language_id.train(df, settings._replace(max_langs=1)).langs in (["xx"], ["yy"])


def test_sentencepiece_by_name_and_with_clashing_columns(spark):
    rows = [(1, "two words"), (1, "two words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({k: F.lit(1) for k in ("n_tokens", "ids_sha256", "ids")})
    import public_tokenizers

    named, by_path = sentencepiece_codec.op6(df, "piece_bpe_32k.model").collect(), sentencepiece_codec.op6(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    same([tuple(r) for r in named], [tuple(r) for r in by_path])
    assert len(named) == 3 and sorted(r.n_tokens for r in named)[0] == 0


def test_deduplicate_one_very_long_text_and_one_large_group(spark, monkeypatch):
    """A text of 60,000 words beside a near copy; a large group of copies of one text with a few texts that are unlike its first."""
    rnd = random.Random(12)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(60_000)]
    texts = [" ".join(words), " ".join([*words[:59_000], "another", "end"])]
    base = [f"v{i}" for i in range(100)]
    drift = list(base)
    for i in range(40):  # a chain that leaves the first text step by step, and copies near the first
        drift[(i * 7) % 100] = f"d{i}"
        near = list(base)
        near[i] = f"n{i}"
        texts += [" ".join(drift), " ".join(near)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    label = brute_similar(texts)
    expected = sorted(label.index(x) for x in set(label))
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 8)
    assert sorted(r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, DOCS)).collect()) == expected
