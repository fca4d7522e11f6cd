"""Whitening against numpy, byte-level BPE and alignment against the public libraries and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketbars.llm import byte_bpe, token_alignment, whitening

A, B, RANKS = "byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"
DOCS = "doc_id long, text string"
ODD = [" ", "  ", "\n", "\t", "'s", "'ll", "\x1c", "\x85", "\xa0", "　", "é", "中", "😀", "1", "23", "½", "a", "Word", "the", "ing", "##", "..", "́", "‍", "<|endoftext|>", "<0x41>", "▁", "<unk>", "\r", "\x00", "①", "ﬁ"]


def texts() -> list[tuple]:
    rnd = random.Random(3)
    some = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    some += ["the same text", "the same text", "word " * 3000, "x" * 5000, "".join(rnd.choice("abcdefg") for _ in range(3000)), " " * 700, "", " ", "  "]
    return [*enumerate(some), (5, None), (None, "a null id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(texts(), DOCS).repartition(3)
    return df.withColumns({c: df["doc_id"] for c in ("rid", "pair", "pairs", "n", "times", "n_a", "x", "v", "id")})


# --- whitening


@pytest.mark.parametrize("matrix", [np.eye(6), np.diag([3.0, 3, 3, 1, 0]), np.zeros((4, 4)), np.array([[2.0]]), np.array([[2.0, 1], [1, 2]]), np.ones((7, 7)), np.kron(np.eye(3), np.array([[2.0, 1], [1, 2]]))])
def test_components_of_special_matrices(matrix):
    values, vectors = whitening.leading_components(matrix, 16)
    assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1]).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 and np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-13


@pytest.mark.parametrize("size", [3, 40, 150])
def test_components_of_random_matrices(size):
    rng = np.random.default_rng(size)
    a = rng.standard_normal((size, size // 2 + 2)) * 10.0 ** rng.integers(-3, 4)
    v = a @ a.T
    values, vectors = whitening.leading_components(v, 16)
    k, norm = min(16, size), np.abs(v).max() * size
    assert np.abs(values - np.linalg.eigvalsh(v)[::-1][:k]).max() < 1e-14 * norm
    assert np.abs(v @ vectors - vectors * values).max() < 1e-14 * norm and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


def test_sturm_counts():
    rng = np.random.default_rng(1)
    d, o = rng.standard_normal(30), rng.standard_normal(29)
    o[11] = 0
    e = np.linalg.eigvalsh(np.diag(d) + np.diag(o, 1) + np.diag(o, -1))
    at = rng.uniform(-4, 4, 50)
    assert whitening.count_below(d, o, at).tolist() == [(e < x).sum() for x in at]


VECTORS = "vec_id long, embedding array<float>"


def brute_whitening(rows: list[tuple]) -> dict:
    rows = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in r[1]] for r in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    c = np.array([[float(n * v - s) for v, s in zip(r, sums, strict=True)] for r in fit]) / n
    v = c.T @ c / n
    e, z = np.linalg.eigh(v)
    e, z = e[::-1][:16], z[:, ::-1][:, :16]
    y = np.array([[(n * v - s) / n for v, s in zip(r, sums, strict=True)] for r in x]) @ z / np.sqrt(e)
    return {"rows": rows, "n": n, "deviation": [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x], "whitened": y, "explained": e / np.trace(v)}


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((20, 20)) * np.linspace(1, 0.2, 20)
    rows = [(i, (rng.standard_normal(20) @ mix / 8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(250)]  # one hot vector, once in the fit list
    rows += [(None, rows[7][1]), (7, rows[8][1]), (2000, None), (2001, [None] * 20), (2002, [float("nan")] + [0.0] * 19), (2003, [float("inf")] * 20)]
    other = [(2004, []), (2005, [1.0, 2.0])]  # of another length
    df = spark.createDataFrame(rows + other, VECTORS).repartition(5)
    got = whitening.op11(df.withColumns({c: F.lit("x") for c in ("x", "v", "id", "n", "component")})).collect()
    want = brute_whitening(rows)
    assert len(got) == 16 * len(want["rows"]) and {r.n for r in got} == {want["n"]} and max(r.identity_error for r in got) < 1e-10
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    key = lambda i, d, w: (i is None, i or 0, d, round(w, 6))
    for k, own in by.items():
        y = want["whitened"][:, k - 1]
        sign = max((1, -1), key=lambda s: sum(a == b for a, b in zip(sorted(round(s * r.whitened, 6) for r in own), sorted(np.round(y, 6)), strict=True)))
        assert all(abs(r.explained - want["explained"][k - 1]) < 1e-10 for r in own)
        mine = sorted(key(r.vec_id, r.deviation, sign * r.whitened) for r in own)
        theirs = sorted(key(i, d, w) for (i, _), d, w in zip(want["rows"], want["deviation"], y, strict=True))
        assert [m[:3] for m in mine] == [t[:3] for t in theirs] and np.abs(np.array([m[3] for m in mine]) - np.array([t[3] for t in theirs])).max() < 2e-6


def test_whitening_of_few_vectors(spark):
    of = lambda rows: whitening.op11(spark.createDataFrame(rows, VECTORS)).collect()
    assert of([]) == [] and of([(1, None), (2, [])]) == [] and of([(1, [0.5, 1.0]), (2, [0.5, 1.0])]) == []
    two = of([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])])
    assert {(r.vec_id, r.component, abs(r.whitened), r.deviation, r.explained) for r in two} == {(i, 1, 1.0, 64 * 64, 1.0) for i in (1, 2, 3)}


def test_whitening_of_huge_entries(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 2.0])]
    got = whitening.op11(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all(r.deviation is None for r in got if r.vec_id < 3)


# --- byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(byte_bpe.read_ranks(RANKS))}, special_tokens={})


def test_perfect_hash_is_minimal():
    for keys in ([b"a"], [bytes([i]) for i in range(256)], byte_bpe.read_ranks(RANKS)):
        h = byte_bpe.PerfectHash(keys)
        assert sorted(h.number.tolist()) == list(range(len(keys))) and h.find(keys) == list(range(len(keys)))
        assert h.find([b"no such key", b""]) == [-1, -1] == [h.find_one(b"no such key"), h.find_one(b"")] and [h.find_one(k) for k in keys] == list(range(len(keys)))
    assert h.find([]) == []


@pytest.mark.parametrize("table_size", [3, byte_bpe.TABLE_SIZE])
def test_byte_bpe_equals_library(docs, tiktoken_encoding, table_size):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x), sha(" ".join(map(str, x)).encode()), sha(tiktoken_encoding.decode_bytes(x))) for i, t in texts() for x in [tiktoken_encoding.encode_ordinary(t or "")]]
    got = byte_bpe.op12(docs, RANKS, P.PATTERN, table_size).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_byte_bpe_texts_come_back(spark, docs):
    encoded = byte_bpe.encode_documents(docs, RANKS, P.PATTERN)
    assert {bytes(r.decoded).decode() for r in encoded.collect()} == {t or "" for _, t in texts()}
    assert {r.text for r in byte_bpe.decode_documents(encoded, RANKS).collect()} == {t or "" for _, t in texts()}
    assert byte_bpe.op12(spark.createDataFrame([], DOCS), RANKS, P.PATTERN).collect() == []


def test_merges_of_long_pieces(tiktoken_encoding):
    table = byte_bpe.PreTokenTable(*byte_bpe._built(RANKS), P.PATTERN)
    rnd = random.Random(9)
    for t in ("a" * 20_000, "ab" * 9_000, "".join(rnd.choice("abcde") for _ in range(20_000))):
        assert next(table.encode([t]))[1] == " ".join(map(str, tiktoken_encoding.encode_ordinary(t)))
    assert not table.table  # nothing so long is kept


def test_rank_files_are_checked(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="without a gap"):
        byte_bpe.read_ranks(str(tmp_path / "r"))


def merges(monkeypatch):
    """A list to which every pre-token that tier two merges from now on is added."""
    seen, merged = [], byte_bpe.merged
    monkeypatch.setattr(byte_bpe, "merged", lambda ids, ranks: seen.append(tuple(ids)) or merged(ids, ranks))
    return seen


def test_pre_tokens_met_often_stay_in_the_table(monkeypatch, tiktoken_encoding):
    seen, table = merges(monkeypatch), byte_bpe.PreTokenTable(*byte_bpe._built(RANKS), P.PATTERN, 12)
    docs = [f"qzoften qxoften {' '.join(f'qj{chr(97 + i)}{chr(97 + k)}vx' for k in range(4))}" for i in range(20)]
    for t in docs:
        ids = tiktoken_encoding.encode_ordinary(t)
        assert list(table.encode([t])) == [(len(ids), " ".join(map(str, ids)), t.encode())]
        assert len(table.table) <= 12 and len(table.older) <= 12
    assert len(seen) == len(set(seen)) == 2 + 20 * 4


def test_table_is_kept_from_task_to_task(spark, docs, monkeypatch):
    seen, run = merges(monkeypatch), byte_bpe._batches(docs, RANKS, P.PATTERN, 1000, True)
    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array(["qzoften qxoften", None])], ["doc_id", "text"])
    first, n = list(run(iter([batch]))), len(seen)
    assert list(run(iter([batch]))) == first and len(seen) == n == 2
    assert list(byte_bpe._batches(docs, RANKS, P.PATTERN, 1000, True)(iter([batch]))) == first and len(seen) == 2 * n  # another query has a table of its own


# --- alignment


def libraries():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(P.path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path(B))


def brute_alignment(rows: list[tuple]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows of op13 by loops, with overlap and shared-group links."""
    a, b = libraries()
    signs = token_alignment._signs()
    found, counts, overlaps, shared = [], Counter(), [], []
    for i, t in rows:
        found.append(None)
        if not t:
            continue
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        bx = [bytes(signs[c] for c in a.id_to_token(k)) for k in x]
        by = [bytes([int(p[3:-1], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in y for p in [b.id_to_piece(k)]]
        if b"".join(bx) != (" " + t).encode() or b"".join(by) != (" " + t).encode():
            continue
        ends = lambda s: np.cumsum([len(p) for p in s]).tolist()
        ex, ey = ends(bx), ends(by)
        common = sorted(set(ex) & set(ey))
        gx, gy = ([next(g for g, c in enumerate(common) if e <= c) for e in s] for s in (ex, ey)) if len(t) < 400 else ([], [])
        links = [(p, q) for p, e in enumerate(ex) for q in ([ey.index(e)] if e in common else [])]
        groups, p0, q0 = [], 0, 0
        for p, q in links:
            groups.append(",".join(map(str, x[p0 : p + 1])) + "|" + ",".join(map(str, y[q0 : q + 1])))
            p0, q0 = p + 1, q + 1
        counts.update((x[p], y[q]) for p, q in links)
        found[-1] = (x, y, links, groups)
        if len(t) < 400:
            for p, e in enumerate(ex):
                for q, f in enumerate(ey):
                    n = min(e, f) - max(e - len(bx[p]), f - len(by[q]))
                    if n > 0:
                        overlaps.append((i, p, q, x[p], y[q], n))
                    if gx[p] == gy[q]:
                        shared.append((i, p, q, x[p], y[q]))
    top: dict[int, int] = defaultdict(int)
    for (_, q), n in counts.items():
        top[q] = max(top[q], n)
    out = []
    for (i, _), f in zip(rows, found, strict=True):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, links, groups = f
        ids = [(x[p], y[q]) for p, q in links]
        out.append((i, len(x), len(y), len(groups), len(links), sum(counts[k] == top[k[1]] for k in ids), sum(counts[k] for k in ids), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out, overlaps, shared


@pytest.fixture(scope="module")
def brute():
    return brute_alignment(texts())


@pytest.mark.parametrize("sent_most", [token_alignment.SENT_MOST, 3])
def test_alignment_equals_loops(docs, brute, sent_most):
    got = token_alignment.op13(docs, A, B, P.PATTERN, sent_most).collect()
    assert sorted(repr(tuple(r)[:8]) for r in got) == sorted(map(repr, brute[0]))
    assert sum(r.n_a == 0 for r in got) > 10 and all((r.n_overlaps >= r.n_links and r.n_shared >= r.n_overlaps) for r in got)


def test_links_equal_loops(spark, brute):
    short = spark.createDataFrame([r for r in texts() if r[1] is None or len(r[1]) < 400], DOCS)
    assert sorted(map(repr, map(tuple, token_alignment.overlap_links(short, A, B, P.PATTERN).collect()))) == sorted(map(repr, brute[1]))
    assert sorted(map(repr, map(tuple, token_alignment.shared_links(short, A, B, P.PATTERN).collect()))) == sorted(map(repr, brute[2]))


def test_alignment_in_small_blocks(spark, docs, monkeypatch):
    want = sorted(repr(tuple(r)) for r in token_alignment.op13(docs, A, B, P.PATTERN).collect())
    pair = token_alignment._pair(A, B, P.PATTERN)
    ids = [x for x in pair.encode([t for _, t in texts() if t]) if x]
    rows = lambda: [(*r[:7], r[7].tolist(), r[8].tolist()) for r in token_alignment.Alignment(pair, ids).per_text()]
    whole, each = rows(), [(*r[:7], r[7].tolist(), r[8].tolist()) for x in ids for r in token_alignment.Alignment(pair, [x]).per_text()]
    monkeypatch.setattr(token_alignment, "EXPANDED", 7)
    assert whole == each == rows() and want


def test_product_of_random_matrices(monkeypatch):
    monkeypatch.setattr(token_alignment, "EXPANDED", 20)
    rng = np.random.default_rng(5)

    def csr(m: np.ndarray) -> token_alignment.Csr:
        return token_alignment.Csr(np.concatenate([[0], np.cumsum((m != 0).sum(axis=1))]), np.nonzero(m)[1], m[m != 0], m.shape[1])

    a, b = (rng.integers(0, 4, s) * (rng.random(s) < 0.4) for s in ((9, 12), (12, 8)))
    out = np.zeros((9, 8), int)
    for i, j, v in token_alignment.product(csr(a), csr(b)):
        out[i, j] += v
    assert (out == a @ b).all() and (token_alignment.row_sizes(csr(a), csr(b)) == [(b[r != 0] != 0).sum() for r in a]).all()
    t = csr(a).transposed()
    back = np.zeros((12, 9), int)
    back[np.repeat(np.arange(12), np.diff(t.starts)), t.columns] = t.values
    assert (back == a.T).all()


def test_alignment_of_nothing(spark):
    assert token_alignment.op13(spark.createDataFrame([], DOCS), A, B, P.PATTERN).collect() == []
    assert [tuple(r)[:8] for r in token_alignment.op13(spark.createDataFrame([(1, None)], DOCS), A, B, P.PATTERN).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_merges_are_checked(tmp_path):
    import json

    with open(P.path(A), encoding="utf-8") as f:
        model = json.load(f)
    model["model"]["merges"] = model["model"]["merges"][::-1]
    (tmp_path / "bad.json").write_text(json.dumps(model), encoding="utf-8")
    with pytest.raises(ValueError, match="merges"):
        token_alignment.check_merges(str(tmp_path / "bad.json"))
