"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is lower-cased, everything but letters becomes a blank, and the 2-, 3- and 4-byte windows of the result are
hashed into `buckets`. A document is the mean of its windows' embeddings; a linear softmax on it is trained by
stochastic gradient descent in numpy. Training takes a bounded sample: about `per_lang` texts of each language, chosen
by a hash of their ids, of the `max_langs` most frequent languages, at most `max_rows` in all and of at most `max_chars`
characters each (longer texts aren't learned from; every text is predicted whole). A fifth of the sample is held out to fit a temperature, so that scores
are probabilities, and the lowest score at which accepted predictions are right `precision` of the time. lang_pred is the
likeliest language whatever its score; accepted tells whether the score reaches the threshold.

Cases: null text and text without a letter are `und` with score 0 and not accepted; rows without a language are
predicted but not learned from; null ids are not learned from; repeated rows each get a row; without any labelled row
everything is `und`; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = (2, 3, 4)
NOT_LETTERS = re.compile(r"[\W\d_]+")
BLOCK = 1 << 20


class Settings(NamedTuple):
    buckets: int = 1 << 15
    size: int = 16
    per_lang: int = 800
    max_rows: int = 8000
    max_langs: int = 500
    max_chars: int = 20_000
    epochs: int = 6
    rate: float = 0.5
    precision: float = 0.99
    seed: int = 7


class Model(NamedTuple):
    """langs, the logits that each bucket adds (embedding times softmax weights), biases, temperature, threshold."""

    langs: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def windows(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Bucket numbers of all windows of a text, in blocks."""
    data = np.frombuffer((" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ").encode(), np.uint8)
    for at in range(0, len(data), BLOCK):
        b = data[at : at + BLOCK + max(ORDERS) - 1].astype(np.uint32)
        h, done = b, []
        for k in range(1, max(ORDERS)):
            h = h[:-1] * np.uint32(16777619) ^ b[k:]
            if k + 1 in ORDERS and len(h):
                mixed = (h + np.uint32(k * 0x9E37)) * np.uint32(2654435761)
                done.append((mixed >> np.uint32(32 - buckets.bit_length() + 1))[:BLOCK])
        if done:
            yield np.concatenate(done)


def features(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares."""
    found = list(windows(text, buckets))
    u, n = np.unique(np.concatenate(found), return_counts=True)
    return u, (n / n.sum()).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], s: Settings = Settings()) -> Model:
    """Train on (text, lang) rows; texts need a letter."""
    langs = sorted({x[1] for x in rows})
    if not langs:
        return Model([], np.zeros((s.buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(s.seed)
    data = [(*features(t, s.buckets), langs.index(x)) for t, x in rows]
    order = rng.permutation(len(data))
    aside = [data[i] for i in order[: len(data) // 5]]
    train = [data[i] for i in order[len(data) // 5 :]]
    emb = rng.uniform(-1 / s.size, 1 / s.size, (s.buckets, s.size)).astype(np.float32)
    w, bias = np.zeros((s.size, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    steps, done = s.epochs * len(train), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(train)):
            u, share, y = train[i]
            rate = s.rate * (1 - done / steps)
            mean = share @ emb[u]
            g = _softmax(mean @ w + bias)
            g[y] -= 1
            back = w @ g
            w -= rate * np.outer(mean, g)
            bias -= 0.1 * rate * g
            emb[u] -= (rate * 8) * np.outer(share, back) * min(len(u), 64)
            done += 1
    logits = emb @ w
    model = Model(langs, logits, bias, 1.0, 0.0)
    if not aside:
        return model
    z = np.array([share @ logits[u] + bias for u, share, _ in aside])
    y = np.array([c for *_, c in aside])
    temps = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in temps]
    t = float(temps[int(np.argmin(loss))])
    p = _softmax(z / t)
    best, right = p.max(1), p.argmax(1) == y
    down = np.argsort(-best, kind="stable")
    good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(y) + 1) >= s.precision)
    threshold = float(best[down[good[-1]]]) if len(good) else 1.0
    return model._replace(temperature=t, threshold=threshold)


def predict(model: Model, text: str | None) -> tuple[str, float, bool]:
    """(lang, score, accepted) of a whole text."""
    if not text or not model.langs or not any(map(str.isalpha, text)):
        return "und", 0.0, False
    z, n = np.zeros(len(model.langs)), 0
    for w in windows(text, len(model.logits)):
        z += model.logits[w].sum(axis=0, dtype=np.float64)
        n += len(w)
    p = _softmax((z / n + model.bias) / model.temperature)
    k = int(p.argmax())
    return model.langs[k], float(p[k]), float(p[k]) >= model.threshold


def held_out(doc_id: str) -> Column:
    """crc32(doc_id as text) mod 3 is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Fit on the documented bounded sample of rows that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("text").rlike(r"\p{L}") & (F.length("text") <= s.max_chars))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(s.max_langs).collect()}
    if not counts:
        return fit([], s)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(s.per_lang / n))])
    rank = F.xxhash64("doc_id", F.lit(s.seed))
    some = known.where(F.pmod(rank, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    rows = some.select("text", "lang", rank.alias("r")).orderBy("r", "text").limit(s.max_rows).collect()
    return fit([(r["text"], r["lang"]) for r in rows if any(map(str.isalpha, r["text"]))], s)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and accepted, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [predict(model, t.as_py()) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select(F.col("doc_id").cast("long"), held_out("doc_id").alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def op2(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return identify(docs, train(docs, settings))
