"""Quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is described by how it is written (case, symbols, repetition, word
lengths) and by what is in it (its words and the letter triples of it, hashed), and encoded by a layer that is
learned with the rest; gated attention weighs the passages, a = softmax(w . (tanh(V h) * sigmoid(U h))), and a
logistic layer scores the weighted passage representation. Only document labels teach it: the weights show which
passages decide.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.llm.shared import small_batches, table

#: Words of a passage; the last one of a document may be shorter.
PASSAGE = 48
SAMPLE_DOCS = 2000
THRESHOLD = 0.3
#: Features of the writing, and buckets of words and of letter triples.
STYLE, WORDS, TRIPLES = 16, 96, 32
FEATURES = STYLE + WORDS + TRIPLES
_CLASS = np.zeros(256, "uint8")
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"|<>{}[]=_/\\^~`", b"!?", b"*#$%&@+", b".,;:'\"()-"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 8
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_MIX = np.random.default_rng(17).integers(1, 1 << 62, size=(64, 256), dtype="uint64") | np.uint64(1)
#: Buckets of triples by three bytes, added up; letter case doesn't count.
_TRIPLE = np.random.default_rng(19).integers(0, TRIPLES, size=(3, 256), dtype="int64")
_TRIPLE[:, 65:91] = _TRIPLE[:, 97:123]


#: Bytes that are looked at at once, and words that are encoded at once: whole passages.
STEP, RUN = 1 << 18, PASSAGE * 512
#: Kinds of bytes, and one more for line ends.
_KIND = _CLASS.astype("int64")
_KIND[10] = 9


def _words(b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of words, block by block: a word's end may come blocks after its start."""
    before = True
    for lo in range(0, len(b), STEP):
        white = _WHITE[b[lo : lo + STEP]]
        turn = np.flatnonzero(white != np.concatenate([[before], white[:-1]])) + lo
        first = 0 if before else 1
        yield turn[first::2], turn[1 - first :: 2]
        before = bool(white[-1])
    yield np.zeros(0, "int64"), np.full(0 if before else 1, len(b))


def _stretches(first: np.ndarray, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (from, to) of the bytes from the first of first to end, the stretches in each (those begin at first), and where they begin in it."""
    for lo in range(int(first[0]), end, STEP):
        hi = min(lo + STEP, end)
        own = np.arange(np.searchsorted(first, lo, "right") - 1, np.searchsorted(first, hi, "left"))
        yield lo, hi, own, np.maximum(first[own], lo) - lo


def _encode(b: np.ndarray, start: np.ndarray, stop: np.ndarray, end: int, known: int) -> np.ndarray:
    """The passages of the words from the one of number known on; those before it are context. The last word's white space ends at end.

    Work takes some 60 bytes a byte of a block and a word, whatever the length of words.
    """
    word = np.zeros(len(start), "uint64")
    for lo, hi, own, at in _stretches(start, end):
        x, length = b[lo:hi], np.diff(np.append(at, hi - lo))
        place = np.arange(lo, hi) - np.repeat(start[own], length)
        word[own] += np.add.reduceat(np.where(_WHITE[x], np.uint64(0), _MIX[place & 63, x]), at)
    order = np.argsort(word, kind="stable")
    same, again = np.zeros(len(word), "int32"), np.zeros(len(word), "int32")
    same[1:] = word[1:] == word[:-1]
    repeat = word[order[1:]] == word[order[:-1]]
    again[order[1:][repeat]] = (order[1:] - order[:-1])[repeat] <= 2 * PASSAGE
    start, stop, word, same, again = (x[known:] for x in (start, stop, word, same, again))
    n, at = len(start), np.arange(0, len(start), PASSAGE)
    out = np.zeros((len(at), FEATURES), "float32")
    words = np.diff(np.append(at, n)).astype("float32")
    first, length = start[at], stop - start
    kinds, triples = np.zeros((len(at), 10), "int64"), np.zeros((len(at), TRIPLES), "int64")
    for lo, hi, own, begin in _stretches(first, end):
        of = np.repeat(own - own[0], np.diff(np.append(begin, hi - lo)))
        kinds[own] += np.bincount(of * 10 + _KIND[b[lo:hi]], minlength=10 * len(own)).reshape(-1, 10)
        x = b[lo : min(hi + 2, len(b))]
        triple = (_TRIPLE[0, x[:-2]] + _TRIPLE[1, x[1:-1]] + _TRIPLE[2, x[2:]]) % TRIPLES
        triples[own] += np.bincount(of[: len(triple)] * TRIPLES + triple, minlength=TRIPLES * len(own)).reshape(-1, TRIPLES)
    out[:, :8] = kinds[:, 1:9] / np.maximum(1, np.add.reduceat(length, at)).astype("float32")[:, None]
    out[:, 8] = np.add.reduceat(same, at) / words
    out[:, 9] = np.add.reduceat(again, at) / words
    out[:, 10] = np.add.reduceat(length, at) / words / 8
    out[:, 11] = np.add.reduceat((length > 12).astype("int32"), at) / words
    begins, ends = _CLASS[b[start]], _CLASS[b[stop - 1]]
    out[:, 12] = np.add.reduceat(((begins == 1) & (ends != 1)).astype("int32"), at) / words
    out[:, 13] = np.add.reduceat(np.isin(ends, (4, 5, 6)).astype("int32"), at) / words
    out[:, 14] = np.minimum(1, kinds[:, 9] / words)
    out[:, 15] = np.minimum(words / PASSAGE, 1)
    bucket = (word * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype("int64") % WORDS
    counts = np.bincount(np.arange(n) // PASSAGE * WORDS + bucket, minlength=len(at) * WORDS).reshape(-1, WORDS)
    out[:, STYLE : STYLE + WORDS] = counts / words[:, None]
    out[:, STYLE + WORDS :] = triples / np.maximum(1, triples.sum(axis=1, keepdims=True))
    return out


def runs(data: bytes) -> Iterator[np.ndarray]:
    """(passages, FEATURES) of runs of a text's passages in order; one passage of zeros where it has no words.

    Memory is that of the text and one run, for any length of the text and of its words.
    """
    b = np.frombuffer(data, "uint8")
    start, stop, known = np.zeros(0, "int64"), np.zeros(0, "int64"), 0
    for more, ends in _words(b):
        start, stop = np.concatenate([start, more]), np.concatenate([stop, ends])
        while len(stop) > known + RUN:
            last = known + RUN
            yield _encode(b, start[:last], stop[:last], int(start[last]), known)
            start, stop, known = start[last - 2 * PASSAGE :], stop[last - 2 * PASSAGE :], 2 * PASSAGE
    if len(start) > known:
        yield _encode(b, start, stop, len(b), known)
    elif not known:
        yield np.zeros((1, FEATURES), "float32")


def encode(data: bytes) -> np.ndarray:
    """(passages, FEATURES) of a text in UTF-8; one passage of zeros where it has no words."""
    return np.concatenate(list(runs(data)))


@dataclass
class Attention:
    """The network's weights; passages are standardised by mean and scale first."""

    mean: np.ndarray
    scale: np.ndarray
    e: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    beta: np.ndarray
    bias: float

    def hidden(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z[:, :STYLE], np.tanh(z @ self.e)], axis=1)

    def raw(self, h: np.ndarray) -> np.ndarray:
        return (np.tanh(h @ self.v) / (1 + np.exp(-np.clip(h @ self.u, -30, 30)))) @ self.w

    def weights(self, h: np.ndarray) -> np.ndarray:
        raw = self.raw(h)
        a = np.exp(raw - raw.max())
        return a / a.sum()

    def score(self, x: np.ndarray) -> float:
        return self.score_runs([x])

    def score_runs(self, parts: Iterable[np.ndarray]) -> float:
        """The score of a document from runs of its passages: weights are relative to the highest so far."""
        top, total, sums = -math.inf, 0.0, 0.0
        for x in parts:
            h = self.hidden(x)
            raw = self.raw(h)
            high = max(top, float(raw.max()))
            a, old = np.exp(raw - high), math.exp(top - high)
            total, sums, top = total * old + a.sum(), sums * old + a @ h, high
        z = float((sums / total) @ self.beta + self.bias)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def loss_and_gradients(p: dict[str, np.ndarray], z: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The mean log loss of bags (rows of z, from starts) with labels y, and its gradients."""
    bag = np.repeat(np.arange(len(y)), np.diff(np.append(starts, len(z))))
    t = np.tanh(z @ p["e"])
    h = np.concatenate([z[:, :STYLE], t], axis=1)
    tv, su = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -30, 30)))
    raw = (tv * su) @ p["w"]
    a = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    rep = np.add.reduceat(a[:, None] * h, starts)
    s = 1 / (1 + np.exp(-np.clip(rep @ p["beta"] + p["bias"][0], -30, 30)))
    loss = -float(np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))
    d = (s - y) / len(y)
    g = {"beta": rep.T @ d, "bias": np.array([d.sum()])}
    gh = (d[bag] * a)[:, None] * p["beta"][None, :]
    ga = d[bag] * (h @ p["beta"])
    gr = a * (ga - np.add.reduceat(a * ga, starts)[bag])
    g["w"] = (tv * su).T @ gr
    gtv, gsu = gr[:, None] * p["w"] * su * (1 - tv**2), gr[:, None] * p["w"] * tv * su * (1 - su)
    g["v"], g["u"] = h.T @ gtv, h.T @ gsu
    gh += gtv @ p["v"].T + gsu @ p["u"].T
    g["e"] = z.T @ (gh[:, STYLE:] * (1 - t**2))
    return loss, g


def first_weights(features: int, units: int) -> dict[str, np.ndarray]:
    rng, wide = np.random.default_rng(23), STYLE + units
    return {
        "e": rng.normal(0, 0.3 * math.sqrt(STYLE / features), (features, units)), "v": rng.normal(0, 0.2, (wide, units)), "u": rng.normal(0, 0.2, (wide, units)),
        "w": rng.normal(0, 0.2, units), "beta": np.zeros(wide), "bias": np.zeros(1),
    }


def train(bags: list[np.ndarray], labels: np.ndarray, units: int = 12, epochs: int = 150, rate: float = 0.03, decay: float = 1e-3) -> Attention:
    """Full-batch Adam on the mean log loss, encoder, attention and score together."""
    x = np.concatenate(bags).astype("float64")
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.02
    z = np.clip((x - mean) / scale, -6, 6)
    starts = np.cumsum([0, *map(len, bags[:-1])])
    p = first_weights(z.shape[1], units)
    m1, m2 = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, epochs + 1):
        _, g = loss_and_gradients(p, z, starts, labels.astype("float64"))
        for k in p:
            grad = g[k] + (decay * p[k] if k != "bias" else 0)
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad**2
            p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Attention(mean, scale, p["e"], p["v"], p["u"], p["w"], p["beta"], float(p["bias"][0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Attention | None:
    """Learns from at most sample_docs labelled documents, those of least hash among the rows that aren't held out.

    Their passages alone reach the driver. None where no label is left to learn from; rows without id or label
    are left out, of repeated labels the largest counts. Of documents that share ids the first 2 * sample_docs by
    id and hash of the text are taken, so reruns learn the same.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality").cast("int")).alias("y")).filter(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    @F.pandas_udf("binary")
    def passages(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: zlib.compress(encode((t or "").encode("utf-8", "replace")).tobytes(), 1))

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = picked.join(F.broadcast(known), "doc_id")
    # sample_docs bounds the labels that are broadcast, and with the length of texts what is collected
    found = picked.select("doc_id", "y", F.xxhash64("text").alias("h"), passages("text").alias("x")).orderBy("doc_id", "h").limit(2 * sample_docs)
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], r["h"]))
    if not rows:
        return None
    bags = [np.frombuffer(zlib.decompress(r["x"]), "float32").reshape(-1, FEATURES) for r in rows]
    return train(bags, np.array([r["y"] for r in rows]))


def _score(model: Attention | None) -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series([0.5] * len(texts), dtype="float64")
        return pd.Series([model.score_runs(runs((t or "").encode("utf-8", "replace"))) for t in texts], dtype="float64")

    return score(F.col("text").cast("string"))


def classify(docs: DataFrame, model: Attention | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs' own columns, and the struct (score, predicted) as q; where docs has a q, as q_ (and so on).

    A null or blank text is one empty passage and gets that passage's score. Without a model the score is 0.5.
    """
    small_batches(docs.sparkSession)
    name = "q"
    while name in docs.columns:
        name += "_"
    both = docs.select(F.struct("*").alias("doc"), _score(model).alias("score"))
    return both.select("doc.*", F.struct("score", (F.col("score") >= threshold).cast("int").alias("predicted")).alias(name))


def kept(docs: DataFrame, model: Attention | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs' own rows whose score reaches the threshold."""
    small_batches(docs.sparkSession)
    both = docs.select(F.struct("*").alias("doc"), _score(model).alias("score"))
    return both.filter(F.col("score") >= threshold).select("doc.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "q.score", "q.predicted")


QUERIES = {"op10_quality": op10_quality}
