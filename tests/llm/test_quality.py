import math
import subprocess
import sys
import zlib

import numpy as np
import pytest

from geofuse.llm import quality
from tests.llm.docs_cases import documents


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = quality.op10_quality(spark, sf).collect()
    assert len(out) == 1000
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) >= 0.95
    assert np.mean([p for p, y in held if y]) >= 0.98


def test_passages_by_hand():
    x = quality.encode(b"AB cd cd 12!\nef|")
    assert x.shape == (1, quality.FEATURES)
    assert x[0, 0] == np.float32(2 / 12) and x[0, 2] == np.float32(2 / 12) and x[0, 8] == np.float32(1 / 5) and x[0, 14] == np.float32(1 / 5)
    assert len(quality.encode(b"w " * 1000)) == -(-1000 // quality.PASSAGE)
    assert not quality.encode(b"").any() and not quality.encode(b" \n ").any()
    a, b = quality.encode(b"one two one two three"), quality.encode(b"   one two one two three")
    assert np.array_equal(a, b)


def test_words_and_triples_by_hand():
    x = quality.encode(b"one two one " + b"Three " * 60)
    words, triples = x[:, quality.STYLE : quality.STYLE + quality.WORDS], x[:, quality.STYLE + quality.WORDS :]
    assert x.shape == (2, quality.FEATURES) and np.allclose(words.sum(axis=1), 1) and np.allclose(triples.sum(axis=1), 1)
    assert sorted(words[0][words[0] > 0].tolist()) == pytest.approx(sorted([2 / 48, 1 / 48, 45 / 48])) and (words[1] > 0).sum() == 1
    t = quality._TRIPLE
    want = np.zeros(quality.TRIPLES)
    for a, b, d in zip(b"ab Ab", b"b Ab", b" Ab"):
        want[(t[0, a] + t[1, b] + t[2, d]) % quality.TRIPLES] += 1 / 3
    assert np.allclose(quality.encode(b"ab Ab")[0, quality.STYLE + quality.WORDS :], want)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    z, starts, y = rng.normal(0, 1, (30, quality.FEATURES)), np.array([0, 4, 5, 17]), np.array([1.0, 0, 0, 1])
    p = {k: a + rng.normal(0, 0.1, a.shape) for k, a in quality.first_weights(quality.FEATURES, 5).items()}
    _, g = quality.loss_and_gradients(p, z, starts, y)
    for k in p:
        for _ in range(12):
            i = tuple(rng.integers(n) for n in p[k].shape)
            ends = []
            for step in (1e-5, -1e-5):
                q = {n: a.copy() for n, a in p.items()}
                q[k][i] += step
                ends.append(quality.loss_and_gradients(q, z, starts, y)[0])
            assert g[k][i] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-8), k


def plain_score(model, x):
    """The score once more, passage by passage."""
    hidden = []
    for row in x.astype("float64"):
        z = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale)]
        hidden.append(z[: quality.STYLE] + [math.tanh(sum(v * e for v, e in zip(z, col))) for col in model.e.T])
    raw = [sum(w * math.tanh(sum(a * b for a, b in zip(h, v))) / (1 + math.exp(-sum(a * b for a, b in zip(h, u)))) for w, v, u in zip(model.w, model.v.T, model.u.T)) for h in hidden]
    share = [math.exp(r) / sum(map(math.exp, raw)) for r in raw]
    rep = [sum(a * h[k] for a, h in zip(share, hidden)) for k in range(len(model.beta))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(rep, model.beta)) - model.bias))


def test_scores_equal_the_plain_formula(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(5), labels)
    got = {r["doc_id"]: r["q"]["score"] for r in quality.classify(docs, model).collect()}
    for r in docs.limit(25).collect():
        x = quality.encode((r["text"] or "").encode())
        assert got[r["doc_id"]] == pytest.approx(plain_score(model, x), abs=1e-9)
    assert np.array_equal(model.e, again.e)
    assert {r["doc_id"] for r in quality.kept(docs, model).collect()} == {d for d, s in got.items() if s >= 0.3}


def test_attention_finds_the_passage_that_decides():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for i in range(300):
        bag = rng.normal(0, 1, (rng.integers(2, 9), quality.FEATURES)).astype("float32")
        if i % 2:
            bag[rng.integers(len(bag)), 3] = 9
        bags.append(bag)
        labels.append(i % 2)
    model = quality.train(bags, np.array(labels))
    assert np.mean([(model.score(b) >= 0.5) == y for b, y in zip(bags, labels)]) > 0.97
    top = [model.weights(model.hidden(b)).argmax() == b[:, 3].argmax() for b, y in zip(bags, labels) if y]
    assert np.mean(top) > 0.9


def test_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(3, 1, 0), (7, 0, 0), (None, 1, 0), (4, None, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    out = quality.classify(docs, model)
    assert out.columns == [*docs.columns, "q"] and out.count() == docs.count()
    assert {r["q"]["score"] for r in out.collect() if r["doc_id"] in (1, 2)} == {model.score(quality.encode(b""))}
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r["q"]["score"] for r in quality.classify(docs, None).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0
    clash = docs.selectExpr("*", "'x' AS q", "'y' AS q_", "1 AS score", "2 AS doc")
    assert quality.classify(clash, model).columns == [*clash.columns, "q__"] and quality.kept(clash, model).columns == clash.columns
    assert quality.kept(clash, None).count() == docs.count()


MEMORY = """
import resource, sys
import numpy as np
from geofuse.llm import quality
p = quality.first_weights(quality.FEATURES, 12)
model = quality.Attention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), p["e"], p["v"], p["u"], p["w"], p["beta"] + 1, 0.0)
data = {"words": b"some words\\n" * 9_500_000, "letters": b"a " * 50_000_000, "one": b"x" * 100_000_000, "blank": b" " * 100_000_000}[sys.argv[1]]
print(model.score_runs(quality.runs(data)), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""


@pytest.mark.parametrize("kind", ["words", "letters", "one", "blank"])
def test_memory_of_a_hundred_megabytes(kind):
    out = subprocess.run([sys.executable, "-c", MEMORY, kind], capture_output=True, text=True, check=True, timeout=600).stdout.split()
    assert 0 <= float(out[0]) <= 1 and int(out[1]) < 1_000_000


def test_runs_are_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["", " \n ", "x" * 5000, "é " * 700, " ".join(rng.choice(["a", "Bb", "c\n", "12!", "word"], 3000)), "\n" * 900 + "a b" + " " * 900 + "c"]
    whole = [quality.encode(t.encode()) for t in texts]
    p = quality.first_weights(quality.FEATURES, 5)
    model = quality.Attention(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), p["e"], p["v"], p["u"], p["w"] * 9, p["beta"] + 1, 0.0)
    monkeypatch.setattr(quality, "STEP", 64)
    monkeypatch.setattr(quality, "RUN", 2 * quality.PASSAGE)
    for t, x in zip(texts, whole):
        assert np.array_equal(np.concatenate(list(quality.runs(t.encode()))), x)
        assert model.score_runs(quality.runs(t.encode())) == pytest.approx(model.score(x), abs=1e-9)
