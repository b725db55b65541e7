import re

import numpy as np
import pandas as pd
import pytest

from geofuse.llm import mixing
from tests.llm.docs_cases import documents


def water(sizes, cap=3.0):
    """Targets by the wording: what is above the cap is reshared among the rest until none is above."""
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (1, 2, 3)[i % 3] for i, k in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = [k for k in order if k not in stopped]
        share = (total - sum(stopped.values())) / max(1e-300, sum(weight[k] for k in left))
        over = [k for k in left if share * weight[k] > cap * sizes[k]]
        if not over:
            return stopped | {k: share * weight[k] for k in left}
        stopped |= {k: cap * sizes[k] for k in over}


def check(docs, out):
    sizes, sources = {}, {}
    for r in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
    want = water(sizes)
    assert len(out) == len(docs)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    taken = {}
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    return want, taken, sizes


def test_mix_meets_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix(docs).collect()
    want, taken, _ = check(docs.collect(), out)
    for k in want:
        assert taken[k] == pytest.approx(want[k], rel=0.02)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_odd_rows(spark):
    docs = documents(spark)
    check(docs.collect(), mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_capped_and_empty_sources(spark):
    rows = [(i, "w " * 100, "big", None, 0) for i in range(50)] + [(100, "one two", "a", None, 0), (101, None, "b", None, 0), (102, "x y z", None, None, 0)]
    docs = spark.createDataFrame([(i, t, None, s, n) for i, t, s, _, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(docs).collect()
    want, taken, sizes = check(docs.collect(), out)
    assert taken["a"] == 6 and taken["b"] == 0 and taken[None] == 9
    assert abs(taken["big"] - want["big"]) <= 50 and want["big"] < sizes["big"]


def test_allot_carries_the_error():
    sizes = pd.DataFrame({"key": "k", "size": [1000, 10, 1], "n": [1, 30, 30], "rate": 0.4, "cap": 3.0, "source_size": 1330, "target": 532.0})
    out = mixing.allot(sizes)
    n = out["size"].map({1000: 1, 10: 30, 1: 30})
    assert abs((out["size"] * (out["base"] * n + out["extra"])).sum() - 0.4 * 1330) <= 1
    assert ((out["base"] + (out["extra"] > 0)) <= 3).all()


def dense(groups, target, cap, ridge):
    """The dual by plain gradient steps on all unknowns with the full Hessian: groups of (source, size, n)."""
    s, size, n = (np.array(x) for x in zip(*groups))
    words = size * n.astype("float64")
    log = np.log(size)
    mean = (words * log).sum() / words.sum()
    f = (log - mean) / np.sqrt((words * (log - mean) ** 2).sum() / words.sum())
    k = len(target)
    x = np.zeros(k + 1)
    jac = np.zeros((len(s), k + 1))
    jac[np.arange(len(s)), s], jac[:, k] = 1, f
    fixed = np.array(target) >= cap * np.bincount(s, words, k) * (1 - 1e-12)

    def value(x):
        u = jac @ x
        phi = np.where(u < np.log(cap), np.exp(u), cap + cap * (u - np.log(cap)))
        return (words * np.where(fixed[s], cap * u, phi)).sum() - x[:k] @ np.where(fixed, 0, target) + ridge / 2 * words.sum() * x[k] ** 2

    for _ in range(400):
        r = np.where(fixed[s], cap, np.minimum(cap, np.exp(jac @ x)))
        grad = jac.T @ (words * r) - np.append(target, -ridge * words.sum() * x[k])
        grad[:k][fixed] = 0
        w = np.where(fixed[s], 0, words * np.where(r >= cap, 1e-3 * r, r))
        hess = jac.T @ (jac * w[:, None]) + np.diag(np.append(np.where(fixed, 1.0, 0.0), ridge * words.sum()))
        step, t = np.linalg.solve(hess, -grad), 1.0
        while value(np.where(np.append(fixed, False), 0, x + t * step)) > value(x) and t > 1e-9:
            t /= 2
        x = np.where(np.append(fixed, False), 0, x + t * step)
    return x[k], r, f


@pytest.mark.parametrize("share", [(0.7, 0.2, 0.1), (0.1, 0.2, 0.7), (0.02, 0.9, 0.08)])
def test_dual_equals_a_dense_solver(spark, share):
    rng = np.random.default_rng(4)
    groups = [(s, int(z), int(rng.integers(1, 9))) for s in range(3) for z in np.unique(rng.lognormal(3 + s, 1, 40).astype(int) + 1)]
    words = np.bincount([s for s, _, _ in groups], [z * n for _, z, n in groups])
    target = [min(3 * w, x * words.sum()) for w, x in zip(words, share)]
    sizes = spark.createDataFrame([(str(s), z, n) for s, z, n in groups], "key string, size long, n long")
    sources = spark.createDataFrame([(str(s), int(words[s]), float(target[s])) for s in range(3)], "key string, source_size long, target double")
    out, mu = mixing.balanced(sizes, sources, 3.0)
    got = {(int(r["key"]), r["size"]): r["rate"] for r in out.collect()}
    want_mu, want, f = dense(groups, target, 3.0, mixing.RIDGE)
    assert mu == pytest.approx(want_mu, abs=1e-4) and abs(mu) > 0.01
    for (s, z, _), r in zip(groups, want):
        assert got[(s, z)] == pytest.approx(r, rel=1e-3)
    took = [sum(got[(s, z)] * z * n for s, z, n in groups if s == k) for k in range(3)]
    assert took == pytest.approx(target, rel=1e-4)


def test_closing_is_within_a_short_document():
    rng = np.random.default_rng(6)
    for _ in range(300):
        size = np.unique(rng.integers(1, rng.choice([30, 3000]), rng.integers(1, 30)))
        n = rng.integers(1, 6, len(size))
        total = int((size * n).sum())
        target = float(rng.uniform(0, 3 * total))
        sizes = pd.DataFrame({"key": "k", "size": size, "n": n, "rate": rng.uniform(0, 3, len(size)), "cap": 3.0, "source_size": total, "target": target})
        out = mixing.allot(sizes).sort_values("size")
        copies = out["base"].to_numpy() * n + out["extra"].to_numpy()
        assert (copies >= 0).all() and (copies <= 3 * n).all()
        off = target - (copies * size).sum()
        movable = size[copies < 3 * n] if off > 0 else size[copies > 0]
        assert abs(off) < 1 or abs(off) < movable.min()


def test_extreme_targets_converge_or_fail_aloud(spark):
    groups = [("a", z, n) for z, n in ((1, 50), (7, 9), (300, 40), (900, 10))] + [("b", z, n) for z, n in ((2, 30), (40, 9), (80, 261), (90, 1))]
    words = sum(z * n for s, z, n in groups if s == "a")
    other = sum(z * n for s, z, n in groups if s == "b")
    sizes = spark.createDataFrame(groups, "key string, size long, n long")
    sources = spark.createDataFrame([("a", words, 2.9 * words), ("b", other, 1e-6 * other)], "key string, source_size long, target double")
    out, _ = mixing.balanced(sizes, sources, 3.0)
    took = {k: sum(r["rate"] * r["size"] * r["n"] for r in out.collect() if r["key"] == k) for k in "ab"}
    assert took["a"] == pytest.approx(2.9 * words, rel=1e-6) and took["b"] == pytest.approx(1e-6 * other, rel=1e-6)
    with pytest.raises(ArithmeticError):
        mixing.balanced(sizes, sources, 3.0, passes=2)
