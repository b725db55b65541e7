import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geofuse.llm import periodic
from tests.llm.docs_cases import documents


def smallest_period(w):
    fail, k = [0] * (len(w) + 1), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[len(w)]


def plain_runs(w, minimum=6, exponent=4):
    """By the wording: for each q the longest stretches whose words q apart are identical and that have q as smallest period."""
    out, w = [], list(w)
    ids = np.array([{x: i for i, x in enumerate(dict.fromkeys(w))}[x] for x in w]) if w else np.zeros(0)
    for q in range(1, len(w) // exponent + 1):
        same = np.r_[False, ids[:-q] == ids[q:], False]
        edges = np.flatnonzero(np.diff(same.astype(int)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + q >= max(minimum, exponent * q) and smallest_period(w[a : b + q]) == q:
                out.append((a, b - a + q, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def together(texts, **kw):
    sizes = [len(t) for t in texts]
    words = np.array([x for t in texts for x in t], "int64")
    rows = periodic.find_runs(words, np.repeat(np.arange(len(texts)), sizes), **kw)
    out, first = [], 0
    for n in sizes:
        out.append([(a - first, b - a, q) for a, b, q in rows.tolist() if first <= a < first + n])
        first += n
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6))
def test_equals_definition_on_small_alphabets(texts):
    assert together(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.data())
def test_equals_definition_on_planted_periods(data):
    texts = []
    for _ in range(data.draw(st.integers(1, 4))):
        text = []
        for _ in range(data.draw(st.integers(1, 4))):
            p = data.draw(st.lists(st.integers(0, 4), min_size=1, max_size=9))
            text += (p * 12)[: data.draw(st.integers(1, 80))]
        texts.append(text)
    assert together(texts) == [plain_runs(t) for t in texts]
    assert together(texts, minimum=9, exponent=5) == [plain_runs(t, 9, 5) for t in texts]


def test_shared_passages_are_compressed_once():
    """Copies of a text make one root's worth of rules, and runs are found in each copy."""
    rng = np.random.default_rng(1)
    text = [*rng.integers(0, 500, 300).tolist(), *[1, 2, 3] * 40, *rng.integers(0, 500, 300).tolist()]
    one, many = (periodic.Grammar(np.array(text * k), np.repeat(np.arange(k), len(text))) for k in (1, 50))
    assert len(many.left) <= len(one.left) + 50
    assert together([text] * 50) == [plain_runs(text)] * 50


@pytest.mark.parametrize("text", [[0] * 200_000, [0, 1, 2] * 70_000, list(range(1000)) * 200, list(range(200_000))])
def test_long_texts_are_near_linear(text):
    began = time.process_time()
    rows = together([text])[0]
    assert time.process_time() - began < 20
    p = smallest_period(text)
    assert rows == ([(0, len(text), p)] if p * 4 <= len(text) else [])


def test_nested_grammar_gives_back_the_text():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 30, 4000)
    g = periodic.Grammar(words, np.repeat(np.arange(8), 500))
    for rule in range(len(g.left)):
        stack, out = [g.n_words + rule], []
        while stack:
            s = stack.pop()
            if s < g.n_words:
                out.append(s)
            else:
                stack += [int(g.right[s - g.n_words]), int(g.left[s - g.n_words])]
        a = int(g.start[rule])
        assert out == words[a : a + len(out)].tolist() and len(out) == g.lsize[rule] + g.rsize[rule]


def expected(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *head, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in drop))


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_equals_definition(spark, sf):
    df = periodic.op11_periodic_runs(spark, sf)
    assert df.columns == COLUMNS and {t for c, t in df.dtypes if not c.endswith("256")} == {"bigint"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = order(expected(*r) for r in docs)
    assert order(map(tuple, df.collect())) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark, tmp_path):
    """Nulls, empty, blank and long texts, repeats, clashing columns; every id, so that tails are made, too."""
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows += [(i, t) for i in range(100, 180) for t in ("a b a b c d e f g h i j k l m n o p", "word", "é ü x\x0by\x0cz\x1cw   a", " ")]
    documents(spark, [(i, t, "l", "s", 1) for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    got = order(map(tuple, periodic.op11_periodic_runs(spark, str(tmp_path)).collect()))
    assert got == order(expected(*r) for r in rows)
    assert periodic.periodic_runs(documents(spark).limit(0)).count() == 0


def test_operator_gives_spans_and_text(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b y")], "doc_id long, text string")
    row = periodic.periodic_runs(docs).first()
    assert (row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (10, [(1, 8, 2)], "x a b y")
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, exponent=2)
