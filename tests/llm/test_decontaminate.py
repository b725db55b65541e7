import random
import time

import numpy as np
import pytest

from geofuse.llm import decontaminate as dc
from tests.llm.docs_cases import documents


def plain(text, item, least=0.8):
    """The same share by laying the item at every place."""
    w, n = dc.tokens(text), len(item)
    if n < 5:
        return float(any(w[i : i + n] == item for i in range(len(w) - n + 1)))
    covered, best = set(), 0
    for d in range(-n + 1, len(w)):
        same = [0 <= j + d < len(w) and w[j + d] == item[j] for j in range(n)]
        best = max(best, sum(same) / n)
        for s in range(n - 4):
            if sum(same[s : s + 5]) >= 5 * least:
                covered |= {j for j in range(s, s + 5) if same[j]}
    return max(best, len(covered) / n)


def test_equals_every_alignment(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r["text"]) < 4000}
    items = {r["item_id"]: dc.tokens(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    out = {r["doc_id"]: r["item_ids"] for r in dc.op2_decontaminate(spark, sf).collect()}
    for d, text in list(docs.items())[:60]:
        assert out[d] == sorted(i for i, w in items.items() if plain(text, w) >= 0.8)
    assert sum(map(bool, out.values())) > 2
    low = {d: " ".join(t.lower().split()) for d, t in docs.items()}
    exact = {d for d, t in low.items() for w in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if " ".join(w["text"].lower().split()) in t}
    assert exact <= {d for d, x in out.items() if x}


def test_changed_passages_are_found(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.choice((5, 6, 11, 25, 50)))]) for i in range(40)]
    rows = []
    for i, w in items:
        changed = list(w)
        for j in rng.sample(range(len(w)), len(w) // 5):
            changed[j] = "changed"
        filler = [rng.choice(vocabulary) for _ in range(80)]
        rows.append((i, " ".join(filler + changed + filler)))
        rows.append((1000 + i, " ".join(filler + [x for k, x in enumerate(w) if k % 2] + filler)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w).upper() + "!") for i, w in items], "item_id long, text string")
    one = {r["doc_id"]: [x["item_id"] for x in r["items"]] for r in dc.decontaminate(docs, bench).collect()}
    share = {d: {i for i, w in items if plain(t, [x.encode() for x in w]) >= 0.8} for d, t in rows}
    assert all(i in share[i] for i, _ in items)
    assert {d: set(x) for d, x in one.items()} == share
    # all four fifths in place: a hit is certain; the share then counts the words in near-whole spans
    assert all(len(dc.diagonals(dc.hashed(dc.tokens(t)), dc.hashed(dc.tokens(" ".join(w))))) for (_, t), (_, w) in zip(rows[::2], items))
    assert sorted(r["doc_id"] for r in dc.clean(docs, bench).collect()) == sorted(d for d, x in share.items() if not x)


def test_share_equals_every_alignment():
    rng = random.Random(8)
    for _ in range(300):
        vocabulary = [b"w%d" % i for i in range(rng.choice((2, 5, 50)))]
        item = [rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 5, 6, 9, 20)))]
        doc = [rng.choice(vocabulary) for _ in range(rng.randrange(30))] + [w if rng.random() < 0.85 else b"x" for w in item] + [rng.choice(vocabulary) for _ in range(9)]
        want = plain(b" ".join(doc).decode(), item)
        got = dc.share(doc, item, 0.8)
        assert got <= want + 1e-12 and (want < 0.8 or got == want)


def test_long_runs_of_one_word():
    began = time.process_time()
    assert dc.share([b"word"] * 1_000_000, [b"word"] * 100, 0.8) == 1
    assert dc.share([b"word"] * 1_000_000, [b"word"] * 60 + [b"x"] * 40, 0.8) == pytest.approx(0.6)
    assert time.process_time() - began < 60


def test_odd_rows(spark):
    docs = documents(spark)
    bench = spark.createDataFrame([(1, None), (2, " "), (None, "the same words in"), (3, "id twice"), (4, "same words in the same order here"), (4, "word " * 6)], "item_id long, text string")
    out = dc.decontaminate(docs, bench).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: [x["item_id"] for x in r["items"]] for r in out}
    assert by[10] in ([], [3]) and by[3] == by[5] == [4] and 4 in by[6] and by[1] == by[2] == []
    assert not any(r["contaminated"] for r in dc.decontaminate(docs, bench.limit(0)).collect())
    assert dc.decontaminate(docs.limit(0), bench).count() == 0


def test_places_left_out_cannot_suffice():
    rng = random.Random(12)
    for _ in range(400):
        n = rng.choice((5, 7, 12, 20, 33))
        item = [b"i%d" % k for k in range(n)]
        changed = [w if rng.random() < 0.75 else b"x" for w in item]
        doc = [b"y"] * 3 + [w for w in changed if rng.random() < 0.95] + [b"z"] * 3
        own = [set(a.tolist()) for a in dc.seeds(dc.hashed(doc))]
        hit = np.any([[x in found for x in b.tolist()] for found, b in zip(own, dc.seeds(dc.hashed(item)))], axis=0)
        if plain(b" ".join(doc).decode(), item) >= 0.8:
            assert dc.may_suffice(hit, 0.8)
            texts = np.array([rng.randrange(1, 4) for _ in range(n - 4)])
            assert hit[dc.rarest(n, np.arange(n - 4), texts, 0.8)].any()
    for n in range(5, 14):  # against all choices of words out of place
        hit = np.array([rng.random() < 0.5 for _ in range(n - 4)])
        least = min(bin(m).count("1") for m in range(1 << n) if all(h or bin(m >> p & 31).count("1") >= 2 for p, h in enumerate(hit)))
        assert dc.out_of_place(hit) == least


def test_a_shared_sentence_makes_no_pairs(spark):
    rng = random.Random(9)
    sentence = "which of the following answers is the best one for the question below here"
    word = lambda: f"w{rng.randrange(10**9)}"
    text = lambda n: " ".join([*(word() for _ in range(n)), sentence, *(word() for _ in range(n))])
    items = [(i, text(15)) for i in range(2000)]
    rows = [(d, text(40)) for d in range(2000)] + [(5000 + i, f"{text(20)} {items[i][1]} {word()}") for i in range(0, 2000, 400)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    began = time.monotonic()
    out = {r["doc_id"]: [x["item_id"] for x in r["items"]] for r in dc.decontaminate(docs, bench).filter("contaminated").collect()}
    assert out == {5000 + i: [i] for i in range(0, 2000, 400)}
    assert dc.candidates(docs, dc.item_seeds(bench), 0.8).count() == len(out)
    assert time.monotonic() - began < 60


def test_a_text_is_digested_and_seeded_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, None)], "doc_id long, text string")
    items = dc.item_seeds(spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string"))
    found = dc.text_seeds(docs, items)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1 and plan.count("md5(") == 1
    assert plan.index("Generate") < plan.index("md5(")
    assert found.count() >= 20
