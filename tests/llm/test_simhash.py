import random
import re

import xxhash
from pyspark.sql import functions as F

from geofuse.llm import simhash
from geofuse.plans.components import components
from tests.llm.docs_cases import documents


def plain_fingerprint(text, n=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows):
    """rows of (doc_id, fp) -> {doc_id: component}, by comparing all with all."""
    by = {}
    for d, f in rows:
        by.setdefault(f, []).append(d)
    fps, root = list(by), {f: f for f in by}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for f, ds in by.items():
        least[find(f)] = min([least.get(find(f), 1 << 62), *ds])
    return {d: least[find(f)] for d, f in rows}


def test_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = plain_components(rows)
    out = simhash.op8_simhash(spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in out} == {d: f"{f:016x}" for d, f in rows}
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert len(out) == len(rows)


def test_links_lose_nothing(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(8):
            g = f
            for b in rng.sample(range(64), rng.choice((1, 1, 2, 2, 3))):
                g ^= 1 << b
            fps.add(g)
            f = g if rng.random() < 0.3 else f
    signed = [simhash._signed(f) for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & mask).count("1") <= 2}
    assert got == want and len(want) > 300


def test_odd_rows(spark):
    docs = documents(spark)
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == docs.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[3] == by[4] == by[5] == {3} and by[1] == by[2] == {1} and 1 in by[10]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(500, i) for i in range(501, 700)]
    rows = spark.createDataFrame([*chain, *star, (7, 7), (9, 8), (8, 9)], "a long, b long").withColumn("salt", F.lit(1))
    got = {r["node"]: r["root"] for r in components(rows).collect()}
    assert got == {i: 100 for i in range(100, 181)} | {i: 500 for i in range(500, 700)} | {8: 8, 9: 8}


def test_groups_without_ids_and_under_one_id_stay_apart(spark):
    texts = {"a": "red boats lie in the old harbour at dawn", "b": "nobody counted seven grey stones behind that mill", "c": "the train to the north leaves late on sundays"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (7, texts["c"]), (7, "quite another matter is told under this same number"), (8, texts["c"])]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted((i or 0, t) for i, t in {*rows[:5]})
