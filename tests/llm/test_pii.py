import hashlib
import re

import pytest
from pyspark.sql import functions as F

from geofuse.llm import pii
from tests.llm.docs_cases import documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 10 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    spans = [(m.start(), i, m.end()) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return sorted(spans)


def base(found):
    return [(s["s"], s["k"], s["e"]) for s in found["base_spans"]]


NOTHING = pii.Boosted([], float("inf"))


def test_base_spans_equal_plain_regexes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = pii.find_pii(docs, NOTHING).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert base(r) == brute(texts[r["doc_id"]])
    assert sum(len(base(r)) for r in rows) > 20


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c_d@e.f x@y @z.w a@@b.c q@r.s.t. .@a.b",
        "1.2.3.4.5.6.7.8 300.1.1.1.5.6.7 0001.002.3.255 1.2.3",
        "4111 1111 1111 1111 4111111111111111-2 12345678901234567890 4111-1111-1111-1111x 1 4111  1111",
        "+1 (499) 555-6503 +12 +123456789012345678 +1-2-3-4-5-6-7-8-9-0) ++15551234567",
        "é\U0001f600 a@b.co \U0001f600 10.0.0.1",
        "7" * 5000 + " a" * 3000 + "b@" * 500 + "1.1.1.1 " * 700,
        "a" * 200000,
    ],
)
def test_hard_texts(spark, text):
    r = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string"), NOTHING).first()
    assert base(r) == brute(text)


def test_odd_rows_and_fit(spark):
    docs = documents(spark)
    model = pii.fit(docs)  # too few candidates of both labels: nothing is added
    rows = pii.find_pii(docs, model).collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[8]["n_email"], by_id[8]["n_phone"], by_id[8]["n_ip"]) == (1, 1, 1)
    assert by_id[9]["n_card"] == 1 and by_id[9]["n_ip"] == 3
    assert base(by_id[1]) == []
    assert pii.find_pii(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_query_keeps_base_and_digest(spark, sf):
    out = pii.op1_pii(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        tags = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute(texts[r["doc_id"]])]
        assert r["base_sha256"] == hashlib.sha256(",".join(tags).encode()).hexdigest()
        assert set(tags) <= set(r["spans"].split(","))


def test_trees_score_and_redact(spark):
    model = pii.Boosted([(1.0, ("digits", 9.0, (-1.0,), (1.0,)))], 0.5)
    docs = spark.createDataFrame([(1, "call 499 555 6503 12 or a@b.co"), (2, None), (3, "clean")], "doc_id long, text string")
    found = pii.find_pii(docs, model)
    assert {r["doc_id"]: r["text"] for r in pii.redact(docs, found).collect()} == {1: "call [phone] or [email]", 2: None, 3: "clean"}
    assert found.filter(F.size("spans") > 0).count() == 1


def test_every_document_is_learned_from(spark, monkeypatch):
    """One document of 3000 has candidates of its own: a sample of 2000 by the hash of ids leaves it out."""
    ids = spark.range(3000).orderBy(F.xxhash64("id"), "id").collect()
    last = ids[-1]["id"]
    text = F.when(F.col("id") == last, "call 021 555 0199 22 or +64 21 555 0199 now").otherwise("nothing here")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"))
    kept = []
    monkeypatch.setattr(pii, "stored", lambda df, label: kept.append(df) or df)
    pii.fit(docs)
    assert kept[0].agg(F.sum("n")).first()[0] == 2
