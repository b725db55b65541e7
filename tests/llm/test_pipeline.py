import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from geofuse.llm import decontaminate, mixing, quality
from geofuse.llm.shared import stored
from tests.llm.docs_cases import documents
from tests.llm.test_near_copies import plain_kept


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect()}

    want = {i for i, r in rows.items() if model.score(quality.encode((r["text"] or "").encode())) >= 0.3}
    out = stored(cp.keep_quality(spark, docs, sf), "t")
    assert {r["doc_id"] for r in out.collect()} == want and out.columns == docs.columns
    assert 0.6 * len(rows) < len(want) < len(rows)

    want = set(plain_kept([(i, rows[i]["text"] or "") for i in want]))
    out = stored(cp.drop_near_copies(spark, out, sf), "t")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want) and out.columns == docs.columns

    items = [decontaminate.tokens(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {i for i in want if not any(decontaminate.share(decontaminate.tokens(rows[i]["text"]), item, 0.8) >= 0.8 for item in items)}
    out = stored(cp.drop_leaks(spark, out, sf), "t")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(want) and out.columns == docs.columns

    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(out).collect()}
    out = stored(cp.mix_sources(spark, out, sf), "t")
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}

    t, start, want = Tokenizer.from_file(P.path("byte_bpe_50k.json")), 0, []
    for i in sorted(copies):
        ids = [*t.encode(rows[i]["text"], add_special_tokens=False).ids, 2]
        for _ in range(copies[i]):
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    out = cp.write_token_shards(spark, out, sf)
    assert sorted(map(tuple, out.collect())) == want
    assert cp.run(spark, sf).agg(F.sum("n_tokens")).first()[0] == start


def test_stages_on_odd_rows(spark, sf):
    docs = documents(spark)
    for d in (docs, docs.limit(0)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, d, sf)
            assert out.columns == docs.columns, name
            n = out.count()
            assert n <= 3 * d.count()
    kept = [(r["doc_id"], r["text"]) for r in cp.drop_near_copies(spark, docs, sf).collect()]
    assert sorted((i or 0, t or "") for i, t in kept) == sorted(
        [(1, ""), (3, "the same words in the same order here again"), (6, "word " * 30000), (7, "x" * 20000), (0, "no id but a text"), (10, "one id twice")]
        + [(i, t) for i, t in [(8, None), (9, None)] if t]
        + [(r["doc_id"], r["text"]) for r in docs.filter("doc_id IN (8, 9)").collect()]
    )
