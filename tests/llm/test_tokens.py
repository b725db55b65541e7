import base64
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geofuse.llm import token_counts, token_ids
from geofuse.llm.shared import new_dir
from tests.llm.docs_cases import documents

SP = P.path("piece_bpe_32k.model")
BPE = P.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  two  spaces ", " lead", "trail ", "tab\t x", "x \ty", "line\nnext  \n\n z", "it's we're 's", "a b  c  d",
    "<|endoftext|> a <|endoftext|>b c<|endoftext|> d", "\x1c a \x1d b", "é́ \U0001f600 中文 x", "a" * 3000, "1 22 333 4444,5 ...!?", "<s> </s> <unk> x",
]


def test_encoder_equals_library():
    t, e = Tokenizer.from_file(BPE), token_ids.Encoder(BPE, room=800)
    for text in [*ODD, " ".join(ODD), "\n".join(ODD), "w " * 50 + "z" * 500, "w " + "z" * 500 + " \n w"]:
        assert np.frombuffer(e(text), e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids, text
        assert e.held <= 800 + 20000 and all(len(w) <= token_ids.LONGEST for w in e.words)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab'sT1. \n\t é!中\x1c"), max_size=30))
def test_encoder_equals_library_on_any_text(text):
    t, e = Tokenizer.from_file(BPE), token_ids.encoder(BPE)
    assert np.frombuffer(e(text), e.dtype).tolist() == t.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 5000), max_size=700), st.integers(0, 1 << 40))
@settings(max_examples=60, deadline=None)
def test_elias_fano_round_trip(gaps, first):
    values = np.cumsum([first, *gaps]).astype("uint64")
    ef = token_ids.EliasFano.build(values)
    head, parts = ef.sections()
    ef = token_ids.EliasFano.load(head, b"".join(parts))
    assert [v for k in range(-(-len(values) // token_ids.SAMPLE)) for v in ef.block(k).tolist()] == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.arange(0, 10**7, 1000)
    _, parts = token_ids.EliasFano.build(values).sections()
    assert sum(map(len, parts)) * 8 < len(values) * 13


def test_shards_round_trip(spark, sf):
    t = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start, want = 0, {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    out = token_ids.op9_token_ids(spark, sf).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in out} == want
    shards = token_ids.write_tokens(docs, BPE, new_dir(spark, "t")).collect()
    shard = token_ids.Shard(shards[-1]["path"])
    for i in (0, len(shard.doc_ids) // 2, len(shard.doc_ids) - 1):
        ids = shard.ids(i)
        assert zlib.crc32(ids.astype("<u4").tobytes()) == want[shard.doc_ids[i]][2]


def test_odd_rows(spark):
    docs = documents(spark)
    out = token_ids.read_tokens(token_ids.write_tokens(docs, BPE, new_dir(spark, "t"))).collect()
    assert len(out) == docs.count() and sum(r["doc_id"] is None for r in out) == 1
    rows = sorted(out, key=lambda r: r["start"])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    assert token_ids.read_tokens(token_ids.write_tokens(docs.limit(0), BPE, new_dir(spark, "t"))).count() == 0
    counted = token_counts.token_counts(docs, SP).collect()
    assert len(counted) == docs.count() and {r["n_tokens"] for r in counted if r["doc_id"] in (1, 2)} == {0}
    assert token_counts.token_counts(docs.limit(0), SP).count() == 0


ideographs = "".join(chr(0x4E00 + i * 7919 % 6000) for i in range(3000))
BASE64 = base64.b64encode(random.Random(3).randbytes(3000)).decode()


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (100, 4), (333, 64)])
def test_chunks_equal_whole(chunk, overlap):
    p, joined = token_counts.processor(SP)
    texts = [*ODD, " ".join(ODD * 3), "no spaces" + "xé" * 900, " " * 500 + "end", ("word  two   three\n" * 99), ideographs, BASE64, f"{ideographs} {BASE64}{'x' * 999}"]
    for text in texts:
        assert token_counts.chunked_count(p, joined, text, chunk, overlap) == len(p.encode(text)), text[:50]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcthe er ▁é\n 中的國1Zq/+\U0001f600"), max_size=200))
def test_chunks_equal_whole_on_any_text(text):
    p, joined = token_counts.processor(SP)
    assert token_counts.chunked_count(p, joined, text, 30, 4) == len(p.encode(text))


@pytest.mark.parametrize("text", [ideographs * 100, BASE64 * 75, "x" * 300000, "word " * 60000], ids=["ideographs", "base64", "run", "words"])
def test_long_texts_take_linear_time(text):
    p, joined = token_counts.processor(SP)
    began = time.process_time()
    want = len(p.encode(text))
    whole = time.process_time() - began
    began = time.process_time()
    assert token_counts.chunked_count(p, joined, text) == want
    assert time.process_time() - began < 3 * whole + 0.5


def test_counts_equal_library(spark, sf):
    p = sentencepiece.SentencePieceProcessor(model_file=SP)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in token_counts.op5_token_counts(spark, sf).collect():
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(p.encode(t))) and r["over_limit"] == (r["n_tokens"] > 4096)
