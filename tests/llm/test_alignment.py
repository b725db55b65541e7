import hashlib
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geofuse.llm import alignment
from tests.llm.docs_cases import documents

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  two  spaces ", " lead", "trail ", "tab\t x", "line\nnext  \n\n z", "it's we're 's", "<|endoftext|> a <|endoftext|>b <s> </s> <unk>", "中文 é́ \U0001f600 ﬁ x",
    "has ▁ a mark", "\x1c a \x1d b\x00c", "a" * 3000, "one    two　three", "x",
]


class Plain:
    """By the wording, token by token."""

    def __init__(self):
        self.t = Tokenizer.from_file(A)
        self.t.encode_special_tokens = True
        self.p = sentencepiece.SentencePieceProcessor(model_file=B)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}

    def tokens(self, text):
        if not text:
            return [], []
        a = self.t.encode(" " + text, add_special_tokens=False).ids
        b = self.p.encode(text)
        a = [(i, bytes(self.byte[c] for c in self.t.id_to_token(i))) for i in a]
        piece = lambda i: bytes([int(self.p.id_to_piece(i)[3:5], 16)]) if self.p.is_byte(i) else self.p.id_to_piece(i).replace("▁", " ").encode()
        b = [(i, piece(i)) for i in b]
        whole = b" " + text.encode()
        return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])

    def rows(self, docs):
        found, held = [], defaultdict(set)
        for d, (doc_id, text) in enumerate(docs):
            a, b = self.tokens(text)
            ranges = []
            for own in (a, b):
                at, out = 0, []
                for i, x in own:
                    out.append((i, at, at + len(x)))
                    at += len(x)
                ranges.append(out)
            cuts = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
            parts = [([], []) for _ in cuts]
            for side, own in enumerate(ranges):
                for i, s, _ in own:
                    parts[bisect_right(cuts, s)][side].append(str(i))
            groups = [";".join("|".join(map(",".join, part)) for part in parts)]
            starts, links = 0, []
            for i, s, e in ranges[0]:
                while ranges[1][starts][2] <= s:
                    starts += 1
                k = starts
                while k < len(ranges[1]) and ranges[1][k][1] < e:
                    links.append((i, ranges[1][k][0]))
                    k += 1
            for pair in links:
                held[pair].add(d)
            found.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(groups[0].encode()).hexdigest() if a else ""))
        most = Counter()
        for (i, _), ds in held.items():
            most[i] = max(most[i], len(ds))
        return [(d, na, nb, g, len(ls), sum(len(held[p]) == most[p[0]] for p in ls), sum(len(held[p]) for p in ls), sha) for d, na, nb, g, ls, sha in found]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple(map(str, r)))


def test_op12_equals_wording(spark, sf):
    df = alignment.op12_alignment(spark, sf)
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for c, t in df.dtypes if c != "groups_sha256"} == {"bigint"}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert order(df.collect()) == order(Plain().rows(docs))


@pytest.mark.parametrize("most", [alignment.TABLE, 0])
def test_odd_rows_by_table_and_by_join(spark, most):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] * 2
    docs = documents(spark, [(i, t, "l", "s", 1) for i, t in rows])
    want = Plain().rows(rows)
    assert order(alignment.alignment_statistics(docs, A, B, most=most).collect()) == order(want)
    assert sum(r[1] == 0 for r in want) >= 5
    assert alignment.alignment_statistics(docs.limit(0), A, B, most=most).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(1, 4), min_size=1, max_size=12))
def test_groups_and_links_equal_all_pairs(a, b):
    a[-1] += max(0, sum(b) - sum(a))
    b[-1] += max(0, sum(a) - sum(b))
    ea, eb = np.cumsum(a), np.cumsum(b)
    overlap = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(ea[i] - a[i], eb[j] - b[j]) < min(ea[i], eb[j])]
    assert list(zip(*map(list, alignment.links_of(ea, eb)))) == overlap
    shared = sorted(set(ea.tolist()) & set(eb.tolist()))
    for ends, groups in zip((ea, eb), alignment.groups_of(ea, eb)):
        assert groups.tolist() == [sum(c < e for c in shared) for e in ends]


def test_groups_are_given_and_sides_may_be_swapped(spark):
    docs = spark.createDataFrame([(1, "Hello tokenizers, 中")], "doc_id long, text string")
    one, two = alignment.aligned(docs, A, B).first(), alignment.aligned(docs, B, A).first()
    swap = lambda s: ";".join("|".join(reversed(g.split("|"))) for g in s.split(";"))
    assert one["groups"].decode() == swap(two["groups"].decode()) and one["n_links"] == two["n_links"] > 4
