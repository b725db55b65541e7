"""Cross-tokenizer alignment by interval coalescing.

Each token of two tokenizers covers a range of the text's bytes. The tokens of many documents, one document after
another, are sorted by start; the running maximum of their ends breaks them into groups where a start reaches it, that is
where tokens of both kinds end together. Inside a group every pair of overlapping ranges is a link. A document's
distinct id pairs are kept with it, packed; how many documents hold a pair is counted over all documents, each worker
adding up its own before the shuffle, and looked up for every document's links: in a table that each worker reads from
the shared folder while that has at most TABLE pairs, else by a join.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.llm import token_ids
from geofuse.llm.files import opened
from geofuse.llm.shared import small_batches, stored, table

#: Bytes of text that are aligned together; keys that a worker adds up before it hands them on; pairs of a worker's table.
TOGETHER, HELD, TABLE = 1 << 20, 1 << 21, 1 << 22
MARK = "▁"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, pairs binary, times binary"


class ByteLevel(token_ids.Encoder):
    """A byte-level tokenizer of the tokenizers library, special tokens' strings as plain text: ids of space + text."""

    def __init__(self, path: str, room: int):
        super().__init__(path, room)
        self.t.encode_special_tokens = True
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
        names = {i: w for w, i in self.t.get_vocab().items()}
        self.bytes = [b"".join(bytes([byte[c]]) if c in byte else c.encode() for c in names.get(i, "")) for i in range(max(names) + 1)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            found = self._known(text.split(" "), False) if self.by_word else None
            out.append(np.frombuffer(self(" " + text) if found is None else b"".join(found), self.dtype).astype("int64"))
        return out


class Pieces:
    """A sentencepiece tokenizer, which sets the space before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.p.get_piece_size()
        self.bytes = [bytes([int(self.p.id_to_piece(i)[1:-1], 16)]) if self.p.is_byte(i) else self.p.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, "int64") for ids in self.p.encode(texts, num_threads=1)] if texts else []


@functools.cache
def side(path: str, room: int):
    """A tokenizer by its file; room is the bytes of a worker's table of words."""
    return ByteLevel(path, room) if path.endswith(".json") else Pieces(path)


def groups_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of both kinds, from the ends of ranges that lie side by side."""
    ends = np.concatenate([a_end, b_end])
    starts = np.concatenate([np.r_[0, a_end[:-1]], np.r_[0, b_end[:-1]]])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(ends), "int64")
    group[order] = np.cumsum(np.r_[0, starts[order][1:] >= reach[:-1]])
    return group[: len(a_end)], group[len(a_end) :]


def links_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (token of A, token of B) whose ranges overlap."""
    low = np.searchsorted(b_end, np.r_[0, a_end[:-1]], side="right")
    n = np.searchsorted(np.r_[0, b_end[:-1]], a_end, side="left") - low
    a = np.repeat(np.arange(len(a_end)), n)
    return a, np.arange(len(a)) + np.repeat(low - np.cumsum(n) + n, n)


def _aligned(ids: list, texts: list[str], a_side, b_side, labels: list[bytes]) -> pa.RecordBatch:
    """A row for each text, in the form of ALIGNED."""
    n_docs, n_b = len(texts), len(b_side.bytes)
    some = [i for i, t in enumerate(texts) if t]
    both = [s.encode([texts[i] for i in some]) for s in (a_side, b_side)]
    whole = {i: b" " + texts[i].encode() for i in some}
    fine = [k for k, i in enumerate(some) if all(b"".join(map(s.bytes.__getitem__, own[k].tolist())) == whole[i] for s, own in zip((a_side, b_side), both))]
    rows = np.array([some[k] for k in fine], "int64")
    a_ids, b_ids = (np.concatenate([own[k] for k in fine] or [np.zeros(0, "int64")]) for own in both)
    sizes = [np.array([len(own[k]) for k in fine], "int64") for own in both]
    size = {s: np.array([len(x) for x in s.bytes], "int64") for s in (a_side, b_side)}
    a_end, b_end = np.cumsum(size[a_side][a_ids]), np.cumsum(size[b_side][b_ids])
    counts = np.zeros((4, n_docs), "int64")
    texts_out, pairs, times = [b""] * n_docs, [b""] * n_docs, [b""] * n_docs
    if len(rows):
        a_group, b_group = groups_of(a_end, b_end)
        a, b = links_of(a_end, b_end)
        # Each token's place when groups follow each other, A before B in each, and its label with what follows it.
        n = int(a_group[-1]) + 1
        in_a, in_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
        before_b, upto_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        entry = np.empty(len(a_ids) + len(b_ids), "int64")
        entry[np.arange(len(a_ids)) + before_b[a_group]] = 2 * a_ids + np.r_[a_group[1:] > a_group[:-1], True]
        entry[np.arange(len(b_ids)) + upto_a[b_group]] = 2 * (len(a_side.bytes) + b_ids) + np.r_[b_group[1:] > b_group[:-1], True]
        own = list(map(labels.__getitem__, entry.tolist()))
        cut = np.r_[0, np.cumsum(sizes[0] + sizes[1])].tolist()
        a_cut = np.r_[0, np.cumsum(sizes[0])]
        link_cut = np.searchsorted(a, a_cut)
        counts[:, rows] = [*sizes, np.diff(np.r_[a_group, n][a_cut]), np.diff(link_cut)]
        span = len(a_side.bytes) * n_b
        keys = np.repeat(np.arange(len(rows)) * span, np.diff(link_cut)) + a_ids[a] * n_b + b_ids[b]
        keys, often = np.unique(keys, return_counts=True)
        key_cut = np.searchsorted(keys, np.arange(len(rows) + 1) * span).tolist()
        keys = (keys % span).astype(_width(span))
        often = often.astype("<u4")
        for k, i in enumerate(rows.tolist()):
            texts_out[i] = b"".join(own[cut[k] : cut[k + 1]])[:-1]
            pairs[i], times[i] = keys[key_cut[k] : key_cut[k + 1]].tobytes(), often[key_cut[k] : key_cut[k + 1]].tobytes()
    names = ("n_a", "n_b", "n_groups", "n_links")
    packed = {"groups": texts_out, "pairs": pairs, "times": times}
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, "int64")} | dict(zip(names, counts)) | {k: pa.array(v, "binary") for k, v in packed.items()})


def _width(span: int) -> str:
    return "<u4" if span <= 1 << 32 else "<u8"


def aligned(docs: DataFrame, a: str, b: str, room: int = 100_000_000) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups, and its distinct id pairs with their numbers of links, packed.

    a and b are files of tokenizers (.json of byte-level ones, .model of sentencepiece). groups is `a1,a2|b1;a3|b2,b3`:
    ids of both kinds, in order. A pair of ids is a * (size of b's vocabulary) + b. Null and empty texts, and texts that
    either tokenizer doesn't give back byte by byte after a space, have no tokens: zeros, and an empty groups.
    Ids may be null or repeat; other columns are ignored. A text's memory is some 300 bytes a token.
    """
    small_batches(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = side(a, room), side(b, room)
        labels = [f"{i}{c}".encode() for s, after in ((a_side, ",|"), (b_side, ",;")) for i in range(len(s.bytes)) for c in after]
        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if texts and held + len(text) > TOGETHER:
                    yield _aligned(ids, texts, a_side, b_side, labels)
                    ids, texts, held = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                held += len(text)
            if texts:
                yield _aligned(ids, texts, a_side, b_side, labels)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(align, ALIGNED)


def pair_counts(rows: DataFrame, n_b: int, span: int) -> DataFrame:
    """key, a, docs (how many documents hold the pair linked), best (whether no other pair of its A id has more)."""
    dtype = _width(span)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, fresh, held = np.zeros(0, "int64"), np.zeros(0, "int64"), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, *fresh])
            each = np.r_[n, np.ones(len(every) - len(keys), "int64")]
            order = np.argsort(every, kind="stable")
            head = np.flatnonzero(np.r_[True, np.diff(every[order]) != 0])
            return every[order][head], np.add.reduceat(each[order], head)

        for batch in batches:
            for packed in batch.column(0):
                own = np.frombuffer(packed.as_py(), dtype).astype("int64")
                fresh.append(own)
                held += len(own)
                if held > HELD:
                    keys, n = merged()
                    fresh, held = [], 0
                    if len(keys) > HELD:
                        yield pa.RecordBatch.from_pydict({"key": keys, "n": n})
                        keys = n = np.zeros(0, "int64")
        if held or len(keys):
            keys, n = merged()
            yield pa.RecordBatch.from_pydict({"key": keys, "n": n})

    counts = rows.select("pairs").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("docs"))
    counts = counts.withColumn("a", F.floor(F.col("key") / n_b))
    # At most as many rows for an A id as the other vocabulary has ids.
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


@functools.lru_cache(maxsize=1)
def _table(uri: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    system, path = opened(uri)
    rows = pq.read_table(path, filesystem=system, columns=["key", "docs", "best"])
    key = rows["key"].to_numpy()
    order = np.argsort(key)
    return key[order], rows["docs"].to_numpy()[order], rows["best"].to_numpy()[order]


def with_counts(rows: DataFrame, counts: DataFrame, span: int, most: int = TABLE) -> DataFrame:
    """Adds n_best and count_sum to stored rows (with a column row that tells them apart), from stored counts."""
    uri, dtype = counts.stored_at, _width(span)
    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    if counts.count() > most:

        def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, pairs, times in zip(*(c.to_pylist() for c in batch.columns)):
                    key = np.frombuffer(pairs, dtype).astype("int64")
                    yield pa.RecordBatch.from_pydict({"row": np.full(len(key), row), "key": key, "times": np.frombuffer(times, "<u4").astype("int64")})

        links = rows.select("row", "pairs", "times").mapInArrow(apart, "row long, key long, times long").join(counts.select("key", "docs", "best"), "key")
        sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
        return rows.select(*kept).join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, best = _table(uri)
        for batch in batches:
            n_best, total = [], []
            for pairs, times in zip(batch["pairs"], batch["times"]):
                at = np.searchsorted(key, np.frombuffer(pairs.as_py(), dtype).astype("int64"))
                n = np.frombuffer(times.as_py(), "<u4").astype("int64")
                n_best.append(int(n[best[at]].sum()))
                total.append(int((n * docs[at]).sum()))
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in kept} | {"n_best": pa.array(n_best, "int64"), "count_sum": pa.array(total, "int64")})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return rows.mapInArrow(look_up, schema + ", n_best long, count_sum long")


def alignment_statistics(docs: DataFrame, a: str, b: str, most: int = TABLE, room: int = 100_000_000) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of documents, of all, that hold it linked: n_best are the links whose count is the highest
    of their A id, count_sum adds the counts of all links. groups_sha256 is '' where a text has no tokens. most: pairs up to
    which workers read the counts as a table; beyond, the same result comes by a join. As for aligned() otherwise.
    """
    n_b = len(side(b, room).bytes)
    span = len(side(a, room).bytes) * n_b
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = aligned(docs, a, b, room).select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    rows = stored(rows, "aligned")
    counts = stored(pair_counts(rows, n_b, span), "pair-counts")
    return with_counts(rows, counts, span, most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return alignment_statistics(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op12_alignment": op12_alignment}
