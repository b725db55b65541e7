"""Token-id shards with Elias-Fano coded document boundaries.

A shard is: magic, the ids of its documents one after another (little-endian, 16 bits where the vocabulary
allows it), the doc_ids, the boundaries, and a JSON footer with the places of the sections, its length and the
magic again. n boundaries up to u cost about n * (2 + log2(u / n)) bits: the low bits of each are packed,
the high bits are a bit vector of unary gaps, and every 256th one's place is kept, from which select walks.
Shards are written in doc_id order, each by the task that encoded it, and read back for the result.
"""

from __future__ import annotations

import array
import functools
import json
import os
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geofuse.llm.files import reading, written
from geofuse.llm.shared import new_dir, small_batches, stored, table

MAGIC = b"GFTOKEN1"
SAMPLE = 256
END_ID = 2
#: Bytes of the table of words, of an entry besides its text and ids, and the longest word that is kept in it.
ROOM, ENTRY, LONGEST = 220_000_000, 150, 64


class EliasFano:
    """A non-decreasing sequence of numbers from 0 to u."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, "uint64")
        n = len(values)
        u = int(values[-1]) if n else 0
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits, dtype="uint64")[None, :]).astype("uint8") & 1
        ones = (values >> np.uint64(low_bits)).astype("int64") + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, "uint8")
        bits[ones] = 1
        pack = functools.partial(np.packbits, bitorder="little")
        return cls(n, low_bits, pack(low.ravel()), pack(bits), ones[::SAMPLE].astype("<u4" if u >> low_bits < 1 << 30 else "<u8"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)[None, :]
        bits = (self.low[at >> 3] >> (at & 7).astype("uint8") & 1).astype("uint64")
        return (bits << np.arange(self.low_bits, dtype="uint64")[None, :]).sum(axis=1, dtype="uint64")

    def select(self, i: int) -> int:
        """The i-th number, from the nearest sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte, seen = place >> 3, -1
            word = int(self.high[byte]) >> (place & 7) << (place & 7)
            while (ones := word.bit_count()) + seen < left:
                seen, byte = seen + ones, byte + 1
                word = int(self.high[byte])
            for _ in range(left - seen - 1):
                word &= word - 1
            place = (byte << 3) + (word & -word).bit_length() - 1
        return (place - i << self.low_bits) + int(self._low(np.array([i]))[0])

    def block(self, k: int) -> np.ndarray:
        """The numbers from the k-th sample to before the next one."""
        i = np.arange(k * SAMPLE, min(self.n, (k + 1) * SAMPLE))
        first = int(self.samples[k])
        last = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first >> 3 : (last + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[first & 7 :])[: len(i)] + first
        return ((ones - i).astype("uint64") << np.uint64(self.low_bits)) + self._low(i)

    def sections(self) -> tuple[dict, list[bytes]]:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return {"n": self.n, "low_bits": self.low_bits, "wide": self.samples.dtype.itemsize, "sizes": [len(p) for p in parts]}, parts

    @classmethod
    def load(cls, head: dict, data: bytes) -> EliasFano:
        a, b, _ = head["sizes"]
        u1 = lambda x: np.frombuffer(x, "uint8")
        return cls(head["n"], head["low_bits"], u1(data[:a]), u1(data[a : a + b]), np.frombuffer(data[a + b :], f"<u{head['wide']}"))


class Encoder:
    """Ids as bytes, from the tokenizers library.

    A byte-level tokenizer that splits by its own pattern never joins what stands on either side of a single
    space between two characters that are no white space: the space begins a new word. So a text is cut
    there and each word is encoded by the library once, then looked up. The table is emptied when full.
    Other tokenizers encode whole texts.
    """

    SAFE = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str, room: int = ROOM):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        added = [x["content"] for x in spec.get("added_tokens", [])]
        plain = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
        self.by_word = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and not spec.get("post_processor") and not any(" " in a for a in added) and plain
        )
        self.words: dict[str, bytes] = {}
        self.room, self.held = room, 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.t.encode_batch_fast(texts, add_special_tokens=False)
        return [self._bytes(e.ids) for e in found]

    def _bytes(self, ids: list[int]) -> bytes:
        own = array.array("H" if self.dtype == "<u2" else "I", ids)
        if sys.byteorder == "big":
            own.byteswap()
        return own.tobytes()

    def _known(self, words: list[str], proven: bool) -> list[bytes] | None:
        """The ids of each word with the space before it; None if one has white space at an end and its cuts aren't proven."""
        found = list(map(self.words.get, words))
        if None not in found:
            return found
        new = list({w for w, ids in zip(words, found) if ids is None})
        odd = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        if odd and not proven:
            return None
        own = {}
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            own.update(zip(some, self._encode([" " + w for w in some])))
        if self.held > self.room:
            self.words.clear()
            self.held = 0
        keep = {w: ids for w, ids in own.items() if len(w) <= LONGEST and w not in odd}
        self.words.update(keep)
        self.held += sum(len(w) + len(ids) + ENTRY for w, ids in keep.items())
        return [own[w] if ids is None else ids for w, ids in zip(words, found)]

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._encode([text])[0]
        first, *rest = text.split(" ")
        found = self._known(rest, False) if first and not first[-1].isspace() else None
        if found is None:
            first, *rest = self.SAFE.split(text)
            found = self._known(rest, True)
        return b"".join([*self._encode([first]), *found])


@functools.cache
def encoder(path: str, room: int = ROOM) -> Encoder:
    return Encoder(path, room)


def write_shard(uri: str, attempt: int, docs: Iterator[tuple[int | None, bytes]], dtype: str) -> tuple[int, int]:
    """Writes (doc_id, ids) in the order given; the number of documents and of ids."""
    wide = int(dtype[-1])
    ends, ids, total = [], [], 0
    with written(uri, attempt) as out:
        out.write(MAGIC)
        for doc_id, data in docs:
            out.write(data)
            total += len(data) // wide
            ends.append(total)
            ids.append(doc_id)
        bounds, parts = EliasFano.build(np.array([0, *ends])).sections()
        names = np.array([0 if i is None else i for i in ids], "<i8").tobytes()
        nulls = [k for k, i in enumerate(ids) if i is None]
        parts = [zlib.compress(names, 1), *parts]
        for p in parts:
            out.write(p)
        foot = {"dtype": dtype, "tokens": total, "docs": len(ids), "names": len(parts[0]), "nulls": nulls, "bounds": bounds}
        foot = json.dumps(foot).encode()
        out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
    return len(ids), total


class Shard:
    """Random access to the documents of a shard."""

    def __init__(self, uri: str):
        self.f = reading(uri, seek=True)
        size = self.f.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"no token shard: {uri}")
        n = int.from_bytes(tail[:8], "little")
        self.foot = json.loads(self._at(size - 16 - n, n))
        self.wide = int(self.foot["dtype"][-1])
        at = len(MAGIC) + self.foot["tokens"] * self.wide
        names = np.frombuffer(zlib.decompress(self._at(at, self.foot["names"])), "<i8")
        self.doc_ids: list = names.tolist()
        for k in self.foot["nulls"]:
            self.doc_ids[k] = None
        head = self.foot["bounds"]
        self.bounds = EliasFano.load(head, self._at(at + self.foot["names"], sum(head["sizes"])))

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        return np.frombuffer(self._at(len(MAGIC) + a * self.wide, (b - a) * self.wide), self.foot["dtype"])

    def each(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the shard, ids) in order."""
        b = self.bounds.select(0)
        for at in range(0, len(self.doc_ids), SAMPLE):
            ends = self.bounds.block(at // SAMPLE).tolist()
            ends = [*ends[1:], self.bounds.select(at + SAMPLE)] if at + SAMPLE < self.bounds.n else ends[1:]
            for doc_id, end in zip(self.doc_ids[at : at + SAMPLE], ends):
                a, b = b, end
                yield doc_id, a, np.frombuffer(self._at(len(MAGIC) + a * self.wide, (b - a) * self.wide), self.foot["dtype"])


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, room: int = ROOM) -> DataFrame:
    """Encodes and writes the documents, by doc_id; a row per shard: shard, path, docs, tokens, start.

    A null or empty text has the end id alone. A null doc_id comes first. Rows that repeat an id follow
    each other, by a hash of their text. No documents give no shards. Other columns are ignored. room: bytes of each
    worker's table of words; less costs time alone.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, room)
        end = np.array([end_id], encode.dtype).tobytes()
        context = TaskContext.get()
        shard = context.partitionId()
        # By attempt: the rows of the attempt that counts name its file, and no other can replace it.
        uri = f"{folder}/shard-{shard:06d}-{context.taskAttemptId()}.tokens"

        def each() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    yield doc_id.as_py(), encode(text.as_py()) + end

        first = next(docs := each(), None)
        if first is None:
            return
        n, total = write_shard(uri, context.taskAttemptId(), (d for part in ([first], docs) for d in part), encode.dtype)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [uri], "docs": [n], "tokens": [total]})

    shards = stored(rows.select("doc_id", "text").mapInArrow(write, "shard long, path string, docs long, tokens long"), "token-shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))


def read_tokens(shards: DataFrame) -> DataFrame:
    """Reads shards back: doc_id, start, n_tokens, ids_crc32 of each document."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"]):
                out = []
                for doc_id, at, ids in Shard(path).each():
                    out.append((doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                yield pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})

    n = max(1, shards.count())
    return shards.repartitionByRange(n, "shard").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_dir(spark, "tokens")))


QUERIES = {"op9_token_ids": op9_token_ids}
