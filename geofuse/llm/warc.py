"""WARC archives compressed record by record with a shared Zstandard dictionary.

The dictionary is built from archived records, stands in a leading skippable frame (so a file explains
itself), and every record is a frame of its own, so that one can be read at its offset. Equal payloads are
archived once; the others refer to that record.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import io
import re
import urllib.parse
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.llm.files import reading, written
from geofuse.llm.shared import attach, new_dir, salt_bit, salt_of, small_batches, stored, table

#: The skippable frame that holds the dictionary.
DICT_FRAME = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_RECORDS, DICT_BYTES, FILE_BYTES = 400, 1 << 16, 1 << 25


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    value = uri.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def target_uri(url: str | None, page_id: int | None) -> str:
    if not url or not url.strip():
        return record_id(page_id).strip("<>")
    return urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]")


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A whole record: a response with its payload, or a revisit with the response's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target_uri(url, page_id)}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info_record() -> bytes:
    block = b"software: geofuse\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:warcinfo:{sha1_base32(block)}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary of bounded size from records; raw content where there are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICT_BYTES:]


@functools.lru_cache(4)
def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


class Writer:
    def __init__(self, out, dictionary: bytes, level: int = 3):
        self.out, self.size = out, 0
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        self._put(DICT_FRAME.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed)
        self.c = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary) if dictionary else None)
        self.add(info_record())

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> tuple[int, int]:
        """The place and length of the record's frame."""
        at = self.size
        self._put(self.c.compress(record))
        return at, self.size - at


def read_dictionary(f) -> bytes:
    head = f.read(8)
    if int.from_bytes(head[:4], "little") != DICT_FRAME:
        raise ValueError("no leading dictionary frame")
    return zstandard.ZstdDecompressor().decompress(f.read(int.from_bytes(head[4:], "little")), max_output_size=1 << 27)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_records(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, one in memory at a time."""
    dictionary = read_dictionary(f)
    d = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary) if dictionary else None)
    buffer = b""
    while True:
        obj, parts = d.decompressobj(), []
        while not obj.eof:
            if not buffer and not (buffer := f.read(1 << 18)):
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(obj.decompress(buffer))
            buffer = obj.unused_data if obj.eof else b""
        yield parse_record(b"".join(parts))


def decide(pages: DataFrame, least_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Pages with digest and salt, and per digest the response's page_id."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.unhex(F.concat(F.sha1(payload), F.sha2(payload, 256))).alias("digest"),
    ).withColumn("salt", salt_of("page_id", "url"))
    groups = (
        rows.select("digest", "page_id", "salt", F.octet_length("payload").alias("n")).filter(F.col("n") >= least_bytes)
        .groupBy("digest").agg(F.max("page_id").alias("first_id"), F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    )
    return rows, groups


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, file_bytes: int = FILE_BYTES, samples: int = SAMPLE_RECORDS) -> DataFrame:
    """Writes one record per page; a row per file: path, records, bytes.

    Of pages with equal payloads (of least_bytes or more) the one with the largest page_id is the response, the
    others revisit it; rows that repeat its page_id are responses too. A null html is an empty payload, a null
    url is named after the page, a null page_id loses to any other. The dictionary is trained on the
    samples pages of least hash, 16 Ki characters of each (the bounds). No pages give no files.
    """
    small_batches(pages.sparkSession, 500)
    ids = pages.select("page_id").filter("page_id IS NOT NULL").orderBy(F.xxhash64("page_id"), "page_id").limit(samples)
    picked = pages.select("page_id", "url", F.substring(F.col("html").cast("string"), 1, 1 << 14).alias("html"))
    some = picked.join(F.broadcast(ids), "page_id", "left_semi").limit(samples).collect()
    some.sort(key=lambda r: (r["page_id"], r["url"] or "", r["html"] or ""))
    dictionary = train([make_record(r["page_id"], r["url"], (r["html"] or "").encode(), None, False) for r in some])
    rows, groups = decide(pages, least_bytes)
    # In an order that only rows equal in all share, so that a repeated task writes what the first one wrote.
    joined = attach(rows, groups, ["digest"], how="left").sortWithinPartitions("digest", "page_id", "url")
    joined = joined.select("page_id", "url", "payload", "first_id", (F.octet_length("payload") >= least_bytes).alias("shared"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Files are named by attempt, and the rows of the attempt that counts name them: no other can replace them.
        context = TaskContext.get()
        base, k, done = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}", 0, []
        records = (
            make_record(p, u, body or b"", first, shared and first is not None and p != first)
            for batch in batches
            for p, u, body, first, shared in zip(*(c.to_pylist() for c in batch.columns))
        )
        record = next(records, None)
        while record is not None:
            uri, n = f"{base}-{k:04d}.warc.zst", 0
            with written(uri, context.taskAttemptId()) as out:
                w = Writer(out, dictionary)
                while record is not None and (n == 0 or w.size < file_bytes):
                    w.add(record)
                    n += 1
                    record = next(records, None)
            done.append((uri, n, w.size))
            k += 1
        if done:
            yield pa.RecordBatch.from_pydict(dict(zip(("path", "records", "bytes"), map(list, zip(*done)))))

    return stored(joined.mapInArrow(write, "path string, records long, bytes long"), "warc-files")


def read_archive(files: DataFrame) -> DataFrame:
    """Reads archives back: page_id, payload_bytes, payload_digest, record_type, refers_to of each record.

    A response's length and digest are those of the payload that was read, and must be those it declares.
    """
    length = re.compile(rb"Content-Length: (\d+)")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for path in (p for batch in batches for p in batch["path"]):
            out = []
            with reading(path) as f:
                for fields, block in read_records(f):
                    kind = fields["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n, digest = int(length.search(http)[1]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (n, digest) != (len(payload), sha1_base32(payload)):
                        raise ValueError(f"a record of {path} is not what it declares")
                    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
                    out.append((page_of(fields["WARC-Record-ID"]), n, digest, kind, refers))
            frame = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    n = max(1, files.count())
    return files.select("path").repartitionByRange(n, "path").mapInPandas(
        read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def read_one(uri: str, at: int) -> tuple[dict[str, str], bytes]:
    """One record by its frame's place."""
    with reading(uri, seek=True) as f:
        dictionary = read_dictionary(f)
        f.seek(at)
        d = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary) if dictionary else None)
        return parse_record(d.stream_reader(io.BytesIO(f.read()), read_across_frames=False).read())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archive(write_archive(table(spark, sf_dir, "pages"), new_dir(spark, "warc")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, body, strlen(body) AS n,
             max(page_id) OVER (PARTITION BY body) AS first_id,
             array_to_string(list_transform(range(0, 32), lambda i:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                        1 + ((((instr('0123456789abcdef', substr(hex || '00', CAST((5 * i) // 4 + 1 AS INT), 1)) - 1) * 256
                             + (instr('0123456789abcdef', substr(hex || '00', CAST((5 * i) // 4 + 2 AS INT), 1)) - 1) * 16
                             + (instr('0123456789abcdef', substr(hex || '00', CAST((5 * i) // 4 + 3 AS INT), 1)) - 1))
                             >> CAST(7 - (5 * i) % 4 AS INT)) & 31), 1)), '') AS digest
      FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

QUERIES = {"op6_warc": op6_warc}
ORACLES = {"op6_warc": SQL}
