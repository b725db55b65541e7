"""Token counts with overlap resynchronisation for huge documents.

A text is encoded whole up to CHUNK characters. A longer one is encoded in chunks that overlap. The overlap is encoded
once more with offsets, and the neighbours are spliced at a boundary in it that is proven stable: no piece of the
vocabulary has the two characters on its sides next to each other, so no merge can ever cross it and the pieces on
either side don't depend on each other (a letter before the space mark, most pairs of ideographs, a digit before a
letter). The ids of both chunks must agree with the overlap's there. Where they don't, or nothing is proven, the overlap
is widened, up to the whole chunk; then the chunk and as much text again are encoded as one, so that the work
stays linear in the text whatever it holds.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.llm.shared import small_batches, table

CHUNK, OVERLAP, WIDEN, LIMIT, MARK = 1 << 15, 256, 4, 4096, "▁"


@functools.cache
def processor(model: str):
    """The tokenizer, and the pairs of characters that stand side by side in a piece.

    The pairs are None where boundaries can't be proven: if the library changes texts before it cuts them, or joins
    characters that no piece has.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(p.get_piece_size())
    pieces = [p.id_to_piece(i) for i in ids if not p.is_byte(i)]
    joined = frozenset(piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1))
    same = all(p.normalize(s) == MARK + s.replace(" ", MARK) for s in ("a  b", "ﬁ é́ \t\n　x "))
    return p, joined if same and any(p.is_byte(i) for i in ids) else None


def last_stable(text: str, first: int, end: int, joined: frozenset[str]) -> int | None:
    """The last place after first and before end where a boundary is proven."""
    part = text[first:end].replace(" ", MARK)
    return next((first + i for i in range(len(part) - 1, 0, -1) if part[i - 1 : i + 1] not in joined), None)


def chunked_count(p, joined: frozenset[str], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of pieces of a text, from overlapping chunks."""
    # begin is where the left chunk was encoded from, start where its pieces count from, the first skip are before that
    n, total, begin, start, skip = len(text), 0, 0, 0, 0
    end = min(chunk, n)
    left = p.encode(text[:end])
    while end < n:
        stop, back, spliced = min(n, end + chunk), overlap, False
        while not spliced:
            at = max(start, end - back)
            cut = last_stable(text, at, end, joined)
            if cut is not None:
                both = p.encode(text[at:end], return_type="proto").pieces
                place = len(text[at:cut].encode())
                k = next((i for i, piece in enumerate(both) if piece.begin == place), 0)
                ids, right = [piece.id for piece in both], p.encode(text[at:stop])
                spliced = k > 0 and left[len(left) - len(ids) + k :] == ids[k:] and right[:k] == ids[:k]
            if spliced:
                total += len(left) - skip - (len(ids) - k)
                left, begin, start, skip, end = right, at, cut, k, stop
            elif at == start:
                end = min(n, end + max(chunk, end - begin))
                left = p.encode(text[begin:end])
                break
            back *= WIDEN
    return total + len(left) - skip


def counts(model: str, chunk: int, overlap: int):
    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        p, joined = processor(model)
        out, batch, size = [0] * len(texts), [], 0

        def flush() -> None:
            for i, ids in zip(batch, p.encode([texts.iloc[i] for i in batch], num_threads=1)):
                out[i] = len(ids)
            batch.clear()

        for i, text in enumerate(texts):
            if text is None or not text:
                continue
            if joined is not None and len(text) > chunk:
                out[i] = chunked_count(p, joined, text, chunk, overlap)
                continue
            batch.append(i)
            size += len(text)
            if size > 1 << 18:
                flush()
                size = 0
        flush()
        return pd.Series(out, dtype="int64")

    return count


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A null or empty text has 0 bytes and 0 tokens. Ids may be null or repeat. Other columns are ignored.
    A vocabulary whose boundaries can't be proven has its texts encoded whole.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        counts(model, chunk, overlap)(text).alias("n_tokens"),
    )
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_token_counts": op5_token_counts}
