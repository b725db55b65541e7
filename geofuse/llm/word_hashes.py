"""XXH64 of stretches of words of many texts at once: stretches of one length take their steps together, as arrays."""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

SEED = 42
#: Bytes of texts that are cut into words at once (a longer text by itself), and stretches that are hashed at once.
RUN, STEP = 1 << 20, 1 << 16
#: Stretches from here on are hashed by the library, one by one.
LONG = 32
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + b"\t\n\v\f\r", string.ascii_lowercase.encode() + b" " * 5)


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def plain_words(text: str | None) -> bytes:
    """The words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, a space between."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).strip(b" ")
    return b" ".join(data.split()) if b"  " in data else data


def _hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 of each data[start:end]; data is eight bytes longer than the last one."""
    u8 = np.frombuffer(data, "uint8")
    u32, u64 = (np.ndarray(len(data) - width + 1, f"<u{width}", data, strides=(1,)) for width in (4, 8))
    out, kind = np.empty(len(start), "uint64"), np.minimum(end - start, LONG).astype("uint8")
    order, upto = np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind, minlength=LONG + 1))
    for length in np.flatnonzero(np.diff(upto, prepend=0)).tolist():
        own = order[upto[length - 1] if length else 0 : upto[length]]
        at, left = start[own], length
        if length == LONG:
            out[own] = [xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(at.tolist(), end[own].tolist())]
            continue
        h = np.full(len(own), np.uint64(SEED + int(P5) + length))
        while left >= 8:
            h = rotated(h ^ rotated(u64[at] * P2, 31) * P1, 27) * P1 + P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = rotated(h ^ u32[at] * P1, 23) * P2 + P3
            at, left = at + 4, left - 4
        for _ in range(left):
            h = rotated(h ^ u8[at] * P5, 11) * P1
            at = at + 1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        out[own] = h ^ h >> np.uint64(32)
    return out


def _runs(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for data in map(plain_words, texts):
        if held and size + len(data) > RUN:
            yield held
            held, size = [], 0
        held.append(data)
        size += len(data)
    if held:
        yield held


def hashed(texts: Iterable[str | None], words: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Of each text its plain words, and the hashes of all stretches of so many, in order; fewer words are one, none are none."""
    for run in _runs(texts):
        data = b" ".join(filter(None, run)) + bytes(8)
        gaps = np.flatnonzero(np.frombuffer(data, "uint8") == 32)
        start, end = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data) - 8)
        n_words = np.array([x.count(b" ") + 1 if x else 0 for x in run])
        n = np.maximum(n_words - words + 1, np.minimum(n_words, 1))
        upto = np.cumsum(n)
        first = np.arange(upto[-1]) + np.repeat(np.cumsum(n_words) - n_words - upto + n, n)
        last = first + np.repeat(np.minimum(n_words, words) - 1, n)
        parts = [_hashes(data, start[first[k : k + STEP]], end[last[k : k + STEP]]) for k in range(0, len(first), STEP)]
        h = np.concatenate([np.zeros(0, "uint64"), *parts])
        for text, (a, b) in zip(run, itertools.pairwise([0, *upto.tolist()])):
            yield text, h[a:b]
