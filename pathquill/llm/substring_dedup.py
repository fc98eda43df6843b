"""Words covered by windows that occur more than once, by super-k-mer partitioning.

Runs of windows that share a minimiser travel as packed strings (see :mod:`windows`); in its bucket,
sorting ranks counts the windows exactly: words are numbered, and ranks of 1, 2, 4, ... words are
sorted in pairs until they span a window.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table
from .windows import BUCKET_SYMBOLS, Symbols, covered, repeated_ranges, unsqueezed, with_marks

LENGTH = 35
GRAM = 8


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: bytes.split knows the six ASCII spaces alone."""
    return text.encode().split() if text else []


BASE = 0x9E3779B97F4A7C15


@functools.lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2^64, at least ``n`` of them."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x))
    return both[0], both[1]


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[bytes, np.ndarray, np.ndarray]]:
    """Words' hashes without a step in Python for each: sums of bytes times powers, differences at word borders."""
    plain = [b" ".join(words_of(t)) for t in texts]
    first = np.concatenate(([0], np.cumsum([x.count(b" ") + 1 if x else 0 for x in plain], dtype=np.int64)))
    joined = b" ".join(x for x in plain if x)
    if not joined:
        return np.empty(0, np.uint64), first, (joined, first, first)
    letters = np.frombuffer(joined, np.uint8)
    space = np.flatnonzero(letters == 32)
    start, end = np.append(0, space + 1), np.append(space, len(letters))
    power, inverse = powers(1 << len(letters).bit_length())
    total = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * power[: len(letters)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return h ^ (h >> np.uint64(32)), first, (joined, start, end)


def symbols(length: int) -> Symbols:
    gram = min(GRAM, 1 << (length.bit_length() - 1))
    return Symbols(length, gram, hashes, cut, lambda x: windows_of(x, length))


def cut(state: tuple[bytes, np.ndarray, np.ndarray], at: int, a: int, b: int) -> bytes:
    joined, start, end = state
    return joined[start[at + a] : end[at + b - 1]]


def windows_of(packed: bytes, length: int) -> list[bytes]:
    words = packed.split(b" ")
    return [b" ".join(words[i : i + length]) for i in range(len(words) - length + 1)]


def sort_windows(packed: list[bytes], length: int) -> list[np.ndarray]:
    """For each packed string, its windows that occur at least twice among all, by exact sorting."""
    number: dict[bytes, int] = {}
    words = [x.split(b" ") for x in packed]
    sizes = np.array([len(w) for w in words])
    first = np.concatenate(([0], np.cumsum(sizes)))
    rank = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(first[-1]))
    left = np.repeat(first[1:], sizes) - np.arange(len(rank))
    span = 1
    while span < length:
        step = min(span, length - span)
        # positions too near the end pair with garbage, and are left out below
        pair = rank[:-step] * np.int64(len(rank) + len(number)) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1]
        span += step
    starts = np.flatnonzero(left[: len(rank)] >= length)
    times = np.bincount(rank[starts])
    twice = starts[times[rank[starts]] > 1]
    owner = np.searchsorted(first, twice, "right") - 1
    bounds = np.searchsorted(owner, np.arange(len(packed) + 1))
    return [twice[bounds[k] : bounds[k + 1]] - first[k] for k in range(len(packed))]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, bucket_symbols: int = BUCKET_SYMBOLS) -> DataFrame:
    """``doc_id, n_words, spans, kept`` for every row: removed [start, end) word runs and the text of the other words.

    A word goes if a window of ``length`` words around it starts anywhere else too. Null and empty texts
    have no words; equal rows repeat each other; kept words are joined by one space.
    """
    found = repeated_ranges(docs, symbols(length), sort_windows, doc_id, text, bucket_symbols)

    def make():
        def run(texts: list[str | None], marks: list):
            n, spans, kept = [], [], []
            for t, m in zip(texts, marks, strict=True):
                words = words_of(t)
                n.append(len(words))
                spans.append(covered(m, length, len(words)))
                kept.append(b" ".join(left_over(words, spans[-1])).decode())
            return n, pa.array(spans, pa.list_(pa.list_(pa.int64()))), kept

        return run

    marked = with_marks(docs.select(doc_id, text), found, doc_id, text)
    return map_texts(marked, doc_id, "_z", "n_words long, spans array<array<bigint>>, kept string", make, ["_marks"], unsqueezed)


def left_over(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return out + words[at:]


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of words of all ``documents``; nulls, empty and long texts and repeated rows as in :func:`without_repeats`."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
