"""Bytes covered by strings that occur more than once, by difference-cover suffix sorting.

Suffixes with a common prefix of ``length`` bytes share the prefix' minimiser, so the text is dealt out
by minimiser (see :mod:`windows`) and each bucket's suffixes are sorted apart. In a bucket the strings are
concatenated and sorted by the difference cover modulo 3: positions 1 and 2 modulo 3 are sorted by
triples of symbols and named; unless the names are unique or already span ``length`` bytes, their
string is sorted recursively; the other suffixes follow from one symbol and the next name, and
both orders are merged. Neighbours in the order are then compared over their first ``length`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table
from .windows import BUCKET_SYMBOLS, Symbols, covered, repeated_ranges, unsqueezed, with_marks

LENGTH = 200
GRAM = 32


def eight_bytes(raw: bytes) -> np.ndarray:
    """The eight bytes at each position as one integer; ``raw`` has seven more at its end."""
    n = len(raw) - 7
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        part = np.frombuffer(raw, np.uint64, (len(raw) - r) // 8, r)
        out[r::8] = part[: len(out[r::8])]
    return out


def hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
    raw = [t.encode() for t in texts]
    first = np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64)))
    joined = b"".join(raw)
    w = eight_bytes(joined + bytes(7))
    # grams of GRAM bytes from four integers each
    h = w.copy()
    h[:-8] = w[:-8] * np.uint64(0x9E3779B97F4A7C15) + (w[8:] ^ (w[8:] >> np.uint64(31)))
    g = h.copy()
    g[:-16] = h[:-16] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[16:] ^ (h[16:] >> np.uint64(29)))
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xE7037ED1A0B428DB)
    g ^= g >> np.uint64(29)
    return g, first, joined


def symbols(length: int) -> Symbols:
    return Symbols(length, GRAM, hashes, lambda state, at, a, b: state[at + a : at + b], lambda x: [x[i : i + length] for i in range(len(x) - length + 1)], wide=GRAM)


def suffix_order(s: np.ndarray, span: int, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of ``s``, exact over their first ``span`` original symbols.

    ``width`` is how many original symbols one of ``s`` stands for. Symbols are positive integers
    below 2^21 or so, so that a triple fits one machine word; suffixes that agree over ``span`` may tie.
    """
    n = len(s)
    if n < 3:
        order = np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(1, n + 1)
        return order, rank
    bits = max(int(s.max()).bit_length(), 1)
    # positions 3j, 3j + 1 and 3j + 2; when n % 3 == 1 an empty suffix ends the second kind, so that the first two are as many
    n0, n2 = (n + 2) // 3, n // 3
    x = np.zeros(3 * n0 + 5, np.int64)
    x[:n] = s
    x0, x1, x2 = x[0 : 3 * n0 : 3], x[1 : 3 * n0 + 1 : 3], x[2 : 3 * n0 + 2 : 3]
    # sample: 1 modulo 3, then 2 modulo 3
    ahead0, ahead1 = x[3 : 3 * n0 + 3 : 3], x[4 : 3 * n0 + 4 : 3]
    if 3 * bits <= 62:
        triple = np.concatenate([x1 << 2 * bits | x2 << bits | ahead0, (x2 << 2 * bits | ahead0 << bits | ahead1)[:n2]])
    else:
        triple = paired(np.concatenate([x1, x2[:n2]]), np.concatenate([x2, ahead0[:n2]]), np.concatenate([ahead0, ahead1[:n2]]))
    by, ordered = sorted_by(triple)
    new = np.append(True, ordered[1:] != ordered[:-1])
    name = np.empty(len(triple), np.int64)
    name[by] = np.cumsum(new)
    if not new.all() and 3 * width < span:
        # names of one kind follow each other in the text, then those of the other
        by, name = suffix_order(name, span, 3 * width)
    name1, name2 = name[:n0], np.zeros(n0, np.int64)
    name2[:n2] = name[n0:]
    by1, by2 = by[by < n0], by[by >= n0] - n0
    if n % 3 == 1:
        by1 = by1[by1 != n0 - 1]
    # the suffixes at 3j: own symbol, then the rank of the one behind; those at 3j + 1 alike
    shift = len(name).bit_length() + 1
    o0, key0 = sorted_by(x0 << shift | name1)
    key1 = np.maximum.accumulate((x1 << shift | name2)[by1])
    before = np.searchsorted(key1, key0)
    # both in one order, in which those at 3j and 3j + 2 are told apart by what is behind their own symbol
    both0, both1 = np.empty(n0 + 1, np.int64), np.zeros(n0, np.int64)
    both0[-1] = 0
    both0[o0] = np.arange(1, n0 + 1) + before
    free = np.ones(n0 + len(by1) + 1, bool)
    free[both0] = False
    both1[by1] = np.flatnonzero(free)
    deep = len(free).bit_length()
    key2 = np.maximum.accumulate((x2[:n2] << deep | both0[1 : n2 + 1])[by2])
    before += np.searchsorted(key2, (x0 << deep | both1)[o0])
    place = np.arange(n0) + np.maximum.accumulate(before)
    order = np.empty(n, np.int64)
    free = np.ones(n, bool)
    free[place] = False
    order[place] = 3 * o0
    first = np.where(by < n0, 3 * by + 1, 3 * (by - n0) + 2)
    order[free] = first[first < n]
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(1, n + 1)
    return order, rank


def sorted_by(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys). Keys that leave room for their position are sorted with it, which is faster."""
    n = len(keys)
    bits = n.bit_length()
    if n and int(keys.max()).bit_length() + bits <= 63:
        both = np.sort(keys << bits | np.arange(n))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(keys)
    return order, keys[order]


def paired(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Triples of large symbols as integers in the same order: pairs are ranked first."""
    pair = np.unique(a << 31 | b, return_inverse=True)[1].astype(np.int64)
    return pair << 31 | c


def sorted_windows(packed: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, its windows of ``length`` bytes that start at least twice among all."""
    sizes = np.array([len(p) for p in packed])
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    raw = b"\0".join(packed) + bytes(8)
    s = np.frombuffer(raw, np.uint8, int(first[-1])).astype(np.int64) + 1
    s[first[1:] - 1] = 0  # a separator below all bytes; windows never reach over it
    order, _ = suffix_order(s + 1, length)
    left = np.repeat(sizes + 1, sizes + 1) - 1 - (np.arange(len(s)) - np.repeat(first[:-1], sizes + 1))
    order = order[left[order] >= length]
    words = eight_bytes(raw)
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for at in [*range(0, length - 8, 8), max(length - 8, 0)] if length >= 8 else []:
        same = same[words[a[same] + at] == words[b[same] + at]]
    if length < 8:
        low = np.uint64((1 << 8 * length) - 1)
        same = same[(words[a] & low) == (words[b] & low)]
    hit = np.zeros(len(s), bool)
    hit[a[same]] = hit[b[same]] = True
    twice = np.flatnonzero(hit)
    bounds = np.searchsorted(twice, first)
    return [twice[bounds[k] : bounds[k + 1]] - first[k] for k in range(len(packed))]


def found_repeats(docs: DataFrame, doc_id: str, text: str, length: int, bucket_symbols: int) -> DataFrame:
    if length < GRAM:
        raise ValueError(f"strings of at least {GRAM} bytes")
    return repeated_ranges(docs, symbols(length), sorted_windows, doc_id, text, bucket_symbols)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, bucket_symbols: int = BUCKET_SYMBOLS) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for every row: removed [start, end) byte runs and the bytes left (binary).

    A byte goes if a string of ``length`` bytes around it starts anywhere else too, in this document or
    another. Null and empty texts have no bytes; equal rows repeat each other. What is left may
    break a character in two; :func:`cleaned` keeps characters whole.
    """
    found = found_repeats(docs, doc_id, text, length, bucket_symbols)

    def make():
        def run(texts: list[str], marks: list):
            raw = [t.encode() for t in texts]
            spans = [covered(m, length, len(x)) for x, m in zip(raw, marks, strict=True)]
            kept = [left_over(x, s) for x, s in zip(raw, spans, strict=True)]
            return [len(x) for x in raw], pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())

        return run

    return map_texts(with_marks(docs.select(doc_id, text), found, doc_id, text), doc_id, "_z", "n_bytes long, spans array<array<bigint>>, kept binary", make, ["_marks"], unsqueezed)


def left_over(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the characters that they cover only in part."""
    out = []
    for a, b in spans:
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b < len(raw) and b > a and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, bucket_symbols: int = BUCKET_SYMBOLS) -> DataFrame:
    """``docs`` with repeated bytes taken out of the text, characters kept whole; other columns as they are."""
    found = found_repeats(docs, doc_id, text, length, bucket_symbols)

    names, at = docs.columns, docs.columns.index(text)
    # the other columns travel in one struct, so that no name can clash
    row = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in names if c != text)).alias("_row"))
    marked = with_marks(row, found, "_id", "_text").select("_row", "_z", "_marks")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, m in zip(unsqueezed(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                if m is not None:
                    raw = t.encode()
                    t = left_over(raw, whole_characters(raw, covered(m, length, len(raw)))).decode()
                out.append(t)
            rest = batch.column(0).flatten()
            yield pa.RecordBatch.from_arrays([*rest[:at], pa.array(out, pa.string()), *rest[at:]], names=names)

    return marked.mapInArrow(clean, docs.schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of bytes of all ``documents``; nulls, empty and long texts and repeated rows as in :func:`without_repeats`."""
    found = without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
