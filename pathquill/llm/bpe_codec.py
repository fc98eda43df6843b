"""Byte-pair encoding and decoding with forced-boundary splitting.

A pair of bytes that stands next to each other inside no vocabulary token can never end up in one
token, so a word may be cut between them for certain. The fragments are encoded independently and
their ids concatenated. Texts are taken in blocks: what a block's different pieces need and no cache
holds is encoded once, all fragments together, one merge of each fragment a round.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import struct
import sys
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import map_texts, table

#: Characters of texts whose pieces are looked up together, and of new pieces that are encoded together.
TEXT_BLOCK, PIECE_BLOCK = 1 << 19, 1 << 17
#: Entries of one generation of the piece cache, to which a block of texts may add.
CACHE_ENTRIES = 40_000
#: Longer fragments are merged one by one with a heap.
LONG_FRAGMENT = 48


class Codec:
    """Encodes and decodes texts under a vocabulary file with word ends."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        vocab, self.pairs, self.added, self.suffix = bpe.load(path)
        self.token = {i: t for t, i in (vocab | self.added).items()}
        symbols = bpe.byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols])
        self.last = np.array([vocab[s + self.suffix] for s in symbols])
        self.cut = np.frombuffer(forced_cuts(vocab, self.suffix), bool)
        self.merges = Merges(self.pairs)
        self.words, self.narrow_words = word_finder(), word_finder(0xFFFF)
        self.wide = re.compile("[\U00010000-\U0010ffff]").search
        self.control = re.compile("[\x1c-\x1f]").search
        self.spaces = re.compile(f"[{bpe.SPACE}]+").split
        self.split_added = bpe.added_splitter(self.added).split if self.added else None
        # added tokens by names that no piece has; packed ids and decoded texts of pieces, in two generations
        self.fixed = {" " + t: struct.pack("<I", i) for t, i in self.added.items()}, {" " + t: t for t in self.added}
        self.entries = entries
        self.ids, self.texts = map(dict, self.fixed)
        self.old_ids: dict[str, bytes] = {}
        self.old_texts: dict[str, str] = {}
        self.long: list[str] = []

    def plain_pieces(self, text: str) -> list[str]:
        text = bpe.lowered(bpe.composed(text))
        return [p for p in self.spaces(text) if p] if self.control(text) else text.split()

    def pieces(self, text: str) -> list[str]:
        """A text between white space, in order; added tokens come with a space before them."""
        if not self.added or not any(a in text for a in self.added):
            return self.plain_pieces(text)
        return [p for part in self.split_added(text) for p in ([" " + part] if part in self.added else self.plain_pieces(part))]

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(packed ids, decoded text) of each text, in order."""
        for block in blocks(texts, TEXT_BLOCK):
            cut = list(map(self.pieces, block))
            self.learn(set().union(*cut))
            for pieces in cut:
                yield b"".join(map(self.ids.__getitem__, pieces)), " ".join(map(self.texts.__getitem__, pieces))
            self.forget()

    def learn(self, pieces: set[str]) -> None:
        """Fills the caches for all ``pieces``."""
        pieces.difference_update(self.ids)
        for p in pieces & self.old_ids.keys():
            self.ids[p], self.texts[p] = self.old_ids[p], self.old_texts[p]
        pieces.difference_update(self.old_ids)
        for new in blocks(pieces, PIECE_BLOCK):
            self.encode_pieces(new)

    def forget(self) -> None:
        """A full generation becomes the old one; very long pieces stay in none."""
        if len(self.ids) < self.entries and not self.long:
            return
        for p in self.long:
            del self.ids[p], self.texts[p]
        self.long.clear()
        if len(self.ids) >= self.entries:
            self.old_ids, self.old_texts = self.ids, self.texts
            self.ids, self.texts = map(dict, self.fixed)

    def encode_pieces(self, pieces: list[str]) -> None:
        """Puts the packed ids and decoded texts of pieces without white space into the caches."""
        words = list(map(self.words if self.wide("".join(pieces)) else self.narrow_words, pieces))
        raw = np.frombuffer(" ".join(w for ws in words for w in ws).encode(), np.uint8)
        ids, ends = self.encode_words(raw)
        # where the words of each piece end
        at = np.concatenate([[0], ends])[np.cumsum([0, *map(len, words)])]
        packed = ids.astype("<u4").tobytes()
        tokens = [self.token[i] for i in ids.tolist()]
        for p, a, b in zip(pieces, at.tolist(), at[1:].tolist(), strict=False):
            self.ids[p], self.texts[p] = packed[4 * a : 4 * b], " ".join(tokens[a:b])
        self.long += [p for p in pieces if len(p) > 200]

    def encode_words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the UTF-8 bytes of words between single spaces, and the number of ids up to the end of each word."""
        space = raw == 0x20
        final = np.append(space[1:], True)
        inside = ~space
        symbols = np.where(final, self.last[raw], self.inner[raw])[inside]
        word_ends = np.cumsum(inside)[final]
        begins = np.zeros(len(symbols), bool)
        begins[0] = True
        begins[word_ends[:-1]] = True
        plain = raw[inside].astype(np.uint16)
        begins[1:] |= self.cut[plain[:-1] << 8 | plain[1:]]
        starts = np.flatnonzero(begins)
        sizes = np.diff(starts, append=len(symbols))
        for k in np.flatnonzero(sizes > LONG_FRAGMENT).tolist():
            a, b = starts[k], starts[k] + sizes[k]
            made = merged_long(symbols[a:b].tolist(), self.pairs)
            symbols[a:b] = -1
            symbols[a : a + len(made)] = made
        short = np.repeat(sizes <= LONG_FRAGMENT, sizes)
        sizes = sizes[sizes <= LONG_FRAGMENT]
        symbols[short] = self.merges.merged(symbols[short], np.cumsum(sizes) - sizes)
        left = symbols >= 0
        return symbols[left], np.cumsum(left)[word_ends - 1]

    def encode(self, text: str) -> np.ndarray:
        ((ids, _),) = self.encode_texts([text])
        return np.frombuffer(ids, "<u4")

    def decode(self, ids) -> str:
        """Tokens joined by one space: the vocabulary names no decoder. Unknown ids are skipped."""
        return " ".join(self.token[i] for i in ids if i in self.token)


class Merges:
    """Ranks of pairs of ids in an open hash table, looked up for whole arrays."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, pairs: dict[int, tuple[int, int]]):
        self.made = np.zeros(1 + max((rank for rank, _ in pairs.values()), default=0), np.int64)
        self.bits = max(10, (len(pairs) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.zeros(1 << self.bits, np.int64)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        for key, slot in zip(keys.tolist(), self.slots(keys).tolist(), strict=True):
            rank, made = pairs[key]
            while self.keys[slot] >= 0:
                slot = slot + 1 & (1 << self.bits) - 1
            self.keys[slot], self.ranks[slot], self.made[rank] = key, rank, made

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def order(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """``rank << 32 | at`` of the pairs a, b at positions ``at``; NONE where there is no merge."""
        keys = a << 32 | b
        slots = self.slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots] << 32 | at, self.NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = slots[open_] + 1 & (1 << self.bits) - 1
            found = self.keys[slots[open_]]
            hit = open_[found == keys[open_]]
            out[hit] = self.ranks[slots[hit]] << 32 | at[hit]
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return out

    def merged(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Ids of fragments that begin at ``starts`` after all merges, -1 where one was merged away.

        Each round takes of each fragment the first pair of the lowest rank.
        """
        n = len(ids)
        if not n:
            return ids
        # position n stands beside the fragments' ends; no pair has its id
        ids = np.append(ids, (1 << 31) - 1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts - 1] = after[n - 1] = after[n] = n
        before[starts] = before[n] = n
        where = slot = np.arange(n + 1)
        slot = slot.copy()
        order = self.order(ids, ids[after], where)
        while True:
            best = np.minimum.reduceat(order, starts)
            on = best < self.NONE
            hit = best[on]
            if not len(hit):
                return ids[:n]
            i = hit & 0xFFFFFFFF
            j, h = after[i], before[i]
            k = after[j]
            ids[i], ids[j] = self.made[hit >> 32], -1
            after[i], before[k] = k, i
            # only fragments with a merge and ids that are left go on
            sizes = np.diff(starts, append=len(order) - 1)
            kept = np.append(np.repeat(on, sizes), True) & (ids[where] >= 0)
            sizes = np.add.reduceat(kept, starts, dtype=np.int64)
            sizes[-1] -= 1
            sizes = sizes[on]
            starts = np.cumsum(sizes) - sizes
            where, order = where[kept], order[kept]
            slot[where] = np.arange(len(where))
            order[slot[i]] = self.order(ids[i], ids[k], i)
            order[slot[h]] = self.order(ids[h], ids[i], h)


def word_finder(top: int = sys.maxunicode):
    """Finds contractions, letters, single numbers, other marks in texts without code points over ``top``."""
    letters, numbers = bpe.unicode_class("L", top), bpe.unicode_class("N", top)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{bpe.SPACE}{letters}{numbers}]+").findall


def blocks(texts: Iterable[str], size: int) -> Iterator[list[str]]:
    """Texts in lists of ``size`` characters; the last one of each may pass that."""
    held: list[str] = []
    left = size
    for text in texts:
        held.append(text)
        left -= len(text)
        if left <= 0:
            yield held
            held, left = [], size
    if held:
        yield held


@functools.cache
def codec_of(path: str) -> Codec:
    """One codec, with its caches, for all tasks of a worker process."""
    return Codec(path)


def forced_cuts(vocab: dict[str, int], suffix: str) -> bytearray:
    """1 at ``a << 8 | b`` where bytes a, b stand together in no token."""
    byte = {s: b for b, s in enumerate(bpe.byte_symbols())}
    cut = bytearray(b"\1") * 65536
    for token in vocab:
        raw = [byte[c] for c in (token[: -len(suffix)] if suffix and token.endswith(suffix) else token)]
        for a, b in zip(raw, raw[1:], strict=False):
            cut[a << 8 | b] = 0
    return cut


def merged_long(ids: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Ids after all merges, by a heap."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(*hit, i, ids[i], ids[i + 1]) for i in range(n - 1) if (hit := pairs.get(ids[i] << 32 | ids[i + 1]))]
    heap = [(rank, i, made, a, b) for rank, made, i, a, b in heap]
    heapq.heapify(heap)
    while heap:
        _, i, made, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = made, -1
        k = after[i] = after[j]
        for left, right in ((i, k), (before[i], i)):
            if left >= 0 and right < n and (hit := pairs.get(ids[left] << 32 | ids[right])):
                heapq.heappush(heap, (hit[0], left, hit[1], ids[left], ids[right]))
        if k < n:
            before[k] = i
    return [x for x in ids if x >= 0]


def encode_texts(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` for every row: the token ids and the text they decode to.

    Null and empty texts have no ids and decode to the empty text; rows repeat as they come; other
    columns are not read. ``vocabulary`` is a path that every executor can open.
    """

    def make():
        codec = codec_of(vocabulary)

        def run(texts: list[str]):
            made = list(codec.encode_texts(texts))
            return [np.frombuffer(ids, "<u4").astype(np.int64) for ids, _ in made], [decoded for _, decoded in made]

        return run

    return map_texts(df, doc_id, text, "ids array<long>, decoded string", make)


def decode_ids(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, decoded`` for rows of token ids; null ids decode to the empty text."""

    def make():
        codec = codec_of(vocabulary)
        return lambda _, rows: [[codec.decode(x or []) for x in rows]]

    from pyspark.sql import functions as F

    return map_texts(df.withColumn("_none", F.lit(None).cast("string")), doc_id, "_none", "decoded string", make, [ids])


def codec_digests(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for: :func:`encode_texts` reduced in the worker."""

    def make():
        codec = codec_of(vocabulary)

        def run(texts: list[str]):
            n, a, b, every = [], [], [], []
            for ids, decoded in codec.encode_texts(texts):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    every.append(np.frombuffer(ids, "<u4").astype(np.int64))
            return (n, a, b, every) if with_ids else (n, a, b)

        return run

    return map_texts(df, doc_id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>" * with_ids, make)


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of all ``documents``; nulls, empty and long texts, repeated rows and an empty table as in :func:`encode_texts`."""
    import public_tokenizers

    return codec_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
