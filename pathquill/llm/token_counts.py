"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list; a heap holds the rank of each mergeable adjacent pair. The
lowest rank, leftmost first, is popped until none is left: the count is the initial symbols less
the merges. No identifier is emitted. n symbols take O(n log n), so an endless word is no trap.
"""

from __future__ import annotations

import functools
import heapq
import re

from pyspark.sql import DataFrame, SparkSession

from . import bpe
from .common import map_texts, table


class Counter:
    """Counts the tokens of texts under a byte-level vocabulary file."""

    def __init__(self, path: str):
        vocab, self.pairs, self.added, _ = bpe.load(path)
        self.first = [vocab[s] for s in bpe.byte_symbols()]
        letters, numbers, space = bpe.unicode_class("L"), bpe.unicode_class("N"), bpe.SPACE
        # contractions, letters, numbers, other marks (each with one space before), trailing space, space
        self.words = re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.odd_space = re.compile(f" [{space}]|(?! )[{space}] ").search
        self.runs = re.compile(f"(?<=[^{space}])(?= )").split
        self.by_word = bpe.Cache(self.count_word)
        self.by_piece = bpe.Cache(self.count_piece)
        self.split_added = bpe.added_splitter(self.added).split if self.added else None

    def count_word(self, word: str) -> int:
        ids = [self.first[b] for b in word.encode()]
        return len(ids) - merges(ids, self.pairs)

    def count_piece(self, piece: str) -> int:
        return sum(map(self.by_word.__getitem__, self.words(piece)))

    def count_plain(self, text: str) -> int:
        """A space after a non-space always starts a new word, so text is cut there and pieces are cached."""
        if self.odd_space(text):
            return sum(map(self.by_piece.__getitem__, self.runs(text)))
        head, *rest = text.split(" ")
        if not rest:
            return self.by_piece[head]
        count = self.by_spaced
        return self.by_piece[head] + sum(map(count.__getitem__, rest))

    @property
    def by_spaced(self) -> bpe.Cache:
        """Counts of a space and the piece."""
        if not hasattr(self, "_spaced"):
            self._spaced = bpe.Cache(lambda piece: self.count_piece(" " + piece))
        return self._spaced

    def count(self, text: str) -> int:
        if not self.added or not any(a in text for a in self.added):
            return self.count_plain(text) if text else 0
        return sum(1 if part in self.added else self.count_plain(part) for part in self.split_added(text) if part)


@functools.cache
def counter_of(path: str) -> Counter:
    """One counter, with its caches, for all tasks of a worker process."""
    return Counter(path)


def merges(ids: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """How many merges byte-pair encoding makes on these symbols; ``ids`` is overwritten."""
    n = len(ids)
    heap = []
    for i in range(n - 1):
        hit = pairs.get(ids[i] << 32 | ids[i + 1])
        if hit:
            heap.append((hit[0], i, hit[1], ids[i], ids[i + 1]))
    if not heap:
        return 0
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    done = 0
    while heap:
        _, i, made, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else n
        if j >= n or ids[j] != b:
            continue  # one side has merged meanwhile
        done += 1
        ids[i], ids[j] = made, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            hit = pairs.get(made << 32 | ids[k])
            if hit:
                heapq.heappush(heap, (hit[0], i, hit[1], made, ids[k]))
        h = before[i]
        if h >= 0:
            hit = pairs.get(ids[h] << 32 | made)
            if hit:
                heapq.heappush(heap, (hit[0], h, hit[1], ids[h], made))
    return done


def token_counts(df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row.

    ``vocabulary`` is the path of a byte-level file that every executor can open. Null and empty
    texts have 0 bytes and 0 tokens; rows repeat as they come; other columns are not read.
    """

    def make():
        counter = counter_of(vocabulary)

        def run(texts: list[str]):
            n = [counter.count(t) for t in texts]
            return [len(t.encode()) for t in texts], n, [x > limit for x in n]

        return run

    return map_texts(df, doc_id, text, "n_bytes long, n_tokens long, over_limit boolean", make)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all ``documents``; nulls, empty and long texts and repeated rows as in :func:`token_counts`."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
