"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document, as search engines shard theirs: one row for each document
with the postings (term, positions) of its benchmark terms. Postings are stored where a phrase could
be: within reach of an occurrence of an anchor, the rarest term of some window by counts over all
documents. A search starts from a window's anchor postings and intersects the offset-adjusted lists of
the other terms, rarest first; with every term of the window intersected, the match is exact.

Benchmarks are taken in blocks of bounded size, so what is broadcast stays small however many
items there are; each block has its own index.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, settle, table

WINDOW = 10
#: Bytes of benchmark text that one block holds at most, on average: the bound of what is broadcast.
BLOCK_BYTES = 8_000_000

_lower = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 128)) + bytes(range(128, 256))
#: Lower-cases A-Z and makes every other ASCII byte but digits and letters a space.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in _lower)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Windows:
    """The distinct windows of a block of items: term ids, and which items hold them."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        places: dict[str, int] = {}  # of the items' ids as text: a repeated id is one item
        found: dict[tuple[int, ...], set[int]] = defaultdict(set)
        for item_id, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            if ids and item_id is not None:
                place = places.setdefault(str(item_id), len(places))
                for i in range(max(1, len(ids) - window + 1)):
                    found[tuple(ids[i : i + window])].add(place)
        self.items = list(places)
        self.phrases = list(found)
        self.holders = [sorted(s) for s in found.values()]

    def plan(self, counts: np.ndarray) -> None:
        """Orders each window's terms from the rarest, and lists windows by their anchor."""
        self.order = [sorted(((t, i) for i, t in enumerate(p)), key=lambda x: (counts[x[0]], x[0], x[1])) for p in self.phrases]
        self.by_anchor: dict[int, list[int]] = defaultdict(list)
        for w, terms in enumerate(self.order):
            self.by_anchor[terms[0][0]].append(w)
        self.is_anchor = np.zeros(len(self.vocab) + 1, bool)
        self.is_anchor[list(self.by_anchor)] = True


def term_ids(words: list[bytes], vocab: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(vocab.get, words, repeat(-1)), np.int32, len(words))


def term_counts(docs: DataFrame, text: str, windows: Windows) -> np.ndarray:
    """Occurrences of each benchmark term over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(windows.vocab)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        sums = np.zeros(len(vocab) + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                sums += np.bincount(term_ids(words_of(t), vocab) + 1, minlength=len(vocab) + 1)
        at = np.flatnonzero(sums[1:])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[1:][at])], names=["term", "n"])

    got = docs.select(text).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a block's terms at most
    counts = np.zeros(len(windows.vocab), np.int64)
    counts[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return counts


INDEX = "n_words long, terms array<int>, starts array<int>, positions array<int>, k1 long, k2 long"
#: What names a row in the indexes of several blocks: two hashes of id and text, and the id.
KEYS = ["k1", "k2", "doc_id"]


def build_index(docs: DataFrame, windows: Windows, doc_id: str = "doc_id", text: str = "text", reach: int = WINDOW) -> DataFrame:
    """One row for each document: its length, the postings within ``reach`` words of an anchor, and its hashes.

    ``terms`` are ascending; the positions of ``terms[k]`` are ``positions[starts[k]:starts[k+1]]``.
    """
    windows.plan(term_counts(docs, text, windows))
    shared = docs.sparkSession.sparkContext.broadcast((windows.vocab, windows.is_anchor))
    kind = docs.schema[doc_id].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, is_anchor = shared.value
        for batch in batches:
            n_words, terms, starts, positions = [], [], [], []
            for t in batch.column(1).to_pylist():
                ids = term_ids(words_of(t), vocab)
                n_words.append(len(ids))
                near = np.zeros(len(ids) + 1, np.int32)
                at = np.flatnonzero(is_anchor[ids] & (ids >= 0))
                np.add.at(near, np.maximum(at - reach, 0), 1)
                np.add.at(near, np.minimum(at + reach + 1, len(ids)), -1)
                pos = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (ids >= 0))
                pos = pos[np.argsort(ids[pos], kind="stable")]
                first = np.flatnonzero(np.diff(ids[pos], prepend=-1))
                terms.append(ids[pos][first])
                starts.append(np.append(first, len(pos)).astype(np.int32))
                positions.append(pos.astype(np.int32))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), *(pa.array(x, ints) for x in (terms, starts, positions)), batch.column(2), batch.column(3)], names=["doc_id", "n_words", "terms", "starts", "positions", "k1", "k2"])

    keys = F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(1), doc_id).alias("k2")
    return settle(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keys).mapInArrow(index, f"doc_id {kind}, {INDEX}"))


def phrase_matches(windows: Windows, lists: dict[int, np.ndarray]) -> Iterator[tuple[int, set[int]]]:
    """(window, starts) of every exact occurrence in a document with these postings."""
    as_set: dict[int, set[int]] = {}
    for anchor in lists.keys() & windows.by_anchor.keys():
        base = lists[anchor].tolist()
        for w in windows.by_anchor[anchor]:
            (_, shift), *others = windows.order[w]
            starts = {p - shift for p in base}
            for term, offset in others:
                if term not in lists:
                    starts = None
                    break
                if term not in as_set:
                    as_set[term] = set(lists[term].tolist())
                there = as_set[term]
                starts = {s for s in starts if s + offset in there}
                if not starts:
                    break
            if starts:
                yield w, starts


def proximity_matches(windows: Windows, lists: dict[int, np.ndarray], slop: int) -> Iterator[tuple[int, int, int]]:
    """(window, first, last word) of stretches of at most window + ``slop`` words that hold all its terms, in any order.

    A term that occurs k times in the window must occur k times. Stretches around each anchor
    occurrence are tried; the index needs a reach of at least window + slop.
    """
    for anchor in lists.keys() & windows.by_anchor.keys():
        for w in windows.by_anchor[anchor]:
            phrase = windows.phrases[w]
            need = {t: phrase.count(t) for t in set(phrase)}
            if not need.keys() <= lists.keys():
                continue
            span = len(phrase) + slop
            every = np.sort(np.concatenate([lists[t] for t in need]))
            for p in lists[anchor].tolist():
                around = every[np.searchsorted(every, p - span + 1) : np.searchsorted(every, p, "right")].tolist()
                for first in around:
                    inside = {t: (np.searchsorted(lists[t], first), np.searchsorted(lists[t], first + span)) for t in need}
                    if all(b - a >= need[t] for t, (a, b) in inside.items()):
                        yield w, first, max(int(lists[t][inside[t][0] + need[t] - 1]) for t in need)
                        break


def unpack(terms, starts, positions) -> dict[int, np.ndarray]:
    return {int(t): positions[a:b] for t, a, b in zip(terms, starts[:-1], starts[1:], strict=True)}


def search(index: DataFrame, windows: Windows, slop: int | None = None) -> DataFrame:
    """``doc_id, n_words, hits, items, near, near_items, k1, k2`` for each document: merged [start, end) word runs and item ids.

    ``hits`` and ``items`` are of exact matches, ``near`` and ``near_items`` of proximity matches with ``slop``; without one
    they are empty. ``k1, k2`` are the row's hashes.
    """
    shared = index.sparkSession.sparkContext.broadcast(windows)
    kind = index.schema["doc_id"].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            hits, items, near, near_items = [], [], [], []
            lists = [(c.offsets.to_numpy(), c.flatten().to_numpy()) for c in (batch.column(k) for k in (2, 3, 4))]
            for r in range(batch.num_rows):
                terms, starts, positions = (v[o[r] - o[0] : o[r + 1] - o[0]] for o, v in lists)
                spans, held, near_spans, near_held = [], set(), [], set()
                if len(terms):
                    postings = unpack(terms, starts, positions)
                    for k, found in phrase_matches(w, postings):
                        spans += [(s, s + len(w.phrases[k])) for s in found]
                        held.update(w.holders[k])
                    if slop is not None:
                        for k, first, last in proximity_matches(w, postings, slop):
                            near_spans.append((first, last + 1))
                            near_held.update(w.holders[k])
                hits.append(merge_runs(spans))
                items.append([w.items[k] for k in held])
                near.append(merge_runs(near_spans))
                near_items.append([w.items[k] for k in near_held])
            runs, ids = pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, runs), pa.array(items, ids), pa.array(near, runs), pa.array(near_items, ids), batch.column(5), batch.column(6)], names=["doc_id", "n_words", "hits", "items", "near", "near_items", "k1", "k2"])

    return index.mapInArrow(look, f"doc_id {kind}, n_words long, hits array<array<bigint>>, items array<string>, near array<array<bigint>>, near_items array<string>, k1 long, k2 long")


def merge_runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about ``BLOCK_BYTES`` of text, dealt by a hash of text and id."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = -(-int(size) // BLOCK_BYTES) or 1
    rows = benchmark.select(F.col(item_id), F.col(text))
    for k in range(blocks):
        block = rows.where(F.pmod(F.xxhash64(item_id, text), F.lit(blocks)) == k).collect() if blocks > 1 else rows.collect()
        if block or not k:
            yield [tuple(r) for r in block]


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """``doc_id, n_words, hits, items`` for every row of ``docs``; with a ``slop`` also ``near, near_items``.

    ``hits`` are the merged [start, end) word runs inside occurrences of benchmark windows; ``items`` the
    ids, as text, of items with an occurring window. ``near`` and ``near_items`` are the same for stretches of
    at most window + ``slop`` words that hold all terms of a window in any order. Null and empty texts have no words. Items without
    words, or with a null id, are left out; repeated items count once. Every row has
    its own result, whatever the number of blocks that the benchmark takes: repeated rows are counted, and
    rows that share an id, or have none, stay apart.
    """
    parts = []
    for block in item_blocks(benchmark, item_id, item_text):
        windows = Windows(block, window)
        parts.append(search(build_index(docs, windows, doc_id, text, window + (slop or 0)), windows, slop))
    found = parts[0]
    hits, items = (["hits"], ["items"]) if slop is None else (["hits", "near"], ["items", "near_items"])
    if len(parts) > 1:
        # equal rows have equal results: each block gives one of them and their number
        one = [part.groupBy(*KEYS).agg(F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ["n_words", *hits, *items])) for part in parts]
        gathered = {c: F.flatten(F.collect_list(c)) for c in hits + items}
        gathered |= {c: F.array_distinct(gathered[c]) for c in items}
        found = reduce(DataFrame.union, one).groupBy(*KEYS).agg(F.max("rows").alias("rows"), F.max("n_words").alias("n_words"), *(x.alias(c) for c, x in gathered.items()))
        found = found.withColumns({c: merged_hits(F.col(c)) for c in hits}).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return found.select("doc_id", "n_words", "hits", "items", *hits[1:], *items[1:])


def merged_hits(hits):
    """Overlapping runs united, for hits that several blocks found."""
    zero = F.array().cast("array<array<bigint>>")

    def add(done, run):
        last = F.element_at(done, -1)
        grow = (F.size(done) > 0) & (run[0] <= last[1])
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], run[1]))))
        return F.when(grow, joined).otherwise(F.concat(done, F.array(run)))

    return F.aggregate(F.array_sort(hits), zero, add)


def drop_contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", share: float = 0.0) -> DataFrame:
    """Rows of ``docs``, all columns, of whose words at most ``share`` lie in benchmark windows.

    The words in windows are those that :func:`contamination` finds over all blocks; rows are dropped by two hashes
    of their text, written down first so that Spark sees how few they are. Null and empty texts stay, equal texts stay or go
    together, and a benchmark without items drops nothing.
    """
    spark = docs.sparkSession
    keys = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    marked = docs.select(F.struct(keys[0].alias("_gone1"), keys[1].alias("_gone2")).alias("doc_id"), F.col(text).alias("text"))
    found = contamination(marked, benchmark, window=window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, run: n + run[1] - run[0])
    place = f"{checkpoint_dir(spark)}/contaminated-{uuid.uuid4().hex}"
    found.where(n_hit > share * F.col("n_words")).select("doc_id.*").distinct().write.parquet(place)
    gone = spark.read.parquet(place)
    return docs.join(gone, (keys[0] == gone["_gone1"]) & (keys[1] == gone["_gone2"]), "left_anti")


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all ``documents``; nulls, empty texts and items, repeated rows and ids as in :func:`contamination`."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, run: n + run[1] - run[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
