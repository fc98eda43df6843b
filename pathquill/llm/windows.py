"""Repeated windows of a corpus by super-k-mer partitioning, for any kind of symbol.

A window is ``length`` consecutive symbols (words, bytes) of one document. Its minimiser is the
smallest hash of the ``gram``-symbol grams inside it, so equal windows have equal minimisers, and
consecutive windows mostly share one: such a run travels as one packed string.

1. Minimisers are counted over all documents. Only those that occur twice, in two runs or
   within one run, can head a repeated window; the others are dropped before any text moves.
2. Documents with such minimisers are cut into packed runs of at most ``LONGEST`` windows.
3. Runs, collapsed within each task, meet in their minimiser's bucket, where a solver marks the
   windows that start more than once. A minimiser whose runs have more than ``bucket_symbols`` symbols together is dealt out by the
   content of its single windows instead, so one shared by a third of all documents never meets in one task
   and a bucket's memory is bounded.
4. Marks go back along the runs' ids and become removed symbol ranges of each document.

Counts, ids and ranges move; text moves twice, compressed: once to be cut into runs, once to meet its ranges.
Documents are known by two hashes of id and text: equal rows share them, and count as often as they occur.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_dir, drop_table, group_starts, settle, shuffle_width, whole_groups

#: Windows of a run at most; longer runs, as in text of few symbols, are cut.
LONGEST = 4096
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols, and runs of symbols packed strings."""

    length: int
    gram: int
    #: (texts) -> (64-bit hash of each symbol's neighbourhood, first symbol of each text, state to cut from)
    hashes: Callable[[list[str]], tuple[np.ndarray, np.ndarray, object]]
    #: (state, first symbol of the text, first symbol in it, end in it) -> packed string
    cut: Callable[[object, int, int, int], bytes]
    #: packed string -> the content of each of its windows
    views: Callable[[bytes], list[bytes]]
    #: symbols that a symbol's hash reaches over
    wide: int = 1


def gram_hashes(h: np.ndarray, count: int) -> np.ndarray:
    """Hashes of ``count`` (a power of two) consecutive entries, at each entry but the last ones."""
    n, k = 1, 0
    while n < count:
        h = h[:-n] * MIX[k % 5] + h[n:]
        n, k = n * 2, k + 1
    h = h ^ (h >> np.uint64(29))
    h *= MIX[5]
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if n < width else h


def runs_of(s: Symbols, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Runs of windows with one minimiser: (text number, first window, windows, minimiser, repeats inside, (state, first)).

    Texts are concatenated, and windows across their borders left out.
    """
    h, first, state = s.hashes(texts)
    width = s.length - s.gram + 1
    empty = np.empty(0, np.int64)
    if len(h) < s.length:
        return empty, empty, empty, empty, empty.astype(bool), (state, first)
    g = gram_hashes(h, s.gram // s.wide) if s.gram > s.wide else h
    m = sliding_min(g[: len(h) - s.gram + 1], width)
    start, end = first[:-1], np.maximum(first[1:] - s.length + 1, first[:-1])  # windows of each text
    edge = np.zeros(len(m) + 1, np.int8)
    np.add.at(edge, np.minimum(start, len(m)), 1)
    np.add.at(edge, np.minimum(end, len(m)), -1)
    inside = np.cumsum(edge[:-1]) > 0
    new = np.empty(len(m), bool)
    new[0] = True
    np.not_equal(m[1:], m[:-1], out=new[1:])
    new[start[(start < len(m)) & (end > start)]] = True
    at = np.flatnonzero(new & inside)
    if len(at) and np.diff(np.append(at, len(m))).max() > LONGEST:
        since = np.arange(len(m)) - np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
        new |= since % LONGEST == 0
        at = np.flatnonzero(new & inside)
    stop = np.flatnonzero(new | ~inside)
    ends = np.append(stop, len(m))[np.searchsorted(stop, at, "right")]
    # a run that meets its minimiser again within a window's reach, or is longer than one minimiser can carry
    again = np.zeros(len(m) + 1, np.int32)
    again[1:-1] = np.cumsum((g[: len(m) - 1] == m[:-1]) & ~new[1:] & inside[:-1])
    again[-1] = again[-2] if len(m) > 1 else 0
    own = (again[ends - 1] - again[at] > 0) | (ends - at >= width)
    doc = np.searchsorted(first, at, "right") - 1
    return doc, at - first[doc], ends - at, m[at].view(np.int64), own, (state, first)


def keyed(df: DataFrame, doc_id: str, text: str) -> list:
    """Two hashes that name a row by its id and text."""
    d, t = F.col(doc_id), F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(d, t).alias("_k1"), F.xxhash64(t, F.lit(1), d).alias("_k2")]


def squeezed(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` with ``_k1, _k2`` and the text compressed as ``_z`` in its place: what a shuffle of texts moves."""
    others = [c for c in df.columns if c != text]
    source = df.select(*others, *keyed(df, doc_id, text), F.col(text).alias("_z"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = [None if t is None else pack(t.encode()) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.binary())], names=batch.schema.names)

    schema = T.StructType([*source.schema.fields[:-1], T.StructField("_z", T.BinaryType())])
    return source.mapInArrow(squeeze, schema)


def unsqueezed(column: pa.Array) -> list[str | None]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [None if z is None else unpack(z).decode() for z in column.to_pylist()]


def batched(texts: list[str], budget: int = 400_000) -> Iterator[tuple[int, list[str]]]:
    """Slices of about ``budget`` characters, small enough for the processor's cache."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= budget:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


PACKED = "anchor long, r1 long, r2 long, times long, packed binary, hot boolean, k1 long, k2 long, first long, windows long"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def packed_rows(**columns) -> pa.RecordBatch:
    """A batch of :data:`PACKED` with nulls in the columns not given."""
    n = len(next(iter(columns.values())))
    names = [c.split(" ")[0] for c in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, _TYPES, strict=True)], names=names)


#: Symbols of a bucket at most; in the solvers each takes some hundred bytes.
BUCKET_SYMBOLS = 1_000_000


def repeated_ranges(docs: DataFrame, s: Symbols, solve: Callable[[list[bytes], int], list[np.ndarray]], doc_id: str, text: str, bucket_symbols: int = BUCKET_SYMBOLS) -> DataFrame:
    """``k1, k2, marks``: the repeated windows of each document that has any, as start, end, start, end, ...

    ``solve(packed, length)`` gets distinct runs and returns, for each, the windows (offsets) whose content
    starts at least twice among all of them. Minimisers of more than ``bucket_symbols`` symbols are dealt out by content.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1 = batch.column(0).to_numpy()
            for at, texts in batched([t or "" for t in batch.column(1).to_pylist()]):
                doc, _, windows, anchor, own, _ = runs_of(s, texts)
                # one number tells the windows of a run and whether it repeats its minimiser: negative if so
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(k1[at + doc]), pa.array(np.where(own, -windows, windows).astype(np.int32))], names=["anchor", "k1", "windows"])

    place = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    heads_at = f"{place}-heads"
    rows.select(keyed(rows, "_id", "text")[0], "text").mapInArrow(minimisers, "anchor long, k1 long, windows int").write.option("compression", "zstd").parquet(heads_at)
    heads = spark.read.schema("anchor long, k1 long, windows int").parquet(heads_at)
    size = F.sum(F.abs("windows").cast("long") + (s.length - 1))
    live = heads.groupBy("anchor").agg(F.count("*").alias("n"), F.min("windows").alias("least"), size.alias("size"))
    live = live.where("n > 1 or least < 0").select("anchor", (F.col("size") > bucket_symbols).alias("hot"))
    # the list of a document is bounded by its own length; what shares a first hash by chance is cut in vain
    wanted = heads.select("anchor", F.col("k1").alias("_k1")).join(live, "anchor").groupBy("_k1").agg(F.collect_list("anchor").alias("live"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("heat"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each occurrence of a run, and one for each distinct run with its string and count here."""
        again: dict[tuple[int, int, int], int] = {}  # runs whose string has been sent -> further occurrences

        def rest() -> Iterator[pa.RecordBatch]:
            more = [(*run, n) for run, n in again.items() if n]
            if more:
                anchor, r1, r2, times = zip(*more, strict=True)
                yield packed_rows(anchor=anchor, r1=r1, r2=r2, times=times, hot=np.isin(anchor, list(heat)))
            again.clear()

        heat: set[int] = set()
        for batch in batches:
            k1, k2, live, hot = (batch.column(k) for k in (0, 1, 3, 4))
            k1, k2 = k1.to_numpy(), k2.to_numpy()
            heat.update(hot.flatten().to_pylist())
            for at, texts in batched([t or "" for t in unsqueezed(batch.column(2))]):
                doc, first, count, anchor, _, (state, begin) = runs_of(s, texts)
                ok = np.isin(anchor, live.slice(at, len(texts)).flatten().to_numpy())
                doc, first, count, anchor = doc[ok], first[ok], count[ok], anchor[ok]
                if not len(doc):
                    continue
                strings = [s.cut(state, b, a, a + n + s.length - 1) for b, a, n in zip(begin[doc].tolist(), first.tolist(), count.tolist(), strict=True)]
                pair = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), "<i8").reshape(-1, 2)
                yield packed_rows(r1=pair[:, 0], r2=pair[:, 1], k1=k1[at + doc], k2=k2[at + doc], first=first, windows=count)
                new = []
                for k, run in enumerate(zip(anchor.tolist(), pair[:, 0].tolist(), pair[:, 1].tolist(), strict=True)):
                    if run in again:
                        again[run] += 1
                    else:
                        again[run] = 0
                        new.append(k)
                at_new = np.array(new, np.int64)
                yield packed_rows(anchor=anchor[at_new], r1=pair[at_new, 0], r2=pair[at_new, 1], times=np.ones(len(new), np.int64), packed=[strings[k] for k in new], windows=count[at_new], hot=np.isin(anchor[at_new], list(heat)))
                if len(again) > 300_000:
                    yield from rest()
        yield from rest()

    texts = squeezed(rows, "_id", "text").select("_k1", "_k2", "_z")
    texts.join(wanted, "_k1").select("_k1", "_k2", "_z", "live", "heat").mapInArrow(pack, PACKED).write.option("compression", "zstd").parquet(place)
    drop_table(spark, heads_at)
    packed = spark.read.schema(PACKED).parquet(place)

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["anchor"], 2_000):
            starts = np.append(group_starts(t, ["anchor"]), t.num_rows)
            # some runs at a time keep the sort in the processor's cache
            cuts = [0]
            for e in starts[1:].tolist():
                if e - cuts[-1] >= 150:
                    cuts.append(e)
            for a, e in zip(cuts, [*cuts[1:], t.num_rows], strict=True):
                if e > a:
                    yield marks_of(t.slice(a, e - a), s.length, solve)

    runs = packed.where("anchor is not null")
    bucket = runs.where("not hot").select("anchor", "r1", "r2", "times", "packed", "windows").repartition(shuffle_width(spark), "anchor").sortWithinPartitions("anchor", "r1", "r2")
    marked = bucket.mapInArrow(bucketed, MARKS).union(by_content(runs.where("hot"), s))
    occurrences = packed.where("k1 is not null").select("r1", "r2", "k1", "k2", "first")
    found = occurrences.join(marked, ["r1", "r2"]).select("k1", "k2", F.transform("marks", lambda m: m + F.col("first")).alias("marks"))
    found = settle(found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("marks")).alias("marks")))
    drop_table(spark, place)
    return found


MARKS = "r1 long, r2 long, marks array<long>"


def marks_of(t: pa.Table, length: int, solve) -> pa.RecordBatch:
    """Marks of the runs of whole buckets (rows sorted by bucket and run); runs without any are left out."""
    anchor, r1, r2, times = (t.column(k).to_numpy() for k in ("anchor", "r1", "r2", "times"))
    new = np.append(True, (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1]) | (anchor[1:] != anchor[:-1]))
    at = np.flatnonzero(new)
    total = np.add.reduceat(times, at)
    strings: list[bytes] = []
    windows: list[int] = []
    column, counts = t.column("packed").to_pylist(), t.column("windows").to_pylist()
    for a, e in zip(at.tolist(), [*at[1:].tolist(), t.num_rows], strict=True):
        k = next(k for k in range(a, e) if column[k] is not None)
        strings.append(column[k])
        windows.append(counts[k])
    bucket = anchor[at]
    alone = np.append(True, bucket[1:] != bucket[:-1]) & np.append(bucket[1:] != bucket[:-1], True)
    # alone in its bucket and there twice: repeated as a whole, and nothing else to compare with
    whole = (alone & (total > 1)).tolist()
    compared = [k for k, w in enumerate(whole) if not w]
    offsets = dict(zip(compared, solve([strings[k] for k in compared], length) if compared else [], strict=True))
    keep, marks = [], []
    for k in range(len(at)):
        if total[k] > 1:
            keep.append(k)
            marks.append(np.array([0, windows[k]]))
        elif len(found := offsets[k]):
            gap = np.flatnonzero(np.diff(found) != 1)
            starts, ends = found[np.append(0, gap + 1)], found[np.append(gap, len(found) - 1)] + 1
            keep.append(k)
            marks.append(np.column_stack([starts, ends]).reshape(-1))
    rows = at[np.array(keep, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(r1[rows]), pa.array(r2[rows]), pa.array(marks, pa.list_(pa.int64()))], names=["r1", "r2", "marks"])


def by_content(runs: DataFrame, s: Symbols) -> DataFrame:
    """Marks of the runs of hot minimisers: every single window goes where its own content leads."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r1, r2, x in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, s.views(x))), "<i8").reshape(-1, 2)
                at = np.lexsort((digest[:, 1], digest[:, 0]))
                digest = digest[at]
                first = np.flatnonzero(np.append(True, (digest[1:] != digest[:-1]).any(axis=1)))
                n = len(first)
                offsets = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(digest[first, 0]), pa.array(digest[first, 1]), pa.array(np.full(n, r1)), pa.array(np.full(n, r2)), offsets], names=["w1", "w2", "r1", "r2", "at"])

    # a row for each content that a run has; what it has twice needs no other run
    each = runs.where("packed is not null").select("r1", "r2", "packed").dropDuplicates(["r1", "r2"]).mapInArrow(explode, "w1 long, w2 long, r1 long, r2 long, at array<long>")
    twice = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    shared = each.where("size(at) = 1").join(twice, ["w1", "w2"]).select("r1", "r2", "at").union(each.where("size(at) > 1").select("r1", "r2", "at"))
    single = shared.select("r1", "r2", F.explode("at").alias("at")).select("r1", "r2", "at", (F.col("at") + 1).alias("end"))
    whole = runs.groupBy("r1", "r2").agg(F.sum("times").alias("n"), F.max("windows").alias("windows")).where("n > 1")
    both = single.union(whole.select("r1", "r2", F.lit(0).cast("long"), "windows"))
    # one row for each run: a run is bounded by its document
    return both.groupBy("r1", "r2").agg(F.flatten(F.collect_set(F.array("at", "end"))).alias("marks"))


def covered(marks, length: int, size: int) -> list[tuple[int, int]]:
    """Merged [start, end) symbol ranges that windows at ``marks`` (flat start, end pairs) cover."""
    if marks is None or not len(marks):
        return []
    pairs = np.asarray(marks, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    ends = np.maximum.accumulate(np.minimum(pairs[:, 1] + length - 1, size))
    new = np.flatnonzero(np.append(True, pairs[1:, 0] > ends[:-1]))
    return list(zip(pairs[new, 0].tolist(), ends[np.append(new[1:] - 1, len(ends) - 1)].tolist(), strict=True))


def with_marks(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """All rows of ``docs``: its other columns, the compressed text ``_z`` and the ``_marks`` found (null: none)."""
    marks = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("marks").alias("_marks"))
    return squeezed(docs, doc_id, text).join(marks, ["_k1", "_k2"], "left").drop("_k1", "_k2")
