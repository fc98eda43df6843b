"""Near-duplicate texts by order min-hashing and banded alignment.

The k-mers of a text (``K`` words) are labelled with their occurrence. For each of ``SKETCHES`` hash
functions the ``KEEP`` smallest labelled k-mers are taken and written down in text order; equal
sketches make a bucket. Two texts meet when even one sketch agrees in members and order, which follows
edit similarity, not set overlap alone.

Candidates are verified: shared labelled k-mers bound the similarity from above; what passes is aligned
within the band of edits that the threshold allows, and the aligned runs give the shingles
that both texts have in the same order. Links are texts whose ordered shingle similarity is ``threshold``
or more. Equal texts are collapsed first. Buckets of more than ``block`` texts or ``block_words`` words are dealt out as pairs
of blocks, so that a task holds two blocks at most, however many or long the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Cache
from .common import components, group_starts, settle, shuffle_width, table, whole_groups

K, KEEP, SKETCHES = 5, 3, 12
MARKS = ".,;:!?\"'()[]{}<>|*#$%&_-"
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def word_hash(piece: str) -> int:
    """Hash of a word, case and outer marks aside; 0 for marks alone."""
    word = piece.lower().strip(MARKS)
    return xxhash.xxh3_64_intdigest(word) or 1 if word else 0


def words_of(text: str, cache: Cache) -> np.ndarray:
    pieces = text.split()
    h = np.fromiter(map(cache.__getitem__, pieces), np.uint64, len(pieces))
    return h[h != 0]


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-mers of a text, labelled with their occurrence so that all differ."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(32))) * ODD[0] + words[j : j + n]
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if same.any():
        run = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(n), 0))
        h[order] = h[order] + run.astype(np.uint64) * ODD[2]
    return h


def sketches(h: np.ndarray) -> list[int]:
    """One key for each hash function: the ``KEEP`` smallest labelled k-mers, in text order."""
    out = []
    for s in range(SKETCHES):
        x = (h ^ np.uint64((s + 1) * int(ODD[1]) & (1 << 64) - 1)) * ODD[3]
        x ^= x >> np.uint64(32)
        x *= ODD[0]
        x ^= x >> np.uint64(29)
        at = np.sort(np.argpartition(x, KEEP)[:KEEP]) if len(x) > KEEP else np.arange(len(x))
        out.append(xxhash.xxh3_64_intdigest(h[at].tobytes()) - (1 << 63))
    return out


def most_edits(a: int, b: int, threshold: float) -> int:
    """Edits that a cheapest alignment of texts of ``a`` and ``b`` shingles has at most, if they reach the threshold.

    Every word outside the matched runs, and every shingle that a break between two runs costs, is missing
    in ``a + b - 2 * common``; an edit leaves one such word at least. One more is for rounding.
    """
    common = threshold * (a + b) / (1 + threshold)
    return int(a + b - 2 * common) + 1


def aligned_runs(a: np.ndarray, b: np.ndarray, band: int) -> list[int] | None:
    """Lengths of the matched runs of a cheapest alignment; None beyond ``band`` edits.

    Furthest-reaching points on the diagonals within the band, one edit more each round.
    """
    n, m = len(a), len(b)
    if abs(n - m) > band:
        return None

    def slide(i: int, j: int) -> int:
        """How far a and b agree from here."""
        start, step = i, 32
        while i < n and j < m:
            k = min(step, n - i, m - j)
            differs = a[i : i + k] != b[j : j + k]
            first = int(differs.argmax())
            if differs[first]:
                return i + first - start
            i, j, step = i + k, j + k, step * 4
        return i - start

    # diagonal d = i - j; a row has the furthest i on each from its first, -2 where none is
    goal = n - m
    rows = [(0, np.array([slide(0, 0)], np.int32))]

    def furthest(row: tuple[int, np.ndarray], d: int) -> int:
        first, reach = row
        return int(reach[d - first]) if 0 <= d - first < len(reach) else -2

    while furthest(rows[-1], goal) < n:
        e = len(rows)
        if e > band:
            return None
        # from other diagonals the goal is out of the band's reach
        lo, hi = max(-e, -m, goal - (band - e)), min(e, n, goal + (band - e))
        first, reach = rows[-1]
        last = np.full(hi - lo + 3, -2, np.int32)  # lo - 1 to hi + 1
        x, y = max(first, lo - 1), min(first + len(reach), hi + 2)
        last[x - lo + 1 : y - lo + 1] = reach[x - first : y - first]
        d = np.arange(lo, hi + 1, dtype=np.int32)
        best = np.minimum(np.maximum(np.maximum(last[1:-1], last[:-2]) + 1, last[2:]), np.minimum(n, m + d))
        best[best < np.maximum(d, 0)] = -2
        at = np.flatnonzero((best >= 0) & (best < n) & (best - d < m))
        at = at[a[best[at]] == b[(best - d)[at]]]
        for k in at.tolist():
            i = int(best[k])
            best[k] = i + slide(i, i - lo - k)
        rows.append((lo, best))
    runs, d, i = [], goal, n
    for e in range(len(rows) - 1, 0, -1):
        last = rows[e - 1]
        choices = ((furthest(last, d) + 1, d), (furthest(last, d - 1) + 1, d - 1), (furthest(last, d + 1), d + 1))
        start, came = max(choices, key=lambda c: min(c[0], n, m + d))
        start = min(start, n, m + d)
        runs.append(i - start)
        d, i = came, furthest(last, came)
    runs.append(i)
    return runs


def ordered_similarity(a: np.ndarray, b: np.ndarray, threshold: float, k: int = K) -> float:
    """Shared shingles in the same order over all shingles; 0 where the alignment leaves the band."""
    na, nb = max(len(a) - k + 1, 0), max(len(b) - k + 1, 0)
    runs = aligned_runs(a, b, most_edits(na, nb, threshold))
    if runs is None or not na + nb:
        return 0.0
    common = sum(max(r - k + 1, 0) for r in runs)
    return common / (na + nb - common)


def link_group(words: list[np.ndarray], keys: np.ndarray, band: np.ndarray, block: np.ndarray, split: bool, threshold: float) -> list[tuple[int, int]]:
    """Links of a bucket that join its components: a pair is tried unless its ends are joined already.

    ``keys`` are all sketches of each text; a pair that meets under an earlier one is left to it.
    """
    g = len(words)
    marks = [shingles(w) for w in words]
    sizes = np.array([len(x) for x in marks])
    owner = np.repeat(np.arange(g), sizes)
    flat = np.concatenate(marks)
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    starts = np.append(np.flatnonzero(np.append(True, flat[1:] != flat[:-1])), len(flat))
    parent = list(range(g))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(g - 1):
        where = np.searchsorted(flat[starts[:-1]], marks[i])
        lo, hi = starts[where], starts[where + 1]
        span = np.repeat(lo - np.append(0, np.cumsum(hi - lo)[:-1]), hi - lo) + np.arange(int((hi - lo).sum()))
        shared = np.bincount(owner[span], minlength=g)
        ok = shared >= threshold * (sizes[i] + sizes - shared)
        ok[: i + 1] = False
        if split:
            ok &= block != block[i]
        js = np.flatnonzero(ok)
        js = js[np.argmax(keys[js] == keys[i], axis=1) == band[i]]
        for j in js[np.argsort(-shared[js], kind="stable")].tolist():
            a, b = root(i), root(j)
            if a != b and ordered_similarity(words[i], words[j], threshold) >= threshold:
                parent[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, block: int = 640, block_words: int = 150_000) -> DataFrame:
    """``doc_id, class_id, kept, n_words`` for every row of ``docs``.

    ``class_id`` is the smallest id reachable by links; the document with that id is kept. Case and marks
    around words don't count. Texts of fewer than five words link with equal ones only; null, empty and
    wordless texts, and rows without an id, are classes of their own and kept. Texts are known by their content, so rows
    that share an id link by each of their texts. Very long texts are compared whole; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(word_hash)
        for batch in batches:
            e, n, keys = [], [], []
            for t in batch.column(1).to_pylist():
                w = words_of(t or "", cache)
                e.append(xxhash.xxh3_128_digest(w.tobytes()))
                n.append(len(w))
                keys.append(sketches(shingles(w)) if len(w) >= K else [])
            pair = np.frombuffer(b"".join(e), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "e1", "e2", "n_words", "keys"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    base = settle(source.mapInArrow(sketch, f"doc_id {kind}, e1 long, e2 long, n_words long, keys array<long>"))
    reps = base.where("n_words > 0 and doc_id is not null").groupBy("e1", "e2").agg(F.min("doc_id").alias("rep"), F.first("n_words").alias("n_words"), F.first("keys").alias("keys"))
    reps = settle(reps)
    keyed = reps.select("e1", "e2", "n_words", F.posexplode("keys").alias("band", "key"))
    full = keyed.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"), F.sum(F.xxhash64("e1", "e2").cast("decimal(38,0)")).alias("members")).where("n > 1")
    # buckets of the same members under several sketches are compared once
    full = full.groupBy("n", "words", "members").agg(F.min(F.struct("band", "key")).alias("at")).select("n", "words", "at.band", "at.key")
    met = keyed.join(full, ["band", "key"]).withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("words") / block_words)).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("e1", "e2"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = met.select("band", "key", "e1", "e2", "block", other).select("band", "key", "e1", "e2", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))

    wanted = met.select("e1", "e2").distinct().join(reps, ["e1", "e2"]).select("rep").distinct()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Cache(word_hash)
        for batch in batches:
            every = [words_of(t or "", cache) for t in batch.column(0).to_pylist()]
            pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w.tobytes()) for w in every), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array([w.astype(np.uint32).tobytes() for w in every], pa.binary())], names=["e1", "e2", "words"])

    # 32 bits a word: two words of a pair of texts agree by chance once in 2^32
    texts = source.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").select("text").mapInArrow(number, "e1 long, e2 long, words binary").dropDuplicates(["e1", "e2"])
    by = ["band", "key", "bi", "bj"]
    loaded = dealt.join(reps.select("e1", "e2", "rep", "keys").join(texts, ["e1", "e2"]), ["e1", "e2"]).repartition(shuffle_width(spark), *by).sortWithinPartitions(*by, "rep", "e1")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, by, 200):
            starts = np.append(group_starts(t, by), t.num_rows)
            rep = t.column("rep").to_pylist()
            band, block = (t.column(k).to_numpy() for k in ("band", "block"))
            split = t.column("bi").to_numpy() != t.column("bj").to_numpy()
            a, b = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                part = t.slice(s, e - s)
                words = [np.frombuffer(x, np.uint32).astype(np.uint64) for x in part.column("words").to_pylist()]
                keys = np.array(part.column("keys").to_pylist(), np.int64)
                for i, j in link_group(words, keys, band[s:e], block[s:e], bool(split[s]), threshold):
                    a.append(rep[s + i])
                    b.append(rep[s + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, t.schema.field("rep").type), pa.array(b, t.schema.field("rep").type)], names=["a", "b"])

    links = loaded.select(*by, "rep", "block", "keys", "words").mapInArrow(verify, f"a {kind}, b {kind}")
    classes = components(links)
    named = reps.select("e1", "e2", "rep").join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("e1", "e2", F.coalesce("component", "rep").alias("component"))
    alone = (F.col("n_words") == 0) | F.col("doc_id").isNull()
    out = base.where(~alone).join(named, ["e1", "e2"]).select("doc_id", "component", "n_words")
    out = out.union(base.where(alone).select("doc_id", F.col("doc_id").alias("component"), "n_words"))
    return out.select("doc_id", F.col("component").alias("class_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"), "n_words")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns, one document of each class: the one with the smallest id.

    Rows that share an id stay or go together (they stay if one of their texts does); null, empty and wordless texts and
    rows without an id stay.
    """
    found = near_duplicates(docs, doc_id, text, threshold).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates of all ``documents``; nulls, ties and repeated rows as in :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
