"""Near-duplicate vectors by randomised-rotation binary codes.

Each unit vector is turned by seeded random rotations and kept as its sign bits, with the stored
correction factor <o, code> that makes ``<code, q> / <o, code>`` an unbiased estimate of <o, q>.
The query side is rounded at random to a few bits a coordinate, so estimates are popcounts. The
estimate's deviation shrinks with the number of bits; a pair whose upper confidence bound stays
below the threshold is dropped, every other pair is recomputed exactly in double precision.

Bits of the same codes key the candidate tables. Their number follows from the wanted recall at the
threshold, their width from the number of rows, so that tables keep a few rows a bucket at any size.
A bucket of more than ``block`` vectors is dealt out as pairs of blocks to many tasks. Equal vectors
are collapsed first and only weigh. A pair that meets in several tables counts in the first.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, group_starts, settle, shuffle_width, table, whole_groups

QUERY_BITS = 4


def plan_tables(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits a table, tables): about eight rows a bucket at ``rows``, and the wanted recall at the threshold."""
    bits = max(8, math.ceil(math.log2(max(rows, 2))) - 3)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


@functools.lru_cache(4)
def rotations(dim: int, count: int) -> np.ndarray:
    """(count, width, dim): rows of seeded orthogonal matrices; width is dim rounded up to whole words."""
    width = -(-dim // 64) * 64
    rng = np.random.default_rng(dim)
    return np.stack([np.linalg.qr(rng.standard_normal((width, width)))[0][:, :dim] for _ in range(count)])


@functools.lru_cache(4)
def table_bits(pool: int, tables: int, bits: int) -> np.ndarray:
    """Which code bits key each table: seeded permutations of the pool, dealt out in turn."""
    rng = np.random.default_rng(pool)
    order = np.concatenate([rng.permutation(pool) for _ in range(-(-tables * bits // pool))])
    return order[: tables * bits].reshape(tables, bits)


def pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=-1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, tables: int, bits: int) -> dict[str, np.ndarray]:
    """Codes of unit vectors (rows of ``x``): sign bits, correction factor, bit planes of the rounded query, table keys."""
    n, dim = x.shape
    width = -(-dim // 64) * 64
    count = max(4, -(-tables * bits // width))
    turned = np.einsum("rwd,nd->nrw", rotations(dim, count), x).reshape(n, count * width)
    signs = turned > 0
    total = count * width
    # unit code vector: signs / sqrt(total); the turned vector has norm sqrt(count)
    factor = np.abs(turned).sum(1) / math.sqrt(total) / math.sqrt(count)
    low, high = turned.min(1, keepdims=True), turned.max(1, keepdims=True)
    step = np.maximum(high - low, 1e-12) / (2**QUERY_BITS - 1)
    dither = np.random.default_rng(total).random((1, total))
    q = np.clip(np.floor((turned - low) / step + dither), 0, 2**QUERY_BITS - 1).astype(np.uint8)
    planes = np.stack([pack(q >> j & 1) for j in range(QUERY_BITS)], axis=1)
    keys = signs[:, table_bits(total, tables, bits)] @ (1 << np.arange(bits, dtype=np.int64))
    return {"code": pack(signs), "factor": factor, "planes": planes, "low": low[:, 0], "step": step[:, 0], "q_sum": q.sum(1, dtype=np.int64), "keys": keys, "total": total, "count": count}


def estimate(c: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Unbiased estimates of <x_i, x_j>: code of i against the rounded j, by popcounts alone."""
    ones = np.bitwise_count(c["code"][i]).sum(1, dtype=np.int64)
    hit = np.zeros(len(i))
    for p in range(QUERY_BITS):
        hit += (1 << p) * np.bitwise_count(c["code"][i] & c["planes"][j, p]).sum(1, dtype=np.int64)
    # sum over bits of sign * (low + step * q)
    dot = c["low"][j] * (2 * ones - c["total"]) + c["step"][j] * (2 * hit - c["q_sum"][j])
    return dot / math.sqrt(c["total"]) / math.sqrt(c["count"]) / c["factor"][i]


def bound(c: dict, i: np.ndarray, confidence: float) -> np.ndarray:
    """Half width of the estimate's confidence interval: ``confidence`` deviations of code and rounding."""
    f = c["factor"][i]
    code = np.sqrt(np.maximum(1 - f * f, 0)) / f / math.sqrt(max(c["total"] - 1, 1))
    rounding = c["step"][i] / 2 / math.sqrt(c["count"]) / f
    return confidence * np.sqrt(code**2 + rounding**2)


def unit_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str, label: str):
    """Rows that can link: labelled, and every component finite and not all of them zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.col(label).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda e: e != 0)


def near_vectors(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = 0.93,
    recall: float = 0.995,
    confidence: float = 4.0,
    block: int = 1024,
) -> DataFrame:
    """Links and components of vectors with equal labels and cosine >= ``threshold``.

    Returns ``vec_id, n_links, component_id, kept`` for every distinct (id, label, vector). Null labels and
    null, zero, empty or non-finite vectors link with nothing and are kept; vectors of different
    length never link. A repeated row counts once. A null id is never linked and its component is null.
    ``recall`` is the chance that a pair exactly at the threshold becomes a candidate; nearer pairs
    have a higher one. Candidates are all examined, whatever the size of a bucket.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).distinct()
    fit = rows.where(usable("vector", "label") & F.col("vec_id").isNotNull())
    reps = settle(fit.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("weight")))
    bits, tables = plan_tables(reps.count(), threshold, recall)
    # labels become numbers, so that keys of any label type sort as integers
    reps = reps.withColumn("space", F.xxhash64("label", F.size("vector")))

    def to_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy()) if batch.num_rows else np.empty(0, int)
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == size))
                part = batch.take(at)
                keys = encode(unit_rows(part.column(2)), tables, bits)["keys"]
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(part.column(0).to_numpy(), tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(1).to_numpy(), tables))],
                    names=["space", "tab", "key", "rep"],
                )

    keyed = reps.select("space", "rep", "vector").mapInArrow(to_keys, "space long, tab int, key long, rep long")
    keyed = settle(keyed)
    full = keyed.groupBy("space", "tab", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = keyed.join(full, ["space", "tab", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # a bucket of several blocks: each row goes to every pair of blocks that its own is part of
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = met.select("space", "tab", "key", "rep", "block", other).select("*", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    dealt = dealt.drop("other").join(reps.select("space", "rep", "vector", "weight"), ["space", "rep"])
    by = ["space", "tab", "key", "bi", "bj"]
    width = shuffle_width(spark)
    dealt = dealt.repartition(width, *by).sortWithinPartitions(*by, "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, by, 8_000):
            sizes = np.diff(t.column("vector").combine_chunks().offsets.to_numpy())
            for size in np.unique(sizes):
                part = t if (sizes == size).all() else t.take(pa.array(np.flatnonzero(sizes == size)))
                yield from links_of(part, by, tables, bits, threshold, confidence)

    # one row for each vector and bucket: how much it linked there, and one edge to its bucket's forest
    found = settle(dealt.select(*by, "rep", "block", "weight", "vector").mapInArrow(compare, "rep long, links long, root long"))
    weights = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("root != rep").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = reps.select("label", "vector", "rep", "weight").join(weights, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = fit.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(usable("vector", "label") & F.col("vec_id").isNotNull(), F.lit(False)))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def links_of(t: pa.Table, by: list[str], tables: int, bits: int, threshold: float, confidence: float) -> Iterator[pa.RecordBatch]:
    """Links inside each group of ``t`` (rows sorted by group), as weights and a spanning forest.

    Row i meets row i + d of its group for d = 1, 2, ...: every step is one vectorised pass, and only
    counts and a parent for each row are kept, never the pairs.
    """
    x = unit_rows(t.column("vector"))
    c = encode(x, tables, bits)
    starts = group_starts(t, by)
    sizes = np.diff(np.append(starts, len(x)))
    left = np.repeat(starts + sizes, sizes) - np.arange(len(x))  # rows from here to the group's end
    tab, block, weight, rep = (t.column(k).to_numpy() for k in ("tab", "block", "weight", "rep"))
    split = t.column("bi").to_numpy() != t.column("bj").to_numpy()
    links, parent = np.zeros(len(x), np.int64), np.arange(len(x))
    for d in range(1, int(sizes.max(initial=1))):
        i = np.flatnonzero(left > d)
        j = i + d
        ok = ~split[i] | (block[i] != block[j])  # two blocks: only pairs across them
        i, j = i[ok], j[ok]
        ok = np.minimum(estimate(c, i, j) + bound(c, i, confidence) + bound(c, j, confidence), 2) >= threshold
        i, j = i[ok], j[ok]
        # what is left to recompute is recomputed in the first table of the pair alone
        ok = np.argmax(c["keys"][i] == c["keys"][j], axis=1) == tab[i] if len(i) else ok[:0]
        i, j = i[ok], j[ok]
        ok = np.einsum("nd,nd->n", x[i], x[j]) >= threshold
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        join_roots(parent, i, j)
    seen = links > 0
    root = parent.copy()
    while (up := root[root] != root).any():
        root[up] = root[root[up]]
    yield pa.RecordBatch.from_arrays([pa.array(rep[seen]), pa.array(links[seen]), pa.array(rep[root[seen]])], names=["rep", "links", "root"])


def join_roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the sets of each i and j (union by smaller root, path halving)."""
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all ``embeddings``; nulls, ties, repeated rows and an empty table as in :func:`near_vectors`."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
