"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark so that any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the session runs on one machine a
    temporary folder takes its place. The session's cleaner deletes the files when nothing refers to them any more.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for tables between steps."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="pathquill-checkpoint-"))
    return sc.getCheckpointDir()


def drop_table(spark: SparkSession, place: str) -> None:
    """Deletes a table between steps that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession, rows: int | None = None, rows_per_task: int = 50_000) -> int:
    """Partitions for a shuffle of ``rows`` rows: the session's width at least."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(width, -(-rows // rows_per_task)) if rows else width


def crc_mod(column: str, m: int):
    """crc32 of the column as text, modulo ``m``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m


def crc_mod_py(value: object, m: int) -> int:
    return zlib.crc32(str(value).encode()) % m


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null reads as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of at least ``rows`` rows that end where a group ends.

    The input is sorted by ``keys``; only the open group is carried over, so memory follows the
    largest group, which callers bound by splitting.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cut = int(group_starts(table, keys)[-1])
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
        else:
            held = table.to_batches()
        count = sum(b.num_rows for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which a new value of ``keys`` (integers without nulls) begins."""
    new = np.zeros(table.num_rows, bool)
    if len(new):
        new[0] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an edge table as ``(node, component)``, the smallest node of each.

    Alternating large-star and small-star rounds. Every step is a grouped minimum and an equi-join,
    so no neighbourhood is gathered in one task and nothing goes to the driver but two numbers a
    round. Nodes without edges are absent. Each round is cut by a checkpoint.
    """
    e = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    before = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(small.union(down.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


#: Arrow's name for the column types that :func:`map_texts` fills from lists.
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def map_texts(df: DataFrame, doc_id: str, text: str, columns: str, make, extra: list[str] | None = None, read=None) -> DataFrame:
    """One output row for each document: ``doc_id`` and ``columns``, from ``make()(texts)``.

    ``make`` runs once in each Python worker task and returns a function from a list of texts (null:
    empty) to a list of columns. Only the needed columns leave the JVM, so others never clash.
    ``extra`` columns go along and are given to the function as further lists. ``read`` makes texts of the column where
    it isn't text.
    """
    extra = extra or []
    kind = df.schema[doc_id].dataType.simpleString()
    out = f"doc_id {kind}, {columns}"
    fields = [part.strip().split(" ") for part in out.split(", ")]
    names = [name for name, _ in fields]
    kinds = [ARROW.get(k) for _, k in fields[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                made = f([x or "" for x in (read(part.column(1)) if read else part.column(1).to_pylist())], *(part.column(2 + i).to_pylist() for i in range(len(extra))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=names)

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *extra).mapInArrow(run, out)
