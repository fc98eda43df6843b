"""Queries over streams: a filter and projection without order, page or count keeps no state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..api import PathQuery, Tables
from ..errors import EngineError
from ..operators import query
from ..sources.shared import shared_folder


def over_stream(stream: DataFrame, tables: Tables, text: str | PathQuery) -> DataFrame:
    """The query's rows as a stream. Joins are with the registered tables as they are at each batch."""
    q = PathQuery(text) if isinstance(text, str) else text
    bound = q.bound
    if bound.order or bound.skip or bound.limit or bound.count or bound.has_apply or bound.delete:
        raise EngineError("a stream has no order, page, count or change")
    c = tables.collection(q.collection)
    return query.select(query.Collection(stream, c.key, c.json), bound, tables.collection)


def filtered(spark: SparkSession, tables: Tables, text: str, path: str) -> DataFrame:
    """All rows that a stream over Parquet files gives until it has caught up, by a Parquet sink in the shared folder."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if not is_folder(spark, path):
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    stream = over_stream(reader.parquet(path), tables, text)
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
