"""Queries over schemaless documents: rows of ``id`` and ``doc``, a document as JSON text.

Filters that name their paths compile to VARIANT expressions, dispatched on the kind of value
found; wildcards, arrays, patches and projections go through the evaluator, document by document
in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import PatchError
from ..functions.evaluator import Projector, as_key, matches, split_join
from ..functions.patch import apply_patch
from ..lang.ast import Fields, KeyLookup, Query
from ..plans import variant
from ..sources.shared import settle


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def load(text: str | None):
    return None if text is None else json.loads(text)


def mapped(docs: DataFrame, change, *extra: str) -> DataFrame:
    """``docs`` with each document through ``change(id, value, *extra)``; None drops the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            columns = [c.to_pylist() for c in batch.columns]
            for i, text, *rest in zip(*columns, strict=True):
                made = change(i, load(text), *rest)
                if made is not None:
                    ids.append(i)
                    out.append(dump(made[0]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "doc"])

    return docs.select(F.col("id").cast("long").alias("id"), "doc", *extra).mapInArrow(run, "id long, doc string")


def matching(docs: DataFrame, q: Query) -> DataFrame:
    """The documents that match. Keys of a list come in its order, as often as it names them."""
    if isinstance(q.where, KeyLookup):
        many = isinstance(q.where.key, (list, tuple))
        keys = [k for k in map(as_key, q.where.key if many else [q.where.key]) if k is not None]
        found = docs.where(F.col("id").isin(keys))
        if len(keys) < 2:
            return found
        wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("_at"), F.lit(k).alias("_key")) for i, k in enumerate(keys))))
        wanted = docs.sparkSession.range(1).select(wanted.alias("_k")).select("_k.*")  # the keys of the query's text
        return found.join(F.broadcast(wanted), F.col("id") == F.col("_key")).orderBy("_at").select("id", "doc")
    if variant.where(q.where, F.lit(None).cast("variant")) is not None:
        # the array of one is where the text is parsed once for all comparisons
        return docs.where(F.exists(F.array(F.try_parse_json("doc")), lambda value: variant.where(q.where, value)))
    return mapped(docs, lambda i, value: (value,) if matches(q, value) else None)


def ordered(docs: DataFrame, q: Query) -> DataFrame:
    """In order and cut to the page: missing, null, booleans, numbers, texts, containers. By default newest first."""
    if q.order and not q.count:
        value = F.try_parse_json("doc")
        columns = []
        for o in q.order:
            key = variant.order_key(value, o)
            columns.append(key.desc() if o.descending else key.asc())
        docs = docs.orderBy(*columns)
    elif (q.skip or q.limit) and not isinstance(q.where, KeyLookup):
        docs = docs.orderBy(F.col("id").asc() if q.inverse else F.col("id").desc())
    if q.skip:
        docs = docs.offset(q.skip)
    return docs.limit(q.limit) if q.limit else docs


def query_documents(docs: DataFrame, q: Query, resolve=None) -> DataFrame:
    """The result of a bound query: ``id, doc``, or ``count``. Patches apply before the projection.

    ``resolve(name)`` gives a referenced collection's ``id, doc`` rows, or None.
    """
    found = ordered(matching(docs, q), q)
    if q.count:
        return found.agg(F.count(F.lit(1)).alias("count"))
    if q.has_apply and not q.upsert:
        found = mapped(found, lambda i, value: (apply_patch(value, q.apply),))
    return projected(found, q, resolve)


def join_steps(q: Query) -> list[tuple[tuple, str]]:
    """(path of names to the referencing field, collection) of each join."""
    out = []
    for p in q.projection:
        at: tuple = ()
        for s in p.path or ():
            for name in s.names if isinstance(s, Fields) else (s,):
                field, target = split_join(name.text)
                if target:
                    out.append(((*at, field), target))
            at = (*at, split_join(s.text)[0]) if not isinstance(s, Fields) else (*at, "*")
    return list(dict.fromkeys(out))


def projected(found: DataFrame, q: Query, resolve=None) -> DataFrame:
    if not q.projection:
        return found
    joins = join_steps(q) if resolve else []
    fetched, many = [], []
    if q.order and joins:
        found = found.withColumn("_at", F.monotonically_increasing_id())  # a join moves rows: their places are kept
    for k, (path, target) in enumerate(joins):
        other = resolve(target)
        if other is None:
            continue
        if "*" in path:
            many.append((path, target, other))
            continue
        key = F.try_variant_get(F.try_parse_json("doc"), variant.json_path(path), "long")
        right = other.select(F.col("id").alias(f"_id{k}"), F.col("doc").alias(f"_doc{k}"))
        found = found.withColumn(f"_key{k}", key).join(right, F.col(f"_key{k}") == F.col(f"_id{k}"), "left").drop(f"_id{k}")
        fetched.append((target, f"_key{k}", f"_doc{k}"))

    behind = bool(many)
    if behind:
        found = with_references(found, many)
    if "_at" in found.columns:
        found = found.orderBy("_at")

    def change(i, value, *rest):
        known = {(t, rest[2 * n]): load(rest[2 * n + 1]) for n, (t, _, _) in enumerate(fetched)}
        if behind:
            known |= {(r["target"], r["key"]): load(r["found"]) for r in rest[-1] or ()}
        return (Projector(q, lambda c, k: known.get((c, k)))(value),)

    if Projector(q).identity and not fetched and not behind:
        return found
    return mapped(found, change, *(c for _, k, d in fetched for c in (k, d)), *["_refs"] * behind)


def values_at(value, path: tuple):
    """What a path of names and wildcards finds in a JSON value."""
    if not path:
        yield value
    elif isinstance(value, (dict, list)):
        inner = value.items() if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value))
        for k, v in inner:
            if path[0] in ("*", k):
                yield from values_at(v, path[1:])


def with_references(found: DataFrame, many: list[tuple]) -> DataFrame:
    """``found`` and ``_refs``: the documents that references behind wildcards name, as many a row as it has references.

    The keys of each document are listed, joined with their collections, and brought together by the row's number.
    """
    paths = [(path, target) for path, target, _ in many]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                value = load(text)
                pairs = {(t, k) for p, t in paths for k in map(as_key, values_at(value, p)) if k is not None}
                out.append([{"target": t, "key": k} for t, k in sorted(pairs)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("target", pa.string()), ("key", pa.int64())])))], names=["_row", "_wanted"])

    numbered = settle(found.withColumn("_row", F.monotonically_increasing_id()))
    wanted = numbered.select("_row", "doc").mapInArrow(keys, "_row long, _wanted array<struct<target:string,key:long>>").select("_row", F.explode("_wanted").alias("w")).select("_row", "w.*")
    got = None
    for target, other in {t: o for _, t, o in many}.items():
        right = other.select(F.col("id").alias("key"), F.col("doc").alias("found"))
        part = wanted.where(F.col("target") == target).join(right, "key").select("_row", F.struct("target", "key", "found").alias("ref"))
        got = part if got is None else got.union(part)
    return numbered.join(got.groupBy("_row").agg(F.collect_list("ref").alias("_refs")), "_row", "left")


def changed_documents(docs: DataFrame, q: Query) -> tuple[DataFrame, DataFrame]:
    """(the collection after the change, the documents that it reached).

    An upsert that matches nothing inserts its object with the next id.
    """
    hit = ordered(matching(docs, q), q)
    rest = docs.join(hit.select("id"), "id", "left_anti")
    if q.delete:
        return rest, hit
    if q.upsert and hit.isEmpty():
        if not isinstance(q.apply, dict):
            raise PatchError("only an object can be inserted")
        new = docs.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("id")).select("id", F.lit(dump(q.apply)).alias("doc"))
        return docs.union(new), new
    done = mapped(hit, lambda i, value: (apply_patch(value, q.apply),))
    return rest.union(done), done

