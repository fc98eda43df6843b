"""Changes as functions: the collection before, the collection after."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NoPrimaryKeyError, PatchError
from ..functions.patch import pointer
from ..lang.ast import Query
from ..plans import typed
from .query import Collection, matching, paged


def literal(value, kind: T.DataType) -> Column:
    if isinstance(value, dict) and isinstance(kind, T.StructType):
        return F.struct(*(literal(value.get(f.name), f.dataType).alias(f.name) for f in kind))
    if isinstance(value, list) and isinstance(kind, T.ArrayType):
        return F.array(*(literal(x, kind.elementType) for x in value)).cast(kind)
    if isinstance(value, (dict, list)):
        raise PatchError(f"{value!r} does not fit a column of type {kind.simpleString()}")
    return F.lit(value).cast(kind)


def merged(c: Column, kind: T.DataType, patch) -> Column:
    """A merge patch on a column: objects merge into structs, null clears, anything else replaces."""
    if isinstance(patch, dict) and isinstance(kind, T.StructType):
        unknown = set(patch) - set(kind.names)
        if unknown:
            raise PatchError(f"no field {min(unknown)!r}")
        return F.struct(*((merged(c.getField(f.name), f.dataType, patch[f.name]) if f.name in patch else c.getField(f.name)).alias(f.name) for f in kind))
    return literal(patch, kind)


def at_path(c: Column, kind: T.DataType, parts: list[str], change, create: bool = False) -> Column:
    """``c`` with ``change(column, type)`` at a path of struct fields and array elements; a null struct is made where ``create`` says so."""
    if not parts:
        return change(c, kind)
    if isinstance(kind, T.ArrayType) and parts[0].isdigit():
        at = int(parts[0])
        return F.transform(c, lambda e, i: F.when(i == at, at_path(e, kind.elementType, parts[1:], change, create)).otherwise(e))
    if not isinstance(kind, T.StructType) or parts[0] not in kind.names:
        raise PatchError(f"no field {parts[0]!r}")
    made = F.struct(*((at_path(c.getField(f.name), f.dataType, parts[1:], change, create) if f.name == parts[0] else c.getField(f.name)).alias(f.name) for f in kind))
    return made if create else F.when(c.isNotNull(), made)


def found_at(columns: dict[str, Column], schema: T.StructType, path: str) -> tuple[Column, T.DataType]:
    """The column and type at a pointer through struct fields and array elements."""
    parts = pointer(path)
    if not parts or parts[0] not in schema.names:
        raise PatchError(f"no field {path!r}")
    c, kind = columns[parts[0]], schema[parts[0]].dataType
    for p in parts[1:]:
        if isinstance(kind, T.StructType) and p in kind.names:
            c, kind = c.getField(p), kind[p].dataType
        elif isinstance(kind, T.ArrayType) and p.isdigit():
            c, kind = F.get(c, F.lit(int(p))), kind.elementType
        else:
            raise PatchError(f"no field {path!r}")
    return c, kind


def operated(columns: dict[str, Column], schema: T.StructType, op: dict) -> None:
    """One JSON patch operation on typed columns, whose types stay.

    A removed field is null. What moves, is copied or swapped between fields of different types is cast and null where
    that fails; a test that fails on a row fails the query.
    """
    kind, parts = op.get("op"), pointer(op.get("path", ""))
    if not parts or parts[0] not in schema.names:
        raise PatchError(f"no field {op.get('path')!r}")
    if kind in ("move", "copy", "swap"):
        value, t = found_at(columns, schema, op.get("from", ""))
        other, u = found_at(columns, schema, op.get("path", ""))
        if isinstance(t, (T.StructType, T.ArrayType, T.MapType)) and t != u:
            raise PatchError(f"{op.get('from')!r} and {op.get('path')!r} have different types")
        origin = op.get("from")
        if kind == "move" and origin != op["path"]:
            operated(columns, schema, {"op": "remove", "path": origin})
        elif kind == "swap":
            put_at(columns, schema, pointer(origin), other if t == u else other.try_cast(t))
        put_at(columns, schema, parts, value if t == u else value.try_cast(u))
        return
    if kind == "test":
        c, t = found_at(columns, schema, op["path"])
        same = c.isNull() if op.get("value") is None else F.coalesce(c == literal(op["value"], t), F.lit(False))
        columns[parts[0]] = F.when(same, columns[parts[0]]).otherwise(F.raise_error(F.lit(f"test failed at {op['path']}")).cast(schema[parts[0]].dataType))
        return

    def change(c: Column, t: T.DataType) -> Column:
        if kind in ("add", "replace", "add_create"):
            return literal(op.get("value"), t)
        if kind == "remove":
            return F.lit(None).cast(t)
        if kind == "increment":
            return (c + F.lit(op.get("value"))).cast(t)
        raise PatchError(f"operation {kind!r} would change the schema of a typed table")

    name = parts[0]
    columns[name] = at_path(columns[name], schema[name].dataType, parts[1:], change, create=kind == "add_create")


def put_at(columns: dict[str, Column], schema: T.StructType, parts: list[str], value: Column) -> None:
    name = parts[0]
    columns[name] = at_path(columns[name], schema[name].dataType, parts[1:], lambda c, t: value)


def patched(df: DataFrame, patch, hit: Column) -> DataFrame:
    """All rows, with ``patch`` applied to those that ``hit``."""
    schema = df.schema
    columns = {n: F.col(f"`{n}`") for n in schema.names}
    if isinstance(patch, dict):
        for name, value in patch.items():
            if name not in columns:
                raise PatchError(f"no field {name!r}")
            columns[name] = merged(columns[name], schema[name].dataType, value)
    elif isinstance(patch, (list, tuple)):
        for op in patch:
            operated(columns, schema, op)
    else:
        raise PatchError("a patch is an object or an array")
    return df.select(*(F.when(hit, columns[n]).otherwise(F.col(f"`{n}`")).alias(n) for n in schema.names))


def is_paged(q: Query) -> bool:
    return bool(q.skip or q.limit)


def hit_column(c: Collection, q: Query) -> Column:
    """Which rows a change reaches, as a condition; only for queries without a page."""
    from ..functions.evaluator import as_key
    from ..lang.ast import KeyLookup

    if isinstance(q.where, KeyLookup):
        if not c.key:
            raise NoPrimaryKeyError("the collection has no key")
        keys = q.where.key if isinstance(q.where.key, (list, tuple)) else [q.where.key]
        return F.coalesce(F.col(c.key).isin([k for k in map(as_key, keys) if k is not None]), F.lit(False))
    return F.coalesce(typed.column_of(typed.where(q.where, c.rows.schema)), F.lit(False))


def changed(c: Collection, q: Query) -> DataFrame:
    """The collection after the query's apply, upsert or del.

    A page limits the change to its rows, which are then named by key. An upsert that matches nothing
    inserts its object, with the next key where it has none.
    """
    if is_paged(q):
        if not c.key:
            raise NoPrimaryKeyError("a change of a page needs a key")
        chosen = paged(matching(c, q), c, q).select(F.col(c.key).alias("_hit"))
        if q.delete:
            return c.rows.join(chosen, F.col(c.key) == F.col("_hit"), "left_anti")
        marked = c.rows.join(chosen, F.col(c.key) == F.col("_hit"), "left")
        return patched(marked, q.apply, F.col("_hit").isNotNull()).drop("_hit")
    hit = hit_column(c, q)
    if q.delete:
        return c.rows.where(~hit)
    if q.upsert and c.rows.where(hit).isEmpty():
        return inserted(c, q.apply)
    return patched(c.rows, q.apply, hit)


def inserted_row(c: Collection, value: dict) -> DataFrame:
    """The row that an upsert inserts, with the next key where it has none."""
    if not isinstance(value, dict):
        raise PatchError("only an object can be inserted")
    schema = c.rows.schema
    unknown = set(value) - set(schema.names)
    if unknown:
        raise PatchError(f"no field {min(unknown)!r}")
    row = c.df.sparkSession.range(1)
    if c.key and value.get(c.key) is None:
        row = c.rows.agg((F.coalesce(F.max(c.key), F.lit(0)) + 1).alias("_next"))
    columns = [F.col("_next").cast(f.dataType).alias(f.name) if f.name == c.key and value.get(f.name) is None else literal(value.get(f.name), f.dataType).alias(f.name) for f in schema]
    return row.select(*columns)


def inserted(c: Collection, value: dict) -> DataFrame:
    """The collection and one more row."""
    return reduce(DataFrame.unionByName, [c.rows, inserted_row(c, value)])
