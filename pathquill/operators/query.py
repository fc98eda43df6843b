"""Running a query over a DataFrame: filter, order, page, join, project, count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CollectionNotFoundError, NoPrimaryKeyError
from ..functions.evaluator import Projector, as_key, names_of, split_join
from ..lang.ast import KeyLookup, Query
from ..plans import typed
from ..plans.projection import project


@dataclass
class Collection:
    """A typed table: rows, the column that is its key (None: no key), and columns of JSON text by their schema."""

    df: DataFrame
    key: str | None = None
    json: dict[str, str] = field(default_factory=dict)

    @property
    def rows(self) -> DataFrame:
        out = self.df
        for name, schema in self.json.items():
            out = out.withColumn(name, F.from_json(name, schema))
        return out


Catalog = Callable[[str], Collection]


def matching(c: Collection, q: Query) -> DataFrame:
    """Rows that match, all columns. Keys of a list come in its order, as often as it names them."""
    df = c.rows
    if isinstance(q.where, KeyLookup):
        if not c.key:
            raise NoPrimaryKeyError("the collection has no key")
        many = isinstance(q.where.key, (list, tuple))
        keys = [k for k in map(as_key, q.where.key if many else [q.where.key]) if k is not None]
        if not many or len(keys) < 2:
            return df.where(F.col(c.key).isin(keys) if many else F.col(c.key) == keys[0]) if keys else df.where(F.lit(False))
        wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("_at"), F.lit(k).alias("_key")) for i, k in enumerate(keys))))
        wanted = df.sparkSession.range(1).select(wanted.alias("_k")).select("_k.*")  # the keys of the query's text
        found = df.where(F.col(c.key).isin(keys))
        return found.join(F.broadcast(wanted), F.col(c.key) == F.col("_key")).orderBy("_at").drop("_at", "_key")
    truth = typed.where(q.where, df.schema)
    return df if truth is True else df.where(typed.column_of(truth))


def order_column(schema: T.StructType, order):
    """A column for a JSON pointer; None if there is no such field, which orders nothing."""
    c, kind = None, schema
    for step in order.path:
        if isinstance(kind, T.StructType) and step.text in kind.names:
            c, kind = (F.col(f"`{step.text}`") if c is None else c.getField(step.text)), kind[step.text].dataType
        elif isinstance(kind, T.ArrayType) and step.text.isdigit():
            c, kind = F.get(c, F.lit(int(step.text))), kind.elementType
        elif isinstance(kind, T.MapType):
            c, kind = F.try_element_at(c, F.lit(step.text)), kind.valueType
        else:
            return None
    return c.desc_nulls_last() if order.descending else c.asc_nulls_first()


def paged(df: DataFrame, c: Collection, q: Query) -> DataFrame:
    """In order and cut to the page. Without order clauses, a page starts at the largest key, or the smallest if inverse.

    An order is only imposed where it can be seen.
    """
    columns = [x for x in (order_column(df.schema, o) for o in q.order) if x is not None]
    cut = bool(q.skip or q.limit)
    if not columns and cut and c.key and not isinstance(q.where, KeyLookup):
        columns = [F.col(c.key).asc() if q.inverse else F.col(c.key).desc()]
    if columns and not (q.count and not cut):
        df = df.orderBy(*columns)
    if q.skip:
        df = df.offset(q.skip)
    return df.limit(q.limit) if q.limit else df  # limit 0 is no limit


def references(q: Query, schema: T.StructType) -> list[tuple[tuple[str, ...], str]]:
    """(path of fields, collection) of each join step, at any depth of structs; ``*`` stands for every field there is.

    A path that the schema doesn't have, or that leads through an array or map, is left out.
    """
    out: dict[tuple[tuple[str, ...], str], None] = {}

    def walk(steps: tuple, kind: T.DataType, at: tuple[str, ...]) -> None:
        if not steps or not isinstance(kind, T.StructType):
            return
        for name in names_of(steps[0]):
            f, target = split_join(name)
            for field in kind:
                if f in (field.name, "*"):
                    if target:
                        out[(*at, field.name), target] = None
                    else:
                        walk(steps[1:], field.dataType, (*at, field.name))

    for p in q.projection:
        walk(p.path or (), schema, ())
    return list(out)


def field_at(path: tuple[str, ...]):
    c = F.col(f"`{path[0]}`")
    for name in path[1:]:
        c = c.getField(name)
    return c


def replaced(c, kind: T.DataType, path: tuple[str, ...], value):
    """``c`` with ``value`` at a path of struct fields."""
    if not path:
        return value
    parts = [(replaced(c.getField(f.name), f.dataType, path[1:], value) if f.name == path[0] else c.getField(f.name)).alias(f.name) for f in kind]
    return F.when(c.isNotNull(), F.struct(*parts))


def resolved(df: DataFrame, q: Query, catalog: Catalog, unresolved: bool = False) -> DataFrame:
    """Reference fields replaced by the rows they name: null where there is none.

    With ``unresolved``, a column named after the path and ``__ref`` keeps the old value of references that find nothing, as the
    field itself has changed its type. A missing collection or a field that isn't there leaves the column as it is, and
    values that can't be keys find nothing. Which side is broadcast is left to Spark, which knows the sizes.
    """
    schema = df.schema
    for path, target in references(q, schema):
        try:
            other = catalog(target)
        except CollectionNotFoundError:
            continue
        kind = next((f.dataType for f in df.schema if f.name == path[0]), None)
        at = kind
        for name in path[1:]:
            at = at[name].dataType if isinstance(at, T.StructType) and name in at.names else None
        if not other.key or at is None or isinstance(at, (T.StructType, T.ArrayType, T.MapType)):
            continue
        right = other.rows
        right = right.select(F.col(other.key).alias("_ref_key"), F.struct(*(F.col(f"`{n}`") for n in right.columns)).alias("_ref"))
        key = right.schema["_ref_key"].dataType
        old = field_at(path)
        left = old if at == key else old.try_cast(key)
        new = replaced(F.col(f"`{path[0]}`"), kind, path[1:], F.col("_ref"))
        columns = [new.alias(n) if n == path[0] else F.col(f"`{n}`") for n in df.columns]
        if unresolved:
            columns.append(F.when(F.col("_ref_key").isNull(), old).alias(f"{'/'.join(path)}__ref"))
        df = df.join(right, left == F.col("_ref_key"), "left").select(*columns)
    return df


def counted(df: DataFrame, q: Query) -> DataFrame:
    """The number of rows of the page: a page has no order to be imposed, and no rows to be moved."""
    n = F.count(F.lit(1))
    if q.skip:
        n = F.greatest(n - F.lit(q.skip), F.lit(0).cast("long"))
    return df.agg((F.least(n, F.lit(q.limit).cast("long")) if q.limit else n).alias("count"))


def select(c: Collection, q: Query, catalog: Catalog, skip: int | None = None, limit: int | None = None, unresolved: bool = False) -> DataFrame:
    """The result of a bound query; ``skip`` and ``limit`` go before the query's own.

    A query that applies a patch gives the rows that it reaches, chosen and ordered as they are before, with the patch
    applied, then projected; an upsert that reaches none gives the row that it would insert. Nothing is written.
    """
    from .mutate import inserted_row, patched

    if skip is not None or limit is not None:
        q = replace(q, skip=q.skip if skip is None else skip, limit=q.limit if limit is None else limit)
    if q.count and not q.upsert:
        return counted(matching(c, q), q)
    df = paged(matching(c, q), c, q)
    if q.has_apply:
        df = inserted_row(c, q.apply) if q.upsert and df.isEmpty() else patched(df, q.apply, F.lit(True))
    if q.count:
        return df.agg(F.count(F.lit(1)).alias("count"))
    if not q.projection or Projector(q).identity and not references(q, df.schema):
        return df
    if not references(q, df.schema):
        return project(df, q)
    # a join moves rows: their places are kept where the query orders them
    extra = resolved(df.withColumn("_at", F.monotonically_increasing_id()) if q.order else df, q, catalog, unresolved)
    if q.order:
        extra = extra.orderBy("_at").drop("_at")
    return project(extra, q, [n for n in extra.columns if n not in df.columns])
