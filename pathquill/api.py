"""Reusable queries over typed tables: parse once, bind, run."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CollectionNotFoundError
from .functions import evaluator
from .functions.patch import apply_patch
from .lang.ast import KeyLookup, Pattern
from .lang.parser import parse
from .lang.printer import to_text
from .operators import mutate, query
from .operators.bind import bind, params_of
from .operators.explain import explain
from .plans import typed


class PathQuery:
    """A parsed query with the values bound to its placeholders; binding returns a new one."""

    def __init__(self, text: str, collection: str | None = None):
        self.text, self.tree = text, parse(text)
        self._collection = collection
        self.positional: tuple = ()
        self.named: dict[str, Any] = {}

    def bind(self, *positional, **named) -> PathQuery:
        out = PathQuery(self.text, self._collection)
        out.positional = (*self.positional, *positional)
        out.named = self.named | named
        return out

    def bind_regex(self, name: str | None, pattern: str) -> PathQuery:
        return self.bind(Pattern(pattern)) if name is None else self.bind(**{name: Pattern(pattern)})

    def reset(self) -> PathQuery:
        """Without bound values."""
        return PathQuery(self.text, self._collection)

    @property
    def bound(self):
        return bind(self.tree, self.positional, self.named)

    @property
    def collection(self) -> str | None:
        """The collection given, else the first that the text names."""
        return self._collection or self.tree.anchor

    first_anchor = property(lambda self: self.tree.anchor)
    has_apply = property(lambda self: self.tree.has_apply)
    has_upsert = property(lambda self: self.tree.upsert)
    has_delete = property(lambda self: self.tree.delete)
    has_projection = property(lambda self: bool(self.tree.projection) and not evaluator.Projector(self.tree).identity)
    has_order = property(lambda self: bool(self.tree.order))
    has_count = property(lambda self: self.tree.count)
    skip = property(lambda self: self.bound.skip or 0)
    limit = property(lambda self: self.bound.limit or 0)
    placeholders = property(lambda self: [p.name or p.index for p in params_of(self.tree)])

    def to_text(self) -> str:
        return to_text(self.tree)

    def matches(self, value, key=None) -> bool:
        """Whether one JSON value matches."""
        return evaluator.matches(self.bound, value, key)

    def apply_and_project(self, value, fetch=None):
        """One JSON value patched, then projected."""
        q = self.bound
        if q.has_apply:
            value = apply_patch(value, q.apply)
        return evaluator.Projector(q, fetch)(value)


class Tables:
    """Typed tables as collections: names, keys and columns of JSON text are declared, data stays where it is."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.collections: dict[str, query.Collection] = {}
        self.loaders: dict[str, Callable[[], query.Collection]] = {}

    def register_later(self, name: str, load: Callable[[], DataFrame], key: str | None = None, json: dict[str, str] | None = None) -> Tables:
        """As :meth:`register`, but the table is opened when a query first names it."""
        self.loaders[name] = lambda: query.Collection(load(), key, json or {})
        return self

    def register(self, name: str, df: DataFrame, key: str | None = None, json: dict[str, str] | None = None) -> Tables:
        self.collections[name] = query.Collection(df, key, json or {})
        return self

    def collection(self, name: str) -> query.Collection:
        if name in self.loaders and name not in self.collections:
            self.collections[name] = self.loaders[name]()
        if name not in self.collections:
            raise CollectionNotFoundError(f"no collection {name!r}")
        return self.collections[name]

    def _of(self, q: PathQuery | str, collection: str | None) -> tuple[PathQuery, query.Collection | None]:
        q = PathQuery(q) if isinstance(q, str) else q
        name = collection or q.collection or ""
        return q, self.collection(name) if name in self.collections or name in self.loaders else None

    def query(self, q: PathQuery | str, collection: str | None = None, skip: int | None = None, limit: int | None = None, unresolved: bool = False) -> DataFrame:
        """The result of a query; patches show in it but are not written. A missing collection is empty, not an error.

        With ``unresolved``, columns ``<field>__ref`` keep the values of references that find nothing.
        """
        q, c = self._of(q, collection)
        if c is None:
            return self.spark.range(0).select(F.lit(None).alias("none")).limit(0) if not q.has_count else self.spark.range(1).select(F.lit(0).cast("long").alias("count"))
        return query.select(c, q.bound, self.collection, skip, limit, unresolved)

    def changed(self, q: PathQuery | str, collection: str | None = None) -> DataFrame:
        """The collection as it is after the query's apply, upsert or del."""
        q, c = self._of(q, collection)
        if c is None:
            raise CollectionNotFoundError(f"no collection {collection or q.collection!r}")
        return mutate.changed(c, q.bound)

    def count(self, q: PathQuery | str, collection: str | None = None) -> int:
        df = self.query(q, collection)
        return df.first()["count"] if df.columns == ["count"] else df.count()

    def condition(self, q: PathQuery | str, collection: str | None = None) -> Column:
        """The filter alone, for use in any DataFrame or stream of the same schema."""
        q, c = self._of(q, collection)
        where = q.bound.where
        if isinstance(where, KeyLookup):
            return F.col(c.key) == where.key
        return typed.column_of(typed.where(where, c.rows.schema))

    def explain(self, q: PathQuery | str, indexes: list[dict] | None = None) -> str:
        q = PathQuery(q) if isinstance(q, str) else q
        return explain(q.bound, indexes or [])
