"""Projections over typed columns: which fields stay, rebuilt as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.evaluator import Projector, names_of, split_join, strip_joins
from ..lang.ast import Query


def hits(paths: list[tuple], name: str) -> list[tuple]:
    return [p[1:] for p in paths if any(n in (name, "*") for n in names_of(p[0]))]


def keep(c: Column, kind: T.DataType, paths: list[tuple]) -> Column | None:
    """``c`` with what the paths name; None if nothing is left."""
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind:
            below = hits(paths, f.name)
            deeper = [p for p in below if p]
            if below:
                at = keep(c.getField(f.name), f.dataType, deeper) if deeper else c.getField(f.name)
                if at is not None:
                    parts.append(at.alias(f.name))
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else None
    if isinstance(kind, T.ArrayType):
        whole = hits(paths, "*")
        if any(n == "*" for p in paths for n in names_of(p[0])):
            deeper = [p for p in whole if p]
            return F.transform(c, lambda e: keep(e, kind.elementType, deeper)) if deeper else c
        at = sorted({int(n) for p in paths for n in names_of(p[0]) if n.isdigit()})
        return F.filter(c, lambda e, i: i.isin(at)) if at else None
    return None


def drop(c: Column, kind: T.DataType, paths: list[tuple]) -> Column:
    """``c`` without what the paths name."""
    if isinstance(kind, T.StructType):
        parts = []
        for f in kind:
            below = hits(paths, f.name)
            if not any(not p for p in below):
                at = c.getField(f.name)
                parts.append((drop(at, f.dataType, below) if below else at).alias(f.name))
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else F.lit(None)
    if isinstance(kind, T.ArrayType):
        out = c
        below = [p[1:] for p in paths if any(n == "*" for n in names_of(p[0]))]
        if any(not p for p in below):
            return F.slice(c, 1, 0)
        if below:
            out = F.transform(out, lambda e: drop(e, kind.elementType, below))
        at = sorted({int(n) for p in paths if len(p) == 1 for n in names_of(p[0]) if n.isdigit()})
        return F.filter(out, lambda e, i: ~i.isin(at)) if at else out
    return c


def project(df: DataFrame, q: Query, always: list[str] | None = None) -> DataFrame:
    """The columns that the projection of ``q`` keeps, and those that stay ``always``; its joins are resolved before."""
    shape = Projector(q)
    if shape.nothing:
        return df.select()
    include, exclude = [strip_joins(p) for p in shape.include], [strip_joins(p) for p in shape.exclude]
    joined = {split_join(n)[0] for p in (*shape.include, *shape.exclude) for n in names_of(p[0]) if split_join(n)[1]}
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in (always or ()):
            out.append(c)
            continue
        below = hits(include, f.name)
        if not shape.whole and not below:
            continue
        deeper = [p for p in below if p]
        if not shape.whole and deeper:
            c = keep(c, f.dataType, deeper)
            if c is None:
                continue
        gone = hits(exclude, f.name)
        if any(not p for p in gone) and f.name not in joined:
            continue
        deeper_gone = [p for p in gone if p]
        if deeper_gone:
            kind = df.select(c.alias("c")).schema[0].dataType if not shape.whole else f.dataType
            c = drop(c, kind, deeper_gone)
        out.append(c.alias(f.name))
    return df.select(*out)
