"""Queries over typed columns: syntax tree and schema to Catalyst expressions.

Paths are resolved against the schema while compiling: names become fields, wildcards an OR over the
fields or a higher-order function over arrays and maps. Where the literal's type agrees with the
column's, the comparison is left bare, so that it is pushed into the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coercion import holds, is_number, leading_float, leading_integer, number_text, scalar_text
from ..functions.evaluator import matches_all, plain
from ..lang.ast import DeepStar, Group, Joined, KeyTest, Name, Predicate, Star, Test

#: A condition: a Column, or True or False where it is known while compiling.
Truth = Column | bool
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTION = (T.FloatType, T.DoubleType, T.DecimalType)


def all_of(a: Truth, b: Truth) -> Truth:
    if a is False or b is False:
        return False
    return b if a is True else a if b is True else a & b


def any_of(a: Truth, b: Truth) -> Truth:
    if a is True or b is True:
        return True
    return b if a is False else a if b is False else a | b


def negate(a: Truth) -> Truth:
    return (not a) if isinstance(a, bool) else ~F.coalesce(a, F.lit(False))


def column_of(a: Truth) -> Column:
    return F.lit(a) if isinstance(a, bool) else a


def fold(chain: tuple[Joined, ...], truth: Callable[[Any], Truth]) -> Truth:
    """Operands from left to right: an 'or' that holds decides, one that fails leaves False to what follows."""
    decided: Truth = False
    value: Truth = False
    for j in chain:
        x = negate(truth(j.item)) if j.negated else truth(j.item)
        if j.join is None:
            value = x
        elif j.join == "and":
            value = all_of(value, x)
        else:
            decided, value = any_of(decided, any_of(value, x)), False
    return any_of(decided, value)


# comparisons of one value with a literal; the value is taken to be there


def ordered(c: Column, op: str, value) -> Column:
    return {"=": c == value, ">": c > value, ">=": c >= value, "<": c < value, "<=": c <= value}[op]


def by_sign(known: int, op: str) -> bool:
    return {"=": known == 0, ">": known > 0, ">=": known >= 0, "<": known < 0, "<=": known <= 0}[op]


def compare_text(c: Column, op: str, r) -> Truth:
    if r is None:
        return True if op == ">=" else False if op == "<" else c != "" if op == ">" else c == ""
    if isinstance(r, bool):
        return ordered((c == "true").cast("int"), op, int(r))
    if is_number(r):
        return ordered(c, op, number_text(r))
    if op == "=":
        return c == r
    size, n = F.octet_length(c), len(r.encode())
    longer = size > n if op in (">", ">=") else size < n
    return longer | ((size == n) & ordered(c, op, r))


def compare_number(c: Column, kind: T.DataType, op: str, r) -> Truth:
    if r is None:
        return by_sign(1, op)
    whole = isinstance(kind, NUMERIC)
    if isinstance(r, bool):
        return ordered((c != 0).cast("int"), op, int(r)) if whole else ordered(c, op, float(r))
    if isinstance(r, str):
        r = leading_integer(r) if whole else leading_float(r)
    if isinstance(kind, T.FloatType) or (whole and isinstance(r, float)):
        c = c.cast("double")
    return ordered(c, op, r)


def compare_bool(c: Column, op: str, r) -> Truth:
    if isinstance(r, str) and r not in ("true", "false"):
        return by_sign(-1, op)
    r = r == "true" if isinstance(r, str) else bool(r)
    return c == r if op == "=" else ordered(c.cast("int"), op, int(r))


def compare_typed(c: Column, kind: T.DataType, op: str, r) -> Truth:
    if isinstance(r, (list, dict)):
        return compare_container(c, kind, op, r)
    if isinstance(kind, T.StringType):
        return compare_text(c, op, r)
    if isinstance(kind, NUMERIC + FRACTION):
        return compare_number(c, kind, op, r)
    if isinstance(kind, T.BooleanType):
        return compare_bool(c, op, r)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) and isinstance(r, str):
        return ordered(c, op, F.lit(r).try_cast(kind))  # a text that is no time compares with none
    return False


def compare_container(c: Column, kind: T.DataType, op: str, r) -> Truth:
    """Arrays by elements, structs and maps by entries; equality only, for what has an order of its own."""
    if op != "=":
        return False
    if isinstance(kind, T.ArrayType) and isinstance(r, list):
        out: Truth = F.size(c) == len(r)
        for i, x in enumerate(r):
            out = all_of(out, present(F.get(c, F.lit(i)), compare_same(F.get(c, F.lit(i)), kind.elementType, x), x))
        return out
    if isinstance(kind, T.StructType) and isinstance(r, dict):
        if not set(r) <= set(kind.names):
            return False
        out = True
        for f in kind:
            at = c.getField(f.name)
            out = all_of(out, present(at, compare_same(at, f.dataType, r[f.name]), r[f.name]) if f.name in r else at.isNull())
        return out
    if isinstance(kind, T.MapType) and isinstance(r, dict):
        out = F.size(c) == len(r)
        for k, x in r.items():
            out = all_of(out, compare_same(F.try_element_at(c, F.lit(k)), kind.valueType, x))
        return out
    return False


def present(at: Column, truth: Truth, literal) -> Truth:
    return at.isNull() if literal is None else truth


def compare_same(c: Column, kind: T.DataType, r) -> Truth:
    """Equality of like kinds inside containers: there, nothing is coerced."""
    like = isinstance(kind, T.StringType) if isinstance(r, str) else isinstance(kind, T.BooleanType) if isinstance(r, bool) else isinstance(kind, NUMERIC + FRACTION) if is_number(r) else True
    return compare_typed(c, kind, "=", r) if like else False


def text_of(c: Column, kind: T.DataType) -> Column | None:
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, FRACTION):
        d = c.cast("double")
        return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("long").cast("string")).otherwise(d.cast("string"))
    return c.cast("string") if isinstance(kind, NUMERIC + (T.BooleanType,)) else None


def holds_typed(c: Column, kind: T.DataType, op: str, r) -> Truth:
    """``c op r`` without the operator's own negation."""
    if op == "in":
        if not isinstance(r, (list, tuple)):
            return False
        plain_kind = str if isinstance(kind, T.StringType) else int if isinstance(kind, NUMERIC) else None
        if plain_kind and r and all(type(x) is plain_kind for x in r):
            return c.isin(list(r))
        out: Truth = False
        for x in r:
            out = any_of(out, compare_typed(c, kind, "=", x))
        return out
    if op == "ni":
        if not isinstance(kind, T.ArrayType):
            return False
        inner = [compare_typed(F.lit(None).cast(kind.elementType), kind.elementType, "=", r)]
        if inner[0] is False:
            return False
        return F.exists(c, lambda e: F.coalesce(column_of(compare_typed(e, kind.elementType, "=", r)), F.lit(False)))
    if op in ("re", "~"):
        text, r = text_of(c, kind), scalar_text(r)
        if text is None or r is None:
            return False
        if op == "~":
            return text.startswith(r)
        return text.rlike(r) if r else text == ""
    return compare_typed(c, kind, op, r)


def value_test(c: Column, kind: T.DataType, p: Predicate) -> Truth:
    x = holds_typed(c, kind, p.op, plain(p.right))
    if isinstance(x, bool):
        return c.isNotNull() if x != p.negated else False
    if p.negated:
        return c != p.right if p.op == "=" and same_kind(kind, p.right) else ~x
    return x


def same_kind(kind: T.DataType, r) -> bool:
    return (isinstance(kind, T.StringType) and isinstance(r, str)) or (isinstance(kind, NUMERIC) and type(r) is int)


# keys and paths


def key_test(key: str | Column, op: str, negated: bool, right) -> Truth:
    if isinstance(key, str):
        return holds(key, op, plain(right)) != negated
    x = holds_typed(key, T.StringType(), op, plain(right))
    return negate(x) if negated else x


def predicate(p: Predicate, key: str | Column, c: Column, kind: T.DataType) -> Truth:
    if isinstance(p.left, Name):
        same = key == p.left.text
        return all_of(same, value_test(c, kind, p)) if not isinstance(same, bool) or same else False
    if isinstance(p.left, Star):
        return key_test(key, p.op, p.negated, p.right)
    if isinstance(p.left, KeyTest):
        gate = key_test(key, p.left.op, p.left.negated, p.left.right)
        return all_of(gate, value_test(c, kind, p)) if gate is not False else False
    return value_test(c, kind, p)


def test_one(t: Test, key: str | Column, c: Column, kind: T.DataType) -> Truth:
    x = fold(t.chain, lambda p: predicate(p, key, c, kind))
    sure = not isinstance(x, bool) and len(t.chain) == 1 and not isinstance(t.chain[0].item.left, Star)
    return x if sure else all_of(x, c.isNotNull())


def fields(c: Column | None, kind: T.StructType) -> Iterator[tuple[str, Column, T.DataType]]:
    for f in kind:
        yield f.name, F.col(f"`{f.name}`") if c is None else c.getField(f.name), f.dataType


def over_children(c: Column | None, kind: T.DataType, truth: Callable[[str | Column, Column, T.DataType], Truth]) -> Truth:
    """Whether ``truth(key, value, type)`` holds for any child; a null child is not there."""
    if isinstance(kind, T.StructType):
        out: Truth = False
        for name, at, sub in fields(c, kind):
            out = any_of(out, truth(name, at, sub))
        return out
    if isinstance(kind, T.ArrayType):
        hits = F.transform(c, lambda e, i: F.coalesce(column_of(truth(i.cast("string"), e, kind.elementType)), F.lit(False)))
        return F.coalesce(F.exists(hits, lambda h: h), F.lit(False))
    if isinstance(kind, T.MapType):
        return F.coalesce(F.exists(F.map_entries(c), lambda e: F.coalesce(column_of(truth(e["key"].cast("string"), e["value"], kind.valueType)), F.lit(False))), F.lit(False))
    return False


def there(c: Column) -> Truth:
    return c.isNotNull()


def path_truth(steps: tuple, c: Column | None, kind: T.DataType) -> Truth:
    """Whether any way from ``c`` (None: the row itself) passes all steps."""
    if not steps:
        return True if c is None else there(c)
    head, rest = steps[0], steps[1:]
    if isinstance(head, DeepStar):
        here = path_truth(rest, c, kind) if rest else False
        return any_of(here, over_children(c, kind, lambda k, v, t: path_truth(steps, v, t) if rest else there(v)))
    if isinstance(head, Star):
        return over_children(c, kind, lambda k, v, t: path_truth(rest, v, t))
    if isinstance(head, Name):
        if isinstance(kind, T.StructType):
            hit = [path_truth(rest, at, sub) for name, at, sub in fields(c, kind) if name == head.text]
            return hit[0] if hit else False
        if isinstance(kind, T.ArrayType):
            if not head.text.isdigit():
                return False
            return path_truth(rest, F.get(c, F.lit(int(head.text))), kind.elementType)
        return path_truth(rest, F.try_element_at(c, F.lit(head.text)), kind.valueType) if isinstance(kind, T.MapType) else False
    only = {j.item.left.text for j in head.chain if isinstance(j.item.left, Name) and not j.negated}
    if isinstance(kind, T.ArrayType) and all(isinstance(j.item.left, DeepStar) for j in head.chain) and not rest:
        return F.coalesce(F.exists(c, lambda e: F.coalesce(column_of(test_one(head, "", e, kind.elementType)), F.lit(False))), F.lit(False))
    if isinstance(kind, T.MapType) and len(head.chain) == 1 and only:
        return path_test_map(head, rest, c, kind, next(iter(only)))
    return over_children(c, kind, lambda k, v, t: all_of(test_one(head, k, v, t), path_truth(rest, v, t) if rest else True))


def path_test_map(head: Test, rest: tuple, c: Column, kind: T.MapType, key: str) -> Truth:
    at = F.try_element_at(c, F.lit(key))
    return all_of(test_one(head, key, at, kind.valueType), path_truth(rest, at, kind.valueType) if rest else True)


def where(chain: tuple[Joined, ...], schema: T.StructType) -> Truth:
    """The filter of a query as one condition over the columns of ``schema``."""

    def truth(item) -> Truth:
        if isinstance(item, Group):
            return where(item.chain, schema)
        return True if matches_all(item.steps) else path_truth(item.steps, None, schema)

    return fold(chain, truth)
