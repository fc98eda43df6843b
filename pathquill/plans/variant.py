"""Filters over VARIANT documents as built-in expressions: names, one level of wildcards, tests of keys and values.

What a path finds may be of any kind, so each comparison is a choice by kind, whose arms are the typed
comparisons; wildcards look at the entries of an object or array. None stands for filters that need the evaluator: those
of any depth, and comparisons with whole containers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.coercion import holds
from ..functions.evaluator import matches_all, plain
from ..lang.ast import Group, Joined, KeyTest, Name, Predicate, Star, Test
from . import typed


def json_path(names) -> str:
    quoted = (n.replace("\\", "\\\\").replace("'", "\\'") for n in names)
    return "$" + "".join(f"['{n}']" for n in quoted)


def found(value: Column, names, cast: str) -> Column:
    """What a path finds; a name of digits is an object's key or an array's index, whichever there is."""
    names = list(names)
    ways = [[]]
    for n in names:
        steps = [json_path([n])[1:], f"[{int(n)}]"] if n.isdigit() and len(n) < 10 else [json_path([n])[1:]]
        ways = [[*w, s] for w in ways for s in steps]
    got = [F.try_variant_get(value, "$" + "".join(w), cast) for w in ways]
    return got[0] if len(got) == 1 else F.coalesce(*got)


def simple(chain: tuple[Joined, ...]) -> bool:
    """Whether built-in expressions can say it: everything but ``**`` as a step, containers on the right, and names with quotes."""
    return all(simple(j.item.chain) if isinstance(j.item, Group) else matches_all(j.item.steps) or all(map(step_ok, j.item.steps)) for j in chain)


def step_ok(s) -> bool:
    return name_ok(s) or isinstance(s, Star) or isinstance(s, Test) and all((not isinstance(j.item.left, Name) or name_ok(j.item.left)) and right_ok(j.item) for j in s.chain)


def name_ok(s) -> bool:
    return isinstance(s, Name) and "'" not in s.text and "\\" not in s.text


def right_ok(p: Predicate) -> bool:
    r = plain(p.right)
    return not isinstance(r, (dict, list, tuple)) or p.op == "in" and not isinstance(r, dict) and not any(isinstance(x, (list, dict)) for x in r)


def entries(value: Column) -> Column:
    """Keys and values of an object's fields or an array's elements; none of anything else."""
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    elements = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda e, i: F.struct(i.cast("string").alias("key"), e.alias("value")))
    kind = "array<struct<key:string,value:variant>>"
    return F.coalesce(fields.cast(kind), elements.cast(kind), F.array().cast(kind))


ARMS = [("STRING", "string", T.StringType()), ("BIGINT", "long", T.LongType()), ("DOUBLE", "double", T.DoubleType()), ("FLOAT", "double", T.DoubleType()), ("BOOLEAN", "boolean", T.BooleanType())]


def predicate(value: Column, names: tuple[str, ...], p: Predicate) -> Column:
    """Whether what a path of names finds passes the comparison; what isn't there doesn't."""
    at = found(value, names, "variant")
    right = plain(p.right)
    if p.op == "ni":
        equal = Predicate(p.left, "=", False, p.right)
        held = F.exists(found(value, names, "array<variant>"), lambda e: predicate(e, (), equal))
        held = F.coalesce(held, F.lit(False))
        return at.isNotNull() & (~held if p.negated else held)
    kind = F.schema_of_variant(at)
    out = F.when(at.isNull(), F.lit(False))
    for name, cast, t in ARMS:
        truth = typed.column_of(typed.holds_typed(found(value, names, cast), t, p.op, right))
        out = out.when(kind == name, ~truth if p.negated else truth)
    decimal = typed.column_of(typed.holds_typed(found(value, names, "double"), T.DoubleType(), p.op, right))
    out = out.when(kind.startswith("DECIMAL"), ~decimal if p.negated else decimal)
    out = out.when(kind == "VOID", F.lit(holds(None, p.op, right) != p.negated))
    return F.coalesce(out.otherwise(F.lit(p.negated)), F.lit(False))  # containers can't be compared


def tested(t: Test, key: Column, value: Column) -> Column:
    """Whether one field or element passes all of a test."""

    def truth(p: Predicate) -> typed.Truth:
        if isinstance(p.left, Star):
            return typed.key_test(key, p.op, p.negated, p.right)
        gate: typed.Truth = True
        if isinstance(p.left, Name):
            gate = key == p.left.text
        elif isinstance(p.left, KeyTest):
            gate = typed.key_test(key, p.left.op, p.left.negated, p.left.right)
        return typed.all_of(gate, predicate(value, (), p))

    return typed.column_of(typed.fold(t.chain, truth))


def path_truth(steps: tuple, value: Column) -> Column:
    names: tuple[str, ...] = ()
    while steps and isinstance(steps[0], Name):
        names, steps = (*names, steps[0].text), steps[1:]
    if not steps:
        return found(value, names, "variant").isNotNull()
    head, rest = steps[0], steps[1:]
    if isinstance(head, Test) and not rest:
        keys = {j.item.left.text if isinstance(j.item.left, Name) else None for j in head.chain}
        if len(keys) == 1 and None not in keys and not any(j.negated for j in head.chain):
            return typed.column_of(typed.fold(head.chain, lambda p: predicate(value, (*names, p.left.text), p)))
    at = found(value, names, "variant") if names else value

    def below(e: Column) -> Column:
        here = tested(head, e["key"], e["value"]) if isinstance(head, Test) else F.lit(True)
        return F.coalesce(here & path_truth(rest, e["value"]) if rest else here, F.lit(False))

    return F.exists(entries(at), below)


def where(chain: tuple[Joined, ...], value: Column) -> Column | None:
    if not simple(chain):
        return None

    def truth(item) -> typed.Truth:
        if isinstance(item, Group):
            return typed.fold(item.chain, truth)
        return True if matches_all(item.steps) else path_truth(item.steps, value)

    return typed.column_of(typed.fold(chain, truth))


def order_key(value: Column, order) -> Column:
    """Values of mixed kinds in one order: missing, null, boolean, number, text, containers."""
    names = [n.text for n in order.path]
    at = found(value, names, "variant")
    kind = F.schema_of_variant(at)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    rank = F.when(at.isNull(), 0).when(kind == "VOID", 1).when(kind == "BOOLEAN", 2).when(number, 3).when(kind == "STRING", 4).otherwise(5)
    return F.struct(
        rank.alias("rank"),
        F.when(kind == "BOOLEAN", found(value, names, "boolean").cast("double")).when(number, found(value, names, "double")).alias("number"),
        F.when(kind == "STRING", found(value, names, "string")).alias("text"),
    )
