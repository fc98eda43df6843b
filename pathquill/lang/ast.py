"""Syntax tree of a path query. All nodes are immutable; binding makes a new tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Param:
    """A placeholder: ``:name``, or the ``index``-th ``:?``."""

    name: str | None
    index: int = -1


@dataclass(frozen=True)
class Name:
    text: str
    quoted: bool = False


@dataclass(frozen=True)
class Star:
    """One level, any key."""


@dataclass(frozen=True)
class DeepStar:
    """Any number of levels as a step; any child value on the left of a predicate."""


@dataclass(frozen=True)
class Pattern:
    """A bound regular expression."""

    source: str


@dataclass(frozen=True)
class KeyTest:
    """``[* op right]`` on the left of a predicate: the key must pass."""

    op: str
    negated: bool
    right: Any


@dataclass(frozen=True)
class Predicate:
    left: Name | Star | DeepStar | KeyTest
    op: str  # = > >= < <= in ni re ~
    negated: bool
    right: Any  # JSON value, Param or Pattern


@dataclass(frozen=True)
class Joined:
    """An operand of a chain: ``join`` is None for the first, else 'and' or 'or'."""

    join: str | None
    negated: bool
    item: Any


@dataclass(frozen=True)
class Test:
    """Predicates on the keys of one level."""

    chain: tuple[Joined, ...]


@dataclass(frozen=True)
class Path:
    steps: tuple[Any, ...]  # Name | Star | DeepStar | Test
    anchor: str | None = None


@dataclass(frozen=True)
class Group:
    chain: tuple[Joined, ...]


@dataclass(frozen=True)
class KeyLookup:
    """``/=key``: a key, a list of keys, or a Param."""

    key: Any
    anchor: str | None = None


@dataclass(frozen=True)
class Projection:
    """One term: ``all`` (path None) or a path; ``sign`` is '+' or '-'."""

    sign: str
    path: tuple[Any, ...] | None  # Name | Param | Fields


@dataclass(frozen=True)
class Fields:
    names: tuple[Any, ...]  # Name | Param


@dataclass(frozen=True)
class Order:
    path: tuple[Any, ...] | Param  # Names and Params, or one Param that holds a pointer
    descending: bool


@dataclass(frozen=True)
class Query:
    where: KeyLookup | tuple[Joined, ...]
    apply: Any = None
    upsert: bool = False
    delete: bool = False
    projection: tuple[Projection, ...] = ()
    order: tuple[Order, ...] = ()
    skip: Any = None
    limit: Any = None
    count: bool = False
    noindex: bool = False
    inverse: bool = False
    has_apply: bool = False
    positional: int = field(default=0, compare=False)

    @property
    def anchor(self) -> str | None:
        """The first collection named in the text."""
        if isinstance(self.where, KeyLookup):
            return self.where.anchor

        def first(chain: tuple[Joined, ...]) -> str | None:
            for j in chain:
                found = first(j.item.chain) if isinstance(j.item, Group) else j.item.anchor
                if found:
                    return found
            return None

        return first(self.where)
