"""Comparison of JSON values of any two kinds.

The left side is the document's value, the right side the query's. ``compare`` returns a number whose
sign orders them, or None where the kinds cannot be compared.
"""

from __future__ import annotations

import re

try:
    import regex as patterns  # knows \p{L}, as the JVM's patterns do
except ImportError:
    patterns = re


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def sign(a, b) -> int:
    return (a > b) - (a < b)


def number_text(x: int | float) -> str:
    """Decimal text: integers plainly, fractions in their shortest form."""
    if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
        return str(int(x))
    return repr(x) if isinstance(x, float) else str(x)


def leading_integer(text: str) -> int:
    m = re.match(r"[ \t\r\n]*([+-]?\d+)", text)
    return int(m[1]) if m else 0


def leading_float(text: str) -> float:
    m = re.match(r"[ \t\r\n]*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", text)
    return float(m[1]) if m else 0.0


def short_first(text: str) -> tuple[int, bytes]:
    """Strings are ordered by their length in bytes, then by their bytes."""
    raw = text.encode()
    return len(raw), raw


def compare(left, right) -> int | None:
    if isinstance(left, (list, dict)):
        return compare_deep(left, right) if type(left) is type(right) else None
    if left is None:
        return 0 if right is None or right == "" else -1
    if isinstance(right, (list, dict)):
        return None
    if isinstance(left, bool):
        if isinstance(right, str):
            return int(left) - (right == "true") if right in ("true", "false") else -1
        return int(left) - bool(right)
    if is_number(left):
        if right is None:
            return 1
        if isinstance(right, bool):
            return sign(left, float(right)) if isinstance(left, float) else (left != 0) - right
        if isinstance(right, str):
            return sign(left, leading_float(right) if isinstance(left, float) else leading_integer(right))
        return sign(left, right)
    if right is None:
        return int(left != "")
    if isinstance(right, bool):
        return (left == "true") - right
    if is_number(right):
        return sign(left.encode(), number_text(right).encode())
    return sign(short_first(left), short_first(right))


def compare_deep(a, b) -> int:
    """Arrays by element, objects by their entries in key order; kinds in a fixed order."""
    if isinstance(a, list) and isinstance(b, list):
        for x, y in zip(a, b, strict=False):
            if c := compare_deep(x, y):
                return c
        return sign(len(a), len(b))
    if isinstance(a, dict) and isinstance(b, dict):
        if len(a) != len(b):
            return sign(len(a), len(b))
        for (k, x), (m, y) in zip(sorted(a.items()), sorted(b.items()), strict=True):
            if c := sign(k, m) or compare_deep(x, y):
                return c
        return 0
    kinds = kind_rank(a), kind_rank(b)
    if kinds[0] != kinds[1]:
        return sign(*kinds)
    return 0 if a is None else sign(a.encode(), b.encode()) if isinstance(a, str) else sign(a, b)


def kind_rank(x) -> int:
    """Order of kinds: null, boolean, number, string, object, array."""
    if x is None:
        return 1
    if isinstance(x, bool):
        return 2
    return 3 if is_number(x) else 4 if isinstance(x, str) else 5 if isinstance(x, dict) else 6


def scalar_text(x) -> str | None:
    """Text of a scalar for patterns and prefixes; None for null and containers."""
    if isinstance(x, bool):
        return "true" if x else "false"
    return number_text(x) if is_number(x) else x if isinstance(x, str) else None


def regex_found(pattern: str, text: str) -> bool:
    """Unanchored search; the empty pattern finds the empty text alone."""
    return bool(patterns.search(pattern, text)) if pattern else not text


def holds(left, op: str, right) -> bool:
    """Whether ``left op right``, without the operator's own negation."""
    if op == "in":
        return isinstance(right, (list, tuple)) and any(compare(left, r) == 0 for r in right)
    if op == "ni":
        return isinstance(left, list) and any(compare(x, right) == 0 for x in left)
    if op == "re":
        text, pattern = scalar_text(left), scalar_text(right)
        return text is not None and pattern is not None and regex_found(pattern, text)
    if op == "~":
        text, prefix = scalar_text(left), scalar_text(right)
        return text is not None and prefix is not None and text.startswith(prefix)
    c = compare(left, right)
    if c is None:
        return False
    return {"=": c == 0, ">": c > 0, ">=": c >= 0, "<": c < 0, "<=": c <= 0}[op]
