"""Merge patches (RFC 7396), JSON patches (RFC 6902) and three further operations: increment, add_create, swap."""

from __future__ import annotations

import copy
from typing import Any

from ..errors import PatchError, PatchTestError
from .coercion import compare_deep, is_number


def merge(target, patch):
    """Null removes a key, objects merge, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge(out.get(k), v)
    return out


def pointer(text: str) -> list[str]:
    if text in ("", None):
        return []
    if not text.startswith("/"):
        raise PatchError(f"not a JSON pointer: {text!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in text[1:].split("/")]


_MISSING = object()


def child(value, key: str):
    if isinstance(value, dict):
        return value.get(key, _MISSING)
    if isinstance(value, list) and key.isdigit() and int(key) < len(value):
        return value[int(key)]
    return _MISSING


def find(doc, parts: list[str]):
    for p in parts:
        doc = child(doc, p)
        if doc is _MISSING:
            return _MISSING
    return doc


def parent_of(doc, parts: list[str]):
    parent = find(doc, parts[:-1])
    if parent is _MISSING or not isinstance(parent, (dict, list)):
        raise PatchError(f"no container at /{'/'.join(parts[:-1])}")
    return parent


def put(doc, parts: list[str], value, insert: bool = True):
    if not parts:
        return value
    parent, key = parent_of(doc, parts), parts[-1]
    if isinstance(parent, dict):
        parent[key] = value
    elif key == "-":
        parent.append(value)
    elif key.isdigit() and int(key) < len(parent) + insert:
        if insert:
            parent.insert(int(key), value)
        else:
            parent[int(key)] = value
    else:
        raise PatchError(f"no such element: {key}")
    return doc


def remove(doc, parts: list[str]):
    if not parts:
        return None
    parent, key = parent_of(doc, parts), parts[-1]
    if child(parent, key) is _MISSING:
        raise PatchError(f"nothing to remove at /{'/'.join(parts)}")
    del parent[key if isinstance(parent, dict) else int(key)]
    return doc


def needed(doc, parts: list[str]):
    value = find(doc, parts)
    if value is _MISSING:
        raise PatchError(f"nothing at /{'/'.join(parts)}")
    return value


def operate(doc, op: dict[str, Any]):
    kind, path = op.get("op"), pointer(op.get("path", ""))
    if kind == "add":
        return put(doc, path, copy.deepcopy(op.get("value")))
    if kind == "remove":
        return remove(doc, path)
    if kind == "replace":
        needed(doc, path)
        return put(doc, path, copy.deepcopy(op.get("value")), insert=False)
    if kind == "test":
        if compare_deep(needed(doc, path), op.get("value")) != 0:
            raise PatchTestError(f"test failed at {op.get('path')}")
        return doc
    if kind == "copy":
        return put(doc, path, copy.deepcopy(needed(doc, pointer(op.get("from", "")))))
    if kind == "move":
        origin = pointer(op.get("from", ""))
        value = needed(doc, origin)
        if path[: len(origin)] == origin and len(path) > len(origin):
            raise PatchError("a value can't move into itself")
        return put(remove(doc, origin), path, value)
    if kind == "increment":
        value, by = needed(doc, path), op.get("value")
        if not is_number(value) or not is_number(by):
            raise PatchError("increment of what is not a number")
        return put(doc, path, value + by, insert=False)
    if kind == "add_create":
        at = doc
        for p in path[:-1]:
            nxt = child(at, p)
            if nxt is _MISSING:
                if not isinstance(at, dict):
                    raise PatchError(f"{p} can't be created in what is not an object")
                nxt = at[p] = {}
            elif not isinstance(nxt, dict) and not isinstance(nxt, list):
                raise PatchError(f"{p} is not an object")
            at = nxt
        return put(doc, path, copy.deepcopy(op.get("value")))
    if kind == "swap":
        origin = pointer(op.get("from", ""))
        value, other = needed(doc, origin), find(doc, path)
        if other is _MISSING:
            doc = put(doc, path, value)
            return remove(doc, origin)
        doc = put(doc, origin, other, insert=False)
        return put(doc, path, value, insert=False)
    raise PatchError(f"unknown operation {kind!r}")


def apply_patch(doc, patch):
    """``doc`` after a merge patch (object) or a list of operations; ``doc`` itself is left alone."""
    if isinstance(patch, dict):
        return merge(doc, patch)
    if not isinstance(patch, (list, tuple)):
        raise PatchError("a patch is an object or an array")
    doc = copy.deepcopy(doc)
    for op in patch:
        doc = operate(doc, op)
    return doc
