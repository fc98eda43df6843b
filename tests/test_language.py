"""Parsing, printing, matching, projecting and patching on plain JSON values.

Most cases are made by rule: queries are written from random trees, and what they mean is said once more
by a short function over all places of a document, a table of kinds, or the standards' own definitions.
"""

import copy
import itertools
import json
import operator
import random
import re

import pytest

from pathquill.errors import OptionRepeatedError, PatchError, PatchTestError, QueryParseError
from pathquill.functions.coercion import compare
from pathquill.functions.evaluator import Projector, matches
from pathquill.functions.patch import apply_patch
from pathquill.lang.parser import parse
from pathquill.lang.printer import to_text

NAMES = ["shelf", "book", "isbn", "lent"]
LEAVES = [0, 7, -2, 3.5, "", "ink", "7", True, False]


def random_doc(rng, depth=3):
    """An object of few names, so that paths meet."""
    out = {}
    for name in rng.sample(NAMES, rng.randint(1, 3)):
        roll = rng.random()
        if depth and roll < 0.45:
            out[name] = random_doc(rng, depth - 1)
        elif depth and roll < 0.6:
            out[name] = [random_doc(rng, 0) if rng.random() < 0.3 else rng.choice(LEAVES) for _ in range(rng.randint(0, 3))]
        else:
            out[name] = rng.choice(LEAVES)
    return out


def places(value, at=()):
    """(path, value) of everything below a value."""
    inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in inner:
        yield (*at, str(k)), v
        yield from places(v, (*at, str(k)))


# printing


def random_query(rng):
    """A query's text in canonical form."""

    def predicate():
        left = rng.choice([*NAMES, '[* = "book"]', "*", "**"])
        op = rng.choice(["=", "!=", ">", ">=", "<", "<=", "re", "not re", "~", "in", "not in", "ni"])
        right = "[1,2]" if op.endswith("in") else rng.choice(['"ink"', "7", "3.5", "true", "null", ":p", ":?"])
        if left == "*" and op == "in":
            right = '["book"]'
        return f"{left} {op} {right}"

    def test():
        return "[" + f" {rng.choice(['and', 'or'])} ".join(predicate() for _ in range(rng.randint(1, 2))) + "]"

    def path():
        steps = [rng.choice([*NAMES, "*", "**"]) for _ in range(rng.randint(0, 2))]
        return "".join("/" + s for s in [*steps, rng.choice([rng.choice(NAMES), test()])])

    def chain(depth):
        join, out = rng.choice(["and", "or"]), []
        for k in range(rng.randint(1, 3)):
            item = f"({chain(depth - 1)})" if depth and rng.random() < 0.3 else path()
            out.append(item if not k else f"{join} {'not ' * (rng.random() < 0.2)}{item}")
        return " ".join(out)

    where = chain(1)
    lines = [("@books" if where.startswith("/") and rng.random() < 0.5 else "") + where]
    if rng.random() < 0.3:
        lines.append('| apply {"lent":true}')
    if rng.random() < 0.5:
        lines.append("| " + rng.choice(["all - /isbn", "/book + /shelf/{isbn,lent}", "/shelf<shelves + /shelf/book"]))
    if rng.random() < 0.5:
        lines.append("| " + rng.choice(["asc /isbn", "desc :f", "skip 3 limit 4", "limit :n", "count"]))
    return "\n".join(lines)


@pytest.mark.filterwarnings("ignore:'and' after")
def test_printing_reads_back():
    rng = random.Random(21)
    for _ in range(400):
        text = random_query(rng)
        tree = parse(text)
        assert parse(to_text(tree)) == tree, text
        assert to_text(parse(to_text(tree))) == to_text(tree)


def test_printing_is_canonical():
    spelled = [
        ("/shelf/[isbn eq 3]", "/shelf/[isbn = 3]"),
        ("/shelf/[isbn !eq ink]", '/shelf/[isbn != "ink"]'),
        ("/shelf   and\tnot\n/book", "/shelf and not /book"),
        ("@books/=  9 |count", "@books/=9\n| count"),
        ("/shelf | inverse noidx", "/shelf\n| noidx inverse"),
    ]
    for text, printed in spelled:
        assert to_text(parse(text)) == printed


def test_what_cannot_be_read():
    for text in ("", "book", "/book or", "not /book", "/book/[isbn]", "/book/[isbn = 4 2]", "/book/[isbn => 4]", "/book | limit ink", "/book | skip -1", "(/book", "/book/[isbn = maybe not]"):
        with pytest.raises(QueryParseError):
            parse(text)
    for option in ("skip", "limit"):
        with pytest.raises(OptionRepeatedError):
            parse(f"/* | {option} 4 {option} 5")


# paths: a pattern of steps is a regular expression over places

STEP = {"*": r"/[^/]+", "**": r"(?:/[^/]+)*"}


def reached(doc, steps):
    """Whether a place fits the steps; a ``**`` at the end wants one level more."""
    tail = [*steps[:-1], "*", "**"] if steps[-1] == "**" else steps
    pattern = re.compile("".join(STEP.get(s, "/" + re.escape(s)) for s in tail))
    return any(pattern.fullmatch("/" + "/".join(at)) for at, _ in places(doc))


def test_paths():
    rng = random.Random(5)
    seen = []
    for _ in range(1500):
        doc = random_doc(rng)
        steps = [rng.choice([*NAMES, "*", "**", "0", "1"]) for _ in range(rng.randint(1, 4))]
        if all(s in ("*", "**") for s in steps) and len(steps) == 1:
            continue
        wanted = reached(doc, steps)
        assert matches(parse("/" + "/".join(steps)), doc) is wanted, (doc, steps)
        seen.append(wanted)
    assert 0.1 < sum(seen) / len(seen) < 0.9


def test_everything_matches_a_lone_star():
    for doc in ({}, {"isbn": 1}, [], [1]):
        assert matches(parse("/*"), doc) and matches(parse("/**"), doc)


def test_tests_at_depth():
    """``/**/[name op value]`` looks at every place with that name."""
    rng = random.Random(6)
    for _ in range(600):
        doc, name, value = random_doc(rng), rng.choice(NAMES), rng.choice([7, 0, -2])
        wanted = any(at[-1] == name and type(v) is int and v >= value for at, v in places(doc))
        other = any(at[-1] == name and not isinstance(v, (dict, list, str, bool)) and v >= value for at, v in places(doc))
        assert matches(parse(f"/**/[{name} >= {value}]"), strip(doc, (str, bool, float))) is wanted
        assert matches(parse(f"/**/[{name} >= {value}]"), strip(doc, (str, bool))) is other


def strip(value, kinds):
    """Without leaves of some kinds, which compare by rules of their own."""
    if isinstance(value, dict):
        return {k: strip(v, kinds) for k, v in value.items() if not isinstance(v, kinds)}
    return [strip(v, kinds) for v in value] if isinstance(value, list) else value


# comparisons: by kind of both sides

OPS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def shortlex(text):
    return len(text.encode()), text.encode()


def test_like_kinds_compare_by_their_order():
    kinds = [([-2, 0, 3, 3.5, 7], float), (["", "a", "ink", "paper", "é", "zz"], shortlex), ([True, False], int)]
    for values, key in kinds:
        for left, right, (op, holds) in itertools.product(values, values, OPS.items()):
            text = f"/[x {op} {json.dumps(right)}]"
            assert matches(parse(text), {"x": left}) is holds(key(left), key(right)), (left, op, right)


def test_unlike_kinds():
    """Texts read as numbers against numbers, numbers write as text against text, null is below all."""
    assert compare("12", 12) == compare(12, "12 apples") == compare(3.5, "3.5") == 0
    assert compare(None, -5) < 0 < compare(-5, None)
    assert compare("", None) == 0 < compare("a", None)
    assert compare(True, "true") == compare(5, True) == compare("no", False) == 0
    assert compare(False, "ink") < 0
    for value, container in itertools.product((5, "5", True), ([5], {"x": 5})):
        assert compare(value, container) is None and compare(container, value) is None


def test_negation_wants_the_key():
    for op in ("= 4", "re ^a", "in [4]", "~ a"):
        word = {"=": "!=", "re": "not re", "in": "not in", "~": "!~"}[op.split()[0]]
        negated = word + op[len(op.split()[0]) :]
        for doc in ({"x": 4}, {"x": 5}, {"x": "abc"}):
            assert matches(parse(f"/[x {op}]"), doc) is not matches(parse(f"/[x {negated}]"), doc)
        assert not matches(parse(f"/[x {negated}]"), {"y": 4})


def test_members_and_texts():
    rng = random.Random(8)
    for _ in range(300):
        value, pool = rng.randint(0, 5), [rng.randint(0, 5) for _ in range(rng.randint(0, 4))]
        assert matches(parse(f"/[x in {json.dumps(pool)}]"), {"x": value}) is (value in pool)
        assert matches(parse(f"/[x ni {value}]"), {"x": pool}) is (value in pool)
        assert matches(parse(f"/x/[** = {value}]"), {"x": pool}) is (value in pool)
    for text, pattern in itertools.product(["", "ink", "pink ink", "42"], ["", "^i", "nk$", "[0-9]+", "k i"]):
        wanted = bool(re.search(pattern, text)) if pattern else not text
        assert matches(parse(f"/[x re {json.dumps(pattern)}]"), {"x": text}) is wanted
        assert matches(parse(f"/[x ~ {json.dumps(text)}]"), {"x": "pink ink"}) is "pink ink".startswith(text)
    assert matches(parse("/[x re ^4]"), {"x": 42}) and matches(parse("/[x ~ 4]"), {"x": 42}) and not matches(parse("/[x re a]"), {"x": [1]})
    assert matches(parse(r'/[x re "^\\p{Lu}"]'), {"x": "Écru"}) and not matches(parse(r'/[x re "^\\p{Lu}"]'), {"x": "écru"})


def test_keys():
    doc = {"isbn": 7, "lent": 3}
    for key, value in itertools.product([*NAMES, "nothing"], (3, 7)):
        assert matches(parse(f"/[[* = {key}] = {value}]"), doc) is (doc.get(key) == value)
        assert matches(parse(f"/[* = {key}]"), doc) is (key in doc)
    assert matches(parse("/[* not in [\"isbn\"]]"), doc) and not matches(parse('/[* not in ["isbn","lent"]]'), doc)
    assert matches(parse("/=5"), doc)


def typed(x):
    """With the kind of each leaf: 1 is not true."""
    return {k: typed(v) for k, v in x.items()} if isinstance(x, dict) else [typed(v) for v in x] if isinstance(x, list) else (isinstance(x, bool), isinstance(x, str), x)


def test_containers_compare_whole():
    rng = random.Random(9)
    values = [random_doc(rng, 1) for _ in range(25)]
    for a, b in itertools.product(values, values):
        assert matches(parse(f"/[x = {json.dumps(b)}]"), {"x": copy.deepcopy(a)}) is (typed(a) == typed(b))
    assert matches(parse('/[x = {"b":1,"a":2}]'), {"x": {"a": 2, "b": 1}})


# chains: operands from left to right, an 'or' that holds ends the chain


def by_hand(items):
    """``items`` are (join, negated, truth)."""
    value = None
    for join, negated, truth in items:
        x = truth != negated
        if join is None:
            value = x
        elif join == "and":
            value = value and x
        elif value or x:
            return True
        else:
            value = False
    return value


@pytest.mark.filterwarnings("ignore:'and' after")
def test_chains():
    rng = random.Random(10)
    for _ in range(400):
        items = [(None if not k else rng.choice(["and", "or"]), bool(k) and rng.random() < 0.3, rng.random() < 0.5) for k in range(rng.randint(1, 5))]
        text = " ".join(f"{j + ' ' if j else ''}{'not ' * n}/{'isbn' if t else 'nothing'}" for j, n, t in items)
        assert matches(parse(text), {"isbn": 1}) is by_hand(items), text
        assert matches(parse(f"/isbn and ({text})"), {"isbn": 1}) is by_hand(items), text


def test_one_value_passes_a_whole_test():
    """All predicates in brackets are about one child."""
    doc = {"isbn": 7, "lent": 3}
    assert not matches(parse("/[isbn = 7 and lent = 3]"), doc)
    assert matches(parse("/[isbn = 7] and /[lent = 3]"), doc)
    assert matches(parse("/[isbn > 5 and isbn < 9]"), doc)


# projections: what stays is said by the leaves' paths


def kept(doc, wanted, at=()):
    """``doc`` with the places for which ``wanted`` holds, and what is above them."""
    out = {}
    for k, v in doc.items():
        here = (*at, k)
        if wanted(here):
            out[k] = v
        elif isinstance(v, dict):
            below = kept(v, wanted, here)
            if below:
                out[k] = below
    return out


def without(doc, path):
    if len(path) == 1:
        return {k: v for k, v in doc.items() if path[0] not in (k, "*")}
    return {k: without(v, path[1:]) if path[0] in (k, "*") and isinstance(v, dict) else v for k, v in doc.items()}


def objects_only(rng, depth=2):
    return {n: objects_only(rng, depth - 1) if depth and rng.random() < 0.6 else rng.choice(LEAVES) for n in rng.sample(NAMES, rng.randint(1, 4))}


def test_projections():
    rng = random.Random(12)
    for _ in range(300):
        doc = objects_only(rng)
        depth = rng.randint(1, 2)  # of paths of which one holds the other, the deeper counts
        paths = [tuple(rng.choice([*NAMES, "*"]) for _ in range(depth)) for _ in range(rng.randint(1, 2))]

        def fits(at, paths=paths):
            return any(len(p) == len(at) and all(a in (b, "*") for a, b in zip(p, at, strict=True)) for p in paths)

        text = " + ".join("/" + "/".join(p) for p in paths)
        got = Projector(parse(f"/* | {text}"))(doc)
        assert prune(got) == prune(kept(doc, fits)), (doc, text)
        gone = paths[0]
        assert Projector(parse(f"/* | all - /{'/'.join(gone)}"))(doc) == without(doc, gone), (doc, gone)
    assert Projector(parse("/* | all - all"))(doc) == {} and Projector(parse("/* | all + all"))(doc) == doc
    assert Projector(parse("/* | /book/{isbn,none}"))({"book": {"isbn": 1, "lent": 2}}) == {"book": {"isbn": 1}}


def prune(value):
    """Without empty objects, which a path may leave above nothing."""
    if not isinstance(value, dict):
        return value
    out = {k: prune(v) for k, v in value.items()}
    return {k: v for k, v in out.items() if v != {}}


def test_array_elements_in_projections():
    assert Projector(parse("/* | /lent/1"))({"lent": ["Ann", "Bo", "Cy"]}) == {"lent": ["Bo"]}
    assert Projector(parse("/* | all - /lent/0"))({"lent": ["Ann", "Bo"]}) == {"lent": ["Bo"]}


def test_join_projection():
    shelves = {4: {"room": "east", "rows": [2, 8]}}
    doc = {"title": "Ink", "shelf": 4}

    def project(text):
        return Projector(parse(f"/* | {text}"), lambda c, k: shelves.get(k) if c == "shelves" else None)(doc)

    assert project("/{title,shelf<shelves}") == {"title": "Ink", "shelf": shelves[4]}
    assert project("/shelf<shelves + /shelf/room") == {"shelf": {"room": "east"}}
    assert project("/shelf<shelves - /shelf/rows/1") == {"shelf": {"room": "east", "rows": [2]}}
    assert project("/shelf<elsewhere") == {"shelf": 4}


# patches


def merge_by_definition(target, patch):
    """The pseudocode of RFC 7396, section 2."""
    if not isinstance(patch, dict):
        return patch
    target = dict(target) if isinstance(target, dict) else {}
    for name, value in patch.items():
        if value is None:
            target.pop(name, None)
        else:
            target[name] = merge_by_definition(target.get(name), value)
    return target


def test_merge_patches():
    rng = random.Random(14)
    for _ in range(300):
        doc, patch = random_doc(rng), random_doc(rng)
        for name in rng.sample(sorted(patch), 1):
            patch[name] = None
        before = json.dumps(doc)
        assert apply_patch(doc, patch) == merge_by_definition(doc, patch)
        assert json.dumps(doc) == before


def test_operations():
    doc = {"lent": 3, "tags": ["old", "torn"], "shelf": {"row": 5}, "a/b~c": 0}
    cases = [
        ([("increment", "lent", 4)], {"lent": 7}),
        ([("add", "tags/1", "thin")], {"tags": ["old", "thin", "torn"]}),
        ([("add", "tags/-", "thin")], {"tags": ["old", "torn", "thin"]}),
        ([("remove", "tags/0", None), ("replace", "tags/0", "new")], {"tags": ["new"]}),
        ([("add_create", "shelf/room/name", "east")], {"shelf": {"row": 5, "room": {"name": "east"}}}),
        ([("test", "a~1b~0c", 0), ("replace", "a~1b~0c", 1)], {"a/b~c": 1}),
    ]
    for ops, changes in cases:
        patch = [{"op": op, "path": "/" + path, "value": value} for op, path, value in ops]
        assert apply_patch(doc, patch) == doc | changes, ops
    between = [
        ("move", "/lent", "/shelf/lent", {"tags": doc["tags"], "shelf": {"row": 5, "lent": 3}, "a/b~c": 0}),
        ("copy", "/shelf/row", "/lent", doc | {"lent": 5}),
        ("swap", "/tags/1", "/lent", doc | {"tags": ["old", 3], "lent": "torn"}),
        ("swap", "/lent", "/gone", {"tags": doc["tags"], "shelf": doc["shelf"], "a/b~c": 0, "gone": 3}),
    ]
    for op, origin, path, wanted in between:
        assert apply_patch(doc, [{"op": op, "from": origin, "path": path}]) == wanted, op


def test_patches_that_fail():
    doc = {"lent": 3, "shelf": {"row": 5}}
    bad = [
        [{"op": "remove", "path": "/nothing"}],
        [{"op": "add_create", "path": "/lent/by/whom", "value": 1}],
        [{"op": "swap", "from": "/nothing", "path": "/lent"}],
        [{"op": "move", "from": "/shelf", "path": "/shelf/inside"}],
        [{"op": "increment", "path": "/shelf", "value": 1}],
        [{"op": "unheard", "path": "/lent"}],
        "text",
    ]
    for patch in bad:
        with pytest.raises(PatchError):
            apply_patch(doc, patch)
    with pytest.raises(PatchTestError):
        apply_patch(doc, [{"op": "test", "path": "/lent", "value": 4}])
