"""Typed tables: every backend agrees, plans are pushed down, placeholders and properties."""

import json

import pytest

from pathquill.api import PathQuery, Tables
from pathquill.errors import InvalidPlaceholderError, NoPrimaryKeyError, UnsetPlaceholderError
from pathquill.functions.evaluator import matches
from pathquill.operators.documents import query_documents
from pathquill.operators.explain import explain

ROWS = [
    {"id": 1, "n": 5, "s": "abc", "b": True, "f": 1.5, "a": [1, 2], "o": {"k": 7, "t": "x"}, "m": [{"k": 1}, {"k": 9}]},
    {"id": 2, "n": None, "s": "", "b": False, "f": 22.0, "a": [], "o": {"k": None, "t": "y"}, "m": []},
    {"id": 3, "n": 22, "s": "22", "b": None, "f": None, "a": None, "o": None, "m": None},
    {"id": 4, "n": -3, "s": "true", "b": True, "f": -0.25, "a": [22], "o": {"k": 22, "t": "22"}, "m": [{"k": 22}]},
]
SCHEMA = "id long, n long, s string, b boolean, f double, a array<long>, o struct<k:long,t:string>, m array<struct<k:long>>"
FILTERS = [
    "/n", "/o/k", "/a/0", "/m/1/k", "/*/k", "/**/k", "/m/*/[k > 5]", "/m/**/[k = 22]", "/[n = 22]", '/[n = "22"]', "/[n != 22]", "/[n > 4 or n < 0]", "/[n > 0 and not n = 5]",
    "/[s = 22]", "/[s > ab]", "/[s <= 5]", "/[s = null]", "/[s = true]", "/[b = true]", '/[b = "false"]', "/[b < 5]", "/[f > 1]", "/[f = 22]", '/[f re "^22$"]', "/[s re \"\"]", "/[n ~ 2]", "/[f ~ 1]",
    "/[a ni 22]", "/[a = [1,2]]", "/[a != 3]", '/[o = {"k":7,"t":"x"}]', "/[n in [5,\"22\"]]", '/[s not in ["abc"]]', "/[* = n]", '/[* re "^[ns]$"]', "/[[* = n] > 4]",
    '/o/[[* ~ "k"] = 22]', "/[** = 22]", "/a/[** > 1]", "/o/[** = x]", "/n and not /[s = abc]", "/n or not /o", "(/[n = 5] or /[n = -3]) and /o/[k = 7]", "/[n >= null]", "/nothing", "/[nothing != 1]", "/*", "/**",
]


def drop_nulls(x):
    """A missing field for each null, as typed rows mean it."""
    if isinstance(x, dict):
        return {k: drop_nulls(v) for k, v in x.items() if v is not None}
    return [drop_nulls(v) for v in x] if isinstance(x, list) else x


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([tuple(r.values()) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(r["id"], json.dumps(drop_nulls(r))) for r in ROWS], "id long, doc string")


def test_backends_agree(df, docs, spark):
    tables = Tables(spark).register("t", df, "id")
    for text in FILTERS:
        q = PathQuery(text, "t")
        wanted = {r["id"] for r in ROWS if matches(q.bound, drop_nulls(r))}
        assert {r.id for r in tables.query(q).collect()} == wanted, text
        assert {r.id for r in query_documents(docs, q.bound).collect()} == wanted, text


def test_pushdown(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "t"))
    t = Tables(spark).register("t", spark.read.parquet(str(tmp_path / "t")), "id")
    plan = t.query("@t/[n > 4] and /[s = abc] | /{id,n}")._jdf.queryExecution().toString()
    assert "GreaterThan(n,4)" in plan and "EqualTo(s,abc)" in plan
    assert "ReadSchema: struct<id:bigint,n:bigint,s:string>" in plan


def test_placeholders(df, spark):
    tables = Tables(spark).register("t", df, "id")
    q = PathQuery("@t/[n > :low] and /[s = :?] | /:f | skip :n")
    assert q.placeholders == ["low", 0, "f", "n"]
    with pytest.raises(UnsetPlaceholderError):
        tables.query(q)
    bound = q.bind("abc", low=0, f="s", n=0)
    assert [r.s for r in tables.query(bound).collect()] == ["abc"]
    for bad in (q.bind("a", "b"), q.bind("abc", low=0, f=3, n=0), q.bind("abc", low=0, f="s", n=-1), q.bind(other=1)):
        with pytest.raises(InvalidPlaceholderError):
            tables.query(bad)
    assert tables.count(PathQuery("@t/[s re :r]").bind_regex("r", "^a")) == 1
    assert tables.count("@t/* | count") == 4
    with pytest.raises(NoPrimaryKeyError):
        Tables(spark).register("t", df).query("@t/=1")
    assert tables.query("@none/*").count() == 0


def test_properties():
    q = PathQuery('@c/* | apply {"a":1} | /x | asc /y skip 2 limit 3 count')
    assert (q.collection, q.has_apply, q.has_projection, q.has_order, q.has_count, q.skip, q.limit) == ("c", True, True, True, True, 2, 3)
    assert not PathQuery("/* | all").has_projection
    assert PathQuery("/* | /a").apply_and_project({"a": 1, "b": 2}) == {"a": 1}


def test_explain():
    indexes = [{"path": "/f/b", "type": "integer", "unique": True, "rows": 10}, {"path": "/n", "type": "integer", "unique": False, "rows": 10}]

    def log(text):
        return explain(PathQuery(text).bound, indexes)

    assert "SELECTED UNIQUE|integer 10 /f/b EXPR1: 'b = 1'" in log("/f/[b = 1] and /[n > 3]")
    assert "EXPR1: 'b > 1' EXPR2: 'b <= 8'" in log("/f/[b > 1 and b <= 8]")
    assert "[INDEX] NO" in log("/f/[b != 1]") and "[INDEX] NO" in log("/f/[b = 1] or /n") and "[INDEX] PK" in log("/=1")
    assert "ORDERBY DESC" in log("/* | desc /n") and "PLAIN" in log("/* | desc /n") and "SORTER" in log("/* | desc /x")
    assert "[INDEX] NO" in log("/f/[b = 1] | noidx")


def test_joins_keep_the_order(spark):
    rows = [(i, (i * 7) % 50, i % 5) for i in range(50)]
    left = spark.createDataFrame(rows, "id long, n long, r long").repartition(4)
    right = spark.createDataFrame([(i, f"name {i}") for i in range(5)], "k long, name string")
    tables = Tables(spark).register("t", left, "id").register("u", right, "k")
    got = tables.query("@t/* | /{n,r<u} | desc /n skip 3").collect()
    assert [r.n for r in got] == list(range(46, -1, -1)) and all(r.r.name for r in got)
    docs = left.selectExpr("id", "to_json(struct(n, r)) as doc")
    others = right.selectExpr("k as id", "to_json(struct(name)) as doc")
    found = query_documents(docs, PathQuery("/* | /{n,r<u} | asc /n").bound, lambda name: others if name == "u" else None)
    assert [json.loads(r.doc)["n"] for r in found.collect()] == list(range(50))
