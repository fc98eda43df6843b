"""Registered queries over the data folder's tables, and the SQL each is held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import PathQuery, Tables
from .sources.shared import shared_folder

KEYS = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "lineitem": None,
    "events": "event_id",
    "documents": "doc_id",
    "embeddings": "vec_id",
    "pages": "page_id",
    "benchmark": "item_id",
    "labels": "doc_id",
    "conversations": None,
}


def tables(spark: SparkSession, sf_dir: str, json_columns: bool = True) -> Tables:
    out = Tables(spark)
    for name, key in KEYS.items():
        out.register_later(name, partial(spark.read.parquet, f"{sf_dir}/{name}.parquet"), key, {"props": "struct<k:bigint>"} if name == "events" and json_columns else None)
    return out


#: name -> (query, SQL, positional values, named values)
SELECTS: dict[str, tuple] = {
    "scan_all": ("@region/*", "select * from region"),
    "scan_deep": ("@nation/**", "select * from nation"),
    "field_exists": ("@customer/c_acctbal", "select * from customer where c_acctbal is not null"),
    "field_missing": ("@customer/nothing", "select * from customer where false"),
    "eq_str": ("@customer/[c_mktsegment = BUILDING]", "select * from customer where c_mktsegment = 'BUILDING'"),
    "ne_str": ("@customer/[c_mktsegment != BUILDING]", "select * from customer where c_mktsegment <> 'BUILDING'"),
    "not_eq_word": ("@customer/[c_mktsegment !eq BUILDING]", "select * from customer where c_mktsegment <> 'BUILDING'"),
    "gt": ("@lineitem/[l_quantity > 30]", "select * from lineitem where l_quantity > 30"),
    "gte": ("@lineitem/[l_quantity gte 30]", "select * from lineitem where l_quantity >= 30"),
    "lt": ("@lineitem/[l_quantity < 5]", "select * from lineitem where l_quantity < 5"),
    "lte": ("@lineitem/[l_quantity <= 5]", "select * from lineitem where l_quantity <= 5"),
    "range_same_key": ("@orders/[o_totalprice >= 1000 and o_totalprice < 50000]", "select * from orders where o_totalprice >= 1000 and o_totalprice < 50000"),
    "two_keys_never": ("@orders/[o_orderkey >= 0 and o_custkey >= 0]", "select * from orders where false"),
    "or_same_key": ("@part/[p_size < 3 or p_size > 48]", "select * from part where p_size < 3 or p_size > 48"),
    "and_not_inside": ("@part/[p_size > 45 and not p_size = 50]", "select * from part where p_size > 45 and p_size <> 50"),
    "and_filters": ("@lineitem/[l_returnflag = R] and /[l_quantity <= 10]", "select * from lineitem where l_returnflag = 'R' and l_quantity <= 10"),
    "or_filters": ("@part/[p_size = 1] or /[p_size = 50]", "select * from part where p_size = 1 or p_size = 50"),
    "or_then_and": ("@part/[p_size = 1] or /[p_size = 50] and /[p_size = 2]", "select * from part where p_size = 1 or p_size = 50"),
    "and_then_or": ("@part/[p_size > 48] and /[p_size < 50] or /[p_size = 1]", "select * from part where (p_size > 48 and p_size < 50) or p_size = 1"),
    "grouping": ('@part/[p_size > 40] and (/[p_brand = "Brand#1"] or /[p_brand = "Brand#2"])', "select * from part where p_size > 40 and p_brand in ('Brand#1', 'Brand#2')"),
    "and_not": ('@orders/[o_orderstatus = F] and not /[o_orderpriority = "1-URGENT"]', "select * from orders where o_orderstatus = 'F' and not o_orderpriority = '1-URGENT'"),
    "or_not": ('@orders/[o_orderstatus = F] or not /[o_orderpriority = "1-URGENT"]', "select * from orders where o_orderstatus = 'F' or not o_orderpriority = '1-URGENT'"),
    "in": ("@part/[p_size in [1,5,9]]", "select * from part where p_size in (1, 5, 9)"),
    "not_in": ("@part/[p_size not in [1,5,9]]", "select * from part where p_size not in (1, 5, 9)"),
    "coerced_in": ('@part/[p_size in [1,"5"]]', "select * from part where p_size in (1, 5)"),
    "in_strings": ('@customer/[c_mktsegment in ["BUILDING","MACHINERY"]]', "select * from customer where c_mktsegment in ('BUILDING', 'MACHINERY')"),
    "regex": ('@documents/[text re "^E"]', "select * from documents where regexp_matches(text, '^E')"),
    "not_regex": ('@documents/[text not re "^[A-M]"]', "select * from documents where not regexp_matches(text, '^[A-M]')"),
    "regex_number": ('@orders/[o_orderkey re "^1.*7$"]', "select * from orders where regexp_matches(o_orderkey::varchar, '^1.*7$')"),
    "regex_empty": ('@customer/[c_mktsegment re ""]', "select * from customer where c_mktsegment = ''"),
    "prefix": ("@customer/[c_mktsegment ~ AUTO]", "select * from customer where starts_with(c_mktsegment, 'AUTO')"),
    "not_prefix": ("@customer/[c_mktsegment !~ AUTO]", "select * from customer where not starts_with(c_mktsegment, 'AUTO')"),
    "prefix_number": ("@orders/[o_orderkey ~ 14]", "select * from orders where starts_with(o_orderkey::varchar, '14')"),
    "prefix_empty": ('@nation/[n_name ~ ""]', "select * from nation"),
    "shortlex_gt": ("@customer/[c_mktsegment > HOUSEHOLD]", "select * from customer where (strlen(c_mktsegment), c_mktsegment) > (9, 'HOUSEHOLD')"),
    "shortlex_lte": ("@customer/[c_mktsegment <= MACHINERY]", "select * from customer where (strlen(c_mktsegment), c_mktsegment) <= (9, 'MACHINERY')"),
    "num_vs_text": ('@customer/[c_custkey = "42"]', "select * from customer where c_custkey = 42"),
    "num_vs_bool": ("@part/[p_size = true]", "select * from part where p_size <> 0"),
    "num_vs_null": ("@part/[p_size > null]", "select * from part"),
    "text_vs_num": ("@customer/[c_mktsegment > 5]", "select * from customer where c_mktsegment > '5'"),
    "text_vs_null": ("@customer/[c_mktsegment = null]", "select * from customer where c_mktsegment = ''"),
    "key_name": ("@nation/[* = n_name]", "select * from nation"),
    "key_regex": ('@nation/[* re "^n_"]', "select * from nation"),
    "key_name_missing": ("@nation/[* = other]", "select * from nation where false"),
    "key_value": ("@nation/[[* = n_name] = NATION_3]", "select * from nation where n_name = 'NATION_3'"),
    "key_prefix_value": ('@nation/[[* ~ "n_"] = 3]', "select * from nation where n_nationkey = 3 or n_regionkey = 3 or n_name = '3'"),
    "any_key": ("@nation/[** = 3]", "select * from nation where n_nationkey = 3 or n_regionkey = 3 or n_name = '3'"),
    "deep_key": ("@events/**/[k > 90]", "select event_id, ts, user_id, event_type, value, {'k': cast(json_extract(props, '$.k') as bigint)} as props from events where cast(json_extract(props, '$.k') as bigint) > 90"),
    "json_path": ("@events/props/[k > 90] | /event_id + /value", "select event_id, value from events where cast(json_extract(props, '$.k') as bigint) > 90"),
    "json_exists": ("@events/props/k | /event_id", "select event_id from events where json_extract(props, '$.k') is not null"),
    "star_step": ("@events/*/[k <= 3] | /event_id", "select event_id from events where cast(json_extract(props, '$.k') as bigint) <= 3"),
    "json_eq_object": ('@events/[props = {"k":7}] | /event_id', "select event_id from events where cast(json_extract(props, '$.k') as bigint) = 7"),
    "array_any": ("@embeddings/embedding/[** > 0.3] | /vec_id", "select vec_id from embeddings where len(list_filter(embedding, lambda x: x::double > 0.3)) > 0"),
    "array_index": ("@embeddings/embedding/3 | /vec_id", "select vec_id from embeddings where len(embedding) > 3"),
    "array_index_test": ("@embeddings/embedding/[3 > 0.1] | /vec_id", "select vec_id from embeddings where embedding[4]::double > 0.1"),
    "array_contains": ("@embeddings/[embedding ni 0.5] | /vec_id", "select vec_id from embeddings where list_contains(embedding, 0.5::float)"),
    "timestamp_range": ('@orders/[o_orderdate >= "1995-01-01" and o_orderdate < "1995-07-01"]', "select * from orders where o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1995-07-01'"),
    "pk": ("@orders/=42", "select * from orders where o_orderkey = 42"),
    "pk_list": ("@orders/=[3,1,2]", "select * from orders where o_orderkey in (1, 2, 3)"),
    "pk_list_repeats": ("@orders/=[3,1,3]", "select * from orders where o_orderkey in (1, 3) union all select * from orders where o_orderkey = 3"),
    "pk_placeholder": ("@orders/=:id", "select * from orders where o_orderkey = 7", (), {"id": "7"}),
    "placeholder_pos": ("@orders/[o_totalprice > :?] and /[o_orderstatus = :?]", "select * from orders where o_totalprice > 100000 and o_orderstatus = 'O'", (100000, "O"), {}),
    "placeholder_named": ("@orders/[o_totalprice > :min and o_totalprice < :max]", "select * from orders where o_totalprice > 1000 and o_totalprice < 9000", (), {"min": 1000, "max": 9000}),
    "placeholder_list": ("@part/[p_size in :sizes]", "select * from part where p_size in (2, 4)", (), {"sizes": [2, 4]}),
    "flagship": ("@orders/[o_totalprice > 100000] and /[o_orderstatus = F] | /{o_orderkey,o_totalprice}", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'F'"),
    "proj_fields": ("@customer/[c_acctbal < 0] | /{c_custkey,c_name}", "select c_custkey, c_name from customer where c_acctbal < 0"),
    "proj_plus": ("@customer/* | /c_custkey + /c_name", "select c_custkey, c_name from customer"),
    "proj_minus": ("@customer/* | all - /c_name - /c_mktsegment", "select c_custkey, c_nationkey, c_acctbal from customer"),
    "proj_plus_minus": ("@customer/* | /{c_custkey,c_name,c_acctbal} - /c_name", "select c_custkey, c_acctbal from customer"),
    "proj_nested": ("@events/[event_id < 100] | /event_id + /props/k", "select event_id, {'k': cast(json_extract(props, '$.k') as bigint)} as props from events where event_id < 100"),
    "proj_array_element": ("@embeddings/* | /vec_id + /embedding/0", "select vec_id, embedding[1:1] as embedding from embeddings"),
    "proj_missing": ("@region/* | /r_name + /nothing", "select r_name from region"),
    "proj_fields_ph": ("@customer/* | /:f + /:?", "select c_name, c_acctbal from customer", ("c_acctbal",), {"f": "c_name"}),
    "sort_asc": ("@customer/[c_acctbal > 5000] | asc /c_acctbal", "select * from customer where c_acctbal > 5000"),
    "sort_multi": ("@customer/* | asc /c_mktsegment desc /c_acctbal asc /c_custkey limit 25", "select * from customer order by c_mktsegment, c_acctbal desc, c_custkey limit 25"),
    "sort_placeholder": ("@customer/* | desc :f asc /c_custkey limit 7", "select * from customer order by c_acctbal desc, c_custkey limit 7", (), {"f": "/c_acctbal"}),
    "sort_nested": ("@events/* | /event_id | desc /props/k asc /event_id limit 20", "select event_id from events order by cast(json_extract(props, '$.k') as bigint) desc, event_id limit 20"),
    "topk": ("@orders/* | desc /o_totalprice asc /o_orderkey limit 10", "select * from orders order by o_totalprice desc, o_orderkey limit 10"),
    "skip_limit": ("@orders/* | desc /o_totalprice asc /o_orderkey skip 5 limit 10", "select * from orders order by o_totalprice desc, o_orderkey limit 10 offset 5"),
    "skip_only": ("@nation/* | asc /n_nationkey skip 20", "select * from nation order by n_nationkey offset 20"),
    "limit_zero": ("@nation/* | limit 0", "select * from nation"),
    "count": ("@lineitem/[l_discount > 0.05] | count", "select count(*) as count from lineitem where l_discount > 0.05"),
    "count_limit": ("@orders/* | limit 100 count", "select least(count(*), 100) as count from orders"),
    "count_skip": ("@orders/[o_orderstatus = F] | skip 10 count", "select greatest(count(*) - 10, 0) as count from orders where o_orderstatus = 'F'"),
    "default_order_limit": ("@orders/* | limit 5", "select * from orders order by o_orderkey desc limit 5"),
    "inverse_limit": ("@orders/* | inverse limit 5", "select * from orders order by o_orderkey limit 5"),
    "join_fields": (
        "@orders/[o_totalprice > 300000] | /{o_orderkey,o_custkey<customer} + /o_custkey/c_name",
        "select o_orderkey, {'c_name': c_name} as o_custkey from orders left join customer on o_custkey = c_custkey where o_totalprice > 300000",
    ),
    "join_exclude": (
        "@nation/* | /{n_nationkey,n_name,n_regionkey<region} - /n_regionkey/r_regionkey",
        "select n_nationkey, n_name, {'r_name': r_name} as n_regionkey from nation left join region on n_regionkey = r_regionkey",
    ),
    "join_multi": (
        "@lineitem/[l_quantity = 50] | /{l_orderkey,l_linenumber,l_partkey<part,l_suppkey<supplier} + /l_partkey/p_name + /l_suppkey/s_name",
        "select l_orderkey, l_linenumber, {'p_name': p_name} as l_partkey, {'s_name': s_name} as l_suppkey from lineitem left join part on l_partkey = p_partkey left join supplier on l_suppkey = s_suppkey where l_quantity = 50",
    ),
    "apply_shows": ('@orders/[o_orderstatus = F] | apply {"o_orderpriority":"DONE"} | /{o_orderkey,o_orderpriority}', "select o_orderkey, 'DONE' as o_orderpriority from orders where o_orderstatus = 'F'"),
    "upsert_shows": ('@region/[r_name = NOWHERE] | upsert {"r_name":"NOWHERE"}', "select cast(max(r_regionkey) + 1 as integer) as r_regionkey, 'NOWHERE' as r_name from region"),
    "timestamp_not": ('@orders/[o_orderdate > "no date"] or /[o_orderkey < 5]', "select * from orders where o_orderkey < 5"),
    "proj_star": ("@events/[event_id < 50] | /*/k", "select {'k': cast(json_extract(props, '$.k') as bigint)} as props from events where event_id < 50"),
    "array_contains_all": ("@embeddings/[embedding not ni 5] | /vec_id", "select vec_id from embeddings where not list_contains(embedding, 5::float)"),
    "array_equal": ("@embeddings/[embedding != [1,2]] | /vec_id", "select vec_id from embeddings where embedding <> [1, 2]::float[]"),
    "regex_filled": ('@customer/[c_mktsegment not re ""]', "select * from customer where c_mktsegment <> ''"),
    "text_above_null": ("@customer/[c_mktsegment > null]", "select * from customer where c_mktsegment <> ''"),
    "join_missing_collection": ("@orders/[o_orderkey < 50] | /{o_orderkey,o_custkey<nobody}", "select o_orderkey, o_custkey from orders where o_orderkey < 50"),
}

#: Changes as the collection after them.
CHANGES: dict[str, tuple] = {
    "apply_merge": ('@orders/[o_orderstatus = F] | apply {"o_orderpriority":"DONE"}', "select * replace (case when o_orderstatus = 'F' then 'DONE' else o_orderpriority end as o_orderpriority) from orders"),
    "apply_null": ('@orders/[o_orderstatus = F] | apply {"o_orderpriority":null}', "select * replace (case when o_orderstatus = 'F' then null else o_orderpriority end as o_orderpriority) from orders"),
    "apply_increment": ('@customer/[c_mktsegment = BUILDING] | apply [{"op":"increment","path":"/c_nationkey","value":100}]', "select * replace (case when c_mktsegment = 'BUILDING' then c_nationkey + 100 else c_nationkey end as c_nationkey) from customer"),
    "apply_replace": ('@part/=[1,2] | apply [{"op":"replace","path":"/p_size","value":99}]', "select * replace (case when p_partkey in (1, 2) then 99 else p_size end as p_size) from part"),
    "apply_placeholder": ("@part/[p_size = 1] | apply :p", "select * replace (case when p_size = 1 then 'X' else p_brand end as p_brand) from part", (), {"p": {"p_brand": "X"}}),
    "apply_page": ('@orders/* | apply {"o_orderstatus":"Z"} | desc /o_totalprice asc /o_orderkey limit 10', "select * replace (case when o_orderkey in (select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 10) then 'Z' else o_orderstatus end as o_orderstatus) from orders"),
    "apply_copy": ('@customer/[c_custkey < 40] | apply [{"op":"copy","from":"/c_name","path":"/c_mktsegment"}]', "select * replace (case when c_custkey < 40 then c_name else c_mktsegment end as c_mktsegment) from customer"),
    "apply_move": ('@customer/[c_custkey < 40] | apply [{"op":"move","from":"/c_nationkey","path":"/c_acctbal"}]', "select * replace (case when c_custkey < 40 then c_nationkey::double else c_acctbal end as c_acctbal, case when c_custkey < 40 then null else c_nationkey end as c_nationkey) from customer"),
    "apply_swap": ('@customer/[c_custkey < 40] | apply [{"op":"swap","from":"/c_name","path":"/c_mktsegment"}]', "select * replace (case when c_custkey < 40 then c_name else c_mktsegment end as c_mktsegment, case when c_custkey < 40 then c_mktsegment else c_name end as c_name) from customer"),
    "apply_test": ('@customer/[c_custkey = 7] | apply [{"op":"test","path":"/c_custkey","value":7},{"op":"replace","path":"/c_name","value":"seven"}]', "select * replace (case when c_custkey = 7 then 'seven' else c_name end as c_name) from customer"),
    "del": ("@orders/[o_orderstatus = F] | del", "select * from orders where not o_orderstatus = 'F'"),
    "del_page": ("@orders/* | del | asc /o_totalprice asc /o_orderkey limit 100", "select * from orders where o_orderkey not in (select o_orderkey from orders order by o_totalprice, o_orderkey limit 100)"),
    "upsert_insert": ('@region/[r_name = NOWHERE] | upsert {"r_name":"NOWHERE"}', "select * from region union all select cast(max(r_regionkey) + 1 as integer), 'NOWHERE' from region"),
    "upsert_patch": ('@region/[r_regionkey = 2] | upsert {"r_name":"SOMEWHERE"}', "select * replace (case when r_regionkey = 2 then 'SOMEWHERE' else r_name end as r_name) from region"),
}


def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.files import filtered

    return filtered(spark, tables(spark, sf_dir), "@orders/[o_totalprice > 200000] | /{o_orderkey,o_totalprice}", f"{sf_dir}/orders.parquet")


def _run(text: str, positional=(), named=None, change: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        q = PathQuery(text).bind(*positional, **(named or {}))
        t = tables(spark, sf_dir)
        return t.changed(q) if change else t.query(q)

    return run


def _documents(text: str, table: str):
    """The query over the table's rows as schemaless documents: ids, and the documents as canonical text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .operators.documents import query_documents

        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        docs = df.select(F.col(KEYS[table]).alias("id"), F.to_json(F.struct(*df.columns)).alias("doc"))
        return query_documents(docs, PathQuery(text).bound)

    return run


DOCUMENTS: dict[str, tuple[Callable, str]] = {
    "docs_filter": (_documents("/[p_size > 40] and /[p_brand = \"Brand#2\"] | count", "part"), "select count(*) as count from part where p_size > 40 and p_brand = 'Brand#2'"),
    "docs_wildcard": (_documents('/**/[[* = c_mktsegment] in ["BUILDING"]] | count', "customer"), "select count(*) as count from customer where c_mktsegment = 'BUILDING'"),
    "docs_keys": (_documents('/[[* ~ "n_"] = 3] | /n_nationkey', "nation"), """select n_nationkey as id, '{"n_nationkey":' || n_nationkey || '}' as doc from nation where n_nationkey = 3 or n_regionkey = 3 or n_name = '3'"""),
    "docs_star": (_documents("/*/[** > 0.3] | count", "embeddings"), "select count(*) as count from embeddings where len(list_filter(embedding, lambda x: x::double > 0.3)) > 0"),
    "docs_contains": (_documents("/[n_regionkey in [1,\"3\"]] and not /[n_name ni 3] | count", "nation"), "select count(*) as count from nation where n_regionkey in (1, 3)"),
    "docs_projection": (_documents("/[n_regionkey = 2] | /n_name", "nation"), "select n_nationkey as id, '{\"n_name\":\"' || n_name || '\"}' as doc from nation where n_regionkey = 2"),
    "docs_apply": (_documents('/[n_regionkey = 2] | apply [{"op":"remove","path":"/n_regionkey"},{"op":"remove","path":"/n_nationkey"}] | all', "nation"), "select n_nationkey as id, '{\"n_name\":\"' || n_name || '\"}' as doc from nation where n_regionkey = 2"),
    "docs_topk": (_documents("/* | /s_suppkey | desc /s_acctbal limit 5", "supplier"), "select s_suppkey as id, '{\"s_suppkey\":' || s_suppkey || '}' as doc from supplier order by s_acctbal desc limit 5"),
}


def _database(spark: SparkSession, sf_dir: str, *names: str):
    """A fresh database in the shared folder with whole tables as collections; ids are keys plus one, as an id is positive."""
    from .sources.database import Database

    db = Database(spark, f"{shared_folder(spark)}/database-{uuid.uuid4().hex}", "truncate")
    for name in names:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        db.load(name, df.select((F.col(KEYS[name]) + 1).cast("long").alias("id"), F.to_json(F.struct(*df.columns)).alias("doc")))
    return db


def _stored(*names: str):
    """A query over a database of these tables."""

    def made(f: Callable[[object, SparkSession], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(_database(spark, sf_dir, *names), spark)

    return made


def _lines(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@_stored("region")
def db_insert(db, spark):
    db.put("region", {"r_name": "NEW"})
    return db.query("@region/* | /r_name")


@_stored("region")
def db_replace(db, spark):
    db.put("region", {"r_name": "OTHER"}, 3)
    return db.query("@region/*  | /r_name")


@_stored("nation")
def db_get(db, spark):
    return _lines(spark, [(i, db.get("nation", i)["n_name"]) for i in (1, 7, 25)], "id long, n_name string")


@_stored("nation")
def db_delete(db, spark):
    db.delete("nation", 4)
    return db.query("@nation/* | /n_nationkey")


@_stored("nation")
def db_patch(db, spark):
    db.patch("nation", 4, {"n_name": None, "n_regionkey": 77})
    db.patch("nation", 5, [{"op": "increment", "path": "/n_regionkey", "value": 10}])
    return db.query("@nation/[n_nationkey < 5] | /n_regionkey")


@_stored("region")
def db_merge_or_put(db, spark):
    db.merge_or_put("region", 1, {"r_regionkey": None, "seen": True})
    db.merge_or_put("region", 50, {"r_name": "NEW"})
    return db.query("@region/* | all - /r_regionkey")


@_stored("region", "nation")
def db_collections(db, spark):
    db.rename_collection("region", "area")
    db.ensure_collection("none")
    db.remove_collection("nation")
    return _lines(spark, [(c["name"], c["rnum"]) for c in db.info()["collections"]], "name string, rnum long")


@_stored("customer")
def db_indexes(db, spark):
    db.ensure_index("customer", "/c_custkey", "integer", unique=True)
    db.ensure_index("customer", "/c_mktsegment", "string")
    db.ensure_index("customer", "/c_comment", "string")
    db.ensure_index("customer", "/c_nationkey", "float")
    db.remove_index("customer", "/c_nationkey", "float")
    return _lines(spark, [(i["path"], i["type"], i["unique"], i["rnum"]) for i in db.info()["collections"][0]["indexes"]], "path string, type string, unique boolean, rnum long")


@_stored("nation")
def db_unique(db, spark):
    from .errors import UniqueViolationError

    db.ensure_index("nation", "/n_name", "string", unique=True)
    said = []
    for value in ("NATION_3", "NOWHERE"):
        try:
            db.put("nation", {"n_name": value})
            said.append((value, "stored"))
        except UniqueViolationError:
            said.append((value, "refused"))
    return _lines(spark, [(v, s, db.count("@nation/* | count")) for v, s in said], "n_name string, said string, rows long")


@_stored("nation")
def db_backup(db, spark):
    from .errors import ReadOnlyError
    from .sources.database import Database

    to = f"{db.root}-copy"
    db.backup(to)
    db.delete("nation", 1)
    copy = Database(spark, to, "r")
    try:
        copy.put("nation", {})
        refused = False
    except ReadOnlyError:
        refused = True
    return copy.query("@nation/*").select("id", F.lit(refused).alias("refused"))


@_stored("supplier")
def db_index_filters(db, spark):
    db.ensure_index("supplier", "/s_nationkey", "integer")
    plan = db.explain("@supplier/[s_nationkey > 20]")
    return db.query("@supplier/[s_nationkey > 20] | /s_name").select("id", F.lit("SELECTED" in plan).alias("indexed"))


@_stored("nation")
def db_apply(db, spark):
    """Add_create and swap reach the stored documents."""
    db.count('@nation/[n_regionkey = 1] | apply [{"op":"add_create","path":"/at/zone","value":7},{"op":"swap","from":"/n_regionkey","path":"/n_nationkey"}]')
    return db.query("@nation/at/[zone = 7] | /{n_nationkey,n_regionkey}")


@_stored("nation")
def db_apply_projection(db, spark):
    """Documents come patched, then projected."""
    return db.query('@nation/[n_regionkey = 2] | apply {"n_name":"SAME"} | /n_name')


@_stored("region")
def db_upsert(db, spark):
    for _ in range(2):
        db.query('@region/[r_name = NOWHERE] | upsert {"r_name":"NOWHERE"}').count()
    return db.query("@region/* | /r_name")


@_stored("supplier")
def db_del(db, spark):
    """What a del returns is what it removed."""
    gone = db.query("@supplier/[s_nationkey < 12] | del | /s_suppkey")
    return gone.select("id", F.lit(db.count("@supplier/* | count")).cast("long").alias("left"))


@_stored("nation", "region")
def db_join(db, spark):
    db.count('@nation/* | apply [{"op":"increment","path":"/n_regionkey","value":1}]')
    return db.query("@nation/[n_nationkey < 10] | /{n_nationkey,n_regionkey<region} + /n_regionkey/r_name")


@_stored("nation", "region")
def db_join_wildcard(db, spark):
    """References behind a wildcard and inside arrays; one that finds nothing has no name to show."""
    db.put_all("trips", [{"stops": [{"at": 1}, {"at": 2}, {"at": 99}]}, {"stops": []}, {"stops": [{"at": 5}], "x": 1}])
    return db.query("@trips/* | /stops/*/at<region + /stops/*/at/r_name")


@_stored("part")
def db_paging(db, spark):
    """A page given beside the query takes the place of the query's own."""
    return db.query("@part/* | /p_partkey | asc /p_partkey skip 1 limit 5", skip=10, limit=20)


@_stored("nation")
def db_visit(db, spark):
    seen: list[tuple[int, int]] = []

    def visitor(i, doc):
        seen.append((len(seen), i))
        return -1 if len(seen) == 1 else 2 if len(seen) < 5 else 0

    db.visit("@nation/* | asc /n_nationkey", visitor)
    return _lines(spark, seen, "step long, id long")


@_stored("nation")
def db_placeholders(db, spark):
    q = db.prepare("@nation/[n_regionkey in :r and n_regionkey < :?] | /:f").bind(4, r=[1, 3, 4], f="n_name")
    return db.query(q)


@_stored("customer")
def db_explain(db, spark):
    db.ensure_index("customer", "/c_custkey", "integer", unique=True)
    said = {
        "index": "SELECTED UNIQUE|integer" in db.explain("@customer/[c_custkey > 10]"),
        "none": "[INDEX] NO" in db.explain("@customer/[c_name ~ A]"),
        "key": "[INDEX] PK" in db.explain("@customer/=1"),
        "off": "[INDEX] NO" in db.explain("@customer/[c_custkey > 10] | noidx"),
        "sorter": "SORTER" in db.explain("@customer/* | asc /c_name"),
    }
    return _lines(spark, list(said.items()), "name string, held boolean")


@_stored("region")
def db_printing(db, spark):
    from .lang.printer import to_text

    texts = ["/a   and not\n/b", "@c/[x eq 1]|count", "/a/[k !eq v] | asc /p skip 1"]
    return _lines(spark, [(t, to_text(PathQuery(t).tree)) for t in texts], "text string, printed string")


@_stored("region")
def db_values(db, spark):
    """Filters, patches and projections on single values."""
    q = PathQuery("/shelf/[row > 3]")
    patched = PathQuery('/* | apply {"row":9} | /row').apply_and_project({"row": 1, "x": 2})
    rows = [("match", str(q.matches({"shelf": {"row": 4}}))), ("miss", str(q.matches({"shelf": {"row": 3}}))), ("patched", str(patched["row"])), ("fields", str(len(patched)))]
    return _lines(spark, rows, "name string, value string")


@_stored("nation")
def db_errors(db, spark):
    from .errors import EngineError

    def said(f) -> str:
        try:
            f()
            return "none"
        except EngineError as e:
            return type(e).__name__

    rows = [
        ("parse", said(lambda: db.query("nation"))),
        ("document", said(lambda: db.get("nation", 900))),
        ("collection", said(lambda: db.get("nowhere", 1))),
        ("rename", said(lambda: db.rename_collection("nation", "nation"))),
        ("placeholder", said(lambda: db.query("@nation/[n_name = :x]"))),
        ("index", said(lambda: db.ensure_index("nation", "/x", "other"))),
    ]
    return _lines(spark, rows, "name string, error string")


@_stored("nation")
def db_commands(db, spark):
    """The lines that the command session answers."""
    from .sources.commands import Session

    s = Session(db)
    asked = ["a get nation 3", 'b add nation {"n_name":"X"}', "c patch nation 26 {\"z\":1}", "d query nation /[z = 1] | /z", "e del nation 26", "f @nation/* | count", "g idx nation integer+unique /n_nationkey", "h get nation 26", "i rmi nation integer /n_nationkey", "j rmc nation", "k @nation/* | count"]
    rows = [(k, n, line.split("ERROR")[0].strip() + (" ERROR" if "ERROR" in line else "")) for k, text in enumerate(asked) for n, line in enumerate(s.command(text))]
    return _lines(spark, rows, "asked long, n long, line string")


@_stored("region")
def db_requests(db, spark):
    """Status and answer of requests, the query's answer in chunks among them."""
    from .sources.commands import Requests

    r = Requests(db, token="t", anonymous_read=True)
    own = {"X-Access-Token": "t"}
    asked = [("GET", "/region/2", "", None), ("GET", "/region/90", "", None), ("POST", "/region", '{"r_name":"X"}', own), ("PUT", "/region/1", "{}", None), ("PATCH", "/region/6", '{"y":2}', own), ("POST", "/", "@region/[y = 2] | /y", own), ("POST", "/", "@region/* | count", None), ("DELETE", "/region/6", "", own), ("POST", "/", "@region/* | del", None), ("HEAD", "/region/3", "", None)]
    rows = []
    for k, (method, path, body, headers) in enumerate(asked):
        answer = r.handle(method, path, body, headers)
        rows.append((k, answer.status, answer.body.strip() if method == "POST" and answer.status == 200 else ""))
    return _lines(spark, rows, "asked long, status long, body string")


@_stored("nation")
def db_streamed(db, spark):
    """Documents fetched a partition at a time, and the first ones."""
    n = sum(1 for _ in db.stream("@nation/[n_regionkey = 1]"))
    text = sum(len(t) for _, t in db.raw("@nation/[n_nationkey = 3] | /n_name"))
    first = db.first("@nation/* | asc /n_nationkey")[0]
    return _lines(spark, [("stream", n), ("raw", text), ("first", first), ("first_n", len(db.first_n("@nation/*", 7))), ("count", db.count("@nation/* | count", limit=4)), ("update", db.update('@nation/[n_regionkey = 1] | apply {"z":1} | count'))], "name string, n long")


def _values(columns: str, *rows: str) -> str:
    return f"select * from (values {', '.join(rows)}) as t({columns})"


#: Queries over a database, with the SQL that says what is in it afterwards.
STORED: dict[str, tuple[Callable, str]] = {
    "db_insert": (db_insert, """select r_regionkey + 1 as id, '{"r_name":"' || r_name || '"}' as doc from region union all select max(r_regionkey) + 2, '{"r_name":"NEW"}' from region"""),
    "db_replace": (db_replace, """select r_regionkey + 1 as id, '{"r_name":"' || case when r_regionkey = 2 then 'OTHER' else r_name end || '"}' as doc from region"""),
    "db_get": (db_get, "select n_nationkey + 1 as id, n_name from nation where n_nationkey in (0, 6, 24)"),
    "db_delete": (db_delete, """select n_nationkey + 1 as id, '{"n_nationkey":' || n_nationkey || '}' as doc from nation where n_nationkey <> 3"""),
    "db_patch": (db_patch, """select n_nationkey + 1 as id, '{"n_regionkey":' || case n_nationkey when 3 then 77 when 4 then n_regionkey + 10 else n_regionkey end || '}' as doc from nation where n_nationkey < 5"""),
    "db_merge_or_put": (db_merge_or_put, """select r_regionkey + 1 as id, case when r_regionkey = 0 then '{"r_name":"' || r_name || '","seen":true}' else '{"r_name":"' || r_name || '"}' end as doc from region union all select 50, '{"r_name":"NEW"}'"""),
    "db_collections": (db_collections, "select 'area' as name, count(*) as rnum from region union all select 'none', 0"),
    "db_indexes": (db_indexes, "select '/c_custkey' as path, 'integer' as type, true as unique, count(*) as rnum from customer union all select '/c_mktsegment', 'string', false, count(*) from customer union all select '/c_comment', 'string', false, 0"),
    "db_unique": (db_unique, "select n_name, said, (select count(*) + 1 from nation) as rows from (values ('NATION_3', 'refused'), ('NOWHERE', 'stored')) as t(n_name, said)"),
    "db_backup": (db_backup, "select n_nationkey + 1 as id, true as refused from nation"),
    "db_index_filters": (db_index_filters, "select s_suppkey + 1 as id, true as indexed from supplier where s_nationkey > 20"),
    "db_apply": (db_apply, """select n_nationkey + 1 as id, '{"n_nationkey":1,"n_regionkey":' || n_nationkey || '}' as doc from nation where n_regionkey = 1"""),
    "db_apply_projection": (db_apply_projection, """select n_nationkey + 1 as id, '{"n_name":"SAME"}' as doc from nation where n_regionkey = 2"""),
    "db_upsert": (db_upsert, """select r_regionkey + 1 as id, '{"r_name":"' || r_name || '"}' as doc from region union all select max(r_regionkey) + 2, '{"r_name":"NOWHERE"}' from region"""),
    "db_del": (db_del, 'select s_suppkey + 1 as id, (select count(*) from supplier where s_nationkey >= 12) as "left" from supplier where s_nationkey < 12'),
    "db_join": (db_join, """select n_nationkey + 1 as id, '{"n_nationkey":' || n_nationkey || ',"n_regionkey":{"r_name":"' || r_name || '"}}' as doc from nation join region on n_regionkey = r_regionkey where n_nationkey < 10"""),
    "db_join_wildcard": (db_join_wildcard, """select 1 as id, '{"stops":[{"at":{"r_name":"' || (select r_name from region where r_regionkey = 0) || '"}},{"at":{"r_name":"' || (select r_name from region where r_regionkey = 1) || '"}}]}' as doc union all select 2, '{"stops":[]}' union all select 3, '{"stops":[{"at":{"r_name":"' || (select r_name from region where r_regionkey = 4) || '"}}]}'"""),
    "db_paging": (db_paging, """select p_partkey + 1 as id, '{"p_partkey":' || p_partkey || '}' as doc from part order by p_partkey limit 20 offset 10"""),
    "db_visit": (db_visit, _values("step, id", "(0, 1)", "(1, 1)", "(2, 3)", "(3, 5)", "(4, 7)")),
    "db_placeholders": (db_placeholders, """select n_nationkey + 1 as id, '{"n_name":"' || n_name || '"}' as doc from nation where n_regionkey in (1, 3)"""),
    "db_explain": (db_explain, _values("name, held", "('index', true)", "('none', true)", "('key', true)", "('off', true)", "('sorter', true)")),
    "db_printing": (db_printing, _values("text, printed", "('/a   and not' || chr(10) || '/b', '/a and not /b')", "('@c/[x eq 1]|count', '@c/[x = 1]' || chr(10) || '| count')", """('/a/[k !eq v] | asc /p skip 1', '/a/[k != "v"]' || chr(10) || '| asc /p' || chr(10) || '  skip 1')""")),
    "db_values": (db_values, _values("name, value", "('match', 'True')", "('miss', 'False')", "('patched', '9')", "('fields', '1')")),
    "db_errors": (db_errors, _values("name, error", "('parse', 'QueryParseError')", "('document', 'NotFoundError')", "('collection', 'CollectionNotFoundError')", "('rename', 'CollectionExistsError')", "('placeholder', 'UnsetPlaceholderError')", "('index', 'IndexMismatchError')")),
    "db_streamed": (db_streamed, "select 'stream' as name, count(*) as n from nation where n_regionkey = 1 union all select 'raw', strlen('{\"n_name\":\"NATION_3\"}') union all select 'first', 1 union all select 'first_n', 7 union all select 'count', 4 union all select 'update', count(*) from nation where n_regionkey = 1"),
    "db_commands": (db_commands, _values("asked, n, line", """(0, 0, 'a' || chr(9) || '3' || chr(9) || '{"n_nationkey": 2, "n_name": "NATION_2", "n_regionkey": 2}')""", "(1, 0, 'b' || chr(9) || '26')", "(2, 0, 'c' || chr(9) || '26')", """(3, 0, 'd' || chr(9) || '26' || chr(9) || '{"z":1}')""", "(3, 1, 'd')", "(4, 0, 'e' || chr(9) || '26')", "(5, 0, 'f' || chr(9) || '25')", "(6, 0, 'g')", "(7, 0, 'h ERROR')", "(8, 0, 'i')", "(9, 0, 'j')", "(10, 0, 'k' || chr(9) || '0')")),
    "db_requests": (db_requests, _values("asked, status, body", "(0, 200, '')", "(1, 404, '')", "(2, 200, '6')", "(3, 401, '')", "(4, 200, '')", """(5, 200, '6' || chr(9) || '{"y":2}')""", "(6, 200, '6')", "(7, 200, '')", "(8, 403, '')", "(9, 200, '')")),
}


def join_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that find nothing keep their values beside the joined rows."""
    t = tables(spark, sf_dir)
    few = t.collection("customer").df.where("c_custkey % 2 = 0")
    t.register("some", few, "c_custkey")
    return t.query("@orders/[o_totalprice > 100000] | /{o_orderkey,o_custkey<some} + /o_custkey/c_name", unresolved=True)


def join_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text that is no key finds nothing."""
    return tables(spark, sf_dir).query("@nation/* | /{n_nationkey,n_name<region}")


def join_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference inside a struct, and one that a wildcard names."""
    t = tables(spark, sf_dir)
    rows = t.collection("orders").df
    t.register("wrapped", rows.select("o_orderkey", F.struct("o_custkey", "o_orderstatus").alias("by")), "o_orderkey")
    return t.query("@wrapped/* | /o_orderkey + /by/o_custkey<customer + /by/o_custkey/c_name")


MORE: dict[str, tuple[Callable, str]] = {
    "join_unresolved": (join_unresolved, "select o_orderkey, case when c_custkey is not null then {'c_name': c_name} end as o_custkey, case when c_custkey is null then o_custkey end as o_custkey__ref from orders left join (select * from customer where c_custkey % 2 = 0) on o_custkey = c_custkey where o_totalprice > 100000"),
    "join_text_key": (join_text_key, "select n_nationkey, null::struct(r_regionkey integer, r_name varchar) as n_name from nation"),
    "join_nested": (join_nested, "select o_orderkey, {'o_custkey': case when c_custkey is not null then {'c_name': c_name} end} as \"by\" from orders left join customer on o_custkey = c_custkey"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {name: _run(x[0], *x[2:]) for name, x in SELECTS.items()}
    out |= {name: _run(x[0], *x[2:], change=True) if len(x) > 2 else _run(x[0], change=True) for name, x in CHANGES.items()}
    out |= {name: run for name, (run, _) in (DOCUMENTS | STORED | MORE).items()}
    return out | {"stream_filter": stream_filter}


def oracle_sql() -> dict[str, str]:
    out = {name: x[1] for name, x in (SELECTS | CHANGES).items()} | {name: sql for name, (_, sql) in (DOCUMENTS | STORED | MORE).items()}
    return out | {"stream_filter": "select o_orderkey, o_totalprice from orders where o_totalprice > 200000"}
