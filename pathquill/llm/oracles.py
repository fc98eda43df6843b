"""DuckDB SQL for the operators whose results SQL can express, over whole tables and whole texts."""

ORACLE_SQL = {
    "op1_embedding_near_dedup": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), link as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
), reach as (
  select vec_id as a, vec_id as b from embeddings
  union
  select reach.a, link.b from reach join link on reach.b = link.a
), component as (select a, min(b) as component_id from reach group by a),
degree as (select a, count(*) as n from link group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join component on component.a = vec_id left join degree on degree.a = vec_id
""",
    "op4_substring_dedup": r"""
with w as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents
), win as (
  select doc_id, i, array_to_string(ws[i:i + 34], ' ') as s from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w)
), twice as (select s from win group by s having count(*) > 1),
hit as (select distinct doc_id, unnest(range(i, i + 35)) as p from win join twice using (s)),
word as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from word anti join hit using (doc_id, p) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
""",
    "op5_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), item as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark
), item_window as (
  select distinct item_id, least(len(ws), 10) as n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') as s
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) as i from item where len(ws) > 0)
), doc_window as (
  select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') as s
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from item_window))
), found as (select doc_id, i, n, item_id from doc_window join item_window using (n, s)),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct doc_id, item_id::varchar as id from found) group by doc_id)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
""",
    "op10_suffix_dedup": """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (
  select doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) as s from (select doc_id, h, unnest(range(0, length(h) // 2 - 199)) as i from d)
), twice as (select s from win group by s having count(*) > 1),
start as (select doc_id, i from win join twice using (s)),
edge as (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 200, true) as fresh from start),
span as (select doc_id, min(i) as a, max(i) + 200 as b from (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as g from edge) group by doc_id, g),
gap as (
  select doc_id, b as a, coalesce(lead(a) over (partition by doc_id order by a), 1000000000) as b from span
  union all select doc_id, 0, min(a) from span group by doc_id
), kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as k from gap join d using (doc_id) group by doc_id),
total as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from span group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(k, h))) as kept_sha256
from d left join kept using (doc_id) left join total using (doc_id)
""",
}
