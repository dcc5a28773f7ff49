"""DuckDB SQL for the corpus queries that SQL can express, each straight from the rule and without the operator's method."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
e as (select x, y from l union select y, x from l),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce((select min(y) from r where r.x = d.doc_id), d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce((select min(y) from r where r.x = d.doc_id), d.doc_id)) as kept
from d left join n using (doc_id)"""

OP3 = r"""
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(range(0, len(ls))) as line, unnest(ls) as v from t),
w as (select doc_id, line, regexp_extract_all(v, '[^\x20\x09-\x0D]+') as w from l),
k as (select doc_id, line, list_sort(list_distinct(w)) as s from w where len(w) > 0),
c as (select s, min(struct_pack(d := doc_id, l := line)) as f, len(s) as n from k group by s),
i as (select row_number() over (order by f) as id, s, f, n from c),
u as (select id, n, unnest(s) as g from i),
j as (select a.id as x, b.id as y, a.n as nx, b.n as ny, count(*) as c from u a join u b on a.g = b.g and a.id < b.id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
e as (select x, y from j where 100 * c >= 80 * (nx + ny - c)),
late as (select distinct y as id from e),
deg as (select id, count(*) as n_links from (select x as id from e union all select y from e) group by id),
o as (select k.doc_id, k.line, coalesce(deg.n_links, 0) as n_links, late.id is not null or i.f <> struct_pack(d := k.doc_id, l := k.line) as removed from k join i on k.s = i.s left join late on late.id = i.id left join deg on deg.id = i.id),
g as (select doc_id, count(*) filter (removed) as n_removed, coalesce(array_to_string(list_sort(list(line) filter (removed)), ','), '') as removed_lines, cast(sum(n_links) as bigint) as n_links from o group by doc_id)
select t.doc_id, cast(len(ls) as bigint) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed_lines, '') as removed_lines, coalesce(n_links, 0) as n_links from t left join g using (doc_id)"""

_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select distinct item_id, least(len(w), 8) as n, array_to_string(list_slice(w, i, least(i + 7, len(w))), ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) as i from b where len(w) > 0)),
ls as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ls where len(w) >= n)),
hit as (select doc_id, i, bw.n, item_id from dw join bw on dw.g = bw.g and dw.n = bw.n),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, sha256(array_to_string(list_sort(list(distinct cast(item_id as varchar))), ',')) as h from hit group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(h, sha256('')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join pos using (doc_id) left join it using (doc_id)"""

ORACLES: dict[str, str] = {"op1_minhash": OP1, "op3_line_dedup": OP3, "op10_decontamination": OP10}
