"""SQL (DuckDB) for the operators that SQL can express, over whole tables."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

OP8 = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '{_WORD}') as w from documents),
s as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, coalesce(len(s), 0) as n from s),
e as (select doc_id, unnest(s) as s from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 80 * (na.n + nb.n - i)),
r as (select a, a as b from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, least(a, min(b)) as c from r group by 1)
select n.doc_id, cast(n.n as bigint) as n_shingles, coalesce(c.c, n.doc_id) as component_id from n left join c on c.a = n.doc_id
"""

OP1 = rf"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents),
t as (select doc_id, no, line, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}'))) as w from l),
k as (select w, min(doc_id * 1000000 + no) as first, len(w) as n, row_number() over (order by w) as id from t where len(w) > 0 group by w),
e as (select id, n, first, unnest(w) as x from k),
p as (select a.id, a.n as na, b.n as nb, count(*) as i from e a join e b on a.x = b.x and b.first < a.first and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n group by a.id, b.id, a.n, b.n),
late as (select distinct id from p where 5 * i >= 4 * (na + nb - i)),
m as (select t.doc_id, t.no, t.line, len(t.w) > 0 and (k.first <> t.doc_id * 1000000 + t.no or late.id is not null) as gone from t left join k on k.w = t.w left join late on late.id = k.id)
select d.doc_id, any_value(case when d.text is null then null else coalesce(c.kept, '') end) as text, cast(any_value(case when d.text is null then 0 else len(string_split(d.text, chr(10))) end) as bigint) as n_lines, cast(any_value(coalesce(c.n_removed, 0)) as bigint) as n_removed
from documents d left join (select doc_id, string_agg(line, chr(10) order by no) filter (where not gone) as kept, count(*) filter (where gone) as n_removed from m group by 1) c using (doc_id) group by 1
"""

OP13 = r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
k as (select *, ('0x' || h[1:8])::bigint % (n + 1) as c1, ('0x' || h[9:16])::bigint % (n + 1) as c2, ('0x' || h[17:24])::bigint % 100 as c3, ('0x' || h[25:32])::bigint % 100 as c4 from d),
f as (select *, least(c1, c2) as a, greatest(c1, c2) as b, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or c3 >= 90 then 'plain' when c4 < 20 then 'spm' else 'psm' end as form from k),
p as (select *, substr(t, 1, a) as x, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from f),
o as (select *, case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || x || '<M>' || m end as o from p),
r as (select *, string_split_regex(o, '<P>|<S>|<M>') as q from o)
select doc_id, n, form, case when form <> 'plain' then length(x) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars, sha256(o) as output_sha256,
sha256(case form when 'plain' then o when 'psm' then q[2] || q[4] || q[3] else q[3] || q[4] || q[2] end) as restored_sha256 from r
"""

ORACLE_SQL = {"op1_line_dedup": OP1, "op8_ngram_jaccard_join": OP8, "op13_fill_in_middle": OP13}
