"""DuckDB SQL of the queries, written from their definitions alone."""

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE: dict[str, str] = {}

ORACLE["op2_line_dedup"] = f"""
with l as (
  select doc_id, generate_subscripts(a, 1) as pos, unnest(a) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents)),
k as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UP}', '{LOW}') as key
  from l),
r as (
  select key, max(doc_id) as keeper from k where length(key) >= 20
  group by key having count(distinct doc_id) >= 3),
d as (
  select k.doc_id, k.pos, k.line, r.key is not null and k.doc_id <> r.keeper as gone
  from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from d group by doc_id"""

_WORDS8 = f"""
  select id, generate_subscripts(a, 1) as pos, unnest(a) as w, len(a) as n from (
    select id, list_filter(regexp_split_to_array(translate(text, '{UP}', '{LOW}'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as a from {{src}})"""

ORACLE["op8_winnowing_decontamination"] = f"""
with dw as ({_WORDS8.format(src="(select doc_id as id, text from documents)")}),
iw as ({_WORDS8.format(src="(select item_id as id, text from benchmark)")}),
spans as (select distinct least(n, 10) as k from iw),
ig as (
  select id, k, string_agg(w, ' ') over (partition by id, k order by pos rows between current row and 9 following)
    as g, pos, n from iw, spans where least(n, 10) = k),
ig2 as (select distinct id, k, g from ig where pos + k - 1 <= n),
dg as (
  select id, pos, n, string_agg(w, ' ') over (partition by id order by pos rows between current row and 9 following)
    as g from dw),
short as (
  select d.id, d.pos, d.k, string_agg(e.w, ' ' order by e.pos) as g
  from (select id, pos, n, k from dw, spans where k < 10 and pos + k - 1 <= n) d
  join dw e on e.id = d.id and e.pos between d.pos and d.pos + d.k - 1 group by all),
occ as (
  select d.id as doc, d.pos, 10 as k, i.id as item from dg d join ig2 i on i.g = d.g and i.k = 10 where d.pos + 9 <= d.n
  union all
  select d.id, d.pos, d.k, i.id from short d join ig2 i on i.g = d.g and i.k = d.k),
hit as (select doc, count(distinct p) as n_hit from (select doc, unnest(range(pos, pos + k)) as p from occ) group by doc),
its as (
  select doc, count(*) as n_items, string_agg(s, ',' order by s) as ids
  from (select distinct doc, item::varchar as s from occ) group by doc),
nw as (select id, count(*) as n_words from dw group by id)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from documents d left join nw on nw.id = d.doc_id left join hit on hit.doc = d.doc_id left join its on its.doc = d.doc_id"""

# Blanks are 0x20 and 0x09-0x0D.
_WORDS1 = """
  select doc_id, generate_subscripts(a, 1) as pos, unnest(a) as w, len(a) as n from (
    select doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as a
    from documents)"""

ORACLE["op1_substring_dedup"] = f"""
with w as ({_WORDS1}),
g as (
  select doc_id, pos, n, string_agg(w, ' ') over (partition by doc_id order by pos
         rows between current row and 12 following) as g from w),
g2 as (select doc_id, pos, min(doc_id) over (partition by g) as least from g where pos + 12 <= n),
cut as (select distinct doc_id, unnest(range(pos, pos + 13)) as pos from g2 where least < doc_id),
k as (select w.*, cut.pos is not null as gone from w left join cut on cut.doc_id = w.doc_id and cut.pos = w.pos)
select d.doc_id, count(k.pos) as n_words, count(*) filter (gone) as n_removed,
       sha256(coalesce(string_agg(w, ' ' order by k.pos) filter (not gone), '')) as kept_sha256
from documents d left join k on k.doc_id = d.doc_id group by d.doc_id"""

ORACLE["op3_jaccard_join"] = f"""
with recursive w as ({_WORDS1.replace("(text,", f"(translate(text, '{UP}', '{LOW}'),")}),
g as (
  select doc_id, pos, n, string_agg(w, ' ') over (partition by doc_id order by pos
         rows between current row and 3 following) as g from w),
s as (select distinct doc_id, g from g where pos + least(n, 4) - 1 <= n),
z as (select doc_id, count(*) as n from s group by doc_id),
l as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
  join z x on x.doc_id = a.doc_id join z y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on l.a = r.b)
select d.doc_id, coalesce(z.n, 0) as n_shingles, c.component_id
from documents d left join z on z.doc_id = d.doc_id
join (select a, min(b) as component_id from r group by a) c on c.a = d.doc_id"""

_WORDS12 = _WORDS8.format(src="(select {id} as id, text from {table})")
_BUCKETS = 10000

ORACLE["op12_importance_resampling"] = f"""
with t as (
  select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as crc),
dw as ({_WORDS12.format(id="doc_id", table="documents")}),
bw as ({_WORDS12.format(id="item_id", table="benchmark")}),
w as (select distinct w from (select w from dw union all select w from bw)),
h as (
  select w, xor(list_reduce(list_transform(range(1, strlen(w) + 1), lambda i: ('0x' || hex(encode(w))[2 * i - 1:2 * i])::bigint),
    lambda c, b: xor(c >> 8, t.crc[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295) % {_BUCKETS} as bucket
  from w, t),
s as (select bucket, count(*) as s from dw join h using (w) group by bucket),
u as (select bucket, count(*) as t from bw join h using (w) group by bucket),
a as (select (select count(*) from dw) as ss, (select count(*) from bw) as tt),
g as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (ss + {_BUCKETS})::double
         / ((coalesce(s, 0) + 1)::double * (tt + {_BUCKETS})::double)))::bigint as gain
  from (select bucket, s, t from s full join u using (bucket)), a),
f as (select id, count(*) as n, floor(sum(gain) / count(*))::bigint as weight from dw join h using (w) join g using (bucket) group by id),
d as (
  select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
         ('0x' || sha256('2024:' || doc_id)[1:8])::bigint as h
  from documents left join f on f.id = doc_id),
e as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from d),
r as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n from e where n_features >= 20)
select e.doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end as rank
from e left join r on r.doc_id = e.doc_id"""

_NEAREST = """
{a} as (
  select vec_id, p, e, d from (
    select x.vec_id, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) as d,
           row_number() over (partition by x.vec_id, x.p order by sum((x.v - c.v) * (x.v - c.v)), c.e) as k
    from x join {c} c on c.p = x.p and c.i = x.i group by x.vec_id, x.p, c.e) where k = 1)"""

_MEANS = """
{new} as (
  select c.p, c.e, c.i, coalesce(m.v, c.v) as v
  from {old} c left join (
    select x.p, a.e, x.i, floor(sum(x.v) / count(*)::double)::bigint as v
    from x join {a} a on a.vec_id = x.vec_id and a.p = x.p group by x.p, a.e, x.i) m on m.p = c.p and m.e = c.e and m.i = c.i)"""

ORACLE["op13_vector_codes"] = f"""
with k as (
  select vec_id, label, list_transform(embedding, lambda z: floor(256 * z::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0),
y as (select vec_id, unnest(v) as v, generate_subscripts(v, 1) - 1 as j, len(v) // 16 as width from k),
x as (select vec_id, (j // width) as p, (j % width) as i, v from y),
first as (select vec_id, row_number() over (order by vec_id) - 1 as e from k order by vec_id limit 64),
c0 as (select p, e, i, v from x join first using (vec_id)),
{_NEAREST.format(a="a0", c="c0")},
{_MEANS.format(new="c1", old="c0", a="a0")},
{_NEAREST.format(a="a1", c="c1")},
{_MEANS.format(new="c2", old="c1", a="a1")},
{_NEAREST.format(a="a2", c="c2")},
r as (
  select k.vec_id, k.label, string_agg(lower(lpad(to_hex(e), 2, '0')), '' order by p) as code, sum(d)::bigint as error
  from k join a2 on a2.vec_id = k.vec_id group by k.vec_id, k.label)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(v::varchar, ',' order by p, e, i)) from c2) as codebooks_sha256
from r"""
