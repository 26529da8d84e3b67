"""DuckDB SQL for the queries of this subpackage that SQL can express."""

MIXING = r"""
with d as (
  select doc_id, source, coalesce(doc_id, -9223372036854775808) as id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '-') || ':'
                        || coalesce(text, '')), 1, 12))::bigint as h
  from documents),
s as (select source, sum(size) as source_size from d group by source),
w as (
  select *, case (row_number() over (order by source nulls last) - 1) % 3
              when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from s),
r as (select *, 3 * source_size as cap,
             row_number() over (order by 3.0::double * source_size / weight, source) as k from w),
p as (
  select *,
    coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0)
      as fixed,
    coalesce(sum(weight) over (order by k rows between unbounded preceding and 1 preceding), 0)
      as used
  from r),
levels as (
  select k, cap, weight, ((select sum(source_size) from s) - fixed)::double
            / ((select sum(weight) from w) - used) as level
  from p),
level as (select level from levels where level * weight <= cap order by k limit 1),
t as (select source, source_size,
             least(weight * coalesce((select level from level), 0), cap::double) as target from r),
u as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole
      from t),
v as (select *, target - whole * source_size as extra from u),
g as (select source, h, id, size, sum(size) as words from d group by all),
o as (
  select *, coalesce(sum(words) over (partition by source order by h, id, size
                     rows between unbounded preceding and 1 preceding), 0) as reached
  from g)
select d.doc_id, d.size::bigint as size, v.source_size::bigint as source_size, v.target,
  (d.size * (v.whole + case when v.source_size > 0 and 2 * o.reached + o.words <= 2 * v.extra
                            then 1 else 0 end))::bigint as taken
from d
join v on d.source is not distinct from v.source
join o on d.source is not distinct from o.source and d.h = o.h and d.id = o.id
  and d.size = o.size
"""

CHAT = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations
  union all
  select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                        (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e as (
  select *, length(text)
      + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', ''))
      + length(text) - length(replace(text, '[', '')) as body,
    length(role)
      + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', ''))
      + length(role) - length(replace(role, '[', '')) + length(role) - length(replace(role, '|', ''))
      as head
  from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), ''
         order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
         filter (role = 'assistant'), '')) as loss_sha256,
  sum(head + 5 + body + 8)::bigint as formatted_chars
from e group by conv_id
"""

NEAR_DUPLICATES = r"""
with recursive w as materialized (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as words
  from documents),
s as materialized (
  select doc_id, unnest(case
    when len(words) = 0 then []
    when len(words) = 1 then words
    else list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))
    end) as shingle
  from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as common
  from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id),
links as materialized (
  select u, v from pairs p join n x on x.doc_id = u join n y on y.doc_id = v
  where 100 * common >= 80 * (x.n + y.n - common)),
ways as materialized (select u, v from links union all select v, u from links),
reach(doc_id, seen) as (
  select doc_id, doc_id from documents
  union
  select ways.v, reach.seen from reach join ways on ways.u = reach.doc_id),
least as (select doc_id, min(seen) as component_id from reach group by doc_id)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id,
  doc_id = component_id as kept
from least left join n using (doc_id)
"""

LLM_ORACLE = {
    "op1_mixing": MIXING,
    "op5_near_duplicates": NEAR_DUPLICATES,
    "op10_chat_format": CHAT,
}
