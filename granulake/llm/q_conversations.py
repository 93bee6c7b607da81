"""Query of the conversation structure repair."""

from __future__ import annotations

from granulake.llm import conversations
from granulake.llm.registry import query, table

#: Damage, faults, then the cheapest edits row by row: each step keeps the least (cost, audit) of each state.
SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
  from conversations),
keyed as (
  select name, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(name, ''), lambda c: ascii(c)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 20 as fate
  from (select distinct name from named), crc),
damaged as (
  select conv_id, turn, case when fate = 4 then 'user' else role end as role,
    case when fate = 1 then '' when fate = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when fate = 3 then 2 else 1 end)) as copy
  from named join keyed using (name) where fate <> 0),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(length(role) || ':' || role || ':' || text), copy) as pos,
    regexp_replace(text, '[\x20\x09-\x0D]+$', '') as body
  from damaged),
counted as (select *, row_number() over (partition by conv_id, role, text order by pos) as seen from ordered),
rows_ as (
  select *, case when body = '' then 'blank' when seen > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    role[1] as initial, lag(role[1]) over (partition by conv_id order by pos) as before
  from counted),
steps(initial, p, q) as (values ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
states(p) as (values (0), (1), (2), (3)),
ins(p, q, c, a) as (values (0,0,0,''), (1,1,0,''), (2,2,0,''), (3,3,0,''), (0,2,2,'I'), (0,3,4,'II'), (1,2,2,'I'), (1,3,4,'II'), (2,3,2,'I'), (3,2,2,'I')),
edits as (
  select conv_id, pos, p, p as q, 3 as c, 'D' as a from rows_, states
  union all
  select conv_id, pos, p, q, (fault = 'truncated')::int, 'K' from rows_ join steps using (initial) where fault not in ('blank', 'duplicate')
  union all
  select conv_id, pos, p, q, 2 + (fault = 'truncated')::int, 'R' from rows_, steps where steps.initial <> 's' and fault not in ('blank', 'duplicate')),
path(conv_id, pos, st, best) as (
  select distinct conv_id, 0::bigint, q, {'c': c, 'a': a} from conversations, ins where p = 0
  union all
  select path.conv_id, path.pos + 1, i.q, min({'c': best.c + e.c + i.c, 'a': best.a || e.a || i.a})
  from path join edits e on e.conv_id is not distinct from path.conv_id and e.pos = path.pos + 1 and e.p = path.st join ins i on i.p = e.q
  group by path.conv_id, path.pos, i.q),
counts as (
  select conv_id, max(pos) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from rows_ group by conv_id),
parsed as (
  select counts.conv_id, min(best) as best from counts
  join path on path.conv_id is not distinct from counts.conv_id and pos = n and st in (0, 3) group by counts.conv_id),
letters as (
  select conv_id, i, best.a[i] as e from (select conv_id, best, unnest(range(1, length(best.a) + 1)) as i from parsed)),
placed as (
  select *, count(*) filter (e <> 'I') over w as pos, count(*) filter (e <> 'D') over w as nth
  from letters window w as (partition by conv_id order by i rows unbounded preceding)),
made as (
  select l.conv_id, l.i, l.e, l.nth, r.role, case when l.e = 'I' then '' else r.text end as text,
    max((l.nth = 1 and l.e = 'K' and r.initial = 's')::int) over (partition by l.conv_id) as shift
  from placed l left join rows_ r on r.conv_id is not distinct from l.conv_id and r.pos = l.pos and l.e <> 'I' where l.e <> 'D'),
told as (
  select conv_id, string_agg(case when e = 'K' then role when (nth - shift) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by i) as t
  from made group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counts on counts.conv_id is not distinct from c.conv_id
left join parsed on parsed.conv_id is not distinct from c.conv_id
left join told on told.conv_id is not distinct from c.conv_id"""


@query("op13_conversation_repair", SQL)
def op13(spark, sf_dir):
    """Faults of every conversation after the damage, the cheapest repair, and the repaired text's digest."""
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))
