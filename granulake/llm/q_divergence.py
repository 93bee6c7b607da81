"""Query of the source divergence audit."""

from __future__ import annotations

from granulake.llm import divergence
from granulake.llm.registry import query, table

#: Every term of every group with its share, then the distances of sources and the terms above the language.
SQL = r"""
with d as (
  select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
g as (select distinct lang, source from d),
t as (select doc, lang, source, unnest(w) as term from d),
kept as (select lang, term from t group by 1, 2 having count(distinct doc) >= 30),
c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by 1, 2, 3),
v as (select lang, count(*) as v from kept group by 1),
size as (select lang, source, sum(n) as size from c group by 1, 2),
whole as (select lang, sum(n) as size from c group by 1),
p as (
  select lang, source, term, coalesce(n, 0) as n,
    1 + (1000000000::hugeint * (coalesce(n, 0) + 5)) // (coalesce(size, 0) + 5 * v) as p
  from g join kept using (lang) join v using (lang) left join c using (lang, source, term) left join size using (lang, source)),
q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (any_value(whole.size) + 5 * any_value(v)) as q
  from c join whole using (lang) join v using (lang) group by 1, 2),
far as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, (p - q)::bigint as value
  from p join q using (lang, term) where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 50"""


@query("op11_source_divergence", SQL)
def op11(spark, sf_dir):
    """Distances between the sources of a language, and the terms that a source has more of than its language."""
    return divergence.audit(table(spark, sf_dir, "documents"))
