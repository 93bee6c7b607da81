"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from granulake.llm import jaccard
from granulake.llm.registry import query, table

#: Every document against every other by shared shingles, then the smallest id that links reach.
SQL = r"""
with recursive d as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
g as (
  select distinct doc_id, array_to_string(w[p:p + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as common
  from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * common >= 75 * (x.n + y.n - common)),
edges as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from d union select r.doc_id, e.b from reach r join edges e on e.a = r.other)
select doc_id, coalesce(n, 0) as n_shingles, component_id
from (select doc_id, min(other) as component_id from reach group by doc_id) left join n using (doc_id)"""


@query("op4_ngram_jaccard_join", SQL)
def op4(spark, sf_dir):
    """Shingle set size and component of every document."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))
