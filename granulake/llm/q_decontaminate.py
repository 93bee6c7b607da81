"""Query of benchmark decontamination."""

from __future__ import annotations

from granulake.llm import decontaminate
from granulake.llm.registry import query, table

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

SQL = f"""
with d as (select row_number() over () as k, doc_id, {_WORDS} as w from documents),
i as (select item_id, {_WORDS} as w from benchmark),
iw as (
  select distinct item_id, array_to_string(w[p:p + 9], ' ') as g, least(len(w), 10) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (
  select k, p, n, array_to_string(w[p:p + n - 1], ' ') as g
  from (select k, w, n, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n)),
hits as (select dw.k, dw.p, dw.n, iw.item_id from dw join iw on dw.g = iw.g and dw.n = iw.n),
covered as (select k, count(distinct q) as n_hit from (select k, unnest(range(p, p + n)) as q from hits) group by k),
named as (
  select k, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct k, cast(item_id as varchar) as item from hits) group by k)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (k) left join named using (k)"""


@query("op6_benchmark_decontamination", SQL)
def op6(spark, sf_dir):
    """Every document against every test item: hit words, items and contamination."""
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)
