"""Log analytics: the normalised log table, its labels and flags, categories and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.operators import aggregates, categories, joins, logs, ordering
from granulake.plans import inputs
from granulake.plans.counting import uploads
from granulake.plans.registry import query
from granulake.session import cut

# What the log lines say, straight from the events they were made of (see inputs.log_lines_sql).
_A = "cast(event_id % 100 as varchar)"
_B = "cast(event_id % 100 + 5 as varchar)"
FACTS = f"""select event_id, event_id % 7 as m7, event_id % 6 as m6,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') as now, case when event_type = 'error' then 400 else 200 end as status,
  case when event_id % 5 = 0 then 'POST' else 'GET' end as method,
  case when event_id % 3 = 1 then 'eed-edsc-prod' when event_id % 3 = 2 then 'other' end as client_id,
  event_id % 9 = 0 as used_search_after, round(value * 100) as duration,
  case event_type when 'click' then '/search/granules.json' when 'view' then '/search/collections.umm_json'
    when 'purchase' then '/search/granules/timeline' when 'signup' then '/search/concepts/C1-P.iso19115' else '/search/x.php' end as uri,
  case event_type when 'click' then 'granules' when 'view' then 'collections' when 'purchase' then 'granules/timeline'
    when 'signup' then 'concepts' else 'PHP requests' end as concept,
  case event_type when 'click' then 'json' when 'view' then 'umm_json' when 'signup' then 'iso' end as format,
  case event_id % 4 when 0 then 'Python' when 1 then 'Web Browser' when 2 then 'Bot' else 'curl' end as user_agent_type,
  case when event_id % 6 = 0 then '2020-01-01T00:00:00Z,' when event_id % 6 = 1 then '2011-5' when event_id % 6 = 2 then '2021-02-03' end as time_query,
  case when event_id % 6 = 0 then 'params.temporal' when event_id % 6 = 1 then 'params.temporal.facet' when event_id % 6 = 2 then 'params.updated.since' end as time_type,
  case when event_id % 8 = 0 then 'PROV_A' when event_id % 8 = 1 then 'INVALID' when event_id % 8 = 2 then 'INVALID' end as provider,
  case when event_id % 10 = 0 then '-start_date,short_name' when event_id % 10 = 1 then '-start_date,provider,short_name' end as sort_key,
  case when event_id % 7 > 4 then cast(event_id % 5 * 600 as integer) end as page_size,
  case when event_id % 4 < 2 then cast(event_id % 12 as integer) end as page_num,
  case when event_id % 16 = 0 then '6 Near-Real-Time' when event_id % 16 = 4 then 'INVALID' when event_id % 4 = 0 then '006' end as version,
  case when event_id % 4 < 2 then concat('MOD', cast(event_id % 3 as varchar)) end as short_name,
  case when event_id % 4 < 2 then concat('C', cast(event_id % 21 as varchar), '-P') end as concept_id,
  case when event_id % 4 < 2 then 'MODIS' end as instrument,
  case event_id % 7 when 0 then concat('POLYGON ((', {_A}, ' 0, ', {_B}, ' 0, ', {_B}, ' ', cast(event_id % 13 + 1 as varchar), ', ',
        case when event_id % 3 = 0 then concat({_A}, ' 5, ') else '' end, {_A}, ' 0))')
    when 1 then 'MULTIPOLYGON (((-10 -10, 10 -10, 10 10, -10 10, -10 -10)), ((20 20, 30 20, 30 30, 20 30, 20 20)))'
    when 2 then 'POINT (-83 40)'
    when 4 then concat('POLYGON ((', x1, ' 0, ', x2, ' 0, ', x2, ' 10, ', x1, ' 10, ', x1, ' 0))') end as wkt,
  case event_id % 7 when 0 then 'POLYGON' when 1 then 'BBOX' when 2 then 'CIRCLE' when 3 then 'POINT' when 4 then 'BBOX' end as geo_type,
  case when event_id % 7 = 2 then 2000 end as circle_radius,
  case when event_id % 7 = 3 then 'POINT ERROR: Odd Coordinate Count' end as error,
  case event_id % 7 when 0 then case when event_id % 3 = 0 then 5 else 4 end when 1 then 10 when 2 then 1 when 4 then 5 end as vertex_count,
  case event_id % 7 when 0 then case when event_id % 3 = 0 then 12.5e0 + 2.5e0 * (event_id % 13 + 1) - 12.5e0 + 12.5e0 else 2.5e0 * (event_id % 13 + 1) end
    when 1 then 500e0 when 4 then (event_id % 17 + 1) * 10e0 end as polygon_area
from (select *, cast(event_id % 30 as varchar) as x1, cast(event_id % 30 + event_id % 17 + 1 as varchar) as x2 from events) e
where event_id % 50 <> 49"""


def log_table(spark, sf_dir, **options):
    return logs.log_table(inputs.log_lines(spark, sf_dir), "line", keep=("event_id",), **options)


def _columns(name: str, *columns: str, doc: str = "") -> None:
    """Register columns of the log table against the facts."""

    def plan(spark, sf_dir):
        return log_table(spark, sf_dir).select("event_id", *columns)

    plan.__doc__ = doc
    plan.__module__ = __name__
    query(name, f"select event_id, {', '.join(columns)} from ({FACTS}) facts")(plan)


_columns("uri_concept", "uri", "concept", doc="Endpoint of every request.")
_columns("uri_format", "uri", "format", doc="Format extension of every request.")
_columns("user_agent_type", "user_agent_type")
_columns("provider_clean", "provider")
_columns("version_clean", "version")
_columns("param_extract", "sort_key", "page_size", "page_num", "short_name", "concept_id", "instrument")
_columns("flag_search_after", "used_search_after")
_columns("time_query_unify", "time_query", "time_type")
_columns("spatial_unify", "wkt", "geo_type", "circle_radius", "error")
_columns("log_table", "now", "status", "method", "client_id", "duration", "concept", "format", "wkt", "error")


@query(
    "coalesce_params",
    f"""select event_id, sort_key as first, concat_ws(';', case when event_id % 8 = 0 then 'PROV_A' end, case when event_id % 8 = 2 then 'P3 x' end,
          case when event_id % 8 = 1 then 'P1,P2' end) as every from ({FACTS}) facts""",
)
def coalesce_params(spark, sf_dir):
    """First matching parameter, and all matching parameters as one text."""
    fields = logs.with_params(logs.events(inputs.log_lines(spark, sf_dir), "line"))
    return fields.select(
        "event_id",
        logs.first_param(logs.NAMES["sort_key"]).alias("first"),
        logs.all_params(logs.NAMES["provider"]).alias("every"),
    )


@query("facet_date", f"select event_id, case when m6 = 1 then '2011-5' end as facet from ({FACTS}) facts")
def facet_date(spark, sf_dir):
    fields = logs.with_params(logs.events(inputs.log_lines(spark, sf_dir), "line"))
    return fields.select("event_id", logs.facet_date().alias("facet"))


@query(
    "client_group",
    f"select case when client_id like 'eed-edsc%' then 'Earthdata Search' else client_id end as client, count(*) as n from ({FACTS}) f group by 1",
)
def client_group(spark, sf_dir):
    clients = log_table(spark, sf_dir).select(logs.client_group(F.col("client_id")).alias("client"))
    return aggregates.count_by(clients, "client")


@query(
    "time_type_label",
    f"""select case time_type when 'params.temporal' then 'temporal' when 'params.temporal.facet' then 'temporal.facet'
          else 'updated.since' end as label, count(*) as n from ({FACTS}) f where time_type is not null group by 1""",
)
def time_type_label(spark, sf_dir):
    typed = log_table(spark, sf_dir).where(F.col("time_type").isNotNull())
    return aggregates.count_by(typed.select(logs.time_type_label(F.col("time_type")).alias("label")), "label")


@query(
    "bool_flags",
    f"""select event_id, geo_type is not null as spatial_bool, time_query is not null as temporal_bool, sort_key is not null as sort_bool
        from ({FACTS}) f""",
)
def bool_flags(spark, sf_dir):
    return categories.with_flags(log_table(spark, sf_dir)).select("event_id", "spatial_bool", "temporal_bool", "sort_bool")


@query(
    "prov_coll",
    f"""select event_id, case when provider is not null and concept_id is not null then 'Both' when provider is not null then 'Provider'
          when concept_id is not null then 'Collection' else '' end as prov_coll from ({FACTS}) f""",
)
def prov_coll(spark, sf_dir):
    return categories.with_flags(log_table(spark, sf_dir)).select("event_id", "prov_coll")


@query(
    "sort_count",
    f"select event_id, case when event_id % 10 = 0 then 2 when event_id % 10 = 1 then 3 end as sort_count from ({FACTS}) f",
)
def sort_count(spark, sf_dir):
    return categories.with_flags(log_table(spark, sf_dir)).select("event_id", "sort_count")


@query("log_measures", f"select event_id, vertex_count, round(polygon_area, 6) as polygon_area from ({FACTS}) f")
def log_measures(spark, sf_dir):
    """Vertex count of every query shape, area of polygons and boxes."""
    measured = categories.with_measures(log_table(spark, sf_dir))
    return inputs.rounded(measured.select("event_id", "vertex_count", "polygon_area"), "polygon_area")


_RANKED = f"""facts as ({FACTS}),
  vertex_ranks as (select vertex_count, round(sum(sum(case when geo_type = 'POLYGON' then 1 else 0 end)) over (order by vertex_count)
      / (select count(*) from facts where geo_type = 'POLYGON' and wkt is not null)::double, 6) as vertex_pctile
    from facts where vertex_count is not null group by vertex_count),
  area_ranks as (select polygon_area, sum(count(*)) over (order by polygon_area) / (select count(polygon_area) from facts)::double as area_pctile
    from facts where polygon_area is not null group by polygon_area),
  cats as (select f.*, vertex_pctile, area_pctile, concat(cast(geo_type is not null as integer), cast(time_query is not null as integer),
      cast(sort_key is not null as integer), cast(coalesce(area_pctile, 0) > 0.99 as integer), cast(coalesce(vertex_pctile, 0) > 0.99 as integer)) as test_cat
    from facts f left join vertex_ranks using (vertex_count) left join area_ranks using (polygon_area))"""


def categorised(spark, sf_dir):
    return categories.categorise(log_table(spark, sf_dir))


@query(
    "log_ranks",
    f"with {_RANKED} select event_id, vertex_pctile, round(area_pctile, 9) as area_pctile from cats",
)
def log_ranks(spark, sf_dir):
    measured = cut(categories.with_measures(log_table(spark, sf_dir)), "measured")
    ranked = categories.with_ranks(measured)
    return inputs.rounded(ranked.select("event_id", "vertex_pctile", "area_pctile"), "area_pctile", digits=9)


@query("category_code", f"with {_RANKED} select event_id, test_cat from cats where concept = 'granules'")
def category_code(spark, sf_dir):
    return categorised(spark, sf_dir).select("event_id", "test_cat")


@query(
    "category_expand",
    f"""with {_RANKED} select event_id, substr(test_cat, 1, 1) = '1' as "Spatial", substr(test_cat, 2, 1) = '1' as "Temporal",
          substr(test_cat, 3, 1) = '1' as "Sort", substr(test_cat, 4, 1) = '1' as "Area99", substr(test_cat, 5, 1) = '1' as "Vertex99"
        from cats where concept = 'granules'""",
)
def category_expand(spark, sf_dir):
    return categories.expand(categorised(spark, sf_dir)).select("event_id", *categories.FLAG_NAMES)


_PERCENTILES = f"""{_RANKED}, p as (select test_cat, count(duration) as n, round(quantile_cont(duration, 0.5), 6) as p50,
  round(quantile_cont(duration, 0.95), 6) as p95, round(quantile_cont(duration, 0.99), 6) as p99 from cats where concept = 'granules' group by 1)"""


def percentiles(spark, sf_dir):
    found = categories.duration_percentiles(categorised(spark, sf_dir))
    return inputs.rounded(found, "p50", "p95", "p99")


@query("multi_key_join", f"with {_PERCENTILES} select * from p")
def multi_key_join(spark, sf_dir):
    """Counts and three percentiles per category: one aggregate in place of three keyed joins."""
    return percentiles(spark, sf_dir)


@query("category_percentiles_slowest", f"with {_PERCENTILES} select test_cat, p95 from p order by p95 desc, test_cat limit 5")
def category_percentiles_slowest(spark, sf_dir):
    found = percentiles(spark, sf_dir).select("test_cat", "p95")
    return ordering.sort_limit(found, [F.desc("p95"), "test_cat"], 5)


_SUITE = "suite as (select * from (values " + ", ".join(
    f"('{name}', '{code}')" for name, code in categories.SUITE_CATEGORIES.items()
) + ") s(test_type, test_cat))"


@query("right_join_suite", f"with {_PERCENTILES}, {_SUITE} select test_cat, n, p50, p95, p99, test_type from p right join suite using (test_cat)")
def right_join_suite(spark, sf_dir):
    return categories.suite_percentiles(percentiles(spark, sf_dir))


@query("anti_join", f"with {_PERCENTILES}, {_SUITE} select * from p where test_cat not in (select test_cat from suite)")
def anti_join(spark, sf_dir):
    """Categories of the log that the suite does not cover."""
    return categories.not_in_suite(percentiles(spark, sf_dir))


@query("semi_join_suite", f"with {_PERCENTILES}, {_SUITE} select * from p where test_cat in (select test_cat from suite)")
def semi_join_suite(spark, sf_dir):
    return categories.in_suite(percentiles(spark, sf_dir))


@query(
    "coverage_ratio",
    f"""with {_PERCENTILES}, {_SUITE}, t as (select sum(n) as total, sum(n) filter (where test_cat <> '00000') as busy,
          coalesce(sum(n) filter (where test_cat in (select test_cat from suite)), 0) as covered from p),
          top as (select sum(n) as heading from (select n from p order by n desc, test_cat limit 7) x)
        select round(covered / total::double, 9) as suite_share, round(covered / busy::double, 9) as suite_share_non_trivial,
          round(heading / total::double, 9) as top_share from t, top""",
)
def coverage_ratio(spark, sf_dir):
    shares = categories.coverage(categorised(spark, sf_dir))
    return inputs.rounded(shares, *shares.columns, digits=9)


@query(
    "upload_vs_parsed",
    f"""select (select count(*) from events where event_id % 11 = 0) as uploaded,
          (select count(*) from ({FACTS}) f where geo_type is not null) as parsed""",
)
def upload_vs_parsed(spark, sf_dir):
    counted = logs.shapefile_uploads(spark, f"{uploads(spark, sf_dir)}/prod-app*", "search.services.query-service")
    return categories.upload_vs_parsed(log_table(spark, sf_dir), counted)


@query(
    "vertex_histogram_by_geo_type",
    f"""select case when v <= 1 then 1 when v <= 2 then 2 when v <= 3 then 3 when v <= 4 then 4 when v <= 5 then 5 else 6 end as bin,
          count(*) as n_all, count(*) filter (where geo_type = 'POLYGON') as n_polygon, count(*) filter (where geo_type = 'BBOX') as n_bbox
        from (select vertex_count as v, geo_type from ({FACTS}) f where vertex_count is not null) t group by 1""",
)
def vertex_histogram_by_geo_type(spark, sf_dir):
    measured = categories.with_measures(log_table(spark, sf_dir))
    return aggregates.histogram_by(measured, "vertex_count", aggregates.VERTEX_BREAKS, "geo_type", ["POLYGON", "BBOX"])


@query(
    "log_updates",
    f"with {_RANKED} select event_id, vertex_count, vertex_pctile from cats where geo_type is not null",
)
def log_updates(spark, sf_dir):
    """Columns of a ranked copy written back into the log table by id."""
    measured = cut(categories.with_measures(log_table(spark, sf_dir)), "measured")
    table = measured.where(F.col("geo_type").isNotNull()).select("event_id")
    ranked = categories.with_ranks(measured)
    return joins.update_from(table, ranked, "event_id", ["vertex_count", "vertex_pctile"])
