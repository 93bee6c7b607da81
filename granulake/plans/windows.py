"""Positions, distributions, load windows, time slices and I/O profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.functions import profiles, times
from granulake.operators import layout, ordering
from granulake.plans import inputs
from granulake.plans.inputs import using
from granulake.plans.registry import query


@query("row_ids", using("granules") + "select GranuleUR, row_number() over (order by StartTime, GranuleUR) as id from granules")
def row_ids(spark, sf_dir):
    """Ids along the time order, without a single-task window."""
    g = inputs.granules(spark, sf_dir).select("GranuleUR", "StartTime")
    return ordering.row_positions(g, ["StartTime", "GranuleUR"]).drop("StartTime")


@query(
    "rank_in_file",
    using("granules") + "select GranuleUR, CollectionConceptId, rank from (select *, row_number() over (partition by CollectionConceptId order by StartTime desc, GranuleUR) as rank from granules) t where rank <= 7",
)
def rank_in_file(spark, sf_dir):
    """Newest seven granules of every collection with their rank."""
    g = inputs.granules(spark, sf_dir).select("GranuleUR", "CollectionConceptId", "StartTime")
    top = ordering.top_k_per_group(g, ["CollectionConceptId"], [F.desc("StartTime"), "GranuleUR"], 7, rank="rank")
    return top.drop("StartTime").withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "adjacent_compare",
    using("granules") + "select GranuleUR, lag(MBRWest) over (order by GranuleUR) as prev_MBRWest from granules",
)
def adjacent_compare(spark, sf_dir):
    g = inputs.granules(spark, sf_dir).select("GranuleUR", "MBRWest")
    return ordering.with_previous(g, ["GranuleUR"], ["MBRWest"]).drop("MBRWest")


@query(
    "ecdf_percentile",
    using("granule_shapes") + "select GranuleUR, shape_no, area, round(cume_dist() over (order by area), 9) as pctile from granule_shapes",
)
def ecdf_percentile(spark, sf_dir):
    rows = inputs.granule_shapes(spark, sf_dir).select("GranuleUR", "shape_no", "area")
    return inputs.rounded(ordering.ecdf(rows, "area"), "pctile", digits=9)


@query(
    "ecdf_subset",
    """select event_id, round((select count(*) from events b where b.event_type = 'click' and floor(b.value) <= floor(e.value))
         / (select count(*) from events where event_type = 'click')::double, 6) as pctile from events e""",
)
def ecdf_subset(spark, sf_dir):
    """Distribution of one event type, applied to all events."""
    rows = inputs.table(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").alias("v"))
    return ordering.ecdf(rows, "v", base=F.col("event_type") == "click", digits=6).select("event_id", "pctile")


@query(
    "ecdf_lookup",
    """select s_suppkey, round((select count(*) from orders where o_totalprice <= s_acctbal * 20) / (select count(*) from orders)::double, 9) as pctile
       from supplier""",
)
def ecdf_lookup(spark, sf_dir):
    """Ranks of outside values in a table's distribution."""
    probes = inputs.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") * 20).alias("x"))
    found = ordering.ecdf_lookup(inputs.table(spark, sf_dir, "orders"), "o_totalprice", probes)
    return inputs.rounded(found.select("s_suppkey", "pctile"), "pctile", digits=9)


@query(
    "load_in_window",
    """with seconds as (select strftime(ts, '%Y-%m-%dT%H:%M:%S') as now, count(*) as queries, date_trunc('second', ts) as t from events group by 1, 3)
       select now, queries, cast(sum(queries) over (order by t range between interval 5 minutes preceding and interval 5 minutes following) as bigint) as load
       from seconds""",
)
def load_in_window(spark, sf_dir):
    """Queries within five minutes of every busy second."""
    now = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return ordering.load_in_window(inputs.table(spark, sf_dir, "events").select(now.alias("now")), "now", 5)


_DAYS = """select GranuleUR, strftime(greatest(d, a), '%Y-%m-%dT%H:%M:%S.%fZ') as slice_start,
  strftime(least(d + interval 1 day, b), '%Y-%m-%dT%H:%M:%S.%fZ') as slice_end
  from (select GranuleUR, a, b, unnest(generate_series(a, b, interval 1 day)) as d from spans) t where d < b"""


@query(
    "time_slices",
    using("granules", spans="select GranuleUR, cast(StartTime as timestamp) as a, cast(EndTime as timestamp) as b from granules") + _DAYS,
)
def time_slices(spark, sf_dir):
    """Day slices of every granule's time span."""
    g = layout.spread_small(inputs.granules(spark, sf_dir).select("GranuleUR", "StartTime", "EndTime"))
    return times.explode_slices(g, "StartTime", "EndTime", "day").drop("StartTime", "EndTime")


@query(
    "time_slices_month",
    using("granules", spans="select GranuleUR, cast(StartTime as timestamp) as a, cast(EndTime as timestamp) as b from granules")
    + """select GranuleUR, strftime(greatest(m, a), '%Y-%m-%dT%H:%M:%S.%fZ') as slice_start,
           strftime(least(m + interval 1 month, b), '%Y-%m-%dT%H:%M:%S.%fZ') as slice_end
         from (select GranuleUR, a, b, unnest(generate_series(date_trunc('month', a)::timestamp, b, interval 1 month)) as m from spans) t
         where greatest(m, a) < least(m + interval 1 month, b)""",
)
def time_slices_month(spark, sf_dir):
    """Month slices, clipped to the span at both ends."""
    g = inputs.granules(spark, sf_dir).select("GranuleUR", "StartTime", "EndTime")
    return times.explode_slices(g, "StartTime", "EndTime", "month").drop("StartTime", "EndTime")


@query(
    "io_stats_parse",
    """select o_orderkey, case when o_orderkey % 7 = 6 then null when o_orderkey % 4 = 0 then n when o_orderkey % 4 = 1 then n * 1024
           when o_orderkey % 4 = 2 then cast(floor((n + 0.5e0) * 1048576) as bigint) else -1 end as bytes_in,
         case when o_orderkey % 7 <> 6 then 0 end as bytes_out,
         case when o_orderkey % 7 <> 6 then cast(n as double) end as gets, case when o_orderkey % 7 <> 6 then 0e0 end as puts
       from (select o_orderkey, o_custkey as n from orders) t""",
)
def io_stats_parse(spark, sf_dir):
    """Counters of profile texts with several units, some without an HTTP part."""
    n = F.col("o_custkey").cast("string")
    unit = F.col("o_orderkey") % 4
    volume = (
        F.when(unit == 0, n)
        .when(unit == 1, F.concat(n, F.lit(" KiB")))
        .when(unit == 2, F.concat(n, F.lit(".5 MiB")))
        .otherwise(F.concat(n, F.lit(" parsecs")))
    )
    part = F.concat(F.lit("Total 3s HTTPFS \n HTTP Stats \n in: "), volume, F.lit(" \n out: 0 \n #HEAD: 3 \n #GET: "), n, F.lit(" \n └ rest"))
    text = F.when(F.col("o_orderkey") % 7 == 6, "no statistics here").otherwise(part)
    stats = inputs.table(spark, sf_dir, "orders").select("o_orderkey", profiles.io_stats(text).alias("s"))
    return stats.select(
        "o_orderkey",
        F.col("s.in").alias("bytes_in"),
        F.col("s.out").alias("bytes_out"),
        F.col("s.GET").alias("gets"),
        F.col("s.PUT").alias("puts"),
    )
