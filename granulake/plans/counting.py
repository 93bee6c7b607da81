"""Aggregates: counts, summaries, run statistics, coverage, extents."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.functions import geohash
from granulake.operators import aggregates, layout, logs, ordering, search
from granulake.plans import inputs
from granulake.plans.geometry import prefix_rows_sql
from granulake.plans.inputs import using
from granulake.plans.registry import query
from granulake.plans.scans import SUITE_COUNTS_SQL, SUITE_JSON
from granulake.plans.sinks import BOX, flat_bins, flat_bins_sql
from granulake.session import scratch
from granulake.sources import documents, spec


@query("count_rows", using("granules") + "select count(*) as total, count(*) filter (where MBRNorth > 0) as north from granules")
def count_rows(spark, sf_dir):
    return inputs.granules(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("MBRNorth") > 0).alias("north"))


@query("min_max", using("granules") + "select min(StartTime) as first, max(StartTime) as last from granules")
def min_max(spark, sf_dir):
    return inputs.granules(spark, sf_dir).agg(F.min("StartTime").alias("first"), F.max("StartTime").alias("last"))


@query("count_by_key", "select event_type, count(*) as n from events group by 1")
def count_by_key(spark, sf_dir):
    return aggregates.count_by(inputs.table(spark, sf_dir, "events"), "event_type")


_RANKS = " ".join(f"when '{r}' then {i}" for i, r in enumerate(layout.REGION_ORDER, 1))


@query(
    "count_bins_ordered",
    using("granules", bins=flat_bins_sql())
    + f"""select hashbin, count(*) as n, cast(case hashbin {_RANKS} else {len(layout.REGION_ORDER)} + instr('{geohash.ALPHABET}', hashbin) end as bigint) as rank
          from bins group by 1""",
)
def count_bins_ordered(spark, sf_dir):
    """Bin counts with their place: regions in fixed order, then letters."""
    return layout.count_bins(flat_bins(spark, sf_dir)).orderBy("rank")


_SUMMARY = """paths4 as (select path as item, count(*) as value from paths group by 1),
  big as (select *, item in ('All', 'Global', 'North', 'East', 'West', 'South', 'NW', 'NE', 'SE', 'SW') as big from paths4)
  select item, value from paths4
  union all select 'Sum', sum(value)::bigint from big union all select 'Avg', (sum(value) // nullif(count(*), 0))::bigint from big
  union all select 'BigSum', coalesce(sum(value) filter (where big), 0)::bigint from big
  union all select 'BigBox', (sum(value) filter (where big) // nullif(count(*) filter (where big), 0))::bigint from big
  union all select 'BktSum', coalesce(sum(value) filter (where not big), 0)::bigint from big
  union all select 'Bucket', (sum(value) filter (where not big) // nullif(count(*) filter (where not big), 0))::bigint from big"""


@query("bin_count_summary", using("granules", paths=prefix_rows_sql(3)).rstrip() + ", " + _SUMMARY)
def bin_count_summary(spark, sf_dir):
    """Counts per prefix path with the totals and averages of both classes."""
    hashed = geohash.with_corner_hashes(inputs.granules(spark, sf_dir), BOX, 3)
    return layout.bin_summary(geohash.with_prefix_path(hashed, 3))


@query(
    "distinct_values",
    using("granules") + "select distinct MBRSouth as value from granules where MBRWest in (-180, -90, 90, 180)",
)
def distinct_values(spark, sf_dir):
    """Distinct values of one column on masked rows."""
    g = inputs.granules(spark, sf_dir).where(F.col("MBRWest").isin(*search.GLOBE_BOUNDS))
    return g.select(F.col("MBRSouth").alias("value")).distinct()


_TILES = r"""select unnest(regexp_extract_all(text, 'h\d\dv\d\d')) as tile from (
  select concat('MOD.h', lpad(cast(l_partkey % 36 as varchar), 2, '0'), 'v', lpad(cast(l_suppkey % 18 as varchar), 2, '0'), '.hdf ',
    case when l_orderkey % 3 = 0 then concat('MYD.h', lpad(cast(l_suppkey % 36 as varchar), 2, '0'), 'v00.hdf') else '' end) as text from lineitem) t"""


def tile_texts(spark, sf_dir):
    two = lambda c, n: F.lpad((F.col(c) % n).cast("string"), 2, "0")
    other = F.when(
        F.col("l_orderkey") % 3 == 0, F.concat(F.lit("MYD.h"), two("l_suppkey", 36), F.lit("v00.hdf"))
    ).otherwise("")
    text = F.concat(F.lit("MOD.h"), two("l_partkey", 36), F.lit("v"), two("l_suppkey", 18), F.lit(".hdf "), other)
    return inputs.table(spark, sf_dir, "lineitem").select(text.alias("text"))


def tiles(df):
    """Tile names in a text."""
    return df.select(F.explode(F.regexp_extract_all("text", F.lit(r"(h\d\dv\d\d)"), 1)).alias("tile"))


@query("tile_id", f"select tile, count(*) as n from ({_TILES}) x group by 1")
def tile_id(spark, sf_dir):
    return aggregates.count_by(tiles(tile_texts(spark, sf_dir)), "tile")


@query("distinct_tiles", f"select count(distinct tile) as n from ({_TILES}) x")
def distinct_tiles(spark, sf_dir):
    return tiles(tile_texts(spark, sf_dir)).agg(F.countDistinct("tile").alias("n"))


@query(
    "unique_group_count",
    "select count(*) as n from (select distinct case when c_nationkey > 3 then c_nationkey end from customer) t",
)
def unique_group_count(spark, sf_dir):
    """Number of groups, NULL being one of them."""
    keyed = inputs.table(spark, sf_dir, "customer").select(F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("k"))
    return aggregates.distinct_groups(keyed, "k")


@query(
    "percentile_by_group",
    """select event_type, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95,
         round(quantile_cont(value, 0.99), 6) as p99 from events group by 1""",
)
def percentile_by_group(spark, sf_dir):
    found = ordering.exact_quantiles(inputs.table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])
    return inputs.rounded(found, "p50", "p95", "p99")


@query(
    "in_quantile",
    """select event_id, value >= (select quantile_cont(value, 0.9) from events) as in_quantile from events""",
)
def in_quantile(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events").select("event_id", "value")
    return ordering.add_quantile_flag(events, "value", 0.9).drop("value")


def _bins_sql(value: str, breaks, table: str, where: str = "true") -> str:
    rows = []
    for i, label in enumerate(aggregates.bin_labels(breaks), 1):
        low = f"{value} >= {breaks[0]!r}" if i == 1 else f"{value} > {breaks[i - 1]!r}"
        high = f"{value} <= {breaks[i]!r}" if i < len(breaks) else "true"
        rows.append(f"select {i} as bin, '{label}' as label, count(*) filter (where {low} and {high} and {where}) as n from {table}")
    return " union all ".join(rows)


@query("histogram_breaks", _bins_sql("l_extendedprice", aggregates.AREA_BREAKS, "lineitem"))
def histogram_breaks(spark, sf_dir):
    """Right-closed bins with hand-made edges; empty bins stay."""
    return aggregates.histogram(inputs.table(spark, sf_dir, "lineitem"), "l_extendedprice", aggregates.AREA_BREAKS)


@query("histogram_vertices", _bins_sql("l_quantity", aggregates.VERTEX_BREAKS, "lineitem"))
def histogram_vertices(spark, sf_dir):
    """The vertex bins: the first one is the single value 1."""
    return aggregates.histogram(inputs.table(spark, sf_dir, "lineitem"), "l_quantity", aggregates.VERTEX_BREAKS)


@query(
    "histogram_by_type",
    """select case when l_quantity <= 1 then 1 when l_quantity <= 2 then 2 when l_quantity <= 3 then 3 when l_quantity <= 4 then 4
         when l_quantity <= 5 then 5 when l_quantity <= 20 then 6 else 7 end as bin, count(*) as n_all,
         count(*) filter (where l_returnflag = 'A') as n_a, count(*) filter (where l_returnflag = 'R') as n_r
       from lineitem where l_quantity >= 1 group by 1""",
)
def histogram_by_type(spark, sf_dir):
    lines = inputs.table(spark, sf_dir, "lineitem")
    return aggregates.histogram_by(lines, "l_quantity", aggregates.VERTEX_BREAKS, "l_returnflag", ["A", "R"])


def measured_runs(spark, sf_dir):
    """Line items as measured runs of tests: the part is the test, the price in cents the time."""
    line = inputs.table(spark, sf_dir, "lineitem")
    run = F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return line.select(F.col("l_partkey").alias("test"), run.alias("run"), cents.alias("value"))


_RUNS = """select l_partkey as test, l_orderkey * 1000000 + l_suppkey * 1000 + l_linenumber * 100 + cast(l_quantity as integer) as run,
  cast(round(l_extendedprice * 100) as bigint) as value from lineitem"""
_RUN_AGGREGATES = """count(*) as count, sum(value)::bigint as total, min(value) as min, max(value) as max,
  sum(value)::double / count(*) as average, median(value)::double as median"""


def _first_run_sql(pick: str) -> str:
    return f"(select min(run) from runs r where r.test = t.test and r.value = t.{pick})"


@query(
    "run_stats",
    f"""with runs as ({_RUNS}), t as (select test, {_RUN_AGGREGATES} from runs group by 1)
        select *, {_first_run_sql('min')} as min_id, {_first_run_sql('max')} as max_id from t""",
)
def run_stats(spark, sf_dir):
    """Statistics of measured runs per test, with the first runs at the extremes."""
    return aggregates.run_stats(measured_runs(spark, sf_dir))


@query(
    "run_stats_overall",
    f"""with runs as ({_RUNS}), t as (select {_RUN_AGGREGATES} from runs)
        select *, (select min(run) from runs where value = t.min) as min_id, (select min(run) from runs where value = t.max) as max_id from t""",
)
def run_stats_overall(spark, sf_dir):
    return aggregates.run_stats(measured_runs(spark, sf_dir), groups=())


_RULES = """select * from (values ('box-time-sorted', 'greater-then', '10'), ('time-sorted', 'less-then', '5')) r(name, action, expected)"""


@query(
    "verify_counts",
    using("granules", found=SUITE_COUNTS_SQL, rules=_RULES)
    + """select name, found, action, case when action is null then true when action = 'greater-then' then found > cast(expected as bigint)
           else found < cast(expected as bigint) end as passed from found left join rules using (name)""",
)
def verify_counts(spark, sf_dir):
    """Result counts of a suite against the rules in it."""
    suite = spec.from_json(SUITE_JSON)
    listed = [(t.name, t.expected.action, str(t.expected.value)) for t in suite.tests if t.expected]
    rules = spark.createDataFrame(listed, "name string, action string, expected string")
    counts = search.suite_counts(inputs.granule_boxes(spark, sf_dir), suite)
    return aggregates.verify(counts, rules).drop("expected")


@query(
    "latest_revision",
    """select concat('C', cast(o_custkey as varchar)) as concept, max(o_orderkey) as revision, arg_max(o_orderpriority, o_orderkey) as state
       from orders group by 1""",
)
def latest_revision(spark, sf_dir):
    rows = inputs.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("concept"),
        F.col("o_orderkey").alias("revision"),
        F.col("o_orderpriority").alias("state"),
    )
    return aggregates.latest_revision(rows, "concept", "revision")


@query(
    "distinct_on_largest",
    using("granule_shapes") + "select GranuleUR, max(area) as area from granule_shapes group by 1",
)
def distinct_on_largest(spark, sf_dir):
    rows = inputs.granule_shapes(spark, sf_dir).select("GranuleUR", "shape_no", "area")
    return aggregates.largest_shape(rows, "GranuleUR", "area", ["shape_no"]).drop("shape_no")


@query(
    "distinct_on_smallest",
    using("granule_shapes")
    + """select GranuleUR, shape_no, area from (select *, row_number() over (partition by GranuleUR order by area, shape_no) as r
           from granule_shapes) t where r = 1""",
)
def distinct_on_smallest(spark, sf_dir):
    """The smallest shape instead, with its number."""
    rows = inputs.granule_shapes(spark, sf_dir).select("GranuleUR", "shape_no", "area")
    return aggregates.largest_shape(rows, "GranuleUR", "area", ["shape_no"], largest=False)


@query(
    "shapefile_upload_count",
    "select concat('prod-app-', cast(user_id % 3 as varchar)) as directory, count(*) as n from events where event_id % 11 = 0 group by 1",
)
def shapefile_upload_count(spark, sf_dir):
    """Upload markers in gzip logs, per directory."""
    path = uploads(spark, sf_dir)
    return logs.shapefile_uploads(spark, f"{path}/prod-app*", "search.services.query-service")


def uploads(spark, sf_dir) -> str:
    """Log folders per application with upload lines among others; returns their parent."""
    path = scratch(spark, "uploads")
    marked = F.concat(F.lit("INFO search.services.query-service - {:shapefile {:filename \"a"), F.col("event_id").cast("string"), F.lit(".zip\"}}"))
    half = F.lit("INFO search.services.query-service - {:polygon 1}")
    text = F.when(F.col("event_id") % 11 == 0, marked).when(F.col("event_id") % 2 == 0, half).otherwise("{:shapefile {:filename other")
    rows = inputs.table(spark, sf_dir, "events").select(text.alias("value"), "user_id")
    for app in range(3):
        rows.where(F.col("user_id") % 3 == app).select("value").write.option("compression", "gzip").text(f"{path}/prod-app-{app}")
    return path


_NUMBERS = ["o_totalprice", "o_custkey", "o_orderkey"]


@query(
    "describe",
    " union all ".join(
        f"""select '{c}' as column, count({c}) as count, round(avg({c}), 3) as mean, round(stddev_samp({c}), 3) as std, min({c})::double as min,
            max({c})::double as max, round(quantile_cont({c}::double, 0.25), 3) as p25, round(quantile_cont({c}::double, 0.5), 3) as p50,
            round(quantile_cont({c}::double, 0.75), 3) as p75 from orders"""
        for c in _NUMBERS
    ),
)
def describe(spark, sf_dir):
    stats = aggregates.describe(inputs.table(spark, sf_dir, "orders"), _NUMBERS)
    return inputs.rounded(stats, "mean", "std", "p25", "p50", "p75", digits=3)


@query(
    "non_null_counts",
    """select 'o_orderkey' as column, count(o_orderkey) as non_null from orders union all select 'o_custkey', count(o_custkey) from orders
       union all select 'o_totalprice', count(o_totalprice) from orders""",
)
def non_null_counts(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return aggregates.non_null_counts(o).drop("type")


@query("partition_value_counts", "select n_nationkey as nation, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1")
def partition_value_counts(spark, sf_dir):
    """Rows per value and partition of a curve-ordered table, added up over the partitions."""
    p = inputs.points(spark, sf_dir)
    placed = layout.spatial_shuffle(p, 8, ("lon", "lat", "lon", "lat"), tie=["id"])
    per_part = placed.groupBy(F.spark_partition_id().alias("part"), "nation").agg(F.count(F.lit(1)).alias("n"))
    return per_part.groupBy("nation").agg(F.sum("n").alias("n"))


@query(
    "table_extent",
    using("granules") + "select min(MBRWest) as xmin, min(MBRSouth) as ymin, max(MBREast) as xmax, max(MBRNorth) as ymax from granules where k % 101 <> 0",
)
def table_extent(spark, sf_dir):
    return aggregates.table_extent(inputs.granules(spark, sf_dir).where(F.col("k") % 101 != 0), BOX)


@query(
    "unpivot_measures",
    """select event_type, unnest(['p50', 'p95', 'p99']) as measure, unnest([round(quantile_cont(value, 0.5), 6),
         round(quantile_cont(value, 0.95), 6), round(quantile_cont(value, 0.99), 6)]) as value from events group by 1""",
)
def unpivot_measures(spark, sf_dir):
    wide = percentile_by_group(spark, sf_dir)
    return aggregates.unpivot(wide, ["event_type"], ["p50", "p95", "p99"], "measure", "value")


@query(
    "page_size_profile",
    """select case when s is null then 'null' when s > 2000 then 'excluded' else 'size' end as kind, case when s <= 2000 then s end as page_size,
         count(*) as n from (select case when event_id % 4 > 0 then cast(event_id % 30 * 100 as integer) end as s from events) t group by 1, 2""",
)
def page_size_profile(spark, sf_dir):
    size = F.when(F.col("event_id") % 4 > 0, (F.col("event_id") % 30 * 100).cast("int"))
    return aggregates.page_size_profile(inputs.table(spark, sf_dir, "events").select(size.alias("page_size")))


@query(
    "json_fields",
    """select 1 as level, key as field, count(*) as n from (select unnest(json_keys(props)) as key from events) t group by 1, 2""",
)
def json_fields(spark, sf_dir):
    return documents.field_counts(inputs.table(spark, sf_dir, "events"), "props")


@query(
    "json_fields_nested",
    using("granules")
    + """select 1 as level, 'id' as field, count(*) as n from granules union all select 1, 'properties', count(*) from granules
         union all select 2, 'properties.datetime', count(*) from granules
         union all select 2, 'properties.platform', count(*) from granules where k % 2 = 1""",
)
def json_fields_nested(spark, sf_dir):
    """Keys on two levels."""
    properties = F.struct(F.col("StartTime").alias("datetime"), F.when(F.col("k") % 2 == 1, F.col("CollectionConceptId")).alias("platform"))
    text = F.to_json(F.struct(F.col("GranuleUR").alias("id"), properties.alias("properties")))
    return documents.field_counts(inputs.granules(spark, sf_dir).select(text.alias("doc")), "doc")
