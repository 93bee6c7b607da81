"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.functions import shapes
from granulake.operators import joins, sets
from granulake.plans import inputs
from granulake.plans.inputs import using
from granulake.plans.registry import query
from granulake.plans.sinks import flat_bins, flat_bins_sql
from granulake.session import scratch, shuffle_partitions
from granulake.sinks import tables as sinks


@query(
    "join_bins",
    using("granules", bins=flat_bins_sql())
    + "select g.GranuleUR, StartTime, hashbin from granules g join bins using (GranuleUR) where hashbin = 'All'",
)
def join_bins(spark, sf_dir):
    g = inputs.granules(spark, sf_dir).select("GranuleUR", "StartTime")
    return joins.join_bins(g, flat_bins(spark, sf_dir), only="All")


@query(
    "join_bins_bucketed",
    using("granules", bins=flat_bins_sql())
    + "select hashbin, count(*) as n, min(StartTime) as first_start from granules g join bins using (GranuleUR) group by 1",
)
def join_bins_bucketed(spark, sf_dir):
    """Granules and their bins stored in the same buckets: the join moves no row of either table."""
    g = inputs.granules(spark, sf_dir).select("GranuleUR", "StartTime")
    both = []
    for label, df in (("granules", g), ("bins", flat_bins(spark, sf_dir))):
        path = scratch(spark, f"bucketed-{label}")
        both.append(sinks.save_bucketed(df, sinks.table_name(path), "GranuleUR", shuffle_partitions(spark), path))
    joined = joins.join_bins(both[0], both[1].hint("merge"))
    return joined.groupBy("hashbin").agg(F.count(F.lit(1)).alias("n"), F.min("StartTime").alias("first_start"))


@query(
    "update_from",
    """select o_orderkey, case when o_custkey % 3 = 0 then o_totalprice else -1 end as price from orders""",
)
def update_from(spark, sf_dir):
    """Prices set to -1, then updated from another table where the id matches."""
    o = inputs.table(spark, sf_dir, "orders")
    target = o.select("o_orderkey", F.lit(-1.0).alias("price"))
    other = o.where(F.col("o_custkey") % 3 == 0).select("o_orderkey", F.col("o_totalprice").alias("price"))
    return joins.update_from(target, other, "o_orderkey", ["price"])


@query(
    "fill_null_from",
    """select o_orderkey, case when o_custkey % 2 = 0 then 'own' when o_custkey % 3 = 0 then o_orderpriority end as label from orders""",
)
def fill_null_from(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    target = o.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "own").alias("label"))
    other = o.where(F.col("o_custkey") % 3 == 0).select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return joins.fill_null_from(target, other, "o_orderkey", ["label"])


@query("semi_join", "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def semi_join(spark, sf_dir):
    good = inputs.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return inputs.table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "lang")


@query(
    "column_concat",
    using("granule_shapes") + "select GranuleUR, shape_no, round(w, 6) as minx, round(s + dy, 6) as maxy, partkey from granule_shapes",
)
def column_concat(spark, sf_dir):
    """Bounds put beside the row's own columns."""
    rows = shapes.with_bounds(inputs.triangles(spark, sf_dir))
    return rows.select("GranuleUR", "shape_no", F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"), "partkey")


@query(
    "suite_cross_source",
    using("granules")
    + """select strftime(day, '%Y-%m-%d') as day, source, by_id from (select unnest(generate_series(
           (select min(cast(StartTime as date)) from granules), (select max(cast(StartTime as date)) from granules), interval 1 day)) as day) d,
         (values ('large', false), ('1_small_collections', true)) s(source, by_id)""",
)
def suite_cross_source(spark, sf_dir):
    """The harvest work list: every day of the table with every source."""
    start = F.to_date("StartTime")
    span = inputs.granules(spark, sf_dir).agg(F.min(start).alias("a"), F.max(start).alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    return joins.work_list(days, [("large", False), ("1_small_collections", True)])


@query(
    "index_filter",
    """select case when n_nationkey % 4 = 0 then concat('1_c', cast(n_nationkey as varchar)) else '1_small_collections' end as index_name,
         n_nationkey from nation where n_nationkey % 4 in (0, 1)""",
)
def index_filter(spark, sf_dir):
    name = (
        F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("1_c"), F.col("n_nationkey").cast("string")))
        .when(F.col("n_nationkey") % 4 == 1, "1_small_collections")
        .when(F.col("n_nationkey") % 4 == 2, "1_collections_v2")
        .otherwise("2_other")
    )
    listed = inputs.table(spark, sf_dir, "nation").select(name.alias("index_name"), "n_nationkey")
    return joins.index_filter(listed)


# ---- sets ------------------------------------------------------------------------------------------


@query("union_all", "select c_custkey as key, c_name as name from customer union all select s_suppkey, s_name from supplier")
def union_all(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = inputs.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"))
    return sets.union_all([c, s])


@query(
    "union_fill",
    """select c_custkey as key, c_mktsegment as segment, null::integer as nation from customer
       union all select s_suppkey, null, s_nationkey from supplier""",
)
def union_fill(spark, sf_dir):
    c = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    s = inputs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return sets.union_fill([c, s])


@query("set_diff", "select o_orderkey from orders where o_custkey % 2 <> 0 and o_custkey % 3 = 0")
def set_diff(spark, sf_dir):
    """Rows that were NULL before a fill and are set after it."""
    o = inputs.table(spark, sf_dir, "orders")
    before = o.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "own").alias("label"))
    other = o.where(F.col("o_custkey") % 3 == 0).select("o_orderkey", F.col("o_orderpriority").alias("label"))
    return sets.newly_set(before, joins.fill_null_from(before, other, "o_orderkey", ["label"]), "o_orderkey", "label")


@query("column_intersect", "select c_name, c_custkey from customer")
def column_intersect(spark, sf_dir):
    return sets.column_intersect(inputs.table(spark, sf_dir, "customer"), ["c_name", "c_missing", "c_custkey"])


@query("column_except", "select c_name, c_nationkey, c_acctbal, c_mktsegment as c_seg from customer")
def column_except(spark, sf_dir):
    dotted = inputs.table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "c.seg")
    return sets.column_except(dotted, "c_custkey")
