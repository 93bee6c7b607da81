"""Order, limits, top-k per source, pages and curve order."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.functions import shapes
from granulake.operators import aggregates, layout, ordering, search
from granulake.plans import inputs
from granulake.plans.inputs import QUERY_BOX, using
from granulake.plans.registry import query
from granulake.plans.searches import BOX_SQL
from granulake.session import scratch
from granulake.sinks import tables as sinks


@query("sort_limit", using("granules") + "select GranuleUR, StartTime from granules order by GranuleUR limit 2000")
def sort_limit(spark, sf_dir):
    return ordering.sort_limit(inputs.granules(spark, sf_dir), "GranuleUR").select("GranuleUR", "StartTime")


@query("limit_only", using("granules") + f"select least(count(*), 2000)::bigint as n from granules where {BOX_SQL}")
def limit_only(spark, sf_dir):
    """Any 2000 hits; only their number is determined."""
    hits = inputs.granules(spark, sf_dir).where(search.box_columns(QUERY_BOX)).select("GranuleUR")
    return ordering.limit_only(hits).agg(F.count("GranuleUR").alias("n"))


@query(
    "topk_per_part_merge",
    using("granules")
    + f"""select CollectionConceptId, GranuleUR from (select *, row_number() over (partition by CollectionConceptId order by GranuleUR) as r
          from granules where {BOX_SQL}) t where r <= 20""",
)
def topk_per_part_merge(spark, sf_dir):
    """Every collection's own first 20 hits, merged, not cut again."""
    hits = inputs.granules(spark, sf_dir).where(search.box_columns(QUERY_BOX)).select("CollectionConceptId", "GranuleUR")
    return ordering.merge_tops(hits, "CollectionConceptId", ["GranuleUR"], 20)


@query(
    "topk_recut",
    using("granules") + f"select CollectionConceptId, GranuleUR from granules where {BOX_SQL} order by GranuleUR limit 20",
)
def topk_recut(spark, sf_dir):
    hits = inputs.granules(spark, sf_dir).where(search.box_columns(QUERY_BOX)).select("CollectionConceptId", "GranuleUR")
    return ordering.merge_tops(hits, "CollectionConceptId", ["GranuleUR"], 20, recut=True)


@query(
    "sort_by_centroid",
    using("granules")
    + """select GranuleUR, row_number() over (order by round((MBRWest + MBREast) / 2, 5), round((MBRSouth + MBRNorth) / 2, 5), GranuleUR) as position
         from granules where k % 101 <> 0""",
)
def sort_by_centroid(spark, sf_dir):
    """Positions of the whole table in centroid order."""
    g = inputs.granule_boxes(spark, sf_dir).where(F.col("k") % 101 != 0)
    c = shapes.centroid(F.col("geometry.kind"), F.col("geometry.rings"))
    placed = g.withColumn("c", c).select("GranuleUR", F.round("c.x", 5).alias("x"), F.round("c.y", 5).alias("y"))
    return ordering.row_positions(placed, ["x", "y", "GranuleUR"], "position").select("GranuleUR", "position")


@query("sort_table", "select o_custkey, o_orderkey from orders order by o_custkey, o_orderkey limit 500")
def sort_table(spark, sf_dir):
    """A stored table written in order; its head is read back."""
    path = scratch(spark, "sorted")
    name = sinks.table_name(path)
    sinks.save_table(inputs.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), name, ["o_custkey", "o_orderkey"], path)
    return ordering.sort_limit(spark.table(name), ["o_custkey", "o_orderkey"], 500)


@query(
    "keyset_page",
    using("granules")
    + """select StartTime, GranuleUR from granules where StartTime > '1997-03-05T00:00:00'
           or (StartTime = '1997-03-05T00:00:00' and GranuleUR > 'G0000000100') order by StartTime, GranuleUR limit 1000""",
)
def keyset_page(spark, sf_dir):
    """The page after a cursor."""
    g = inputs.granules(spark, sf_dir).select("StartTime", "GranuleUR")
    return ordering.keyset_page(g, ["StartTime", "GranuleUR"], ("1997-03-05T00:00:00", "G0000000100"))


@query(
    "keyset_pages_all",
    using("granules")
    + """select GranuleUR, cast((row_number() over (partition by year, priority order by StartTime, GranuleUR) - 1) // 100 + 1 as bigint) as page
         from granules""",
)
def keyset_pages_all(spark, sf_dir):
    """Page numbers of every slice at once, with no cap on the pages."""
    g = inputs.granules(spark, sf_dir).select("GranuleUR", "StartTime", "year", "priority")
    return ordering.page_numbers(g, ["year", "priority"], ["StartTime", "GranuleUR"], 100).select("GranuleUR", "page")


@query("offset_page", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc, o_orderkey limit 100 offset 250")
def offset_page(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders")
    page = ordering.offset_page(o, [F.desc("o_orderdate"), "o_orderkey"], 250, 100)
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    "order_by_expr_desc",
    "select c_mktsegment, count(*) as n from customer group by 1 order by count(*) desc, 1 limit 3",
)
def order_by_expr_desc(spark, sf_dir):
    counts = aggregates.count_by(inputs.table(spark, sf_dir, "customer"), "c_mktsegment")
    return ordering.sort_limit(counts, [F.desc("n"), "c_mktsegment"], 3)


@query("top_n_groups", using("points") + "select nation, count(*) as n from points group by 1 order by 2 desc, 1 limit 15")
def top_n_groups(spark, sf_dir):
    return aggregates.top_n_groups(inputs.points(spark, sf_dir), "nation", 15)


@query("spatial_shuffle", using("granules") + "select GranuleUR, MBRWest, MBRNorth from granules")
def spatial_shuffle(spark, sf_dir):
    """Rows moved along the curve into eight files and read back: none lost, none doubled."""
    path = scratch(spark, "curve")
    placed = layout.spatial_shuffle(inputs.granules(spark, sf_dir), 8, tie=["GranuleUR"])
    placed.select("GranuleUR", "MBRWest", "MBRNorth", "curve_key").write.parquet(path)
    return spark.read.parquet(path).drop("curve_key")


@query(
    "order_check",
    using("granules")
    + """select count(*) filter (where p is not null and CollectionConceptId <> p) as changes,
           count(*) filter (where p is not null and CollectionConceptId < p) as disorder
         from (select CollectionConceptId, lag(CollectionConceptId) over (order by StartTime, GranuleUR) as p from granules) t""",
)
def order_check(spark, sf_dir):
    """Changes and disorder of a column between neighbours in a given row order."""
    g = inputs.granules(spark, sf_dir).select("CollectionConceptId", "StartTime", "GranuleUR")
    pairs = ordering.with_previous(g, ["StartTime", "GranuleUR"], ["CollectionConceptId"])
    now, before = F.col("CollectionConceptId"), F.col("prev_CollectionConceptId")
    return pairs.agg(
        F.count_if(F.coalesce(now != before, F.lit(False))).alias("changes"),
        F.count_if(F.coalesce(now < before, F.lit(False))).alias("disorder"),
    )


@query(
    "head_tail",
    """select 'head' as part, o_orderkey from (select o_orderkey from orders order by 1 limit 5) h
       union all select 'tail', o_orderkey from (select o_orderkey from orders order by 1 desc limit 5) t
       union all select 'slice', o_orderkey from (select o_orderkey from orders order by 1 limit 1 offset 7) s""",
)
def head_tail(spark, sf_dir):
    o = inputs.table(spark, sf_dir, "orders").select("o_orderkey")
    head = ordering.sort_limit(o, "o_orderkey", 5).select(F.lit("head").alias("part"), "o_orderkey")
    tail = ordering.sort_limit(o, [F.desc("o_orderkey")], 5).select(F.lit("tail").alias("part"), "o_orderkey")
    one = ordering.offset_page(o, ["o_orderkey"], 7, 1).select(F.lit("slice").alias("part"), "o_orderkey")
    return head.unionByName(tail).unionByName(one)
