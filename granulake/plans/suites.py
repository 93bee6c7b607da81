"""Search variants and whole suites."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from granulake.operators import search
from granulake.plans import inputs
from granulake.plans.inputs import using
from granulake.plans.registry import query
from granulake.plans.scans import SUITE_COUNTS_SQL, SUITE_JSON, SUITE_SQL
from granulake.sources import spec

SUITE = spec.from_json(SUITE_JSON)
BASE = next(t for t in SUITE.tests if t.name == "box-time-sorted")
_HITS = f"from granules where {SUITE_SQL['box-time-sorted']}"


@query("variant_limit", using("granules") + f"select GranuleUR {_HITS} order by GranuleUR limit 128")
def variant_limit(spark, sf_dir):
    return search.search(inputs.granules(spark, sf_dir), BASE.with_limit(128))


@query("variant_no_limit", using("granules") + f"select GranuleUR {_HITS}")
def variant_no_limit(spark, sf_dir):
    """A limit below one removes the limit."""
    return search.search(inputs.granules(spark, sf_dir), BASE.with_limit(-1))


@query("variant_all", using("granules") + f"select * {_HITS} order by GranuleUR limit 2000")
def variant_all(spark, sf_dir):
    return search.search(inputs.granules(spark, sf_dir), BASE.all_columns())


@query("variant_orderless", using("granules") + f"select least(count(*), 2000)::bigint as n {_HITS}")
def variant_orderless(spark, sf_dir):
    """Without the order only the number of rows is determined."""
    return search.search(inputs.granules(spark, sf_dir), BASE.without_order()).agg(F.count("GranuleUR").alias("n"))


_LIMITS = "case name when 'span' then 50 else 2000 end"
_TAGS = """select * from (values ('flag-0-base', null), ('flag-1-all', null), ('flag-2-orderless', null), ('flag-3-orderless-all', null),
  ('flag-4-limit:128', 128), ('flag-5-limit:128-all', 128), ('flag-6-limit:128-orderless', 128), ('flag-7-limit:128-orderless-all', 128)) t(tag, most)"""


@query(
    "variant_matrix",
    using("granules", found=SUITE_COUNTS_SQL, tags=_TAGS)
    + f"select name, tag, least(found, coalesce(most, {_LIMITS})) as rows from found, tags",
)
def variant_matrix(spark, sf_dir):
    """All variants of all searches with the rows each returns, from one scan."""
    return search.suite_variant_counts(inputs.granule_boxes(spark, sf_dir), SUITE, 128, True, True)


_RESULTS = " union all ".join(
    f"""select '{name}' as name, GranuleUR, row_number() over (order by GranuleUR) as rank from granules where {test}
        qualify rank <= {50 if name == 'span' else 2000}"""
    for name, test in SUITE_SQL.items()
)


@query("suite_run", using("granules") + _RESULTS)
def suite_run(spark, sf_dir):
    """Every search of the suite answered in one scan: its first ids in order."""
    found = search.suite_results(inputs.granule_boxes(spark, sf_dir), SUITE)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "suite_lifecycle",
    using("granules", found=SUITE_COUNTS_SQL)
    + """select 'setup' as stage, 'life-cycle-event' as name, null::bigint as found union all select 'test', name, found from found
         union all select 'takedown', 'life-cycle-event', null""",
)
def suite_lifecycle(spark, sf_dir):
    """The suite between its setup and takedown statements, which are listed and never varied."""
    data = inputs.granule_boxes(spark, sf_dir)
    view = "lifecycle_granules"
    staged = replace(
        SUITE,
        setup={"sql": f"CREATE OR REPLACE TEMPORARY VIEW lifecycle_ready AS SELECT * FROM {view}"},
        takedown={"sql": "DROP VIEW lifecycle_ready"},
    )
    stages, counts = search.run_lifecycle(
        spark, staged, lambda: search.suite_counts(spark.table("lifecycle_ready"), SUITE), view, data
    )
    events = stages.select("stage", F.lit("life-cycle-event").alias("name"), F.lit(None).cast("bigint").alias("found"))
    return events.unionByName(counts.select(F.lit("test").alias("stage"), "name", "found"))
