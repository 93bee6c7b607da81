"""Every registered query against its SQL twin.

By default the quicker ones run; GRANULAKE_ALL=1 runs all of them.
"""

import os

import oracle
import pytest
from oracle import SF_DIR

import __spark_entry__ as entry

QUERIES, TWINS = entry.queries(), entry.oracle_sql()

QUICK = """scan_parquet scan_union_by_name scan_id_list scan_hits scan_stac_pages scan_log_lines footer_stats row_group_rows
echo10_to_shapes ords_to_shapes write_covering_bbox write_bins write_compact write_sized_files save_table bucket_info
decode_geometry_table safe_wkt geom_centroid geom_area geom_envelope box_shrink geom_simplify geom_normalize partition_extents
geohash_encode geohash_decode common_prefix box_region hash_path_flat hash_path_nested hash_path_prefix curve_key curve_key_hilbert
antimeridian_split register_hashbin filter_bbox_struct filter_lir_or_exact st_intersects st_intersects_points st_contains or_any
not_any search search_shape shape_join_search shape_join_exact topk_per_part_merge sort_by_centroid keyset_page keyset_pages_all
order_check join_bins update_from set_diff suite_cross_source bin_count_summary percentile_by_group in_quantile histogram_by_type
run_stats verify_counts distinct_on_largest describe json_fields_nested row_ids ecdf_percentile ecdf_lookup load_in_window
time_slices_month io_stats_parse log_table category_code coverage_ratio variant_matrix suite_run suite_lifecycle
stream_ingest_logs stream_daily_counts stream_late_rows stream_largest_shapes st_intersects_holes raster_decides search_zoned zone_choice antimeridian_rings geom_simplify_topology
xml_table_function ords_table_function xml_to_rows write_geo_metadata join_bins_bucketed""".split()

CHOSEN = sorted(QUERIES) if os.environ.get("GRANULAKE_ALL") else QUICK


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, duck, name):
    rows = oracle.spark_rows(QUERIES[name](spark, SF_DIR))
    assert rows[2], "no rows"
    if name in TWINS:
        assert oracle.compare(rows, oracle.duck_rows(duck, TWINS[name])) is None


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["GranuleUR"]
