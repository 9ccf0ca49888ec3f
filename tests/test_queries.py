"""The driver's contract on the smallest data; ``check.py`` runs every query at any scale factor."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare, database

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "roi_stats volume_info slice_yz project_visible composite_mask histogram256 otsu_multi3 rect_range label_downsample "
    "gradient region_grow set_voxels remap_counts rle_binary_runs rle_label_tiles effective_edits group_files meta_dat "
    "series_order image_to_voxels stream_slabs"
).split()


def test_names():
    assert set(oracle_sql()) <= set(queries()) and set(SAMPLE) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 8


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    assert compare(spark, database(FOLDER), name, FOLDER).startswith("ok")
