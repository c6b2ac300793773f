"""Registered queries against their SQL in DuckDB, on the smallest tables.

A part of them by default; TRACKFLOW_ALL_QUERIES=1 runs all.
"""

import os

import pytest

from checks.all_queries import QUERIES, SQL
from checks.compare import differences, duck

SF_DIR = os.environ.get("TRACKFLOW_SF_DIR", "/root/testdata/sf0.001")
SOME = """
a3_read_gates a6_elevation_join b1_parse_time b4_animal_from_file b16_rescale b17_round_to_second c1_drop_auxiliary
c4_enough_satellites_as_text c6_moving_fixes c7_longitude_band d2_segments d3_drop_speed_outliers d4_smooth d7_trip_events d9_crossing_time
e2_perpendicular_line e4_measuring_gates e8_point_polyline_distance f5_asof_last f6_asof_nearest g3_assign_route g4_gap_summary
g8_distinct_counts g10_proximity_counts h3_order_by_time_of_day h7_nearest_to_gate k1_kruskal_wallis k2_bh_adjust k5_levene_price
k1_kruskal_wallis_p_of_quantity k5_levene_p k7_mantel x4_moving_speed_60s x5_stops x8_leader_follower x9_mean_pair_distance x10_hull_area
x11_frechet_within
""".split()
NAMES = sorted(SQL) if os.environ.get("TRACKFLOW_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == ""


@pytest.mark.parametrize("name", ["g4_gap_summary", "f6_asof_nearest", "g11_box_by_pair_type", "a6_elevation_join"])
def test_same_without_broadcasts_and_with_hot_groups(spark, con, name, monkeypatch):
    """Every side table counts as too large, every group as hot."""
    from trackflow.operators import network, tables

    monkeypatch.setattr(tables, "MAX_BROADCAST_ROWS", -1)
    monkeypatch.setattr(network, "HOT_GROUP", 1)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert differences(QUERIES[name](spark, SF_DIR), con, SQL[name]) == ""
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert set(rows.columns) == {"route", "animal_id", "gate_no", "direction", "mean_rank", "mean_gap"}
    assert rows.count() > 0
