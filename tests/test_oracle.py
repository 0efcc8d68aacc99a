"""Registered queries against their SQL on the smallest tables.

By default the quick ones; CALORWAY_ALL=1 runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import compare

SF = "/root/testdata/sf0.001"
QUICK = [
    "horizon_walls", "horizon_inside_footprint", "building_horizon", "sun_panel", "tmrt_panel", "utci_curve", "weather_asof", "weather_series",
    "sidewalk_edges", "snap_nodes", "crossing_candidates", "sample_points", "build_crowns", "components", "sample_tiling", "height_stats",
    "walk_time_to_target", "leg_clock", "pareto_prune", "choose_for_profile", "order_routes", "verdict_text", "read_streets", "read_buildings",
    "read_amenities", "read_weather_hours", "landcover_lookup", "park_entrances", "nearest_node", "tallest_in_view", "validate_bbox", "place_filter",
]
NAMES = sorted(entry.queries()) if os.environ.get("CALORWAY_ALL") else QUICK


@pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    line = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert line.startswith(("ok", "ROWS")), line


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
