import pytest
from pyspark.sql import functions as F

from calorway.functions import text as T
from calorway.operators import parks as P
from calorway.operators import routes as R
from calorway.operators import waypoints as WP
from calorway.operators import weather as WX

LEG = ("route_id long, seq int, edge_id long, street_name string, side int, kind int, bearing_deg double, enter_s double, "
       "feels_c double, f_sun double, from_node long, to_node long")


def test_cards_compare_with_the_last_sidewalk(spark):
    legs = spark.createDataFrame([
        (1, 0, 10, "5th Avenue", 0, 0, 0.0, 0.0, 34.0, 0.9, 0, 1), (1, 1, 11, "x", -1, 1, 90.0, 60.0, 34.0, 0.9, 1, 2),
        (1, 2, 12, "5th Avenue", 1, 0, 0.0, 90.0, 30.0, 0.2, 2, 3), (1, 3, 13, "5th Avenue", 1, 0, 0.0, 150.0, 30.0, 0.2, 3, 4),
        (2, 0, 14, "a / b", -1, 1, 0.0, 0.0, 30.0, 0.2, 0, 1)], LEG)
    cards = R.turn_cards(legs, ["route_id"])
    told = R.card_numbers(cards, ["route_id"]).orderBy("route_id", "card_no").collect()
    assert [(r["type"], r["text"]) for r in told] == [
        ("start", "Head off along the west side of 5th Avenue"), ("cross", "Cross to the east side of 5th Avenue"), ("arrive", "Arrive"),
        ("start", "Head off along a / b"), ("arrive", "Arrive")]
    why = R.turn_why(cards).collect()
    assert len(why) == 1 and why[0]["delta_c"] == 4.0 and why[0]["dappled"] and why[0]["why_shaded_by"] == "tree canopy"


def test_rest_stop_once_when_hot(spark):
    amenities = spark.createDataFrame([(7, 0, "Fountain", 620.0, 0.0)], "amenity_id long, kind int, name string, x_m double, y_m double")

    def stops(feels):
        legs = spark.createDataFrame([(1, i, feels, 90.0, 120.0 * (i + 1), 0.0) for i in range(8)],
                                     "route_id long, seq int, feels_c double, duration_s double, end_x double, end_y double")
        return WP.rest_stops(legs, amenities, ["route_id"]).collect()
    hot = stops(36.0)
    assert len(hot) == 1 and hot[0]["amenity_id"] == 7 and hot[0]["after_seq"] == 5
    assert stops(23.0) == []


def test_words_and_units(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]
    assert [value(T.heat_category(F.lit(c))) for c in (8.0, 25.9, 26.0, 32.0, 38.0, 46.0, float("nan"))] == [
        "cold stress", "no thermal stress", "moderate heat stress", "strong heat stress", "very strong heat stress", "extreme heat stress", "unknown"]
    assert value(T.heat_rgb(F.lit(29.0))) == [209, 177, 102]
    assert value(T.degrees_text(F.lit(0.0), True)) == "32" and value(T.signed_degrees(F.lit(10.0), True)) == "+18°"
    assert value(T.signed_degrees(F.lit(0.2))) == "the same"
    assert value(T.distance_text(F.lit(1609.344), True)) == "1.00 mi" and value(T.speed_text(F.lit(1.6), True, 2)) == "3.58 mph"
    assert value(T.metres_to_feet_in_text(F.lit("the 226 m tower"))) == "the 741 ft tower"
    assert value(T.minutes_per_degree_text(F.lit(1.8), True)) == "1.0 min per °F"
    assert value(T.side_name(F.lit(0.0), F.lit(-1))) == ""
    assert value(T.building_text(F.lit(158.0), F.lit("5th Avenue"))) == "the 158 m tower on 5th Avenue"
    assert value(T.canopy_text(F.lit(None).cast("string"))) == "tree canopy" and value(T.canopy_text(F.lit("oak"))) == "oaks overhead"


def test_nearest_weather_hour(spark):
    weather = spark.createDataFrame([(1, h) for h in (0, 3600, 10800)], "city int, hour_s long")
    asks = spark.createDataFrame([(1, 1800), (1, 1860), (1, 7200), (1, 7260), (1, 99999), (1, -5)], "city int, at_s long")
    got = {r["at_s"]: r["hour_s"] for r in WX.nearest_hour(asks, weather, ["city"]).collect()}
    assert got == {1800: 0, 1860: 3600, 7200: 3600, 7260: 10800, 99999: 10800, -5: 0}
    empty = WX.weather_at(asks, weather.filter("hour_s < 0").withColumns(
        {c: F.lit(None).cast("string" if c == "source" else "double") for c in WX.FALLBACK}), ["city"])
    assert empty.filter("source like 'fallback%' and air_temp_c = 32").count() == 6


def test_gates_are_thinned_and_capped(spark):
    pts = spark.createDataFrame([(1, 0, i, 15.0 * i, 0.0) for i in range(200)] + [(2, 0, 0, 0.0, 0.0)], "park_id long, part int, pos int, x_m double, y_m double")
    assert P.thin_gates(pts).filter("park_id = 1").count() == 34
    rows = P.thin_gates(pts, limit=8).filter("park_id = 1").orderBy("pos").collect()
    assert len(rows) == 8 and rows[0]["pos"] == 0
    assert all(b["x_m"] - a["x_m"] >= 80 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("costs,want", [([(300.0, 30.0), (360.0, 28.0)], "b"), ([(300.0, 30.0), (600.0, 29.0)], "a")])
def test_choice_by_profile(spark, costs, want):
    routes = spark.createDataFrame([(1, n, d, c) for n, (d, c) in zip("ab", costs)], "walk_id long, route_id string, duration_s double, mean_c double")
    profiles = spark.createDataFrame([("standard", 1.0)], "profile string, minutes_per_degree double")
    assert R.choose_for_profile(routes, profiles).first()["chosen_route_id"] == want
