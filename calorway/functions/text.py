"""Words and display units as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import as_col, floor_mod, round_half_up

# fixed values: compass names, heat categories, colour stops, unit factors
COMPASS = ("north", "north-east", "east", "south-east", "south", "south-west", "west", "north-west")
HEAT_CATEGORIES = ((46.0, "extreme heat stress"), (38.0, "very strong heat stress"), (32.0, "strong heat stress"),
                   (26.0, "moderate heat stress"), (9.0, "no thermal stress"))
COLD_CATEGORY, UNKNOWN_CATEGORY = "cold stress", "unknown"
HEAT_STOPS = ((18.0, (80, 191, 190)), (26.0, (180, 174, 153)), (32.0, (237, 179, 51)),
              (38.0, (248, 119, 36)), (46.0, (229, 39, 81)))
UNKNOWN_RGB = (120, 130, 140)
FEET_PER_METRE, METRES_PER_MILE, MPH_PER_MS = 3.28084, 1609.344, 2.236936
AMENITY_NOUNS = ("drinking fountain", "cooling site", "park")
TOWER_HEIGHT_M = 60.0


def side_name(bearing, side) -> Column:
    """Compass side of the street, '' where an edge has no side."""
    heading = floor_mod(as_col(bearing) + F.when(as_col(side) == 0, -90.0).otherwise(90.0), 360.0)
    index = (F.floor((heading + 22.5) / 45.0) % 8 + 1).cast("int")
    named = F.concat(F.element_at(F.array(*map(F.lit, COMPASS)), index), F.lit(" side"))
    return F.when(as_col(side) == -1, F.lit("")).otherwise(named)


def heat_category(celsius) -> Column:
    c = as_col(celsius)
    out = F.when(c.isNull() | F.isnan(c), UNKNOWN_CATEGORY)
    for start, label in HEAT_CATEGORIES:
        out = out.when(c >= start, label)
    return out.otherwise(COLD_CATEGORY)


def heat_rgb(celsius) -> Column:
    """array<int> of three channels, linear between the stops and clamped outside."""
    c = as_col(celsius)

    def colour(rgb):
        return F.array(*[F.lit(v).cast("int") for v in rgb])

    out = F.when(c.isNull() | F.isnan(c), colour(UNKNOWN_RGB)).when(c <= HEAT_STOPS[0][0], colour(HEAT_STOPS[0][1]))
    for (low, a), (high, b) in zip(HEAT_STOPS, HEAT_STOPS[1:]):
        share = (c - low) / (high - low)
        out = out.when(c <= high, F.array(*[round_half_up(share * (q - p) + p).cast("int") for p, q in zip(a, b)]))
    return out.otherwise(colour(HEAT_STOPS[-1][1]))


def fahrenheit(celsius) -> Column:
    return as_col(celsius) * 9.0 / 5.0 + 32.0


def fahrenheit_delta(celsius) -> Column:
    return as_col(celsius) * 9.0 / 5.0


def degrees_text(celsius, imperial: bool = False) -> Column:
    value = fahrenheit(celsius) if imperial else as_col(celsius)
    return F.when(value.isNull() | F.isnan(value), "—").otherwise(round_half_up(value).cast("string"))


def signed_degrees(delta, imperial: bool = False) -> Column:
    size = round_half_up(F.abs(fahrenheit_delta(delta) if imperial else as_col(delta)))
    sign = F.when(as_col(delta) < 0, "−").otherwise("+")
    return F.when(size == 0, "the same").otherwise(F.concat(sign, size.cast("string"), F.lit("°")))


def _fixed(value: Column, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f", value)


def distance_text(metres, imperial: bool = False) -> Column:
    m = as_col(metres).cast("double")
    if imperial:
        near = F.concat(round_half_up(m * FEET_PER_METRE).cast("string"), F.lit(" ft"))
        return F.when(m < 160.0, near).otherwise(F.concat(_fixed(m / METRES_PER_MILE, 2), F.lit(" mi")))
    near = F.concat(round_half_up(m).cast("string"), F.lit(" m"))
    return F.when(m < 1000.0, near).otherwise(F.concat(_fixed(m / 1000.0, 2), F.lit(" km")))


def speed_text(ms, imperial: bool = False, decimals: int = 1) -> Column:
    value = as_col(ms).cast("double")
    if imperial:
        return F.concat(_fixed(value * MPH_PER_MS, decimals), F.lit(" mph"))
    return F.concat(_fixed(value, decimals), F.lit(" m/s"))


def minutes_per_degree_text(minutes, imperial: bool = False) -> Column:
    m = as_col(minutes).cast("double")
    if imperial:
        return F.concat(_fixed(m / 1.8, 1), F.lit(" min per °F"))
    return F.concat(F.when(m == F.floor(m), _fixed(m, 0)).otherwise(_fixed(m, 1)), F.lit(" min per °C"))


def metres_to_feet_in_text(text) -> Column:
    """'the 226 m tower' -> 'the 741 ft tower', for every length in the text."""
    metres = r"(\d+(?:\.\d+)?)\s*m\b"
    pieces = F.split(text, metres)
    numbers = F.regexp_extract_all(text, F.lit(metres), F.lit(1))
    feet = F.transform(numbers, lambda n: F.concat(round_half_up(n.cast("double") * FEET_PER_METRE).cast("string"), F.lit(" ft")))
    padded = F.concat(feet, F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, padded, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def building_text(height_m, street) -> Column:
    height = F.format_string("%.0f", F.rint(as_col(height_m).cast("double")))
    noun = F.when(as_col(height_m) >= TOWER_HEIGHT_M, "tower").otherwise("building")
    named = F.length(F.trim(F.coalesce(street, F.lit("")))) > 0
    return F.when(named, F.concat(F.lit("the "), height, F.lit(" m "), noun, F.lit(" on "), F.trim(street))).otherwise(
        F.concat(F.lit("a "), height, F.lit(" m "), noun))


def canopy_text(common_name) -> Column:
    plural = F.when(common_name.endswith("s"), common_name).otherwise(F.concat(common_name, F.lit("s")))
    return F.coalesce(F.concat(plural, F.lit(" overhead")), F.lit("tree canopy"))


def amenity_noun(kind) -> Column:
    nouns = F.array(*map(F.lit, AMENITY_NOUNS))
    k = as_col(kind).cast("int")
    return F.when(k.between(0, 2), F.element_at(nouns, k + 1)).otherwise("cool spot")


def amenity_label(name, kind) -> Column:
    noun = amenity_noun(kind)
    own = F.trim(F.coalesce(name, F.lit("")))
    return F.when(own != "", own).otherwise(F.concat(F.upper(F.substring(noun, 1, 1)), F.substring(noun, 2, 100)))


def rest_text(name, kind, detour_s) -> Column:
    minutes = as_col(detour_s) / 60.0
    far = F.concat(F.format_string("%.0f", F.rint(minutes)), F.lit(" min out of your way"))
    return F.concat(F.lit("Cool off at "), amenity_label(name, kind), F.lit(" — a "), amenity_noun(kind), F.lit(" "),
                    F.when(minutes >= 1.0, far).otherwise("right here"))


def route_verdict(label, same_route, cooler_c, extra_s, imperial: bool = False) -> Column:
    """One sentence on whether a cooler route is worth its time."""
    extra = round_half_up(as_col(extra_s) / 60.0)
    drop = round_half_up(F.abs(fahrenheit_delta(cooler_c) if imperial else as_col(cooler_c))).cast("string")
    minutes = F.when(extra == 1, " extra minute").otherwise(" extra minutes")
    return (F.when(same_route, "The quickest way is also the coolest one here. Nothing to trade.")
            .when(as_col(cooler_c) < 0.5, F.concat(label, F.lit(" costs "), extra.cast("string"),
                                                   F.lit(" min and feels about the same. Take the fast one.")))
            .when(extra <= 0, F.concat(label, F.lit(" is "), drop, F.lit("° cooler for no extra walking.")))
            .otherwise(F.concat(extra.cast("string"), minutes, F.lit(" buys you "), drop, F.lit("°."))))
