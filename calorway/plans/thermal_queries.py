"""Sun, radiation, felt temperature and the edge cost panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radiation as R
from ..functions import utci as U
from ..functions.solar import minute_of, with_sun
from ..operators import exposure as X
from ..operators import weather as WX
from . import derived_city as city
from .oracle import compose
from .registry import query, stage, staged
from .shade_queries import horizon_rows, horizon_table

PANEL_HOURS = (9, 17)


def sun_sql(source: str) -> str:
    """SQL of the sun's place for rows of `source` with epoch_s, lat and lon."""
    return f"""
      SELECT * EXCLUDE (jc, ml, ma, ec, ap, ob, de, y, ha, cz, phi), 90 - degrees(acos(cz)) AS elevation_deg,
        CASE WHEN ha > 0 THEN (degrees(acos(az)) + 180.0) % 360.0 ELSE (540.0 - degrees(acos(az))) % 360.0 END AS azimuth_deg
      FROM (SELECT *, greatest(-1.0, least(1.0, CASE WHEN abs(cos(phi) * sin(acos(cz))) < 1e-9 THEN 0.0
               ELSE (sin(phi) * cz - sin(de)) / (cos(phi) * sin(acos(cz))) END)) AS az
      FROM (SELECT *, greatest(-1.0, least(1.0, sin(phi) * sin(de) + cos(phi) * cos(de) * cos(ha))) AS cz
      FROM (SELECT *, radians(lat) AS phi, radians((((((epoch_s % 86400) / 60.0 + 4 * lon + 4 * degrees(
               y * sin(2 * ml) - 2 * ec * sin(ma) + 4 * ec * y * sin(ma) * cos(2 * ml) - 0.5 * y * y * sin(4 * ml)
               - 1.25 * ec * ec * sin(2 * ma))) % 1440.0) + 1440.0) % 1440.0) / 4 - 180) AS ha
      FROM (SELECT *, asin(sin(ob) * sin(ap)) AS de, pow(tan(ob / 2), 2) AS y
      FROM (SELECT *, ml + radians(sin(ma) * (1.914602 - jc * (0.004817 + 0.000014 * jc))
               + sin(2 * ma) * (0.019993 - 0.000101 * jc) + sin(3 * ma) * 0.000289)
               - radians(0.00569 + 0.00478 * sin(radians(125.04 - 1934.136 * jc))) AS ap,
               radians(23.0 + (26.0 + (21.448 - jc * (46.815 + jc * (0.00059 - jc * 0.001813))) / 60.0) / 60.0)
               + radians(0.00256) * cos(radians(125.04 - 1934.136 * jc)) AS ob
      FROM (SELECT *, radians((280.46646 + jc * (36000.76983 + jc * 0.0003032)) % 360.0) AS ml,
               radians(357.52911 + jc * (35999.05029 - 0.0001537 * jc)) AS ma,
               0.016708634 - jc * (0.000042037 + 0.0000001267 * jc) AS ec
      FROM (SELECT *, (epoch_s / 86400.0::DOUBLE + 2440587.5::DOUBLE - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS jc
            FROM {source})))))))"""


def _utci_poly(d: str, ta: str, v: str, pa: str) -> str:
    terms, it = [], iter(U.UTCI_COEFFICIENTS)
    for p in range(7):
        for k in range(7 - p):
            for j in range(7 - p - k):
                for i in range(7 - p - k - j):
                    terms.append(f"{next(it)!r}::DOUBLE * pow({ta}, {i}) * pow({v}, {j}) * pow({d}, {k}) * pow({pa}, {p})")
    return f"({ta} + " + " + ".join(terms) + ")"


SATURATION_SQL = """exp(2.7150305 * ln(t) - 2836.5744 / pow(t, 2) - 6028.076559 / t + 19.54263612 - 0.02737830188 * t
    + 0.000016261698 * pow(t, 2) + 7.0229056e-10 * pow(t, 3) - 1.8680009e-13 * pow(t, 4)) * 0.001"""

EXTRA = {
    # felt temperature on the half-degree grid of every weather hour
    "curve": (("weather",), f"""
        SELECT hour_s, idx, tmrt_c, {_utci_poly('d', 'ta', 'v', 'pa')} AS utci_c FROM (
          SELECT hour_s, idx, tmrt_c, greatest(-30.0, least(70.0, tmrt_c - ta)) AS d, ta, v, pa FROM (
            SELECT *, {SATURATION_SQL} * greatest(0, least(100, relative_humidity_pct)) / 100 AS pa FROM (
              SELECT *, greatest(-50.0, least(50.0, air_temp_c)) AS ta, greatest(-50.0, least(50.0, air_temp_c)) + 273.15 AS t,
                     greatest(0.5, least(17.0, wind_speed_10m_ms)) AS v FROM weather)),
            (SELECT i AS idx, -30.0 + 0.5 * i AS tmrt_c FROM (SELECT unnest(range(0, 241)) AS i)))"""),
    "sky": (("weather",), """
        SELECT *, greatest(0, least(1, clear + (1 - clear) * cloud_cover_pct / 100)) AS eps FROM (
          SELECT *, 1 - (1 + xi) * exp(-sqrt(1.2 + 3 * xi)) AS clear FROM (
            SELECT *, 46.5 * 6.112 * exp(17.62 * air_temp_c / (243.12 + air_temp_c)) * relative_humidity_pct / 100
                      / (air_temp_c + 273.15) AS xi FROM weather))"""),
    "panel_keys": ((), f"""
        SELECT epoch_s // 60 AS minute, epoch_s, epoch_s AS want_s, {city.SITE_LAT}::DOUBLE AS lat, {city.SITE_LON}::DOUBLE AS lon
        FROM (SELECT {city.DAY_START_S} + 3600 * h AS epoch_s FROM (SELECT unnest(range({PANEL_HOURS[0]}, {PANEL_HOURS[1]} + 1)) AS h))"""),
    "panel_hours": (("panel_keys", "weather"), """
        SELECT minute, epoch_s, lat, lon, arg_min(hour_s, abs(hour_s - want_s) * 2 + CASE WHEN hour_s > want_s THEN 1 ELSE 0 END) AS hour_s
        FROM panel_keys, weather GROUP BY ALL"""),
    "panel_sun": (("panel_hours",), sun_sql("panel_hours")),
    "shade": (("horizon",), """
        SELECT sample_id, sample_id // 9 AS edge_id, opaque, canopy, tau_q,
               1 - list_sum(list_transform(opaque, lambda b: pow(sin(radians(b)), 2))) / 72 AS svf FROM horizon"""),
}


def panel_sql(keys: str) -> dict:
    """CTEs that evaluate samples for rows (edge_id, minute, hour_s) of `keys` with their sun in `keys`_sun."""
    return {
        "lit": ((keys, "shade"), f"""
            SELECT edge_id, minute, hour_s, sample_id, svf, CASE WHEN elevation_deg <= 0 OR oh >= elevation_deg THEN 0.0
                     WHEN ch >= elevation_deg THEN th / 255 ELSE 1.0 END AS f_sun FROM (
              SELECT k.*, h.sample_id, svf, opaque[lo + 1] * (1 - wt) + opaque[(lo + 1) % 72 + 1] * wt AS oh,
                     canopy[lo + 1] * (1 - wt) + canopy[(lo + 1) % 72 + 1] * wt AS ch,
                     tau_q[lo + 1] * (1 - wt) + tau_q[(lo + 1) % 72 + 1] * wt AS th
              FROM (SELECT *, floor(azimuth_deg / 5)::INTEGER % 72 AS lo, azimuth_deg / 5 - floor(azimuth_deg / 5) AS wt FROM {keys}) k
              JOIN shade h USING (edge_id))"""),
        "radiant": (("lit", "sky"), """
            SELECT *, pow((0.70 * (f_sun * direct_normal_wm2 * 0.28 + up_k * 0.06 + 0.25 * global_horizontal_wm2 * 0.06 + 0.44 * up_k)
                     + 0.97 * (up_l * 0.06 + surf * 0.06 + 0.44 * (up_l + surf))) / (0.97 * 5.670374419e-8), 0.25) - 273.15 AS tmrt_c
            FROM (SELECT *, svf * diffuse_wm2 + (1 - svf) * 0.20 * global_horizontal_wm2 AS up_k,
                     svf * eps * 5.670374419e-8 * pow(air_temp_c + 273.15, 4) + (1 - svf) * surf AS up_l
              FROM (SELECT *, 0.95 * 5.670374419e-8 * pow(air_temp_c + 273.15 + (2 + f_sun * 16)
                       * greatest(0, least(1, global_horizontal_wm2 / 900)), 4) AS surf FROM lit JOIN sky USING (hour_s)))"""),
        "felt": (("radiant", "curve"), """
            SELECT r.edge_id, r.minute, r.hour_s, r.sample_id, r.f_sun, r.svf, r.tmrt_c,
                   a.utci_c * (1 - (pos - floor(pos))) + b.utci_c * (pos - floor(pos)) AS feels
            FROM (SELECT *, greatest(0, least(239.9999, (tmrt_c + 30) / 0.5)) AS pos FROM radiant) r
            JOIN curve a ON a.hour_s = r.hour_s AND a.idx = floor(pos)
            JOIN curve b ON b.hour_s = r.hour_s AND b.idx = floor(pos) + 1"""),
        "cost": (("felt", "edges"), """
            SELECT edge_id, minute, hour_s, avg(feels) AS mean_feels_like_c, avg(f_sun) AS mean_f_sun, avg(svf) AS mean_svf,
                   avg(tmrt_c) AS mean_tmrt_c, avg(CASE WHEN f_sun > 0 AND f_sun < 1 THEN 1.0 ELSE 0.0 END) AS mean_canopy_fraction,
                   any_value(length_m / 1.35 + 20.0 * e.kind) AS duration_s
            FROM felt JOIN edges e USING (edge_id) GROUP BY 1, 2, 3"""),
    }


PANEL = {**EXTRA, "panel_edges": (("edges", "panel_sun"), "SELECT edge_id, s.* FROM edges, panel_sun s"), **panel_sql("panel_edges")}


def city_weather(spark, sf):
    return city.weather(spark, sf).withColumn("city", F.lit(1))


def hours_for(keys, spark, sf):
    """Adds the nearest weather hour to rows with at_s."""
    return WX.nearest_hour(keys.withColumn("city", F.lit(1)), city_weather(spark, sf), ["city"]).drop("city")


def panel_minutes(spark, sf):
    low, high = PANEL_HOURS
    grid = spark.range(low, high + 1).select((F.lit(city.DAY_START_S) + F.col("id") * 3600).alias("at_s"))
    return hours_for(grid, spark, sf).select(minute_of(F.col("at_s")).alias("minute"), "hour_s")


def shaded(spark, sf):
    """Samples with their arrays, which are written once: the horizon table is read where it is there already, and not made for this."""
    made = staged(spark, sf, "horizon")
    return stage(spark, sf, "shaded", lambda: X.shaded_samples(city.samples(spark, sf), horizon_rows(spark, sf) if made is None else made))


def panel_keys(spark, sf):
    return city.edges(spark, sf).select("edge_id").crossJoin(F.broadcast(panel_minutes(spark, sf)))


def cost_of(keys, spark, sf):
    moments = X.instants(keys, city.weather(spark, sf), city.SITE_LAT, city.SITE_LON)
    return X.edge_cost(keys, city.edges(spark, sf), shaded(spark, sf), moments)


def rounded_cost(df):
    return df.select("edge_id", "minute", "hour_s", *[F.round(c, 4).alias(c) for c in (
        "mean_feels_like_c", "mean_f_sun", "mean_svf", "mean_tmrt_c", "mean_canopy_fraction", "duration_s", "heat_dm")])


@query("edge_cost_panel", compose("""
    SELECT edge_id::BIGINT AS edge_id, minute::BIGINT AS minute, hour_s::BIGINT AS hour_s, round(mean_feels_like_c, 4) AS mean_feels_like_c,
           round(mean_f_sun, 4) AS mean_f_sun, round(mean_svf, 4) AS mean_svf, round(mean_tmrt_c, 4) AS mean_tmrt_c,
           round(mean_canopy_fraction, 4) AS mean_canopy_fraction, round(duration_s, 4) AS duration_s,
           round(mean_feels_like_c * duration_s / 60, 4) AS heat_dm FROM cost""", "cost", extra=PANEL))
def edge_cost_panel(spark, sf):
    return rounded_cost(cost_of(panel_keys(spark, sf), spark, sf))


@query("f_sun_panel", compose("""
    SELECT sample_id::BIGINT AS sample_id, minute::BIGINT AS minute, round(f_sun, 5) AS f_sun FROM lit""", "lit", extra=PANEL))
def f_sun_panel(spark, sf):
    keys = panel_keys(spark, sf)
    moments = X.instants(keys, city.weather(spark, sf), city.SITE_LAT, city.SITE_LON)
    out = X.sample_panel(keys, shaded(spark, sf), moments)
    return out.select("sample_id", "minute", F.round("f_sun", 5).alias("f_sun"))


@query("canopy_fraction", compose("""
    SELECT minute::BIGINT AS minute, count(*)::BIGINT AS n_samples, round(avg(CASE WHEN f_sun > 0 AND f_sun < 1 THEN 1.0 ELSE 0.0 END), 6) AS canopy_fraction
    FROM lit GROUP BY 1""", "lit", extra=PANEL))
def canopy_fraction(spark, sf):
    keys = panel_keys(spark, sf)
    moments = X.instants(keys, city.weather(spark, sf), city.SITE_LAT, city.SITE_LON)
    share = F.avg(((F.col("f_sun") > 0) & (F.col("f_sun") < 1)).cast("double"))
    return X.sample_panel(keys, shaded(spark, sf), moments).groupBy("minute").agg(
        F.count(F.lit(1)).alias("n_samples"), F.round(share, 6).alias("canopy_fraction"))


@query("scene_health", compose("""
    SELECT (SELECT count(*) FROM samples)::BIGINT AS n_samples, (SELECT count(*) FROM edges)::BIGINT AS n_edges, 1.0::DOUBLE AS warm_fraction""", "samples"))
def scene_health(spark, sf):
    return X.scene_health(city.samples(spark, sf), city.edges(spark, sf), horizon_table(spark, sf))


# ---- sun and weather columns over every event hour -------------------------

SUN_SITES = {
    "event_minutes": ((), f"""
        SELECT DISTINCT epoch(date_trunc('minute', ts))::BIGINT AS epoch_s, {city.SITE_LAT}::DOUBLE AS lat, {city.SITE_LON}::DOUBLE AS lon FROM events"""),
    "sun": (("event_minutes",), sun_sql("event_minutes")),
}


@query("sun_panel", compose("""
    SELECT epoch_s::BIGINT AS epoch_s, round(azimuth_deg, 5) AS azimuth_deg, round(elevation_deg, 5) AS elevation_deg FROM sun""", "sun", extra=SUN_SITES))
def sun_panel(spark, sf):
    minutes = city.read(spark, sf, "events").select(
        (minute_of(city.epoch_seconds(F.col("ts"))) * 60).alias("epoch_s")).distinct()
    sites = minutes.withColumns({"lat": F.lit(city.SITE_LAT), "lon": F.lit(city.SITE_LON)})
    return with_sun(sites).select("epoch_s", F.round("azimuth_deg", 5).alias("azimuth_deg"), F.round("elevation_deg", 5).alias("elevation_deg"))


@query("vapour_pressure", compose("""
    SELECT hour_s::BIGINT AS hour_s, round(6.112 * exp(17.62 * air_temp_c / (243.12 + air_temp_c)) * relative_humidity_pct / 100, 6) AS vapour_hpa
    FROM weather""", "weather"))
def vapour_pressure(spark, sf):
    return city.weather(spark, sf).select("hour_s", F.round(
        R.vapour_pressure_hpa(F.col("air_temp_c"), F.col("relative_humidity_pct")), 6).alias("vapour_hpa"))


@query("sky_emissivity", compose("SELECT hour_s::BIGINT AS hour_s, round(eps, 6) AS emissivity FROM sky", "sky", extra=EXTRA))
def sky_emissivity(spark, sf):
    return city.weather(spark, sf).select("hour_s", F.round(R.sky_emissivity(
        F.col("air_temp_c"), F.col("relative_humidity_pct"), F.col("cloud_cover_pct")), 6).alias("emissivity"))


@query("surface_temperature", compose("""
    SELECT hour_s::BIGINT AS hour_s, round(air_temp_c + 2 * greatest(0, least(1, global_horizontal_wm2 / 900)), 6) AS shaded_c,
           round(air_temp_c + 18 * greatest(0, least(1, global_horizontal_wm2 / 900)), 6) AS sunlit_c FROM weather""", "weather"))
def surface_temperature(spark, sf):
    def at(f):
        return F.round(R.surface_temp_c(F.col("air_temp_c"), F.lit(f), F.col("global_horizontal_wm2")), 6)
    return city.weather(spark, sf).select("hour_s", at(0.0).alias("shaded_c"), at(1.0).alias("sunlit_c"))


SURFACES = {**EXTRA, "cases": ((), "SELECT * FROM (VALUES (0.0, 0.2), (0.0, 1.0), (0.5, 0.6), (1.0, 0.3), (1.0, 1.0)) AS v(f_sun, svf)"),
            "lit": (("cases", "weather"), "SELECT 0 AS edge_id, 0 AS minute, hour_s, 0 AS sample_id, svf, f_sun FROM cases, weather")}
SURFACES["radiant"] = panel_sql("x")["radiant"]


@query("tmrt_panel", compose("""
    SELECT hour_s::BIGINT AS hour_s, f_sun::DOUBLE AS f_sun, svf::DOUBLE AS svf, round(tmrt_c, 4) AS tmrt_c FROM radiant""", "radiant", extra=SURFACES))
def tmrt_panel(spark, sf):
    cases = F.explode(F.array(*[F.struct(F.lit(f).alias("f_sun"), F.lit(v).alias("svf"))
                                for f, v in ((0.0, 0.2), (0.0, 1.0), (0.5, 0.6), (1.0, 0.3), (1.0, 1.0))])).alias("c")
    rows = R.with_sky(city.weather(spark, sf)).select("*", cases)
    return rows.select("hour_s", F.col("c.f_sun").alias("f_sun"), F.col("c.svf").alias("svf"),
                       F.round(R.tmrt(F.col("c.f_sun"), F.col("c.svf"), F.lit(0.25)), 4).alias("tmrt_c"))


@query("saturation_vapour", compose(f"""
    SELECT hour_s::BIGINT AS hour_s, round({SATURATION_SQL}, 6) AS saturation_kpa FROM (SELECT hour_s, air_temp_c + 273.15 AS t FROM weather)""", "weather"))
def saturation_vapour(spark, sf):
    return city.weather(spark, sf).select("hour_s", F.round(U.saturation_vapour_kpa(F.col("air_temp_c")), 6).alias("saturation_kpa"))


@query("utci_panel", compose("""
    SELECT c.hour_s::BIGINT AS hour_s, round(utci_c, 4) AS utci_c FROM curve c WHERE idx = 140""", "curve", extra=EXTRA))
def utci_panel(spark, sf):
    return U.with_weather_curve(city.weather(spark, sf)).select("hour_s", F.round(U.utci_exact(F.lit(40.0)), 4).alias("utci_c"))


@query("utci_curve", compose("""
    SELECT hour_s::BIGINT AS hour_s, tmrt_c::DOUBLE AS tmrt_c, round(utci_c, 4) AS utci_c FROM curve""", "curve", extra=EXTRA))
def utci_curve(spark, sf):
    return U.utci_curve(city.weather(spark, sf)).select("hour_s", "tmrt_c", F.round("utci_c", 4).alias("utci_c"))


@query("pedestrian_wind", compose("""
    SELECT hour_s::BIGINT AS hour_s, round(greatest(0.5, least(17.0, wind_speed_10m_ms * ln(2.1) / ln(11.0))), 6) AS wind_ms FROM weather""", "weather"))
def pedestrian_wind(spark, sf):
    return city.weather(spark, sf).select("hour_s", F.round(U.pedestrian_wind(F.col("wind_speed_10m_ms")), 6).alias("wind_ms"))


@query("weather_cell", compose("""
    SELECT node_id::BIGINT AS node_id, round_even(lat / 0.05, 0)::BIGINT AS cell_lat, round_even(lon / 0.05, 0)::BIGINT AS cell_lon FROM nodes_ll""", "nodes_ll"))
def weather_cell(spark, sf):
    lat, lon = WX.weather_cell(F.col("lat"), F.col("lon"))
    return city.nodes(spark, sf).select("node_id", lat.alias("cell_lat"), lon.alias("cell_lon"))


@query("weather_asof", compose("""
    SELECT e.event_id::BIGINT AS event_id, w.hour_s::BIGINT AS hour_s, w.air_temp_c FROM
      (SELECT event_id, arg_min(hour_s, abs(hour_s - at_s) * 2 + CASE WHEN hour_s > at_s THEN 1 ELSE 0 END) AS hour_s
       FROM (SELECT event_id, epoch(ts)::BIGINT - epoch(ts)::BIGINT % 60 AS at_s FROM (SELECT event_id, date_trunc('minute', ts) AS ts FROM events)), weather
       WHERE hour_s BETWEEN at_s - 200000 AND at_s + 200000 GROUP BY 1) e
    JOIN weather w USING (hour_s)""", "weather"))
def weather_asof(spark, sf):
    asks = city.read(spark, sf, "events").select(
        "event_id", (minute_of(city.epoch_seconds(F.col("ts"))) * 60).alias("at_s"), F.lit(1).alias("city"))
    return WX.weather_at(asks, city_weather(spark, sf), ["city"]).select("event_id", "hour_s", "air_temp_c")


@query("forecast_hour", compose("""
    SELECT event_id::BIGINT AS event_id, CASE WHEN s % 3600 > 1800 THEN s - s % 3600 + 3600 ELSE s - s % 3600 END::BIGINT AS hour_s
    FROM (SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events)"""))
def forecast_hour(spark, sf):
    return city.read(spark, sf, "events").select("event_id", WX.forecast_hour(city.epoch_seconds(F.col("ts"))).alias("hour_s"))


@query("weather_series", compose(f"""
    SELECT trip_id::BIGINT AS trip_id, hour_no::BIGINT AS hour_no,
           (SELECT arg_min(air_temp_c, abs(hour_s - at_s) * 2 + CASE WHEN hour_s > at_s THEN 1 ELSE 0 END) FROM weather) AS air_temp_c
    FROM (SELECT trip_id, hour_no, depart_s + 3600 * hour_no AS at_s FROM trips, (SELECT unnest(range(0, 6)) AS hour_no))""", "trips", "weather"))
def weather_series(spark, sf):
    starts = city.trips(spark, sf).select("trip_id", F.col("depart_s").alias("at_s"), F.lit(1).alias("city"))
    out = WX.weather_series(starts, city_weather(spark, sf), 6, ["city"])
    return out.select("trip_id", F.col("hour_no").cast("long").alias("hour_no"), "air_temp_c")


@query("departure_grid", compose("""
    SELECT trip_id::BIGINT AS trip_id, (depart_s + 900 * i)::BIGINT AS depart_s FROM trips, (SELECT unnest(range(0, 24)) AS i)""", "trips"))
def departure_grid(spark, sf):
    return WX.departures(city.trips(spark, sf), 6).select("trip_id", "depart_s")


@query("walk_duration", compose("""
    SELECT edge_id::BIGINT AS edge_id, round(length_m / 1.35 + CASE WHEN kind = 1 THEN 20 ELSE 0 END, 6) AS duration_s FROM edges""", "edges"))
def walk_duration(spark, sf):
    return city.edges(spark, sf).select("edge_id", F.round(X.walk_duration(F.col("length_m"), F.col("kind")), 6).alias("duration_s"))
