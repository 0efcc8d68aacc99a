"""The derived city and its shade in plain SQL, for checking the Spark jobs.

CTES maps a name to (names it needs, select). compose() writes the WITH clause.
"""

from __future__ import annotations

from ..operators.scene import GENUS_TAU, SPECIES_TAU
from .derived_city import DAY_START_S, SITE_LAT, SITE_LON


def _values(pairs: dict, key: str, value: str, alias: str) -> str:
    rows = ", ".join(f"('{k}', {v}::DOUBLE)" if isinstance(k, str) else f"({k}, {v}::DOUBLE)" for k, v in pairs.items())
    return f"(VALUES {rows}) AS {alias}({key}, {value})"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "grid": ((), "SELECT count(*)::BIGINT AS n, floor(sqrt(count(*)))::BIGINT AS w FROM customer"),
    "corners": (("grid",), """
        SELECT c_custkey AS k, n, w, c_custkey % w AS col, c_custkey // w AS row,
               CASE WHEN c_custkey // w < w // 2 THEN '1' ELSE '3' END AS borough
        FROM customer, grid"""),
    "sides": ((), "SELECT * FROM (VALUES (0), (1)) AS v(s)"),
    "nodes": (("corners", "sides"), """
        SELECT 2 * k + s AS node_id, (300000 + 80 * col + CASE s WHEN 0 THEN -8 ELSE 8 END)::DOUBLE AS x_m,
               (64000 + 80 * row + CASE s WHEN 0 THEN 8 ELSE -8 END)::DOUBLE AS y_m, borough
        FROM corners, sides"""),
    "nodes_ll": (("nodes", "lcc"), """
        SELECT node_id, x_m, y_m, borough, lon, lat FROM (
          SELECT *, -74.0 + degrees(atan2(x_m - 300000.0, rho0 - y_m) / cone) AS lon,
                 degrees(list_reduce([pi() / 2 - 2 * atan(t)] || [0.0, 0.0, 0.0, 0.0, 0.0], lambda phi, z:
                   pi() / 2 - 2 * atan(t * pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2)))) AS lat
          FROM (SELECT *, pow(sqrt(pow(x_m - 300000.0, 2) + pow(rho0 - y_m, 2)) / af, 1 / cone) AS t FROM nodes, lcc))"""),
    "lcc": ((), """
        SELECT e, cone, 6378137.0 * f0 AS af, 6378137.0 * f0 * pow(t0, cone) AS rho0 FROM (
          SELECT e, t0, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) AS cone,
                 m1 / ((ln(m1) - ln(m2)) / (ln(t1) - ln(t2)) * pow(t1, (ln(m1) - ln(m2)) / (ln(t1) - ln(t2)))) AS f0
          FROM (SELECT e, cos(p1) / sqrt(1 - pow(e * sin(p1), 2)) AS m1, cos(p2) / sqrt(1 - pow(e * sin(p2), 2)) AS m2,
                  tan(pi() / 4 - p0 / 2) / pow((1 - e * sin(p0)) / (1 + e * sin(p0)), e / 2) AS t0,
                  tan(pi() / 4 - p1 / 2) / pow((1 - e * sin(p1)) / (1 + e * sin(p1)), e / 2) AS t1,
                  tan(pi() / 4 - p2 / 2) / pow((1 - e * sin(p2)) / (1 + e * sin(p2)), e / 2) AS t2
                FROM (SELECT sqrt(f * (2 - f)) AS e, radians(40 + 10 / 60.0) AS p0, radians(40 + 40 / 60.0) AS p1,
                             radians(41 + 2 / 60.0) AS p2 FROM (SELECT 1 / 298.257222101::DOUBLE AS f))))"""),
    "blocks": (("corners",), """
        SELECT *, 0 AS dir, 1 AS dc, 0 AS dr, 'Row ' || row || ' Street' AS street_name, 2 * k AS physical_id
        FROM corners WHERE col < w - 1 AND k + 1 < n
        UNION ALL
        SELECT *, 1, 0, 1, 'Column ' || col || ' Avenue', 2 * k + 1
        FROM corners WHERE k + w < n AND row <> w // 2 - 1"""),
    "edges": (("blocks", "corners", "sides"), """
        SELECT e.*, sqrt(pow(bx - ax, 2) + pow(yb - ay, 2)) AS length_m,
               (degrees(atan2(bx - ax, yb - ay)) + 360.0) % 360.0 AS bearing_deg FROM (
          SELECT (dir * n + k) * 2 + s AS edge_id, 2 * k + s AS u, 2 * (k + dc + dr * w) + s AS v, 0 AS kind, s AS side,
                 street_name, physical_id,
                 (300000 + 80 * col + 16 * s - 8)::DOUBLE AS ax, (64000 + 80 * row - 16 * s + 8)::DOUBLE AS ay,
                 (300000 + 80 * (col + dc) + 16 * s - 8)::DOUBLE AS bx, (64000 + 80 * (row + dr) - 16 * s + 8)::DOUBLE AS yb
          FROM blocks, sides
          UNION ALL
          SELECT 4 * n + k, 2 * k, 2 * k + 1, 1, -1, 'Row ' || row || ' Street / Column ' || col || ' Avenue', -1,
                 300000 + 80 * col - 8, 64000 + 80 * row + 8, 300000 + 80 * col + 8, 64000 + 80 * row - 8
          FROM corners) e"""),
    "samples": (("edges",), """
        SELECT edge_id * 9 + i::BIGINT AS sample_id, edge_id, kind, i / last AS t, i,
               ax + (bx - ax) * (i / last) AS x_m, ay + (yb - ay) * (i / last) AS y_m, 0.25::DOUBLE AS ground_albedo
        FROM (SELECT *, CASE kind WHEN 0 THEN 8.0::DOUBLE ELSE 3.0::DOUBLE END AS last FROM edges),
             (SELECT unnest(range(0, 9))::DOUBLE AS i) WHERE i <= last"""),
    "buildings": (("grid",), """
        SELECT p_partkey AS building_id, h::DOUBLE AS height_m, (p_partkey % 7)::DOUBLE AS base_m,
               (cx - half)::DOUBLE AS bx0, (cy - half)::DOUBLE AS by0, (cx + half)::DOUBLE AS bx1, (cy + half)::DOUBLE AS by1
        FROM (SELECT p_partkey, 10 + p_size + CASE WHEN p_partkey % 97 = 0 THEN 120 ELSE 0 END AS h,
                     300000 + (p_partkey % w) * 80 + 40 AS cx, 64000 + ((p_partkey // w) % w) * 80 + 40 AS cy,
                     20 + (p_partkey % 3) * 4 + CASE WHEN p_partkey % 97 = 0 THEN 14 ELSE 0 END AS half FROM part, grid)"""),
    "walls": (("buildings",), """
        SELECT building_id, height_m, bx0 AS ax, by0 AS ay, bx1 AS bx, by0 AS yb FROM buildings
        UNION ALL SELECT building_id, height_m, bx1, by0, bx1, by1 FROM buildings
        UNION ALL SELECT building_id, height_m, bx1, by1, bx0, by1 FROM buildings
        UNION ALL SELECT building_id, height_m, bx0, by1, bx0, by0 FROM buildings"""),
    "tree_points": (("grid",), """
        SELECT o_orderkey AS tree_id, (300000 + (37 * o_orderkey) % (80 * w))::DOUBLE AS x_m,
               (64000 + (53 * o_custkey + 11 * o_orderkey) % (80 * w))::DOUBLE AS y_m,
               ['Quercus palustris', 'Gleditsia triacanthos var. inermis', 'Ulmus americana', 'Acer platanoides',
                'Unknownia rara', 'Betula  pendula ''Youngii'''][o_orderkey % 6 + 1] AS species,
               (o_orderkey % 41)::DOUBLE AS raw_dbh FROM orders, grid"""),
    "trees": (("tree_points",), f"""
        SELECT tree_id, x_m, y_m, species, dbh_cm, measured, coalesce(sp.tau, ge.tau, 0.18) AS tau,
               CASE WHEN sp.tau IS NOT NULL THEN 'species value for ' || key WHEN ge.tau IS NOT NULL
                    THEN 'genus default for ' || genus ELSE 'global default' END
                 || CASE WHEN measured THEN '' ELSE '; dbh imputed as median 23.0cm' END AS tau_source,
               greatest(0.8, 0.55 * pow(dbh_cm, 0.70)) AS crown_radius_m,
               greatest(2.0, top * 0.35) AS crown_base_m, greatest(top, greatest(2.0, top * 0.35) + 1.0) AS crown_top_m
        FROM (SELECT *, greatest(3.0, 1.35 * pow(dbh_cm, 0.62)) AS top, split_part(key, ' ', 1) AS genus FROM (
          SELECT *, CASE WHEN raw_dbh > 1 THEN raw_dbh ELSE 23.0 END AS dbh_cm, raw_dbh > 1 AS measured,
                 trim(split_part(split_part(regexp_replace(species, '\\s+', ' ', 'g'), ' var. ', 1), ' ''', 1)) AS key
          FROM tree_points))
        LEFT JOIN {_values(SPECIES_TAU, 'species_key', 'tau', 'sp')} ON sp.species_key = key
        LEFT JOIN {_values(GENUS_TAU, 'genus_key', 'tau', 'ge')} ON ge.genus_key = genus"""),
    "amenities": (("grid",), """
        SELECT s_suppkey AS amenity_id, s_suppkey % 3 AS kind, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS name,
               (300000 + (97 * s_suppkey) % (80 * w))::DOUBLE AS x_m, (64000 + (61 * s_suppkey) % (80 * w))::DOUBLE AS y_m
        FROM supplier, grid"""),
    "amenities_ll": (("amenities", "lcc"), """
        SELECT amenity_id, kind, name, x_m, y_m, -74.0 + degrees(atan2(x_m - 300000.0, rho0 - y_m) / cone) AS lon,
                 degrees(list_reduce([pi() / 2 - 2 * atan(t)] || [0.0, 0.0, 0.0, 0.0, 0.0], lambda phi, z:
                   pi() / 2 - 2 * atan(t * pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2)))) AS lat
          FROM (SELECT *, pow(sqrt(pow(x_m - 300000.0, 2) + pow(rho0 - y_m, 2)) / af, 1 / cone) AS t FROM amenities, lcc)"""),
    "weather": ((), """
        SELECT hour_s, 20.0::DOUBLE + (c % 1500) / 100.0::DOUBLE AS air_temp_c, 30.0::DOUBLE + c % 50 AS relative_humidity_pct,
               0.5::DOUBLE + (c % 70) / 10.0::DOUBLE AS wind_speed_10m_ms, (c % 101)::DOUBLE AS cloud_cover_pct,
               100.0::DOUBLE + c % 701 AS direct_normal_wm2, 50.0::DOUBLE + c % 211 AS diffuse_wm2,
               200.0::DOUBLE + c % 601 AS global_horizontal_wm2, (c % 11)::DOUBLE AS uv_index
        FROM (SELECT (epoch(date_trunc('hour', ts)))::BIGINT AS hour_s, sum(round(value * 100)::BIGINT)::BIGINT AS c
              FROM events GROUP BY 1)"""),
    "trips": (("corners",), f"""
        SELECT k AS trip_id, 2 * k AS origin, 2 * dest AS destination, {DAY_START_S} + 13 * 3600 + (k % 4) * 900 AS depart_s
        FROM (SELECT *, (CASE WHEN row > 0 THEN row - 1 ELSE row + 1 END) * w + col
                        + CASE WHEN col + 2 < w THEN 2 ELSE -2 END AS dest FROM corners) WHERE dest < n"""),
    # ---- shade ------------------------------------------------------------
    "bins": ((), """
        SELECT b::INTEGER AS bin, round(sin(radians(5.0 * b)), 12) AS dx, round(cos(radians(5.0 * b)), 12) AS dy
        FROM (SELECT unnest(range(0, 72)) AS b)"""),
    "inside": (("samples", "buildings"), """
        SELECT DISTINCT sample_id FROM samples JOIN buildings
          ON x_m >= bx0 AND x_m <= bx1 AND y_m >= by0 AND y_m <= by1"""),
    "wall_cells": (("walls",), """
        SELECT w.*, cx, cy FROM walls w,
          LATERAL (SELECT unnest(range(floor((least(ax, bx) - 400) / 200)::BIGINT, floor((greatest(ax, bx) + 400) / 200)::BIGINT + 1)) AS cx),
          LATERAL (SELECT unnest(range(floor((least(ay, yb) - 400) / 200)::BIGINT, floor((greatest(ay, yb) + 400) / 200)::BIGINT + 1)) AS cy)"""),
    "wall_near": (("samples", "wall_cells"), """
        SELECT sample_id, building_id, height_m, x_m, y_m, ax, ay, bx, yb,
               degrees(atan2((ax + bx) / 2 - x_m, (ay + yb) / 2 - y_m)) AS mid,
               degrees(atan2(ax - x_m, ay - y_m)) AS da, degrees(atan2(bx - x_m, yb - y_m)) AS db
        FROM samples JOIN wall_cells ON cx = floor(x_m / 200)::BIGINT AND cy = floor(y_m / 200)::BIGINT
        WHERE sqrt(pow((ax + bx) / 2 - x_m, 2) + pow((ay + yb) / 2 - y_m, 2)) <= 400 + 42"""),
    # every wall is tested on the bins between its two bearings, whichever way it faces
    "wall_hits": (("wall_near", "bins"), """
        SELECT sample_id, building_id, bin,
               CASE WHEN dist <= 0.01 THEN 90.0 ELSE degrees(atan((height_m - 1.1) / dist)) END AS angle FROM (
          SELECT sample_id, building_id, height_m, bin,
                 ((ax - x_m) * (yb - ay) - (ay - y_m) * (bx - ax)) / (dx * (yb - ay) - dy * (bx - ax)) AS dist,
                 ((ax - x_m) * dy - (ay - y_m) * dx) / (dx * (yb - ay) - dy * (bx - ax)) AS share
          FROM (SELECT *, ((unnest(range(ceil(lo / 5.0 - 1e-9)::BIGINT, floor(hi / 5.0 + 1e-9)::BIGINT + 1)) % 72 + 72) % 72)::INTEGER AS b
                FROM (SELECT *, least(da, db2) AS lo, greatest(da, db2) AS hi
                      FROM (SELECT *, CASE WHEN db - da > 180 THEN db - 360 WHEN db - da < -180 THEN db + 360 ELSE db END AS db2
                            FROM wall_near))) q
          JOIN bins ON bin = b WHERE dx * (yb - ay) - dy * (bx - ax) <> 0)
        WHERE dist >= 0 AND dist <= 400 AND share >= -1e-9 AND share <= 1 + 1e-9"""),
    "opaque_bins": (("wall_hits", "samples", "bins", "inside"), """
        SELECT s.sample_id, b.bin, CASE WHEN i.sample_id IS NOT NULL THEN 90
                 ELSE least(greatest(coalesce(round_even(h.angle, 0), 0), 0), 90) END::INTEGER AS opaque
        FROM samples s CROSS JOIN bins b
        LEFT JOIN inside i ON i.sample_id = s.sample_id
        LEFT JOIN (SELECT sample_id, bin, max(angle) AS angle FROM wall_hits GROUP BY 1, 2) h
          ON h.sample_id = s.sample_id AND h.bin = b.bin"""),
    "opaque": (("opaque_bins",), "SELECT sample_id, list(opaque ORDER BY bin) AS opaque FROM opaque_bins GROUP BY 1"),
    "tree_cells": (("trees",), """
        SELECT tree_id, x_m AS tx, y_m AS ty, species, crown_radius_m AS r, crown_base_m, crown_top_m, tau, cx, cy FROM trees t,
          LATERAL (SELECT unnest(range(floor((x_m - 400 - crown_radius_m) / 200)::BIGINT, floor((x_m + 400 + crown_radius_m) / 200)::BIGINT + 1)) AS cx),
          LATERAL (SELECT unnest(range(floor((y_m - 400 - crown_radius_m) / 200)::BIGINT, floor((y_m + 400 + crown_radius_m) / 200)::BIGINT + 1)) AS cy)"""),
    "crown_near": (("samples", "tree_cells"), """
        SELECT sample_id, x_m, y_m, tree_id, tx, ty, species, r, crown_base_m, crown_top_m, tau,
               sqrt(pow(tx - x_m, 2) + pow(ty - y_m, 2)) AS dist, degrees(atan2(tx - x_m, ty - y_m)) AS toward
        FROM samples JOIN tree_cells ON cx = floor(x_m / 200)::BIGINT AND cy = floor(y_m / 200)::BIGINT
        WHERE sqrt(pow(tx - x_m, 2) + pow(ty - y_m, 2)) <= 400 + r"""),
    "crown_hits": (("crown_near", "bins"), """
        SELECT sample_id, bin, along, tau, crown_base_m, crown_top_m FROM (
          SELECT sample_id, bin, tau, crown_base_m, crown_top_m, r, (tx - x_m) * dx + (ty - y_m) * dy AS along,
                 abs((tx - x_m) * dy - (ty - y_m) * dx) AS aside
          FROM (SELECT *, ((unnest(range(ceil((toward - half) / 5.0 - 1e-9)::BIGINT, floor((toward + half) / 5.0 + 1e-9)::BIGINT + 1)) % 72 + 72) % 72)::INTEGER AS b
                FROM (SELECT *, CASE WHEN dist <= r THEN 90.0 ELSE degrees(asin(r / dist)) END AS half FROM crown_near)) q
          JOIN bins ON bin = b)
        WHERE aside <= r AND along > 0 AND along <= 400"""),
    "canopy_bins": (("crown_hits", "samples", "bins"), """
        SELECT s.sample_id, b.bin,
               least(greatest(coalesce(round_even(degrees(atan(h.ratio)), 0), 0), 0), 90)::INTEGER AS canopy,
               round_even(least(exp(coalesce(h.log_tau, 0)), 1) * 255, 0)::INTEGER AS tau_q
        FROM samples s CROSS JOIN bins b
        LEFT JOIN (SELECT sample_id, bin, max((crown_top_m - 1.1) / greatest(along, 0.01)) AS ratio,
                          sum(CASE WHEN crown_base_m <= 1.1 + along * tan(radians(30)) AND 1.1 + along * tan(radians(30)) <= crown_top_m
                                   THEN ln(greatest(tau, 1e-6)) END) AS log_tau
                   FROM crown_hits GROUP BY 1, 2) h ON h.sample_id = s.sample_id AND h.bin = b.bin"""),
    "canopy": (("canopy_bins",), """
        SELECT sample_id, list(canopy ORDER BY bin) AS canopy, list(tau_q ORDER BY bin) AS tau_q FROM canopy_bins GROUP BY 1"""),
    "horizon": (("opaque", "canopy"), "SELECT * FROM opaque JOIN canopy USING (sample_id)"),
}


def compose(select: str, *names: str, extra: dict[str, tuple[tuple[str, ...], str]] | None = None) -> str:
    """WITH clause of the named CTEs and all they need, then the select."""
    known = {**CTES, **(extra or {})}
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in known[name][0]:
            visit(dep)
        order.append(name)

    for name in names:
        visit(name)
    clauses = ",\n".join(f"{n} AS ({known[n][1].strip()})" for n in order)
    return f"WITH {clauses}\n{select.strip()}" if order else select.strip()
