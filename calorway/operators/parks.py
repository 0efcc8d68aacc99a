"""Park entrances: outline points near a sidewalk, thinned per park."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geometry as G
from .cells import box_cells, cell_join, point_cells

#: distances are told apart to the micrometre
TOUCH_M = 1e-6


def boundary_points(parks: DataFrame, step_m: float = C.PARK_BOUNDARY_STEP_M) -> DataFrame:
    """(park_id, part, pos, x_m, y_m) round every outer ring, at least four per ring."""
    ring = F.col("rings")[0]
    rows = parks.select("park_id", "part", ring.alias("ring"), G.path_length(ring).alias("len")).filter("len > 0")
    rows = rows.withColumn("n", F.greatest(F.lit(4), F.floor((F.col("len") + TOUCH_M) / step_m).cast("int")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    at = G.interpolate(F.col("ring"), F.col("pos") * F.col("len") / F.col("n"))
    return rows.select("park_id", "part", "pos", at.alias("p")).select("park_id", "part", "pos", F.col("p.x").alias("x_m"), F.col("p.y").alias("y_m"))


def edge_segments(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(G.segments(F.col("path"))).alias("s")).select(
        F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))


def park_entrances(points: DataFrame, edges: DataFrame, reach_m: float = C.PARK_SIDEWALK_REACH_M) -> DataFrame:
    """Outline points within reach of the walking network's true geometry; a micrometre is no distance."""
    size = 4.0 * reach_m
    lines = box_cells(edge_segments(edges), F.least("ax", "bx") - reach_m, F.least("ay", "by") - reach_m,
                      F.greatest("ax", "bx") + reach_m, F.greatest("ay", "by") + reach_m, size)
    gap = G.point_segment_distance(F.col("x_m"), F.col("y_m"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    cells = point_cells(points.withColumn("_pid", F.xxhash64("park_id", "part", "pos")), "x_m", "y_m", size)
    return cell_join(cells, lines, "_pid", gap <= reach_m + TOUCH_M, "left_semi").drop("cell_x", "cell_y", "salt", "_pid")


def thin_gates(points: DataFrame, separation_m: float = C.PARK_GATE_SEPARATION_M, limit: int | None = None) -> DataFrame:
    """Greedy thinning in outline order; with `limit`, an even spread of at most so many per park.

    The choice is sequential round one outline, so a park's points go to one
    helper call; parks are spread over the cluster.
    """
    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "pos"])
        xy = pdf[["x_m", "y_m"]].to_numpy()
        kept: list[int] = []
        for i, here in enumerate(xy):
            if not kept or np.hypot(*(xy[kept] - here).T).min() >= separation_m - TOUCH_M:
                kept.append(i)
        if limit is not None and len(kept) > limit:
            spread = np.rint(np.linspace(0, len(kept) - 1, limit)).astype(int)
            kept = [kept[i] for i in sorted(set(spread.tolist()))]
        return pdf.iloc[kept]

    schema = points.select("park_id", "part", "pos", "x_m", "y_m").schema
    return points.select("park_id", "part", "pos", "x_m", "y_m").groupBy("park_id").applyInPandas(thin, schema)
