"""Street centrelines -> a walking graph with separate left and right sidewalks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geometry as G
from ..functions.numeric import as_col
from ..session import discard, materialize, spread
from .cells import box_cells, cell_join, point_cells
from .components import components
from .numbering import contiguous_ids, running_start

#: spans are ordered to the millimetre, beyond which a projection's last bits would decide
SPAN_DIGITS = 3


def offset_for(width_ft) -> Column:
    """Centreline to sidewalk: half the street, capped, plus half a sidewalk; 6 m when unknown."""
    width = as_col(width_ft)
    half = F.least(width, F.lit(C.MAX_STREET_WIDTH_FT)) * (C.FEET_TO_M / 2.0)
    return F.when(width > 0.0, half + C.SIDEWALK_HALF_WIDTH_M).otherwise(F.lit(C.SIDEWALK_OFFSET_M))


def sidewalk_paths(streets: DataFrame) -> DataFrame:
    """Both sidewalks of every street of at least 3 m, or neither.

    Needs seq, physical_id, street_name, borough, street_width_m and path. Where an offset
    folds over itself, the segments that the bend has swallowed are trimmed away; only a side
    of which nothing is left keeps the centreline, and offset_fallback says so.
    """
    path = F.col("path")
    usable = streets.withColumn("path", G.drop_repeats(path)).filter(F.size(path) >= 2)
    usable = usable.filter(G.path_length(path) >= C.MIN_EDGE_LENGTH_M)
    length = F.col("length_m")
    by = offset_for(F.col("street_width_m") / C.FEET_TO_M)
    side = F.explode(F.array(F.lit(C.SIDE_LEFT), F.lit(C.SIDE_RIGHT))).alias("side")
    # one step per column: each feeds several uses of the next
    sides = usable.select("seq", "physical_id", "street_name", "borough", "path", G.normals(path).alias("_segs"), by.alias("_by"), side)
    sides = sides.withColumn("_by", F.when(F.col("side") == C.SIDE_LEFT, F.col("_by")).otherwise(-F.col("_by")))
    sides = sides.withColumn("_moved", G.offset_path(F.col("_segs"), F.col("_by")))
    sound = G.offset_is_sound(path, F.col("_moved"))
    sides = sides.withColumn("_moved", F.when(sound, F.col("_moved")).otherwise(G.trimmed_offset(F.col("_segs"), F.col("_by"))))
    sides = sides.withColumn("offset_fallback", F.col("_moved").isNull())
    sides = sides.withColumn("path", F.when(F.col("offset_fallback"), path).otherwise(F.col("_moved")))
    sides = sides.withColumn("length_m", G.path_length(path)).withColumn("side", F.col("side").cast("byte"))
    sides = sides.withColumn("bearing_deg", G.path_bearing(path))
    sides = materialize(sides.drop("_segs", "_by", "_moved"), "sides")
    whole = sides.groupBy("seq").agg(F.count_if(length >= C.MIN_EDGE_LENGTH_M).alias("_n")).filter("_n = 2")
    return sides.join(whole.select("seq"), "seq")


def _snap(value: Column) -> Column:
    return F.rint(value / C.NODE_SNAP_M).cast("long")


def snap_nodes(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): ends within the same metre square share a node.

    The first end seen gives a node its coordinate and borough, and nodes are
    numbered in that order.
    """
    rank = F.col("seq") * 2 + F.col("side")
    ends = sides.select("seq", "side", "borough", F.explode(F.array(
        F.struct((rank * 2).alias("ord"), F.lit("u").alias("end"), F.col("path")[0].alias("p")),
        F.struct((rank * 2 + 1).alias("ord"), F.lit("v").alias("end"), F.element_at("path", -1).alias("p")))).alias("e"))
    ends = ends.select("seq", "side", "borough", "e.*", _snap(F.col("e.p.x")).alias("sx"), _snap(F.col("e.p.y")).alias("sy"))
    first = ends.groupBy("sx", "sy").agg(
        F.min("ord").alias("ord"), F.min_by(F.struct("p", "borough"), "ord").alias("seen"))
    nodes = materialize(contiguous_ids(first, "node_id", ["ord"]), "nodes")
    keyed = ends.join(nodes.select("node_id", "sx", "sy"), ["sx", "sy"])
    uv = keyed.groupBy("seq", "side").agg(
        F.max(F.when(F.col("end") == "u", F.col("node_id"))).alias("u"),
        F.max(F.when(F.col("end") == "v", F.col("node_id"))).alias("v"))
    edges = sides.join(uv, ["seq", "side"])
    return nodes.select("node_id", F.col("seen.p.x").alias("x_m"), F.col("seen.p.y").alias("y_m"),
                        F.col("seen.borough").alias("borough")), edges


def sidewalk_edges(streets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all sidewalks, with contiguous edge ids in street order."""
    nodes, edges = snap_nodes(sidewalk_paths(streets))
    edges = contiguous_ids(edges.withColumn("_rank", F.col("seq") * 2 + F.col("side")), "edge_id", ["_rank"])
    return nodes, edges.select(
        "edge_id", "u", "v", F.lit(C.KIND_SIDEWALK).cast("short").alias("kind"), "side", "street_name",
        "physical_id", "bearing_deg", "length_m", F.lit(None).cast("double").alias("width_m"), "path", "offset_fallback")


def endpoint_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Both ends of every edge as rows, duplicates kept; rows of unknown nodes drop out.

    row_id orders all u ends before all v ends, by edge.
    """
    n = edges.agg((F.max("edge_id") + 1).alias("_n"))
    ends = edges.select("edge_id", "street_name", "physical_id", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("u").alias("node_id")),
        F.struct(F.lit(1).alias("which"), F.col("v").alias("node_id")))).alias("e"))
    ends = ends.crossJoin(F.broadcast(n)).select(
        (F.col("edge_id") + F.col("e.which") * F.col("_n")).alias("row_id"),
        F.col("e.node_id").alias("node_id"), "street_name", "physical_id")
    return node_lookup(ends, nodes)


def node_lookup(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows with the coordinates of their node_id; rows without a node drop out."""
    return rows.join(nodes.select("node_id", "x_m", "y_m"), "node_id", "left").na.drop(subset=["x_m", "y_m"])


def crossing_candidates(ends: DataFrame, max_span_m: float = C.CROSSING_MAX_SPAN_M) -> DataFrame:
    """End pairs of different streets and nodes, at most max_span_m apart."""
    # a box of two spans meets two or three cells of four spans, but nine of one
    cell_m = 4.0 * max_span_m
    left = point_cells(ends, "x_m", "y_m", cell_m)
    other = ends.select(*[F.col(c).alias(f"b_{c}") for c in ends.columns])
    bx, by = F.col("b_x_m"), F.col("b_y_m")
    right = box_cells(other, bx - max_span_m, by - max_span_m, bx + max_span_m, by + max_span_m, cell_m)
    span = G.distance(F.col("x_m"), F.col("y_m"), bx, by)
    fits = ((F.col("row_id") < F.col("b_row_id")) & (F.col("physical_id") != F.col("b_physical_id"))
            & (F.col("node_id") != F.col("b_node_id")) & (span <= max_span_m) & (span > 0.0))
    pairs = cell_join(left, right, "row_id", fits)
    return pairs.select(
        span.alias("span_m"), F.col("row_id").alias("i"), F.col("b_row_id").alias("j"),
        F.col("node_id").alias("u"), F.col("b_node_id").alias("v"),
        F.concat("street_name", F.lit(" / "), "b_street_name").alias("street_name"),
        G.bearing_deg(F.col("x_m"), F.col("y_m"), bx, by).alias("bearing_deg"),
        G.path_of((F.col("x_m"), F.col("y_m")), (bx, by)).alias("path"))


def select_crossings(candidates: DataFrame, keep_span_m: float = C.CROSSING_KEEP_SPAN_M) -> DataFrame:
    """All short candidates, plus long ones only where they join components.

    Long links are chosen by Boruvka rounds: every component takes its lowest
    outgoing link in the order (span, i, j). That order is strict, so the links
    are the ones that adding them one by one, shortest first, would choose.
    Spans that agree to the millimetre count as equal (rank_m).
    """
    candidates = materialize(candidates.withColumn("rank_m", F.round("span_m", SPAN_DIGITS)), "candidates")
    ends = candidates.select(F.col("i").alias("node_id")).union(candidates.select("j")).distinct()
    label = materialize(components(candidates.filter(F.col("span_m") <= keep_span_m), ends, "i", "j"), "label")
    long = candidates.filter(F.col("span_m") > keep_span_m).select("rank_m", "i", "j")
    a = label.select(F.col("node_id").alias("i"), F.col("component").alias("ci"))
    b = label.select(F.col("node_id").alias("j"), F.col("component").alias("cj"))
    long = materialize(long.join(a, "i").join(b, "j").filter("ci <> cj"), "long")
    chosen, order = None, F.struct("rank_m", "i", "j")
    while True:
        out = long.select("ci", "cj", order.alias("link")).union(long.select("cj", "ci", order))
        best = out.groupBy("ci").agg(F.min("link").alias("link"), F.min_by("cj", "link").alias("cj"))
        best = materialize(best, "best")
        if best.isEmpty():
            break
        picked = best.select("link.*").distinct()
        chosen = picked if chosen is None else chosen.union(picked)
        # every component that still has a link is a row of best, so only links between these are carried on
        merged = components(best.select(F.col("ci").alias("u"), F.col("cj").alias("v")), best.select(F.col("ci").alias("node_id")))
        a = merged.select(F.col("node_id").alias("ci"), F.col("component").alias("_ci"))
        b = merged.select(F.col("node_id").alias("cj"), F.col("component").alias("_cj"))
        old = long
        long = materialize(long.join(a, "ci").join(b, "cj").filter("_ci <> _cj").select(F.col("_ci").alias("ci"), F.col("_cj").alias("cj"), "rank_m", "i", "j"), "long")
        discard(old)
    short = candidates.filter(F.col("span_m") <= keep_span_m)
    if chosen is None:
        return short
    return short.unionByName(candidates.join(chosen.distinct().select("i", "j"), ["i", "j"]).select(*short.columns))


def add_crossings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sidewalks plus chosen crossings, renumbered: sidewalks first, then crossings by (span, i, j)."""
    chosen = materialize(select_crossings(crossing_candidates(endpoint_rows(nodes, edges))), "chosen")
    start = edges.agg(F.count(F.lit(1)).alias("_n"))
    numbered = contiguous_ids(chosen, "edge_id", ["rank_m", "i", "j"]).crossJoin(F.broadcast(start))
    cross = numbered.select(
        (F.col("edge_id") + F.col("_n")).alias("edge_id"), "u", "v",
        F.lit(C.KIND_CROSSING).cast("short").alias("kind"), F.lit(C.SIDE_NONE).cast("byte").alias("side"),
        "street_name", F.lit(-1).cast("long").alias("physical_id"), "bearing_deg",
        F.col("span_m").alias("length_m"), F.lit(None).cast("double").alias("width_m"), "path")
    return edges.select(*cross.columns).unionByName(cross)


def number_edges(edges: DataFrame, order_by: str = "edge_id") -> DataFrame:
    """Contiguous edge ids in the order of the given column."""
    return contiguous_ids(edges.withColumn("_rank", F.col(order_by)), "edge_id", ["_rank"]).drop("_rank")


def with_sample_blocks(edges: DataFrame, spacing_m: float = C.SAMPLE_SPACING_M) -> DataFrame:
    """Adds sample_count and sample_start: contiguous blocks in edge order."""
    count = F.greatest(F.lit(2), F.ceil(F.col("length_m").cast("double") / spacing_m).cast("int") + 1)
    return running_start(edges.withColumn("sample_count", count), "sample_count", ["edge_id"], "sample_start")


def sample_points(edges: DataFrame) -> DataFrame:
    """Points along every edge from u to v, both ends included.

    Edges are a fraction of their samples and lie in few files, so they are dealt
    over all tasks before they are multiplied.
    """
    last = F.col("sample_count") - 1
    dealt = spread(edges.select("edge_id", "sample_start", "path", last.alias("_last")), "edge_id")
    measured = dealt.select("*", G.path_length(F.col("path")).alias("_length"), F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("pos"))
    placed = measured.withColumn("t", F.col("pos") / F.col("_last"))
    placed = placed.withColumn("_at", G.interpolate_many(F.col("path"), F.col("t") * F.col("_length")))
    return placed.select((F.col("sample_start") + F.col("pos")).alias("sample_id"), "edge_id", "t",
                         F.col("_at.x").alias("x_m"), F.col("_at.y").alias("y_m"))


def width_hint(edges: DataFrame, sidewalks: DataFrame, reach_m: float = C.WIDTH_SEARCH_M) -> DataFrame:
    """Adds width_m from the nearest surveyed sidewalk line within reach of the edge's middle.

    `sidewalks` has segment columns ax, ay, bx, by. Null where none is near.
    """
    middle = G.interpolate(F.col("path"), G.path_length(F.col("path")) / 2.0)
    mid = edges.select("edge_id", middle.alias("m")).select("edge_id", F.col("m.x").alias("mx"), F.col("m.y").alias("my"))
    lines = box_cells(sidewalks.select("ax", "ay", "bx", "by"), F.least("ax", "bx") - reach_m, F.least("ay", "by") - reach_m,
                      F.greatest("ax", "bx") + reach_m, F.greatest("ay", "by") + reach_m, 4.0 * reach_m)
    gap = G.point_segment_distance(F.col("mx"), F.col("my"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    near = cell_join(point_cells(mid, "mx", "my", 4.0 * reach_m), lines, "edge_id", gap <= reach_m)
    best = near.groupBy("edge_id").agg(F.min(gap).alias("_gap"))
    half = C.SIDEWALK_OFFSET_M - C.SIDEWALK_HALF_WIDTH_M
    width = F.least(F.greatest((F.lit(half) - F.col("_gap")) * 2.0 + 4.0, F.lit(1.5)), F.lit(12.0))
    return edges.drop("width_m").join(best, "edge_id", "left").withColumn("width_m", width).drop("_gap")


def street_spans(edges: DataFrame) -> DataFrame:
    """Metres between the middles of a street's two sidewalks; the last edge of a side counts."""
    middle = G.interpolate(F.col("path"), G.path_length(F.col("path")) / 2.0)
    sides = edges.filter(F.col("kind") == C.KIND_SIDEWALK).withColumn("m", middle)

    def last(side: int) -> Column:
        return F.max_by(F.when(F.col("side") == side, F.col("m")), F.when(F.col("side") == side, F.col("edge_id")))

    pair = sides.groupBy("physical_id").agg(last(C.SIDE_LEFT).alias("l"), last(C.SIDE_RIGHT).alias("r"))
    return pair.filter("l IS NOT NULL AND r IS NOT NULL").select(
        "physical_id", G.distance(F.col("l.x"), F.col("l.y"), F.col("r.x"), F.col("r.y")).alias("span_m"))


def arcs(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; forward says u -> v."""
    cols = [c for c in ("kind", "length_m", "duration_s") if c in edges.columns]
    return edges.select("edge_id", F.col("u").alias("from_node"), F.col("v").alias("to_node"), F.lit(True).alias("forward"), *cols).union(
        edges.select("edge_id", F.col("v").alias("from_node"), F.col("u").alias("to_node"), F.lit(False).alias("forward"), *cols))


def degree(edges: DataFrame) -> DataFrame:
    return arcs(edges).groupBy(F.col("from_node").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
