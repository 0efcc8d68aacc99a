"""Health checks of a built city: each is a one-row frame (check_name, ok, level, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..schemas import CITY_TABLES
from .components import components
from .graph import street_spans
from .numbering import order_statistics

MIN_LARGEST_COMPONENT = 0.95
MAX_GLOBAL_TAU_SHARE = 0.15
MIN_OFFSET_SHARE = 0.80
MIN_TALLEST_M = 30.0
MAX_HORIZON_BYTES = 2 << 30


def _check(df: DataFrame, name: str, level: str, ok: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("check_name"), F.coalesce(ok, F.lit(False)).alias("ok"),
                     F.lit(level).alias("level"), detail.cast("string").alias("detail"))


def schema_problems(name: str, df: DataFrame) -> DataFrame:
    """Every mismatch of a table with its contract, one row each; nulls found in one pass."""
    want = {f.name: f for f in CITY_TABLES[name].fields}
    have = {f.name: f for f in df.schema.fields}
    problems = []
    for column, field in want.items():
        if column not in have:
            problems.append(f"missing column {column} ({field.dataType.simpleString()})")
        elif have[column].dataType != field.dataType:
            problems.append(f"column {column} has type {have[column].dataType.simpleString()}, expected {field.dataType.simpleString()}")
    problems += [f"unexpected column {c}" for c in sorted(set(have) - set(want))]
    required = [c for c, f in want.items() if not f.nullable and c in have]
    spark = df.sparkSession
    found = spark.createDataFrame([(name, p) for p in problems], "table_name string, problem string")
    if not required:
        return found
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    long = nulls.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in required])).alias("x"))
    return found.union(long.filter("x.n > 0").select(
        F.lit(name), F.concat(F.lit("column "), "x.c", F.lit(" contains null values but is required"))))


def schema_check(tables: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    rows = None
    for name in CITY_TABLES:
        part = (schema_problems(name, tables[name]) if name in tables else
                spark.createDataFrame([(name, "missing")], "table_name string, problem string"))
        rows = part if rows is None else rows.union(part)
    # bounded by the number of contract columns
    listed = rows.agg(F.array_sort(F.collect_list(F.concat("table_name", F.lit(": "), "problem"))).alias("p"))
    return _check(listed, "schemas", "hard", F.size("p") == 0,
                  F.when(F.size("p") == 0, "all six conform").otherwise(F.array_join("p", "; ")))


def network_nonempty(nodes: DataFrame, edges: DataFrame, samples: DataFrame) -> DataFrame:
    def count(df, name):
        return df.agg(F.count(F.lit(1)).alias(name))
    row = count(nodes, "n").crossJoin(count(edges, "e")).crossJoin(count(samples, "s"))
    return _check(row, "network_nonempty", "hard", F.expr("n > 0 AND e > 0 AND s > 0"),
                  F.format_string("nodes=%d, edges=%d, samples=%d", "n", "e", "s"))


def row_index_ids(nodes: DataFrame, edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Ids are 0..n-1 without gap or repeat, as a set."""
    def whole(df, column, name):
        per = df.groupBy(column).agg(F.count(F.lit(1)).alias("c"))
        return per.agg(((F.min(column) == 0) & (F.max(column) == F.count(F.lit(1)) - 1) & (F.max("c") == 1)).alias(name))
    row = whole(nodes, "node_id", "nodes").crossJoin(whole(edges, "edge_id", "edges")).crossJoin(whole(samples, "sample_id", "samples"))
    bad = F.concat_ws(", ", *[F.when(~F.col(n), n) for n in ("nodes", "edges", "samples")])
    return _check(row, "row_index_ids", "hard", F.expr("nodes AND edges AND samples"),
                  F.when(bad == "", "ids match their row indices").otherwise(F.concat(F.lit("ids differ: "), bad)))


def dangling_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edge ends that are no node."""
    ends = edges.select(F.col("u").alias("node_id")).union(edges.select("v")).distinct()
    return ends.join(nodes.select("node_id"), "node_id", "left_anti")


def edge_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    row = dangling_endpoints(nodes, edges).agg(F.count(F.lit(1)).alias("n"))
    return _check(row, "edge_endpoints", "hard", F.col("n") == 0, F.format_string("%d endpoint ids missing from nodes", "n"))


def connectivity_by_borough(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of each borough's nodes that lie in its largest component."""
    label = components(edges.select("u", "v"), nodes)
    sizes = nodes.select("node_id", "borough").join(label, "node_id").groupBy("borough", "component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("borough").agg(
        F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_components"),
        (F.max("n") / F.sum("n")).alias("largest_fraction"))


def connectivity_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    label = components(edges.select("u", "v"), nodes)
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.count(F.lit(1)).alias("n_components"),
                    F.coalesce(F.try_divide(F.max("n"), F.sum("n")), F.lit(0.0)).alias("largest_component_fraction"))
    touched = edges.select(F.col("u").alias("node_id")).union(edges.select("v"))
    orphans = nodes.select("node_id").join(touched, "node_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_nodes"))
    return row.crossJoin(orphans)


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    per = connectivity_by_borough(nodes, edges)
    # one entry per borough
    row = per.agg(F.min("largest_fraction").alias("worst"), F.array_sort(F.collect_list(F.format_string(
        "%s: %.3f of %d", "borough", "largest_fraction", "n_nodes"))).alias("parts"))
    return _check(row, "connectivity", "hard", F.col("worst") >= MIN_LARGEST_COMPONENT, F.array_join("parts", ", "))


def both_sides_present(edges: DataFrame) -> DataFrame:
    sides = edges.filter(F.col("kind") == C.KIND_SIDEWALK).groupBy("physical_id").agg(
        F.array_sort(F.collect_set(F.col("side").cast("int"))).alias("sides"))
    whole = F.array(F.lit(C.SIDE_LEFT), F.lit(C.SIDE_RIGHT))
    row = sides.agg(F.count_if(F.col("sides") != whole).alias("bad"), F.count(F.lit(1)).alias("n"))
    return _check(row, "both_sides_present", "hard", F.col("bad") == 0, F.format_string("%d of %d streets lack a left/right pair", "bad", "n"))


def sample_tiling(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """Edge blocks cover every sample exactly once, and samples name their owner."""
    n = samples.agg(F.count(F.lit(1)).alias("n_samples"))
    blocks = edges.select("edge_id", "sample_start", "sample_count").crossJoin(F.broadcast(n))
    valid = (F.col("sample_count") >= 2) & (F.col("sample_start") + F.col("sample_count") <= F.col("n_samples"))
    bad = blocks.agg(F.count_if(~valid).alias("bad_blocks"))
    claims = blocks.filter(valid).select(F.col("edge_id").alias("owner"), F.explode(F.sequence(
        F.col("sample_start"), F.col("sample_start") + F.col("sample_count") - 1)).alias("sample_id"))
    per = claims.groupBy("sample_id").agg(F.count(F.lit(1)).alias("c"), F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    met = samples.select("sample_id", "edge_id").join(per, "sample_id", "full")
    wrong = F.when((F.col("lo") != F.col("edge_id")) | (F.col("hi") != F.col("edge_id")), F.coalesce("lo", F.lit(-1)))
    row = met.agg(F.count_if(F.col("edge_id").isNotNull() & F.col("c").isNotNull()).alias("covered"),
                  F.count("edge_id").alias("n"), F.count_if(F.col("c") > 1).alias("overlaps"),
                  F.count_distinct(wrong).alias("wrong")).crossJoin(bad)
    ok = F.expr("covered = n AND overlaps = 0 AND bad_blocks = 0 AND wrong = 0")
    return _check(row, "sample_tiling", "hard", ok, F.format_string(
        "%d/%d samples claimed, %d overlaps, %d invalid blocks, %d wrong owners", "covered", "n", "overlaps", "bad_blocks", "wrong"))


def crossing_spans(edges: DataFrame) -> DataFrame:
    row = edges.filter(F.col("kind") == C.KIND_CROSSING).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("length_m").cast("double"), F.lit(0.0)).alias("longest"),
        F.count_if(F.col("length_m") > C.CROSSING_MAX_SPAN_M + 0.01).alias("over"))
    return _check(row, "crossing_spans", "hard", F.col("over") == 0,
                  F.format_string("%d crossings, longest %.1f m, %d over limit", "n", "longest", "over"))


def tau_tiers(trees: DataFrame) -> DataFrame:
    source = F.lower("tau_source")
    world = source.startswith("global default")
    genus = source.contains("genus default") & ~world
    row = trees.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"), F.count_if(world).alias("w"), F.count_if(genus).alias("g"))
    share = F.col("w") / F.col("n")
    return _check(row, "tau_sourced", "soft", share < MAX_GLOBAL_TAU_SHARE, F.format_string(
        "%d species, %d genus, %d global of %d", F.col("n") - F.col("w") - F.col("g"), "g", "w", "n"))


def offsets_share(edges: DataFrame) -> DataFrame:
    varied = F.abs(F.col("span_m") - 2.0 * C.SIDEWALK_OFFSET_M) > 0.5
    row = street_spans(edges).agg(F.coalesce(F.avg(varied.cast("double")), F.lit(0.0)).alias("share"))
    return _check(row, "offsets_from_streetwidth", "soft", F.col("share") >= MIN_OFFSET_SHARE,
                  F.format_string("%.4f of streets got their own offset", "share"))


def height_stats(buildings: DataFrame) -> DataFrame:
    row = order_statistics(buildings, "height_m", {"p50": 0.5, "p99": 0.99, "top": 1.0})
    return _check(row, "building_heights", "soft", F.col("top") > MIN_TALLEST_M, F.when(F.col("n") == 0, "no buildings").otherwise(
        F.format_string("n=%d p50=%.1f m p99=%.2f m max=%.1f m", "n", "p50", "p99", "top")))


def horizon_size(samples: DataFrame) -> DataFrame:
    row = samples.agg(F.count(F.lit(1)).alias("n"))
    size = F.col("n") * C.AZIMUTH_BINS * (C.HORIZON_LAYERS + 1)
    return _check(row, "horizon_size", "soft", size < MAX_HORIZON_BYTES, F.format_string("%d samples, %d bytes", F.col("n"), size))


def check_report(tables: dict[str, DataFrame]) -> DataFrame:
    """All checks. Later ones are skipped once schemas, emptiness or endpoints fail."""
    report = schema_check(tables)
    if not report.first()["ok"]:
        return report
    nodes, edges, samples = tables["nodes"], tables["edges"], tables["samples"]
    step = network_nonempty(nodes, edges, samples)
    report = report.union(step)
    if not step.first()["ok"]:
        return report
    step = edge_endpoints(nodes, edges)
    report = report.union(row_index_ids(nodes, edges, samples)).union(step)
    if not step.first()["ok"]:
        return report
    from ..functions.geometry import wkb_to_line
    shaped = edges.withColumn("path", wkb_to_line("geom_wkb"))
    for check in (connectivity(nodes, edges), both_sides_present(edges), sample_tiling(edges, samples),
                  crossing_spans(edges), tau_tiers(tables["trees"]), offsets_share(shaped),
                  height_stats(tables["buildings"]), horizon_size(samples)):
        report = report.union(check)
    return report


def hard_failures(report: DataFrame) -> DataFrame:
    return report.filter("level = 'hard' AND NOT ok")
