"""City tables at rest: typed Parquet, horizon store, fingerprints and the artifact gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import AZIMUTH_BINS, HORIZON_FORMAT_VERSION
from ..functions.geometry import line_to_wkb, rings_to_wkb
from ..operators.checks import schema_problems
from ..schemas import CITY_TABLES, HORIZON

MIN_PRODUCTION_EDGES = 10_000
FINGERPRINTED = ("samples", "buildings", "trees")


class SchemaError(ValueError):
    """Lists every mismatch of a table, not just the first."""


def conform(name: str, df: DataFrame) -> DataFrame:
    """Columns and types of the contract; geometry columns become WKB."""
    if "geom_wkb" in CITY_TABLES[name].fieldNames() and "geom_wkb" not in df.columns:
        encode = line_to_wkb("path") if "path" in df.columns else rings_to_wkb("rings")
        df = df.withColumn("geom_wkb", encode)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in CITY_TABLES[name].fields])


def read_city_table(spark: SparkSession, root: str, name: str, folder: str | None = None) -> DataFrame:
    """A city table (at its name, or at another folder of the root), refused with all its problems when it breaks the contract."""
    df = spark.read.parquet(f"{root}/{folder or name}")
    # at most one row per contract column
    problems = [r["problem"] for r in schema_problems(name, df).collect()]
    if problems:
        raise SchemaError(f"table {name!r} does not conform: " + "; ".join(problems))
    return df


def write_city(tables: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Writes the tables given, zstd-compressed; others at the path stay as they are."""
    for name in CITY_TABLES:
        if name in tables:
            out = conform(name, tables[name]).write.mode("overwrite").option("compression", "zstd")
            keys = (partition_by or {}).get(name)
            (out.partitionBy(*keys) if keys else out).parquet(f"{root}/{name}")


def table_fingerprint(name: str, df: DataFrame) -> DataFrame:
    """One row: order-independent identity of a table's content."""
    rows = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.sum(rows).alias("hash_sum"))


def source_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """One row, one hash over everything that can change a horizon."""
    parts = None
    for name in FINGERPRINTED:
        part = table_fingerprint(name, tables[name])
        parts = part if parts is None else parts.union(part)
    text = F.concat_ws(":", "table_name", F.col("n_rows").cast("string"), F.coalesce("hash_sum", F.lit(0)).cast("string"))
    # three rows
    joined = F.array_join(F.array_sort(F.collect_list(text)), "|")
    return parts.agg(F.sha2(F.concat(F.lit(f"horizon-v{HORIZON_FORMAT_VERSION}|"), joined), 256).alias("fingerprint"))


def write_horizon(horizon: DataFrame, fingerprint: str, path: str) -> None:
    (horizon.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite")
     .option("compression", "zstd").parquet(path))


def quantise_tau(tau: str = "tau"):
    """Float transmissivities of the old format as 1/255 steps."""
    return F.transform(F.col(tau), lambda t: F.rint(F.least(F.greatest(t.cast("double"), F.lit(0.0)), F.lit(1.0)) * 255.0).cast("short"))


def read_horizon(spark: SparkSession, path: str, fingerprint: str, samples: DataFrame) -> DataFrame | None:
    """The stored horizons, or None when stale, incomplete or misshapen."""
    stored = spark.read.parquet(path)
    if "tau_q" not in stored.columns and "tau" in stored.columns:
        stored = stored.withColumn("tau_q", quantise_tau())
    sized = F.greatest(*[F.abs(F.size(c) - AZIMUTH_BINS) for c in ("opaque", "canopy", "tau_q")])
    stale = stored.agg(F.count_if((F.col("fingerprint") != fingerprint) | (sized != 0)).alias("bad"),
                       F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("ids")).first()
    if stale["bad"] or stale["n"] != stale["ids"]:
        return None
    if samples.join(stored, "sample_id", "left_anti").limit(1).count() or stored.join(samples, "sample_id", "left_anti").limit(1).count():
        return None
    return stored.select(*HORIZON.fieldNames())


def verify_city(tables: dict[str, DataFrame], horizon: DataFrame, min_edges: int = MIN_PRODUCTION_EDGES) -> DataFrame:
    """One row per gate: tables present, enough edges, horizons matching the samples."""
    spark = horizon.sparkSession
    missing = [n for n in CITY_TABLES if n not in tables]
    gates = spark.createDataFrame([("tables_present", not missing, ", ".join(missing))], "gate string, ok boolean, detail string")
    n = F.count(F.lit(1))
    if "edges" in tables:
        gates = gates.union(tables["edges"].agg(n.alias("n")).select(
            F.lit("enough_edges"), F.col("n") >= min_edges, F.format_string("%d edges", "n")))
    if "samples" in tables:
        samples = tables["samples"]
        lost = samples.join(horizon, "sample_id", "left_anti").agg(n.alias("lost"))
        extra = horizon.join(samples, "sample_id", "left_anti").agg(n.alias("extra"))
        shape = horizon.agg(F.count_if((F.size("opaque") != AZIMUTH_BINS) | (F.size("canopy") != AZIMUTH_BINS)
                                       | (F.size("tau_q") != AZIMUTH_BINS)).alias("misshapen"))
        gates = gates.union(lost.crossJoin(extra).crossJoin(shape).select(
            F.lit("horizon_matches"), F.expr("lost + extra + misshapen = 0"),
            F.format_string("%d samples without horizon, %d horizons without sample, %d misshapen", "lost", "extra", "misshapen")))
    return gates
