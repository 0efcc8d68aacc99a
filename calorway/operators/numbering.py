"""Contiguous ids and running totals without a one-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def _ranged(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Rows in globally ordered partitions, tagged with their partition.

    Written out once: the partition numbers must be the same in the pass that
    counts and in the pass that numbers, also after an executor is lost.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order_by])
    return materialize(ranged.withColumn("_part", F.spark_partition_id()), "ranged")


def _offsets(totals: DataFrame) -> DataFrame:
    """(_part, _offset): the totals of all partitions before; one row per partition, whatever the data size."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))


def running_start(df: DataFrame, value: str, order_by: list[str], name: str) -> DataFrame:
    """Exclusive running sum of `value` in the order given.

    Two levels: a window inside each range partition, plus the totals of earlier
    partitions. The totals have one row per partition, whatever the data size.
    """
    rows = _ranged(df, order_by)
    offsets = _offsets(rows.groupBy("_part").agg(F.sum(value).alias("_total")))
    inner = W.partitionBy("_part").orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    return (rows.join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_offset") + F.coalesce(F.sum(value).over(inner), F.lit(0))).cast("long"))
            .drop("_part", "_offset"))


def contiguous_ids(df: DataFrame, name: str, order_by: list[str]) -> DataFrame:
    """0..n-1 in the order given, which should be unique.

    Rows are shuffled once: they are counted where the range partitions are sorted, and
    the low 33 bits of the ids that Spark gives there are the place in the partition.
    """
    ranged = df.drop(name).repartitionByRange(*[F.col(c) for c in order_by]).sortWithinPartitions(*order_by)
    place = F.monotonically_increasing_id()
    rows = materialize(ranged.withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}), "ranged")
    offsets = _offsets(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_total")))
    return (rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_place"))
            .select(name, *[c for c in df.columns if c != name]))


def order_statistics(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: n, and for every name the value at that share of the sorted rows, between ranks by linear interpolation.

    Rows are counted per value, the counts are summed up in two levels, and each wanted rank is picked where its
    stretch lies; no task holds the column. Nulls are left out; without rows n is 0 and the values are null.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_start(counts, "_c", ["_v"], "_start")
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"))
    placed = ranked.crossJoin(F.broadcast(total))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_c")), F.col("_v")))

    picks = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * F.lit(float(share))
        picks += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    found = placed.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *picks)
    return found.select("n", *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")).alias(n) for n in shares])
