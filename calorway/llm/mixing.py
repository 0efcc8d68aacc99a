"""Mixing texts of several sources to target weights by systematic sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import running_start
from .common import words_of

#: Offsets are multiples of 2^-20, so that whole rates add without rounding.
OFFSET_HEX = 5


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.size(words_of(text)).cast("long")


#: weights are told apart to a millionth
WEIGHT_UNIT = 1_000_000


def _offset(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, the same in every run with this seed."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")))
    return F.conv(F.substring(F.md5(name), 1, OFFSET_HEX), 16, 10).cast("double") / float(16 ** OFFSET_HEX)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(label, source_size, target) from `sizes` (label, source_size), a row per label.

    Labels in code point order, null last, take the weights in turn. `share` of all sizes
    is dealt by weight; no target passes `most` times its source, and what is over goes to
    the others by weight until none is above. That is a level: with labels ordered by
    cap / weight, those before the level get their cap and the rest level * weight. The
    orders are two-level running sums, so the number of labels is not bounded by a task.
    """
    ranked = running_start(sizes.withColumns({"_null": F.col("label").isNull(), "_one": F.lit(1)}), "_one", ["_null", "label"], "_rank")
    ranked = (ranked.withColumn("_weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double"))
              .withColumn("_cap", most * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("_weight"))
              .select("label", "source_size", "_weight", "_cap", "_level", "_rank"))
    before = running_start(ranked.withColumn("_both", F.col("source_size")), "_both", ["_level", "_rank"], "_below")
    # weights as the whole numbers of a common unit, so that their running sum is exact
    before = running_start(before.withColumn("_whole", F.rint(F.col("_weight") * WEIGHT_UNIT).cast("long")), "_whole", ["_level", "_rank"], "_passed")
    before = before.withColumn("_passed", F.col("_passed") / float(WEIGHT_UNIT))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("_total"), F.coalesce(F.sum("_weight"), F.lit(0.0)).alias("_weights"))
    # the level if this label and all after it stay below their caps
    fits = (before.crossJoin(F.broadcast(total))
            .withColumn("_here", (share * F.col("_total") - most * F.col("_below")) / (F.col("_weights") - F.col("_passed"))))
    level = fits.filter("_here <= _level").agg(F.max("_here").alias("_flat"))
    return (ranked.crossJoin(F.broadcast(level))
            .select("label", "source_size", F.when(F.col("_flat").isNull() | (F.col("_level") <= F.col("_flat")), F.col("_cap"))
                    .otherwise(F.col("_flat") * F.col("_weight")).alias("target")))


def mix_routes(routes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """(route_id, label, size, source_size, target, copies, taken) for every row of `routes` (route_id, label, text or size).

    `label` is the source of a route. Every text of a source is expected target /
    source_size times; the expected copies are added up in the order of (size, route_id)
    within the source, one offset is added, and a text is emitted once per whole number
    that its stretch crosses. Sorting by size spreads long and short texts evenly. `taken`
    is copies * size; a rate of at most `most` crosses at most as many whole numbers as the
    next whole number of `most`.

    A null label is a source of its own. Empty or null texts have size 0 and take 0 words;
    a source without words has target 0. Repeated rows count each. An empty table gives no
    row; other columns are ignored.
    """
    size = F.col("size").cast("long") if "size" in routes.columns else word_count(F.col("text"))
    sized = routes.select("route_id", "label", size.alias("size"), F.lit(1).alias("_one"), F.col("label").isNull().alias("_null"))
    ranked = running_start(sized, "_one", ["_null", "label", "size", "route_id"], "_at")
    sums = ranked.groupBy("label").agg(F.sum("size").alias("source_size"), F.min("_at").alias("_first"))
    targets = source_targets(sums.select("label", "source_size"), weights, share, most).withColumnRenamed("label", "_label")
    plan = (sums.join(targets.drop("source_size"), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
            .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
            .withColumn("_offset", _offset(F.col("label"), seed)).withColumnRenamed("label", "_source"))
    k = F.col("_at") - F.col("_first")
    crossed = F.floor((k + 1) * F.col("_rate") + F.col("_offset")) - F.floor(k * F.col("_rate") + F.col("_offset"))
    return (ranked.join(plan, F.col("label").eqNullSafe(F.col("_source")))
            .withColumn("copies", F.least(crossed, F.lit(math.ceil(most))).cast("long"))
            .select("route_id", "label", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))
