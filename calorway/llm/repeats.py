"""Spark steps that word and byte repeats share: anchored runs, their classes, and the texts behind them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import text_runs
from .common import drop_table, write_table

LAST = (1 << 63) - 1
RUNS = "anchor long, d1 long, d2 long, order long, key long, start long, count long"


def keyed_texts(routes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(route_id, order, key, text, carried): order is the id as a number, null after all others; key is a hash of the text.

    Rows of one id and text are one text; rows of one id and different texts are told apart by key.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return routes.select("route_id", F.coalesce(F.col("route_id").cast("long"), F.lit(LAST)).alias("order"),
                         F.xxhash64(text).alias("key"), text.alias("text"), F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried"))


def _runs(texts: DataFrame, prepare: Callable, units: Callable, window: int, gram: int, anchors_only: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            order, key = batch["order"].to_numpy(), batch["key"].to_numpy()
            prepared = [prepare(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]
            for own, start, count, anchor, d1, d2 in text_runs(prepared, units, window, gram, digests=not anchors_only):
                if anchors_only:
                    yield pd.DataFrame({"anchor": anchor, "order": order[own]})
                else:
                    yield pd.DataFrame({"anchor": anchor, "d1": d1, "d2": d2, "order": order[own], "key": key[own], "start": start, "count": count})
    return texts.select("order", "key", "text").mapInPandas(run, "anchor long, order long" if anchors_only else RUNS)


def repeated_runs(texts: DataFrame, prepare: Callable, units: Callable, window: int, gram: int, across: bool) -> DataFrame:
    """Runs whose anchor occurs again, in a text of another id when `across`.

    The texts are scanned twice: once for bare anchors, which settles what repeats, and
    once for whole runs, so that runs seen once are never written.
    """
    seen = _runs(texts, prepare, units, window, gram, True).groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("order").alias("lo"), F.max("order").alias("hi"))
    again = write_table(seen.filter("lo < hi" if across else "n > 1").select(F.col("anchor").alias("_anchor")), "anchors")
    runs = _runs(texts, prepare, units, window, gram, False)
    found = write_table(runs.join(again, F.col("anchor") == F.col("_anchor"), "left_semi"), "runs")
    drop_table(again)
    return found


def run_classes(runs: DataFrame) -> DataFrame:
    """One row per content of a run: its first place (order, key, start), its windows and whether its anchor has other contents.

    A passage that stands in a third of all texts is one class here, however often it occurs.
    """
    classes = write_table(runs.groupBy("anchor", "d1", "d2").agg(
        F.min(F.struct("order", "key", "start")).alias("first"), F.min("count").alias("count")), "classes")
    mixed = classes.groupBy(F.col("anchor").alias("_anchor")).agg(F.count(F.lit(1)).alias("n_classes"))
    return classes.join(mixed, F.col("anchor") == F.col("_anchor")).drop("_anchor")


def later_members(runs: DataFrame, classes: DataFrame, is_later: Column) -> DataFrame:
    """(order, key, start, count, first): runs whose whole content stands at an earlier place."""
    named = classes.select(F.col("anchor").alias("_a"), F.col("d1").alias("_1"), F.col("d2").alias("_2"), "first")
    return (runs.join(named, (F.col("anchor") == F.col("_a")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")))
            .filter(is_later).select("order", "key", "start", "count", "first"))


def text_lists(rows: DataFrame, texts: DataFrame, items: list[str], how: str) -> DataFrame:
    """`texts` with the sorted list of its rows' `items` as `items`; a list is bounded by its text."""
    lists = rows.groupBy(F.col("order").alias("_order"), F.col("key").alias("_key")).agg(
        F.array_sort(F.collect_list(F.struct(*items))).alias("items"))
    return texts.join(lists, (F.col("order") == F.col("_order")) & (F.col("key") == F.col("_key")), how).drop("_order", "_key")


def covered(starts, counts, length: int, window: int) -> np.ndarray:
    """Flags of the units that windows [start, start + count) cover; no list covers none."""
    edge = np.zeros(length + 1, np.int32)
    if starts is not None and len(starts):
        starts, counts = np.asarray(starts, np.int64), np.asarray(counts, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + counts + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def stretches(flags: np.ndarray) -> np.ndarray:
    """(first, end) of every run of set flags."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).reshape(-1, 2)


def column_of(name: str) -> Column:
    """One field of the items of a list, as an array of its own."""
    return F.transform("items", lambda x: x[name])
