"""Long word passages that an earlier text already has, found as repeated paths of a word de Bruijn graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import repeats as R
from .anchors import word_units
from .common import drop_table, write_table

GRAM = 12


def joined_words(text: bytes) -> bytes:
    """Words [^\\x20\\x09-\\x0D]+ joined by single spaces."""
    return b" ".join(text.split())


#: window hashes that a task holds before it hands them on
WINDOWS_AT_ONCE = 1 << 17


def _window_rows(window: int):
    """Hashes of every window of the listed runs: the edges of the graph that are still open."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def packed(parts):
            half = np.frombuffer(b"".join([d for p in parts for d in p[0]]), "<i8").reshape(-1, 2)
            sizes = [len(p[1]) for p in parts]
            return pd.DataFrame({"w1": half[:, 0], "w2": half[:, 1], "order": np.repeat([p[3] for p in parts], sizes), "key": np.repeat([p[4] for p in parts], sizes),
                                 "start": np.concatenate([p[1] for p in parts]), "run": np.concatenate([p[2] for p in parts])})

        parts, held = [], 0
        for batch in batches:
            for text, begin, count, order, key in zip(batch["text"], batch["start"], batch["count"], batch["order"].tolist(), batch["key"].tolist()):
                words = joined_words(text.encode("utf-8", "surrogatepass"))
                first, last = word_units(words)
                starts = np.repeat(begin - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
                runs = np.repeat(begin, count)
                for at in range(0, len(starts), WINDOWS_AT_ONCE):
                    some = starts[at:at + WINDOWS_AT_ONCE]
                    digests = [xxhash.xxh3_128_digest(words[a:b]) for a, b in zip(first[some].tolist(), last[some + window - 1].tolist())]
                    parts.append((digests, some, runs[at:at + WINDOWS_AT_ONCE], order, key))
                    held += len(some)
                    if held >= WINDOWS_AT_ONCE:
                        yield packed(parts)
                        parts, held = [], 0
        if parts:
            yield packed(parts)
    return run


def compact_paths(flagged: DataFrame) -> DataFrame:
    """(order, key, start, count, first): stretches of repeated windows that run on in step with one source.

    A window and the next are edges that share a node. While both the text's and the
    source's coordinate advance together the path does not branch and becomes one row.
    """
    own = W.partitionBy("order", "key").orderBy("start", "count")
    ends = F.max(F.col("start") + F.col("count")).over(own.rowsBetween(W.unboundedPreceding, -1))
    lag = F.col("first.start") - F.col("start")
    breaks = (F.coalesce(ends < F.col("start"), F.lit(True)) | (F.coalesce(F.lag("first.key").over(own), F.lit(0)) != F.col("first.key"))
              | (F.coalesce(F.lag(lag).over(own), F.lit(0)) != lag))
    numbered = flagged.withColumn("_new", breaks.cast("int")).withColumn("_path", F.sum("_new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    return (numbered.groupBy("order", "key", "_path")
            .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("count")).alias("_end"), F.min("first").alias("first"))
            .select("order", "key", "start", (F.col("_end") - F.col("start")).alias("count"), "first"))


def repeated_passages(routes: DataFrame, window: int = 50, gram: int = GRAM) -> DataFrame:
    """(order, key, start, count, first): per text, stretches of windows that a smaller id has too.

    The edges of the graph are the windows of `window` words. Runs of edges with one
    anchor are paths that cannot branch inside; runs of equal content, wherever they
    occur, are one path class and need no look at their edges. Only where an anchor has
    several classes, next to the ends of a passage or an edited word, are single edges
    hashed and grouped, at the first place of each class; the other places that the class
    has under the same id get the same edges, moved to their own start. What repeats is
    compacted into stretches with source coordinates.
    """
    texts = R.keyed_texts(routes)
    runs = R.repeated_runs(texts, joined_words, word_units, window, gram, across=True)
    classes = R.run_classes(runs)
    later = R.later_members(runs, classes, F.col("first.order") < F.col("order"))
    open_runs = classes.filter("n_classes > 1").select("first.*", "count")
    listed = R.text_lists(open_runs, texts.select("order", "key", "text"), ["start", "count"], "inner")
    edges = write_table(listed.select("order", "key", "text", R.column_of("start").alias("start"), R.column_of("count").alias("count"))
                        .mapInPandas(_window_rows(window), "w1 long, w2 long, order long, key long, start long, run long"), "edges")
    shared = (edges.groupBy(F.col("w1").alias("_1"), F.col("w2").alias("_2"))
              .agg(F.min(F.struct("order", "key", "start")).alias("first"), F.max("order").alias("_hi")).filter("first.order < _hi"))
    single = write_table(edges.join(shared, (F.col("w1") == F.col("_1")) & (F.col("w2") == F.col("_2"))).filter("first.order < order")
                         .select("order", "key", "start", F.lit(1).cast("long").alias("count"), "first", "run"), "single")
    same = R.later_members(runs, classes.filter("n_classes > 1"), (F.col("first.order") == F.col("order")) & (F.col("first") != F.struct("order", "key", "start")))
    same = same.select(F.col("order").alias("_order"), F.col("key").alias("_key"), F.col("start").alias("_start"), "first.key", "first.start").distinct().toDF(
        "_order", "_key", "_start", "_first_key", "_first_start")
    moved = (single.join(same, (F.col("order") == F.col("_order")) & (F.col("key") == F.col("_first_key")) & (F.col("run") == F.col("_first_start")))
             .select("order", F.col("_key").alias("key"), (F.col("_start") + F.col("start") - F.col("run")).alias("start"), "count", "first"))
    found = write_table(compact_paths(later.unionByName(single.drop("run")).unionByName(moved)), "passages")
    for table in (runs, classes, edges, single):
        drop_table(table)
    return found


def remove_repeats(routes: DataFrame, window: int = 50, gram: int = GRAM, carry: tuple[str, ...] = ()) -> DataFrame:
    """(route_id, text, n_words, n_removed, spans, carried, whole) for every row of `routes` (route_id, text).

    A word goes if some window of `window` consecutive words over it also starts in a text
    with a smaller route_id; windows are judged on the input. `text` is the kept words
    joined by one space, `spans` the removed stretches (first_word, n_words), `carried` a
    struct of the columns that `carry` names, `whole` the text as it came (empty for null).

    Ids must be numbers; a null id counts as larger than any other, and equal ids take
    nothing from each other. Null and empty texts have no words and keep an empty text.
    Texts with fewer words than the window stay whole. Repeated rows stay, columns that are
    not carried are ignored, an empty table gives no row.
    """
    @F.pandas_udf("text string, n_words long, n_removed long, spans array<struct<first_word:long,n_words:long>>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, counts in parts:
            rows = []
            for text, s, n in zip(texts, starts, counts):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = R.covered(s, n, len(words), window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
                rows.append((kept.decode("utf-8", "surrogatepass"), len(words), int(gone.sum()),
                             [{"first_word": int(a), "n_words": int(b - a)} for a, b in R.stretches(gone)]))
            yield pd.DataFrame(rows, columns=["text", "n_words", "n_removed", "spans"])

    passages = repeated_passages(routes, window, gram)
    listed = R.text_lists(passages, R.keyed_texts(routes, carry), ["start", "count"], "left")
    return (listed.select("route_id", "carried", F.col("text").alias("whole"), cut("text", R.column_of("start"), R.column_of("count")).alias("_c"))
            .select("route_id", "_c.*", "carried", "whole"))
