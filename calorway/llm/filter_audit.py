"""What each filter on route texts removes, in every order, counted while files of routes stream in.

All files are processed as available-now micro-batches. Four filters look at one text alone; the fifth asks whether an
earlier route already has the same text, which no batch can know: a route with a smaller id may still arrive. So the text
is the key of a state that holds the smallest id seen and what was counted for it. When a smaller id arrives, the counts
of the former holder are retracted and given again with the fifth bit set. Batches write signed counts by label and mask of
failed filters; their sum is exact after every batch, whatever the order of the files.

The state is a table in the shared folder, one part per batch: a batch reads only the newest rows of the texts that it
holds itself and writes only these. A batch that runs again after a failure replaces its own parts.
"""

from __future__ import annotations

import itertools
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint_root
from .common import drop_table, words_of, write_table

LETTERS = "ABCDE"
REPEATED = 1 << LETTERS.index("E")
ROUTE_FILES = "route_id long, label string, text string"
_WHAT = ["mask", "label", "good", "toxic"]
_SIGNED = "label string, mask int, good boolean, toxic boolean, n long"
_STATE = "text_key binary, mask int, label string, good boolean, toxic boolean, least long, n long, batch int"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the four filters that look at one text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = words_of(text)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _folded(rows: DataFrame) -> DataFrame:
    """Rows of one text, label and judgment as one row: the least id, how many rows have it, and how many a larger one.

    Rows are counted per id first, so both steps combine before they shuffle and a hot text never travels row by row.
    """
    each = rows.groupBy("text_key", *_WHAT, "route_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct("route_id", "n"))
    return each.groupBy("text_key", *_WHAT).agg(first.alias("first"), F.sum("n").alias("all")).select(
        "text_key", *_WHAT, F.col("first.route_id").alias("least"), F.col("first.n").alias("n"), (F.col("all") - F.col("first.n")).alias("n_more"), F.lit(False).alias("old"))


def _known(spark, root: str, batch: int, keys: DataFrame) -> DataFrame:
    """What the state holds for the texts of a batch: the rows that the newest earlier batch wrote for each."""
    try:
        state = spark.read.schema(_STATE).parquet(f"{root}/state").filter(F.col("batch") < batch)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        state = spark.createDataFrame([], _STATE)
    mine = state.join(keys, "text_key", "left_semi")
    newest = F.max("batch").over(W.partitionBy("text_key"))
    return mine.withColumn("_newest", newest).filter("batch = _newest").select("text_key", *_WHAT, "least", "n", F.lit(0).cast("long").alias("n_more"), F.lit(True).alias("old"))


def _apply(rows: DataFrame, batch: int, root: str) -> None:
    """Count one batch: its new rows, and the retraction of rows that a smaller id of the batch overtakes."""
    spark = rows.sparkSession
    rows = write_table(rows, "audit-rows")
    new = write_table(_folded(rows.filter("route_id IS NOT NULL")), "audit-folded")
    # a text has at most four rows per label here, so its window stays small
    both = new.unionByName(_known(spark, root, batch, new.select("text_key").distinct()))
    judged = write_table(both.withColumn("smallest", F.min("least").over(W.partitionBy("text_key"))), "audit-judged")
    holds = F.col("least") == F.col("smallest")
    failed = F.col("mask").bitwiseOR(F.lit(REPEATED))
    # an old row was counted before: it is moved when it no longer holds the smallest id
    moves = F.array(
        F.struct(F.when(holds, F.col("mask")).otherwise(failed).alias("mask"), F.when(F.col("old") & holds, F.lit(0)).otherwise(F.col("n")).alias("n")),
        F.struct(F.col("mask").alias("mask"), F.when(F.col("old") & ~holds, -F.col("n")).otherwise(F.lit(0)).alias("n")),
        F.struct(failed.alias("mask"), F.col("n_more").alias("n")))
    signed = judged.select("label", "good", "toxic", F.explode(moves).alias("m")).select("label", "m.mask", "good", "toxic", "m.n")
    free = rows.filter("route_id IS NULL").select("label", "mask", "good", "toxic", F.lit(1).cast("long").alias("n"))
    counts = signed.filter("n <> 0").unionByName(free).groupBy("label", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    held = judged.filter(holds).groupBy("text_key", *_WHAT).agg(F.min("least").alias("least"), F.sum("n").alias("n"))
    held.write.mode("overwrite").parquet(f"{root}/state/batch={batch}")
    counts.write.mode("overwrite").parquet(f"{root}/counts/batch={batch}")
    for table in (rows, new, judged):
        drop_table(table)


def count_masks(routes: DataFrame, judgments: DataFrame) -> DataFrame:
    """(label, mask, good, toxic, n): routes of a stream by label, failed filters (bit 0 is A) and judgment.

    `routes` is a streaming DataFrame with route_id, label and text; `judgments` has route_id, quality and toxic (0 or 1;
    of rows that contradict each other the larger value counts). Runs until all files there are have been read. A batch
    that is run again after a failure replaces its own counts. A null route_id is smaller or larger than none.
    """
    spark = routes.sparkSession
    root = f"{checkpoint_root(spark)}/streams/filter-audit-{uuid.uuid4().hex}"
    marks = judgments.filter("route_id IS NOT NULL").groupBy(F.col("route_id").alias("_judged")).agg(
        F.coalesce(F.max("quality") == 1, F.lit(False)).alias("_good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).alias("_toxic"))
    marks = write_table(marks, "judgments")
    mask = sum((F.when(fails, 1 << LETTERS.index(k)).otherwise(0) for k, fails in text_filters(F.col("text")).items()), F.lit(0))
    text_key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    seen = routes.select("route_id", F.coalesce("label", F.lit("")).alias("label"), text_key.alias("text_key"), mask.alias("mask"))
    seen = seen.join(marks, F.col("route_id") == F.col("_judged"), "left").select(
        "text_key", "mask", "label", F.coalesce("_good", F.lit(False)).alias("good"), F.coalesce("_toxic", F.lit(False)).alias("toxic"), "route_id")
    query = (seen.writeStream.foreachBatch(lambda batch, number: _apply(batch, number, root))
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    try:
        counted = spark.read.schema(_SIGNED).parquet(f"{root}/counts")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], _SIGNED)
    return counted.groupBy("label", "mask", "good", "toxic").agg(F.sum("n").alias("n")).filter("n <> 0")


def audit_steps(masks: DataFrame) -> DataFrame:
    """One row per label, order of the five filters and step, from counts by mask.

    Columns: label, filter_order, step (1-5), kept (after this step), removed (here), redundant (fail this filter, removed
    earlier), unique_fails (fail this filter only), good_lost and toxic_lost (removed here, judged so), shapley (what the
    filter removes, summed over all orders). A route that fails k filters is removed by each of them in 120 / k orders.
    """
    steps = []
    for order in itertools.permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            steps.append({"filter_order": "".join(order), "step": step, "bit": bit, "earlier": before})
            before |= bit
    orders = len(steps) // len(LETTERS)
    told = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,earlier:int>>")
    n = F.col("n")
    counts = masks.groupBy("label", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
                                                F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))
    rows = counts.select("*", F.explode(told).alias("s")).select("label", "mask", "n", "good", "toxic", "s.*")
    mask, bit, earlier = F.col("mask"), F.col("bit"), F.col("earlier")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(earlier) != 0

    def total(when: Column, value: Column) -> Column:
        return F.sum(F.when(when, value).otherwise(0)).cast("long")

    return rows.groupBy("label", "filter_order", "step").agg(
        total(~fails & ~gone, n).alias("kept"), total(fails & ~gone, n).alias("removed"), total(fails & gone, n).alias("redundant"),
        total(mask == bit, n).alias("unique_fails"), total(fails & ~gone, F.col("good")).alias("good_lost"),
        total(fails & ~gone, F.col("toxic")).alias("toxic_lost"),
        total(fails, F.expr(f"n * ({orders} div greatest(bit_count(mask), 1))")).alias("shapley"))


def audit_filters(routes: DataFrame, judgments: DataFrame) -> DataFrame:
    """Audit of the five filters over a stream of route files: `count_masks`, then `audit_steps`.

    Parameters
    ----------
    routes : streaming DataFrame of route files (route_id, label, text); further columns are not read.
    judgments : (route_id, quality, toxic) of some routes.

    Returns one row per label, order and step, 600 a label, zeros included. A null label or text counts as empty; a route
    fails the fifth filter when any route of any label has a smaller id and the same text; rows that share an id are rows
    of their own and do not fail for each other; a null id neither fails it nor makes others fail; no files give no rows.
    """
    return audit_steps(count_masks(routes, judgments))


def read_route_files(spark, path: str, schema, batches: int = 4) -> DataFrame:
    """Route files at a path as a stream that deals them to about so many micro-batches."""
    files = len(spark.read.parquet(path).inputFiles())
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // batches)))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile():
        # a stream reads folders: the folder of a single file, and of it that file
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)
