"""Column helpers and written tables shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_root

SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once per row, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column, gaps: str = r"[\x20\x09-\x0D]+") -> Column:
    """Words of a text between `gaps`; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gaps), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: lists that collect the folders of written tables while a `recorded` block is open
_RECORDS: list[list[str]] = []


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back: short lineage, safe when executors are lost."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{label}-{uuid.uuid4().hex}"
    for record in _RECORDS:
        record.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that write_table fills inside the block."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.remove(made)


def drop_folders(spark, folders: list[str], still_read: DataFrame) -> None:
    """Delete folders of written tables, but for those that a table still reads."""
    used = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in still_read.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 1)[-1] not in used:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by write_table that no later step reads."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rows_in(df: DataFrame) -> int:
    """Row count, used to prove a bound before a broadcast."""
    return df.count()
