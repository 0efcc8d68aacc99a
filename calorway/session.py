"""Session settings and materialisation of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: rows of both sides of a join that one task sorts
ROWS_PER_TASK = 1_000_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  driver_memory: str = "20g", app: str = "calorway") -> SparkSession:
    """A session for local runs; on a cluster use the one the cluster hands you."""
    return (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder is lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="calorway-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over the session's shuffle partitions: a small file is read by one task, which would multiply its rows alone."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def in_tasks(side: DataFrame, rows: int, *keys: str) -> DataFrame:
    """One side of a join of `rows` rows in all, dealt by its keys over tasks of ROWS_PER_TASK where the session's shuffle partitions would hold more."""
    tasks = -(-rows // ROWS_PER_TASK)
    return side.repartition(tasks, *keys) if tasks > int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")) else side


def materialize(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage once and read it back, split into folders by some columns if asked.

    Cuts the lineage, survives executor loss, and gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tables/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a stage written by materialize that nothing reads any more; of other data, nothing."""
    spark = df.sparkSession
    root = f"{checkpoint_root(spark).rstrip('/')}/tables/".split(":", 1)[-1].replace("//", "/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.lstrip("/") in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
