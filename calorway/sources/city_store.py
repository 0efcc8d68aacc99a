"""Versioned city folders: tables under a build id, and a manifest that is written last.

    tables/<name>/<build id>/   the files of one table, never changed once a manifest names them
    manifests/<version>/        one small file: which folder holds each table in that version

Readers follow the newest manifest, so a build that fails half-way is never seen: its folders are named by no manifest.
A version that replaces some tables shares the folders of the others with the version before it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..schemas import CITY_TABLES
from .tables import conform, read_city_table

MANIFEST = "version long, build_id string, table_name string, folder string, n_rows long"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """All committed manifests, one row per version and table; no rows where nothing was built yet."""
    try:
        # a manifest in the making lies in a hidden folder, which the reader skips
        return spark.read.schema(MANIFEST).json(f"{root}/manifests/*")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], MANIFEST)


def city_version(spark: SparkSession, root: str, version: int | None = None) -> dict:
    """{version, build_id, tables: {name: folder}, rows: {name: count}} of a version, the newest unless one is given.

    version 0 without tables where nothing was built yet; a version that is not there raises LookupError.
    """
    every = manifests(spark, root)
    wanted = every.agg({"version": "max"}).first()[0] if version is None else version
    # one row per contract table
    rows = every.filter(every.version == wanted).collect() if wanted is not None else []
    if not rows:
        if version is not None:
            raise LookupError(f"no version {version} at {root}")
        return {"version": 0, "build_id": None, "tables": {}, "rows": {}}
    return {"version": wanted, "build_id": rows[0]["build_id"], "tables": {r["table_name"]: r["folder"] for r in rows},
            "rows": {r["table_name"]: r["n_rows"] for r in rows}}


def read_version(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A city table of a version, refused with all its problems when it breaks the contract."""
    folders = city_version(spark, root, version)["tables"]
    if name not in folders:
        raise LookupError(f"no table {name!r} at {root}")
    return read_city_table(spark, root, name, folders[name])


def write_version(spark: SparkSession, root: str, build_id: str, tables: dict[str, DataFrame],
                  partition_by: dict[str, list[str]] | None = None) -> int:
    """Write tables under a build id, then the manifest; returns the new version.

    Tables that are not given are shared with the version before; a first version needs all six. A build that failed may
    be run again under its id and replaces its own files. An id that a manifest names is refused, and so is a version that
    another build committed meanwhile.
    """
    unknown = sorted(set(tables) - set(CITY_TABLES))
    before = city_version(spark, root)
    missing = [n for n in CITY_TABLES if n not in tables and n not in before["tables"]]
    if unknown or missing:
        raise ValueError(f"unknown tables {unknown}, missing tables {missing}")
    if not manifests(spark, root).filter(f"build_id = '{build_id}'").isEmpty():
        raise ValueError(f"build id {build_id!r} is in use")
    version, rows = before["version"] + 1, []
    for name in CITY_TABLES:
        folder = before["tables"].get(name)
        if name in tables:
            folder = f"tables/{name}/{build_id}"
            out = conform(name, tables[name]).write.mode("overwrite").option("compression", "zstd")
            keys = (partition_by or {}).get(name)
            (out.partitionBy(*keys) if keys else out).parquet(f"{root}/{folder}")
        count = read_city_table(spark, root, name, folder).count() if name in tables else before["rows"][name]
        rows.append((version, build_id, name, folder, count))
    # one task, one file: it appears as a whole or not at all
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").json(f"{root}/manifests/v{version:09d}")
    return version
