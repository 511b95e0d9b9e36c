"""Readers, writers and the shared-folder hand-over between stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headered CSV in which ``NA`` means null. A header that differs from the schema, or a malformed row, is an error."""
    reader = spark.read.schema(schema).option("header", True).option("nullValue", "NA")
    return reader.option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_bundle(frames: dict[str, DataFrame], path: str) -> None:
    """Store named results together.

    Members go to a folder of their own; one row, appended to the manifest after
    all of them, makes them the bundle. A write that ends before leaves the
    former bundle as it was. One writer at a time.
    """
    spark = next(iter(frames.values())).sparkSession
    version = _last_version(spark, path) + 1
    folder = f"{version:08d}-{uuid.uuid4().hex}"
    for name, frame in frames.items():
        write_table(frame, f"{path}/members/{folder}/{name}")
    entry = spark.createDataFrame([(version, folder, list(frames))], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


MANIFEST = "version long, folder string, names array<string>"


def _manifest(spark: SparkSession, path: str) -> list[Row]:
    """Entries, the newest first; none where nothing was ever stored."""
    try:
        entries = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        return entries.orderBy("version", ascending=False).collect()  # one row per write
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _last_version(spark: SparkSession, path: str) -> int:
    return max((e.version for e in _manifest(spark, path)), default=0)


def read_bundle(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The members of the last complete bundle, or those named."""
    entries = _manifest(spark, path)
    if not entries:
        raise ValueError(f"no bundle at {path}")
    last = entries[0]
    wanted = last["names"] if names is None else names
    if absent := sorted(set(wanted) - set(last["names"])):
        raise ValueError(f"not in the bundle: {', '.join(absent)}")
    return {name: read_table(spark, f"{path}/members/{last.folder}/{name}") for name in wanted}


def remove_former(spark: SparkSession, path: str) -> list[str]:
    """Delete the member folders of all but the last bundle, and those of writes that did not end. Nobody may read them any more."""
    entries = _manifest(spark, path)
    members = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/members")
    system = members.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = {f.getPath().getName(): f.getPath() for f in system.listStatus(members)} if entries else {}
    gone = sorted(name for name in folders if name != entries[0].folder)
    for name in gone:
        system.delete(folders[name], True)
    return gone


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint location that the cluster names.

    Only a local session may fall back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fieldspark-")
    return f"{root}/fieldspark-{uuid.uuid4().hex}"


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside go when the write ends, not when the driver next collects garbage."""
    former = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, former)


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage (lost executors re-read files, not history) and, unlike an
    RDD checkpoint, keeps column pruning, filter push-down and size statistics
    for the stages that follow.
    """
    path = shared_folder(df.sparkSession)
    with shuffles_released(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
