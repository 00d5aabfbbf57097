"""Scratch tables: written once to the folder that the cluster shares, so that a lost executor costs no more than its own tasks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []

#: Rows of a few numbers that a file of a scratch table holds.
FILE_ROWS = 1_000_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Without one, a local session gets a folder of its own and any other is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/tallyloom-{uuid.uuid4().hex}/{label}"
    _MADE.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back. rows: of a slim table, so that it has few files and not one for each partition."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if rows is not None:
        df = df.coalesce(rows // FILE_ROWS + 12)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def marked() -> int:
    """How many scratch tables there are, for `release`."""
    return len(_MADE)


def release(spark: SparkSession | None = None, since: int = 0) -> None:
    """Delete the scratch tables made so far, or since a mark; results that read them must be consumed first."""
    while len(_MADE) > since:
        own, path = _MADE.pop()
        try:
            delete_path(spark or own, path)
        except Exception:  # noqa: BLE001  the session may have ended, which is no error while leaving
            continue


atexit.register(release)
