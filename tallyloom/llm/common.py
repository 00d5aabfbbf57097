"""Shared pieces of the corpus operators: reading, hashing, and the scratch tables of `sources.scratch`."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import marked, materialize, release, scratch_path  # noqa: F401  the operators take them from here

#: A word, and the white space between words, of every contract.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def plain(docs: DataFrame, *names: str) -> tuple[DataFrame, ...]:
    """docs with its columns named c0, c1, .., and the Column of each name, so that no other column's name can clash with ours.

    A name means the column that has it, else the only one that has it but for case.
    """
    own = docs.columns
    at = []
    for name in names:
        loose = [i for i, c in enumerate(own) if c.lower() == name.lower()]
        at.append(own.index(name) if name in own else loose[0])
    return docs.toDF(*[f"c{i}" for i in range(len(own))]), *[F.col(f"c{i}") for i in at]


def named_as(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns c0, c1, .. under their own names again; changed: others in their place."""
    return rows.select(*[changed.get(f"c{i}", F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def id_key(value: Column) -> Column:
    """An id as text that is never null, so that joins and windows over it share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
