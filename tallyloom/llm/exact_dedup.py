"""Exact deduplication: group by 128-bit content hash, keep the smallest id, compare bytes inside groups.

Texts count as equal when they are identical after each run of ASCII white space became one space; a null text
counts as empty. Groups are built by (hash, normalised text): partial aggregation brings one row for each
distinct text of a task to the shuffle, and texts that share a hash but differ in bytes stay apart. Documents then
meet their group by the hash; a hash under which texts differ is looked up by the text as well.

Defined results: a null id sorts after all others; of rows that share both id and text one stays; a group
of null ids only keeps one row; an empty table gives an empty result; extra columns pass through `drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, id_key, materialize, named_as, plain, text_of


def _normalised(text: Column) -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=lambda norm: F.unhex(F.md5(norm))) -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256, text_hash."""
    own, id_, text = plain(docs, id_col, text_col)
    rows = own.select(id_.alias("id"), _normalised(text).alias("norm")).withColumn("h", digest(F.col("norm")))
    classes = rows.groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = classes.withColumn("n_texts", F.count(F.lit(1)).over(W.partitionBy("h")))
    slim = materialize(classes.where("group_size > 1 OR n_texts > 1").select("h", "keep_id", "group_size", "n_texts"), "copy_groups")
    groups = slim.where("n_texts = 1").select("h", "keep_id", "group_size")
    own = rows.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"))
    if slim.where("n_texts > 1").isEmpty():
        found = own.join(groups, "h", "left")
    else:  # hash collisions: those rows meet their group by the text
        mixed = classes.where("n_texts > 1").select(F.col("h").alias("mixed_h"), F.col("norm").alias("mixed_norm"), F.col("keep_id").alias("mixed_id"), F.col("group_size").alias("mixed_size"))
        apart = rows.join(mixed, (rows.h == mixed.mixed_h) & (rows.norm == mixed.mixed_norm), "left")
        apart = apart.select("id", "h", F.unhex(F.sha2("norm", 256)).alias("sha"), "mixed_id", "mixed_size").join(groups, "h", "left")
        found = apart.select("id", "h", "sha", F.coalesce("mixed_id", "keep_id").alias("keep_id"), F.coalesce("mixed_size", "group_size").alias("group_size"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    found = found.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), "h", "sha")
    first = F.row_number().over(W.partitionBy("id", "sha").orderBy("keep_id")) == 1
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & first
    return found.select("id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("h").alias("text_hash"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    keepers = copies(docs, id_col, text_col).where("kept").select(id_key(F.col("id")).alias("key"), F.col("text_sha256").alias("sha"))
    own, id_, text = plain(docs, id_col, text_col)
    own = own.withColumn("key", id_key(id_)).withColumn("sha", F.sha2(_normalised(text), 256))
    # the window stands on the join's partitioning: texts are dealt out once here
    kept = own.join(keepers, ["key", "sha"], "left_semi")
    first = F.row_number().over(W.partitionBy("key", "sha").orderBy(F.lit(1)))
    return named_as(kept.withColumn("row", first).where("row = 1"), docs)
