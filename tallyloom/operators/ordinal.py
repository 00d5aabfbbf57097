"""Global ordinals: the place of each row in an order over the whole table, without a window that holds all rows.

Rows are dealt out by ranges of the order, sorted inside their range, and numbered there; the sizes of the ranges, one number for each
partition, give what comes before. `tie` is a column that tells rows apart (a row number of a written table will do): it breaks ties
and lets one often repeated key spread over many ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

#: monotonically_increasing_id: the partition stands above, the row in it below this many bits.
_ROW_BITS = 33


def ordinals(rows: DataFrame, order: Sequence[Column], tie: str, ordinal: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Adds `ordinal`, from 1. order: sort columns such as F.desc("score"); a null stands where its sort column says."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.asc(tie)]
    dealt = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(dealt, "ordinals")
    part = F.shiftrightunsigned("__at", _ROW_BITS)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 1, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    first = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in offsets or [1]]), (part + 1).cast("int"))
    return placed.withColumn(ordinal, first + F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("__at")
