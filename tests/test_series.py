import pytest
from pyspark.sql import functions as F

from tallyloom.operators.series import long_series, series


@pytest.mark.parametrize("policy", ["pending", "carry", "zero"])
def test_a_long_series_is_a_series(spark, policy):
    """One long series, short ones and one without a name; gaps; more ranges than rows of most."""
    rows = [("long", i, None if i % 5 == 0 else i) for i in range(300)] + [(k, i, i * 2) for k in ("a", None) for i in range(4)]
    table = spark.createDataFrame(rows, "k string, i int, v bigint").withColumn("cell", F.when(F.col("i") % 7 != 3, F.concat(F.lit("B"), F.col("i").cast("string")))).repartition(3)
    out = ("k", "i", "step", "running_total", "pending", "n_cells", "step_cell")
    want = sorted(map(str, series(table, "v", ["k"], "i", policy, "cell").select(*out).collect()))
    for n in (1, 16):
        got = long_series(table, "v", ["k"], "i", policy, n, "cell")
        assert sorted(map(str, got.select(*out).collect())) == want
    assert got.select(F.spark_partition_id()).distinct().count() >= 1
    with pytest.raises(ValueError, match="null policy"):
        long_series(table, "v", ["k"], "i", "other")
