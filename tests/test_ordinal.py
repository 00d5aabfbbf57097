from pyspark.sql import functions as F

from tallyloom.operators.ordinal import ordinals


def test_ordinals(spark):
    """Nulls, ties and one key that most rows share; more ranges than rows."""
    rows = [(i, None if i % 7 == 0 else 5 if i % 3 else i) for i in range(200)]
    table = spark.createDataFrame(rows, "tie bigint, v bigint").repartition(5)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for n in (1, 7, 300):
        got = ordinals(table, [F.desc_nulls_last("v")], "tie", "place", n).orderBy("place").collect()
        assert [(r["tie"], r["v"]) for r in got] == want
        assert [r["place"] for r in got] == list(range(1, 201))


def test_of_nothing(spark):
    assert ordinals(spark.createDataFrame([], "tie bigint, v bigint"), [F.asc("v")], "tie").collect() == []
