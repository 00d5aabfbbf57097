import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import lineage
from tallyloom.operators.series import series


def islands(numbers):
    out = []
    for n in sorted(set(numbers)):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 16])
def test_runs_are_the_islands_of_each_group(spark, chunk):
    """Repeats, gaps, runs over several chunks, a null key, cells of two columns, and what is no cell."""
    rng = random.Random(chunk)
    rows = [(g, c, rng.randrange(1, 60)) for g in ("a", "b", None) for c in ("B", "AA") for _ in range(40)] + [("c", "B", n) for n in range(1, 50)]
    table = spark.createDataFrame([(g, f"{c}{n}") for g, c, n in rows] + [("a", None), ("a", "note"), ("d", None)], "g string, cell string").repartition(3)
    found = lineage.runs(table, ["g"], chunk=chunk)
    got = {}
    for r in found.collect():
        got.setdefault((r["g"], r["col"]), []).append((r["first"], r["last"]))
    assert {k: sorted(v) for k, v in got.items()} == {(g, c): islands([n for h, e, n in rows if (h, e) == (g, c)]) for g, c, _ in rows}
    lists = lineage.gathered(found, ["g"]).select("g", lineage.n_cells("runs").alias("n"), lineage.cells_of("runs").alias("cells")).collect()
    for r in lists:
        want = {f"{c}{n}" for g, c, n in rows if g == r["g"]}
        assert set(r["cells"]) == want and r["n"] == len(want) == len(r["cells"])


def test_nothing_has_no_runs(spark):
    none = spark.createDataFrame([], "g string, cell string")
    assert lineage.runs(none, ["g"]).count() == 0 and lineage.gathered(lineage.runs(none, ["g"]), ["g"]).count() == 0


def test_prefixes_spell_out_what_stands_up_to_a_point(spark):
    rows = [("a", 1, "A1"), ("a", 2, None), ("a", 3, "A3"), (None, 1, None), (None, 2, "Z2")]
    points = series(spark.createDataFrame(rows, "k string, o int, cell string").withColumn("v", F.lit(1)), "v", ["k"], "o", "carry", "cell")
    got = {(r["k"], r["o"]): r["step_cells"] for r in lineage.prefix_cells(points, ["k"]).collect()}
    assert got == {("a", 1): ["A1"], ("a", 2): ["A1"], ("a", 3): ["A1", "A3"], (None, 1): [], (None, 2): ["Z2"]}
