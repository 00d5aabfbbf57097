import random

import pytest

from .conftest import SCHEMA, sample
from .test_exact_rules_packing_files import by_text, ids_of
from .test_mixing_substrings import WORD
from .test_near_dedup import brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    r = random.Random(9)
    plain = [f"word{i}" for i in range(80)]
    rows = sample()
    labels = []
    for i in range(300):
        toxic = i % 4 == 0
        words = r.sample(plain, 25) + (["vile", "vermin"] if toxic else [])
        r.shuffle(words)
        rows.append((1000 + i, " ".join(words), "en", "h1", 1))
        labels.append((1000 + i, 1, int(toxic)))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages(spark, folder):
    import corpus_pipeline as p

    d, rows = folder
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [rows]
    for name, stage in p.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen.append([tuple(r) for r in docs.collect()])
    before, clean, exact, near, mix = seen[:5]
    ids = lambda x: {r[0] for r in x}
    toxic = {1000 + i for i in range(300) if i % 4 == 0}
    assert ids(before) - ids(clean) == toxic
    assert sorted(r[0] for r in exact) == sorted(min(o) for o in by_text(clean).values())
    assert sorted(r[0] for r in near) == sorted(set(brute(exact).values()))
    assert {tuple(r[:2]) for r in near} <= {tuple(r[:2]) for r in before}
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in near}
    taken = {}
    for r in mix:
        assert r[1] in dict((x[0], x[1]) for x in near)[r[0]]
        taken[r[0]] = taken.get(r[0], 0) + len(WORD.findall(r[1]))
    assert all(n <= 2 * size[i] for i, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 5
    packed = docs.collect()
    assert sum(r["length"] for r in packed) == sum(map(len, ids_of([r[1] for r in mix])))
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spots in bins.values():
        at = 0
        for o, n in sorted(spots):
            assert o == at
            at += n
        assert at <= 1024


def test_run(spark, folder):
    import corpus_pipeline as p

    assert p.run(spark, folder[0]).count() > 0 and p.ORACLE_SQL is None
