import random

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import toxicity
from tallyloom.llm.toxicity import Machine, drop_toxic, score, train


def learnable():
    return F.crc32(F.col("id").cast("string")) % 3 != 1


def made(n=900, seed=3):
    """Insults are toxic only with a group mention: what additive weights cannot tell."""
    r = random.Random(seed)
    insult, group, plain = ["idiot", "scum"], ["groupa", "groupb"], [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        a, b = r.random() < 0.5, r.random() < 0.5
        words = r.sample(plain, 12) + ([r.choice(insult)] if a else []) + ([r.choice(group)] if b else [])
        r.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(a and b)))
    return rows, labels


def test_pairs_are_learned(spark):
    rows, labels = made()
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = train(docs, marks, learnable(), min_odds=0.1)
    got = {r["id"]: r["score"] for r in score(docs, machine).collect()}
    held = [i for i, _ in labels if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    right = np.mean([(got[i] >= 0.7) == labels[i][1] for i in held])
    assert right > 0.95
    again = train(docs, marks, learnable(), min_odds=0.1)
    assert np.array_equal(again.w, machine.w) and again.bias == machine.bias
    kept = drop_toxic(docs, machine)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def test_pairs_of_weak_terms_are_learned(spark):
    """Toxic with an insult or a group mention but not both: no term alone tells anything."""
    rows, _ = made(1500)
    marks = [(i, int(("idiot" in t or "scum" in t) != ("group" in t))) for i, t, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    machine = train(docs, spark.createDataFrame(marks, "doc_id bigint, toxic int"), learnable())
    got = {r["id"]: r["score"] for r in score(docs, machine).collect()}
    held = [i for i, _ in marks if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == marks[i][1] for i in held]) > 0.9


def test_score_by_hand():
    rng = np.random.default_rng(1)
    m = Machine(np.array([5, 9, 7], np.uint64), np.array([0.5, -1.0, 2.0]))
    m.v, m.bias = rng.normal(size=(3, 8)), 0.3
    doc, at = m.find(np.array([0, 0, 0, 1, 1]), np.array([5, 9, 5, 8, 7], np.uint64))
    assert list(zip(doc, at)) == [(0, 0), (0, 2), (1, 1)] and list(m.w) == [0.5, 2.0, -1.0]
    z = [0.3 + 0.5 - 1.0 + m.v[0] @ m.v[2], 0.3 + 2.0, 0.3]
    assert np.allclose(m.score(doc, at, 3), 1 / (1 + np.exp(-np.array(z))))


def test_edges(spark, docs, none):
    marks = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    machine = train(docs, marks, F.lit(True))
    assert all(r["score"] > 0.99 for r in score(docs, machine).collect())
    machine = train(none, marks.where("1 = 0"), F.lit(True))
    assert score(none, machine).count() == 0
    assert all(r["score"] < 0.01 for r in score(docs, machine).collect())


def test_slots_are_alike_by_table_and_by_sort(monkeypatch):
    rng = np.random.default_rng(4)
    machine = Machine(rng.integers(1, 1 << 40, 30).astype(np.uint64), np.zeros(30), shared=70)
    doc = np.sort(rng.integers(0, 50, 2_000))
    term = np.where(rng.random(2_000) < 0.3, rng.choice(machine.names, 2_000), rng.integers(0, 1 << 40, 2_000).astype(np.uint64))
    term[::7] = 0  # no term
    by_table = machine.find(doc, term)
    monkeypatch.setattr(toxicity, "CELLS", 0)
    by_sort = machine.find(doc, term)
    assert all(np.array_equal(a, b) for a, b in zip(by_table, by_sort, strict=True))
    none = machine.find(doc[:0], term[:0])
    assert len(none[0]) == len(none[1]) == 0
