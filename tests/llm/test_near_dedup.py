import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm.common import mix64
from tallyloom.llm.components import components
from tallyloom.llm.near_dedup import BANDS, ROWS, Names, _classes, classes, drop_near, shingles, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, least=0.8):
    """Smallest id of each class, by all pairs."""
    words = {}
    for r in rows:
        words.setdefault(tuple(WORD.findall(r[1] or "")), []).append(r[0])
    texts = list(words)
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} if len(t) >= 5 else ({t} if t else set()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= least * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(top(i), []).extend(words[t])
    return {d: min(own) for own in groups.values() for d in own}


def near_rows(seed=2):
    """Chains of edits, so that ends of a chain are far apart, beside groups of near copies and others."""
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(3000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([30, 90, 200]))]
        for _ in range(r.choice([1, 3, 25])):
            rows.append(base[:])
            if r.random() < 0.5:
                base = base[:]
            own = base if r.random() < 0.4 else base[:]
            for _ in range(r.randrange(1 + len(own) // 40)):
                own[r.randrange(len(own))] = word()
            rows.append(own[:])
    r.shuffle(rows)
    return [(i, " ".join(w), "en", "s", 1) for i, w in enumerate(rows)]


@pytest.mark.parametrize("chunk", [500, 3])
def test_classes(spark, monkeypatch, chunk):
    monkeypatch.setattr("tallyloom.llm.near_dedup.CHUNK", chunk)
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    got = {r["id"]: r["class_id"] for r in classes(docs).collect()}
    want = brute(rows)
    assert len(set(want.values())) < len(rows)
    assert got == want


def test_fixture_and_edges(spark, docs, rows, none):
    got = classes(docs).collect()
    want = brute(rows)
    assert {r["id"]: r["class_id"] for r in got} == want
    size = {}
    for c in want.values():
        size[c] = size.get(c, 0) + 1
    assert all(r["class_size"] == size[r["class_id"]] for r in got)
    kept = drop_near(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert classes(none).count() == 0 and drop_near(none).count() == 0
    odd = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (None, "a  b c d e f", "z"), (None, "q", "z"), (3, None, None)], "doc_id bigint, text string, bucket string")
    assert sorted((str(r["id"]), str(r["class_id"])) for r in classes(odd).collect()) == [("1", "1"), ("1", "1"), ("3", "3"), ("None", "1"), ("None", "None")]
    assert sorted(str(r["doc_id"]) for r in drop_near(odd).collect()) == ["1", "3", "None"]


def test_one_row_of_each_class(spark):
    """Clean texts under null or repeated ids all stay, and of a class one row does."""
    text = lambda k: " ".join(f"t{k}w{i}" for i in range(40))
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0) + " more"), (None, text(1))]
    rows += [(7, text(7)), (7, text(8)), (7, text(8) + " more"), (3, text(7) + " more"), (9, text(9)), (None, text(9) + " more")]
    kept = [tuple(r) for r in drop_near(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    topic = lambda r: int(r[1][1 : r[1].index("w")])
    assert sorted(map(topic, kept)) == [0, 1, 2, 3, 4, 5, 7, 8, 9] and set(kept) <= set(rows)
    assert {topic(r): r[0] for r in kept} == {k: None for k in range(6)} | {7: 3, 8: 7, 9: 9}


def test_signatures_estimate_probability_jaccard():
    r = random.Random(1)
    a = [f"t{i}" for i in range(400)]
    b = a[:]
    for i in range(0, 400, 45):
        b[i] = "other" + str(r.random())
    doc, value, count = shingles(pa.array([" ".join(a), " ".join(b), "x", "x"]))
    s = signatures(doc, value, count, 4, m=2000)
    x, y = set(value[doc == 0].tolist()), set(value[doc == 1].tolist())
    truth = len(x & y) / len(x | y)
    assert abs((s[0] == s[1]).mean() - truth) < 0.04
    assert (s[2] == s[3]).all() and BANDS * ROWS == 120
    # weights move the index: 1 / sum of the larger of the two weight ratios
    value = mix64(np.array([1, 2, 1, 2], np.uint64))
    s = signatures(np.array([0, 0, 1, 1]), value, np.array([1, 8, 8, 1]), 2, m=4000)
    w, v = (1, 4), (4, 1)  # 1 + log2 of the counts
    p = sum(1 / sum(max(w[k] / w[d], v[k] / v[d]) for k in (0, 1)) for d in (0, 1))
    assert abs((s[0] == s[1]).mean() - p) < 0.04


def test_sets_propose_what_sets_verify(spark):
    """A line that repeats 64 times hardly moves the sets but most of the weight."""
    r = random.Random(5)
    rows = []
    for i in range(0, 80, 2):
        base = [f"p{i}w{k}" for k in range(120)]
        line = [f"l{i}w{r.randrange(10**6)}" for _ in range(16)]
        rows += [(i, " ".join(base)), (i + 1, " ".join(base + line * 64))]
    got = {x["id"]: x["class_id"] for x in classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows) == {i: i // 2 * 2 for i in range(80)}


def test_names_that_clash(spark):
    """Different texts whose names would be equal get other names, and nothing is merged or lost."""
    from pyspark.sql import functions as F

    rows = near_rows(5)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    names = Names(lambda t: F.pmod(F.xxhash64(t), F.lit(11)))
    got = {r["id"]: r["class_id"] for r in _classes(docs, names, 0.8, "doc_id", "text").collect()}
    assert names.again and got == brute(rows)


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x["id"]: x["component"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1]} | {x: got[x] for x in got if x not in root}
