"""Top-k search, importance resampling and ranked search against brute force, on ordinary and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import importance, lexical, topk

LOWER = str.maketrans(importance.UPPER, importance.UPPER.lower())
VECTORS = "vec_id bigint, embedding array<float>, id string, v int, cell string, `row` int, dots int, norm int, part int, VEC_ID int"


def by_hand(rows, k=5, every=5):
    """(query, rank, vec_id, score) as sorted text."""
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(sound):
        if q is not None and q % every == 0:
            clip = lambda s: min(max(s, -(1 << 63)), (1 << 63) - 1)
            got = [(-clip(sum(m * n for m, n in zip(x, y, strict=True))), i is None, i or 0) for b, (i, y) in enumerate(sound) if a != b and len(x) == len(y)]
            out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(got)[:k], 1)]
    return sorted(map(str, out))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *["x", 1, "y", 2, 3, 4, 5, 6]) for i, v in rows], VECTORS).repartition(3)


def searched(spark, rows, **how):
    got = topk.nearest(vectors(spark, rows), "vec_id", "embedding", F.col("id") % 5 == 0, **how)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("block_numbers", [1 << 20, 120])
def test_top_k_is_exact(spark, block_numbers):
    """Clusters, copies and ties; with small blocks there are many cells, blocks and chunks of queries."""
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in centres[i % 5]]) for i in range(150)]
    rows += [(200 + i, list(rows[10][1])) for i in range(40)] + [(10, list(rows[10][1])), (10, list(rows[10][1])), (None, list(rows[10][1]))]
    assert searched(spark, rows, block_numbers=block_numbers) == by_hand(rows)


def test_top_k_of_odd_vectors(spark):
    """Null vectors and components, NaN, infinities, other lengths, empty, huge, zero."""
    rows = [(0, None), (5, [1.0, None]), (10, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (20, [1.0, -0.001]), (25, [0.0, 0.0]), (1, [2.0, 3.0]), (2, [2.0, 3.0])]
    rows += [(30, [1.0]), (31, [2.0]), (35, []), (36, []), (40, [3e38, 1.0]), (41, [-3e38, 2.0]), (45, [1e12, 1e12]), (46, [1e12, 1e12 + 1e6]), (-5, [1.0, 1.0]), (50, [0.1, 0.2, 0.3])]
    assert searched(spark, rows) == by_hand(rows)
    assert searched(spark, rows, sample=2) == by_hand(rows)  # lengths that the sample lacks
    assert searched(spark, []) == searched(spark, rows[:4]) == []
    assert searched(spark, [(5, [1.0])]) == []


def test_pivots_eliminate():
    """In tight clusters most candidates are never scored, and nothing is lost."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(20, 16)) * 300
    rows = np.floor(centres[r.integers(0, 20, 2000)] + r.normal(size=(2000, 16)) * 4)
    pivots = rows[topk.farthest(rows, 16)]
    norm = float(np.sqrt((rows**2).sum(1)).max())
    block = topk.Block(rows, np.arange(2000), np.zeros(2000, bool), np.arange(2000), pivots, rows @ pivots.T, norm)
    for q in range(0, 2000, 100):
        places, scores = block.best(rows[q], q, -np.inf, 5)
        every = rows @ rows[q]
        every[q] = -np.inf
        want = np.lexsort((np.arange(2000), -every))[:5]
        assert places.tolist() == want.tolist() and scores.tolist() == every[want].tolist()
        assert (block.limits(rows[q]) >= rows @ rows[q]).all()
    assert block.scored < 0.5 * 20 * 2000


def features(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    w = re.findall(pattern, (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def resampled_by_hand(docs, target, percent):
    s, t = Counter(), Counter()
    made = [(i, *features(x)) for i, x in docs]
    for _, _, f in made:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    out = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[5] = rank
    return sorted(str(tuple(x)) for x in out)


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_resampling(spark, docs, rows, percent):
    """Nulls, repeats and ties: equal rows are drawn each."""
    more = [(7, "Ñandú " * 25, None, None, 1)] * 9 + [(None, "B b É é İ 9z " * 12, None, None, 1)] * 3
    target = ["Alpha beta gamma", None, "", "é ñandú one two x"]
    d = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("words", F.lit("x")).withColumn("row", F.lit(1)).withColumn("buckets", F.lit(2)).select("*", F.lit("no").alias("TEXT"))
    got = importance.resample(d, spark.createDataFrame([(1, x) for x in target], "n int, text string"), "doc_id", "text", "text", percent=percent)
    assert sorted(str(tuple(r)) for r in got.collect()) == resampled_by_hand([(r[0], r[1]) for r in [*rows, *more]], target, percent)


def test_resampling_of_nothing(spark, none, docs, rows):
    target = spark.createDataFrame([], "text string")
    assert importance.resample(none, target, "doc_id", "text", "text").collect() == []
    got = importance.resample(docs, target, "doc_id", "text", "text", percent=50)
    assert sorted(str(tuple(r)) for r in got.collect()) == resampled_by_hand([(r[0], r[1]) for r in rows], [], 50)


def test_resampling_of_a_long_text(spark):
    r = random.Random(4)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(200_000))
    docs = [(1, long), (2, "a b c")]
    got = importance.resample(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("w1 w2",)], "text string"), "doc_id", "text", "text", percent=100)
    assert sorted(str(tuple(x)) for x in got.collect()) == resampled_by_hand(docs, ["w1 w2"], 100)


def test_a_gain_is_one_literal(spark, docs):
    """The gains are folded into the plan; nothing explodes where documents are scored."""
    d = importance.with_buckets(docs, F.col("text"))
    plan = spark.range(3).select(F.element_at(importance.literal(range(10000)), F.col("id").cast("int") + 1).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "element_at([0,1,2,3" in plan
    assert "Generate" not in d._jdf.queryExecution().executedPlan().toString()


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)) if text else []


def ranked_by_hand(docs, items, k):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, every = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        got = []
        for i, c in own:
            m = 50 + (50 * sum(c.values()) * n) // every
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                got.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(got)[:k], 1)]
    return sorted(map(str, out))


@pytest.mark.parametrize("group_terms", [lexical.GROUP_TERMS, 5])
def test_ranked_search(spark, docs, rows, group_terms, monkeypatch):
    """Nulls, ties, repeated rows and items, items without terms; with small groups the items go in many."""
    more = [(7, "alpha one two", None, None, 1)] * 8 + [(None, "Alpha É two", None, None, 1)] * 2
    items = [(1, "ALPHA beta nothing-here"), (2, "one two x one"), (2, "gamma"), (None, "idiot é"), (3, None), (4, ""), (5, "never seen words"), (1, "ALPHA beta nothing-here")]
    d = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumn("item", F.lit("x")).withColumn("score", F.lit(1)).select("*", F.lit(1).alias("Doc_ID"))
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, term int")
    for k in (3, 50):
        got = lexical.search(d, b, "doc_id", "text", "item_id", "text", k=k, group_terms=group_terms)
        assert sorted(str(tuple(r)) for r in got.collect()) == ranked_by_hand([(r[0], r[1]) for r in [*rows, *more]], items, k)


def test_runs_of_impacts(docs, rows, spark, monkeypatch):
    """The same sums however few impacts are sorted at a time."""
    import pyarrow as pa

    terms_ = np.array([5, 5, 9], np.uint64)
    group = lexical.Group(terms_, np.array([0, 1, 1]), 2)
    assert group.terms.tolist() == [5, 9] and group.size.tolist() == [2, 1]
    words = lexical.Words(pa.array(["one two", "two two three", "", "one"]), lower=True, apart=lexical.APART)
    h = words.hashes()
    group = lexical.Group(np.array([h[0], h[1], h[1]]), np.array([0, 0, 1]), 2)
    group.weigh(3, np.array([2, 2]))
    whole = [tuple(map(list, x)) for x in lexical.accumulate(group, pa.array(["one two", "two two three", "", "one"]), 3, 6)]
    monkeypatch.setattr(lexical, "AT_ONCE", 1)
    parts = [tuple(map(list, x)) for x in lexical.accumulate(group, pa.array(["one two", "two two three", "", "one"]), 3, 6)]
    flat = lambda xs: sorted((i, d, s) for a, b, c in xs for i, d, s in zip(a, b, c, strict=True))
    assert len(parts) > len(whole) == 1 and flat(parts) == flat(whole)


def test_radix_is_a_stable_sort():
    r = np.random.default_rng(5)
    keys = r.integers(0, 1 << 50, 1000).astype(np.uint64) & np.uint64(0x3FFFF0003FFFF)
    assert lexical.radix(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def test_ranked_search_of_nothing(spark, none, docs):
    items = spark.createDataFrame([(1, "alpha")], "item_id bigint, text string")
    args = ("doc_id", "text", "item_id", "text")
    assert lexical.search(none, items, *args).collect() == []
    assert lexical.search(docs, items.where("false"), *args).collect() == []
    assert lexical.search(docs.where("doc_id = 60"), items, *args).collect() == []


def test_ranked_search_of_a_long_text(spark):
    r = random.Random(6)
    docs = [(1, " ".join(f"w{r.randrange(3000)}" for _ in range(300_000))), (2, "w1 w2 other")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, "w1 w9 other")], "item_id bigint, text string"), "doc_id", "text", "item_id", "text")
    assert sorted(str(tuple(x)) for x in got.collect()) == ranked_by_hand(docs, [(1, "w1 w9 other")], 50)
