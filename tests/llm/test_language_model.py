import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.language_model import learn, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")
def held_out():
    return F.crc32(F.col("id").cast("string")) % 10 == 0


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    tokens = {r[0]: [*WORD.findall(lower(r[1])), None] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(t for i, own in tokens.items() if not held[i] for t in own)
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(own), sum(c[t] > 0 for t in own), n, sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)) for i, own in tokens.items()}, c, tokens, held


@pytest.mark.parametrize("small", [{}, {"block_bytes": 2000, "range_keys": 400}, {"block_bytes": 2000, "range_keys": 400, "fan": 3}])
def test_scores(docs, rows, small):
    got = {r["id"]: r for r in score(docs, held_out(), **small).collect()}
    want, c, tokens, held = brute(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        g = got[i]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:4]
        assert g["base_score"] == pytest.approx(w[4])
        assert g["score"] < 0
    # the same model by hand: pairs within documents, contexts by their own counts
    pair = Counter(p for i, own in tokens.items() if not held[i] for p in zip([None, *own], own))
    n, v = sum(c.values()), len(c)
    cells = Counter()
    for (a, b), k in pair.items():
        cells[(c[a] - 1, k - 1, c[b] - 1)] += k
    log = lambda p: -177 if p <= 0 else max(round(math.log2(p) * 4), -176)
    bucket = lambda x: x.bit_length() if x > 0 else 0
    weights = learn([(bucket(a), log(k / max(a, 1)), log(b / (n - 1)), m) for (a, k, b), m in cells.items()], v)
    for i, own in tokens.items():
        by_hand = 0
        for a, b in zip([None, *own], own):
            w = weights[bucket(c[a])]
            by_hand += math.log10(w[0] * pair[(a, b)] / max(c[a], 1) + w[1] * c[b] / n + w[2] / (v + 1))
        assert got[i]["score"] == pytest.approx(by_hand, rel=1e-6)


def test_probabilities_sum_to_one_and_beat_the_base(spark, none):
    import random

    r = random.Random(5)
    rows = [(i, " ".join(x for _ in range(40) for x in r.choice(["a b c", "d e", "f g h i", "q"]).split())) for i in range(300)]
    got = score(spark.createDataFrame(rows, "doc_id bigint, text string"), held_out()).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.75  # scores are negative: the pairs tell much more
    assert score(none, held_out()).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (4, "a b"), (4, "a b")], "doc_id bigint, text string")
    assert score(odd, held_out()).count() == 4
    nothing = score(odd, F.lit(True)).collect()
    assert all(x["train_tokens"] == 0 and x["n_known"] == 0 and x["score"] <= 0 for x in nothing)
