import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.mixing import Mix, mixed, split, taken, targets
from tallyloom.llm.substrings import repeated_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert targets([100, 100, 100], share=1.5) == pytest.approx([200, 500 / 3, 250 / 3])
    assert sum(targets([10, 1000, 5, 70], share=1.5)) == pytest.approx(1.5 * 1085)
    assert targets([0, 0]) == [0, 0] and targets([]) == []


def test_split_is_exact():
    q = np.array([1000, 0, 7, 312])
    leaves = split(q, 13, np.random.default_rng(3))
    assert leaves.shape == (13, 4) and (leaves >= 0).all() and (leaves.sum(0) == q).all()
    assert np.ptp(leaves.sum(1)) <= 4


def test_taken(docs, rows, none):
    m = Mix(docs, block_words=16, shards=8)
    got = taken(m).collect()
    assert sorted(g["id"] for g in got) == sorted(r[0] for r in rows)
    names = sorted({r[3] for r in rows if r[3] is not None}) + [None]
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = [sum(size[i] for i in size if source[i] == s) for s in names]
    goal = dict(zip(names, targets(total)))
    for g in got:
        assert (g["size"], g["source_size"]) == (size[g["id"]], total[names.index(source[g["id"]])])
        assert g["target"] == pytest.approx(goal[source[g["id"]]]) and 0 <= g["taken"] <= 2 * g["size"]
    for s in names:
        assert abs(sum(g["taken"] for g in got if source[g["id"]] == s) - goal[s]) <= 1
    assert sorted(map(str, taken(Mix(docs, block_words=16, shards=8)).collect())) == sorted(map(str, got))
    # a document has one piece in a pass, and shards hold them at positions without gaps
    pieces = m.pieces.collect()
    assert len({(p["s"], p["id"], p["row"], p["k"], p["pass"]) for p in pieces}) == len(pieces)
    for shard in range(8):
        own = sorted(p["position"] for p in pieces if p["shard"] == shard)
        assert own == list(range(len(own)))
    assert taken(Mix(none)).count() == 0


def _blocks(m):
    """(source, pass, block) -> shard, from the pieces: the first document of a block tells its place in the stream."""
    at = {(r["s"], r["id"], r["row"], r["k"]): r for r in m.stream.collect()}
    out = {}
    for p in m.pieces.collect():
        r = at[p["s"], p["id"], p["row"], p["k"]]
        out.setdefault((p["s"], p["pass"], r["block"]), set()).add(p["shard"])
    return out


def test_the_tree_decides(docs):
    """Each shard holds, of each source, as many blocks as its leaf says, and a block lies in one shard. Equal shares would not."""
    m = Mix(docs, block_words=16, shards=8)
    drawn = _blocks(m)
    assert all(len(x) == 1 for x in drawn.values())
    held = np.zeros_like(m.leaves)
    for (s, _, _), (shard,) in drawn.items():
        held[shard, m.order.index(s)] += 1
    assert (held == m.leaves).all()
    quotas = m.leaves.sum(0)
    equal = np.array([[q * (i + 1) // 8 - q * i // 8 for q in quotas] for i in range(8)])
    assert (m.leaves != equal).any()


def test_the_draw_against_brute_force(spark, docs, rows):
    """A mixture made row by row in Python, from the same hashes, draws the same words of the same documents."""
    m = Mix(docs, block_words=16, shards=8, seed=5)
    facts = m.documents.withColumn("p", F.xxhash64(F.lit(5), "row", "k")).collect()
    got = {}
    for p in m.pieces.collect():
        got[p["s"], p["id"], p["row"], p["k"], p["pass"]] = p["n"]
    want = {}
    plan = {r["s"]: r for r in m.sources.collect()}
    for s, t in plan.items():
        at, blocks = 0, {}
        for r in sorted((r for r in facts if r["s"] == s and r["size"] > 0), key=lambda r: r["p"]):
            blocks.setdefault(at // 16, []).append(r)
            at += r["size"]
        for turn in range(-(-t["take"] // max(t["words"], 1))):
            own = spark.createDataFrame([(s, turn, b) for b in blocks], "s string, pass bigint, block bigint")
            h = {r["block"]: r["h"] for r in own.withColumn("h", F.xxhash64(F.lit(5), "s", "pass", "block")).collect()}
            left = t["take"] - turn * t["words"]
            for b in sorted(blocks, key=lambda b: h[b]):
                for r in blocks[b]:
                    n = min(r["size"], left)
                    left -= n
                    if n > 0:
                        want[s, r["id"], r["row"], r["k"], turn] = n
    assert got == want


def test_draws_beyond_the_samplers_limit():
    from tallyloom.llm.mixing import _some_of

    counts = np.array([3_000_000_000, 5, 1_000_000_001])
    n = _some_of(counts, 2_000_000_000, np.random.default_rng(1))
    assert n.sum() == 2_000_000_000 and (n <= counts).all() and abs(n[0] - 1.5e9) < 1e6


def test_mixed_texts(spark, docs, rows):
    out = mixed(docs, block_words=16, shards=8)
    assert out.columns == docs.columns
    per = {}
    for r in out.collect():
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + len(WORD.findall(r["text"]))
    for g in taken(Mix(docs, block_words=16, shards=8)).collect():
        assert per.get(g["id"], 0) == g["taken"]
    odd = spark.createDataFrame([(1, "a b c", "s", "q"), (1, "a b c", "s", "q"), (None, "d e f", None, "q"), (2, None, "s", None)], "doc_id bigint, text string, source string, size string")
    t = taken(Mix(odd)).collect()
    assert len(t) == 4 and sum(g["taken"] for g in t) == round(1.5 * 9)
    assert sum(len(r["text"].split()) for r in mixed(odd).collect()) == round(1.5 * 9)


def brute_spans(rows, window):
    first = {}
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(window)}
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize(("window", "small"), [(50, {}), (5, {"block_bytes": 500, "range_keys": 300}), (5, {"block_bytes": 500, "range_keys": 300, "fan": 3})])
def test_repeated_spans(docs, rows, window, small):
    got = {r["id"]: r for r in repeated_spans(docs, window, **small).collect()}
    want = brute_spans(rows, window)
    assert got.keys() == want.keys() and any(w[1] for w in want.values())
    for d, (n, gone, kept) in want.items():
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_text"]) == (n, gone, kept)
        assert sum(s["end"] - s["start"] for s in got[d]["spans"]) == gone


def test_repeated_spans_edges(spark, none):
    assert repeated_spans(none).count() == 0
    same = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, same, 0), (1, same, 1), (None, same, 2), (None, None, 3)], "doc_id bigint, text string, n_words int")
    got = sorted((str(r["id"]), r["n_removed"]) for r in repeated_spans(d).collect())
    assert got == [("1", 0), ("1", 0), ("None", 0), ("None", 60)]
