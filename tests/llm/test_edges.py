"""Every operator on nulls, repeated rows, ties, empty tables, clashing column names and long texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import exact_dedup, language_model, mixing, near_dedup, packing, quality_rules, secrets, substrings, token_files, toxicity
from tallyloom.llm.queries import vocabulary
from tallyloom.llm.tokens import SLICE, encoded

from .test_exact_rules_packing_files import ids_of

# other columns, named as the operators name their own
CLASH = ("id", "t", "s", "row", "k", "n", "key", "words", "tag", "block", "bucket", "chunk", "size", "sha", "h", "host", "c0", "c1", "__id", "TEXT", "Doc_ID", "position", "shard", "held", "norm")


def small_rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    long = text(60)
    rows = [(1, long, "a"), (1, long, "a"), (1, text(30), "b"), (None, long, "a"), (None, long, "a"), (None, None, None), (2, None, "a"), (3, "", None), (4, " \t", "b"), (5, long + " end", "b")]
    return rows + [(10 + i, text(25), r.choice("ab")) for i in range(12)]


@pytest.fixture(scope="module")
def clash(spark):
    rows = small_rows()
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    return d.select("doc_id", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH[:13])], "text", *[F.lit(i).alias(c) for i, c in enumerate(CLASH[13:], 13)], "source").cache(), rows


MACHINE = toxicity.Machine(np.array([5], np.uint64), np.array([0.5]))
SCORERS = {
    "op1": lambda d: secrets.scan(d),
    "op2": lambda d: language_model.score(d, F.lit(False)),
    "op3": lambda d: mixing.taken(mixing.Mix(d)),
    "op4": lambda d: toxicity.score(d, MACHINE),
    "op5": lambda d: substrings.repeated_spans(d, 20),
    "op7": lambda d: quality_rules.verdicts(d),
    "op8": lambda d: exact_dedup.copies(d),
    "op9": lambda d: token_files.round_trip(d, vocabulary()),
    "op10": lambda d: near_dedup.classes(d),
}


@pytest.mark.parametrize("op", sorted(SCORERS))
def test_a_row_for_each_document(clash, op):
    """One row for each row that went in, nulls and repeats included, whatever the other columns are called."""
    docs, rows = clash
    got = SCORERS[op](docs).collect()
    name = "doc_id" if op == "op9" else "id"
    assert sorted(str(g[name]) for g in got) == sorted(str(r[0]) for r in rows)


FILTERS = {
    "toxicity": lambda d: toxicity.drop_toxic(d, MACHINE),
    "exact": exact_dedup.drop_copies,
    "near": near_dedup.drop_near,
    "mixing": mixing.mixed,
    "rules": quality_rules.drop_failing,
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_columns_pass_through(spark, clash, none, name):
    docs, rows = clash
    out = FILTERS[name](docs)
    assert out.columns == docs.columns
    kept = out.select(*[F.col(f"`{c}`") for c in ("block", "__id", "c0", "shard")], "source").collect()
    assert kept and {(r[0], r[1], r[2], r[3]) for r in kept} == {(f"x{CLASH.index('block')}", CLASH.index("__id"), CLASH.index("c0"), CLASH.index("shard"))}
    empty = FILTERS[name](none)
    assert empty.columns == none.columns and empty.count() == 0


def test_counts_of_the_filters(clash):
    docs, rows = clash
    plain = [r[:3] for r in rows]
    assert toxicity.drop_toxic(docs, MACHINE).count() == len(rows)
    texts = {(r[1] or "").strip() for r in plain}
    assert exact_dedup.drop_copies(docs).count() == len({" ".join((r[1] or "").split()) if (r[1] or "").strip() else (" " if r[1] and r[1] != "" else "") for r in plain})
    assert near_dedup.drop_near(docs).count() == len({r["class_words"] for r in near_dedup._classes(docs, near_dedup.Names(), 0.8, "doc_id", "text").collect()}) < len(texts)
    kept = quality_rules.verdicts(docs).where("kept").count()
    assert quality_rules.drop_failing(docs).count() == kept


def test_packing_of_odd_rows(spark, clash):
    """Null ids, repeated rows, equal lengths and a null text: each piece has a place of its own."""
    docs, rows = clash
    got = packing.pack(docs, vocabulary(), capacity=32).collect()
    assert sorted(zip(*np.unique([str(g["id"]) for g in got if g["piece"] == 0], return_counts=True))) == sorted(zip(*np.unique([str(r[0]) for r in rows], return_counts=True)))
    assert sum(g["length"] for g in got) == sum(map(len, ids_of([r[1] for r in rows])))
    bins = {}
    for g in got:
        bins.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    for spots in bins.values():
        assert [o for o, _ in sorted(spots)] == np.cumsum([0] + [n for _, n in sorted(spots)])[:-1].tolist() and sum(n for _, n in spots) <= 32
    assert len(packing.pack(spark.createDataFrame([(i, "same words") for i in range(700)], "doc_id int, text string"), vocabulary(), capacity=16).collect()) == 700


def test_files_of_rows_with_one_id(spark):
    """Rows of one id lie in several parts, by length and checksum."""
    texts = ["b c", "a", None, "b c", "zz " * 50] * 40
    d = spark.createDataFrame([(7 if i % 2 else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    got = token_files.round_trip(d, vocabulary()).collect()
    ids = ids_of(texts)
    want = sorted(((7 if i % 2 else -1), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids))
    at, spots = 0, []
    for i, n, crc in want:
        spots.append((i, at, n, crc))
        at += n
    assert sorted((-1 if g["doc_id"] is None else g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) for g in got) == sorted(spots)


def brute_fullest(counts, capacity):
    """The most that a bin with the longest length can hold, over all multisets."""
    items = [x for x, n in counts.items() for _ in range(n)]
    first = max(items)
    items.remove(first)
    sums = {first}
    for x in items:
        sums |= {s + x for s in sums if s + x <= capacity}
    return max(sums)


def test_fullest_against_all_subsets():
    r = random.Random(8)
    for _ in range(300):
        capacity = r.randrange(5, 60)
        counts = {r.randrange(1, capacity + 1): r.randrange(1, 4) for _ in range(r.randrange(1, 7))}
        left = [0] * (capacity + 1)
        for x, n in counts.items():
            left[x] = n
        got = packing.fullest(left, capacity, sorted(counts, reverse=True))
        assert got[0][0] == max(counts) and all(n <= counts[x] for x, n in got)
        assert sum(x * n for x, n in got) == brute_fullest(counts, capacity), (counts, capacity)


def test_the_machine_against_a_plain_trainer():
    """One pass of the fit against loops over documents and pairs."""
    rng = np.random.default_rng(4)
    docs = [np.sort(rng.choice(12, rng.integers(1, 6), replace=False)).astype(np.int32) for _ in range(40)]
    labels = (rng.random(40) < 0.4).astype(np.int64)
    names, odds = np.arange(1, 9, dtype=np.uint64), rng.normal(size=8)
    a, b = toxicity.Machine(names, odds, shared=4), toxicity.Machine(names, odds, shared=4)
    a.fit(docs, labels, epochs=2, batch=40)
    pos, n = int(labels.sum()), 40
    weight = np.where(labels == 1, max(1.0, (n - pos) / pos), max(1.0, pos / (n - pos)))
    bias, w, v, start = float(np.log(pos / (n - pos))), b.w.copy(), b.v.copy(), b.w.copy()
    gb, gw, gv = 1e-6, np.full(12, 1e-6), np.full(v.shape, 1e-6)
    gw[8:], gv[8:] = toxicity.STILL
    for _ in range(2):
        db, dw, dv = 0.0, np.zeros(12), np.zeros_like(v)
        for d, y, c in zip(docs, labels, weight):
            z = bias + sum(w[i] for i in d) + sum(v[i] @ v[j] for x, i in enumerate(d) for j in d[x + 1 :])
            e = c * (1 / (1 + np.exp(-z)) - y) / n
            db += e
            for i in d:
                dw[i] += e
                dv[i] += e * sum((v[j] for j in d if j != i), np.zeros(v.shape[1]))
        used = sorted({int(i) for d in docs for i in d})
        dw[used] += 1e-4 * (w - start)[used]
        dv[used] += 1e-4 * v[used]
        gb, gw, gv = gb + db**2, gw + dw**2, gv + dv**2
        bias, w, v = bias - 0.1 * db / gb**0.5, w - 0.1 * dw / np.sqrt(gw), v - 0.1 * dv / np.sqrt(gv)
    assert a.bias == pytest.approx(bias, rel=1e-4) and np.allclose(a.w, w, atol=1e-3) and np.allclose(a.v, v, atol=2e-3)


def test_a_long_text_is_encoded_in_parts():
    r = random.Random(6)
    words = ["don't", "x", "中文", "1234", "  ", "\n\n", "tail,", "é\u00a0", "\u3000", "<|endoftext|>"]
    long = " ".join(r.choice(words) for _ in range(2_400_000))
    assert len(long.encode()) > 2.2 * SLICE
    texts = ["a b", long, None, "y" * (2 * SLICE + 10)]
    got = {}
    for first, ids, at in encoded(vocabulary(), pa.array(texts), 2):
        for k in range(len(at) - 1):
            got[first + k] = ids[at[k] : at[k + 1]].tolist()
    want = ids_of(texts[:3])
    assert [got[i] for i in range(3)] == want and got[3][-1] == 2 and len(got) == 4


def test_long_texts(spark):
    """Texts of 6 MB beside short ones, in each operator that works on words."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    long = " ".join(r.choice(words) for _ in range(1_000_000))
    d = spark.createDataFrame([(1, long), (2, "x y " + long + " z"), (3, "short text"), (4, "v" * 3_000_000)], "doc_id bigint, text string").withColumn("source", F.lit("a")).repartition(4)
    assert {g["id"]: g["class_id"] for g in near_dedup.classes(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {g["id"]: (g["n_words"], g["n_removed"]) for g in substrings.repeated_spans(d).collect()} == {1: (1_000_000, 0), 2: (1_000_003, 1_000_000), 3: (2, 0), 4: (1, 0)}
    assert {g["id"]: g["n_tokens"] for g in language_model.score(d, F.lit(False)).collect()} == {1: 1_000_001, 2: 1_000_004, 3: 3, 4: 2}
    assert sum(g["taken"] for g in mixing.taken(mixing.Mix(d)).collect()) == round(1.5 * 2_000_006)
