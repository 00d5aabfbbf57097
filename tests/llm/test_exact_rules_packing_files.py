import hashlib
import re
import zlib

import numpy as np
import pytest

from tallyloom.llm.exact_dedup import copies, drop_copies
from tallyloom.llm.huffman import Code, code_lengths
from tallyloom.llm.packing import pack, plan
from tallyloom.llm.quality_rules import Rules, drop_failing, verdicts
from tallyloom.llm.queries import vocabulary
from tallyloom.llm.token_files import round_trip
from tallyloom.llm.tokens import encoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return [x.ids + [2] for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def by_text(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    return groups


@pytest.mark.parametrize("digest", ["md5", "collides"])
def test_copies(docs, rows, digest):
    from pyspark.sql import functions as F

    how = {} if digest == "md5" else {"digest": lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 3), 4, "0"))}
    got = {r["id"]: r for r in copies(docs, **how).collect()}
    groups = by_text(rows)
    assert len(got) == len(rows)
    for r in rows:
        own = groups[norm(r[1])]
        g = got[r[0]]
        assert (g["keep_id"], g["group_size"], g["kept"]) == (min(own), len(own), r[0] == min(own))
        assert g["text_sha256"] == hashlib.sha256(norm(r[1]).encode()).hexdigest()


def test_drop_copies_nulls_and_repeats(spark, docs, rows, none):
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(x) for x in by_text(rows).values())
    odd = spark.createDataFrame([(1, "a b", "x"), (1, "a  b", "y"), (1, "c", "y"), (None, "q", None), (None, "q", None), (None, "a b", None)], "doc_id bigint, text string, h string")
    assert sorted((str(r["doc_id"]), norm(r["text"]), r["h"] is None) for r in drop_copies(odd).collect()) == [("1", "a b", False), ("1", "c", False), ("None", "q", True)]
    assert drop_copies(none).count() == 0 and copies(none).count() == 0


def brute_measures(t):
    t = t or ""
    words = WORD.findall(t)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(docs, rows):
    got = {r["id"]: r for r in verdicts(docs).collect()}
    assert any(brute_measures(r[1])[4] for r in rows)
    for r in rows:
        g, b = got[r[0]], brute_measures(r[1])
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == b, r
        assert g["base_failed"] == (b[0] < 20 or 100 * b[4] > 30 * b[0])
        assert not (g["kept"] and g["base_failed"])


def test_host_verdicts(spark, none):
    good, bad = " ".join(f"w{i}" for i in range(30)), "too short"
    rows = [(i, bad if i % 50 else good, "spam") for i in range(200)] + [(1000 + i, good if i % 10 else bad, "fine") for i in range(200)]
    rows += [(2000 + i, good, f"one{i}") for i in range(30)] + [(3000, good, None), (3001, bad, "tiny")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumnRenamed("source", "host")
    got = {r["id"]: r["kept"] for r in verdicts(d, host_col="host").collect()}
    assert not any(got[i] for i in range(200))
    assert all(got[1000 + i] == bool(i % 10) for i in range(200))
    assert all(got[2000 + i] for i in range(30)) and got[3000] and not got[3001]
    assert drop_failing(d, host_col="host").columns == d.columns
    assert drop_failing(d, host_col="host").count() == sum(got.values())
    assert verdicts(none, rules=Rules()).count() == 0


def test_tokens_equal_the_library():
    import pyarrow as pa

    texts = ["", None, " ", "a", "don't   stop\n\n", "x y  z", "ab'll 12,34 <|endoftext|> é ", "中文  tail \t"] * 3
    ids, at = encoder(vocabulary()).encode(pa.array(texts), 2)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == ids_of(texts)


def test_token_files(docs, rows, none):
    got = {r["doc_id"]: r for r in round_trip(docs, vocabulary()).collect()}
    at = 0
    for r, own in zip(sorted(rows), ids_of([r[1] for r in sorted(rows)])):
        g = got[r[0]]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    assert round_trip(none, vocabulary()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 300, 5000])
def test_huffman(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, 20_000), n) * 3
    u, c = np.unique(ids, return_counts=True)
    code = Code(u, code_lengths(c, 14))
    assert code.most <= 14
    payload, starts = code.encode(ids, 100)
    assert np.array_equal(code.decode(payload, len(ids), starts, 100), ids)
    k = 7  # a block decodes on its own
    assert np.array_equal(code.decode(payload, 100, starts[k : k + 1], 100), ids[100 * k : 100 * k + 100])


def check_packing(got, rows, capacity):
    want = {r[0]: own for r, own in zip(rows, ids_of([r[1] for r in rows]))}
    by_doc, by_bin = {}, {}
    for g in got:
        by_doc.setdefault(g["id"], []).append(g)
        by_bin.setdefault(g["sequence_id"], []).append((g["offset"], g["length"]))
    assert by_doc.keys() == want.keys()
    for d, parts in by_doc.items():
        at = 0
        for k, p in enumerate(sorted(parts, key=lambda x: x["piece"])):
            assert (p["piece"], p["start"]) == (k, at)
            assert p["ids_crc32"] == zlib.crc32(np.array(want[d][at : at + p["length"]], "<u4").tobytes())
            assert k == 0 or p["length"] == capacity
            at += p["length"]
        assert at == len(want[d])
    for spots in by_bin.values():
        at = 0
        for o, n in sorted(spots):
            assert o == at
            at += n
        assert at <= capacity
    return len(by_bin), sum(map(len, want.values()))


def test_pack(docs, rows, none):
    bins, total = check_packing(pack(docs, vocabulary(), capacity=256).collect(), rows, 256)
    assert bins <= -(-total // 256) + 1
    assert pack(none, vocabulary()).count() == 0


def test_plan_fills_bins():
    rng = np.random.default_rng(1)
    u, c = np.unique(np.clip(rng.lognormal(5.5, 1, 5000).astype(int), 1, 1024), return_counts=True)
    made = plan(dict(zip(u.tolist(), c.tolist())), 1024)
    used = {}
    for pattern, times in made:
        assert sum(a * b for a, b in pattern) <= 1024
        for a, b in pattern:
            used[a] = used.get(a, 0) + b * times
    assert used == dict(zip(u.tolist(), c.tolist()))
    assert sum(t for _, t in made) <= -(-int((u * c).sum()) // 1024) + 1
