"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    s = scan(table(spark, sf_dir, "documents"))
    return s.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score

    held = F.crc32(F.col("id").cast("string")) % 10 == 0
    return score(table(spark, sf_dir, "documents"), held).withColumnRenamed("id", "doc_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix, taken

    return taken(Mix(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id").drop("source")


def toxicity_machine(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Learned from rows whose id's remainder is not 1."""
    from .toxicity import train

    return train(docs, table(spark, sf_dir, "labels"), F.crc32(F.col("id").cast("string")) % 3 != 1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import THRESHOLD, score

    docs = table(spark, sf_dir, "documents")
    s = score(docs, toxicity_machine(spark, docs, sf_dir)).withColumnRenamed("id", "doc_id")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_spans

    r = repeated_spans(table(spark, sf_dir, "documents"), window=50)
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=2, capacity=1024).withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import verdicts

    v = verdicts(table(spark, sf_dir, "documents"))
    return v.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import copies

    return copies(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes

    c = classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
    return c.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 50 == 0, k=5)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    r = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "text", percent=5, seed=42)
    return r.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", k=50)


def queries() -> dict:
    return {
        "op1_secret_scans": op1_secret_scans,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_mixing": op3_mixing,
        "op4_toxicity": op4_toxicity,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_quality_rules": op7_quality_rules,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_token_files": op9_token_files,
        "op10_near_dedup": op10_near_dedup,
        "op11_topk_search": op11_topk_search,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_lexical_search": op13_lexical_search,
    }


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""


OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
least AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i, unnest(range(50)) AS k FROM win JOIN least USING (h) WHERE m < doc_id)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP7_SQL = r"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS j FROM (SELECT doc_id, i, unnest(range(8)) AS k FROM win JOIN rep USING (doc_id, g))) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
 coalesce(cov.n, 0) AS n_repeat_words FROM w JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count_if(base_failed) AS k, count_if(base_failed) / count(*) AS r FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(r) AS mean, coalesce(var_pop(r), 0) AS v, avg(1 / n) AS inv FROM h),
q AS (SELECT mean, CASE WHEN mean * (1 - mean) > 0 THEN greatest(1.0, mean * (1 - mean) / greatest(v - mean * (1 - mean) * inv, mean * (1 - mean) * 0.01) - 1) ELSE 1.0 END AS weight FROM p),
bad AS (SELECT source FROM h, q WHERE (k + mean * weight) / (n + weight) >= 0.6)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(source IN (SELECT source FROM bad), false) AS kept FROM f
"""


OP11_SQL = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS y FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, v.vec_id, list_inner_product(q.y, v.y)::BIGINT AS score FROM v AS q JOIN v ON q.r <> v.r AND len(q.y) = len(v.y) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""

# crc32 byte by byte over distinct features; x.step has its 256 steps
OP12_SQL = r"""
WITH x AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS step),
u AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
 UNION ALL SELECT -row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT r, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM u),
f AS (SELECT r, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 4) t(k))),
c AS (SELECT r, g, count(*) AS n FROM f GROUP BY r, g),
b AS (SELECT g, xor(4294967295, list_reduce(list_transform(range(1, 2 * octet_length(encode(g)), 2), lambda i: ('0x' || substr(hex(encode(g)), i, 2))::BIGINT), lambda h, y: xor(h >> 8, step[(xor(h, y) & 255) + 1]), 4294967295)) % 10000 AS bucket
 FROM (SELECT DISTINCT g FROM c), x),
e AS (SELECT r, bucket, sum(n)::BIGINT AS n FROM c JOIN b USING (g) GROUP BY r, bucket),
p AS (SELECT bucket, sum(CASE WHEN r > 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN r < 0 THEN n ELSE 0 END) AS t FROM e GROUP BY bucket),
a AS (SELECT sum(s) AS ss, sum(t) AS tt FROM p),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM p, a),
d AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM e JOIN gain USING (bucket) GROUP BY r),
s AS (SELECT w.r, doc_id, len(ws) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
 coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d USING (r) WHERE w.r > 0),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM o) // 100 THEN rank END AS rank FROM s LEFT JOIN o USING (r)
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM k),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
f AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM k) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // l)))) AS BIGINT) AS score FROM f JOIN w USING (t) JOIN q USING (t), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_substring_dedup": OP5_SQL,
        "op7_quality_rules": OP7_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op11_topk_search": OP11_SQL,
        "op12_importance_resampling": OP12_SQL,
        "op13_lexical_search": OP13_SQL,
    }
