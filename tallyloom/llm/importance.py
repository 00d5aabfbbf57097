"""Importance resampling towards a target distribution of hashed n-grams, in DataFrame functions only.

A feature is a run of 1 to 3 consecutive words joined by one space; its bucket is the crc32 of its UTF-8 bytes modulo `buckets`. Higher-order
functions make each text's array of buckets, without a row for each feature. The corpus' totals by bucket (`buckets` numbers from each
task, summed before they move) and the target's give one gain for each bucket; a document's weight is the sum over its array of
`element_at` the gains, a literal array of `buckets` numbers in the plan. Texts are never shuffled: only totals are, and the ids, scores and
places of the rows that are drawn. Documents draw themselves by the Gumbel trick: score = weight + noise that depends on the
id alone, and the highest scores win.

Defined results: null and empty texts have no features, weight 0 and are never drawn, as they are too short; a null id gets the noise of an empty id and
comes last in ties; repeated rows count each in the totals and are drawn each, with places of their own; an empty corpus gives no rows; over an empty
target all gains are those of t = T = 0. Extra columns do not matter. A very long text is one array of about three times its words; a text
of 50 MB takes about 2 GB of heap, as all its features are strings for a moment.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import ordinals
from .common import materialize, plain, text_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What separates words, once A-Z are lower case.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LEAST_WORDS = 20
#: Classes of scores that come to the driver to find where the drawn ones end.
CLASSES = 65_536


def ascii_lower(text: Column) -> Column:
    """Only A-Z in lower case. `lower` does the same where every character is one byte, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def with_buckets(rows: DataFrame, text: Column, buckets: int = BUCKETS) -> DataFrame:
    """Adds n_words and `buckets`, a bucket for each feature. Each step is a projection of its own, so that no array is made twice."""
    words = F.array_remove(F.split(ascii_lower(text), APART), "")
    n = F.size("words")
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    less = lambda k: F.greatest(n - k, F.lit(0))
    own = rows.withColumn("words", words).withColumn("n_words", n)
    own = own.withColumn("pairs", F.zip_with(F.slice("words", F.lit(1), less(1)), F.slice("words", F.lit(2), less(1)), joined))
    own = own.withColumn("triples", F.zip_with(F.slice("pairs", F.lit(1), less(2)), F.slice("words", F.lit(3), less(2)), joined))
    of = lambda x: (F.crc32(x) % buckets).cast("smallint" if buckets <= 32_768 else "int")
    return own.withColumn("buckets", F.transform(F.concat("words", "pairs", "triples"), of)).drop("words", "pairs", "triples")


def totals(featured: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features each bucket holds: at most `buckets` sums from each task."""
    out = [0] * buckets
    for r in featured.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(target: Sequence[int], corpus: Sequence[int]) -> list[int]:
    n, all_t, all_s = len(corpus), sum(target), sum(corpus)
    return [math.floor(1000 * math.log((float(t + 1) * (all_s + n)) / (float(s + 1) * (all_t + n)))) for t, s in zip(target, corpus, strict=True)]


def literal(numbers: Sequence[int]) -> Column:
    """An array of numbers as one literal in the plan: a foldable expression, not a node for each number."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def noise(id_: Column, seed: int = 42) -> Column:
    """1000 times a draw of the standard Gumbel law, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), text_of(id_)), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, n: int) -> DataFrame:
    """(row, rank) of the n highest scores among the rows that are long enough; ties to the smaller id. scored: a written table."""
    able = scored.where("able")
    ends = able.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if not n or ends["low"] is None:
        return able.where(F.lit(False)).select("row", F.lit(None).cast("bigint").alias("rank"))
    width = (ends["high"] - ends["low"]) // CLASSES + 1
    by_class = able.groupBy(F.expr(f"(score - ({ends['low']}L)) div {width}").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()  # CLASSES rows at most
    left, edge = n, ends["low"]
    for c, size in sorted(((r["c"], r["n"]) for r in by_class), reverse=True):
        left -= size
        if left <= 0:
            edge = ends["low"] + c * width
            break
    near = able.where(F.col("score") >= edge).select("row", "id", "score")
    return ordinals(near, [F.desc("score"), F.asc_nulls_last("id")], "row", "rank").where(F.col("rank") <= n).select("row", "rank")


def resample(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, percent: int = 5, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document; rank is null for those not drawn."""
    own, id_, text = plain(docs, id_col, text_col)
    featured = with_buckets(own.select(id_.cast("bigint").alias("id"), text_of(text).alias("text")), F.col("text"), buckets).drop("text")
    featured = materialize(featured.withColumn("row", F.monotonically_increasing_id()), "buckets")
    aim, aimed = plain(target, target_col)
    wanted = totals(with_buckets(aim.select(text_of(aimed).alias("text")), F.col("text"), buckets), buckets)
    gain = literal(gains(wanted, totals(featured, buckets)))
    weight = F.aggregate("buckets", F.lit(0).cast("bigint"), lambda sum_, b: sum_ + F.element_at(gain, b.cast("int") + 1))
    slim = featured.select("row", "id", F.col("n_words").cast("bigint").alias("n_words"), F.size("buckets").cast("bigint").alias("n_features"), weight.alias("weight"))
    slim = slim.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn("able", F.col("n_words") >= LEAST_WORDS)
    slim = materialize(slim, "scores")
    n = percent * slim.where("able").count() // 100
    return slim.join(drawn(slim, n), "row", "left").select("id", "n_words", "n_features", "weight", "score", "rank")
