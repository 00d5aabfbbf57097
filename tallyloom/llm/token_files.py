"""Token ids in Huffman-coded files, and their reader.

Layout of a folder: `codes` has a row (id, bits) for each id of the canonical code, made from the counts of the whole
corpus; `rows` has the token stream in ascending order of document id. A row holds whole documents: their
ids and lengths, the bit stream of their tokens, and the bit at which each block of BLOCK tokens begins, so that
blocks decode on their own from a table. `part` and `row` give the order of rows; `before` is
the number of tokens of the part ahead of the row. Spark's committer writes both tables, so a lost task leaves nothing.

Defined results: a null text is empty and has the end id only; rows of one id are ordered by their length and the checksum of
their ids, so rows of one id may lie in several parts; null ids come first; an empty table gives empty files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_shuffles, materialize, plain, scratch_path
from .huffman import Code, code_lengths
from .tokens import encoded, encoder

BLOCK = 256
MAX_BITS = 18
ROW_TOKENS = 1 << 17
PART_TOKENS = 8_000_000
MAX_PARTS = 100_000


def tokenized(docs: DataFrame, vocab: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens, crc and ids (zstd over little-endian ids of the vocabulary's width)."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for first, ids, at in encoded(vocab, batch.column(1), end_id):
                n = len(at) - 1
                raw = [ids[at[k] : at[k + 1]].tobytes() for k in range(n)]
                sums = pa.array([zlib.crc32(x) for x in raw], pa.int64())
                small = pa.array([pack.compress(x) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(at), pa.int64()), sums, small], names=["id", "n_tokens", "crc", "ids"])

    own, id_, text = plain(docs, id_col, text_col)
    rows = own.select(id_.cast("bigint").alias("id"), text.cast("string").alias("t"))
    return rows.mapInArrow(run, "id bigint, n_tokens bigint, crc bigint, ids binary")


def _unpacked(batch: pa.RecordBatch, kind) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpack.decompress(x), kind) for x in batch.column("ids").to_pylist()]


def counted(tokens: DataFrame, kind) -> list:
    """(id, count) over all tokens; at most as many rows as the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for own in _unpacked(batch, kind):
                if len(own):
                    c = np.bincount(own)
                    if len(c) > len(total):
                        total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
                    total[: len(c)] += c
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()


ROWS = "part int, row int, before bigint, doc_ids array<bigint>, n_tokens array<bigint>, payload binary, starts array<bigint>"


def write(docs: DataFrame, path: str, vocab: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the files of all documents to path."""
    spark = docs.sparkSession
    kind = encoder(vocab).dtype
    # the tag, fixed once the table is written, lets rows that agree in all else lie in several parts
    tokens = materialize(tokenized(docs, vocab, end_id, id_col, text_col).withColumn("tag", F.monotonically_increasing_id()), "token_ids", "none")
    counts = counted(tokens, kind)
    ids = np.array([r["id"] for r in counts], np.int64)
    n = np.array([r["n"] for r in counts], np.int64)
    bits = code_lengths(n, MAX_BITS)
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits, strict=True)], "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codes")

    def run(batches):
        code = Code(ids, bits)
        part, row, before = TaskContext.get().partitionId(), 0, 0
        docs_, sizes, held, total = [], [], [], 0

        def flush():
            stream = np.concatenate(held)
            payload, starts = code.encode(stream, BLOCK)
            arrays = [pa.array([part], pa.int32()), pa.array([row], pa.int32()), pa.array([before], pa.int64()), pa.array([docs_], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([starts.tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "row", "before", "doc_ids", "n_tokens", "payload", "starts"])

        for batch in batches:
            for doc, own in zip(batch.column("id").to_pylist(), _unpacked(batch, kind), strict=True):
                docs_.append(doc)
                sizes.append(len(own))
                held.append(own)
                total += len(own)
                if total >= ROW_TOKENS:
                    yield flush()
                    row, before = row + 1, before + total
                    docs_, sizes, held, total = [], [], [], 0
        if docs_:
            yield flush()

    parts = min(MAX_PARTS, int(n.sum()) // PART_TOKENS + 1)
    order = ["id", "n_tokens", "crc", "tag"]
    ordered = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, ROWS).write.option("compression", "none").parquet(f"{path}/rows")
    del ordered
    free_shuffles(spark)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens, ids_crc32."""
    codes = spark.read.schema("id bigint, bits int").parquet(f"{path}/codes").orderBy("id").collect()  # at most the vocabulary
    ids, bits = np.array([r["id"] for r in codes], np.int64), np.array([r["bits"] for r in codes], np.int64)
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    sums = rows.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n"))  # a row for each part: MAX_PARTS at most
    offset = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("part", offset.alias("offset"))

    def run(batches):
        code = Code(ids, bits)
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["n_tokens"], np.int64)
                wide = code.decode(r["payload"], int(sizes.sum()), np.array(r["starts"], np.int64), BLOCK).astype("<u4")
                end = np.cumsum(sizes)
                start = end - sizes
                sums_ = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(sizes), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(start + r["before"]), pa.array(sizes), pa.array(sums_, pa.int64())],
                    names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    found = rows.mapInArrow(run, "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocab: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = scratch_path(docs.sparkSession, "token_files")
    write(docs, path, vocab, end_id, id_col, text_col)
    return read(docs.sparkSession, path)
