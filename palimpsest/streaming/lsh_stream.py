"""Buckets and matches of documents that arrive in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import hash_tokens, minhash_of_hashes
from ..functions.tokenizers import shingle, words
from ..operators.lsh import lsh
from ..runtime import path_exists


def bucket_rows(docs: DataFrame, n: int, h: int, bands: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """Buckets of texts by n-grams; texts of no more than n words have none. Works on streams."""
    w = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > n)
    signed = w.select("doc_id", minhash_of_hashes(hash_tokens(shingle(F.col("w"), n)), h, seed).alias("minhashes"))
    return lsh(signed, bands, h)


def stream_buckets(docs: DataFrame, path: str, checkpoint: str, n: int = 5, h: int = 200, bands: int = 50, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> StreamingQuery:
    """Append the buckets of a stream of documents to the Parquet table ``path``, batch by batch.

    A batch is one folder, written over when the batch is run again, so a restart adds nothing twice. A document that
    arrives again has rows in both batches; ``current_buckets`` takes the latest. Of several versions in one batch the
    one with the largest ``order_col`` counts, and of equal ones the largest text.
    """

    def add(batch: DataFrame, number: int) -> None:
        order = F.struct(*[F.col(c) for c in (order_col, text_col) if c])
        one = batch.groupBy(id_col).agg(F.max_by(text_col, order).alias(text_col))
        rows = bucket_rows(one, n, h, bands, seed, id_col, text_col)
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_buckets(spark, path: str) -> DataFrame:
    """``(doc, buckets)`` of each document's latest batch."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "doc string, buckets string")
    rows = spark.read.parquet(path)
    last = rows.groupBy("doc").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["doc", "batch"], "left_semi").select("doc", "buckets")


def stream_matches(docs: DataFrame, buckets: DataFrame, n: int = 5, h: int = 200, bands: int = 50, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(a, b)`` of a stream: an arriving document a and one b of a fixed table of buckets that share a bucket.

    A pair comes once for each bucket shared in a batch. The table is planned like any other side of a join.
    """
    new = bucket_rows(docs, n, h, bands, seed, id_col, text_col).withColumnRenamed("doc", "a")
    return new.join(buckets.withColumnRenamed("doc", "b"), "buckets").where("a != b").select("a", "b")
