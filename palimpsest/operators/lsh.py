"""Locality-sensitive hashing of minhash signatures by bands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..functions.hashing import random_ints
from .salted import meeting_pairs, split_join


def check_banding(h: int, b: int) -> int:
    """Rows in a band."""
    if b < 1 or h % b:
        raise ValueError("The number of hashes must be evenly divisible by the number of bands.")
    return h // b


def band_seq(h: int, b: int) -> list[range]:
    r = check_banding(h, b)
    return [range(i, i + r) for i in range(0, h, r)]


def lsh_probability(h: int, b: int, s: Column | float):
    """Probability that two signatures of similarity s share a bucket."""
    return 1 - (1 - s ** (h / b)) ** b


def lsh_threshold(h: int, b: int) -> float:
    return (1 / b) ** (1 / (h / b))


def sign(df: DataFrame, n: int = 200, seed: int = 42, hashes: str = "hashes", out: str = "minhashes", rows: int = 256) -> DataFrame:
    """``df`` with the signatures of its hashes, the same as ``minhash_of_hashes``: null for null or empty hashes.

    The n passes over all hashes run in numpy on Arrow batches, ``rows`` documents at a time; as expressions they are n
    evaluations of a lambda for each hash.
    """
    if n < 1:
        raise ValueError("a signature needs at least one hash")
    ints = np.array(random_ints(n, seed), np.int64)
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(LongType()))])
    most = np.iinfo(np.int64).max

    def signed(b: pa.RecordBatch) -> pa.RecordBatch:
        lists = b.column(b.schema.get_field_index(hashes))
        lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        none = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
        flat = flat.fill_null(0).to_numpy(zero_copy_only=False)
        there = lens > 0
        begin = (np.cumsum(lens) - lens)[there]
        sig = np.empty((len(begin), n), np.int64)
        for j, r in enumerate(ints if len(begin) else []):
            x = flat ^ r
            if none is not None:
                x[none] = most
            sig[:, j] = np.minimum.reduceat(x, begin)
        if none is not None:
            there[there] = sig[:, 0] != most
            sig = sig[sig[:, 0] != most]
        at = pa.array(np.r_[0, np.cumsum(there * n)].astype(np.int32), mask=np.r_[~there, False])
        return pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(sig.ravel()))], names=[*b.schema.names, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, rows):
                yield signed(b.slice(lo, rows))

    return df.mapInArrow(run, schema)


def lsh(df: DataFrame, bands: int, h: int, id_col: str = "doc_id", minhashes: str = "minhashes") -> DataFrame:
    """``(doc, buckets)``, one row for each document and band; the band's number is part of the hash.

    Signatures must have ``h`` values, else the query fails; null signatures have no buckets. No shuffle.
    """
    r = check_banding(h, bands)
    m = F.col("m")
    keys = F.transform(F.sequence(F.lit(1), F.lit(bands)), lambda i: F.md5(F.concat_ws("|", i.cast("string"), F.array_join(F.slice(m, (i - 1) * r + 1, r), ","))))
    checked = F.when(F.size("m") == h, keys).otherwise(F.raise_error(F.lit(f"a signature has not {h} values")))
    return df.select(F.col(id_col).alias("doc"), F.col(minhashes).alias("m")).where("m is not null").select("doc", F.explode(checked).alias("buckets"))


def lsh_add(buckets: DataFrame, df: DataFrame, bands: int, h: int, id_col: str = "doc_id", minhashes: str = "minhashes") -> DataFrame:
    """Buckets with the documents of ``df`` added; those already there are replaced."""
    new = lsh(df, bands, h, id_col, minhashes)
    return buckets.join(df.select(F.col(id_col).alias("doc")).distinct(), "doc", "left_anti").select("doc", "buckets").unionByName(new)


def lsh_candidates(buckets: DataFrame, each: int = 1000) -> DataFrame:
    """Distinct pairs ``(a, b, score NULL)``, a < b, of documents that share a bucket. Null buckets match nothing.

    Buckets of one document are dropped before the join, and those of more than ``each`` are split (``meeting_pairs``).
    """
    return meeting_pairs(buckets, "buckets", each=each).select("a", "b").distinct().withColumn("score", F.lit(None).cast("double"))


def lsh_query(buckets: DataFrame, ids: DataFrame) -> DataFrame:
    """``(a, b, score NULL)``: for each id of the one-column frame ``ids`` the documents that share a bucket with it.

    A bucket of very many documents is split (``split_join``).
    """
    q = ids.toDF("a").distinct().join(buckets.select(F.col("doc").alias("a"), "buckets"), "a").distinct()
    met = split_join(q, buckets.select(F.col("doc").alias("b"), "buckets").where("buckets is not null"), "buckets", "b")
    return met.where("a != b").select("a", "b").distinct().withColumn("score", F.lit(None).cast("double"))


def lsh_subset(candidates: DataFrame) -> DataFrame:
    """``(doc)``: every document of a candidate pair."""
    return candidates.select(F.explode(F.array("a", "b")).alias("doc")).where("doc is not null").distinct()


def lsh_compare(candidates: DataFrame, docs: DataFrame, f: Callable[[Column, Column], Column], id_col: str = "doc_id", on: str = "hashes") -> DataFrame:
    """Candidates with scores; only pairs without one (null or NaN) are compared, and only their documents are joined."""
    open_ = F.col("score").isNull() | F.isnan("score")
    d = docs.select(F.col(id_col).alias("id"), F.col(on).alias("v"))
    fresh = (
        candidates.where(open_).select("a", "b")
        .join(d.select(F.col("id").alias("a"), F.col("v").alias("x")), "a")
        .join(d.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
        .select("a", "b", f(F.col("x"), F.col("y")).cast("double").alias("score"))
    )
    return candidates.where(~open_).select("a", "b", "score").unionByName(fresh)
