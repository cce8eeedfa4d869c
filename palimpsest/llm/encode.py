"""Problem 8: token ids of every text by a public byte-level BPE vocabulary.

Distinct-word table. Texts are split into the vocabulary's words (its own pattern, no word is lost or joined), every
distinct word of the corpus is encoded once, and the ids return to the positions through the chunks' indexes
(``chunks``). Decoding joins ids with the table of pieces.

Defined cases: a null and an empty text have an empty list of ids; strings that look like special tokens are ordinary
text; rows with equal or null ids of documents stay rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import written
from .chunks import chunked

TOKENIZERS = "/opt/tokenizers"
# fixed value: the pattern by which this vocabulary splits text
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def encoder(name: str, folder: str):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=vocabulary(name, folder), special_tokens={})


def _ship(spark: SparkSession, name: str, folder: str) -> None:
    """Send the vocabulary to the executors; only the driver has to see ``folder``."""
    spark.sparkContext.addFile(os.path.join(folder, f"{name}.tiktoken"))


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def split(text: str) -> list[str]:
    return _pattern().findall(text)


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id_col, ids)`` for every row of ``df``, by the vocabulary ``name`` of ``folder`` (a folder of the driver)."""
    _ship(df.sparkSession, name, folder)
    kind = dict(df.select(id_col).dtypes)[id_col]
    chunks = written(chunked(df, id_col, text_col, split), "words")
    used = chunks.select(F.col("chunk").alias("c"), F.posexplode("pieces").alias("at", "word"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(name, SparkFiles.getRootDirectory())
        for b in batches:
            ids = bpe.encode_ordinary_batch(b.column(0).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    words = used.select("word").distinct().mapInArrow(encode, "word string, ids array<int>")
    coded = used.join(words, "word").select("c", "at", "ids")

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([(id_col, right.schema.field("ids").type.value_type), ("ids", pa.list_(pa.int32()))])
        if not right.num_rows:
            return schema.empty_table()
        row = right.slice(0, 1)
        lens, idx = row["lens"].chunk(0).values.to_numpy(), row["idx"].chunk(0).values.to_numpy()
        if left.num_rows:
            left = left.sort_by("at")
            lists = left["ids"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            flat, size = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            first = np.r_[0, np.cumsum(size)[:-1]]
            n = size[idx]
            ends = np.cumsum(n)
            ids = flat[np.repeat(first[idx] - (ends - n), n) + np.arange(ends[-1])] if len(idx) else np.empty(0, np.int32)
            cut = np.r_[0, ends][np.r_[0, np.cumsum(lens)]]
        else:
            ids, cut = np.empty(0, np.int32), np.zeros(len(lens) + 1, np.int64)
        return pa.table([row["ids"].chunk(0).values, pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))], schema=schema)

    return coded.groupBy("c").cogroup(chunks.groupBy("chunk")).applyInArrow(place, f"`{id_col}` {kind}, ids array<int>")


def piece_table(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id, piece BINARY)``; its size is the vocabulary's."""
    return spark.createDataFrame([(i, bytearray(p)) for p, i in vocabulary(name, folder).items()], "id int, piece binary")


def decode_ids(df: DataFrame, id_col: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``(id_col, text)``: ids joined with their pieces; an empty list gives an empty text, a null one null.

    ``id_col`` must be unique. The table of pieces is broadcast: it has the vocabulary's fixed size.
    """
    pieces = piece_table(df.sparkSession, name, folder)
    at = df.select(F.col(id_col).alias("doc"), F.posexplode(ids).alias("at", "id"))
    joined = at.join(F.broadcast(pieces), "id").select("doc", "at", F.hex("piece").alias("x"))
    text = joined.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("p")).select(
        "doc", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["x"]), "")), "UTF-8").alias("text")
    )
    return df.select(F.col(id_col).alias("doc"), ids).join(text, "doc", "left").select(F.col("doc").alias(id_col), F.when(F.col(ids).isNotNull(), F.coalesce("text", F.lit(""))).alias("text"))
