"""Documents from files, folders, frames and strings: rows ``(doc_id, content, meta)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import as_string, filenames


def _files(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    if encoding.upper().replace("-", "") in ("UTF8", "UNKNOWN"):
        raw = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    else:
        raw = spark.read.format("binaryFile").load(paths).select("path", F.decode("content", encoding).alias("content"))
    name = F.url_decode(F.regexp_replace("path", r"\+", "%2B"))
    return raw.select(filenames(name).alias("doc_id"), as_string(F.col("content")).alias("content"), F.create_map(F.lit("file"), name, F.lit("id"), filenames(name)).alias("meta"))


def from_paths(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Whole files; the id is the file's name without its extension."""
    if not paths:
        raise ValueError("no paths given")
    return _files(spark, list(paths), encoding)


def from_dir(spark: SparkSession, folder: str, encoding: str = "UTF-8") -> DataFrame:
    """Every file directly in a folder, of whatever extension."""
    return _files(spark, [folder.rstrip("/") + "/*"], encoding)


def from_texts(spark: SparkSession, texts: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Strings with their ids, or numbered ``doc-1``, ``doc-2``, ..."""
    pairs = list(texts.items()) if isinstance(texts, Mapping) else [(f"doc-{i}", t) for i, t in enumerate(texts, 1)]
    rows = spark.createDataFrame(pairs, "doc_id string, content string")
    return rows.withColumn("meta", F.create_map(F.lit("id"), F.col("doc_id")))


def from_dataframe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns of any frame; the id keeps its type."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("content"), F.create_map(F.lit("id"), F.col(id_col).cast("string")).alias("meta"))


def write_table(df: DataFrame, path: str, bucket_column: str | None = None, parts: int | None = None) -> None:
    """Parquet sink; ``bucket_column`` groups equal values into the same files, for later lookups by it."""
    out = df.repartition(parts, bucket_column) if bucket_column and parts else df.repartition(bucket_column) if bucket_column else df
    out.write.mode("overwrite").option("compression", "zstd").parquet(path)


