"""Aggregation and joins that stay balanced when a few keys hold most rows.

Spark combines algebraic aggregates before the shuffle, but a distinct count, an ordered list or any
other aggregate with large state is not reduced by that: all rows of a key meet in one task. The two
stages here split a heavy key over ``salts`` tasks and merge the partial results by the original key.

The salt is a hash of the row, not ``rand()``: a task that is run again after an executor was lost must
send its rows to the same partitions as before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written

SALT = "__salt"


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """Keys that hold more than ``share`` of all rows, with ``n_rows``; at most ``1 / share`` rows.

    Null keys count as keys of their own. An empty input gives no rows.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("__total"))
    return counts.join(F.broadcast(total), on=F.col("n_rows") > F.col("__total") * F.lit(share)).drop("__total")


def salt(on: Sequence[Column], salts: int) -> Column:
    return F.pmod(F.xxhash64(*on, F.lit("salt")), F.lit(salts)).cast("int")


def keyed_record_counts(
    df: DataFrame,
    key: str,
    docs: str,
    share: float = 0.01,
    salts: int = 32,
) -> DataFrame:
    """Per key: rows, references and distinct records of an array column, and whether the key is heavy.

    Result columns: ``key`` (under its own name), ``n_rows`` BIGINT, ``n_refs`` BIGINT (non-null elements of
    ``docs``), ``n_records`` BIGINT (distinct ones), ``heavy`` BOOLEAN (the key holds more than ``share`` of
    the rows). Rows whose key is null are left out; a null or empty ``docs`` counts as a row without
    references. Repeated rows count as often as they stand. An empty table gives no rows; other columns are
    ignored whatever their names.

    A first scan of the keys alone counts rows, combined before its shuffle, and is written once; it names the keys
    to salt, at most ``1 / share`` of them whatever the size of the data, so their broadcast is bounded. The
    second scan gives all results by two stages. A row becomes its elements and one null that stands for the row
    itself. Stage one groups by (key, salt, element), then by (key, salt); the salt comes from the element, so that the
    distinct elements of different salts are disjoint and partial counts add up exactly; keys that are not heavy use
    salt 0, and the nulls are combined before the shuffle. Stage two merges the partials by key.
    """
    rows = df.select(F.col(key).alias("k"), F.col(docs).alias("d")).where(F.col("k").isNotNull())
    sizes = written(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "key-counts")
    line = (sizes.agg(F.sum("n")).first()[0] or 0) * share
    heavy = sizes.where(F.col("n") > line).select(F.col("k").alias("hk"))
    flagged = rows.join(F.broadcast(heavy), F.col("k") == F.col("hk"), "left")
    parts = F.concat(F.array(F.lit(None).cast(rows.schema["d"].dataType.elementType)), F.coalesce(F.filter("d", lambda x: x.isNotNull()), F.array().cast(rows.schema["d"].dataType)))
    elements = flagged.select("k", "hk", F.explode(parts).alias("e"))
    salted = elements.select("k", "e", F.when(F.col("hk").isNotNull(), salt([F.col("e")], salts)).otherwise(F.lit(0)).alias(SALT))
    found = salted.groupBy("k", SALT, "e").agg(F.count(F.lit(1)).alias("n"))
    partial = found.groupBy("k", SALT).agg(
        F.coalesce(F.sum(F.when(F.col("e").isNull(), F.col("n"))), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("e").isNotNull(), F.col("n"))), F.lit(0)).alias("n_refs"),
        F.count("e").alias("n_records"),
    )
    merged = partial.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_refs", "n_records")])
    return merged.select(F.col("k").alias(key), "n_rows", "n_refs", "n_records", (F.col("n_rows") > line).alias("heavy"))


def salted_join_unique(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", heavy_share: float = 0.02, heavy: DataFrame | None = None) -> DataFrame:
    """Join ``rows`` with a ``lookup`` that has one row per key, although some keys hold most of ``rows``.

    Keys over ``heavy_share`` of the rows (at most ``1 / heavy_share`` of them, counted here unless ``heavy`` has them)
    are joined by a broadcast of just their lookup rows, so their rows never move; all others are joined by an ordinary
    shuffle. Rows with a null key are dropped by ``inner`` and kept by ``left``.
    """
    if heavy is None:
        heavy = heavy_keys(rows.where(F.col(key).isNotNull()), [key], heavy_share).select(key)
    flagged = rows.join(F.broadcast(heavy.withColumn("__heavy", F.lit(True))), key, "left")
    light = flagged.where(F.col("__heavy").isNull()).drop("__heavy").join(lookup, key, how)
    hot = flagged.where(F.col("__heavy")).drop("__heavy").join(F.broadcast(lookup.join(F.broadcast(heavy), key, "left_semi")), key, how)
    return light.unionByName(hot)


def meeting_pairs(rows: DataFrame, key: str, doc: str = "doc", more: Sequence[str] = (), each: int = 1000) -> DataFrame:
    """``(a, b, a_x, b_x, ...)``, a < b: every two documents that share a key, once for each key; ``more`` names columns x.

    The rows of a key that more than ``each`` documents share are split into blocks of about that size, by a hash of the
    document, and every block meets the whole list in a task of its own; no pair is left out by that. Rows of keys that
    stand alone, most of them as a rule, are dropped first, by counts of the keys' hashes that are combined before their
    shuffle; repeated rows only then.
    """
    named = rows.select(key, doc, *more).where(F.col(key).isNotNull() & F.col(doc).isNotNull()).withColumn("__h", F.xxhash64(key))
    sizes = named.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    split = named.join(sizes, "__h").drop("__h").distinct().withColumn("__blocks", F.ceil(F.col("__n") / each).cast("int"))
    side = lambda name: [F.col(doc).alias(name), *(F.col(x).alias(f"{name}_{x}") for x in more)]
    left = split.select(F.col(key).alias("__k"), *side("a"), F.pmod(F.xxhash64(doc), F.col("__blocks")).cast("int").alias("__block"))
    right = split.select(F.col(key).alias("__k"), *side("b"), F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"))
    return left.join(right, ["__k", "__block"]).where("a < b").drop("__k", "__block")


def split_join(left: DataFrame, right: DataFrame, key: str, by: str, each: int = 1000) -> DataFrame:
    """Inner join on ``key`` where a key may hold a large part of ``right``.

    The rows of a key with more than ``each`` on the right are split into blocks by a hash of the column ``by``, and the
    rows of the left are sent to every block of their key.
    """
    sizes = right.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / each).cast("int").alias("__blocks"))
    asked = left.join(sizes, key).withColumn("__block", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).drop("__blocks")
    placed = right.join(sizes.where("__blocks > 1"), key, "left").withColumn("__block", F.pmod(F.xxhash64(by), F.coalesce("__blocks", F.lit(1))).cast("int")).drop("__blocks")
    return asked.join(placed, [key, "__block"]).drop("__block")
