"""Problem 5: one group identifier for all records that are linked directly or indirectly.

Hash-to-min (Rastogi et al. 2013). Every vertex keeps a cluster, at first itself and its neighbours; in a round it
sends the cluster to its smallest member and the smallest member to all others, until nothing changes. A cluster
is a set of rows ``(v, u)`` here, never one value: the smallest member of a group gathers the whole group, and
its rows stay spread over partitions. The minimum of a cluster is combined before the shuffle, and joined back
without moving the rows of heavy vertices (``salted_join_unique``).

Defined cases: a pair with a null side links nothing and names nobody; a record linked only to itself is a group
of its own; direction, repetition and further columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.salted import salted_join_unique
from ..runtime import delete_path, scratch_path


def link_groups(pairs: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(group_doc, doc)``: every record of a pair with both sides, and the smallest id it is linked to.

    Rounds grow with the logarithm of the longest chain in practice; more than ``rounds`` is an error, never a
    partial result.
    """
    spark = pairs.sparkSession

    def kept(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "clusters")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    links = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    mirrored = links.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))).alias("x"))
    state, path = kept(mirrored.select("x.v", "x.u").distinct())
    before = None
    for _ in range(rounds):
        low = state.groupBy("v").agg(F.min("u").alias("m"))
        with_low = salted_join_unique(state, low, "v")
        sent = with_low.select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u").distinct()
        # a round needs the one before it only
        old, (state, path) = path, kept(sent)
        delete_path(spark, old)
        # stable once every vertex holds only its minimum and the minimum holds everybody: equal size and 128 bits of sums
        now = tuple(state.agg(F.count(F.lit(1)), *[F.sum(F.xxhash64(*x).cast("decimal(38,0)")) for x in (("v", "u"), ("u", "v"))]).first())
        if now == before:
            return state.groupBy(F.col("v").alias("doc")).agg(F.min("u").alias("group_doc")).select("group_doc", "doc")
        before = now
    raise RuntimeError(f"groups aren't stable after {rounds} rounds")
