"""Problem 3: how often every term occurs, in how many records, and which terms are of no use.

Incremental signed deltas. ``TermCounts`` keeps postings ``(token, doc, n)`` and counts ``(token, n_rows, n_records)`` in
a folder that all executors share, both as immutable parts. ``apply`` takes only added, changed or deleted rows (a change
is a deletion of the old row and an addition of the new one) and aggregates them to signed changes. Whether a pair of
token and record appears or disappears depends on its earlier postings; they lie in buckets by record, and only the
buckets that hold a record of the delta are read. The changes become a new part: nothing stored is rewritten for it.
Parts of equal level merge, so their number grows with the logarithm of the deltas. A delta is there when its
manifest is: parts that no manifest names, from a driver that was lost, are ignored.

A token is folded by trimming and lower-casing; null and empty ones are left out. Records are the distinct
non-null elements of ``docs``; a null or empty ``docs`` is a row without records. Repeated rows each count as
rows. A row taken away before it was added is owed: the balance is kept, and the term appears once it is positive. An
empty delta changes nothing. Extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import fold_token
from ..runtime import delete_path, last_note, parallelism, put_note, scratch_path

POSTING = "token string, doc string, n bigint"
COUNT = "token string, n_rows bigint, n_records bigint"


class TermCounts:
    """Counts of terms in ``path`` (default: the session's shared folder), brought up to date by deltas.

    The number of buckets follows the first delta (``each`` postings a bucket) and stays.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, each: int = 1_000_000):
        self.spark, self.path, self.each = spark, path or scratch_path(spark, "term-counts"), each
        self.number, self.buckets, self.levels = 0, 0, []
        note = last_note(spark, f"{self.path}/manifest")
        if note:
            self.number, self.buckets, self.levels = note["number"], note["buckets"], [tuple(x) for x in note["parts"]]

    def parts(self) -> int:
        return len(self.levels)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc"), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, parts: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{p}" for p in parts])

    def _postings(self, parts: list[str]) -> DataFrame:
        # the folders of buckets are read one part at a time, as each part has its own root
        one = [self.spark.read.schema(POSTING + ", bucket int").parquet(f"{self.path}/postings/{p}") for p in parts]
        out = one[0]
        for x in one[1:]:
            out = out.unionByName(x)
        return out

    def _write_postings(self, df: DataFrame, part: str) -> DataFrame:
        # a bucket that one record fills is split by the rebalancing
        placed = df.withColumn("bucket", self._bucket()).hint("rebalance", "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/postings/{part}")
        return self._postings([part])

    def apply(self, delta: DataFrame, token: str = "token", docs: str = "docs", sign: str | None = None) -> None:
        """Merge the rows of ``delta``: sign 1 (or no sign column) adds a row, -1 takes one away."""
        s = F.col(sign).cast("bigint") if sign else F.lit(1).cast("bigint")
        rows = delta.select(fold_token(F.col(token)).alias("token"), F.col(docs).alias("docs"), s.alias("s")).where("token is not null and token != ''")
        change = (
            rows.select("token", "s", F.explode(F.array_distinct(F.filter("docs", lambda d: d.isNotNull()))).alias("doc"))
            .groupBy("token", F.col("doc").cast("string").alias("doc"))
            .agg(F.sum("s").alias("n"))
            .where("n != 0")
        )
        part = f"{self.number + 1}-{uuid.uuid4().hex[:8]}"
        if not self.buckets:
            most = rows.agg(F.sum(F.coalesce(F.size("docs"), F.lit(0)).cast("bigint"))).first()[0] or 0
            # each bucket is a folder: of very many postings larger ones, so that the folders stay a short list
            self.buckets = max(parallelism(self.spark), min(-(-most // self.each), 2000), -(-most // (50 * self.each)))
        new = self._write_postings(change, part)
        if self.levels:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]
            before = self._postings([p for _, p in self.levels])
            before = before.where(F.col("bucket").isin(touched)) if len(touched) < self.buckets else before
            had = before.join(new.select("token", "doc", "bucket"), ["token", "doc", "bucket"], "left_semi").groupBy("token", "doc").agg(F.sum("n").alias("had"))
            both = new.join(had, ["token", "doc"], "left").select("token", F.coalesce("had", F.lit(0)).alias("had"), "n")
        else:
            both = new.select("token", F.lit(0).cast("bigint").alias("had"), "n")
        there = lambda c: F.when(c > 0, 1).otherwise(0).cast("bigint")
        records = both.groupBy("token").agg(F.lit(0).cast("bigint").alias("n_rows"), F.sum(there(F.col("had") + F.col("n")) - there(F.col("had"))).alias("n_records"))
        moved = rows.groupBy("token").agg(F.sum("s").alias("n_rows"), F.lit(0).cast("bigint").alias("n_records")).unionByName(records)
        self._summed(moved).write.option("compression", "zstd").parquet(f"{self.path}/counts/{part}")
        self._merge(part)

    def _summed(self, counts: DataFrame) -> DataFrame:
        return counts.groupBy("token").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records")).where("n_rows != 0 or n_records != 0")

    def _merge(self, part: str) -> None:
        """Take a new part in; parts of its level become one of the next. Then the manifest, then the old parts go."""
        level, gone = 0, []
        while self.levels and self.levels[-1][0] == level:
            gone.append(self.levels.pop()[1])
            level += 1
        self.number += 1
        if gone:
            old, part = [*gone, part], f"{part}-{level}"
            self._write_postings(self._postings(old).groupBy("token", "doc").agg(F.sum("n").alias("n")).where("n != 0"), part)
            self._summed(self._read("counts", old, COUNT)).write.option("compression", "zstd").parquet(f"{self.path}/counts/{part}")
            gone = old
        self.levels.append((level, part))
        put_note(self.spark, f"{self.path}/manifest", self.number, {"number": self.number, "buckets": self.buckets, "parts": self.levels})
        for p in gone:
            delete_path(self.spark, f"{self.path}/postings/{p}")
            delete_path(self.spark, f"{self.path}/counts/{p}")

    def counts(self) -> DataFrame:
        """``(token, n_rows, n_records)`` as of the last delta: the sum of the parts, for terms that have rows."""
        if not self.levels:
            return self.spark.createDataFrame([], COUNT)
        return self._summed(self._read("counts", [p for _, p in self.levels], COUNT)).where("n_rows > 0")


def mark_terms(counts: DataFrame, n_docs: DataFrame, rare: int = 3, common: float = 0.2) -> DataFrame:
    """``(token, mark)`` of the terms in fewer than ``rare`` records or more than ``common`` of ``n_docs``.

    ``n_docs`` is a table of one row and one column. Terms between the lines don't appear.
    """
    total = n_docs.toDF("total")
    mark = F.when(F.col("n_records") < rare, "rare").when(F.col("n_records") > F.col("total") * F.lit(common), "common")
    return counts.crossJoin(F.broadcast(total)).select("token", mark.alias("mark")).where("mark is not null")
