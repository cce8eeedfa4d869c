"""Problem 6: duplicates of new batches among all records accepted before.

A record is rejected if it shares at least ``least`` distinct buckets with one accepted record of an earlier
batch; records of one batch are not compared with each other.

Immutable suffix arrays, one for each batch. The text of a batch is the buckets of its accepted records, one after the
other; the substrings that are looked for are whole buckets. So the suffixes that begin with a bucket are kept, ordered
to the length of a bucket: more of them is never compared. A suffix array is cut into ranges of buckets (shards), which
``bucketBy`` keeps in files of their own: a lookup goes to its shard, where the batch's buckets are searched by
bisection; the history doesn't move, and shards that no bucket of the batch falls into aren't read. What is
found is summed to the coverage of each pair of records. Arrays merge with later ones that are as
large, so their number grows with the logarithm of the history.

Buckets are compared by 128 bits of their fingerprints, records with the same buckets in the same batch share their fate
and are one node, named by 128 bits of its content.

Hot buckets: a bucket of more than ``cap`` nodes of an array is marked in it and its nodes stand apart, in order of the
scan. Pairs that meet under other buckets but not often enough are completed by the nodes' hot buckets; pairs that
have hot ones only meet under sets of ``least`` of them, of which equal ones are one row. No list of a hot
bucket is ever gathered, and nothing is left out.

Defined cases: null records, buckets and batches are left out, a record's batch is its smallest; records that are
in no arrival take no part; repeated rows count once; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import delete_path, last_note, put_note, scratch_path, written
from .pairs import binary, capped, local_heavy, matrix

NODE = 16
MARK = b"\0" * NODE
EACH = 500_000  # suffixes of a shard


def batch_of(arrivals: DataFrame, doc: str = "doc", batch: str = "batch_no") -> DataFrame:
    return arrivals.select(F.col(doc).alias("doc"), F.col(batch).alias("batch")).where("doc is not null and batch is not null").groupBy("doc").agg(F.min("batch").alias("batch"))


def nodes_of(buckets: DataFrame, batches: DataFrame, doc: str = "doc", bucket: str = "buckets") -> DataFrame:
    """``(doc, batch, node, s)``: the record's distinct buckets, sorted, and the name of its node."""
    b = F.col(bucket).cast("string")
    rows = buckets.select(F.col(doc).alias("doc"), F.struct(F.xxhash64(b).alias("hi"), F.xxhash64(F.lit(1), b).alias("lo")).alias("s"), b.isNotNull().alias("there")).where("doc is not null and there")
    sets = rows.groupBy("doc").agg(F.array_sort(F.collect_set("s")).alias("s"))
    half = lambda seed: F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(seed), "batch", "s")), 16, "0"))
    return sets.join(batches, "doc").withColumn("node", F.concat(half(1), half(2)))


def _suffixes(nodes: DataFrame) -> DataFrame:
    return nodes.select("node", F.explode("s").alias("x")).select(F.col("x.hi").alias("hi"), F.col("x.lo").alias("lo"), "node")


def _hash(n: int) -> int:
    """Spark's hash of an INT: Murmur3 for 32 bits with the seed 42."""
    m = 0xFFFFFFFF
    turn = lambda x, k: (x << k | x >> (32 - k)) & m
    h = turn(42 ^ turn(n * 0xCC9E2D51 & m, 15) * 0x1B873593 & m, 13) * 5 + 0xE6546B64 & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


class Segment:
    """An immutable suffix array: the bucketed table (its name in the session's catalog is of this session alone) ``(hot, shard, seq, marks, symbols, checks, nodes)``, a row for a block of suffixes in order.

    ``marks`` is how many hot buckets a block marks.
    """

    schema = "hot boolean, shard int, seq int, marks int, symbols binary, checks binary, nodes binary"

    def __init__(self, spark: SparkSession, path: str, shards: int, n_hot: int | None = None):
        self.spark, self.path, self.shards, self.n_hot = spark, path, shards, n_hot
        self.name = f"suffixes_{uuid.uuid4().hex}"
        # a shard is named by a number that bucketBy puts into the bucket of the shard
        found: dict[int, int] = {}
        n = 0
        while len(found) < shards:
            found.setdefault(_hash(n) % shards, n)
            n += 1
        self.labels = [found[b] for b in range(shards)]
        self.there = False

    def shard(self) -> Column:
        """Shards are ranges of ``hi`` of equal width."""
        at = F.floor((F.col("hi") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(self.shards)).cast("int")
        return F.element_at(self._named(), F.least(F.greatest(at, F.lit(0)), F.lit(self.shards - 1)) + 1)

    def _named(self) -> Column:
        return F.array(*[F.lit(x) for x in self.labels])

    def write(self, suffixes: DataFrame, cap: int, many: np.ndarray) -> None:
        """``suffixes`` are distinct ``(hi, lo, node)``. Buckets whose hi is one of ``many`` are hot beforehand."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seq, marked = 0, None
            for t, big in capped(batches, ["spread", "shard", "hi", "lo"], cap):
                spread, shard, hi, lo = (t[c].to_numpy() for c in ("spread", "shard", "hi", "lo"))
                node = matrix(t["node"], np.uint8)
                key = shard * 2 + spread
                for k in np.unique(key):
                    at = np.flatnonzero(key == k)
                    hot = big or bool(k % 2)
                    blocks = [(hot, hi[at], lo[at], node[at])]
                    if big and not k % 2:
                        # a bucket that streams by in several pieces is marked once
                        first = at[np.r_[marked != (hi[at[0]], lo[at[0]]), (hi[at][1:] != hi[at][:-1]) | (lo[at][1:] != lo[at][:-1])]]
                        marked = hi[at[-1]], lo[at[-1]]
                        if len(first):
                            blocks.append((False, hi[first], lo[first], np.zeros((len(first), NODE), np.uint8)))
                    for flag, x, y, z in blocks:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([flag]), pa.array([k // 2], pa.int32()), pa.array([seq], pa.int32()), pa.array([0 if flag or z.any() else len(x)], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary()), pa.array([z.tobytes()], pa.binary())],
                            names=["hot", "shard", "seq", "marks", "symbols", "checks", "nodes"],
                        )
                        seq += 1

        placed = suffixes.select(F.lit(0).cast("bigint").alias("spread"), self.shard().cast("bigint").alias("shard"), "hi", "lo", "node")
        if len(many):
            # the nodes of the hottest buckets go to all shards by turns, and a mark to the bucket's own
            known = F.col("hi").isin([int(x) for x in many.view(np.int64)])
            turn = F.element_at(self._named(), F.pmod(F.xxhash64("node"), F.lit(self.shards)).cast("int") + 1).cast("bigint")
            marks = placed.where(known).select("spread", "shard", "hi", "lo").distinct().withColumn("node", F.lit(MARK))
            placed = placed.where(~known).unionByName(marks).unionByName(placed.where(known).withColumns({"spread": F.lit(1).cast("bigint"), "shard": turn}))
        blocks = placed.repartition(self.shards, F.col("shard").cast("int")).sortWithinPartitions("spread", "shard", "hi", "lo", "node").mapInArrow(pack, self.schema)
        blocks.write.bucketBy(self.shards, "shard").mode("overwrite").option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
        self.there = True
        self.n_hot = self.table().agg(F.sum("marks")).first()[0] or 0

    def table(self) -> DataFrame:
        if not self.there:
            self.spark.sql(f"CREATE TABLE {self.name} ({self.schema}) USING parquet CLUSTERED BY (shard) INTO {self.shards} BUCKETS LOCATION '{self.path}'")
            self.there = True
        return self.spark.table(self.name)

    def rows(self, only_hot: bool = False) -> DataFrame:
        """``(hi, lo, node)`` of all buckets or of the hot ones."""

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for sym, chk, node in zip(b.column("symbols"), b.column("checks"), b.column("nodes")):
                    hi, lo, n = np.frombuffer(sym.as_py(), np.int64), np.frombuffer(chk.as_py(), np.int64), np.frombuffer(node.as_py(), np.uint8).reshape(-1, NODE)
                    real = n.any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(hi[real]), pa.array(lo[real]), binary(n[real])], names=["hi", "lo", "node"])

        held = self.table()
        return (held.where("hot") if only_hot else held).select("symbols", "checks", "nodes").mapInArrow(unpack, "hi long, lo long, node binary")

    def search(self, suffixes: DataFrame, few: bool) -> DataFrame:
        """``(new, old, hi, lo)``: for every bucket of the batch the old nodes that have it; ``old`` is null for a hot bucket."""
        asked = suffixes.withColumn("shard", self.shard())
        held = self.table().where("not hot")
        if few:
            touched = [r[0] for r in asked.select("shard").distinct().collect()]
            held = held.where(F.col("shard").isin(touched)) if len(touched) < self.shards else held
        schema = pa.schema([("new", pa.binary()), ("old", pa.binary()), ("hi", pa.int64()), ("lo", pa.int64())])

        def find(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            blocks = right.sort_by("seq")
            sym, chk = (np.frombuffer(b"".join(blocks[c].to_pylist()), np.int64) for c in ("symbols", "checks"))
            node = np.frombuffer(b"".join(blocks["nodes"].to_pylist()), np.uint8).reshape(-1, NODE)
            if (sym[1:] < sym[:-1]).any():  # the mark of a hot bucket may stand behind its neighbours of a block
                order = np.argsort(sym, kind="stable")
                sym, chk, node = sym[order], chk[order], node[order]
            hi, lo = left["hi"].to_numpy(), left["lo"].to_numpy()
            begin, end = np.searchsorted(sym, hi, "left"), np.searchsorted(sym, hi, "right")
            n = end - begin
            who = np.repeat(np.arange(len(hi)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            same = chk[at] == lo[who]
            who, at = who[same], at[same]
            hot = ~node[at].any(axis=1)
            old = pc.if_else(pa.array(hot), pa.scalar(None, pa.binary()), binary(node[at])) if len(at) else pa.array([], pa.binary())
            return pa.table([left["node"].take(pa.array(who)), old, pa.array(hi[who]), pa.array(lo[who])], schema=schema)

        return asked.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(find, "new binary, old binary, hi long, lo long")

    def drop(self, files: bool = False) -> None:
        if self.there:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.there = False
        if files:
            delete_path(self.spark, self.path)


def _sets(column: str, least: int) -> Column:
    """All sets of ``least`` members of an array, in order, as arrays of arrays."""
    grown = F.transform(column, lambda x, i: F.struct(i.alias("i"), F.array(x).alias("m")))
    for _ in range(least - 1):
        grown = F.flatten(
            F.transform(grown, lambda t: F.transform(F.filter(F.transform(column, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda y: y["i"] > t["i"]), lambda y: F.struct(y["i"].alias("i"), F.concat(t["m"], F.array(y["x"])).alias("m"))))
        )
    return F.transform(grown, lambda t: t["m"])


def _stacked(segments: list[tuple[int, Segment]]) -> DataFrame:
    """``(g, hi, lo, node)``: the hot buckets of some segments."""
    rows = [s.rows(only_hot=True).withColumn("g", F.lit(g)) for g, s in segments]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


class BatchIndex:
    """Accepted history as immutable segments, so that a new batch is checked without reprocessing it.

    ``decide`` searches one batch's buckets in the segments and appends the accepted part as a segment, after it has
    taken in the segments that are no larger than it. So the segments' sizes fall, their number grows with the logarithm
    of the history, and a row is written again only when its segment at least doubles.

    An index that is opened on the path of another goes on from its history: after each batch a manifest of the segments
    is written, whole, under the batch's number, and the last one is read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, least: int = 3, cap: int = 256, each: int = EACH):
        self.spark, self.path, self.least, self.cap, self.each = spark, path or scratch_path(spark, "batches"), least, cap, each
        self.levels: list[tuple[int, Segment]] = []
        self.number = 0
        note = last_note(spark, f"{self.path}/manifest")
        if note:
            self.number = note["number"]
            self.levels = [(n, Segment(spark, f"{self.path}/{name}", shards, n_hot)) for n, name, shards, n_hot in note["segments"]]

    def segments(self) -> int:
        return len(self.levels)

    def decide(self, nodes: DataFrame, append: bool = True, n: int | None = None) -> DataFrame:
        """``(node)``: the rejected of a batch's distinct nodes ``(node, s)`` with ``n`` buckets; the others are appended."""
        self.number += 1
        n = nodes.agg(F.sum(F.size("s"))).first()[0] or 0 if n is None else n
        path = f"{self.path}/rejected/{self.number}"
        gone = self._matched(nodes, n) if self.levels and n else nodes.select("node").limit(0)
        gone.write.mode("overwrite").parquet(path)
        gone = self.spark.read.schema("node binary").parquet(path)
        if append:
            self._append(_suffixes(nodes.join(gone, "node", "left_anti")), n)
        return gone

    def _matched(self, nodes: DataFrame, n: int) -> DataFrame:
        suffixes = _suffixes(nodes)
        found = None
        for number, (_, segment) in enumerate(self.levels):
            one = segment.search(suffixes, n < 4 * segment.shards).withColumn("g", F.lit(number))
            found = one if found is None else found.unionByName(one)
        found = written(found, "found")
        pairs = found.where("old is not null").groupBy("g", "new", "old").agg(F.count(F.lit(1)).cast("int").alias("n"))
        gone = pairs.where(F.col("n") >= self.least).select("new")
        hot = [(g, s) for g, (_, s) in enumerate(self.levels) if s.n_hot]
        if hot:
            symbol = F.struct("hi", "lo")
            mine = found.where("old is null").groupBy("g", "new").agg(F.collect_set(symbol).alias("h"))
            open_ = pairs.where(F.col("n") < self.least).join(mine, ["g", "new"]).where(F.col("n") + F.size("h") >= self.least)
            here = open_.select("g", "new", "old", "n", F.explode("h").alias("x")).select("g", "new", "old", "n", "x.hi", "x.lo")
            met = here.join(_stacked(hot).withColumnRenamed("node", "old"), ["g", "old", "hi", "lo"]).groupBy("g", "new", "old").agg((F.first("n") + F.count(F.lit(1))).alias("n"))
            gone = gone.unionByName(met.where(F.col("n") >= self.least).select("new"))
            many = [(g, s) for g, s in hot if s.n_hot >= self.least]
            if many:
                sets = lambda df, *keep: df.where(F.size("h") >= self.least).select(*keep, F.explode(_sets("h", self.least)).alias("k"))
                theirs = _stacked(many).groupBy("g", "node").agg(F.array_sort(F.collect_set(symbol)).alias("h")).select("g", "h").distinct()
                asked = sets(mine.select("g", "new", F.array_sort("h").alias("h")), "g", "new")
                gone = gone.unionByName(asked.join(sets(theirs, "g").distinct(), ["g", "k"], "left_semi").select("new"))
        return gone.distinct().withColumnRenamed("new", "node")

    def add(self, batch: DataFrame, doc: str = "doc", bucket: str = "buckets") -> DataFrame:
        """``(doc, rejected)`` of the records of the batch."""
        docs = batch.select(F.col(doc).alias("doc")).where("doc is not null").distinct().withColumn("batch", F.lit(self.number + 1).cast("long"))
        mine = written(nodes_of(batch, docs, doc, bucket), "batch")
        gone = self.decide(mine.groupBy("node").agg(F.any_value("s").alias("s")))
        return mine.join(gone.withColumn("rejected", F.lit(True)), "node", "left").select("doc", F.coalesce("rejected", F.lit(False)).alias("rejected"))

    def _append(self, rows: DataFrame, n: int) -> None:
        merged = []
        while self.levels and self.levels[-1][0] <= n:
            held, old = self.levels.pop()
            merged.append(old)
            rows = rows.unionByName(old.rows())
            n += held
        # shards of a few megabytes; of very long arrays larger ones, so that their names stay a short list
        each = min(max(self.each, n // 2000), 16 * self.each)
        segment = Segment(self.spark, f"{self.path}/{self.number}", max(1, -(-n // each)))
        # only of a long array can one bucket fill a task; then the hottest ones (a bounded list) are known before the shuffle
        many = local_heavy(rows, ["hi"], lambda b: b.column("hi").to_numpy(zero_copy_only=False).view(np.uint64)[:, None], 0.005) if n > 16 * self.each else np.empty(0, np.uint64)
        segment.write(rows, self.cap, many)
        self.levels.append((n, segment))
        self._note()
        # no manifest names them any more
        for old in merged:
            old.drop(files=True)

    def _note(self) -> None:
        put_note(self.spark, f"{self.path}/manifest", self.number, {"number": self.number, "segments": [(n, s.path.rpartition("/")[2], s.shards, s.n_hot) for n, s in self.levels]})

    def close(self, files: bool = False) -> None:
        """Take the segments out of the session's catalog; the stored history stays unless ``files``."""
        for _, segment in self.levels:
            segment.drop(files)


def rejected_records(buckets: DataFrame, arrivals: DataFrame, least: int = 3, cap: int = 256) -> DataFrame:
    """``(doc)``: the records rejected when all batches go through a ``BatchIndex`` in ascending order."""
    spark = buckets.sparkSession
    path, by_node = scratch_path(spark, "nodes"), scratch_path(spark, "sets")
    nodes = nodes_of(buckets, batch_of(arrivals))
    nodes.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    found = spark.read.schema(nodes.schema).parquet(path)
    sets = found.groupBy("batch", "node").agg(F.any_value("s").alias("s"))
    sets.write.partitionBy("batch").option("compression", "zstd").parquet(by_node)
    sets = spark.read.schema(sets.schema).parquet(by_node)
    # one value for each batch, not for each record
    batches = sorted(map(tuple, sets.groupBy("batch").agg(F.sum(F.size("s"))).collect()))
    index, gone = BatchIndex(spark, least=least, cap=cap), None
    for batch, n in batches:
        now = index.decide(sets.where(F.col("batch") == batch).select("node", "s"), batch != batches[-1][0], n)
        gone = now if gone is None else gone.unionByName(now)
    index.close(files=True)
    if gone is None:
        return found.select("doc").limit(0)
    return found.join(gone, "node", "left_semi").select("doc")
