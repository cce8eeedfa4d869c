"""Candidate pairs from many keys per record, without trusting any key to be rare.

The steps are shared by the two similarity joins. Records are first reduced to classes of exact copies, so
that copies never multiply the keys. Every class gives a fixed number of 64-bit keys; classes that meet under
a key are candidates. Three guards keep hot keys from making hot tasks:

1. Keys that hold a large share of all classes (``local_heavy``) are known before the shuffle; there is a
   fixed number of them at most. Classes that have such a key send refined keys (the key and more of the record) in
   its place.
2. After the shuffle the keys come sorted, and a task holds no more than ``cap`` rows of one. A group larger than
   that sends its members back as ``(key, rid)`` rows while it streams by; they are refined in the same way.
3. Refined rows carry a sketch, and a pair of theirs leaves the task only when the sketches allow it. Groups of
   refined rows are cut into blocks of ``BLOCK``, and a task gets the rows of two blocks.

Nothing is dropped: a refinement is chosen so that every pair sought still meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parts_for, written

HEAVY_LEAST = 64
BLOCK = 1024
NONE = np.uint64(0)  # a key that a record doesn't have


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """A binary column without nulls whose values have one length, as a 2-d array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0), dtype=dtype)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(np.frombuffer(data, np.uint8)[at[0] : at[-1]].tobytes(), dtype=dtype).reshape(n, -1)


def binary(rows: np.ndarray) -> pa.Array:
    """Inverse of ``matrix``."""
    rows = np.ascontiguousarray(rows)
    width, n = rows.shape[1] * rows.itemsize, rows.shape[0]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def local_heavy(reps: DataFrame, columns: list[str], keyer: Callable[[pa.RecordBatch], np.ndarray], share: float) -> np.ndarray:
    """Keys held by about ``share`` of all rows or more (and at least HEAVY_LEAST rows), sorted.

    A batch names the keys of half the share of its own rows, and counts are added over all batches; a key that has
    the share of all rows has it by the batches that name it. Only keys with half the share of all rows by these
    counts are kept, so there are at most keys-per-row * 2 / share of them, however the rows are ordered.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = keyer(b)
            u, c = np.unique(keys.ravel(), return_counts=True)
            hot = (c >= max(2, share / 2 * len(keys))) & (u != NONE)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[u[hot].view(np.int64), 0]), pa.array(np.r_[c[hot], 0]), pa.array(np.r_[np.zeros(hot.sum(), np.int64), len(keys)])], names=["key", "c", "n"])

    named = reps.select(*columns).mapInArrow(count, "key long, c long, n long").groupBy("key").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))
    named = written(named, "frequent")
    total = named.agg(F.sum("n")).first()[0] or 0
    found = named.where((F.col("c") >= max(HEAVY_LEAST, share / 2 * total)) & (F.col("key") != 0)).select("key").toPandas()["key"].to_numpy(dtype=np.int64)
    return np.sort(found.view(np.uint64))


def _isin(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(keys.shape, dtype=bool)
    at = np.searchsorted(hot, keys)
    at[at == len(hot)] = 0
    return hot[at] == keys


def _refined(b: pa.RecordBatch, refine, r: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Refined rows of the memberships, which come ordered by r; those of a class stay together."""
    rid = b.column("rid").to_numpy(zero_copy_only=False)
    cuts = np.unique(np.r_[0, np.searchsorted(r, r[2000::2000], "left"), len(r)]) if len(r) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows, keys = refine(b, r[lo:hi], c[lo:hi])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(rid[rows]), b.column("sketch").take(pa.array(rows))], names=["key", "rid", "sketch"]
        )


def _bounds(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])


def capped(batches: Iterator[pa.RecordBatch], keys: list[str], cap: int) -> Iterator[tuple[pa.Table, bool]]:
    """Whole groups of rows that come sorted by ``keys`` (BIGINT), with False, and the rows of groups over ``cap``, with True.

    No more than a batch and ``cap`` rows are held, however large a group is.
    """
    held, over = None, None

    def cut(t: pa.Table) -> Iterator[tuple[pa.Table, bool]]:
        at = _edges_of(t, keys)
        big = np.repeat(np.diff(at) > cap, np.diff(at))
        for mask, flag in ((~big, False), (big, True)):
            if mask.any():
                yield (t if mask.all() else t.filter(pa.array(mask))), flag

    for b in batches:
        t = pa.Table.from_batches([b])
        if over is not None and t.num_rows:
            same = np.logical_and.reduce([t[k].to_numpy() == v for k, v in zip(keys, over)])
            n = t.num_rows if same.all() else int(np.argmin(same))
            if n:
                yield t.slice(0, n), True
                t = t.slice(n)
        if not t.num_rows:
            continue
        over = None
        t = t if held is None else pa.concat_tables([held, t])
        last = int(_edges_of(t, keys)[-2])
        held = t.slice(last)
        if last:
            yield from cut(t.slice(0, last))
        if held.num_rows > cap:
            over = [held[k][0].as_py() for k in keys]
            yield held, True
            held = None
    if held is not None:
        yield from cut(held)


def _edges_of(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows - 1, bool)
    for k in keys:
        v = t[k].to_numpy()
        new |= v[1:] != v[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, t.num_rows]


def _pair_batch(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64) if key is None else key)], names=["a", "b", "key"])


def meet(keys: DataFrame, cap: int, parts: int, near: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Pairs ``(a, b)`` of rids that share a key; members of groups over ``cap`` come as ``(rid, -1, key)``.

    Where the rows carry a sketch, only pairs whose sketches pass ``near`` come.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, big in capped(batches, ["key"], cap):
            key, rid = t["key"].to_numpy(), t["rid"].to_numpy()
            if big:
                yield _pair_batch(rid, np.full(len(rid), -1, np.int64), key)
                continue
            sketch = matrix(t["sketch"], np.uint8) if near is not None else None
            at = _bounds(key)
            size = np.diff(at)
            for s in np.unique(size):
                if s < 2:
                    continue
                starts = at[:-1][size == s]
                i, j = np.triu_indices(s, 1)
                step = max(1, 2_000_000 // len(i))
                for lo in range(0, len(starts), step):
                    g = starts[lo : lo + step, None] + np.arange(s)[None]
                    x, y = g[:, i].ravel(), g[:, j].ravel()
                    if near is not None:
                        keep = near(sketch[x], sketch[y])
                        x, y = x[keep], y[keep]
                    a, b = rid[x], rid[y]
                    u = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
                    u = np.unique(u, axis=0) if s > 8 else u
                    u = u[u[:, 0] != u[:, 1]]
                    yield _pair_batch(u[:, 0], u[:, 1])

    return keys.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long")


def meet_sketched(keys: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray], write: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Pairs of refined rows that share a key and whose sketches pass ``near``.

    A group of more than BLOCK rows is cut into blocks by a hash of the record, and every two blocks meet in a tile of
    their own. Tiles are spread by their names, so a large group is the work of many tasks.
    """
    keys = write(keys, "refined")
    blocks = keys.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")).where("blocks > 1")
    sized = keys.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = sized.withColumn("i", F.pmod(F.xxhash64("rid", F.lit(5)), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = mine.select("key", "rid", "sketch", F.col("i").cast("bigint").alias("i"), (F.least("i", "j") * F.lit(1 << 31) + F.greatest("i", "j")).cast("bigint").alias("tile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a tile has about two blocks; what is larger by chance still comes as a whole
        for t, _ in capped(batches, ["key", "tile"], 1 << 40):
            key, tile, side, rid = (t[c].to_numpy() for c in ("key", "tile", "i", "rid"))
            sketch = matrix(t["sketch"], np.uint8)
            at = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1, len(key)]
            for lo, hi in zip(at[:-1], at[1:]):
                if hi - lo < 2:
                    continue
                inner = tile[lo] >> 31 == tile[lo] & 0x7FFFFFFF
                x = np.arange(lo, hi) if inner else lo + np.flatnonzero(side[lo:hi] == side[lo:hi].min())
                y = x if inner else lo + np.flatnonzero(side[lo:hi] != side[lo:hi].min())
                for p in range(0, len(x), 512):
                    for q in range(p if inner else 0, len(y), 512):
                        i, j = np.meshgrid(x[p : p + 512], y[q : q + 512], indexing="ij")
                        i, j = i.ravel(), j.ravel()
                        keep = rid[i] < rid[j] if inner and p == q else rid[i] != rid[j]
                        i, j = i[keep], j[keep]
                        keep = near(sketch[i], sketch[j])
                        i, j = i[keep], j[keep]
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rid[i], rid[j])), pa.array(np.maximum(rid[i], rid[j]))], names=["a", "b"])

    return tiled.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(run, "a long, b long")


def sketch_filter(pairs: DataFrame, reps: DataFrame, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Candidate pairs whose sketches pass ``near``."""
    s = reps.select("rid", "sketch")
    both = pairs.join(s.select(F.col("rid").alias("a"), F.col("sketch").alias("sa")), "a").join(
        s.select(F.col("rid").alias("b"), F.col("sketch").alias("sb")), "b"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = near(matrix(b.column("sa"), np.uint8), matrix(b.column("sb"), np.uint8))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def candidates(reps: DataFrame, columns: list[str], keyer, refine, near, per_row: int, share: float, cap: int, write: Callable[[DataFrame, str], DataFrame], carry: bool = False) -> DataFrame:
    """All pairs of classes that meet under a key and pass the sketch, each once. A class has about ``per_row`` keys.

    With ``carry`` the rows of keys carry the sketch (a small one), so that a pair is filtered where it meets; else pairs
    are joined with the sketches. ``refine`` gets a batch with the hot memberships of its classes, as rows and columns of ``keyer``'s result.
    """
    parts = parts_for(reps.sparkSession, reps.count() * per_row)
    hot = local_heavy(reps, columns, keyer, share)
    shared = reps.sparkSession.sparkContext.broadcast(hot)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            keys = keyer(b)
            keep = ~_isin(keys, shared.value) & (keys != NONE)
            rows = np.broadcast_to(rid[:, None], keys.shape)[keep]
            one = pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(rows)], names=["key", "rid"])
            yield one.append_column("sketch", b.column("sketch").take(pa.array(np.nonzero(keep)[0]))) if carry else one

    def fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = keyer(b)
            is_hot = _isin(keys, shared.value)
            for i, big in enumerate(b.column("__big").to_pylist()):
                if big:
                    is_hot[i] |= np.isin(keys[i].view(np.int64), big)
            r, c = np.nonzero(is_hot)
            yield from _refined(b, refine, r, c)

    rows = reps.select(*columns).mapInArrow(plain, "key long, rid long, sketch binary" if carry else "key long, rid long")
    met = write(meet(rows, cap, parts, near if carry else None), "met")
    pairs = met.where(F.col("b") >= 0).select("a", "b").distinct()
    pairs = pairs if carry else sketch_filter(pairs, reps, near)
    # at most per_row keys a class
    big = met.where(F.col("b") < 0).groupBy(F.col("a").alias("rid")).agg(F.collect_set("key").alias("__big"))
    with_hot = reps.select(*columns).join(big, "rid", "left" if len(hot) else "inner").select(*columns, "__big")
    refined = with_hot.mapInArrow(fine, "key long, rid long, sketch binary")
    return write(pairs.unionByName(meet_sketched(refined, near, write)), "near").distinct()


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of documents ``(doc_a, doc_b)`` from pairs of classes, those inside a class included.

    ``members`` has ``(rid, id)``. Each pair comes once, the smaller id first.
    """
    copies = members.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("rid").alias("a"), F.col("rid").alias("b"))
    every = pairs.select("a", "b").unionByName(copies)
    out = (
        every.join(members.select(F.col("rid").alias("a"), F.col("id").alias("x")), "a")
        .join(members.select(F.col("rid").alias("b"), F.col("id").alias("y")), "b")
        .where("x != y")
        .select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    )
    return out.distinct()
