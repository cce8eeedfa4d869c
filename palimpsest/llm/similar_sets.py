"""Problem 2: all pairs of records whose sets of hashes have a Jaccard similarity of at least 0.4.

Multi-index binary sketches. Every distinct set gets minhashes; their low bits are packed into a one-bit code,
and pairs of minhashes into the segments of a multi-index that is joined by equality. A pair that meets in a
segment is a candidate if its codes (512 bits with those of the segments) lie within a Hamming radius calibrated for
recall (``code_radius``) and its sizes allow the similarity, and is
kept if the original sets, compared exactly, are similar enough. Scores are exact; recall is that of
the segments and the radius.

Segments of one-bit values alone cannot reach the recall at this threshold: at similarity 0.4 two bits agree with
probability 0.7, against 0.5 by chance, so segments selective enough for 100,000 sets (16 bits) match with
probability 0.0033 and 1,400 of them would be needed. Therefore a segment here holds two minhashes in full.
They are taken over all tokens of the set, frequent ones too: over a part of the tokens a pair can be far less similar
than it is. A pair of which one common segment is ordinary meets under it; if all its common segments are hot, it meets under
any two of them. So a pair of similarity s is missed by the segments with a probability of q^60, q = 1 - s^2 (3e-5 at
0.4), and, only if all that it has in common is hot, of q^60 + 60 s^2 q^59 (3.6e-4 at 0.4, 5e-6 at 0.5). The radius misses
1e-5.

Defined cases: null or empty sets and null elements take no part; repeated elements count once; a repeated row
counts once; equal sets are one class with score 1; an empty table gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from . import pairs as P
from .words import mix

BITS = 392  # with the 120 bits of the segments' minhashes a code of 64 bytes


def code_radius(least: float, bits: int, miss: float = 0.00001) -> int:
    """Largest Hamming distance of the codes of two sets of similarity ``least``, but for a share ``miss`` of them.

    A bit differs with probability (1 - least) / 2, so the distance is binomial; the tail is summed exactly.
    """
    p = (1 - least) / 2
    if p <= 0:
        return 0
    total = 0.0
    for d in range(bits + 1):
        total += math.exp(math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) + d * math.log(p) + (bits - d) * math.log(1 - p))
        if total >= 1 - miss:
            return d
    return bits


def _multipliers(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _minima(x: np.ndarray, at: np.ndarray, mul: np.ndarray) -> np.ndarray:
    """Minhashes of consecutive slices of the mixed values x that begin at ``at``; slices are not empty."""
    out = np.empty((len(at), len(mul)), np.uint64)
    with np.errstate(over="ignore"):
        for j, m in enumerate(mul):
            h = x * m
            h ^= h >> np.uint64(29)
            out[:, j] = np.minimum.reduceat(h, at)
    return out


def similar_set_classes(df: DataFrame, id_col: str = "doc_id", col: str = "hashes", least: float = 0.4, segments: int = 60, cap: int = 256, share: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, score)`` of classes of equal sets, and the classes' members ``(rid, id)``."""
    sets = df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.filter(col, lambda x: x.isNotNull()))).alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    kind = dict(sets.dtypes)["id"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy()
            off = off - off[0] if len(off) else off
            d = [hashlib.blake2b(flat[x:y], digest_size=16).digest() for x, y in zip(off[:-1], off[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d, type=pa.binary()), lists], names=["id", "dig", "v"])

    base = sets.mapInArrow(digest, f"id {kind}, dig binary, v array<bigint>")
    reps = written(base.groupBy("dig").agg(F.any_value("v").alias("v")).withColumn("rid", F.monotonically_increasing_id()), "sets")
    members = base.select("dig", "id").distinct().join(reps.select("dig", "rid"), "dig").select("rid", "id")
    anchors, code = _multipliers(2 * segments, 11), _multipliers(BITS, 29)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("v")
            raw, off = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
            off = off - off[0]
            x = mix(raw.view(np.uint64))
            folded = (mix(_minima(x, off[:-1], anchors)) >> np.uint64(32)).astype(np.uint32)
            ones = np.concatenate([_minima(x, off[:-1], code) & np.uint64(1), folded & np.uint32(1)], axis=1)
            size = np.diff(off).astype(np.uint32)
            sketch = np.concatenate([np.packbits(ones.astype(np.uint8), axis=1), size[:, None].view(np.uint8)], axis=1)
            yield pa.RecordBatch.from_arrays([b.column("rid"), P.binary(folded), P.binary(sketch)], names=["rid", "anchor", "sketch"])

    index = written(reps.select("rid", "v").mapInArrow(sketches, "rid long, anchor binary, sketch binary"), "sketches")
    names = mix(np.arange(1, segments + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def keyer(b: pa.RecordBatch) -> np.ndarray:
        m = P.matrix(b.column("anchor"), np.uint32) if b.num_rows else np.empty((0, 2 * segments), np.uint32)
        return mix((m[:, ::2].astype(np.uint64) << np.uint64(32) | m[:, 1::2]) + names[None])

    def refine(b: pa.RecordBatch, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every two hot segments of a set."""
        keys = keyer(b)
        rows, out = [np.empty(0, int)], [np.empty(0, np.uint64)]
        begin = np.searchsorted(r, r, "right")
        for step in range(1, segments):
            at = np.flatnonzero(np.arange(len(r)) + step < begin)
            if not len(at):
                break
            rows.append(r[at])
            out.append(mix(keys[r[at], c[at]] * np.uint64(3) + keys[r[at + step], c[at + step]]))
        return np.concatenate(rows), np.concatenate(out)

    radius, width = code_radius(least, BITS + 2 * segments), -(-(BITS + 2 * segments) // 8)

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes within the radius, of sets whose sizes allow the similarity."""
        x, y = (np.ascontiguousarray(v[:, width:]).view(np.uint32)[:, 0] for v in (a, b))
        keep = np.minimum(x, y) >= least * np.maximum(x, y) - 1e-9
        words = np.bitwise_count(np.ascontiguousarray(a[keep, :width]) ^ np.ascontiguousarray(b[keep, :width])).sum(axis=1, dtype=np.uint32)
        keep[keep] = words <= radius
        return keep

    found = P.candidates(index, ["rid", "anchor", "sketch"], keyer, refine, near, segments, share, cap, written, carry=True)
    v = reps.select("rid", "v")
    both = found.join(v.select(F.col("rid").alias("a"), F.col("v").alias("x")), "a").join(v.select(F.col("rid").alias("b"), F.col("v").alias("y")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("t"))
    return common.select("a", "b", (F.col("k") / (F.col("t") - F.col("k"))).alias("score")).where(F.col("score") >= F.lit(least)), members


def similar_set_pairs(df: DataFrame, **options) -> DataFrame:
    """Every pair ``(doc_a, doc_b)`` of documents with similar sets; the smaller id first."""
    classes, members = similar_set_classes(df, **options)
    return P.expand(classes, written(members, "members"))
