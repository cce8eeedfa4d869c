"""Problem 1: records that share most of their content, found from their minhash signatures.

Pigeonring filtering. A signature is a ring of segments; segment i has the budget t_i, and the budgets add
up to ``radius - segments + 1``. Two signatures within ``radius`` differing positions have a segment that keeps its
budget (pigeonhole), and even one from which every chain of following segments keeps the cumulative budget
``t_i + ... + t_j + (j - i)`` (pigeonring). Candidates meet under the positions that a segment within budget
must leave equal; the chains prune them before the full comparison, which is exact. No pair is lost.

Defined cases: a null signature, one with a null element or with another number of values takes no part; a
repeated row counts once; a document with several different signatures takes part with each; an empty table
gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from . import pairs as P
from .words import mix


class Ring:
    """Segments of a signature of ``n`` positions and their budgets for ``radius`` differing positions.

    The fewest segments whose budgets stay at ``most`` are taken, of nearly equal width.
    """

    def __init__(self, n: int, radius: int, most: int = 1):
        # sum(t_i + 1) must be radius + 1
        count = -(-(radius + 1) // (most + 1))
        count = max(1, min(count, n))
        budgets = [(radius + 1) // count + (i < (radius + 1) % count) - 1 for i in range(count)]
        # wider segments for larger budgets: as many positions must stay equal everywhere
        left = n - sum(budgets)
        widths = [b + left // count + (i < left % count) for i, b in enumerate(budgets)]
        if min(widths[i] - budgets[i] for i in range(count)) < 1:
            raise ValueError("radius is too large for the signature")
        self.n, self.radius, self.budgets, self.widths = n, radius, budgets, widths
        self.starts = np.r_[0, np.cumsum(widths)[:-1]].astype(int)
        self.keys: list[tuple[int, tuple[int, ...]]] = []
        for i, (s, w, b) in enumerate(zip(self.starts, widths, budgets)):
            self.keys += [(i, c) for c in combinations(range(s, s + w), w - b)]
        self.count = count

    def follow(self, i: int) -> list[tuple[int, ...]]:
        """Subsets of the segment after i, one of which a chain of two within budget leaves equal."""
        j = (i + 1) % self.count
        if j == i:
            return [()]
        allowed = min(self.widths[j], self.budgets[i] + self.budgets[j] + 1)
        s, w = self.starts[j], self.widths[j]
        return list(combinations(range(s, s + w), w - allowed))

    def chains(self, differ: np.ndarray, longest: int = 6) -> np.ndarray:
        """Rows of ``differ`` (pairs x positions) that have a start whose chains all keep their budgets."""
        d = np.add.reduceat(differ.astype(np.int16), self.starts, axis=1)
        ok = np.ones(d.shape, dtype=bool)
        total, budget = np.zeros(d.shape, np.int16), np.zeros(self.count, np.int16)
        for step in range(min(longest, self.count)):
            total = total + np.roll(d, -step, axis=1)
            budget = budget + np.roll(np.asarray(self.budgets, np.int16), -step) + (step > 0)
            ok &= total <= budget
        return ok.any(axis=1)


def _signatures(df: DataFrame, id_col: str, col: str, n: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n)
            digest = pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in m], type=pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), digest, P.binary(m), P.binary((mix(m.view(np.uint64)) >> np.uint64(56)).astype(np.uint8))], names=["id", "dig", "sig", "sketch"])

    whole = df.select(F.col(id_col).alias("id"), F.col(col).alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == n) & ~F.coalesce(F.exists("v", lambda x: x.isNull()), F.lit(False))
    )
    kind = dict(whole.dtypes)["id"]
    return whole.mapInArrow(pack, f"id {kind}, dig binary, sig binary, sketch binary")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", col: str = "minhashes", n: int = 100, least: int = 60, cap: int = 256, share: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b, agree)`` of classes of equal signatures that agree in at least ``least`` of ``n`` positions,
    and the classes' members ``(rid, id)``."""
    ring = Ring(n, n - least)
    base = _signatures(df, id_col, col, n)
    reps = written(base.groupBy("dig").agg(F.any_value("sig").alias("sig"), F.any_value("sketch").alias("sketch")).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    members = base.select("dig", "id").distinct().join(reps.select("dig", "rid"), "dig").select("rid", "id")
    spec = [np.array(c) for _, c in ring.keys]
    salt = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    names = mix(np.arange(1, len(spec) + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    follow = {i: ring.follow(i) for i in range(ring.count)}

    def positions(b: pa.RecordBatch) -> np.ndarray:
        return mix(P.matrix(b.column("sig"), np.uint64) ^ salt[None]) if b.num_rows else np.empty((0, n), np.uint64)

    def keyer(b: pa.RecordBatch) -> np.ndarray:
        m = positions(b)
        out = np.empty((len(m), len(spec)), np.uint64)
        for j, c in enumerate(spec):
            out[:, j] = m[:, c].sum(axis=1, dtype=np.uint64) + names[j]
        return mix(out)

    def refine(b: pa.RecordBatch, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m, rows, keys = positions(b), [], []
        for j in np.unique(c):
            of = r[c == j]
            base_key = m[of][:, spec[j]].sum(axis=1, dtype=np.uint64) + names[j]
            for k, sub in enumerate(follow[ring.keys[j][0]]):
                rows.append(of)
                keys.append(mix(base_key + np.uint64(k + 1) + m[of][:, list(sub)].sum(axis=1, dtype=np.uint64) * np.uint64(3)))
        return (np.concatenate(rows), np.concatenate(keys)) if rows else (np.empty(0, int), np.empty(0, np.uint64))

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = a != b
        keep = ring.chains(differ)
        keep[keep] = differ[keep].sum(axis=1) <= ring.radius
        return keep

    found = P.candidates(reps, ["rid", "sig", "sketch"], keyer, refine, near, len(spec), share, cap, written)
    sig = reps.select("rid", "sig")
    both = found.join(sig.select(F.col("rid").alias("a"), F.col("sig").alias("x")), "a").join(sig.select(F.col("rid").alias("b"), F.col("sig").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                agree = (P.matrix(b.column("x"), np.int64) == P.matrix(b.column("y"), np.int64)).sum(axis=1)
                keep = pa.array(agree >= least)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(agree.astype(np.int32)).filter(keep)], names=["a", "b", "agree"])

    return both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, agree int"), members


def near_duplicate_pairs(df: DataFrame, **options) -> DataFrame:
    """Every pair ``(doc_a, doc_b)`` of documents that are near duplicates; the smaller id first."""
    classes, members = near_duplicate_classes(df, **options)
    return P.expand(classes, written(members, "members"))
