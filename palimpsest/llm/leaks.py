"""Problem 9: passages of held-out items inside training texts.

Broadcast hash set. The windows of ``k`` consecutive words of all items are hashed and broadcast, if there are at
most ``most`` of them (checked); documents are scanned once, their windows are looked up, and every hit is
verified word by word. Beyond that bound the windows of both sides are joined by a shuffle instead, and verified
by the digest of their words.

Defined cases: null or empty texts, and items or documents of fewer than k words, match nothing; items that repeat
each other are all reported; a pair is reported once; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.salted import salted_join_unique
from ..runtime import written
from .words import WORD, WordCodes, windows, word_list

MOST = 4_000_000


class Items:
    """Windows of the items, sorted by hash, with a bitmap that most lookups end at."""

    def __init__(self, ids: pa.Array, words: list[list[str]], k: int):
        codes = WordCodes()
        self.k, self.ids, self.words = k, ids, words
        hs, item, pos = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for n, w in enumerate(words):
            h = windows(codes.of(w), k)
            hs.append(h)
            item.append(np.full(len(h), n))
            pos.append(np.arange(len(h)))
        h, self.item, self.pos = np.concatenate(hs), np.concatenate(item), np.concatenate(pos)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.pos = h[order], self.item[order], self.pos[order]
        self.shift = np.uint64(64 - max(16, int(np.ceil(np.log2(max(len(h), 1) * 32)))))
        self.bits = np.zeros(1 << int(np.uint64(64) - self.shift), bool)
        self.bits[(self.h >> self.shift).astype(np.int64)] = True

    def hits(self, words: list[str], codes: np.ndarray) -> list[tuple[int, int]]:
        """Verified ``(item number, position of the window)``."""
        h = windows(codes, self.k)
        out = []
        for p in np.flatnonzero(self.bits[(h >> self.shift).astype(np.int64)]):
            lo, hi = np.searchsorted(self.h, h[p], "left"), np.searchsorted(self.h, h[p], "right")
            for j in range(lo, hi):
                n, q = self.item[j], self.pos[j]
                if self.words[n][q : q + self.k] == words[p : p + self.k]:
                    out.append((int(n), int(p)))
        return out


def _items(items: DataFrame, id_col: str, text_col: str, k: int, most: int) -> Items | None:
    held = items.select(F.col(id_col), F.col(text_col)).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    # a window needs two characters a word at least, so the characters bound the windows before anything is collected
    size = held.agg(F.sum(F.length(text_col))).first()[0] or 0
    if size // 2 > most:
        return None
    table = held.toArrow()
    return Items(table.column(0).combine_chunks(), [word_list(t) for t in table.column(1).to_pylist()], k)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 12, most: int = MOST) -> DataFrame:
    """``(doc_id, item_id)``: documents and the items of which they hold at least k consecutive words."""
    kind, item_kind = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    found = _items(items, item_id, item_text, k, most)
    if found is None:
        return _by_shuffle(docs, items, doc_id, text, item_id, item_text, k)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes = shared.value, WordCodes()
        for b in batches:
            at, hits = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                w = word_list(t)
                if len(w) >= held.k:
                    for n in {n for n, _ in held.hits(w, codes.of(w))}:
                        at.append(i)
                        hits.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), held.ids.take(pa.array(hits, pa.int64()))], names=["doc_id", "item_id"])

    rows = docs.select(doc_id, text).where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return rows.mapInArrow(scan, f"doc_id {kind}, item_id {item_kind}").distinct()


def _digests(df: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """``(id, at, d)``: the digest of every window of k words."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, d = [], [], []
            for n, body in enumerate(b.column(1).to_pylist()):
                w = word_list(body)
                last = len(w) - k + 1
                d += [hashlib.blake2b(" ".join(w[p : p + k]).encode("utf-8", "surrogatepass"), digest_size=16).digest() for p in range(last)]
                at += range(max(last, 0))
                row += [n] * max(last, 0)
                if len(d) > 200_000:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(d, pa.binary())], names=["id", "at", "d"])
                    row, at, d = [], [], []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(at, pa.int32()), pa.array(d, pa.binary())], names=["id", "at", "d"])

    return df.select(id_col, text).where(F.col(id_col).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, f"id {kind}, at int, d binary")


def _by_shuffle(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, k: int) -> DataFrame:
    of_items = written(_digests(items, item_id, item_text, k).select(F.col("id").alias("item_id"), "d").distinct(), "items")
    # windows that stand in a large part of the documents don't move
    hits = salted_join_unique(written(_digests(docs, doc_id, text, k).select(F.col("id").alias("doc_id"), "d").distinct(), "windows"), of_items.select("d").distinct(), "d")
    return hits.join(of_items, "d").select("doc_id", "item_id").distinct()


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 12, whole: float = 0.5, most: int = MOST) -> DataFrame:
    """``(doc_id, text, n_removed)``: texts with the leaked spans cut out, for every document.

    A document of whose words more than ``whole`` leaked gets a null text (it is to be dropped). Null texts stay null
    with 0 words removed. Rows with equal or null ids stay rows of their own.
    """
    kind = dict(docs.dtypes)[doc_id]
    found = _items(items, item_id, item_text, k, most)
    out = f"doc_id {kind}, text string, n_removed long"

    def cut(ids: pa.Array, bodies: list[str | None], places: list[list[int]]) -> pa.RecordBatch:
        """The texts without the windows that begin at ``places``."""
        texts, gone = [], []
        for t, hit in zip(bodies, places):
            if not hit:
                texts.append(t)
                gone.append(0)
                continue
            at = _offsets(t)
            bad = np.zeros(len(at), bool)
            for p in hit:
                bad[p : p + k] = True
            if bad.mean() > whole:
                texts.append(None)
            else:
                edge = np.flatnonzero(np.diff(np.r_[0, bad.astype(np.int8), 0]))
                kept, last = [], 0
                for x, y in zip(edge[::2], edge[1::2]):
                    kept.append(t[last : at[x][0]])
                    last = at[y - 1][1]
                texts.append("".join([*kept, t[last:]]))
            gone.append(int(bad.sum()))
        return pa.RecordBatch.from_arrays([ids, pa.array(texts, pa.string()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_removed"])

    if found is None:
        rows = written(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "texts")
        of_items = _digests(items, item_id, item_text, k).select("d").distinct()
        hits = salted_join_unique(written(_digests(rows, "row", "text", k), "windows"), of_items, "d").groupBy(F.col("id").alias("row")).agg(F.collect_list("at").alias("places"))

        def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield cut(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist())

        return rows.join(hits, "row", "left").select("id", "text", "places").mapInArrow(given, out)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes = shared.value, WordCodes()
        for b in batches:
            bodies = b.column(1).to_pylist()
            words = map(word_list, bodies)
            yield cut(b.column(0), bodies, [[p for _, p in held.hits(w, codes.of(w))] if len(w) >= k else [] for w in words])

    return docs.select(doc_id, text).mapInArrow(searched, out)


def _offsets(text: str) -> list[tuple[int, int]]:
    """Spans in the text itself of the words of the lower-cased text, which can be longer (U+0130)."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    at = [i for i, c in enumerate(text) for _ in c.lower()]
    return [(at[x], at[y - 1] + 1) for x, y in spans]
