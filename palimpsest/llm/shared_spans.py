"""Problem 4: spans of at least ``k`` words that stand verbatim in more than one record.

De Bruijn compaction. Every window of k words is an edge between the windows of k - 1 words it starts and ends
with. Edges that stand in at least two records are repeated; where every occurrence of an edge is followed by the
same edge, and that one is preceded by no other, the two lie on one nonbranching path. Paths are compacted to
single rows with the source coordinates (record, first word, length), and the words at those coordinates are
read again and compared, so that no fingerprint decides alone.

Shape: words are held in chunks (``chunks``). A chunk sends each distinct edge once, with what precedes and follows
it; edges come sorted to the tasks that gather them, which hold no more than ``cap`` rows of one. An edge of more chunks
than that passes through and is joined with its combined neighbours apart from the others, without gathering it.
Repeated edges go back to their chunks, and only compacted paths travel further.

Defined cases: text is ``content`` or, where that is null, what the tokens spell (null tokens are skipped); records
with neither, or with fewer than k words, have no spans; repeated rows count once and a record doesn't share with
itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.salted import salted_join_unique
from ..runtime import parts_for, written
from .chunks import CHARS, chunked
from .pairs import _bounds, capped
from .words import WordCodes, mix, windows, word_list

END, MANY = np.uint32(0), np.uint32(1)


def spelled(tokens: Column) -> Column:
    """The text that word n-grams in text order spell: the first one, then the last word of each other."""
    t = F.filter(tokens, lambda x: x.isNotNull())
    rest = F.transform(F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda x: F.substring_index(x, " ", -1))
    return F.concat_ws(" ", F.get(t, 0), F.array_join(rest, " "))


def _edges(lens: np.ndarray, idx: np.ndarray, pieces: list[str], k: int):
    """Of a chunk: fingerprint, position, document number and neighbours of each window inside a document."""
    table = WordCodes().of(pieces)
    codes = table[idx] if len(idx) else np.empty(0, np.uint64)
    h = windows(codes, k)
    start = np.r_[0, np.cumsum(lens)].astype(np.int64)
    doc = np.repeat(np.arange(len(lens)), lens)
    pos = np.arange(len(h))
    inside = doc[pos] == doc[pos + k - 1] if len(h) else np.empty(0, bool)
    pos = pos[inside]
    h, doc = h[inside], doc[pos]
    small = ((codes >> np.uint64(32)).astype(np.uint32) | np.uint32(2)) if len(codes) else np.empty(0, np.uint32)
    after, before = np.full(len(pos), END), np.full(len(pos), END)
    ok = pos + k < start[doc + 1]
    after[ok] = small[pos[ok] + k]
    ok = pos > start[doc]
    before[ok] = small[pos[ok] - 1]
    return h, pos, doc, before, after, start


def _one(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The value all of a group have, else MANY."""
    low, high = np.minimum.reduceat(values, at), np.maximum.reduceat(values, at)
    return np.where(low == high, low, MANY).astype(np.uint32)


def shared_paths(df: DataFrame, id_col: str, text: Column, k: int = 20, cap: int = 250_000) -> tuple[DataFrame, DataFrame]:
    """Compacted paths ``(path, digest, id, start, n_windows)`` that stand in at least two records, and the chunks."""
    kind = dict(df.select(id_col).dtypes)[id_col]
    source = df.select(F.col(id_col).alias("id"), text.alias("text")).where("id is not null and text is not null").distinct()
    chunks = written(chunked(source, "id", "text", word_list), "words")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, ids, lens, idx, pieces in zip(*(b.column(n) for n in ("chunk", "ids", "lens", "idx", "pieces"))):
                names = {x: i for i, x in enumerate(dict.fromkeys(ids.as_py()))}
                who = np.array([names[x] for x in ids.as_py()], dtype=np.int64)
                h, _, doc, before, after, _ = _edges(lens.values.to_numpy(), idx.values.to_numpy(), pieces.as_py(), k)
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                h, doc, before, after = h[order], who[doc[order]], before[order], after[order]
                at = _bounds(h)[:-1]
                several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[at].view(np.int64)),
                        pa.array(np.full(len(at), c.as_py(), np.int64)),
                        pa.array((_one(before, at).astype(np.uint64) << np.uint64(32) | _one(after, at).astype(np.uint64)).view(np.int64)),
                        pa.array(several),
                    ],
                    names=["h", "chunk", "beside", "several"],
                )

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, big in capped(batches, ["h"], cap):
            h, chunk, beside, several = (t[n].to_numpy() for n in ("h", "chunk", "beside", "several"))
            if big:
                yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(h), pa.array(np.full(len(h), -1, np.int8)), pa.array(beside)], names=["chunk", "h", "flag", "beside"])
                continue
            bounds, sides = _bounds(h), beside.view(np.uint64)
            at, size = bounds[:-1], np.diff(bounds)
            good = (size > 1) | np.logical_or.reduceat(several, at)
            into = _one((sides >> np.uint64(32)).astype(np.uint32), at) == MANY
            out = _one((sides & np.uint64(0xFFFFFFFF)).astype(np.uint32), at) == MANY
            keep = np.repeat(good, size)
            flag = np.repeat((into * 1 + out * 2).astype(np.int8), size)
            yield pa.RecordBatch.from_arrays([pa.array(chunk[keep]), pa.array(h[keep]), pa.array(flag[keep]), pa.nulls(int(keep.sum()), pa.int64())], names=["chunk", "h", "flag", "beside"])

    n_chunks = chunks.count()
    met = (
        chunks.mapInArrow(edges, "h long, chunk long, beside long, several boolean")
        .repartition(parts_for(df.sparkSession, n_chunks * CHARS / 5), "h")
        .sortWithinPartitions("h")
        .mapInArrow(repeated, "chunk long, h long, flag tinyint, beside long")
    )
    found = met.select("chunk", "h", "flag")
    if n_chunks > cap:  # else no window can be in so many chunks
        met = written(met, "windows")
        hot = met.where("flag < 0").select("chunk", "h", "beside")
        sides = hot.select("h", F.shiftright("beside", 32).alias("x"), F.col("beside").bitwiseAND(F.lit(0xFFFFFFFF)).alias("y"))
        many = lambda c: (F.min(c) != F.max(c)) | (F.min(c) == int(MANY))
        flags = sides.groupBy("h").agg((many("x").cast("int") + many("y").cast("int") * 2).cast("tinyint").alias("flag"))
        found = met.where("flag >= 0").select("chunk", "h", "flag").unionByName(salted_join_unique(hot, flags, "h").select("chunk", "h", "flag"))

    def compact(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("path", pa.int64()), ("digest", pa.binary()), ("id", right.schema.field("ids").type.value_type), ("start", pa.int64()), ("n_windows", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        row = right.slice(0, 1)
        lens, idx = row["lens"].chunk(0).values.to_numpy(), row["idx"].chunk(0).values.to_numpy()
        pieces, ids = row["pieces"][0].as_py(), row["ids"][0].as_py()
        h, pos, doc, _, _, start = _edges(lens, idx, pieces, k)
        known = left["h"].to_numpy().view(np.uint64)
        order = np.argsort(known)
        known, flags = known[order], left["flag"].to_numpy()[order]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        h, pos, doc, flag = h[hit], pos[hit], doc[hit], flags[at[hit]]
        if not len(h):
            return schema.empty_table()
        begins = np.r_[True, (pos[1:] != pos[:-1] + 1) | (doc[1:] != doc[:-1]) | (flag[1:] & 1 > 0) | (flag[:-1] & 2 > 0)]
        first = np.flatnonzero(begins)
        n = np.diff(np.r_[first, len(h)])
        digests = []
        for p, m in zip(pos[first], n):
            words = " ".join([pieces[i] for i in idx[p : p + m + k - 1]])
            digests.append(hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        d = doc[first]
        return pa.table([pa.array(h[first].view(np.int64)), pa.array(digests, pa.binary()), pa.array([ids[i] for i in d], schema.field("id").type), pa.array((pos[first] - start[d]).astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    placed = found.groupBy("chunk").cogroup(chunks.groupBy("chunk")).applyInArrow(compact, f"path long, digest binary, id {kind}, start long, n_windows long")
    paths = written(placed, "paths")
    # the words at the coordinates decide: a path counts if the same words stand in two records
    proven = paths.groupBy("digest").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("digest")
    return salted_join_unique(paths, proven, "digest"), chunks


def shared_runs(paths: DataFrame, k: int = 20) -> DataFrame:
    """``(id, start_word, n_words)``: maximal runs of word positions that lie in shared windows."""
    by = W.partitionBy("id").orderBy("start", "end")
    spans = paths.select("id", "start", (F.col("start") + F.col("n_windows") + (k - 1)).alias("end")).distinct()
    marked = spans.withColumn("so_far", F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)))
    numbered = marked.withColumn("run", F.sum(F.when(F.col("so_far") >= F.col("start"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("id", "run").agg(F.min("start").alias("start_word"), (F.max("end") - F.min("start")).alias("n_words")).select("id", "start_word", "n_words")


def record_text(content: str = "content", tokens: str = "tokens") -> Column:
    return F.coalesce(F.col(content), F.when(F.col(tokens).isNotNull(), spelled(F.col(tokens))))
