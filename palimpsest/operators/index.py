"""Inverted index of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import parallelism, written
from .salted import meeting_pairs, salted_join_unique


def _rows(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """Distinct ``(doc, token)``, written once: tokens are made once, however often the rows are read."""
    rows = df.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(tokens)).alias("token")).where("token is not null and doc is not null").distinct()
    return written(rows, "postings")


def _counts(rows: DataFrame, least: int, most: int | None) -> DataFrame:
    n = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least)
    return n if most is None else n.where(F.col("n_docs") <= most)


def token_counts(df: DataFrame, id_col: str = "doc_id", tokens: str = "tokens", least: int = 2, most: int | None = None) -> DataFrame:
    """``(token, n_docs)`` of the tokens in ``least`` to ``most`` documents; counts are combined before the shuffle."""
    return _counts(_rows(df, id_col, tokens), least, most)


def token_index(df: DataFrame, id_col: str = "doc_id", tokens: str = "tokens", least: int = 2, most: int | None = None) -> DataFrame:
    """``(token, docs, n_docs)``: documents of each token, sorted.

    Tokens outside the bounds are counted out before their lists are built. A list is as long as the token is
    frequent: set ``most``, or use ``token_postings``, where a token may be in a large part of a large corpus.
    """
    kept = token_postings(df, id_col, tokens, least, most)
    return kept.groupBy("token").agg(F.array_sort(F.collect_list("doc")).alias("docs"), F.count(F.lit(1)).alias("n_docs"))


def token_postings(df: DataFrame, id_col: str = "doc_id", tokens: str = "tokens", least: int = 2, most: int | None = None, share: float = 0.005) -> DataFrame:
    """The same index as rows ``(token, doc)``, without lists. The rows of tokens with over ``share`` of all don't move."""
    rows = _rows(df, id_col, tokens)
    counts = written(_counts(rows, 1, None), "counts")
    line = (counts.agg(F.sum("n_docs")).first()[0] or 0) * share
    wanted = counts.where(F.col("n_docs") >= least) if most is None else counts.where(F.col("n_docs").between(least, most))
    heavy = counts.where(F.col("n_docs") > line).select("token")
    if most is not None and most <= line:  # then the heaviest tokens aren't wanted
        return rows.join(F.broadcast(heavy), "token", "left_anti").join(wanted.select("token"), "token", "left_semi").select("token", "doc")
    return salted_join_unique(rows, wanted.select("token"), "token", heavy=heavy).select("token", "doc")


def token_index_candidates(index: DataFrame, each: int = 1000) -> DataFrame:
    """Distinct pairs ``(a, b, score NULL)`` of documents that share a token of an index or of its postings.

    Tokens of more than ``each`` documents are split into blocks (``meeting_pairs``).
    """
    rows = index.select("token", "doc") if "doc" in index.columns else index.select("token", F.explode("docs").alias("doc"))
    return meeting_pairs(rows, "token", each=each).select("a", "b").distinct().withColumn("score", F.lit(None).cast("double"))


def token_index_pairs(df: DataFrame, id_col: str = "doc_id", tokens: str = "tokens", each: int = 32_768, of_part: int = 8192, dense: int = 64) -> DataFrame:
    """The rows of ``token_index_candidates`` over the whole index, ``(a, b, score NULL)``, straight from the documents.

    No row is made for a token that two documents share, and the pairs never move: documents are split into blocks of
    about ``each``, and a task takes two blocks and forms every pair between them once. Tokens stand by 80 bits of two
    hashes. They go in batches to parts, by hash, one for about ``of_part`` documents; there those of one document fall
    out, and the others are sent to every two blocks in which they can make a pair. A token in more than ``dense``
    documents of a block is a bit set there.
    """
    kind = dict(df.dtypes)[id_col]
    known = df.where(F.col(id_col).isNotNull())
    n, cores = known.count(), parallelism(df.sparkSession)
    parts = max(cores, -(-n // of_part))
    # small inputs are split further, so that there is a task for each core
    blocks = max(1, -(-n // each), min(-(-n // 1000), int(np.ceil((np.sqrt(8 * cores + 1) - 1) / 2))))
    hashed = F.transform(F.array_compact(tokens), lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g")))
    rows = known.select(F.col(id_col).alias("doc"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("block"), hashed.alias("t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = batch["t"].value_lengths().fill_null(0).to_numpy(), batch["t"].flatten()
            h, g = flat.field("h").to_numpy(), flat.field("g").to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            part = (h.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            block = batch["block"].to_numpy()
            for p, at in _groups(part):
                yield _row({"part": p}, {"doc": _named(batch["doc"], row[at]), "block": block[row[at]], "h": h[at], "g": g[at].astype(np.int16)})

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, rows in _by(batches, "part"):
            t = _whole(_tables(rows))
            docs = t["doc"].chunk(0)
            d, h, g, block = docs.indices.to_numpy(), *(t[c].to_numpy() for c in ("h", "g", "block"))
            order = np.lexsort((d, g, h))
            d, h, g, block = d[order], h[order], g[order], block[order]
            other = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
            once = other | np.r_[True, d[1:] != d[:-1]]
            token = np.cumsum(other)[once] - 1
            d, block = d[once], block[once]
            shared = np.bincount(token)[token] > 1
            d, block, token = d[shared], block[shared], token[shared].astype(np.int32)
            inside = [(b, d[at], token[at], *np.unique(token[at], return_counts=True)) for b, at in _groups(block)]
            met = np.zeros(len(other), bool)
            for y, (j, *right) in enumerate(inside):
                for i, *left in inside[: y + 1]:
                    both = right[2][right[3] > 1] if i == j else np.intersect1d(left[2], right[2], assume_unique=True)
                    if len(both):
                        met[both] = True
                        for b, (doc, names, *_) in ((i, left), (j, right))[i == j :]:
                            at = np.flatnonzero(met[names])
                            yield _row({"tile": j * (j + 1) // 2 + i, "block": b, "part": p}, {"doc": _named(docs.dictionary, doc[at]), "step": np.diff(names[at], prepend=np.int32(0))})
                        met[both] = False

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by(batches, "tile"):
            sides = [_lists(own) for _, own in sorted(_by([rows], "block"))]
            (ids, *asked), (others, *held) = sides[0], sides[-1]
            for lo, bits in _unions(asked, held, dense):
                found = np.unpackbits(bits.view(np.uint8), axis=1).view(bool)
                if len(sides) == 1:  # a block with itself: every pair once
                    found &= np.arange(found.shape[1]) > np.arange(lo, lo + len(found))[:, None]
                ends = np.cumsum(np.r_[0, found.sum(axis=1)]).astype(np.int32)
                b = others.take(pa.array(np.flatnonzero(found) % found.shape[1]))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(found)), pa.ListArray.from_arrays(pa.array(ends), b)], ["a", "b"])

    sent = rows.mapInArrow(split, "part int, rows binary").repartitionById(parts, "part").mapInArrow(send, "tile int, block int, part int, rows binary")
    met = sent.repartitionById(blocks * (blocks + 1) // 2, "tile").mapInArrow(pair, f"a {kind}, b array<{kind}>").select("a", F.explode("b").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(None).cast("double").alias("score"))


def _groups(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each value of ``key``, ascending: the places where it stands, in order."""
    order = np.argsort(key, kind="stable")
    names, first = np.unique(key[order], return_index=True)
    return list(zip(names.tolist(), np.split(order, first[1:])))


def _row(named: dict[str, int], columns: dict) -> pa.RecordBatch:
    """A row of integers and a table, packed."""
    t, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t)
    return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32()) for k, v in named.items()} | {"rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _by(batches, name: str) -> list[tuple[int, pa.RecordBatch]]:
    """The rows of each value of a column. Partitions by that column hold one value, or few."""
    t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    return [(k, t.take(pa.array(at)).combine_chunks().to_batches()[0]) for k, at in _groups(t[name].to_numpy())] if t else []


def _named(docs: pa.Array, at: np.ndarray) -> pa.DictionaryArray:
    """``docs`` at the places ``at``, with a dictionary of just those and short numbers where these do."""
    used, place = np.unique(at, return_inverse=True)
    ids = docs.take(pa.array(used)).dictionary_encode()
    return pa.DictionaryArray.from_arrays(ids.indices.take(pa.array(place)).cast(pa.uint16() if len(ids.dictionary) <= 65_536 else pa.int32()), ids.dictionary)


def _tables(rows: pa.RecordBatch) -> list[pa.Table]:
    return [pa.ipc.open_stream(x.as_buffer()).read_all() for x in rows["rows"]]


def _whole(tables: list[pa.Table]) -> pa.Table:
    """Tables as one; its column ``doc`` has one dictionary."""
    docs = [pa.DictionaryArray.from_arrays(x.indices.cast(pa.int32()), x.dictionary) for t in tables for x in t["doc"].chunks]
    named = pa.table({"doc": pa.chunked_array(docs)}).unify_dictionaries()["doc"]
    return pa.concat_tables([t.drop_columns("doc") for t in tables]).append_column("doc", named).combine_chunks()


def _lists(rows: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The documents of a block, their tokens and the offsets of these lists. Tokens are numbered in their part."""
    tables = _tables(rows)
    docs = _whole(tables)["doc"].chunk(0)
    d, token = docs.indices.to_numpy(), np.concatenate([np.cumsum(t["step"].to_numpy(), dtype=np.int64) + (p << 32) for p, t in zip(rows["part"].to_pylist(), tables)])
    order = np.argsort(d, kind="stable")
    return docs.dictionary, token[order], np.r_[0, np.cumsum(np.bincount(d, minlength=len(docs.dictionary)))]


def token_index_partners(df: DataFrame, id_col: str = "doc_id", tokens: str = "hashes", each: int = 65_536, dense: int = 256) -> DataFrame:
    """``(doc, n_partners)``: for every document of the index, with how many others it shares a token. No token is left out.

    Tokens are BIGINT (take 64-bit hashes), ids are unique. The pairs grow with the square of a family of near copies,
    so they are counted without being formed: documents are split into blocks of about ``each``, and a task takes two
    blocks. There a token in more than ``dense`` documents of a block is a bit set, and a document's partners are the
    bits of the union over its tokens. The bits are still documents squared, in words of 64.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(tokens)).alias("token")).where("token is not null and doc is not null")
    held = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("n > 1")
    sets = written(held.groupBy("doc").agg(F.collect_list("token").alias("t")), "sets")
    blocks = max(1, -(-sets.count() // each))
    tiled = (
        sets.withColumn("i", F.pmod(F.xxhash64("doc"), F.lit(blocks)).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select((F.least("i", "j") * blocks + F.greatest("i", "j")).alias("tile"), "i", "doc", "t")
    )

    def tile(rows: pa.Table) -> pa.Table:
        i = rows["i"].to_numpy()
        sides = [rows.filter(pa.array(i == k)) for k in np.unique(i)]
        # a tile of two blocks that misses one of them has nothing to add; a block meets itself in its own tile
        met = [(sides[0], sides[0])] if rows["tile"][0].as_py() % (blocks + 1) == 0 else [(sides[0], sides[1]), (sides[1], sides[0])] if len(sides) == 2 else []
        out = [pa.table({"doc": x["doc"], "n": pa.array(_union_sizes(_flat(x), _flat(y), dense))}) for x, y in met]
        return pa.concat_tables(out) if out else pa.table({"doc": rows["doc"].slice(0, 0), "n": pa.array([], pa.int64())})

    met = tiled.groupBy("tile").applyInArrow(tile, f"doc {kind}, n long")
    # a document meets itself once
    return met.groupBy("doc").agg((F.sum("n") - 1).alias("n_partners"))


def _flat(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lists = rows["t"].combine_chunks()
    off = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), off - off[0]


def _union_sizes(asked: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], dense: int) -> np.ndarray:
    """For each list of ``asked``: how many lists of ``held`` share a token with it. Both are tokens and list offsets."""
    sizes = [np.bitwise_count(bits).sum(axis=1, dtype=np.int64) for _, bits in _unions(asked, held, dense)]
    return np.concatenate([np.zeros(0, np.int64), *sizes])


def _unions(asked: tuple[np.ndarray, np.ndarray], held: tuple[np.ndarray, np.ndarray], dense: int) -> Iterator[tuple[int, np.ndarray]]:
    """For 128 lists of ``asked`` at a time: the first one's number, and as rows of bits which lists of ``held`` share a token with each."""
    (tokens, at), (others, starts) = asked, held
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(others, kind="stable")
    names, first, n = np.unique(others[order], return_index=True, return_counts=True)
    owner, width = owner[order], -(-(len(starts) - 1) // 64) * 64
    place = np.minimum(np.searchsorted(names, tokens), max(len(names) - 1, 0))
    known = names[place] == tokens if len(names) else np.zeros(len(tokens), bool)
    often = np.flatnonzero(n > dense)
    bits = np.zeros((len(often), width // 8), np.uint8)
    for r, k in enumerate(often):
        one = np.zeros(width, bool)
        one[owner[first[k] : first[k] + n[k]]] = True
        bits[r] = np.packbits(one)
    bits = bits.view(np.uint64)
    row_of = np.full(len(names), -1)
    row_of[often] = np.arange(len(often))
    for lo in range(0, len(at) - 1, 128):
        hi = min(lo + 128, len(at) - 1)
        mine = slice(at[lo], at[hi])
        doc = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))[known[mine]]
        k = place[mine][known[mine]]
        hot = row_of[k] >= 0
        rare, length = k[~hot], n[k[~hot]]
        step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        seen = np.zeros((hi - lo, width), bool)
        seen[np.repeat(doc[~hot], length), owner[np.repeat(first[rare], length) + step]] = True
        packed = np.packbits(seen, axis=1).view(np.uint64)
        if hot.any():
            d, begin = np.unique(doc[hot], return_index=True)
            packed[d] |= np.bitwise_or.reduceat(bits[row_of[k[hot]]], begin, axis=0)
        yield lo, packed
