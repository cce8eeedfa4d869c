"""Texts split into pieces, packed as chunks with a dictionary of their own.

A chunk is one row: the ids of some documents, how many pieces each has, the piece at every position as an
index, and the distinct pieces. Later stages handle each distinct piece of a chunk once, and come back to the
positions through the index; so work and shuffles follow the distinct pieces, and a frequent piece
costs a chunk one row. Chunks are bounded by ``chars`` (one longer text is a chunk of its own), so their number
grows with the data and their size does not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS = 4_000_000


class _Index(dict):
    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        return n


def chunked(df: DataFrame, id_col: str, text_col: str, split: Callable[[str], list[str]], chars: int = CHARS) -> DataFrame:
    """``(chunk, ids, lens, idx, pieces)`` over all rows; a null text has no pieces."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids, lens, idx, index, held = [], [], [], _Index(), 0
        id_type = None

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(idx) if idx else np.empty(0, np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | number], pa.int64()),
                    pa.array([ids], pa.list_(id_type)),
                    pa.array([lens], pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, pa.int32())),
                    pa.array([list(index)], pa.list_(pa.string())),
                ],
                names=["chunk", "ids", "lens", "idx", "pieces"],
            )

        for b in batches:
            id_type = b.schema.field(0).type
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces = split(text) if text else []
                if held and held + len(text or "") > chars:
                    yield flush()
                    number += 1
                    ids, lens, idx, index, held = [], [], [], _Index(), 0
                ids.append(i)
                lens.append(len(pieces))
                if pieces:
                    idx.append(np.fromiter(map(index.__getitem__, pieces), dtype=np.int32, count=len(pieces)))
                held += len(text or "") + 1
        if ids:
            yield flush()

    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, lens array<int>, idx array<int>, pieces array<string>")
