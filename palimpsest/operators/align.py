"""Best local alignment of two texts, word by word, with the edits marked.

The scores are Smith and Waterman's with a linear gap; the way back takes the largest neighbour (up before left before
diagonal) and ends where the diagonal cell is 0. Words are compared without punctuation and case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squish
from ..functions.tokenizers import words
from ..runtime import written

SCHEMA = "struct<a_edits string, b_edits string, score int, n_optimal int>"


@dataclass(frozen=True)
class Scores:
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    edit_mark: str = "#"

    def __post_init__(self):
        whole = all(isinstance(v, int) or (isinstance(v, float) and v.is_integer()) for v in (self.match, self.mismatch, self.gap))
        if not whole or self.match <= 0 or self.mismatch > 0 or self.gap > 0 or len(self.edit_mark) != 1:
            raise ValueError("match must be a positive integer, mismatch and gap negative integers or zero, edit_mark a single character")


def align_tokens(text: Column, preserve_punctuation: bool = False) -> Column:
    if not preserve_punctuation:
        return words(text, lowercase=False)
    return F.filter(F.split(squish(text), " "), lambda x: x != "")


def normalized(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.lower(F.regexp_replace(x, r"\p{P}", "")))


def _rows(above: np.ndarray, b: np.ndarray, a: np.ndarray, s: Scores) -> np.ndarray:
    """Matrix rows for the words b under the row ``above``."""
    n = len(a)
    ramp = s.gap * np.arange(n + 1, dtype=np.int64)
    out = np.zeros((len(b), n + 1), np.int32)
    for i, word in enumerate(b):
        x = np.zeros(n + 1, np.int64)
        x[1:] = np.maximum(np.maximum(above[:-1] + np.where(a == word, s.match, s.mismatch), above[1:] + s.gap), 0)
        # a gap to the left can run on from any earlier cell: a running maximum along the row
        above = np.maximum.accumulate(x - ramp) + ramp
        above[0] = 0
        out[i] = above
    return out


def align_words(a_words: list[str], b_words: list[str], a_norm: list[str], b_norm: list[str], s: Scores = Scores(), block: int | None = None) -> dict:
    """Memory grows with the root of the matrix: rows are kept in blocks and computed again on the way back."""
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in a_norm], np.int64)
    b = np.array([codes.setdefault(w, len(codes)) for w in b_norm], np.int64)
    step = block or (len(b) or 1 if (len(a) + 1) * (len(b) + 1) <= 20_000_000 else max(1, int(len(b) ** 0.5)))
    tops, top = [], np.zeros(len(a) + 1, np.int64)
    best, at, count, last = 0, (0, 0), 0, None
    for lo in range(0, len(b), step):
        tops.append(top)
        last = _rows(top, b[lo : lo + step], a, s)
        top = last[-1].astype(np.int64)
        high = int(last.max())
        if high >= best and high > 0:
            r, c = np.nonzero(last == high)
            k = np.lexsort((r, c))[0]
            first = (lo + int(r[k]) + 1, int(c[k]))
            if high > best:
                best, at, count = high, first, len(r)
            else:
                count += len(r)
                if first[1] < at[1]:
                    at = first
    if best == 0:
        return {"a_edits": "", "b_edits": "", "score": 0, "n_optimal": 0}
    held: tuple[int, np.ndarray] = ((len(tops) - 1) * step, last)

    def cell(i: int, j: int) -> int:
        nonlocal held
        if i == 0:
            return 0
        lo = (i - 1) // step * step
        if held[0] != lo:
            held = (lo, _rows(tops[lo // step], b[lo : lo + step], a, s))
        return int(held[1][i - 1 - lo, j])

    i, j = at
    left, right = [a_words[j - 1]], [b_words[i - 1]]
    mark = lambda w: s.edit_mark * len(w)
    while (diagonal := cell(i - 1, j - 1)) != 0:
        over, side = cell(i - 1, j), cell(i, j - 1)
        top_value = max(over, side, diagonal)
        if over == top_value:
            i -= 1
            left.append(mark(b_words[i - 1]))
            right.append(b_words[i - 1])
        elif side == top_value:
            j -= 1
            left.append(a_words[j - 1])
            right.append(mark(a_words[j - 1]))
        else:
            i, j = i - 1, j - 1
            x, y = a_words[j - 1], b_words[i - 1]
            if a[j - 1] == b[i - 1]:
                left.append(x)
                right.append(y)
            else:
                left += [mark(y), x]
                right += [y, mark(x)]
    return {"a_edits": " ".join(left[::-1]), "b_edits": " ".join(right[::-1]), "score": best, "n_optimal": count}


def align_pairs(pairs: DataFrame, docs: DataFrame, scores: Scores = Scores(), preserve_punctuation: bool = False, id_col: str = "doc_id", content: str = "text") -> DataFrame:
    """``(a, b, a_edits, b_edits, score, n_optimal)`` of the documents of every pair; ``n_optimal`` > 1 means ties."""
    tokens = align_tokens(F.col(content), preserve_punctuation)
    # hashes of the normalised words are enough to compare them; a pair carries the words once
    d = docs.select(F.col(id_col).alias("id"), tokens.alias("w")).select("id", "w", F.transform(normalized(F.col("w")), lambda x: F.xxhash64(x)).alias("n"))
    d = written(d, "words").where("w is not null")
    both = (
        pairs.select("a", "b")
        .join(d.select(F.col("id").alias("a"), F.col("w").alias("aw"), F.col("n").alias("an")), "a")
        .join(d.select(F.col("id").alias("b"), F.col("w").alias("bw"), F.col("n").alias("bn")), "b")
    )
    kinds = dict(both.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                got = [align_words(*[part.column(c)[i].as_py() for c in ("aw", "bw", "an", "bn")], scores) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), pa.array([g["a_edits"] for g in got], pa.string()), pa.array([g["b_edits"] for g in got], pa.string()), pa.array([g["score"] for g in got], pa.int32()), pa.array([g["n_optimal"] for g in got], pa.int32())],
                    names=["a", "b", "a_edits", "b_edits", "score", "n_optimal"],
                )

    return both.mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}, a_edits string, b_edits string, score int, n_optimal int")


def show_alignment(a_edits: str, b_edits: str, score: int, width: int = 72) -> str:
    """Both sides of an alignment, wrapped."""
    import textwrap

    return "\n".join(["Alignment score: " + str(score), "Document A:", *textwrap.wrap(a_edits, width), "", "Document B:", *textwrap.wrap(b_edits, width)])
