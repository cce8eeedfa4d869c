"""Comparison of all pairs of documents, and conversions between its forms.

Built-in measures never meet pairs that cannot reach the threshold: tokens are ordered from the rarest to the most
frequent, every document is looked up under the first ones only (a pair of Jaccard similarity t or more shares one
among the first ``size - ceil(t * size) + 1``), and pairs that meet are compared exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..runtime import written
from .salted import meeting_pairs, salted_join_unique


def similar_pairs(df: DataFrame, least: float, id_col: str = "doc_id", tokens: str = "hashes") -> DataFrame:
    """``(a, b, score)`` of all pairs with a Jaccard similarity of ``least`` (over 0) or more, a < b. Ids must be unique."""
    if not 0 < least <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    sets = df.select(F.col(id_col).alias("doc"), F.array_distinct(F.filter(tokens, lambda x: x.isNotNull())).alias("s")).where("doc is not null and size(s) > 0")
    rows = sets.select("doc", F.explode("s").alias("t"))
    often = written(rows.groupBy("t").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    line = (often.agg(F.sum("df")).first()[0] or 0) * 0.005
    # tokens of one document can't make a pair; they only fill the front of its order
    ranked = salted_join_unique(rows, often.where("df > 1"), "t", heavy=often.where(F.col("df") > line).select("t"))
    ordered = ranked.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("k"))
    sized = ordered.join(sets.select("doc", F.size("s").alias("n")), "doc")
    alone = F.col("n") - F.size("k")
    take = F.greatest(F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1 - alone, F.lit(0)).cast("int")
    front = written(sized.select("doc", "n", F.explode(F.slice("k", F.lit(1), take)).alias("k")).select("doc", "n", F.col("k.t").alias("t")), "front")
    met = (
        meeting_pairs(front, "t", more=["n"])
        .where(F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * F.lit(least) - F.lit(1e-9))
        .select("a", "b")
        .distinct()
    )
    scored = compare(met, sets, S.jaccard_similarity, "doc", "s")
    return scored.where(F.col("score") >= least)


def compare(pairs: DataFrame, docs: DataFrame, f: Callable[[Column, Column], Column], id_col: str = "doc_id", on: str = "hashes") -> DataFrame:
    """``(a, b, score)``: f of both documents of every pair."""
    d = docs.select(F.col(id_col).alias("id"), F.col(on).alias("v"))
    both = pairs.select("a", "b").join(d.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(d.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    return both.select("a", "b", f(F.col("x"), F.col("y")).alias("score"))


def pairwise_compare(docs: DataFrame, f: Callable[[Column, Column], Column], queries: DataFrame | None = None, directional: bool = False, id_col: str = "doc_id", on: str = "hashes", most: int = 20_000, elements: int = 20_000_000) -> DataFrame:
    """``(a, b, score)`` of any measure f over all pairs: a < b, or both directions when ``directional``.

    The number of pairs is the square of the documents, so this is for small corpora: with more than ``most`` documents
    (counted) it raises and names the operators that scale. With ``queries`` (one column of at most ``most`` ids) these
    documents are compared with all others instead. What is broadcast has at most ``elements`` array elements (counted).
    """
    d = docs.select(F.col(id_col).alias("b"), F.col(on).alias("y"))
    if queries is None:
        if d.count() > most:
            raise ValueError(f"more than {most} documents: use similar_pairs, LSH or the token index for candidates, or give queries")
        asked = d
    else:
        ids = queries.toDF("b").distinct()
        if ids.count() > most:
            raise ValueError(f"more than {most} queries")
        asked = d.join(ids, "b", "left_semi")
    kind = asked.schema["y"].dataType.typeName()
    held = asked.agg(F.sum(F.size("y") if kind == "array" else F.length(F.col("y").cast("string")))).first()[0] or 0
    if held > elements:
        raise ValueError(f"more than {elements} elements to compare with: give fewer queries at a time")
    left = asked.select(F.col("b").alias("a"), F.col("y").alias("x"))
    on_ = F.col("a") != F.col("b") if directional or queries is not None else F.col("a") < F.col("b")
    return d.join(F.broadcast(left), on_).select("a", "b", f(F.col("x"), F.col("y")).alias("score"))


def pairwise_candidates(matrix: DataFrame, directional: bool = False) -> DataFrame:
    """Scored pairs as candidates: pairs without a score are dropped, zeros stay; sorted ids unless ``directional``."""
    kept = matrix.where("score is not null")
    if directional:
        return kept.select("a", "b", "score")
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")


def similarity_matrix(candidates: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Symmetric sparse matrix ``(row, col, value)``, 1 on the diagonal. Of a pair that is given more than once the last
    score counts, by the order of the given (a, b)."""
    docs = (ids.toDF("row") if ids is not None else candidates.select(F.explode(F.array("a", "b")).alias("row"))).distinct()
    one = candidates.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max_by("score", F.struct("a", "b", "score")).alias("value"))
    both = one.select(F.explode(F.array(F.struct(F.col("x").alias("row"), F.col("y").alias("col"), "value"), F.struct(F.col("y").alias("row"), F.col("x").alias("col"), "value"))).alias("c")).select("c.*")
    return docs.select("row", F.col("row").alias("col"), F.lit(1.0).alias("value")).unionByName(both.where("row != col"))


def dense_matrix(candidates: DataFrame, most: int = 2000) -> DataFrame:
    """The matrix as one row a document and one column a document (``row`` and the ids), zeros filled in; small only."""
    coo = similarity_matrix(candidates)
    ids = sorted(r[0] for r in coo.select("row").distinct().limit(most + 1).collect())
    if len(ids) > most:
        raise ValueError(f"more than {most} documents: keep the sparse form")
    return coo.groupBy("row").pivot("col", ids).agg(F.first("value")).fillna(0.0)
