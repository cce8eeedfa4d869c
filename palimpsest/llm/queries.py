"""Queries of the training-data operators: name -> (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table, written
from .batches import rejected_records
from .encode import decode_ids, encode_texts
from .groups import link_groups
from .leaks import leaks, without_leaks
from .near_duplicates import near_duplicate_classes, near_duplicate_pairs
from .personal import personal_spans, redacted
from .shared_spans import record_text, shared_paths, shared_runs
from .similar_sets import similar_set_classes, similar_set_pairs
from .term_counts import TermCounts, mark_terms


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicate_pairs(table(spark, d, "doc_records"))


def classes_of(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each document: its group and the number of other documents it is linked to directly."""
    sizes = members.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.x", "e.y")
    links = both.join(sizes.select(F.col("rid").alias("y"), "n"), "y").groupBy("x").agg(F.sum("n").alias("far"))
    firsts = sizes.select("rid", "first")
    named = pairs.join(firsts.select(F.col("rid").alias("a"), F.col("first").alias("fa")), "a").join(firsts.select(F.col("rid").alias("b"), F.col("first").alias("fb")), "b")
    alone = firsts.select(F.col("first").alias("fa"), F.col("first").alias("fb"))
    groups = link_groups(named.select("fa", "fb").unionByName(alone), "fa", "fb")
    rows = sizes.join(links, sizes.rid == links.x, "left").join(groups, sizes["first"] == groups.doc)
    per_class = rows.select("rid", "group_doc", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return members.join(per_class, "rid").select(F.col("id").alias("doc_id"), "group_doc", "n_links")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = near_duplicate_classes(table(spark, d, "doc_records"))
    return classes_of(written(pairs.select("a", "b"), "pairs"), written(members, "members"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_set_pairs(table(spark, d, "doc_records"))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Similar classes by their first documents, with the score and the sizes of both classes."""
    pairs, members = similar_set_classes(table(spark, d, "doc_records"))
    sizes = written(members, "members").groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    x = sizes.select(F.col("rid").alias("a"), F.struct(F.col("first").alias("doc"), "n").alias("x"))
    y = sizes.select(F.col("rid").alias("b"), F.struct(F.col("first").alias("doc"), "n").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.round("score", 9).alias("score"))
    return both.select(F.col("x.doc").alias("doc_a"), F.col("y.doc").alias("doc_b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), "score")


def _all_terms(spark: SparkSession, d: str) -> TermCounts:
    """The index by three deltas: most fragments; the others, with some delivered twice; the surplus ones taken back."""
    index = table(spark, d, "token_index").select("token", "docs")
    build = F.pmod(F.xxhash64("token", "docs"), F.lit(16))
    counts = TermCounts(spark)
    counts.apply(index.where(F.coalesce(build != 0, F.lit(True))))
    counts.apply(index.where(build <= 1).withColumn("sign", F.lit(1)), sign="sign")
    counts.apply(index.where(build == 1).withColumn("sign", F.lit(-1)), sign="sign")
    return counts


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    n_docs = table(spark, d, "doc_records").agg(F.count_distinct("doc_id"))
    return mark_terms(_all_terms(spark, d).counts(), n_docs)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return _all_terms(spark, d).counts()


def p3_delta(spark: SparkSession, d: str) -> DataFrame:
    """Words of documents: all, then those of one source withdrawn by a second, negative delta."""
    docs = table(spark, d, "documents").select("source", F.split("text", " ").alias("w"), F.array(F.col("doc_id").cast("string")).alias("docs"))
    rows = docs.select("source", "docs", F.explode(F.array_distinct("w")).alias("token"))
    counts = TermCounts(spark)
    counts.apply(rows)
    counts.apply(rows.where("source = 'letters_ocr'").withColumn("sign", F.lit(-1)), sign="sign")
    return counts.counts()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    paths, _ = shared_paths(table(spark, d, "doc_records"), "doc_id", record_text())
    return shared_runs(paths).select(F.col("id").alias("doc_id"), "start_word", "n_words")


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For each record with words: how many it has and how many of them are shared."""
    paths, chunks = shared_paths(table(spark, d, "doc_records"), "doc_id", record_text())
    shared = shared_runs(paths).groupBy("id").agg(F.sum("n_words").alias("n_shared"))
    lens = chunks.select(F.explode(F.arrays_zip("ids", "lens")).alias("x")).groupBy(F.col("x.ids").alias("id")).agg(F.max("x.lens").cast("bigint").alias("n_words"))
    return lens.where("n_words > 0").join(shared, "id", "left").select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return link_groups(table(spark, d, "candidates"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected_records(table(spark, d, "lsh_buckets"), table(spark, d, "arrivals"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"))


def p8_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts again from their ids."""
    return decode_ids(written(p8_ids(spark, d), "ids")).select("doc_id", F.md5("text").alias("text_md5"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    out = without_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return out.where("n_removed > 0").select("doc_id", "n_removed", F.col("text").isNull().alias("dropped"), F.md5("text").alias("text_md5"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_spans(table(spark, d, "documents"), table(spark, d, "name_lexicon"))


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    out = redacted(table(spark, d, "documents"), table(spark, d, "name_lexicon"))
    return out.select("doc_id", "n_found", F.md5("text").alias("text_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_scores, p3_found, p3_counts, p3_delta, p4_found, p4_coverage, p5_found, p6_found, p8_ids, p8_texts, p9_found, p9_clean, p10_found, p10_redacted)}
