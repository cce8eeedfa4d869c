"""Queries of the text-overlap operators over the whole ``documents`` table, with the SQL that gives the same rows.

Operators on pairs work on the distinct texts: a text's copies are one class, named by its smallest document
(``text_classes`` has the membership), so copies are never expanded into pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..corpus import Corpus
from ..functions import similarity as S
from ..functions.hashing import hash_tokens, minhash_generator, random_ints
from ..functions.text import filenames, mark_chars, squish
from ..functions.tokenizers import WORD, minimum_words, ngrams, sentences, shingle, skip_ngrams, skip_shingle, word_count, words
from ..operators import index as I
from ..operators import lsh as L
from ..operators import pairwise as P
from ..operators.align import align_pairs
from ..operators.salted import salted_join_unique
from ..runtime import parallelism, spread, table, written

N, H, BANDS, SEED, LEAST = 5, 100, 25, 42, 0.5


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a text; the condition is on the scanned column, so that no expression is pushed below the spreading."""
    return spread(table(spark, d, "documents").select("doc_id", "text").where("text is not null"))


def _w(spark: SparkSession, d: str, lowercase: bool = True) -> DataFrame:
    return _texts(spark, d).select("doc_id", words(F.col("text"), lowercase).alias("w"))


def _long(w, tokens, least: int):
    """Tokens of the texts of at least so many words, else null: a value, so that it isn't evaluated a second time as a filter."""
    return F.when(F.size(w) >= least, tokens)


def _joined(df: DataFrame, tokens) -> DataFrame:
    return df.select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", "|")).alias("tokens_md5"))


def text_classes(spark, d):
    docs = _texts(spark, d)
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("class_id"))
    return salted_join_unique(docs.select("doc_id", F.sha2("text", 256).alias("h")), first, "h").select("doc_id", "class_id")


def representatives(spark, d) -> DataFrame:
    """The distinct texts by their smallest documents. Texts move once, by their documents, so that copies don't meet.

    The number of partitions is given: tokenizing costs far more than the bytes suggest by which small shuffles are merged.
    """
    docs = table(spark, d, "documents").select("doc_id", "text").where("text is not null")
    first = docs.groupBy(F.unhex(F.sha2("text", 256)).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.repartition(parallelism(spark), "doc_id").join(first, "doc_id", "left_semi")


def _hashes(spark, d, n: int = N) -> DataFrame:
    """Hashes of the n-grams of the distinct texts, null for those that are too short."""
    w = representatives(spark, d).select("doc_id", words(F.col("text")).alias("w"))
    return w.select("doc_id", _long(F.col("w"), hash_tokens(shingle(F.col("w"), n)), minimum_words(n)).alias("hashes"))


def _hashed(spark, d, n: int = N) -> DataFrame:
    """The same of the texts that are long enough, written once for the joins that follow."""
    return written(_hashes(spark, d, n), "hashes").where("hashes is not null")


def _pairs(spark, d) -> tuple[DataFrame, DataFrame]:
    h = _hashed(spark, d)
    return h, P.similar_pairs(h, LEAST)


def _signed(spark, d) -> DataFrame:
    return L.sign(_hashes(spark, d), H, SEED).where("minhashes is not null")


def _buckets(spark, d) -> DataFrame:
    return written(L.lsh(_signed(spark, d), BANDS, H), "buckets")


def word_counts(spark, d):
    return _docs(spark, d).select("doc_id", word_count(F.col("text")).alias("n_words"))


def tokenize_words(spark, d):
    return _joined(_w(spark, d), F.col("w"))


def tokenize_words_cased(spark, d):
    return _joined(_w(spark, d, False), F.col("w"))


def tokenize_ngrams_3(spark, d):
    return _joined(_w(spark, d), shingle(F.col("w"), 3))


def tokenize_ngrams_5(spark, d):
    return _joined(_w(spark, d), shingle(F.col("w"), 5))


def tokenize_skip_ngrams_3_2(spark, d):
    return _joined(_w(spark, d), skip_shingle(F.col("w"), 3, 2))


def tokenize_sentences(spark, d):
    s = _texts(spark, d).select("doc_id", sentences(F.col("text")).alias("s"))
    return _joined(s, F.col("s"))


def squished(spark, d):
    return _texts(spark, d).select("doc_id", F.md5(squish(F.col("text"))).alias("text_md5"))


def _corpus(spark, d, **options) -> Corpus:
    return Corpus.from_dataframe(_docs(spark, d), **options)


def short_docs_kept(spark, d):
    return _corpus(spark, d).names()


def short_docs_skipped(spark, d):
    return _corpus(spark, d).skipped


def skip_ngram_skipped(spark, d):
    return _corpus(spark, d, tokenizer=skip_ngrams, n=3, k=2).skipped


def corpus_tokens(spark, d):
    return _joined(_corpus(spark, d, n=5, lowercase=False, keep_tokens=True).docs, F.col("tokens"))


def corpus_skip_ngrams(spark, d):
    return _joined(_corpus(spark, d, tokenizer=skip_ngrams, n=3, k=2, keep_tokens=True).docs, F.col("tokens"))


def corpus_retokenized(spark, d):
    return _joined(_corpus(spark, d, n=5).tokenize(ngrams, n=4).docs, F.col("tokens"))


def corpus_positions(spark, d):
    return _corpus(spark, d).positions()


def corpus_meta(spark, d):
    c = _corpus(spark, d).with_doc_meta("parity", F.col("doc_id") % 2)
    return c.docs.select("doc_id", F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"))


def file_names(spark, d):
    p = F.concat(F.lit("/data/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".mp3"))
    return table(spark, d, "documents").select("doc_id", filenames(p).alias("name"), filenames(p, True).alias("with_extension"))


def marked_words(spark, d):
    return _w(spark, d).select("doc_id", F.md5(F.array_join(F.transform("w", lambda x: mark_chars(x)), " ")).alias("marks_md5"))


def hash_sums(spark, d):
    h = F.col("h")
    return _w(spark, d).select("doc_id", hash_tokens(shingle(F.col("w"), 3)).alias("h")).select("doc_id", F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("hash_sum"), F.size(h).alias("n"))


def minhash_signatures(spark, d):
    return _signed(spark, d).select("doc_id", F.md5(F.array_join("minhashes", ",")).alias("signature_md5"))


def rehash_seed_2(spark, d):
    c = Corpus.from_dataframe(representatives(spark, d), n=N, keep_tokens=True).rehash(minhash_generator(20, 2), "minhashes")
    return c.slot("minhashes").select("doc_id", F.md5(F.array_join("minhashes", ",")).alias("signature_md5"))


def lsh_buckets_of_documents(spark, d):
    return L.lsh(_signed(spark, d), BANDS, H)


def lsh_candidates(spark, d):
    return L.lsh_candidates(_buckets(spark, d)).select("a", "b", "score")


def lsh_query(spark, d):
    b = _buckets(spark, d)
    return L.lsh_query(b, b.where("doc % 20 = 0").select("doc").distinct())


def lsh_subset(spark, d):
    return L.lsh_subset(L.lsh_candidates(_buckets(spark, d)))


def lsh_add(spark, d):
    """Documents added to buckets that hold stale ones of some of them: the same rows as a full build."""
    s = written(_signed(spark, d), "signed")
    stale = L.lsh(s.where("doc_id % 3 != 0").select("doc_id", F.transform("minhashes", lambda x: x + (F.col("doc_id") % 3 - 1)).alias("minhashes")), BANDS, H)
    return L.lsh_add(stale, s.where("doc_id % 3 != 1"), BANDS, H)


def lsh_compare(spark, d):
    s = written(_signed(spark, d), "signed")
    c = L.lsh_candidates(L.lsh(s, BANDS, H))
    return L.lsh_compare(c, s, S.jaccard_similarity).select("a", "b", F.round("score", 9).alias("score"))


def lsh_compare_prescored(spark, d):
    s = written(_signed(spark, d), "signed")
    c = L.lsh_candidates(L.lsh(s, BANDS, H)).withColumn("score", F.when(F.col("a") % 2 == 0, 0.125).when(F.col("a") % 3 == 0, float("nan")))
    return L.lsh_compare(c, s, S.jaccard_similarity).select("a", "b", F.round("score", 9).alias("score"))


def lsh_probability_grid(spark, d):
    s = spark.range(1, 11).select((F.col("id") / 10).alias("s"))
    one = [s.select(F.lit(h).alias("h"), F.lit(b).alias("b"), "s", F.round(L.lsh_probability(h, b, F.col("s")), 9).alias("p")) for h, b in ((200, 50), (240, 80), (100, 25))]
    return one[0].unionByName(one[1]).unionByName(one[2])


def lsh_threshold_grid(spark, d):
    rows = [(h, b, round(L.lsh_threshold(h, b), 9)) for h, b in ((200, 50), (240, 80), (100, 25))]
    return spark.createDataFrame(rows, "h int, b int, t double")


def _three(spark, d) -> DataFrame:
    return _w(spark, d).select("doc_id", _long(F.col("w"), shingle(F.col("w"), 3), minimum_words(3)).alias("tokens"))


def token_index_of_documents(spark, d):
    out = I.token_index(_three(spark, d), least=2, most=50)
    return out.select("token", "n_docs", F.md5(F.array_join(F.transform("docs", lambda x: x.cast("string")), ",")).alias("docs_md5"))


def token_postings_of_documents(spark, d):
    """The whole index, hot tokens too, as rows: no list is built."""
    return I.token_postings(_three(spark, d)).select(F.md5("token").alias("token_md5"), F.col("doc").alias("doc_id"))


def token_frequencies(spark, d):
    return I.token_counts(_three(spark, d), least=2)


def _five(spark, d) -> DataFrame:
    reps = representatives(spark, d).select("doc_id", words(F.col("text")).alias("w"))
    return reps.select("doc_id", _long(F.col("w"), shingle(F.col("w"), N), minimum_words(N)).alias("tokens"))


def token_index_candidates(spark, d):
    """Candidates of a band of the index, tokens in 2 to 10 documents, as its SQL has it; the others are in the two queries below."""
    return I.token_index_candidates(I.token_postings(_five(spark, d), least=2, most=10)).select("a", "b", "score")


def token_index_candidates_all(spark, d):
    """Candidates of the whole index. Their number grows with the square of the documents that share a token."""
    return I.token_index_pairs(_five(spark, d))


def token_index_partners(spark, d):
    """With how many others each document of the whole index is a candidate; the pairs are not formed."""
    h = _five(spark, d).select("doc_id", F.transform("tokens", lambda x: F.xxhash64(x)).alias("hashes"))
    return I.token_index_partners(h).withColumnRenamed("doc", "doc_id")


def jaccard_pairs(spark, d):
    return _pairs(spark, d)[1].select("a", "b", F.round("score", 9).alias("score"))


def pairwise_measures(spark, d):
    h, pairs = _pairs(spark, d)
    x, y = F.col("x"), F.col("y")
    dd = h.select(F.col("doc_id").alias("id"), F.col("hashes").alias("v"))
    both = pairs.select("a", "b").join(dd.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(dd.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    return both.select(
        "a", "b", F.round(S.jaccard_similarity(x, y), 9).alias("jaccard"), F.round(S.jaccard_dissimilarity(x, y), 9).alias("dissimilarity"), F.round(S.jaccard_bag_similarity(x, y), 9).alias("bag"),
        F.round(S.ratio_of_matches(x, y), 9).alias("ratio_ab"), F.round(S.ratio_of_matches(y, x), 9).alias("ratio_ba"), S.count_matches(x, y).alias("matches_ab"), S.count_matches(y, x).alias("matches_ba"),
    )


def matching_tokens_pairs(spark, d):
    _, pairs = _pairs(spark, d)
    reps = written(representatives(spark, d).select("doc_id", words(F.col("text")).alias("w")).select("doc_id", shingle(F.col("w"), N).alias("tokens")), "tokens")
    return P.compare(pairs, reps, lambda x, y: F.md5(F.array_join(S.matching_tokens(x, y), "|")), on="tokens").withColumnRenamed("score", "matching_md5")


def _items_and_docs(spark, d) -> DataFrame:
    """Distinct hashes of the benchmark's items (ids ``i...``) and of the distinct texts (ids ``d...``)."""
    items = table(spark, d, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("doc_id"), "text")
    docs = representatives(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text").unionByName(items)
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    return written(w.select("doc_id", _long(F.col("w"), F.array_distinct(hash_tokens(shingle(F.col("w"), N))), minimum_words(N)).alias("hashes")), "hashes").where("hashes is not null")


def benchmark_overlap(spark, d):
    """A stated query set, the benchmark's items, against all documents, by a directional measure: every pair with a common 5-gram."""
    rows = _items_and_docs(spark, d).select("doc_id", F.size("hashes").alias("n"), F.explode("hashes").alias("t"))
    asked = rows.where("doc_id like 'i%'").select(F.col("doc_id").alias("item"), F.col("n").alias("n_item"), "t")
    # the items are a stated set; a large one is joined by a shuffle
    small = asked.count() <= 1_000_000
    met = rows.where("doc_id like 'd%'").join(F.broadcast(asked) if small else asked, "t").groupBy("item", "doc_id", "n_item").agg(F.count(F.lit(1)).alias("matches"))
    return met.select(F.substring("item", 2, 20).cast("bigint").alias("item_id"), F.substring("doc_id", 2, 20).cast("bigint").alias("doc_id"), "matches", F.round(F.col("matches") / F.col("n_item"), 9).alias("ratio"))


def pairwise_benchmark(spark, d):
    """The pairs of ``benchmark_overlap`` that hold a tenth of the item's 5-grams, as its SQL has it."""
    return benchmark_overlap(spark, d).where("ratio >= 0.1")


def pairwise_compare_items(spark, d):
    """``pairwise_compare`` with a query set: every item against every document and other item, pairs without a match included.

    The measure is the share of the item's 5-grams; on sets it is ``ratio_of_matches`` without its search of lists.
    """
    h = _items_and_docs(spark, d)
    out = P.pairwise_compare(h, lambda x, y: F.size(F.array_intersect(x, y)) / F.size(x), queries=h.where("doc_id like 'i%'").select("doc_id"))
    return out.select("a", "b", F.round("score", 9).alias("score"))


def _items(spark, d) -> DataFrame:
    w = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), words(F.col("text")).alias("w"))
    return w.select("doc_id", _long(F.col("w"), hash_tokens(shingle(F.col("w"), N)), minimum_words(N)).alias("hashes")).where("hashes is not null")


def pairwise_items(spark, d):
    """All pairs of the benchmark's items, both ways, by a directional measure of two lists."""
    out = P.pairwise_compare(_items(spark, d), S.ratio_of_matches, directional=True)
    return out.select("a", "b", F.round("score", 9).alias("score"))


def dense_matrix_of_items(spark, d):
    """The dense matrix of the benchmark's items, a row's cells in the order of the ids, in billionths."""
    m = P.dense_matrix(P.pairwise_candidates(P.pairwise_compare(_items(spark, d), S.jaccard_similarity)))
    ids = sorted((c for c in m.columns if c != "row"), key=int)
    return m.select("row", F.array_join(F.transform(F.array(*[F.col(f"`{c}`") for c in ids]), lambda x: F.round(x * 1e9).cast("bigint").cast("string")), ",").alias("cells"))


def pairwise_candidates(spark, d):
    _, pairs = _pairs(spark, d)
    swapped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.round("score", 9).alias("score"))
    return P.pairwise_candidates(swapped.unionByName(swapped.select("a", "b", F.lit(None).cast("double").alias("score"))))


def similarity_matrix(spark, d):
    _, pairs = _pairs(spark, d)
    return P.similarity_matrix(pairs.select("a", "b", F.round("score", 9).alias("score")))


def align_candidates(spark, d):
    _, pairs = _pairs(spark, d)
    out = align_pairs(pairs, representatives(spark, d))
    return out.select("a", "b", "score", "n_optimal", F.md5("a_edits").alias("a_md5"), F.md5("b_edits").alias("b_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        word_counts, tokenize_words, tokenize_words_cased, tokenize_ngrams_3, tokenize_ngrams_5, tokenize_skip_ngrams_3_2, tokenize_sentences, squished, short_docs_kept, short_docs_skipped, skip_ngram_skipped,
        file_names, marked_words, hash_sums, minhash_signatures, rehash_seed_2, lsh_buckets_of_documents, lsh_candidates, lsh_query, lsh_subset, lsh_add, lsh_compare, lsh_compare_prescored, lsh_probability_grid,
        lsh_threshold_grid, token_index_of_documents, token_postings_of_documents, token_frequencies, token_index_candidates, token_index_candidates_all, token_index_partners, text_classes, jaccard_pairs, pairwise_measures, matching_tokens_pairs, benchmark_overlap, pairwise_benchmark, pairwise_compare_items, pairwise_candidates,
        similarity_matrix, align_candidates, corpus_tokens, corpus_skip_ngrams, corpus_retokenized, corpus_positions, corpus_meta, pairwise_items, dense_matrix_of_items,
    )
}

# --- the same in SQL ---
_RX = WORD.replace("'", "''")


def _words_sql(text: str = "lower(text)") -> str:
    return f"regexp_extract_all({text}, '{_RX}')"


def _ngrams_sql(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) > {n} THEN list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i : i + {n - 1}], ' ')) ELSE [] END"


def _skip_sql(w: str, n: int, k: int) -> str:
    parts = []
    for gap in range(k, -1, -1):
        width = n + n * gap - gap
        grams = " || ' ' || ".join(f"{w}[i + {j * (gap + 1)}]" for j in range(n))
        parts.append(f"list_transform(range(1, len({w}) - {width} + 2), lambda i: {grams})")
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"CASE WHEN len({w}) >= {n + n * k - k} THEN {out} ELSE [] END"


def _hash_sql(t: str) -> str:
    return f"list_transform({t}, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT)"


def _minhash_sql(h: str, n: int, seed: int) -> str:
    return f"list_transform({random_ints(n, seed)}, lambda r: list_min(list_transform({h}, lambda h: xor(h, r))))"


def _sentences_sql() -> str:
    from ..functions.tokenizers import SENTENCE_STEPS

    q = lambda s: "'" + s.replace("'", "''") + "'"
    e = "text"
    for pattern, by in SENTENCE_STEPS:
        e = f"regexp_replace({e}, {q(pattern)}, {q(by.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2'))}, 'g')"
    e = f"regexp_split_to_array(regexp_replace({e}, '[\x01\x02]\\z', ''), '[\x01\x02]')"
    clean = "lower(trim(regexp_replace(regexp_replace(s, '\\p{P}', ' ', 'g'), '[\\s\\p{Z}\\x{0B}]+', ' ', 'g')))"
    return f"list_transform({e}, lambda s: {clean})"


_W = f"w AS (SELECT doc_id, {_words_sql()} AS w FROM documents WHERE text IS NOT NULL)"
_REPS = "reps AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text)"
_HASHED = f"{_REPS}, rw AS (SELECT doc_id, {_words_sql()} AS w FROM reps), hd AS MATERIALIZED (SELECT doc_id, {_hash_sql(_ngrams_sql('w', N))} AS hashes FROM rw WHERE len(w) >= {minimum_words(N)})"
_SIGNED = f"{_HASHED}, sg AS MATERIALIZED (SELECT doc_id, hashes, {_minhash_sql('hashes', H, SEED)} AS m FROM hd)"
_R = H // BANDS


def _buckets_sql(source: str, m: str = "m") -> str:
    return f"SELECT doc_id AS doc, unnest(list_transform(range(1, {BANDS + 1}), lambda i: md5(i::VARCHAR || '|' || array_to_string({m}[(i - 1) * {_R} + 1 : i * {_R}], ',')))) AS buckets FROM {source}"


_BUCKETS = f"{_SIGNED}, bk AS MATERIALIZED ({_buckets_sql('sg')})"
_CANDIDATES = f"{_BUCKETS}, cd AS (SELECT DISTINCT x.doc AS a, y.doc AS b FROM bk x JOIN bk y ON x.buckets = y.buckets AND x.doc < y.doc)"
_JOINED_HASHES = "JOIN hd x ON x.doc_id = a JOIN hd y ON y.doc_id = b"
_FIVE = f"{_REPS}, rw AS (SELECT doc_id, {_words_sql()} AS w FROM reps), t AS (SELECT DISTINCT doc_id, unnest({_ngrams_sql('w', N)}) AS token FROM rw)"
_ITEMS = f"bw AS (SELECT item_id, {_words_sql()} AS w FROM benchmark), bh AS (SELECT item_id, list_distinct({_hash_sql(_ngrams_sql('w', N))}) AS h FROM bw WHERE len(w) >= {minimum_words(N)})"
_J = "round(len(list_intersect(x.hashes, y.hashes)) / len(list_distinct(list_concat(x.hashes, y.hashes))), 9)"
_PAIRS = f"""{_HASHED}, ht AS MATERIALIZED (SELECT doc_id, len(list_distinct(hashes)) AS n, unnest(list_distinct(hashes)) AS t FROM hd),
pr AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS s FROM ht x JOIN ht y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY 1, 2
  HAVING count(*) / (any_value(x.n) + any_value(y.n) - count(*)) >= {LEAST})"""
_COUNTS = "len(list_filter({b}.hashes, lambda h: list_contains({a}.hashes, h)))"


def _tokens_sql(tokens: str, source: str = _W, name: str = "w") -> str:
    return f"WITH {source}, t AS (SELECT doc_id, {tokens} AS t FROM {name}) SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, '|')) AS tokens_md5 FROM t"


ORACLE = {
    "text_classes": f"WITH {_REPS} SELECT d.doc_id, r.doc_id AS class_id FROM documents d JOIN reps r USING (text)",
    "word_counts": f"SELECT doc_id, len({_words_sql('text')})::INTEGER AS n_words FROM documents",
    "tokenize_words": _tokens_sql("w"),
    "tokenize_words_cased": _tokens_sql("w", f"w AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE text IS NOT NULL)"),
    "tokenize_ngrams_3": _tokens_sql(_ngrams_sql("w", 3)),
    "tokenize_ngrams_5": _tokens_sql(_ngrams_sql("w", 5)),
    "tokenize_skip_ngrams_3_2": _tokens_sql(_skip_sql("w", 3, 2)),
    "tokenize_sentences": _tokens_sql("w", f"w AS (SELECT doc_id, {_sentences_sql()} AS w FROM documents WHERE text IS NOT NULL)"),
    "squished": "SELECT doc_id, md5(trim(regexp_replace(text, '[\\s\\p{Z}\\x{0B}]+', ' ', 'g'))) AS text_md5 FROM documents WHERE text IS NOT NULL",
    "short_docs_kept": f"SELECT doc_id FROM documents WHERE len({_words_sql('text')}) >= 4",
    "short_docs_skipped": f"SELECT doc_id FROM documents WHERE coalesce(len({_words_sql('text')}) < 4, true)",
    "skip_ngram_skipped": f"SELECT doc_id FROM documents WHERE coalesce(len({_words_sql('text')}) < 7, true)",
    "file_names": """SELECT doc_id, CASE WHEN source IS NULL THEN NULL WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE doc_id::VARCHAR || '.mp3' END AS name,
        CASE WHEN source IS NULL THEN NULL ELSE doc_id::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '.mp3' END END AS with_extension FROM documents""",
    "marked_words": f"WITH {_W} SELECT doc_id, md5(array_to_string(list_transform(w, lambda x: repeat('#', len(x))), ' ')) AS marks_md5 FROM w",
    "hash_sums": f"WITH {_W}, h AS (SELECT doc_id, {_hash_sql(_ngrams_sql('w', 3))} AS h FROM w) SELECT doc_id, coalesce(list_sum(h), 0)::BIGINT AS hash_sum, len(h)::INTEGER AS n FROM h",
    "minhash_signatures": f"WITH {_SIGNED} SELECT doc_id, md5(array_to_string(m, ',')) AS signature_md5 FROM sg",
    "rehash_seed_2": f"WITH {_HASHED} SELECT doc_id, md5(array_to_string({_minhash_sql('hashes', 20, 2)}, ',')) AS signature_md5 FROM hd",
    "lsh_buckets_of_documents": f"WITH {_BUCKETS} SELECT doc, buckets FROM bk",
    "lsh_candidates": f"WITH {_CANDIDATES} SELECT a, b, NULL::DOUBLE AS score FROM cd",
    "lsh_query": f"WITH {_BUCKETS} SELECT DISTINCT x.doc AS a, y.doc AS b, NULL::DOUBLE AS score FROM bk x JOIN bk y ON x.buckets = y.buckets AND x.doc <> y.doc WHERE x.doc % 20 = 0",
    "lsh_subset": f"WITH {_CANDIDATES} SELECT a AS doc FROM cd UNION SELECT b FROM cd",
    "lsh_add": f"""WITH {_SIGNED}, st AS (SELECT doc_id, m FROM sg WHERE doc_id % 3 = 1) {_buckets_sql('sg').replace('FROM sg', 'FROM (SELECT doc_id, m FROM sg WHERE doc_id % 3 <> 1 UNION ALL SELECT doc_id, m FROM st)')}""",
    "lsh_compare": f"WITH {_CANDIDATES} SELECT a, b, {_J} AS score FROM cd {_JOINED_HASHES}",
    "lsh_compare_prescored": f"WITH {_CANDIDATES} SELECT a, b, CASE WHEN a % 2 = 0 THEN 0.125 ELSE {_J} END AS score FROM cd {_JOINED_HASHES}",
    "lsh_probability_grid": "SELECT h::INTEGER AS h, b::INTEGER AS b, s, round(1 - pow(1 - pow(s, h / b), b), 9) AS p FROM (SELECT unnest(range(1, 11)) / 10 AS s), (VALUES (200, 50), (240, 80), (100, 25)) v(h, b)",
    "lsh_threshold_grid": "SELECT h::INTEGER AS h, b::INTEGER AS b, round(pow(1 / b, 1 / (h / b)), 9) AS t FROM (VALUES (200, 50), (240, 80), (100, 25)) v(h, b)",
    "token_index_of_documents": f"""WITH {_W}, t AS (SELECT DISTINCT doc_id, unnest({_ngrams_sql('w', 3)}) AS token FROM w)
        SELECT token, count(*) AS n_docs, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS docs_md5 FROM t GROUP BY token HAVING count(*) BETWEEN 2 AND 50""",
    "token_postings_of_documents": f"""WITH {_W}, t AS (SELECT DISTINCT doc_id, unnest({_ngrams_sql('w', 3)}) AS token FROM w)
        SELECT md5(token) AS token_md5, doc_id FROM t WHERE token IN (SELECT token FROM t GROUP BY token HAVING count(*) >= 2)""",
    "token_frequencies": f"WITH {_W}, t AS (SELECT DISTINCT doc_id, unnest({_ngrams_sql('w', 3)}) AS token FROM w) SELECT token, count(*) AS n_docs FROM t GROUP BY token HAVING count(*) >= 2",
    "token_index_candidates": f"""WITH {_REPS}, rw AS (SELECT doc_id, {_words_sql()} AS w FROM reps), t AS (SELECT DISTINCT doc_id, unnest({_ngrams_sql('w', N)}) AS token FROM rw),
        k AS (SELECT token FROM t GROUP BY token HAVING count(*) BETWEEN 2 AND 10), p AS (SELECT * FROM t JOIN k USING (token))
        SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, NULL::DOUBLE AS score FROM p x JOIN p y ON x.token = y.token AND x.doc_id < y.doc_id""",
    "token_index_candidates_all": f"WITH {_FIVE} SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, NULL::DOUBLE AS score FROM t x JOIN t y ON x.token = y.token AND x.doc_id < y.doc_id",
    "token_index_partners": f"WITH {_FIVE} SELECT x.doc_id, count(DISTINCT y.doc_id) AS n_partners FROM t x JOIN t y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY 1",
    "jaccard_pairs": f"WITH {_PAIRS} SELECT a, b, round(s, 9) AS score FROM pr",
    "pairwise_measures": f"""WITH {_PAIRS}, hc AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest(hashes) AS t FROM hd) GROUP BY 1, 2), hn AS (SELECT doc_id, len(hashes) AS n FROM hd),
        m AS (SELECT a, b, any_value(s) AS s, sum(least(x.c, y.c)) AS bag, sum(y.c) AS ab, sum(x.c) AS ba FROM pr JOIN hc x ON x.doc_id = a JOIN hc y ON y.doc_id = b AND x.t = y.t GROUP BY a, b)
        SELECT a, b, round(s, 9) AS jaccard, round(1 - s, 9) AS dissimilarity, round(bag / (p.n + q.n), 9) AS bag, round(ab / q.n, 9) AS ratio_ab, round(ba / p.n, 9) AS ratio_ba, ab::INTEGER AS matches_ab, ba::INTEGER AS matches_ba
        FROM m JOIN hn p ON p.doc_id = a JOIN hn q ON q.doc_id = b""",
    "matching_tokens_pairs": f"""WITH {_PAIRS}, tk AS (SELECT doc_id, {_ngrams_sql('w', N)} AS t FROM rw)
        SELECT a, b, md5(array_to_string(list_filter(y.t, lambda k: list_contains(x.t, k)), '|')) AS matching_md5 FROM pr JOIN tk x ON x.doc_id = a JOIN tk y ON y.doc_id = b""",
    "benchmark_overlap": f"""WITH {_HASHED}, {_ITEMS}, bt AS (SELECT item_id, len(h) AS n, unnest(h) AS t FROM bh), dt AS (SELECT doc_id, unnest(list_distinct(hashes)) AS t FROM hd)
        SELECT item_id, doc_id, count(*) AS matches, round(count(*) / any_value(n), 9) AS ratio FROM bt JOIN dt USING (t) GROUP BY 1, 2""",
    "pairwise_compare_items": f"""WITH {_HASHED}, {_ITEMS}, al AS (SELECT 'i' || item_id AS id, h FROM bh UNION ALL SELECT 'd' || doc_id, list_distinct(hashes) FROM hd)
        SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.h, y.h)) / len(x.h), 9) AS score FROM al x JOIN al y ON x.id <> y.id WHERE x.id LIKE 'i%'""",
    "pairwise_benchmark": f"""WITH {_HASHED}, bw AS (SELECT item_id, {_words_sql()} AS w FROM benchmark), bh AS (SELECT item_id, list_distinct({_hash_sql(_ngrams_sql('w', N))}) AS h FROM bw WHERE len(w) >= {minimum_words(N)}),
        bt AS (SELECT item_id, len(h) AS n, unnest(h) AS t FROM bh), dt AS (SELECT doc_id, unnest(list_distinct(hashes)) AS t FROM hd)
        SELECT item_id, doc_id, count(*) AS matches, round(count(*) / any_value(n), 9) AS ratio FROM bt JOIN dt USING (t) GROUP BY 1, 2 HAVING round(count(*) / any_value(n), 9) >= 0.1""",
    "corpus_tokens": f"WITH c AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents), t AS (SELECT doc_id, {_ngrams_sql('w', 5)} AS t FROM c WHERE len(w) >= 6) SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, '|')) AS tokens_md5 FROM t",
    "corpus_skip_ngrams": f"WITH {_W}, t AS (SELECT doc_id, {_skip_sql('w', 3, 2)} AS t FROM w WHERE len(w) >= 7) SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, '|')) AS tokens_md5 FROM t",
    "corpus_retokenized": f"WITH {_W}, t AS (SELECT doc_id, {_ngrams_sql('w', 4)} AS t FROM w WHERE len(w) >= 6) SELECT doc_id, len(t)::INTEGER AS n, md5(array_to_string(t, '|')) AS tokens_md5 FROM t",
    "corpus_positions": f"SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents WHERE len({_words_sql('text')}) >= 4",
    "corpus_meta": f"SELECT doc_id, 'hash_func=hash_tokens;id=' || doc_id || ';parity=' || (doc_id % 2) || ';tokenizer=ngrams' AS meta FROM documents WHERE len({_words_sql('text')}) >= 4",
    "pairwise_items": f"""WITH bw AS (SELECT item_id, {_words_sql()} AS w FROM benchmark), bh AS (SELECT item_id AS id, {_hash_sql(_ngrams_sql('w', N))} AS h FROM bw WHERE len(w) >= {minimum_words(N)})
        SELECT x.id AS a, y.id AS b, round(len(list_filter(y.h, lambda h: list_contains(x.h, h))) / len(y.h), 9) AS score FROM bh x JOIN bh y ON x.id <> y.id""",
    "dense_matrix_of_items": f"""WITH bw AS (SELECT item_id, {_words_sql()} AS w FROM benchmark), bh AS (SELECT item_id AS id, list_distinct({_hash_sql(_ngrams_sql('w', N))}) AS h FROM bw WHERE len(w) >= {minimum_words(N)}),
        c AS (SELECT x.id AS a, y.id AS b, CASE WHEN x.id = y.id THEN 1.0 ELSE len(list_intersect(x.h, y.h)) / len(list_distinct(list_concat(x.h, y.h))) END AS v FROM bh x JOIN bh y ON true)
        SELECT a AS row, string_agg(round(v * 1e9)::BIGINT::VARCHAR, ',' ORDER BY b) AS cells FROM c GROUP BY a""",
    "pairwise_candidates": f"WITH {_PAIRS} SELECT a, b, round(s, 9) AS score FROM pr",
    "similarity_matrix": f"""WITH {_PAIRS}, q AS (SELECT a, b, round(s, 9) AS v FROM pr) SELECT a AS row, b AS col, v AS value FROM q UNION ALL SELECT b, a, v FROM q
        UNION ALL SELECT x, x, 1.0 FROM (SELECT a AS x FROM q UNION SELECT b FROM q)""",
}
