"""Tokenizers, hashes and similarity: golden values and properties."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import hashing, similarity as S, text as X, tokenizers as T

SENTENCE = "This is a sentence which has a number of words in it; also some\n             tricky puncuation and spacing. Does it work?"


def one(spark, column, **cols):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_words_and_case(spark):
    s = F.lit("There are several; WORDS here")
    assert one(spark, T.words(s)) == ["there", "are", "several", "words", "here"]
    assert one(spark, T.words(s, False)) == ["There", "are", "several", "WORDS", "here"]
    assert one(spark, T.words(F.lit("don't l’eau 3.14 1,000 4th set-off a---b c:d §"))) == ["don't", "l’eau", "3.14", "1,000", "4th", "set", "off", "a", "b", "c", "d"]
    assert one(spark, T.words(F.lit(None).cast("string"))) is None
    assert one(spark, T.words(F.lit(""))) == []


def test_ngrams(spark):
    got = one(spark, T.ngrams(F.lit(SENTENCE), 5))
    assert len(got) == 17 and got[0] == "this is a sentence which" and got[-1] == "and spacing does it work"
    assert one(spark, T.ngrams(F.lit("This is a Capital Word."), 4, lowercase=False)) == ["This is a Capital", "is a Capital Word"]
    assert one(spark, T.ngrams(F.lit("one two three"), 3)) == []
    with pytest.raises(Exception, match="more than 3 words"):
        one(spark, T.ngrams(F.lit("one two three"), 3, strict=True))


def test_skip_ngrams(spark):
    s = F.lit("How many roads must a man walk down")
    got = one(spark, T.skip_ngrams(s, 3, 2))
    assert got[:2] == ["how must walk", "many a down"] and got[-1] == "man walk down" and len(got) == 2 + 4 + 6
    assert one(spark, T.skip_ngrams(s, 5, 0)) == one(spark, T.ngrams(s, 5))
    assert one(spark, T.skip_ngrams(F.lit("a b c d e f"), 3, 2)) == []
    assert (T.minimum_words(3), T.minimum_words(3, 2)) == (4, 7)


def test_sentences(spark):
    assert one(spark, T.sentences(F.lit("This is a---sentence. This too."))) == ["this is a sentence", "this too"]
    assert one(spark, T.sentences(F.lit("This is the text. But also this."), False)) == ["This is the text", "But also this"]


def test_word_count(spark):
    assert one(spark, T.word_count(F.lit("One two three four five six seven; all good children go to heaven."))) == 13


def test_hashes(spark):
    tokens = F.array(*[F.lit(x) for x in ("a", "b", "a")])
    h = one(spark, hashing.hash_tokens(tokens))
    assert h[0] == h[2] != h[1] and all(0 <= x < 2**32 for x in h) and h[0] == int("0cc175b9", 16)
    f, g = hashing.minhash_generator(50, 1), hashing.minhash_generator(50, 2)
    a, b, c = one(spark, f(tokens)), one(spark, f(tokens)), one(spark, g(tokens))
    assert a == b and len(a) == 50 and all(x != y for x, y in zip(a, c))
    assert one(spark, hashing.minhash_generator(20, 1)(tokens)) == a[:20]
    assert a == [min(x ^ r for x in h) for r in hashing.random_ints(50, 1)]
    assert one(spark, hashing.minhash_of_hashes(F.array().cast("array<bigint>"))) is None


def arr(*x):
    return F.array(*[F.lit(v) for v in x])


def test_similarity_goldens(spark):
    assert one(spark, S.jaccard_similarity(arr(1, 2, 3), arr(2, 3, 4))) == 0.5
    assert one(spark, S.jaccard_similarity(arr("a", "b", "c"), arr("b", "c"))) == pytest.approx(2 / 3)
    assert one(spark, S.jaccard_dissimilarity(arr("a", "b", "c"), arr("b", "c"))) == pytest.approx(1 / 3)
    assert one(spark, S.jaccard_bag_similarity(arr("a", "a", "a", "b"), arr("a", "a", "b", "b", "c"))) == pytest.approx(1 / 3)
    a, b = arr(1, 2, 3, 4), arr(3, 4, 5)
    assert one(spark, S.ratio_of_matches(a, b)) == pytest.approx(2 / 3)
    assert one(spark, S.count_matches(a, b)) == 2 and one(spark, S.matching_tokens(a, b)) == [3, 4]
    assert one(spark, S.matching_tokens(arr("a", "b"), arr("a", "a", "c"))) == ["a", "a"]


def test_similarity_of_nothing(spark):
    none, empty = F.lit(None).cast("array<int>"), F.array().cast("array<int>")
    assert math.isnan(one(spark, S.jaccard_similarity(empty, empty)))
    assert math.isnan(one(spark, S.ratio_of_matches(arr(1), empty)))
    for f in (S.jaccard_similarity, S.jaccard_bag_similarity, S.ratio_of_matches, S.count_matches):
        assert one(spark, f(none, arr(1))) is None
    assert one(spark, S.jaccard_similarity(F.array(F.lit(1), F.lit(None)), arr(1))) == 1.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=8), st.lists(st.integers(0, 6), min_size=1, max_size=8))
def test_similarity_properties(spark, a, b):
    x, y = arr(*a), arr(*b)
    r = spark.range(1).select(S.jaccard_similarity(x, y).alias("j"), S.jaccard_similarity(y, x).alias("k"), S.jaccard_bag_similarity(x, y).alias("bag"), S.ratio_of_matches(x, x).alias("self"), S.ratio_of_matches(x, y).alias("r")).first()
    assert r.j == r.k == len(set(a) & set(b)) / len(set(a) | set(b))
    assert r.bag <= 0.5 and r["self"] == 1 and r.r == sum(v in a for v in b) / len(b)


def test_text_helpers(spark):
    names = [one(spark, X.filenames(F.lit(p))) for p in ("/a/one.txt", "two.md", "x/three", "y/four.mp3", "five.tar.gz")]
    assert names == ["one", "two", "three", "four.mp3", "five.tar"]
    assert one(spark, X.filenames(F.lit("/a/one.txt"), True)) == "one.txt"
    assert one(spark, X.as_string(F.lit("﻿a\nb\n"))) == "a\nb"
    assert one(spark, X.mark_chars(F.lit("word"))) == "####"
    assert one(spark, X.squish(F.lit("  a \n\t b "))) == "a b"


def test_counts_on_repeated_elements(spark):
    import random

    from palimpsest.functions import similarity as S

    rng = random.Random(3)
    rows = [([rng.choice("abcdef") for _ in range(rng.randrange(0, 12))], [rng.choice("cdefgh") for _ in range(rng.randrange(0, 12))]) for _ in range(60)]
    rows += [(["a", None, "a"], ["a", None]), (None, ["a"]), (["a"], None), ([], [])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = df.select("a", "b", S.count_matches(F.col("a"), F.col("b")).alias("n"), S.jaccard_bag_similarity(F.col("a"), F.col("b")).alias("bag"), S.matching_tokens(F.col("a"), F.col("b")).alias("m")).collect()
    for r in got:
        if r.a is None or r.b is None:
            assert r.n is None and r.bag is None
            continue
        a, b = [x for x in r.a if x is not None], [x for x in r.b if x is not None]
        assert r.n == sum(x in a for x in b)
        assert [x for x in r.m if x is not None] == [x for x in b if x in a]
        if a or b:
            assert abs(r.bag - sum(min(a.count(x), b.count(x)) for x in set(a)) / (len(a) + len(b))) < 1e-12
