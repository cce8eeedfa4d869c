"""Corpus construction, accessors, sources, streaming."""

import pytest
from pyspark.sql import functions as F

from palimpsest.corpus import Corpus, is_candidates, is_corpus, is_document, is_documents, is_lsh_buckets
from palimpsest.functions import hashing, tokenizers as T
from palimpsest.operators.lsh import lsh
from palimpsest.sources import text as sources
from palimpsest.streaming.lsh_stream import bucket_rows, current_buckets, stream_buckets, stream_matches


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_skipping(spark):
    texts = {"short-a": "Too short", "long": "Just long enough yo", "short-b": "No"}
    c = Corpus.from_texts(spark, texts)
    assert ids(c.names()) == ["long"] and ids(c.skipped) == ["short-a", "short-b"]
    every = Corpus.from_texts(spark, texts, skip_short=False)
    assert len(every) == 3 and ids(every.skipped) == []
    skip = Corpus.from_texts(spark, {"five": "a b c d e", "seven": "a b c d e f g"}, tokenizer=lambda t: T.skip_ngrams(t, 3, 2), k=2)
    assert ids(skip.names()) == ["seven"]


def test_ids_and_files(spark, tmp_path):
    assert ids(Corpus.from_texts(spark, ["one two three four", "five six seven eight"]).names()) == ["doc-1", "doc-2"]
    (tmp_path / "x one.txt").write_bytes("﻿one two three four\nfive\n".encode())
    (tmp_path / "y.mp3").write_text("six seven eight nine")
    c = Corpus.from_dir(spark, str(tmp_path))
    assert ids(c.names()) == ["x one", "y.mp3"]
    assert c.document("x one").content == "one two three four\nfive"
    assert ids(Corpus.from_paths(spark, [str(tmp_path / "y.mp3")]).names()) == ["y.mp3"]
    (tmp_path / "y.mp3").write_bytes("café au lait chaud".encode("latin-1"))
    assert Corpus.from_paths(spark, [str(tmp_path / "y.mp3")], encoding="ISO-8859-1").document("y.mp3").content.startswith("café")
    with pytest.raises(ValueError):
        sources.from_paths(spark, [])
    with pytest.raises(ValueError, match="unique"):
        Corpus.of(sources.from_texts(spark, ["a b c d"]).unionByName(sources.from_texts(spark, ["a b c d"])), unique=True)


def test_slots(spark):
    texts = {"a": "one two three four five", "b": "two three four five six"}
    c = Corpus.from_texts(spark, texts, keep_tokens=True, minhash_func=hashing.minhash_generator(8, 3), meta={"z": "1", "b": "2"})
    assert is_corpus(c) and is_documents(c.docs) and list(c.meta) == ["b", "z"]
    assert c.has("tokens") and c.has("minhashes") and len(c.document("a").minhashes) == 8
    bare = Corpus.from_texts(spark, texts, keep_text=False)
    assert not bare.has("tokens") and not bare.has("content") and bare.has("hashes") and not bare.has("minhashes")
    with pytest.raises(Exception, match="keep their tokens"):
        bare.rehash(hashing.hash_tokens).docs.collect()
    again = c.tokenize(lambda t: T.ngrams(t, 2))
    assert again.document("a").tokens[0] == "one two" and again.document("a").minhashes is None
    assert c.rehash(hashing.minhash_generator(4, 9), "minhashes").document("a").minhashes != c.document("a").minhashes[:4]
    assert ids(c.subset(["a"]).names()) == ["a"] and c.subset(["a"]).meta == c.meta
    assert ids(c.subset(spark.createDataFrame([("b",)], "x string")).names()) == ["b"]
    assert c.document("nope") is None
    assert ids(c.rename(spark.createDataFrame([("a", "n")], "old string, new string")).names()) == ["b", "n"]
    assert c.doc_meta("id").where("doc_id = 'a'").first().id == "a" and c.with_meta(k="v").meta["k"] == "v"
    assert "Corpus(" in repr(c) and not is_lsh_buckets(c.docs) and not is_candidates(c.docs)


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "four words are here", "z")], "doc_id long, text string, tokens string")
    c = Corpus.from_dataframe(df)
    assert ids(c.names()) == [3] and ids(c.skipped) == [1, 2]
    assert len(Corpus.from_dataframe(df.limit(0))) == 0


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(str(i), " ".join(f"w{(i // 2) * 30 + j}" for j in range(12))) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    src = str(tmp_path / "in")
    docs.where("doc_id < '4'").coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema("doc_id string, text string").parquet(src)
    out, cp = str(tmp_path / "buckets"), str(tmp_path / "cp")
    stream_buckets(stream(), out, cp, h=40, bands=20).awaitTermination()
    docs.where("doc_id >= '4'").coalesce(1).write.mode("append").parquet(src)
    stream_buckets(stream(), out, cp, h=40, bands=20).awaitTermination()
    batch = bucket_rows(docs, 5, 40, 20, 42, "doc_id", "text")
    assert sorted(map(tuple, current_buckets(spark, out).collect())) == sorted(map(tuple, batch.collect()))
    q = stream_matches(stream(), batch, h=40, bands=20).writeStream.format("memory").queryName("matches").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.a, r.b) for r in spark.table("matches").collect()}
    assert ("0", "1") in got and ("1", "0") in got and ("0", "2") not in got
    assert current_buckets(spark, str(tmp_path / "none")).count() == 0


def test_arguments_reach_the_tokenizer(spark):
    texts = {"six": "One Two three four five six", "five": "one two three four five", "eight": "a b c d e f g h"}
    c = Corpus.from_texts(spark, texts, n=5, keep_tokens=True, lowercase=False)
    assert ids(c.names()) == ["eight", "six"] and ids(c.skipped) == ["five"]
    assert c.document("six").tokens == ["One Two three four five", "Two three four five six"]
    skip = Corpus.from_texts(spark, texts, tokenizer=T.skip_ngrams, n=3, k=2, keep_tokens=True)
    assert ids(skip.names()) == ["eight"] and skip.document("eight").tokens[0] == "a d g"
    # without arguments skip n-grams have n 3 and k 1, so five words are enough
    assert ids(Corpus.from_texts(spark, texts, tokenizer=T.skip_ngrams).skipped) == []
    assert ids(Corpus.from_texts(spark, texts, tokenizer=T.words, n=7).names()) == ["eight"]
    assert c.tokenize(T.ngrams, n=6).document("eight").tokens[0] == "a b c d e f"
    with pytest.raises(TypeError, match="nope"):
        Corpus.from_texts(spark, texts, nope=1)


def test_repeated_ids_are_an_error(spark):
    twice = sources.from_texts(spark, ["a b c d"]).unionByName(sources.from_texts(spark, ["a b c d"]))
    with pytest.raises(ValueError, match="unique"):
        Corpus.of(twice)
    assert len(Corpus.of(twice, unique=False)) == 2


def test_setters(spark):
    c = Corpus.from_texts(spark, {"a": "one two three four", "b": "five six seven eight"}, keep_tokens=True)
    d = c.with_slot("hashes", F.array(F.lit(7))).with_slot("content", spark.createDataFrame([("a", "new")], "i string, t string"))
    assert d.document("a").hashes == [7] and d.document("a").content == "new" and d.document("b").content is None
    assert {r.doc_id: r.has for r in d.has_each("content").collect()} == {"a": True, "b": False}
    m = c.with_doc_meta("lang", F.lit("en")).with_doc_meta("id", spark.createDataFrame([("a", "x")], "i string, v string"))
    assert m.document("a").meta["id"] == "x" and "id" not in m.document("b").meta and m.document("b").meta["lang"] == "en" and list(m.document("a").meta) == sorted(m.document("a").meta)
    with pytest.raises(ValueError, match="slot"):
        c.with_slot("nope", F.lit(1))


def test_documents(spark):
    c = Corpus.from_texts(spark, {"a": "one two three four " + "long " * 80})
    doc = c.document("a")
    assert is_document(doc) and not is_document(c) and doc.has("content") and not doc.has("tokens") and str(doc).startswith("one two")
    assert len(repr(doc).split("content: ")[1]) == 200 and "tokenizer: ngrams" in repr(doc)
    other = doc.with_slots(tokens=["x"], meta={"k": "v"})
    assert other.tokens == ["x"] and other.meta["k"] == "v" and doc.tokens is None
    assert is_documents(other.to_frame(spark)) and other.to_frame(spark).first().tokens == ["x"]
    with pytest.raises(ValueError, match="slot"):
        doc.has("nope")


def test_positions(spark):
    c = Corpus.from_texts(spark, [f"one two three {n}" for n in range(25)], meta={"k": "v"})
    names = sorted(f"doc-{n}" for n in range(1, 26))
    assert [r.doc_id for r in c.positions().orderBy("position").collect()] == names
    assert sorted(r.position for r in c.positions().collect()) == list(range(25))
    assert ids(c.take([0, 24]).names()) == [names[0], names[24]] and c.take([0]).meta == c.meta


def test_jobs_have_groups(spark):
    from palimpsest.runtime import cancel, job

    with job(spark, "load", "loading documents"):
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "load"
        assert spark.range(3).count() == 3
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    cancel(spark, "load")


def test_versions_of_a_document_in_one_batch(spark, tmp_path):
    rows = [("a", " ".join(f"old{n}" for n in range(9)), 1), ("a", " ".join(f"new{n}" for n in range(9)), 2), ("b", " ".join(f"b{n}" for n in range(9)), 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, v int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream_buckets(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), out, str(tmp_path / "cp"), h=20, bands=10, order_col="v").awaitTermination()
    want = bucket_rows(df.where("v = 2 or doc_id = 'b'"), 5, 20, 10, 42, "doc_id", "text")
    assert sorted(map(tuple, current_buckets(spark, out).collect())) == sorted(map(tuple, want.collect()))
