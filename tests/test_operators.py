"""LSH, index, pairwise, alignment, salted aggregation."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import similarity as S
from palimpsest.functions.hashing import hash_tokens, minhash_of_hashes
from palimpsest.functions.tokenizers import shingle, words
from palimpsest.operators import index as I, lsh as L, pairwise as P, salted
from palimpsest.operators.align import Scores, align_pairs, align_words, show_alignment

TEXTS = [
    ("a", "the quick brown fox jumps over the lazy dog and then runs far away from here"),
    ("b", "the quick brown fox jumps over the lazy dog and then runs far away from there"),
    ("c", "an entirely different text about ships and harbours that shares no phrase at all"),
    ("d", None),
    ("e", "short"),
]


def signed(spark, h=40, seed=1, rows=TEXTS):
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumn("w", words(F.col("text")))
    df = df.withColumn("tokens", shingle(F.col("w"), 3)).withColumn("hashes", hash_tokens(F.col("tokens")))
    return df.withColumn("minhashes", minhash_of_hashes(F.col("hashes"), h, seed))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_banding(spark):
    with pytest.raises(ValueError, match="evenly divisible"):
        L.check_banding(200, 33)
    assert [list(r) for r in L.band_seq(6, 3)] == [[0, 1], [2, 3], [4, 5]]
    assert L.lsh_threshold(240, 80) == pytest.approx(0.232, abs=5e-4)
    assert L.lsh_probability(200, 50, 0.4503) == pytest.approx(0.877, abs=1e-3)


def test_lsh_flow(spark):
    s = signed(spark)
    b = L.lsh(s, 20, 40)
    assert b.columns == ["doc", "buckets"] and b.count() == 60
    c = L.lsh_candidates(b)
    assert rows(c.select("a", "b")) == [("a", "b")] and c.first().score is None
    assert rows(L.lsh_subset(c)) == [("a",), ("b",)]
    assert rows(L.lsh_query(b, spark.createDataFrame([("b",), ("zz",)], "x string")).select("a", "b")) == [("b", "a")]
    scored = L.lsh_compare(c, s, S.jaccard_similarity).first()
    assert scored.score == pytest.approx(13 / 15)
    kept = L.lsh_compare(c.withColumn("score", F.lit(0.5)), s, S.jaccard_similarity).first()
    assert kept.score == 0.5
    nan = L.lsh_compare(c.withColumn("score", F.lit(float("nan"))), s, S.jaccard_similarity).first()
    assert nan.score == pytest.approx(13 / 15)


def test_lsh_add_equals_full_build(spark):
    s = signed(spark)
    part = L.lsh(s.where("doc_id != 'b'"), 20, 40)
    full = rows(L.lsh(s, 20, 40))
    assert rows(L.lsh_add(part, s.where("doc_id = 'b'"), 20, 40)) == full
    assert rows(L.lsh_add(L.lsh(s, 20, 40), s.where("doc_id = 'b'"), 20, 40)) == full


def test_lsh_rejects_other_lengths(spark):
    with pytest.raises(Exception, match="signature has not 80"):
        L.lsh(signed(spark), 20, 80).collect()


def test_token_index(spark):
    df = spark.createDataFrame([("a", ["one two", "two three"]), ("b", ["one two", "two three", "one two"]), ("c", ["x y"]), ("n", None), ("m", [None])], "doc_id string, tokens array<string>")
    idx = I.token_index(df)
    assert rows(idx) == [("one two", ["a", "b"], 2), ("two three", ["a", "b"], 2)]
    assert I.token_index(df, most=1).count() == 0
    assert rows(I.token_index_candidates(idx).select("a", "b")) == [("a", "b")]
    assert rows(I.token_index_candidates(I.token_postings(df)).select("a", "b")) == [("a", "b")]
    assert I.token_index_candidates(I.token_index(df.limit(0))).count() == 0


def test_similar_pairs_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", words(F.col("text")).alias("w"))
    h = docs.select("doc_id", hash_tokens(shingle(F.col("w"), 3)).alias("hashes")).where("size(hashes) > 0")
    sets = {r.doc_id: set(r.hashes) for r in h.collect()}
    for least in (0.2, 0.6):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        got = P.similar_pairs(h, least)
        assert {(r.a, r.b) for r in got.collect()} == want


def test_pairwise(spark):
    s = signed(spark)
    m = P.pairwise_compare(s, S.jaccard_similarity)
    assert m.count() == 10
    both = P.pairwise_compare(s, S.ratio_of_matches, directional=True)
    assert both.count() == 20
    three = both.where("a in ('a','b','c') and b in ('a','b','c')")
    assert P.pairwise_candidates(three).count() == 6
    assert P.pairwise_candidates(m).where("a > b").count() == 0
    with pytest.raises(ValueError, match="similar_pairs"):
        P.pairwise_compare(s, S.jaccard_similarity, most=3)
    q = P.pairwise_compare(s, S.jaccard_similarity, queries=spark.createDataFrame([("a",)], "x string"))
    assert q.count() == 4


def test_matrix(spark):
    c = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.7), ("b", "c", 0.0)], "a string, b string, score double")
    coo = {(r.row, r.col): r.value for r in P.similarity_matrix(c).collect()}
    assert coo[("a", "b")] == coo[("b", "a")] == 0.7 and coo[("a", "a")] == 1 and len(coo) == 7
    dense = {r["row"]: r for r in P.dense_matrix(c).collect()}
    assert dense["a"]["c"] == 0 and dense["a"]["b"] == 0.7 and dense["c"]["c"] == 1


ALIGN = [
    ("How can we tell if this is a match, he asked?", "Surely, this is a good match, she replied.", False, "this is a #### match", "this is a good match", 7),
    ("'How do I know', she asked, 'if this is a good match?'", "'This is a match', he replied.", False, "this is a good match", "This is a #### match", 7),
    ("abc", "xyz", False, "", "", 0),
    ("Hello, world! This is a match.", "hello world this is a match", True, "Hello, world! This is a match.", "hello world this is a match", 12),
    ("The answer is blowin' in the wind.", "As the Bob Dylan song says, the answer is blowing in the wind.", False, "The answer is blowin ####### in the wind", "the answer is ###### blowing in the wind", 11),
]


@pytest.mark.parametrize("case", ALIGN)
def test_alignment(spark, case):
    a, b, punct, ea, eb, score = case
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    r = align_pairs(spark.createDataFrame([(1, 2)], "a long, b long"), docs, preserve_punctuation=punct).first()
    assert (r.a_edits, r.b_edits, r.score) == (ea, eb, score)


def test_alignment_in_blocks_is_the_same():
    import random

    rng = random.Random(5)
    for _ in range(20):
        a, b = ([rng.choice("pqrst") for _ in range(rng.randint(1, 40))] for _ in range(2))
        whole = align_words(a, b, a, b)
        assert all(align_words(a, b, a, b, block=k) == whole for k in (1, 3, 7))
    assert align_words([], [], [], [])["score"] == 0


def test_alignment_parameters():
    for bad in ({"match": 0}, {"mismatch": 1}, {"gap": 2}, {"edit_mark": "##"}, {"match": 1.5}):
        with pytest.raises(ValueError):
            Scores(**bad)
    assert "Alignment score: 7" in show_alignment("a " * 60, "b", 7)


def test_salted_counts(spark):
    hot = [("hot", [str(i % 7), None, str(i % 3)], i) for i in range(300)] + [("hot", None, 0), ("hot", [], 0)]
    cold = [(f"t{i}", ["x", "x"], i) for i in range(50)] + [(None, ["x"], 1)]
    df = spark.createDataFrame(hot + cold, "token string, docs array<string>, n_rows int")
    got = {r.token: r for r in salted.keyed_record_counts(df, "token", "docs", share=0.05).collect()}
    assert got["hot"].n_rows == 302 and got["hot"].n_refs == 600 and got["hot"].n_records == 7 and got["hot"].heavy
    assert got["t3"].n_rows == 1 and got["t3"].n_refs == 2 and got["t3"].n_records == 1 and not got["t3"].heavy
    assert len(got) == 51 and salted.keyed_record_counts(df.limit(0), "token", "docs").count() == 0


def test_heavy_keys_come_out_of_the_salted_stages(spark, sf):
    from palimpsest.plans.skew import p7_found

    plan = p7_found(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "__salt" in plan and "explode" in plan and "docs" in plan and plan.count("token_index.parquet") == 1


def test_salted_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(200)] + [(i, i) for i in range(2, 40)] + [(None, 7)], "k int, v int")
    right = spark.createDataFrame([(i, i * 10) for i in range(1, 30)], "k int, w int")
    for how, n in (("inner", 200 + 28), ("left", 239)):
        got = salted.salted_join_unique(left, right, "k", how)
        assert got.count() == n and got.where("w != k * 10").count() == 0


def test_hot_tokens_make_candidates_and_partners(spark):
    """A family of 40 documents whose only common token is in all of them, beside random ones; blocks and bit sets in use."""
    import random

    rng = random.Random(7)
    docs = [(n, [1] * (n < 40) + [rng.randrange(1000, 1060) for _ in range(rng.randrange(0, 4))] + [10_000 + n]) for n in range(90)]
    docs += [(90, []), (91, None), (92, [None, 1])]
    sets = {i: set(t or []) - {None} for i, t in docs}
    pairs = {(a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    df = spark.createDataFrame(docs, "doc_id long, hashes array<bigint>")
    got = I.token_index_candidates(I.token_postings(df, tokens="hashes"), each=7).collect()
    assert len(got) == len(pairs) and {(r.a, r.b) for r in got} == pairs
    want = {i: n for i in sets if (n := sum(i in p for p in pairs))}
    for each, dense in ((1000, 256), (20, 3), (8, 0)):
        assert {r.doc: r.n_partners for r in I.token_index_partners(df, each=each, dense=dense).collect()} == want
    assert I.token_index_partners(df.limit(0)).count() == 0


def test_pairs_of_the_whole_index_make_no_rows_of_tokens(spark):
    """Copies share many tokens: pairs come once, from blocks of any size, with ids of any kind, and are joined nowhere."""
    import random

    rng = random.Random(3)
    docs = [(f"d{n % 97}", [f"all {n % 2}"] * (n % 3) + [f"t{rng.randrange(900)}" for _ in range(rng.randrange(0, 5))] + [f"c{n % 15} {k}" for k in range(30 * (n % 4 == 0))]) for n in range(120)]
    docs += [("none", None), ("empty", []), ("null", [None]), ("alone", ["x", "x"]), (None, ["all 0"])]
    sets = {}
    for i, t in docs:
        sets.setdefault(i, set()).update(set(t or []) - {None})
    pairs = sorted((a, b) for a in sets for b in sets if a and b and a < b and sets[a] & sets[b])
    df = spark.createDataFrame(docs, "id string, t array<string>")
    for each, of_part, dense in ((1000, 1000, 64), (20, 30, 3), (7, 10, 0)):
        got = I.token_index_pairs(df, "id", "t", each=each, of_part=of_part, dense=dense)
        assert got.dtypes == [("a", "string"), ("b", "string"), ("score", "double")]
        assert sorted((r.a, r.b) for r in got.collect()) == pairs
    assert I.token_index_pairs(df.limit(0), "id", "t").count() == 0


def test_whole_index_query_moves_no_pairs(spark, sf):
    from palimpsest.plans import registry

    plan = registry.queries()["token_index_candidates_all"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert not [x for x in ("Join", "Aggregate", "Repartition") if x in above]


def slow_alignment(a, b, match=2, mismatch=-1, gap=-1):
    """The definition, cell by cell: a matrix of lists, the first best cell by column, the walk back to the largest neighbour."""
    m = [[0] * (len(a) + 1) for _ in range(len(b) + 1)]
    for i in range(1, len(b) + 1):
        for j in range(1, len(a) + 1):
            m[i][j] = max(0, m[i - 1][j - 1] + (match if a[j - 1] == b[i - 1] else mismatch), m[i - 1][j] + gap, m[i][j - 1] + gap)
    best = max(map(max, m))
    if not best:
        return "", "", 0, 0
    places = [(j, i) for i in range(len(b) + 1) for j in range(len(a) + 1) if m[i][j] == best]
    j, i = min(places)
    left, right = [a[j - 1]], [b[i - 1]]
    while m[i - 1][j - 1]:
        top = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1])
        if m[i - 1][j] == top:
            i -= 1
            left.append("#" * len(b[i - 1]))
            right.append(b[i - 1])
        elif m[i][j - 1] == top:
            j -= 1
            left.append(a[j - 1])
            right.append("#" * len(a[j - 1]))
        else:
            i, j = i - 1, j - 1
            x, y = a[j - 1], b[i - 1]
            left += [x] if x == y else ["#" * len(y), x]
            right += [y] if x == y else [y, "#" * len(x)]
    return " ".join(left[::-1]), " ".join(right[::-1]), best, len(places)


def test_alignment_equals_the_definition(spark):
    import random

    rng = random.Random(17)
    texts = [" ".join(rng.choice(["an", "bee", "sea", "delta", "e"]) for _ in range(rng.randint(0, 14))) for _ in range(40)]
    pairs = [(x, y) for x in range(40) for y in range(40) if x < y and rng.random() < 0.3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = align_pairs(spark.createDataFrame(pairs, "a long, b long"), docs).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert (r.a_edits, r.b_edits, r.score, r.n_optimal) == slow_alignment(texts[r.a].split(), texts[r.b].split())


def test_hot_bucket_is_split(spark):
    rows = [(n, "hot") for n in range(300)] + [(n, f"b{n // 2}") for n in range(300)] + [(7, None)]
    b = spark.createDataFrame(rows, "doc long, buckets string")
    got = L.lsh_candidates(b, each=32)
    assert got.count() == 300 * 299 // 2
    q = L.lsh_query(b, spark.createDataFrame([(5,), (999,)], "x long"))
    assert q.count() == 299 and {r.a for r in q.collect()} == {5}
    pairs = salted.split_join(spark.createDataFrame([("hot", 1), ("b0", 2), ("none", 3)], "k string, a int"), b.withColumnRenamed("buckets", "k"), "k", "doc", each=10)
    assert pairs.where("a = 1").count() == 300 and pairs.where("a = 2").count() == 2 and pairs.where("a = 3").count() == 0


def test_bound_of_a_broadcast(spark):
    s = signed(spark)
    with pytest.raises(ValueError, match="elements"):
        P.pairwise_compare(s, S.jaccard_similarity, elements=10)


def test_sink(spark, tmp_path):
    from palimpsest.sources.text import write_table

    df = spark.createDataFrame([(n, f"b{n % 3}") for n in range(30)], "doc long, buckets string")
    for options in ({}, {"bucket_column": "buckets"}, {"bucket_column": "buckets", "parts": 4}):
        write_table(df, str(tmp_path / "t"), **options)
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == sorted(map(tuple, df.collect()))


def test_signatures_equal_the_expression(spark):
    rows = [(n, [(n * k * 2654435761) % 2**32 for k in range(n % 7)], "x") for n in range(40)] + [(50, None, "x"), (51, [None], "x"), (52, [5, None, 9], "x")]
    df = spark.createDataFrame(rows, "doc_id long, hashes array<bigint>, sig string")
    want = {r.doc_id: r.m for r in df.select("doc_id", minhash_of_hashes(F.col("hashes"), 12, 3).alias("m")).collect()}
    for block in (1, 3, 256):
        got = {r.doc_id: r.minhashes for r in L.sign(df, 12, 3, rows=block).collect()}
        assert {k: v for k, v in got.items() if k != 51} == {k: v for k, v in want.items() if k != 51} and got[51] is None
    assert L.sign(df.limit(0), 12).count() == 0
