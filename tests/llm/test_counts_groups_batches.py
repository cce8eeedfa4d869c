"""Term counts under deltas, groups of links, batches against history."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.llm.batches import BatchIndex, rejected_records
from palimpsest.llm.groups import link_groups
from palimpsest.llm.term_counts import TermCounts, mark_terms

INDEX = "token string, docs array<string>, n_docs long, doc string, bucket string"


def counted(rows):
    n, docs = defaultdict(int), defaultdict(set)
    for t, d in rows:
        t = (t or "").strip().lower()
        if t:
            n[t] += 1
            docs[t] |= {x for x in d or [] if x is not None}
    return {t: (n[t], len(docs[t])) for t in n}


def state(counts):
    return {r.token: (r.n_rows, r.n_records) for r in counts.counts().collect()}


def test_deltas_equal_a_full_count(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", " A ", "b", "c\t", "", None, "dd"]), rng.choice([None, [], ["x"], ["x", "x", None], ["y", "z"], [str(rng.randint(0, 9))]])) for _ in range(200)]
    frame = lambda r: spark.createDataFrame([(t, d, 0, "q", "q") for t, d in r], INDEX)
    c = TermCounts(spark)
    assert state(c) == {}
    c.apply(frame(rows[:120]))
    assert state(c) == counted(rows[:120])
    c.apply(frame(rows[120:]))
    assert state(c) == counted(rows)
    # deletions of some rows and a change of others in one signed delta
    signed = frame(rows[:50]).withColumn("s", F.lit(-1)).unionByName(frame([("new", ["x"])] + rows[:10]).withColumn("s", F.lit(1)))
    c.apply(signed, sign="s")
    assert state(c) == counted(rows[:10] + rows[50:] + [("new", ["x"])])
    c.apply(frame(rows[:1]).limit(0))
    assert state(c) == counted(rows[:10] + rows[50:] + [("new", ["x"])])
    again = TermCounts(spark, c.path)
    assert state(again) == state(c)
    c.apply(frame(rows[:10] + rows[50:] + [("new", ["x"])]).withColumn("s", F.lit(-1)), sign="s")
    assert state(c) == {}


def test_deletion_before_addition(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "token string, docs array<string>, s int")
    c = TermCounts(spark)
    c.apply(frame(("x", ["a"], -1), ("y", ["a"], 1)), sign="s")
    assert state(c) == {"y": (1, 1)}
    c.apply(frame(("x", ["a"], 1)), sign="s")
    assert state(c) == {"y": (1, 1)}
    c.apply(frame(("x", ["a"], 1)), sign="s")
    assert state(c) == {"y": (1, 1), "x": (1, 1)}


def test_a_lost_driver_leaves_the_last_whole_state(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "token string, docs array<string>")
    c = TermCounts(spark)
    c.apply(frame(("x", ["a"])))
    lost = TermCounts(spark, c.path)
    lost._merge = lambda part: None  # the parts are written, the manifest isn't
    lost.apply(frame(("x", ["b"]), ("z", ["b"])))
    again = TermCounts(spark, c.path)
    assert state(again) == {"x": (1, 1)}
    again.apply(frame(("x", ["b"])))
    assert state(again) == {"x": (2, 2)}


def test_parts_grow_with_the_logarithm_and_a_delta_reads_its_buckets(spark):
    c = TermCounts(spark, each=5)
    for n in range(9):
        c.apply(spark.createDataFrame([(f"t{k}", [f"d{n}-{k}"]) for k in range(40 if n == 0 else 1)], "token string, docs array<string>"))
        assert c.parts() <= 4
    assert c.buckets == 8 and state(c)["t0"] == (9, 9) and len(state(c)) == 40


def test_marks(spark):
    counts = spark.createDataFrame([("none", 1, 0), ("two", 9, 2), ("three", 9, 3), ("edge", 9, 4), ("over", 9, 5)], "token string, n_rows long, n_records long")
    n = spark.createDataFrame([(20,)], "n long")
    assert {(r.token, r.mark) for r in mark_terms(counts, n).collect()} == {("none", "rare"), ("two", "rare"), ("over", "common")}


def closure(pairs):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def grouped(spark, pairs):
    df = spark.createDataFrame([(a, b, None, "x") for a, b in pairs], "a string, b string, score double, v string")
    rows = link_groups(df).collect()
    assert len(rows) == len({r.doc for r in rows})
    return {r.doc: r.group_doc for r in rows}


def test_groups(spark):
    rng = random.Random(2)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    rng.shuffle(chain)
    star = [("s000", f"s{i:03}") for i in range(1, 150)]
    web = [(f"w{rng.randint(0, 30):02}", f"w{rng.randint(0, 30):02}") for _ in range(25)]
    dirt = [("self", "self"), ("x", None), (None, "y"), (None, None), ("b", "a"), ("a", "b"), ("a", "b")]
    pairs = chain + star + web + dirt
    assert grouped(spark, pairs) == closure(pairs)
    assert grouped(spark, [(None, "y")]) == {}


def test_groups_never_end_early(spark):
    with pytest.raises(RuntimeError, match="stable"):
        link_groups(spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}") for i in range(60)], "a string, b string"), rounds=2)


def replay(buckets, batch, least=3):
    held = defaultdict(set)
    for d, b in buckets:
        if d is not None and b is not None and d in batch:
            held[d].add(b)
    accepted, gone = [], set()
    for n in sorted(set(batch.values())):
        new = [d for d in held if batch[d] == n]
        bad = {d for d in new if any(len(held[d] & held[x]) >= least for x in accepted)}
        gone |= bad
        accepted += [d for d in new if d not in bad]
    return gone


@pytest.mark.parametrize("cap", [1, 256])
def test_batches(spark, cap):
    rng = random.Random(3)
    rows, arrived = [], []
    for g in range(12):
        base = [f"g{g}-{i}" for i in range(8)]
        for n in range(6):
            d = f"d{g:02}-{n}"
            rows += [(d, b) for b in base if rng.random() < 0.6] + [(d, f"own-{d}")] + [(d, f"junk{j}") for j in range(4) if rng.random() < 0.5]
            arrived += [(d, rng.randint(1, 3)), (d, rng.choice([None, 4]))]
    # a third of all records are copies of each other
    rows += [(f"copy{i:02}", f"k{j}") for i in range(30) for j in range(5)]
    arrived += [(f"copy{i:02}", 1 + i % 4) for i in range(30)]
    rows += [rows[0], (None, "x"), ("d00-0", None), ("stranger", "k0"), ("stranger", "k1"), ("stranger", "k2")]
    arrived += [(None, 1), ("nobuckets", 2)]
    b = spark.createDataFrame([(d, x, 1, 2) for d, x in rows], "doc string, buckets string, batch long, node long")
    a = spark.createDataFrame([(d, n, "2020", 1) for d, n in arrived], "doc string, batch_no int, arrived_at string, s long")
    batch = {}
    for d, n in arrived:
        if d is not None and n is not None:
            batch[d] = min(n, batch.get(d, n))
    got = [r.doc for r in rejected_records(b, a, cap=cap).collect()]
    assert len(got) == len(set(got)) and set(got) == replay(rows, batch)
    # the same, batch by batch against stored segments
    index, bad = BatchIndex(spark, cap=cap), set()
    for n in sorted(set(batch.values())):
        mine = spark.createDataFrame([(d, x) for d, x in rows if batch.get(d) == n], "doc string, buckets string")
        bad |= {r.doc for r in index.add(mine).where("rejected").collect()}
    assert bad == set(got) and index.segments() <= 3


def test_shards_are_named_by_sparks_hash(spark):
    from palimpsest.llm.batches import Segment, _hash

    assert [r[0] for r in spark.range(50).select(F.hash(F.col("id").cast("int"))).collect()] == [_hash(n) for n in range(50)]
    assert [_hash(n) % 7 for n in Segment(spark, "nowhere", 7).labels] == list(range(7))


def test_many_shards_and_hot_buckets_known_beforehand(spark, monkeypatch):
    """Small shards and blocks, and a bucket that a third of all nodes have."""
    from palimpsest.llm import pairs as P

    monkeypatch.setattr(P, "HEAVY_LEAST", 4)
    rng = random.Random(9)
    rows = [(f"d{n:03}", x) for n in range(160) for x in [f"own{n}"] + [f"f{n // 4}-{k}" for k in range(5) if rng.random() < 0.7] + (["hot1"] if n % 3 == 0 else []) + (["hot2", "hot3"] if n % 5 == 0 else [])]
    batch = {f"d{n:03}": 1 + n % 4 for n in range(160)}
    index, got = BatchIndex(spark, cap=10, each=16), set()
    for n in range(1, 5):
        mine = spark.createDataFrame([(d, x) for d, x in rows if batch[d] == n], "doc string, buckets string")
        got |= {r.doc for r in index.add(mine).where("rejected").collect()}
    assert got == replay(rows, batch)
    assert any(s.shards > 4 for _, s in index.levels)


def test_no_batches(spark):
    b, a = spark.createDataFrame([], "doc string, buckets string"), spark.createDataFrame([], "doc string, batch_no int")
    assert rejected_records(b, a).count() == 0


def test_reopened_index_keeps_its_history(spark, tmp_path):
    """Each batch is decided by an index of its own on the same path."""
    path = f"file://{tmp_path}/index"
    rows = lambda *docs: spark.createDataFrame([(d, f"{k}{j}") for d, k in docs for j in range(4)], "doc string, buckets string")
    batches = [(("a", "x"),), (("b", "y"), ("c", "x")), (("d", "x"), ("e", "y")), (("f", "z"),), (("g", "z"), ("h", "y"), ("i", "w"))]
    got = []
    for n, docs in enumerate(batches):
        index = BatchIndex(spark, path)
        assert index.number == n
        got.append({r.doc for r in index.add(rows(*docs)).where("rejected").collect()})
    assert got == [set(), {"c"}, {"d", "e"}, set(), {"g", "h"}]
