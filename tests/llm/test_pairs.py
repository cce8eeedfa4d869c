"""Near duplicates and similar sets against brute force, with hot keys, copies, dirt and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import pairs as P
from palimpsest.llm.near_duplicates import Ring, near_duplicate_classes, near_duplicate_pairs
from palimpsest.llm.queries import classes_of
from palimpsest.llm.similar_sets import code_radius, similar_set_pairs

SCHEMA = "doc_id string, minhashes array<bigint>, rid long, id string, a long"


def brute(rows, least=60):
    sig = {(i, tuple(m)) for i, m, *_ in rows if i is not None and m is not None and len(m) == 100 and None not in m}
    sig = sorted(sig)
    out = set()
    for x in range(len(sig)):
        for y in range(x + 1, len(sig)):
            if sig[x][0] != sig[y][0] and sum(p == q for p, q in zip(sig[x][1], sig[y][1])) >= least:
                out.add((min(sig[x][0], sig[y][0]), max(sig[x][0], sig[y][0])))
    return out


def edits(rng, base, n):
    m = list(base)
    for p in rng.choice(100, n, replace=False):
        m[p] = int(rng.integers(0, 2**32))
    return m


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and all(a < b for a, b in rows)
    return set(rows)


def test_ring_loses_nothing():
    rng = np.random.default_rng(1)
    for n, radius in ((100, 40), (100, 20), (24, 10), (10, 3), (12, 0)):
        ring = Ring(n, radius)
        assert sum(b + 1 for b in ring.budgets) == radius + 1 and sum(ring.widths) == n
        for _ in range(300):
            differ = np.zeros((1, n), bool)
            differ[0, rng.choice(n, radius, replace=False)] = True
            assert ring.chains(differ)[0]
            starts = [i for i, c in ring.keys if not differ[0, list(c)].any()]
            # one of the starts also leaves a subset of the next segment equal
            assert any(not differ[0, list(s)].any() for i in starts for s in ring.follow(i))
    with pytest.raises(ValueError):
        Ring(4, 4)


def test_near_duplicates_with_dirt(spark):
    rng = np.random.default_rng(2)
    base = [[int(x) for x in rng.integers(0, 2**32, 100)] for _ in range(6)]
    rows = [(f"d{k}-{n}", edits(rng, base[k], e), None, None, None) for k in range(6) for n, e in enumerate((0, 0, 15, 20, 39, 40, 41, 60))]
    rows += [rows[0], (None, base[0], 1, "x", 2), ("nul", None, 1, "x", 2), ("short", base[0][:99], 1, "x", 2), ("long", base[0] + [1], 1, "x", 2), ("hole", [None] + base[0][1:], 1, "x", 2), ("empty", [], 1, "x", 2)]
    rows += [("two", base[0], 0, "x", 0), ("two", base[1], 0, "x", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(near_duplicate_pairs(df)) == brute(rows)
    assert near_duplicate_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [2, 256])
def test_hot_keys_are_refined(spark, monkeypatch, cap):
    """A third of the signatures share many positions without being near duplicates."""
    monkeypatch.setattr(P, "HEAVY_LEAST", 8)
    rng = np.random.default_rng(3)
    mould = [int(x) for x in rng.integers(0, 2**32, 100)]
    rows = [(f"h{n:03}", edits(rng, mould, 45), None, None, None) for n in range(60)]
    rows += [(f"c{n:03}", edits(rng, mould, 20), None, None, None) for n in range(20)]
    rows += [(f"e{n:03}", mould, None, None, None) for n in range(20)]
    rows += [(f"r{n:03}", [int(x) for x in rng.integers(0, 2**32, 100)], None, None, None) for n in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(near_duplicate_pairs(df, cap=cap, share=0.05)) == brute(rows)


def test_classes_have_one_row_a_document(spark):
    rng = np.random.default_rng(4)
    m = [int(x) for x in rng.integers(0, 2**32, 100)]
    rows = [("a", m), ("b", m), ("c", edits(rng, m, 30)), ("d", [int(x) for x in rng.integers(0, 2**32, 100)]), ("d", [1] * 100)]
    pairs, members = near_duplicate_classes(spark.createDataFrame(rows[:4], "doc_id string, minhashes array<bigint>"))
    got = {r.doc_id: (r.group_doc, r.n_links) for r in classes_of(pairs, members).collect()}
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("a", 2), "d": ("d", 0)}


def jaccard(rows, least=0.4):
    s = {(i, frozenset(x for x in v if x is not None)) for i, v, *_ in rows if i is not None and v is not None}
    s = sorted([(i, v) for i, v in s if v], key=lambda r: r[0])
    return {(a, b) for n, (a, x) in enumerate(s) for b, y in s[n + 1 :] if a != b and len(x & y) >= least * len(x | y)}


def test_similar_sets_with_dirt(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(8):
        base = rng.integers(0, 2**32, 60)
        for n, drop in enumerate((0, 0, 10, 20, 30, 36, 45)):
            keep = [int(x) for x in rng.permutation(base)[drop:]]
            rows.append((f"s{k}-{n}", keep + [int(x) for x in rng.integers(0, 2**32, drop // 3)]))
    rows += [rows[3], ("nul", None), ("empty", []), ("holes", [None, None]), ("one", [7]), ("uno", [7, 7, None]), (None, [7]), ("neg", [-5, 3]), ("gen", [-5, 3, 3])]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "doc_id string, hashes array<bigint>, rid long, id string, sketch long")
    assert found(similar_set_pairs(df)) == jaccard(rows)
    assert similar_set_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("cap", [3, 256])
def test_sets_of_frequent_tokens(spark, monkeypatch, cap):
    """Half of the sets share the same tokens, so that these are frequent and their keys are hot."""
    monkeypatch.setattr(P, "HEAVY_LEAST", 8)
    rng = np.random.default_rng(6)
    common = [int(x) for x in rng.integers(0, 2**32, 40)]
    rows = [(f"h{n:03}", common[: 20 + n % 20] + [int(x) for x in rng.integers(0, 2**32, 12 + n % 30)]) for n in range(80)]
    rows += [(f"r{n:03}", [int(x) for x in rng.integers(0, 2**32, 40)]) for n in range(80)]
    df = spark.createDataFrame(rows, "doc_id string, hashes array<bigint>")
    got, want = found(similar_set_pairs(df, cap=cap, share=0.05)), jaccard(rows)
    assert got <= want and len(got) >= 0.99 * len(want)


def test_boilerplate_hides_no_pair(spark):
    """A third of the sets hold the same 25 tokens; short ones lie inside long ones, at 0.4, with all of them."""
    rng = np.random.default_rng(8)
    common, more = [int(x) for x in rng.integers(0, 2**32, 25)], lambda n: [int(x) for x in rng.integers(0, 2**32, n)]
    rows, planted = [], set()
    for n in range(100):
        own = more(15)
        rows += [(f"a{n:03}", common + own), (f"b{n:03}", common + own + more(60))] + [(f"r{n:03}-{k}", more(40)) for k in range(4)]
        planted.add((f"a{n:03}", f"b{n:03}"))
    got, want = found(similar_set_pairs(spark.createDataFrame(rows, "doc_id string, hashes array<bigint>"))), jaccard(rows)
    assert planted <= want and got <= want
    assert len(planted - got) <= 1 and len(got) >= 0.999 * len(want)


def test_radius():
    assert 95 < code_radius(0.4, 256, miss=0.0005) < 106 and code_radius(0.4, 256) > code_radius(0.4, 256, miss=0.0005) and code_radius(1.0, 256) == 0


def test_boundary_recall(spark, monkeypatch):
    """600 pairs at similarity 0.4 that share tokens of half of all sets, with hot segments."""
    monkeypatch.setattr(P, "HEAVY_LEAST", 8)
    rng = np.random.default_rng(11)
    common, more = [int(x) for x in rng.integers(0, 2**32, 12)], lambda n: [int(x) for x in rng.integers(0, 2**32, n)]
    rows, planted = [], set()
    for n in range(600):
        own = more(28)
        a, b = common + own + more(30), common + own + more(30)
        rows += [(f"a{n:03}", a), (f"b{n:03}", b)]
        planted.add((f"a{n:03}", f"b{n:03}"))
    got = found(similar_set_pairs(spark.createDataFrame(rows, "doc_id string, hashes array<bigint>"), share=0.02))
    assert planted == jaccard(rows) & planted and len(planted & got) >= 0.995 * len(planted)


def test_one_key_of_half_the_rows_in_order(spark, monkeypatch):
    """Sorted input, one third mould, blocks of refined rows: nothing is lost and no list of hot keys grows."""
    monkeypatch.setattr(P, "BLOCK", 16)
    monkeypatch.setattr(P, "HEAVY_LEAST", 8)
    rng = np.random.default_rng(12)
    mould = [int(x) for x in rng.integers(0, 2**32, 100)]
    rows = [(f"a{n:03}", edits(rng, mould, 44), None, None, None) for n in range(120)] + [(f"b{n:03}", edits(rng, mould, 22), None, None, None) for n in range(20)]
    rows += [(f"r{n:03}", [int(x) for x in rng.integers(0, 2**32, 100)], None, None, None) for n in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert found(near_duplicate_pairs(df, cap=4, share=0.05)) == brute(rows)


def test_groups_stream_by():
    import pyarrow as pa

    rng = np.random.default_rng(13)
    keys = np.sort(np.r_[rng.integers(0, 40, 300), np.full(500, 17), np.full(90, 50)])
    table = pa.table({"k": keys, "v": np.arange(len(keys))})
    for size in (1, 7, 64, 2000):
        small, big = [], []
        for t, over in P.capped(iter(table.to_batches(max_chunksize=size)), ["k"], 20):
            assert over or max(np.unique(t["k"].to_numpy(), return_counts=True)[1]) <= 20
            (big if over else small).extend(zip(t["k"].to_pylist(), t["v"].to_pylist()))
        assert sorted(small + big) == sorted(zip(keys.tolist(), range(len(keys))))
        assert {k for k, _ in big} == {int(k) for k, n in zip(*np.unique(keys, return_counts=True)) if n > 20}


def test_recall_on_the_tables(spark, sf):
    rows = [(r.doc_id, r.hashes) for r in spark.read.parquet(f"{sf}/doc_records.parquet").select("doc_id", "hashes").collect()]
    assert found(similar_set_pairs(spark.read.parquet(f"{sf}/doc_records.parquet"))) == jaccard(rows)
