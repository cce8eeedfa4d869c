"""Every core query against the SQL that must give the same rows, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from palimpsest.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same(spark, con, sf, name, queries, sql):
    df = queries[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    rel = con.sql(sql[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, sf, name):
    same(spark, con, sf, name, registry.queries(), registry.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["a", "b", "score"]


def test_alignments_of_documents(spark, sf):
    rows = registry.queries()["align_candidates"](spark, sf).collect()
    assert all(r.score > 0 and r.n_optimal > 0 for r in rows)


def test_core_stands_alone():
    import subprocess
    import sys

    code = "import sys; sys.modules['palimpsest.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith(('p1_', 'p10_'))] and 'p7_found' in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_overlap_keeps_short_passages(spark, tmp_path):
    """12 words borrowed from an item of 300: 8 of its 296 5-grams, a ratio under 0.1."""
    item = [f"word{n}" for n in range(300)]
    rows = [(1, " ".join([f"own{n}" for n in range(40)] + item[100:112])), (2, " ".join(f"other{n}" for n in range(40)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    q = registry.queries()
    assert [tuple(r) for r in q["benchmark_overlap"](spark, str(tmp_path)).collect()] == [(7, 1, 8, round(8 / 296, 9))]
    assert {tuple(r) for r in q["pairwise_compare_items"](spark, str(tmp_path)).collect()} == {("i7", "d1", round(8 / 296, 9)), ("i7", "d2", 0.0)}


def test_postings_of_hot_tokens(spark, tmp_path):
    """A 3-gram in 60 documents, beyond the band of token_index_of_documents."""
    rows = [(n, f"all have this own{n} other{n}") for n in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    q = registry.queries()
    assert q["token_index_of_documents"](spark, str(tmp_path)).count() == 0
    assert sorted(r.doc_id for r in q["token_postings_of_documents"](spark, str(tmp_path)).collect()) == list(range(60))
