"""Problem 7: per-token results of an index of which a handful of tokens hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.tokens import fold_token
from ..operators.salted import keyed_record_counts
from ..runtime import table


def token_records(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "token_index")
    folded = index.select(fold_token(index.token).alias("token"), "docs").where("token is not null and token != ''")
    return keyed_record_counts(folded, "token", "docs", share=0.01)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return token_records(spark, d).where("heavy").select("token")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_records(spark, d)


FOLDED = """WITH f AS (SELECT lower(regexp_replace(token, '^\\s+|\\s+$', '', 'g')) AS token, docs FROM token_index WHERE token IS NOT NULL),
t AS (SELECT * FROM f WHERE token <> ''), n AS (SELECT count(*) AS n FROM t)"""

QUERIES = {"p7_found": p7_found, "p7_counts": p7_counts}
ORACLE = {
    "p7_found": f"{FOLDED} SELECT token FROM t, n GROUP BY token, n HAVING count(*) > n * 0.01",
    "p7_counts": f"""{FOLDED}, e AS (SELECT token, unnest(docs) AS doc FROM t), c AS (SELECT token, count(doc) AS n_refs, count(DISTINCT doc) AS n_records FROM e GROUP BY 1)
        SELECT t.token, count(*) AS n_rows, coalesce(any_value(n_refs), 0) AS n_refs, coalesce(any_value(n_records), 0) AS n_records, count(*) > any_value(n) * 0.01 AS heavy
        FROM t LEFT JOIN c ON t.token = c.token, n GROUP BY t.token""",
}
