"""SQL that gives the same rows as the queries of this subpackage, where SQL can.

p8_ids and the queries of problem 10 have none: they need a tokenizer or a model.
"""

P1_PAIRS = """
v AS (SELECT DISTINCT doc_id, minhashes FROM doc_records WHERE len(minhashes) = 100 AND len(list_filter(minhashes, lambda x: x IS NULL)) = 0),
u AS (SELECT doc_id, unnest(minhashes) AS h, unnest(range(1, 101)) AS i FROM v),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM u a JOIN u b ON a.i = b.i AND a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) >= 60)
"""
P2_PAIRS = """
v AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_filter(hashes, lambda x: x IS NOT NULL))) AS s FROM doc_records),
s AS (SELECT doc_id, s, len(s) AS n FROM v WHERE len(s) > 0),
u AS (SELECT doc_id, n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score
      FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
      HAVING count(*) >= 0.4 * (any_value(a.n) + any_value(b.n) - count(*)))
"""
FOLDED = """
t AS (SELECT lower(regexp_replace(token, '^\\s+|\\s+$', '', 'g')) AS token, docs FROM token_index WHERE token IS NOT NULL),
f AS (SELECT token, docs FROM t WHERE token <> ''),
r AS (SELECT token, count(*) AS n_rows FROM f GROUP BY 1),
e AS (SELECT token, unnest(docs) AS doc FROM f),
c AS (SELECT token, count(DISTINCT doc) AS n_records FROM e GROUP BY 1)
"""
WORDS4 = """
src AS (SELECT DISTINCT doc_id, CASE WHEN content IS NOT NULL THEN content WHEN tokens IS NOT NULL THEN
          array_to_string(list_concat([tokens[1]], list_transform(tokens[2:], lambda x: string_split(x, ' ')[-1])), ' ') END AS text FROM doc_records),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM src WHERE text IS NOT NULL),
k AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 20], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS p FROM w)),
g AS (SELECT g FROM k GROUP BY g HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT DISTINCT doc_id, p FROM k JOIN g USING (g)),
m AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 20 THEN 0 ELSE 1 END AS fresh FROM s),
n AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
runs AS (SELECT doc_id, min(p) AS start_word, max(p) + 20 - min(p) AS n_words FROM n GROUP BY doc_id, run)
"""


LEAKS = """
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ik AS (SELECT DISTINCT item_id, array_to_string(w[p + 1 : p + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 11)) AS p FROM i)),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
dk AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 11)) AS p FROM d))
"""


def _p6() -> str:
    batches = """
b AS (SELECT doc, min(batch_no) AS batch FROM arrivals WHERE batch_no IS NOT NULL AND doc IS NOT NULL GROUP BY doc),
u AS (SELECT DISTINCT doc, buckets FROM lsh_buckets WHERE doc IS NOT NULL AND buckets IS NOT NULL),
x AS (SELECT doc, batch, buckets FROM u JOIN b USING (doc)),
e AS MATERIALIZED (SELECT o.doc AS old, n.doc AS new, n.batch FROM x o JOIN x n ON o.buckets = n.buckets AND o.batch < n.batch GROUP BY 1, 2, 3 HAVING count(*) >= 3),
r1 AS (SELECT CAST(NULL AS VARCHAR) AS doc WHERE false)"""
    for n in range(2, 13):
        batches += f",\nr{n} AS MATERIALIZED (SELECT doc FROM r{n - 1} UNION SELECT new FROM e WHERE batch = {n} AND old NOT IN (SELECT doc FROM r{n - 1}))"
    return f"WITH {batches}\nSELECT doc FROM r12"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {P1_PAIRS} SELECT doc_a, doc_b FROM p",
        "p1_groups": f"""WITH RECURSIVE {P1_PAIRS},
            l AS (SELECT doc_a AS x, doc_b AS y FROM p UNION SELECT doc_b, doc_a FROM p UNION SELECT doc_id, doc_id FROM v),
            reach AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
            SELECT x AS doc_id, min(y) AS group_doc, (SELECT count(*) FROM l WHERE l.x = reach.x AND l.y <> l.x) AS n_links FROM reach GROUP BY x""",
        "p2_found": f"WITH {P2_PAIRS} SELECT doc_a, doc_b FROM p",
        "p2_scores": f"""WITH {P2_PAIRS}, c AS (SELECT s, min(doc_id) AS doc, count(*) AS n FROM s GROUP BY s)
            SELECT doc_a, doc_b, x.n AS n_a, y.n AS n_b, round(score, 9) AS score FROM p JOIN c x ON doc_a = x.doc JOIN c y ON doc_b = y.doc""",
        "p3_found": f"""WITH {FOLDED}, d AS (SELECT count(DISTINCT doc_id) AS n FROM doc_records),
            m AS (SELECT token, CASE WHEN coalesce(n_records, 0) < 3 THEN 'rare' WHEN n_records > n * 0.2 THEN 'common' END AS mark FROM r LEFT JOIN c USING (token), d)
            SELECT token, mark FROM m WHERE mark IS NOT NULL""",
        "p3_counts": f"WITH {FOLDED} SELECT token, n_rows, coalesce(n_records, 0) AS n_records FROM r LEFT JOIN c USING (token)",
        "p3_delta": """WITH w AS (SELECT doc_id, source, unnest(list_distinct(string_split(text, ' '))) AS token FROM documents),
            f AS (SELECT doc_id, lower(regexp_replace(token, '^\\s+|\\s+$', '', 'g')) AS token FROM w WHERE source IS NULL OR source <> 'letters_ocr')
            SELECT token, count(*) AS n_rows, count(DISTINCT doc_id) AS n_records FROM f WHERE token <> '' GROUP BY 1""",
        "p4_found": f"WITH {WORDS4} SELECT doc_id, start_word, n_words FROM runs",
        "p4_coverage": f"""WITH {WORDS4}, c AS (SELECT doc_id, sum(n_words) AS n FROM runs GROUP BY 1)
            SELECT doc_id, max(len(w)) AS n_words, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shared FROM w LEFT JOIN c USING (doc_id) WHERE len(w) > 0 GROUP BY 1""",
        "p5_found": """WITH RECURSIVE l AS (SELECT a AS x, b AS y FROM candidates WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM candidates WHERE a IS NOT NULL AND b IS NOT NULL
              UNION SELECT a, a FROM candidates WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, b FROM candidates WHERE a IS NOT NULL AND b IS NOT NULL),
            reach AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
            SELECT min(y) AS group_doc, x AS doc FROM reach GROUP BY x""",
        "p6_found": _p6(),
        "p8_texts": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
        "p9_found": f"WITH {LEAKS} SELECT DISTINCT doc_id, item_id FROM dk JOIN ik USING (g)",
        # a text is cut into words and what separates them; a separator goes with the words on both sides of it
        "p9_clean": f"""WITH {LEAKS}, hit AS (SELECT DISTINCT doc_id, p FROM dk WHERE g IN (SELECT g FROM ik)),
            bad AS (SELECT DISTINCT doc_id, p + o AS k FROM hit, (SELECT unnest(range(0, 12)) AS o)),
            n AS (SELECT doc_id, count(*) AS n_removed FROM bad GROUP BY 1),
            c AS (SELECT doc_id, n_removed, n_removed > len(w) * 0.5 AS dropped FROM n JOIN d USING (doc_id)),
            t AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS s FROM documents JOIN n USING (doc_id)),
            u AS (SELECT doc_id, unnest(s) AS s, unnest(range(0, len(s))) AS i FROM t),
            v AS (SELECT *, regexp_matches(s, '^[\\p{{L}}\\p{{N}}]') AS is_word FROM u),
            x AS (SELECT *, sum(is_word::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM v),
            y AS (SELECT x.doc_id, s, i, b.k IS NOT NULL AND (is_word OR e.k IS NOT NULL) AS gone FROM x LEFT JOIN bad b ON b.doc_id = x.doc_id AND b.k = x.k LEFT JOIN bad e ON e.doc_id = x.doc_id AND e.k = x.k + 1),
            z AS (SELECT doc_id, md5(coalesce(string_agg(s, '' ORDER BY i) FILTER (NOT gone), '')) AS m FROM y GROUP BY 1)
            SELECT doc_id, n_removed, dropped, CASE WHEN NOT dropped THEN m END AS text_md5 FROM c JOIN z USING (doc_id)""",
    }
