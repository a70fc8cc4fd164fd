"""DuckDB SQL for the numbered queries that SQL can express."""

#: Words of a text as contracts define them; A-Z lower-cased.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def near_duplicates_sql(source: str, num: int, den: int, words: int = 5) -> str:
    """CTEs w .. near_dup: near_dup(doc_id, n_shingles, component_id, kept) over ``source(doc_id, text)``."""
    return f"""
w AS (SELECT doc_id, {WORDS} AS w FROM {source}),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < {words} THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + {words - 1}], ' ') END AS g
      FROM w, unnest(generate_series(1, greatest(len(w) - {words - 1}, 1))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a),
near_dup AS (SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(min(r.seen), d.doc_id) AS component_id,
      coalesce(min(r.seen), d.doc_id) = d.doc_id AS kept
      FROM {source} d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id)"""


OP1 = f"WITH RECURSIVE {near_duplicates_sql('documents', 85, 100)} SELECT * FROM near_dup"
