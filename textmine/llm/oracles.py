"""SQL for DuckDB that states the queries directly where SQL can."""

from __future__ import annotations

import string

from textmine.llm import licenses

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _components(ids: str, links: str) -> str:
    """Recursive reachability over ``links`` (x, y) from every id."""
    return f"""
edge AS (SELECT x AS a, y AS b FROM {links} UNION SELECT y, x FROM {links}),
reach(v, c) AS (
  SELECT id, id FROM {ids} UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.v),
class AS (SELECT v, min(c) AS c FROM reach GROUP BY v)"""


def license_scan() -> str:
    phrases = ", ".join(
        f"('{label}', {k}, '{word}', {len(phrase.split())})"
        for phrase, label in licenses.PHRASES
        for k, word in enumerate(phrase.split())
    )
    notices = []
    for number, (label, notice, key) in enumerate(licenses.NOTICES):
        words, wanted = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
        notices += [
            f"({number}, '{label}', {k}, '{word}', {int(at <= k < at + len(wanted))}, "
            f"{len(words)}, {len(wanted)})"
            for k, word in enumerate(words)
        ]
    separator = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""WITH phrase(label, k, word, size) AS (VALUES {phrases}),
notice(number, label, k, word, in_key, size, key_size) AS (VALUES {", ".join(notices)}),
doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '{separator}'), lambda w: w <> '') AS words
  FROM documents),
placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM doc),
base AS (
  SELECT doc_id, label, pos - k AS start FROM placed JOIN phrase USING (word)
  GROUP BY doc_id, label, pos - k HAVING count(*) = max(size)),
based AS (
  SELECT doc_id, count(*) AS n, min(start) AS first_word, max(start) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM base GROUP BY doc_id),
freq AS (SELECT word, count(DISTINCT doc_id) AS df FROM placed GROUP BY word),
present AS (
  SELECT DISTINCT doc_id, number, word, df
  FROM placed JOIN notice USING (word) JOIN freq USING (word)),
rare AS (
  SELECT doc_id, number, word, true AS is_rare FROM present
  QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY df, word) <= {licenses.RARE_WORDS}),
accepted AS (
  SELECT doc_id, label, count(*) / max(size) AS coverage
  FROM placed JOIN notice USING (word) LEFT JOIN rare USING (doc_id, number, word)
  GROUP BY doc_id, number, label, pos - k
  HAVING sum(in_key) = max(key_size)
     AND count(*) FILTER (WHERE is_rare) > 0),
every AS (
  SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM accepted),
named AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
best AS (SELECT doc_id, max(coverage) AS coverage FROM accepted GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(based.n, 0) AS BIGINT) AS n_base,
       CAST(based.first_word AS BIGINT) AS first_word, CAST(based.last_word AS BIGINT) AS last_word,
       coalesce(based.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
       CASE WHEN based.n > 0 THEN CAST(1 AS DOUBLE)
            ELSE coalesce(best.coverage, CAST(0 AS DOUBLE)) END AS score
FROM doc LEFT JOIN based USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)"""


JACCARD = rf"""WITH RECURSIVE doc AS (
  SELECT doc_id AS id,
         list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingle AS (
  SELECT id, unnest(CASE WHEN len(w) = 0 THEN []
                         WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                         ELSE list_transform(range(1, len(w) - 2),
                                             lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM doc),
member AS (SELECT DISTINCT id, s FROM shingle),
size AS (SELECT id, count(*) AS n FROM member GROUP BY id),
pair AS (
  SELECT a.id AS x, b.id AS y, count(*) AS n_both
  FROM member a JOIN member b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id),
link AS (
  SELECT x, y FROM pair JOIN size p ON p.id = x JOIN size q ON q.id = y
  WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),{_components("doc", "link")}
SELECT doc.id AS doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, class.c AS component_id
FROM doc LEFT JOIN size ON size.id = doc.id JOIN class ON class.v = doc.id"""

VECTORS = f"""WITH RECURSIVE vec AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
link AS (
  SELECT a.id AS x, b.id AS y FROM vec a JOIN vec b
    ON a.id < b.id AND list_cosine_similarity(a.v, b.v) >= 0.95),{_components("vec", "link")},
degree AS (SELECT a AS id, count(*) AS n FROM edge GROUP BY a)
SELECT vec.id AS vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links,
       class.c AS component_id, class.c = vec.id AS kept
FROM vec LEFT JOIN degree ON degree.id = vec.id JOIN class ON class.v = vec.id"""

NEGATIVES = """WITH vec AS (
  SELECT DISTINCT vec_id AS id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vec a JOIN vec b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
negative AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS place
  FROM positive JOIN scored USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS "rank", negative_id,
       positive_score, negative_score
FROM negative WHERE place <= 10"""

ORACLES = {
    "op2_license_scan": license_scan(),
    "op4_jaccard_join": JACCARD,
    "op6_vector_dedup": VECTORS,
    "op11_hard_negatives": NEGATIVES,
}
