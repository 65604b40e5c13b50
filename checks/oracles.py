"""SQL for DuckDB that states each query directly, without the engine's shortcuts."""

from __future__ import annotations

from checks.queries import STOPWORDS

DOC = r"""
doc AS (
  SELECT doc_id AS id, source AS period,
         list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '') AS words
  FROM documents)"""

OCC = DOC + """,
occ AS (SELECT id, period, unnest(words) AS term FROM doc)"""

DOC_LINES = """
lines AS (
  SELECT doc_id AS id, source AS period, unnest(string_split(text, chr(10))) AS value
  FROM documents)"""

TURN_LINES = """
lines AS (
  SELECT conv_id AS id, role AS period, unnest(string_split(text, chr(10))) AS value
  FROM conversations)"""

DATED = """
named AS (
  SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey) AS names
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey),
lines AS (
  SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d') || ',' || names AS value
  FROM orders JOIN named ON o_orderkey = l_orderkey)"""

PARSED = DATED + """,
parsed AS (
  SELECT id, substr(value, 1, 4) AS period,
         list_filter(string_split(split_part(value, ',', 2), ' '), lambda w: w <> '') AS words
  FROM lines WHERE contains(value, ','))"""

COMMON = OCC + """,
common AS (
  SELECT term FROM occ GROUP BY term
  HAVING count(DISTINCT period) = (SELECT count(DISTINCT source) FROM documents))"""

STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"

WS = r"'[\s\x{1c}-\x{1f}\x{85}\x{a0}]+'"
PUNCT = r"""'[ *$&#/\t\n\f"'',.:;?!\[\](){}<>~\-_]'"""


def _terms(source: str, split: str) -> str:
    return f"""WITH {source},
terms AS (SELECT unnest({split}) AS term FROM lines)
SELECT term, count(*) AS n FROM terms WHERE term <> '' GROUP BY term"""


def _weights(n: str, beta: float | None = None) -> str:
    keep = "" if beta is None else f" WHERE tf * log10({n} / df) >= {beta}"
    return OCC + f""",
counted AS (SELECT term, period, count(*) AS tf FROM occ GROUP BY term, period),
freq AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
weighted AS (
  SELECT term, period, tf, df, round(tf * log10({n} / df), 6) AS weight
  FROM counted JOIN freq USING (term){keep})"""


N_PERIODS = "(SELECT count(DISTINCT source) FROM documents)"

POSITIONS = """,
pos AS (
  SELECT id, period, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM cleaned),
pairs AS (
  SELECT a.id, a.period, least(a.term, b.term) AS term1, greatest(a.term, b.term) AS term2
  FROM pos a JOIN pos b ON a.id = b.id AND a.i < b.i),
counted AS (
  SELECT period, term1, term2, count(*) AS n FROM pairs GROUP BY period, term1, term2)"""


def _cleaned(source: str, drop: str = "") -> str:
    kept = f"regexp_matches(w, '^[a-z]'){drop}"
    return PARSED + f""",
cleaned AS (SELECT id, period, list_filter(words, lambda w: {kept}) AS words FROM {source})"""


def _top(k: int) -> str:
    return f"""SELECT period, term1, term2, n FROM counted
QUALIFY row_number() OVER (PARTITION BY period ORDER BY n DESC, term1, term2) <= {k}"""


def _top_by_source(k: int) -> str:
    return f"""WITH {COMMON}, {DOC_LINES},
numbered AS (
  SELECT row_number() OVER () AS id, period, string_split(lower(value), ' ') AS words FROM lines),
term AS (
  SELECT id, period, unnest(words) AS term, generate_subscripts(words, 1) AS i FROM numbered),
pos AS (
  SELECT * FROM term
  WHERE regexp_matches(term, '^[a-z]') AND term NOT IN (SELECT term FROM common)),
pairs AS (
  SELECT a.period, least(a.term, b.term) AS term1, greatest(a.term, b.term) AS term2
  FROM pos a JOIN pos b ON a.id = b.id AND a.i < b.i),
counted AS (
  SELECT period, term1, term2, count(*) AS n FROM pairs GROUP BY period, term1, term2)
{_top(k)}"""


def _top_in_documents(k: int) -> str:
    return f"""WITH {COMMON},
bag AS (
  SELECT id, period, term, count(*) AS m FROM occ
  WHERE regexp_matches(term, '^[a-z]') AND term NOT IN (SELECT term FROM common)
  GROUP BY id, period, term),
pairs AS (
  SELECT a.period, a.term AS term1, b.term AS term2,
         CASE WHEN a.term = b.term THEN a.m * (a.m - 1) / 2 ELSE a.m * b.m END AS m
  FROM bag a JOIN bag b ON a.id = b.id AND a.term <= b.term),
counted AS (
  SELECT period, term1, term2, CAST(sum(m) AS BIGINT) AS n FROM pairs
  WHERE m > 0 GROUP BY period, term1, term2)
{_top(k)}"""


def _directional(source: str) -> str:
    return "WITH " + source + rf""",
numbered AS (SELECT row_number() OVER () AS line, value FROM lines),
terms AS (
  SELECT line, unnest(regexp_split_to_array(lower(trim(value)), {PUNCT})) AS term FROM numbered),
mult AS (SELECT line, term, count(*) AS m FROM terms WHERE term <> '' GROUP BY line, term),
directed AS (
  SELECT a.term, b.term AS other, CAST(sum(b.m) AS BIGINT) AS n
  FROM mult a JOIN mult b ON a.line = b.line AND a.term <> b.term
  GROUP BY a.term, b.term)"""


TURNS = r"""
doc AS (
  SELECT conv_id * 1000000 + turn AS id, role AS period,
         list_filter(regexp_split_to_array(lower(text), '[^\p{L}]+'), lambda w: w <> '') AS words
  FROM conversations)"""


def _overlaps(source: str, cross_period: bool = True) -> str:
    cross = " AND a.period <> b.period" if cross_period else ""
    return source + f""",
tok AS (SELECT DISTINCT id, period, unnest(words) AS token FROM doc),
sizes AS (SELECT id, count(*) AS n FROM tok GROUP BY id),
common_tokens AS (
  SELECT a.id AS id1, b.id AS id2, count(*) AS o
  FROM tok a JOIN tok b ON a.token = b.token AND a.id < b.id{cross}
  GROUP BY a.id, b.id),
sims AS (
  SELECT id1, id2, CAST(o AS DOUBLE) / (s.n + t.n - o) AS sim
  FROM common_tokens JOIN sizes s ON s.id = id1 JOIN sizes t ON t.id = id2)"""


def _jaccard(tau: float, source: str = DOC, cross_period: bool = True) -> str:
    return f"""WITH {_overlaps(source, cross_period)}
SELECT id1, id2, sim FROM sims WHERE sim >= {tau}"""


RANKED = DOC + """,
tok AS (SELECT DISTINCT id, period, unnest(words) AS token FROM doc),
freq AS (SELECT token, count(*) AS freq FROM tok GROUP BY token),
ranked AS (
  SELECT id, period, token, freq,
         row_number() OVER (PARTITION BY id ORDER BY freq, token) AS pos,
         count(*) OVER (PARTITION BY id) AS n
  FROM tok JOIN freq USING (token))"""


def _prefix(tau: float) -> str:
    return f"pos <= n - ceil({tau} * n - 1e-9) + 1"


SETS = RANKED + """,
keyed AS (
  SELECT id, period, n, string_agg(token, ' ' ORDER BY token) AS key
  FROM ranked GROUP BY id, period, n),
sets AS (
  SELECT key, min(id) AS set_id, any_value(n) AS n, count(*) AS copies,
         min(period) AS first_period, max(period) AS last_period
  FROM keyed GROUP BY key)"""


def _candidates(tau: float, extra: str = "2e-2") -> str:
    """Pairs of sets with enough common tokens in their two prefixes."""
    return SETS + f""",
placed AS (SELECT token, row_number() OVER (ORDER BY freq, token) AS place FROM freq),
spans AS (
  SELECT *,
         least(n, n - ceil(2 * {tau} / (1 + {tau}) * n - 1e-9) + 1 + floor(n * {extra})) AS len1,
         least(n, n - ceil({tau} * n - 1e-9) + 1 + floor(n * {extra})) AS len2
  FROM sets),
posting AS (
  SELECT set_id, spans.n, first_period, last_period, len1, len2, pos, freq, place
  FROM spans JOIN ranked ON id = set_id JOIN placed USING (token)),
ends AS (
  SELECT set_id, max(place) FILTER (pos <= len1) AS last1, max(place) FILTER (pos <= len2) AS last2
  FROM posting GROUP BY set_id),
met AS (
  SELECT s.set_id AS s_id, l.set_id AS l_id, any_value(s.n) AS n1, any_value(l.n) AS n2,
         any_value(s.len1) AS len1, any_value(l.len2) AS len2, count(*) AS c
  FROM posting s JOIN posting l
    ON s.place = l.place AND s.pos <= s.len1 AND l.pos <= l.len2
   AND (s.n < l.n OR (s.n = l.n AND s.set_id < l.set_id))
   AND s.n >= {tau} * l.n - 1e-9
   AND least(s.first_period, l.first_period) <> greatest(s.last_period, l.last_period)
  GROUP BY s.set_id, l.set_id),
candidates AS (
  SELECT least(s_id, l_id) AS set1, greatest(s_id, l_id) AS set2
  FROM met JOIN ends e ON e.set_id = s_id JOIN ends f ON f.set_id = l_id
  WHERE c + CASE WHEN e.last1 < f.last2 THEN n1 - len1 ELSE n2 - len2 END
        >= ceil({tau} / (1 + {tau}) * (n1 + n2) - 1e-9))"""


def _similar_sets(tau: float) -> str:
    return SETS + f""",
members AS (
  SELECT set_id, copies, token FROM sets JOIN ranked ON id = set_id),
common_tokens AS (
  SELECT a.set_id AS set1, b.set_id AS set2, count(*) AS o
  FROM members a JOIN members b ON a.token = b.token AND a.set_id < b.set_id
  GROUP BY a.set_id, b.set_id),
crossing AS (
  SELECT a.set_id AS set1, b.set_id AS set2, CAST(o AS DOUBLE) / (a.n + b.n - o) AS sim,
         a.copies AS copies1, b.copies AS copies2
  FROM common_tokens JOIN sets a ON a.set_id = set1 JOIN sets b ON b.set_id = set2
  WHERE least(a.first_period, b.first_period) <> greatest(a.last_period, b.last_period)),
within AS (
  SELECT set_id AS set1, set_id AS set2, CAST(1 AS DOUBLE) AS sim,
         copies AS copies1, copies AS copies2
  FROM sets WHERE copies > 1 AND first_period <> last_period)
SELECT * FROM crossing WHERE sim >= {tau} UNION ALL SELECT * FROM within"""


ORACLES: dict[str, str] = {
    "parse_dated_lines": f"""WITH {PARSED}
SELECT id, period, array_to_string(words, ' ') AS words FROM parsed""",
    "unparsed_lines": f"""WITH {DOC_LINES}
SELECT id, value FROM lines WHERE NOT contains(value, ',')""",
    "text_roundtrip": f"""WITH {PARSED}
SELECT period, array_to_string(words, ' ') AS words FROM parsed""",
    "stopword_file_roundtrip": f"""WITH {COMMON}
SELECT period, count(*) AS n FROM occ WHERE term NOT IN (SELECT term FROM common)
GROUP BY period""",
    "tokenize_space": _terms(DOC_LINES, "string_split(value, ' ')"),
    "tokenize_whitespace": _terms(DOC_LINES, f"regexp_split_to_array(value, {WS})"),
    "tokenize_tfidf": _terms(DOC_LINES, r"regexp_split_to_array(value, '\t|,|; |\s')"),
    "tokenize_punct": _terms(DOC_LINES, f"regexp_split_to_array(lower(value), {PUNCT})"),
    "drop_stopwords": f"""WITH {COMMON}
SELECT period, term, count(*) AS n FROM occ
WHERE term NOT IN (SELECT term FROM common) GROUP BY period, term""",
    "drop_stopwords_list": f"""WITH {OCC}
SELECT period, term, count(*) AS n FROM occ WHERE term NOT IN {STOP} GROUP BY period, term""",
    "drop_long_stopwords": f"""WITH {OCC},
rare AS (SELECT term FROM occ GROUP BY term HAVING count(DISTINCT id) = 1),
placed AS (SELECT id, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM doc),
kept AS (
  SELECT id, string_agg(term, ' ' ORDER BY pos) AS words
  FROM placed WHERE term NOT IN (SELECT term FROM rare) GROUP BY id)
SELECT doc.id, coalesce(kept.words, '') AS words FROM doc LEFT JOIN kept ON kept.id = doc.id""",
    "keep_words_in_row": rf"""WITH {DOC_LINES}
SELECT id, array_to_string(list_filter(string_split(value, ' '),
         lambda w: regexp_matches(w, '^[a-z]') AND w NOT IN {STOP}), ' ') AS words
FROM lines""",
    "keep_lowercase": f"""WITH {DOC_LINES},
terms AS (SELECT unnest(string_split(value, ' ')) AS term FROM lines)
SELECT term, count(*) AS n FROM terms WHERE regexp_matches(term, '^[a-z]') GROUP BY term""",
    "keep_alphabetic": rf"""WITH {DOC_LINES},
terms AS (SELECT unnest(regexp_split_to_array(value, {WS})) AS term FROM lines)
SELECT term, count(*) AS n FROM terms WHERE regexp_matches(term, '^\p{{L}}') GROUP BY term""",
    "corpus_totals": f"""WITH {DOC_LINES},
words AS (SELECT unnest(regexp_split_to_array(value, {WS})) AS word FROM lines)
SELECT 'chars' AS metric, CAST(sum(length(value)) AS BIGINT) AS total FROM lines
UNION ALL SELECT 'words', count(*) FROM words WHERE word <> ''
UNION ALL SELECT 'lines', count(*) FROM lines""",
    "corpus_totals_dated": f"""WITH {DATED},
words AS (SELECT unnest(regexp_split_to_array(value, {WS})) AS word FROM lines)
SELECT 'chars' AS metric, CAST(sum(length(value)) AS BIGINT) AS total FROM lines
UNION ALL SELECT 'words', count(*) FROM words WHERE word <> ''
UNION ALL SELECT 'lines', count(*) FROM lines""",
    "initial_letter_counts": rf"""WITH {DOC_LINES},
words AS (SELECT unnest(regexp_split_to_array(lower(value), {WS})) AS word FROM lines)
SELECT substr(word, 1, 1) AS letter, count(*) AS n FROM words
WHERE regexp_matches(word, '^\p{{L}}') GROUP BY 1""",
    "initial_letter_lines": rf"""WITH {TURN_LINES},
words AS (SELECT unnest(regexp_split_to_array(lower(value), {WS})) AS word FROM lines)
SELECT substr(word, 1, 1) || ' ' || count(*) AS output FROM words
WHERE regexp_matches(word, '^\p{{L}}') GROUP BY substr(word, 1, 1)""",
    "term_counts": f"WITH {OCC} SELECT term, count(*) AS n FROM occ GROUP BY term",
    "term_period_counts": f"""WITH {OCC}
SELECT term, period, count(*) AS tf FROM occ GROUP BY term, period""",
    "period_frequency": f"""WITH {OCC}
SELECT term, count(DISTINCT period) AS df FROM occ GROUP BY term""",
    "tfidf_by_period": f"WITH {_weights(N_PERIODS)} SELECT * FROM weighted",
    "tfidf_threshold": f"WITH {_weights(N_PERIODS, 5)} SELECT * FROM weighted",
    "tfidf_given_periods": f"WITH {_weights('100', 50)} SELECT * FROM weighted",
    "tfidf_text": f"""WITH {_weights(N_PERIODS, 5)}
SELECT '"' || term || '"' || chr(9) || '"' || period || ',' || weight || '"' AS output
FROM weighted""",
    "tfidf_top_k": f"""WITH {_weights(N_PERIODS)} SELECT * FROM weighted
QUALIFY row_number() OVER (PARTITION BY period ORDER BY weight DESC, term) <= 10""",
    "unordered_pairs": f"""WITH {PARSED}, cleaned AS (SELECT * FROM parsed){POSITIONS}
SELECT id, period, term1, term2, count(*) AS n FROM pairs GROUP BY id, period, term1, term2""",
    "pair_counts_by_year": f"""WITH {PARSED}, cleaned AS (SELECT * FROM parsed){POSITIONS}
SELECT period, term1, term2, n FROM counted""",
    "top_pairs_by_year": f"WITH {_cleaned('parsed')}{POSITIONS} {_top(3)}",
    "top_pairs_stopwords": f"""WITH {_cleaned('parsed', " AND w NOT IN ('small', 'rod')")}{POSITIONS}
{_top(10)}""",
    "top_pairs_text": f"""WITH {_cleaned('parsed')}{POSITIONS}
SELECT period || '    ' || term1 || ',' || term2 || ':' || n AS output FROM ({_top(20)})""",
    "top_pairs_by_source": _top_by_source(10),
    "top_pairs_by_source_unpruned": _top_by_source(10),
    "top_pairs_by_source_documents": _top_in_documents(10),
    "directional_cooccurrence": _directional(DATED) + " SELECT * FROM directed",
    "directional_cooccurrence_turns": _directional(TURN_LINES) + " SELECT * FROM directed",
    "cooccurrence_lines": _directional(DATED)
    + " SELECT term || ' ' || other || ' ' || n AS output FROM directed",
    "stripes_text": _directional(DATED) + """
SELECT term, CAST(0 AS BIGINT) AS part,
       string_agg(other || ':' || n, ',' ORDER BY other) AS stripe
FROM directed GROUP BY term""",
    "stripes_merged": _directional(DATED) + " SELECT * FROM directed",
    "stripes_in_batches": _directional(DATED) + " SELECT * FROM directed",
    "repeated_lines": f"""WITH {PARSED},
term AS (
  SELECT id, period, unnest(words) AS term FROM parsed),
mult AS (SELECT id, period, term, count(*) AS m FROM term GROUP BY id, period, term),
bag AS (
  SELECT id, period, string_agg(term || ':' || m, ' ' ORDER BY term) AS bag
  FROM mult GROUP BY id, period)
SELECT period, bag, count(*) AS lines FROM bag GROUP BY period, bag""",
    "top_pairs_many": _top_in_documents(300),
    "period_frequency_merged": f"""WITH {OCC},{TURNS.replace("doc AS", "turn AS")},
every AS (SELECT term, period FROM occ UNION SELECT unnest(words), period FROM turn)
SELECT term, count(DISTINCT period) AS df FROM every GROUP BY term""",
    "tfidf_ordered_files": f"""WITH {_weights(N_PERIODS, 5)}
SELECT row_number() OVER (ORDER BY term, period DESC) - 1 AS place,
       term || ',' || period || ',' || weight AS value
FROM weighted""",
    "pairs_ordered_files": f"""WITH {_overlaps(DOC)}
SELECT row_number() OVER (ORDER BY id1, id2) - 1 AS place,
       '(' || id1 || ',' || id2 || ')    ' || round(sim, 6) AS value
FROM sims WHERE sim >= 0.9""",
    "top_pairs_ordered_files": f"""WITH {_cleaned('parsed')}{POSITIONS}
SELECT row_number() OVER (ORDER BY period, n DESC, term1, term2) - 1 AS place,
       period || '    ' || term1 || ',' || term2 || ':' || n AS value
FROM ({_top(20)})""",
    "dense_token_ranks": f"""WITH {RANKED}
SELECT token, freq, CAST(row_number() OVER (ORDER BY freq, token) - 1 AS INTEGER) AS rank
FROM freq WHERE freq > 1""",
    "token_order": f"WITH {RANKED} SELECT token, freq FROM freq",
    "rarity_sorted": f"""WITH {RANKED}
SELECT id, period, string_agg(token, ' ' ORDER BY pos) AS tokens FROM ranked GROUP BY id, period""",
    "prefix_tokens": f"WITH {RANKED} SELECT id, period, token FROM ranked WHERE {_prefix(0.8)}",
    "shared_tokens": f"""WITH {RANKED}
SELECT id, period, token FROM ranked WHERE {_prefix(0.8)} AND freq > 1""",
    "distinct_sets": f"""WITH {SETS}
SELECT set_id, CAST(n AS INTEGER) AS n, copies, first_period, last_period FROM sets""",
    "candidate_sets": f"WITH {_candidates(0.8)} SELECT set1, set2 FROM candidates",
    "candidate_sets_half": f"WITH {_candidates(0.5)} SELECT set1, set2 FROM candidates",
    "similar_sets": f"WITH {_similar_sets(0.8)}",
    "jaccard_self_join": _jaccard(0.8),
    "jaccard_self_join_half": _jaccard(0.5),
    "jaccard_self_join_any": _jaccard(0.8, cross_period=False),
    "jaccard_equal_sets": _jaccard(1.0),
    "jaccard_turns": _jaccard(0.1, TURNS),
    "jaccard_text": f"""WITH {_overlaps(DOC)}
SELECT '(' || id1 || ',' || id2 || ')    ' || round(sim, 6) AS output FROM sims WHERE sim >= 0.9""",
}
