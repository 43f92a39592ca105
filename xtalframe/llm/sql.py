"""SQL for the corpus queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op1_suffix_dedup"] = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, encode(coalesce(text, '')) AS e, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT r, i, row_number() OVER (PARTITION BY md5(e[i : i + 99]) ORDER BY r, i) > 1 AS again
  FROM (SELECT r, e, unnest(range(1, octet_length(e) - 98)) AS i FROM d)),
g AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 100, true) AS opens FROM w WHERE again),
x AS (SELECT r, i, count(*) FILTER (opens) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
s AS (SELECT r, min(i) AS a, max(i) + 99 AS z FROM x GROUP BY r, k),
n AS (SELECT r, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY r),
k AS (
  SELECT d.r, x.part, x.o FROM d JOIN (
    SELECT r, a AS o, substr(h, 2 * (lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) + 1) - 1,
                             2 * (a - 1 - lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a))) AS part FROM s JOIN d USING (r)
    UNION ALL
    SELECT r, 9223372036854775807, substr(any_value(h), 2 * max(z) + 1) FROM s JOIN d USING (r) GROUP BY r) x USING (r)),
t AS (SELECT r, string_agg(part, '' ORDER BY o) AS kept FROM k GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""

SQL["op9_quality_ledger"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols
  FROM d),
g AS (
  SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
p AS (SELECT DISTINCT r, i + unnest([0, 1, 2]) AS at
      FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
n AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN n USING (r)),
b AS (
  SELECT *, CAST(CAST(n_words < 50 AS INT) + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT)
    + 4 * CAST(n_symbols > n_words AS INT) + 8 * CAST(100 * n_dup_lines > 60 * n_lines AS INT)
    + 16 * CAST(word_chars < 2 * n_words AS INT) + 32 * CAST(word_chars > 25 * n_words AS INT) AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, (fail_bits & 7) = 0 AS kept_v1, n_lines, fail_bits,
       CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_words' WHEN 4 THEN 'symbols' WHEN 8 THEN 'repeated_lines'
         WHEN 16 THEN 'short_words' WHEN 32 THEN 'long_words' END AS dropped_only_by
FROM b
"""

SQL["quality_ablation"] = (
    SQL["op9_quality_ledger"].rpartition("SELECT doc_id")[0].rstrip()
    + r""",
policies AS (SELECT * FROM (VALUES ('base', 3), ('v1', 7), ('v2', 63)) p(policy, mask)),
rules AS (SELECT * FROM (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('short_words', 16), ('long_words', 32)) u(rule, bit))
SELECT policy, rule, count(*) FILTER ((fail_bits & mask) = 0) AS kept, count(*) FILTER ((fail_bits & mask & ~bit) = 0) AS kept_without,
       count(*) FILTER ((fail_bits & mask) = bit) AS dropped_by_rule_alone
FROM b, policies, rules WHERE mask & bit <> 0 GROUP BY policy, rule
"""
)

SQL["op7_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
p AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT r, doc_id, i, line, p.key IS NOT NULL AND keeper IS DISTINCT FROM doc_id AS gone FROM k LEFT JOIN p USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

SQL["op5_decontaminate"] = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS words
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> ''] AS words
  FROM benchmark),
v AS (SELECT DISTINCT item_id, words[i : least(i + 9, len(words))] AS win
      FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
n AS (SELECT DISTINCT len(win) AS n FROM v),
o AS (SELECT r, i, n, words[i : i + n - 1] AS win
      FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, n WHERE len(words) >= n)),
m AS (SELECT r, item_id, i, n FROM o JOIN v USING (win)),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT r, item_id FROM m) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

SQL["op8_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents),
s AS (SELECT DISTINCT r, array_to_string(words[i : least(i + 3, len(words))], ' ') AS g
      FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
l AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.r <> y.r GROUP BY ALL) p
  JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT r, r AS x FROM w UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM w LEFT JOIN n USING (r) JOIN reach USING (r) JOIN w o ON o.r = reach.x GROUP BY w.r, w.doc_id
"""

SQL["op12_lexical_search"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id,
         [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> ''] AS words
  FROM documents),
d AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n FROM t WHERE len(words) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM d),
i AS (
  SELECT DISTINCT item_id, unnest([x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') IF x <> '']) AS term
  FROM benchmark),
p AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(words) AS term FROM t) SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs),
s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (r), c GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(k AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM s WHERE score > 0) WHERE k <= 50
"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
