"""DuckDB statements for the operators that SQL can express."""

ORACLES: dict[str, str] = {}

_WORDS = r"""
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
"""

ORACLES["op1_quality_rules"] = rf"""
WITH base AS ({_WORDS}),
rowed AS (SELECT row_number() OVER () AS r, * FROM base),
starts AS (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM rowed WHERE len(words) >= 5),
windows AS (SELECT r, i, list_slice(words, i, i + 4) AS w FROM starts),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 5) t(k) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_upper
  FROM rowed LEFT JOIN covered USING (r)
),
bits AS (
  SELECT *, CAST(
      CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 25 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * word_chars THEN 16 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 25 * n_words THEN 32 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept,
       CASE fail_bits WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols'
                      WHEN 8 THEN 'repeated_lines' WHEN 16 THEN 'shouting' WHEN 32 THEN 'word_length' END AS sole_rule,
       CAST(2 AS INTEGER) AS policy
FROM bits
"""

ORACLES["op9_benchmark_decontamination"] = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
),
shingles AS (
  SELECT DISTINCT side, id, list_slice(w, i, i + 4) AS s
  FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
items AS (SELECT id AS item_id, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE side = 'i'),
shared AS (
  SELECT d.id AS doc_id, item_id, n_item, count(*) AS n_shared
  FROM shingles d JOIN items USING (s) WHERE d.side = 'd' GROUP BY ALL
)
SELECT doc_id, item_id, CAST(floor(log2(n_item)) AS INTEGER) AS size_class, n_item, n_shared,
       CAST(n_shared AS DOUBLE) / n_item AS containment
FROM shared WHERE 100 * n_shared >= 80 * n_item
"""


ORACLES["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
c1 AS (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(w) AS phrase FROM words) GROUP BY ALL),
c2 AS (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM words) GROUP BY ALL),
c3 AS (SELECT lang, phrase, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS phrase FROM words) GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, n AS a, 1 AS k, split_part(phrase, ' ', 1) AS x, split_part(phrase, ' ', 2) AS y FROM c2 WHERE n >= 10
  UNION ALL
  SELECT lang, phrase, n, 1, split_part(phrase, ' ', 1), split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) FROM c3 WHERE n >= 10
  UNION ALL
  SELECT lang, phrase, n, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) FROM c3 WHERE n >= 10
),
parts AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, f.n AS l, g.n AS r, 1000000::HUGEINT * a * a // (f.n::HUGEINT * g.n) AS score
  FROM cuts JOIN parts f ON f.lang = cuts.lang AND f.phrase = x JOIN parts g ON g.lang = cuts.lang AND g.phrase = y
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) AS phrase, n AS a FROM c3 WHERE n >= 10
    UNION ALL SELECT lang, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3), n FROM c3 WHERE n >= 10
  ) GROUP BY ALL
),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a),
totals AS (SELECT lang, sum(n) AS n FROM c1 GROUP BY lang),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES["op12_hard_negatives"] = """
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same,
         CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.row <> b.row AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT anchor, anchor_id, row AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, row) <= 5
),
hard AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY score DESC, s.vec_id, row) AS rank
  FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 10
"""
