"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP1 = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shing AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM toks),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shing),
flat AS (SELECT doc_id, unnest(s) AS g FROM shing),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * i >= 75 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other)
SELECT r.doc_id, any_value(n) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS g, coalesce('=' || source, '') AS s FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
trig AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS k FROM tri),
rep AS (SELECT doc_id, i FROM trig QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
st AS (
  SELECT w.doc_id, g, s, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10000 * n_symbols // greatest(word_chars, 1) AS symbol_rate, 10000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate,
         10000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate, 100 * word_chars // greatest(n_words, 1) AS word_length FROM st),
long AS (UNPIVOT (SELECT g, s, symbol_rate, dup_line_rate, repeat_rate, word_length FROM m WHERE NOT base_failed)
         ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME metric VALUE v),
binned AS (SELECT g, s, metric, greatest(length(bin(v)) - 6, 0) AS sh, v >> CAST(greatest(length(bin(v)) - 6, 0) AS BIGINT) AS hi FROM long),
sk AS (SELECT g, s, metric, sh, hi, count(*) AS n FROM binned GROUP BY ALL UNION ALL
       SELECT g, NULL, metric, sh, hi, count(*) FROM binned GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY g, s, metric ORDER BY sh, hi) AS upto, sum(n) OVER (PARTITION BY g, s, metric) AS total,
               ((hi + 1) << CAST(sh AS BIGINT)) - 1 AS top FROM sk),
cut AS (SELECT *, min(CASE WHEN 2 * upto >= total THEN upto END) OVER (PARTITION BY g, s, metric) AS middle,
               CASE metric WHEN 'symbol_rate' THEN 75 WHEN 'dup_line_rate' THEN 98 WHEN 'repeat_rate' THEN 95 ELSE 90 END AS pct FROM cum),
q AS (SELECT g, s, metric, max(total) AS n, min(CASE WHEN 2 * upto >= total THEN top END) AS mid, min(CASE WHEN 100 * upto >= pct * total THEN top END) AS up,
             min(CASE WHEN upto > middle AND 100 * (upto - middle) >= 5 * (total - middle) THEN top END) AS start FROM cut GROUP BY ALL),
own AS (SELECT g, s, metric, n, CASE WHEN up > mid THEN up + (CASE metric WHEN 'dup_line_rate' THEN 2 WHEN 'word_length' THEN 3 ELSE 4 END) * (up - mid)
                                     ELSE mid + greatest(50, coalesce((start - mid) // 2, 0)) END AS fence FROM q),
f AS (SELECT o.g, o.s, o.metric, (o.n * o.fence + 200 * l.fence) // (o.n + 200) AS most
      FROM own o JOIN own l ON o.g = l.g AND o.metric = l.metric AND o.s IS NOT NULL AND l.s IS NULL),
p AS (SELECT g, s, max(CASE WHEN metric = 'symbol_rate' THEN most END) AS a, max(CASE WHEN metric = 'dup_line_rate' THEN most END) AS b,
             max(CASE WHEN metric = 'repeat_rate' THEN most END) AS c, max(CASE WHEN metric = 'word_length' THEN most END) AS e FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbol_rate <= a AND dup_line_rate <= b AND repeat_rate <= c AND word_length <= e, false) AS kept
FROM m LEFT JOIN p ON p.g = m.g AND p.s = m.s
"""

OP12 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i+1], ' '))) FROM w
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (
  SELECT lang, k, phrase, a, 1 AS cut, w[1] AS x, array_to_string(w[2:], ' ') AS y FROM c
  UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, a, l.n AS l, r.n AS r,
         CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y
  QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3),
kept AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM longer q WHERE q.lang = s.lang AND q.phrase = s.phrase AND 100 * q.a >= 50 * s.a))
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, total.n, score
FROM kept JOIN total ON total.lang = kept.lang QUALIFY rank <= 2000
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
o AS (SELECT i, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT lang, source FROM d GROUP BY ALL),
n AS (SELECT lang, source, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY ALL),
dense AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(c.c, 0) AS c,
         CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5) // (coalesce(n.n, 0) + 5 * v.v) AS BIGINT) AS p
  FROM grp JOIN kept ON kept.lang = grp.lang JOIN v ON v.lang = grp.lang
  LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = kept.term LEFT JOIN n ON n.lang = grp.lang AND n.source = grp.source),
ln AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM c GROUP BY lang),
q AS (
  SELECT kept.lang, kept.term, CAST(1 + CAST(1000000000 AS HUGEINT) * (sum(c.c) + 5) // (any_value(ln.n) + 5 * any_value(v.v)) AS BIGINT) AS q
  FROM kept JOIN c ON c.lang = kept.lang AND c.term = kept.term JOIN ln ON ln.lang = kept.lang JOIN v ON v.lang = kept.lang GROUP BY ALL),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(far.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (
  SELECT dense.lang, dense.source, 'term' AS part, dense.term AS item, p - q AS value
  FROM dense JOIN q ON q.lang = dense.lang AND q.term = dense.term WHERE dense.c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1, "op4_exact_top_k": OP4, "op8_quality_rules": OP8, "op12_phrase_collocations": OP12, "op13_source_divergence": OP13}
