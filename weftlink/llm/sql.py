"""DuckDB SQL for the rows of those opN_ queries that SQL can express; plain definitions over whole tables."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_SPACED}), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 4),
sets AS (SELECT doc_id, count(g) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 180 * c >= 80 * (x.n + y.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT doc_id, n AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = sets.doc_id) AS component_id,
  (SELECT count(*) FROM links WHERE links.a = sets.doc_id) AS n_links FROM sets
"""

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_WORD}), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM benchmark WHERE text IS NOT NULL),
items AS (
  SELECT item_id, i AS j, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
found AS (SELECT doc_id, i, j, k, item_id FROM places JOIN items USING (k, s)),
-- consecutive windows of one item, one after the other in document and item
stretches AS (SELECT doc_id, min(i) AS first, count(*) + k - 1 AS n FROM (SELECT DISTINCT doc_id, item_id, i, j, k, i - row_number() OVER (PARTITION BY doc_id, item_id, k, i - j ORDER BY i) AS g, i - j AS way FROM found) GROUP BY doc_id, item_id, k, way, g),
longest AS (SELECT doc_id, max(n) AS n, min(first) FILTER (n = most) AS first FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM stretches) GROUP BY doc_id),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated, coalesce(longest.n, 0) AS longest_match, coalesce(longest.first - 1, -1) AS longest_first_word
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id LEFT JOIN longest ON longest.doc_id = d.doc_id
"""

OP6 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_SPACED}), []) AS w,
    doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS goal FROM documents),
tokens AS (SELECT doc_id, goal, len(w) AS n, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i, unnest(list_prepend(NULL, w[:-2])) AS v FROM d),
size AS (SELECT count(DISTINCT w) + 1 AS v, count(*) AS n, count(*) FILTER (goal) AS g FROM tokens),
uni AS (SELECT w, count(*) AS n, count(*) FILTER (goal) AS g FROM tokens GROUP BY w),
bi AS (SELECT v, w, count(*) AS n, count(*) FILTER (goal) AS g FROM tokens WHERE i > 1 GROUP BY v, w),
fol AS (SELECT v, sum(n) AS n, sum(g) AS g FROM bi GROUP BY v),
own_uni AS (SELECT doc_id, w, count(*) AS n FROM tokens GROUP BY ALL),
own_bi AS (SELECT doc_id, v, w, count(*) AS n FROM tokens WHERE i > 1 GROUP BY ALL),
own_fol AS (SELECT doc_id, v, count(*) AS n FROM tokens WHERE i > 1 GROUP BY ALL),
p1 AS (
  SELECT t.doc_id, t.goal, t.i, t.v, t.w, t.n, (uni.g - if(goal, own.n, 0) + 1) / (size.g - if(goal, t.n, 0) + size.v) AS pg,
    (uni.n - own.n + 1) / (size.n - t.n + size.v) AS pb
  FROM tokens t JOIN uni USING (w) JOIN own_uni own ON own.doc_id = t.doc_id AND own.w = t.w, size),
p2 AS (
  SELECT p1.doc_id, p1.n, CASE WHEN i = 1 THEN pg ELSE (bi.g - if(goal, own_bi.n, 0) + 50 * pg) / (fol.g - if(goal, own_fol.n, 0) + 50) END AS pg,
    CASE WHEN i = 1 THEN pb ELSE (bi.n - own_bi.n + 50 * pb) / (fol.n - own_fol.n + 50) END AS pb
  FROM p1 LEFT JOIN bi ON bi.v = p1.v AND bi.w = p1.w LEFT JOIN fol ON fol.v = p1.v
  LEFT JOIN own_bi ON own_bi.doc_id = p1.doc_id AND own_bi.v = p1.v AND own_bi.w = p1.w
  LEFT JOIN own_fol ON own_fol.doc_id = p1.doc_id AND own_fol.v = p1.v),
loss AS (SELECT doc_id, sum(-ln(pg)) / any_value(n) AS g, sum(-ln(pb)) / any_value(n) AS b FROM p2 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(g, 6) AS target_loss, round(b, 6) AS background_loss, round(g - b, 6) AS score
FROM d LEFT JOIN loss USING (doc_id)
"""

OP7 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACED}), []) AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN least_doc USING (s) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
parts AS (SELECT doc_id, j, substr(h, 2 * j + 1, 2 * (512 + 199)) AS h FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT), 512)) AS j FROM d)),
windows AS (SELECT doc_id, i + j AS i, md5_number(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT doc_id, h, j, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 199)) AS i FROM parts WHERE len(h) >= 400)),
twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, true) AS new FROM windows SEMI JOIN twice USING (s)),
numbered AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, span),
rests AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * r.a + 1, 2 * (coalesce(r.b, CAST(len(h) / 2 AS BIGINT)) - r.a)), '' ORDER BY r.a) AS t FROM rests r JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE t END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""

BY_QUERY = {"op1_ngram_jaccard": OP1, "op4_decontamination": OP4, "op6_lm_scoring": OP6, "op7_projected_knn": OP7, "op8_fm_dedup": OP8, "op9_suffix_array_dedup": OP9}
