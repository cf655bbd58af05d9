"""DuckDB SQL for the queries that SQL can express. The others are tested
against brute force, round trips or held-out rows in ``tests/llm``."""

from __future__ import annotations

OP7 = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d
"""

OP5 = r"""
WITH pages AS (SELECT row_number() OVER () AS page, source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
lines AS (
  SELECT DISTINCT page, source, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM (SELECT page, source, unnest(string_split(text, chr(10))) AS line FROM pages)),
boilerplate AS (
  SELECT l.source, list(l.line) AS lines
  FROM (SELECT source, line, count(*) AS n FROM lines WHERE line <> '' GROUP BY source, line) l
  JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE n >= 3 AND n > pages * 0.05::DOUBLE
  GROUP BY l.source),
cleaned AS (
  SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS ls,
         list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(
           coalesce(b.lines, []), trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)))) AS stays
  FROM documents d LEFT JOIN boilerplate b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(stays), 0) AS n_dropped,
       array_to_string(stays, chr(10)) AS text
FROM cleaned
"""

OP1 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
docs AS (SELECT *, 1.0::DOUBLE + (length(bin(size + 1)) - 1) / 8.0::DOUBLE AS imp FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM docs GROUP BY source),
fill AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS fill,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM sources),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY fill, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM fill),
shares AS (SELECT *, max(CASE WHEN level <= fill THEN level END) OVER () AS share FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN share IS NULL OR fill < share THEN cap ELSE share * weight END AS target FROM shares),
classes AS (
  SELECT d.source, d.imp, sum(d.size)::BIGINT AS class_size, any_value(t.target) AS target
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, d.imp),
factors AS (
  SELECT *, (target - 2.0::DOUBLE * coalesce(sum(class_size) OVER (PARTITION BY source ORDER BY imp DESC
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / nullif(sum(class_size * imp) OVER (PARTITION BY source ORDER BY imp DESC
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS factor FROM classes),
fits AS (
  SELECT *, max(CASE WHEN factor * imp <= 2 THEN imp END) OVER (PARTITION BY source) AS fit_imp FROM factors),
plan AS (
  SELECT f.source, f.imp, f.class_size, greatest(CASE WHEN f.fit_imp IS NULL OR f.imp > f.fit_imp THEN 2.0::DOUBLE
           ELSE least(2.0::DOUBLE, g.factor * f.imp) END, 0) AS copies
  FROM fits f LEFT JOIN fits g ON f.source IS NOT DISTINCT FROM g.source AND g.imp = f.fit_imp),
needs AS (SELECT source, sum(class_size * (copies - floor(copies))) AS need FROM plan GROUP BY source),
drawn AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, n.need, floor(p.copies)::BIGINT AS whole,
         p.copies - floor(p.copies) AS p,
         (('0x' || md5('7:' || d.doc_id)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source AND d.imp = p.imp
  JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
  JOIN needs n ON d.source IS NOT DISTINCT FROM n.source),
ranked AS (
  SELECT *, CASE WHEN p <= 0 THEN 2 ELSE (u / (1 - u)) / (u / (1 - u) + p / (1 - p)) END AS rank FROM drawn),
line AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY rank, doc_id NULLS LAST) AS n
  FROM ranked WHERE rank < 2 AND size > 0),
walk AS (
  SELECT source, need AS open, 0::BIGINT AS n, NULL::BIGINT AS doc_id, FALSE AS drawn FROM needs
  UNION ALL
  SELECT w.source, CASE WHEN l.size <= w.open THEN w.open - l.size ELSE w.open END, l.n, l.doc_id, l.size <= w.open
  FROM walk w JOIN line l ON l.source IS NOT DISTINCT FROM w.source AND l.n = w.n + 1)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.size * (r.whole + coalesce(w.drawn, FALSE)::INT))::BIGINT AS taken
FROM ranked r LEFT JOIN walk w ON r.source IS NOT DISTINCT FROM w.source AND r.doc_id = w.doc_id
"""

OP12 = r"""
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.id AS anchor_id, r.id, r.label = a.label AS same, list_inner_product(a.vec, r.vec)::BIGINT AS score
  FROM v a JOIN v r ON a.id <> r.id WHERE a.id % 100 = 0),
positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

ORACLE_SQL = {"op12_hard_negatives": OP12, "op1_mixing": OP1, "op5_line_dedup": OP5, "op7_exact_dedup": OP7}
