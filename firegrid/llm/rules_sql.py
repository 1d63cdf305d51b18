"""The SQL that the adaptive quality rules must agree with."""

from __future__ import annotations

from firegrid.llm.rules import COUNTS, LEAST, RATES, REACH

_BUCKET = "(v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0)"


def _fence(rate: str) -> str:
    _, _, spread, two_sided = RATES[rate]
    reach = f"{REACH} * greatest(q75 - q25, {spread})"
    low = f"q25 - {reach}" if two_sided else "0"
    return (f"max(CASE WHEN rate = '{rate}' THEN {low} END) AS {rate}_low, "
            f"max(CASE WHEN rate = '{rate}' THEN q75 + {reach} END) AS {rate}_high")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twin AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twin, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
s AS (
  SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered ON covered.r = d.r),
p AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS rate, 1000 * {a} // {b} AS v FROM s WHERE {b} > 0" for k, (a, b, _, _) in RATES.items())}),
own AS (SELECT 2 AS level, lang, source, rate, {_BUCKET} AS bk, count(*) AS n FROM p GROUP BY ALL),
sk AS (
  SELECT * FROM own
  UNION ALL SELECT 1, lang, NULL, rate, bk, sum(n) FROM own GROUP BY lang, rate, bk
  UNION ALL SELECT 0, NULL, NULL, rate, bk, sum(n) FROM own GROUP BY rate, bk),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rate ORDER BY bk) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, rate) AS total FROM sk),
q AS (
  SELECT level, lang, source, rate, min(bk) FILTER (100 * upto >= 25 * total) AS q25, min(bk) FILTER (100 * upto >= 75 * total) AS q75
  FROM c GROUP BY ALL),
f AS (SELECT level, lang, source, {", ".join(_fence(k) for k in RATES)} FROM q GROUP BY level, lang, source),
size AS (SELECT level, lang, source, sum(n) AS n FROM sk WHERE rate = 'word_length' GROUP BY ALL),
uses AS (
  SELECT a.lang, a.source, CASE WHEN a.n >= {LEAST} THEN 2 WHEN b.n >= {LEAST} THEN 1 ELSE 0 END AS use
  FROM size a LEFT JOIN size b ON b.level = 1 AND a.lang IS NOT DISTINCT FROM b.lang WHERE a.level = 2),
limits AS (
  SELECT u.lang AS own_lang, u.source AS own_source, f.* FROM uses u JOIN f ON f.level = u.use
    AND f.lang IS NOT DISTINCT FROM CASE WHEN use > 0 THEN u.lang END AND f.source IS NOT DISTINCT FROM CASE WHEN use > 1 THEN u.source END),
j AS (
  SELECT s.*, level, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         {" AND ".join(f"coalesce(1000 * {a} // nullif({b}, 0) BETWEEN {k}_low AND {k}_high, true)" for k, (a, b, _, _) in RATES.items())} AS inside
  FROM s LEFT JOIN limits ON s.lang IS NOT DISTINCT FROM own_lang AND s.source IS NOT DISTINCT FROM own_source)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND inside AS kept, n_lines, level AS sketch_level FROM j
"""
