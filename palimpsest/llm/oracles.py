"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from palimpsest.llm import quality

OP1 = r"""
WITH d AS (  -- bytes as pairs of hexadecimal digits
  SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), chunk AS (  -- substr takes time in proportion to where it begins, so windows are cut from chunks of 400 window starts
  SELECT r, c, substr(x, CAST(2 * c + 1 AS BIGINT), 998) AS y FROM d, unnest(range(0, CAST(greatest(0, strlen(x) // 2 - 99) AS BIGINT), 400)) AS t(c)
), w AS (
  SELECT r, c + s AS s, md5_number(substr(y, CAST(2 * s - 1 AS BIGINT), 200)) AS h FROM chunk, unnest(range(1, CAST(strlen(y) // 2 - 98 AS BIGINT))) AS t(s)
), first AS (
  SELECT h, min((r << 32) + s) AS one FROM w GROUP BY h HAVING count(*) > 1
), again AS (
  SELECT w.r, w.s FROM w JOIN first f USING (h) WHERE (w.r << 32) + w.s <> f.one
), runs AS (  -- windows that overlap or touch make one run of removed bytes
  SELECT r, min(s) AS a, max(s) + 99 AS z
  FROM (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS run FROM (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= 100 THEN 0 ELSE 1 END AS new FROM again))
  GROUP BY r, run
), cut AS (
  SELECT r, list(z ORDER BY a) AS ends, list(a ORDER BY a) AS starts, sum(z - a + 1) AS gone, count(*) AS n FROM runs GROUP BY r
)
SELECT d.doc_id, CAST(strlen(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN x ELSE array_to_string(list_transform(range(0, CAST(n + 1 AS BIGINT)), lambda i:
         substr(x, CAST(CASE WHEN i = 0 THEN 1 ELSE 2 * ends[i] + 1 END AS BIGINT),
                CAST((CASE WHEN i = n THEN strlen(x) ELSE 2 * starts[i + 1] - 2 END) - (CASE WHEN i = 0 THEN 0 ELSE 2 * ends[i] END) AS BIGINT))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


def _op5() -> str:
    q = quality
    spaces = r"[^\x20\x09-\x0D]"
    bins = ", ".join(f"CASE WHEN {den} > 0 THEN CAST(least(ceil({num} * {q.GRID} / ({den} * CAST({top} AS DOUBLE))), {q.GRID}) AS INTEGER) ELSE 0 END AS {rule}" for rule, (num, den, top) in q.RULES.items())
    rules, n = list(q.RULES), len(q.MARGINS)
    margin = "CASE step " + " ".join(f"WHEN {i} THEN {m}" for i, m in enumerate(q.MARGINS)) + " ELSE 0 END"
    return rf"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256(coalesce(text, '')) AS key, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{spaces}+') AS w FROM documents
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c FROM words WHERE len(w) >= 3)
), again AS (
  SELECT r, count(DISTINCT i + k) AS n FROM windows, range(3) AS t(k) WHERE times > 1 GROUP BY r
), counted AS (
  SELECT words.r, doc_id, lang, key, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{spaces}')) AS lines FROM words) words LEFT JOIN again USING (r)
), found AS (
  SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PER_CENT} * n_words AS base_failed, {bins} FROM counted
), truth AS (
  SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id
), held AS (
  SELECT lang, key, key >= '8' AS holdout, min(q) > 0 AS good, {", ".join(f"any_value({r}) AS {r}" for r in rules)} FROM found JOIN truth USING (doc_id) WHERE NOT base_failed GROUP BY lang, key
), tuning AS (
  SELECT lang, good, unnest([{", ".join(f"'{r}'" for r in rules)}]) AS rule, unnest([{", ".join(rules)}]) AS bin FROM held WHERE NOT holdout
), lost AS (  -- documents that a cutoff rejects
  SELECT lang, rule, j, count(*) FILTER (good) AS all_good, count(*) FILTER (good AND bin > j) AS good, count(*) FILTER (NOT good AND bin > j) AS bad FROM tuning, range(0, {q.GRID + 1}) AS t(j) GROUP BY lang, rule, j
), steps AS (
  SELECT step, {margin} AS margin, greatest(0, step - {n}) * CAST({q.RISK} AS DOUBLE) / {q.SHARES} AS share FROM range(0, {q.STEPS}) AS t(step)
), aimed AS (
  SELECT lang, rule, step, least(min(j) + any_value(margin), {q.GRID}) AS j FROM lost, steps WHERE good <= share * all_good GROUP BY lang, rule, step
), way AS (
  SELECT a.lang, a.rule, a.step, min(CASE WHEN l.bad > 0 THEN a.j ELSE {q.GRID} END) OVER (PARTITION BY a.lang, a.rule ORDER BY a.step) AS j
  FROM aimed a JOIN lost l ON a.lang IS NOT DISTINCT FROM l.lang AND a.rule = l.rule AND a.j = l.j
), path AS (
  SELECT lang, step, {", ".join(f"max(j) FILTER (rule = '{r}') AS c_{r}" for r in rules)} FROM way GROUP BY lang, step
), tested AS (
  SELECT p.lang, p.step, count(*) FILTER (holdout AND good) AS n, count(*) FILTER (holdout AND good AND out) AS k,
         count(*) FILTER (NOT holdout AND NOT good AND out) / greatest(1, count(*) FILTER (NOT holdout AND NOT good)) - count(*) FILTER (NOT holdout AND good AND out) / greatest(1, count(*) FILTER (NOT holdout AND good)) AS gain
  FROM (SELECT p.*, h.holdout, h.good, {" OR ".join(f"h.{r} > p.c_{r}" for r in rules)} AS out FROM path p JOIN held h ON p.lang IS NOT DISTINCT FROM h.lang) p GROUP BY p.lang, p.step
), level AS (
  SELECT CAST({q.DELTA} AS DOUBLE) / greatest(1, count(*)) AS level FROM (SELECT DISTINCT lang FROM held)
), certified AS (
  SELECT lang, step, gain, n > 0 AND k < n * CAST({q.RISK} AS DOUBLE) AND list_sum(list_transform(range(0, k + 1), lambda i:
           exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({q.RISK}) + (n - i) * ln(1 - {q.RISK})))) <= level AS ok
  FROM tested, level
), chosen AS (
  SELECT lang, arg_min(step, (-gain, step)) AS step FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang ORDER BY step) AS so_far FROM certified) WHERE so_far AND gain > 0 GROUP BY lang
), cuts AS (
  SELECT path.* FROM path JOIN chosen c ON path.lang IS NOT DISTINCT FROM c.lang AND path.step = c.step
)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
       NOT f.base_failed AND NOT coalesce({" OR ".join(f"f.{r} > c.c_{r}" for r in rules)}, false) AS kept
FROM found f LEFT JOIN cuts c ON f.lang IS NOT DISTINCT FROM c.lang
"""


OP5 = _op5()
