"""The registered queries: each operator over its whole table, and the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, neardup, packing, quality, sharding, tokens, toolcalls, toxicity, warc
from .common import table


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.calls_of_conversations(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.TOOLS).withColumn("errors", F.array_join("errors", ";"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")))


def op3_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = quality.score(documents, quality.fit_references(documents))
    return scored.withColumns({x: F.round(x, 6) for x in ("class_distance", "word_distance")})


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokens.piece_vocabulary(packing.tokenizer_path("byte_bpe_50k.json"))
    return tokens.count_tokens(table(spark, sf_dir, "documents"), vocabulary)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).drop("node")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_tool_calls, op2_warc_revisits, op3_distribution_divergence, op4_best_fit_packing, op5_token_counts, op6_toxicity, op7_license_scan, op8_decontamination, op9_near_duplicates, op10_sharding)}

WORDS = r"""list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"""

ORACLE_SQL = {
    "op1_tool_calls": r"""
WITH RECURSIVE
rows_ AS (SELECT conv_id, turn, role, text, conv_id + turn AS k FROM conversations),
calls AS (
  SELECT conv_id, turn, CASE WHEN k % 11 = 3 THEN NULL WHEN k % 13 = 5 AND turn >= 1 THEN 'call-' || (turn - 1) ELSE 'call-' || turn END AS call_id,
         CASE WHEN k % 17 = 12 THEN 'other' WHEN role = 'user' THEN 'ask' WHEN role = 'assistant' THEN 'answer' ELSE 'configure' END AS name,
         CASE WHEN k % 17 = 2 THEN '"{\"text\":"' WHEN k % 17 = 14 THEN 'null' ELSE '{' || concat_ws(',', '"n_chars":' || length(text), CASE WHEN k % 17 <> 9 THEN '"text":' || to_json(text) END, CASE WHEN k % 17 = 5 THEN '"turn":"' || turn || '"' ELSE '"turn":' || turn END) || '}' END AS arguments,
         list_filter([CASE WHEN k % 5 = 1 THEN 'call-' || (turn + 2) END, CASE WHEN k % 5 = 2 THEN 'call-' || (turn - 1) END, CASE WHEN k % 5 = 4 THEN 'call-' || (turn - 1) END, CASE WHEN k % 25 = 3 THEN 'call-' || (turn - 2) END, CASE WHEN k % 7 = 0 THEN 'call-' || (turn + 1000) END], lambda x: x IS NOT NULL) AS depends_on,
         CASE WHEN k % 17 IN (2, 14) THEN 'broken JSON' WHEN k % 17 = 12 THEN 'unknown tool'
              ELSE concat_ws(';', CASE WHEN text IS NULL OR k % 17 = 9 THEN '$.text: required' END, CASE WHEN text = '' THEN '$.n_chars: minimum' END, CASE WHEN text = '' AND k % 17 <> 9 THEN '$.text: minLength' END, CASE WHEN k % 17 = 5 THEN '$.turn: type' END) END AS errors
  FROM rows_),
results AS (SELECT conv_id, turn, CASE WHEN k % 19 = 4 THEN NULL WHEN k % 19 = 8 THEN 'call-' || (turn + 500) WHEN k % 23 = 6 THEN 'call-' || (turn - 2) ELSE 'call-' || (turn - 1) END AS call_id, text AS content FROM rows_),
call_forms AS (SELECT *, count(*) AS times FROM calls WHERE call_id IS NOT NULL GROUP BY ALL),
call_ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name NULLS FIRST, arguments NULLS FIRST, depends_on) AS form, sum(times) OVER (PARTITION BY conv_id, call_id) AS n FROM call_forms),
result_forms AS (SELECT *, count(*) AS times FROM results WHERE call_id IS NOT NULL GROUP BY ALL),
result_ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, content NULLS FIRST) AS form, sum(times) OVER (PARTITION BY conv_id, call_id) AS n FROM result_forms),
first_call AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, call_id) - 1 AS place FROM call_ranked WHERE form = 1),
first_result AS (SELECT * FROM result_ranked WHERE form = 1),
needs AS (SELECT DISTINCT conv_id, place AS p, call_id, unnest(depends_on) AS need FROM first_call),
edges AS (SELECT DISTINCT n.conv_id, n.p, f.place AS q FROM needs n JOIN first_call f ON f.conv_id = n.conv_id AND f.call_id = n.need),
dangling AS (SELECT n.conv_id, n.call_id, count(*) AS n_dangling FROM needs n ANTI JOIN first_call f ON f.conv_id = n.conv_id AND f.call_id = n.need GROUP BY ALL),
reach AS (SELECT conv_id, p AS a, q AS b FROM edges UNION SELECT r.conv_id, r.a, e.q FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.p = r.b),
on_cycle AS (SELECT conv_id, a FROM reach WHERE a = b),
kept AS (SELECT e.* FROM edges e ANTI JOIN reach r ON r.conv_id = e.conv_id AND r.a = e.q AND r.b = e.p WHERE e.p <> e.q),
waits AS (SELECT conv_id, p AS a, q AS b FROM kept UNION SELECT w.conv_id, w.a, e.q FROM waits w JOIN kept e ON e.conv_id = w.conv_id AND e.p = w.b),
closure AS (SELECT * FROM waits UNION SELECT conv_id, place, place FROM first_call),
latest AS (SELECT conv_id, a, max(b) AS r FROM closure GROUP BY ALL),
keys AS (SELECT c.conv_id, c.a, any_value(l.r) AS r, list(c.b ORDER BY c.b DESC) AS own FROM closure c JOIN latest l ON l.conv_id = c.conv_id AND l.a = c.a JOIN latest m ON m.conv_id = c.conv_id AND m.a = c.b AND m.r = l.r GROUP BY c.conv_id, c.a),
ordered AS (SELECT conv_id, a, row_number() OVER (PARTITION BY conv_id ORDER BY r, own) - 1 AS topo FROM keys),
linked AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn, c.name,
         CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN y.a IS NOT NULL THEN 'cycle' WHEN r.call_id IS NOT NULL THEN 'linked' ELSE 'unanswered' END AS status,
         o.topo, coalesce(c.n, 0) AS n_calls, coalesce(r.n, 0) AS n_results, coalesce(d.n_dangling, 0) AS n_dangling, c.errors, c.arguments, r.content
  FROM first_call c FULL JOIN first_result r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
  LEFT JOIN ordered o ON o.conv_id = c.conv_id AND o.a = c.place LEFT JOIN (SELECT DISTINCT * FROM on_cycle) y ON y.conv_id = c.conv_id AND y.a = c.place
  LEFT JOIN dangling d ON d.conv_id = c.conv_id AND d.call_id = c.call_id
  UNION ALL SELECT conv_id, NULL, turn, name, 'no_identifier', NULL, 1, 0, 0, errors, arguments, NULL FROM calls WHERE call_id IS NULL
  UNION ALL SELECT conv_id, NULL, turn, NULL, 'no_identifier', NULL, 0, 1, 0, NULL, NULL, content FROM results WHERE call_id IS NULL
  UNION ALL SELECT conv_id, call_id, turn, name, 'repeated_call', NULL, times, 0, 0, errors, arguments, NULL FROM call_ranked WHERE form > 1
  UNION ALL SELECT conv_id, call_id, turn, NULL, 'repeated_result', NULL, 0, times, 0, NULL, NULL, content FROM result_ranked WHERE form > 1)
SELECT conv_id, call_id, turn, name, status, topo, CAST(n_calls AS BIGINT) AS n_calls, CAST(n_results AS BIGINT) AS n_results, CAST(n_dangling AS BIGINT) AS n_dangling,
       n_calls > 0 AND errors = '' AS valid, coalesce(errors, '') AS errors,
       '{' || concat_ws(',', CASE WHEN n_calls > 0 THEN '"arguments":' || arguments END, '"id":' || coalesce(to_json(call_id), 'null'), CASE WHEN n_calls > 0 THEN '"name":"' || name || '"' END, CASE WHEN n_results > 0 THEN '"result":' || coalesce(to_json(content), 'null') END) || '}' AS json
FROM linked""",
    "op2_warc_revisits": r"""
WITH p AS (SELECT page_id AS k, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS tag, 'day ' || page_id AS day, CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '' END AS mark,
                  regexp_extract(trim(url), '^([^/?#]*(?://[^/?#]*)?)', 1) || '/style.css' AS sheet, page_id // 7 % 3 = 0 AS fetched, CAST(page_id // 256 AS VARCHAR) AS version FROM pages),
records AS (
  SELECT k * 4 AS record_id, url, k * 8 AS ts, true AS complete, CASE WHEN k % 4 < 2 THEN tag END AS etag, CASE WHEN k % 2 = 0 THEN day END AS date, strlen(html) AS size, 'text/html' AS kind FROM p
  UNION ALL SELECT k * 4 + 1, url, k * 8 - 1, false, CASE WHEN k % 4 < 2 THEN tag END, CASE WHEN k % 2 = 0 THEN day END, 0, NULL FROM p
  UNION ALL SELECT k * 4 + 2, url, k * 8 + 2, false, CASE WHEN k % 7 <> 0 THEN 'W/' || tag || mark END, day || mark, 0, NULL FROM p
  UNION ALL SELECT k * 4 + 3, sheet, k * 8 + 4, fetched, CASE WHEN k % 2 = 0 OR fetched THEN 'v' || version END, version, 100, 'text/css' FROM p),
parts AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM records),
urls AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*(?://[^/?]*)?)', 1)), '^(http://[^:]*):80$', '\1'), '^(https://[^:]*):443$', '\1')
         || regexp_replace(regexp_extract(bare, '^[^/?]*(?://[^/?]*)?([^?]*)', 1), '/+$', '') AS front,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query
  FROM parts),
named AS (SELECT *, front || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM urls),
joined AS (
  SELECT r.record_id, r.canonical_url, r.ts, r.etag, r.date, f.record_id AS resolved_id, f.ts AS resolved_ts, f.etag AS old_etag, f.date AS old_date, f.size, f.kind,
         row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.record_id DESC) AS place
  FROM (SELECT * FROM named WHERE NOT complete) r LEFT JOIN (SELECT * FROM named WHERE complete) f ON f.canonical_url = r.canonical_url AND f.ts < r.ts),
judged AS (
  SELECT *, CASE WHEN resolved_id IS NULL THEN 'no_earlier_response'
                 WHEN etag IS NOT NULL AND old_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(old_etag, '^W/', '') THEN 'resolved' ELSE 'validator_mismatch' END
                 WHEN date IS NOT NULL AND old_date IS NOT NULL THEN CASE WHEN date = old_date THEN 'resolved' ELSE 'validator_mismatch' END
                 ELSE 'unvalidated' END AS status
  FROM joined WHERE place = 1)
SELECT record_id, canonical_url, ts, resolved_id, resolved_ts, status,
       CASE WHEN status IN ('resolved', 'unvalidated') THEN '{' || concat_ws(',', '"content-length":"' || size || '"', '"content-type":"' || kind || '"', '"date":"' || ts || '"',
            '"etag":"' || coalesce(etag, old_etag) || '"', '"last-modified":"' || coalesce(date, old_date) || '"') || '}' END AS headers_json
FROM judged""",
    "op3_distribution_divergence": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE code WHEN '' THEN 'und' ELSE lower(code) END AS lang FROM (SELECT *, regexp_extract(coalesce(lang, ''), '^([A-Za-z]{2,3})(?:[^A-Za-z]|$)', 1) AS code FROM documents)),
w AS (SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
windows AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
often AS (SELECT doc_id, a, b, c FROM windows GROUP BY ALL HAVING count(*) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows SEMI JOIN often USING (doc_id, a, b, c)) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, lang, length(t) AS n_chars, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lo, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^0-9]', '', 'g')) AS di, length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS sp,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS sy, length(regexp_replace(t, '[^\x00-\x08\x0E-\x1F\x7F]', '', 'g')) AS co, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS be FROM d),
cls AS (SELECT doc_id, lang, unnest(range(8)) AS idx, unnest([lo, up, di, sp, sy, n_chars - lo - up - di - sp - sy - co - be, co, be]) AS n FROM c),
said AS (SELECT doc_id, lang, word, count(*) AS n FROM (SELECT doc_id, lang, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word FROM w) GROUP BY ALL),
ref AS (SELECT lang, count(*) AS docs, sum(len(w)) AS total FROM w WHERE lang <> 'und' GROUP BY lang HAVING count(*) >= 30 AND sum(len(w)) >= 3000),
ref_cls AS (SELECT lang, idx, sum(n) AS n FROM cls SEMI JOIN ref USING (lang) GROUP BY ALL),
top AS (SELECT lang, word, n FROM (SELECT lang, word, sum(n) AS n, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, word) AS place FROM said SEMI JOIN ref USING (lang) GROUP BY lang, word) WHERE place <= 48),
top_sum AS (SELECT lang, sum(n) AS n FROM top GROUP BY lang),
pairs AS (SELECT w.doc_id, len(w.w) AS n_words, r.lang AS rlang, CASE WHEN w.lang = r.lang THEN 1 ELSE 0 END AS own, r.total FROM w JOIN ref r ON w.lang = r.lang OR w.lang NOT IN (SELECT lang FROM ref)),
common AS (SELECT p.doc_id, p.rlang, p.own, p.n_words, p.total, t.word, coalesce(s.n, 0) AS p, t.n AS q FROM pairs p JOIN top t ON t.lang = p.rlang LEFT JOIN said s ON s.doc_id = p.doc_id AND s.word = t.word),
rest AS (SELECT doc_id, rlang, any_value(own) AS own, any_value(n_words) - sum(p) AS p, greatest(0, any_value(total) - sum(q)) AS q FROM common GROUP BY ALL),
hist AS (
  SELECT p.doc_id, rlang, 'c' AS kind, CAST(c.n AS DOUBLE) AS p, CAST(greatest(0, r.n - own * c.n) AS DOUBLE) AS q FROM pairs p JOIN cls c USING (doc_id) JOIN ref_cls r ON r.lang = p.rlang AND r.idx = c.idx
  UNION ALL SELECT doc_id, rlang, 'w', p, greatest(0, q - own * p) FROM common UNION ALL SELECT doc_id, rlang, 'w', p, greatest(0, q - own * p) FROM rest),
shares AS (SELECT doc_id, rlang, kind, p / nullif(sum(p) OVER x, 0) AS p, q / nullif(sum(q) OVER x, 0) AS q FROM hist WINDOW x AS (PARTITION BY doc_id, rlang, kind)),
js AS (SELECT doc_id, rlang, kind, coalesce(sqrt(greatest(0, sum(0.5 * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END)) FILTER (p IS NOT NULL AND q IS NOT NULL))), 0) AS dist FROM shares GROUP BY ALL),
near AS (SELECT doc_id, min(dist) FILTER (kind = 'c') AS cd, least(1, min(dist) FILTER (kind = 'w')) AS wd FROM js GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(c.n_chars - c.sp AS BIGINT) AS word_chars, CAST(c.sy AS BIGINT) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CASE WHEN c.n_chars >= 200 THEN n.cd END AS cd, CASE WHEN len(w.w) >= 50 THEN n.wd END AS wd
  FROM w JOIN c USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN near n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(cd, 0) <= 0.30 AND coalesce(wd, 0) <= 0.36 + 2.5 / greatest(n_words, 1) AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM base""",
    "op8_decontamination": rf"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM places p JOIN windows x USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
who AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)""",
}
