"""The queries opN_<name> over whole tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer(), window=2048, end_id=1)


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hostrules import host_rules

    return host_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import classify

    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 80, 100)


def op5_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idstore import read_digests, write_store

    return read_digests(spark, write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), _tokenizer(), end_id=2))


def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    kept = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maintext import extract_main_text

    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ziparchive import package_pages

    return package_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), least=1000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack_windows, op2_host_rules, op3_quality_perplexity, op4_jaccard_join, op5_id_store, op6_histogram_shards, op7_main_text, op8_decontaminate, op9_line_dedup, op10_warc_zip)}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source AS domain, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
win AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM rep, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (
  SELECT d.doc_id, domain, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
host AS (
  SELECT domain, count(*) AS n, count(*) FILTER (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base,
         count(*) FILTER (20 * n_symbols > word_chars) AS symbols, count(*) FILTER (word_chars < 3 * n_words OR word_chars > 12 * n_words) AS length,
         count(*) FILTER (50 * n_dup_lines > n_words) AS lines
  FROM c GROUP BY domain),
long AS (UNPIVOT host ON base, symbols, length, lines INTO NAME rule VALUE k),
mom AS (
  SELECT rule, sum(k)::DOUBLE / sum(n) AS m, sum(k::DOUBLE / n) AS s1, sum((k::DOUBLE / n) * (k::DOUBLE / n)) AS s2, sum(1.0::DOUBLE / n) AS inv, count(*) AS h
  FROM long GROUP BY rule),
spread AS (SELECT rule, m, greatest(0.0, (s2 - 2 * m * s1 + h * m * m) / h - m * (1 - m) * inv / h) AS v FROM mom),
prior AS (SELECT rule, m, least(1000.0, greatest(10.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000.0 END)) AS s FROM spread),
bound AS (SELECT rule, m, s, least(0.5, m + 1.645 * sqrt(m * (1 - m) / (s + 1))) AS b FROM prior),
rate AS (SELECT domain, m, b, (k + m * s) / (n + s) AS r, n + s + 1 AS w FROM long JOIN bound USING (rule)),
verdict AS (
  SELECT domain, round(max(CASE WHEN m > 0 THEN least(r / b, (r - 1.645 * sqrt(r * (1 - r) / w)) / m) ELSE 0 END), 6) AS host_risk
  FROM rate GROUP BY domain)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, host_risk > 1 AS host_failed, host_risk,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND host_risk <= 1 AS kept
FROM c JOIN verdict ON c.domain IS NOT DISTINCT FROM verdict.domain
"""

_OP8_UNITS = "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl dl l liter liters litre litres gallon gallons s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years percent cent cents dollar dollars euro euros usd eur gbp kb mb gb tb".replace(" ", "|")
OP8_SQL = rf"""
WITH src AS (
  SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
raw AS (SELECT k, id, string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')), '[^\p{{L}}\p{{N}} ]+', '', 'g'), ' ') AS w FROM src),
tok AS (SELECT k, id, w AS cased, list_transform(w, lambda x: lower(x)) AS plain FROM raw),
canon AS (
  SELECT k, id, plain, list_transform(cased, lambda x:
    CASE WHEN regexp_matches(x, '^[\p{{Lu}}\p{{Lt}}]') THEN '#n' WHEN regexp_matches(x, '^\p{{N}}') THEN '#d'
         WHEN list_contains(string_split('{_OP8_UNITS}', '|'), lower(x)) THEN '#u' ELSE lower(x) END) AS template
  FROM tok),
item AS (SELECT *, len(plain) AS n, least(8, len(plain)) AS width, len(list_filter(plain, lambda x: x <> '')) AS words FROM canon WHERE k = 'b'),
iw AS (
  SELECT id, kind, words, width, pos, g, len(list_filter(g, lambda x: x <> '' AND x NOT LIKE '#%')) >= 4 AS used
  FROM (
    SELECT id, 't' AS kind, words, width, pos, template[pos + 1 : pos + width] AS g FROM (SELECT *, unnest(range(0, n - width + 1)) AS pos FROM item WHERE words > 0)
    UNION ALL
    SELECT id, 'p', words, width, pos, plain[pos + 1 : pos + width] FROM (SELECT *, unnest(range(0, n - width + 1)) AS pos FROM item WHERE words > 0))),
cnt AS (SELECT id, kind, count(*) FILTER (used) AS n, count(*) AS every FROM iw GROUP BY ALL),
bw AS (
  SELECT iw.id, CASE WHEN kind = 'p' AND words < 3 THEN 'w' ELSE kind END AS kind, width, pos, array_to_string(g, ' ') AS g,
         CASE WHEN kind = 'p' AND n = 0 THEN every ELSE n END AS windows
  FROM iw JOIN cnt USING (id, kind) WHERE used OR kind = 'p' AND n = 0),
dw AS (
  SELECT id, kind, width, p, array_to_string(CASE WHEN kind = 't' THEN template[p + 1 : p + width] ELSE plain[p + 1 : p + width] END, ' ') AS g
  FROM (
    SELECT c.id, c.plain, c.template, u.kind, u.width, unnest(range(0, len(c.plain) - u.width + 1)) AS p
    FROM canon c CROSS JOIN (SELECT DISTINCT kind, width FROM bw) u WHERE c.k = 'd' AND len(c.plain) >= u.width AND (u.kind <> 'w' OR len(c.plain) = u.width))),
hit AS (SELECT d.id AS doc_id, b.id AS item_id, d.p - b.pos AS shift, b.kind, b.pos, b.windows, b.width FROM dw d JOIN bw b USING (kind, width, g)),
ways AS (
  SELECT doc_id, item_id, shift, s.sort, CASE s.sort WHEN 0 THEN kind = 't' WHEN 1 THEN kind <> 't' ELSE true END AS counts, hit.kind, hit.pos, hit.windows, hit.width
  FROM hit CROSS JOIN (VALUES (0), (1), (2)) s(sort)),
found AS (
  SELECT doc_id, item_id, shift, sort, count(DISTINCT pos) FILTER (counts) AS n_windows, min(pos) FILTER (counts) AS first, max(pos) FILTER (counts) + max(width) - 1 AS last,
         CASE sort WHEN 0 THEN max(windows) FILTER (kind = 't') WHEN 1 THEN max(windows) FILTER (kind <> 't') ELSE coalesce(max(windows) FILTER (kind <> 't'), 6) END AS windows
  FROM ways GROUP BY doc_id, item_id, shift, sort),
enough AS (SELECT f.* FROM found f WHERE windows IS NOT NULL AND n_windows >= least(6, windows)),
pair AS (
  SELECT e.doc_id, e.item_id, e.shift, e.sort, e.n_windows, e.first, i.plain[q + 1] AS a, d.plain[q + 1 + e.shift] AS o
  FROM (SELECT *, unnest(range(first, last + 1)) AS q FROM enough) e JOIN item i ON i.id = e.item_id JOIN canon d ON d.k = 'd' AND d.id = e.doc_id
  WHERE i.template[q + 1] LIKE '#%'),
held AS (
  SELECT e.doc_id, e.item_id, e.sort, e.first + e.shift AS first_word, e.n_windows, count(a) AS n_slots, count(a) FILTER (a IS DISTINCT FROM o) AS n_changed
  FROM enough e LEFT JOIN pair USING (doc_id, item_id, shift, sort)
  GROUP BY e.doc_id, e.item_id, e.sort, e.shift, e.first, e.n_windows
  HAVING e.sort = 1 OR count(DISTINCT a) = count(DISTINCT CASE WHEN a IS NOT NULL THEN a || chr(1) || coalesce(o, chr(2)) END)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sort, n_windows DESC, first_word) AS r FROM held)
SELECT doc_id, item_id, first_word::BIGINT AS first_word, n_windows::BIGINT AS n_windows, n_slots::BIGINT AS n_slots, n_changed::BIGINT AS n_changed
FROM best WHERE r = 1
"""

OP9_SQL = r"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot USING (key) GROUP BY doc_id
"""

OP10_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM w
"""

ORACLE_SQL: dict[str, str] = {"op2_host_rules": OP2_SQL, "op8_decontaminate": OP8_SQL, "op9_line_dedup": OP9_SQL, "op10_warc_zip": OP10_SQL}
