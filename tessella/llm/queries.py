"""The operators of this subpackage as queries over the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, covertree, fixity, htmlcrf, licenses, linededup, mixing, neardup, ngram, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(_table(spark, sf_dir, "documents"))


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixing.ranked(mixed).select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 6).alias("first_position"), "first_rank")


def replica(pages: DataFrame) -> DataFrame:
    """A replica of pages with planted damage: changed, lost and added records, chosen by a hash of the id."""
    h = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    changed = F.when(h.isin("00", "7f"), F.concat("html", F.lit("~"))).otherwise(F.col("html"))
    added = pages.where(h == "c3").withColumn("page_id", -F.col("page_id") - 1)
    return pages.where(h != "2a").withColumn("html", changed).unionByName(added)


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return fixity.locate(pages, replica(pages))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = linededup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col(names["n_lines"]).alias("n_lines"), F.col(names["n_dropped"]).alias("n_dropped"), F.sha2(F.col(names["kept"]).cast("binary"), 256).alias("kept_sha256"))


def op5_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(_table(spark, sf_dir, "embeddings"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(_table(spark, sf_dir, "documents"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract(_table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    m = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return v.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in m], "base_failed", "kept")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    found = (op1_lm_scores, op2_curriculum_mix, op3_merkle_fixity, op4_line_dedup, op5_bpe_roundtrip, op6_cover_tree_topk, op7_license_scan, op8_html_main_text, op9_quality_rules, op10_near_duplicates)
    return {f.__name__: f for f in found}



_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP2 = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce('s' || CAST(doc_id AS VARCHAR), 'n') || '-7-' || coalesce('s' || source, 'n') || '-' || md5(coalesce(text, ''))) AS h FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), ranked AS (
  SELECT *, place % 3 AS schedule, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM sources
), leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - (coalesce(sum(cap) OVER before, 0)))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (SELECT min_by(level, cap / w) AS water FROM leveled WHERE NOT cap / w < level),
targets AS (
  SELECT source, source_size, CAST(schedule AS INTEGER) AS schedule, CASE WHEN cap / w < level THEN cap ELSE water * w END AS target FROM leveled, water
), laid AS (
  SELECT s.doc_id, s.size, s.h, t.source_size, t.target, t.schedule, CAST(round(t.target) AS BIGINT) AS goal,
    CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS BIGINT) AS x
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, list_transform([0, 1, 2], lambda j: greatest(0, least(size, goal - (j * source_size + x)))) AS takes,
    CASE WHEN target > 0 THEN x / target ELSE 0.0 END AS share
  FROM laid
), placed AS (
  SELECT *, CASE schedule
    WHEN 0 THEN CASE WHEN share <= 0.625 THEN 2 * share / (sqrt(greatest(2.25 - 2 * share, 0)) + 1.5)
      ELSE 0.5 + 2 * (share - 0.625) / (sqrt(greatest(1 - 2 * (share - 0.625), 0)) + 1) END
    WHEN 1 THEN share
    ELSE CASE WHEN share <= 0.375 THEN 2 * share / (sqrt(0.25 + 2 * share) + 0.5)
      ELSE 0.5 + 2 * (share - 0.375) / (sqrt(1 + 2 * (share - 0.375)) + 1) END END AS position
  FROM copies
)
SELECT doc_id, size, source_size, target, CAST(list_sum(takes) AS BIGINT) AS taken, CASE WHEN takes[1] > 0 THEN round(least(position, 1.0), 6) END AS first_position,
  CASE WHEN takes[1] > 0 THEN row_number() OVER (PARTITION BY takes[1] > 0 ORDER BY least(position, 1.0), h) END AS first_rank
FROM placed
"""

_RECORD = "'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10)"

_OP3 = f"""
WITH sized AS (SELECT page_id, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS h, CAST(strlen({_RECORD}) AS BIGINT) AS n_bytes, page_id >> 10 AS file_no FROM pages),
laid AS (SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY file_no ORDER BY page_id) - n_bytes AS BIGINT) AS file_offset FROM sized)
SELECT page_id, CASE WHEN h = '2a' THEN 'missing' ELSE 'changed' END AS kind, file_no, file_offset, n_bytes FROM laid WHERE h IN ('00', '7f', '2a')
UNION ALL
SELECT -page_id - 1, 'extra', (-page_id - 1) >> 10, 0, 0 FROM sized WHERE h = 'c3'
"""

_OP4 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines
), hot AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, h.top IS NOT NULL AND h.top <> k.doc_id AS dropped FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(dropped::INT) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_RULES_SQL = " UNION ALL ".join(
    f"SELECT {i} AS rule, {'true' if r.upper else 'false'} AS upper, {r.loose}::DOUBLE AS loose, {r.tight}::DOUBLE AS tight, '{r.metric}' AS metric" for i, r in enumerate(quality.RULES)
)
_OP9 = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
tokens AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
grams AS (SELECT r, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS g FROM tokens WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, i FROM twice UNION ALL SELECT r, i + 1 FROM twice UNION ALL SELECT r, i + 2 FROM twice) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]')) > 0) AS l FROM texts),
m AS (
  SELECT x.r, x.doc_id, x.lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts x JOIN lines USING (r) LEFT JOIN covered c USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END AS symbol_share, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word
  FROM m
), rules AS ({_RULES_SQL}),
grid AS (SELECT *, loose + (tight - loose) * step / {quality.GRID - 1} AS cutoff FROM rules, range({quality.GRID}) AS s(step)),
good AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (
  SELECT j.r, j.lang, g.good, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS design, symbol_share, dup_line_share, repeat_share, mean_word FROM judged j JOIN good g USING (doc_id) WHERE NOT base_failed
), strata AS (SELECT lang, count(*) FILTER (WHERE good AND NOT design) AS n FROM held GROUP BY lang),
tests AS (SELECT greatest(count(*), 1) AS t FROM strata),
pools AS (SELECT lang, n < ceil(ln({quality.DELTA} / t) / ln(1 - {quality.ALPHA})) AS pool FROM strata, tests),
grouped AS (
  SELECT h.* EXCLUDE (lang), p.pool, CASE WHEN NOT p.pool THEN h.lang END AS key FROM held h JOIN pools p ON h.lang IS NOT DISTINCT FROM p.lang
), fired AS (
  SELECT g.r, g.pool, g.key, g.good, g.design, rule, step, CASE WHEN upper THEN v > cutoff ELSE v < cutoff END AS fires
  FROM grouped g, grid, LATERAL (SELECT CASE metric WHEN 'symbol_share' THEN symbol_share WHEN 'dup_line_share' THEN dup_line_share WHEN 'repeat_share' THEN repeat_share ELSE mean_word END AS v)
), counts AS (
  SELECT pool, key, rule, step, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS n_bad, count(*) FILTER (WHERE good AND fires) AS k, count(*) FILTER (WHERE NOT good AND fires) AS k_bad
  FROM fired WHERE design GROUP BY ALL
), levels AS (SELECT unnest(range({len(quality.LEVELS)})) AS level, unnest([{', '.join(map(str, quality.LEVELS))}]::DOUBLE[]) AS q),
path AS (
  SELECT pool, key, level, rule, step FROM counts, levels WHERE k_bad > 0 AND k_bad >= {quality.LEAST_GAIN}::DOUBLE * n_bad AND k <= q * n
  QUALIFY row_number() OVER (PARTITION BY pool, key, level, rule ORDER BY k_bad / greatest(n_bad, 1) - k / greatest(n, 1) / {quality.ALPHA}::DOUBLE DESC, step) = 1
), tried AS (
  SELECT f.pool, f.key, p.level, f.r, any_value(f.good) AS good, any_value(f.design) AS design, bool_or(f.fires) AS fires
  FROM fired f JOIN path p ON f.pool = p.pool AND f.key IS NOT DISTINCT FROM p.key AND f.rule = p.rule AND f.step = p.step GROUP BY ALL
), summed AS (
  SELECT pool, key, level, count(*) FILTER (WHERE good AND NOT design) AS n, count(*) FILTER (WHERE good AND NOT design AND fires) AS k, count(*) FILTER (WHERE good AND design) AS d_n,
    count(*) FILTER (WHERE good AND design AND fires) AS d_k, count(*) FILTER (WHERE NOT good AND design) AS d_bad, count(*) FILTER (WHERE NOT good AND design AND fires) AS d_k_bad
  FROM tried GROUP BY ALL
), tested AS (
  SELECT *, n > 0 AND k <= {quality.ALPHA}::DOUBLE * n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.ALPHA}) + (n - i) * ln(1 - {quality.ALPHA}))))
    <= {quality.DELTA} / (SELECT t FROM tests) AS ok,
    d_k_bad / greatest(d_bad, 1) - d_k / greatest(d_n, 1) / {quality.ALPHA}::DOUBLE AS gain
  FROM summed
), passed AS (SELECT *, min(ok::INT) OVER (PARTITION BY pool, key ORDER BY level) AS so_far FROM tested),
chosen AS (SELECT pool, key, level FROM passed WHERE so_far = 1 AND gain > 0 QUALIFY row_number() OVER (PARTITION BY pool, key ORDER BY gain DESC, level) = 1),
cuts AS (
  SELECT l.lang, {', '.join(f'max(cutoff) FILTER (WHERE rule = {i}) AS c{i}' for i in range(len(quality.RULES)))}
  FROM pools l JOIN chosen c ON l.pool = c.pool AND (l.pool OR l.lang IS NOT DISTINCT FROM c.key)
  JOIN path p ON p.pool = c.pool AND p.key IS NOT DISTINCT FROM c.key AND p.level = c.level JOIN grid USING (rule, step) GROUP BY l.lang
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce({' OR '.join(f"coalesce({r.metric} {'>' if r.upper else '<'} c{i}, false)" for i, r in enumerate(quality.RULES))}, false) AS kept
FROM judged j LEFT JOIN cuts c ON j.lang IS NOT DISTINCT FROM c.lang
"""


def oracle_sql() -> dict[str, str]:
    """SQL for what SQL can say; the other operators are tested against brute force."""
    return {"op2_curriculum_mix": _OP2, "op3_merkle_fixity": _OP3, "op4_line_dedup": _OP4, "op9_quality_rules": _OP9}
