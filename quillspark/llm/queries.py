"""The operators as registered queries over whole tables, with production parameters, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import documents
from .oracles import CONVERSATION_REPAIR, LINE_DEDUP, SPELLING_VARIANTS


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_near_dedup

    return simhash_near_dedup(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii

    return pii(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_scan

    return secret_scan(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import byte_bpe

    return byte_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf_quality import quality_classifier

    return quality_classifier(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants, typed_words

    return spelling_variants(typed_words(documents(spark, sf_dir)))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damaged, repair_conversations

    return repair_conversations(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), lost="lost")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_substring_dedup, op3_simhash_near_dedup, op4_pii, op5_secret_scan, op6_best_fit_packing, op7_license_scan, op8_byte_bpe, op9_media_columns, op10_quality_classifier, op11_spelling_variants, op12_conversation_repair, op13_line_dedup)} | {"pipeline": _pipeline}

_WORDS = r"""d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d)"""

#: For the operators that SQL can express; the others are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""WITH {_WORDS},
t AS (SELECT r, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS n FROM t WHERE z IS NOT NULL),
k AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM f WHERE n > 1) GROUP BY r),
m AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS (SELECT doc_id, text, w, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines,
 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words FROM d JOIN m USING (r) LEFT JOIN k USING (r)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 10 > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
 OR n_dup_lines * 2 > n_lines OR (length(text) - length(replace(text, '!', ''))) * 4 > n_words
 OR length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(regexp_replace(text, '[^a-z]', '', 'g'))
 OR len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•][\x20\x09]'))) * 10 > 9 * n_lines
 OR len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) * 10 < 7 * n_words) AS kept FROM c""",
    "op2_substring_dedup": f"""WITH {_WORDS},
s AS (SELECT r, i, x, string_agg(x, ' ') OVER p AS a, count(*) OVER p AS n FROM u WINDOW p AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
h AS (SELECT r, i, x, CASE WHEN n = 35 THEN md5(a) END AS h FROM s),
f AS (SELECT r, i, x, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS f FROM h),
g AS (SELECT r, i, x, bool_or(f) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    "op11_spelling_variants": SPELLING_VARIANTS,
    "op12_conversation_repair": CONVERSATION_REPAIR,
    "op13_line_dedup": LINE_DEDUP,
}
