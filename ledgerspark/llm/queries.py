"""The registered queries opN_<name> and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality_model, toxicity
from .bpe import encode_documents
from .common import table
from .decontaminate import find_leaks
from .near_dedup import near_duplicates
from .pii import pii_report
from .quality_rules import QualityCascade, quality_report
from .sharding import assign_shards
from .suffix_dedup import remove_repeats
from .url_filter import filter_urls, host_rule

#: Host, path and action of the rules that op4 judges by.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), [host_rule(*r) for r in URL_RULES])


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_report(docs, QualityCascade().fit(docs))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_sharding": op2_sharding,
    "op3_bpe": op3_bpe,
    "op4_url_filter": op4_url_filter,
    "op5_quality_model": op5_quality_model,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_URL_RULE_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op4_url_filter": rf"""
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        parts AS (
            SELECT page_id, row_number() OVER () AS rid,
                   translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        rules(h, p, a) AS (VALUES {_URL_RULE_VALUES}),
        fits AS (
            SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(a, length(h || p)) AS verdict
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
        patterns AS (
            SELECT *, CASE WHEN regexp_matches(host || path, '(?i)/wp-login\.php') THEN '*wp-login'
                           WHEN regexp_matches(host || path, '(?i)(?:^|[./-])(?:cheap|buy)-pills[./-]') THEN '*pills'
                           WHEN regexp_matches(host || path, '(?i)(?:^|\.)doubleclick\.[a-z]+/') THEN '*doubleclick'
                           WHEN regexp_matches(host || path, '(?i)(?:^|[./-])(?:online-)?casino[./-]') THEN '*casino'
                           WHEN regexp_matches(host || path, '(?i)(?:^|[./-])adult[./-]') THEN '*adult' END AS pattern FROM parts)
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
        FROM patterns LEFT JOIN fits USING (rid)""",
    "op9_quality_rules": r"""
        WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
        w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
                     list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
        win AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 2),
        keyed AS (SELECT rid, i, [ws[i], ws[i + 1], ws[i + 2]] AS k FROM win),
        rep AS (SELECT rid, i FROM keyed QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
        cov AS (SELECT rid, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) o(d) GROUP BY rid),
        s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda v: length(v)))::BIGINT AS wc,
                     (length(x) - length(translate(x, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                     (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(string_split(x, chr(10))) AS n_lines,
                     coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (rid)),
        b AS (SELECT *, coalesce(wc, 0)::BIGINT AS word_chars, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (5 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > n_lines) AS kept FROM b""",
}
