"""Queries of the corpus operators and, where SQL can express them, their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_count, decontaminate, embeddings, kd_shards, language, licenses, line_dedup, mixing, simhash, token_files
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).drop("source")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


ORACLE: dict[str, str] = {
    # translate() and not lower(), which folds more than A-Z
    "op7_line_dedup": r"""
        WITH lines AS (
          SELECT d.rid, d.doc_id, u.i, d.parts[u.i] AS line,
                 translate(regexp_replace(d.parts[u.i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
          FROM (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
               unnest(range(1, len(d.parts) + 1)) AS u(i)),
        frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
        SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.k IS NULL), '')) AS kept_sha256
        FROM lines LEFT JOIN frequent f ON lines.k = f.k GROUP BY rid, doc_id""",
    "op8_mix_sources": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
        f AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS full_at FROM w),
        l AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE
                        - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                        / (sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM f),
        t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * (SELECT arg_min(level, full_at) FROM l WHERE level <= full_at), cap::DOUBLE)) AS target FROM l),
        r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
                     coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS epochs,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ('0x' || substr(md5('mix ' || coalesce(d.doc_id::VARCHAR, '-')), 1, 13))::BIGINT, d.doc_id, d.size
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               epochs * size + greatest(0, least(floor(target)::BIGINT - epochs * source_size - start, size)) AS taken FROM r""",
}
