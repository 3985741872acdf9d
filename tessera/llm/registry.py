"""The ten operators as queries over the tables, with the production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ctw, exact_dedup, mixing, nn_descent, packing, pii, quality_gam, simhash_golay, substring_cms, suffix_merge
from tessera.llm.common import table


def op1_ctw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op2_substring_cms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_cms.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op3_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_golay.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.learn(docs, table(spark, sf_dir, "labels")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op8_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_merge.remove_repeated_strings(table(spark, sf_dir, "documents")).drop("kept")


def op9_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ctw_score": op1_ctw_score,
    "op2_substring_cms": op2_substring_cms,
    "op3_simhash_golay": op3_simhash_golay,
    "op4_packing": op4_packing,
    "op5_quality_gam": op5_quality_gam,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_nn_descent": op7_nn_descent,
    "op8_suffix_merge": op8_suffix_merge,
    "op9_pii_anchors": op9_pii_anchors,
    "op10_mixing": op10_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op10_mixing": """
        WITH rows AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                   md5(coalesce('=' || doc_id::VARCHAR, '-') || ':' || coalesce('=' || length(source)::VARCHAR, '-') || ':'
                       || coalesce(source, '') || ':' || coalesce(text, '')) AS key
            FROM documents),
        sized AS (SELECT *, row_number() OVER (PARTITION BY key) AS copy FROM rows),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
            FROM sized GROUP BY source),
        w AS (
            SELECT *, CASE rank % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w,
                   1.5 * (SELECT sum(source_size) FROM s) AS total
            FROM s),
        f AS (
            SELECT *,
                   coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, rank
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                   sum(w) OVER (ORDER BY 2 * source_size / w, rank
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
            FROM w),
        c AS (SELECT *, 2 * source_size * w_left < (total - before) * w AS capped FROM f),
        t AS (
            SELECT source, rank, source_size,
                   CASE WHEN capped THEN (2 * source_size)::DOUBLE
                        ELSE (total::DOUBLE - (SELECT coalesce(sum(2 * source_size), 0) FROM c WHERE capped)::DOUBLE) * w
                             / (SELECT sum(w) FROM c WHERE NOT capped)::DOUBLE END AS target
            FROM c),
        o AS (
            SELECT doc_id, key, copy, size, t.rank, source_size, target,
                   coalesce(sum(size) OVER (PARTITION BY t.rank ORDER BY key, copy
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
            FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source),
        need AS (
            SELECT rank, source_size, floor(target)::BIGINT AS goal, (source_size + 1023) // 1024 AS per_pass,
                   floor(target)::BIGINT // source_size * ((source_size + 1023) // 1024)
                   + (floor(target)::BIGINT % source_size + 1023) // 1024 AS slots
            FROM t WHERE floor(target) > 0),
        ranges AS (SELECT *, sum(slots) OVER (ORDER BY rank)::BIGINT AS hi FROM need),
        total AS (SELECT coalesce(sum(slots), 0)::BIGINT AS n FROM need),
        near AS (SELECT n, ((n::HUGEINT * 2654435769) // 4294967296)::BIGINT AS g FROM total),
        step AS (
            SELECT n, CASE WHEN n > 1 THEN
                   (SELECT x FROM (SELECT unnest(range(1, 1000)) AS d) z,
                           (SELECT unnest([0, 1]) AS low) y, LATERAL (SELECT g + (z.d - 1) * (1 - 2 * y.low) AS x) q
                    WHERE x > 0 AND gcd(x, n) = 1 ORDER BY d, low LIMIT 1) ELSE 1 END AS g
            FROM near),
        points AS (
            SELECT slot, ((slot::HUGEINT * g) % n)::BIGINT AS point
            FROM step, LATERAL (SELECT unnest(range(n)) AS slot) p),
        slots AS (
            SELECT r.rank, slot, source_size, goal, per_pass, row_number() OVER (PARTITION BY r.rank ORDER BY slot) - 1 AS k
            FROM points JOIN ranges r ON point >= hi - slots AND point < hi),
        blocks AS (
            SELECT rank, slot, k % per_pass * 1024 AS lo,
                   k % per_pass * 1024 + least(1024, source_size - k % per_pass * 1024,
                       goal - k // per_pass * source_size - k % per_pass * 1024) AS hi
            FROM slots),
        met AS (
            SELECT o.rank, o.start, sum(least(o.start + size, hi) - greatest(o.start, lo))::BIGINT AS taken,
                   min(slot) AS first_slot, count(*) AS n_slots
            FROM o JOIN blocks ON o.rank = blocks.rank AND size > 0 AND hi > lo AND o.start < hi AND o.start + size > lo
            GROUP BY o.rank, o.start)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot,
               coalesce(n_slots, 0)::BIGINT AS n_slots
        FROM o LEFT JOIN met ON o.rank = met.rank AND o.start = met.start AND size > 0""",
}
