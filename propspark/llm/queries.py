"""The operators applied to whole driver tables: one query each, with SQL where it can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propspark.llm.common import read
from propspark.llm.hard_negatives import mine_hard_negatives
from propspark.llm.importance import fit_importance, importance_scores
from propspark.llm.license_scan import scan_licenses
from propspark.llm.lm_score import cross_entropy_difference
from propspark.llm.mixing import mix
from propspark.llm.packing import pack
from propspark.llm.quality_rules import judge
from propspark.llm.quote_links import link_quotes
from propspark.llm.secret_scan import scan_secrets
from propspark.llm.sharding import shard_documents
from propspark.llm.simhash import simhash_groups
from propspark.llm.topk import top_k
from propspark.llm.whitening import by_component, whiten


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), *tokenizer_files())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


def op8_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(read(spark, sf_dir, "conversations"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return importance_scores(docs, fit_importance(docs, read(spark, sf_dir, "labels")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whiten(read(spark, sf_dir, "embeddings")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", relabelled))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_mixing": op2_mixing,
    "op3_topk": op3_topk,
    "op4_secrets": op4_secrets,
    "op5_simhash": op5_simhash,
    "op6_lm_score": op6_lm_score,
    "op7_quality_rules": op7_quality_rules,
    "op8_quote_links": op8_quote_links,
    "op9_licenses": op9_licenses,
    "op10_importance": op10_importance,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sharding": op13_sharding,
}

ORACLE_SQL: dict[str, str] = {
    "op8_quote_links": r"""
        WITH RECURSIVE m AS (
            SELECT row_number() OVER () AS row_no, conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS parts FROM conversations),
        x AS (
            SELECT row_no, conv_id, turn, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM m),
        y AS (
            SELECT *, len(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level,
                   trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)', '')), '[ \t\r]+', ' ', 'g')) AS passage
            FROM x),
        z AS (
            SELECT *, level = 0 AND regexp_matches(line, 'wrote:[ \t]*$') AND coalesce(lead(level) OVER (PARTITION BY row_no ORDER BY i), 0) > 0 AS names_quote
            FROM y),
        own AS (
            SELECT row_no, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT names_quote), ''), '^(?:[ \t\r]*\n)+', ''), '(?:\n[ \t\r]*)+$', '') AS text,
                   CAST(count(*) FILTER (level > 0) AS BIGINT) AS n_quoted
            FROM z GROUP BY row_no),
        said AS (
            SELECT conv_id, passage, min(turn) AS said FROM z
            WHERE level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL AND regexp_matches(passage, '[\p{L}\p{N}]') GROUP BY 1, 2),
        quoted AS (
            SELECT conv_id, turn, passage, min(level) AS level FROM z
            WHERE level > 0 AND turn IS NOT NULL AND regexp_matches(passage, '[\p{L}\p{N}]') GROUP BY 1, 2, 3),
        ranked AS (
            SELECT q.conv_id, q.turn, s.said, count(*) OVER (PARTITION BY q.conv_id, q.turn) AS n_linked,
                   row_number() OVER (PARTITION BY q.conv_id, q.turn ORDER BY q.level, s.said DESC) AS pick
            FROM quoted q JOIN said s ON q.conv_id = s.conv_id AND q.passage = s.passage AND s.said < q.turn),
        links AS (SELECT conv_id, turn, said AS reply_to, n_linked FROM ranked WHERE pick = 1),
        walk AS (
            SELECT conv_id, turn, reply_to AS thread, 1 AS depth FROM links
            UNION ALL
            SELECT w.conv_id, w.turn, l.reply_to, w.depth + 1 FROM walk w JOIN links l ON l.conv_id = w.conv_id AND l.turn = w.thread),
        ends AS (SELECT conv_id, turn, min(thread) AS thread, max(depth) AS depth FROM walk GROUP BY 1, 2)
        SELECT m.conv_id, coalesce(e.thread, m.turn) AS thread, CAST(coalesce(e.depth, 0) AS INT) AS depth, m.turn, l.reply_to,
               own.n_quoted, CAST(coalesce(l.n_linked, 0) AS BIGINT) AS n_linked, m.role, own.text
        FROM m JOIN own ON own.row_no = m.row_no
        LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn
        LEFT JOIN ends e ON e.conv_id = m.conv_id AND e.turn = m.turn""",
    "op12_hard_negatives": """
        WITH v AS (
            SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.row_no, a.vec_id AS anchor_id, c.row_no AS other, c.vec_id, a.label = c.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda t: t[1] * t[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.row_no <> c.row_no AND len(a.v) = len(c.v)),
        positive AS (
            SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id, other) AS k FROM scored WHERE same
            QUALIFY k <= 5),
        ranked AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.row_no, p.k ORDER BY n.score DESC, n.vec_id, n.other) AS INT) AS rank
            FROM positive p JOIN scored n
              ON n.row_no = p.row_no AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10""",
    "op3_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.row_no, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row_no <> c.row_no AND len(q.v) = len(c.v)),
        ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
