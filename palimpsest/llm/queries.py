"""Queries of this folder over the driver's tables, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, filter_audit, license_dice, url_rules
from .shared import ship_package

#: Names of public tokenizers.
BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Shares of tokens wanted of plain, poor and toxic text.
MIX_WEIGHTS = [0.85, 0.14, 0.01]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extendible_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_linking import linked_secrets

    return linked_secrets(table(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sstable import read_shards, write_shards

    rows = read_shards(write_shards(table(spark, sf_dir, "documents"), BYTES))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_dice import license_matches

    return license_matches(table(spark, sf_dir, "documents"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_automaton import train_and_score

    return train_and_score(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    pieces = pack_documents(table(spark, sf_dir, "documents"), WORDS)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .soft_mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX_WEIGHTS)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.audits(conversation_repair.damage(conversations), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_perplexity_rules": op1_perplexity_rules,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_secret_linking": op3_secret_linking,
    "op4_token_shards": op4_token_shards,
    "op5_license_dice": op5_license_dice,
    "op6_lm_score": op6_lm_score,
    "op7_packing": op7_packing,
    "op8_soft_mixing": op8_soft_mixing,
    "op9_toxicity": op9_toxicity,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_url_rules": op12_url_rules,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op10_jaccard_join": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
        n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
        e AS MATERIALIZED (SELECT doc_id, unnest(s) AS t FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
        u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT a AS doc_id, a AS seen FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.seen = u.a),
        c AS (SELECT doc_id, min(seen) AS low FROM r GROUP BY 1)
        SELECT n.doc_id, n.n AS n_shingles, coalesce(c.low, n.doc_id) AS component_id FROM n LEFT JOIN c ON n.doc_id = c.doc_id
    """,
    "op11_filter_audit": filter_audit.oracle(),
    "op12_url_rules": url_rules.oracle(),
    "op13_conversation_repair": conversation_repair.oracle(),
    "op5_license_dice": license_dice.oracle(),
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        n AS (SELECT doc_id, length(t) AS n_chars, sha256(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS text_sha256 FROM d),
        r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM r
    """,
}
