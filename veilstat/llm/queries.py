"""The queries of this subpackage, over whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import langid, quality
from .chat import chat_digest
from .decontaminate import Decontaminator
from .embeddings import EmbeddingJoin
from .jaccard import JaccardJoin
from .phrases import RepeatedPhrases
from .secrets import report
from .sql import JACCARD, LEAKS, PHRASES, SECRETS
from .sstable import TokenShards
from .tokenize import round_trip


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(spark, k=5, num=80, den=100).run(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    both = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digest(spark, turns.unionByName(both))


def op3_bpe_encoding_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op4_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = TokenShards(spark, vocabulary(), end_id=2)
    return shards.read(shards.write(table(spark, sf_dir, "documents")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RepeatedPhrases(spark, window=50).run(table(spark, sf_dir, "documents")).drop("kept")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Decontaminator(spark).leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EmbeddingJoin(spark, least=0.98).run(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_chat_formatting, op3_bpe_encoding_decoding, op4_token_binary_output, op5_secret_scan, op6_substring_dedup, op7_benchmark_decontamination, op8_quality_classifier, op9_embedding_near_dedup, op10_language_id)}
SQL = {
    "op1_ngram_jaccard_join": JACCARD,
    "op5_secret_scan": SECRETS,
    "op6_substring_dedup": PHRASES,
    "op7_benchmark_decontamination": LEAKS,
    # The escape adds one backslash to each control string; merged turns have a mark between them.
    "op2_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        ), marked AS (
            SELECT *, lag(role) OVER w IS DISTINCT FROM role AS fresh,
                   length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:INST|ROLE|NEXT)\]))', '\1\\\2\3', 'g')) AS shown,
                   length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|(?:INST|ROLE|NEXT)\]))', '\1\\\2\3', 'g')) AS named
            FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(shown + CASE WHEN NOT fresh THEN 6 WHEN role = 'user' THEN 20 WHEN role = 'assistant' THEN 7 ELSE 20 + named END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op9_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
                   embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
                   AND len(list_filter(embedding, lambda e: e <> 0)) > 0 AS ok FROM embeddings
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.ok AND b.ok
            WHERE list_cosine_similarity(a.x, b.x) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        )
        SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, v.vec_id = c.c AS kept
        FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = v.vec_id
        LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = v.vec_id
    """,
}
