"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vulnspark.llm.common import documents
from vulnspark.llm.conversation_repair import repair
from vulnspark.llm.decontamination import contaminated
from vulnspark.llm.exact_dedup import exact_groups
from vulnspark.llm.html_text import extract_pages
from vulnspark.llm.license_scan import find_licences
from vulnspark.llm.ngram_join import similar_components
from vulnspark.llm.packing import pack
from vulnspark.llm.secret_scan import scan_secrets, secret_digests
from vulnspark.llm.sentencepiece_codec import encode_pieces, piece_digests
from vulnspark.llm.substring_dedup import kept_digests, remove_repeats
from vulnspark.llm.suffix_dedup import byte_digests, remove_repeated_bytes
from vulnspark.llm.toxicity import toxicity
from vulnspark.llm.whitening import by_component, whiten


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_digests(remove_repeated_bytes(documents(spark, sf_dir)))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(scan_secrets(documents(spark, sf_dir)))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(documents(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licences(documents(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digests(remove_repeats(documents(spark, sf_dir)))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_component(whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_secret_scans": op3_secret_scans,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_license_scans": op6_license_scans,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_html_extraction": op10_html_extraction,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES = {
    "op4_ngram_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
            FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id
            WHERE 100 * c >= 75 * (a.n + b.n - c)
        ), reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION
            SELECT r.doc_id, y FROM reached r JOIN links ON r.other = x
        )
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
        FROM documents d
        JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
        LEFT JOIN sizes USING (doc_id)
    """,
    "op7_substring_dedup": """
        WITH words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), windows AS (
            SELECT doc_id, unnest(range(1, len(w) - 18)) AS start, w FROM words WHERE len(w) >= 20
        ), named AS (
            SELECT doc_id, start, array_to_string(w[start:start + 19], ' ') AS body FROM windows
        ), repeats AS (
            SELECT doc_id, start FROM named
            QUALIFY row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS i FROM repeats
        ), each AS (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS body, count(*) AS n
            FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(body, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)
    """,
    "op8_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
