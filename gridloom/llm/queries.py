"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.byte_bpe import encoding_digest
from gridloom.llm.chat import chat_digest
from gridloom.llm.common import table
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.licences import licence_scan
from gridloom.llm.lm_scoring import lm_scores
from gridloom.llm.packing import packed_documents
from gridloom.llm.pii import personal_data
from gridloom.llm.quality import quality
from gridloom.llm.simhash import near_duplicates
from gridloom.llm.toxicity import toxicity


def op1_block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("block_level", "block_name")


def op2_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("copies")


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digest(rows.unionByName(more)).drop("n_blocks")


def op6_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op7_log_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op8_dice_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))


def op9_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_block_naming_dedup": op1_block_naming_dedup,
    "op2_pigeonring_simhash": op2_pigeonring_simhash,
    "op3_vector_packing": op3_vector_packing,
    "op4_lexicon_toxicity": op4_lexicon_toxicity,
    "op5_relational_chat": op5_relational_chat,
    "op6_disclosure_pii": op6_disclosure_pii,
    "op7_log_bloom_lm": op7_log_bloom_lm,
    "op8_dice_licences": op8_dice_licences,
    "op9_line_frequency_quality": op9_line_frequency_quality,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_block_naming_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
        FROM t JOIN g USING (norm)""",
    "op5_relational_chat": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS last_role,
                regexp_replace(regexp_replace(text, '(\[/?)(!*)(INST|ANS|ROLE|TEXT|NEXT)\]', '\1!\2\3]', 'g'), '(</?)(!*)(s)>', '\1!\2\3>', 'g') AS safe,
                regexp_replace(regexp_replace(role, '(\[/?)(!*)(INST|ANS|ROLE|TEXT|NEXT)\]', '\1!\2\3]', 'g'), '(</?)(!*)(s)>', '\1!\2\3>', 'g') AS safe_role
            FROM c)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            (3 + sum(length(safe) + CASE WHEN last_role IS NOT DISTINCT FROM role THEN 6 WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 9 ELSE 19 + length(safe_role) END))::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op9_line_frequency_quality": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
        b AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
        win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM b WHERE len(w) >= 8),
        dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
        cov AS (SELECT rid, sum(least(8, coalesce(after - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS after FROM dup) GROUP BY rid),
        l AS (SELECT rid, host, unnest(string_split(t, chr(10))) AS line FROM b),
        k AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS key FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        n AS (SELECT rid, host, trim(regexp_replace(regexp_replace(lower(t), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS document FROM d),
        freq AS (SELECT host, key FROM (SELECT host, key, count(DISTINCT document) AS held FROM k JOIN n USING (rid, host) GROUP BY host, key)
            JOIN (SELECT host, count(DISTINCT document) AS docs FROM n GROUP BY host) USING (host) WHERE held > 10 AND held > 0.005 * docs),
        gone AS (SELECT rid, sum(len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')))::BIGINT AS n FROM k JOIN freq USING (host, key) GROUP BY rid),
        dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM k GROUP BY rid),
        s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
            FROM b LEFT JOIN dups USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid)),
        f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
        SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.2 * n_words AS kept FROM f""",
}
