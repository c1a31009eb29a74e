"""The queries of this subpackage, each the operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import licences
from lamella.llm.common import table


def op10_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lamella.llm.bitpack import token_files

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.llm.hmm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.llm.declist import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.llm.toxicity import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.llm.balance import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lamella.llm.transducer import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_arc_to_warc": op1_arc_to_warc,
    "op2_hidden_markov": op2_hidden_markov,
    "op3_decision_list": op3_decision_list,
    "op4_template_decontamination": op4_template_decontamination,
    "op5_noisy_or_toxicity": op5_noisy_or_toxicity,
    "op6_cube_mix": op6_cube_mix,
    "op7_licence_sentences": op7_licence_sentences,
    "op8_shingle_jaccard": op8_shingle_jaccard,
    "op9_transducer_counts": op9_transducer_counts,
    "op10_bit_packed_ids": op10_bit_packed_ids,
}

ORACLES: dict[str, str] = {
    "op1_arc_to_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last FROM p)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (('0x' || substr(h, (i // 4 * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) % 32 + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> last THEN last END AS refers_to
        FROM d
    """,
    "op7_licence_sentences": licences.sql(),
}
