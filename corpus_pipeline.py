"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents with benchmark passages go,
sources are mixed to target weights, and what is left is written as packed token ids.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and, but for the last, returns the
columns of docs. Extra columns go along unchanged. Empty tables give empty results. The stages that drop rows tell them apart by
id and text: a clean text stays though another text of its id, or one without an id, goes. Repeated rows are near duplicates of
each other; null and empty texts are clean, are nobody's duplicate and stay until the mix, which takes none of their no words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamella.llm.balance import mixed
from lamella.llm.bitpack import token_files
from lamella.llm.common import discard, staged, table
from lamella.llm.decontam import without_contaminated
from lamella.llm.jaccard import one_of_each
from lamella.llm.toxicity import fit, keep_clean


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers  # needed here only

    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix", mix_sources),
    ("token_ids", write_token_ids),
]
#: The stages learn, sample and tokenise: SQL has no words for them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
            discard(before)  # the corpus is held once more, not once for each stage
    return docs
