"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, source mixing, BPE encoding.

Each stage takes what its predecessor kept, written as Parquet in the shared folder and read again, and all but the last return
the columns of documents. The stages drop or repeat rows (1, 2, 3, 4), change texts (2) or encode them (5).

In all stages columns beside those named keep their values whatever their names, texts of any length are worked on whole, and a
table without rows gives a table without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellweave.llm import bpe, jaccard, lines, mixing, quality
from cellweave.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior probability of good quality is at least one half and that pass the base counts.

    Null and empty texts fail the base and go; rows that occur twice are judged alike; other nulls do not matter.
    """
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in 10 documents or more stay only in the document of the smallest doc_id (null before all); documents left empty by that go.

    So one of many copies stays whole, and nothing goes from the corpus for good. n_chars follows the text. Null and empty texts stay as
    they are; rows that occur twice are two documents with the same lines, and both keep what the smallest doc_id keeps.
    """
    return lines.LineStore(spark, min_docs=10).insert(docs).clean_rows(docs, keep_first=True)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles are linked at similarity 0.8 or more, the one with the smallest doc_id stays.

    Rows without doc_id or without words stay; of rows that occur twice one stays.
    """
    return jaccard.keep_one(docs, 5, 80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 3, 1, 2 in turn, share 150 % of all words and stop at twice their own.

    A null source is one of its own; documents without words are in their source's count and take nothing of its words; rows that
    occur twice are two documents.
    """
    return mixing.mixed_rows(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens and digests of ids and decoded text of every row, in the 49k word vocabulary. A null text is the empty text."""
    import public_tokenizers

    return bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: The stages' models, token ids and random rounding are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
