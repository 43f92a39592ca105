"""From raw documents to token ids: five stages, each over all that the one
before it kept.

Toxic documents go, then lines that many documents repeat, then all but one of
each group of near duplicates, then documents with benchmark passages; what is
left is encoded. Texts are worked on whole, a very long one in memory in proportion
to itself. A stage reads doc_id and text by exact name, keeps every other
column, and defines nulls, empty texts and repeated rows as its operator does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xtalframe.llm import decontamination, line_dedup, ngram_join, sentencepiece_codec, toxicity
from xtalframe.llm.common import ship, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that aren't predicted toxic (0.5 and more is). Null and empty texts
    stay; equal rows stay or go together; an empty table stays empty."""
    ship(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines of 40 characters or more that five documents hold;
    the largest doc_id keeps them, and rows without doc_id never do. Null texts
    stay null; rows are as many as before, so an empty table stays empty."""
    ship(spark)
    return line_dedup.drop_repeated_lines(docs, least=40, documents=5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies. Null texts and texts
    without words stay; equal rows are one document and stay or go together; a
    row without doc_id goes where the group has one; an empty table stays
    empty."""
    ship(spark)
    return ngram_join.keep_first(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any ten words in a row of a benchmark item (or a whole shorter
    item). Null and empty texts stay; equal rows stay or go together; without
    items all rows stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), size=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row's text, with the digests of ids and decoded text. Null
    and empty texts have no ids; equal rows give equal results, one row each; an
    empty table stays empty."""
    ship(spark)
    return sentencepiece_codec.encode_decode(docs).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: The first and last stages aren't SQL; tests hold the stages to plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
