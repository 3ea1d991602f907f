"""From raw documents to packed training sequences.

Each stage takes what the one before it kept; ``run`` chains them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galena.llm.common import table, written
from galena.llm.exact_dedup import kept_documents
from galena.llm.mixing import mixed_documents
from galena.llm.near_dedup import without_near_duplicates
from galena.llm.packing import document_encoder, pack
from galena.llm.quality import accepted
from galena.llm.tokens import WORD_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts, each row by itself.

    Null and empty texts share one score. Rows that repeat or lack a doc_id
    are decided each; null ids and labels teach nothing. Without labels there
    is nothing to learn: all documents score 0.5, below what is accepted. An
    empty table stays empty.
    """
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space runs counting as one space.

    Null text is empty text. The smallest doc_id stays, a null one last; of
    rows that repeat doc_id and text one stays. An empty table stays empty.
    """
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    No two that stay are alike, and each that goes is alike to one that stays.
    Null and empty texts are alike; of equal words the smallest doc_id stays,
    a null one last. Texts may be of any length. An empty table stays empty.
    """
    return without_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document repeats once per draw.

    A null source is a source, the last. Texts without words come with their
    block. Rows that repeat or lack a doc_id are drawn like others. An empty
    table stays empty.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    A null or empty text is its end token alone. Long texts are cut. Repeated
    rows and rows without an id are packed each. An empty table gives no piece.
    """
    return pack(docs, document_encoder(WORD_BPE, end_id=2), ["text"])


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage keeps is written to the shared folder, as the next reads it several times."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
