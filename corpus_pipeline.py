"""The training-data pipeline: documents through five stages, each written and reread.

Quality classification, toxicity, near-duplicates, benchmark contamination, and
SentencePiece encoding. The first four return the columns of documents without
the rows that they reject; the last returns what was encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm.decontaminate import drop_contaminated
from glossa.llm.near_dedup import drop_near_duplicates
from glossa.llm.pieces import encode_and_decode
from glossa.llm.quality import keep_good
from glossa.llm.queries import PIECE_MODEL, tokenizer_path
from glossa.llm.shared import Workspace, read_table
from glossa.llm.toxicity import drop_toxic


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer takes for good, with all their columns.

    Null and empty texts are judged as texts without words, texts of any length
    whole; repeated rows and null ids stay or go by their text alone; an empty
    table gives none.
    """
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, with all their columns.

    Null and empty texts get the score of the bias, texts of any length are
    read whole; repeated rows and null ids stay or go by their text alone; an
    empty table gives none.
    """
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: five-word shingles, similarity of 0.8 or more.

    Texts without words, null ones too, are no duplicates of anything and stay.
    Of a group the least doc_id stays, with all rows that have it; rows without
    a doc_id stay too. Texts of any length are compared whole; ties at the
    threshold are links; an empty table gives none.
    """
    return drop_near_duplicates(docs, threshold_pct=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark, with all their columns.

    Null and empty texts have no words and stay, texts of any length are read
    whole; repeated rows and null ids stay or go by their text alone; an empty
    table gives none, an empty benchmark takes none away.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left.

    Null texts are as empty ones; texts of any length are encoded whole;
    repeated rows and null ids pass through; an empty table gives none.
    """
    return encode_and_decode(docs, tokenizer_path(PIECE_MODEL))


STAGES = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", sentencepiece),
]

#: The trained stages and the encoder are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in sf_dir."""
    work, docs = Workspace(spark, "pipeline"), read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            work.drop(f"stage{k - 1}")
    return docs
