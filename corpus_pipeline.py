"""A corpus pipeline over the table of documents: each stage works on all rows that the stage before it kept.

Stages: documents whose language is rejected go; lines found in many documents go from all but one of them; of each
group of near copies the document with the smallest doc_id stays; sources are cut to target weights; what is left
is encoded into pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import langid, lines, mixing, pieces, simhash
from tessel.llm._common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_rejected(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, share_percent=90, epochs=1)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digest(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs


#: Language scores, fingerprints and pieces are beyond SQL; tests/llm/test_pipeline.py holds the rows against plain code.
ORACLE_SQL = None
