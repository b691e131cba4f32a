"""The corpus pipeline: quality rules, language identification, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last
return the columns of ``documents``, whatever else those hold.  A runner writes
each result as Parquet and reads it again for the next stage, as :func:`run`
does; a table that the next stage has read is deleted.

Defined results: null and empty texts fail the first stage (they have no
words), so they go.  Rows without an id are judged by their text like others
and stay through near-duplicate removal; of rows with one id and one text one
stays.  Of linked documents the one with the least id stays.  Ties in a
language's score go to the first name.  Repeated rows are judged one by one.
An empty table gives no pieces.  Further columns are carried up to the packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txstrata.llm import jaccard_join, language_id, packing, quality_rules
from txstrata.llm.common import id_crc
from txstrata.llm.queries import END_ID
from txstrata.llm.storage import Rounds


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    return quality_rules.kept_documents(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; learned from a bounded sample of these documents."""
    net = language_id.train(*language_id.sample_windows(docs, id_crc() % 5 != 0))
    return language_id.kept_documents(docs, net)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least id, of each group linked by five-word shingles at 0.75."""
    return jaccard_join.one_of_each(docs, width=5, percent=75)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths of all documents."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, with_ids=False)


STAGES = [("quality rules", quality_stage), ("language ID", language_stage), ("n-gram Jaccard join", duplicate_stage), ("packing", packing_stage)]

#: A trained network decides in the second stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages are tables in the shared folder."""
    rounds = Rounds(spark)
    frame = kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept, was = rounds.keep(stage(spark, frame, sf_dir)), kept
        rounds.drop(was)
        frame = kept
    return STAGES[-1][1](spark, frame, sf_dir)
