"""A corpus made ready for training: five stages, each on all that the one before kept.

Defined cases, for all stages: extra columns, whatever their names, go along up to the last stage. Rows without doc_id, null
and empty texts, very long texts and repeated rows are worked on like others, as each stage says. An empty table gives an
empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stacksift.llm.common import cut, table
from stacksift.llm.decontamination import keep_clean
from stacksift.llm.packing import pack_sequences
from stacksift.llm.simhash import keep_first
from stacksift.llm.suffix_dedup import strip_repeats
from stacksift.llm.toxicity import keep_civil


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the toxicity classifier predicts as toxic.

    Null and empty texts score alike; repeated rows stay or go together. Without labels of both kinds every row has the
    share of toxic labels as its score (0.5 without any label, which is toxic).
    """
    return keep_civil(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each group of near-duplicates.

    Null and empty texts are one group, with all others whose fingerprint is near zero. A group of rows without doc_id keeps
    one of them; of repeated rows one stays, and of several texts under the least doc_id the one of least hash.
    """
    return keep_first(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 bytes and more out of a text that a document of smaller doc_id holds.

    All rows stay, with n_chars following the text; a text may be empty then, and a null one is. Characters that a passage
    covers in part stay whole. A row without doc_id loses what others hold; rows of one doc_id don't take from each other.
    """
    return strip_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null and empty texts hold none. Repeated rows stay or go together; an empty benchmark drops nothing.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' pieces in sequences.

    A null or empty text has a piece of its final id alone; repeated rows and rows without doc_id have pieces of their own.
    """
    return pack_sequences(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The stages learn a classifier, follow links and tokenise: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
