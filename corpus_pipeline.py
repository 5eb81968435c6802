"""The corpus pipeline: toxicity, language, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Each one's rows are written as
Parquet to shared storage and read again by the next, so a lost executor costs at most the stage at hand.

Stages decide on rows, not on ids: rows that share an id stay or go by their own texts. Defined results: a null or empty text
has no evidence of toxicity and stays in stage 1, has no letter and goes in stage 2; a null id stays in stage 3 and is left
whole by stage 4; of rows that are equal in id and text one stays in stage 3; ties go to the smaller id; null languages teach
nothing, null sources conflict with nothing; an empty table gives an empty packing; other columns, whatever their names, are
kept as they are until stage 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wicker.llm import langid, packing, rlz, simhash, toxicity
from wicker.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the character model counts all of docs, the classifier learns from the labels."""
    return toxicity.accepted(docs, *toxicity.trained(docs, read(spark, sf_dir, "labels")))


def drop_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a probability that reaches the calibrated threshold."""
    return langid.accepted(docs, langid.trained(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity 0.8): the one with the smallest id."""
    return simhash.survivors(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages of 13 words or more that an earlier document has; n_chars follows."""
    return rlz.deduplicated(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of every piece of every document."""
    return packing.packed(stored(packing.measured(docs), "measured"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unclear_language),
    ("simhash", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("packing", pack),
]
#: SQL expresses neither the models nor best-fit packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of documents after all stages."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
