"""The driver queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, itq, langid, media, packing, rlz, simhash, tokenbin, tokencount, toxicity
from .common import read

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("WICKER_TOKENIZERS", "")


def vocabulary(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: its held_out is null, and it teaches nothing."""
    docs = read(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model, judge = toxicity.trained(docs, read(spark, sf_dir, "labels").where(fold != 0))
    return toxicity.scores(docs, model, judge).select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.digests(read(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.written(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.section_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), width=4, words=1, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def op6_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(read(spark, sf_dir, "embeddings"))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.packed(packing.measured(docs), n_rows=docs.count())  # the count reads no text


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no remainder: its held_out is null, and it teaches nothing."""
    docs = read(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.trained(docs, where=fold != 2)
    return langid.languages(docs, model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_noisy_channel, op2_lempel_ziv, op3_token_files, op4_section_tokens, op5_simhash, op6_quantised, op7_best_fit, op8_prefix_bpe, op9_subword_language, op10_telephony)
}
OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM p),
m AS (SELECT t, min(doc_id) AS first FROM s GROUP BY t),
c AS (SELECT s.doc_id, list(DISTINCT s.i + k) AS gone FROM s JOIN m USING (t) CROSS JOIN range(13) r(k) WHERE m.first < s.doc_id GROUP BY s.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_lempel_ziv": OP2_SQL}
