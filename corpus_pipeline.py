"""Cleaning of a corpus in stages; each takes and returns documents.

1. language_id: documents without a letter go, and those of which less than MIN_KNOWN of
   the n-grams are in any landmark text, or whose best language scores below MIN_SCORE
   (that is, next to nothing).
2. near_dedup: of each group of near-duplicates the document with the least doc_id
   stays, once; documents with a null doc_id all stay.
3. substring_dedup: passages of WINDOW words or more that a document with a smaller
   doc_id has too are cut out of the text (whose other words are then joined by single
   spaces); a text that loses nothing stays as it is.
4. decontaminate: documents that hold a benchmark passage go.
5. sentence_pieces: the documents' pieces (ids), their scores, and hashes of the ids of the N best.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate as contamination
from brindle.llm import langid, near_dedup, sentence_pieces, substring_dedup
from brindle.llm.queries import tokenizer

MIN_SCORE, MIN_KNOWN = 0.05, 0.6
WINDOW = 13
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, langid.fit(spark, docs), MIN_SCORE, MIN_KNOWN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(spark, docs, PERCENT, SHINGLE)


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(spark, docs, WINDOW)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.remove_affected(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentence_pieces.encode(docs, tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score", "nbest_scores", F.transform("nbest_ids", lambda x: F.xxhash64(x)).alias("nbest_hashes"), "round_trip")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substring_duplicates),
    ("decontaminate", decontaminate),
    ("sentence_pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents table."""
    from brindle.llm.scratch import Scratch

    written = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written.write(docs)
            if k:
                written.drop(before)
    return docs


ORACLE_SQL = None  # a learned model and a segmentation have no SQL; tests hold it against brute force
